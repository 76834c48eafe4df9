"""The filter audit against a plain version; the query itself has SQL."""

import itertools
import re
from collections import Counter

from plain import prose

from voxledger.llm import audit


def fails(rows):
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = []
    for i, _, t in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append(
            {
                "A": len(words) < 50,
                "B": 100 * len(set(words)) < 65 * len(words),
                "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                "D": bool(re.search(r"[#$%&*|]", t)),
                "E": i is not None and first[t] < i,
            }
        )
    return out


def plain(rows, labels):
    failed, want = fails(rows), {}
    good, toxic = ({d for d, *v in labels if v[k] == 1 and d is not None} for k in (0, 1))
    for part in {p or "" for _, p, _ in rows}:
        mine = [(r[0], f) for r, f in zip(rows, failed) if (r[1] or "") == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order):
                gone = [r for r in left if r[1][name]]
                left = [r for r in left if not r[1][name]]
                shapley[name] += len(gone)
                want[part, "".join(order), step + 1] = [
                    len(left),
                    len(gone),
                    sum(f[name] for _, f in mine) - len(gone),
                    sum(f[name] and sum(f.values()) == 1 for _, f in mine),
                    sum(i in good for i, _ in gone),
                    sum(i in toxic for i, _ in gone),
                ]
        for (p, order, step), row in want.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return want


def test_against_plain_version(spark, tmp_path):
    texts = [prose(60 + i % 5, i % 7) for i in range(12)] + ["ABC def " * 40, "a # b", "", None, prose(70) + " $5", "word " * 80, prose(70) + " $5"]
    rows = [(i % 24, ["x", "y", None, ""][i % 4], texts[i % len(texts)]) for i in range(60)]
    rows += [(None, "x", texts[0]), (None, "z", ""), rows[3], rows[3]] + [(100 + i, "hot", "SAME # text") for i in range(40)]
    labels = [(i, i % 2, (i + 1) % 3) for i in range(20)] + [(4, 1, 1), (4, None, 0), (None, 1, 1), (103, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id bigint, source string, text string, kept int, fails_A boolean")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = audit.audit_documents(docs, marks, "doc_id", "source", "text", "quality", "toxic").collect()
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in columns] for r in got} == plain(rows, labels)
    assert len(got) == 600 * 5


def test_empty_tables(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert audit.audit_documents(no_docs, none, "doc_id", "source", "text", "quality", "toxic").count() == 0
    got = audit.audit_documents(odd_docs, none, "doc_id", "source", "text", "quality", "toxic").collect()
    assert len(got) == 600 * len({r["source"] or "" for r in odd_docs.select("source").collect()})
    assert all(r["good_lost"] == r["toxic_lost"] == 0 for r in got)


def test_failing_ids_are_stored_by_filter(spark, tmp_path):
    docs = spark.createDataFrame([(1, "s", "few words"), (2, "s", "few words"), (3, "s", prose(60))], "doc_id bigint, source string, text string")
    failing = audit.store_failing(audit.judge_documents(docs, "doc_id", "source", "text"))
    assert {f: sorted(r["doc"] for r in ids.collect()) for f, ids in failing.items()} == {"A": [1, 2], "B": [], "C": [], "D": [], "E": [2]}
