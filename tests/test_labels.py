from pyspark.sql import functions as F

from voxledger.functions import labels as L
from voxledger.operators import enrichment as E

FALLBACK = ("Uncategorized", "Neutral", 1)
FULL = '{"category": "Bug", "sentiment": "Negative", "urgency_score": %s}'


def one(spark, answers):
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a string")
    out = rows.select("i", L.labels_from_object(F.col("a")).alias("l")).orderBy("i").collect()
    return [tuple(row.l) for row in out]


def test_answer_wrappings(spark):
    body, ok = FULL % 4, ("Bug", "Negative", 4)
    cases = {
        body: ok,
        f"```json\n{body}\n```": ok,
        f"```{body}```": ok,
        f"Sure! {body} Anything else?": ok,
        f"{body} trailing": ok,
        f"{body}{body}": FALLBACK,
        f"{body}, {body}": FALLBACK,
        body[:-1]: FALLBACK,
        "no idea": FALLBACK,
        "[1]": FALLBACK,
        "": FALLBACK,
        None: FALLBACK,
    }
    assert one(spark, cases) == list(cases.values())


def test_urgency_by_json_type(spark):
    cases = {
        "4": 4, "4.7": 4, '"4"': 4, '" 3 "': 3, '"4.7"': 1, "true": 1, "null": 1, "[5]": 1, '{"a": 1}': 1,
        "0": 1, "-7": 1, "99": 5, "123456789012345678901234567890": 5, "-0.5": 1, '"+2"': 2, '"1_0"': 5, '""': 1, "2.0": 2,
        "1e0": 1, "3e0": 3,
    }
    assert one(spark, [FULL % value for value in cases]) == [("Bug", "Negative", u) for u in cases.values()]


def test_one_bad_label_falls_back_alone_but_nested_or_infinite_spoils_the_answer(spark):
    cases = {
        '{"category": "bug", "sentiment": "Positive", "urgency_score": 2}': ("Uncategorized", "Positive", 2),
        '{"category": 5, "sentiment": null, "urgency_score": 2}': ("Uncategorized", "Neutral", 2),
        '{"urgency_score": 3}': ("Uncategorized", "Neutral", 3),
        '{"category": "Spam", "category": "Bug", "urgency_score": 3}': ("Bug", "Neutral", 3),
        '{"category": ["Bug"], "sentiment": "Positive", "urgency_score": 2}': FALLBACK,
        '{"category": "Bug", "sentiment": {}, "urgency_score": 2}': FALLBACK,
        FULL % "1e999": FALLBACK,
        "{}": FALLBACK,
    }
    assert one(spark, cases) == list(cases.values())


def batch(spark, texts, response):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, clean_text string")
    numbered = E.with_item_number(E.micro_batches(df))
    answers = spark.createDataFrame([(0, response)], "batch_id bigint, response string")
    found = E.apply_batch_responses(numbered, answers).orderBy("id").collect()
    return [(row.category, row.sentiment, row.urgency_score) for row in found]


def test_batch_answers(spark):
    bug, spam = FULL % 4, '{"category": "Spam"}'
    b, s = ("Bug", "Negative", 4), ("Spam", "Neutral", 1)
    texts = ["first", "  ", "second", ""]
    assert batch(spark, texts, f"[{bug}, {spam}]") == [b, FALLBACK, s, FALLBACK]
    assert batch(spark, texts, f"```json\n[{bug}]\n```") == [b, FALLBACK, FALLBACK, FALLBACK]
    assert batch(spark, texts, f"[{bug}, {spam}, {bug}]") == [b, FALLBACK, s, FALLBACK]
    failed = [FALLBACK] * 4
    for answer in (f"[{bug}, 7]", f"[{bug}, {spam}", bug, "[]", f"[{bug}] [{spam}]", '[{"category": []}]', None, "sorry"):
        assert batch(spark, texts, answer) == failed, answer


def test_batches_and_prompts(spark):
    texts = [f"text {i}" for i in range(31)]
    texts[3], texts[16] = " ", "y" * 3000
    df = spark.createDataFrame([(i * 3 + 5, t) for i, t in enumerate(texts)], "id bigint, clean_text string").repartition(7)
    batched = E.micro_batches(df)
    placed = [(row.batch_id, row.pos) for row in batched.orderBy("id").collect()]
    assert placed == [(i // 15, i % 15) for i in range(31)]
    prompts = {row.batch_id: row for row in E.build_batch_prompts(batched).collect()}
    assert [prompts[i].item_count for i in range(3)] == [14, 15, 1]
    lines = prompts[0]["items"].split("\n")
    assert lines[2:4] == ['3. "text 2"', '4. "text 4"'] and len(lines) == 14
    assert prompts[1]["items"].split("\n")[1] == '2. "' + "y" * 1000 + '"'
    assert "exactly 14 objects" in prompts[0].prompt and prompts[0]["items"] in prompts[0].prompt
    assert E.build_row_prompts(df).count() == 30


def test_a_failing_scorer_never_fails_the_job(spark):
    def answer(prompts):
        if any("text 20" in prompt for prompt in prompts):
            raise RuntimeError("quota")
        return ["[" + ", ".join([FULL % 2] * 15) + "]" for _ in prompts]

    df = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "id bigint, clean_text string")
    numbered = E.with_item_number(E.micro_batches(df))
    answers = E.answering(answer, parallelism=2)(E.build_batch_prompts(numbered))
    found = [row.category for row in E.apply_batch_responses(numbered, answers).orderBy("id").collect()]
    assert found == ["Bug"] * 15 + ["Uncategorized"] * 15 + ["Bug"] * 10


def test_empty_input(spark):
    nothing = spark.createDataFrame([], "id bigint, clean_text string")
    assert E.with_item_number(E.micro_batches(nothing)).count() == 0
    assert E.build_batch_prompts(E.micro_batches(nothing)).count() == 0
    assert E.route_empty_text(nothing).count() == 0


def test_title_prompts(spark):
    tickets = spark.createDataFrame(
        [("a", ["one", "two"]), ("b", [])], "ticket_key string, sample_reviews array<string>"
    )
    (row,) = E.build_title_prompts(tickets).collect()
    assert row.samples == "- one\n- two" and row.samples in row.prompt
