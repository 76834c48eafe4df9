import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts, a null id, a repeated row, and extra columns with the operators' own names."""
    from plain import ODD_TEXTS, prose

    texts = [*ODD_TEXTS, prose(80), prose(80), prose(300, 2)]
    rows = [(i, t, "en", "s", None, 1.0, 7, "x", [1]) for i, t in enumerate(texts)]
    rows += [(None, prose(60, 3), None, None, 1, None, 7, None, None), rows[12]]
    return spark.createDataFrame(
        rows,
        "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, shard int, stats string, ids array<int>",
    )


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
