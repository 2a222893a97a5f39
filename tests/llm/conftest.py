import random

import pytest

PROSE = "river stone market winter garden silver letter window bridge forest candle harbor mirror thunder valley copper".split()
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["row", "line", "bucket", "node", "id", "n", "host", "key", "doc", "mix_slot", "quality_score", "kept", "cut", "_row"]


def prose(seed: int, words: int) -> str:
    pick = random.Random(seed)
    return " ".join("".join(pick.choice("abcdefghijklmnop") for _ in range(pick.randint(2, 9))) if pick.random() < 0.5
                    else pick.choice(PROSE) for _ in range(words))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows."""
    a, b = prose(1, 120), prose(2, 300)
    return [
        (None, None, None, None, None), (None, a, "en", None, 5), (1, None, "en", "s", None), (2, "", "en", "s", 0),
        (3, " \t\n \r\n", None, "s", 4), (4, a, "en", "s", len(a)), (4, a, "en", "s", len(a)), (5, a, "de", "s", -1),
        (6, b, "en", "t", len(b)), (7, b.replace("river", "rivers"), "en", "t", len(b)), (8, "x" * 200_000, "en", "t", 1),
        (9, "na " * 40_000, "en", "t", 1), (10, "one two", "en", "t", 7), (11, "\n".join([prose(3, 20)] * 30), "en", "t", 9),
        (12, prose(3, 20) + "\n" + prose(4, 200), "en", "t", 9), (13, "é漢字 \u00a0\u2028 ü\x00\x1f", "en", "t", 9),
        (13, "another text under the same id", "en", "t", 9),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    docs = spark.createDataFrame(edge_rows, COLUMNS)
    for name in CLASHES:
        docs = docs.selectExpr("*", f"'c' as `{name}`")
    return docs


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
