import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, _row long, fp string"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, odd white space, control strings and near copies."""
    r = random.Random(3)
    words = ["ab", "The", "the", "é", "ñandú", "日本", "x.", "<|endoftext|>", "<s>", "don't", " ", "\U0001f600", "İ", "##", "12", "Á"]
    rows = []
    for i in range(120):
        text = r.choice([" ", "\n", "\t", "  "]).join(r.choice(words) for _ in range(r.randrange(0, 40)))
        rows.append((i, text, r.choice(["en", "fr", None]), r.choice(["a", "b", "é", None, ""])))
    base = " ".join(f"w{r.randrange(500)}" for _ in range(300))
    rows += [(200 + i, base.replace(" w1", " zz", i), "en", "a") for i in range(6)]
    rows += [(300, base, None, None), (300, base, None, None), (301, base, "en", "b")]
    rows += [(400, None, None, None), (None, None, None, None), (None, "alone here", "fr", "b"), (None, base, "en", "a"), (401, "", "en", "a"), (402, " \n\t ", "en", None)]
    rows += [(500, "long words and more of them " * 9000, "en", "b"), (501, "x" * 30000, "fr", "a"), (7, rows[7][1], "en", "a")]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    full = [(d, t, lang, s, len(t or ""), 5, True, 1, "q") for d, t, lang, s in odd_rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
