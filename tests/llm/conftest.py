import pytest

WORDS = ("the of and in on at by with for from red blue green stone river field cloud bird tree house "
         "walks sings reads turns opens closes finds keeps makes holds").split()  # fmt: skip


def prose(n, seed):
    """``n`` words that hardly repeat in threes."""
    out, x = [], seed * 2654435761 % 4294967296
    for _ in range(n):
        x = (x * 1664525 + 1013904223) % 4294967296
        out.append(WORDS[(x >> 12) % 28] + WORDS[(x >> 20) % 28])
    return " ".join(out)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string, `_row` int, label string, size int, `key` string, md int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, near copies, and
    extra columns whose names clash with those the operators use."""
    base = prose(120, 1)
    near = base.split()
    near[60] = "changed"
    texts = [
        (1, base, "a"), (2, base, "a"), (2, base, "a"), (3, " ".join(near), "b"), (4, prose(200, 4), "b"),
        (5, None, "a"), (6, "", None), (None, prose(90, 7), None), (7, "   \t\n ", "a"), (8, "one two", "é"),
        (9, prose(30000, 9), "a"), (10, "word " * 80, "c"), (11, prose(70, 11) + ' token = "abcdef0123456789abcdef0123456789"', "c"),
        (12, prose(60, 12) + "\nReleased under the MIT License.\n" + prose(20, 13), "c"), (13, "😀é 　x" * 20, "d"),
        (14, "x" * 5000, "d"), (None, None, "a"),
    ]
    rows = [(i, t, "en", s, len(t) if t else None, "n", "k", 1, "l", 2, "y", 3) for i, t, s in texts]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    """(doc_id, text) with nulls as they are."""
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
