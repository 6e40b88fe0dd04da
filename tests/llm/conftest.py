import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, __group int, drop string, label string"


def words(seed, n):
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and columns with clashing names."""
    line = "This line is long enough to be a key of its own, it is."
    long = (words(1, 9000) + ".\n") * 3
    rows = [
        (1, f"{line}\nThe first has its own words here, and the last.", "en", "a"),
        (2, f"  {line.upper()}\t\n{words(2, 60)}", "en", "a"),
        (3, f"{line}\n{words(3, 60)}", "en", None),
        (4, f"{line}\n{words(4, 60)}", None, "b"),
        (5, f"{line}\n{words(5, 60)}", "de", "b"),
        (6, line, "de", "b"),
        (7, "", "de", "b"),
        (8, None, None, None),
        (None, f"{line}\nno id", "en", "a"),
        (None, None, None, None),
        (10, long, "en", "c"),
        (11, words(7, 100), "en", "c"),
        (11, words(7, 100), "en", "c"),
        (12, words(7, 100), "en", "c"),
        (13, words(7, 99) + " changed", "en", "c"),
        (14, " \t\n \r\n", "en", ""),
        (15, "0123 456 !!!", "en", ""),
        (16, "\x85\x1c ̈ ÅÉ 中文 😀 <|endoftext|> x", "en", ""),
    ]
    full = [(i, t, lang, s, None if t is None else len(t), "x", 1, None, "y") for i, t, lang, s in rows]
    return spark.createDataFrame(full, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
