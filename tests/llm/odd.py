"""Small tables with every awkward case: nulls, empty and very long texts, repeated rows, clashing columns."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the quick brown fox jumps over the lazy dog while seven old wizards brew a strong potion".split()
LONG = " ".join(WORDS[(i * 7 + i // 5) % len(WORDS)] + str(i % 97) for i in range(30_000))


def rows():
    base = "A plain text of some ordinary words that nobody would mind reading once or twice."
    return [
        (1, base, "en", "a", len(base)), (2, base, "en", "b", len(base)), (2, base, "en", "b", len(base)),
        (3, None, None, None, None), (4, "", "en", "a", 0), (None, base, "en", None, 5), (None, None, None, None, None),
        (5, LONG, "en", "a", len(LONG)), (6, LONG, "de", "a", len(LONG)), (7, "x", "en", "a", 1),
        (8, " \t\n ", "en", "", 4), (9, "héllo wörld ñ \u00a0 é", "fr", "c", 10), (10, base.upper(), "en", "a", 9),
    ]


def docs(spark):
    """The rows with extra columns of names that operators use themselves."""
    df = spark.createDataFrame(rows(), SCHEMA)
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(
        ("digest", "keep_id", "n", "fp", "class", "score", "copy_no", "mix_key", "cdf", "th", "place", "item_id", "spans"))])


def empty(spark):
    return docs(spark).limit(0)
