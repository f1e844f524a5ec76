"""Documents with nulls, empty and very long texts, ties, repeated rows and columns of clashing names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "\n".join(f"line {i} of a very long text with some words {i * 7}" for i in range(4000))
EDGES = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, LONG, "en", "b", len(LONG)), (5, "x" * 30_000, "en", "b", 30_000),
    (6, "one two three", "en", "a", 13), (6, "one two three", "en", "a", 13), (None, "a text without an id, which is kept as it is", None, "b", 44), (7, "é 数据 😀▁ \x00 nul", "zh", "a", 10),
]


def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def clashing(spark, *names):
    """The edge cases with more columns, named as those that an operator adds or uses."""
    from pyspark.sql import functions as F

    return edges(spark).withColumns({n: F.lit(7) for n in names})
