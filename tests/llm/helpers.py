"""Awkward documents that every operator must take."""

AWKWARD = [
    (1, None, None),
    (2, "", "en"),
    (3, "x", None),
    (4, "the same line, forty characters or more in it\nÉcole", "fr"),
    (4, "the same line, forty characters or more in it\nÉcole", "fr"),
    (5, "  \n\n \t", "en"),
    (None, "a row without an id", "en"),
    (6, "long " * 30_000, "en"),
    (7, "tie one two three four five six seven eight nine ten", "en"),
    (8, "tie one two three four five six seven eight nine ten", "en"),
]


def awkward(spark, rows=AWKWARD, more=("pos", "row", "key", "found", "h1", "id", "node")):
    """With further columns whose names operators might use."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.select("*", *(F.lit(k).alias(c) for k, c in enumerate(more)))


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
