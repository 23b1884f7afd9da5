"""Small tables with the awkward rows: nulls, empty and long texts, repeated rows, clashing names."""

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "lorem ipsum dolor sit amet " * 3000


def awkward(spark):
    rows = [
        (1, "the cat sat on the mat and looked at the dog", "en", "a", 5),
        (1, "the cat sat on the mat and looked at the dog", "en", "a", 5),
        (2, None, None, None, None),
        (3, "", "en", "", 0),
        (None, "a text without an id, but with words", "en", "a", 1),
        (4, LONG, "la", "a", len(LONG)),
        (5, " \n\t ", "en", "a", 4),
        (6, "naïve Ünïcode 😀 <|im_end|> <\\|x|> 12345", "fr", "a", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df, names):
    """``df`` with extra columns named like what the operator makes."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("mine") for n in names})


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
