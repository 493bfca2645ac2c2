"""Small tables with the awkward rows: nulls, empty and long texts, repeats, clashing names."""

from pyspark.sql import functions as F

LONG = " ".join(f"wort{i % 977}" for i in range(30_000))
LINE = "the quick brown fox jumps over the lazy dog near the old river bank today"
PROSE = " ".join(f"alpha{i} beta{i}" for i in range(60))

ROWS = [
    (1, PROSE, "en", "a", 10),
    (2, PROSE, "en", "a", 10),
    (3, LONG, "de", None, 10),
    (4, "", "de", "b", 0),
    (5, None, None, "b", None),
    (None, "no id here, only a few words", "en", "b", 5),
    (6, f"{LINE}\n{LINE} again\n\n  \nother words in another line", "en", "c", 9),
    (7, f"{LINE}!\nsomething else entirely, nothing alike", "en", "c", 9),
    (7, f"{LINE}!\nsomething else entirely, nothing alike", "en", "c", 9),
    (8, "Ünïcödé straße 漢字 \U0001f600 ZZ zz", "fr", "ü", 3),
    (9, " \t \r\n\x0b\x0c ", "fr", "ü", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows=ROWS):
    """The documents, with columns named like ones that operators add for themselves."""
    df = spark.createDataFrame(rows, SCHEMA)
    own = "mark size kept target score ids root taken host key hash id of doc at found n_words"
    for name in [*own.split(), *[f"_{n}" for n in "hash taken size words kept_lines t_id k_id found".split()], "a.b"]:
        df = df.withColumn(name, F.lit("own"))
    return df


def empty(spark):
    return documents(spark).limit(0)


def saved(spark, folder, **tables):
    """A data folder with these tables."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
