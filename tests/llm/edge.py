"""Rows that every operator has to bear: nulls, empty and long texts, repeated rows, clashing names."""

CLASH = "ids string, offsets string, mix string, quality string, lines string, verdict string, fingerprint string, wide string, near_d string, n int, h int, d int, th int, `key` int, size int, batch int, score double, `a.b` int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"


def documents(spark, texts=None):
    rest = ("en", "s", 1, *["x"] * 9, 1, 2, 3, 4, 5, 6, 7, 0.5, 8)
    long = "word " * 30_000 + "\n" + "unbroken" * 3000
    rows = texts or [(1, None), (2, ""), (3, "one line of more than twenty characters"), (3, "one line of more than twenty characters"), (None, "a b c d e f g\n\n \t x"), (4, long), (5, "one line of more than twenty characters\none line of more than twenty characters"), (6, "é🙂 ß\x0b\x0cÄ"), (7, "one line of more than twenty characters")]
    out = spark.createDataFrame([(i, t, *rest) for i, t in rows], SCHEMA)
    from pyspark.sql import functions as F

    return out.withColumn("source", F.when(F.col("doc_id") == 6, F.lit(None)).otherwise(F.col("source")))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
