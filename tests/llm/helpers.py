"""Tables for the operators' tests: the smallest driver table, and one of odd cases."""

from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def small(spark, name="documents"):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""
    passage = " ".join(f"word{i} of passage" for i in range(40))
    rows = [
        (1, None, 0), (2, "", 0), (3, "   \n\n  ", 0), (4, "12345 !!", 0), (5, passage, 1), (6, passage, 1), (6, passage, 1), (7, "x " + passage + " y", 2),
        (8, "a" * 3000, 3), (9, "a" * 5000, 3), (10, "short", 3), (11, "né à Zürich, ñandú — 中文 文本 😀", 4), (12, passage[:-3] + "é", 4),
        (13, " ".join(f"lang{i % 97} text{i % 89}" for i in range(30000)), 5), (None, passage, 6), (15, "<|endoftext|> and <|endoftext|>", 6), (16, "tab\there  double  space ", 6), (17, "don't  it's\r\nwe'll x", 7),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra int")
    for clash in ("chunk", "blob", "bucket", "n_bytes", "score", "key", "size"):
        df = df.withColumn(clash, F.lit(None).cast("int"))
    return df


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")
