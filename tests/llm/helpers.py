"""Small inputs with the awkward cases: nulls, empty and long texts, ties, repeats, clashing extra columns."""

from pyspark.sql import types as T

ROWS = [
    (0, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "src0", 1),
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "src0", 1),
    (2, None, None, None, None),
    (3, "", "fr", "src1", 0),
    (4, "  \n\t ", "fr", "src1", 5),
    (5, "é" * 7 + " 日本語 🙂 naïve  double  space\x00", "fr", "src1", 5),
    (6, "one", "en", "src2", 3),
    (7, " ".join(f"word{i % 97}x{i}" for i in range(9000)), "en", "src2", 9),
    (7, " ".join(f"word{i % 97}x{i}" for i in range(9000)), "en", "src2", 9),
    (100, "x" * 30000, "en", "src2", 9),
    (None, "a record without an id", "en", None, 2),
]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)


def frame(spark, rows=None):
    """The rows, with extra columns whose names operators use themselves."""
    df = spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)
    return df.selectExpr("*", "'x' AS shard", "1 AS size", "2 AS part", "3 AS length", "'y' AS score", "4 AS dup", "5 AS _key", "6 AS bins")


def texts(sf="sf0.001"):
    import pyarrow.parquet as pq

    return [(r["doc_id"], r["text"]) for r in pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
