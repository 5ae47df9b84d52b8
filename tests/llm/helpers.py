from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def docs(spark, rows, partitions=2):
    return spark.createDataFrame(rows, DOCS).repartition(partitions)


def messy(spark):
    """Nulls, empty and long texts, repeated rows and ids, an extra column."""
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "alpha beta gamma"), (3, "alpha beta gamma"), (3, "other text"), (None, "alpha beta gamma"), (4, long), (5, " \n\t\n "), (6, "é" * 50)]
    return docs(spark, rows)
