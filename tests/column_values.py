"""Helper of the tests of Column functions (a module of its own: the name
``conftest`` belongs to more than one folder)."""


def values(spark, fn, texts, schema="s string"):
    """Apply a Column function to literal texts and return the results in order."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, {schema}")
    return [r.v for r in df.select("i", fn(F.col("s")).alias("v")).orderBy("i").collect()]
