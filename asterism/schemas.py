"""Fixed schemas of the frames the operators exchange."""

from pyspark.sql import types as T

VECTOR = T.ArrayType(T.DoubleType(), containsNull=False)

LINES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("line", T.StringType()),
])
ITEMS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("features", VECTOR),
])
POINTS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
    T.StructField("cluster", T.IntegerType()),
])
CLUSTERS = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("label", T.StringType()),
    T.StructField("size", T.LongType()),
])
SUMMARY = T.StructType([
    T.StructField("k", T.IntegerType()),
    T.StructField("n_points", T.LongType()),
    T.StructField("n_clusters", T.LongType()),
])
CENTROIDS = T.StructType([
    T.StructField("cluster", T.IntegerType()),
    T.StructField("centroid", VECTOR),
])
