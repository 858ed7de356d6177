"""Column layouts of the tables that operators pass to each other."""

from pyspark.sql import types as T

FILES = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("size_bytes", T.LongType()),
])

LISTING = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("rel_path", T.StringType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("is_dir", T.BooleanType()),
])

TEXT_FILES = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("rel_path", T.StringType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("content", T.StringType()),
])

CHUNKS = T.StructType([
    T.StructField("chunk_id", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("chunk_type", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("code", T.StringType()),
    T.StructField("line_start", T.IntegerType()),
    T.StructField("line_end", T.IntegerType()),
    T.StructField("oversized", T.BooleanType()),
])

# `order_path` and `order_pos` give a row its place among the rows of one source.
KNOWLEDGE = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("cwe_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("examples", T.ArrayType(T.StringType())),
    T.StructField("languages", T.ArrayType(T.StringType())),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("order_path", T.StringType()),
    T.StructField("order_pos", T.LongType()),
])

FINDINGS = T.StructType([
    T.StructField("cwe_id", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("line_start", T.LongType()),
    T.StructField("line_end", T.LongType()),
    T.StructField("code_snippet", T.StringType()),
    T.StructField("recommendation", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("file_path", T.StringType()),
])
