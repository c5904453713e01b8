"""Fixed schemas of the tables and requests."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_FILES = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])

CHUNKS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("page_number", T.IntegerType()),
    T.StructField("content", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

PARTS = T.StructType([
    T.StructField("item_number", T.LongType()),
    T.StructField("part_number", T.StringType()),
    T.StructField("designation", T.StringType()),
    T.StructField("part_code", T.StringType()),
    T.StructField("part_name", T.StringType()),
    T.StructField("qr_code_url", T.StringType()),
])

MESSAGES = T.ArrayType(T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
]))

REQUESTS = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("messages", MESSAGES),
])

RESPONSE = T.StructType([
    T.StructField("answer", T.StringType()),
    T.StructField("references", T.ArrayType(T.StructType([
        T.StructField("content", T.StringType()),
        T.StructField("doc_uri", T.StringType()),
        T.StructField("page_number", T.IntegerType()),
    ]))),
])

EVAL_QUESTIONS = T.StructType([
    T.StructField("question", T.StringType()),
    T.StructField("source", T.StringType()),
])

PAGE_STRUCTS = T.ArrayType(T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("page_number", T.IntegerType()),
    T.StructField("text", T.StringType()),
]))


def ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
