"""The canonical event table and the minimum that analytic operators take."""

from __future__ import annotations

from pyspark.sql import types as T

EVENTS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("dataset_id", T.StringType(), False),
        T.StructField("source_file", T.StringType()),
        T.StructField("entity_id", T.StringType()),
        T.StructField("actor", T.StringType()),
        T.StructField("ts", T.TimestampType(), False),
        T.StructField("raw_timestamp", T.StringType()),
        T.StructField("sequence_num", T.LongType()),
        T.StructField("content", T.StringType(), False),
        T.StructField("event_type", T.StringType(), False),
        T.StructField("char_length", T.IntegerType()),
        T.StructField("word_count", T.IntegerType()),
        T.StructField("has_urls", T.BooleanType()),
        T.StructField("has_emojis", T.BooleanType()),
        T.StructField("has_media", T.BooleanType()),
        T.StructField("urls", T.ArrayType(T.StringType())),
        T.StructField("emojis", T.ArrayType(T.StringType())),
        T.StructField("metadata", T.StringType()),
    ]
)
MINIMUM = ["id", "dataset_id", "actor", "ts", "event_type", "content"]
