"""Table schemas, enumerations and row checks of the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The names that the catalog's columns may hold.
STATES = ("discovered", "converted", "chunked", "embedded", "indexed", "failed")
TERMINAL = ("indexed", "failed")
UNREAD = ("denied", "dataless", "io_error")
STAGE_KEYS = ("chunker", "embedding", "embedding_dims", "vec_metric")
SUMMARY_LEVELS = (4, 16, 64)
SCHEMA_VERSION = 1


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "array<string>": T.ArrayType(T.StringType()),
    "array<float>": T.ArrayType(T.FloatType()),
    "map<string_string>": T.MapType(T.StringType(), T.StringType()),
}


def _schema(columns: str) -> T.StructType:
    """From ``name type`` pairs; needs no session."""
    pairs = (c.split() for c in columns.replace("map<string,string>", "map<string_string>").split(", "))
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in pairs])


CONTENT = _schema("content_hash string, state string, stage_versions map<string,string>, attempts int, next_retry_at long, last_error string, created_at long, updated_at long")
FILES = _schema("path string, content_hash string, unread_reason string, size long, mtime_ns long")
CHUNKS = _schema("content_hash string, ordinal int, text string, heading_path string, byte_start long, byte_end long")
VECTORS = _schema("generation int, content_hash string, ordinal int, embedding array<float>")
GENERATIONS = _schema("generation int, model string, dims int, layout string, metric string, query_template string, passage_template string, ceiling_tokens int")
SUMMARIES = _schema("content_hash string, level int, text string")
LISTING = _schema("path string, kind string, size long, mtime_ns long, stat_error string, read_error string, is_dataless boolean, content_hash string")
GOLDEN = _schema("id string, query string, relevant array<string>, acceptable array<string>, tags array<string>")
HITS = _schema("content_hash string, ordinal int, text string, heading_path string, path string, distance double, also_at array<string>")


def terminal(state: Column) -> Column:
    return state.isin(*TERMINAL)


def check_files(files: DataFrame) -> DataFrame:
    """The rows that break a rule, with the rule's name: exactly one of hash and reason, a known reason, a path."""
    rule = (
        F.when(F.col("path").isNull() | (F.col("path") == ""), "path")
        .when(F.col("content_hash").isNull() == F.col("unread_reason").isNull(), "hash_xor_reason")
        .when(F.col("unread_reason").isNotNull() & ~F.col("unread_reason").isin(*UNREAD), "unread_reason")
    )
    return files.withColumn("rule", rule).where("rule is not null")


def check_content(content: DataFrame) -> DataFrame:
    """The rows whose state is unknown or whose hash is missing."""
    rule = F.when(F.col("content_hash").isNull(), "content_hash").when(~F.coalesce(F.col("state").isin(*STATES), F.lit(False)), "state")
    return content.withColumn("rule", rule).where("rule is not null")


def check_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks whose span is not the length of their text, and contents whose ordinals are not dense from 0."""
    span = chunks.where(F.col("byte_end") - F.col("byte_start") != F.octet_length("text")).select("content_hash", F.lit("span").alias("rule"))
    dense = chunks.groupBy("content_hash").agg(F.max("ordinal").alias("m"), F.min("ordinal").alias("l"), F.count("*").alias("n"), F.countDistinct("ordinal").alias("d"))
    return span.unionByName(dense.where("l != 0 or m + 1 != n or d != n").select("content_hash", F.lit("ordinals").alias("rule")))
