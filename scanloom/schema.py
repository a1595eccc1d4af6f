"""Table schemas shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

LOCATION = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("byte_offset", T.LongType()),
    T.StructField("byte_length", T.LongType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("column", T.IntegerType()),
])

FINDING = T.StructType([
    T.StructField("code", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("help", T.StringType()),
    T.StructField("location", LOCATION),
    # Position of the detector and rule in the registry: with the path and the
    # offset they give findings a total order ("first finding of a code").
    T.StructField("family_no", T.IntegerType()),
    T.StructField("rule_no", T.IntegerType()),
])

FINDING_COLUMNS = FINDING.fieldNames()

FILE = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("size", T.LongType()),
])

PACKAGE = T.StructType([
    T.StructField("ecosystem", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("source", T.StringType()),
])

# Names of the ordered levels, lowest first, and of the buckets.
SEVERITIES = ("info", "low", "medium", "high", "critical")
CONFIDENCES = ("low", "medium", "high")
CATEGORIES = ("secret", "security", "dependency", "performance", "crawler", "internal")
KINDS = ("manifest", "source", "config", "test", "other")
