"""Streams: each must give what the batch gives."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import functions as F

import scanloom as sl
from scanloom.streaming.live import stream_rules
from workload import corpora as C, oracle as O
from workload.registry import query
from workload.scans import flat


def _folder(spark, name: str) -> str:
    """A new folder next to the shared checkpoint folder; a local one only where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}" if base else tempfile.mkdtemp(prefix=f"{name}-")


_RULES = stream_rules()


@query("stream_scan", O.with_(*O.code_findings(_RULES)) + f"SELECT {O.SHOWN} FROM findings")
def stream_scan(spark, sf):
    files = sl.with_kind(C.code(spark, sf))
    source, target, state = (_folder(spark, n) for n in ("stream-in", "stream-out", "stream-state"))
    files.repartition(5, "doc_id").write.mode("overwrite").parquet(source)
    arriving = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 2).parquet(source)
    job = sl.scan_stream(arriving, _RULES).writeStream.format("parquet").option("path", target).option(
        "checkpointLocation", state).trigger(availableNow=True).start()
    job.awaitTermination()
    return flat(spark.read.parquet(target))


# Versions arrive in this many batches, in files whose versions have about this many bytes of text, whatever the size of the tables.
# Where they get their texts, a task holds about this many bytes of documents.
BATCHES = 3
FILE_BYTES = 128 << 20
TEXT_BYTES = 32 << 20


def dealt(events, texts) -> tuple[int, int]:
    """Into how many files the versions go, an event carrying a text of average length, and into how many parts the texts."""
    size = F.octet_length("content")
    sizes = texts.agg(F.coalesce(F.avg(size), F.lit(0.0)).alias("mean"), F.coalesce(F.sum(size), F.lit(0)).alias("total"))
    n, mean, total = events.agg(F.count(F.lit(1)).alias("n")).crossJoin(sizes).first()
    files = max(2 * BATCHES, math.ceil(n * mean / FILE_BYTES))
    return files, max(files, math.ceil(total / TEXT_BYTES), 2 * texts.sparkSession.sparkContext.defaultParallelism)


# Versions of documents: history revisions as open, change, save and close events in time order.
_VERSIONS = """
SELECT c.path, c.content || CASE WHEN e.event_id % 3 = 0 THEN '' ELSE concat(chr(10), 'k = "AKIA', upper(substring(md5(cast(e.event_id AS varchar(20))),1,16)), '"') END AS content,
  CASE e.event_type WHEN 'signup' THEN 'open' WHEN 'click' THEN 'save' WHEN 'view' THEN 'change' WHEN 'purchase' THEN 'save' ELSE 'close' END AS event,
  e.event_id AS version FROM (SELECT *, event_id % (SELECT count(*) FROM documents) AS target FROM events) e JOIN corpus_code c ON c.doc_id = e.target"""


@query("stream_latest_state", O.with_(
    C.CODE_CTE, f"versions AS ({_VERSIONS})",
    "latest AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY version DESC) AS n FROM versions WHERE event <> 'change')",
    O.files_cte("(SELECT path, content FROM latest WHERE n = 1 AND event <> 'close')"), O.rules_cte(_RULES), O.findings_ctes())
    + f"SELECT {O.SHOWN} FROM findings")
def stream_latest_state(spark, sf):
    events, documents, texts = C.table(spark, sf, "events").select("event_id", "event_type"), C.table(spark, sf, "documents"), C.code(spark, sf)
    source, log, state = (_folder(spark, n) for n in ("versions-in", "finding-log", "versions-state"))
    files, parts = dealt(events, texts)
    events.repartition(files, "event_id").write.mode("overwrite").parquet(source)
    arriving = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", -(-files // BATCHES)).parquet(source)
    # An event gets its text as it arrives: stored beforehand, the texts of all versions would take many times the room of the documents.
    versions = C.over(spark, _VERSIONS, events=arriving, documents=documents, corpus_code=texts.repartition(parts, "doc_id"))
    store = sl.FindingLog(log, _RULES)
    store.start(versions, state).awaitTermination()
    return flat(store.findings(spark))
