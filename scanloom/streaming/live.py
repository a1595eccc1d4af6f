"""Findings of arriving document versions, and the latest state per document."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from scanloom.operators.classify import route_keys, with_kind
from scanloom.operators.scan import find, scan
from scanloom.rules import Rule
from scanloom.rules.catalogue import builtin_rules

# Document events. A change only buffers; closing clears.
SCANNED_EVENTS = ("open", "save")
CLOSED = "close"
# Bits that mark winners, and how many of them ``bitmap_construct_agg`` holds: 8 MB at most, whatever the size of a batch.
MARKS = 1 << 26
BLOCK = 1 << 15


def stream_rules() -> list[Rule]:
    """Rules that need nothing but the document itself."""
    return [r for r in builtin_rules() if not r.framework and not r.scan_framework]


def scan_stream(files: DataFrame, rules: Iterable[Rule] | None = None) -> DataFrame:
    """Findings per arriving version: the batch scan, which keeps no state."""
    return scan(files, stream_rules() if rules is None else rules)


def _marked(versions: DataFrame, winners: DataFrame) -> DataFrame:
    """The versions whose bit a winner set: all winners and a few others, found where the versions lie."""
    slot = F.pmod(F.xxhash64("path", "version"), F.lit(MARKS))
    block, bit = F.floor(slot / BLOCK), slot % BLOCK
    marks = winners.groupBy(block.alias("_block")).agg(F.bitmap_construct_agg(bit).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return versions.join(F.broadcast(marks), (block == F.col("_block")) & (F.getbit(byte, (bit % 8).cast("int")) == 1), "left_semi")


def _drop_shuffles(batch: DataFrame) -> None:
    """Shuffle files of an arrived batch would stay until the driver collects its garbage, those of all batches beside each other."""
    plan = batch._jdf.queryExecution().logical()
    if plan.getClass().getSimpleName() == "LogicalRDD":
        plan.rdd().cleanShuffleDependencies(False)


class FindingLog:
    """Log of the latest version per document, in buckets of paths.

    A micro-batch writes its own folder and then a commit; a retried batch replaces both, and a folder without a commit counts for
    nothing. ``merge`` folds committed batches into a new level of the buckets they touch; the other buckets stay where they are. A read
    opens the newest level of every bucket and the batches committed since, so it does not grow with the age of the log.
    Which version wins depends on the version alone, not on the order of batches.

    Folders: ``batch=N/bucket=B``, ``level=N/bucket=B``, and ``commits/...`` with a few numbers for each of them. Older folders
    may be removed once no reader uses them.
    """

    def __init__(self, path: str, rules: Iterable[Rule] | None = None, buckets: int = 32):
        self.path = path.rstrip("/")
        self.rules = stream_rules() if rules is None else list(rules)
        self.buckets = buckets

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """``foreachBatch`` target over (path, content, event, version)."""
        folder = f"{self.path}/batch={batch_id}"
        latest = self._latest(batch)
        self._write(latest, folder)
        touched = batch.sparkSession.read.schema(latest.withColumn("bucket", self._bucket()).schema).parquet(folder).select("bucket").distinct()
        self._commit(touched.select(F.lit("batch").alias("kind"), F.lit(batch_id).cast("long").alias("number"), F.col("bucket").cast("int")),
                     f"batch={batch_id}")

    def _bucket(self):
        return F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, folder: str) -> None:
        # Else every task would leave a small file in every bucket.
        rows.withColumn("bucket", self._bucket()).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)

    def _commit(self, rows: DataFrame, name: str) -> None:
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{name}")

    def _latest(self, batch: DataFrame) -> DataFrame:
        relevant = batch.filter(F.col("event").isin(*SCANNED_EVENTS, CLOSED))
        # Which version wins is decided without the texts, and no text is shuffled to learn it: marked versions are scanned where they lie,
        # and the findings of those that did not win are dropped.
        # It is needed twice and shuffled once: the join would add the tests for nulls to its side alone.
        newest = relevant.filter("path IS NOT NULL AND version IS NOT NULL").groupBy("path").agg(F.max("version").alias("version")).filter("version IS NOT NULL")
        winners = with_kind(_marked(relevant, newest))
        keys = route_keys(F.col("kind"), F.col("ext"), F.col("path"), F.col("content"))
        # A closed document has no text to scan.
        open_text = winners.withColumn("content", F.when(F.col("event") != CLOSED, F.col("content")))
        found = find(open_text.withColumn("_path", F.col("path")), keys, self.rules, carry=("_path", "version", "event"), as_rows=False)
        rows = found.select(F.col("_path").alias("path"), "version", (F.col("event") == CLOSED).alias("closed"), "findings")
        # ``newest`` has every path once; a semi join would be pushed below the scan, to the texts.
        return rows.join(newest, ["path", "version"])

    def _commits(self, spark: SparkSession) -> tuple[dict[int, int], dict[int, set[int]]]:
        """(bucket -> newest level, open batch -> its buckets): a few numbers per bucket and batch."""
        rows = spark.read.schema("kind string, number long, bucket int").option("recursiveFileLookup", True).parquet(f"{self.path}/commits").collect()
        levels: dict[int, int] = {}
        for r in rows:
            if r.kind == "level":
                levels[r.bucket] = max(levels.get(r.bucket, -1), r.number)
        merged = {r.number for r in rows if r.kind == "merged"}
        batches: dict[int, set[int]] = {}
        for r in rows:
            if r.kind == "batch" and r.number not in merged:
                batches.setdefault(r.number, set()).add(r.bucket)
        return levels, batches

    def _read(self, spark: SparkSession, kind: str, places: list[tuple[int, int]]) -> DataFrame | None:
        if not places:
            return None
        rows = spark.read.option("basePath", self.path).parquet(*[f"{self.path}/{kind}={n}/bucket={b}" for n, b in places])
        return rows.select("path", "version", "closed", "findings")

    @staticmethod
    def _newest(rows: DataFrame) -> DataFrame:
        return rows.groupBy("path").agg(F.max_by(F.struct("version", "closed", "findings"), F.struct("version", "closed", F.to_json("findings"))).alias("v")).select(
            "path", "v.*")

    def _current(self, spark: SparkSession, only: set[int] | None = None) -> DataFrame | None:
        levels, batches = self._commits(spark)
        settled = self._read(spark, "level", [(n, b) for b, n in sorted(levels.items()) if only is None or b in only])
        recent = self._read(spark, "batch", [(n, b) for n, bs in sorted(batches.items()) for b in sorted(bs)])
        # A level holds every path once.
        if recent is None:
            return settled
        return self._newest(recent if settled is None else settled.unionByName(recent))

    def findings(self, spark: SparkSession) -> DataFrame:
        """Findings of all open documents at their latest version."""
        current = self._current(spark)
        if current is None:
            return scan(with_kind(spark.createDataFrame([], "path string, content string")), self.rules)
        return current.filter(~F.col("closed")).select(F.inline("findings"))

    def merge(self, spark: SparkSession) -> None:
        """Fold the batches committed so far into a new level of the buckets they touch.

        The commit of a merge names its buckets and batches; until it is written readers see what they saw before.
        """
        levels, batches = self._commits(spark)
        touched = set().union(*batches.values())
        if not touched:
            return
        number = max(levels.values(), default=-1) + 1
        self._write(self._current(spark, touched), f"{self.path}/level={number}")
        rows = [("level", number, b) for b in sorted(touched)] + [("merged", n, None) for n in sorted(batches)]
        self._commit(spark.createDataFrame(rows, "kind string, number long, bucket int"), f"level={number}")

    def compact(self, spark: SparkSession, target: str) -> "FindingLog":
        """Write the current state as a new log at ``target``; closed documents keep a marker."""
        out = FindingLog(target, self.rules, self.buckets)
        current = self._current(spark)
        if current is not None:
            out._write(current, f"{out.path}/level=0")
            used = spark.read.parquet(f"{out.path}/level=0").select("bucket").distinct()
            out._commit(used.select(F.lit("level").alias("kind"), F.lit(0).cast("long").alias("number"), F.col("bucket").cast("int")), "level=0")
        return out

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        def arrived(batch: DataFrame, batch_id: int) -> None:
            self.upsert(batch, batch_id)
            _drop_shuffles(batch)

        return (
            stream.writeStream.foreachBatch(arrived).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start()
        )
