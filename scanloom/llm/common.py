"""What the operators of this subpackage share: shared tables, row batches, word chunks."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a task holds as Python objects at once.
CHUNK_BYTES = 4 << 20
#: Entries of a task's memo of chunks; the texts seen first fill it, frequent words among them.
MEMO_ENTRIES = 500_000
#: Bytes of an Arrow batch between Spark and its Python workers; both sides hold such batches outside the heap.
BATCH_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Only where the session names none and all tasks run on this machine (tests), a temporary folder is made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def save(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of the session hold `BATCH_BYTES` at most (or one row), where it allows more: rows are cut by bytes, not by number alone."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?[0-9]+)([a-z]?)b?", spark.conf.get(name).strip().lower()).groups()
    own = int(number) << 10 * "bkmgtp".index(unit or "b")
    if own <= 0 or own > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def give_back() -> None:
    """Free memory that the allocators keep goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function for mapInArrow, after which its worker keeps nothing of the task: workers live on and wait beside those that run."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def slices(batches: Iterable[pa.RecordBatch], column: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose given column holds about `limit` bytes; a longer value comes alone."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start, n - start)


# U+2581 is what the piece model writes for a space, so beside one a space stands in a run of spaces.
_BETWEEN = re.compile(r"(?<=[^\s\u2581]) (?=[^\s\u2581])")
_LOOSE_MARK = re.compile(r"[,.](?<![^\W_][,.])")


def chunks(text: str, marks: bool = False) -> list[str]:
    """Cut a text before every single space, and every single line end, that stands between two other characters.

    U+2581 counts as a space here: no cut beside it, and no cut at line ends of a text that holds it.

    With `marks` also before a comma or full stop, where every one follows a letter or digit (an
    underscore is punctuation and may form one piece with the mark). A chunk is named by what follows its space; one that begins with a line end or mark is named
    with it, and any other with a leading carriage return. See `spelled`.
    """
    plain = (text.replace("\n", "").isprintable() and "  " not in text and "\n\n" not in text
             and " \n" not in text and "\n " not in text and text[:1] != " " and text[-1:] != " " and "\u2581" not in text)
    if plain and marks:
        plain = not _LOOSE_MARK.search(text)
    if plain:
        text = text.replace("\n", " \n")
        parts = (text.replace(",", " ,").replace(".", " .") if marks else text).split(" ")
    else:
        first, *rest = _BETWEEN.split(text)
        parts = [first, *["\r " + p if marks and p[0] in ",." else p for p in rest]]
    parts[0] = "\r" + parts[0]
    return parts


def spelled(name: str, marks: bool = False) -> str:
    """The characters of a chunk; those of all chunks joined give the text."""
    head = name[:1]
    return name[1:] if head == "\r" else name if head == "\n" or marks and head in (",", ".") else " " + name


class Memo(dict):
    """Encoded chunks; `encode` gets the names of those not known. Once full it keeps what it has."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], entries: int = MEMO_ENTRIES):
        super().__init__()
        self.encode, self.entries = encode, entries

    def joined(self, texts: list[list[str]]) -> list[bytes]:
        """The chunks of every text put together; what is not known in all of them is encoded at once."""
        values = [list(map(self.get, parts)) for parts in texts]
        gaps = [i for i, v in enumerate(values) if None in v]
        new = list({p for i in gaps for p, v in zip(texts[i], values[i], strict=True) if v is None})
        found = dict(zip(new, self.encode(new), strict=True)) if new else {}
        if len(self) < self.entries:
            self.update((p, v) for p, v in found.items() if len(p) <= 64)
        for i in gaps:
            values[i] = [found[p] if v is None else v for p, v in zip(texts[i], values[i], strict=True)]
        return [b"".join(v) for v in values]


def column_or_null(df: DataFrame, name: str, kind: str):
    from pyspark.sql import functions as F

    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)
