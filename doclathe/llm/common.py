"""What several operators share: tables, shared-folder staging, word arrays."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session of one machine (as in
    tests) gets a folder of its own, and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        found = f"file://{tempfile.gettempdir()}/doclathe-shared"
    return found.rstrip("/")


def _place(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder, read back. The files go with ``discard``, or when the JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/doclathe/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at, files = _place(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``written`` wrote; nothing that is still to run may read it."""
    at, files = _place(df.sparkSession, df.written_to)
    files.delete(at, True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for columns to add, none of which the table has already (in any case of letters)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def own_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the columns that an operator reads, so that extra columns can't clash with its own."""
    return docs.select(*[F.col(f"`{n}`") for n in names])


# --- arrays of words -------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(20, (n - 1).bit_length())
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            run = np.full(size, base, np.uint64)
            run[0] = 1
            _POWERS[key] = np.cumprod(run, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j]-P[i] the polynomial hash of data[i:j], times the base to the power i."""
    up, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def small_hash(prefix: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte strings, mixed lightly: to order them, not to tell them apart."""
    _, down = _powers(len(prefix))
    h = (prefix[k:] - prefix[:-k]) * down[: len(prefix) - k]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def trim_memory() -> None:
    """Give freed memory back: Python workers live on, idle, beside the executor."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def trimmed(run):
    """For mapInArrow: the same, with memory given back at the end of each task."""
    def trimming(batches):
        try:
            yield from run(batches)
        finally:
            trim_memory()

    return trimming


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array, and the n+1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word; words end where a text ends."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    ink = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = ink.copy()
    first[1:] &= ~ink[:-1] | edge[1:-1]
    last = ink
    last[:-1] &= ~ink[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def chunks(batches, text: str, most_bytes: int = 8 << 20, most_rows: int = 60_000):
    """Slices of the batches with a bounded volume of text (one text at least)."""
    for batch in batches:
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64))
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            to = min(max(at + 1, int(np.searchsorted(size, before + most_bytes, side="right"))), at + most_rows)
            yield batch.slice(at, to - at)
            at = to


def planes(values: np.ndarray) -> bytes:
    """Integers byte plane by byte plane: of sorted ones, the high planes compress to almost nothing."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes() if len(values) else b""


def from_planes(blob: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(size, -1).T).view(dtype).ravel() if blob else np.zeros(0, dtype)
