"""What the operators share: the shared work folder, byte blocks of text, and vectorised word hashes.

Texts reach numpy as one byte array with offsets, in blocks bounded by bytes, so memory per task
depends on the block size (or on the single longest text), not on how many rows an Arrow batch has.
"""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.session import ship

BLOCK_BYTES = 1 << 20
_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir. Only a session on one machine, as in tests, may leave that unset and gets one."""
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir is unset: work tables need a folder that all executors see")
        top = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
        sc.setCheckpointDir(top)
    path = f"{top.rstrip('/')}/work-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a work folder through Hadoop's file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _made.pop(path, None)


@atexit.register
def _discard_all() -> None:
    for path, spark in list(_made.items()):
        try:
            discard(spark, path)
        except Exception:  # noqa: BLE001  the session is over; its folder's owner cleans up
            continue


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """df as a table in the shared folder, parted by a column if named: its lineage is cut, and a lost executor loses none of it."""
    path = shared_dir(df.sparkSession)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.work_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes written() tables that nothing reads any more."""
    for t in tables:
        discard(t.sparkSession, t.work_path)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, for mapInArrow; after a task's last batch its worker returns freed memory to the machine."""

    def held(batches):
        yield from run(batches)
        trim()

    return held


def trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(id_col: str | Column, mod: int) -> Column:
    """crc32 of the id as text, mod `mod`; a null id counts as the empty text, so 0."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % mod


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES, rows: int = 1 << 30) -> Iterator[pa.Table]:
    """The rows in order, in tables of up to `limit` bytes of text (one row at least) and up to `rows` rows."""
    held: list[pa.RecordBatch] = []
    size = n = 0
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(np.nan_to_num(pc.binary_length(col).to_numpy(zero_copy_only=False)).astype(np.int64)) if len(col) else np.zeros(0, np.int64)
        at = base = 0
        while at < len(ends):
            stop = int(np.searchsorted(ends, base + limit - size, side="right"))
            stop = min(max(stop, at + (not held)), len(ends), at + rows - n)
            if stop > at:
                held.append(batch.slice(at, stop - at))
                size += int(ends[stop - 1]) - base
                n += stop - at
                base, at = int(ends[stop - 1]), stop
            if at < len(ends) or size >= limit or n >= rows:
                if held:
                    yield pa.Table.from_batches(held)
                held, size, n = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def flat(col: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after another, and their n+1 offsets; null counts as empty."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    col = pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col
    col = col.cast(pa.large_binary()).fill_null(b"")
    offs = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)[offs[0] : offs[-1]] if len(col) and col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every bit of x over the result."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_M = 0x5851F42D4C957F2D | 1
_INV = pow(_M, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(which: int, n: int) -> np.ndarray:
    """The first n powers; those of one very long text are not kept."""
    if len(_powers[which]) >= n:
        return _powers[which][:n]
    steps = np.full(max(n, 1 << 16), (_M, _INV)[which], np.uint64)
    steps[0] = 1
    out = np.multiply.accumulate(steps)
    if n <= BLOCK_BYTES + (1 << 16):
        _powers[which] = out
    return out[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, letters: np.ndarray = _LETTERS) -> np.ndarray:
    """64-bit polynomial hashes of data[starts:ends], the same wherever a span stands."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(letters[data] * _grown(0, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _grown(1, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`, and for each text the number of words before it (n+1 counts)."""
    gap = np.ones(len(data) + 1, bool)
    gap[1:] = SPACE[data]
    cut = offs[:-1][offs[:-1] < len(data)]
    first = ~gap[1:] & gap[:-1]
    first[cut] |= ~gap[1:][cut]
    starts = np.flatnonzero(first)
    last = ~gap[1:]
    last[:-1] &= gap[2:] | first[1:]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def owners(before: np.ndarray) -> np.ndarray:
    """From n+1 counts, the text to which each item belongs."""
    return np.repeat(np.arange(len(before) - 1), np.diff(before))


def sums_by(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Sums of the runs before[i]:before[i+1], 0 for empty ones."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[before[1:]] - total[before[:-1]]


def with_fields(df: DataFrame, **fields: T.DataType) -> T.StructType:
    """df's schema with more fields at its end."""
    return T.StructType([*df.schema.fields, *(T.StructField(k, v) for k, v in fields.items())])


def numbered(df: DataFrame, **more: Column) -> DataFrame:
    """df's columns as c0, c1, ..., whatever their names, and `more` of its expressions."""
    return df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)], *[v.alias(k) for k, v in more.items()])
