"""Exact deduplication by two passes over a Bloom filter with counters that stop at two.

Pass one sets two slots for each text's SHA-256; a slot says 0, 1, or 2 and more. A text that occurs
twice finds both its slots at two, so a text with a lower slot is unique. Pass two looks every row up:
rows that are surely unique pass straight through, the possibly repeated ones alone shuffle.

The filter has 16 slots a row. One broadcast holds MAX_SLOTS at most (32 MB); beyond that the digests are dealt
into parts, each with its own filter, so the share of rows that shuffle doesn't grow with the table.

Defined results: a null text counts as empty. Texts are equal if they are after each run of
`[\\x20\\x09-\\x0D]` became one space. Of equal texts the smallest id stays, null ids last; of rows
with the same id and text exactly one stays. An empty table gives an empty result. Other columns,
whatever their names, are carried by drop_exact_duplicates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import documents, drop, lean, mix, numbered, written

MAX_SLOTS = 1 << 28
BLOCK = 1 << 16
#: Partial filters for one block that a task merges at most.
FAN_IN = 256
_OTHER = np.uint64(0xA0761D6478BD642F)


def normalised(text: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _slots(sha: pa.Array, bits: int) -> np.ndarray:
    """The two slots of each digest of at least 16 bytes, or of each whole number, one after another."""
    if pa.types.is_int64(sha.type):
        h = sha.to_numpy(zero_copy_only=False).view(np.uint64)
        both = np.stack([mix(h), mix(h ^ _OTHER)], axis=1)
    else:
        both = np.ascontiguousarray(np.frombuffer(b"".join(sha.to_pylist()), np.uint8).reshape(len(sha), -1)[:, :16]).view("<u8")
    return (both >> np.uint64(64 - bits)).astype(np.int64)


def _packed(at: np.ndarray) -> bytes:
    """Places in a block: two bytes each, or a bitmap where that is shorter."""
    if len(at) * 2 < BLOCK // 8:
        return at.astype("<u2").tobytes()
    bits = np.zeros(BLOCK, bool)
    bits[at] = True
    return np.packbits(bits).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    bits = np.zeros(BLOCK, bool)
    if len(data) == BLOCK // 8:
        return np.unpackbits(np.frombuffer(data, np.uint8)).astype(bool)
    bits[np.frombuffer(data, "<u2")] = True
    return bits


def _partial(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(slots: list[np.ndarray]) -> pa.RecordBatch:
        at, n = np.unique(np.concatenate(slots), return_counts=True)
        cuts = np.flatnonzero(np.diff(at // BLOCK, prepend=-1))
        out: list[tuple[int, bytes, bytes]] = []
        for lo, hi in zip(cuts, np.append(cuts[1:], len(at)), strict=True):
            place, many = at[lo:hi] % BLOCK, n[lo:hi] > 1
            out.append((int(at[lo] // BLOCK), _packed(place[~many]), _packed(place[many])))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["block", "once", "twice"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(_slots(b.column(0), bits).ravel())
                size += len(held[-1])
            if size > 4_000_000:
                yield rows(held)
                held, size = [], 0
        if held:
            yield rows(held)

    return run


def _merged(table: pa.Table) -> pa.Table:
    once, twice = np.zeros(BLOCK, bool), np.zeros(BLOCK, bool)
    for a, b in zip(table["once"].to_pylist(), table["twice"].to_pylist(), strict=True):
        a = _unpacked(a)
        twice |= _unpacked(b) | (a & once)
        once |= a
    at = lambda x: pa.array([_packed(np.flatnonzero(x))], pa.binary())
    return pa.table({"block": table["block"].slice(0, 1).cast(pa.int32()), "once": at(once & ~twice), "twice": at(twice)})


def repeated_filter(digests: DataFrame, sha: str = "sha", max_slots: int = MAX_SLOTS, times: int = 2) -> tuple[np.ndarray, int]:
    """The slots that were set `times` (1 or 2) times, as packed bits of max_slots / 8 bytes at most, and the number of bits of a slot's number."""
    bits = min(_bits(digests.count()), max_slots.bit_length() - 1)
    kind = "block int, once binary, twice binary"
    part = digests.select(sha).mapInArrow(lean(_partial(bits)), kind)
    many = digests.rdd.getNumPartitions()
    if many > FAN_IN:
        part = part.withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(-(-many // FAN_IN)))).groupBy("block", "lane").applyInArrow(lambda t: _merged(t.select(["block", "once", "twice"])), kind)
    part = part.groupBy("block").applyInArrow(_merged, kind)
    plane = np.zeros((1 << bits) // 8, np.uint8)
    for row in part.where((F.length("twice") > 0) | F.lit(times == 1)).toLocalIterator():
        set_ = _unpacked(bytes(row.twice)) | _unpacked(bytes(row.once)) if times == 1 else _unpacked(bytes(row.twice))
        plane[row.block * (BLOCK // 8) :][: BLOCK // 8] = np.packbits(set_)
    return plane, bits


def _bits(rows: int) -> int:
    """Bits of a slot's number for 16 slots a row."""
    return max(16, int(16 * rows).bit_length())


def hits(sha: pa.Array, plane: np.ndarray, bits: int) -> np.ndarray:
    """Whether both slots of each digest are set."""
    at = _slots(sha, bits)
    return ((plane[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1) if len(at) else np.zeros(0, bool)


def lookup(spark: SparkSession, plane: np.ndarray, bits: int):
    """A column function of a digest: false if it is surely not in the filter. Only the digest goes to Python."""
    shared = spark.sparkContext.broadcast(plane)

    @F.arrow_udf("boolean")
    def maybe(sha: pa.Array) -> pa.Array:
        return pa.array(hits(sha, shared.value, bits), pa.bool_())

    return maybe


def among(keys: DataFrame, max_slots: int = MAX_SLOTS):
    """A column function: false if the value is surely none of the one column of keys, so that what passes can be joined cheaply."""
    return lookup(keys.sparkSession, *repeated_filter(keys, keys.columns[0], max_slots, times=1))


def digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, a number for the row, and the SHA-256 of the normalised text: written, as it is read more than once."""
    return written(docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2(normalised(text).cast("binary"), 256)).alias("sha")))


def suspects(digest: DataFrame, max_slots: int = MAX_SLOTS) -> DataFrame:
    """digests() with `maybe`, whether the filter calls the text possibly repeated.

    A filter that would have more than max_slots is made and asked in parts by the digest's last bits: the digests are
    written by part, and each part has a filter of its own over its own files, 16 slots a row, whatever the table's size.
    """
    spark = digest.sparkSession
    parts = 1 << max(0, _bits(digest.count()) - (max_slots.bit_length() - 1))
    if parts == 1:
        return digest.withColumn("maybe", lookup(spark, *repeated_filter(digest, max_slots=max_slots))("sha"))
    of = F.conv(F.hex(F.substring("sha", 26, 7)), 16, 10).cast("long") % parts
    dealt = written(digest.withColumn("part", of.cast("int")).repartition("part", F.pmod("row", F.lit(16))), by="part")
    return reduce(DataFrame.unionByName, [(own := dealt.where(F.col("part") == p).drop("part")).withColumn("maybe", lookup(spark, *repeated_filter(own, max_slots=max_slots))("sha")) for p in range(parts)])


def classes(digest: DataFrame, max_slots: int = MAX_SLOTS) -> DataFrame:
    """For each row of digests(): keep_id, group_size, kept."""
    seen = suspects(digest, max_slots)
    alone = seen.where(~F.col("maybe")).select("id", "row", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    maybe = seen.where("maybe").drop("maybe")
    first = maybe.groupBy("sha").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"), F.count(F.lit(1)).alias("group_size"))
    found = maybe.join(first, "sha").select("id", "row", "sha", F.col("first.id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"))
    return alone.unionByName(found)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", max_slots: int = MAX_SLOTS) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256."""
    out = classes(digests(docs, id_col, text), max_slots)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", max_slots: int = MAX_SLOTS) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Digests of repeated texts alone make a second filter; rows it doesn't know keep their place, the others are matched by text and id together, so a hot text spreads over all tasks.
    """
    names = docs.columns
    digest = digests(docs, id_col, text)
    first = suspects(digest, max_slots).where("maybe").groupBy("sha").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("first"), F.count(F.lit(1)).alias("many"))
    first = written(first.where("many > 1").select("sha", F.lit(True).alias("has"), F.col("first.id").alias("keep")))
    drop(digest)
    key = f"c{names.index(id_col)}"
    rows = numbered(docs, sha=F.unhex(F.sha2(normalised(f"`{text}`").cast("binary"), 256)))
    seen = rows.withColumn("maybe_", among(first.select("sha"), max_slots)("sha"))
    return settled(seen, first, ["sha"], key).drop("sha").toDF(*names)


def settled(seen: DataFrame, members: DataFrame, by: list[str], key: str) -> DataFrame:
    """Of seen (columns with `maybe_`, false if surely no line of members is about the row) the rows that members (by, has, keep) doesn't know, and of the others one with the id keep (column `key`) where has is true.

    Rows that aren't `maybe_` pass without a shuffle.
    """
    ours = seen.where("maybe_").drop("maybe_")
    met = ours.join(members.withColumn("known_", F.lit(True)), by, "left")
    # the filter takes some digests for members': such rows are known to no line and stay, each for itself
    staying = met.where(F.col("known_").isNull() | F.col("has") & F.col(key).eqNullSafe(F.col("keep")))
    staying = staying.withColumn("own_", F.when(F.col("known_").isNull(), F.monotonically_increasing_id())).dropDuplicates([*by, key, "own_"])
    return seen.where(~F.col("maybe_")).drop("maybe_").unionByName(staying.select(*ours.columns))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


OP1_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""
