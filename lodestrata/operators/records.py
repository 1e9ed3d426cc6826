"""Record logs as tables: chains of hashes, audits, losses, parity, chunks, pacing.

Defined results: a null number belongs to no run and is missing from none; a repeated number counts once in runs and
losses; a null text has no chunks; of records with one number and no body the first by offset stays.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import gf256


def verify_entries(entries: DataFrame, records: DataFrame) -> DataFrame:
    """Entries (stream, seq, hash) against arrived records: counts by stream, and whether an altered record fails it."""
    seen = records.select("stream", "seq", F.col("hash").alias("got"))
    both = entries.join(seen, ["stream", "seq"], "left")
    out = both.groupBy("stream").agg(F.count_if(F.col("got") == F.col("hash")).alias("verified"), F.count_if(F.col("got") != F.col("hash")).alias("mismatched"), F.count_if(F.col("got").isNull()).alias("missing"))
    return out.withColumn("failed", F.col("mismatched") > 0)


def hash_chain(records: DataFrame, window: int = 64) -> DataFrame:
    """(stream, records, checkpoints, digest): the last digest of each stream's checkpoints, each over `window` entries (seq, hash as hex) and the digest before.

    Entries of a checkpoint are put together by aggregates, 40 bytes each and `window` at most; the chain itself is
    sequential by its nature, so one task goes through a stream's checkpoints in order and holds one of them.
    """
    place = F.row_number().over(Window.partitionBy("stream").orderBy("seq")) - 1
    little = lambda c: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.lpad(F.hex(F.call_function("shiftright", c, i * 8).bitwiseAND(F.lit(255))), 2, "0")), "")
    entry = F.concat(little(F.col("seq")), F.col("hash"))
    cks = records.select("stream", "seq", F.floor(place / window).alias("ck"), entry.alias("entry")).groupBy("stream", "ck").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("seq", "entry"))).alias("all"))
    rows = cks.select("stream", "ck", "n", F.unhex(F.array_join(F.transform("all", lambda e: e["entry"]), "")).alias("entries")).repartition("stream").sortWithinPartitions("stream", "ck")
    kind = records.schema["stream"].dataType

    def run(batches):
        stream, seen, n, many, digest = None, False, 0, 0, b""

        def row():
            return pa.RecordBatch.from_pylist([{"stream": stream, "records": n, "checkpoints": many, "digest": digest.hex()}])

        for b in batches:
            for s, k, entries in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if not seen or s != stream:
                    if seen:
                        yield row()
                    stream, seen, n, many, digest = s, True, 0, 0, hashlib.sha256(f"sstr-v0 genesis{s}".encode()).digest()
                n, many, digest = n + k, many + 1, hashlib.sha256(b"sstr-v0 checkpoint" + digest + entries).digest()
        if seen:
            yield row()

    return rows.mapInArrow(run, f"stream {kind.simpleString()}, records long, checkpoints long, digest string")


def crc_table() -> list[int]:
    """The CRC-32 of each byte, reflected, from its rule."""
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


def missing(records: DataFrame, block: int = 1 << 16) -> DataFrame:
    """Numbers from 0 to the largest that no record has. Only blocks with a gap are counted out, by as many tasks as there are such blocks."""
    spark = records.sparkSession
    held = records.select("seq").distinct().withColumn("block", F.floor(F.col("seq") / block)).groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    top = records.agg(F.max("seq")).first()[0]
    if top is None:
        return records.select("seq").limit(0)
    blocks = spark.range(top // block + 1).withColumnRenamed("id", "block").join(held, "block", "left")
    size = F.least(F.lit(top + 1) - F.col("block") * block, F.lit(block))
    open_ = blocks.where(F.coalesce("n", F.lit(0)) < size).select(F.explode(F.sequence(F.col("block") * block, F.col("block") * block + size - 1)).alias("seq"))
    return open_.join(records.select("seq"), "seq", "left_anti")


def islands(lost: DataFrame, block: int = 1 << 20) -> DataFrame:
    """Runs of neighbouring numbers: first, last, size. A number starts a run if the one before it isn't there."""
    lost = lost.select("seq").distinct()  # a repeated number is one
    before = lost.select((F.col("seq") + 1).alias("seq"))
    after = lost.select((F.col("seq") - 1).alias("seq"))
    firsts, lasts = lost.join(before, "seq", "left_anti"), lost.join(after, "seq", "left_anti")
    # the k-th start and the k-th end belong together; ranks come from block counts
    return _ranked(firsts, block).withColumnRenamed("seq", "first_seq").join(_ranked(lasts, block).withColumnRenamed("seq", "last_seq"), "k").select("first_seq", "last_seq", (F.col("last_seq") - F.col("first_seq") + 1).alias("size"))


def _ranked(numbers: DataFrame, block: int) -> DataFrame:
    """Ranks k without one task for all rows: within a block of numbers, plus the counts of the blocks before."""
    cut = numbers.withColumn("block", F.floor(F.col("seq") / block))
    base = cut.groupBy("block").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return cut.join(base, "block").select("seq", (F.row_number().over(Window.partitionBy("block").orderBy("seq")) + F.col("base")).alias("k"))


def overlaps(ranges: DataFrame, erasures: DataFrame, width: int = 1 << 10) -> DataFrame:
    """Pairs of half-open ranges (a, b) and erasures (s, e) that overlap, joined on buckets; each pair is kept in its first common bucket."""
    bucket = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width))).alias("bucket")
    both = ranges.select("*", bucket("a", "b")).join(erasures.select("*", bucket("s", "e")), "bucket")
    return both.where((F.col("a") < F.col("e")) & (F.col("s") < F.col("b")) & (F.col("bucket") == F.floor(F.greatest("a", "s") / width))).drop("bucket")


def parity_bytes(records: DataFrame, group: int = 16) -> DataFrame:
    """P and Q of one byte of each record by groups of neighbouring numbers, added up before the shuffle."""
    placed = records.withColumn("grp", F.floor(F.col("seq") / group)).withColumn("place", F.col("seq") % group)
    return placed.groupBy("grp").agg(F.bit_xor("byte").alias("p"), F.bit_xor(gf256.times_power(F.col("byte"), F.col("place"))).alias("q"))


def chunks(texts: DataFrame, size: int) -> DataFrame:
    """(id, place, chunk): the text in pieces of `size` characters; an empty text has none."""
    n = F.ceil(F.length("text") / size).cast("int")
    return texts.where(F.length("text") > 0).select("id", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("text"), i * size + 1, F.lit(size)))).alias("place", "chunk"))


def pacing(records: DataFrame, speed: float) -> DataFrame:
    """When each record is due, in microseconds after its stream's first."""
    w = Window.partitionBy("stream").orderBy("seq")
    return records.select("stream", "seq", F.floor((F.col("t_us") - F.first("t_us").over(w)) / speed).cast("long").alias("due_us"))


def first_copies(records: DataFrame) -> DataFrame:
    """One record of each number: the first whose body isn't lost, else the first."""
    w = Window.partitionBy("stream", "seq").orderBy(F.col("body").isNull(), "offset")
    return records.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
