"""Packing token pieces into as few sequences as it can by bulk-synchronous best fit.

Lengths are whole numbers up to the capacity, so pieces of one length are alike, and so are gaps of one size. Both
are sorted by range and held as runs: a length and the ranks of its pieces, a gap and the sequences that have it. A
range is [2^k, 2^(k+1)). The pieces of a range are matched in rounds, longest range first. In a round each range that
has pieces and gaps is a task: it sweeps its pieces from the longest down, each asks for its successor, the smallest
gap there that holds it; of several that ask for one run of gaps, rank by rank gets a gap, and the rest ask for the next
successor; a gap that got a piece is smaller and asked again. The first round is that of the pieces' own range. Pieces
without a gap then go up: they are dealt by rank to the ranges above, as many to each as its gaps may hold. After a
round gaps go to the range of their new size, and pieces left over begin again. When no range above has a gap, as many
new sequences are opened as hold the pieces left. When all have a place, the range below begins.

The tables of runs have as many lines as there are lengths and sequences of different make, whatever the number of
pieces: they go from round to round through the driver. The rows are ranked within their length from counts for each
task, without gathering a length in one task, and look their place up in the plan. `plan` is the sequential
best fit decreasing of the same runs, to judge the rounds by.

Defined results: a null text counts as empty (one end id, one piece). A null id is kept as it is; rows
keep their repeats, each is packed for itself. An empty table gives an empty result. Other columns
are left out.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, insort
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import blocks, documents, lean, with_fields, written
from .pieces import byte_bpe, forget

CAPACITY = 2048
END = 0
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenised(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces: id, piece, start, length, ids_crc32, and the task with the place among its pieces of that length."""

    def run(batches):
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        encode = byte_bpe(path)
        for t in blocks(batches, text="t_"):
            ids, offs = encode.ids([x or "" for x in t["t_"].to_pylist()])
            n = np.diff(offs) + 1
            data = np.full(len(ids) + len(n), END, "<u4")
            data[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n - 1)] = ids
            begin = np.append(0, np.cumsum(n))
            many = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            rest = (n - (many - 1) * capacity)[row]
            start = np.where(piece == 0, 0, rest + (piece - 1) * capacity)
            length = np.where(piece == 0, rest, capacity)
            raw = memoryview(data).cast("B") if len(data) else b""
            at = (begin[row] + start) * 4
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + length * 4).tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            runs = np.searchsorted(length[order], np.arange(capacity + 2))
            local = np.empty(len(row), np.int64)
            local[order] = np.arange(len(row)) - runs[length[order]] + seen[length[order]]
            seen += np.diff(runs)
            yield pa.RecordBatch.from_arrays([t[0].combine_chunks().take(pa.array(row)) if len(row) else t[0].combine_chunks(), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(row), task, np.int32)), pa.array(local)], ["id", "piece", "start", "length", "ids_crc32", "task", "local"])
        forget()

    src = docs.select(F.col(id_col).alias("id"), F.col(text).alias("t_"))
    fields = {"piece": T.IntegerType(), "start": T.LongType(), "length": T.LongType(), "ids_crc32": T.LongType(), "task": T.IntegerType(), "local": T.LongType()}
    return src.mapInArrow(lean(run), with_fields(src.drop("t_"), **fields))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[str, np.ndarray], int]:
    """Lines (length, rank, many, sequence, offset): ranks from `rank` on go one each to the sequences from `sequence` on. And the number of sequences."""
    lines: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    opened = 0

    def put(gap: int, run: tuple[int, int]) -> None:
        if gap:
            if gap not in gaps:
                insort(sizes, gap)
                gaps[gap] = []
            heapq.heappush(gaps[gap], run)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(sizes, length)
            if at == len(sizes):
                # what one new sequence holds of this length, for all that are left
                per = capacity // length
                full, over = divmod(left, per)
                for many, each in ((full, per), (1, over)):
                    if many and each:
                        for k in range(each):
                            lines.append((length, rank, many, opened, k * length))
                            rank += many
                        put(capacity - each * length, (opened, many))
                        opened += many
                break
            gap = sizes[at]
            first, many = heapq.heappop(gaps[gap])
            if not gaps[gap]:
                del gaps[gap], sizes[at]
            take = min(many, left)
            lines.append((length, rank, take, first, capacity - gap))
            if many > take:
                put(gap, (first + take, many - take))
            put(gap - length, (first, take))
            rank, left = rank + take, left - take
    table = np.array(sorted(lines), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "many", "sequence", "offset"), table.T.copy(), strict=True)), opened


_LINE = "kind string, at int, size long, first long, many long, sequence long, place long"


def range_of(size: int) -> int:
    return size.bit_length() - 1


def _sweep(capacity: int):
    """One range's round: its runs of pieces and of gaps to lines of the plan, pieces left, and gaps as they are then."""

    def run(runs: pa.Table) -> pa.Table:
        at = runs["at"][0].as_py()
        items = sorted(((r["size"], r["first"], r["many"]) for r in runs.to_pylist() if r["kind"] == "piece"), key=lambda r: (-r[0], r[1]))
        gaps: dict[int, list[tuple[int, int]]] = {}
        out: list[tuple] = []

        def put(size: int, first: int, many: int) -> None:
            if size:
                if size not in gaps:
                    insort(sizes, size)
                    gaps[size] = []
                heapq.heappush(gaps[size], (first, many))

        sizes: list[int] = []
        for r in runs.to_pylist():
            if r["kind"] == "gap":
                put(r["size"], r["first"], r["many"])
        for length, rank, left in items:
            while left:
                k = bisect_left(sizes, length)
                if k == len(sizes):
                    out.append(("piece", at, length, rank, left, None, None))
                    break
                gap = sizes[k]
                first, many = heapq.heappop(gaps[gap])
                if not gaps[gap]:
                    del gaps[gap], sizes[k]
                take = min(many, left)
                out.append(("line", at, length, rank, take, first, capacity - gap))
                if many > take:
                    put(gap, first + take, many - take)
                put(gap - length, first, take)
                rank, left = rank + take, left - take
        out += [("gap", range_of(size), size, first, many, None, None) for size in sizes for first, many in gaps[size]]
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate(zip(("kind", "at", "size", "first", "many", "sequence", "place"), kinds, strict=True))})

    return run


def _runs(spark: SparkSession, rows: list[tuple[int, str, int, int, int]]) -> DataFrame:
    """Runs as a table; as Arrow, so that no Python worker has to read them before the sweeps do."""
    kinds = (("at", pa.int32()), ("kind", pa.string()), ("size", pa.int64()), ("first", pa.int64()), ("many", pa.int64()))
    return spark.createDataFrame(pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(kinds)}))


def rounds(spark: SparkSession, counts: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[str, np.ndarray], int]:
    """The plan's lines as plan() has them, and the number of sequences, by rounds over ranges."""
    lines: list[tuple[int, int, int, int, int]] = []
    gaps: list[tuple[int, int, int]] = []
    opened = 0
    for home in sorted({range_of(n) for n in counts}, reverse=True):
        waiting = [(n, 0, counts[n]) for n in sorted(counts, reverse=True) if range_of(n) == home]
        own_turn = True
        while waiting:
            there = sorted({range_of(g) for g, _, _ in gaps if range_of(g) >= home})
            if own_turn and home in there:
                dealt = {home: waiting}
            else:
                above = [r for r in there if r > home]
                if not above:
                    new = max(1, ceil(sum(Fraction(many, capacity // n) for n, _, many in waiting)))
                    gaps.append((capacity, opened, new))
                    opened, above = opened + new, [range_of(capacity)]
                dealt = _dealt(waiting, {r: sum(g * many for g, _, many in gaps if range_of(g) == r) for r in above})
            rows = [(at, "piece", *w) for at, own in dealt.items() for w in own] + [(range_of(g), "gap", g, first, many) for g, first, many in gaps if range_of(g) in dealt]
            done = _runs(spark, rows).groupBy("at").applyInArrow(_sweep(capacity), _LINE).toArrow().to_pylist()
            lines += [(r["size"], r["first"], r["many"], r["sequence"], r["place"]) for r in done if r["kind"] == "line"]
            gaps = _joined([g for g in gaps if range_of(g[0]) not in dealt] + [(r["size"], r["first"], r["many"]) for r in done if r["kind"] == "gap"])
            waiting = sorted(((r["size"], r["first"], r["many"]) for r in done if r["kind"] == "piece"), key=lambda w: (-w[0], w[1]))
            own_turn = list(dealt) != [home]
    table = np.array(sorted(lines), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "many", "sequence", "offset"), table.T.copy(), strict=True)), opened


def _dealt(waiting: list[tuple[int, int, int]], space: dict[int, int]) -> dict[int, list[tuple[int, int, int]]]:
    """Runs of pieces, longest first, by range: as much to each as its gaps have space, the rest to the last."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    ranges = sorted(space)
    left = [space[r] for r in ranges]
    k = 0
    for n, first, many in waiting:
        while many:
            while k + 1 < len(ranges) and left[k] < n:
                k += 1
            take = many if k + 1 == len(ranges) else min(many, left[k] // n)
            out.setdefault(ranges[k], []).append((n, first, take))
            left[k] -= take * n
            first, many = first + take, many - take
    return out


def _joined(gaps: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of one size that follow each other as one."""
    out: list[tuple[int, int, int]] = []
    for size, first, many in sorted(gaps):
        if out and out[-1][0] == size and out[-1][1] + out[-1][2] == first:
            out[-1] = (size, out[-1][1], out[-1][2] + many)
        else:
            out.append((size, first, many))
    return out


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces, as tokenised() gives them and written, with sequence_id and offset."""
    spark = pieces.sparkSession
    by_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a length
    lines, _ = rounds(spark, counts, capacity)
    shared = spark.sparkContext.broadcast(lines)

    def run(batches):
        p = shared.value
        # lengths and ranks as one rising number
        wide = np.int64(max(counts.values(), default=0) + 1)
        keys = p["length"] * wide + p["rank"]
        for b in batches:
            rank = b.column(b.schema.get_field_index("rank")).to_numpy()
            length = b.column(b.schema.get_field_index("length")).to_numpy()
            at = np.searchsorted(keys, length * wide + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p["sequence"][at] + rank - p["rank"][at]), pa.array(p["offset"][at])], [*b.schema.names, "sequence_id", "offset"])

    ranked = pieces.join(base.select("task", "length", "base"), ["task", "length"]).withColumn("rank", F.col("local") + F.col("base")).drop("task", "local", "base")
    return ranked.mapInArrow(lean(run), with_fields(ranked, sequence_id=T.LongType(), offset=T.LongType())).drop("rank")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    pieces = written(tokenised(docs, path or tokenizer_path(), capacity, id_col, text))
    out = packed(pieces, capacity)
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
