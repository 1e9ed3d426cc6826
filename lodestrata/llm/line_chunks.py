"""Line dedup: repeated runs of two lines and more go.

Each two neighbouring lines of a text are hashed together. A run of lines repeats if, and only if, all its
pairs do, so the lines of pairs that stood before (smaller id, then row, then place) are the longest repeated
runs, wherever they begin and end. Pairs of equal hash are told apart by SHA-256 of their bytes. A pair that
overlaps its own first occurrence is no repeat of it. Each line's first occurrence stays, as any pair
with it that stood before would hold an earlier one.

Content-defined chunks are told as sizes: a rolling hash over the last WINDOW line hashes ends a chunk where it
is 0 modulo SPREAD. removed_chunks are those of which no line stays.

Defined results: a null text counts as empty, one empty line. Lines end at LF alone, other characters
belong to them. Two empty lines are no pair; empty lines between removed ones go with them. Null ids come
last. Rows keep their repeats; other columns are left out. A hot pair is counted before it shuffles, and its
rows are split by adaptive joins.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import blocks, documents, flat, lean, mix, owners, span_hashes, written
from .exact_dedup import hits, repeated_filter

WINDOW = 2
SPREAD = 3
_M = np.uint64(0xA0761D6478BD642F)


def cuts(data: np.ndarray, offs: np.ndarray, window: int = WINDOW, spread: int = SPREAD):
    """Text, first byte and end byte of each line; text and number of lines of each chunk."""
    n = len(offs) - 1
    lf = np.flatnonzero(data == 10)
    per = np.searchsorted(lf, offs)
    many = np.diff(per) + 1
    before = np.append(0, np.cumsum(many))
    who = owners(before)
    at = np.arange(before[-1])
    first, last = at == before[who], at == before[who + 1] - 1
    starts, ends = np.empty(before[-1], np.int64), np.empty(before[-1], np.int64)
    starts[first], ends[last] = offs[:-1], offs[1:]
    ends[~last] = lf
    starts[~first] = lf + 1
    h = span_hashes(data, starts, ends)
    roll = np.zeros(len(h), np.uint64)
    place = at - before[who]
    for k in range(window):
        roll = roll * _M + np.where(place >= k, h[np.maximum(at - k, 0)], np.uint64(k))
    close = (mix(roll) % np.uint64(spread) == 0) | last
    end_at = np.flatnonzero(close)
    begin = np.append(0, end_at[:-1] + 1)
    return who, starts, ends, who[begin], end_at - begin + 1


def _lists(who: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(who, np.arange(n + 1)).astype(np.int32)), values)


def paired(docs: DataFrame, id_col: str, text: str, window: int = WINDOW, spread: int = SPREAD) -> DataFrame:
    """id, row, text, hashes of each line with the next one (null where both are empty), lines of each chunk."""
    src = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text), F.lit("")).alias("t_"))

    def run(batches):
        for t in blocks(batches, text="t_"):
            data, offs = flat(t["t_"])
            who, s, e, owner, lines = cuts(data, offs, window, spread)
            two = np.flatnonzero(who[1:] == who[:-1])
            h = pa.array(span_hashes(data, s[two], e[two + 1]).view(np.int64), mask=e[two + 1] - s[two] == 1)
            yield pa.RecordBatch.from_arrays([t["id"].combine_chunks(), t["row"].combine_chunks(), t["t_"].combine_chunks(), _lists(who[two], len(t), h), _lists(owner, len(t), pa.array(lines.astype(np.int32)))], ["id", "row", "text", "h", "chunks"])

    return src.mapInArrow(lean(run), f"id {src.schema['id'].dataType.simpleString()}, row long, text string, h array<long>, chunks array<int>")


def _all_hashes(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0).flatten().drop_null()], ["h"])


def _gone(places: list[int], lines: list[str]) -> np.ndarray:
    """Which lines go: those of the pairs, and empty ones between two that go."""
    out = np.zeros(len(lines), bool)
    out[places] = True
    out[np.array(places) + 1] = True
    at = 0
    while at < len(lines):
        end = at
        while end < len(lines) and not out[end] and not lines[end]:
            end += 1
        if at and end > at and end < len(lines) and out[at - 1] and out[end]:
            out[at:end] = True
        at = max(end, at + 1)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, spread: int = SPREAD) -> DataFrame:
    """id_col, text without repeated runs of lines, n_lines, n_chunks, removed_chunks, removed_lines."""
    table = written(paired(docs, id_col, text, window, spread))
    kind = table.schema["id"].dataType.simpleString()
    # pass one: a filter of hashes that may be repeated; pass two: only those pairs' digests shuffle
    plane, bits = repeated_filter(table.select("h").mapInArrow(lean(_all_hashes), "h long"), "h")
    shared = docs.sparkSession.sparkContext.broadcast(plane)

    def suspected(batches):
        for b in batches:
            h = b.column(3)
            flat_h, many = h.flatten(), np.diff(np.asarray(h.offsets))
            if not len(flat_h):
                continue
            live = np.asarray(flat_h.is_valid())
            hit = hits(flat_h.fill_null(0), shared.value, bits) & live
            who = np.repeat(np.arange(b.num_rows), many)
            place = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
            rows, sha, held, lines = np.flatnonzero(hit), [], -1, []
            for i, p in zip(who[rows].tolist(), place[rows].tolist(), strict=True):
                if i != held:
                    held, lines = i, b.column(2)[i].as_py().encode().split(b"\n")
                sha.append(hashlib.sha256(lines[p] + b"\n" + lines[p + 1]).digest())
            at = pa.array(who[rows])
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(place[rows].astype(np.int32)), pa.array(sha, pa.binary())], ["id", "row", "place", "same"])

    suspects = table.select("id", "row", "text", "h").mapInArrow(lean(suspected), f"id {kind}, row long, place int, same binary")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row", "place")
    first = suspects.groupBy("same").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("many")).where("many > 1").withColumnRenamed("same", "same_")
    gone = suspects.join(first, F.col("same") == F.col("same_")).where(~((F.col("row") == F.col("first.row")) & F.col("place").between(F.col("first.place"), F.col("first.place") + 1)))
    gone = gone.groupBy("row").agg(F.collect_set("place").alias("gone"))  # of one document

    def kept(batches):
        for b in batches:
            out = [[] for _ in range(5)]
            for t, chunks, places in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                n = t.count("\n") + 1
                removed = whole = 0
                if places:
                    lines = t.split("\n")
                    off = _gone(places, lines)
                    t = "\n".join(x for x, o in zip(lines, off.tolist(), strict=True) if not o)
                    removed, whole = int(off.sum()), int(np.logical_and.reduceat(off, np.cumsum(chunks) - chunks).sum())
                for col, x in zip(out, (t, n, len(chunks), whole, removed), strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.string()), *(pa.array(x, pa.int32()) for x in out[1:])], ["id", "text", "n_lines", "n_chunks", "removed_chunks", "removed_lines"])

    out = table.join(gone, "row", "left").select("id", "text", "chunks", "gone").mapInArrow(lean(kept), f"id {kind}, text string, n_lines int, n_chunks int, removed_chunks int, removed_lines int")
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text), "n_lines", "n_chunks", "removed_chunks", "removed_lines")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_chunks", "removed_chunks", "removed_lines", F.length("text").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))
