"""Armor: a byte stream as printable lines, each with its offset and a checksum, and back.

A stream's lines stand by themselves, so they are made and read anywhere; a line's offset says where it belongs.
Reading gives pieces and the ranges that no line covered, which the capture reader takes as erasures.

Defined results: an empty stream has a first and a last line; lines that aren't armor are counted, not read; of lines
that cover the same bytes the one that came first counts, the rest are repeats; an unreadable last line leaves the
length open.
"""

from __future__ import annotations

import binascii
import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Payload bytes of a line, its first and last line, and the shape of a line.
LINE_BYTES = 45
BEGIN = "-----BEGIN SSTR ARMOR v0-----"
END = "-----END SSTR ARMOR "
SHAPE = re.compile(r"S([0-9a-f]{9}):([A-Za-z0-9_-]{1,60}):([0-9a-f]{8})")
LAST = re.compile(r"-----END SSTR ARMOR ([0-9a-fA-F]{1,16})(?:[ \t\n\x0b\f\r-][^\n\r\x85\u2028\u2029]*)?")
#: Lines of a batch.
BATCH_LINES = 1 << 14
_URL, _STANDARD = bytes.maketrans(b"+/", b"-_"), bytes.maketrans(b"-_", b"+/")


def pieces(data: Column) -> Column:
    """(offset, bytes) of a stream's pieces of LINE_BYTES."""
    many = F.floor((F.octet_length(data) + LINE_BYTES - 1) / LINE_BYTES).cast("int")
    # the outer transform makes the stream's bytes once, not for each piece
    cut = F.transform(F.array(data), lambda b: F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.struct((i.cast("long") * LINE_BYTES).alias("offset"), F.substring(b, i * LINE_BYTES + 1, F.lit(LINE_BYTES)).alias("bytes"))))[0]
    return F.when(many > 0, cut).otherwise(F.array().cast("array<struct<offset:bigint,bytes:binary>>"))


def end_line(total: int, sha256: str) -> str:
    return f"{END}{total:x} {sha256[:40]}-----"


def stream_lines(data: bytes | None) -> Iterator[tuple[int | None, str | None]]:
    """(line_no, line) of one stream: the first line, a line a piece, the last line, which is null for null."""
    yield -1, BEGIN
    if data is None:
        yield None, None
        return
    for k, at in enumerate(range(0, len(data), LINE_BYTES)):
        head = b"S%09x:%b" % (at, binascii.b2a_base64(data[at : at + LINE_BYTES], newline=False).translate(_URL).rstrip(b"="))
        yield k, f"{head.decode()}:{zlib.crc32(head):08x}"
    yield -(-len(data) // LINE_BYTES), end_line(len(data), hashlib.sha256(data).hexdigest())


def armored(streams: DataFrame) -> DataFrame:
    """(stream, line_no, line) of streams (stream, data): the first line, a line a piece, the last line."""
    kind = StructType([streams.schema["stream"]]).add("line_no", "long").add("line", "string")

    def run(batches):
        for b in batches:
            made = ((i, *line) for i in range(len(b)) for line in stream_lines(b.column(1)[i].as_py()))
            while some := list(itertools.islice(made, BATCH_LINES)):
                which, line_no, line = zip(*some, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which)), pa.array(line_no, pa.int64()), pa.array(line, pa.string())], ["stream", "line_no", "line"])

    return streams.select("stream", "data").mapInArrow(run, kind)


def parse(line: str | None) -> tuple[str, int | None, bytes | None, int | None]:
    """kind (line, end, begin, damaged, other, blank), offset, bytes, total of one line."""
    line = None if line is None else line.rstrip("\r\n")
    if line is None or not line.startswith(("S", "-")):
        return "blank" if line == "" else "other", None, None, None
    if hit := SHAPE.fullmatch(line):
        offset, data, crc = hit.groups()
        if len(data) % 4 == 1 or zlib.crc32(line[:-9].encode()) != int(crc, 16):
            return "damaged", None, None, None
        return "line", int(offset, 16), binascii.a2b_base64(data.encode().translate(_STANDARD) + b"=="), None
    if line.startswith(END.rstrip()):
        total = int(hit[1], 16) if (hit := LAST.fullmatch(line)) else 1 << 63
        return ("end", None, None, total) if total < 1 << 63 else ("begin", None, None, None)
    return "begin" if line.startswith(BEGIN[:20]) else "other", None, None, None


def parsed(lines: DataFrame) -> DataFrame:
    """lines (stream, line_no, line) with kind, offset, bytes, total for line: each is read once, however often its parts are used."""
    rest = [c for c in lines.columns if c != "line"]
    kind = StructType([lines.schema[c] for c in rest]).add("kind", "string").add("offset", "long").add("bytes", "binary").add("total", "long")

    def run(batches):
        for b in batches:
            got = zip(*map(parse, b.column(0).to_pylist()), strict=True) if len(b) else [()] * 4
            new = [pa.array(c, t) for c, t in zip(got, (pa.string(), pa.int64(), pa.binary(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays(b.columns[1:] + new, [*rest, "kind", "offset", "bytes", "total"])

    return lines.select("line", *rest).mapInArrow(run, kind)


def unarmored(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From lines: pieces (stream, offset, bytes), erasures (stream, start, end), and stats (stream, lines, crc_failed, not_armor, repeats, lost_bytes, total).

    Lines come in rising order of their offsets but for repeats; what stands after the last line's end counts as lost up to the length that it tells.
    """
    so_far = Window.partitionBy("stream").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.col("kind") == "line"
    seen = parsed(lines).withColumn("until", F.when(whole, F.col("offset") + F.octet_length("bytes")))
    placed = seen.withColumn("reach", F.coalesce(F.max("until").over(so_far), F.lit(0).cast("long"))).withColumn("repeat", whole & (F.col("offset") < F.col("reach")))
    kept = placed.where(whole & ~F.col("repeat"))
    hole = F.when(whole & (F.col("offset") > F.col("reach")), F.col("offset") - F.col("reach"))
    n = lambda c, name: F.count_if(c).alias(name)
    sums = placed.groupBy("stream").agg(
        n(whole & ~F.col("repeat"), "lines"), n(F.col("kind") == "damaged", "crc_failed"), n(F.col("kind") == "other", "not_armor"), n(F.col("repeat"), "repeats"),
        F.coalesce(F.sum(hole), F.lit(0).cast("long")).alias("holes"), F.coalesce(F.max("until"), F.lit(0).cast("long")).alias("reach"), F.max("total").alias("total"),
    )
    lost_bytes = F.col("holes") + F.greatest(F.coalesce(F.col("total") - F.col("reach"), F.lit(0).cast("long")), F.lit(0).cast("long"))
    stats = sums.select("stream", "lines", "crc_failed", "not_armor", "repeats", lost_bytes.alias("lost_bytes"), "total")
    holes = kept.where("offset > reach").select("stream", F.col("reach").alias("start"), F.col("offset").alias("end"))
    tail = sums.where("total > reach").select("stream", F.col("reach").alias("start"), F.col("total").alias("end"))
    return kept.select("stream", "offset", "bytes"), holes.unionByName(tail), stats


def files(lines: DataFrame) -> DataFrame:
    """(path, content, erasures) for captures.scanned(): each stream's bytes with zeros where lines were lost. One row holds a stream."""
    kept, lost, stats = unarmored(lines)
    zeros = lost.select("stream", F.col("start").alias("offset"), F.unhex(F.repeat(F.lit("00"), (F.col("end") - F.col("start")).cast("int"))).alias("bytes"))
    parts = kept.unionByName(zeros).groupBy("stream").agg(F.array_sort(F.collect_list(F.struct("offset", "bytes"))).alias("parts"))
    ranges = lost.groupBy("stream").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("erasures"))
    content = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["bytes"])), ""))
    out = stats.select("stream").join(parts, "stream", "left").join(ranges, "stream", "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return out.select(F.col("stream").cast("string").alias("path"), F.coalesce(content, F.lit(b"")).alias("content"), F.coalesce("erasures", none).alias("erasures"))


def erasures_json(lost: DataFrame) -> DataFrame:
    """(stream, json): the ranges as an erasure file holds them."""
    pairs = F.array_sort(F.collect_list(F.struct("start", "end")))
    return lost.groupBy("stream").agg(F.to_json(F.transform(pairs, lambda r: F.array(r["start"], r["end"]))).alias("json"))


def erasures_from(spark: SparkSession, path: str) -> DataFrame:
    """(start, end) of an erasure file; pairs of another shape are left out."""
    whole = spark.read.text(path, wholetext=True)
    pairs = whole.select(F.explode(F.from_json("value", "array<string>")).alias("pair"))
    numbers = pairs.select(F.from_json("pair", "array<long>").alias("p")).where(F.size("p") == 2)
    return numbers.select(F.get("p", F.lit(0)).alias("start"), F.get("p", F.lit(1)).alias("end")).where("start is not null and end is not null")
