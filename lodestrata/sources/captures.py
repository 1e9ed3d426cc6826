"""Captures: framed records with two header copies and Reed-Solomon coded bodies, as tables.

A capture is a signature and records; a record is two marked header copies and a coded body. A damaged
header is mended from either copy, or the reader looks for the next mark. Files are read whole, one
a task (a lost header can hide any number of bytes, so files aren't split); lost bodies come back from
the parity records of their group by joins.

Ranges of a file that are known lost (erasures) go into the codec. Checkpoints chain the hashes of the records
before them, so that a later change shows.

Defined results: an empty file has no records; bytes that belong to no record are skipped and counted in the row
of the record after them; a record whose body can't be mended has a null `plain`; a record cut off by the file's
end is left out. A file's end is a row of its own, of type `` and number -1, for those who ask: the bytes skipped at
its end, and whether it is cut off.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import struct
import zlib
from bisect import bisect_right
from collections.abc import Callable, Generator, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import gf256
from lodestrata.functions import reed_solomon as rs
from lodestrata.operators import records

# Fixed values of the format: name and files, signature, marks, header layout, limits, entry layout of parity records.
FORMAT = "sstr"
FILES = "*.[sS][sS][tT][rR]"
MAGIC = b"\x89SST\r\n\x1a\n"
MARKS = (b"\xa7SSR", b"\xa7SSr")
HEADER = struct.Struct("<BBHQQII")
ENTRY = struct.Struct("<QQBII")
ENTRY_SIZE = ENTRY.size
COPY = 68
LONGEST_BODY = 1 << 24
LONGEST_INFLATED = 1 << 26
DEFLATED = 1
GROUP = 16
CHUNK = 1 << 16
TYPES = "HDPCE"

GENESIS, CHECKPOINT, SIGNED = b"sstr-v0 genesis", b"sstr-v0 checkpoint", b"sstr-v0 "
CHECKPOINT_RECORDS = 64

#: Bytes of bodies that a reader mends together, of files that it reads side by side, and of records that a writer codes together.
TOGETHER = 1 << 22

SCHEMA = "path string, offset long, typ string, flags int, seq long, t_us long, plain_len long, body_crc long, plain binary, hdr_fixed int, body_fixed int, resync boolean, skipped long, truncated boolean"


def bare_header(typ: str, flags: int, seq: int, t_us: int, size: int, crc: int) -> bytes:
    return HEADER.pack(ord(typ), flags, 0, seq, t_us, size, crc)


def packed_all(rows: list[tuple[str, int, int, int, bytes]]) -> list[bytes]:
    """Each record (typ, flags, seq, t_us, plain) as it is stored; all are coded side by side."""
    bare = [bare_header(typ, flags, seq, t_us, len(plain), zlib.crc32(plain)) for typ, flags, seq, t_us, plain in rows]
    copies = rs.encode_all([b + struct.pack("<I", zlib.crc32(b)) for b in bare])
    return [MARKS[0] + copy + MARKS[1] + copy + body for copy, body in zip(copies, rs.encode_all([r[4] for r in rows]), strict=True)]


def packed(typ: str, flags: int, seq: int, t_us: int, plain: bytes) -> bytes:
    """One record as it is stored."""
    return packed_all([(typ, flags, seq, t_us, plain)])[0]


def parity_body(entries: list[tuple], bodies: list[bytes], rows: int = 2) -> bytes:
    """Entries (seq, t_us, flags, plain_len, body_crc), then the P row, and with rows = 2 the Q row."""
    return struct.pack("<H", len(entries)) + b"".join(ENTRY.pack(*e) for e in entries) + b"".join(gf256.parity(bodies)[:rows])


def record_hash(typ: str, flags: int, seq: int, t_us: int, plain: bytes) -> bytes:
    """What a checkpoint's entry holds of a record."""
    return hashlib.sha256(bare_header(typ, flags, seq, t_us, len(plain), zlib.crc32(plain)) + plain).digest()


def genesis(stream_id: bytes) -> bytes:
    return hashlib.sha256(GENESIS + stream_id).digest()


def checkpoint_digest(prev: bytes, entries: list[tuple[int, bytes]]) -> bytes:
    return hashlib.sha256(CHECKPOINT + prev + b"".join(seq.to_bytes(8, "little") + h for seq, h in entries)).digest()


def signed_message(stream_id: bytes, digest: bytes) -> bytes:
    """What a signer signs."""
    return SIGNED + stream_id + digest


def _plain_records(chunks: Iterable[tuple[int, bytes]], stream_id: str, rows: int = 2, deflate: bool = False, group: int = GROUP, checkpoint: int | None = CHECKPOINT_RECORDS, meta: dict | None = None, sign: Callable[[bytes], str] | None = None) -> Iterator[tuple]:
    """The records of a capture, not yet coded: (typ, flags, seq, t_us, plain), times. Holds one group and one checkpoint's entries."""
    head = {"format": FORMAT, "version": rows - 1, "stream_id": stream_id, **(meta or {})}
    own = bytes.fromhex(stream_id) if len(stream_id) % 2 == 0 and all(c in "0123456789abcdef" for c in stream_id) else stream_id.encode()
    seq, entries, bodies, window, prev, digest, total, many, last = 0, [], [], [], genesis(own), hashlib.sha256(), 0, 0, 0

    def put(typ: str, plain: bytes, t_us: int, flags: int = 0, times: int = 1, hashed: bool = False) -> tuple:
        nonlocal seq
        if hashed:
            window.append((seq, record_hash(typ, flags, seq, t_us, plain)))
        seq += 1
        return (typ, flags, seq - 1, t_us, plain), times

    def parity() -> Iterator[tuple]:
        if entries:
            yield put("P", parity_body(entries, bodies, rows), last)
            entries.clear()
            bodies.clear()

    def check() -> Iterator[tuple]:
        nonlocal prev
        if checkpoint is None or not window:
            return
        d = checkpoint_digest(prev, window)
        body = {"prev": prev.hex(), "entries": [[n, h.hex()] for n, h in window], "digest": d.hex(), "sig": sign(signed_message(own, d)) if sign else None, "stream": head}
        window.clear()
        prev = d
        yield put("C", json.dumps(body, separators=(",", ":")).encode(), last, times=2)

    yield put("H", json.dumps(head).encode(), 0, times=2, hashed=True)
    for t_us, chunk in chunks:
        small = zlib.compress(chunk) if deflate else chunk
        flags = DEFLATED if len(small) < 0.95 * len(chunk) else 0
        body, last = small if flags else chunk, t_us
        entries.append((seq, t_us, flags, len(body), zlib.crc32(body)))
        bodies.append(body)
        yield put("D", body, t_us, flags, hashed=True)
        digest.update(chunk)
        total, many = total + len(chunk), many + 1
        due = checkpoint is not None and len(window) >= checkpoint
        if len(entries) >= group or due:
            yield from parity()
        if due:
            yield from check()
    yield from parity()
    yield put("E", json.dumps({"data_records": many, "bytes": total, "sha256": digest.hexdigest(), "interrupted": False}).encode(), last, times=2, hashed=True)
    yield from check()


def _coded(flow: Iterable[tuple]) -> Iterator[tuple]:
    """(key, piece) of (key, (record, times)); records are coded together by TOGETHER / 4 bytes, headers counted."""
    held, size = [], 0
    for item in flow:
        held.append(item)
        size += len(item[1][0][4]) + 2 * COPY
        if size >= TOGETHER // 4:
            yield from _coded_now(held)
            held, size = [], 0
    yield from _coded_now(held)


def _coded_now(held: list[tuple]) -> Iterator[tuple]:
    for (key, (_, times)), piece in zip(held, packed_all([r for _, (r, _) in held]), strict=True):
        yield key, piece * times


def pieces(chunks: Iterable[tuple[int, bytes]], stream_id: str, *args, **kw) -> Iterator[bytes]:
    """A capture of (t_us, bytes) chunks, piece by piece: head and end twice, parity after each group, a checkpoint twice after as many hashed records. Holds one group, one checkpoint's entries and the records that are coded together."""
    yield MAGIC
    for _, piece in _coded((None, r) for r in _plain_records(chunks, stream_id, *args, **kw)):
        yield piece


def captured(many: Iterable[tuple[Iterable[tuple[int, bytes]], str]], rows: int = 2, deflate: bool = False, group: int = GROUP, checkpoint: int | None = None, meta: dict | None = None) -> Iterator[bytes]:
    """The whole capture of each (chunks, stream_id), coded side by side; without checkpoints unless asked."""
    flow = ((i, r) for i, (chunks, stream_id) in enumerate(many) for r in _plain_records(chunks, stream_id, rows, deflate, group, checkpoint, meta))
    for _, own in itertools.groupby(_coded(flow), key=lambda x: x[0]):
        yield MAGIC + b"".join(piece for _, piece in own)


def capture(chunks: list[tuple[int, bytes]], stream_id: str, rows: int = 2, deflate: bool = False, group: int = GROUP, checkpoint: int | None = None, meta: dict | None = None) -> bytes:
    """A whole capture; without checkpoints unless asked."""
    return next(captured([(chunks, stream_id)], rows, deflate, group, checkpoint, meta))


def recorded(chunks: DataFrame, rows: int = 2, deflate: bool = False, checkpoint: int | None = CHECKPOINT_RECORDS) -> DataFrame:
    """(stream, place, bytes): the captures of all streams of chunks (stream string, pos, t_us, chunk), in pieces in their order.

    A stream's records are chained, so one task writes it, one piece after another; streams are spread over all tasks.
    """
    src = chunks.select("stream", "pos", "t_us", "chunk").repartition("stream").sortWithinPartitions("stream", "pos")

    def run(batches):
        flow = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True))
        for stream, own in itertools.groupby(flow, key=lambda r: r[0]):
            held, size, place = [], 0, 0
            for piece in pieces(((t, c) for _, t, c in own), stream, rows, deflate, GROUP, checkpoint):
                held.append(piece)
                size += len(piece)
                if size >= 1 << 20:
                    yield _piece(stream, place, held)
                    held, size, place = [], 0, place + 1
            if held:
                yield _piece(stream, place, held)

    return src.mapInArrow(run, "stream string, place int, bytes binary")


def _piece(stream: str, place: int, held: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([stream]), pa.array([place], pa.int32()), pa.array([b"".join(held)], pa.binary())], ["stream", "place", "bytes"])


class Lost:
    """Lost ranges [start, end) of a file, for masks of its parts; overlapping ones are joined."""

    def __init__(self, ranges: Iterable[tuple[int, int]] = ()):
        self.start, self.end = [], []
        for a, b in sorted((a, b) for a, b in ranges if b > a):
            if self.end and a <= self.end[-1]:
                self.end[-1] = max(self.end[-1], b)
            else:
                self.start.append(a)
                self.end.append(b)

    def mask(self, a: int, b: int) -> np.ndarray | None:
        """Which bytes of [a, b) are lost, None if none is."""
        if not self.start:
            return None
        first = bisect_right(self.end, a)
        out = None
        while first < len(self.start) and self.start[first] < b:
            out = np.zeros(b - a, bool) if out is None else out
            out[max(self.start[first] - a, 0) : self.end[first] - a] = True
            first += 1
        return out


class _Ask(NamedTuple):
    """A damaged header's copy, which a reader wants mended, and which of its bytes are lost."""

    raw: bytes
    mask: np.ndarray | None


def _is_header(b: bytes) -> bool:
    return zlib.crc32(b[:28]) == int.from_bytes(b[28:32], "little")


# What asks for a header to be mended: it is sent the plain bytes or None, and the number of bytes mended.
_Header = Generator[_Ask, tuple[bytes | None, int], tuple[tuple, int] | None]


def _header(data: bytes, at: int, lost: Lost) -> _Header:
    """Header fields at `at` and the bytes mended: from either copy, or from both, each with what the other lost."""
    copies = [(data[i : i + 64], lost.mask(i, i + 64)) for i in (at + 4, at + COPY + 4)]
    if any(m is not None for _, m in copies):
        (one, a), (two, b) = ((np.frombuffer(c, np.uint8), np.zeros(64, bool) if m is None else m) for c, m in copies)
        copies.append((np.where(a & ~b, two, one).tobytes(), a & b))
    for raw, mask in copies:
        bare, mended = (raw, 0) if _is_header(raw) else (yield _Ask(raw, mask))
        if bare is None:
            continue
        typ, flags, _, seq, t_us, size, crc = HEADER.unpack(bare[:28])
        if chr(typ) in TYPES and size <= LONGEST_BODY and max(seq, t_us) < 1 << 63:
            return (chr(typ), flags, seq, t_us, size, crc), mended
    return None


def _next(data: bytes, at: int, lost: Lost) -> Generator[_Ask, tuple, tuple[int, tuple[tuple, int]] | None]:
    """The first place from `at` on with a readable header: `at` itself, or where a mark says one starts."""
    room = len(data) - 2 * COPY
    if at <= room and (found := (yield from _header(data, at, lost))):
        return at, found
    seen = at
    while True:
        marks = [(i, i - k * COPY) for k, m in enumerate(MARKS) if (i := data.find(m, seen + 1)) >= 0]
        if not marks:
            return None
        seen, start = min(marks)
        if at <= start <= room and (found := (yield from _header(data, start, lost))):
            return start, found


def _read(data: bytes, lost: Lost) -> Generator[_Ask | tuple, tuple | None, None]:
    """A capture's records without their bodies (offset, typ, flags, seq, t_us, size, crc, bytes mended, resync, skipped), the whole row about its end, and between them what is to be mended."""
    at = len(MAGIC) if data.startswith(MAGIC) else 0
    while hit := (yield from _next(data, at, lost)):
        start, (head, fixed_head) = hit
        end = start + 2 * COPY + rs.body_length(head[4])
        if end > len(data):
            yield len(data), "", 0, -1, 0, 0, 0, None, 0, 0, start != at, start - at, True
            return
        yield start, *head, fixed_head, start != at, start - at
        at = end
    yield len(data), "", 0, -1, 0, 0, 0, None, 0, 0, False, len(data) - at, False


def _heads(files: list[tuple[bytes, Lost]]) -> Iterator[tuple[int, tuple]]:
    """(which file, what _read gives) of all files, each in its order; damaged headers of all are mended side by side."""
    readers = [_read(*f) for f in files]
    live: dict[int, tuple | None] = dict.fromkeys(range(len(files)))
    while live:
        asked = {}
        for i, answer in live.items():
            got = readers[i].send(answer)
            while got is not None and not isinstance(got, _Ask):
                yield i, got
                got = next(readers[i], None)
            if got is not None:
                asked[i] = got.raw, 32, _is_header, got.mask
        live = dict(zip(asked, rs.decode_all(list(asked.values())), strict=True))


def every_of(files: list[tuple[bytes, Iterable[tuple[int, int]]]]) -> Iterator[tuple[int, tuple]]:
    """(which file, record) of captures (data, lost ranges), read side by side: each one's records in order, as SCHEMA has them after path, and last the row about its end. Bodies are mended some at a time."""
    own = [(data, Lost(lost)) for data, lost in files]
    held, bodies, size_held = [], [], 0

    def mended() -> Iterator[tuple[int, tuple]]:
        done = iter(rs.decode_all(bodies))
        for i, h in held:
            if h[1]:
                plain, fixed = next(done)
                yield i, (*h[:7], plain, h[7], fixed, *h[8:], False)
            else:
                yield i, h
        held.clear()
        bodies.clear()

    for i, h in _heads(own):
        held.append((i, h))
        if not h[1]:
            continue
        (data, lost), at, size, crc = own[i], h[0] + 2 * COPY, h[5], h[6]
        end = at + rs.body_length(size)
        bodies.append((data[at:end], size, lambda b, crc=crc: zlib.crc32(b) == crc, lost.mask(at, end)))
        size_held += end - at
        if size_held >= TOGETHER:
            yield from mended()
            size_held = 0
    yield from mended()


def every(data: bytes, lost: Iterable[tuple[int, int]] = ()) -> Iterator[tuple]:
    """Records of a capture, as SCHEMA has them after path, and last the row about the file's end."""
    return (r for _, r in every_of([(data, lost)]))


def scan(data: bytes, lost: Iterable[tuple[int, int]] = ()) -> Iterator[tuple]:
    """The records alone."""
    return (r for r in every(data, lost) if r[1])


def placed(data: bytes) -> Iterator[tuple[int, str, int]]:
    """(offset, typ, body's plain bytes) of the records of a capture, of which no body is decoded."""
    return ((h[0], h[1], h[5]) for _, h in _heads([(data, Lost())]) if h[1])


def side_by_side(files: Iterable[tuple]) -> Iterator[list[tuple]]:
    """Runs of files (key, data, ...) of about TOGETHER bytes, a longer file by itself."""
    held, size = [], 0
    for f in files:
        if held and size + len(f[1]) > TOGETHER:
            yield held
            held, size = [], 0
        held.append(f)
        size += len(f[1])
    if held:
        yield held


def scanned(files: DataFrame, ends: bool = False) -> DataFrame:
    """Records of all files (path, content), with erasures (array of structs start, end) if there is such a column; with `ends` also the rows about the files' ends."""
    with_lost = "erasures" in files.columns

    def found(batch):
        for i, (path, content) in enumerate(zip(batch.column(0), batch.column(1), strict=True)):
            lost = [(e["start"], e["end"]) for e in batch.column(2)[i].as_py() or []] if with_lost else []
            yield path.as_py(), content.as_py() or b"", lost

    def run(batches):
        for batch in batches:
            for some in side_by_side(found(batch)):
                held, size = [], 0
                for i, r in every_of([f[1:] for f in some]):
                    if not r[1] and not ends:
                        continue
                    held.append((some[i][0], *r))
                    size += len(r[7] or b"")
                    if size > 1 << 22:
                        yield _batch(held)
                        held, size = [], 0
                if held:
                    yield _batch(held)

    return files.select("path", "content", *["erasures"] * with_lost).mapInArrow(run, SCHEMA)


_ARROW = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("typ", pa.string()), ("flags", pa.int32()), ("seq", pa.int64()), ("t_us", pa.int64()), ("plain_len", pa.int64()), ("body_crc", pa.int64()), ("plain", pa.binary()), ("hdr_fixed", pa.int32()), ("body_fixed", pa.int32()), ("resync", pa.bool_()), ("skipped", pa.int64()), ("truncated", pa.bool_())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Captures at or below path: path, name, length, in the order of folders, then of their bytes; files go before folders."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", FILES).option("recursiveFileLookup", "true").load(path)
    out = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    depth = F.transform(F.split("path", "/"), lambda x, i: F.concat(F.when(i == F.size(F.split("path", "/")) - 1, F.lit("0")).otherwise(F.lit("1")), x))
    return out.orderBy(depth.cast("array<string>"))


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, meta) of captures: the JSON of the first head record; no further record of a file is decoded."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", FILES).option("recursiveFileLookup", "true").load(path)

    def run(batches):
        for b in batches:
            metas = [next((r[7].decode("utf-8", "replace") for r in scan(c.as_py() or b"") if r[1] == "H" and r[7] is not None), None) for c in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(metas, pa.string())], ["path", "meta"])

    return files.select("path", "content").mapInArrow(run, "path string, meta string")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the capture at path, or of all FILES below it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", FILES).option("recursiveFileLookup", "true")
    return scanned(files.load(path))


def data_records(rows: DataFrame) -> DataFrame:
    """(path, seq, t_us, flags, plain, rebuilt) of every data record that arrived whole or can be rebuilt; the others are left out.

    A parity record lists its group; the group's bodies are joined to it and rebuilt where one or two lack.
    """
    named = rows.withColumnRenamed("path", "stream").withColumnRenamed("plain", "body")
    first = records.first_copies(named.where("typ <> ''")).withColumnRenamed("stream", "path").withColumnRenamed("body", "plain")
    whole = first.where("typ = 'D' and plain is not null").select("path", "seq", "t_us", "flags", "plain")
    groups = first.where("typ = 'P' and plain is not null").select("path", F.col("seq").alias("p_seq"), F.col("plain").alias("par"))

    def entries(batches):
        for b in batches:
            got = [(p, s, i, *e) for p, s, par in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True) for i, e in enumerate(_entries(par))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in got], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.int64()))], ["path", "p_seq", "place", "seq"])

    listed = groups.mapInArrow(entries, "path string, p_seq long, place int, seq long")
    lacking = listed.join(whole.select("path", "seq"), ["path", "seq"], "left_anti").select("path", "p_seq").distinct()
    bodies = listed.join(lacking, ["path", "p_seq"], "left_semi").join(whole.select("path", "seq", "plain"), ["path", "seq"], "left")
    bodies = bodies.groupBy("path", "p_seq").agg(F.array_sort(F.collect_list(F.struct("place", "plain"))).alias("have"))

    def mend(batches):
        for b in batches:
            got = []
            for path, par, have in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                listed_here = _entries(par)
                wide = max((e[3] for e in listed_here), default=0)
                lines = par[2 + len(listed_here) * ENTRY_SIZE :]
                known = [h["plain"] for h in have]
                if not wide or len(lines) < wide or not (full := gf256.rebuild(known, lines[:wide], lines[wide : 2 * wide] or None)):
                    continue
                for (seq, t_us, flags, size, crc), old, new in zip(listed_here, known, full, strict=True):
                    if old is None and zlib.crc32(new[:size]) == crc:
                        got.append((path, seq, t_us, flags, new[:size]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in got], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["path", "seq", "t_us", "flags", "plain"])

    rebuilt = groups.join(bodies, ["path", "p_seq"]).select("path", "par", "have").mapInArrow(mend, "path string, seq long, t_us long, flags int, plain binary")
    return whole.withColumn("rebuilt", F.lit(False)).unionByName(rebuilt.withColumn("rebuilt", F.lit(True)))


def parity_entries(rows: DataFrame) -> DataFrame:
    """(path, seq, plain_len) that the good parity records list."""

    def run(batches):
        for b in batches:
            got = [(p, e[0], e[3]) for p, par in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for e in _entries(par)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in got], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "seq", "plain_len"])

    return rows.where("typ = 'P' and plain is not null").select("path", "plain").mapInArrow(run, "path string, seq long, plain_len long").distinct()


def _entries(par: bytes) -> list[tuple]:
    n = int.from_bytes(par[:2], "little")
    return list(ENTRY.iter_unpack(par[2 : 2 + n * ENTRY.size])) if len(par) >= 2 + n * ENTRY.size else []


def inflated(plain: bytes, flags: int) -> bytes | None:
    """The chunk of a data record; None where it isn't a whole deflate stream or is too long."""
    if not flags & DEFLATED:
        return plain
    try:
        z = zlib.decompressobj()
        out = z.decompress(plain, LONGEST_INFLATED)
    except zlib.error:
        return None
    return out if z.eof else None


def survives(texts: DataFrame, hit: int = 12) -> DataFrame:
    """(id, records, sha): each text (id, text) as a capture whose every header loses its first copy and every body
    its first `hit` bytes, read back. sha is of the payload as mended."""

    def damaged(batch):
        keys = batch.column(0).to_pylist()
        raws = [(text or "").encode() for text in batch.column(1).to_pylist()]
        many = (([(i, raw[i : i + CHUNK]) for i in range(0, len(raw), CHUNK)], f"{key}") for key, raw in zip(keys, raws, strict=True))
        for key, whole in zip(keys, captured(many), strict=True):
            bad = np.frombuffer(whole, np.uint8).copy()
            for start, _, size in placed(whole):
                bad[start : start + COPY] ^= 0x55
                bad[start + 2 * COPY : start + 2 * COPY + min(hit, rs.body_length(size))] ^= 0x33
            yield key, bad.tobytes()

    def run(batches):
        for b in batches:
            rows = []
            for some in side_by_side(damaged(b)):
                many, sha = [0] * len(some), [hashlib.sha256() for _ in some]
                for i, r in every_of([(data, ()) for _, data in some]):
                    if r[1] == "D":
                        many[i] += 1
                        sha[i].update(r[7] or b"")
                rows += [(key, n, h.hexdigest()) for (key, _), n, h in zip(some, many, sha, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["id", "records", "sha"])

    return texts.select("id", "text").mapInArrow(run, "id long, records long, sha string")
