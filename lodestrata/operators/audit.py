"""The audit of captures: what arrived, was mended, was lost, and whether the checkpoints agree.

Everything is counted by joins and aggregates over the rows of captures.scanned() with ends; only the payload's own digest
is made in order, by one task a capture, which holds one record. Copies of a record are told apart by their
offset: one after a good copy is a repeat.

Signatures are made and checked by an outside tool; without a checker every one is counted as not checkable.
Defined results: a file without records has counts of 0, no end record and the verdict 1.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.sources import captures

COUNTERS = ["records", "data", "parity", "checkpoints", "duplicates", "bytes", "header_fixed", "body_fixed", "bodies_repaired", "recovered", "data_lost", "unknown_lost", "parity_lost", "resyncs", "skipped", "ck_ok", "ck_bad", "ck_lost", "chain_gaps", "verified", "mismatched", "missing", "sig_good", "sig_bad", "sig_unverifiable"]


def _marked(rows: DataFrame) -> DataFrame:
    """rows with `good` and `repeat`."""
    before = Window.partitionBy("path", "seq").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    good = F.col("plain").isNotNull()
    return rows.withColumn("good", good).withColumn("repeat", (F.col("typ") != "") & F.coalesce(F.max(good).over(before), F.lit(False)))


def payload(data: DataFrame) -> DataFrame:
    """(path, bytes, sha256, broken): the payload of each capture's data records in order; broken: records that don't inflate."""
    src = data.select("path", "seq", "flags", "plain").repartition("path").sortWithinPartitions("path", "seq")
    kind = "path string, bytes long, sha256 string, broken long"

    def run(batches):
        path, seen, n, broken, digest = None, False, 0, 0, hashlib.sha256()

        def row():
            return pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([n], pa.int64()), pa.array([digest.hexdigest()]), pa.array([broken], pa.int64())], ["path", "bytes", "sha256", "broken"])

        for b in batches:
            for p, flags, plain in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if seen and p != path:
                    yield row()
                    n, broken, digest = 0, 0, hashlib.sha256()
                path, seen = p, True
                out = captures.inflated(plain, flags)
                if out is None:
                    broken += 1
                else:
                    n += len(out)
                    digest.update(out)
        if seen:
            yield row()

    return src.mapInArrow(run, kind)


def checkpoints(rows: DataFrame, check: Callable[[str, bytes, str], bool] | None = None) -> DataFrame:
    """(path, offset, prev, digest, right, entries, sig) of each first good checkpoint record that is JSON; sig: good, bad, unknown, or null without one."""

    def run(batches):
        for b in batches:
            out = []
            for path, offset, plain in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    c = json.loads(plain)
                except ValueError:
                    continue
                if not isinstance(c, dict):
                    continue
                prev = _bytes(c.get("prev")) or b""
                listed = [(e[0], h) for e in c.get("entries") or [] if isinstance(e, list) and len(e) > 1 and isinstance(e[0], int) and (h := _bytes(e[1])) and len(h) == 32]
                digest = captures.checkpoint_digest(prev, listed)
                stream, sig = c.get("stream") or {}, c.get("sig")
                known = check is not None and stream.get("key")
                said = None if not sig else "unknown" if not known else "good" if check(stream["key"], captures.signed_message(_bytes(stream.get("stream_id")) or b"", digest), sig) else "bad"
                out.append((path, offset, prev, digest, c.get("digest") == digest.hex(), [{"seq": s, "hash": h} for s, h in listed], said))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 7, _CHECK, strict=True)], ["path", "offset", "prev", "digest", "right", "entries", "sig"])

    return rows.where("typ = 'C' and good and not repeat").select("path", "offset", "plain").mapInArrow(run, "path string, offset long, prev binary, digest binary, right boolean, entries array<struct<seq:long,hash:binary>>, sig string")


_CHECK = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.bool_(), pa.list_(pa.struct([("seq", pa.int64()), ("hash", pa.binary())])), pa.string()]


def _bytes(x) -> bytes | None:
    try:
        return bytes.fromhex(x) if isinstance(x, str) else None
    except ValueError:
        return None


def _hashes(rows: DataFrame) -> DataFrame:
    """(path, seq, hash) of records (path, typ, flags, seq, t_us, plain)."""

    def run(batches):
        for b in batches:
            path, typ, flags, seq, t_us, plain = (b.column(i).to_pylist() for i in range(6))
            own = [captures.record_hash(*r) for r in zip(typ, flags, seq, t_us, plain, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(own, pa.binary())], ["path", "seq", "hash"])

    return rows.select("path", "typ", "flags", "seq", "t_us", "plain").mapInArrow(run, "path string, seq long, hash binary")


def audit(rows: DataFrame, check: Callable[[str, bytes, str], bool] | None = None, held: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """A row for each capture: COUNTERS, truncated, max_seq, last_signed, meta, end, payload_sha256, verdict. rows: of captures.scanned(ends=True). held: makes what is read more than once only once (the marked rows, and the data records as mended)."""
    rows = held(_marked(rows))
    live, at_all = ~F.col("repeat") & (F.col("typ") != ""), F.col("typ") != ""
    kind = lambda t: F.col("typ") == t
    n = lambda c, name: F.count_if(c).alias(name)
    counts = rows.groupBy("path").agg(
        n(live & (kind("D") | F.col("good")), "records"), n(live & kind("D"), "data"), n(live & kind("P") & F.col("good"), "parity"), n(F.col("repeat"), "duplicates"),
        F.sum("hdr_fixed").alias("header_fixed"), F.sum("body_fixed").alias("body_fixed"), n(F.col("body_fixed") > 0, "bodies_repaired"), n(live & kind("P") & ~F.col("good"), "parity_lost"),
        n("resync", "resyncs"), F.sum("skipped").alias("skipped"), n(live & kind("C") & ~F.col("good"), "ck_lost"), F.max("truncated").alias("truncated"),
        F.min_by("plain", F.when(kind("H") & F.col("good"), F.col("offset"))).cast("string").alias("meta"), F.min_by("plain", F.when(kind("E") & F.col("good"), F.col("offset"))).cast("string").alias("end"),
        F.max(F.when(live & (kind("D") | F.col("good")), F.col("seq"))).alias("top"),
    )
    data = held(captures.data_records(rows.drop("good", "repeat")))
    listed = captures.parity_entries(rows.where("not repeat"))
    known = rows.where("typ = 'D' or good").where(at_all).select("path", "seq", (F.col("typ") != "D").alias("other")).unionByName(listed.select("path", "seq", F.lit(False).alias("other"))).groupBy("path", "seq").agg(F.max("other").alias("other"))
    state = known.join(data.select("path", "seq", "rebuilt"), ["path", "seq"], "left")
    here = F.col("rebuilt").isNotNull() | F.col("other")
    tops = rows.where(live & (kind("D") | F.col("good"))).select("path", "seq").unionByName(data.where("rebuilt").select("path", "seq")).groupBy("path").agg(F.max("seq").alias("max_seq"))
    lost = state.join(tops, "path").where("seq <= max_seq").groupBy("path").agg(F.count_if("rebuilt").alias("recovered"), F.count_if(~here).alias("data_lost"), (F.max("max_seq") + 1 - F.count(F.lit(1))).alias("unknown_lost"), F.max("max_seq").alias("max_seq"))
    heads = rows.where("typ in ('H', 'E') and good and not repeat").select("path", "typ", "flags", "seq", "t_us", "plain")
    hashes = _hashes(heads.unionByName(data.withColumn("typ", F.lit("D")).select(*heads.columns)))
    cks = checkpoints(rows, check)
    entries = cks.where("right").select("path", "offset", F.explode("entries").alias("e")).select("path", "offset", "e.seq", "e.hash")
    met = entries.join(hashes.withColumnRenamed("hash", "own"), ["path", "seq"], "left")
    told = met.groupBy("path", "offset").agg(F.count_if(F.col("own") == F.col("hash")).alias("verified"), F.count_if(F.col("own") != F.col("hash")).alias("mismatched"), F.count_if(F.col("own").isNull()).alias("missing"), F.max("seq").alias("through"))
    start = counts.select("path", F.unhex(F.sha2(F.concat(F.lit(captures.GENESIS), T.unhex(F.get_json_object("meta", "$.stream_id"))), 256)).alias("genesis"))
    followed = cks.where("right").withColumn("before", F.lag("digest").over(Window.partitionBy("path").orderBy("offset"))).join(start, "path", "left")
    gap = F.coalesce(F.coalesce("before", "genesis") != F.col("prev"), F.lit(False))
    right = followed.select("path", "offset", "sig", gap.alias("gap")).join(told, ["path", "offset"], "left").groupBy("path").agg(
        F.count_if(F.coalesce("mismatched", F.lit(0)) == 0).alias("ck_ok"), F.count_if(F.col("mismatched") > 0).alias("ck_mixed"), F.count_if("gap").alias("chain_gaps"), *[F.sum(c).alias(c) for c in ("verified", "mismatched", "missing")],
        F.count_if(F.col("sig") == "good").alias("sig_good"), F.count_if(F.col("sig") == "bad").alias("sig_bad"), F.count_if(F.col("sig") == "unknown").alias("sig_unverifiable"), F.max(F.when(F.col("sig") == "good", F.col("through"))).alias("last_signed"),
    )
    wrong = cks.groupBy("path").agg(F.count(F.lit(1)).alias("checkpoints"), F.count_if(~F.col("right")).alias("ck_wrong"))
    out = counts.join(lost, "path", "left").join(payload(data), "path", "left").join(wrong, "path", "left").join(right, "path", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    col = {c: zero(F.col(c)) for c in COUNTERS if c not in ("ck_bad", "data_lost")}
    col["ck_bad"] = zero(F.col("ck_wrong")) + zero(F.col("ck_mixed"))
    col["data_lost"] = zero(F.col("data_lost")) + zero(F.col("broken"))
    sha = F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest()))
    full = out.select("path", *[col[c].alias(c) for c in COUNTERS], F.coalesce("truncated", F.lit(False)).alias("truncated"), F.coalesce("max_seq", F.lit(-1)).alias("max_seq"), F.coalesce("last_signed", F.lit(-1)).alias("last_signed"), "meta", "end", sha.alias("payload_sha256"))
    return full.withColumn("verdict", verdict())


def verdict() -> Column:
    """0 if everything checks out, else 1, from audit()'s columns."""
    ends = F.get_json_object("end", "$.sha256") == F.col("payload_sha256")
    bad = (F.col("data_lost") > 0) | (F.col("mismatched") > 0) | (F.col("ck_bad") > 0) | (F.col("sig_bad") > 0) | F.col("truncated") | F.col("end").isNull() | ~F.coalesce(ends, F.lit(False))
    return F.when(bad, 1).otherwise(0)


def report() -> Column:
    """The lines that tell a person, from audit()'s columns."""
    s = lambda c: F.col(c).cast("string")
    meta = lambda k: T.printable(F.get_json_object("meta", f"$.{k}"))

    def line(name: str, *parts) -> Column:
        return F.concat(F.lit(f"{name:<12} "), *[F.lit(p) if isinstance(p, str) else p for p in parts])

    ends = (F.get_json_object("end", "$.sha256") == F.col("payload_sha256")) & (F.get_json_object("end", "$.bytes").cast("long") == F.col("bytes"))
    matched = F.when(ends, F.lit("matches the end record")).otherwise(F.lit("DOES NOT match the end record"))
    payload_line = F.when(F.col("end").isNotNull(), line("payload", s("bytes"), " bytes, sha256 ", F.substring("payload_sha256", 1, 16), " (", matched, ")")).otherwise(line("payload", s("bytes"), " bytes; no end record", F.when(F.col("truncated"), F.lit(", file truncated")).otherwise(F.lit(""))))
    cut_short = F.when(F.get_json_object("end", "$.interrupted") == "true", F.lit(", writer was interrupted")).otherwise(F.lit(""))
    or_unknown = lambda k: F.coalesce(meta(k), F.lit("?"))
    optional = [F.when(meta(k) != "", line(k, meta(k))) for k in ("source", "license", "note")]
    key = F.when(F.get_json_object("meta", "$.key") != "", line("key", F.substring(meta("key"), 1, 40), "; no good signature seen")).otherwise(line("key", "none: checkpoints detect damage, not tampering"))
    return F.concat_ws(
        "\n",
        line("stream", or_unknown("stream_id"), "  ", or_unknown("content_type"), "  created ", or_unknown("created")),
        *optional,
        key,
        line("records", s("records"), " (", s("data"), " data, ", s("parity"), " parity, ", s("checkpoints"), " checkpoints), ", s("duplicates"), " repeats skipped"),
        payload_line,
        line("repaired", s("header_fixed"), " header bytes, ", s("body_fixed"), " body bytes in ", s("bodies_repaired"), " records, ", s("recovered"), " records rebuilt from parity"),
        line("lost", s("data_lost"), " data records, ", s("unknown_lost"), " records of unknown type, ", s("parity_lost"), " parity; ", s("skipped"), " bytes skipped in ", s("resyncs"), " resyncs"),
        line("checkpoints", s("ck_ok"), " good, ", s("ck_bad"), " bad, ", s("chain_gaps"), " chain gaps; entries ", s("verified"), " verified, ", s("mismatched"), " mismatched, ", s("missing"), " unaccounted"),
        line("signatures", s("sig_good"), " good, ", s("sig_bad"), " bad, ", s("sig_unverifiable"), " not checkable (no key seen yet); signed through record ", s("last_signed"), " of ", s("max_seq")),
        F.when(F.col("end").isNotNull(), line("end", "present", cut_short)).otherwise(line("end", "missing: the capture stopped without closing")),
    )
