"""Audits of damaged captures, armor both ways, settings and queue files, documents, streaming."""

import hashlib
import json
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import audit, documents, live, media, playlists, queue
from lodestrata.sources import armor, captures, queue_file, settings
from lodestrata.streaming import follow, ordered, throttle


def _payload(n=90_000):
    return random.Random(7).randbytes(n)


def _whole(raw, rows=2, checkpoint=16, size=4096):
    return captures.capture([(i, raw[i : i + size]) for i in range(0, len(raw), size)], "00ff", rows=rows, checkpoint=checkpoint, meta={"content_type": "video/mp4"})


def _data(blob):
    return [(r[0], 2 * captures.COPY + captures.rs.body_length(r[5])) for r in captures.scan(bytes(blob)) if r[1] == "D"]


def _damaged(kind, whole, draw):
    b = bytearray(whole)
    if kind.startswith("ber"):
        for bit in draw.sample(range(len(b) * 8), int(len(b) * 8 * float(kind[3:]))):
            b[bit // 8] ^= 1 << bit % 8
    elif kind == "burst":
        b[40_000:42_000] = bytes(2000)
    elif kind.startswith("wipe"):
        for k in map(int, kind[4:].split("+")):
            at, n = _data(whole)[k]
            b[at : at + n] = draw.randbytes(n)
    elif kind == "head":
        at = [r[0] for r in captures.scan(bytes(whole)) if r[1] != "H"][0]
        b[8:at] = draw.randbytes(at - 8)
    elif kind == "truncate":
        del b[int(len(b) * 0.6) :]
    elif kind == "tamper":
        at, n = _data(whole)[3]
        r = [x for x in captures.scan(bytes(whole)) if x[1] == "D"][3]
        body = bytearray(r[7])
        body[1000] ^= 0xFF
        b[at : at + n] = captures.packed("D", r[2], r[3], r[4], bytes(body))
    return bytes(b)


KINDS = ["none", "ber1e-5", "ber1e-4", "ber1e-3", "burst", "wipe5", "wipe2+20", "wipe2+4", "wipe2+3+4", "head", "truncate", "tamper"]


def test_audit_of_every_kind_of_damage(spark):
    raw = _payload()
    draw = random.Random(7)
    rows = [(k, _damaged(k, _whole(raw), draw)) for k in KINDS] + [("v0", _damaged("wipe2+4", _whole(raw, rows=1), draw)), ("empty", b""), ("junk", b"no capture at all")]
    seen = captures.scanned(spark.createDataFrame(rows, "path string, content binary"), ends=True).cache()
    got = {r.path: r for r in audit.audit(seen).withColumn("report", audit.report()).collect()}
    sha = hashlib.sha256(raw).hexdigest()
    n = len(_data(_whole(raw)))
    for kind in ("none", "ber1e-5", "ber1e-4", "ber1e-3", "burst", "wipe5", "wipe2+20", "wipe2+4", "head"):
        r = got[kind]
        assert (r.verdict, r.payload_sha256, r.bytes, r.data_lost, r.mismatched) == (0, sha, len(raw), 0, 0), (kind, r)
        assert r.verified + r.missing == n + 2 and r.chain_gaps == 0
    assert got["none"].data == n and got["none"].duplicates and got["none"].skipped == 0
    assert got["ber1e-4"].body_fixed > 0 and got["wipe2+4"].recovered == 2 and got["wipe5"].recovered == 1 and got["wipe5"].resyncs == 1
    assert got["wipe2+3+4"].verdict == 1 and got["wipe2+3+4"].data_lost == 3
    assert got["v0"].verdict == 1 and got["v0"].data_lost == 2 and got["v0"].recovered == 0
    assert got["truncate"].verdict == 1 and got["truncate"].truncated and got["truncate"].end is None
    assert got["tamper"].verdict == 1 and got["tamper"].mismatched == 1 and got["tamper"].ck_bad == 1
    assert got["empty"].verdict == got["junk"].verdict == 1 and got["junk"].skipped == 17
    lines = got["none"].report.split("\n")
    assert len(lines) >= 9 and lines[0].startswith("stream       00ff  video/mp4") and lines[-1] == "end          present" and "(matches the end record)" in got["none"].report


def test_armor_goes_both_ways(spark):
    data = bytes(i * 13 & 255 for i in range(500))
    lines = [r.line for r in armor.armored(spark.createDataFrame([("a", data)], "stream string, data binary")).orderBy("line_no").collect()]
    assert lines[0] == armor.BEGIN and len(lines[1]) == 80 and lines[-1] == f"-----END SSTR ARMOR 1f4 {hashlib.sha256(data).hexdigest()[:40]}-----"
    noisy = [x for i, x in enumerate(lines) if i != 4]
    noisy.insert(5, "[  812.004113] usb 1-1: new high-speed USB device\r")
    noisy[8] = noisy[8][:12] + ("B" if noisy[8][12] != "B" else "C") + noisy[8][13:]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(noisy)], "stream string, line_no long, line string")
    pieces, lost, stats = armor.unarmored(df)
    ranges = sorted((r.start, r.end) for r in lost.collect())
    assert (135, 180) in ranges and len(ranges) == 2
    s = stats.first()
    assert (s.not_armor, s.crc_failed, s.total, s.lost_bytes) == (1, 1, 500, 90)
    file = armor.files(df).first()
    assert len(file.content) == 500 and [(e.start, e.end) for e in file.erasures] == ranges
    assert json.loads(armor.erasures_json(lost).first().json) == [list(r) for r in ranges]
    golden = "S000000000:iVNTVA0KGgqnU1NSSAAAAAAAAAAAAAAAUwAAAAAAAADVAQAAuuWhqNzNTFu3:a579734a"
    one = armor.parsed(spark.createDataFrame([("g", 0, golden)], "stream string, line_no long, line string")).first()
    assert one.kind == "line" and one.offset == 0 and bytes(one.bytes)[:13] == captures.MAGIC + b"\xa7SSRH"


def test_lost_armor_is_mended_by_the_codec(spark):
    raw = _payload(30_000)
    whole = _whole(raw)
    lines = armor.armored(spark.createDataFrame([("a", whole)], "stream string, data binary")).where("line_no % 33 <> 7 or line_no < 0")
    seen = captures.scanned(armor.files(lines), ends=True).cache()
    r = audit.audit(seen).first()
    assert (r.verdict, r.payload_sha256) == (0, hashlib.sha256(raw).hexdigest()) and r.body_fixed > 0


def test_erasure_masks():
    lost = captures.Lost([(5, 9), (8, 12), (20, 20), (30, 31)])
    assert lost.mask(0, 5) is None and lost.mask(12, 30) is None
    assert lost.mask(4, 13).tolist() == [False] + [True] * 7 + [False] and lost.mask(30, 40).sum() == 1


def test_settings(spark, tmp_path):
    a, b = tmp_path / "media.conf", tmp_path / "config"
    a.write_text('# a note\nOUTPUT=both\n dir = "~/Videos" \nWARM=off\nno line\nOUTPUT=mp4\n')
    b.write_text("WARM=on\n#OUTPUT=sstr\n")
    got = {r.key: (r.value, r.source) for r in settings.in_force(settings.read(spark, [str(a), str(b), str(tmp_path / "none")], "/home/u")).collect()}
    assert got["OUTPUT"] == ("mp4", "media.conf") and got["DIR"] == ("/home/u/Videos", "media.conf") and got["WARM"] == ("on", "ytq/config") and got["PLAYER"] == ("mpv", "default") and len(got) == len(settings.SETTINGS)
    lines = spark.createDataFrame(list(enumerate(["# OUTPUT=x", "OUTPUT=a", "K=1", " output = b", ""])), "line_no int, value string")
    edit = lambda k, v: [r.value for r in settings.edited(lines, k, v).orderBy("line_no").collect()]
    assert edit("output", "mp4") == ["# OUTPUT=x", "OUTPUT=mp4", "K=1", ""] and edit("OUTPUT", None) == ["# OUTPUT=x", "K=1", ""] and edit("NEW", "1")[-1] == "NEW=1"
    df = spark.createDataFrame([("OUTPUT", "SSTR"), ("OUTPUT", "both"), ("OUTPUT", "?"), ("WARM", "on"), ("WARM", "x"), ("DIR", "a")], "k string, v string")
    assert [r[0] for r in df.select(settings.next_value(F.col("k"), F.col("v"))).collect()] == ["mp4", "sstr", "sstr", "off", "on", None]


def test_queue_files(spark, tmp_path):
    path = str(tmp_path / "queue.json")
    assert queue_file.read(spark, path).count() == 0
    new = queue.new_entries(spark.createDataFrame([("u1",), ("u2",)], "url string"), F.lit(5.0)).withColumn("pos", F.substring("url", 2, 1).cast("int"))
    queue_file.write(new, path)
    back = queue_file.read(spark, path)
    assert [(r.url, r.status, r.attempts, r.cookie_tried) for r in back.orderBy("pos").collect()] == [("u1", "checking", 0, False), ("u2", "checking", 0, False)]
    queue_file.write(queue.forgotten(back, spark.createDataFrame([("u1",)], "url string")), path)
    assert [r.url for r in queue_file.read(spark, path).collect()] == ["u2"] and len(json.load(open(path))) == 1
    for bad in ('{"url": "x"}', "not json", ""):
        (tmp_path / "queue.json").write_text(bad)
        assert queue_file.read(spark, path).count() == 0
    log = tmp_path / "ytq.log"
    log.write_text("".join(f"line {i}\n" for i in range(1000)))
    assert [r.line for r in queue_file.log_seed(spark, str(log), 200, 5).orderBy("line_no").collect()] == [f"line {i}" for i in range(995, 1000)]


def test_listing_and_headers(spark, tmp_path):
    (tmp_path / "b").mkdir()
    for name in ("z.sstr", "a.SSTR", "b/c.sstr"):
        (tmp_path / name).write_bytes(_whole(b"x" * 100))
    (tmp_path / "n.txt").write_text("x")
    assert [r.name for r in captures.listing(spark, str(tmp_path)).collect()] == ["a.SSTR", "z.sstr", "c.sstr"]
    assert {json.loads(r.meta)["content_type"] for r in captures.headers(spark, str(tmp_path)).collect()} == {"video/mp4"}


def test_streams_are_recorded_in_pieces(spark):
    raw = _payload(50_000)
    chunks = spark.createDataFrame([(s, i, i, raw[i : i + 1000]) for s in ("00", "01") for i in range(0, len(raw), 1000)], "stream string, pos long, t_us long, chunk binary")
    got = captures.recorded(chunks.repartition(7)).orderBy("stream", "place").collect()
    for s in ("00", "01"):
        whole = b"".join(bytes(r.bytes) for r in got if r.stream == s)
        assert whole == captures.capture([(i, raw[i : i + 1000]) for i in range(0, len(raw), 1000)], s, checkpoint=captures.CHECKPOINT_RECORDS)


def test_notes(spark):
    meta = {"title": "A day", "uploader": "Ann", "channel": "Ann's", "uploader_id": "@ann", "webpage_url": "https://v/1", "timestamp": 0.0, "duration": 3725.0, "view_count": 1234567.0, "tags": ["x", "y"], "license": "", "chapters": [(0.0, 5.0, "Start"), (3600.0, None, "End")], "age_limit": 18.0, "live_status": "was_live", "subtitles": {"en": "e", "de": "d"}, "description": " words ", "resolution": "1x1", "vcodec": "av1.2", "fps": 25.0, "heatmap": [(0.0, 10.0, 1.0), (10.0, 20.0, 0.2), (20.0, 30.0, 0.9), (30.0, 40.0, 0.1)]}
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(documents.FIELDS)
    df = spark.createDataFrame([tuple(meta.get(f.name) for f in kind.fields)], kind)
    row = df.select(documents.notes(F.col, F.lit("u"), F.lit(86400.0), F.lit("en"), F.lit("a.mp4")).alias("n"), documents.tag_file(F.col, F.lit("c=1")).alias("t")).first()
    want = ["A day", "", "Notes", "  Title:      A day", "  Author:     Ann", "  Handle:     @ann", "  Where:      Ann's", "  URL:        https://v/1", "  Published:  1970-01-01 00:00:00 +0000", "  Downloaded: 1970-01-02 00:00:00 +0000", "  Duration:   1:02:05", "  Live:       recorded from a live stream", "  Age limit:  18+", "  License:    not stated", "  Video:      a.mp4", "  Format:     1x1, av1, 25 fps"]
    got = row.n.split("\n")
    assert got[: len(want)] == want
    assert "  Captions:   en, written by the uploader" in got and "Stats  (read 1970-01-02 00:00:00 +0000)" in got and "  Views:      1,234,567" in got and "  Replayed:   0:25  (most first)" in got
    assert got[got.index("Chapters") + 1 : got.index("Chapters") + 3] == ["     0:00  Start", "  1:00:00  End"] and got[-5:] == ["Description", "words", "", "Transcript", ""]
    assert row.t.startswith(";FFMETADATA1\ntitle=A day\nartist=Ann\n") and "START=3600000\nEND=3725000\n" in row.t and "comment=c\\=1\n" in row.t
    bare = spark.createDataFrame([(None,) * len(kind.fields)], kind).select(documents.notes_head(F.col, F.lit("u"), F.lit(0.0)).alias("n")).first().n
    assert bare.startswith("u\n\nNotes\n  Title:      u\n  Author:     unknown\n  URL:        u\n  Published:  unknown\n") and "Stats" not in bare


def test_discussion(spark):
    rows = [("v", 0, "a", "root", "@Ann", "@ann1", 0.0, True, 1200.0, "first " * 20), ("v", 1, "b", "a", "Bob", "Bob", None, False, 0.0, "reply"), ("v", 2, "c", "gone", None, None, None, None, None, "orphan"), ("v", 3, "d", "b", "Deep", None, None, None, None, "not printed")]
    df = spark.createDataFrame(rows, "video string, pos long, id string, parent string, author string, author_id string, timestamp double, is_pinned boolean, like_count double, text string")
    text = documents.discussion(df, spark.createDataFrame([("v", 99)], "video string, total long")).first().text
    assert text.startswith("Discussion  (4 of 99)\n\n  @Ann  (@ann1)  1970-01-01  * pinned  1,200 likes\n    first ") and "    |  @Bob\n    |    reply\n" in text and "  @unknown\n    orphan\n" in text and "not printed" not in text
    assert text.index("reply") < text.index("orphan")


def test_live_record(spark):
    f = {"phase": "downloading", "part": "1", "parts": "2", "formats": "299+140", "pct": "45.2%", "got_b": "386973696", "total_b": "856267161", "est_b": "NA", "speed": "12.3MiB/s", "eta": "00:31", "vcodec": "avc1.64", "acodec": "none", "format": "NA", "height": "1080", "frag": "NA", "frags": "NA"}
    df = spark.createDataFrame([f])
    row = df.select(live.describe(F.col).alias("d"), live.compact(F.col).alias("c"), live.size_of(F.col).alias("s"), live.progress_line(F.col, 10).alias("p")).first()
    assert row.d == "downloading part 1 of 2: video f299 avc1.64 1080p" and row.c == "1/2 45.2% 12.3MiB/s eta 00:31" and row.s == "369.0 MiB of 816.6 MiB"
    assert row.p == "progress [#####-----] 45.2%  369.0 MiB of 816.6 MiB  12.3MiB/s  eta 00:31"


def _brute_samples(rows, every=30.0):
    out, last = [], {}
    for u, at, done in sorted(rows):
        if done:
            out.append((u, at, done))
        elif at - last.get(u, float("-inf")) >= every:
            last[u] = at
            out.append((u, at, done))
    return sorted(out)


def _stream(spark, tmp_path, df, f, parts=3):
    """f's result over df's rows, given to a stream file by file in their order."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = df.collect()
    step = -(-len(rows) // parts)
    for i in range(0, len(rows), step):
        spark.createDataFrame(rows[i : i + step], df.schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = f(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.read.parquet(out).collect()


def test_throttle(spark, tmp_path):
    draw = random.Random(2)
    rows = [(f"u{draw.randrange(3)}", float(t), draw.random() < 0.1) for t in sorted(draw.sample(range(2000), 200))]
    df = spark.createDataFrame(rows, "url string, at double, finished boolean")
    assert sorted(map(tuple, live.sampled(df).collect())) == _brute_samples(rows)
    assert sorted(map(tuple, _stream(spark, tmp_path, df, throttle.sampled))) == _brute_samples(rows)


def test_reorder_buffer(spark, tmp_path):
    draw = random.Random(3)
    seqs = [i for i in range(300) if i not in (5, 6, 100)]
    seqs.sort(key=lambda i: i + draw.random() * 20)
    df = spark.createDataFrame([("s", i, bytes([i % 256])) for i in seqs + [4, 250]], "stream string, seq long, body binary")
    got = sorted((r.seq, r.lost) for r in _stream(spark, tmp_path, df, ordered.reordered))
    assert got == [(i, i in (5, 6, 100)) for i in range(300)]
    batch = ordered.settled(df).collect()
    assert sorted((r.seq, r.lost) for r in batch) == got
    held = {3: b"x"}
    assert ordered.given_out(held, 0, 3) == ([], 0) and ordered.given_out({3: b"x"}, 0, 3, force=True)[0] == [(0, None, True), (1, None, True), (2, None, True), (3, b"x", False)]
    assert ordered.given_out({41: b"x"}, 0, 41)[0] == [(0, None, True)]


def test_growing_file_across_rotation(tmp_path):
    path = tmp_path / "log"
    reader = follow.GrowingReader({"path": str(path)})
    at = reader.initialOffset()

    def step():
        nonlocal at
        rows, at = reader.read(at)
        return [r[1] for r in rows]

    assert step() == []
    path.write_text("one\ntwo\nhal")
    assert step() == ["one", "two"] and step() == []
    with path.open("a") as f:
        f.write("f\nlast\n")
    path.rename(tmp_path / "log.1")
    path.write_text("new\n")
    assert step() == ["half", "last"] and step() == [] and step() == ["new"]


def test_playlists(spark):
    places = spark.createDataFrame([("https://www.youtube.com/watch?v=" + "a" * 11, "L", None, False)], "url string, list string, index int, queued boolean")
    new = spark.createDataFrame([(0, places.first().url, "M", 1), (1, "u2", "L", 2), (2, "u2", "N", 3)], "pos int, url string, list string, index int")
    both = playlists.noted(places, new)
    assert sorted((r.url, r.list) for r in both.collect())[-1] == ("u2", "L") and both.count() == 2
    c = F.col
    lines = both.select(playlists.line(c("url"), c("list"), c("index"), c("queued")).alias("value"))
    assert sorted(map(tuple, playlists.from_lines(lines).collect()), key=str) == sorted(map(tuple, both.collect()), key=str)
    marks = spark.createDataFrame([(2, False, False), (2, False, True), (None, True, False)], "i int, q boolean, g boolean")
    assert [r[0] for r in marks.select(playlists.mark(c("i"), c("q"), c("g"))).collect()] == ["[playlist #2: n next, N go on]", "[playlist #2: going on]", "[playlist: next queued]"]


def test_lost_numbers(spark):
    from lodestrata.operators import records

    rows = spark.createDataFrame([(i,) for i in range(200_000) if i % 70_001] * 2, "seq long")
    assert sorted(r.seq for r in records.missing(rows).collect()) == [0, 70_001, 140_002]
    assert records.missing(rows.limit(0)).count() == 0
    runs = records.islands(spark.createDataFrame([(1,), (2,), (2,), (5,)], "seq long"))
    assert sorted(map(tuple, runs.collect())) == [(1, 2, 2), (5, 5, 1)]


@pytest.mark.parametrize("pos", [0, 3])
def test_a_first_point_may_be_a_peak(spark, pos):
    df = spark.createDataFrame([(1, pos, 5.0), (1, pos + 1, 1.0)], "series int, pos int, value double")
    assert media.peaks(df).count() == (pos > 0)


def test_audit_makes_shared_steps_once(spark):
    made = []
    files = [("a", captures.capture([(i, b"x%d" % i * 90) for i in range(20)], "00", checkpoint=8))]
    rows = captures.scanned(spark.createDataFrame(files, "path string, content binary"), ends=True)
    seen = audit.audit(rows, held=lambda df: made.append(df.columns) or df.cache())
    assert seen.collect() == audit.audit(rows).collect() and seen.first().verdict == 0
    assert len(made) == 2 and "repeat" in made[0] and "rebuilt" in made[1]


def test_armor_lines_are_read_once(spark):
    head = "S000000000:-_8"
    good = f"{head}:{zlib.crc32(head.encode()):08x}"
    short = "S000000000:A"
    odd = {good: ("line", 0, b"\xfb\xff", None), f"{good}\r\n\n": ("line", 0, b"\xfb\xff", None), good[:-1] + "x": ("other", None, None, None), f" {good}": ("other", None, None, None), f"{short}:{zlib.crc32(short.encode()):08x}": ("damaged", None, None, None), head + ":00000000": ("damaged", None, None, None)}
    odd |= {"-----END SSTR ARMOR 1F4 ab-----\n": ("end", None, None, 500), "-----END SSTR ARMOR ffffffffffffffff": ("begin", None, None, None), "-----END SSTR ARMOR": ("begin", None, None, None), "-----BEGIN SSTR ARMOR v1": ("begin", None, None, None), "\r\n": ("blank", None, None, None), "": ("blank", None, None, None), " ": ("other", None, None, None), None: ("other", None, None, None)}
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(odd)], "stream string, line_no long, line string")
    assert [(r.kind, r.offset, r.bytes, r.total) for r in armor.parsed(df).orderBy("line_no").collect()] == list(odd.values())
    stats = armor.unarmored(armor.armored(spark.createDataFrame([("a", b"x" * 500), ("e", b"")], "stream string, data binary")))[2]
    assert sorted(map(tuple, stats.collect())) == [("a", 12, 0, 0, 0, 0, 500), ("e", 0, 0, 0, 0, 0, 0)]
    plan = stats._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.count("Window [") == 1 and "Join" not in plan
