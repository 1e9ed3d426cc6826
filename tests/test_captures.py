import random

from lodestrata.functions import reed_solomon as rs
from lodestrata.sources import captures


def _chunks(n=40):
    draw = random.Random(n)
    return [(i * 10, draw.randbytes(draw.randrange(1, 900))) for i in range(n)]


def _back(spark, files):
    rows = captures.scanned(spark.createDataFrame(files, "path string, content binary"))
    got = captures.data_records(rows).collect()
    return [captures.inflated(r.plain, r.flags) for r in sorted(got, key=lambda r: (r.path, r.seq))]


def _starts(data, kind="D"):
    return [r[0] for r in captures.scan(data) if r[1] == kind]


def test_files_round_trip(spark, tmp_path):
    chunks = _chunks()
    (tmp_path / "a.SSTR").write_bytes(captures.capture(chunks, "00"))
    (tmp_path / "b.txt").write_bytes(b"other")
    rows = captures.read(spark, str(tmp_path))
    assert rows.groupBy("typ").count().collect() and rows.where("resync or plain is null").count() == 0
    assert sorted(r.plain for r in captures.data_records(rows).collect()) == sorted(c for _, c in chunks)


def test_two_lost_records_of_a_group_come_back(spark):
    chunks = [(i, b"x%d " % i * 50) for i in range(20)]
    data = bytearray(captures.capture(chunks, "00", deflate=True))
    for at in _starts(bytes(data))[3:5]:
        data[at : at + 136] = bytes(136)
    assert _back(spark, [("a", bytes(data))]) == [c for _, c in chunks]


def test_three_lost_or_one_row_is_reported(spark):
    chunks = _chunks(16)
    for rows, n in ((2, 3), (1, 2)):
        data = bytearray(captures.capture(chunks, "00", rows=rows))
        for at in _starts(bytes(data))[3 : 3 + n]:
            data[at : at + 136] = bytes(136)
        assert _back(spark, [("a", bytes(data))]) == [c for _, c in chunks[:3] + chunks[3 + n :]]


def test_odd_files(spark):
    whole = captures.capture(_chunks(3), "00")
    cut = captures.capture(_chunks(3), "00")[:900]
    assert _back(spark, [("a", b""), ("b", b"junk" * 99), ("c", None)]) == []
    assert _back(spark, [("a", b"lead" + whole), ("b", cut)])[:3] == [c for _, c in _chunks(3)]
    assert captures.capture([], "00").startswith(captures.MAGIC) and _back(spark, [("a", captures.capture([], "00"))]) == []


def test_many_damaged_captures_are_mended_side_by_side(monkeypatch):
    whole = [captures.capture([(i, c[: 40 + k]) for i, c in _chunks(1 + k % 3)], "00") for k in range(60)]
    files = []
    for w in whole:
        bad = bytearray(w)
        for at, _, size in captures.placed(w):
            for a, n in ((at, captures.COPY), (at + 2 * captures.COPY, min(12, rs.body_length(size)))):
                bad[a : a + n] = bytes(x ^ 0x55 for x in bad[a : a + n])
        files.append((bytes(bad), ()))
    calls, correct = [], rs.correct_all
    monkeypatch.setattr(rs, "correct_all", lambda *a: calls.append(len(a[0])) or correct(*a))
    found = [[] for _ in files]
    for i, r in captures.every_of(files):
        found[i].append(r)
    # at most a call for each record of one capture and one for all bodies, not for each capture
    assert sum(calls) > 600 and len(calls) <= 1 + max(map(len, found))
    assert [[(r[0], r[1], r[7]) for r in f] for f in found] == [[(r[0], r[1], r[7]) for r in captures.every(w)] for w in whole]
    assert found[7] == list(captures.every(*files[7]))


def test_many_captures_are_coded_side_by_side(monkeypatch):
    many = [([(i, c) for i, c in _chunks(k % 5)], "00") for k in range(80)]
    alone = [captures.capture(chunks, name, checkpoint=3) for chunks, name in many]
    calls, parity = [], rs.parity
    monkeypatch.setattr(rs, "parity", lambda data: calls.append(len(data)) or parity(data))
    assert list(captures.captured(many, checkpoint=3)) == alone
    # headers once and bodies once, not for each record
    assert len(calls) == 2 and sum(calls) > 800
