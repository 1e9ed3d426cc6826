"""What is shown, and small edits."""

from pyspark.sql import functions as F

from lodestrata.operators import actions, screen


def test_entries_and_folders(spark):
    rows = [("u1", "T", "failed", "720p mp4", 2, "no " * 40, "/a/b.mp4", ""), ("u2", "", "queued", "", 0, "", "", "5%")]
    df = spark.createDataFrame(rows, "url string, title string, status string, quality string, attempts int, error string, file string, progress string")
    c = F.col
    got = df.select(screen.detail(c("status"), c("quality"), c("progress"), c("file"), c("error")).alias("d"), screen.inspected_entry().alias("i"), screen.entry_line(c("status"), c("title"), c("url")).alias("l")).collect()
    assert got[0].d == "failed · 720p mp4 · b.mp4 · " + ("no " * 40)[:60] and got[1].d == "queued · 5%" and got[1].l == "queued      u2"
    assert got[0].i == ["T", "", "status       failed", "quality      720p mp4", "file         /a/b.mp4", "attempts     2", "url          u1", "", "error        " + "no " * 40]
    assert got[1].i == ["u2", "", "status       queued", "url          u2"]
    files = spark.createDataFrame([("b", True), (".x", False), ("B", False), ("é", False), ("a", False)], "name string, is_dir boolean")
    assert [r.name for r in screen.listed(files).orderBy("place").collect()] == ["B", "a", "b", "é"]
    one = spark.range(1)
    assert one.select(screen.inspected_folder(F.lit("d"), F.lit(1))).first()[0] == ["d", "", "folder, 1 item"]
    assert one.select(screen.inspected_capture(F.lit("c"), F.lit("x\ny"), F.lit(0))).first()[0] == ["c", "", "x", "y", "", "verify: everything checked out"]
    long = "\n".join(map(str, range(30)))
    assert len(one.select(screen.inspected_file(F.lit("t.txt"), F.lit(1234), F.lit(long), F.lit(None), F.lit(None).cast("string"))).first()[0]) == 24
    assert one.select(screen.inspected_file(F.lit("v.mp4"), F.lit(1234), F.lit(None).cast("string"), F.lit("v.txt"), F.lit("n"))).first()[0] == ["v.mp4", "", "1,234 bytes", "", "notes: v.txt", "n"]


def test_small_edits(spark):
    codes = spark.createDataFrame([(0, None), (3, None), (None, None), (None, "gone")], "c int, w string")
    assert [r[0] for r in codes.select(screen.outcome(F.col("c"), F.col("w"))).collect()] == ["ok", "exit 3", "killed by a signal", "could not run: gone"]
    said = screen.stamped(spark.createDataFrame([(0.0, 7, "a\nb\x1b")], "at double, pid int, said string"))
    assert [r.line for r in said.collect()] == ["1970-01-01 00:00:00 [7] a", "1970-01-01 00:00:00 [7] b^["]
    env = spark.createDataFrame([("$HOME/${HOME}s/$HOMER/$NO",)], "x string").select(screen.expanded(F.col("x"), {"HOME": "/h$1"}).alias("x"))
    assert env.first().x == "/h$1//h$1s/$HOMER/$NO"
    names = spark.createDataFrame([("/a/c.mp4",), ("/a/d.txt",), ("/a/e",)], "path string")
    there = spark.createDataFrame([("/a/c.mp4",), ("/a/c-1.mp4",), ("/a/e",)], "path string")
    assert {r.path: r.free for r in screen.free_names(names, there, 5).collect()} == {"/a/c.mp4": "/a/c-2.mp4", "/a/d.txt": "/a/d.txt", "/a/e": "/a/e-1"}
    notes = screen.sign_ins(spark.createDataFrame([("u\t5.5\tw",), ("u",), ("v\t6",)], "value string"))
    assert sorted(map(tuple, notes.collect())) == [("u", 5.5, "w"), ("v", 6.0, "")]
    lists = spark.createDataFrame([('[{"class":"Brave-browser","address":"0x1"},{"class":"term","address":"0x2"}]', '[{"index":4,"properties":{"application.name":"Brave"}},{"index":5,"corked":true,"properties":{"application.process.binary":"/usr/bin/brave"}},{"index":6}]')], "w string, s string")
    row = lists.select(screen.browser_windows(F.col("w")).alias("w"), screen.browser_streams(F.col("s")).alias("s")).first()
    assert row.w == ["0x1"] and [tuple(x) for x in row.s] == [(4, False), (5, True)]
    q = spark.createDataFrame([("u1", "a", 1), ("u2", "b", 2)], "url string, status string, attempts int")
    new = screen.updated(q, spark.createDataFrame([("u1", "done"), ("zz", "x")], "url string, status string"))
    assert sorted(map(tuple, new.collect())) == [("u1", "done", 1), ("u2", "b", 2)]
    rows = spark.createDataFrame([(5, 2, 4), (0, 9, 4), (3, 4, 4)], "t int, s int, r int")
    assert [r[0] for r in rows.select(screen.scrolled(F.col("t"), F.col("s"), F.col("r"))).collect()] == [2, 6, 3]


def test_shelf_and_actions(spark):
    one = spark.range(1)
    assert one.select(actions.shelf_line(F.array(F.lit("a"), F.lit("b")))).first()[0] == "Shelf: [a] [b]"
    sel = spark.createDataFrame([("/v/x.sstr", "file", "text/plain", 0, None), ("/v", "folder", None, 3, None), (None, "queued", None, 0, "u v")], "path string, kind string, content_type string, captures int, url string")
    found = [r.a for r in sel.select(actions.actions().alias("a")).collect()]
    assert [[x.key for x in a] for a in found] == [list("pPsvxta"), ["X"], ["r", "f"]] and found[2][0].line == "ytq retry 'u v'" and found[1][0].name == "Export all 3"
    assert sel.where("kind = 'folder'").select(actions.line_for(actions.actions(), F.lit(False))).first()[0] == "Services:  X Export all 3"
    copies = spark.createDataFrame([("a", 0, "x", "x"), ("b", 0, "x", "y"), ("c", 1, "x", "x")], "path string, verdict int, payload_sha256 string, file_sha256 string")
    assert [r.kept for r in actions.proved(copies).orderBy("path").collect()] == [True, False, False]
    caps = spark.createDataFrame([("/a/x.sstr",), ("/a/y.sstr",)], "path string")
    texts = spark.createDataFrame([("/a/x.txt",), ("/a/y.md",)], "path string")
    assert sorted((r.path, r.text) for r in actions.with_sidecar(caps, texts).collect()) == [("/a/x.sstr", "/a/x.txt"), ("/a/y.sstr", None)]
