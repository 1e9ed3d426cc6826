"""Functions against known vectors."""

import textwrap

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import links, text, wrapping

ID = "SWHZolxKdVU"
WATCH = "https://www.youtube.com/watch?v="


def _each(spark, values, f):
    """f of every value, by value."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("r")).collect()
    return [r.r for r in sorted(rows, key=lambda r: r.i)]


def test_excerpt_of_links(spark):
    page = """<DT><A HREF="https://www.youtube.com/watch?v=sK99WuaU_k8" ICON="data:image/png;base64,iVBORw0KGgo=">x</A>
<DT><A HREF="https://www.youtube.com/shorts/3mxgcs10PoI">s</A>
<DT><A HREF="https://www.youtube.com/watch?v=EmFV-A5E5hk&list=RDu64NgDuis6g&index=2">mix</A>
<DT><A HREF="https://www.youtube.com/watch?v=6xlmaorRY0w">a</A>
<DT><A HREF="https://www.youtube.com/watch?v=6xlmaorRY0w&t=5330s">a again</A>
<DT><A HREF="https://www.youtube.com/watch?t=807&v=s6rGdKY2xWo&feature=youtu.be">t first</A>
<DT><A HREF="https://www.youtube.com/watch?feature=share&amp;v=_m_jwz5hzzw">escaped</A>
<DT><A HREF="https://youtu.be/-yKLnpqfwSQ?si=abc">be</A>
<DT><A HREF="https://www.youtube.com/watch?v=WXpWwY4kDgI&list=RDp29-4ymTv94&index=10">mix2</A>
<DT><A HREF="https://www.youtube.com/@bernadettebanner">channel</A>
<DT><A HREF="https://www.youtube.com/channel/UCCND6a0H56zHL4YuY226ZOQ">channel id</A>
<DT><A HREF="https://www.youtube.com/watch?v=tooShort">short</A>
<DT><A HREF="https://www.youtube.com/watch?v=0eFTrOpueYEX">long</A>"""
    (got,) = _each(spark, [page], links.video_urls)
    assert [u[len(WATCH) :] for u in got] == ["sK99WuaU_k8", "3mxgcs10PoI", "EmFV-A5E5hk", "6xlmaorRY0w", "s6rGdKY2xWo", "_m_jwz5hzzw", "-yKLnpqfwSQ", "WXpWwY4kDgI"]


def test_scheme_may_lack(spark):
    yes = ["youtube.com/shorts/", "www.youtube.com/shorts/", "m.youtube.com/shorts/", "youtu.be/", "youtube.com/watch?feature=share&v=", "see youtube.com/shorts/", "(youtube.com/shorts/", 'HREF="youtube.com/shorts/', "https://www.youtube.com/shorts/", "http://youtube.com/shorts/", "music.youtube.com/watch?v="]
    assert _each(spark, [x + ID + " )" for x in yes], links.first_id) == [ID] * 11
    no = ["notyoutube.com/shorts/SWHZolxKdVU", "foo.youtube.com/shorts/SWHZolxKdVU", "evil.com/youtube.com/shorts/SWHZolxKdVU", "youtube.com.evil.com/shorts/SWHZolxKdVU", "xyoutu.be/SWHZolxKdVU", "user@youtube.com/shorts/SWHZolxKdVU", "youtube.com/shorts/SWHZolxKdVUX", "youtube.com/shorts/SWHZolx", "youtube.com/@channel", "youtube.com/playlist?list=PL0123456789", "éyoutu.be/SWHZolxKdVU"]
    assert _each(spark, no, links.first_id) == [None] * 11 and _each(spark, no[:1], links.short) == no[:1]
    order = ["youtube.com/watch?v=AAAAAAAAAAA&v=BBBBBBBBBBB", "youtube.com/watch?v=short&v=CCCCCCCCCCC"]
    assert _each(spark, order, links.first_id) == ["B" * 11, "C" * 11]


def test_addresses(spark):
    archive = f"https://web.archive.org/web/2024/{WATCH}{ID}"
    cases = {f"youtube.com/shorts/{ID}": WATCH + ID, f"  \nyoutu.be/{ID} \n": WATCH + ID, f"m.youtube.com/watch?v={ID}&t=5s": WATCH + ID, f"{WATCH}{ID}&list=RDabc&index=2": WATCH + ID, archive: archive, "https://vimeo.com/12345": "https://vimeo.com/12345", "https://www.youtube.com/@channel": "https://www.youtube.com/@channel"}
    none = [f"notyoutube.com/shorts/{ID}", f"example.com/shorts/{ID}", f"youtube.com/shorts/{ID} and more words", "youtube.com/@channel", "plain words", "", "https://a.b/\x1b[2J"]
    assert _each(spark, [*cases, *none], links.as_url) == [*cases.values(), *[None] * len(none)]
    assert _each(spark, ["http://localhost:8080/x", "https://a.b:443", "https://nodot", "https://a..b", "HTTPS://a.b", "https://a.b:/", "https://a.b/\n"], links.is_url) == [True, True, False, False, False, False, True]
    talk = ["https://www.reddit.com/r/interesting/comments/1x6nbkn/michael/", "https://old.reddit.com/r/aww/comments/abc123/", "https://reddit.com/comments/abc123", "https://www.youtube.com/watch?v=jNQXAC9IVRw"]
    assert _each(spark, [*talk, "https://www.reddit.com/r/interesting/", "https://notreddit.com/r/x/comments/abc/", "https://vimeo.com/12345"], links.talks) == [True] * 4 + [False] * 3
    assert _each(spark, ["https://x/?a=1&list=PL_1&b#list=no", "https://x/?xlist=2", "https://x/#a"], lambda c: links.param(c, "list")) == ["PL_1", None, None]


def test_references(spark):
    cases = {"a&amp;b &lt;&gt; &#61; &#x3D; &ampx &bogus; &#128;": "a&b <> = = &x &bogus; €", "&#0;&#xD800;&#1114112;": "���", "&#1;&#129;&#xFDD0;&#x1FFFE;x": "x", "&nbsp;&copy&notit; &;&": "\xa0©&notit; &;&", "&apos &apos;": "&apos '", "no": "no", None: None}
    assert _each(spark, list(cases), links.html_unescape) == list(cases.values())


def test_places(spark):
    rows = _each(spark, [f"see {WATCH}{ID}&list=PLa&index=3 and {WATCH}{ID}&amp;list=PLb youtu.be/AAAAAAAAAAA?list=P!x youtu.be/BBBBBBBBBBB?list=PLc&index=x"], links.places)[0]
    assert [tuple(r) for r in rows] == [(WATCH + ID, "PLa", 3), (WATCH + "B" * 11, "PLc", None)]


def test_cleaning(spark):
    assert _each(spark, ["a\x1b]0;title\x07b\x1b[2Jc\0d\x7fe\u009bf", "a\r\nb\rc\x0bd\x0ce\x85f\u2028g\u2029h", "plain — café\ttab\nline"], text.clean) == ["a]0;titleb[2Jcdef", "a\nb\nc\nd\ne\nf\ng\nh", "plain — café\ttab\nline"]
    assert _each(spark, ["Honest title\nLicense:    Creative Commons", "one\r[CHAPTER]\rSTART=6000", "  a\n\n\tb\n c\n", "two  spaces stay"], text.cleaned_line) == ["Honest title License:    Creative Commons", "one [CHAPTER] START=6000", "a b c", "two  spaces stay"]
    assert _each(spark, ["\x1c\u2003 a b\x1f\n", "\n"], text.py_strip) == ["a b", ""]
    assert _each(spark, ["a\x00\x1b[b\x7f\x85é", "plain"], text.printable) == ["a^@^[[b^??é", "plain"]
    lines = ["", "a", "a\n", "a\r\nb\rc\x0bd\x0ce\x1cf\x1dg\x1eh\x85i\u2028j\u2029", "\n\n"]
    assert _each(spark, lines, text.split_lines) == [x.splitlines() for x in lines]
    info = '{"title":"t\\nURL: x","description":"one\\r\\ntwo\\u001b[2J","n":3,"tags":["a\\rb"],"sub\\ntitles":{"en\\n":[]}}'
    assert _each(spark, [info, "no json"], wrapping.clean_info) == ['{"title": "t URL: x", "description": "one\\ntwo[2J", "n": 3, "tags": ["a b"], "sub titles": {"en": []}}', None]


def test_words_for_shells_and_tags(spark):
    import shlex

    words = ["", "plain-1.mp4", "it's", "a b", "x=1", "caf\u00e9"]
    assert _each(spark, words, text.shell_word) == [shlex.quote(w) for w in words]
    assert _each(spark, ["", "it's", "a%b", "a,b"], text.pasted_word) == ["''", "'it'\\''s'", "'a%b'", "a,b"]
    assert _each(spark, ["a=b;c#d\\e\nf\rg\0h"], text.ff_escape) == ["a\\=b\\;c\\#d\\\\e\\\nf\\\rgh"]


def test_names(spark):
    names = ["/a/b.MP4", "/a.d/noext", ".hidden", "x.tar.webm", "..a.opus", "/x/."]
    assert _each(spark, names, text.extension) == [".mp4", "", "", ".webm", ".opus", ""]
    assert _each(spark, names, text.content_type) == ["video/mp4", text.OTHER_TYPE, text.OTHER_TYPE, "video/webm", "audio/ogg", text.OTHER_TYPE]
    kinds = ["video/mp4", "text/plain", "application/json", "audio/ogg", "other", None]
    assert _each(spark, kinds, text.extension_for) == ["mp4", "txt", "json", "opus", "bin", "bin"] and _each(spark, kinds, text.is_text) == [False, True, True, False, False, False]
    assert _each(spark, ["short", "a long name of a file.sstr", "no extension in this one", "x.averylongextension"], lambda c: text.elide(c, 12)) == ["short", "a long..sstr", "no extension", "x.averylonge"]
    assert _each(spark, ["/home/u", "/home/u/x", "/home/user"], lambda c: text.tilde(c, "/home/u")) == ["~", "~/x", "/home/user"]
    assert _each(spark, ["2026-09-15 10:11:12 [77] done: x] y", "2026-09-15 10:11:12 none", "x"], lambda c: text.log_parts(c)) == [("10:11:12", "done: x] y"), ("", "2026-09-15 10:11:12 none"), ("", "x")]
    assert _each(spark, ["Please SIGN IN", "HTTP Error 403", "fine"], text.cookie_problem) == [True, True, False] and _each(spark, ["Error 429", "Too Many Requests", "404"], text.rate_limited) == [True, True, False]


def test_wrapping(spark):
    words = ["a well-known so--called x-ray 1-2 e-mail --flag " * 5, "w" * 200 + " end", "tab\there", "   ", ""]
    assert _each(spark, words, lambda c: wrapping.wrap(c, 30)) == [textwrap.wrap(w, 30) for w in words]
    vtt = "WEBVTT\nKind: captions\n\n00:00.000 --> 00:01.000\nHello <c>there</c>\n\n00:01.000 --> 00:02.000\nHello there\nyou &amp; me&#27;\n"
    assert _each(spark, [vtt, "no head", vtt.replace("\n", "\r\n")], wrapping.caption_text) == ["Hello there you & me", "", "Hello there you & me"]
    assert _each(spark, ["a\tb"], wrapping.expand_tabs) == ["a       b"]


def test_bytes(spark):
    data = [bytes(i * 37 + 250 & 255 for i in range(n)) for n in range(50)]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "i int, d binary")
    back = {r.i: (r.e, bytes(r.b)) for r in df.select("i", text.base64url(F.col("d")).alias("e")).select("i", "e", text.unbase64url(F.col("e")).alias("b")).collect()}
    assert all(back[i][1] == d and "=" not in back[i][0] for i, d in enumerate(data))
    assert _each(spark, ["A", "a*b", "-_8"], text.unbase64url) == [None, None, bytearray(b"\xfb\xff")]
    assert _each(spark, ["0aFF", "0", "zz", ""], text.unhex) == [bytearray(b"\x0a\xff"), None, None, bytearray()]


@pytest.mark.parametrize(("share", "want"), [(0.25, "[##--------]"), (2.0, "[##########]"), (-1.0, "[----------]"), (0.35, "[####------]"), (0.05, "[----------]")])
def test_bar(spark, share, want):
    assert spark.range(1).select(text.bar(F.lit(share), 10)).first()[0] == want


def test_values(spark):
    assert _each(spark, ["NA", " none ", "Unknown B/s", "5MiB/s", None], text.na) == ["", "", "", "5MiB/s", ""]
    assert _each(spark, ["5.5", " 7 ", "x", None], text.number) == [5.5, 7.0, 0.0, 0.0]
    df = spark.createDataFrame([("1920x1080", "avc1.64", "mp4a.40", 25.0), ("audio only", "none", "opus", 0.0), (None, None, None, None)], "r string, v string, a string, f double")
    assert [r[0] for r in df.select(text.format_line(F.col("r"), F.col("v"), F.col("a"), F.col("f"))).collect()] == ["1920x1080, avc1 + mp4a, 25 fps", "opus", None]
