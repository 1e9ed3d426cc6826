"""Text and number functions as Column expressions.

Defined results: a null argument gives null, unless a function says otherwise. Lengths are in code points.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions and content types of files, and what a payload of a type is called.
CONTENT_TYPES = {".mp4": "video/mp4", ".m4v": "video/mp4", ".webm": "video/webm", ".mkv": "video/x-matroska", ".mov": "video/quicktime", ".m4a": "audio/mp4", ".mp3": "audio/mpeg", ".opus": "audio/ogg", ".ogg": "audio/ogg"}
OTHER_TYPE = "application/octet-stream"
EXTENSIONS = {"video/mp4": "mp4", "video/webm": "webm", "video/x-matroska": "mkv", "video/quicktime": "mov", "video/mp2t": "ts", "audio/mpeg": "mp3", "audio/mp4": "m4a", "audio/ogg": "opus", "application/json": "json"}

# Words that tell of a sign-in problem, and of a rate limit.
COOKIE_WORDS = ["sign in", "log in", "login", "cookies", "age", "bot", "private video", "members", "premium", "confirm you", "403", "restricted", "subscriber"]
RATE_WORDS = ["429", "too many requests"]

#: White space of Unicode and the four separators from U+001C on, inside a class of a (?U) pattern.
_SPACE = r"\s\x1c-\x1f"


def _any(x: list[Column]) -> Column:
    return reduce(Column.__or__, x)


def given(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once, however often f names it; the value may come from Python, where lambdas may not."""
    return F.transform(F.array(value), f)[0]


def strip_tags(x: Column) -> Column:
    """Without <...>; a lone < stays."""
    return F.regexp_replace(x, "<[^>]*>", "")


def clean(x: Column) -> Column:
    """Every kind of line end as LF; other control characters but tab go."""
    return F.regexp_replace(F.regexp_replace(x, "\r\n|[\r\x0b\x0c\x85  ]", "\n"), r"[\x00-\x08\x0e-\x1f\x7f-\x9f]", "")


def one_line(x: Column) -> Column:
    """Runs of LF and tab as one space, none next to a space or at the ends."""
    x = F.regexp_replace(F.regexp_replace(x, " [\n\t]+", " "), "[\n\t]+ ", " ")
    return F.trim(F.regexp_replace(x, "[\n\t]+", " "))


def cleaned_line(x: Column) -> Column:
    """clean, then one_line."""
    return one_line(clean(x))


def py_strip(x: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(x, rf"(?U)\A[{_SPACE}]+|[{_SPACE}]+\z", "")


def split_lines(x: Column) -> Column:
    """Lines, at the ten characters and one pair that end one; no empty line after the last end."""
    parts = F.split(x, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def printable(x: Column) -> Column:
    """Control characters as ^X, DEL as ^?, those from U+0080 to U+009F as a question mark."""
    marked = reduce(lambda c, i: F.replace(c, F.lit(chr(i)), F.lit("^" + chr(i + 64))), range(32), x)
    shown = F.regexp_replace(F.replace(marked, F.lit("\x7f"), F.lit("^?")), r"[\x80-\x9f]", "?")
    return F.when(F.regexp_like(x, F.lit(r"[\x00-\x1f\x7f-\x9f]")), shown).otherwise(x)


def shell_word(x: Column, inside: str = "'\"'\"'", bare: str = r"[A-Za-z0-9_@%+=:,./-]+") -> Column:
    """As a shell needs it written: bare characters as they are, others between single quotes."""
    return F.when(F.regexp_like(x, F.lit(rf"\A{bare}\z")), x).otherwise(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit(inside)), F.lit("'")))


def pasted_word(x: Column) -> Column:
    """The other way of quoting, for lines that are shown to be pasted."""
    return shell_word(x, r"'\''", r"[A-Za-z0-9_./:@+,=-]+")


def ff_escape(x: Column) -> Column:
    """For a tag file: a backslash before = ; # \\ LF CR, and no NUL."""
    return F.regexp_replace(F.replace(x, F.lit("\0"), F.lit("")), r"([=;#\\\n\r])", r"\\$1")


def cut(x: Column, n: int) -> Column:
    return F.substring(x, 1, max(n, 0))


def ljust(x: Column, n: int) -> Column:
    return F.concat(x, F.repeat(F.lit(" "), F.greatest(F.lit(n) - F.length(x), F.lit(0))))


def elide(x: Column, room: int) -> Column:
    """In room characters; an extension of eight at most is kept after two dots, where there is room for more."""
    ext = F.regexp_extract(x, r"(?s)\A.*\.([^.]*)\z", 1)
    e = F.length(ext)
    short = F.concat(F.substring(x, F.lit(1), F.lit(room - 2) - e), F.lit(".."), ext)
    return F.when(F.lit(room <= 0), F.lit("")).when(F.length(x) <= room, x).when(e.between(1, 8) & (e + 3 < room), short).otherwise(cut(x, room))


def tilde(x: Column, home: str) -> Column:
    """~ for the home folder and what is in it."""
    rest = F.substring(x, F.lit(len(home) + 1), F.length(x))
    inside = F.startswith(x, F.lit(home)) & ((rest == "") | F.startswith(rest, F.lit("/"))) & F.lit(bool(home))
    return F.when(inside, F.concat(F.lit("~"), rest)).otherwise(x)


def basename(x: Column) -> Column:
    return F.substring_index(x, "/", -1)


def extension(x: Column) -> Column:
    """The last dot of the file's name and what follows it, lower-cased; dots at the name's start begin none."""
    return F.lower(F.regexp_extract(basename(x), r"\A\.*[^.].*(\.[^.]*)\z|\A\.*[^.](\.[^.]*)\z", 1))


def stem(x: Column) -> Column:
    """The path without its extension."""
    return F.substring(x, F.lit(1), F.length(x) - F.length(extension(x)))


def content_type(path: Column) -> Column:
    kinds = F.create_map(*[F.lit(v) for kv in CONTENT_TYPES.items() for v in kv])
    return F.coalesce(F.try_element_at(kinds, extension(path)), F.lit(OTHER_TYPE))


def extension_for(kind: Column) -> Column:
    """What a payload of this content type is called; null counts as unknown."""
    names = F.create_map(*[F.lit(v) for kv in EXTENSIONS.items() for v in kv])
    return F.coalesce(F.try_element_at(names, kind), F.when(F.startswith(kind, F.lit("text/")), F.lit("txt")), F.lit("bin"))


def is_text(kind: Column) -> Column:
    return F.coalesce(F.startswith(kind, F.lit("text/")) | (kind == "application/json"), F.lit(False))


def cookie_problem(x: Column) -> Column:
    return _any([F.contains(F.lower(x), F.lit(w)) for w in COOKIE_WORDS])


def rate_limited(x: Column) -> Column:
    return _any([F.contains(F.lower(x), F.lit(w)) for w in RATE_WORDS])


def own_name(name: Column, id_: Column) -> Column:
    """Whether a file's name is one that the queue gives: its alphabet, no leading dot, and before the first dot the id at the end."""
    shaped = F.regexp_like(name, F.lit(r"\A[A-Za-z0-9_-][A-Za-z0-9_.-]*\z"))
    return shaped & (id_.isNull() | F.endswith(F.substring_index(name, ".", 1), id_))


def log_parts(line: Column) -> Column:
    """(time, message) of a stamped log line; a line of another shape is its message, with no time."""
    shape = r"(?s)\A[0-9]{4}-[0-9]{2}-[0-9]{2} ([0-9]{2}:[0-9]{2}:[0-9]{2}) .*?\] (.*)\z"
    stamped = F.regexp_like(line, F.lit(shape))
    time, said = (F.when(stamped, F.regexp_extract(line, shape, k)) for k in (1, 2))
    return F.struct(F.coalesce(time, F.lit("")).alias("time"), F.coalesce(said, line).alias("message"))


def fmt_size(n: Column) -> Column:
    """Bytes in steps of 1024, one decimal, halves to even, up to GiB."""
    part = lambda d, unit: F.concat(F.format_string("%.1f", F.bround(n / F.lit(float(d)), 1)), F.lit(unit))
    return F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).when(n < 1 << 20, part(1 << 10, " KiB")).when(n < 1 << 30, part(1 << 20, " MiB")).otherwise(part(1 << 30, " GiB"))


def fmt_secs(s: Column) -> Column:
    """h:mm:ss, or m:ss below an hour; negative counts as 0."""
    s = F.greatest(s.cast("long"), F.lit(0))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(r))).otherwise(F.concat(m.cast("string"), F.lit(":"), two(r)))


def commas(n: Column) -> Column:
    return F.format_number(n.cast("long"), 0)


def bar(share: Column, width: int) -> Column:
    """[###---]: the share of width, halves to even."""
    n = F.bround(F.least(F.greatest(share.cast("double"), F.lit(0.0)), F.lit(1.0)) * width).cast("int")
    return F.concat(F.lit("["), F.repeat(F.lit("#"), n), F.repeat(F.lit("-"), F.lit(width) - n), F.lit("]"))


def na(x: Column) -> Column:
    """A template's value, or the empty text where it stands for none."""
    x = F.trim(F.coalesce(x.cast("string"), F.lit("")))
    return F.when(x.isin("NA", "None", "none") | F.startswith(x, F.lit("Unknown")), F.lit("")).otherwise(x)


def number(x: Column) -> Column:
    """A text as a number, 0 where it is none."""
    return F.coalesce(F.trim(x.cast("string")).try_cast("double"), F.lit(0.0))


def number_text(x: Column) -> Column:
    """A number as it is shown: whole ones without a point."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e16)
    return F.when(whole, x.cast("long").cast("string")).otherwise(x.cast("string"))


def published(timestamp: Column, upload_date: Column) -> Column:
    """The timestamp in the session's zone, else the date yyyymmdd, else unknown."""
    day = F.regexp_replace(upload_date, r"\A([0-9]{4})([0-9]{2})([0-9]{2})\z", "$1-$2-$3")
    return F.coalesce(when(timestamp), F.when(F.regexp_like(upload_date, F.lit(r"\A[0-9]{8}\z")), day), F.lit("unknown"))


def when(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss xx")


def format_line(resolution: Column, vcodec: Column, acodec: Column, fps: Column) -> Column:
    """What was downloaded in a line, null if nothing is known."""
    told = lambda x: F.when((x != "") & (x != "none"), x)
    codecs = F.concat_ws(" + ", F.substring_index(told(vcodec), ".", 1), F.substring_index(told(acodec), ".", 1))
    rate = F.when(fps != 0, F.concat(number_text(fps), F.lit(" fps")))
    line = F.concat_ws(", ", F.when(resolution != "audio only", told(resolution)), F.when(codecs != "", codecs), rate)
    return F.when(line != "", line)


def line_bytes_per_second(baud: Column) -> Column:
    """Of a line with ten bits a byte."""
    return baud / 10


def armored_bytes_per_second(baud: Column) -> Column:
    """45 of the 81 bytes of each line are payload."""
    return line_bytes_per_second(baud) * 45 / 81


def unhex(x: Column) -> Column:
    """Bytes of hexadecimal digits; null for an odd number of them or another character."""
    return F.when(F.regexp_like(x, F.lit(r"\A(?:[0-9A-Fa-f]{2})*\z")), F.unhex(x))


def base64url(data: Column) -> Column:
    """Without padding."""
    return F.rtrim(F.regexp_replace(F.translate(F.base64(data), "+/", "-_"), "[\r\n]", ""), F.lit("="))


def unbase64url(x: Column) -> Column:
    """Null for a character outside the alphabet or a length that no bytes give."""
    right = F.regexp_like(x, F.lit(r"\A[A-Za-z0-9_-]*\z")) & (F.length(x) % 4 != 1)
    padded = F.rpad(F.translate(x, "-_", "+/"), (F.ceil(F.length(x) / 4) * 4).cast("int"), F.lit("="))
    return F.when(right, F.unbase64(padded))


def armor_line(offset: Column, payload: Column) -> Column:
    """`S`, nine hex digits of the offset, base64url without padding, CRC-32 of what stands before it."""
    head = F.concat(F.lit("S"), F.lpad(F.lower(F.hex(offset)), 9, "0"), F.lit(":"), base64url(payload))
    return F.concat(head, F.lit(":"), F.lpad(F.lower(F.hex(F.crc32(head.cast("binary")))), 8, "0"))
