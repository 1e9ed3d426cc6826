"""Links in text: videos, other addresses, playlists, and HTML's character references.

The patterns are Java's with (?U), so that word characters and white space are those of every script.
Defined results: a null text has no links (null); an unknown reference stays as it is.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestrata.functions import text as T

# The pattern of a video's link, whose group is the id; of an address; of a post that has a discussion; and the canonical link.
VIDEO = r"""(?U)(?:https?://|(?<![\w.@/-]))(?:(?:www|m|music)\.)?(?:youtube\.com/(?:watch\?(?:[^\s\x1c-\x1f"'<>#]*?&)?v=|shorts/|live/|embed/)|youtu\.be/)([A-Za-z0-9_-]{11})(?![A-Za-z0-9_-])"""
ADDRESS = r"(?U)\Ahttps?://(?:(?:[A-Za-z0-9-]+\.)+[A-Za-z0-9-]+|localhost)(?::[0-9]+)?(?:/[^\s\x1c-\x1f]*)?\n?\z"
POST = r"(?s)\Ahttps?://(?i:(?:(?:www|old|new|m)\.)?reddit\.com)/(?:(?:r|user)/[^/]*/)?comments/[A-Za-z0-9]+(?:/.*)?\z"
WATCH = "https://www.youtube.com/watch?v="

# References by name, and those that need no semicolon.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®"}
BARE = ["amp", "lt", "gt", "quot", "nbsp", "copy", "reg"]
_REFERENCE = re.compile(r"&(?:#(?:[xX](?P<hex>[0-9a-fA-F]+)|(?P<dec>[0-9]+));?|(?P<name>[^\t\n\f\0 <&#;]{1,32})(?P<end>;?))", re.ASCII)


def _code_point(n: int) -> str:
    """What a numeric reference stands for: Windows-1252 from 128 to 159, nothing for codes that are no characters."""
    if 0x80 <= n <= 0x9F:
        return bytes([n]).decode("cp1252", "ignore")
    if n == 0 or 0xD800 <= n <= 0xDFFF or n > 0x10FFFF:
        return "\ufffd"
    barred = 1 <= n <= 8 or n == 11 or 14 <= n <= 31 or n == 127 or 0xFDD0 <= n <= 0xFDEF or n & 0xFFFE == 0xFFFE
    return "" if barred else chr(n)


def _resolved(hit: re.Match) -> str:
    if digits := hit["hex"] or hit["dec"]:
        return _code_point(int(digits, 16 if hit["hex"] else 10))
    name = hit["name"]
    if hit["end"] and name in NAMED:
        return NAMED[name]
    bare = max((b for b in BARE if name.startswith(b)), key=len, default="")
    return NAMED[bare] + name[len(bare) :] + hit["end"] if bare else hit[0]


def unescaped(x: str) -> str:
    return _REFERENCE.sub(_resolved, x) if "&" in x else x


@F.pandas_udf(StringType())
def _unescape(x: pd.Series) -> pd.Series:
    return x.map(unescaped, na_action="ignore")


def html_unescape(x: Column) -> Column:
    """Character references undone. Only texts with an ampersand go to Python."""
    return F.when(F.contains(x, F.lit("&")), _unescape(F.when(F.contains(x, F.lit("&")), x))).otherwise(x)


def video_ids(x: Column) -> Column:
    """Every id, in order, with repeats."""
    return F.regexp_extract_all(x, F.lit(VIDEO), F.lit(1))


def video_urls(x: Column) -> Column:
    """The canonical link of every video, once each, after references are undone."""
    return F.transform(F.array_distinct(video_ids(html_unescape(x))), lambda i: F.concat(F.lit(WATCH), i))


def first_id(x: Column) -> Column:
    """Null if there is none."""
    return F.try_element_at(video_ids(x), F.lit(1))


def short(url: Column) -> Column:
    """The id of a video's link, else the link."""
    return F.coalesce(first_id(url), url)


def is_url(x: Column) -> Column:
    return F.regexp_like(x, F.lit(ADDRESS))


def as_url(x: Column) -> Column:
    """The text as one address to queue, else null: a video at its start with no white space in it is its canonical link."""
    t = T.py_strip(x)
    video = F.regexp_extract(t, r"\A" + VIDEO, 1)
    solid = ~F.regexp_like(t, F.lit(r"(?U)[\s\x1c-\x1f]"))
    plain = is_url(t) & ~F.regexp_like(t, F.lit(r"[\x00-\x1f\x7f-\x9f]"))
    return F.when((video != "") & solid, F.concat(F.lit(WATCH), video)).when(plain, t)


def is_post(url: Column) -> Column:
    return F.regexp_like(url, F.lit(POST))


def talks(url: Column) -> Column:
    """Whether a download of it gets a transcript and a discussion."""
    return first_id(url).isNotNull() | is_post(url)


def param(url: Column, key: str) -> Column:
    """The first value of key in the query, null if it has none."""
    pattern = rf"(?s)\A[^?]*\?(?:[^#]*?&)?{re.escape(key)}=([^&#]*)"
    return F.when(F.regexp_like(url, F.lit(pattern)), F.regexp_extract(url, pattern, 1))


def places(x: Column) -> Column:
    """(url, list, index) of every video whose link names a playlist, the first place of each video."""

    def place(word: Column) -> Column:
        named = F.when(F.regexp_like(param(word, "list"), F.lit(r"\A[A-Za-z0-9_-]+\z")), param(word, "list"))
        index = param(word, "index").try_cast("int")
        return F.struct(F.concat(F.lit(WATCH), first_id(word)).alias("url"), named.alias("list"), F.when(index >= 0, index).alias("index"))

    def firsts(words: Column) -> Column:
        found = F.filter(F.transform(words, place), lambda p: p["url"].isNotNull() & p["list"].isNotNull())
        return T.given(found, lambda f: F.filter(f, lambda p, i: F.array_position(F.transform(f, lambda q: q["url"]), p["url"]) == i + 1))

    return T.given(F.split(html_unescape(x), r"(?U)\s+"), firsts)
