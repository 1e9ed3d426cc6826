"""Wrapped text and captions.

Lines break as the standard library's textwrap breaks them: at white space, after hyphens inside words, around
dashes; a word longer than a line is cut. Defined results: null gives null; a text of blanks has no lines.
"""

from __future__ import annotations

import json
import re
import textwrap

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.functions import links, text

WIDTH = 78


def wrap(x: Column, width: int = WIDTH) -> Column:
    @F.pandas_udf("array<string>")
    def run(col: pd.Series) -> pd.Series:
        return col.map(lambda s: textwrap.wrap(s, width), na_action="ignore")

    return run(x)


def fill(x: Column, width: int = WIDTH) -> Column:
    return F.array_join(wrap(x, width), "\n")


def expand_tabs(x: Column) -> Column:
    @F.pandas_udf("string")
    def run(col: pd.Series) -> pd.Series:
        return col.map(lambda s: s.expandtabs(8), na_action="ignore")

    return F.when(F.contains(x, F.lit("\t")), run(x)).otherwise(x)


_ENDS, _BARRED = re.compile("\r\n|[\r\x0b\x0c\x85\u2028\u2029]"), re.compile("[\x00-\x08\x0e-\x1f\x7f-\x9f]")


def _lines(x: str) -> str:
    """clean() of one Python text."""
    return _BARRED.sub("", _ENDS.sub("\n", x))


def _spoken(x: str) -> list[str]:
    """The words of lines (between U+0000): references undone, cleaned, without empty lines and repeats of the one before."""
    out: list[str] = []
    for line in x.split("\0"):
        said = _lines(links.unescaped(line)).strip()
        if said and out[-1:] != [said]:
            out.append(said)
    return out


def _cues(x: Column) -> Column:
    """What stands below the head of a caption file, without times and tags; lines between U+0000."""
    every = F.transform(F.split(F.regexp_replace(x, "\r\n?", "\n"), "\n"), text.py_strip)
    none = F.array().cast("array<string>")
    body = text.given(every, lambda e: F.when(F.array_position(e, "") == 0, none).otherwise(F.slice(e, F.array_position(e, "").cast("int") + 1, F.size(e))))
    said = F.filter(body, lambda s: ~F.contains(s, F.lit("-->")))
    return F.array_join(F.transform(said, text.strip_tags), "\0")


def caption_lines(x: Column) -> Column:
    """The words of a caption file, line by line: after the head and its empty line, without times, tags and repeats of the line before."""

    @F.pandas_udf("array<string>")
    def run(col: pd.Series) -> pd.Series:
        return col.map(_spoken, na_action="ignore")

    return run(_cues(x))


def caption_text(x: Column, width: int = WIDTH) -> Column:
    """A caption file's words as one wrapped paragraph."""

    @F.pandas_udf("string")
    def run(col: pd.Series) -> pd.Series:
        return col.map(lambda s: textwrap.fill(" ".join(_spoken(s)), width), na_action="ignore")

    return run(_cues(x))


def clean_info(x: Column, long: tuple[str, ...] = ("description",)) -> Column:
    """A JSON text with every string and key as one clean line; values of the keys in `long` keep their lines. Null if it isn't JSON."""
    def line(s: str) -> str:
        s = re.sub("[\n\t]+ ", " ", re.sub(" [\n\t]+", " ", _lines(s)))
        return re.sub("[\n\t]+", " ", s).strip()

    def walked(v, key=None):
        if isinstance(v, str):
            return _lines(v) if key in long else line(v)
        if isinstance(v, list):
            return [walked(i) for i in v]
        return {line(k): walked(i, k) for k, i in v.items()} if isinstance(v, dict) else v

    def cleaned(s: str) -> str | None:
        try:
            return json.dumps(walked(json.loads(s)), ensure_ascii=False)
        except ValueError:
            return None

    @F.pandas_udf("string")
    def run(col: pd.Series) -> pd.Series:
        return col.map(cleaned, na_action="ignore")

    return run(x)
