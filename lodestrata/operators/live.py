"""A download's live record: what the tool's lines make of it, and how it reads.

A line has url, at (seconds) and line, in the order of `pos`. The record's fields are texts as the tool gave them.
Defined results: a missing field reads as the empty text; lines of no known kind change nothing but `last`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import text as T

# The fields of a progress line in order, and the prefixes that tag the tool's own lines.
PROGRESS_KEYS = ["pct", "got_b", "total_b", "est_b", "speed", "eta", "elapsed", "frag", "frags", "format", "vcodec", "acodec", "height", "state"]
TAGS = ["PROGRESS", "NOTES", "FILE"]

# Patterns of the tool's lines.
FORMATS = r"\A\[info\] \S+: Downloading [0-9]+ format\(s\): (\S+)"
DESTINATION = r"(?s)\A\[download\] Destination: (.*)\z"
ALREADY = r"(?s)\A\[download\] (.*) has already been downloaded\z"
MERGING = r"(?s)\A\[Merger\] Merging formats into \"*(.*?)\"*\z"
STEP = r"\A\[(Fixup\w*|FFmpeg\w*|Embed\w*|Metadata)\] "

#: Seconds between samples of a part's progress.
SAMPLE_S = 30.0


def routed(line: Column) -> Column:
    """(tag, rest) of a line: one of TAGS, else `meta` for the name rules' chatter, else `own` for the tool's own words."""
    out = F.when(F.startswith(line, F.lit("[MetadataParser] ")), F.struct(F.lit("meta").alias("tag"), line.alias("rest")))
    for tag in TAGS:
        out = out.when(F.startswith(line, F.lit(f"{tag} ")), F.struct(F.lit(tag).alias("tag"), F.substring(line, F.lit(len(tag) + 2), F.length(line)).alias("rest")))
    return out.otherwise(F.struct(F.lit("own").alias("tag"), line.alias("rest")))


def progress(rest: Column) -> Column:
    """The fields of a progress line as a map."""
    values = F.transform(F.split(rest, r"\|"), T.py_strip)
    n = F.least(F.size(values), F.lit(len(PROGRESS_KEYS)))
    return F.map_from_arrays(F.slice(F.array(*[F.lit(k) for k in PROGRESS_KEYS]), F.lit(1), n), F.slice(values, F.lit(1), n))


def without_progress(fields: Column) -> Column:
    """A record's map without the fields of the part before."""
    return F.map_filter(fields, lambda k, _: ~k.isin(PROGRESS_KEYS))


def step_of(line: Column) -> Column:
    """(phase, formats, dest, new_part) that a line of the tool begins; a null phase if it begins none."""
    formats, dest, there, merged, name = (F.regexp_extract(line, p, 1) for p in (FORMATS, DESTINATION, ALREADY, MERGING, STEP))
    is_ = lambda p: F.regexp_like(line, F.lit(p))

    def step(phase, formats=F.lit(None), dest=F.lit(None), part=False):
        return F.struct(phase.alias("phase"), formats.cast("string").alias("formats"), dest.cast("string").alias("dest"), F.lit(part).alias("new_part"))

    return (
        F.when(is_(FORMATS), step(F.lit("starting"), formats=formats))
        .when(is_(DESTINATION), step(F.lit("downloading"), dest=dest, part=True))
        .when(is_(ALREADY), step(F.lit("already on disk"), dest=there, part=True))
        .when(is_(MERGING), step(F.lit("merging"), dest=merged))
        .when(is_(STEP), step(F.concat(F.lit("post-processing ("), name, F.lit(")"))))
        .when(F.startswith(line, F.lit("Deleting original file")), step(F.lit("removing the part files")))
        .otherwise(step(F.lit(None).cast("string")))
    )


def steps(lines: DataFrame) -> DataFrame:
    """The steps of each download: url, pos, phase, part, parts, formats, dest; only lines that change phase or part."""
    from pyspark.sql import Window

    own = lines.where(routed(F.col("line"))["tag"] == "own").withColumn("s", step_of(F.col("line"))).where("s.phase is not null")
    so_far = Window.partitionBy("url").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("url").orderBy("pos")
    named = own.select("url", "pos", "at", "s.phase", "s.dest", F.sum(F.col("s.new_part").cast("int")).over(so_far).alias("part"), F.last("s.formats", ignorenulls=True).over(so_far).alias("formats"))
    changed = named.withColumn("old", F.lag(F.struct("phase", "part")).over(before)).where(F.col("old").isNull() | (F.col("old") != F.struct("phase", "part")))
    return changed.select("url", "pos", "at", "phase", "part", F.size(F.split("formats", r"\+")).alias("parts"), "formats", "dest")


def stream_of(f) -> Column:
    """What is being fetched: kind, format, codec, height; f gives a field's Column by name."""
    v, a = T.na(f("vcodec")), T.na(f("acodec"))
    planned = F.get(F.split(f("formats"), r"\+"), f("part").cast("int") - 1)
    fmt = F.when(T.na(f("format")) != "", T.na(f("format"))).otherwise(F.coalesce(planned, F.lit("")))
    kind = F.when((v != "") & (a != ""), "video and audio").when(v != "", "video").when(a != "", "audio")
    tall = F.when((v != "") & (T.na(f("height")) != ""), F.concat(T.na(f("height")), F.lit("p")))
    said = F.concat_ws(" ", kind, F.when(fmt != "", F.concat(F.lit("f"), fmt)), F.when(v != "", v).when(a != "", a), tall)
    return F.when(said == "", F.lit("?")).otherwise(said)


def size_of(f) -> Column:
    """Bytes got of all; a total that is an estimate has a tilde."""
    got, total, est = (T.number(f(k)) for k in ("got_b", "total_b", "est_b"))
    of = F.concat(T.fmt_size(got), F.lit(" of "), F.when(total == 0, F.lit("~")).otherwise(F.lit("")), T.fmt_size(F.when(total != 0, total).otherwise(est)))
    return F.when((total != 0) | (est != 0), of).when(got != 0, T.fmt_size(got)).otherwise(F.lit(""))


def _part(f, shape: str) -> Column:
    named = F.coalesce(f("part").cast("int"), F.lit(0)) * F.coalesce(f("parts").cast("int"), F.lit(0)) != 0
    return F.when(named, F.format_string(shape, f("part").cast("string"), f("parts").cast("string"))).otherwise(F.lit(""))


def describe(f) -> Column:
    """The step in words."""
    phase = F.when(F.coalesce(f("phase"), F.lit("")) == "", F.lit("starting")).otherwise(f("phase"))
    fetching = F.concat(phase, _part(f, " part %s of %s"), F.lit(": "), stream_of(f))
    return F.when(phase.isin("downloading", "already on disk"), fetching).when(phase == "merging", F.lit("merging the video and audio into one file (ffmpeg)")).otherwise(phase)


def compact(f) -> Column:
    """The progress in a few words, or the step."""
    phase, eta = F.coalesce(f("phase"), F.lit("")), T.na(f("eta"))
    said = F.concat(_part(f, "%s/%s "), f("pct"), F.lit(" "), T.na(f("speed")), F.when(eta != "", F.concat(F.lit(" eta "), eta)).otherwise(F.lit("")))
    return F.when((phase == "downloading") & (T.na(f("pct")) != ""), F.trim(said)).otherwise(phase)


def progress_line(f, width: int) -> Column:
    """The bar with what is said beside it."""
    or_q = lambda k: F.when(T.na(f(k)) == "", F.lit("?")).otherwise(T.na(f(k)))
    share = T.number(F.rtrim(f("pct"), F.lit("%"))) / 100
    frag = F.when((T.na(f("frag")) != "") & (T.na(f("frags")) != ""), F.concat(F.lit("  fragment "), f("frag"), F.lit(" of "), f("frags"))).otherwise(F.lit(""))
    return F.concat(F.lit("progress "), T.bar(share, width), F.lit(" "), f("pct"), F.lit("  "), size_of(f), F.lit("  "), or_q("speed"), F.lit("  eta "), or_q("eta"), frag)


def part_sizes(lines: DataFrame) -> DataFrame:
    """By url: parts that are done and the sum of their sizes, the total where it is known, else what was got."""
    fields = lines.where(routed(F.col("line"))["tag"] == "PROGRESS").select("url", progress(routed(F.col("line"))["rest"]).alias("f")).where("f['state'] = 'finished'")
    total, got = T.number(F.col("f")["total_b"]), T.number(F.col("f")["got_b"])
    return fields.groupBy("url").agg(F.count(F.lit(1)).alias("parts_done"), F.sum(F.when(total != 0, total).otherwise(got)).cast("long").alias("done_b"))


def sampled(samples: DataFrame, every: float = SAMPLE_S) -> DataFrame:
    """The samples (url, at, finished) that are logged: each that finishes a part, and of the others one as soon as `every` seconds have gone since the last such.

    The interval begins anew with each one, so a url's samples are read in order, one after another, by one task; the task holds one time.
    """
    rows = samples.select("url", "at", "finished").repartition("url").sortWithinPartitions("url", "at")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        url, last = object(), 0.0
        for b in batches:
            keep = []
            for u, at, done in zip(b["url"], b["at"], b["finished"], strict=True):
                if u != url:
                    url, last = u, float("-inf")
                due = not done and at - last >= every
                last = at if due else last
                keep.append(bool(done) or due)
            yield b[keep]

    return rows.mapInPandas(run, rows.schema)
