"""Peaks, captions, threads, settings and tails.

Defined results: a null value is no peak; null and empty lines are no captions; a comment without a parent, or whose
parent isn't there, is a root; of lines with one number in a source any may be the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def peaks(points: DataFrame) -> DataFrame:
    """Local maxima by series: after the opening (pos > 0), no smaller than the one before, larger than the one after; at an end one neighbour is enough."""
    w = Window.partitionBy("series").orderBy("pos")
    near = points.withColumns({"prev": F.lag("value").over(w), "next": F.lead("value").over(w)})
    return near.where("pos > 0 and (prev is null or prev <= value) and (next is null or next < value)").select("series", "pos", "value")


def chapter_ends(chapters: DataFrame) -> DataFrame:
    """(video, pos, start, end, title): a chapter ends where it says, else with the video, else where it starts."""
    return chapters.select("video", "pos", F.col("start_time").alias("start"), F.coalesce("end_time", "duration", "start_time").alias("end"), "title")


def caption_text(lines: DataFrame) -> DataFrame:
    """Lines (id, line_no, line) stripped, without empty ones and repeats of the line before, as one text."""
    w = Window.partitionBy("id").orderBy("line_no")
    full = lines.withColumn("line", F.regexp_replace("line", r"^[ \t\r]+|[ \t\r]+$", "")).where("line <> ''")
    kept = full.withColumn("before", F.lag("line").over(w)).where("before is null or before <> line")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ")
    return kept.groupBy("id").agg(F.count(F.lit(1)).alias("n_lines"), text.alias("text"))


def thread(comments: DataFrame) -> DataFrame:
    """Whether a comment is a root (no parent, or one that isn't there), a reply to a root, or deeper and not printed."""
    ids = comments.select(F.col("video"), F.col("id").alias("parent"), F.col("parent").alias("above"), F.lit(True).alias("there"))
    one = comments.join(ids, ["video", "parent"], "left")
    up = comments.select("video", F.col("id").alias("above"), F.lit(True).alias("top_there"))
    two = one.join(up, ["video", "above"], "left")
    root = F.col("parent").isNull() | F.col("there").isNull()
    return two.select("video", "id", F.when(root, "root").when(F.col("above").isNull() | F.col("top_there").isNull(), "reply").otherwise("deeper").alias("kind"))


def in_force(settings: DataFrame) -> DataFrame:
    """Of each key the value of the source that counts most; within a source the last line."""
    return settings.groupBy("key").agg(F.max_by(F.struct("value", "source"), F.struct("weight", "line_no")).alias("x")).select("key", "x.value", "x.source")


def word_counts(texts: DataFrame) -> DataFrame:
    """(id, words, tags, chapters) of (id, text, tags, chapters); null counts as none."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != ""))
    return texts.select("id", words.alias("words"), F.coalesce(F.size(F.filter("tags", lambda t: t != "")), F.lit(0)).alias("tags"), F.coalesce(F.size("chapters"), F.lit(0)).alias("chapters"))


def tail(lines: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("source").orderBy(F.desc("line_no"))
    return lines.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")
