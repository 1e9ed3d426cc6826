"""Playlists around the queue: noted places, the next video, and lists that go on by themselves.

Tables: places (url, list, index, queued), items (list, pos, id) with pos from 0, queue (url), going (list).
Defined results: a url that no place names has no next one; where its id is not in the list, those after its index
count, and with no index none; repeated places of a url count once, by the first (smallest index, then list).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import links

#: Videos that a list goes on through without being asked twice.
CONFIRM_ABOVE = 10


def noted(places: DataFrame, new: DataFrame) -> DataFrame:
    """places and the new ones (pos, url, list, index) whose url has no place yet, the first of each."""
    first = new.groupBy("url").agg(F.min_by(F.struct("list", "index"), F.col("pos")).alias("x")).select("url", "x.list", "x.index", F.lit(False).alias("queued"))
    return places.unionByName(first.join(places.select("url").distinct(), "url", "left_anti").select(*places.columns))


def rest(places: DataFrame, items: DataFrame) -> DataFrame:
    """(url, list, place, id): what comes after each place in its list; place counts from 1."""
    one = places.groupBy("url").agg(F.min(F.struct("index", "list")).alias("x")).select("url", "x.list", "x.index", links.first_id(F.col("url")).alias("own"))
    here = one.join(items.select("list", F.col("id").alias("own"), "pos"), ["list", "own"], "left").groupBy("url", "list", "index").agg(F.min("pos").alias("at"))
    start = here.select("url", "list", F.coalesce(F.col("at") + 1, F.col("index")).alias("start"))
    return start.join(items, "list").where(F.col("pos") >= F.col("start")).select("url", "list", (F.col("pos") + 1).alias("place"), "id")


def next_of(places: DataFrame, items: DataFrame, queue: DataFrame, going: DataFrame) -> DataFrame:
    """For each place: how many come after it, the first of them that the queue lacks with its place, what is left after that, and whether its list goes on by itself."""
    after = rest(places, items).withColumn("next", F.concat(F.lit(links.WATCH), F.col("id")))
    known = queue.select(F.col("url").alias("next"), F.lit(True).alias("there")).distinct()
    found = after.join(known, "next", "left").groupBy("url").agg(F.count(F.lit(1)).alias("after"), F.min(F.when(F.col("there").isNull(), F.struct("place", "next"))).alias("x"))
    size = items.groupBy("list").agg(F.count(F.lit(1)).alias("size"))
    one = places.groupBy("url").agg(F.min(F.struct("index", "list")).alias("p")).select("url", "p.list")
    out = one.join(found, "url", "left").join(size, "list", "left").join(going.select("list", F.lit(True).alias("auto")).distinct(), "list", "left")
    return out.select("url", "list", F.coalesce("after", F.lit(0)).alias("after"), "x.next", "x.place", (F.col("size") - F.col("x.place")).alias("left"), F.coalesce("auto", F.lit(False)).alias("auto"))


def outcome(asked_auto: Column, confirmed: Column) -> Column:
    """What next_of()'s row comes to: stopped, confirm, queued, nothing."""
    stop = asked_auto & F.col("auto")
    return F.when(stop, F.lit("stopped")).when(asked_auto & (F.col("after") > CONFIRM_ABOVE) & ~confirmed, F.lit("confirm")).when(F.col("next").isNotNull(), F.lit("queued")).otherwise(F.lit("nothing"))


def said(kind: Column, auto: Column) -> Column:
    """What a person is told of it."""
    n = lambda c: F.col(c).cast("string")
    one = F.concat(F.lit("queued #"), n("place"), F.lit(" of the playlist ("), n("left"), F.lit(" more after it): n for the next, N to go on by itself"))
    on = F.concat(F.lit("queued #"), n("place"), F.lit("; the playlist goes on by itself, one at a time ("), n("left"), F.lit(" more after it). N stops it"))
    none = F.when(F.col("after") == 0, F.lit("it is the last in its playlist: nothing after it")).otherwise(F.concat(F.lit("the "), n("after"), F.lit(" after it in the playlist are all in the queue already")))
    ask = F.concat(n("after"), F.lit(" videos after it: press N again within 10 s to go on through them, one at a time"))
    return F.when(kind == "queued", F.when(auto, on).otherwise(one)).when(kind == "confirm", ask).when(kind == "stopped", F.lit("the playlist no longer goes on by itself; n or N resumes it from any of its videos")).otherwise(none)


def gone_on(done: DataFrame, places: DataFrame, items: DataFrame, queue: DataFrame, going: DataFrame) -> tuple[DataFrame, DataFrame]:
    """After the urls of done: what their going lists queue next (url, list, index), and the lists that go on no longer."""
    found = next_of(places.join(done.select("url").distinct(), "url", "left_semi"), items, queue, going).where("auto")
    queued = found.where("next is not null").groupBy(F.col("next").alias("url")).agg(F.min(F.struct("list", "place")).alias("x")).select("url", "x.list", F.col("x.place").alias("index"))
    return queued, found.where("next is null").select("list").distinct()


def mark(index: Column, queued: Column, going: Column) -> Column:
    """The mark of a place in the window."""
    number = F.when(index.isNotNull(), F.concat(F.lit(" #"), index.cast("string"))).otherwise(F.lit(""))
    state = F.when(going, F.lit("going on")).when(queued, F.lit("next queued")).otherwise(F.lit("n next, N go on"))
    return F.concat(F.lit("[playlist"), number, F.lit(": "), state, F.lit("]"))


def info(list_: Column, index: Column) -> Column:
    number = F.when(index.isNotNull(), F.concat(F.lit(", number "), index.cast("string"))).otherwise(F.lit(""))
    return F.concat(F.lit("part of playlist "), list_, number, F.lit(": n queues the next video, N goes on through the playlist by itself"))


def line(url: Column, list_: Column, index: Column, queued: Column) -> Column:
    """A place as its notes file holds it."""
    return F.concat_ws("\t", url, list_, F.coalesce(index.cast("string"), F.lit("")), F.when(queued, F.lit("1")).otherwise(F.lit("")))


def from_lines(lines: DataFrame) -> DataFrame:
    """Places from the lines (value) of a notes file; a line of fewer than two fields is none."""
    f = F.split("value", "\t")
    field = lambda i: F.get(f, F.lit(i))
    out = lines.where(F.size(f) >= 2)
    return out.select(field(0).alias("url"), field(1).alias("list"), field(2).try_cast("int").alias("index"), F.coalesce(field(3) == "1", F.lit(False)).alias("queued"))


def listing_ids(lines: Column) -> Column:
    """Ids of a lister's output: the lines that are an id and nothing else."""
    own = F.transform(lines, lambda x: F.trim(x))
    return F.filter(own, lambda x: F.regexp_like(x, F.lit(r"\A[A-Za-z0-9_-]{11}\z")))
