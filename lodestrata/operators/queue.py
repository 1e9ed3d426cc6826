"""The work queue as a table: states, order, claims, additions, and every transition.

An entry has url, title, status, quality, attempts, cookie_tried, error, added, file, progress and live (JSON).
Defined results: a null title counts as none, a null cookie_tried as false, a null attempts as 0; a status that
isn't known lists with `checking`. Of entries with one url each is an entry of its own; additions are one a url.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import links, text

# States in listing order; which are claimed, in that order; which are over; which are still to be worked on.
ORDER = ["downloading", "cookies", "retry-cookies", "checking", "queued", "retry", "done", "failed", "rejected"]
CLAIMED = ["retry-cookies", "queued", "retry"]
HISTORY = ["done", "failed", "rejected"]
PENDING = ["checking", "queued", "retry", "retry-cookies", "downloading"]

SCHEMA = "url string, title string, status string, quality string, attempts int, cookie_tried boolean, error string, added double, file string, progress string, live string"


def rank_of(status: Column, names: list[str], other: int) -> Column:
    out = F.when(status == names[0], 0)
    for i, s in enumerate(names[1:], 1):
        out = out.when(status == s, i)
    return out.otherwise(other)


def status_counts(queue: DataFrame) -> DataFrame:
    return queue.groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("ord", rank_of(F.col("status"), ORDER, 3))


def history_counts(queue: DataFrame) -> DataFrame:
    """By owner: entries that are over, and by which end."""
    over = [F.count_if(F.col("status") == s).alias(s) for s in HISTORY]
    return queue.groupBy("owner").agg(F.count_if(F.col("status").isin(HISTORY)).alias("history"), *over)


def listed(queue: DataFrame) -> DataFrame:
    """Place of each entry in its owner's list."""
    w = Window.partitionBy("owner").orderBy(rank_of(F.col("status"), ORDER, 3), "added", "pos")
    return queue.withColumn("place", F.row_number().over(w))


def claim(queue: DataFrame) -> DataFrame:
    """The entry that each owner takes next, as it is after the claim. A try with cookies is never forgotten."""
    ready = queue.where(F.col("status").isin(CLAIMED))
    best = ready.groupBy("owner").agg(F.min_by(F.struct("url", "status", "attempts", "pos", "cookie_tried"), F.struct(rank_of(F.col("status"), CLAIMED, 9), F.col("pos"))).alias("x"))
    tried = F.coalesce(F.col("x.cookie_tried"), F.lit(False)) | (F.col("x.status") == "retry-cookies")
    return best.select("owner", "x.url", "x.pos", F.lit("downloading").alias("status"), (F.coalesce(F.col("x.attempts"), F.lit(0)) + 1).alias("attempts"), tried.alias("cookie_tried"))


def enqueue(queue: DataFrame, new: DataFrame) -> DataFrame:
    """The first of each new url that the queue doesn't have, to be appended."""
    first = new.groupBy("url").agg(F.min("pos").alias("pos"))
    return first.join(queue.select("url").distinct(), "url", "left_anti").withColumn("status", F.lit("checking"))


def urls_of(texts: DataFrame) -> DataFrame:
    """(pos, url) to queue from texts (pos, text): every video in a text, else the text if it is an address."""
    found = links.video_urls(F.col("text"))
    either = F.when(F.size(found) > 0, found).otherwise(F.array_compact(F.array(links.as_url(F.col("text")))))
    return texts.select("pos", F.explode(either).alias("url"))


def new_entries(urls: DataFrame, added: Column) -> DataFrame:
    """Entries of a url each, as they begin."""
    none = F.lit("")
    return urls.select("url", none.alias("title"), F.lit("checking").alias("status"), none.alias("quality"), F.lit(0).alias("attempts"), F.lit(False).alias("cookie_tried"), none.alias("error"), added.cast("double").alias("added"), none.alias("file"), none.alias("progress"), F.lit("{}").alias("live"))


def cleared(queue: DataFrame) -> DataFrame:
    return queue.where(~F.col("status").isin(HISTORY))


def forgotten(queue: DataFrame, urls: DataFrame) -> DataFrame:
    return queue.join(urls.select("url").distinct(), "url", "left_anti")


def after_retry(status: Column, tried: Column, titled: Column) -> Column:
    return F.when(status == "downloading", status).when((status == "cookies") | tried, F.lit("retry-cookies")).when(~titled, F.lit("checking")).otherwise(F.lit("queued"))


def after_failure(cookie_like: Column, tried: Column, attempts: Column) -> Column:
    return F.when(cookie_like & ~tried, F.lit("cookies")).when((attempts < 2) & ~tried, F.lit("retry")).otherwise(F.lit("failed"))


def recovered(queue: DataFrame) -> DataFrame:
    """After a worker died: what it had in hand is queued again."""
    left = F.col("status") == "downloading"
    return queue.withColumns({"status": F.when(left, F.lit("queued")).otherwise(F.col("status")), "progress": F.when(left, F.lit("")).otherwise(F.col("progress")), "live": F.when(left, F.lit("{}")).otherwise(F.col("live"))})


def signed_in(queue: DataFrame) -> DataFrame:
    """What waited for a sign-in is tried with cookies."""
    return queue.withColumn("status", F.when(F.col("status") == "cookies", F.lit("retry-cookies")).otherwise(F.col("status")))


def title_or_url(title: Column, url: Column) -> Column:
    return F.when(title != "", title).otherwise(url)


def stepped(queue: DataFrame, events: DataFrame) -> DataFrame:
    """The queue after one event a url: events (url, event, rc, said, title, height, ext, with_cookies, kept).

    checked and finished come with an exit code; stopped, retry, cookies, forget and clear without. An event that the
    entry's state doesn't know changes nothing. Entries that an event removes are left out.
    """
    q = queue.withColumnRenamed("title", "queue_title").join(events, "url", "left")
    event, status = F.coalesce(F.col("event"), F.lit("")), F.col("status")
    rc, said = F.coalesce(F.col("rc"), F.lit(0)), F.substring(text.one_line(F.coalesce(F.col("said"), F.lit(""))), 1, 300)
    tried, attempts = F.coalesce(F.col("cookie_tried"), F.lit(False)), F.coalesce(F.col("attempts"), F.lit(0))
    own_title = F.coalesce(F.col("queue_title"), F.lit(""))
    needs_cookies = text.cookie_problem(said)
    looked, ran = (event == "checked") & (status == "checking"), (event == "finished") & (status == "downloading")
    stopped = (event == "stopped") & (status == "downloading")
    again = (event == "retry") & (status != "downloading")
    waited = (event == "cookies") & (status == "cookies")
    state = (
        F.when(looked & ((rc == 0) | needs_cookies), F.lit("queued"))
        .when(looked, F.lit("rejected"))
        .when(ran & (rc == 0), F.lit("done"))
        .when(ran, after_failure(needs_cookies, tried, attempts))
        .when(stopped, F.when(F.coalesce(F.col("with_cookies"), F.lit(False)), F.lit("retry-cookies")).otherwise(F.lit("queued")))
        .when(again, after_retry(status, tried, own_title != ""))
        .when(waited, F.lit("retry-cookies"))
        .otherwise(status)
    )
    height = F.coalesce(F.col("height"), F.lit(""))
    shown = F.concat(F.when(height.isin("NA", "", "None"), F.lit("?")).otherwise(F.concat(height, F.lit("p"))), F.lit(" "), F.coalesce(F.col("ext"), F.lit("")))
    over = ran | stopped
    out = q.select(
        "url",
        F.when(looked & (rc == 0), F.substring(text.one_line(F.coalesce(F.col("title"), F.lit(""))), 1, 200)).when(looked & needs_cookies, F.col("url")).otherwise(own_title).alias("title"),
        state.alias("status"),
        F.when(looked & (rc == 0), shown).when(looked & needs_cookies, F.lit("?")).otherwise(F.col("quality")).alias("quality"),
        F.when(stopped, attempts - 1).otherwise(attempts).alias("attempts"),
        tried.alias("cookie_tried"),
        F.when((looked | ran) & (rc != 0), said).when(looked | ran | again, F.lit("")).otherwise(F.col("error")).alias("error"),
        F.when(ran & (rc == 0), F.coalesce(F.col("kept"), F.lit(""))).otherwise(F.col("file")).alias("file"),
        F.when(over, F.lit("")).otherwise(F.col("progress")).alias("progress"),
        event.alias("event"),
        status.alias("before"),
    )
    gone = (F.col("event") == "forget") | (F.col("event") == "clear") & F.col("before").isin(HISTORY)
    return out.where(~gone).drop("event", "before")


def toggled(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only."""
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def list_line(status: Column, quality: Column, title: Column, url: Column) -> Column:
    """The line of an entry in the list."""
    show = text.printable
    return F.concat(text.ljust(show(status), 13), F.lit(" "), text.ljust(show(quality), 10), F.lit(" "), show(title_or_url(title, url)))


def report_lines(urls: DataFrame) -> DataFrame:
    """(owner, said) from (owner, pos, url, added): a line a url up to five, else one line of counts."""
    line = F.concat(F.when(F.col("added"), F.lit("queued: ")).otherwise(F.lit("already queued: ")), F.col("url"))
    # of all lines only the first five are held
    placed = urls.withColumn("place", F.row_number().over(Window.partitionBy("owner").orderBy("pos")))
    each = placed.groupBy("owner").agg(F.count(F.lit(1)).alias("n"), F.count_if("added").alias("new"), F.array_sort(F.collect_list(F.when(F.col("place") <= 5, F.struct("place", line.alias("line"))))).alias("lines"))
    many = F.concat(F.lit("queued "), F.col("new").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" links; the other "), (F.col("n") - F.col("new")).cast("string"), F.lit(" were already in the queue"))
    return each.select("owner", F.when(F.col("n") > 5, many).otherwise(F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("said"))


def info(status: Column, error: Column, file: Column, url: Column) -> Column:
    """The message line of a selected entry."""
    waiting = F.concat(F.lit("Brave is open on it: sign in / pass the check, then press c.  "), error)
    return F.when(status == "cookies", waiting).when(status.isin("failed", "rejected", "retry"), error).when(file != "", file).otherwise(url)
