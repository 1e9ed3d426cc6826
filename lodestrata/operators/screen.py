"""What a person is shown of a selection, a folder, a queue entry, a command that ended; and small edits around it.

Defined results: a missing field is left out of what is shown; names that begin with a dot aren't listed; an unknown
variable stays as it is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import links
from lodestrata.functions import text as T
from lodestrata.operators import queue

# Lines of a preview and of the notes beside a file, characters of an error in a detail, bytes of a log before it is moved away.
PREVIEW, BESIDE, ERROR, LOG_MAX = 20, 16, 60, 4 << 20


def _told(x: Column) -> Column:
    return F.when(x != "", x)


def listed(files: DataFrame) -> DataFrame:
    """(name, is_dir, place) of a folder's files (name, is_dir), in the order of their bytes; no dotfiles."""
    return files.where(~F.startswith("name", F.lit("."))).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("name").cast("binary"))))


def detail(status: Column, quality: Column, progress: Column, file: Column, error: Column) -> Column:
    """The second line of an entry."""
    return F.concat_ws(" · ", status, _told(quality), _told(progress), _told(T.basename(file)), _told(T.cut(error, ERROR)))


def entry_line(status: Column, title: Column, url: Column) -> Column:
    return F.concat(T.ljust(status, 11), F.lit(" "), queue.title_or_url(title, url))


def inspected_entry(live_lines: Column | None = None) -> Column:
    """Lines about a queue entry, from its columns; live_lines: of a download under way."""
    c = F.col
    field = lambda k, v: F.when(v != "", F.concat(F.lit(f"{k:<12} "), v))
    tries = F.when(c("attempts") != 0, c("attempts").cast("string"))
    head = F.array(queue.title_or_url(c("title"), c("url")), F.lit(""), F.concat(F.lit("status       "), c("status")), field("quality", c("quality")), field("file", c("file")), field("attempts", tries), F.concat(F.lit("url          "), c("url")))
    wrong = F.when(c("error") != "", F.array(F.lit(""), F.concat(F.lit("error        "), c("error"))))
    none = F.array().cast("array<string>")
    under_way = none if live_lines is None else F.when(c("status") == "downloading", F.concat(F.array(F.lit("")), live_lines)).otherwise(none)
    return F.concat(F.array_compact(head), F.coalesce(wrong, none), under_way)


def inspected_missing(url: Column) -> Column:
    return F.array(links.short(url), F.lit(""), F.lit("(no longer in the queue)"))


def inspected_folder(name: Column, items: Column) -> Column:
    return F.array(name, F.lit(""), F.concat(F.lit("folder, "), items.cast("string"), F.lit(" item"), F.when(items == 1, F.lit("")).otherwise(F.lit("s"))))


def inspected_capture(name: Column, report: Column, verdict: Column) -> Column:
    said = F.when(verdict == 0, F.lit("verify: everything checked out")).otherwise(F.lit("verify: SOMETHING IS WRONG -- sstr verify says what"))
    return F.concat(F.array(name, F.lit("")), F.split(report, "\n"), F.array(F.lit(""), said))


def inspected_file(name: Column, size: Column, own: Column, notes_name: Column, notes: Column) -> Column:
    """A text's first lines (own, null if it is no text), or the first lines of the notes beside it."""
    head = F.array(name, F.lit(""), F.concat(T.commas(size), F.lit(" bytes")))
    first = lambda x, n: F.slice(T.split_lines(x), 1, n)
    none = F.array().cast("array<string>")
    beside = F.when(notes.isNotNull(), F.concat(F.array(F.lit(""), F.concat(F.lit("notes: "), notes_name)), first(notes, BESIDE))).otherwise(none)
    return F.concat(head, F.when(own.isNotNull(), F.concat(F.array(F.lit("")), first(own, PREVIEW))).otherwise(beside))


def outcome(code: Column, wrong: Column) -> Column:
    """How a command ended: its code, null if a signal ended it; wrong: why it couldn't run."""
    return F.when(wrong.isNotNull(), F.concat(F.lit("could not run: "), wrong)).when(code == 0, F.lit("ok")).when(code.isNotNull(), F.concat(F.lit("exit "), code.cast("string"))).otherwise(F.lit("killed by a signal"))


def stamped(events: DataFrame) -> DataFrame:
    """Log lines (at, line) of events (at, pid, said): one a line of what was said, each with the time and the process."""
    stamp = F.concat(F.date_format(F.timestamp_seconds("at"), "yyyy-MM-dd HH:mm:ss"), F.lit(" ["), F.col("pid").cast("string"), F.lit("] "))
    return events.select("at", stamp.alias("stamp"), F.explode(T.split_lines(F.col("said"))).alias("l")).select("at", F.concat("stamp", T.printable(F.col("l"))).alias("line"))


def followed(log: DataFrame, own: DataFrame, keep: int = 200) -> DataFrame:
    """The last lines of a log and of one's own events (at, line) together, by time."""
    return log.select("at", "line").unionByName(own.select("at", "line")).orderBy(F.desc("at")).limit(keep)


def log_files(appended: DataFrame, most: int = LOG_MAX) -> DataFrame:
    """(pos, line, file) of lines to append (pos, line, size before them): a log beyond `most` bytes is moved away before a line goes in, so file counts the moves."""
    own = F.octet_length("line") + 1
    w = Window.partitionBy(F.lit(0)).orderBy("pos")  # one file has one writer
    before = F.coalesce(F.sum(own).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.first("size").over(w)
    return appended.withColumn("file", F.floor(F.greatest(before - 1, F.lit(0)) / (most + 1)))


def sign_ins(lines: DataFrame) -> DataFrame:
    """(url, opened, window) of the lines (value) of a sign-in notes file; a line without a time is none."""
    f = F.split("value", "\t")
    out = lines.select(F.get(f, F.lit(0)).alias("url"), F.get(f, F.lit(1)).try_cast("double").alias("opened"), F.coalesce(F.get(f, F.lit(2)), F.lit("")).alias("window"))
    return out.where("opened is not null")


def expanded(x: Column, env: dict[str, str]) -> Column:
    """$NAME and ${NAME} of the environment, each once; other names stay."""
    out = x
    for name, value in sorted(env.items(), key=lambda e: -len(e[0])):
        safe = value.replace("\\", "\\\\").replace("$", "\\$")
        out = F.regexp_replace(out, rf"\$(?:\{{{name}\}}|{name}(?![A-Za-z0-9_]))", safe)
    return out


def free_names(wanted: DataFrame, there: DataFrame, most: int = 1000) -> DataFrame:
    """(path, free): the path if nothing has it, else the first of stem-1, stem-2, ... that is free; the path itself if none is."""
    own = wanted.select("path", T.stem(F.col("path")).alias("stem"), F.regexp_extract("path", r"(\.[^./]*)\z", 1).alias("ext"))
    taken = there.select(F.col("path").alias("taken")).distinct()
    numbers = F.array_append(F.sequence(F.lit(0), F.lit(most - 1)), F.lit(most))
    # only paths that are taken have further names tried
    hit = own.join(taken, F.col("path") == F.col("taken"), "left").withColumn("n", F.explode(F.when(F.col("taken").isNull(), F.array(F.lit(0))).otherwise(numbers)))
    name = F.when(F.col("n").isin(0, most), F.col("path")).otherwise(F.concat("stem", F.lit("-"), F.col("n").cast("string"), "ext"))
    tried = hit.drop("taken").withColumn("name", name).join(taken, F.col("name") == F.col("taken"), "left").where(F.col("taken").isNull() | (F.col("n") == most))
    return tried.groupBy("path").agg(F.min_by("name", "n").alias("free"))


def browser_windows(clients: Column) -> Column:
    """Addresses of the browser's windows in a compositor's JSON list."""
    found = F.from_json(clients, "array<struct<class:string,address:string>>")
    return F.transform(F.filter(found, lambda c: F.contains(F.lower(c["class"]), F.lit("brave")) & c["address"].isNotNull()), lambda c: c["address"])


def browser_streams(inputs: Column) -> Column:
    """(index, corked) of the browser's streams in a sound server's JSON list."""
    found = F.from_json(inputs, "array<struct<index:bigint,corked:boolean,properties:map<string,string>>>")
    named = lambda i, k: F.contains(F.lower(F.coalesce(F.try_element_at(i["properties"], F.lit(k)), F.lit(""))), F.lit("brave"))
    ours = F.filter(found, lambda i: (named(i, "application.name") | named(i, "application.process.binary")) & i["index"].isNotNull())
    return F.transform(ours, lambda i: F.struct(i["index"].alias("index"), F.coalesce(i["corked"], F.lit(False)).alias("corked")))


def updated(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """entries with the fields that changes (url, and some of their columns) set; a null field stays as it was, urls that aren't there change nothing."""
    fields = [c for c in changes.columns if c != "url"]
    new = changes.select("url", *[F.col(c).alias(f"new_{i}") for i, c in enumerate(fields)])
    out = entries.join(new, "url", "left")
    return out.select(*[F.coalesce(F.col(f"new_{fields.index(c)}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in entries.columns])


def scrolled(top: Column, selected: Column, rows: Column) -> Column:
    """The first row on screen that keeps the selected one there."""
    rows = F.greatest(rows, F.lit(1))
    return F.when(selected < top, selected).when(selected >= top + rows, selected + 1 - rows).otherwise(top)
