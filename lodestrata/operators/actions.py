"""What can be done with a selection, and what playing a capture writes.

Selections: (path, kind, content_type, captures, url), kind one of queued, folder, file. Defined results: an unknown
file has no actions; a folder without captures has none; a null content type is not text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import text as T

# Files that a person reads, and files that a player plays.
READ = ["txt", "md", "json", "log", "csv", "conf"]
PLAYED = ["mp4", "mkv", "webm", "ts", "m4a", "mp3", "opus", "wav"]


def _action(key: str, name, line, how: str = "terminal") -> Column:
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(key).alias("key"), as_col(name).alias("name"), as_col(line).alias("line"), F.lit(how).alias("how"))


def actions(player: str = "mpv", serve: str = "127.0.0.1:8080") -> Column:
    """Actions of a selection, in the order in which they are shown."""
    path, kind, held = F.col("path"), F.col("kind"), F.col("content_type")
    word, url = T.pasted_word(path), T.pasted_word(F.col("url"))
    sh = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    own = F.ltrim(T.extension(path), F.lit("."))
    text, ext = T.is_text(held), T.extension_for(held)
    target = T.pasted_word(sh(T.stem(path), ".", ext))
    quoted = F.lit(serve if serve.replace(".", "").replace(":", "").isalnum() else f"'{serve}'")
    play = F.when(text, _action("p", "Play", sh("sstr play ", word))).otherwise(_action("p", "Play", sh("sstr play ", word, f" | {player} -"), "background"))
    both = F.array(play, _action("P", "Paced", sh("sstr play ", word, " --paced")), _action("s", "Serve", sh("sstr play ", word, " --serve ", quoted), "background"), _action("v", "Verify", sh("sstr verify ", word)), _action("x", sh("Export ", F.upper(ext)), sh("sstr play ", word, " -o ", target)))
    read = F.when(text, F.array(_action("t", "Text", sh("sstr play ", word)))).otherwise(F.array().cast("array<struct<key:string,name:string,line:string,how:string>>"))
    capture = F.concat(both, read, F.array(_action("a", "Armor", sh("sstr armor ", word))))
    queued = F.array(_action("r", "Retry", sh("ytq retry ", url)), _action("f", "Forget", sh("ytq forget ", url)))
    folder = F.array(_action("X", sh("Export all ", F.col("captures").cast("string")), sh("sstr export ", word)))
    none = F.array().cast("array<struct<key:string,name:string,line:string,how:string>>")
    file = F.when(own == "sstr", capture).when(own.isin(READ), F.array(_action("t", "Text", sh("cat ", word)))).when(own.isin(PLAYED), F.array(_action("p", "Play", sh(f"{player} ", word), "background"))).otherwise(none)
    return F.when(kind == "queued", queued).when((kind == "folder") & (F.col("captures") > 0), folder).when(kind == "file", file).otherwise(none)


def line_for(found: Column, to_shelf: Column) -> Column:
    """The line at the window's foot."""
    what = F.when(to_shelf, F.lit("Services to the Shelf:")).otherwise(F.lit("Services:"))
    shown = F.array_join(F.transform(found, lambda a: F.concat(F.lit("  "), a["key"], F.lit(" "), a["name"])), "")
    return F.concat(what, F.when(F.size(found) == 0, F.lit("  (nothing to send)")).otherwise(shown))


def shelf_line(names: Column) -> Column:
    """What the shelf holds."""
    return F.when(F.size(names) == 0, F.lit("Shelf: nothing picked yet -- Space picks the selection")).otherwise(F.concat(F.lit("Shelf:"), F.array_join(F.transform(names, lambda n: F.concat(F.lit(" ["), n, F.lit("]"))), "")))


def shared(targets: DataFrame) -> DataFrame:
    """(owner, key, name) from (owner, pos, found): the actions of several targets, the first of each key."""
    each = targets.select("owner", "pos", F.posexplode("found").alias("at", "a"))
    return each.groupBy("owner", "a.key").agg(F.min_by("a.name", F.struct("pos", "at")).alias("name"), F.min(F.struct("pos", "at")).alias("place"))


def with_sidecar(captures: DataFrame, texts: DataFrame) -> DataFrame:
    """captures (path) and the path of the text file beside each that has its stem, null without one."""
    stems = texts.select(T.stem(F.col("path")).alias("stem"), F.col("path").alias("text")).where(T.extension(F.col("text")) == ".txt")
    one = stems.groupBy("stem").agg(F.min("text").alias("text"))
    return captures.withColumn("stem", T.stem(F.col("path"))).join(one, "stem", "left").drop("stem")


def played(records: DataFrame, start: float = 0.0, zero_gaps: bool = False) -> DataFrame:
    """What playing writes of records (stream, seq, t_us, flags, plain_len, data), data null where it is lost.

    Records before `start` seconds are counted, not written. A lost one is written as zeros if asked, its length is known and it was not deflated.
    """
    zeros = F.unhex(F.repeat(F.lit("00"), F.col("plain_len").cast("int")))
    filled = F.when(F.lit(zero_gaps) & (F.col("plain_len") > 0) & (F.col("flags").bitwiseAND(F.lit(1)) == 0), zeros)
    late = F.col("data").isNull() | (F.col("t_us") >= F.lit(int(start * 1_000_000)))
    return records.withColumn("out", F.when(late, F.coalesce("data", filled))).where(F.col("out").isNotNull()).select("stream", "seq", "out")


def exported(captures: DataFrame, there: DataFrame, force: bool = False, into: str | None = None) -> DataFrame:
    """The plan of an export: captures (path, content_type, verdict, bytes, length) with target and outcome: skipped, done, damaged or failed.

    A target that is there already is left alone unless forced; a capture that doesn't verify keeps its bytes beside, under a name of their own.
    """
    name = F.concat(T.stem(T.basename(F.col("path"))), F.lit("."), T.extension_for(F.col("content_type")))
    folder = F.lit(into) if into else F.substring(F.col("path"), F.lit(1), F.length("path") - F.length(T.basename(F.col("path"))) - 1)
    out = captures.withColumn("target", F.concat(folder, F.lit("/"), name)).join(there.select(F.col("path").alias("target"), F.lit(True).alias("there")).distinct(), "target", "left")
    state = F.when(F.col("there") & ~F.lit(force), F.lit("skipped")).when(F.col("verdict") == 0, F.lit("done")).when(F.col("bytes") > 0, F.lit("damaged")).otherwise(F.lit("failed"))
    return out.select("path", "target", state.alias("outcome"), "bytes", "length")


def tally(plan: DataFrame, remove: bool = False) -> DataFrame:
    """One row: done, skipped, failed, bytes written, bytes freed."""
    done = F.col("outcome") == "done"
    return plan.agg(F.count_if(done).alias("done"), F.count_if(F.col("outcome") == "skipped").alias("skipped"), F.count_if(F.col("outcome").isin("damaged", "failed")).alias("failed"), F.coalesce(F.sum(F.when(done, F.col("bytes"))), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.when(done & F.lit(remove), F.col("length"))), F.lit(0)).alias("freed"))


def proved(copies: DataFrame) -> DataFrame:
    """Copies (path, verdict, payload_sha256, file_sha256) that may take the original's place: they verify and play back as the file."""
    return copies.withColumn("kept", (F.col("verdict") == 0) & F.col("payload_sha256").eqNullSafe(F.col("file_sha256")))
