"""Settings files: lines KEY=VALUE, read in the order of their files, and edited line by line.

Defined results: a missing file has no lines; blank lines, comments and lines without = set nothing; of a key's lines
in one file the last counts; a later file beats an earlier one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lodestrata.functions import text as T

# The settings in the order in which they are shown, with the values they can have, and what holds where nothing is said.
SETTINGS = ["OUTPUT", "ARCHIVE_DIR", "SSTR_KEY", "SSTR_DEFLATE", "DIR", "PLAYER", "SERVE", "AUTOSTART", "SUBS", "WARM", "COMMENTS", "POLL", "FORMAT", "PROFILE", "KEYRING"]
CHOICES = {"OUTPUT": ["sstr", "mp4", "both"], "SSTR_DEFLATE": ["yes", "no"], "AUTOSTART": ["on", "off"], "WARM": ["on", "off"]}
DEFAULTS = {"OUTPUT": "sstr", "SSTR_DEFLATE": "no", "PLAYER": "mpv", "SERVE": "127.0.0.1:8080", "WARM": "on", "COMMENTS": "200", "POLL": "1", "PROFILE": "Default", "KEYRING": "", "AUTOSTART": "off"}
SOURCES = ["default", "media.conf", "ytq/config"]


def expand_user(x: Column, home: str) -> Column:
    """~ at the start as the home folder."""
    return F.when((x == "~") | F.startswith(x, F.lit("~/")), F.concat(F.lit(home.rstrip("/")), F.substring(x, F.lit(2), F.length(x)))).otherwise(x)


def pairs(lines: DataFrame, home: str = "") -> DataFrame:
    """(line_no, key, value) of lines (line_no, value) that set a key."""
    line = T.py_strip(F.col("value"))
    key = F.upper(T.py_strip(F.substring_index(line, "=", 1)))
    value = F.trim(T.py_strip(F.substring(line, F.instr(line, "=") + 1, F.length(line))), F.lit('"'))
    return lines.where((line != "") & ~F.startswith(line, F.lit("#")) & F.contains(line, F.lit("="))).select("line_no", key.alias("key"), expand_user(value, home).alias("value"))


def read(spark: SparkSession, paths: list[str], home: str = "") -> DataFrame:
    """(weight, line_no, key, value) of the files, each later one with more weight."""
    out = spark.createDataFrame([], "weight int, line_no int, key string, value string")
    for weight, path in enumerate(paths, 1):
        try:
            whole = spark.read.text(path, wholetext=True)
        except AnalysisException:  # no such file
            continue
        lines = whole.select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))
        out = out.unionByName(pairs(lines, home).select(F.lit(weight).alias("weight"), "line_no", "key", "value"))
    return out


def in_force(found: DataFrame) -> DataFrame:
    """(key, value, source, place) of SETTINGS in their order: what the found lines say, else the default."""
    spark = found.sparkSession
    known = spark.createDataFrame([(i, k, DEFAULTS.get(k, "")) for i, k in enumerate(SETTINGS)], "place int, key string, own string")
    best = found.groupBy("key").agg(F.max_by(F.struct("value", "weight"), F.struct("weight", "line_no")).alias("x"))
    both = known.join(best, "key", "left")
    source = F.coalesce(F.get(F.array(*[F.lit(s) for s in SOURCES]), F.col("x.weight")), F.lit(SOURCES[0]))
    return both.select("key", F.coalesce("x.value", "own").alias("value"), source.alias("source"), "place")


def output_of(x: Column) -> Column:
    """What a finished download leaves: mp4, both, else sstr."""
    low = F.lower(F.trim(x))
    return F.when(low.isin("mp4", "both"), low).otherwise(F.lit("sstr"))


def comments_of(x: Column) -> Column:
    """The limit as it is set, the default where it isn't; set to nothing means none."""
    return F.coalesce(F.trim(x), F.lit(DEFAULTS["COMMENTS"]))


def warm_of(x: Column) -> Column:
    return ~F.coalesce(F.lower(F.trim(x)).isin("off", "no", "0", "false"), F.lit(False))


def archive_of(archive: Column, folder: Column) -> Column:
    """Where captures go: the archive's folder, else the downloads'."""
    return F.coalesce(F.when(F.trim(archive) != "", archive), folder, F.lit(""))


def next_value(key: Column, now: Column) -> Column:
    """What the next choice of a setting is; null where it is typed."""
    out = F.lit(None).cast("string")
    for k, names in CHOICES.items():
        at = F.array_position(F.array(*[F.lit(n) for n in names]), F.lower(now))
        after = F.get(F.array(*[F.lit(n) for n in names]), (at % len(names)).cast("int"))
        # an unknown value stands for the last choice, and for off
        first = F.lit(names[0])
        out = F.when(key == k, F.when(at == 0, first).otherwise(after)).otherwise(out)
    return out


def edited(lines: DataFrame, key: str, value: str | None) -> DataFrame:
    """lines (line_no, value) with the key set to value, or taken out: its first line is replaced, further ones go, and one is appended where there was none."""
    key = key.upper()
    line = T.py_strip(F.col("value"))
    ours = ~F.startswith(line, F.lit("#")) & F.contains(line, F.lit("=")) & (F.upper(T.py_strip(F.substring_index(line, "=", 1))) == key)
    whole = Window.partitionBy(F.lit(0))  # of one file that a person edits
    marked = lines.withColumn("ours", ours).withColumn("first", F.min(F.when(F.col("ours"), F.col("line_no"))).over(whole))
    if value is None:
        return marked.where("not ours").select("line_no", "value")
    new = F.lit(f"{key}={value}")
    kept = marked.where("not ours or line_no = first").select("line_no", F.when(F.col("ours"), new).otherwise(F.col("value")).alias("value"))
    added = marked.agg(F.count_if("ours").alias("n"), F.coalesce(F.max("line_no") + 1, F.lit(0)).alias("line_no")).where("n = 0")
    return kept.unionByName(added.select(F.col("line_no").cast(lines.schema["line_no"].dataType), new.alias("value")))
