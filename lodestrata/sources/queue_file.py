"""The queue's file: a JSON array of entries, and log files with their tail.

Defined results: a file that can't be read or holds no array is an empty queue; a field of another kind is null.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lodestrata.functions import text as T
from lodestrata.operators import queue

#: Bytes from a log's end that a reader begins with, and lines that it shows.
SEED_BYTES = 1 << 16
SEED_LINES = 200


def read(spark: SparkSession, path: str) -> DataFrame:
    """Entries with their place `pos`."""
    empty = spark.createDataFrame([], f"pos int, {queue.SCHEMA}")
    try:
        whole = spark.read.text(path, wholetext=True)
    except AnalysisException:  # no such file
        return empty
    items = F.when(F.regexp_like("value", F.lit(r"(?s)\A\s*\[.*\]\s*\z")), F.from_json("value", f"array<struct<{queue.SCHEMA.replace(' ', ':')}>>".replace(",:", ",")))
    return whole.select(F.posexplode(items).alias("pos", "e")).select("pos", "e.*")


def write(entries: DataFrame, path: str) -> None:
    """The entries in order of `pos`, as one file that takes the old one's place at once. A queue is what people typed, so it is small."""
    spark = entries.sparkSession
    rows = [json.loads(r.j) for r in entries.orderBy("pos").select(F.to_json(F.struct(*[c for c in entries.columns if c != "pos"]), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator()]
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs = target.getFileSystem(conf)
    fs.setWriteChecksum(False)  # other programs write this file too
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(rows, indent=1).encode()))
    out.close()
    fs.delete(target, False)
    fs.rename(part, target)


def log_seed(spark: SparkSession, path: str, size: int = SEED_BYTES, lines: int = SEED_LINES) -> DataFrame:
    """(path, line_no, line) of the last lines in the last bytes of each log; a first line that is cut off is left out."""
    files = spark.read.format("binaryFile").load(path)
    start = F.greatest(F.col("length") - size, F.lit(0))
    tail = F.substring("content", F.lit(1) + start.cast("int"), F.lit(size)).cast("string")
    every = T.split_lines(tail)
    whole = F.when(start > 0, F.slice(every, 2, F.size(every))).otherwise(every)
    last = F.slice(whole, F.greatest(F.size(whole) - lines + 1, F.lit(1)), F.lit(lines))
    return files.select("path", F.posexplode(last).alias("line_no", "line"))
