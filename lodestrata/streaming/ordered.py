"""Records in order: a buffer that waits for missing numbers by count, not by time.

Rows (stream, seq, body) arrive in any order. Each stream's are given out by seq; a number that lacks is waited for
until one more than HOLD above it has come, then it is told as lost. A number that was given out or is held already is
a repeat and dropped, so a record that comes back too late stays lost. State for each stream: the next number, the
largest one, and at most HOLD + 1 records besides one batch's own.

Defined results: rows with a null stream are a stream of their own; a null seq is left out; of repeats the one with a
body that comes first stays. The end of a stream is not seen: what still waits is in the state, or comes with the
batch form.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Fixed value: numbers above a missing one before it counts as lost.
HOLD = 40

OUT = "stream string, seq long, body binary, lost boolean"
STATE = "next long, top long, seqs array<long>, bodies array<binary>"


def given_out(held: dict[int, bytes | None], nxt: int, top: int, hold: int = HOLD, force: bool = False) -> tuple[list[tuple[int, bytes | None, bool]], int]:
    """What leaves the buffer from nxt on, as (seq, body, lost), and the new next number; held loses what leaves."""
    out = []
    while nxt <= top:
        if held.get(nxt) is not None:
            out.append((nxt, held.pop(nxt), False))
        elif force or top - nxt > hold:
            held.pop(nxt, None)
            out.append((nxt, None, True))
        else:
            break
        nxt += 1
    return out, nxt


def _taken(held: dict[int, bytes | None], nxt: int, seqs, bodies) -> int:
    """Puts rows into the buffer; the largest number among them."""
    top = -1
    for seq, body in zip(seqs, bodies, strict=True):
        if seq >= nxt and held.get(seq) is None:
            held[seq] = body
            top = max(top, seq)
    return top


def reordered(records: DataFrame, hold: int = HOLD) -> DataFrame:
    """Streaming: (stream, seq, body, lost) in order within each stream."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        nxt, top, seqs, bodies = state.get if state.exists else (0, -1, [], [])
        held = dict(zip(seqs, bodies, strict=True))
        for b in batches:
            own = b.sort_values("seq", kind="stable")
            top = max(top, _taken(held, nxt, own["seq"].tolist(), own["body"].tolist()))
            out, nxt = given_out(held, nxt, top, hold)
            yield pd.DataFrame([(key[0], *r) for r in out], columns=["stream", "seq", "body", "lost"])
        state.update((nxt, top, list(held), list(held.values())))

    rows = records.where("seq is not null").select(F.col("stream").cast("string"), F.col("seq").cast("long"), "body")
    return rows.groupBy("stream").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def settled(records: DataFrame) -> DataFrame:
    """The batch form: every number from 0 to a stream's largest, once, with its body or lost.

    Lost numbers come from gaps between neighbours, so a stream's rows are ordered but never gathered.
    """
    from pyspark.sql import Window

    rows = records.where("seq is not null").select(F.col("stream").cast("string"), F.col("seq").cast("long"), "body")
    one = rows.groupBy("stream", "seq").agg(F.first("body", ignorenulls=True).alias("body"))
    before = F.coalesce(F.lag("seq").over(Window.partitionBy("stream").orderBy("seq")), F.lit(-1).cast("long"))
    gaps = one.select("stream", (before + 1).alias("from"), "seq").where("seq > from")
    missing = gaps.select("stream", F.explode(F.sequence("from", F.col("seq") - 1)).alias("seq"))
    return one.withColumn("lost", F.col("body").isNull()).unionByName(missing.select("stream", "seq", F.lit(None).cast("binary").alias("body"), F.lit(True).alias("lost")))
