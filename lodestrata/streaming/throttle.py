"""Throttles, triggers and steps over unbounded tables.

Each keeps one small row of state a key. Defined results: rows of one batch are taken in the order of their time, ties as
they came; a null time is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestrata.operators import live


def sampled(samples: DataFrame, every: float = live.SAMPLE_S) -> DataFrame:
    """Of samples (url, at, finished): each that finishes a part, else one as soon as `every` seconds have gone since the last such."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else float("-inf")
        for b in batches:
            own = b.sort_values("at", kind="stable")
            keep = []
            for at, done in zip(own["at"], own["finished"], strict=True):
                due = not done and at - last >= every
                last = at if due else last
                keep.append(bool(done) or due)
            yield own[keep]
        if last > float("-inf"):
            state.update((last,))

    rows = samples.where("at is not null").selectExpr("cast(url as string) url", "cast(at as double) at", "coalesce(finished, false) finished")
    return rows.groupBy("url").applyInPandasWithState(run, "url string, at double, finished boolean", "last double", "append", GroupStateTimeout.NoTimeout)


def checkpoints(hashed: DataFrame, records: int = 64, seconds: float = 10.0) -> DataFrame:
    """(stream, seq, n): the record after which a checkpoint is due, and how many it covers: as many as `records`, or any after `seconds` since the last."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, since = state.get if state.exists else (0, None)
        for b in batches:
            out = []
            for at, seq in b.sort_values("at", kind="stable")[["at", "seq"]].itertuples(index=False):
                since, n = at if since is None else since, n + 1
                if n >= records or at - since >= seconds:
                    out.append((key[0], int(seq), n))
                    n, since = 0, at
            yield pd.DataFrame(out, columns=["stream", "seq", "n"]).astype({"seq": "int64", "n": "int64"})
        state.update((n, since))

    rows = hashed.where("at is not null").selectExpr("cast(stream as string) stream", "cast(at as double) at", "cast(seq as long) seq")
    return rows.groupBy("stream").applyInPandasWithState(run, "stream string, seq long, n long", "n long, since double", "append", GroupStateTimeout.NoTimeout)


def changes(values: DataFrame) -> DataFrame:
    """Of (key, at, value) those whose value differs from the one before."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, last = state.get if state.exists else (False, None)
        for b in batches:
            own = b.sort_values("at", kind="stable")
            keep = []
            for v in own["value"]:
                keep.append(not seen or v != last)
                seen, last = True, v
            yield own[keep]
        state.update((seen, last))

    rows = values.where("at is not null").selectExpr("cast(key as string) key", "cast(at as double) at", "cast(value as string) value")
    return rows.groupBy("key").applyInPandasWithState(run, "key string, at double, value string", "seen boolean, last string", "append", GroupStateTimeout.NoTimeout)


def confirmed(presses: DataFrame, within: float = 5.0) -> DataFrame:
    """Of presses (key, at) those that confirm the one before, as they come within so many seconds of it; a confirmed one begins anew."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        armed = state.get[0] if state.exists else None
        for b in batches:
            own = b.sort_values("at", kind="stable")
            keep = []
            for at in own["at"]:
                hit = armed is not None and at - armed <= within
                keep.append(hit)
                armed = None if hit else at
            yield own[keep]
        state.update((armed,))

    rows = presses.where("at is not null").selectExpr("cast(key as string) key", "cast(at as double) at")
    return rows.groupBy("key").applyInPandasWithState(run, "key string, at double", "armed double", "append", GroupStateTimeout.NoTimeout)


def phases(lines: DataFrame) -> DataFrame:
    """Steps of downloads from their tool's lines (url, at, line), as live.steps() gives them, with the state between batches."""
    from pyspark.sql import functions as F

    own = lines.where(live.routed(F.col("line"))["tag"] == "own").select(F.col("url").cast("string"), F.col("at").cast("double"), live.step_of(F.col("line")).alias("s")).where("s.phase is not null and at is not null").select("url", "at", "s.*")

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        phase, part, formats = state.get if state.exists else (None, 0, None)
        for b in batches:
            out = []
            for r in b.sort_values("at", kind="stable").itertuples(index=False):
                now = part + int(r.new_part)
                formats = r.formats if isinstance(r.formats, str) else formats
                if (r.phase, now) != (phase, part):
                    out.append((key[0], r.at, r.phase, now, formats))
                phase, part = r.phase, now
            yield pd.DataFrame(out, columns=["url", "at", "phase", "part", "formats"]).astype({"at": "float64", "part": "int64"})
        state.update((phase, part, formats))

    return own.groupBy("url").applyInPandasWithState(run, "url string, at double, phase string, part long, formats string", "phase string, part long, formats string", "append", GroupStateTimeout.NoTimeout)
