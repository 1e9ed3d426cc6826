"""Language identification by rank-order profiles.

A profile lists the most frequent byte n-grams (n = 1 to 3) of a language, most frequent first. A text's
own list is compared with each profile: every n-gram counts by how far out of place it stands, one
that the profile lacks counts as TOP. The language with the smallest sum wins; score is 1 less the sum
over its largest possible value.

Texts are lower-cased; each run of ASCII bytes other than letters is one gap, which n-grams keep as a
word's edge. Profiles come from all training texts. Ties between n-grams go to the smaller code, ties
between languages to the smaller name.

Defined results: a text that is null or has no letter is `und` with score 0; so is every text if there
is nothing to learn from. Rows keep their repeats; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import LOWER, blocks, documents, flat, lean, numbered, remainder, with_fields

TOP = 400
UNKNOWN = "und"
_GAP = np.ones(256, bool)
_GAP[97:123] = _GAP[128:] = False


def grams(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of text number (8 bits) and n-gram (24 bits), and their counts; 256 texts at most."""
    data, offs = flat(pc.utf8_lower(texts.fill_null("")))
    data = LOWER[data]
    data[_GAP[data]] = 32
    n = np.diff(offs)
    # every text stands between gaps; gaps in a row become one
    wide = np.full(len(data) + len(n) + 1, 32, np.uint8)
    who = np.repeat(np.arange(len(n), dtype=np.uint32), n)
    wide[np.arange(len(data)) + who + 1] = data
    owner = np.empty(len(wide), np.uint32)
    owner[0] = 0
    owner[1:] = np.repeat(np.arange(len(n), dtype=np.uint32), n + 1)
    keep = np.ones(len(wide), bool)
    keep[1:] = (wide[1:] != 32) | (wide[:-1] != 32)
    wide, owner = wide[keep].astype(np.uint32), owner[keep]
    top, a, b, c = owner << np.uint32(24), wide[:-2], wide[1:-1], wide[2:]
    mid = b != 32
    keys = [(top[1:-1] | a << np.uint32(16) | b << np.uint32(8) | c)[mid], (top[1:-1] | b << np.uint32(16))[mid], (top[:-1] | wide[:-1] << np.uint32(16) | wide[1:] << np.uint32(8))[(wide[:-1] != 32)], (top[1:] | wide[:-1] << np.uint32(16) | wide[1:] << np.uint32(8))[wide[:-1] == 32]] if len(wide) > 2 else [np.zeros(0, np.uint32)]
    return np.unique(np.concatenate(keys), return_counts=True)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def packed(parts):
        code, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return code, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)

    for t in blocks(batches, rows=256):
        keys, counts = grams(t["text"])
        langs = np.array(t["lang"].to_pylist(), object)[keys >> 24]
        for lang in set(t["lang"].to_pylist()):
            own = held.setdefault(lang, [])
            own.append(packed([((keys & 0xFFFFFF)[langs == lang], counts[langs == lang])]))
            if len(own) > 64:
                held[lang] = [packed(own)]
    for lang, parts in held.items():
        code, n = packed(parts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int32)), pa.array(n)], ["lang", "code", "n"])


def profiles(train: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP) -> dict[str, np.ndarray]:
    """The top n-grams of each language over all of train; a few thousand numbers for each language."""
    rows = train.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = rows.mapInArrow(lean(_counted), "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    best = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    out: dict[str, list[int]] = {}
    for r in best.orderBy("lang", "place").collect():
        out.setdefault(r.lang, []).append(r.code)
    return {k: np.array(v, np.int64) for k, v in sorted(out.items())}


def distances(texts: pa.ChunkedArray, known: dict[str, np.ndarray], top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """Out-of-place sums (language by text) and the number of n-grams that each text is judged by."""
    keys, counts = grams(texts)
    order = np.sort((keys >> 24).astype(np.uint64) << np.uint64(56) | (np.uint64((1 << 32) - 1) - counts.astype(np.uint64)) << np.uint64(24) | (keys & 0xFFFFFF))
    who = (order >> np.uint64(56)).astype(np.int64)
    before = np.searchsorted(who, np.arange(len(texts) + 1))
    place = np.arange(len(order)) - before[who]
    pick = place < top
    who, place, code = who[pick], place[pick], (order[pick] & np.uint64(0xFFFFFF)).astype(np.int64)
    every = np.unique(np.concatenate(list(known.values())))
    at = np.minimum(np.searchsorted(every, code), len(every) - 1)
    there = every[at] == code
    out = np.empty((len(known), len(texts)))
    for i, own in enumerate(known.values()):
        rank = np.full(len(every), -1)
        rank[np.searchsorted(every, own)] = np.arange(len(own))
        far = np.where(there & (rank[at] >= 0), np.abs(rank[at] - place), top)
        out[i] = np.bincount(who, far, len(texts))
    return out, np.bincount(who, minlength=len(texts))


def _lettered(texts: pa.ChunkedArray) -> np.ndarray:
    data, offs = flat(texts)
    ascii_letter = np.append(0, np.cumsum(((LOWER[data] >= 97) & (LOWER[data] <= 122))))
    out = ascii_letter[offs[1:]] > ascii_letter[offs[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offs) > 0)):
        out[i] = any(c.isalpha() for c in texts[int(i)].as_py() or "")
    return out


def _predicted(df: DataFrame, known: dict[str, np.ndarray], text: str, top: int, named_only: bool) -> DataFrame:
    """df's columns by number, lang_pred and score; named_only leaves out UNKNOWN rows."""
    names, shared = list(known), df.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        for t in blocks(batches, text="t_", rows=256):
            pred, score = np.full(len(t), UNKNOWN, object), np.zeros(len(t))
            if names:
                far, n = distances(t["t_"], shared.value, top)
                best = far.argmin(axis=0)
                ok = _lettered(t["t_"]) & (n > 0)
                pred[ok] = np.array(names, object)[best[ok]]
                score[ok] = np.clip(1 - far[best, np.arange(len(t))][ok] / (n[ok] * top), 0, 1)
            out = t.drop(["t_"]).append_column("lang_pred", pa.array(pred, pa.string())).append_column("score", pa.array(score))
            yield from (out.filter(pa.array(pred != UNKNOWN)) if named_only else out).to_batches()

    src = numbered(df, t_=F.col(f"`{text}`"))
    return src.mapInArrow(lean(run), with_fields(src.drop("t_"), lang_pred=T.StringType(), score=T.DoubleType()))


def predict(df: DataFrame, known: dict[str, np.ndarray], text: str = "text", top: int = TOP) -> DataFrame:
    """df with lang_pred and score after its own columns; columns of these names that df has are left out."""
    rest = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("lang_pred", "score")])
    return _predicted(rest, known, text, top, False).toDF(*rest.columns, "lang_pred", "score")


def identified(df: DataFrame, known: dict[str, np.ndarray], text: str = "text", top: int = TOP) -> DataFrame:
    """The rows of df in a language that is known, with df's columns alone, whatever their names."""
    return _predicted(df, known, text, top, True).drop("lang_pred", "score").toDF(*df.columns)


def language_profiles(docs: DataFrame, id_col: str = "doc_id") -> dict[str, np.ndarray]:
    """From all rows with a language whose id's remainder mod 4 isn't 2."""
    return profiles(docs.where(remainder(id_col, 4) != 2))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = predict(docs.select("doc_id", "text").withColumn("held_out", remainder("doc_id", 4) == 2), language_profiles(docs))
    return out.select("doc_id", "held_out", "lang_pred", "score")
