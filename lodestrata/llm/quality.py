"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pairwise part costs time linear in
the number of inputs: half the sum over factors of (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2.

Inputs: each distinct word's hashed bucket with its damped count, scaled to unit length; STATS, numbers
about the text's make-up; and n_chars, the one metadata column that isn't barred. Labels, language,
source and id are never inputs.

The model is fitted on the driver to TRAIN_ROWS labelled rows at most, those with the smallest hash of
their id; only their hashed inputs go there, at most WORDS_KEPT distinct buckets of each.

Defined results: a null text counts as empty, a null n_chars as the text's length. With labels of no
or one kind, every score is the share of good labels (0.5 without labels). Empty texts get a score.
Rows keep their repeats. score() adds the column `score` and leaves out one of that name that df has;
accepted() returns df's own columns as they are, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import LOWER, SPACE, blocks, documents, flat, lean, numbered, owners, remainder, span_hashes, sums_by, with_fields, words

BUCKETS = 1 << 15
FACTORS = 8
TRAIN_ROWS = 8000
EPOCHS = 6
#: Of the fit, at least.
STEPS = 300
STATS = ["bias", "log_words", "log_bytes", "mean_word", "upper", "digit", "punct", "odd", "space", "high", "lines", "distinct", "top_word", "same_as_last", "long_word", "all_caps", "symbol_end", "few_words", "n_chars"]
_KIND = np.zeros(256, np.int8)
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[ord(c) for c in ".,;:!?'\"()-"]] = 3
_KIND[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 4
_KIND[SPACE] = 5
_KIND[128:] = 6
_KIND[10] = 7


def inputs(texts: pa.ChunkedArray, n_chars: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Statistics (rows by STATS), and for the hashed words of all rows: n+1 counts, buckets, values."""
    data, offs = flat(texts)
    n, size = len(offs) - 1, np.maximum(np.diff(offs), 1).astype(np.float64)
    starts, ends, before = words(data, offs)
    who, many = owners(before), np.diff(before)
    word = np.maximum(many, 1).astype(np.float64)
    kind = _KIND[data]
    share = {k: sums_by((kind == k).astype(np.int64), offs) / size for k in range(1, 8)}
    hashes = span_hashes(LOWER[data], starts, ends)
    order = np.lexsort((hashes, who))
    h, w = hashes[order], who[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
    at = np.flatnonzero(first)
    count = np.diff(np.append(at, len(h)))
    owner, bucket = w[at], (h[at] >> np.uint64(49)).astype(np.int64) % BUCKETS
    value = np.log1p(count)
    counts = np.bincount(owner, minlength=n)
    norm = np.sqrt(np.bincount(owner, value**2, n))
    value /= norm[owner] if len(owner) else 1
    top = np.zeros(n)
    np.maximum.at(top, owner, count)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (who[1:] == who[:-1])
    length = (ends - starts).astype(np.float64)
    upper = np.append(0, np.cumsum(kind == 1))
    caps = (upper[ends] - upper[starts] >= 0.6 * length) & (length > 1)
    odd_end = np.isin(kind[ends - 1], [4]) if len(ends) else np.zeros(0, bool)
    chars = np.array([size[i] if c is None else c for i, c in enumerate(n_chars.to_pylist())], np.float64)
    per_word = lambda x: np.bincount(who, x, n) / word
    out = np.stack(
        [np.ones(n), np.log1p(many) / 8, np.log1p(size) / 10, per_word(length) / 8, share[1] * 4, share[2] * 4, share[3] * 4, share[4] * 4, share[5] * 4, share[6] * 4, np.minimum(share[7] * 40, 3), counts / word, top / word, per_word(again), per_word(length > 20) * 4, per_word(caps), per_word(odd_end), 1 / (1 + many), np.log1p(np.maximum(chars, 0)) / 10],
        axis=1,
    )
    return out, np.append(0, np.cumsum(counts)), bucket, value


class Machine:
    """Weights of the factorisation machine; columns 0 to len(STATS) - 1 are the statistics, the rest the buckets."""

    def __init__(self, rate: float = 0.5):
        draw = np.random.default_rng(7)
        self.w = np.zeros(len(STATS) + BUCKETS, np.float32)
        self.v = draw.normal(0, 0.02, (len(STATS) + BUCKETS, FACTORS)).astype(np.float32)
        self.rate = rate
        self.fitted = False

    def parts(self, stats, before, bucket, value):
        """Linear part and factor sums of all rows, in time linear in the inputs."""
        s, x = len(STATS), value[:, None].astype(np.float32)
        own = self.v[s + bucket] * x
        q = stats @ self.v[:s] + sums_by(own, before)
        square = (stats**2) @ (self.v[:s] ** 2) + sums_by(own**2, before)
        return stats @ self.w[:s] + sums_by(self.w[s + bucket] * value, before) + 0.5 * (q**2 - square).sum(axis=1), q

    def score(self, stats, before, bucket, value) -> np.ndarray:
        if not self.fitted:
            return np.full(len(stats), self.rate)
        z, _ = self.parts(stats, before, bucket, value)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, stats, before, bucket, value, label, epochs: int = EPOCHS, step: float = 0.05, batch: int = 128, l2: float = 1e-5) -> Machine:
        """Adagrad on the log loss, rows in a fixed random order."""
        s, draw = len(STATS), np.random.default_rng(11)
        gw, gv = np.full_like(self.w, 1e-3), np.full_like(self.v, 1e-3)
        per_epoch = max(1, len(label) // batch)
        for _ in range(max(epochs, -(-STEPS // per_epoch))):
            for rows in np.array_split(draw.permutation(len(label)), per_epoch):
                n = before[rows + 1] - before[rows]
                at = np.repeat(before[rows] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
                b, x, who = bucket[at], value[at], np.repeat(np.arange(len(rows)), n)
                z, q = self.parts(stats[rows], np.append(0, np.cumsum(n)), b, x)
                error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[rows]
                cols, place = np.unique(b, return_inverse=True)
                ex = error[who] * x
                near = np.zeros((len(cols), FACTORS))
                own = self.v[s + b]
                for f in range(FACTORS):
                    near[:, f] = np.bincount(place, ex * (q[who, f] - own[:, f] * x), len(cols))
                flat_near = (error[:, None, None] * stats[rows][:, :, None] * (q[:, None, :] - self.v[None, :s] * stats[rows][:, :, None])).sum(axis=0)
                for which, dw, dv in ((np.arange(s), error @ stats[rows], flat_near), (s + cols, np.bincount(place, ex, len(cols)), near)):
                    dw, dv = dw / len(rows) + l2 * self.w[which], dv / len(rows) + l2 * self.v[which]
                    gw[which] += dw**2
                    gv[which] += dv**2
                    self.w[which] -= step * dw / np.sqrt(gw[which])
                    self.v[which] -= step * dv / np.sqrt(gv[which])
        self.fitted = True
        return self


def _chars(df: DataFrame):
    return F.col("n_chars").cast("long") if "n_chars" in df.columns else F.lit(None).cast("long")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> Machine:
    """From `rows` labelled documents at most; rows that are held out (remainder 2 of 4) are no part of it."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", 4) != 2)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select(F.col("doc_id").alias("l_"), F.col("quality").alias("q_"))
    own = docs.select(F.col(id_col).alias("i_"), F.col(text).alias("t_"), _chars(docs).alias("m_"))
    chosen = own.join(F.broadcast(picked), F.col("i_") == F.col("l_")).select("t_", "m_", F.col("q_").cast("int").alias("q_"))

    def run(batches):
        for t in blocks(batches, text="t_"):
            stats, before, bucket, value = inputs(t["t_"], t["m_"])
            out = {"stats": [], "bucket": [], "value": []}
            for i in range(len(t)):
                lo, hi = before[i], before[i + 1]
                for k, x, kind in (("stats", stats[i], "<f4"), ("bucket", bucket[lo:hi], "<i4"), ("value", value[lo:hi], "<f4")):
                    out[k].append(x.astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([*(pa.array(out[k], pa.binary()) for k in out), t["q_"].combine_chunks()], ["stats", "bucket", "value", "label"])

    got = chosen.mapInArrow(lean(run), "stats binary, bucket binary, value binary, label int").toArrow().sort_by([("stats", "ascending"), ("bucket", "ascending"), ("label", "ascending")])
    label = np.array(got["label"].to_pylist(), np.float64) > 0
    model = Machine(0.5 if not len(label) else float(label.mean()))
    if len(label) and 0 < label.mean() < 1:
        n = [len(x) // 4 for x in got["bucket"].to_pylist()]
        stats = np.frombuffer(b"".join(got["stats"].to_pylist()), "<f4").reshape(-1, len(STATS)).astype(np.float64)
        bucket = np.frombuffer(b"".join(got["bucket"].to_pylist()), "<i4").astype(np.int64)
        value = np.frombuffer(b"".join(got["value"].to_pylist()), "<f4").astype(np.float64)
        model.fit(stats, np.append(0, np.cumsum(n)), bucket, value, label.astype(np.float64))
    return model


def _scored(df: DataFrame, model: Machine, text: str, at_least: float | None) -> DataFrame:
    """df's columns by number, and `score`; with at_least, only the rows that reach it."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    src = numbered(df, t_=F.col(f"`{text}`"), m_=_chars(df))

    def run(batches):
        for t in blocks(batches, text="t_"):
            out = t.drop(["t_", "m_"]).append_column("score", pa.array(shared.value.score(*inputs(t["t_"], t["m_"])), pa.float64()))
            yield from (out if at_least is None else out.filter(pc.greater_equal(out["score"], at_least))).to_batches()

    return src.mapInArrow(lean(run), with_fields(src.drop("t_", "m_"), score=T.DoubleType()))


def score(df: DataFrame, model: Machine, text: str = "text") -> DataFrame:
    """df with the column score after its own."""
    rest = df.select(*[F.col(f"`{c}`") for c in df.columns if c != "score"])
    return _scored(rest, model, text, None).toDF(*rest.columns, "score")


def accepted(df: DataFrame, model: Machine, at_least: float, text: str = "text") -> DataFrame:
    """The rows of df whose score is at_least or more, with df's columns alone."""
    return _scored(df, model, text, at_least).drop("score").toDF(*df.columns)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs.select("doc_id", "text", "n_chars", (remainder("doc_id", 4) == 2).alias("held_out")), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
