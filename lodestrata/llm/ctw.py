"""Language-model scoring by context-tree weighting over bytes.

A text is its words, lower-cased in ASCII, joined by single spaces, then an end byte (0xFF, which UTF-8
never has). Each byte is eight binary decisions. For every context of 0 to DEPTH bytes and every prefix
of the coming byte, zeros and ones seen in training give a Krichevsky-Trofimov block probability Pe;
a context's weighted probability is Pw = Pe / 2 + (product of its children's Pw) / 2. The probability of
the next bit mixes the estimates at all depths of its path with the weights that follow from Pe / Pw.

A context is a node of its own if at least LEAST training bytes follow it; the rest of its siblings are one
node together. LEAST is a fixed count, so the tree grows with the corpus. It is never held whole: each block
of texts is written with its distinct strings of DEPTH bytes and the byte after them, and those are dealt by
their two newest context bytes, so that one task has every node below such a pair. What lies above, at most
256 contexts of one byte and the empty one, is summed for the driver. Probabilities go back to the blocks in
the order of their strings.

base_score is exact: word counts over all training texts, dealt and sent back in the same way.
`fit` builds the same model in the driver's memory, for small corpora and to check the tables by.
bits_per_byte is of the scored bytes: the words, the spaces between them and the end byte.

Defined results: a null text counts as empty, that is one end token. A null id counts as held out
(crc32 of the empty text). Without training texts base_score is 0 and every bit has probability 1/2.
Rows keep their repeats; ids keep their type; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import LOWER, blocks, documents, flat, mix, owners, remainder, span_hashes, sums_by, words, written

DEPTH = 6
#: Training bytes that follow a context with a node of its own; fixed, whatever the corpus.
LEAST = 2
#: Bytes of a block of texts, whose distinct strings are counted together.
TEXT_BYTES = 16 << 20
#: Buckets of strings for each partition of the input.
BUCKETS = 4
END = 255


def stream(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, each after `depth` end bytes as its first context; the places to predict; n+1 counts of those."""
    n, many = len(before) - 1, np.diff(before)
    size = ends - starts
    length = np.bincount(owners(before), size, n).astype(np.int64) + np.maximum(many, 1)
    base = np.append(0, np.cumsum(length + depth))
    out = np.full(base[-1], END, np.uint8)
    inside = np.append(0, np.cumsum(size + 1))
    first = base[:-1] + depth - inside[before[:-1]]
    at = inside[:-1] + first[owners(before)]
    take = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(at, size) + take] = data[np.repeat(starts, size) + take]
    sep = at + size
    last = np.zeros(len(starts), bool)
    last[before[1:][many > 0] - 1] = True
    out[sep[~last]] = 32
    counts = np.append(0, np.cumsum(length))
    where = np.arange(counts[-1]) + np.repeat(base[:-1] + depth - counts[:-1], length)
    return out, where, counts


def grams(data: np.ndarray, where: np.ndarray) -> np.ndarray:
    """The DEPTH bytes before each place, newest first, and the byte there, as one number."""
    key = np.zeros(len(where), np.int64)
    for i in range(DEPTH):
        key = key << 8 | data[where - 1 - i]
    return key << 8 | data[where]


class Tree:
    """Kept contexts by depth. child: the next node for an older byte; `inner` nodes come first, then leaves."""

    def __init__(self, contexts: list[list[bytes]]):
        """contexts[d]: contexts of d bytes, newest byte first; each one's first d - 1 bytes are in contexts[d - 1]."""
        self.contexts = contexts
        self.place = [{c: i for i, c in enumerate(level)} for level in contexts]

    def children(self, depth: int) -> np.ndarray:
        """For nodes at depth: place at depth + 1 by byte, or -1."""
        out = np.full((len(self.contexts[depth]), 256), -1, np.int32)
        for c, i in self.place[depth + 1].items():
            out[self.place[depth][c[:-1]], c[-1]] = i
        return out


def grown(key: np.ndarray, n: np.ndarray) -> tuple[Tree, list[np.ndarray]]:
    """From distinct strings and how often each was seen: the tree, and for each depth the counts of nodes by byte."""
    levels: list[list[bytes]] = [[b""]]
    counts = [np.bincount(key & 255, n, 256).astype(np.int64).reshape(1, 256)]
    for d in range(1, DEPTH + 1):
        own, run = np.unique(key >> 8 * (DEPTH + 1 - d), return_inverse=True)
        stay = np.bincount(run, n, len(own)) >= LEAST
        levels.append([int(c).to_bytes(d, "big") for c in own[stay]])
        here = np.zeros((len(own), 256), np.int64)
        np.add.at(here, (run, key & 255), n)
        counts.append(here[stay])
    return Tree(levels), counts


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma(x) for x >= 1/2: Stirling's series after a shift by 8."""
    shift = np.ones_like(x)
    for i in range(8):
        shift *= x + i
    y = x + 8
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - np.log(shift)


def _bits(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at each of the 255 prefixes of a byte, shortest first."""
    zero, one = [], []
    for k in range(8):
        part = counts.reshape(len(counts), 1 << k, 2, 1 << (7 - k)).sum(axis=3)
        zero.append(part[:, :, 0])
        one.append(part[:, :, 1])
    return np.concatenate(zero, axis=1).astype(np.float64), np.concatenate(one, axis=1).astype(np.float64)


def in_parts(f, counts: np.ndarray, rows: int = 1024) -> np.ndarray:
    """f(zeros, ones) of counts by byte, some rows at a time, so that the driver holds few intermediate arrays."""
    return np.concatenate([f(*_bits(counts[i : i + rows])) for i in range(0, max(len(counts), 1), rows)])


def log_block(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a block with so many zeros and ones."""
    return _log_gamma(zero + 0.5) + _log_gamma(one + 0.5) - _log_gamma(zero + one + 1) - np.log(np.pi)


def _byte_table(p_one: np.ndarray) -> np.ndarray:
    """log10 probability of each byte from the probability of a one at each prefix."""
    p_one = np.clip(p_one, 1e-12, 1 - 1e-12)
    up, down = np.log10(p_one), np.log10(1 - p_one)
    out = np.zeros((len(p_one), 256), np.float32)
    byte = np.arange(256)
    for k in range(8):
        at = (1 << k) - 1 + (byte >> (8 - k))
        out += np.where(byte >> (7 - k) & 1, up[:, at], down[:, at])
    return out


def weighted(tree: Tree, counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """(child, table, inner): nodes below `inner` branch by child[node, byte]; from it on they are leaves, table[node - inner] by byte."""
    depth = len(counts) - 1
    parent = [np.zeros(0, np.int64)] + [np.array([tree.place[d - 1][c[:-1]] for c in tree.contexts[d]], np.int64) for d in range(1, depth + 1)]

    def rest_of(d):
        rest = counts[d].copy()
        np.subtract.at(rest, parent[d + 1], counts[d + 1])
        return rest

    stop: list[np.ndarray] = [np.zeros(0)] * (depth + 1)
    below = in_parts(log_block, counts[depth])
    for d in range(depth - 1, -1, -1):
        split = in_parts(log_block, rest_of(d))
        np.add.at(split, parent[d + 1], below)
        own = in_parts(log_block, counts[d])
        np.logaddexp(own, split, out=split)
        split -= np.log(2)
        own -= np.log(2)
        stop[d] = np.exp(own - split).astype(np.float32)
        below = split
    del below, split, own
    sizes = [len(c) for c in counts]
    inner = sum(sizes[:-1])
    base = np.append(0, np.cumsum(sizes))
    child = np.empty((inner, 256), np.int32)
    table = np.empty((inner + sizes[-1], 256), np.float32)
    estimate = lambda z, o: ((o + 0.5) / (z + o + 1)).astype(np.float32)

    def fill(at, p_one):
        for i in range(0, len(p_one), 1024):
            table[at + i : at + i + len(p_one[i : i + 1024])] = _byte_table(p_one[i : i + 1024].astype(np.float64))

    seen, left = np.zeros((1, 255), np.float32), np.ones((1, 255), np.float32)
    for d in range(depth):
        if d:
            seen, left = seen[parent[d]], left[parent[d]]
        seen = seen + left * stop[d] * in_parts(estimate, counts[d])
        left = left * (1 - stop[d])
        fill(base[d], seen + left * in_parts(estimate, rest_of(d)))
        to = tree.children(d)
        leaf = inner + base[d] + np.arange(sizes[d])[:, None]
        target = base[d + 1] + to + (inner if d + 1 == depth else 0)
        child[base[d] : base[d + 1]] = np.where(to >= 0, target, leaf)
    if sizes[-1]:
        fill(inner, seen[parent[depth]] + left[parent[depth]] * in_parts(estimate, counts[depth]))
    return child, table, inner


def text_scores(data: np.ndarray, where: np.ndarray, before: np.ndarray, model: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """log10 probability of each text."""
    child, table, inner = model
    node = np.zeros(len(where), np.int64)
    live = np.arange(len(where))
    d = 0
    while len(live):
        node[live] = child[node[live], data[where[live] - 1 - d]]
        live, d = live[node[live] < inner], d + 1
    return sums_by(table[node - inner, data[where]].astype(np.float64), before)


def fit(train: DataFrame, text: str = "text"):
    """The whole tree in the driver's memory."""
    data, offs = flat(train.select(F.col(text).alias("t_")).toArrow()["t_"])
    data, where, _ = stream(LOWER[data], *words(LOWER[data], offs))
    return weighted(*grown(*np.unique(grams(data, where), return_counts=True)))


def _estimate(of: np.ndarray, both: np.ndarray) -> np.ndarray:
    return (of + 0.5) / (both + 1)


def mixtures(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted distinct strings with all that share their two newest bytes, and how often training has each:

    each of the eight bits' probability, mixed from depth 2 down (NaN if that context is no node); by newest byte,
    the sums of log Pw of its children at the 255 prefixes; and counts by byte, of all and of children that are no nodes.
    """
    many, byte = len(key), key & 255
    mixed = np.empty((8, many))
    below: list = [None] * 8
    inner = np.zeros(many, bool)
    for d in range(DEPTH, 1, -1):
        run = np.cumsum(np.diff(key >> 8 * (DEPTH + 1 - d), prepend=-1) != 0) - 1
        node = (np.bincount(run, n) >= LEAST)[run]
        at = run << 8 | byte
        order = np.argsort(at, kind="stable")
        at = at[order]
        for k in range(8):
            first = np.diff(at >> (8 - k), prepend=-1) != 0
            group, one = np.empty(many, np.int64), (byte >> (7 - k) & 1).astype(bool)
            group[order] = np.cumsum(first) - 1
            size, there = int(first.sum()), order[first]
            both, ones = np.bincount(group, n, size), np.bincount(group, n * one, size)
            block = log_block(both - ones, ones)
            bit = _estimate(np.where(one, ones[group], (both - ones)[group]), both[group])
            if d < DEPTH:
                rest, rest_ones = np.bincount(group, n * ~inner, size), np.bincount(group, n * (one & ~inner), size)
                child, value = below[k]
                split = log_block(rest - rest_ones, rest_ones) + np.bincount(group[child], value, size)
                both_ways = np.logaddexp(block, split)
                stop = np.exp(block - both_ways)[group]
                other = _estimate(np.where(one, rest_ones[group], (rest - rest_ones)[group]), rest[group])
                bit = stop * bit + (1 - stop) * np.where(inner, mixed[k], other)
                block = both_ways - np.log(2)
            mixed[k] = bit
            live = node[there]
            below[k] = there[live], block[live]
        inner = node
    mixed[:, ~inner] = np.nan
    newest = key >> 8 * DEPTH
    sums, counts = np.zeros((256, 255)), np.zeros((2, 256, 256))
    for k in range(8):
        child, value = below[k]
        np.add.at(sums, (newest[child], (1 << k) - 1 + (byte[child] >> (8 - k))), value)
    np.add.at(counts[0], (newest, byte), n)
    np.add.at(counts[1], (newest, byte), n * ~inner)
    return mixed.astype(np.float32), sums, counts


def above(sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By newest byte and prefix, for the bit one: what depths 0 and 1 add, the weight of what is below, and the estimate there if no node is."""
    node = counts[0].sum(axis=1) >= LEAST
    (z1, o1), (zr, er) = _bits(counts[0]), _bits(counts[1])
    own = log_block(z1, o1)
    both = np.logaddexp(own, log_block(zr, er) + sums)
    stop = np.exp(own - both)
    z0, o0 = _bits(counts[0].sum(axis=0, keepdims=True))
    zs, os_ = _bits(counts[0][~node].sum(axis=0, keepdims=True))
    own0 = log_block(z0, o0)
    stop0 = np.exp(own0 - np.logaddexp(own0, log_block(zs, os_) + (both - np.log(2))[node].sum(axis=0)))
    here, left = stop0 * _estimate(o0, z0 + o0), 1 - stop0
    add = here + left * np.where(node[:, None], stop * _estimate(o1, z1 + o1), _estimate(os_, zs + os_))
    return add, np.where(node[:, None], left * (1 - stop), 0.0), _estimate(er, zr + er)


def string_scores(key: np.ndarray, mixed: np.ndarray, top: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 probability of each string's last byte."""
    newest, byte, out = key >> 8 * DEPTH, key & 255, np.zeros(len(key))
    for k in range(8):
        at = newest, (1 << k) - 1 + (byte >> (8 - k))
        one = (byte >> (7 - k) & 1).astype(bool)
        add, left, rest = (t[at] for t in top)
        add, rest = np.where(one, add, 1 - left - add), np.where(one, rest, 1 - rest)
        out += np.log10(np.maximum(add + left * np.where(np.isnan(mixed[k]), rest, mixed[k]), 1e-12))
    return out


def _packed(x: np.ndarray) -> bytes:
    """Numbers as compressed planes of their bytes, after their length in bytes."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def _unpacked(data: bytes, kind) -> np.ndarray:
    size, kind = int.from_bytes(data[:8], "little"), np.dtype(kind)
    raw = np.frombuffer(pa.decompress(data[8:], size, "zstd"), np.uint8) if size else np.zeros(0, np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind)[:, 0] if size else np.zeros(0, kind)


def _steps(x: np.ndarray) -> bytes:
    return _packed(np.diff(x, prepend=x.dtype.type(0)))


def _sums(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    key, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return key, np.bincount(back, np.concatenate([p[1] for p in parts]), len(key)).astype(np.int64)


def _keys(lower: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct strings and words of some texts, sorted, as _kinds has them, without the places, which cost a sort of places too."""
    starts, ends, before = words(lower, offs)
    data, where, _ = stream(lower, starts, ends, before)
    return _distinct(grams(data, where)), _distinct(span_hashes(lower, starts, ends))


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers of x, which is sorted in its place."""
    x.sort()
    return x[np.diff(x, prepend=~x[:1]) != 0]


def _kinds(lower: np.ndarray, offs: np.ndarray, held: np.ndarray):
    """Strings and words of some texts: (place in the keys of each item, keys, how often training has each, n+1 counts of items) of both."""
    starts, ends, before = words(lower, offs)
    data, where, counts = stream(lower, starts, ends, before)
    for key, per in ((grams(data, where), counts), (span_hashes(lower, starts, ends), before)):
        own, back = np.unique(key, return_inverse=True)
        yield back, own, np.bincount(back, ~np.repeat(held, np.diff(per)), len(own)).astype(np.int64), per


def _order(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each sorted key (strings by their two newest bytes, hashes of words by themselves), and the keys' places by bucket, then key."""
    at = mix((key >> 8 * (DEPTH - 1)).astype(np.uint64)) if key.dtype == np.int64 else key >> np.uint64(20)
    at = (at % np.uint64(buckets)).astype(np.int32)
    return at, np.argsort(at, kind="stable")


def _pieces(data: np.ndarray, offs: np.ndarray, held: np.ndarray, limit: int = 2 << 20):
    """Runs of texts of about `limit` bytes: first text, end, bytes, offsets, held."""
    lo = 0
    while lo < len(held):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], held[lo:hi]
        lo = hi


_HEAD = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("keys", pa.binary()), ("n", pa.binary()), ("ids", pa.list_(pa.string())), ("held", pa.list_(pa.bool_())), ("words", pa.list_(pa.int64())), ("offs", pa.list_(pa.int64())), ("texts", pa.binary())])
_BACK = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("got", pa.binary()), ("keys", pa.binary()), ("mixed", pa.binary()), ("blocks", pa.list_(pa.int64())), ("places", pa.list_(pa.binary())), ("slot", pa.int32()), ("value", pa.float64())])
_HEAD_DDL = "block long, part int, keys binary, n binary, ids array<string>, held array<boolean>, words array<long>, offs array<long>, texts binary"
_BACK_DDL = "block long, part int, got binary, keys binary, mixed binary, blocks array<long>, places array<binary>, slot int, value double"


def _table(schema: pa.Schema, rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=schema)


def _blocks_of(docs: DataFrame, buckets: int) -> DataFrame:
    """A line for each block of texts, and one for each bucket of its strings (part below `buckets`) and of its words (from there on)."""

    def lines(block, rows):
        held = np.concatenate([r[1] for r in rows])
        data, offs = np.concatenate([r[3] for r in rows]), np.append(0, np.cumsum(np.concatenate([np.diff(r[4]) for r in rows])))
        many = np.concatenate([r[2] for r in rows])
        raw = data.tobytes()
        packed = len(raw).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")
        yield from _table(_HEAD, [{"block": block, "part": -1, "ids": [i for r in rows for i in r[0]], "held": held.tolist(), "words": many.tolist(), "offs": offs.tolist(), "texts": packed}]).to_batches()
        for which in (0, 1):
            key, n = _sums([r[5][which] for r in rows])
            at, order = _order(key, buckets)
            ends = np.searchsorted(at[order], np.arange(buckets + 1))
            out = [{"block": block, "part": which * buckets + p, "keys": _steps(key[order[a:b]]), "n": _packed(n[order[a:b]])} for p, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if b > a]
            if out:
                yield from _table(_HEAD, out).to_batches(max_chunksize=64)

    def run(batches):
        from pyspark import TaskContext

        block, rows, size = TaskContext.get().partitionId() << 24, [], 0
        for t in blocks(batches, text="t_"):
            data, offs = flat(t["t_"])
            data, held = LOWER[data], t["held"].to_numpy()
            got = list(_kinds(data, offs, held))
            rows.append((t["id"].to_pylist(), held, np.diff(got[1][3]), data, offs, [(k[1], k[2]) for k in got]))
            size += len(data)
            if size >= TEXT_BYTES:
                yield from lines(block, rows)
                block, rows, size = block + 1, [], 0
        if rows:
            yield from lines(block, rows)

    return docs.mapInArrow(run, _HEAD_DDL)


def _bucket(buckets: int):
    """All lines of one bucket: of words, the counts for each block; of strings, their mixtures, the blocks' places in them, and what lies above."""

    def run(t: pa.Table) -> pa.Table:
        part = t["part"][0].as_py()
        kind = np.int64 if part < buckets else np.uint64
        own = [np.cumsum(_unpacked(k, kind), dtype=kind) for k in t["keys"].to_pylist()]
        key, n = _sums([(k, _unpacked(c, np.int64)) for k, c in zip(own, t["n"].to_pylist(), strict=True)])
        at = [np.searchsorted(key, k) for k in own]
        named = t["block"].to_pylist()
        if part >= buckets:
            out = [{"block": b, "part": part, "got": _packed(n[i])} for b, i in zip(named, at, strict=True)]
            return _table(_BACK, [*out, {"slot": -1, "value": float((n > 0).sum())}])
        mixed, sums, counts = mixtures(key, n)
        flat_ = np.concatenate([sums.ravel(), counts.ravel()])
        hit = np.flatnonzero(flat_)
        line = {"part": part, "keys": _steps(key), "mixed": _packed(mixed.ravel()), "blocks": named, "places": [_steps(i) for i in at]}
        return pa.concat_tables([_table(_BACK, [line]), pa.table({f.name: pa.array(hit.astype(np.int32)) if f.name == "slot" else pa.array(flat_[hit]) if f.name == "value" else pa.nulls(len(hit), f.type) for f in _BACK}, schema=_BACK)])

    return run


def scored(docs: DataFrame, id_col: str = "doc_id", text: str = "text", mod: int = 10) -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    src = docs.select(F.col(id_col).cast("string").alias("id"), (remainder(id_col, mod) == 0).alias("held"), F.col(text).alias("t_"))
    buckets = max(BUCKETS * src.rdd.getNumPartitions(), 8)
    table = written(_blocks_of(src, buckets))
    back = written(table.where("part >= 0").select("block", "part", "keys", "n").groupBy("part").applyInArrow(_bucket(buckets), _BACK_DDL))
    heads = table.where("part < 0").select("block", "ids", "held", "words", "offs", "texts")
    stats = heads.select(F.explode(F.arrays_zip("held", "words")).alias("x")).where("not x.held").agg(F.count(F.lit(1)).alias("texts"), F.sum("x.words").alias("words")).first()
    texts = stats.texts
    total = (stats.words or 0) + texts
    sums = back.where("slot is not null").groupBy("slot").agg(F.sum("value").alias("value")).toArrow()  # at most 256 * 767 numbers
    slot, value = sums["slot"].to_numpy(), sums["value"].to_numpy()
    kinds = int(value[slot < 0].sum()) + (texts > 0)
    plane = np.zeros(256 * 767)
    plane[slot[slot >= 0]] = value[slot >= 0]
    shared = docs.sparkSession.sparkContext.broadcast(above(plane[: 256 * 255].reshape(256, 255), plane[256 * 255 :].reshape(2, 256, 256)))

    def string_lines(batches):
        for b in batches:
            for line in b.to_pylist():
                key = np.cumsum(_unpacked(line["keys"], np.int64))
                score = string_scores(key, _unpacked(line["mixed"], np.float32).reshape(8, -1), shared.value).astype(np.float32)
                for block, place in zip(line["blocks"], line["places"], strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([line["part"]], pa.int32()), pa.array([_packed(score[np.cumsum(_unpacked(place, np.int64))])])], ["of", "part", "got"])

    strings = back.where("mixed is not null").select("part", "keys", "mixed", "blocks", "places").mapInArrow(string_lines, "of long, part int, got binary")
    known = strings.union(back.where("got is not null").select(F.col("block").alias("of"), "part", "got"))

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        head = left.slice(0, 1).to_pylist()[0]
        size = int.from_bytes(head["texts"][:8], "little")
        data = np.frombuffer(pa.decompress(head["texts"][8:], size, "zstd"), np.uint8) if size else np.zeros(0, np.uint8)
        held, offs = np.array(head["held"], bool), np.array(head["offs"], np.int64)
        parts = sorted(zip(right["part"].to_pylist(), right["got"].to_pylist(), strict=True))
        pieces = list(_pieces(data, offs, held))
        values = []
        keys = [_keys(d, o) for _, _, d, o, _ in pieces]
        for which, kind in ((0, np.float32), (1, np.int64)):
            key = _distinct(np.concatenate([k[which] for k in keys]))
            at = np.empty(len(key), kind)
            got = [_unpacked(x, kind) for p, x in parts if (p >= buckets) == which]
            at[_order(key, buckets)[1]] = np.concatenate(got) if got else np.zeros(0, kind)
            values.append((key, at))
        score, base, seen, count = (np.zeros(len(held)) for _ in range(4))
        for lo, hi, d, o, h in pieces:
            (sb, sk, _, sper), (wb, wk, _, wper) = _kinds(d, o, h)
            score[lo:hi] = sums_by(values[0][1][np.searchsorted(values[0][0], sk)].astype(np.float64)[sb], sper)
            c = values[1][1][np.searchsorted(values[1][0], wk)]
            base[lo:hi] = sums_by(np.log10((c + 0.1) / (total + 0.1 * (kinds + 1)))[wb], wper)
            seen[lo:hi], count[lo:hi] = sums_by((c > 0)[wb].astype(np.int64), wper), np.diff(sper)
        many = np.array(head["words"], np.int64)
        end = np.log10((texts + 0.1) / (total + 0.1 * (kinds + 1)))
        return pa.table(
            {
                "id": pa.array(head["ids"], pa.string()), "held_out": pa.array(held), "n_tokens": pa.array(many + 1), "n_known": pa.array(seen.astype(np.int64) + (texts > 0)),
                "train_tokens": pa.array(np.full(len(many), total, np.int64)), "base_score": pa.array(base + end), "score": pa.array(score), "bits_per_byte": pa.array(-score * np.log2(10) / count),
            }
        )

    kind = "id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    out = heads.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(joined, kind)
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), *[c for c in out.columns if c != "id"])


def op3_ctw_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir))
