"""Near-duplicates by BagMinHash: weighted-Jaccard signatures, bands, and verified multiset overlap.

A text is the bag of its five-word shingles (words lower-cased in ASCII; a shorter text is one shingle).
For each shingle the weights (0, 1], (1, 2], (2, 4], (4, 8], ... carry Poisson processes whose rate is the
width. A process is drawn by its first point only; then it splits in halves, the point falls to one of
them by a coin, the other draws its own first point from there on. Unit widths give their points one
after another, each to a random component, which keeps its smallest. Processes above the bag's
weight are left out, and those later than the largest component end. So two bags agree in a
component with the probability sum(min) / sum(max) of their counts.

Texts that share a band of ROWS components are candidates; a link is a pair whose multiset overlap is at
least THRESHOLD, counted on 48 bits of the shingles' hashes. Classes are the connected links.

Texts with the same words are one node. Each bucket compares its members to its first one. Where that
leaves a bucket in several groups of near signatures, the members outside its largest group meet all others in
tiles of signatures, and each pair of tiles gives the few edges that join groups, not its pairs. The groups so
joined are blocks: every text is in one, and no pair that can be a link crosses two. In blocks of several
classes the members outside the largest class meet all others in tiles once more, this time with their bags;
each pair whose signatures are near is verified there, and only links that join classes leave the task. So no
step has a row for each pair, and a text's bag moves once a block, not once a bucket.

Defined results: null and empty texts have no shingles; they equal each other and nothing else. Null ids
come last when a class picks its smallest id. Rows keep their repeats. Very long texts are taken
whole. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import LOWER, blocks, documents, drop, flat, lean, mix, numbered, owners, span_hashes, trim, with_fields, words, written
from .exact_dedup import among, hits, repeated_filter, settled

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 48
ROWS = 7
#: Pairs whose signatures differ in a larger share of components are no links: at THRESHOLD this is 6.5 standard deviations off.
AT_MOST_APART = 1 - THRESHOLD + 6.5 * (THRESHOLD * (1 - THRESHOLD) / (BANDS * ROWS)) ** 0.5
#: Members of a tile, about, and its bytes of bags, about (one member at least).
TILE = 64
TILE_BYTES = 1 << 19
#: Values of bags that are compared at once.
VALUES = 1 << 20
#: Bytes of a bag for each shingle.
WIDE = 6
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xD6E8FEB86659FD93)
_M2 = np.uint64(2 * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
_G2 = np.uint64(2 * 0x9E3779B97F4A7C15 & (1 << 64) - 1)


def shingles(hashes: np.ndarray, before: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles and n+1 counts by text, from word hashes and n+1 counts of words."""
    n = np.diff(before)
    many = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    counts = np.append(0, np.cumsum(many))
    at = np.repeat(before[:-1] - counts[:-1], many) + np.arange(counts[-1])
    left = np.repeat(before[1:], many) - at
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        ok = left > k
        out = out * _M + np.where(ok, hashes[np.minimum(at + k, max(len(hashes) - 1, 0))] if len(hashes) else out, np.uint64(k + 1))
    return mix(out), counts


def signatures(who: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, size: int) -> np.ndarray:
    """n rows of `size` components for elements (owner, hash, whole weight)."""
    h = np.full((n, size), np.inf)
    rows, lows, highs = [np.arange(len(who))], [np.zeros(len(who), np.int64)], [np.ones(len(who), np.int64)]
    low = 1
    while (more := np.flatnonzero(weight > low)).size:
        rows.append(more)
        lows.append(np.full(len(more), low))
        highs.append(np.full(len(more), 2 * low))
        low *= 2
    row, lo, hi = (np.concatenate(x) for x in (rows, lows, highs))
    doc, w = who[row], weight[row]
    seed = mix(element[row] ^ mix(lo.astype(np.uint64) * _GOLD + hi.astype(np.uint64)))
    draw = lambda s, k: mix(s + k * _GOLD)
    wait = lambda r, width: -np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
    k = np.ones(len(row), np.uint64)
    x = wait(draw(seed, k), hi - lo)
    top = np.full(n, np.inf)
    while len(doc):
        unit = hi - lo == 1
        if unit.all():
            part = mix(draw(seed, k) ^ _M) % np.uint64(size)
        else:
            wide = ~unit
            coin = (mix(draw(seed[wide], k[wide]) ^ _GOLD) & np.uint64(1)).astype(bool)
            l, r, s, at = lo[wide], hi[wide], seed[wide], x[wide]
            mid = (l + r) // 2
            sides = []
            for a, b, own, salt in ((l, mid, ~coin, _M), (mid, r, coin, _M2)):
                child = mix(s + salt)
                first = np.where(own, at, at + wait(draw(child, np.uint64(1)), b - a))
                sides.append((a, b, child, first))
            join = lambda old, i: np.concatenate([old[unit], sides[0][i], sides[1][i]])
            doc, w = (np.concatenate([v[unit], v[wide], v[wide]]) for v in (doc, w))
            k = np.concatenate([k[unit], np.ones(2 * len(l), np.uint64)])
            lo, hi, seed, x = join(lo, 0), join(hi, 1), join(seed, 2), join(x, 3)
            keep = (lo < w) & (x <= top[doc])
            doc, w, k, lo, hi, seed, x = (v[keep] for v in (doc, w, k, lo, hi, seed, x))
            unit = hi - lo == 1
            part = mix(draw(seed, k) ^ _M) % np.uint64(size)
        np.minimum.at(h.ravel(), doc[unit] * size + part[unit].astype(np.int64), x[unit])
        live = np.unique(doc)
        top[live] = h[live].max(axis=1)
        k = k + unit.astype(np.uint64)
        x = np.where(unit, x + wait(draw(seed, k), 1), x)
        keep = x <= top[doc]
        doc, w, k, lo, hi, seed, x = (v[keep] for v in (doc, w, k, lo, hi, seed, x))
    return h


def described(docs: DataFrame, id_col: str, text: str, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, row, two hashes of the word sequence, number of shingles, the bag (sorted, 48 bits each), and the signature, a byte a component."""
    src = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("t_"))

    def run(batches):
        for t in blocks(batches, text="t_", rows=2048):
            hashes, before = _word_hashes(t["t_"])
            h1, h2 = _whole(hashes, before)
            s, counts = shingles(hashes, before, size)
            n = len(t)
            who = owners(counts)
            order = np.lexsort((s, who))
            own, el = who[order], s[order]
            first = np.ones(len(el), bool)
            first[1:] = (el[1:] != el[:-1]) | (own[1:] != own[:-1])
            at = np.flatnonzero(first)
            sig = signatures(own[at], el[at], np.diff(np.append(at, len(el))), n, bands * rows)
            small = mix(sig.view(np.uint64)).astype(np.uint8)
            bag = np.ascontiguousarray(el.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - WIDE :])
            many = np.diff(counts)
            edges = (counts * WIDE).tolist()
            raw = bag.tobytes()
            cols = [t["id"].combine_chunks(), t["row"].combine_chunks(), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(many), pa.array([raw[a:b] for a, b in zip(edges, edges[1:], strict=False)], pa.binary()), pa.array([r.tobytes() for r in small], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "row", "h1", "h2", "n", "bag", "small"])

    long = T.LongType()
    return src.mapInArrow(lean(run), with_fields(src.drop("t_"), h1=long, h2=long, n=long, bag=T.BinaryType(), small=T.BinaryType()))


def _word_hashes(col) -> tuple[np.ndarray, np.ndarray]:
    data, offs = flat(col)
    starts, ends, before = words(data, offs)
    return span_hashes(LOWER[data], starts, ends), before


def _whole(hashes: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's word sequence."""
    at = np.arange(len(hashes), dtype=np.uint64) - np.repeat(before[:-1], np.diff(before)).astype(np.uint64)
    out = []
    for salt in (_GOLD, _G2):
        placed = mix(hashes + mix(at + salt))
        total = np.append(np.uint64(0), np.cumsum(placed, dtype=np.uint64))
        out.append(mix(total[before[1:]] - total[before[:-1]] + np.diff(before).astype(np.uint64) * _M))
    return out[0], out[1]


class Bags:
    """Some texts' bags: distinct values, their counts, where each text's begin, and the texts' sizes."""

    def __init__(self, col):
        data, offs = flat(col)
        raw = np.zeros((len(data) // WIDE, 8), np.uint8)
        raw[:, :WIDE] = data.reshape(-1, WIDE)
        value = raw.view("<u8")[:, 0]
        self.size = np.diff(offs) // WIDE
        who = owners(offs // WIDE)
        first = np.ones(len(value), bool)
        first[1:] = (value[1:] != value[:-1]) | (who[1:] != who[:-1])
        at = np.flatnonzero(first)
        self.value, self.count = value[at], np.diff(np.append(at, len(value)))
        self.edge = np.append(0, np.cumsum(np.bincount(who[at], minlength=len(self.size))))

    def of(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the texts, each with its place in the list above them, and counts."""
        n = np.diff(self.edge)[texts]
        total = np.append(0, np.cumsum(n))
        at = np.repeat(self.edge[texts] - total[:-1], n) + np.arange(total[-1])
        return np.repeat(np.arange(len(texts), dtype=np.uint64), n) << np.uint64(48) | self.value[at], self.count[at]


def overlap(one: Bags, x: np.ndarray, two: Bags, y: np.ndarray) -> np.ndarray:
    """sum(min) / sum(max) of the counts of each pair (x of one, y of two); bounded runs of pairs at a time."""
    both = np.zeros(len(x))
    load = np.cumsum(np.diff(one.edge)[x] + np.diff(two.edge)[y])
    at = 0
    while at < len(x):
        stop = int(np.searchsorted(load, (load[at - 1] if at else 0) + VALUES, side="right"))
        stop = min(max(stop, at + 1), at + 60_000, len(x))
        (ka, ca), (kb, cb) = one.of(x[at:stop]), two.of(y[at:stop])
        if len(ka) and len(kb):
            place = np.minimum(np.searchsorted(ka, kb), len(ka) - 1)
            hit = np.flatnonzero(ka[place] == kb)
            both[at:stop] = np.bincount((kb[hit] >> np.uint64(48)).astype(np.int64), np.minimum(ca[place[hit]], cb[hit]), stop - at)
        at = stop
    return both / np.maximum(one.size[x] + two.size[y] - both, 1)


def _bytes(col) -> np.ndarray:
    """Signatures, a row each."""
    return flat(col)[0].reshape(len(col), -1)


def compared(pairs: DataFrame, bags: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose signatures are near, and whether they are links."""

    def run(batches):
        for t in blocks(batches, text="bag_b"):
            near = np.flatnonzero((_bytes(t["small_a"]) != _bytes(t["small_b"])).mean(axis=1) <= AT_MOST_APART)
            t = t.take(pa.array(near))
            every = np.arange(len(near))
            ok = overlap(Bags(t["bag_a"]), every, Bags(t["bag_b"]), every) >= threshold
            yield pa.RecordBatch.from_arrays([t["a"].combine_chunks(), t["b"].combine_chunks(), pa.array(ok)], ["a", "b", "link"])

    side = lambda rows, k: rows.select(F.col("row").alias(k), F.col("bag").alias(f"bag_{k}"), F.col("small").alias(f"small_{k}"))
    # one row may be `a` of a third of the pairs, so that side is cut to the rows it needs and joined by a shuffle that can be split
    heads = bags.join(pairs.select(F.col("a").alias("row")).distinct(), "row", "left_semi")
    met = pairs.join(side(bags, "b"), "b").join(side(heads, "a"), "a")
    return met.select("a", "b", "bag_a", "bag_b", "small_a", "small_b").mapInArrow(lean(run), "a long, b long, link boolean")


def components(links: DataFrame) -> DataFrame:
    """(node, class) for all nodes of links (a, b); class is one node of the component.

    Each step points every node at the smallest of itself and its neighbours and contracts the links by that; labels are then followed back through the steps, all as tables.
    """
    steps: list[DataFrame] = []
    edges = links
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("near")))
        to = written(both.groupBy("node").agg(F.least("node", F.min("near")).alias("to")))
        steps.append(to)
        left, right = to.select(F.col("node").alias("a"), F.col("to").alias("x")), to.select(F.col("node").alias("b"), F.col("to").alias("y"))
        met = edges.join(left, "a").join(right, "b").where("x <> y")
        rest = written(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if edges is not links:
            drop(edges)
        edges = rest
        if edges.isEmpty():
            break
    drop(edges)
    out = steps[-1].select("node", F.col("to").alias("class"))
    for to in reversed(steps[:-1]):
        out = to.join(out.select(F.col("node").alias("to"), "class"), "to", "left").select("node", F.coalesce("class", "to").alias("class"))
    return out


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct unordered pairs whose sizes allow the threshold."""
    fit = F.least("n", "m") >= THRESHOLD * F.greatest("n", "m") - 1e-9
    return df.where(fit).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()


def classes(described_rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(row of a distinct text, class) for all texts that have a link; from described() rows, written."""
    first = described_rows.groupBy("h1", "h2").agg(F.min("row").alias("row"))
    nodes = written(described_rows.select("row", "n", "small").join(first.select("row"), "row", "left_semi").where("n > 0"))
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("small"), i * ROWS + 1, F.lit(ROWS))))
    keyed = nodes.select("row", "n", F.explode(bands).alias("key"))
    shared = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.min(F.struct("row", "n")).alias("first")).where("many > 1"))
    # most keys and most texts are alone; filters keep them out of the shuffles
    known = keyed.where(among(shared.select("key"))("key"))
    members = written(known.join(shared, "key").select("key", "row", "n", "many", F.col("first.row").alias("head"), F.col("first.n").alias("m")))
    drop(nodes, shared)
    own = members.select("row").distinct()
    bags = written(described_rows.select("row", "n", "bag", "small").where(among(own)("row")).join(own, "row", "left_semi"))
    tested = written(compared(_pairs(members, "head", "row"), bags, threshold))
    links = tested.where("link").select("a", "b")
    # a bucket of two is settled by its one pair
    held = members.where("many > 2").select("key", "row", "n")
    near = written(components(tested.select("a", "b")))
    edges = _across(held, near, bags.select("row", "small"))
    blocks_ = written(components(tested.select("a", "b").unionByName(edges)))
    found = written(components(links))
    drop(members, near, edges)
    more = _across(blocks_.select(F.col("class").alias("key"), F.col("node").alias("row")).join(bags.select("row", "n"), "row"), found, bags.select("row", "bag", "small"), threshold)
    out = written(components(links.unionByName(more)))
    drop(tested, blocks_, found, more, bags)
    return out


def _across(held: DataFrame, groups: DataFrame, bags: DataFrame, threshold: float | None = None) -> DataFrame:
    """Edges (a, b) that join groups (node, class) within a key of held (key, row, n): of near signatures, or with a threshold, of verified links.

    Tiles of a key's members outside its largest group meet tiles of all its members. Of each two tiles, only edges that join groups not joined before leave the task.
    """
    placed = held.join(groups.withColumnRenamed("node", "row"), "row", "left").withColumn("class", F.coalesce("class", "row"))
    sizes = placed.groupBy("key", "class").agg(F.count(F.lit(1)).alias("in_class"), F.sum("n").alias("values"))
    whole = sizes.groupBy("key").agg(F.max(F.struct("in_class", "class")).alias("most"), F.count(F.lit(1)).alias("kinds"), F.sum("in_class").alias("many"), F.sum("values").alias("values")).where("kinds > 1")
    share = F.col("many") / TILE if threshold is None else F.greatest(F.col("many") / TILE, F.col("values") * WIDE / TILE_BYTES)
    whole = whole.select("key", F.col("most.class").alias("main"), F.ceil(share).alias("tiles"))
    open_ = written(placed.join(whole, "key").select("key", "row", "n", "class", (F.col("class") != F.col("main")).alias("out"), F.pmod(F.xxhash64("row"), F.col("tiles")).alias("tile")))
    full = open_.join(bags, "row")
    member = F.struct("row", "n", "class", "out", *[c for c in ("small", "bag") if c in bags.columns])
    tiles = full.groupBy("key", "tile").agg(F.collect_list(member).alias("y"))  # TILE members, about
    outside = full.where("out").groupBy("key", "tile").agg(F.collect_list(member).alias("x"))
    met = outside.select("key", "x").join(tiles.select("key", "y"), "key").select("x", "y")

    def side(col):
        v = col.flatten()
        get = lambda k: v.field(k).to_numpy(zero_copy_only=False)
        return get("row"), get("n"), get("class"), get("out"), _bytes(v.field("small")), v

    def joining(kind, kind_b, x, y) -> list[int]:
        """Of the edges x, y those that join what no earlier one has joined."""
        up: dict[int, int] = {}

        def top(c):
            while (d := up.get(c, c)) != c:
                up[c] = c = up.get(d, d)
            return c

        keep = []
        for i, (c, d) in enumerate(zip(kind[x].tolist(), kind_b[y].tolist(), strict=True)):
            if (c := top(c)) != (d := top(d)):
                up[c] = d
                keep.append(i)
        return keep

    def run(batches):
        for t in batches:
            for i in range(t.num_rows):
                (row, n, kind, _, sig, v), (row_b, m, kind_b, out_b, sig_b, w) = (side(t.column(k).slice(i, 1)) for k in (0, 1))
                fit = (np.minimum.outer(n, m) >= THRESHOLD * np.maximum.outer(n, m) - 1e-9) & (kind[:, None] != kind_b)
                # two members outside the largest group meet twice
                fit &= ~out_b | (row[:, None] < row_b)
                x, y = np.nonzero(fit)
                near = np.concatenate([np.flatnonzero((sig[x[k : k + 4096]] != sig_b[y[k : k + 4096]]).mean(axis=1) <= AT_MOST_APART) + k for k in range(0, max(len(x), 1), 4096)])
                x, y = x[near], y[near]
                if threshold is not None and len(x):
                    ok = overlap(Bags(v.field("bag")), x, Bags(w.field("bag")), y) >= threshold
                    x, y = x[ok], y[ok]
                keep = joining(kind, kind_b, x, y)
                one, two = row[x[keep]], row_b[y[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], ["a", "b"])

    edges = written(met.mapInArrow(lean(run), "a long, b long"))
    drop(open_)
    return edges


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id_col, class_id (the smallest id of its class), class_size, kept."""
    return _near(docs, id_col, text).select(F.col("id").alias(id_col), "class_id", "class_size", "kept")


def _near(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    rows = written(described(docs, id_col, text))
    own = written(rows.select("id", "row", "h1", "h2"))
    found = classes(rows)
    drop(rows)
    same = own.groupBy("h1", "h2").agg(F.min("row").alias("node"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"), F.count(F.lit(1)).alias("many"))
    same = same.join(found, "node", "left").withColumn("class", F.coalesce("class", "node"))
    whole = same.groupBy("class").agg(F.min("first").alias("first"), F.sum("many").alias("class_size"))
    by_text = same.select("h1", "h2", "class").join(whole, "class").select("h1", "h2", "first", "class_size")
    return own.join(by_text, ["h1", "h2"]).select("id", "row", "h1", "h2", F.col("first.id").alias("class_id"), "class_size", (F.col("row") == F.col("first.row")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each class, with all their columns.

    Rows of classes with one member alone keep their place; the others are matched by id and words together.
    """
    names = docs.columns
    several = _near(docs, id_col, text).where("class_size > 1").groupBy("h1", "h2").agg(F.max(F.when(F.col("kept"), F.struct("id"))).alias("x"))
    several = written(several.select("h1", "h2", F.col("x").isNotNull().alias("has"), F.col("x.id").alias("keep")))

    plane, bits = repeated_filter(several.select("h1"), "h1", times=1)
    shared = docs.sparkSession.sparkContext.broadcast(plane)

    @F.arrow_udf("struct<h1:bigint,h2:bigint,maybe_:boolean>")
    def whole(texts: pa.Array) -> pa.Array:
        # a batch is bounded by rows, so its texts are hashed in blocks bounded by bytes
        parts = [_whole(*_word_hashes(t["t_"])) for t in blocks(iter([pa.RecordBatch.from_arrays([texts], ["t_"])]), text="t_")]
        h1, h2 = (pa.array(np.concatenate([np.zeros(0, np.uint64), *(p[i] for p in parts)]).view(np.int64)) for i in (0, 1))
        trim()
        return pa.StructArray.from_arrays([h1, h2, pa.array(hits(h1, shared.value, bits), pa.bool_())], ["h1", "h2", "maybe_"])

    seen = numbered(docs, h=whole(F.col(f"`{text}`").cast("string"))).select("*", "h.*").drop("h")
    return settled(seen, several, ["h1", "h2"], f"c{names.index(id_col)}").drop("h1", "h2").toDF(*names)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
