"""Operators against brute force, round trips and held-out labels, with nulls, ties, repeats and empty tables."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lodestrata.llm import ctw, exact_dedup, langid, line_chunks, media, near_dedup, packing, pieces, preference, quality, sentencepiece_codec

DIR = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long, sha string"
ROWS = [(1, "a  b", "en", "s", 4, "x"), (2, "a\tb", "en", "s", 3, "x"), (3, None, None, None, None, None), (4, "", "en", None, 0, "y"), (None, "a b", None, "s", 3, "z"), (5, "word " * 3000, "fr", "s", None, "z"), (1, "a  b", "en", "s", 4, "x"), (6, "été là " * 9, "fr", "s", 1, "q")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, KIND)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


@pytest.mark.parametrize("slots", [1 << 16, 1 << 28])
def test_exact(odd, none, slots):
    got = exact_dedup.exact_duplicates(odd, max_slots=slots).collect()
    groups = collections.defaultdict(list)
    for r in ROWS:
        groups[hashlib.sha256(re.sub("[\x20\x09-\x0d]+", " ", r[1] or "").encode()).hexdigest()].append(r[0])
    assert len(got) == len(ROWS)
    for r in got:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == min(i for i in ids if i is not None)
    assert sum(r.kept for r in got) == len(groups)
    stay = exact_dedup.drop_exact_duplicates(odd)
    assert stay.columns == odd.columns and sorted(r.doc_id for r in stay.collect()) == [1, 3, 5, 6]
    assert exact_dedup.exact_duplicates(none).count() == 0 and exact_dedup.drop_exact_duplicates(none).count() == 0


def test_near(spark, odd, none):
    draw = random.Random(3)
    base = [f"w{draw.randrange(900)}" for _ in range(200)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k:]), "en", "s", 1, "") for i, k in enumerate(range(10, 190, 12))] + [(100 + i, " ".join(f"v{draw.randrange(10**6)}" for _ in range(80)), "en", "s", 1, "") for i in range(20)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, KIND)).collect()}
    assert {got[i] for i in range(15)} == {0} and all(got[100 + i] == 100 + i for i in range(20))
    assert len(near_dedup.near_duplicates(odd).collect()) == len(ROWS)
    assert sorted(r.doc_id for r in near_dedup.drop_near_duplicates(odd).collect()) == [1, 3, 5, 6]
    assert near_dedup.near_duplicates(none).count() == 0


def test_signatures_estimate_weighted_jaccard():
    draw = np.random.default_rng(3)
    off = []
    for _ in range(30):
        el = draw.integers(0, 1 << 63, 40, dtype=np.uint64)
        a, b = draw.integers(0, 9, 40), draw.integers(0, 9, 40)
        who = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
        h = near_dedup.signatures(who, np.concatenate([el[a > 0], el[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 512)
        off.append((h[0] == h[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(off)) < 0.015


def test_byte_pieces_equal_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    t.encode_special_tokens = True
    draw = random.Random(1)
    letters = [*"ab'sStTrevmldLl  \n\t.,!9²½\xa0　 é中ßٱ१\x1c\x85_-", "'s", "'re", "'ll", " '", "😀", "<|endoftext|>"]
    texts = ["".join(draw.choice(letters) for _ in range(draw.randrange(14))) for _ in range(5000)]
    ids, offs = pieces.byte_bpe(packing.tokenizer_path()).ids(texts)
    for i, e in enumerate(t.encode_batch(texts, add_special_tokens=False)):
        assert e.ids == ids[offs[i] : offs[i + 1]].tolist(), texts[i]


def test_packing(odd, none):
    got = packing.pack(odd).toPandas()
    ends = got.assign(end=got.offset + got.length).sort_values(["sequence_id", "offset"])
    assert (ends.groupby("sequence_id").end.shift(fill_value=0) == ends.offset).all() and ends.end.max() <= 2048
    assert got.sequence_id.nunique() == -(-got.length.sum() // 2048)
    assert (got[got.doc_id == 3].length == 1).all() and packing.pack(none).count() == 0


def test_plan_is_best_fit_decreasing():
    draw = random.Random(4)
    sizes = [draw.randrange(1, 101) for _ in range(500)]
    _, n = packing.plan(collections.Counter(sizes), 100)
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps[gaps.index(min(fit))] -= s
        else:
            gaps.append(100 - s)
    assert n == len(gaps)


def test_sentencepiece(odd, none):
    from sentencepiece import SentencePieceProcessor

    own = SentencePieceProcessor(model_file=sentencepiece_codec.model_path())
    draw = random.Random(2)
    texts = ["".join(draw.choice("abcde theing  \n\t.,!9é中😀▁ß\x01") for _ in range(draw.randrange(25))) for _ in range(3000)]
    encode, decode = sentencepiece_codec.codec(sentencepiece_codec.model_path())
    ids, offs = encode(texts)
    for i, (want, back) in enumerate(zip(own.encode(texts), decode(ids, offs), strict=True)):
        assert want == ids[offs[i] : offs[i + 1]].tolist() and back.decode("utf-8", "replace") == own.decode(want)
    got = sentencepiece_codec.digests(sentencepiece_codec.encoded(odd)).collect()
    assert len(got) == len(ROWS) and all(r.parity for r in got) and sentencepiece_codec.encoded(none).count() == 0


def test_scores(odd, none):
    got = ctw.scored(odd).collect()
    assert len(got) == len(ROWS) and all(r.score < 0 and r.base_score <= 0 for r in got)
    assert ctw.scored(none).count() == 0


def test_byte_probabilities_sum_to_one(odd):
    from pyspark.sql import functions as F

    child, table, inner = ctw.fit(odd.select(F.col("text")))
    assert np.allclose((10.0 ** table.astype(np.float64)).sum(axis=1), 1, atol=1e-4)
    assert child.max() < inner + len(table)


def test_quality(spark, odd, none):
    got = quality.op4_quality_classifier(spark, DIR).join(spark.read.parquet(f"{DIR}/labels.parquet"), "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in got if r.held_out]) > 0.8
    model = quality.train(odd, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality.score(odd, model).collect()} == {0.5} and quality.score(none, model).count() == 0


def test_languages(spark, odd, none):
    got = langid.op9_language_id(spark, DIR).join(spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97
    known = langid.language_profiles(odd)
    by = {r.doc_id: r.lang_pred for r in langid.predict(odd, known).collect()}
    assert by[3] == by[4] == "und" and langid.predict(none, known).count() == 0 and {r.lang_pred for r in langid.predict(odd, {}).collect()} == {"und"}


def test_media(odd, none):
    got = media.read_back(media.store(odd)).collect()
    for r, row in zip(sorted(got, key=lambda r: (r.doc_id or 0, r.n_bytes)), sorted(ROWS, key=lambda r: (r[0] or 0, len((r[1] or "").encode()))), strict=True):
        raw = (row[1] or "").encode()
        data = raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(data), hashlib.sha256(data).hexdigest())
    assert media.store(none).count() == 0
    assert media.MULAW[[0, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0] and media.ALAW[[0xD5, 0x55, 0x2A, 0xAA]].tolist() == [8, -8, -32256, 32256]


def test_adpcm_blocks_equal_one_sample_at_a_time():
    wave = (8000 * np.sin(np.arange(3000) / 9)).astype(np.int16)
    data = media.ima_encode(wave, 64)
    want = []
    for at in range(0, len(data), 64):
        value, index = int.from_bytes(data[at : at + 2], "little", signed=True), data[at + 2]
        want.append(value)
        for b in data[at + 4 : at + 64]:
            for code in (b & 15, b >> 4):
                step = int(media.IMA_STEPS[index])
                diff = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
                value = max(-32768, min(32767, value + (-diff if code & 8 else diff)))
                index = max(0, min(88, index + int(media.IMA_MOVES[code & 7])))
                want.append(value)
    got = media.ima_decode(data, 64)
    assert got.tolist() == want and np.abs(got[: len(wave)].astype(int) - wave).mean() < 400
    assert media.unwav(media.wav("ima", data, 8000, 64)) == ("ima", 8000, 64, data)


def test_line_chunks(spark, none):
    shared = "\n".join(f"shared line {i} of the passage" for i in range(40))
    rows = [(i, f"own {i}\n" * 3 + f"intro {i * 7}\n" + shared + f"\nend {i * 13}", "en", "s", 1, "") for i in range(5)] + [(9, "alone\nby itself", "en", "s", 1, ""), (10, None, None, None, None, None)]
    got = {r.doc_id: r for r in line_chunks.dedup_lines(spark.createDataFrame(rows, KIND)).collect()}
    assert got[0].text.count("shared line") == 40 and got[9].text == "alone\nby itself" and got[10].text == ""
    assert all(got[i].text.count("shared line") < 12 for i in range(1, 5)) and line_chunks.dedup_lines(none).count() == 0


def test_preference(spark):
    rows = [(1, False, 0, "user", "hi"), (1, False, 1, "assistant", "good"), (1, True, 0, "user", "hi"), (1, True, 1, "assistant", "bad one"), (2, False, 0, None, None)]
    one, two = sorted(preference.format_preferences(spark.createDataFrame(rows, "pair_id long, is_rejected boolean, turn long, role string, text string")).collect(), key=lambda r: r.pair_id)
    assert one.prefix_turns == 1 and one.prompt == "<|user|>\nhi<|end|>\n" and one.rejected[one.rejected_mask[0].start : one.rejected_mask[0].end] == "bad one<|end|>"
    assert two.prefix_turns == 0 and not two.complete and two.rejected == ""


def test_scores_keep_every_context_seen_twice(spark):
    from pyspark.sql import functions as F

    from lodestrata.llm.base import LOWER, flat, remainder, words

    draw = random.Random(8)
    rows = [(i, " ".join(f"w{draw.randrange(40)}" for _ in range(400)) + (" zyxqv jkpwb" if i in (3, 4, 5) else ""), "en", "s", 1, "") for i in range(250)] + [(900, "zyxqv jkpwb", "en", "s", 1, ""), (901, None, "en", "s", 1, "")]
    docs = spark.createDataFrame(rows, KIND).repartition(3)
    got = {r.doc_id: r for r in ctw.scored(docs).collect()}
    model = ctw.fit(docs.where(remainder("doc_id", 10) != 0))
    taught = [r[0] for r in docs.where(remainder("doc_id", 10) != 0).select("doc_id").collect()]
    assert sum(i in taught for i in (3, 4, 5)) >= 2
    assert {b"xyz", b"vqxyz ", b"bwpkj"} <= {c for level in ctw.grown(*_strings([r[1] for r in rows if r[0] in taught]))[0].contexts for c in level}
    for i, text, *_ in rows:
        data, offs = flat(pa.chunked_array([pa.array([text])]))
        data, where, before = ctw.stream(LOWER[data], *words(LOWER[data], offs))
        want = ctw.text_scores(data, where, before, model)[0]
        assert abs(got[i].score - want) < 1e-3 * max(1, len(where)) ** 0.5 and np.isclose(got[i].bits_per_byte, -got[i].score * np.log2(10) / len(where))
    assert got[900].bits_per_byte < 3


def _strings(texts):
    from lodestrata.llm.base import LOWER, flat, words

    data, offs = flat(pa.chunked_array([pa.array(texts)]))
    data, where, _ = ctw.stream(LOWER[data], *words(LOWER[data], offs))
    return np.unique(ctw.grams(data, where), return_counts=True)


def test_repeated_runs_of_lines_go_whole(spark):
    draw = random.Random(6)
    pool = [f"line {i} of all" for i in range(60)] + [""]
    texts = ["\n".join(draw.choice([f"own {d} {k}", *draw.choices(pool, k=2)]) if draw.random() < 0.6 else "\n".join(pool[(s := draw.randrange(55)) : s + draw.randrange(2, 6)]) for k in range(draw.randrange(1, 14))) for d in range(120)]
    texts += ["q\nq\nq", "q\nq\nq", "z\nz\nz\nz", "\n\n\n"]
    got = {r.doc_id: r for r in line_chunks.dedup_lines(spark.createDataFrame([(i, t, "en", "s", 1, "") for i, t in enumerate(texts)], KIND)).collect()}
    seen = {}
    for i, t in enumerate(texts):
        lines, off = t.split("\n"), set()
        for k in range(len(lines) - 1):
            pair = lines[k], lines[k + 1]
            if pair == ("", ""):
                continue
            if seen.setdefault(pair, (i, k)) not in ((i, k), (i, k - 1)):
                off |= {k, k + 1}
        for k, line in enumerate(lines):
            lo, hi = k, k
            while lo >= 0 and not lines[lo] and lo not in off:
                lo -= 1
            while hi < len(lines) and not lines[hi] and hi not in off:
                hi += 1
            if not line and lo in off and hi in off and k not in off and lo >= 0:
                assert "" == line and k not in off
                lines[k] = None
        want = "\n".join(x for k, x in enumerate(lines) if k not in off and x is not None)
        assert got[i].text == want and got[i].n_lines == len(lines) and got[i].removed_lines == len(off) + lines.count(None)
    rows = [(0, "a one\nfoo bar\nbaz qux\nb one", "", "", 1, ""), (1, "c one\nfoo bar\nbaz qux\nd one", "", "", 1, "")]
    assert [r.text for r in sorted(line_chunks.dedup_lines(spark.createDataFrame(rows, KIND)).collect(), key=lambda r: r.doc_id)] == [rows[0][1], "c one\nd one"]


def test_quality_learns_from_every_word_of_a_long_text(spark):
    rows = [(i, " ".join(f"u{i}x{k}" for k in range(3000)), "en", "s", 1, "") for i in range(8)]
    docs = spark.createDataFrame(rows, KIND)
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int")
    used = labels.where(quality.remainder("doc_id", 4) != 2).select("doc_id", "quality").collect()
    assert {r.quality for r in used} == {0, 1}
    model = quality.train(docs, labels)
    texts = pa.chunked_array([pa.array([rows[r.doc_id][1] for r in used])])
    _, _, bucket, _ = quality.inputs(texts, pa.chunked_array([pa.array([1] * len(used))]))
    assert (model.w[len(quality.STATS) + np.unique(bucket)] != 0).mean() > 0.99


CLASH = "doc_id long, text string, score double, lang_pred string, t_ string, m_ long, q_ long, l_ long, i_ long, c0 long, sha string, maybe boolean, maybe_ boolean, has boolean, keep long, known_ boolean, own_ long, h1 long, h2 long, h long, row long, id long, n_chars long, `kept` string, lang string"
CLASHING = [(i, t, -5.0, "mine", "t", 1, 2, 3, 4, 5, "s", True, False, True, 7, False, 9, 1, 2, 3, 4, 5, 6, "k", "en" if i != 3 else "de") for i, t in ((1, "one two three four five six seven"), (2, "one two three four five six seven"), (3, "Der Hund und die Katze sind im Haus und schlafen"), (None, None), (4, "x" * 3_000_000 + " tail"), (4, "x" * 3_000_000 + " tail"))]


def test_columns_named_as_the_operators_own(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame(CLASHING, CLASH)
    model, known = quality.Machine(0.9), {"en": np.array([1, 2, 3], np.int64)}
    assert {r.score for r in quality.score(docs, model).collect()} == {0.9}
    same = quality.accepted(docs, model, 0.7)
    assert same.columns == docs.columns and sorted(map(repr, same.collect())) == sorted(map(repr, docs.collect())) and quality.accepted(docs, model, 0.95).count() == 0
    named = langid.identified(docs, known)
    assert named.columns == docs.columns and {(r.doc_id, r.score, r.lang_pred) for r in named.collect()} == {(i, -5.0, "mine") for i in (1, 2, 3, 4)}
    assert langid.predict(docs, known).columns[-2:] == ["lang_pred", "score"]
    for f, want in ((exact_dedup.drop_exact_duplicates, [1, 3, 4, None]), (near_dedup.drop_near_duplicates, [1, 3, 4, None])):
        out = f(docs)
        assert out.columns == docs.columns and sorted((r.doc_id for r in out.collect()), key=str) == sorted(want, key=str)
        assert {r.score for r in out.collect()} == {-5.0}
    spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    step = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == docs.columns, name
    assert packing.pack(docs).where("doc_id = 4").groupBy("piece").count().agg({"count": "min"}).first()[0] == 2
    assert len(ctw.scored(docs).collect()) == len(line_chunks.dedup_lines(docs).collect()) == len(media.read_back(media.store(docs)).collect()) == len(CLASHING)


def test_filter_in_parts_gives_the_same(spark):
    docs = spark.createDataFrame([(i, f"text {i % 3000}", "", "", 1, "") for i in range(9000)], KIND)
    want = sorted(map(repr, exact_dedup.exact_duplicates(docs).collect()))
    assert want == sorted(map(repr, exact_dedup.exact_duplicates(docs, max_slots=1 << 16).collect()))
    stay = exact_dedup.drop_exact_duplicates(docs, max_slots=1 << 16)
    assert sorted(r.doc_id for r in stay.collect()) == list(range(3000))


def test_near_duplicates_equal_brute_force(spark):
    """Classes over whole sf0.01: all links of overlap 0.8 and more, by exact bags of five words."""
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    bags, holders = {}, collections.defaultdict(list)
    for i, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        bags[i] = collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter()
        for s in bags[i] or [()]:
            holders[s].append(i)
    size = {i: sum(b.values()) for i, b in bags.items()}
    shared = collections.Counter()
    for s, own in holders.items():
        for x, a in enumerate(own):
            for b in own[x + 1 :]:
                shared[a, b] += min(bags[a][s], bags[b][s]) if s else 0
    up = {i: i for i in bags}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    links = 0
    for (a, b), n in shared.items():
        if n >= 0.8 * (size[a] + size[b] - n):
            links += 1
            a, b = sorted((top(a), top(b)))
            up[b] = a
    got = {r.doc_id: r.class_id for r in near_dedup.op5_minhash_near_dedup(spark, d).collect()}
    assert links > 50 and got == {i: top(i) for i in bags}


def test_preference_without_id(spark):
    kind = "conv_id long, turn long, role string, text string"
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (2, 0, "user", "c"), (3, 0, "user", "c")]
    df = spark.createDataFrame(rows, kind).selectExpr("conv_id div 2 as pair_id", "pmod(conv_id, 2) = 1 as is_rejected", "turn", "role", "text")
    got = {r.pair_id: r for r in preference.format_preferences(df).collect()}
    assert got[None].chosen == "<|user|>\na<|end|>\n<|assistant|>\nb<|end|>\n" and not got[None].complete and got[1].complete


def _message(*fields):
    """A protobuf message of (field, number, bytes or float)."""
    import struct

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for field, value in fields:
        if isinstance(value, float):
            out += number(field << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += number(field << 3) + number(value)
        else:
            out += number(field << 3 | 2) + number(len(value)) + value
    return out


@pytest.mark.parametrize("trim", [0, 1])
def test_unigram_models_with_byte_fallback(spark, odd, tmp_path, trim):
    """A model written by hand, as none is trained: pieces with scores, bytes for the rest."""
    from sentencepiece import SentencePieceProcessor

    words = ["\u2581", "\u2581the", "\u2581a", "t", "h", "e", "he", "er", "re", "a", "b", "w", "o", "r", "d", "\u2581wor", "wor", "ord", "\u2581word", "\u2581the\u2581word", "s"]
    pieces = [(b"<unk>", 0.0, 2), (b"<s>", 0.0, 3), (b"</s>", 0.0, 3)] + [(f"<0x{i:02X}>".encode(), 0.0, 6) for i in range(256)] + [(w.encode(), -float(3 + i * 7 % 11), 1) for i, w in enumerate(words)]
    model = _message(*[(1, _message((1, p), (2, s), (3, k))) for p, s, k in pieces], (2, _message((3, 1), (35, 1), (40, 0))), (3, _message((1, b"identity"), (3, 1), (4, trim), (5, 1))))
    path = str(tmp_path / "unigram.model")
    (tmp_path / "unigram.model").write_bytes(model)
    own = SentencePieceProcessor(model_file=path)
    draw = random.Random(5)
    texts = ["", "the word", "  the  words ", "\u00e9\U0001f600 word"] + ["".join(draw.choice("the word abs\u00e9 ") for _ in range(draw.randrange(30))) for _ in range(500)]
    encode, decode = sentencepiece_codec.codec(path)
    ids, offs = encode(texts)
    back = [x.decode("utf-8", "replace") for x in decode(ids, offs)]
    same = sentencepiece_codec.same_as_library(path, texts, ids, offs, back)
    assert [t for t, ok in zip(texts, same, strict=True) if not ok] == []
    wrong = sentencepiece_codec.same_as_library(path, texts, ids, offs, ["x" + b for b in back])
    assert not wrong.any() and own.get_piece_size() == len(pieces)
    got = sentencepiece_codec.encoded(odd, path).collect()
    assert all(r.parity for r in got) and len(got) == len(ROWS)


def test_pcm_files_are_stored(spark, odd):
    files = media.store(odd)
    got = media.to_pcm(files).collect()
    texts = sorted((r[1] or "").encode() for r in ROWS)
    assert len(got) == len(ROWS)
    want = collections.Counter()
    for t in texts:
        codec, rate, block, data = media.unwav(media.stored(media.payload_of(t)))
        assert data == media.payload_of(t) and rate == 8000
        pcm = media.resample(media.expand(codec, data, block), 8000, 16000)
        want[pcm.astype("<i2").tobytes()] += 1
    assert collections.Counter(media.unwav(bytes(r.pcm))[3] for r in got) == want and all(media.unwav(bytes(r.pcm))[:2] == ("pcm", 16000) for r in got)
    assert {media.unwav(media.stored(media.payload_of(bytes([i]) * 70)))[0] for i in range(40)} == set(media.CODECS)
    nothing = spark.createDataFrame([(1, None)], "doc_id long, media binary")
    assert media.to_pcm(nothing).first().samples == 0


def test_resampling_keeps_a_tone():
    tone = (8000 * np.sin(np.arange(4000) * 2 * np.pi * 440 / 8000)).astype(np.int16)
    up = media.resample(tone, 8000, 16000)
    want = 8000 * np.sin(np.arange(8000) * 2 * np.pi * 440 / 16000)
    assert len(up) == 8000 and np.abs(up[100:-100] - want[100:-100]).max() < 120
    assert np.abs(media.resample(up, 16000, 8000)[100:-100] - tone[100:-100].astype(int)).max() < 200


def test_rounds_of_packing_are_as_good_as_one_by_one(spark):
    draw = random.Random(14)
    for sizes, capacity in (([draw.randrange(1, 101) for _ in range(700)], 100), ([draw.choice([1, 2, 3, 50, 51, 700, 1025, 2048]) for _ in range(900)], 2048), ([min(2048, int(draw.expovariate(1 / 500)) + 1) for _ in range(5000)], 2048), ([], 2048), ([7], 7)):
        counts = collections.Counter(sizes)
        lines, n = packing.rounds(spark, counts, capacity)
        held, seen = collections.Counter(), set()
        spans = collections.defaultdict(list)
        for length, rank, many, seq, at in zip(*(lines[k].tolist() for k in ("length", "rank", "many", "sequence", "offset")), strict=True):
            held[length] += many
            for i in range(many):
                assert (length, rank + i) not in seen
                seen.add((length, rank + i))
                spans[seq + i].append((at, at + length))
        assert held == counts and len(spans) <= n
        for own in spans.values():
            own.sort()
            assert own[0][0] == 0 and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False)) and own[-1][1] <= capacity
        _, best = packing.plan(counts, capacity)
        assert len(spans) <= best * 1.01 + 2


def test_pairwise_part_equals_the_sum_over_pairs():
    draw = np.random.default_rng(5)
    model = quality.Machine()
    model.w, model.v = (draw.normal(0, 0.3, x.shape).astype(np.float32) for x in (model.w, model.v))
    model.fitted = True
    texts = pa.chunked_array([pa.array(["a b a c", "", None, "One two, THREE 4 #5!\n" * 3])])
    stats, before, bucket, value = quality.inputs(texts, pa.chunked_array([pa.array([7, None, 0, 60])]))
    got = model.score(stats, before, bucket, value)
    for i in range(4):
        at = list(range(len(quality.STATS))) + [len(quality.STATS) + int(b) for b in bucket[before[i] : before[i + 1]]]
        x = [*stats[i], *value[before[i] : before[i + 1]]]
        z = sum(float(model.w[a]) * v for a, v in zip(at, x, strict=True))
        z += sum(float(model.v[at[j]].astype(float) @ model.v[at[k]].astype(float)) * x[j] * x[k] for j in range(len(at)) for k in range(j + 1, len(at)))
        assert abs(got[i] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-3


def test_languages_equal_brute_force(spark):
    """Byte n-grams counted one by one, ranks compared one by one."""
    draw = random.Random(12)
    vocab = {"en": "the and of to in is house water".split(), "de": "der und die das ist haus wasser nicht".split(), "fr": "le et la de est maison eau \u00e9t\u00e9".split()}
    rows = [(i, " ".join(draw.choice(vocab[k]) for _ in range(draw.randrange(1, 40))), k) for i in range(60) for k in [draw.choice(list(vocab))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def grams(text):
        gap = re.sub(rb"[^a-z\x80-\xff]+", b" ", (" " + text.lower() + " ").encode())
        out = collections.Counter()
        for n in (1, 2, 3):
            for i in range(len(gap) - n + 1):
                g = gap[i : i + n]
                if (n == 1 and g != b" ") or (n == 2 and g != b"  ") or (n == 3 and g[1:2] != b" "):
                    out[g] += 1
        return out

    def code(g):
        # as profiles order ties: the number of the n-gram's bytes, first byte highest
        return int.from_bytes(g.ljust(3, b"\0"), "big")

    known = langid.profiles(docs, top=50)
    top = {}
    for k in vocab:
        total = collections.Counter()
        for _, t, lang in rows:
            if lang == k:
                total += grams(t)
        top[k] = [code(g) for g, n in sorted(total.items(), key=lambda x: (-x[1], code(x[0])))][:50]
    assert {k: v.tolist() for k, v in known.items()} == top
    got = {r.doc_id: r for r in langid.predict(docs, known, top=50).collect()}
    for i, t, _ in rows:
        own = [code(g) for g, n in sorted(grams(t).items(), key=lambda x: (-x[1], code(x[0])))][:50]
        far = {k: sum(abs(top[k].index(c) - p) if c in top[k] else 50 for p, c in enumerate(own)) for k in top}
        best = min(sorted(far), key=far.get)
        assert got[i].lang_pred == best and abs(got[i].score - max(0, 1 - far[best] / (len(own) * 50))) < 1e-9


def test_scores_of_ids_that_are_texts(spark):
    docs = spark.createDataFrame([("x1", "a b"), ("x2", None), (None, "a")], "doc_id string, text string")
    got = {r.doc_id: r for r in ctw.scored(docs).collect()}
    assert set(got) == {"x1", "x2", None} and got[None].held_out and got["x2"].n_tokens == 1


def test_pipeline_stages_equal_brute_force(spark):
    """Each stage on what its predecessor kept, over whole sf0.001."""
    import zlib

    import corpus_pipeline
    from lodestrata.llm.base import written

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(written(stage(spark, kept[-1], DIR)))
    rows = [[r.asDict() for r in d.collect()] for d in kept]
    ids = [[r["doc_id"] for r in x] for x in rows]
    assert all(d.columns == docs.columns for d in kept[:-1])
    good = {r.doc_id for r in quality.score(docs, quality.train(docs, labels)).collect() if r.score >= 0.7}
    assert sorted(ids[1]) == sorted(good) and 0 < len(good) < len(ids[0])
    lettered = {r["doc_id"] for r in rows[1] if any(c.isalpha() for c in r["text"] or "")}
    assert sorted(ids[2]) == sorted(lettered)
    first = {}
    for r in sorted(rows[2], key=lambda r: r["doc_id"]):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", r["text"] or ""), r["doc_id"])
    assert sorted(ids[3]) == sorted(first.values())
    bags = {}
    for r in rows[3]:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")]
        bags[r["doc_id"]] = collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    up = {i: i for i in bags}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    own = sorted(bags)
    for x, a in enumerate(own):
        for b in own[x + 1 :]:
            both = sum((bags[a] & bags[b]).values())
            if both >= 0.8 * (bags[a].total() + bags[b].total() - both):
                lo, hi = sorted((top(a), top(b)))
                up[hi] = lo
    assert sorted(ids[4]) == sorted(i for i in own if up[i] == i)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    t.encode_special_tokens = True
    pieces_of, places = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows[5]:
        pieces_of[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["offset"] + r["length"]))
    assert sorted(pieces_of) == sorted(ids[4])
    for r in rows[4]:
        want = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        got = sorted(pieces_of[r["doc_id"]], key=lambda p: p["piece"])
        assert sum(p["length"] for p in got) == len(want) and [p["start"] for p in got] == [0, *np.cumsum([p["length"] for p in got])[:-1]]
        assert all(p["ids_crc32"] == zlib.crc32(want[p["start"] : p["start"] + p["length"]].tobytes()) for p in got)
    for spans in places.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 2048 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_ctw_keys_alone_are_those_of_the_whole_step():
    for texts in ([b""], [b"", b" "], [b"a b a", b"", b"b a\tb", "é ü".encode() * 40], [b"x" * 300, b"x x x"]):
        data, offs = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
        whole = [own for _, own, _, _ in ctw._kinds(data, offs, np.zeros(len(texts), bool))]
        for own, alone in zip(whole, ctw._keys(data, offs), strict=True):
            assert own.dtype == alone.dtype and own.tolist() == alone.tolist()
