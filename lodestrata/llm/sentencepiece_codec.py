"""SentencePiece models, encoded and decoded by the tokenizers library.

The model file is read as protobuf wire format, without its library: pieces, scores and kinds; model
type, byte fallback and unknown id; the normaliser's charsmap, dummy prefix and blank rules. From these
a Tokenizer is rebuilt: unigram models from the scores, BPE models with the merges that their scores
order. If no piece has the blank's marker after another character, no merge crosses the place before a
run of markers, so each word is encoded for itself, and only once by a worker.

Batches are encoded by `threads` threads of the library. Parity: SentencePiece itself encodes and decodes every whole
text, and both its ids and its text must be the same as here.

Control pieces have no text; decoding drops them. Defined results: a null text counts as empty and has
no ids. Rows keep their repeats; other columns are left out.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .base import blocks, documents, lean
from .pieces import Encoder, flattened

MARK = "▁"
MODEL = "piece_bpe_32k.model"
THREADS = 2
UNIGRAM, BPE = 1, 2
#: Kinds of pieces in the model file.
NORMAL, UNKNOWN, CONTROL, DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def wire(data: bytes):
    """(field, value) of a protobuf message: numbers, or bytes as they are."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or (number() if key & 7 == 2 else None)
        if size is None and key & 7 != 2:
            raise ValueError(f"wire type {key & 7} at byte {at}")
        yield key >> 3, data[at : at + (size or 0)]
        at += size or 0


class Model:
    """What a model file says, and the tokenizer rebuilt from it."""

    def __init__(self, path: str):
        self.pieces, self.scores, self.kinds = [], [], []
        trainer: dict[int, object] = {}
        rules: dict[int, object] = {}
        with open(path, "rb") as f:
            for field, value in wire(f.read()):
                if field == 1:
                    p = dict(wire(value))
                    self.pieces.append(p.get(1, b"").decode())
                    self.scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
                    self.kinds.append(p.get(3, NORMAL))
                elif field == 2:
                    trainer = dict(wire(value))
                elif field == 3:
                    rules = dict(wire(value))
        self.type = trainer.get(3, UNIGRAM)
        self.fallback = bool(trainer.get(35, 0))
        self.unknown = trainer.get(40, 0)
        self.charsmap, self.prefix, self.trim = rules.get(2, b""), bool(rules.get(3, 1)), bool(rules.get(4, 1))
        self.word_by_word = all(MARK not in p.lstrip(MARK) for p, k in zip(self.pieces, self.kinds, strict=True) if k == NORMAL)

    def normaliser(self):
        from tokenizers import Regex, normalizers

        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.trim:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip(left=True, right=True)]
        if self.prefix:
            steps.append(normalizers.Prepend(" "))
        return normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])

    def merges(self) -> list[tuple[str, str]]:
        """Pairs whose join is a piece; better pieces first, and for one piece, pairs with smaller ids first."""
        ids = {p: i for i, p in enumerate(self.pieces)}
        found = []
        for i, (piece, kind) in enumerate(zip(self.pieces, self.kinds, strict=True)):
            if kind == NORMAL:
                parts = [(ids[piece[:k]], ids[piece[k:]]) for k in range(1, len(piece)) if piece[:k] in ids and piece[k:] in ids]
                found += [(-self.scores[i], i, pair) for pair in sorted(parts)]
        return [(self.pieces[a], self.pieces[b]) for _, _, (a, b) in sorted(found)]

    def tokenizer(self, whole: bool = True):
        """whole: with the normaliser; otherwise for words that are normalised already."""
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        if self.type == UNIGRAM:
            t = Tokenizer(models.Unigram(list(zip(self.pieces, self.scores, strict=True)), self.unknown, self.fallback))
        elif self.type == BPE:
            t = Tokenizer(models.BPE({p: i for i, p in enumerate(self.pieces)}, self.merges(), unk_token=self.pieces[self.unknown], fuse_unk=True, byte_fallback=self.fallback))
        else:
            raise ValueError(f"model type {self.type}")
        if whole:
            t.normalizer = self.normaliser()
            if self.word_by_word:
                t.pre_tokenizer = pre_tokenizers.Split(Regex(MARK + "+"), "merged_with_next")
        return t

    def bytes_of(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that each id stands for, one after another, and n+1 offsets."""
        out = []
        for piece, kind in zip(self.pieces, self.kinds, strict=True):
            hit = re.fullmatch(r"<0x([0-9A-F]{2})>", piece) if kind == BYTE else None
            out.append(bytes([int(hit[1], 16)]) if hit else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else piece.replace(MARK, " ").encode())
        return np.frombuffer(b"".join(out), np.uint8), np.append(0, np.cumsum([len(x) for x in out]))


def _starts(cp: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where words begin: at each text's start and before each run of markers."""
    mark = cp == ord(MARK)
    first = mark.copy()
    first[1:] &= ~mark[:-1]
    head = offs[:-1][offs[:-1] < len(cp)]
    first[head] = True
    return np.flatnonzero(first)


@lru_cache(2)
def codec(path: str, threads: int = THREADS):
    """(encode, decode) of a model, kept by this worker. threads: of the library, for one batch."""
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
    m = Model(path)
    whole = m.tokenizer()
    plain = m.prefix and not m.trim and not m.charsmap

    def normalise(texts: list[str]) -> list[str]:
        if plain:
            return [(MARK + x.replace(" ", MARK)) if x else "" for x in texts]
        return [whole.normalizer.normalize_str(x) if x else "" for x in texts]

    if m.word_by_word:
        word = m.tokenizer(whole=False)
        fast = getattr(word, "encode_batch_fast", word.encode_batch)
        kept = Encoder(lambda found: flattened([e.ids for e in fast(found, add_special_tokens=False)]), _starts)
        encode = lambda texts: kept.ids(normalise(texts))
    else:

        def encode(texts):
            got = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
            return np.array([i for x in got for i in x], np.uint32), np.append(0, np.cumsum([len(x) for x in got])).astype(np.int64)

    table, edges = m.bytes_of()

    def decode(ids: np.ndarray, offs: np.ndarray) -> list[bytes]:
        n = np.diff(edges)[ids]
        total = np.append(0, np.cumsum(n))
        raw = table[np.repeat(edges[ids] - total[:-1], n) + np.arange(total[-1])].tobytes()
        ends = total[offs].tolist()
        out = [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        return [x[1:] if m.prefix and x[:1] == b" " else x for x in out]

    return encode, decode


@lru_cache(2)
def library(path: str):
    """SentencePiece's own processor, kept by this worker."""
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


def same_as_library(path: str, texts: list[str], ids: np.ndarray, offs: np.ndarray, back: list[str], threads: int = THREADS) -> np.ndarray:
    """Whether SentencePiece gives each text the same ids, and those the same text."""
    own = library(path)
    theirs = own.encode(texts, num_threads=threads)
    size = np.fromiter(map(len, theirs), np.int64, len(theirs))
    same = size == np.diff(offs)
    flat = np.fromiter(itertools.chain.from_iterable(theirs), np.uint32, int(size.sum()))
    if same.all():
        wrong = np.append(0, np.cumsum(flat != ids))
        same &= wrong[offs[1:]] == wrong[offs[:-1]]
    else:
        same &= np.array([x == ids[a:b].tolist() for x, a, b in zip(theirs, offs.tolist(), offs[1:].tolist(), strict=False)], bool)
    return same & np.array([x == y for x, y in zip(own.decode(theirs, num_threads=threads) if theirs else [], back, strict=True)], bool)


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text: str = "text", threads: int = THREADS, parity: bool = True) -> DataFrame:
    """id, ids, the decoded text, and with parity whether SentencePiece itself gives the same ids and text."""
    path = path or model_path()

    def run(batches):
        encode, decode = codec(path, threads)
        for t in blocks(batches, text=text):
            texts = [x or "" for x in t[text].to_pylist()]
            ids, offs = encode(texts)
            back = [x.decode("utf-8", "replace") for x in decode(ids, offs)]
            cols = [t[id_col].combine_chunks(), pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids.astype(np.int32))), pa.array(back, pa.string())]
            if parity:
                cols.append(pa.array(same_as_library(path, texts, ids, offs, back, threads), pa.bool_()))
            yield pa.RecordBatch.from_arrays(cols, [id_col, "ids", "decoded", "parity"][: len(cols)])
        codec.cache_clear()
        library.cache_clear()

    kind = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>, decoded string" + (", parity boolean" if parity else "")
    return docs.select(id_col, text).mapInArrow(lean(run), kind)


def digests(out: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_ids, CRC-32 of the ids as little-endian 32-bit numbers, SHA-256 of the decoded text, parity."""

    def run(batches):
        for t in blocks(batches, text="decoded"):
            b = t.combine_chunks().to_batches()[0]
            ids = [x.values.to_numpy().astype("<u4").tobytes() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.as_py().encode()).hexdigest() for x in b.column(2)]), b.column(3)], [id_col, "n_ids", "ids_crc32", "decoded_sha256", "parity"])

    return out.mapInArrow(lean(run), f"`{id_col}` {out.schema[id_col].dataType.simpleString()}, n_ids long, ids_crc32 long, decoded_sha256 string, parity boolean")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded, each held against SentencePiece."""
    return digests(encoded(documents(spark, sf_dir)))
