"""Ids of texts by the tokenizers library, each distinct piece of text encoded once.

A byte-level BPE splits a text by a fixed pattern and merges within each piece alone, so a text's ids are
the ids of its pieces, one after another. The pieces are found for a whole block of texts at once from
the characters' classes; only pieces not met before by this worker go through the library.
"""

from __future__ import annotations

import itertools
import json
import os
import unicodedata

import numpy as np

#: Classes of characters for the pattern `'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+`.
OTHER, LETTER, NUMBER, BLANK = 0, 1, 2, 3
#: White space of Unicode.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: After an apostrophe that begins a piece.
SHORT = ["s", "t", "re", "ve", "m", "ll", "d"]
#: Pieces that a worker remembers before it starts afresh.
REMEMBERED = 400_000
_tables: dict[str, np.ndarray] = {}
_encoders: dict[tuple, Encoder] = {}
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _classes() -> np.ndarray:
    if "class" not in _tables:
        kind = np.array([{"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)], np.uint8)
        kind[WHITE] = BLANK
        _tables["class"] = kind
    return _tables["class"]


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and their n+1 offsets."""
    data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return data, np.append(0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))))


def starts_of(cp: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where the pieces of all texts begin."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[cp]
    head = np.zeros(n + 1, bool)
    head[offs] = True
    blank, space = kind == BLANK, cp == 32
    first = head[:n].copy()
    first[1:] |= kind[1:] != kind[:-1]
    # the last of several blanks, before something that isn't one, stands for itself
    last = blank.copy()
    last[:-1] &= ~blank[1:] & ~head[1:n]
    last[-1] = False
    first |= last
    # a space that stands so takes what follows with it
    joined = np.zeros(n, bool)
    joined[1:] = (last & space)[:-1] & ~head[1:n]
    first &= ~joined
    for i in np.flatnonzero((cp == 39) & first):
        end = int(offs[np.searchsorted(offs, i, "right")])
        after = "".join(map(chr, cp[i + 1 : min(i + 3, end)]))
        hit = next((x for x in SHORT if after.startswith(x)), None)
        if hit:
            first[i + 1 : i + 1 + len(hit)] = False
            if i + 1 + len(hit) < end:
                first[i + 1 + len(hit)] = True
    return np.flatnonzero(first)


class Encoder:
    """ids(texts) -> all ids, and n+1 offsets by text."""

    def __init__(self, encode, split):
        self.encode, self.split = encode, split
        self._forget()

    def _forget(self) -> None:
        """Of the pieces that are known: hashes in their order, and for each where its ids begin in the pool and how many there are."""
        self.known = np.zeros(0, np.uint64)
        self.first = self.size = np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _add(self, hashes: np.ndarray, found: list[str]) -> None:
        """hashes in their order, none known yet."""
        flat, size = self.encode(found)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        at = np.searchsorted(self.known, hashes)
        first = self.used + np.cumsum(size) - size
        self.known, self.first, self.size = (np.insert(old, at, new) for old, new in ((self.known, hashes), (self.first, first), (self.size, size)))
        self.used += len(flat)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        from .base import _grown, mix

        cp, offs = points(texts)
        at = self.split(cp, offs)
        if not len(at):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        if len(self.known) > REMEMBERED:
            self._forget()
        ends = np.append(at[1:], len(cp))
        sums = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum(mix((cp.astype(np.uint64) + np.uint64(1)) * _MUL) * _grown(0, len(cp)), out=sums[1:])
        h = mix((sums[ends] - sums[at]) * _grown(1, len(cp) + 1)[at] + (ends - at).astype(np.uint64))
        own, where, back = np.unique(h, return_index=True, return_inverse=True)
        slot = np.searchsorted(self.known, own)
        new = np.flatnonzero((slot == len(self.known)) | (self.known[np.minimum(slot, len(self.known) - 1)] != own)) if len(self.known) else np.arange(len(own))
        if len(new):
            whole = "".join(texts)
            lo, hi = at[where[new]].tolist(), ends[where[new]].tolist()
            self._add(own[new], [whole[a:b] for a, b in zip(lo, hi, strict=True)])
            slot = np.searchsorted(self.known, own)
        slot = slot[back]
        size = self.size[slot]
        total = np.append(0, np.cumsum(size))
        out = self.pool[np.repeat(self.first[slot] - total[:-1], size) + np.arange(total[-1])]
        return out, total[np.searchsorted(at, offs)]


def flattened(got: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, one piece after another, and how many each piece has."""
    size = np.fromiter(map(len, got), np.int64, len(got))
    return np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(size.sum())), size


def together(t, found: list[str], run: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """The ids of pieces. Those that begin with one space go through the library side by side in one text, where each is a word of its own; the others one by one."""
    spaced = np.fromiter((len(x) > 1 and x[0] == " " and not x[1].isspace() for x in found), bool, len(found))
    order = np.concatenate([np.flatnonzero(spaced), np.flatnonzero(~spaced)])
    many = int(spaced.sum())
    ids, sizes = [], []
    for at in range(0, many, run):
        own = [found[i] for i in order[at : min(at + run, many)]]
        e = t.encode("".join(own), add_special_tokens=False)
        size = np.bincount(np.array(e.word_ids, np.int64), minlength=len(own))
        flat = np.array(e.ids, np.uint32)
        if len(size) != len(own):  # the file splits otherwise than this module
            flat, size = flattened([x.ids for x in t.encode_batch(own, add_special_tokens=False)])
        ids.append(flat)
        sizes.append(size)
    flat, size = flattened([x.ids for x in getattr(t, "encode_batch_fast", t.encode_batch)([found[i] for i in order[many:]], add_special_tokens=False)])
    flat, size = np.concatenate([*ids, flat]), np.concatenate([*sizes, size]).astype(np.int64)
    back = np.argsort(order)
    start = (np.cumsum(size) - size)[back]
    size = size[back]
    total = np.cumsum(size) - size
    return flat[np.repeat(start - total, size) + np.arange(int(size.sum()))], size


#: What the pattern above is called in a tokenizers file: this pre-tokenizer with its own pattern, and no normaliser.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def forget() -> None:
    """Frees this worker's encoders: a worker that waits for its next task holds none."""
    _encoders.clear()


def byte_bpe(path: str, threads: int = 1) -> Encoder:
    """The encoder for a tokenizers file with the byte-level pattern above, kept by this worker until forget(). A file with another pattern or a normaliser raises ValueError."""
    if ("byte", path) not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        split = told.get("pre_tokenizer") or {}
        if told.get("normalizer") or any(split.get(k) != v for k, v in BYTE_LEVEL.items()):
            raise ValueError(f"{path} splits texts otherwise than by the byte-level pattern")
        t.encode_special_tokens = True
        _encoders["byte", path] = Encoder(lambda x: together(t, x), starts_of)
    return _encoders["byte", path]
