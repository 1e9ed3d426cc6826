"""Reed-Solomon over GF(2^8): 32 parity bytes, up to 223 data bytes, roots 2^0 to 2^31; many codewords at a time."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np

from lodestrata.functions.gf256 import EXP, LOG, PRODUCT, multiply

PARITY = 32
DATA = 255 - PARITY
#: Codewords that are mended at once.
WORDS = 2048
#: Codewords that get their parity at once.
PARITY_WORDS = 4096


def _times(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Product of two polynomials."""
    out = np.zeros(len(p) + len(q) - 1, np.int64)
    for i, c in enumerate(p):
        out[i : i + len(q)] ^= multiply(c, q)
    return out


@functools.cache
def _feedback() -> np.ndarray:
    """[place from the data's end][byte] -> the byte's 32 parity bytes, as four words."""
    g = np.ones(1, np.int64)
    for i in range(PARITY):
        g = _times(g, np.array([1, EXP[i]]))
    rest = np.zeros((DATA, PARITY), np.int64)
    rest[0] = g[1:]
    for k in range(1, DATA):
        rest[k] = np.append(rest[k - 1, 1:], 0) ^ multiply(rest[k - 1, 0], g[1:])
    table = multiply(np.arange(256)[None, :, None], rest[:, None, :]).astype(np.uint8)
    return table.view(np.uint64)


def parity(data: np.ndarray) -> np.ndarray:
    """(m, 32) parity of (m, k) data, k up to 223."""
    m, k = data.shape
    table, out = _feedback(), np.zeros((m, PARITY // 8), np.uint64)
    for at in range(0, m, PARITY_WORDS):
        some, own = np.ascontiguousarray(data[at : at + PARITY_WORDS].T), out[at : at + PARITY_WORDS]
        for i in range(k):
            own ^= table[k - 1 - i].take(some[i], axis=0)
    return out.view(np.uint8)


@functools.cache
def _powers(n: int) -> np.ndarray:
    """[k][place] -> 2^-(k * power of the place) in a word of n bytes."""
    power = np.arange(n)[::-1]
    return EXP[-np.outer(np.arange(PARITY + 1), power) % 255].astype(np.uint8)


@functools.cache
def _evaluation() -> np.ndarray:
    """[place of a remainder][byte] -> the byte's part of the polynomial at 2^0 .. 2^31, as four words."""
    power = EXP[np.outer(np.arange(PARITY)[::-1], np.arange(PARITY)) % 255]
    return PRODUCT[np.arange(256)[None, :, None], power[:, None, :]].view(np.uint64)


def _syndromes(rest: np.ndarray) -> np.ndarray:
    """Each remainder's polynomial at 2^0 .. 2^31."""
    table, out = _evaluation(), np.zeros((len(rest), PARITY // 8), np.uint64)
    for j in range(PARITY):
        out ^= table[j].take(rest[:, j], axis=0)
    return out.view(np.uint8)


def _values(polys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Polynomials (a row each, lowest power first) at every place of a word."""
    out = np.zeros((len(polys), at.shape[1]), np.uint8)
    for k in range(polys.shape[1]):
        live = np.flatnonzero(polys[:, k])
        if len(live):
            out[live] ^= PRODUCT[polys[live, k][:, None], at[k][None, :]]
    return out


def _remainders(words: np.ndarray) -> np.ndarray:
    """Parity of each word's data, added to the parity that it has: zero for a whole word, and a cheap way to its syndromes."""
    return parity(np.ascontiguousarray(words[:, :-PARITY])) ^ words[:, -PARITY:]


def correct_all(words: np.ndarray, erased: np.ndarray | None = None, size: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The codewords within 2 * errors + erasures <= 32 of words (a row each), and which rows have one; the others stay as they are.

    size: bytes of each row's word, which ends where the row ends; what stands before it is zero. None: all of the row.

    Berlekamp-Massey runs on all rows side by side and starts from the erasures' locators, so one polynomial a row covers
    errors and erasures; magnitudes are Forney's, and the results are checked.
    """
    m, n = words.shape
    if erased is None:
        erased = np.zeros((m, n), bool)
    count = erased.sum(axis=1)
    size = np.full(m, n) if size is None else size
    fit = (count <= PARITY) & (size > PARITY) & (n <= 255)
    out = np.where(erased, 0, words).astype(np.uint8)
    if not fit.any():
        return words, fit
    # the remainder has the word's syndromes, as it differs from it by a codeword
    s = _syndromes(_remainders(out))
    locator = np.zeros((m, PARITY + 1), np.uint8)
    locator[:, 0] = 1
    place = np.argsort(~erased, axis=1, kind="stable")[:, :PARITY]
    for j in range(int(np.minimum(count, PARITY).max(initial=0))):
        on = np.flatnonzero(count > j)
        x = EXP[n - 1 - place[on, j]].astype(np.uint8)
        locator[on, 1:] ^= PRODUCT[locator[on, :-1], x[:, None]]
    helper, degree = locator.copy(), count.astype(np.int64)
    for r in range(PARITY):
        gap = np.bitwise_xor.reduce(PRODUCT[locator[:, : r + 1], s[:, r::-1]], axis=1)
        on = count <= r
        helper[on] = np.concatenate([np.zeros((on.sum(), 1), np.uint8), helper[on, :-1]], axis=1)
        hit = on & (gap != 0)
        if not hit.any():
            continue
        better = locator ^ PRODUCT[gap[:, None], helper]
        longer = hit & (2 * degree <= r + count)
        degree = np.where(longer, r + 1 + count - degree, degree)
        inverse = EXP[(255 - LOG[gap]) % 255].astype(np.uint8)
        helper[longer] = PRODUCT[locator[longer], inverse[longer][:, None]]
        locator[hit] = better[hit]
    at = _powers(n)
    roots = (_values(locator, at) == 0) & (np.arange(n) >= n - size[:, None])
    top = PARITY - np.argmax(locator[:, ::-1] != 0, axis=1)
    fit &= (roots.sum(axis=1) == degree) & (top == degree)
    omega = np.zeros((m, PARITY), np.uint8)
    for k in range(PARITY):
        omega[:, k:] ^= PRODUCT[locator[:, k][:, None], s[:, : PARITY - k]]
    slope = locator[:, 1:].copy()
    slope[:, 1::2] = 0
    row, col = np.nonzero(roots & fit[:, None] & s.any(axis=1)[:, None])
    some = np.unique(row)
    spot = np.searchsorted(some, row), col
    above, below = _values(omega[some], at)[spot], _values(slope[some], at)[spot]
    out[row, col] ^= PRODUCT[PRODUCT[above, EXP[(255 - LOG[below]) % 255]], EXP[n - 1 - col]]
    fit[row[below == 0]] = False
    fit &= ~_remainders(out).any(axis=1)
    return np.where(fit[:, None], out, words), fit


def correct(word: np.ndarray, erased: np.ndarray | list[int] = ()) -> np.ndarray | None:
    """One word's codeword, None where there is none; erased: places."""
    lost = np.zeros((1, len(word)), bool)
    lost[0, np.asarray(erased, np.int64)] = True
    out, fit = correct_all(np.asarray(word, np.uint8)[None, :], lost)
    return out[0] if fit[0] else None


def body_length(size: int) -> int:
    """Bytes of the coded body."""
    full, rest = divmod(size, DATA)
    return 255 * full + (rest + PARITY if rest else 0)


def encode_all(plains: list[bytes]) -> list[bytes]:
    """Of each: codewords of 223 bytes and one shorter, interleaved byte by byte. Parity is made for all codewords side by side."""
    many = [-(-len(p) // DATA) for p in plains]
    words = np.zeros((sum(many), DATA), np.uint8)
    at = 0
    for plain, m in zip(plains, many, strict=True):
        full, rest = divmod(len(plain), DATA)
        data = np.frombuffer(plain, np.uint8)
        words[at : at + full] = data[: full * DATA].reshape(full, DATA)
        if rest:
            # zeros before a shorter word leave its parity as it is
            words[at + full, DATA - rest :] = data[full * DATA :]
        at += m
    check, at, out = parity(words), 0, []
    for plain, m in zip(plains, many, strict=True):
        full, rest = divmod(len(plain), DATA)
        if not full:
            out.append(plain + check[at : at + m].tobytes())
        else:
            last = rest + PARITY if rest else 0
            grid = np.zeros((255, m), np.uint8)
            grid[:DATA, :full], grid[DATA:, :full] = words[at : at + full].T, check[at : at + full].T
            if rest:
                grid[:rest, full], grid[rest:last, full] = words[at + full, DATA - rest :], check[at + full]
            out.append(grid[:last].tobytes() + grid[last:, :full].tobytes())
        at += m
    return out


def encode(plain: bytes) -> bytes:
    return encode_all([plain])[0]


class _Body:
    """A received body as a grid of codewords (a column each, the shorter one last and at its end), and which of its bytes are lost."""

    def __init__(self, body: bytes, size: int, lost: np.ndarray | None):
        self.size = size
        self.full, rest = divmod(size, DATA)
        self.last = rest + PARITY if rest else 0
        self.body, self.lost = body, lost

    def grid(self, cells: np.ndarray) -> np.ndarray:
        """(codewords, 255) of the body's bytes, or of marks of them."""
        if not self.full:
            out = np.zeros((1 if self.last else 0, 255), cells.dtype)
            out[:, 255 - self.last :] = cells
            return out
        wide = self.full + (self.last > 0)
        out, cut = np.zeros((wide, 255), cells.dtype), self.last * wide
        top, low = cells[:cut].reshape(self.last, wide), cells[cut:].reshape(255 - self.last, self.full)
        out[: self.full, : self.last], out[: self.full, self.last :] = top[:, : self.full].T, low.T
        if self.last:
            out[self.full, 255 - self.last :] = top[:, self.full]
        return out

    def text(self, words: np.ndarray) -> bytes:
        wide = words.shape[1]
        tail = words[self.full, wide - self.last : wide - PARITY].tobytes() if self.last else b""
        return words[: self.full, :DATA].tobytes() + tail

    def plain(self) -> bytes:
        return self.text(self.words()) if self.full else self.body[: self.size]

    def words(self) -> np.ndarray:
        return self.grid(np.frombuffer(self.body, np.uint8))

    def sizes(self) -> np.ndarray:
        return np.array([255] * self.full + [self.last] * (self.last > 0))


def decode_all(bodies: list[tuple[bytes, int, Callable[[bytes], bool], np.ndarray | None]]) -> list[tuple[bytes | None, int]]:
    """For each (body, size, is_right, lost): the plain body and the bytes mended; None where it can't be told. Damaged codewords of all bodies are mended side by side."""
    out: list[tuple[bytes | None, int] | None] = [None] * len(bodies)
    held: dict[int, _Body] = {}
    for i, (body, size, is_right, lost) in enumerate(bodies):
        own = _Body(body, size, lost)
        if is_right(first := own.plain()):
            out[i] = first, 0
        else:
            held[i] = own
    if not held:
        return out  # type: ignore[return-value]
    size = np.concatenate([own.sizes() for own in held.values()])
    # no word needs more room than the longest
    wide = int(size.max(initial=PARITY + 1))
    words = np.concatenate([own.words() for own in held.values()])[:, 255 - wide :]
    lack = np.concatenate([np.zeros((len(own.sizes()), 255), bool) if own.lost is None else own.grid(own.lost) for own in held.values()])[:, 255 - wide :]
    bad = np.flatnonzero(_remainders(words).any(axis=1) | lack.any(axis=1))
    fixed, right = np.zeros(len(words), np.int64), np.ones(len(words), bool)
    for at in range(0, len(bad), WORDS):
        some = bad[at : at + WORDS]
        good, right[some] = correct_all(words[some], lack[some], size[some])
        fixed[some] = (good != words[some]).sum(axis=1)
        words[some] = good
    at = 0
    for i, own in held.items():
        m = own.full + (own.last > 0)
        plain = own.text(words[at : at + m]) if right[at : at + m].all() else None
        out[i] = (plain if plain is not None and bodies[i][2](plain) else None), int(fixed[at : at + m].sum())
        at += m
    return out  # type: ignore[return-value]


def decode(body: bytes, size: int, is_right: Callable[[bytes], bool], lost: np.ndarray | None = None) -> tuple[bytes | None, int]:
    """The plain body and the number of bytes mended; None where it can't be told. `is_right` is its checksum test, `lost` marks lost bytes of body."""
    return decode_all([(body, size, is_right, lost)])[0]
