import random
import zlib

import numpy as np
import pytest

from lodestrata.functions import reed_solomon as rs


def test_corrects_up_to_the_bound_and_reports_beyond():
    draw = np.random.default_rng(7)
    for _ in range(150):
        n = int(draw.integers(1, 224))
        data = draw.integers(0, 256, (1, n), dtype=np.uint8)
        word = np.concatenate([data, rs.parity(data)], axis=1)[0]
        lost = int(draw.integers(0, min(33, n + 32)))
        errors = int(draw.integers(0, (32 - lost) // 2 + 1))
        at = draw.permutation(len(word))[: lost + errors]
        bad = word.copy()
        bad[at] ^= draw.integers(1, 256, len(at), dtype=np.uint8)
        assert (rs.correct(bad, at[:lost]) == word).all()
    data = draw.integers(0, 256, (1, 223), dtype=np.uint8)
    word = np.concatenate([data, rs.parity(data)], axis=1)[0]
    for _ in range(40):
        bad = word.copy()
        bad[draw.permutation(255)[:40]] ^= draw.integers(1, 256, 40, dtype=np.uint8)
        assert rs.correct(bad) is None


@pytest.mark.parametrize(("size", "disk"), [(0, 0), (1, 33), (222, 254), (223, 255), (224, 288), (446, 510), (65536, 74944)])
def test_bodies_survive_a_burst(size, disk):
    plain = random.Random(size).randbytes(size)
    crc = zlib.crc32(plain)
    right = lambda b: zlib.crc32(b) == crc
    body = bytearray(rs.encode(plain))
    assert len(body) == rs.body_length(size) == disk
    assert rs.decode(bytes(body), size, right) == (plain, 0)
    burst = min(disk // 255 * 14 or 10, disk)
    body[5 : 5 + burst] = bytes(x ^ 0x5A for x in body[5 : 5 + burst])
    assert rs.decode(bytes(body), size, right)[0] == plain
