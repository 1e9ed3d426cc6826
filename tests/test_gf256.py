import itertools
import random

from lodestrata.functions import gf256


def test_all_pairs_of_two_lost_records():
    draw = random.Random(5)
    bodies = [draw.randbytes(draw.randrange(1, 40)) for _ in range(16)]
    p, q = gf256.parity(bodies)
    for a, b in itertools.combinations(range(16), 2):
        got = gf256.rebuild([None if i in (a, b) else x for i, x in enumerate(bodies)], p, q)
        assert got[a][: len(bodies[a])] == bodies[a] and got[b][: len(bodies[b])] == bodies[b]


def test_what_cannot_be_rebuilt():
    bodies = [bytes([i] * 8) for i in range(16)]
    p, q = gf256.parity(bodies)
    assert gf256.rebuild([None, None, None, *bodies[3:]], p, q) is None
    assert gf256.rebuild([None, None, *bodies[2:]], p, None) is None
    assert gf256.rebuild([None, *bodies[1:]], p, None)[0] == bodies[0]
