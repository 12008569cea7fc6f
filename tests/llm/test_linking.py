from __future__ import annotations

import random

import numpy as np

from airq.llm import linking


def sets(n, seed=5):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(60)]
    return [np.array(sorted({*rng.sample(base, rng.randrange(30, 60)), *(rng.getrandbits(64) for _ in range(rng.randrange(1, 12)))}), np.uint64) for _ in range(n)]


def flat_of(some):
    return np.concatenate(some), np.concatenate([[0], np.cumsum([len(x) for x in some])])


def test_shared_values_of_pairs():
    some = sets(40) + [np.array([1, 2, 3], np.uint64), np.array([2, 3], np.uint64), np.array([0, (1 << 64) - 1], np.uint64)]
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(some)), np.arange(len(some))))
    want = [len(set(some[i].tolist()) & set(some[j].tolist())) for i, j in zip(a, b)]
    assert linking.shared(*flat_of(some), a, b).tolist() == want
    sizes = np.array([len(x) for x in some])
    union = sizes[a] + sizes[b] - want
    assert linking._linked(*flat_of(some), a, b, 80).tolist() == (100 * np.array(want) >= 80 * union).tolist()


def test_links_within_blocks():
    some = sets(50)
    rng = np.random.default_rng(1)
    block = {"id": np.arange(50), "label": rng.integers(0, 12, 50), "is_left": rng.integers(0, 2, 50).astype(bool), "size": np.array([len(x) for x in some])}
    block["members"] = np.empty(50, object)
    block["members"][:] = some
    block["sig"] = np.zeros((50, 16), np.uint16)
    cuts = np.array([0, 20, 21, 50])
    got = {tuple(x[[0, 2, 3]]) for part in linking._compared(block, cuts, [0], 60) for x in part}
    want = set()
    for p, q in zip(cuts[:-1], cuts[1:]):
        for i in range(p, q):
            for j in range(p, q):
                one, other = set(some[i].tolist()), set(some[j].tolist())
                if block["is_left"][i] and not block["is_left"][j] and block["label"][i] != block["label"][j] \
                        and 100 * len(one & other) >= 60 * len(one | other):
                    want.add((i, block["label"][i], block["label"][j]))
    assert got == want and want


def test_a_set_of_many_pairs_is_decoded_once(spark):
    def decode(members):
        assert len(set(members)) == len(members)
        return linking.decoded(members)

    some = sets(9)
    members = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(some)], "id long, members binary")
    pairs = spark.createDataFrame([(i, 0) for i in range(1, 9)], "u long, v long").coalesce(1)
    got = {r.u for r in linking._confirmed(pairs, members, decode, 50).collect()}
    first = set(some[0].tolist())
    assert got == {i for i in range(1, 9) if 100 * len(first & set(some[i].tolist())) >= 50 * len(first | set(some[i].tolist()))}
