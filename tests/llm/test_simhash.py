import random

import numpy as np
import xxhash

from tilesieve.llm import simhash_pivots as sp
from tilesieve.llm.components import components


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def union_find(n, pairs):
    up = list(range(n))

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return [top(i) for i in range(n)]


def test_fingerprints_and_components_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    texts = [None, "", "  ", "one", "One", "one two three", "Über ALLES Ärger"]
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(80, 200))]
        texts.append(" ".join(base))
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    fps = [slow_fingerprint(t) for t in texts]
    n = len(texts)
    want = union_find(n, [(i, j) for i in range(n) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chunk in (2048, 3):  # with the small one, lists are cut into chunks
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in sp.near_duplicates(df, chunk=chunk).collect()}
        assert got == {i: (f"{fps[i]:016x}", want[i]) for i in range(n)}
    kept = sorted(r.doc_id for r in sp.keep_one(df).collect())
    assert kept == sorted(set(want))


def test_hot_lists_lose_no_connection(spark):
    # a chain in which each fingerprint is 4 bits from the next, shuffled, beside many far ones
    rng = random.Random(2)
    chain, x = [], rng.getrandbits(64)
    for _ in range(60):
        chain.append(x)
        for b in rng.sample(range(64), 4):
            x ^= 1 << b
    fps = list(dict.fromkeys([*chain, *(chain[0] ^ 1 << a ^ 1 << b for a in range(64) for b in range(a)), *(rng.getrandbits(64) for _ in range(300))]))
    rng.shuffle(fps)
    n = len(fps)
    arr = np.array(fps, dtype=np.uint64)
    pairs = [(int(i), int(j)) for i in range(n) for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 4) if j < i]
    want = union_find(n, pairs)
    classes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(arr)], "fp long, rep long")
    for chunk in (64, 4096):
        links = sp.class_links(classes, chunk=chunk).collect()
        assert all((fps[r.a] ^ fps[r.b]).bit_count() <= 4 for r in links)
        assert union_find(n, [(r.a, r.b) for r in links]) == want
        assert chunk < n or len(links) < 36 * n  # at most a forest for each of the 35 lists, not all pairs


def test_masks_hold_every_close_pair():
    rng = random.Random(0)
    masks = [m & (1 << 64) - 1 for m in sp.block_masks()]
    for _ in range(500):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 4):
            y ^= 1 << b
        assert any(x & m == y & m for m in masks)


def test_pivots_never_discard_a_close_pair():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    y = x ^ (np.uint64(1) << rng.integers(0, 64, 1000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 1000).astype(np.uint64))
    pivots = sp.make_pivots()
    assert (np.abs(sp.pivot_table(x, pivots) - sp.pivot_table(y, pivots)).max(axis=1) <= 2).all()


def test_components_of_random_graphs(spark):
    rng = random.Random(8)
    n = 300
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(220)] + [(0, i) for i in range(250, 300)] + [(i, i + 1) for i in range(100, 140)]
    want = union_find(n, pairs)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {i: want[i] for i in linked}


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b", 1), (5, "a b", 2), (5, "c d e f g", 3), (7, "c d e f g", 4), (9, None, 5)], "doc_id long, text string, component_id int")
    got = {(r.doc_id, r.component_id) for r in sp.near_duplicates(df).collect()}
    assert got == {(None, None), (5, 5), (7, 5), (9, 9)}
    kept = sp.keep_one(df)
    assert kept.columns == df.columns and sorted(r.component_id for r in kept.collect()) == [1, 2, 3, 5]
    assert sp.near_duplicates(df.limit(0)).count() == 0
