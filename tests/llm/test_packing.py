import zlib
from collections import defaultdict

import numpy as np
import pytest

from tilesieve.llm import packing as p


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", "a", "Grüße aus Köln. " * 5, "word " * 3000, "x" * 5000, "<|endoftext|> here", "one two three four five"] + [f"text number {i} " * (i % 90 + 1) for i in range(200)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), texts


def test_ids_pieces_and_places(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    df, texts = docs
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = p.pack_documents(df, problem_pieces=64).collect()
    of = defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
    assert set(of) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        at = 0
        for k, r in enumerate(sorted(of[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert r.length == 1024 or k == 0
            at += r.length
        assert at == len(ids)
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    lens = [r.length for r in rows]
    assert p.lower_bound(np.array(lens), 1024) <= len(seqs) <= len(p.best_fit(sorted(range(len(lens)), key=lambda i: -lens[i]), lens, 1024)) + -(-len(lens) // 64)


def test_sequences_hold_the_ids(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    df, texts = docs
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    seqs, of = defaultdict(list), defaultdict(list)
    for r in p.pack_documents(df, problem_pieces=64).collect():
        assert len(r.ids) == 4 * r.length and r.ids_crc32 == zlib.crc32(r.ids)
        seqs[r.sequence_id].append((r.offset, r.ids))
        of[r.doc_id].append((r.piece, r.ids))
    for i, t in enumerate(texts):
        ids = np.frombuffer(b"".join(x for _, x in sorted(of[i])), dtype="<u4")
        assert ids.tolist() == [*tok.encode(t or "", add_special_tokens=False).ids, 2]
    for parts in seqs.values():
        assert all(offset == sum(len(x) // 4 for o, x in parts if o < offset) for offset, _ in parts)


def test_packing_is_the_same_again(spark, docs):
    df, _ = docs
    one, two = (sorted(map(tuple, p.pack_documents(df, problem_pieces=64).collect()), key=str) for _ in range(2))
    assert one == two


def _valid(packing, lens, most):
    assert sorted(i for b in packing for i in b) == list(range(len(lens)))
    assert all(sum(lens[i] for i in b) <= most for b in packing)


def test_crossover_keeps_every_item_once():
    rng = np.random.default_rng(1)
    lens = rng.integers(1, 100, 300).tolist()
    a = p.best_fit(list(range(300)), lens, 100)
    b = p.best_fit(sorted(range(300), key=lambda i: -lens[i]), lens, 100)
    for _ in range(20):
        a, b = p.crossover(a, b, lens, 100, rng), a
        _valid(a, lens, 100)


def test_evolution_finds_what_greedy_packings_miss():
    # up to three pieces to a full sequence; both first packings need one sequence more
    for seed in (17, 19, 37):
        rng = np.random.default_rng(seed)
        lens = []
        for _ in range(12):
            x, y = sorted(rng.integers(20, 80, 2).tolist())
            lens += [n for n in (x, y - x, 100 - y) if n > 0]
        first = [p.best_fit(sorted(range(len(lens)), key=lambda i: -lens[i]), lens, 100), p.best_fill(lens, 100)]
        best = p.evolve(lens, 100, [], (0,), generations=300, population=8, patience=300)
        _valid(best, lens, 100)
        assert p.lower_bound(np.array(lens), 100) == len(best) == min(map(len, first)) - 1
        assert len(p.evolve(lens, 100, [], (0,), generations=0, population=8)) >= len(best)


def test_packed_ids():
    import zstandard

    z, back = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    for ids in ([], [0], [65_535, 1], [65_536], list(range(5000)), [2**32 - 1, 7]):
        raw = np.array(ids, dtype="<u4")
        assert p.unpack_ids(p.pack_ids(raw, z), back) == raw.tobytes()


def test_best_fill_is_a_packing():
    rng = np.random.default_rng(9)
    for n in (0, 1, 7, 500):
        lens = rng.integers(1, 101, n).tolist()
        _valid(p.best_fill(lens, 100), lens, 100)
    assert len(p.best_fill([60, 55, 45, 40], 100)) == 2


def test_lower_bound_against_exhaustive():
    assert p.lower_bound(np.array([6, 6, 6]), 10) == 3
    assert p.lower_bound(np.array([5, 5, 5, 5]), 10) == 2
    assert p.lower_bound(np.array([7, 4, 4]), 10) == 2
    assert p.lower_bound(np.array([10]), 10) == 1


def test_edges(spark):
    df = spark.createDataFrame([(None, "x y", 5), (3, "x y", 6), (3, "x y", 6)], "doc_id long, text string, length int")
    rows = p.pack_documents(df).collect()
    assert len(rows) == 3 and len({r.sequence_id for r in rows}) == 1 and sorted(r.offset for r in rows)[0] == 0
    assert p.pack_documents(df.limit(0)).count() == 0
