from collections import defaultdict

import numpy as np
import pytest

from tilesieve.llm import mixing as m


def slow_targets(sizes, weights, cap=3):
    total, capped = sum(sizes), {}
    while True:
        rest = total - sum(capped.values())
        w = sum(x for i, x in enumerate(weights) if i not in capped)
        share = {i: rest * weights[i] / w for i in range(len(sizes)) if i not in capped}
        new = {i: cap * sizes[i] for i, t in share.items() if t > cap * sizes[i]}
        if not new:
            return [float(capped[i]) if i in capped else share[i] for i in range(len(sizes))]
        capped |= new


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(3000):
        source = [None, "b", "ä", "a", "z", "tiny"][0 if i < 1000 else 5 if i == 2999 else int(rng.integers(1, 5))]
        rows.append((i, " ".join(["w"] * int(rng.integers(0, 60))) if i % 50 else None, source, "x"))
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string").repartition(4)


def test_targets_are_met(spark, docs):
    rows = m.taken(docs, docs_per_block=64).collect()
    text = {r.doc_id: (r.source, len((r.text or "").split())) for r in docs.collect()}
    assert {r.doc_id: r["size"] for r in rows} == {i: n for i, (_, n) in text.items()}
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        s = text[r.doc_id][0]
        sizes[s] += r["size"]
        taken[s] += r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 3 * r["size"]
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = slow_targets([sizes[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))])
    assert [target[s] for s in order] == pytest.approx(want)
    assert {r.source_size for r in rows if text[r.doc_id][0] is None} == {sizes[None]}
    for s, t in zip(order, want):
        assert abs(taken[s] - t) <= 0.5
    assert sorted(map(tuple, rows)) == sorted(map(tuple, m.taken(docs.repartition(7), docs_per_block=64).collect()))


def test_mix_takes_whole_documents_near_the_targets(spark, docs):
    mixed = m.mix(docs, docs_per_block=64, shards=8)
    assert mixed.columns == docs.columns
    got, size = defaultdict(int), defaultdict(int)
    for r in mixed.collect():
        got[r.source] += len((r.text or "").split())
    for r in docs.collect():
        size[r.source] += len((r.text or "").split())
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    for s, t in zip(order, slow_targets([size[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))])):
        assert abs(got[s] - t) <= 60


def test_tree_splits_exactly_and_evenly():
    counts = np.array([1000, 37, 0, 5])
    quota = m.split(counts, 13, seed=3)
    assert (quota.sum(axis=0) == counts).all() and (quota >= 0).all()
    totals = quota.sum(axis=1)
    assert totals.max() - totals.min() <= 4
    assert (m.split(counts, 13, seed=3) == quota).all() and (m.split(counts, 13, seed=4) != quota).any()


def slow_units(words, blocks, whole, rest, rank, seed):
    """Epochs, blocks and the words left of the last one, by plain loops over the permuted order."""
    out = [(e, b, None) for e in range(whole) for b in words]
    at = 0
    for b in blocks:
        if at >= rest:
            break
        out.append((whole, b, None if at + words[b] <= rest else rest - at))
        at += words[b]
    return sorted(out, key=str)


def test_units_are_whole_passes_and_the_first_blocks_of_one_more(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    rows = []
    for rank, n in enumerate((1, 7, 400)):
        words = rng.integers(1, 50, n).tolist()
        total = sum(words)
        whole, rest = divmod(int(2.4 * total) if rank else total // 2, total)
        rows += [(rank, b, n, whole, rest, w) for b, w in enumerate(words)]
    df = spark.createDataFrame(rows, "rank int, block long, blocks long, whole long, rest long, words long")
    order = defaultdict(list)
    for r in df.withColumn("perm", F.expr("shiftrightunsigned(xxhash64(rank, block, whole, 17, 1), 1)")).orderBy("perm", "block").collect():
        order[r["rank"]].append(r.block)
    # the upper half of the unsigned hash decides first
    for r in order:
        order[r] = [x.block for x in df.where(f"rank = {r}").orderBy(F.expr("shiftrightunsigned(xxhash64(rank, block, whole, 17, 1), 1)"), "block").collect()]
    for bucket in (4, 4096):
        got = defaultdict(list)
        for u in m.units_of(df, 17, bucket).collect():
            got[u["rank"]].append((u.epoch, u.block, u.left))
        for rank in range(3):
            own = [x for x in rows if x[0] == rank]
            words = {x[1]: x[5] for x in own}
            assert sorted(got[rank], key=str) == slow_units(words, order[rank], own[0][3], own[0][4], rank, 17)


def test_shards_follow_the_tree(spark):
    """Quotas of every shard are those of the split, units are disjoint and whole, for small buckets and more units than one task takes."""
    units = [(0, b, e, None) for b in range(9000) for e in range(2)] + [(1, b, 0, 5 if b == 3 else None) for b in range(40)] + [(3, 0, 0, None)]
    df = spark.createDataFrame(units, "rank int, block long, epoch long, left long").checkpoint()
    seen = []
    for seed, bucket in ((17, 4096), (17, 64), (18, 4096)):
        rows = m.deal(df, 4, 37, seed, bucket).collect()
        assert sorted((r["rank"], r.block, r.epoch) for r in rows) == sorted(u[:3] for u in units)
        quota = np.zeros((37, 4), dtype=np.int64)
        for r in rows:
            quota[r.shard, r["rank"]] += 1
        assert (quota == m.split(np.array([18_000, 40, 0, 1]), 37, seed)).all()
        seen.append(sorted(map(tuple, rows), key=str))
    assert seen[0] == seen[1] != seen[2]


def test_the_query_shows_the_tree(spark, docs, monkeypatch):
    kw = {"docs_per_block": 32, "shards": 11}
    rows = m.taken(docs, **kw).collect()
    assert all(r.taken == sum(d.words for d in r.draws) for r in rows)
    # rows of a block are drawn alike; units of a source by shard are the split's quotas
    p = m.plan(docs, **kw)
    counts, quota = np.zeros(6, dtype=np.int64), np.zeros((11, 6), dtype=np.int64)
    for r in p.units.collect():
        for u in r.units:
            counts[r["rank"]] += 1
            quota[u.shard, r["rank"]] += 1
    assert (quota == m.split(counts, 11, 17)).all()
    shards = defaultdict(set)
    for r in m.draws(docs, **kw).collect():
        for d in r.draws:
            shards[r["rank"], d.shard].add(d.epoch)
    assert {(r, s) for s in range(11) for r in range(6) if quota[s, r]} == set(shards)
    # another split gives another result
    real = m.quotas
    monkeypatch.setattr(m, "quotas", lambda spark, counts, shards, seed: real(spark, counts, 1, seed))
    other = m.taken(docs, **kw).collect()
    key = lambda r: str(r.doc_id)
    assert [r.taken for r in sorted(other, key=key)] == [r.taken for r in sorted(rows, key=key)]
    assert [r.draws for r in sorted(other, key=key)] != [r.draws for r in sorted(rows, key=key)]


def test_more_blocks_than_any_bucket(spark):
    df = spark.range(70_000).selectExpr("id AS doc_id", "repeat('w ', cast(id % 7 AS int)) AS text", "if(id % 3 = 0, 'hot', concat('s', id % 5)) AS source")
    rows = m.taken(df, docs_per_block=1, bucket=512).selectExpr("source_size", "target", "taken", "size").groupBy("source_size", "target").sum("taken").collect()
    assert len(rows) == 6 and all(abs(r["sum(taken)"] - r.target) <= 0.5 for r in rows)


def test_long_documents_keep_memory_bounded():
    import pandas as pd

    n = 300
    pdf = pd.DataFrame({"rank": 0, "doc_id": range(n), "th": 0, "size": [10_000_019 + 13 * k for k in range(n)], "times": 1, "left": 500_000_000, "epoch": 0, "perm": range(n)})
    got = m._fill(pdf, cut_last=False)
    assert abs(int(got["part"].sum()) - 500_000_000) <= 10_000_000


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b", "s", 1), (1, None, "s", 2), (2, "", None, 3)], "doc_id long, text string, source string, target int")
    got = {(r.doc_id, r["size"], r.taken) for r in m.taken(df).collect()}
    assert got == {(None, 2, 2), (1, 0, 0), (2, 0, 0)}
    assert m.taken(df.limit(0)).count() == 0 and m.mix(df.limit(0)).count() == 0
    assert m.taken(df.where("doc_id = 1")).first().taken == 0
    # names that clash, ids that are null or repeated, equal rows
    rows = [(None, "a b c", "s", 1, 2, 3, 4), (None, "d", "t", 1, 2, 3, 4), (7, "e f", "s", 1, 2, 3, 4), (7, "g", "s", 1, 2, 3, 4), (8, "h i", "t", 1, 2, 3, 4), (8, "h i", "t", 1, 2, 3, 4), (9, "", "t", 1, 2, 3, 4), (10, "k " * 200_000, "u", 1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _id int, _draws int, shard int, Row int")
    mixed = m.mix(df, weights=(1,))
    assert mixed.columns == df.columns and {r["Row"] for r in mixed.collect()} == {4}
    got = m.taken(df, weights=(1,)).collect()
    assert len(got) == 8 and {r.taken for r in got if r.doc_id == 8} <= {6, 4, 2, 0, 5} and sum(r.taken for r in got if r.doc_id == 9) == 0


def test_nearest_sums_equal_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(200):
        have = rng.integers(1, 40, rng.integers(0, 8)).tolist()
        want = int(rng.integers(0, 120))
        sums = {sum(x for k, x in enumerate(have) if m >> k & 1) for m in range(1 << len(have))}
        for below in (True, False):
            got = sum(have[k] for k in m.nearest_sum(have, want, below))
            assert got == max(x for x in sums if x <= want) if below else abs(got - want) == min(abs(x - want) for x in sums)
