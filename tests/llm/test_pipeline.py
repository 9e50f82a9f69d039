import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline as cp
from tilesieve.llm import mixing, simhash_pivots

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs
    for name, f in cp.STAGES:
        f(spark, docs, SF).write.parquet(f"{top}/{name}")
        docs = out[name] = spark.read.parquet(f"{top}/{name}")
    return out


def test_stages_keep_the_columns(stages):
    for name, _ in cp.STAGES[:-1]:
        assert stages[name].columns == stages["documents"].columns
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "simhash_near_dedup", "substring_dedup", "source_mixing", "best_fit_packing"]


def test_stages_hand_over_small_batches(spark):
    key, docs = "spark.sql.execution.arrow.maxBytesPerBatch", spark.createDataFrame([], "doc_id long, text string, source string, n_chars int")
    for _, f in cp.STAGES[:1]:
        spark.conf.unset(key)
        f(spark, docs, "")
        assert spark.conf.get(key) == str(cp.BATCH_BYTES)


def test_quality_keeps_good_documents(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in stages["quality_rules"].collect()}
    text = {r.doc_id: r.text for r in stages["documents"].collect()}
    good = [r.doc_id for r in labels.where("quality = 1").collect() if len(text[r.doc_id].split()) >= 50]
    bad = [r.doc_id for r in labels.where("quality = 0").collect()]
    assert sum(i in kept for i in good) >= 0.99 * len(good) and sum(i in kept for i in bad) <= 0.05 * len(bad)


def shingles(text, n=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def groups(rows, least=0.8):
    """The smallest id that links of five-word shingle sets with at least this similarity reach, for each id."""
    ids = sorted(rows)
    sets, label = {i: shingles(rows[i]) for i in ids}, {i: i for i in ids}
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            lo = min(label[a], label[b])
            changed |= label[a] != label[b]
            label[a] = label[b] = lo
    return label


def test_near_dedup_against_brute_force(stages):
    before = {r.doc_id: r.text for r in stages["quality_rules"].select("doc_id", "text").collect()}
    label = groups(before)
    kept = {r.doc_id for r in stages["simhash_near_dedup"].collect()}
    copies = {i for i in before if label[i] != i}
    assert not (set(before) - kept) - copies  # nothing else goes
    assert len(copies) > 50 and len(copies - kept) >= 0.98 * len(copies)


def test_near_dedup_of_edited_copies(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    rows = {}
    for _ in range(60):
        base = rng.choices(vocabulary, k=rng.randint(60, 400))
        rows[len(rows)] = " ".join(base)
        for _ in range(5):
            copy = list(base)
            for at in rng.sample(range(len(base)), max(1, len(base) // rng.randint(50, 100))):
                copy[at] = rng.choice(vocabulary)
            rows[len(rows)] = " ".join(copy)
    passage = rng.choices(vocabulary, k=80)
    for _ in range(60):  # a passage in common does not make texts alike
        rows[len(rows)] = " ".join(rng.choices(vocabulary, k=150) + passage + rng.choices(vocabulary, k=100))
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(5)
    label = groups(rows)
    got = {r.doc_id: r.component_id for r in simhash_pivots.similar(df).collect()}
    assert all(got[i] in (i, *(j for j in rows if label[j] == label[i])) for i in rows)
    copies = [i for i in rows if label[i] != i]
    assert len(copies) > 150 and sum(got[i] != i for i in copies) >= 0.97 * len(copies)
    for chunk in (3, 2048):
        again = {r.doc_id: r.component_id for r in simhash_pivots.similar(df, chunk=chunk).collect()}
        assert sum(again[i] == got[i] for i in rows) >= 0.99 * len(rows)


def test_near_dedup_loses_no_pair_of_crowded_lists(spark):
    """Texts that share a passage told over and over have nearly one fingerprint, but only pairs of them are similar."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage, rows = [word() for _ in range(60)], {}
    for _ in range(80):
        own = [word() for _ in range(30)]
        edited = [*own[:15], word(), *own[16:]]
        for words in (own, edited):
            rows[len(rows)] = " ".join([*words, *passage * 20])
    for _ in range(10):  # the same shingles, but one line of many more times: fingerprints far apart
        own = [word() for _ in range(120)]
        for times in (1, 200):
            rows[len(rows)] = " ".join([*own, *own[-8:] * times])
    label = groups(rows)
    assert sum(label[i] != i for i in rows) == 90
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(5)
    for chunk in (2048, 20):
        assert {r.doc_id: r.component_id for r in simhash_pivots.similar(df, chunk=chunk).collect()} == label


def test_near_dedup_equals_brute_force_near_the_bound(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    rows = {0: None, 1: "", 2: "one", 3: "One", 4: "one two three four five"}
    for k in range(40):
        base = rng.choices(vocabulary, k=rng.randint(6, 900))
        rows[len(rows)] = " ".join(base)
        for _ in range(6):  # from a chain of edits, similarities around 0.8
            copy = list(base)
            for at in rng.sample(range(len(base)), max(1, len(base) // rng.randint(35, 55))):
                copy[at] = rng.choice(vocabulary)
            rows[len(rows)] = " ".join(copy)
            base = copy if k % 2 else base
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(5)
    label = groups(rows)
    for chunk in (2048, 3):
        assert {r.doc_id: r.component_id for r in simhash_pivots.similar(df, chunk=chunk).collect()} == label


def test_near_dedup_makes_a_pair_of_long_texts_once(spark, monkeypatch):
    """Long texts told from the same passages share many shingles; but a pair of texts is not made anew for each of these."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passages, rows = [[word() for _ in range(150)] for _ in range(40)], {}
    for _ in range(40):
        told = [w for p in rng.sample(passages, 12) for w in p] + [word() for _ in range(200)]
        rows[len(rows)] = " ".join(told)
    for i in (3, 7):
        rows[len(rows)] = rows[i] + " " + " ".join(word() for _ in range(100))
    seen, dealt = [], simhash_pivots._dealt

    def kept(keys, chunk, cols):
        if "component" in cols:
            seen.append(dealt(keys, chunk, cols))
        return dealt(keys, chunk, cols)

    monkeypatch.setattr(simhash_pivots, "_dealt", kept)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.component_id for r in simhash_pivots.similar(df).collect()} == groups(rows)
    made = seen[0].mapInArrow(lambda it: simhash_pivots._candidates(it, 0.8), "a long, b long, ca long, cb long").select("a", "b").collect()
    assert len(made) <= 4 * len(set(made))


def test_similar_sets_share_a_run_of_their_rarest():
    rng = np.random.default_rng(2)
    for similarity in (0.55, 0.8, 0.9):
        for run in range(1, simhash_pivots.run_length(similarity, 4) + 1):
            for _ in range(300):
                n = int(rng.integers(1, 60))
                extra = rng.integers(0, 1 << 63, (2, int(n * (1 / similarity - 1)) + 1), dtype=np.uint64)
                many = int(rng.integers(0, extra.shape[1]))
                one = int(rng.integers(0, many + 1))
                both = rng.integers(0, 1 << 63, n, dtype=np.uint64)
                x, y = (np.unique(np.r_[both, z]) for z in (extra[0, :one], extra[1, : many - one]))
                if len(np.intersect1d(x, y)) < similarity * len(np.union1d(x, y)):
                    continue
                some = np.unique(rng.choice(np.r_[x, y], 20))
                counts = rng.integers(2, 6, len(some))
                keys = [simhash_pivots.run_keys(simhash_pivots.rarest(z, some, counts, similarity, run), run) for z in (x, y)]
                assert len(np.intersect1d(*keys))
    assert simhash_pivots.run_length(0.4) == 1 and simhash_pivots.run_length(0.8) == 2


ROWS = "doc_id long, text string, lang string, source string, n_chars int, _id long, _draws int, Row int, _gone string, _text string, _unit int, size int, doc string"


def edge_rows():
    rng = random.Random(3)
    sentence = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(6, 14))).capitalize() + "."
    text = lambda n: " ".join(sentence() for _ in range(n))
    same = text(12)
    texts = [(0, None, "a"), (1, "", "a"), (2, " \n ", None), (3, same, "a"), (4, same, "b"), (4, same, "b"), (None, text(10), "a"), (None, text(10), None), (5, text(12_000), "c"), (6, text(9), None), (7, text(9) + " " + same, ""), (8, "short", "a")]
    return [(i, t, None if s is None else "en", s, len(t or ""), 1, 2, 3, None, "x", 4, 5, "y") for i, t, s in texts]


def test_stages_handle_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing names, in every stage."""
    docs = spark.createDataFrame(edge_rows(), ROWS)
    want = {"quality_rules": {None, 3, 4, 5, 6, 7}, "simhash_near_dedup": {None, 0, 3, 5, 6, 7, 8}, "substring_dedup": {None, 0, 1, 2, 3, 5, 6, 7, 8}}
    for name, f in cp.STAGES:
        got = f(spark, docs, "")
        rows = got.collect()
        if name in want:
            assert {r.doc_id for r in rows} == want[name], name
        if name != "best_fit_packing":
            assert got.columns == docs.columns and got.dtypes == docs.dtypes
            assert all(r.Row == 3 and r._draws == 2 and r.doc == "y" for r in rows)
        else:
            assert sum(r.piece == 0 for r in rows) == docs.count()
        assert f(spark, docs.limit(0), "").count() == 0
    # the stages after one another
    for k, (name, f) in enumerate(cp.STAGES):
        f(spark, docs, "").write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert docs.count() > 0


def test_substrings_lose_repeats_alone(stages):
    before = {r.doc_id: r.text for r in stages["simhash_near_dedup"].collect()}
    after = {r.doc_id: r for r in stages["substring_dedup"].collect()}
    assert set(after) <= set(before) and len(after) >= 0.95 * len(before)
    for i, r in after.items():
        assert r.n_chars == len(r.text)
        left = iter(before[i].split())
        assert all(w in left for w in r.text.split())  # what stays is there in the same order


def test_mix_is_near_its_targets(stages):
    before = stages["substring_dedup"].collect()
    size, got = defaultdict(int), defaultdict(int)
    for r in before:
        size[r.source] += len(r.text.split())
    mixed = stages["source_mixing"].collect()
    for r in mixed:
        got[r.source] += len(r.text.split())
    assert max(Counter(r.doc_id for r in mixed).values()) <= 3
    order = sorted(size, key=str.encode)
    for s, t in zip(order, mixing.targets([size[s] for s in order], [mixing.WEIGHTS[k % 3] for k in range(len(order))])):
        assert abs(got[s] - t) <= 0.01 * t + 100


def test_packing_holds_every_token(stages):
    rows = stages["best_fit_packing"].collect()
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(r.doc_id for r in stages["source_mixing"].collect())
    fill = defaultdict(int)
    for r in rows:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024 and sum(fill.values()) / len(fill) > 0.97 * 1024


def test_run(spark, stages):
    got = cp.run(spark, SF)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in got.collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in stages["best_fit_packing"].collect())
