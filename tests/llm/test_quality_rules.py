import random
import re

from tilesieve.llm import quality_rules as q

PROSE = "the quick brown fox jumps over a lazy dog while seven wizards brew potent ale in quiet jars near old mill ponds and nobody asks why they keep on dancing through misty mornings with wet boots full of tiny pebbles or sing about summers gone where swallows once made homes under warm clay roofs"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    dup = sum(1 for i, x in enumerate(lines) if x in lines[:i])
    base = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), base


def test_counts_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t", "one", "é ü x y", "a b c a b c a", "l 1\nl 1\n\nl 1 ", PROSE, PROSE.upper(), "# " * 80 + PROSE, "word " * 20000]
    texts += ["".join(rng.choice(["a", "b", "ü", " ", "  ", "\n", "\t", "#", "x\x0by", "$"]) for _ in range(rng.randint(0, 300))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in q.quality_stats(df).collect():
        want = (20000, 80000, 0, 0, 20000, True) if r.doc_id == 10 else brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want


def test_order_never_changes_the_verdict(spark):
    texts = [PROSE, PROSE.upper(), " ".join(f"{w}###" for w in PROSE.split()), "!! ".join(PROSE.split()), PROSE + "\n" + "same line\n" * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    verdicts = [{r.doc_id: r.kept for r in q.quality_stats(df, order=order).collect()} for order in (list(q.RULES), list(q.RULES)[::-1])]
    assert verdicts[0] == verdicts[1] == {0: True, 1: False, 2: False, 3: False, 4: False}
    assert {r.doc_id for r in q.filter_quality(df).collect()} == {0}


def test_order_is_by_rejections_per_cost():
    m = q.Measured(100, {"a": 1.0, "b": 0.1, "c": 0.001}, {frozenset(): 45, frozenset("a"): 45, frozenset("b"): 10})
    assert q.cascade_order(m, dict.fromkeys("abc")) == ["b", "a", "c"]


def test_selectivity_is_conditional():
    """b rejects most, but hardly anything that a lets through; c's rejections are its own."""
    m = q.Measured(100, {"a": 1.0, "b": 1.2, "c": 1.0}, {frozenset(): 30, frozenset("ab"): 50, frozenset("b"): 1, frozenset("c"): 19})
    assert q.cascade_order(m, dict.fromkeys("abc")) == ["a", "c", "b"]


def test_measured_among_documents_that_the_base_rules_let_through(spark):
    texts = [PROSE, PROSE.upper(), "few words", "x y z " * 60]
    df = spark.createDataFrame([(i, texts[i % 4]) for i in range(80)], "doc_id long, text string")
    found = q.measure(df)
    assert found.documents == 40 and found.together == {frozenset(): 20, frozenset({"shouting"}): 20}
    assert set(found.seconds) == set(q.RULES) and all(s > 0 for s in found.seconds.values())
    none = q.measure(df.where("doc_id % 4 = 2"))
    assert none.documents == 0 and sorted(q.cascade_order(none)) == sorted(q.RULES)


def test_sample_is_spread_over_the_table(spark):
    # the first rows alone would tell nothing of the others
    df = spark.range(20_000, numPartitions=8).selectExpr("id AS doc_id", f"if(id < 15000, '{PROSE}', upper('{PROSE}')) AS text")
    found = q.measure(df, rows=1000)
    assert 800 < found.documents < 1200 and 0.2 < found.together[frozenset({"shouting"})] / found.documents < 0.3


def test_edge_tables(spark):
    df = spark.createDataFrame([(None, PROSE, True, 7), (1, None, True, 8), (2, PROSE, None, 9), (2, PROSE, None, 9)], "doc_id long, text string, kept boolean, n_words int")
    assert sorted((r.doc_id is None, r.doc_id or 0, r.kept) for r in q.quality_stats(df).collect()) == [(False, 1, False), (False, 2, True), (False, 2, True), (True, 0, True)]
    kept = q.filter_quality(df)
    assert kept.columns == df.columns and sorted(r.n_words for r in kept.collect()) == [7, 9, 9]
    assert q.quality_stats(df.limit(0)).count() == 0 and q.filter_quality(df.limit(0)).count() == 0
