import random
import re

from tilesieve.llm import sentence_spans as ss


def slow_removal(texts, run=3, unit=16, least=10):
    """Kept sentences of each text, by comparing every run with all earlier ones."""
    units, held = {}, {}
    for i, t in texts.items():
        own = []
        for part in re.split(r"(?<=[.!?])\s+|\n\s*", t or ""):
            words = part.split()
            own += [" ".join(words[k : k + unit]) for k in range(0, len(words), unit)]
        units[i] = own
    for i in sorted(units):
        for k in range(len(units[i]) - run + 1):
            held.setdefault(tuple(u.lower() for u in units[i][k : k + run]), (i, k))
    out = {}
    for i, own in units.items():
        gone = set()
        for k in range(len(own) - run + 1):
            key = tuple(u.lower() for u in own[k : k + run])
            if held[key] != (i, k) and sum(len(u.split()) for u in key) >= least:
                gone |= set(range(k, k + run))
        out[i] = [u for k, u in enumerate(own) if k not in gone]
    return out


def _sentence(rng):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(rng.randint(3, 30))).capitalize() + rng.choice([".", "!", "?"])


def test_removal_equals_brute_force(spark):
    rng = random.Random(7)
    passages = [[_sentence(rng) for _ in range(rng.randint(2, 7))] for _ in range(8)]
    texts = {}
    for i in range(120):
        parts = []
        for _ in range(rng.randint(1, 5)):
            parts += rng.choice(passages) if rng.random() < 0.5 else [_sentence(rng) for _ in range(3)]
        if i % 3 == 0:
            parts = [*passages[0], *parts]  # a passage that a third of all documents hold
        texts[i] = rng.choice([" ", "\n"]).join(parts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = slow_removal(texts)
    for r in ss.dedup_report(df, run=3, min_words=10).collect():
        assert " ".join(r.text.split()) == " ".join(want[r.doc_id]), r.doc_id
        assert all(f < r.doc_id for f in r.first_ids)


def test_one_sentence_passages_of_many_words(spark):
    rng = random.Random(1)
    words = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(n))
    long = words(55)
    texts = [f"{words(20)}.\n{long}\n{words(20)}." for _ in range(3)]
    got = {r.doc_id: r.text for r in ss.dedup_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0] == texts[0] and got[1].startswith(texts[1][:40]) and got[1].endswith(texts[1][-40:])
    for i in (1, 2):  # fewer words than a run has may stay of its end
        assert long[:20] not in got[i] and len(got[i].split()) < 40 + ss.MIN_WORDS


def test_passages_of_short_lines(spark):
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(n))
    for n in (1, 2, 3):
        menu = "\n".join(words(n) for _ in range(40))
        texts = [f"{words(12)}.\n{menu}\n{words(12)}." for _ in range(3)]
        got = {r.doc_id: r.text for r in ss.dedup_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
        assert got[0] == texts[0]
        for i in (1, 2):
            assert got[i] == "\n".join(texts[i].split("\n")[:1]) + "\n" + texts[i].split("\n")[-1]
    # too few words in all
    few = {r.doc_id: r.n_removed for r in ss.dedup_report(spark.createDataFrame([(0, "a b c\nd e f\ng h i"), (1, "a b c\nd e f\ng h i")], "doc_id long, text string")).collect()}
    assert few == {0: 0, 1: 0}


def test_passages_in_the_middle_of_sentences(spark):
    rng = random.Random(4)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    passage = words(300)
    texts = [" ".join([*words(n), *passage, *words(n + 9)]) for n in (7, 12, 20, 23, 38, 41, 55)]
    edited = [w if k % 60 else "edited" for k, w in enumerate(passage)]
    texts.append(" ".join([*words(5), *edited, *words(8)]))
    got = {r.doc_id: r.text.split() for r in ss.dedup_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0] == texts[0].split()
    for i in range(1, len(texts) - 1):
        assert len(set(passage) & set(got[i])) <= 32 and set(texts[i].split()) - set(passage) <= set(got[i])
    assert len(set(passage) & set(got[len(texts) - 1])) <= 150
    # a sentence of one word again and again has no such places, and is cut all the same
    assert [u[3] for u in ss.sentences("word " * 40)] == [16, 16, 8]


def test_clean_documents_are_left_alone(spark):
    rng = random.Random(2)
    texts = [" ".join([*[_sentence(rng) for _ in range(10)], "Read more here.", "All rights reserved."]) for _ in range(30)]
    got = {r.doc_id: (r.text, r.n_removed) for r in ss.dedup_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: (t, 0) for i, t in enumerate(texts)}


def test_rows_that_share_an_id_are_told_apart_by_text(spark):
    rng = random.Random(8)
    a, b, c = (" ".join(_sentence(rng) for _ in range(6)) for _ in range(3))
    df = spark.createDataFrame([(1, a), (2, f"{b} {a}"), (2, f"{a} {c}"), (2, f"{a} {c}"), (3, c)], "doc_id long, text string")
    got = sorted((r.doc_id, r.text.strip()) for r in ss.dedup_report(df).collect())
    assert [i for i, _ in got] == [1, 2, 2, 2, 3] and got[0][1] == a and (2, b) in got and got[4][1] == ""
    # a passage in the middle may leave its last words, fewer than a run has
    rest = [t for i, t in got if i == 2 and t != b]
    assert rest[0] == rest[1] and rest[0].endswith(c) and len(rest[0].split()) < len(c.split()) + ss.MIN_WORDS


def test_a_very_long_text(spark):
    rng = random.Random(9)
    part = " ".join(_sentence(rng) for _ in range(40))
    long = " ".join(_sentence(rng) for _ in range(20_000))
    df = spark.createDataFrame([(0, part), (1, f"{long} {part} {long}")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in ss.dedup_report(df).collect()}
    assert got[0] == part and len(got[1]) <= len(long) + 200 and got[1].startswith(long[:100_000])


def test_edges(spark):
    t = "One two three four. Five six seven eight. Nine ten eleven twelve."
    least = {"min_words": 10}
    df = spark.createDataFrame([(None, t, 1, "a"), (1, t, 65, "b"), (2, t, 65, "c"), (2, t, 65, "c"), (3, None, None, "d"), (4, "", 0, "e"), (5, t + "\nNew.", 70, "f"), (6, t + "\n" + t, 1, "g")], "doc_id long, text string, n_chars int, _text string")
    rows = sorted(map(tuple, ss.dedup_report(df, **least).select("doc_id", "text", "n_sentences", "n_removed", "first_ids").collect()), key=str)
    assert (None, t, 3, 0, []) in rows and (1, t, 3, 0, []) in rows and rows.count((2, "", 3, 3, [1])) == 2
    assert (3, None, 0, 0, []) in rows and (4, "", 0, 0, []) in rows and (5, "New.", 4, 3, [1]) in rows and (6, "", 6, 6, [1]) in rows
    kept = ss.remove_repeats(df, **least)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=lambda r: r[3]) == [(None, t, 1, "a"), (1, t, 65, "b"), (3, None, None, "d"), (4, "", 0, "e"), (5, "New.", 4, "f")]
    assert ss.dedup_report(df.limit(0)).count() == 0
