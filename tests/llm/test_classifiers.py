import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tilesieve.llm import quality_qda as qda
from tilesieve.llm import toxicity as tox

DATA = "/root/testdata/sf0.1"


def held_out(spark, module, label):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = module.classify(docs, labels).where("held_out").join(labels, "doc_id").select("score", "predicted", label).collect()
    return np.array([[r.score, r.predicted, r[label]] for r in rows])


@pytest.mark.parametrize("module,label,accuracy", [(tox, "toxic", 0.97), (qda, "quality", 0.97)])
def test_held_out_accuracy(spark, module, label, accuracy):
    x = held_out(spark, module, label)
    assert len(x) > 500 and ((x[:, 0] >= 0) & (x[:, 0] <= 1)).all()
    assert (x[:, 1] == (x[:, 0] >= 0.3)).all()
    assert (x[:, 1] == x[:, 2]).mean() >= accuracy
    pos, neg = x[x[:, 2] == 1, 0], x[x[:, 2] == 0, 0]
    assert (pos >= 0.3).mean() >= 0.9
    assert (pos[:, None] > neg[None, :]).mean() > 0.97


def test_counterfactuals_spare_neutral_mentions():
    """A group is named in toxic rows mostly; with the penalty its name adds little to a score."""
    rng = random.Random(4)
    rows, pairs = [], []
    for i in range(600):
        toxic = i % 2
        words = {rng.choice("red blue green house tree river stone cloud".split()) for _ in range(4)}
        if toxic and rng.random() < 0.6:
            words.add("idiot")
        if rng.random() < (0.8 if toxic else 0.05):
            words.add("women")
            pairs += tox.swaps("the women are here", tox.counterparts(tox.IDENTITY_TERMS))
        rows.append((toxic, sorted(tox.features(words))))
    with_penalty, without = (tox.fit(rows, pairs, 1.0, counterfactual=c) for c in (20.0, 0.0))
    shift = lambda m: abs(m.logit({f for f in tox.features({"women"}) if f in m.weights}) - m.logit({f for f in tox.features({"men"}) if f in m.weights}))
    assert shift(without) > 1 and shift(with_penalty) < 0.3 * shift(without)
    insult = [f for f in tox.features({"idiot"}) if f in with_penalty.weights]
    assert insult and with_penalty.score(set(insult)) > 0.6


def test_swaps_stay_within_a_kind_and_a_sentence():
    kinds = tox.counterparts(tox.IDENTITY_TERMS)
    found = tox.swaps("Women sing. Nothing here.\nThe deaf and the blind", kinds)
    assert len(found) == 1 + 1 + 1
    assert all(a and b and not set(a) & set(b) for a, b in found)
    chosen = {tox.word_features("men")[0]}
    assert tox.swaps("Women sing. The deaf.", tox.counterparts(tox.IDENTITY_TERMS, chosen), chosen) == [((), tuple(chosen))]


def slow_sample(rows):
    """Rows (label, text): features told apart, and the sums of swaps over given classes, plainly."""
    of = [(y, tox.features(set(tox._WORD.findall(t.lower())))) for y, t in rows]
    n = [sum(y == c for y, _ in rows) for c in (0, 1)]
    times = {f: [sum(f in x for y, x in of if y == c) for c in (0, 1)] for f in set().union(*(x for _, x in of))}
    chosen = set()
    for f, (neg, pos) in times.items():
        share = (neg + pos) / len(rows)
        error = math.sqrt(max(share * (1 - share), 1e-12) * (1 / n[0] + 1 / n[1]))
        if neg + pos >= tox.LEAST and abs(pos / n[1] - neg / n[0]) >= tox.APART * error:
            chosen.add(f)
    return of, chosen


def test_sample_equals_brute_force(spark):
    """Features, mined classes and swaps of the query's own sample against plain loops."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    x = tox.prepare(docs, labels)
    rows = sorted((r.doc_id, r.toxic, r.text or "") for r in docs.join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 4 <> 2").collect())
    of, chosen = slow_sample([r[1:] for r in rows])
    assert x.rows == [(y, sorted(fs & chosen)) for y, fs in of]
    assert x.classes and len(x.pairs) >= 5 and sum(x.often) > 500
    want = Counter()
    group = {w: c for c in x.classes for w in c}
    assert len(group) == sum(map(len, x.classes)) and not set(group) & {t for g in tox.IDENTITY_TERMS for t in g}
    for _, _, text in rows:
        for sentence in re.split(r"[.!?\n]+", text.lower()):
            words = set(tox._WORD.findall(sentence))
            for w in words & group.keys():
                for other in set(group[w]) - words:
                    a, b = (tox.features(v) & chosen for v in (words, words - {w} | {other}))
                    if a != b:
                        want[tuple(sorted(a - b)), tuple(sorted(b - a))] += 1
    assert want == dict(zip(x.pairs, x.often))
    clean = [set(tox._WORD.findall(t.lower())) for _, y, t in rows if not y]
    toxic = [set(tox._WORD.findall(t.lower())) for _, y, t in rows if y]
    assert all(sum(w in c for c in clean) >= max(tox.CLEAN_ROWS, tox.CLEAN_SHARE * len(clean)) and sum(w in c for c in toxic) >= tox.CLEAN_ROWS for w in group)


def test_the_penalty_acts_and_minimises_its_loss(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    x = tox.prepare(docs, labels)
    change = lambda m: sum(n * (sum(m.weights.get(f, 0) for f in won) - sum(m.weights.get(f, 0) for f in lost)) ** 2 for (lost, won), n in zip(x.pairs, x.often)) / sum(x.often)
    pos = sum(y for y, _ in x.rows)
    share = Counter(f for _, fs in x.rows for f in fs)

    def loss(m, counterfactual, l1=1e-3):
        total = 0.0
        for y, fs in x.rows:
            z = m.intercept - math.log(x.odds) + sum(m.weights.get(f, 0) for f in fs)
            total += math.log1p(math.exp(-z if y else z)) * 0.5 / (pos if y else len(x.rows) - pos)
        scale = {f: math.sqrt(max(share[f] / len(x.rows) * (1 - share[f] / len(x.rows)), 1 / len(x.rows))) for f in m.weights}
        return total + counterfactual / 2 * change(m) + l1 * sum(abs(w) * scale[f] for f, w in m.weights.items())

    with_penalty, without = (tox.fit(x.rows, x.pairs, x.odds, times_of=x.often, counterfactual=c, steps=3000) for c in (tox.COUNTERFACTUAL, 0.0))
    assert change(without) > 0.01 and change(with_penalty) < 0.1 * change(without)
    rng = random.Random(0)
    for m, c in ((with_penalty, tox.COUNTERFACTUAL), (without, 0.0)):
        at = loss(m, c)
        assert at <= loss(without if c else with_penalty, c) + 1e-9
        for _ in range(30):
            moved = tox.Model(m.intercept + rng.gauss(0, 0.05), {f: w + rng.gauss(0, 0.05) for f, w in m.weights.items()})
            assert loss(moved, c) >= at - 1e-7


def test_cholesky_density_equals_the_formula():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, len(qda.STATISTICS)))
    y = (np.arange(400) % 4 == 0).astype(int)
    x[y == 1] = 2 * x[y == 1] + 1
    m = qda.fit(x, y, (0.75, 0.25), to_pooled=0, to_diagonal=0, floor=0)
    a = len(qda.STATISTICS) / (len(qda.STATISTICS) + np.array([300, 100]))
    own = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    pooled = 0.75 * own[0] + 0.25 * own[1]
    for c, prior in ((0, 0.75), (1, 0.25)):
        cov = (1 - a[c]) * own[c] + a[c] * pooled
        v = x[:5] - x[y == c].mean(axis=0)
        want = math.log(prior) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", v, np.linalg.inv(cov), v)
        got = m.constants[c] - 0.5 * (((x[:5] - m.means[c]) @ m.factors[c].T) ** 2).sum(axis=1)
        assert got == pytest.approx(want)


@pytest.mark.parametrize("module,label", [(tox, "toxic"), (qda, "quality")])
def test_edges(spark, module, label):
    docs = spark.createDataFrame([(None, "a b c", 1), (1, None, 2), (2, "", 3), (3, "You idiot. " * 9, 4), (3, "You idiot. " * 9, 4), (4, "word " * 30000, 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(3, 1), (3, 0), (1, 0), (4, 0), (None, 1), (2, None), (77, 1)], f"doc_id long, {label} int")
    rows = module.classify(docs, labels).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out is not None for r in rows)
    assert module.classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in module.classify(docs, labels.limit(0)).collect()} == {0.0}
    assert {r.predicted for r in module.classify(docs, labels.where(f"{label} = 1")).collect()} == {1}


def slow_statistics(text):
    words = [w for w in re.split(r"[ \t\n\x0b\x0c\r]+", text) if w]
    if not words:
        return dict.fromkeys(qda.STATISTICS, 0.0)
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    windows = [tuple(words[i : i + 3]) for i in range(n - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    solid = [c for c in text if c not in " \t\n\x0b\x0c\r"]
    chars = len(solid)
    return {
        "words": n, "word_length": chars / n, "symbols": sum(c in "#*$%&|<>" for c in text) / n, "upper": sum(c != c.lower() for c in text) / chars,
        "exclamations": text.count("!") / n, "duplicate_lines": sum(x in lines[:i] for i, x in enumerate(lines)) / len(lines), "repeated_windows": len(inside) / n,
        "top_word": max(map(words.count, words)) / n, "distinct_words": len(set(words)) / n, "line_length": n / len(lines), "punctuation": sum(c in ".,;:?" for c in text) / n,
        "digits": sum(c in "0123456789" for c in text) / chars, "pipes": text.count("|") / n,
    }


def test_statistics_equal_brute_force(spark):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    texts += ["", " \n ", "a", "A b\x0bC", "x|y | 12 <b>\nx|y | 12 <b>\n\nZ! Z! Z! Z!", "Ünïcode ÇA va? 7\u00a08", "one two three one two three", "\u2003"]
    for t in texts:
        got, want = dict(zip(qda.STATISTICS, qda.statistics(t.encode()))), slow_statistics(t)
        assert got == pytest.approx(want), t[:80]
