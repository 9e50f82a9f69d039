import re

from tilesieve.llm import license_index as li

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"


def brute(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    at, labels = [], set()
    for phrase, label in li.BASE_PHRASES.items():
        p = phrase.split()
        here = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        at += here
        labels |= {label} if here else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_base_columns_equal_brute_force(spark):
    texts = [None, "", "MIT License", "mit-license; MIT\nLICENSE! license mit", "x Apache License, Version 2.0 and the GNU General Public License", "General public  LICENSE general public", "mit Kicense mit licenſe", "é_mit license_é", "Mit License " * 3000, "general general public license license", "smit license", "mit licenses"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in li.scan(df).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id]), texts[r.doc_id]
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def text_of(label, k=0):
    return [t for name, t, _ in li.TEMPLATES if name == label][k]


def labels_of(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: (r.base_labels, r.labels, r.score) for r in li.scan(df, **kw).collect()}


def test_templates_are_found_by_position(spark):
    filler = "the quick brown fox jumps over the lazy dog and runs into the wood to see what is there for any of its friends"
    shuffled = " ".join(sorted(MIT.split()))
    texts = [f"{filler}. {MIT}, {filler}", f"{filler} {shuffled}", filler, text_of("bsd").upper(), "Released under the MIT License", "the mit license"] + [filler] * 20
    got = labels_of(spark, texts)
    assert got[0] == ("", "mit", 1.0) and got[3] == ("", "bsd", 1.0) and got[4] == ("mit", "mit", 1.0)
    assert got[1] == got[2] == ("", "", 0.0)
    assert got[5][:2] == ("mit", "mit") and 0 < got[5][2] < 1  # the score of a row with a base phrase comes from its alignment too


def test_short_grants(spark):
    texts = ["Some words. Licensed under CC BY-NC 4.0.\nMore words.", "Licensed under CC BY 4.0", "under cc by nc sa 4.0, it is said", "# SPDX-License-Identifier: MIT", "by 4 0 nc cc licensed under", "nc cc by"] + ["other words by and under"] * 20
    got = labels_of(spark, texts)
    assert [got[i][1] for i in range(6)] == ["cc-by-nc", "cc-by", "cc-by-nc-sa", "mit", "", ""] and got[0][2] == 1.0 > got[2][2] > 0


def test_parts_of_a_notice_and_inserted_words(spark):
    """What a file holds of a notice is looked up, also where no file holds the rest of it, and gaps are small."""
    bsd = text_of("bsd").split()
    half = bsd[: bsd.index("permitted") + 1]
    holes = [x for w in half for x in ([w, "indeed"] if w == "use" else [w])]
    apart = half[:6] + ["filler"] * 40 + half[6:]
    texts = [" ".join(half), " ".join(holes), "permission is hereby granted free of charge", " ".join(apart), "x " * 500 + " ".join(half) + " y" * 500] + ["other words"] * 20
    got = labels_of(spark, texts)
    assert [got[i][1] for i in (0, 1, 2, 4)] == ["bsd", "bsd", "mit", "bsd"]
    assert got[3][2] < got[0][2]


def test_files_look_up_their_rarest_words(spark):
    common = "associated documentation files charge copy"
    df = spark.createDataFrame([(i, common if i % 3 else "other words hereby") for i in range(20)] + [(20, "granted")], "doc_id long, text string")
    t = next(t for t in li.build_index(df) if t.label == "mit" and len(t.postings) > 4)
    assert [w for w, _ in t.rarest] == ["granted", "hereby", *sorted(common.split())] and t.weight == sum(v for _, v in t.rarest[: li.LOOKUPS])
    df = df.unionByName(spark.createDataFrame([(21, MIT)], "doc_id long, text string"))
    few = {r.doc_id: r.score for r in li.scan(df, lookups=2).collect()}
    assert few[21] == 1.0 and not few[0]


def test_a_very_long_text_of_template_words(spark):
    got = labels_of(spark, ["license under the " * 60_000 + MIT, "mit license " * 50_000])
    assert got[0][1] == "mit" and got[1][:2] == ("mit", "mit")


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, MIT)], "doc_id long, text string")
    df.write.mode("overwrite").parquet(path := spark.conf.get("spark.checkpoint.dir") + "/license_plan")
    plan = li.scan(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "Scan parquet" in plan


def test_edges(spark):
    df = spark.createDataFrame([(None, MIT, "x"), (1, None, "y"), (2, MIT, None), (2, MIT, None)], "doc_id long, text string, words string")
    rows = li.scan(df).collect()
    assert len(rows) == 4 and sum(r.labels == "mit" for r in rows) == 3
    assert li.scan(df.limit(0)).count() == 0


def test_equals_sql_where_templates_are_found(spark):
    import random

    import duckdb
    import pandas as pd
    import pytest

    from tilesieve.llm.oracles import license_sql

    rng = random.Random(3)
    filler = "the of and to a in is it you that he was for on are with as his they be at one have this from".split()
    texts = [None, "", "MIT license and apache LICENSE; mit license"]
    for _, t, _ in li.TEMPLATES:
        words = t.split()
        texts += [" ".join([*rng.choices(filler, k=20), *words, *rng.choices(filler, k=20)]).title(), " ".join(words[: len(words) // 2]), " ".join(w for w in words if rng.random() < 0.8), " ".join(rng.sample(words, len(words)))]
    pdf = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    con = duckdb.connect()
    con.register("documents", pdf)
    want = {r[0]: r[1:] for r in con.sql(f"SELECT doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score FROM ({license_sql()})").fetchall()}
    got = {r.doc_id: tuple(r)[1:] for r in li.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(got) == len(texts) and {i: r[:-1] for i, r in got.items()} == {i: r[:-1] for i, r in want.items()}
    assert [got[i][-1] for i in sorted(got)] == pytest.approx([want[i][-1] for i in sorted(got)])
    assert sum(bool(r[5]) for r in got.values()) >= len(li.TEMPLATES)
    assert len({r[-1] for r in got.values()}) > 5


def test_documents_of_the_test_data(spark):
    """Every document with the short grant is labelled by the index, and no label of the index is missing from the SQL."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = li.scan(docs).join(docs.select("doc_id", "text"), "doc_id").where("labels <> base_labels or text like '%CC BY-NC%'").collect()
    assert len(rows) == 63 and all(r.labels == "cc-by-nc" and r.base_labels == "" and r.score == 1.0 for r in rows)
