import hashlib
import random
import zlib

import numpy as np
import pytest

from tilesieve.llm import media_chunks as mc


def test_gear_hash_is_the_rolling_one():
    data = random.Random(1).randbytes(500)
    h, want = 0, []
    for b in data:
        h = (h << 1) + int(mc.GEAR[b]) & 0xFFFFFFFF
        want.append(h)
    assert mc.gear_hashes(data).tolist() == want


def test_cuts_move_with_the_content():
    rng = random.Random(2)
    data = rng.randbytes(60_000)
    a, b = (set(map(mc.digest, mc.chunks_of(x))) for x in (data, b"prefix" + data))
    assert len(a & b) >= len(a) - 2
    parts = mc.chunks_of(data)
    assert b"".join(parts) == data and all(mc.MIN_CHUNK <= len(p) <= mc.MAX_CHUNK for p in parts[:-1])
    assert mc.chunks_of(b"") == [] and mc.chunks_of(b"\xff" * 20_000)[0] == b"\xff" * mc.MAX_CHUNK


def test_round_trip_and_digests(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefghij ü") for _ in range(n))
    shared = text(9000)
    texts = [None, "", "a", "x" * 575, "y" * 576, "z" * 577, *(text(3000) for _ in range(5)), *([shared] * 9), *(text(700) + shared + text(700) for _ in range(6)), text(100_000), "q" * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = {r.doc_id: r for r in mc.media(df).collect()}
    assert set(rows) == set(range(len(texts)))
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        stored = mc.encode_media(payload)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        x = np.frombuffer(payload, np.uint8).astype(int) - 128
        assert r.feature.startswith(f"chunks={len(mc.chunks_of(stored))};mean={x.mean():.4f};peak={abs(x).max()};")
    assert len({rows[i].feature for i in range(11, 20)}) == 1


def test_damage_is_noticed():
    media = mc.encode_media(mc.payload_of(b"some text " * 300))
    store = {mc.digest(c): c for c in mc.chunks_of(media)}
    order = list(map(mc.digest, mc.chunks_of(media)))
    sha = hashlib.sha256(media).digest()
    assert mc.assemble(order, store, sha[: mc.KEY_BYTES]) == (media, sha) and mc.decode_media(media) == media[44:]
    with pytest.raises(ValueError):
        mc.assemble(order, store | {order[0]: b"x" + store[order[0]][1:]}, sha)
    with pytest.raises(ValueError):
        mc.assemble(order, {}, sha)
    with pytest.raises(ValueError):
        mc.assemble(order, store, hashlib.sha256(b"other").digest())
    with pytest.raises(ValueError):
        mc.decode_media(b"RIFX" + media[4:])


def test_edges(spark):
    df = spark.createDataFrame([(None, "a", "x"), (None, "b", "x"), (1, "a", "y"), (1, "a", "y"), (1, "c", "z")], "doc_id long, text string, digests string")
    rows = mc.media(df).collect()
    assert sorted((r.doc_id or 0, r.n_bytes) for r in rows) == [(0, 1), (0, 1), (1, 1), (1, 1), (1, 1)] and len({r.payload_sha256 for r in rows}) == 3
    assert mc.media(df.limit(0)).count() == 0


def test_store_and_manifest_hold_all_media(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    shared = text(6000)
    twice = text(4000)
    texts = [None, text(20_000), text(3000), shared, shared, text(500) + shared, twice + "!" * 40_000 + twice, twice + text(50)]
    listed, store = mc.stored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    files = [mc.encode_media(mc.payload_of((t or "").encode())) for t in texts]
    rows = mc.chunks(store).collect()
    assert sorted(bytes(r.digest) for r in rows) == sorted({mc.digest(c) for f in files for c in mc.chunks_of(f)})
    assert all(mc.digest(bytes(r.chunk)) == bytes(r.digest) for r in rows)
    order = {r.doc_id: bytes(r.digests) for r in listed.collect()}
    assert order == {i: b"".join(map(mc.digest, mc.chunks_of(f))) for i, f in enumerate(files)}
    assert sorted(bytes(r.media) for r in mc.restore(store).collect()) == sorted(set(files))
    assert store.where("length(foreign) > 0").count() >= 2
    # nothing is read back but from the store
    key = bytearray(hashlib.sha256(files[2]).digest()[: mc.KEY_BYTES])
    with pytest.raises(Exception, match="lacks a content"):
        mc.read_back(listed, store.where(store.key != key)).collect()
    with pytest.raises(Exception, match="lacks a chunk"):
        mc.read_back(listed, store.where("length(lent) = 0")).collect()


def test_dictionary_is_bounded_and_stored(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    df = spark.createDataFrame([(i, " ".join(rng.choices(words, k=600))) for i in range(300)], "doc_id long, text string")
    found = mc.dictionary(df, chunks=200, size=20_000)
    assert 0 < len(found) <= 20_000 and mc.dictionary(df.limit(0)) == b""
    listed, store = mc.stored(df)
    assert mc._dictionary_of(store) and mc.restore(store).count() == 300
