"""SimHash near-dedup with pivot distance tables.

1. Each document gets a 64-bit fingerprint: a bit is set if over half of its shingles' hashes set it.
2. Documents with the same fingerprint are one class, represented by their smallest id.
3. The pivot table is computed once for each class: the Hamming distances of its fingerprint to many
   reference fingerprints, packed in two numbers that go with it.
4. Fingerprints within `max_distance` bits agree on some combination of bit blocks: of 7 blocks at
   most 4 can differ, so 3 agree. Each class is listed under all 35 combinations (pigeonhole). This
   only brings candidates together; no single pivot distance could serve as a key of a join, as
   distances to any one fingerprint are spread over a few values near 32.
5. Among candidates, the pivot tables decide: distances of two fingerprints to the same pivot differ
   at most by the distance between the two, so a pair with a larger coordinate difference is
   discarded; survivors are verified by their exact distance. A list is kept in the order of its first
   coordinate, so that only a window of it is looked at.
6. Of each candidate list only a spanning forest of its links goes on, found by a search that drops
   a fingerprint as soon as it is reached. That loses no connection, and a list of n near copies
   gives n-1 links, not all pairs. Lists above `CHUNK` are cut into chunks, and each pair of chunks
   is a list of its own.
7. Components of the links are found by star contraction.

`similar` is for texts whose shingle sets have a Jaccard similarity of at least `SIMILARITY`, whose
fingerprints differ in about ten bits. No exact combination of blocks brings these together, so
classes (there: equal words) are listed under `BANDS` min-hash keys, the forests of lists and each
class's `NEAREST` links within `WIDE` bits are verified by the exact similarity of their texts, and
their components are found. That is only a quick start, which spares most of the work of an exact join
of what is still apart (`_apart`):

1. Each class is listed under pairs of neighbours among its rarest shingles (prefix filter with runs).
   Shingles are ordered by their frequency in a sample, then by hash; a sample can change how long
   lists are, never what is found. Of n shingles the rarest `RUN` * (1 - similarity) * n and one more
   are taken: what one set has alone can interrupt the common ones only so often that a run of `RUN`
   neighbours is left in common (`rarest`). Lists of one component go, lists of the same classes become one.
2. In a list, all pairs of different components are looked at. A pair is discarded only if it can't be
   similar, by the sizes of its sets and by parity maps, whose bits differ in at most as many
   places as the sets do, or if both rows name an earlier list in common, where it is looked at too.
3. Of each two components the pair with the nearest maps is verified first. Then all pairs that are
   still between different components are verified, however many they are.

Defined results: null and empty texts have fingerprint zero and are linked like any others. A text
of fewer words than a shingle is one shingle. Rows that share an id are one document with several
fingerprints' classes joined. A null id is never linked: its component is null. An empty table gives
an empty result. Other columns are ignored, whatever their names; `keep_one` and `keep_one_similar`
keep them.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilesieve.llm.common import BROADCAST_ROWS, cut_lineage, id_text_batches, small, with_id_and_text
from tilesieve.llm.components import components

SHINGLE = 4
HASH_SEED = 42
MAX_DISTANCE = 4
BLOCKS = 7
PIVOTS = 16
CHUNK = 2048

#: For `similar`: words of a shingle, least Jaccard similarity, largest distance, and min-hash keys of so many values each.
SIMILAR_SHINGLE, SIMILARITY, WIDE, BANDS, BAND_VALUES = 5, 0.8, 18, 10, 4

#: For `similar`: besides the forest, which a link that turns out too weak could tear, each text is linked to so many nearest ones of a list.
NEAREST = 2

#: For `similar`: pairs that a task verifies, on average.
VERIFIED = 1024

#: For the exact join: bits of the parity maps that go into lists, classes in the sample, least count of a frequent shingle there, and the most of these.
SHORT, SAMPLE, OFTEN, FREQUENT = 512, 2048, 2, 1 << 16

#: For the exact join: neighbouring shingles to a key, and the lists that a row names, of all that its class is in.
RUN, HEAD = 2, 8

_UPPER = bytes(range(65, 91))
_LOWERED = bytes.maketrans(_UPPER, _UPPER.lower())


def shingle_hashes(data: bytes, shingle: int = SHINGLE, seed: int = HASH_SEED) -> Iterator[np.ndarray]:
    """The unsigned hashes of a UTF-8 text's shingles, repeats included, some thousands at a time."""
    words = data.translate(_LOWERED).split()
    if not words:
        return
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    step = 1 << 14
    for at in range(0, n, step):
        yield np.array([digest(joined[i:j], seed) for i, j in zip(starts[at : at + step], stops[at : at + step])], dtype="<u8")


def fingerprint_of(parts: Iterable[np.ndarray]) -> int:
    counts, n = np.zeros(64, dtype=np.int64), 0
    for hashes in parts:
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(sum(1 << k for k in np.flatnonzero(2 * counts > n).tolist()))


def fingerprint(data: bytes, shingle: int = SHINGLE, seed: int = HASH_SEED) -> int:
    """The unsigned fingerprint of a UTF-8 text."""
    return fingerprint_of(shingle_hashes(data, shingle, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = HASH_SEED) -> DataFrame:
    """(doc_id, fp) with fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in id_text_batches(batches):
            fps = np.array([fingerprint(t, shingle, seed) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return with_id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def block_masks(max_distance: int = MAX_DISTANCE, blocks: int = BLOCKS) -> list[int]:
    """Bit masks, as signed longs, of which two fingerprints within the distance agree on at least one."""
    if not max_distance < blocks <= 64:
        raise ValueError("there must be more blocks than differing bits, and at most 64")
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    of = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    masks = [sum(c) for c in combinations(of, blocks - max_distance)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def pivot_table(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distances, fingerprints x pivots."""
    return np.stack([np.bitwise_count(fps ^ p) for p in pivots], axis=1).astype(np.int8)


def with_pivots(classes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """classes with the pivot table's row of each fingerprint: eight distances to a number, `p0` and so on."""
    for k in range(0, len(pivots), 8):
        parts = [F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(np.uint64(p).view(np.int64))))).cast("long"), 8 * i) for i, p in enumerate(pivots[k : k + 8])]
        classes = classes.withColumn(f"p{k // 8}", reduce(lambda a, b: a.bitwiseOR(b), parts))
    return classes


def make_pivots(n: int = PIVOTS, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False)


def spanning_links(fps: np.ndarray, side: np.ndarray | None, table: np.ndarray, max_distance: int = MAX_DISTANCE) -> Iterator[tuple[int, int]]:
    """Links (i, j) of a spanning forest of the pairs within the distance; side: only pairs across sides count."""
    order = np.argsort(table[:, 0], kind="stable")
    sides = [order] if side is None else [order[side[order] == k] for k in (0, 1)]
    first = [table[x, 0] for x in sides]
    seen = np.zeros(len(fps), dtype=bool)
    for root in range(len(fps)):
        if seen[root]:
            continue
        seen[root] = True
        stack = [root]
        while stack:
            i = stack.pop()
            k = 0 if side is None else 1 - int(side[i])
            # the maximum coordinate difference: a window by the first pivot, then pivot by pivot
            near = sides[k][np.searchsorted(first[k], table[i, 0] - max_distance) : np.searchsorted(first[k], table[i, 0] + max_distance, side="right")]
            near = near[~seen[near]]
            for p in range(1, table.shape[1]):
                if not len(near):
                    break
                near = near[np.abs(table[near, p] - table[i, p]) <= max_distance]
            near = near[np.bitwise_count(fps[near] ^ fps[i]) <= max_distance]
            seen[near] = True
            for j in near.tolist():
                yield i, j
                stack.append(j)
        if 4 * np.count_nonzero(seen) > 3 * len(fps) and len(sides[0]) > 64:  # those that were reached go now and then
            sides = [x[~seen[x]] for x in sides]
            first = [table[x, 0] for x in sides]


def nearest_links(fps: np.ndarray, side: np.ndarray | None, table: np.ndarray, max_distance: int, most: int) -> Iterator[tuple[int, int]]:
    """Links (i, j) of each fingerprint to the `most` nearest within the distance; side: only pairs across sides count."""
    order = np.argsort(table[:, 0], kind="stable")
    sides = [order] if side is None else [order[side[order] == k] for k in (0, 1)]
    first = [table[x, 0] for x in sides]
    for i in range(len(fps)):
        k = 0 if side is None else 1 - int(side[i])
        near = sides[k][np.searchsorted(first[k], table[i, 0] - max_distance) : np.searchsorted(first[k], table[i, 0] + max_distance, side="right")]
        near = near[near != i]
        near = near[(np.abs(table[near] - table[i]) <= max_distance).all(axis=1)]
        far = np.bitwise_count(fps[near] ^ fps[i])
        for at in np.argsort(far, kind="stable")[:most]:
            if far[at] <= max_distance:
                yield i, int(near[at])


def _lists(batches: Iterator[pa.RecordBatch], by: int = 4) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrow batches sorted by list, which the first columns name, with lists whole: what a batch leaves open goes to the next one."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols)]
        if not len(cols[0]):
            continue
        same = np.logical_and.reduce([c == c[-1] for c in cols[:by]])
        open_at = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        rest = [c[open_at:] for c in cols]
        if open_at:
            yield tuple(c[:open_at] for c in cols)
    if rest is not None and len(rest[0]):
        yield tuple(rest)


def _link(batches: Iterator[pa.RecordBatch], max_distance: int, nearest: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (which, key, c, d, mine, fp, rep, p0, p1) to links between classes."""
    for which, key, c, d, mine, fp, rep, *packed in _lists(batches):
        new = np.r_[True, (which[1:] != which[:-1]) | (key[1:] != key[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1])]
        start = np.flatnonzero(new)
        length = np.diff(np.r_[start, len(new)])
        fps = fp.view(np.uint64)
        table = np.concatenate([np.ascontiguousarray(x).view(np.int8).reshape(-1, 8) for x in packed], axis=1)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        # lists of two, the most by far, all at once
        two = start[(length == 2)]
        two = two[c[two] == d[two]]
        two = two[(np.abs(table[two] - table[two + 1]) <= max_distance).all(axis=1)]
        two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= max_distance]
        out.append((rep[two], rep[two + 1]))
        for s, n in zip(start.tolist(), length.tolist()):
            if n > 2 or n == 2 and c[s] != d[s]:
                part = slice(s, s + n)
                side = None if c[s] == d[s] else (mine[part] != c[s]).astype(np.int8)
                got = list(spanning_links(fps[part], side, table[part], max_distance))
                if nearest:
                    got += nearest_links(fps[part], side, table[part], max_distance, nearest)
                if got:
                    i, j = np.array(got).T
                    out.append((rep[part][i], rep[part][j]))
        a, b = (np.concatenate(x) for x in zip(*out))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def list_links(keys: DataFrame, max_distance: int, chunk: int = CHUNK, nearest: int = 0) -> DataFrame:
    """(a, b): a spanning forest of the links in each list, and each fingerprint's links to so many nearest ones; keys: which, key (of a list), fp, rep (a class's name), p0, p1."""
    return _dealt(keys, chunk, ["fp", "rep", "p0", "p1"]).mapInArrow(lambda it: _link(it, max_distance, nearest), "a long, b long")


def _dealt(keys: DataFrame, chunk: int, cols: list[str]) -> DataFrame:
    """Rows (which, key, c, d, mine, then cols) sorted by list. Of a list above the chunk each pair (c, d) of chunks is a list; cols start with two that tell rows apart."""
    hot = cut_lineage(keys.groupBy("which", "key").count().where(F.col("count") > chunk).select("which", "key", F.ceil(F.col("count") / chunk).cast("int").alias("chunks")))
    dealt = keys.join(small(hot), ["which", "key"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64(*cols[:2], F.lit(3)), F.col("chunks")).cast("int"))
    other = F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    listed = dealt.select("which", "key", "mine", *cols, F.explode(other).alias("other"))
    listed = listed.select("which", "key", F.least("mine", "other").alias("c"), F.greatest("mine", "other").alias("d"), "mine", *cols)
    by = ["which", "key", "c", "d"]
    return listed.repartition(*by).sortWithinPartitions(*by, *cols[:2])


def class_links(classes: DataFrame, max_distance: int = MAX_DISTANCE, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """(a, b) of classes (fp, rep): links that connect all fingerprints within the distance; rep is their names."""
    masks = F.array(*(F.lit(m) for m in block_masks(max_distance, blocks)))
    known = with_pivots(classes.select("fp", "rep"), make_pivots(PIVOTS))
    keys = known.select("fp", "rep", "p0", "p1", F.posexplode(masks).alias("which", "mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    return list_links(keys, max_distance, chunk)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_distance: int = MAX_DISTANCE, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """Per document: doc_id, fingerprint and component_id, the smallest id that links reach."""
    known = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    named = known.where(F.col("doc_id").isNotNull())
    classes = cut_lineage(named.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    links = class_links(classes, max_distance, blocks, chunk)
    # an id with several fingerprints links their classes
    own = named.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where(F.col("lo") != F.col("hi")).select("doc_id")
    several = named.join(own, "doc_id").join(classes, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(links.unionByName(several))
    labels = cut_lineage(classes.join(found, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id")))
    out = known.join(labels, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def _without(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """docs without the ids of gone; their columns can have any names."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"))
    gone = cut_lineage(gone.select(F.col("doc_id").alias("id")).distinct())
    kept = rows.join(small(gone), "id", "left_anti")
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """docs without those that a smaller id of their group stands for; rows with a null id stay."""
    found = near_duplicates(docs, id_col, text_col, **kw)
    return _without(docs, found.where(F.col("doc_id") != F.col("component_id")), id_col)


SHORT_COLS = [f"m{k}" for k in range(SHORT // 64)]
HEAD_COLS = [f"h{k}" for k in range(HEAD)]
SKETCH = "doc_id long, th long, content binary, fp long, keys array<long>"


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SIMILAR_SHINGLE, bands: int = BANDS, values: int = BAND_VALUES, seed: int = HASH_SEED) -> DataFrame:
    """Per row with an id: doc_id, th (hash of its text), content (hash of its words), fp, and min-hash keys."""
    rng = np.random.default_rng(seed)
    times = rng.integers(0, 1 << 63, bands * values, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    plus = rng.integers(0, 1 << 63, bands * values, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows = []
            for data in batch.column(2).cast(pa.binary()).to_pylist():
                least = np.full(bands * values, np.iinfo(np.uint64).max, dtype=np.uint64)
                parts = list(shingle_hashes(data or b"", shingle, seed))
                for h in parts:
                    for at in range(0, len(h), 1024):
                        mixed = h[at : at + 1024, None] * times + plus
                        least = np.minimum(least, (mixed ^ mixed >> np.uint64(32)).min(axis=0))
                own = least.reshape(bands, values)
                keys = [xxhash.xxh3_64_intdigest(x.tobytes()) for x in own]
                words = b" ".join((data or b"").translate(_LOWERED).split())
                rows.append((xxhash.xxh3_128_digest(words), fingerprint_of(parts), keys))
            cols = list(zip(*rows)) or [()] * 3
            fps = np.array(cols[1], dtype=np.uint64).view(np.int64)
            keys = [np.array(x, dtype=np.uint64).view(np.int64) for x in cols[2]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cols[0], pa.binary()), pa.array(fps), pa.array(keys, pa.list_(pa.int64()))], names=[x.split()[0] for x in SKETCH.split(", ")])

    return _hashed(docs, id_col, text_col).where(F.col("doc_id").isNotNull()).select("doc_id", "th", "text").mapInArrow(run, SKETCH)


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return with_id_and_text(docs, id_col, text_col).withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))


def shingle_set(data: bytes, shingle: int = SIMILAR_SHINGLE) -> np.ndarray:
    """The distinct hashes of a UTF-8 text's shingles, in order."""
    return np.unique(np.concatenate([np.empty(0, dtype=np.uint64), *shingle_hashes(data, shingle)]))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def jaccard(a: bytes, b: bytes, shingle: int = SIMILAR_SHINGLE) -> float:
    """Similarity of two texts' shingle sets; of two empty ones 1."""
    x, y = (shingle_set(t, shingle) for t in (a, b))
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / (len(x) + len(y) - common) if len(x) or len(y) else 1.0


def _verified(links: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The links (a, b) between classes whose texts are similar enough. Texts move once, to the links that they are an end of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 32):
            ok = [jaccard(x, y, shingle) >= similarity for x, y in zip(*(batch.column(k).cast(pa.binary()).to_pylist() for k in (2, 3)))]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    ends = cut_lineage(links.select("a", "b", F.explode(F.array("a", "b")).alias("rep")).join(classes.select("rep", "doc_id", "th"), "rep"))
    needed = cut_lineage(ends.select("doc_id", "th").distinct())
    if (n := needed.count()) <= BROADCAST_ROWS:  # then no other text moves
        texts = texts.join(small(needed, n), ["doc_id", "th"], "left_semi")
    found = ends.join(texts, ["doc_id", "th"]).select("a", "b", F.coalesce("text", F.lit("")).alias("text"), (F.col("rep") == F.col("a")).alias("first"))
    # a task gets few pairs, as a batch holds their texts
    found = found.repartition(max(8, ends.count() // (2 * VERIFIED)), "a", "b")
    pairs = found.groupBy("a", "b").agg(F.max_by("text", F.col("first")).alias("x"), F.min_by("text", F.col("first")).alias("y"))
    return pairs.mapInArrow(run, "a long, b long")


def rarest(hashes: np.ndarray, frequent: np.ndarray, counts: np.ndarray, similarity: float, run: int = 1) -> np.ndarray:
    """Of a set's rarest hashes, in order of rarity, so many that two sets of at least the similarity have `run` neighbours in common; frequent: hashes in order, with their counts."""
    most = min(len(hashes), math.floor(run * (1 - similarity) * len(hashes) + 1e-6) + 1)
    if not len(frequent):
        return hashes[:most]
    at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
    return hashes[np.lexsort((hashes, np.where(frequent[at] == hashes, counts[at], 0)))[:most]]


def run_length(similarity: float, most: int = RUN) -> int:
    """Neighbours to a key: the most for which `rarest` needs no more hashes than a set has."""
    return max([1, *(r for r in range(1, most + 1) if r * (1 - similarity) < 1 - 1e-6)])


def run_keys(ordered: np.ndarray, run: int) -> np.ndarray:
    """A hash for each run of so many neighbours; the first ones begin before the first hash."""
    padded = np.r_[np.zeros(run - 1, dtype=np.uint64), ordered]
    keys = np.zeros(len(ordered), dtype=np.uint64)
    for k in range(run):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + padded[k : k + len(ordered)]
        keys ^= keys >> np.uint64(29)
    return keys


def parity_map(hashes: np.ndarray, bits: int) -> np.ndarray:
    """For each value of the hashes' lowest bits whether an odd number has it, eight to a byte; bits is a power of two."""
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8))


def folded(parity: np.ndarray, size: int) -> np.ndarray:
    """A map of fewer bytes, the same as if made with them."""
    return np.bitwise_xor.reduce(parity.reshape(-1, size), axis=0)


def can_be_similar(differ, total, similarity: float):
    """Whether sets that differ in at least so many elements, with so many in all, can have the similarity."""
    return differ * (1 + similarity) <= total * (1 - similarity) + 1e-6


def _frequent(classes: DataFrame, texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles' hashes in order, and their counts, in a sample of classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            for data in batch.column(0).cast(pa.binary()).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(data or b"", shingle).view(np.int64))], names=["h"])

    one_of = max(1, classes.count() // SAMPLE)
    sample = cut_lineage(classes.where(F.pmod(F.xxhash64("content"), F.lit(one_of)) == 0).select("doc_id", "th"))
    hashes = texts.join(small(sample), ["doc_id", "th"], "left_semi").dropDuplicates(["doc_id", "th"]).select("text").mapInArrow(run, "h long")
    rows = hashes.groupBy("h").count().where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "h").limit(FREQUENT).collect()
    frequent, counts = np.array([r.h for r in rows], dtype=np.int64).view(np.uint64), np.array([r["count"] for r in rows], dtype=np.int64)
    order = np.argsort(frequent)
    return frequent[order], counts[order]


def _maps(texts: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, th, n, m0 .. m7, wide): the size of a text's shingle set, its short parity map, and one with two bits or more for each element."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            n, wide = [], []
            for data in batch.column(2).cast(pa.binary()).to_pylist():
                hashes = shingle_set(data or b"", shingle)
                n.append(len(hashes))
                wide.append(parity_map(hashes, max(SHORT, 1 << (2 * len(hashes)).bit_length())))
            short = np.array([folded(x, SHORT // 8) for x in wide], dtype=np.uint8).reshape(len(wide), SHORT // 8).view(np.int64)
            cols = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), *(pa.array(x) for x in short.T.copy()), pa.array([x.tobytes() for x in wide], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "th", "n", *SHORT_COLS, "wide"])

    return texts.mapInArrow(run, f"doc_id long, th long, n long, {', '.join(f'{c} long' for c in SHORT_COLS)}, wide binary")


def _prefixes(texts: DataFrame, frequent: np.ndarray, counts: np.ndarray, shingle: int, similarity: float) -> DataFrame:
    """(doc_id, th, n, keys): runs of a text's rarest shingles."""
    run_of = run_length(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            n, keys = [], []
            for data in batch.column(2).cast(pa.binary()).to_pylist():
                hashes = shingle_set(data or b"", shingle)
                n.append(len(hashes))
                keys.append(run_keys(rarest(hashes, frequent, counts, similarity, run_of), run_of).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "th", "n", "keys"])

    return texts.mapInArrow(run, "doc_id long, th long, n int, keys array<long>")


def _mixed(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Of rows (key, n, rep, component) sorted by key and n, those (key, rep) of lists with several components that have one of a near size beside them.

    The new key is a hash of a list's classes, so that lists of the same classes become one; others that it may join only get longer.
    """
    for key, n, rep, component in _lists(batches, 1):
        new = np.r_[True, key[1:] != key[:-1]]
        start = np.flatnonzero(new)
        mixed = np.minimum.reduceat(component, start) != np.maximum.reduceat(component, start)
        beside = ~new[1:] & can_be_similar(n[1:] - n[:-1], n[1:] + n[:-1], similarity)
        at = np.cumsum(new) - 1
        keep = mixed[at] & (np.r_[beside, False] | np.r_[False, beside])
        name = np.add.reduceat(np.where(keep, _scattered(rep), np.uint64(0)), start).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(name[at[keep]], pa.int64()), pa.array(rep[keep], pa.int64())], names=["key", "rep"])


def _scattered(x: np.ndarray) -> np.ndarray:
    """A hash of each number."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(times)
    return x ^ x >> np.uint64(31)


def _candidates(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Of rows (which, key, c, d, mine, n, rep, component, m0 .. m7, h0 .. h7) sorted by list and n, all pairs of different components that can be similar.

    h0 .. h7 are the least keys of a class's lists. A pair that has a lesser one in common than its list's meets there, and is left to that list.
    """
    names = ["a", "b", "ca", "cb"]

    def batch_of(out: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        a, b, x, y = (np.concatenate(z) for z in zip(*out))
        turn = a > b
        cols = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, y, x), np.where(turn, x, y)
        return pa.RecordBatch.from_arrays([pa.array(z, pa.int64()) for z in cols], names=names)

    for which, key, c, d, mine, n, rep, component, *more in _lists(batches):
        new = np.r_[True, (key[1:] != key[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1])]
        maps, heads = np.stack(more[: len(SHORT_COLS)], axis=1).view(np.uint64), more[len(SHORT_COLS) :]

        def pairs(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
            ok = (component[i] != component[j]) & can_be_similar(n[j] - n[i], n[j] + n[i], similarity) & ((c[i] == d[i]) | (mine[i] != mine[j]))
            i, j = i[ok], j[ok]
            ok = can_be_similar(np.bitwise_count(maps[i] ^ maps[j]).sum(axis=1, dtype=np.int64), n[j] + n[i], similarity)
            i, j = i[ok], j[ok]
            before = np.zeros(len(i), dtype=bool)
            for x in heads:
                for y in heads:
                    before |= (x[i] == y[j]) & (x[i] < key[i])
            i, j = i[~before], j[~before]
            return rep[i], rep[j], component[i], component[j]

        start = np.flatnonzero(new)
        length = np.diff(np.r_[start, len(new)])
        two = start[length == 2]
        out = [pairs(two, two + 1)]  # lists of two, the most by far, all at once
        waiting = len(out[0][0])
        for s, m in zip(start[length > 2].tolist(), length[length > 2].tolist()):
            step = max(1, (1 << 16) // m)
            for at in range(0, m, step):  # so many rows with all after them
                i, j = (x + s for x in np.nonzero(np.arange(at, min(at + step, m))[:, None] < np.arange(m)))
                out.append(pairs(i + at, j))
                waiting += len(out[-1][0])
                if waiting > 1 << 16:
                    yield batch_of(out)
                    out, waiting = [], 0
        if waiting:
            yield batch_of(out)


def _nearer(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, ca, cb, n, wide of each end) that can be similar by their wide maps, with the share far of elements that these tell apart."""
    for batch in _slices(batches):
        n = batch.column(4).to_numpy() + batch.column(6).to_numpy()
        differ = np.empty(len(n), dtype=np.int64)
        for k, (x, y) in enumerate(zip(batch.column(5).to_pylist(), batch.column(7).to_pylist())):
            size = min(len(x), len(y))
            x, y = (folded(np.frombuffer(z, dtype=np.uint8), size) for z in (x, y))
            differ[k] = np.bitwise_count(x ^ y).sum(dtype=np.int64)
        ok = pa.array(can_be_similar(differ, n, similarity))
        far = pa.array(differ / np.maximum(n, 1))
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], far], names=["a", "b", "ca", "cb", "far"]).filter(ok)


def _apart(group: DataFrame, texts: DataFrame, known: DataFrame, shingle: int, similarity: float, chunk: int) -> DataFrame:
    """(a, b, ca, cb, far): all pairs of classes in different components that can be similar, but for the known links (a, b); group: classes with their components."""
    frequent, counts = _frequent(group, texts, shingle)
    named = group.select("doc_id", "th", "rep", "component")
    # a class that is a component of its own is listed without the component's name, which takes room
    own = F.when(F.col("component") != F.col("rep"), F.col("component")).alias("component")
    keys = _prefixes(texts, frequent, counts, shingle, similarity).join(small(named, group.count()), ["doc_id", "th"]).select(F.explode("keys").alias("key"), "n", "rep", own)
    keys = keys.repartition("key").sortWithinPartitions("key", "n").select("key", F.col("n").cast("long").alias("n"), "rep", F.coalesce("component", "rep").alias("component"))
    lists = cut_lineage(keys.mapInArrow(lambda it: _mixed(it, similarity), "key long, rep long").distinct())
    heads = lists.groupBy("rep").agg(F.slice(F.array_sort(F.collect_list("key")), 1, HEAD).alias("head"))
    least = [F.coalesce(F.get("head", F.lit(k)), F.lit((1 << 63) - 1)).alias(c) for k, c in enumerate(HEAD_COLS)]
    listed = cut_lineage(named.join(heads, "rep").select(*named.columns, *least))
    # only what is in a list gets maps
    if (n := listed.count()) <= BROADCAST_ROWS:
        texts = texts.join(small(listed.select("doc_id", "th"), n), ["doc_id", "th"], "left_semi")
    maps = cut_lineage(_maps(texts, shingle).join(small(listed, n), ["doc_id", "th"]).drop("doc_id", "th").dropDuplicates(["rep"]))
    sizes = small(maps.drop("wide"), n)
    rows = lists.withColumn("which", F.lit(0)).join(sizes, "rep")
    pairs = _dealt(rows, chunk, ["n", "rep", "component", *SHORT_COLS, *HEAD_COLS]).mapInArrow(lambda it: _candidates(it, similarity), "a long, b long, ca long, cb long")
    pairs = pairs.groupBy("a", "b").agg(F.first("ca").alias("ca"), F.first("cb").alias("cb")).join(known, ["a", "b"], "left_anti")
    for end in "ab":
        pairs = pairs.join(maps.select(F.col("rep").alias(end), F.col("n").alias(f"n{end}"), F.col("wide").alias(f"wide{end}")), end)
    pairs = pairs.select("a", "b", "ca", "cb", "na", "widea", "nb", "wideb")
    return cut_lineage(pairs.mapInArrow(lambda it: _nearer(it, similarity), "a long, b long, ca long, cb long, far double"))


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY, max_distance: int = WIDE, bands: int = BANDS, values: int = BAND_VALUES, chunk: int = CHUNK) -> DataFrame:
    """Per row with an id: doc_id and component_id, the smallest id that links of at least the similarity reach."""
    known = cut_lineage(sketches(docs, id_col, text_col, shingle, bands, values))
    one = F.min(F.struct("doc_id", "th", "fp", "keys")).alias("one")  # its row with the smallest id names a class
    classes = cut_lineage(known.groupBy("content").agg(one).select("content", "one.*")).withColumn("rep", F.monotonically_increasing_id())
    table = with_pivots(classes, make_pivots(PIVOTS))
    keys = table.select("fp", "rep", "p0", "p1", F.posexplode("keys").alias("which", "key"))
    links = cut_lineage(list_links(keys, max_distance, chunk, NEAREST).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    texts = _hashed(docs, id_col, text_col).where(F.col("doc_id").isNotNull()).select("doc_id", "th", "text")
    ok = _verified(links, classes, texts, shingle, similarity)
    # an id with several texts links their classes
    named = known.select("doc_id", "content").join(classes.select("content", "rep"), "content")
    several = named.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where(F.col("a") < F.col("z"))
    several = named.join(several, "doc_id").where(F.col("rep") > F.col("a")).select("a", F.col("rep").alias("b"))
    found = components(ok.unionByName(several))
    named = classes.select("rep", "doc_id", "th", "content")
    group = cut_lineage(named.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")))
    # the exact way for all pairs that the forests and nearest links leave out
    pairs = _apart(group, texts, links, shingle, similarity, chunk)
    ends = [F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")]
    first = cut_lineage(pairs.groupBy(*ends).agg(F.min(F.struct("far", "a", "b")).alias("one")).select("one.a", "one.b"))
    joined = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
    if not first.isEmpty():
        joined = cut_lineage(joined.unionByName(_verified(first, classes, texts, shingle, similarity)))
        found = cut_lineage(components(joined))
        rest = pairs.join(first, ["a", "b"], "left_anti")
        for end in "ab":
            rest = rest.join(found.select(F.col("node").alias(end), F.col("component").alias(f"now_{end}")), end, "left").withColumn(f"now_{end}", F.coalesce(f"now_{end}", end))
        rest = cut_lineage(rest.where(F.col("now_a") != F.col("now_b")).select("a", "b"))
        if not rest.isEmpty():
            found = components(joined.unionByName(_verified(rest, classes, texts, shingle, similarity)))
        group = cut_lineage(named.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")))
    # written before the join, whose hot groups can then be split
    least = cut_lineage(group.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("classes")).where("classes > 1").drop("classes"))
    labels = cut_lineage(group.join(small(least), "component", "left").select("content", F.coalesce("component_id", "doc_id").alias("component_id")))
    return known.select("doc_id", "content").join(labels, "content").select("doc_id", "component_id")


def keep_one_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """docs without those that a smaller id of their group of `similar` stands for; rows with a null id stay."""
    return _without(docs, similar(docs, id_col, text_col, **kw).where(F.col("doc_id") != F.col("component_id")), id_col)
