"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Each source gets a target in words: all words shared by weight, at most `max_repeats` times the
   source's own words, the excess shared again (`targets`).
2. Each source's documents fall into blocks by a hash of id and text. A pass over the source takes each
   block once; a target of 2.4 times a source is two whole passes and the first blocks of a third, in
   an order permuted by seed. The block at which the target is met is taken in part, by documents.
   Each block of each pass is a unit.
3. A tree splits each source's count of units over the output shards: at a node, how many units of
   each source go left is one draw from the multivariate hypergeometric distribution, so that shards
   get equal numbers of units and quotas add up exactly at every level (`descend`).
4. A shard takes its quota as the next units of each source's permuted order. The shards' units are
   disjoint and together they are the whole mix. Within a shard rows are shuffled locally.

Blocks, units and shards are tables, as many as the corpus asks for. Orders within a source are found
in two steps, over buckets of about `BUCKET` units and within them, so that no task gets all units of
a source that holds a third of all rows. The tree is descended in two rounds: one task splits the root
into about the root of the number of shards, and each of these nodes is split on by itself. One row
for each source comes to the driver: a mix's sources are named in its catalogue with their weights.

Defined results: null or empty texts have size 0 and are taken with 0 words; a null source is a
source of its own, ordered last; a source without words has target 0; a table without words has an
empty mix; an empty table gives an empty result. Rows that are equal in id, source and text are taken
alike; other rows are taken on their own, with null ids or repeated ones too. Columns are kept
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilesieve.llm.common import cut_lineage, small

#: Characters between words, and the weights that sources take in turn.
BETWEEN = r"[\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)

MAX_REPEATS = 3
DOCS_PER_BLOCK = 256

#: Units of a bucket, within which one task finds their order.
BUCKET = 4096

#: Words of an output shard, which one task shuffles locally; there are as many shards as that takes.
SHARD_WORDS = 200_000

#: Bits that the search for the nearest sum of whole documents may hold.
SUM_BITS = 1 << 28


@dataclass
class Source:
    """A source of the catalogue: its rank is its place by code point, null last."""

    rank: int
    name: str | None
    docs: int
    words: int
    blocks: int = 1
    target: float = 0.0


def targets(sizes: Sequence[int], weights: Sequence[float], max_repeats: int = MAX_REPEATS) -> list[float]:
    """Words to take of each source: shares by weight of all words, none above max_repeats times its own."""
    total, found, free = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        rest = total - sum(max_repeats * sizes[i] for i in range(len(sizes)) if i not in free)
        share = {i: rest * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i for i in free if share[i] > max_repeats * sizes[i]}
        for i in over or free:
            found[i] = float(max_repeats * sizes[i]) if i in over else share[i]
        free -= over or free
    return found


def _draw_left(have: np.ndarray, lo: int, mid: int, hi: int, seed: int) -> np.ndarray:
    """How many units of each source go to the shards lo..mid of lo..hi."""
    total = int(have.sum())
    if not total:
        return have
    rng = np.random.default_rng([seed, lo, hi])
    # of a total that shards can't share equally, which side gets the odd units is drawn too
    n = total * (mid - lo) // (hi - lo) + int(rng.random() < total * (mid - lo) / (hi - lo) % 1)
    return rng.multivariate_hypergeometric(have, n, method="marginals")


def descend(lo: int, hi: int, counts: np.ndarray, starts: np.ndarray, seed: int, most: int = 1) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Nodes (lo, hi, counts, starts) of at most `most` shards below a node; starts: units of each source in the shards before."""
    todo = [(lo, hi, np.asarray(counts, dtype=np.int64), np.asarray(starts, dtype=np.int64))]
    while todo:
        lo, hi, have, at = todo.pop()
        if hi - lo <= most:
            yield lo, hi, have, at
            continue
        mid = (lo + hi) // 2
        left = _draw_left(have, lo, mid, hi, seed)
        todo += [(mid, hi, have - left, at + left), (lo, mid, left, at)]


def split(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Unit quotas, shards x sources: counts dealt out by the splitting tree."""
    counts = np.asarray(counts, dtype=np.int64)
    return np.stack([have for _, _, have, _ in descend(0, shards, counts, np.zeros_like(counts), seed)])


NODE = "lo long, hi long, counts array<long>, starts array<long>"


def quotas(spark, counts: Sequence[int], shards: int, seed: int) -> DataFrame:
    """(rank, pos, shard): to which shard each place of each source's permuted units goes, by the tree."""

    def below(most: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for node in zip(*(batch.column(k).to_pylist() for k in range(4))):
                    found = list(descend(*node, seed, most))
                    for at in range(0, len(found), 1024):
                        cols = list(zip(*found[at : at + 1024]))
                        yield pa.RecordBatch.from_arrays([pa.array(map(int, c), pa.int64()) for c in cols[:2]] + [pa.array(c, pa.list_(pa.int64())) for c in cols[2:]], names=["lo", "hi", "counts", "starts"])

        return run

    fan = max(1, int(shards**0.5))
    root = spark.createDataFrame([(0, shards, [int(n) for n in counts], [0] * len(counts))], NODE).coalesce(1)
    nodes = root.mapInArrow(below(fan), NODE)
    leaves = nodes.repartition("lo").mapInArrow(below(1), NODE)
    own = leaves.select(F.col("lo").alias("shard"), F.posexplode(F.arrays_zip("counts", "starts")).alias("rank", "x")).where(F.col("x.counts") > 0)
    return own.select("rank", "shard", F.explode(F.sequence(F.col("x.starts"), F.col("x.starts") + F.col("x.counts") - 1)).alias("pos"))


def _size(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")).cast("long")


def _identity(id_col: str, source_col: str, text_col: str) -> list[Column]:
    """doc_id, th (hash of the text) and source: rows equal in these are taken alike."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return [F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.col(f"`{source_col}`").cast("string").alias("source")]


def catalogue(known: DataFrame, weights: Sequence[float], max_repeats: int, docs_per_block: int) -> list[Source]:
    """known (source, size): one entry for each source, in order."""
    rows = known.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("words")).collect()
    rows.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    found = [Source(i, r.source, r.docs, r.words) for i, r in enumerate(rows)]
    for s, t in zip(found, targets([s.words for s in found], [weights[s.rank % len(weights)] for s in found], max_repeats)):
        s.blocks, s.target = -(-s.docs // docs_per_block), t
    return found


def shard_count(sources: list[Source]) -> int:
    """Output shards of a mix of this size."""
    return max(1, -(-sum(s.words for s in sources) // SHARD_WORDS))


def _listed(spark, sources: list[Source]) -> DataFrame:
    """The catalogue as a table: `want` words make `whole` passes and `rest` words of one more."""
    rows = [(s.rank, s.name, s.blocks, s.words, s.target, *(divmod(round(s.target), s.words) if s.words else (0, 0))) for s in sources]
    return small(spark.createDataFrame(rows, "rank int, name string, blocks long, source_size long, target double, whole long, rest long"), len(rows))


def _blocked(rows: DataFrame, listed: DataFrame, seed: int) -> DataFrame:
    """rows (doc_id, th, source, ..) with their source's entry and their block."""
    found = rows.join(listed, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    return found.withColumn("block", F.pmod(F.xxhash64("doc_id", "th", F.lit(seed)), F.col("blocks")))


def _bucket(hashed: Column, buckets: Column) -> Column:
    """A bucket of a hash that keeps the order of its upper half, unsigned."""
    return F.floor(F.shiftrightunsigned(hashed, 32) * buckets / F.lit(float(1 << 32))).cast("long")


def units_of(blocks: DataFrame, seed: int, bucket: int = BUCKET) -> DataFrame:
    """(rank, block, epoch, left): all blocks once for each whole pass, and the first of one more; of the last one only `left` words are taken.

    blocks: rank, block, words (positive), blocks, whole, rest.
    """
    passes = blocks.where("whole > 0").select("rank", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("epoch"), F.lit(None).cast("long").alias("left"))
    perm = F.xxhash64("rank", "block", "whole", F.lit(seed), F.lit(1))
    one = blocks.where("rest > 0").withColumn("perm", F.shiftrightunsigned(perm, 1)).withColumn("bucket", _bucket(perm, F.ceil(F.col("blocks") / bucket)))
    order = W.partitionBy("rank").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = one.groupBy("rank", "bucket").agg(F.sum("words").alias("have")).withColumn("before", F.coalesce(F.sum("have").over(order), F.lit(0)))
    sums = cut_lineage(sums)
    one = one.join(small(sums), ["rank", "bucket"]).where(F.col("before") < F.col("rest"))
    sure = one.where(F.col("before") + F.col("have") <= F.col("rest")).select("rank", "block", F.col("whole").alias("epoch"), F.lit(None).cast("long").alias("left"))
    within = W.partitionBy("rank", "bucket").orderBy("perm", "block").rowsBetween(W.unboundedPreceding, -1)
    edge = one.where(F.col("before") + F.col("have") > F.col("rest")).withColumn("at", F.col("before") + F.coalesce(F.sum("words").over(within), F.lit(0))).where(F.col("at") < F.col("rest"))
    left = F.when(F.col("at") + F.col("words") > F.col("rest"), F.col("rest") - F.col("at"))
    return passes.unionByName(sure).unionByName(edge.select("rank", "block", F.col("whole").alias("epoch"), left.alias("left")))


def deal(units: DataFrame, ranks: int, shards: int, seed: int, bucket: int = BUCKET) -> DataFrame:
    """units with shard: each source's units in permuted order, dealt by the tree's quotas. units must be fixed rows."""
    spark = units.sparkSession
    counts = dict(units.groupBy("rank").count().collect())  # one row for each source
    some = small(spark.createDataFrame([(r, -(-n // bucket)) for r, n in counts.items()], "rank int, buckets long"), len(counts))
    order = F.xxhash64("rank", "block", "epoch", F.lit(seed), F.lit(2))
    placed = units.join(some, "rank").withColumn("order", F.shiftrightunsigned(order, 1)).withColumn("bucket", _bucket(order, F.col("buckets")))
    before = W.partitionBy("rank").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    first = cut_lineage(placed.groupBy("rank", "bucket").count().withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0))).select("rank", "bucket", "first"))
    within = W.partitionBy("rank", "bucket").orderBy("order", "epoch", "block")
    numbered = placed.withColumn("n", F.row_number().over(within) - 1).join(small(first), ["rank", "bucket"]).select("rank", "block", "epoch", "left", (F.col("first") + F.col("n")).alias("pos"))
    return numbered.join(quotas(spark, [counts.get(r, 0) for r in range(ranks)], shards, seed), ["rank", "pos"]).select("rank", "block", "epoch", "shard", "left")


def nearest_sum(have: Sequence[int], want: int, below: bool) -> list[int]:
    """Places of a subset of the positive sizes whose sum is nearest to want; below: not above it."""
    reach = [1]  # bit n of an entry: n is a sum of the sizes so far
    for n in have:
        reach.append(reach[-1] | reach[-1] << n)
    low = (reach[-1] & (2 << want) - 1).bit_length() - 1
    above = reach[-1] >> want
    best = low
    if not below and above:
        high = want + (above & -above).bit_length() - 1
        best = high if high - want < want - low else low
    out = []
    for k in range(len(have) - 1, -1, -1):
        if not reach[k] >> best & 1:  # not without this one
            out.append(k)
            best -= have[k]
    return out[::-1]


def _fill(pdf: pd.DataFrame, cut_last: bool) -> pd.DataFrame:
    """Of a part-taken block: documents in permuted order while they fit, then a part of one more if that may be cut, else the subset with the nearest sum.

    The nearest sum is searched among as many documents, at the place where the words run out, as
    SUM_BITS allow: all of a block, unless its documents have hundreds of thousands of words.
    """
    pdf = pdf[pdf["size"] > 0].sort_values(["perm", "doc_id", "th"], kind="stable")
    left = int(pdf["left"].iloc[0]) if len(pdf) else 0
    have = pdf["size"].to_numpy() * pdf["times"].to_numpy()
    n = int(np.searchsorted(np.cumsum(have), left, side="right"))
    take = np.where(np.arange(len(have)) < n, have, 0)
    if cut_last:
        left -= int(take.sum())
        rest = np.flatnonzero(take == 0)
        if left > 0 and len(rest):
            k = rest[np.argmax(have[rest])]
            take[k] = min(left, have[k])
    elif len(have):
        reach = max(1, min(len(have), SUM_BITS // max(1, int(have.sum()))))
        some = np.arange(max(0, min(n - reach // 2, len(have) - reach)), len(have))[:reach]
        want = left - int(take.sum()) + int(take[some].sum())
        take[some] = 0
        chosen = some[nearest_sum(have[some].tolist(), want, below=False)]
        take[chosen] = have[chosen]
    # of equal rows each gets the same
    return pd.DataFrame({"rank": pdf["rank"].to_numpy(), "doc_id": pdf["doc_id"].to_numpy(), "th": pdf["th"].to_numpy(), "part": take // pdf["times"].to_numpy()})[take > 0]


@dataclass
class Plan:
    """A mix: the catalogue's table, known (doc_id, th, source, size), each block's units (epoch, shard, left), and the words taken of documents in part-taken blocks."""

    listed: DataFrame
    known: DataFrame
    units: DataFrame
    parts: DataFrame
    seed: int


def plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS, shards: int | None = None, docs_per_block: int = DOCS_PER_BLOCK, seed: int = 17, bucket: int = BUCKET, cut_last: bool = True) -> Plan:
    """cut_last: one document of each source at most is taken in part, so that the target is met to the word; else the nearest number of whole documents."""
    known = cut_lineage(docs.select(*_identity(id_col, source_col, text_col), _size(F.col(f"`{text_col}`").cast("string")).alias("size")))
    sources = catalogue(known, weights, max_repeats, docs_per_block)
    listed = _listed(docs.sparkSession, sources)
    blocked = _blocked(known, listed, seed)
    blocks = cut_lineage(blocked.groupBy("rank", "block", "blocks", "whole", "rest").agg(F.sum("size").alias("words")).where("words > 0"))
    units = cut_lineage(units_of(blocks, seed, bucket))
    dealt = deal(units, len(sources), shards or shard_count(sources), seed, bucket)
    # a block has at most max_repeats + 1 units
    units = cut_lineage(dealt.groupBy("rank", "block").agg(F.array_sort(F.collect_list(F.struct("epoch", "shard", "left"))).alias("units")))
    part = units.withColumn("unit", F.explode("units")).where(F.col("unit.left").isNotNull()).select("rank", "block", F.col("unit.left").alias("left"), F.col("unit.epoch").alias("epoch"))
    part = cut_lineage(part)  # one row for each source at most
    inside = blocked.where("size > 0").join(small(part), ["rank", "block"]).groupBy("rank", "doc_id", "th", "size", "left", "epoch").agg(F.count("*").alias("times"))
    inside = inside.withColumn("perm", F.xxhash64("doc_id", "th", F.lit(seed + 1), F.col("epoch")))
    schema = "rank int, doc_id long, th long, part long"
    filled = inside.groupBy("rank").applyInPandas(lambda pdf: _fill(pdf.astype({"doc_id": "Int64"}), cut_last), schema)
    return Plan(listed, known, units, cut_lineage(filled), seed)


def _drawn(rows: DataFrame, p: Plan) -> DataFrame:
    """rows (doc_id, th, source, ..) with their units, and `part`: the words taken in a part-taken one, if any."""
    found = _blocked(rows, p.listed, p.seed).join(small(p.units), ["rank", "block"], "left")
    parts = small(p.parts.withColumnsRenamed({"doc_id": "_i", "th": "_t", "rank": "_r"}))
    return found.join(parts, (F.col("rank") == F.col("_r")) & (F.col("th") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_i")), "left").drop("_i", "_t", "_r")


def draws(docs: DataFrame, **kw) -> DataFrame:
    """Per row of docs: doc_id, size, rank, source_size, target, draws array<struct<epoch, shard, words>>."""
    p = plan(docs, **kw)
    one = lambda u: F.struct(u["epoch"].alias("epoch"), u["shard"].alias("shard"), F.when(u["left"].isNull(), F.col("size")).otherwise(F.coalesce("part", F.lit(0))).cast("long").alias("words"))
    found = F.filter(F.transform("units", one), lambda x: x["words"] > 0)
    none = F.array().cast("array<struct<epoch:bigint,shard:bigint,words:bigint>>")
    return _drawn(p.known, p).select("doc_id", "size", "rank", "source_size", "target", F.coalesce(found, none).alias("draws"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **kw) -> DataFrame:
    """The mixed documents, repeats as rows of their own, dealt to shards and shuffled within each; docs' columns.

    Documents are taken whole: each source's words come as near to its target as whole documents of
    the block where it is met allow.
    """
    p = plan(docs, id_col, source_col, text_col, **{**kw, "cut_last": False})
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *_identity(id_col, source_col, text_col), text.rlike(r"[^\x20\x09-\x0D]").alias("words")).where("words").drop("words")
    taken_units = F.filter("units", lambda u: u["left"].isNull() | F.col("part").isNotNull())
    dealt = _drawn(rows, p).select("row", "doc_id", "th", F.explode(taken_units).alias("unit")).select("row", F.col("unit.shard").alias("shard"), F.xxhash64("doc_id", "th", F.col("unit.epoch"), F.lit(p.seed + 2)).alias("order"))
    shuffled = dealt.repartition("shard").sortWithinPartitions("shard", "order")
    return shuffled.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def taken(docs: DataFrame, **kw) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, the words that the mix takes of it, and its draws: pass, shard and words."""
    total = F.aggregate("draws", F.lit(0).cast("long"), lambda acc, x: acc + x["words"])
    return draws(docs, **kw).select("doc_id", "size", "source_size", "target", total.alias("taken"), "draws")
