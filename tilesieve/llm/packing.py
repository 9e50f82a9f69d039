"""Best-fit packing of tokenised documents with a grouping genetic algorithm on islands.

Documents become token ids plus an end id; those above the sequence length are cut into pieces, the
first of which is the shorter one. Pieces are dealt to problems of bounded size by a hash of their
row, so that every problem has about the table's mix of lengths. For each problem some islands
evolve populations of packings. A packing is a list of bins, and crossover works on bins: whole
well-filled bins of one parent are injected into the other, bins that hold a duplicate of an injected
piece are dissolved, and the displaced pieces are put back best-fit, longest first. Between epochs
each island gets the elite of its neighbour, by a Spark join on (problem, island). The packing with
the fewest sequences wins. Only rows and lengths go through the problems; the pieces with their token
ids, packed small (`pack_ids`), join the places by row. `ids` is a piece's token ids as little-endian
32-bit numbers.

An island stops when it meets the lower bound on the number of sequences, or when `PATIENCE`
generations have saved none. Random draws depend
on seed, problem, island and epoch alone, so a task that is run again gives the same packing.

Defined results: a null or empty text is one piece of the end id alone. Repeated rows are packed
each. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilesieve.llm.common import cut_lineage, id_text_batches, with_id_and_text

MAX_LENGTH = 1024
END_ID = 2
PROBLEM_PIECES = 8192
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 24
PATIENCE = 5
POPULATION = 4

PIECES = "doc_id long, piece int, start long, length long, ids binary"


def pack_ids(ids: np.ndarray, squeeze) -> bytes:
    """Token ids as bytes that take little room on their way: the width of one, then all of them, compressed."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return bytes([width]) + squeeze.compress(ids.astype(f"<u{width}").tobytes())


def unpack_ids(packed: bytes, back) -> bytes:
    """The ids of pack_ids as little-endian unsigned 32-bit numbers."""
    return np.frombuffer(back.decompress(packed[1:]), dtype=f"<u{packed[0]}").astype("<u4").tobytes()


class Encoder:
    """Token ids of texts, as the `tokenizers` file gives them.

    Where the vocabulary is there as ranks too, the faster of the two libraries reads it; it gives
    the same ids. A text with a special token's string goes to the file's own library.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        import tokenizers

        self.slow = tokenizers.Tokenizer.from_file(path)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=known, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(x in text for x in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


def public_encoder(name: str = "byte_bpe_50k") -> Encoder:
    """The encoder of a public vocabulary file; where that is comes from the installed package."""
    import public_tokenizers

    return Encoder(public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN)


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: the first one takes what the full ones leave."""
    first = n % most or most
    return [(0, first), *((i, most) for i in range(first, n, most))]


def tokenise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", encoder=public_encoder, max_length: int = MAX_LENGTH, end_id: int = END_ID) -> DataFrame:
    """Each document's pieces with length and token ids (as pack_ids gives them)."""
    made: dict[str, Encoder] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = made.get("it") or made.setdefault("it", encoder())
        squeeze = zstandard.ZstdCompressor(level=1)
        for ids, texts in id_text_batches(batches):
            rows: list[tuple] = []
            seen: dict[bytes, list] = {}  # of this batch alone
            for doc_id, data in zip(ids.to_pylist(), texts):
                pieces = seen.get(data)
                if pieces is None:
                    tokens = np.append(enc.ids(data.decode()), np.array([end_id], dtype="<u4"))
                    pieces = seen[data] = [(k, s, n, pack_ids(tokens[s : s + n], squeeze)) for k, (s, n) in enumerate(cut(len(tokens), max_length))]
                rows += [(doc_id, *p) for p in pieces]
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in PIECES.split(", ")])

    return with_id_and_text(docs, id_col, text_col).mapInArrow(run, PIECES)


Packing = list[list[int]]


def best_fit(items: Sequence[int], lens: Sequence[int], most: int, bins: Packing | None = None) -> Packing:
    """items, in this order, each into the fullest bin that has room; bins: those that there are already."""
    bins = [] if bins is None else bins
    room = sorted((most - sum(lens[i] for i in b), k) for k, b in enumerate(bins))
    for i in items:
        at = bisect.bisect_left(room, (lens[i], -1))
        if at < len(room):
            left, k = room.pop(at)
            bins[k].append(i)
        else:
            left, k = most, len(bins)
            bins.append([i])
        if left > lens[i]:
            bisect.insort(room, (left - lens[i], k))
    return bins


def best_fill(lens: Sequence[int], most: int) -> Packing:
    """Bin after bin: the longest piece left, then the pieces, looked up two ahead by length, that fill the rest best."""
    count = np.bincount(np.asarray(lens, dtype=np.int64), minlength=most + 1)
    by: dict[int, list[int]] = {}
    for i in range(len(lens) - 1, -1, -1):
        by.setdefault(lens[i], []).append(i)
    bins: Packing = []
    lengths = np.arange(most + 1)
    for longest in range(most, 0, -1):
        while count[longest]:
            own, room, add = [], most, longest
            while add:
                own.append(by[add].pop())
                count[add] -= 1
                room -= add
                # of each length, the longest that there is up to it
                below = np.maximum.accumulate(np.where(count[: room + 1] > 0, lengths[: room + 1], 0))
                add = int(below[room])
                if add and add < room:
                    one = np.flatnonzero(count[: room + 1])
                    one = one[one > 0]
                    two = below[room - one]
                    two[(two == one) & (count[one] < 2)] = 0
                    k = len(one) - 1 - int(np.argmax((one + two)[::-1]))
                    if one[k] + two[k] > add:
                        add = int(max(one[k], two[k]))
            bins.append(own)
    return bins


def lower_bound(lens: np.ndarray, most: int) -> int:
    """The fewest bins that could do: by the sum, and by pieces that can't share a bin with one another."""
    best = -(-int(lens.sum()) // most)
    order = np.sort(lens)
    total = np.concatenate([[0], np.cumsum(order)])
    big = np.searchsorted(order, most / 2, side="right")
    for t in np.unique(order[order <= most // 2]):
        huge = np.searchsorted(order, most - t, side="right")
        small = np.searchsorted(order, t, side="left")
        middle, n_huge = max(0, huge - big), len(order) - max(huge, big)
        free = middle * most - (total[max(huge, big)] - total[big])
        best = max(best, n_huge + middle + max(0, -(-int(total[big] - total[small] - free) // most)))
    return int(max(best, len(order) - big))


def fitness(p: Packing, lens: Sequence[int], most: int) -> tuple[int, float]:
    """Few bins, and among as many bins unequal fill: full ones, and one with much room. Lower is better."""
    return len(p), -sum((sum(lens[i] for i in b) / most) ** 2 for b in p)


def crossover(a: Packing, b: Packing, lens: Sequence[int], most: int, rng: np.random.Generator) -> Packing:
    """a with whole well-filled bins of b, without the bins that these overlap, displaced pieces best-fit."""
    fill = np.array([sum(lens[i] for i in x) for x in b]) / most
    rank = np.argsort(-(fill + 0.05 * rng.random(len(b))), kind="stable")
    inject = [b[k] for k in rank[: max(1, int(len(b) * rng.uniform(0.2, 0.5)))]]
    held = {i for x in inject for i in x}
    keep = [list(x) for x in a if not held.intersection(x)]
    lost = [i for x in a if held.intersection(x) for i in x if i not in held]
    # the worst-filled bins of the rest go too, so that best fit has something to choose from
    keep.sort(key=lambda x: sum(lens[i] for i in x))
    n = int(len(keep) * rng.uniform(0, 0.1))
    lost += [i for x in keep[:n] for i in x]
    lost.sort(key=lambda i: (-lens[i], i))
    return best_fit(lost, lens, most, [*keep[n:], *(list(x) for x in inject)])


def evolve(lens: Sequence[int], most: int, elites: list[Packing], seed: Sequence[int], generations: int = GENERATIONS, population: int = POPULATION, patience: int = PATIENCE) -> Packing:
    """The best packing of an island; elites join its first population. It ends at the lower bound, after `generations`, or after `patience` of them without a bin less."""
    goal = lower_bound(np.asarray(lens, dtype=np.int64), most) if len(lens) else 0
    rng = np.random.default_rng(list(seed))
    down = sorted(range(len(lens)), key=lambda i: (-lens[i], i))
    pool = [*elites] or [best_fit(down, lens, most), best_fill(lens, most)]
    scored = sorted(((fitness(p, lens, most), p) for p in pool), key=lambda x: x[0])
    if scored[0][0][0] <= goal:
        return scored[0][1]
    while len(scored) < population:
        noisy = np.asarray(lens) * rng.uniform(0.8, 1.2, len(lens))
        p = best_fit([int(i) for i in np.argsort(-noisy, kind="stable")], lens, most)
        scored.append((fitness(p, lens, most), p))
    idle, fewest = 0, min(x[0][0] for x in scored)
    for _ in range(generations):
        scored.sort(key=lambda x: x[0])
        idle, fewest = (0, scored[0][0][0]) if scored[0][0][0] < fewest else (idle + 1, fewest)
        if fewest <= goal or idle > patience:
            break
        i, j = rng.choice(len(scored), 2, replace=False)
        child = crossover(scored[min(i, j)][1], scored[max(i, j)][1], lens, most, rng)
        scored[-1] = (fitness(child, lens, most), child)
    return min(scored, key=lambda x: x[0])[1]


def _bins(of: Sequence[int]) -> Packing:
    out: dict[int, list[int]] = {}
    for i, k in enumerate(of):
        out.setdefault(k, []).append(i)
    return [out[k] for k in sorted(out)]


STATE = "problem long, island int, lens array<int>, bins array<int>, n_bins int"


def _epoch(states: DataFrame, most: int, seed: int, epoch: int, generations: int, population: int) -> DataFrame:
    """states (problem, island, lens, mine, other): each island evolves from its elite and its neighbour's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                elites = [_bins(x) for x in (r["mine"], r["other"]) if x]
                p = evolve(r["lens"], most, elites, (seed, r["problem"], r["island"], epoch), generations, population)
                of = np.empty(len(r["lens"]), dtype=np.int32)
                for k, b in enumerate(p):
                    of[b] = k
                rows.append((r["problem"], r["island"], r["lens"], of, len(p)))
            cols = list(zip(*rows)) or [()] * 5
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), ints, ints, pa.int32()))], names=[x.split()[0] for x in STATE.split(", ")])

    return states.select("problem", "island", "lens", "mine", "other").mapInArrow(run, STATE)


def pack(pieces: DataFrame, length_col: str = "length", max_length: int = MAX_LENGTH, problem_pieces: int = PROBLEM_PIECES, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION, seed: int = 11) -> DataFrame:
    """pieces with sequence_id and offset (place in the sequence, without gaps).

    pieces must be fixed rows (from cut_lineage or a written table): they are read twice and numbered
    by place.
    """
    n = pieces.count()
    problems = max(1, -(-n // problem_pieces))
    # the number of a row is dealt by hash, so that no key of the data decides how large a problem is
    dealt = pieces.withColumn("_row", F.monotonically_increasing_id()).withColumn("_problem", F.pmod(F.xxhash64("_row", F.lit(seed)), F.lit(problems)))
    item = F.struct(F.col("_row"), F.col(f"`{length_col}`").cast("int").alias("len"))
    grouped = dealt.groupBy(F.col("_problem").alias("problem")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    grouped = cut_lineage(grouped)
    state = grouped.select("problem", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.transform("items", lambda x: x["len"]).alias("lens"))
    none = F.lit(None).cast("array<int>")
    state = cut_lineage(_epoch(state.select("*", none.alias("mine"), none.alias("other")), max_length, seed, 0, generations, population))
    for e in range(1, epochs):
        # elite migration around the ring of a problem's islands
        moved = state.select("problem", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("bins").alias("other"))
        state = cut_lineage(_epoch(state.withColumnRenamed("bins", "mine").join(moved, ["problem", "island"]), max_length, seed, e, generations, population))
    best = state.groupBy("problem").agg(F.min_by(F.struct("bins", "n_bins"), F.struct("n_bins", "island")).alias("best"))
    placed = grouped.join(best, "problem").withColumn("_x", F.explode(F.arrays_zip(F.col("items"), F.col("best.bins").alias("bin"), _offsets(F.transform("items", lambda x: x["len"]), F.col("best.bins")).alias("offset"))))
    # a problem has at most as many sequences as pieces, far fewer than 2^31
    seq = F.col("problem") * F.lit(1 << 31) + F.col("_x.bin")
    places = placed.select(F.col("_x.items._row").alias("_row"), seq.alias("sequence_id"), F.col("_x.offset").alias("offset"))
    whole = pieces.select(F.monotonically_increasing_id().alias("_row"), F.struct(*(f"`{c}`" for c in pieces.columns)).alias("_of"))
    return whole.join(places, "_row").select(*(F.col("_of")[c].alias(c) for c in pieces.columns), "sequence_id", "offset")


@F.pandas_udf(T.ArrayType(T.LongType()))
def _offsets(lens: pd.Series, bins: pd.Series) -> pd.Series:
    """Of each item, the sum of the lengths before it in its bin."""
    out = []
    for n, b in zip(lens, bins):
        n, b = np.asarray(n, dtype=np.int64), np.asarray(b, dtype=np.int64)
        order = np.argsort(b, kind="stable")
        before = np.cumsum(n[order]) - n[order]
        first = np.r_[True, b[order][1:] != b[order][:-1]] if len(b) else np.zeros(0, bool)
        start = np.maximum.accumulate(np.where(first, before, 0)) if len(b) else before
        at = np.empty(len(n), dtype=np.int64)
        at[order] = before - start
        out.append(at)
    return pd.Series(out)


PACKED = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", encoder=public_encoder, max_length: int = MAX_LENGTH, end_id: int = END_ID, **kw) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids, their checksum ids_crc32, sequence_id and offset."""
    packed = pack(cut_lineage(tokenise(docs, id_col, text_col, encoder, max_length, end_id)), max_length=max_length, **kw)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = zstandard.ZstdDecompressor()
        for batch in batches:
            ids = pa.array([unpack_ids(x, back) for x in batch.column(4).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], ids, *batch.columns[5:]], names=batch.schema.names)

    whole = packed.select("doc_id", "piece", "start", "length", "ids", "sequence_id", "offset").mapInArrow(spread, PACKED)
    return whole.select("doc_id", "piece", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
