"""Substring dedup by sliding sentence spans.

A text is cut into sentences; a sentence of more than `UNIT_WORDS` words counts as several. It is cut
where the words themselves say so: before a word whose hash is the least among those of its
neighbours (`NEAR` words each way), and after `UNIT_WORDS` words where no such word comes. So a passage
without punctuation is cut alike, but for a few words at its ends, wherever in a sentence it stands,
and also after an edited word. From every sentence on, a run of `RUN` consecutive sentences is hashed, or of as many more as it takes to have
`MIN_WORDS` words. A run that another document with a smaller id holds, or that stands earlier in
the same document, is a repeat, and all sentences that it covers are removed. The first copy stays.

Texts are cut once: `cut_texts` keeps a row for each, with its runs' hashes packed, and is written. Runs
meet by an aggregate (the smallest and largest id that hold a run) and a join with its result; a run
that a third of all documents hold is combined before the shuffle, and the join's hot keys can be
split. Texts move once, with what is known of them, and only those that hold a repeat are cut again.
Words are compared in lower case with single spaces between them.

Defined results: a null text stays null and has no sentences; an empty one stays empty. Rows with a
null id are neither compared nor changed. Rows that share an id are one document: they are not
compared with each other, and equal ones are changed alike. An empty table gives an empty result.
`remove_repeats` keeps all columns, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilesieve.llm.common import cut_lineage, with_id_and_text

RUN = 2
UNIT_WORDS = 16
NEAR = 5
MIN_WORDS = 20

_END = re.compile(r"[.!?]+\s+|\n\s*")
_WORD = re.compile(r"\S+\s*")


def word_cuts(words: list[str], most: int, near: int = NEAR) -> list[int]:
    """Numbers of the words that units of a long sentence start with, and the number of words.

    A word starts a unit if its hash is less than those of the `near` words before it, and not above
    those of the `near` words after it. These places depend on nothing else; longer units are cut from
    the one place on.
    """
    h = np.array([xxhash.xxh3_64_intdigest(w.lower()) >> 1 for w in words], dtype=np.int64)
    edge = np.full(near, np.iinfo(np.int64).max)
    padded = np.concatenate([edge, h, edge])
    n = len(h)
    least = np.ones(n, dtype=bool)
    for k in range(1, near + 1):
        least &= (h < padded[near - k : near - k + n]) & (h <= padded[near + k : near + k + n])
    # places are more than `near` words apart
    cuts = [0]
    for end in [*(np.flatnonzero(least[1:]) + 1).tolist(), n]:
        while end - cuts[-1] > most:
            cuts.append(cuts[-1] + most)
        cuts.append(end)
    return cuts


def sentences(text: str, unit_words: int = UNIT_WORDS) -> list[tuple[int, int, str, int]]:
    """(start, end, words joined, number of words) of each sentence that has a word; spaces belong to the one before."""
    out = []
    at = 0
    for end in [*(m.end() for m in _END.finditer(text)), len(text)]:
        part = text[at:end]
        words = part.split()
        if len(words) <= unit_words:
            if words:
                out.append((at, end, " ".join(words), len(words)))
        else:
            edges = [at, *(at + m.end() for m in _WORD.finditer(part))]
            edges[0] = at
            cuts = word_cuts(words, unit_words)
            for i, j in zip(cuts, cuts[1:]):
                out.append((edges[i], edges[j], " ".join(words[i:j]), j - i))
        at = end
    return out


def runs(units: list[tuple[int, int, str, int]], run: int = RUN, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (numbers of sentences) and two hashes of the runs of consecutive sentences.

    A run has `run` sentences, or as many more as it takes to have min_words words. The last one ends
    with the text, so that no sentence at the end is left over.
    """
    total = np.cumsum([0, *(u[3] for u in units)])
    n = len(units)
    at = np.arange(max(0, n - run + 1))
    ends = np.maximum(at + run, np.searchsorted(total, total[at] + min_words))
    at, ends = at[ends <= n], ends[ends <= n]
    last = min(n - run, int(np.searchsorted(total, total[n] - min_words, side="right")) - 1)
    if last >= 0 and (not len(at) or ends[-1] < n):
        at, ends = np.append(at, last), np.append(ends, n)
    if not len(at):
        return at, ends, np.zeros(0, np.int64), np.zeros(0, np.int32)
    h = np.array([xxhash.xxh3_64_intdigest(u[2].lower()) for u in units], dtype=np.uint64)
    a, b = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for k in range(int((ends - at).max())):
        on = at + k < ends
        x = h[at[on] + k]
        # odd multipliers; the shift carries high bits down, which products alone don't
        a[on] = (a[on] ^ x) * np.uint64(0x9E3779B97F4A7C15)
        a[on] ^= a[on] >> np.uint64(29)
        b[on] = (b[on] + (x >> np.uint64(7) ^ x)) * np.uint64(0xC2B2AE3D27D4EB4F)
        b[on] ^= b[on] >> np.uint64(32)
    return at, ends, a.view(np.int64), (b & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


CUT = "doc_id long, th int, n long, own boolean, h binary, g binary, at binary"


def cut_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, unit_words: int = UNIT_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """Per text: doc_id, th (its hash), n (sentences), own (whether a run stands in it twice), and of each run, where it stands first, both hashes and its number, packed."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(2).cast(pa.binary()).to_pylist():
                units = sentences((data or b"").decode(), unit_words)
                _, _, h, g = runs(units, run, min_words)
                _, first = np.unique(h, return_index=True)
                rows.append((len(units), len(first) < len(h), *(x.astype(t).tobytes() for x, t in ((h[first], "<i8"), (g[first], "<i4"), (first, "<i4")))))
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[x.split()[0] for x in CUT.split(", ")])

    known = with_id_and_text(docs, id_col, text_col).where(F.col("doc_id").isNotNull())
    return known.select("doc_id", _text_hash("text").alias("th"), "text").mapInArrow(cut, CUT)


def _text_hash(text: str) -> Column:
    """With the id, this tells rows apart; a null text is an empty one."""
    return F.hash(F.coalesce(F.col(text), F.lit("")))


def run_table(cut: DataFrame) -> DataFrame:
    """(h, g, doc_id, place): the runs of the rows of cut_texts; place: 32 bits of the text's hash, and the run's number."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, g, at = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=t) for k, t in ((2, "<i8"), (3, "<i4"), (4, "<i4")))
            times = np.array([len(x) // 8 for x in batch.column(2).to_pylist()], dtype=np.int64)
            doc_id, th = (np.repeat(batch.column(k).to_numpy().astype(np.int64), times) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, g, doc_id, th << 32 | at)], names=["h", "g", "doc_id", "place"])

    return cut.select("doc_id", "th", "h", "g", "at").mapInArrow(spread, "h long, g int, doc_id long, place long")


def repeats(cut: DataFrame) -> DataFrame:
    """(doc_id, th, first_id, at): a text's runs that a document with a smaller id, first_id, holds too."""
    table = run_table(cut)
    shared = table.groupBy("h", "g").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where(F.col("first_id") < F.col("last_id")).select("h", "g", "first_id")
    found = table.join(shared, ["h", "g"]).where(F.col("doc_id") > F.col("first_id"))
    return found.select("doc_id", F.shiftright("place", 32).cast("int").alias("th"), "first_id", F.col("place").bitwiseAND((1 << 32) - 1).cast("int").alias("at"))


def covered(text: str, elsewhere: list[int], run: int = RUN, unit_words: int = UNIT_WORDS, min_words: int = MIN_WORDS) -> tuple[list[tuple[int, int, str, int]], np.ndarray]:
    """The sentences, and which of them a repeat covers; elsewhere: numbers of runs that a smaller id holds."""
    units = sentences(text, unit_words)
    gone = np.zeros(len(units), dtype=bool)
    at, ends, h, _ = runs(units, run, min_words)
    if len(at):
        first = np.zeros(len(h), dtype=bool)
        first[np.unique(h, return_index=True)[1]] = True
        again = np.isin(h, h[elsewhere]) if len(elsewhere) else np.zeros(len(h), dtype=bool)
        hit = again | ~first
        for k, end in zip(at[hit], ends[hit]):
            gone[k:end] = True
    return units, gone


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, unit_words: int = UNIT_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """docs but for their text in a struct `_row`, with `_text` (the text after removal), `_sentences`, `_removed` (counts) and `_firsts` (ids that hold first copies)."""
    kw = {"run": run, "unit_words": unit_words, "min_words": min_words}
    cut = cut_lineage(cut_texts(docs, id_col, text_col, **kw))
    none = lambda kind: F.lit(None).cast(kind)
    hits = repeats(cut).select("doc_id", "th", none("long").alias("n"), none("boolean").alias("own"), "first_id", "at")
    known = cut.select("doc_id", "th", "n", "own", none("long").alias("first_id"), none("int").alias("at")).unionByName(hits)
    known = known.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.max("n").alias("_n"), F.max("own").alias("_own"), F.collect_set("at").alias("_at"), F.array_sort(F.collect_set("first_id")).alias("_firsts"))
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in others), F.lit(0).alias("_")).alias("_row"), F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    rows = rows.withColumn("_th", _text_hash("_text"))
    joined = rows.join(known, ["_id", "_th"], "left").select("_row", "_id", "_text", "_n", "_own", "_at", F.coalesce("_firsts", F.array().cast("array<bigint>")).alias("_firsts"))
    names = ["_row", "_text", "_sentences", "_removed", "_firsts"]

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n, gone_n = [], [], []
            for doc_id, text, n_units, own, at in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4, 5))):
                removed = 0
                if doc_id is None:
                    n_units = len(sentences(text or "", unit_words))
                elif own or at:
                    units, gone = covered(text or "", at, **kw)
                    removed = int(gone.sum())
                    kept, last = [], 0
                    for (start, end, *_), x in zip(units, gone.tolist()):
                        if x:
                            kept.append(text[last:start])
                            last = end
                    text = "".join([*kept, text[last:]])
                texts.append(text)
                n.append(n_units)
                gone_n.append(removed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(gone_n, pa.int64()), batch.column(6)], names=names)

    schema = joined.select("_row", "_text", F.lit(0).cast("long").alias("_sentences"), F.lit(0).cast("long").alias("_removed"), "_firsts").schema
    return joined.mapInArrow(drop, schema)


def dedup_report(docs: DataFrame, **kw) -> DataFrame:
    """Per document: doc_id, text without repeats, n_sentences, n_removed, and first_ids, the documents that hold first copies of what went."""
    id_col, text_col = kw.get("id_col", "doc_id"), kw.get("text_col", "text")
    found = without_repeats(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), **kw)
    return found.select(F.col("_row").getField(id_col).alias("doc_id"), F.col("_text").alias("text"), F.col("_sentences").alias("n_sentences"), F.col("_removed").alias("n_removed"), F.col("_firsts").alias("first_ids"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", **kw) -> DataFrame:
    """docs with repeats removed from their text; a count of characters is made anew where something went.

    Documents of which nothing but repeats was there are left out.
    """
    found = without_repeats(docs, id_col, text_col, **kw)
    found = found.where((F.col("_removed") == 0) | (F.trim(F.translate("_text", "\t\n\r\x0b\x0c", "     ")) != ""))
    cols = []
    for c, kind in docs.dtypes:
        if c == text_col:
            x = F.col("_text").cast(kind)
        elif c == chars_col:
            x = F.when(F.col("_removed") > 0, F.length("_text").cast(kind)).otherwise(F.col("_row").getField(c))
        else:
            x = F.col("_row").getField(c)
        cols.append(x.alias(c))
    return found.select(*cols)
