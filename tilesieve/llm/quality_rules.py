"""Quality rules as a short-circuit cascade.

Two fixed base rules come first: too few words, and too many words in repeated 3-word windows. The
further rules look for mark-up junk, shouting, lists of one word and the like. Each rule's cost, and
which rules reject together, is measured in tasks on a sample from all over the table, among the
documents that the base rules let through. The rule with the most rejections per second comes first,
then the one with the most among the documents that are left, and so on; a document is done at the
first rule that rejects it. The order decides how much work is done, never the verdict: a document is
kept if no rule rejects it, in whatever order they run.

Defined results: a null or empty text has no words, all its counts are 0 and it is rejected. A row
with a null id is treated as any other. Repeated rows get a row each. An empty table gives an empty
result. Columns other than id and text are ignored by `quality_stats` and kept by `filter_quality`,
whatever their names.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilesieve.llm.common import id_text_batches, with_id_and_text

#: The characters between words, and those that count as symbols.
SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"

#: Expected rows of the sample on which costs and rejections are estimated. It decides the order of the rules only.
SAMPLE_ROWS = 2048

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


class Text:
    """A document's statistics, each computed when a rule first asks for it."""

    def __init__(self, data: bytes):
        self.data = data

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()  # of bytes, this splits at SPACES and nothing else

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def letters(self) -> str:
        return self.data.translate(None, SPACES).decode()

    @cached_property
    def word_chars(self) -> int:
        return len(self.letters)

    @cached_property
    def n_symbols(self) -> int:
        return len(self.data) - len(self.data.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.data.split(b"\n") if x.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return words_in_repeats(self.words)

    @cached_property
    def top_word(self) -> int:
        return max(Counter(self.words).values(), default=0)

    @cached_property
    def upper(self) -> int:
        """Letters that have a lower case, as they stand."""
        return sum(1 for x in self.letters if x.isupper())

    @cached_property
    def no_letter(self) -> int:
        """Words without any letter."""
        return sum(1 for x in self.words if not any(c.isalpha() for c in x.decode()))


def words_in_repeats(words: Sequence[bytes]) -> int:
    """Words that stand in a 3-word window which the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    covered = end = 0
    for i, x in enumerate(windows):
        if times[x] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


#: The base rules, which reject before the cascade.
BASE: dict[str, Callable[[Text], bool]] = {
    "few_words": lambda t: t.n_words < 50,
    "repeated_windows": lambda t: 100 * t.n_repeat_words > 50 * t.n_words,
}

#: The cascade. A rule rejects where its function is true.
RULES: dict[str, Callable[[Text], bool]] = {
    "symbols": lambda t: 5 * t.n_symbols > t.n_words,
    "shouting": lambda t: 2 * t.upper > t.word_chars,
    "exclamations": lambda t: 5 * t.data.count(b"!") > t.n_words,
    "duplicate_lines": lambda t: 2 * t.n_dup_lines > len(t.lines),
    "word_length": lambda t: not 2 * t.n_words <= t.word_chars <= 20 * t.n_words,
    "one_word": lambda t: 10 * t.top_word > 3 * t.n_words,
    "no_letters": lambda t: 2 * t.no_letter > t.n_words,
}


@dataclass
class Measured:
    """Of the sampled documents that the base rules let through: seconds of each rule, and how many documents each set of rules rejects."""

    documents: int
    seconds: dict[str, float]
    together: dict[frozenset[str], int]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS, rules: dict | None = None, seed: int = 3) -> Measured:
    """Costs and rejections of the rules on about `rows` rows from all over the table.

    Texts stay in their tasks; what comes to the driver is a row for each set of rules that some
    document breaks.
    """
    rules = RULES if rules is None else rules
    names = list(rules)
    total = docs.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seconds: dict[int, np.ndarray] = {}
            times: Counter = Counter()
            for data in batch.column(0).cast(pa.binary()).to_pylist():
                if any(rule(Text(data or b"")) for rule in BASE.values()):
                    continue
                broken, took = 0, np.zeros(len(names))
                for k, name in enumerate(names):
                    t = Text(data)
                    t.n_words  # every document's words are split before the cascade
                    began = time.perf_counter()
                    broken |= bool(rules[name](t)) << k
                    took[k] = time.perf_counter() - began
                times[broken] += 1
                seconds[broken] = seconds.get(broken, 0) + took
            yield pa.RecordBatch.from_arrays([pa.array(times, pa.int64()), pa.array(times.values(), pa.int64()), pa.array([seconds[k].tolist() for k in times], pa.list_(pa.float64()))], names=["broken", "n", "seconds"])

    sample = with_id_and_text(docs, id_col, text_col).select("text").sample(min(1.0, rows / max(1, total)), seed)
    sums = [F.sum(F.col("seconds")[k]).alias(f"s{k}") for k in range(len(names))]
    found = sample.mapInArrow(run, "broken long, n long, seconds array<double>").groupBy("broken").agg(F.sum("n").alias("n"), *sums).collect()
    together = {frozenset(x for k, x in enumerate(names) if r["broken"] >> k & 1): r["n"] for r in found}
    return Measured(sum(together.values()), {x: float(sum(r[f"s{k}"] for r in found)) for k, x in enumerate(names)}, together)


def cascade_order(measured: Measured, rules: dict | None = None) -> list[str]:
    """Rules by rejections per second among the documents that earlier ones let through; ties, and rules that reject nothing more, by cost and then by name."""
    left, out = dict(measured.together), []
    todo = set(RULES if rules is None else rules)
    while todo:
        hits = {k: sum(n for broken, n in left.items() if k in broken) for k in todo}
        cost = {k: measured.seconds.get(k, 0.0) for k in todo}
        out.append(min(todo, key=lambda k: (-hits[k] / max(cost[k], 1e-9), cost[k], k)))
        todo.remove(out[-1])
        left = {broken: n for broken, n in left.items() if out[-1] not in broken}
    return out


def keeps(t: Text, order: Sequence[str], rules: dict) -> bool:
    return not any(rules[k](t) for k in order)


def quality_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: Sequence[str] | None = None, rules: dict | None = None) -> DataFrame:
    """The base counts of each document, whether a base rule rejects it and whether it is kept."""
    rules = RULES if rules is None else rules
    order = cascade_order(measure(docs, id_col, text_col, rules=rules), rules) if order is None else list(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in id_text_batches(batches):
            rows: list[tuple] = []
            for data in texts:
                t = Text(data)
                base = any(rule(t) for rule in BASE.values())
                rows.append((t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, base, not base and keeps(t, order, rules)))
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in cols[:5]), *(pa.array(c, pa.bool_()) for c in cols[5:])], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return with_id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def filter_quality(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", order: Sequence[str] | None = None, rules: dict | None = None) -> DataFrame:
    """The documents that no rule rejects, with all their columns; here each document stops at its first rejection."""
    rules = RULES if rules is None else rules
    order = cascade_order(measure(docs, id_col, text_col, rules=rules), rules) if order is None else list(order)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            mask = []
            for data in texts:
                t = Text(data or b"")
                mask.append(not any(rule(t) for rule in BASE.values()) and keeps(t, order, rules))
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
