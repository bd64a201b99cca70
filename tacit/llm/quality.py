"""Quality rules as a short-circuit cascade.

A rule rejects a text.  The cost and the rejections of every rule are measured on a sample, and
the rules run in falling order of rejections per cost, so that most rejected texts meet one cheap
rule only.  The verdict is the conjunction of all rules, whatever the order.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tacit.llm.text import slices, window_hashes, word_hashes, words

# The separators of words and the characters that count as symbols.
SEPARATORS = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
# Rows of the sample on which rules are measured, and the longest text in it, in bytes.
SAMPLE_ROWS = 256
SAMPLE_BYTES = 1 << 20


class Text:
    """A text and its features, each computed when first asked for.  Null counts as no words."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return words(self.text)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        """Code points in words."""
        return len(self.text) - sum(self.text.count(c) for c in SEPARATORS)

    @cached_property
    def n_symbols(self) -> int:
        return sum(self.text.count(c) for c in SYMBOLS)

    @cached_property
    def lines(self) -> list[str]:
        """Lines with a word."""
        return [line for line in self.text.split("\n") if line.strip(SEPARATORS)]

    @cached_property
    def n_dup_lines(self) -> int:
        """Lines with a word that equal an earlier line."""
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def hashes(self) -> np.ndarray:
        return word_hashes(self.words)

    @cached_property
    def n_echoes(self) -> int:
        """Words equal to the word before."""
        return int((self.hashes[1:] == self.hashes[:-1]).sum())

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside windows of eight that the text holds twice or more."""
        hashes = window_hashes(self.hashes, WINDOW)
        if len(hashes) < 2:
            return 0
        order = np.argsort(hashes, kind="stable")
        same = hashes[order[1:]] == hashes[order[:-1]]
        if not same.any():
            return 0
        marks = np.zeros(self.n_words + 1, np.int64)
        again = np.zeros(len(hashes), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        found = np.flatnonzero(again)
        np.add.at(marks, found, 1)
        np.add.at(marks, found + WINDOW, -1)
        return int((np.cumsum(marks) > 0).sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


# Integer comparisons, so that every engine agrees on them.
RULES = (
    Rule("few words", lambda t: t.n_words < 20),
    Rule("repeated words", lambda t: 100 * t.n_repeat_words > 30 * t.n_words),
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    # Two equal lines in a short text are no junk.
    Rule("repeated lines", lambda t: t.n_dup_lines > 3 and 100 * t.n_dup_lines > 30 * len(t.lines)),
    Rule("echoes", lambda t: 100 * t.n_echoes > 30 * t.n_words),
    Rule("word length", lambda t: not 2 * t.n_words <= t.word_chars <= 20 * t.n_words),
)
BASE = ("few words", "repeated words")


@dataclass(frozen=True)
class Measured:
    """Mean seconds and share of rejected texts of a rule on the sample."""

    name: str
    cost: float
    rejected: float


def measure(texts: list[str | None], rules=RULES) -> list[Measured]:
    """Run every rule on every sampled text alone, features included."""
    found = []
    for rule in rules:
        started = time.perf_counter()
        rejected = sum(rule.rejects(Text(text)) for text in texts)
        spent = time.perf_counter() - started
        n = max(1, len(texts))
        found.append(Measured(rule.name, max(spent / n, 1e-9), rejected / n))
    return found


def ordered(measured: list[Measured], rules=RULES) -> tuple[Rule, ...]:
    """Rules by falling rejections per cost; among rules without rejections the cheap first."""
    rank = {m.name: (-m.rejected / m.cost, m.cost) for m in measured}
    return tuple(sorted(rules, key=lambda rule: rank[rule.name]))


def plan(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """The cascade for a table: rules ordered by a sample of at most ``sample_rows`` texts.

    The sample comes from the first partitions that hold rows, so nothing else is read for it.
    """
    texts = docs.select("text").where(
        F.col("text").isNull() | (F.octet_length("text") <= SAMPLE_BYTES)
    )
    return ordered(measure([row.text for row in texts.limit(sample_rows).collect()], rules), rules)


def keeps(text: Text, cascade: tuple[Rule, ...]) -> bool:
    """Whether no rule rejects the text; rules after the first rejection do not run."""
    return not any(rule.rejects(text) for rule in cascade)


def report(docs: DataFrame, rules=RULES) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, kept)`` per row.

    All features are computed for every text.  Null and empty texts have zero of everything and
    are rejected for having few words.  Repeated rows and null ids stay; other columns are
    ignored.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = docs.select("doc_id", "text")
    cascade = plan(docs, rules)
    schema = T.StructType(
        [
            rows.schema["doc_id"],
            *[T.StructField(name, T.LongType()) for name in names],
            T.StructField("kept", T.BooleanType()),
        ]
    )
    columns = schema.names

    def work(batches):
        for batch in slices(batches, 1):
            texts = [Text(text) for text in batch.column(1).to_pylist()]
            kept = [keeps(text, cascade) for text in texts]
            counts = [pa.array([getattr(t, name) for t in texts], pa.int64()) for name in names]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(kept, pa.bool_())], names=columns
            )

    return rows.mapInArrow(work, schema)


def keep(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows whose text no rule rejects, with all their columns, in one pass."""
    cascade = plan(docs, rules)
    at = docs.columns.index("text")

    def work(batches):
        for batch in slices(batches, at):
            kept = [keeps(Text(text), cascade) for text in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
