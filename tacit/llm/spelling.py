"""Spelling variants: words one edit apart, found by a bit-sliced position index.

The index of a group of words holds a bitset over the group for every (position, letter): the
words with that letter there.  A word is looked up with a few bitwise operations a letter, on
all words of its group at once: one set follows the words without an error so far, three follow
those with one error, which read on at the same position (a replaced letter), one ahead (a letter
more in the indexed word) or one behind (a letter less).  Many words are looked up together.

Two words one edit apart agree in their beginning or in their end, so words are dealt to groups
by their first and by their last letters.  A group that is too large has the letters that its
words do not share cut in two again, length by length; a pair is found in just one group.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tacit.llm.text import slices
from tacit.scratch import Stored, materialize, release, scope, store, task_width

# Fixed value: what counts as a letter.
LETTERS = "A-Za-zÀ-ÿ"
# From this length on groups hold words of two neighbouring lengths only.
LONG = 24
# Above any position.
NEVER = 1 << 30
# Words of a shard in the mean, and the most that may share a group's letters uncut.
SHARD_ROWS = 16_384
GROUP_ROWS = 16_384
# Distinct words that a task counts before it passes them on.
COUNTED = 200_000
# 64-bit words of a set of lookups.
SET_WORDS = 1 << 19


def _counted(docs: DataFrame, least: int, every: int) -> DataFrame:
    """``(word, n)`` partial counts of the words of all texts; see :func:`group`."""
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    rows = rows.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))

    def batch_of(counts: Counter):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
            names=["word", "n"],
        )

    def work(batches):
        runs = re.compile(f"[{LETTERS}]{{{least},}}").findall
        counts: Counter = Counter()
        for batch in slices(batches, 1):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                start = zlib.crc32(f"{doc_id}:".encode())
                for run, n in Counter(runs(text.lower().decode())).items():
                    code = zlib.crc32(run.encode(), start)
                    if code % every == 0:
                        at = code % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < least:
                            continue
                    counts[run] += n
                if len(counts) >= COUNTED:
                    yield batch_of(counts)
                    counts.clear()
        yield batch_of(counts)

    return rows.mapInArrow(work, "word string, n long")


def _bits(marks: np.ndarray, words: int) -> np.ndarray:
    """Rows of flags as rows of 64-bit sets, ``words`` to a row."""
    packed = np.packbits(marks, axis=1, bitorder="little")
    made = np.zeros((len(marks), words * 8), np.uint8)
    made[:, : packed.shape[1]] = packed
    return made.view("<u8")


class PositionIndex:
    """Bitsets per (position, letter) over the words of a group (Latin-1 bytes)."""

    def __init__(self, words: list[bytes]):
        self.sizes = np.array([len(word) for word in words])
        self.width = int(self.sizes.max())
        self.words = -(-len(words) // 64)
        flat = np.frombuffer(b"".join(word.ljust(self.width + 1, b"\0") for word in words), np.uint8)
        self.letters = flat.reshape(len(words), self.width + 1)
        # Row 0 is the empty set, for letters that no word has at a position.
        rows, self.row = [np.zeros((1, self.words), np.uint64)], np.zeros((self.width + 2, 256), np.int32)
        made = 1
        for place in range(self.width):
            column = self.letters[:, place]
            present = np.unique(column[column > 0])
            rows.append(_bits(column == present[:, None], self.words))
            self.row[place, present] = made + np.arange(len(present))
            made += len(present)
        self.sets = np.concatenate(rows)

    def _of_size(self, size: int, low: int, high: int, other: int) -> np.ndarray:
        """The words of a size, if the smaller of it and the ``other`` is in [low, high)."""
        fits = low <= min(size, other) < high
        return _bits(((self.sizes == size) & fits)[None], self.words)[0]

    def near(self, low: int, high: int, below: int):
        """``(queries, sets)``: for positions of queries, bitsets of the words one edit away.

        Only pairs whose smaller length is in [low, high) and whose common beginning is shorter
        than ``below`` count.
        """
        step = max(1, SET_WORDS // self.words)
        for size in np.unique(self.sizes).tolist():
            same = self._of_size(size, low, high, size)
            more = self._of_size(size + 1, low, high, size)
            less = self._of_size(size - 1, low, high, size)
            if not (same.any() or more.any() or less.any()):
                continue
            every = np.flatnonzero(self.sizes == size)
            for at in range(0, len(every), step):
                queries = every[at : at + step]
                exact, replaced, ahead, behind, early = self._follow(queries, size, below)
                found = (replaced & same) | ((ahead | exact) & more) | (behind & less)
                yield queries, found if early is None else found & ~early

    def _follow(self, queries: np.ndarray, size: int, below: int):
        """The sets after all letters of the queries, and those that agreed on ``below`` letters."""
        shape = (len(queries), self.words)
        exact = np.full(shape, np.uint64(2**64 - 1), np.uint64)
        replaced, ahead, behind = (np.zeros(shape, np.uint64) for _ in range(3))
        early = exact if below == 0 else None
        for place in range(size):
            letter = self.letters[queries, place]
            here = self.sets[self.row[place, letter]]
            replaced = (replaced & here) | (exact & ~here)
            ahead = (ahead | exact) & self.sets[self.row[place + 1, letter]]
            if place:
                behind = behind & self.sets[self.row[place - 1, letter]]
            behind = behind | exact
            exact = exact & here
            if place + 1 == below:
                early = exact
        return exact, replaced, ahead, behind, early


def first_bits(sets: np.ndarray) -> np.ndarray:
    """The position of the first member of each set (none may be empty)."""
    word = (sets != 0).argmax(axis=1)
    value = sets[np.arange(len(sets)), word]
    with np.errstate(over="ignore"):
        return word * 64 + np.bitwise_count((value & (~value + np.uint64(1))) - np.uint64(1))


def _place(low, high, a, b, below) -> Column:
    """A group: smaller lengths in [low, high), a letters shared in front and b at the end."""
    values = {"low": low, "high": high, "a": a, "b": b, "below": below}
    return F.struct(
        *[(v if isinstance(v, Column) else F.lit(v)).cast("int").alias(name) for name, v in values.items()]
    )


def _halves(m: Column, a, b, below) -> Column:
    """The two groups of pairs of smaller length ``m``, with half of the open letters shared."""
    a, b, below = (v if isinstance(v, Column) else F.lit(v) for v in (a, b, below))
    half = F.floor((m - a - b) / 2).cast("int")
    return F.array(
        _place(m, m + 1, a + half, b, below), _place(m, m + 1, a, b + half, F.least(below, a + half))
    )


def _keyed(rows: DataFrame) -> DataFrame:
    letters = (F.col("word").substr(F.lit(1), F.col("a")), F.expr("right(word, b)"))
    return rows.withColumn("key", F.xxhash64("low", "high", "a", "b", "below", *letters))


def _groups(words: DataFrame, least: int, most: int) -> list[Stored]:
    """``(word, n, low, high, a, b, below, key)``: the words of all groups.

    A word of length L plays two parts, as the longer of a pair (smaller length L - 1) and as
    the shorter or equal one (L).  A pair whose common beginning is long enough meets by it, any
    other by the end, where ``below`` keeps the former out.
    """
    size, none = F.length("word"), F.array().cast("array<struct<low:int,high:int,a:int,b:int,below:int>>")
    front = max(1, least // 2)
    short = F.array(_place(least, LONG, front, 0, NEVER), _place(least, LONG, 0, front, front))
    places = F.concat(
        F.when(size <= LONG, short).otherwise(none) if least < LONG else none,
        F.when(size >= max(LONG, least), _halves(size, 0, 0, NEVER)).otherwise(none),
        F.when(size > max(LONG, least), _halves(size - 1, 0, 0, NEVER)).otherwise(none),
    )
    rows = words.select("word", "n", F.explode(places).alias("p")).select("word", "n", "p.*")
    tables = []
    while True:
        dealt = store(_keyed(rows), "dealt")
        # All of a group agree in everything but the open letters.
        open_ = F.max((F.col("high") - F.col("low") > 1) | (F.col("low") - F.col("a") - F.col("b") >= 2))
        counts = dealt.frame.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), open_.alias("open"))
        hot = store(counts.where((F.col("rows") > most) & F.col("open")).select("key"), "hot")
        if not hot.rows:
            return [*tables, dealt]
        tables.append(store(dealt.frame.join(hot.frame, "key", "left_anti"), "dealt"))
        todo = dealt.frame.join(hot.frame, "key", "left_semi")

        def part(m: Column) -> Column:
            inside = (m >= F.col("low")) & (m < F.col("high"))
            return F.when(inside, _halves(m, F.col("a"), F.col("b"), F.col("below"))).otherwise(none)

        places = F.concat(part(size), part(size - 1))
        rows = todo.select("word", "n", F.explode(places).alias("p")).select("word", "n", "p.*")


def near_words(words: DataFrame, least: int, shard_rows: int = SHARD_ROWS, most: int = GROUP_ROWS) -> DataFrame:
    """``(word, n_near, best, best_n)`` for the words that have a near one.

    ``best`` is the most frequent near word; of equally frequent ones the smallest.
    """
    dealt = _groups(words, least, most)
    rows = dealt[0].frame.select("word", "n", "low", "high", "below", "key")
    for table in dealt[1:]:
        rows = rows.unionByName(table.frame.select(*rows.columns))
    total = sum(table.rows for table in dealt)
    shards = max(task_width(words.sparkSession), -(-total // shard_rows))

    def work(batches):
        held = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if held is None or not held.num_rows:
            return
        # The most frequent first, so that the first bit of a set is its best word.
        held = held.sort_by([("key", "ascending"), ("n", "descending"), ("word", "ascending")])
        key, n = held.column("key").to_numpy(), held.column("n").to_numpy()
        texts = held.column("word").combine_chunks()
        low, high, below = (held.column(c).to_numpy() for c in ("low", "high", "below"))
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(key)]):
            if b - a == 1:
                continue
            index = PositionIndex([word.encode("latin-1") for word in texts[a:b].to_pylist()])
            for queries, sets in index.near(int(low[a]), int(high[a]), int(below[a])):
                counts = np.bitwise_count(sets).sum(axis=1, dtype=np.int64)
                some = counts > 0
                if not some.any():
                    continue
                best = a + first_bits(sets[some])
                yield pa.RecordBatch.from_arrays(
                    [
                        texts.take(pa.array(a + queries[some])),
                        pa.array(counts[some]),
                        texts.take(pa.array(best)),
                        pa.array(n[best]),
                    ],
                    names=["word", "n_near", "best", "best_n"],
                )

    found = rows.repartition(shards, "key").mapInArrow(
        work, "word string, n_near long, best string, best_n long"
    )
    first = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best")))
    return (
        found.groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), first.alias("b"))
        .select("word", "n_near", "b.best", (-F.col("b.n")).alias("best_n"))
    )


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` from ``(word, form)``: the last word of each chain, by pointer doubling.

    A form is more frequent than its word, so chains end.
    """
    chains = materialize(forms.select("word", F.col("form").alias("root")), "chains")
    while True:
        ahead = chains.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = chains.join(ahead, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
        )
        longer = materialize(longer, "chains")
        chains = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            return chains


def group(
    docs: DataFrame,
    least: int = 7,
    occurrences: int = 2,
    ratio: int = 10,
    every: int = 31,
    shard_rows: int = SHARD_ROWS,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)``, a row per word of the texts of ``docs``.

    Words come from maximal runs of Latin-1 letters, A-Z lower-cased.  Where ``every`` divides
    h, the CRC-32 of ``<doc_id>:<run>``, the run loses its code point h modulo its length; every 0
    leaves all as they are.  A word has ``least`` code points or more and ``occurrences`` or more
    places overall (n).  Near words differ by one inserted, deleted or replaced code point; all
    count in ``n_near``.  ``form`` is the most frequent near word (ties: the smallest) if it is
    ``ratio`` times as frequent, else null, and ``root`` the last word on the way over forms, or
    the word itself.  Null and empty texts have no words; rows count one by one, also those that
    share a doc_id; a null doc_id counts as empty; other columns are ignored.
    """
    if least < 2 or ratio < 2:
        raise ValueError("words of two letters at least and a ratio of two at least")
    with scope() as made:
        grouped = _group(docs, least, occurrences, ratio, every or NEVER, shard_rows, group_rows)
    release(made, grouped)
    return grouped


def _group(docs, least, occurrences, ratio, every, shard_rows, group_rows) -> DataFrame:
    words = materialize(
        _counted(docs, least, every)
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= occurrences),
        "words",
    )
    near = near_words(words, least, shard_rows, group_rows)
    formed = F.col("best_n") >= ratio * F.col("n")
    judged = materialize(
        words.join(near, "word", "left").select(
            "word",
            F.when(formed, F.col("best")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(formed, F.col("best_n")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(judged.where(F.col("form").isNotNull()))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
