"""Near duplicates by SimHash fingerprints and a Gray-order hierarchical index.

Fingerprints are dealt to shards so that any two within the allowed distance meet in one: the
bits are cut into one part more than bits may differ, so such a pair agrees in a whole part, and
a shard holds the fingerprints that agree in a part's pattern.  A pattern too common for one
shard has its other bits cut again in the same way.

Inside a shard fingerprints are sorted by Gray rank, which puts those with many common bits side
by side.  Runs of neighbours form nodes, nodes form upper nodes; a node holds the bits that all
below it share and its parent does not (a mask and a pattern).  A fingerprint walks down from the
top and adds up its differences to the patterns on the way: a whole group is left as soon as the
sum is too large.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tacit.llm.graph import components
from tacit.llm.text import slices
from tacit.scratch import Stored, materialize, release, scope, store, task_width

BITS = 64
DISTANCE = 3
SEED = 42
# Bytes of a text that are split into words at a time.
BLOCK_BYTES = 1 << 20
# Fingerprints of a shard in the mean, and the most that may share a pattern uncut.
SHARD_ROWS = 32_768
PATTERN_ROWS = 65_536
# Children of a node.
FAN = 8
# Steps of the walk held at a time.
FRONTIER = 1 << 18

_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def shingle_hashes(text: bytes, words: int = 3, seed: int = SEED):
    """Arrays of the XXH64 of each run of ``words`` words, space-joined, A-Z lower-cased.

    Repeats count.  A text of fewer words has its whole sequence as its only run; without words
    there is none.  Texts are read in blocks that end at white space.
    """
    digest = xxhash.xxh64_intdigest
    held: list[bytes] = []
    low, some = 0, False
    while low < len(text):
        end = _SPACE.search(text, low + BLOCK_BYTES)
        high = end.start() if end else len(text)
        found = held + text[low:high].lower().split()
        low = high
        if len(found) >= words:
            some = True
            joined = b" ".join(found)
            ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])[: len(found) - words + 1]
            spans = zip(starts.tolist(), ends[words - 1 :].tolist())
            yield np.array([digest(joined[a:b], seed) for a, b in spans], np.uint64)
            held = found[len(found) - words + 1 :]
        else:
            held = found
    if held and not some:
        yield np.array([digest(b" ".join(held), seed)], np.uint64)


def fingerprint(text: bytes | None, words: int = 3, seed: int = SEED) -> int:
    """A bit is set if it is set in over half of the hashes; zero without words."""
    ones, total = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text or b"", words, seed):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    packed = np.packbits(2 * ones > total, bitorder="little")
    return int(packed.view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = SEED) -> DataFrame:
    """``(doc_id, print)`` per row; ``print`` is the fingerprint as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def work(batches):
        for batch in slices(batches, 1):
            made = [fingerprint(text, words, seed) for text in batch.column(1).to_pylist()]
            prints = np.array(made, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["doc_id", "print"])

    return rows.mapInArrow(work, "doc_id long, print long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray order: every bit is the parity of those above."""
    for step in (1, 2, 4, 8, 16, 32):
        codes = codes ^ (codes >> np.uint64(step))
    return codes


class GrayIndex:
    """Nodes over codes sorted by (key, Gray rank).  Level 0 holds the codes themselves.

    A level has per node the bits fixed there but not above (``mask``), their values
    (``pattern``), and the smallest and largest key below.
    """

    def __init__(self, codes: np.ndarray, keys: np.ndarray, fan: int = FAN):
        self.fan, self.keys = fan, keys
        full = np.full(len(codes), np.uint64(2**64 - 1), np.uint64)
        levels = [(full, codes, keys, keys)]
        while len(levels[-1][0]) > fan:
            mask, pattern, low, high = levels[-1]
            starts = np.arange(0, len(mask), fan)
            first = np.repeat(pattern[starts], fan)[: len(mask)]
            same = np.bitwise_and.reduceat(mask, starts)
            same &= ~np.bitwise_or.reduceat(pattern ^ first, starts)
            levels.append(
                (same, pattern[starts] & same, np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts))
            )
        # Bits that the parent fixes are taken out of its children.
        self.levels = []
        for at, (mask, pattern, low, high) in enumerate(levels):
            if at + 1 < len(levels):
                mask = mask & ~np.repeat(levels[at + 1][0], fan)[: len(mask)]
            self.levels.append((mask, pattern & mask, low, high))
        self.codes = codes

    def join(self, distance: int) -> np.ndarray:
        """A label per code: codes of one key are labelled alike if a chain of links joins them.

        Codes of a key link at ``distance`` or fewer differing bits.  A node whose codes all have
        the label of the walking code already is left too.
        """
        count = len(self.codes)
        labels = np.arange(count)
        if count < 2:
            return labels
        # Neighbours in Gray order are the likeliest links.
        near = np.flatnonzero(
            (np.bitwise_count(self.codes[1:] ^ self.codes[:-1]) <= distance) & (self.keys[1:] == self.keys[:-1])
        )
        unite(labels, near, near + 1)
        whole = self._whole(labels)
        top = len(self.levels) - 1
        every = np.arange(count, dtype=np.int64)
        stack = []
        for node in range(len(self.levels[top][0])):
            stack.append((top, every, np.full(count, node), np.zeros(count, np.uint8)))
        while stack:
            level, query, node, spent = stack.pop()
            if len(query) > FRONTIER:
                half = len(query) // 2
                stack.append((level, query[half:], node[half:], spent[half:]))
                stack.append((level, query[:half], node[:half], spent[:half]))
                continue
            mask, pattern, low, high = self.levels[level]
            key = self.keys[query]
            # Each pair is met from its earlier code.
            go = ((node + 1) * self.fan**level > query + 1) & (low[node] <= key) & (key <= high[node])
            go &= whole[level][node] != labels[query]
            query, node, spent = query[go], node[go], spent[go]
            spent = spent + np.bitwise_count((self.codes[query] ^ pattern[node]) & mask[node])
            go = spent <= distance
            query, node, spent = query[go], node[go], spent[go]
            if not len(query):
                continue
            if level == 0:
                unite(labels, query, node)
                whole = self._whole(labels)
                continue
            below = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
            valid = below < len(self.levels[level - 1][0])
            stack.append(
                (
                    level - 1,
                    np.repeat(query, self.fan)[valid],
                    below[valid],
                    np.repeat(spent, self.fan)[valid],
                )
            )
        return labels

    def _whole(self, labels: np.ndarray) -> list[np.ndarray]:
        """Per level and node the label that all its codes have, or -1."""
        made = [labels]
        for _ in self.levels[1:]:
            starts = np.arange(0, len(made[-1]), self.fan)
            least = np.minimum.reduceat(made[-1], starts)
            made.append(np.where(least == np.maximum.reduceat(made[-1], starts), least, -1))
        return made


def unite(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Give the joined groups of all pairs (u, v) their smallest label, in place."""
    while True:
        a, b = labels[u], labels[v]
        apart = a != b
        if not apart.any():
            return
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = labels[labels]
            if (further == labels).all():
                break
            labels[:] = further


def _parts(free: list[int], count: int) -> list[int]:
    """``count`` masks that share out the free bits evenly, in runs."""
    cuts = [len(free) * k // count for k in range(count + 1)]
    return [sum(1 << bit for bit in free[a:b]) for a, b in zip(cuts, cuts[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _dealt(prints: DataFrame, distance: int, most: int) -> list[Stored]:
    """``(head, print, path, key)`` tables: prints by the pattern they share, in all parts.

    A path is a set of bits that a pair may agree in; the prints of a pattern held by over
    ``most`` of them go on to the paths below, until none is left.  A pattern with f free bits
    holds at most 2**f prints, so this ends.
    """
    spark = prints.sparkSession
    todo = prints.select("head", "print", F.lit(0).alias("path"))
    paths, tables, number = {0: 0}, [], 0
    while True:
        rows, below = [], {}
        for path, agreed in paths.items():
            free = [bit for bit in range(BITS) if not agreed >> bit & 1]
            for part in _parts(free, distance + 1):
                number += 1
                below[number] = agreed | part
                rows.append((path, number, _signed(agreed | part)))
        # A row per path: their number depends on the depth alone.
        steps = F.broadcast(spark.createDataFrame(rows, "path int, below int, mask long"))
        key = F.xxhash64("below", F.col("print").bitwiseAND(F.col("mask")))
        dealt = store(
            todo.join(steps, "path").select("head", "print", F.col("below").alias("path"), key.alias("key")),
            "dealt",
        )
        hot = store(dealt.frame.groupBy("key").count().where(F.col("count") > most).select("key"), "hot")
        if not hot.rows:
            return [*tables, dealt]
        tables.append(store(dealt.frame.join(hot.frame, "key", "left_anti").select("head", "print", "path", "key"), "dealt"))
        todo = store(dealt.frame.join(hot.frame, "key", "left_semi"), "todo").frame.select("head", "print", "path")
        left = {row.path for row in todo.select("path").distinct().collect()}
        paths = {path: mask for path, mask in below.items() if path in left}


def link(
    docs: DataFrame,
    words: int = 3,
    distance: int = DISTANCE,
    seed: int = SEED,
    shard_rows: int = SHARD_ROWS,
    pattern_rows: int = PATTERN_ROWS,
) -> DataFrame:
    """``(doc_id, fingerprint, component_id, kept)``, a row per row of ``docs``.

    Documents link at ``distance`` or fewer differing bits of their fingerprints (16 hex digits);
    a component is named by its smallest doc_id, whose rows are kept.  Texts without words (null,
    empty, white space) have fingerprint zero and link like any other.  Rows that share a doc_id
    are one document with several fingerprints, which an edge joins.  A null doc_id takes no
    part: its component is null and it is kept.  Other columns are ignored.
    """
    if not 0 <= distance < BITS:
        raise ValueError("the distance is a number of bits")
    with scope() as made:
        linked = _link(docs, words, distance, seed, shard_rows, pattern_rows)
    release(made, linked)
    return linked


def _link(docs: DataFrame, words: int, distance: int, seed: int, shard_rows: int, pattern_rows: int) -> DataFrame:
    found = materialize(fingerprints(docs, words, seed), "prints")
    known = found.where(F.col("doc_id").isNotNull())
    prints = materialize(
        known.groupBy("print").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("_last")), "heads"
    )
    dealt = _dealt(prints, distance, pattern_rows)
    rows = dealt[0].frame
    for table in dealt[1:]:
        rows = rows.unionByName(table.frame)
    total = sum(table.rows for table in dealt)
    shards = max(task_width(docs.sparkSession), -(-total // shard_rows))

    def work(batches):
        held = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if held is None or not held.num_rows:
            return
        head, code, key = (held.column(name).to_numpy() for name in ("head", "print", "key"))
        code = code.view(np.uint64)
        order = np.lexsort((gray_rank(code), key))
        head, labels = head[order], GrayIndex(code[order], key[order]).join(distance)
        moved = np.flatnonzero(labels != np.arange(len(labels)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(head[labels[moved]]), pa.array(head[moved])], names=["a", "b"]
        )

    # All prints of a pattern are in one partition, of a size that the row count bounds.
    edges = rows.select("head", "print", "key").repartition(shards, "key").mapInArrow(work, "a long, b long")
    # A doc_id with several fingerprints joins their heads.
    several = known.groupBy("doc_id").agg(F.min("print").alias("x"), F.max("print").alias("y")).where("x != y")
    joined = known.join(several.select("doc_id"), "doc_id", "left_semi").join(prints, "print")
    edges = edges.unionByName(joined.select(F.col("head").alias("a"), F.col("doc_id").alias("b")))
    roots = components(edges)
    named = (
        prints.join(roots, prints["head"] == roots["node"], "left")
        .select("print", F.coalesce("root", "head").alias("component_id"), "head", "_last")
        .where((F.col("component_id") != F.col("head")) | (F.col("_last") != F.col("head")))
        .select("print", "component_id")
    )
    named = materialize(named, "named")
    made = F.coalesce("component_id", "doc_id")
    return found.join(named, "print", "left").select(
        "doc_id",
        F.lpad(F.lower(F.hex("print")), BITS // 4, "0").alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), made).alias("component_id"),
        (F.col("doc_id").isNull() | (made == F.col("doc_id"))).alias("kept"),
    )
