"""Near duplicates by SuperMinHash signatures, banding, verification and union-find.

SuperMinHash walks, for every element, through a random permutation of the slots: at level j an
element offers the value j + r to one slot, and no slot twice.  Values of an element are spread
over all slots, which lowers the variance against independent hashes, and once every slot holds a
value below the next level nothing can change any more: long texts stop after a few levels.

Texts with equal shingle sets are one class from the start.  Classes that share a band are
candidates, links are confirmed on full shingle sets, and only links that join two components
are kept, so a group of many copies costs a link per member and not one per pair.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tacit.llm.graph import components
from tacit.llm.text import mix, slices, window_hashes, word_hashes
from tacit.scratch import Stored, materialize, release, scope, store

SLOTS = 126
# Chance of missing a pair at the threshold in all bands, from which the band width follows.
MISS = 1e-4
# Rows of a bucket that one task compares with each other, or with as many others.
TILE = 512
# Shingles of a tile, which bounds the memory of a comparison where texts are long.
TILE_SHINGLES = 2_000_000
# Standard deviations below the threshold at which an estimate rules a pair out.
SURE = 5.0
# Class heads whose texts are fetched by a broadcast of their ids (8 bytes each).
BROADCAST_ROWS = 4_000_000
# Elements whose permutations are held at a time.
BLOCK_ELEMENTS = 150_000


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``words`` words, A-Z lower-cased.

    A text with fewer words has its whole sequence as its only shingle; without words, none.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    hashes = word_hashes(found)
    return np.unique(window_hashes(hashes, min(words, len(found))))


def signatures(sets: list[np.ndarray], slots: int = SLOTS, seed: int = 1) -> np.ndarray:
    """A SuperMinHash signature per set (uint64 per slot: level, then random bits)."""
    made = np.full((len(sets), slots), np.uint64(2**64 - 1), np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    low = 0
    while low < len(sets):
        high = int(np.searchsorted(np.cumsum(sizes[low:]), BLOCK_ELEMENTS, "right")) + low
        high = max(high, low + 1)
        _fill(made[low:high], sets[low:high], sizes[low:high], slots, seed)
        low = high
    return made


def _fill(made: np.ndarray, sets: list[np.ndarray], sizes: np.ndarray, slots: int, seed: int):
    """Signatures of one block of sets, level by level, for the sets that are not yet done."""
    owner = np.repeat(np.arange(len(sets)), sizes)
    elements = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
    flat = made.reshape(-1)
    order = None
    with np.errstate(over="ignore"):
        for level in range(slots):
            if not len(elements):
                return
            draw = mix(elements + np.uint64((seed * 1000 + level + 1) * 0x9E3779B97F4A7C15 % 2**64))
            # The slot from the high bits, the value from the rest.
            pick = (level + ((draw >> np.uint64(44)) * np.uint64(slots - level) >> np.uint64(20))).astype(np.int64)
            value = (np.uint64(level) << np.uint64(44)) | (draw & np.uint64(2**44 - 1))
            if order is None and level == 0:
                slot = pick
                first = pick
            else:
                rows = np.arange(len(elements))
                if order is None:
                    order = np.tile(np.arange(slots, dtype=np.uint8), (len(elements), 1))
                    order[rows, first], order[:, 0] = 0, first.astype(np.uint8)
                slot = order[rows, pick].astype(np.int64)
                order[rows, pick] = order[:, level]
                order[:, level] = slot
            np.minimum.at(flat, owner * slots + slot, value)
            # A set is done when all its slots hold values of this level or an earlier one.
            limit = np.uint64(level + 1) << np.uint64(44)
            live = (made >= limit).any(axis=1)[owner]
            if not live.all():
                elements, owner = elements[live], owner[live]
                if order is not None:
                    order = order[live]
                else:
                    first = first[live]


def band_width(percent: int, slots: int = SLOTS) -> int:
    """The most slots per band with which a pair at the threshold is hardly ever missed."""
    share = percent / 100
    return max(
        (w for w in range(1, 17) if (1 - share**w) ** (slots // w) <= MISS), default=1
    )


def short(made: np.ndarray) -> np.ndarray:
    """Two bytes per slot, enough to compare slots by."""
    return mix(made).astype(np.uint16)


def set_key(found: np.ndarray) -> bytes | None:
    """128 bits that name a shingle set; None for the empty set, which equals nothing."""
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None


def _sketch(docs: DataFrame, words: int) -> DataFrame:
    """``(doc_id, n, key, sig)`` per row; key and sig are null without words."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def work(batches):
        for batch in slices(batches, 1):
            sets = [shingles(text, words) for text in batch.column(1).to_pylist()]
            some = [s for s in sets if len(s)]
            made = iter(short(signatures(some)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_key(s) for s in sets], pa.binary()),
                    pa.array([next(made).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                names=["doc_id", "n", "key", "sig"],
            )

    return rows.mapInArrow(work, "doc_id long, n long, key binary, sig binary")


def _sets(docs: DataFrame, heads: DataFrame, count: int, words: int) -> DataFrame:
    """``(head, set, sig)`` of the documents that lead a class."""
    wanted = heads.select(F.col("head").alias("doc_id"))
    wanted = F.broadcast(wanted) if count <= BROADCAST_ROWS else wanted
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id")

    def work(batches):
        for batch in slices(batches, 1):
            sets = [shingles(text, words) for text in batch.column(1).to_pylist()]
            made = short(signatures(sets)) if sets else []
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                    pa.array([m.tobytes() for m in made], pa.binary()),
                ],
                names=["head", "set", "sig"],
            )

    return rows.mapInArrow(work, "head long, set array<long>, sig binary")


def link(
    docs: DataFrame, words: int = 5, percent: int = 80, tile: int = TILE, slots: int = SLOTS
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, a row per row of ``docs``.

    Linked are documents with ``100 * common >= percent * united`` distinct shingles; a component
    is named by its smallest doc_id, whose rows are kept.  Texts without words (null, empty, white
    space) are linked with nothing and kept.  Rows that share a doc_id are one document, whose
    texts an edge joins; a null doc_id takes no part: its component is null and it is kept.
    Other columns are ignored.  Of the tables written on the way only those that the result
    reads stay.
    """
    with scope() as made:
        linked = _link(docs, words, percent, tile, slots, True).drop("key")
    release(made, linked)
    return linked


def _link(docs: DataFrame, words: int, percent: int, tile: int, slots: int, by_id: bool) -> DataFrame:
    """:func:`link` with the ``key`` of a row's text; without ``by_id`` rows of an id stay apart."""
    width = band_width(percent, slots)
    bands = slots // width
    sketch = materialize(_sketch(docs, words), "sketch")
    classes = materialize(
        sketch.where(F.col("doc_id").isNotNull() & F.col("key").isNotNull())
        .groupBy("key")
        .agg(
            F.min("doc_id").alias("head"),
            F.min("n").alias("n"),
            F.min("sig").alias("sig"),
            F.max("doc_id").alias("_last"),
        ),
        "classes",
    )
    members = _members(classes, bands, width)
    heads = store(members.select("head").distinct(), "heads")
    sets = materialize(_sets(docs, heads.frame, heads.rows, words), "sets")
    # Every member of a bucket against the bucket's smallest.
    close = 100 * F.least("n", "cn") >= percent * F.greatest("n", "cn")
    stars = members.where((F.col("head") != F.col("center")) & close)
    stars = stars.select(F.col("center").alias("a"), F.col("head").alias("b")).distinct()
    edges = materialize(_verified(stars, sets, percent), "links")
    roots = components(edges)
    rest = materialize(_rest(members, roots, sets, percent, bands, width, tile), "links-rest")
    if not rest.isEmpty():
        edges = roots.select(F.col("root").alias("a"), F.col("node").alias("b"))
        roots = components(edges.unionByName(rest))
    if by_id:
        several = _several(sketch)
        if several.rows:
            # An edge from each class of a repeated id to the id.
            ids = sketch.join(several.frame, "doc_id", "left_semi").select("doc_id", "key").distinct()
            more = ids.join(classes.select("key", "head"), "key")
            edges = roots.select(F.col("root").alias("a"), F.col("node").alias("b"))
            roots = components(
                edges.unionByName(more.select(F.col("head").alias("a"), F.col("doc_id").alias("b")))
            )
    named = (
        classes.join(roots, classes["head"] == roots["node"], "left")
        .select("key", F.coalesce("root", "head").alias("component_id"), "head", "_last")
        .where((F.col("component_id") != F.col("head")) | (F.col("_last") != F.col("head")))
        .select("key", "component_id")
    )
    named = materialize(named, "named")
    made = F.coalesce("component_id", "doc_id")
    return (
        sketch.select("doc_id", "n", "key")
        .join(named, "key", "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("doc_id").isNotNull(), made).alias("component_id"),
            (F.col("doc_id").isNull() | (made == F.col("doc_id"))).alias("kept"),
            "key",
        )
    )


def _several(sketch: DataFrame) -> Stored:
    """The ids that have texts with different shingle sets, one of which may be empty."""
    none = F.coalesce("key", F.lit(b""))
    ids = sketch.where(F.col("doc_id").isNotNull()).groupBy("doc_id")
    ids = ids.agg(F.min(none).alias("x"), F.max(none).alias("y")).where("x != y").select("doc_id")
    return store(ids, "several")


def _members(classes: DataFrame, bands: int, width: int) -> DataFrame:
    """``(band, at, head, n, center, cn, size, weight)``: the classes of every bucket that holds two or more."""
    part = F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda b: F.struct(
            F.xxhash64(F.substr("sig", b * (2 * width) + 1, F.lit(2 * width)), b).alias("band"),
            b.alias("at"),
        ),
    )
    listed = classes.select("head", "n", F.explode(part).alias("p")).select(
        "p.band", "p.at", "head", "n"
    )
    buckets = materialize(
        listed.groupBy("band")
        .agg(
            F.min(F.struct("head", "n")).alias("c"),
            F.count(F.lit(1)).alias("size"),
            F.sum("n").alias("weight"),
        )
        .where("size > 1")
        .select("band", F.col("c.head").alias("center"), F.col("c.n").alias("cn"), "size", "weight"),
        "buckets",
    )
    return materialize(listed.join(buckets, "band"), "members")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are linked."""
    left = sets.select(F.col("head").alias("a"), F.col("set").alias("x"))
    right = sets.select(F.col("head").alias("b"), F.col("set").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    sized = pairs.join(right, "b").join(left, "a").select(
        "a", "b", common.alias("k"), (F.size("x") + F.size("y")).alias("n")
    )
    return sized.where(100 * F.col("k") >= percent * (F.col("n") - F.col("k"))).select("a", "b")


def _rest(
    members: DataFrame, roots: DataFrame, sets: DataFrame, percent: int, bands: int, width: int, tile: int
) -> DataFrame:
    """Links between components that share a bucket, beyond those through its smallest member.

    A bucket is cut into tiles, and a task compares two tiles (or one with itself) whole; it
    returns only links that join two components, one per join.
    """
    placed = members.join(roots, members["head"] == roots["node"], "left").select(
        "band", "at", "head", "center", "size", "weight", F.coalesce("root", "head").alias("comp")
    )
    placed = materialize(placed, "placed")
    others = placed.where("head != center")
    open_ = others.groupBy("band").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b"))
    open_ = materialize(open_.where("_a != _b").select("band"), "open-buckets")
    tiles = F.greatest(F.ceil(F.col("size") / tile), F.ceil(F.col("weight") / TILE_SHINGLES))
    tiles = tiles.cast("int")
    mine = F.pmod(F.xxhash64("head", F.lit("tile")), tiles).cast("int")
    rows = (
        placed.join(open_, "band")
        .select("band", "at", "head", "comp", tiles.alias("tiles"), mine.alias("mine"))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
        .select(
            "band",
            "at",
            "head",
            "comp",
            "mine",
            F.least("mine", "other").alias("i"),
            F.greatest("mine", "other").alias("j"),
        )
        .join(sets, "head")
    )
    share = percent / 100
    least = share - SURE * (share * (1 - share) / (bands * width)) ** 0.5

    def compare(table):
        return _compare(table, percent, least, width, bands)

    return rows.groupBy("band", "i", "j").applyInArrow(compare, "a long, b long")


def _compare(table: pa.Table, percent: int, least: float, width: int, bands: int) -> pa.Table:
    """Joining links among the rows of two tiles of a bucket."""
    comps = table.column("comp").to_pylist()
    at, i, j = (table.column(name)[0].as_py() for name in ("at", "i", "j"))
    mine = table.column("mine").to_numpy()
    sig = np.stack([np.frombuffer(s, np.uint16) for s in table.column("sig").to_pylist()])
    lists = table.column("set").combine_chunks()
    flat = lists.flatten().to_numpy().view(np.uint64)
    ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    sets = [flat[a:b] for a, b in zip(ends, ends[1:])]
    sizes = np.diff(ends)
    parent = {c: c for c in comps}

    def root(c):
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    labels = np.array(comps)
    made = []
    for row in range(len(sets)):
        fit = np.arange(len(sets)) > row
        if i != j:
            fit &= mine != mine[row]
        fit &= labels != labels[row]
        fit &= 100 * np.minimum(sizes, sizes[row]) >= percent * np.maximum(sizes, sizes[row])
        near = np.flatnonzero(fit)
        if not len(near):
            continue
        same = sig[near] == sig[row]
        near, same = near[same.mean(axis=1) >= least], same[same.mean(axis=1) >= least]
        # A pair that shares several buckets is compared in the first of them.
        shared = same[:, : at * width].reshape(len(near), at, width).all(axis=2).any(axis=1)
        for other in near[~shared].tolist():
            if root(comps[row]) == root(comps[other]):
                continue
            x, y = sets[row], sets[other]
            place = np.searchsorted(y, x)
            common = int((y[np.minimum(place, len(y) - 1)] == x).sum())
            if 100 * common >= percent * (len(x) + len(y) - common):
                a, b = sorted((root(comps[row]), root(comps[other])))
                parent[b] = a
                made.append((a, b))
    return pa.table(
        {
            "a": pa.array([a for a, _ in made], pa.int64()),
            "b": pa.array([b for _, b in made], pa.int64()),
        }
    )


def keep(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near duplicates, with all columns.

    Of repeated rows of a document one stays.  An id with several texts counts as that many
    documents: a row goes only if its own text has a near duplicate that stays, or occurs again
    under its id.
    """
    with scope() as made:
        kept = _keep(docs, words, percent)
    release(made, kept)
    return kept


def _keep(docs: DataFrame, words: int, percent: int) -> DataFrame:
    found = materialize(_link(docs, words, percent, TILE, SLOTS, False), "linked")
    several = _several(found)
    single = docs
    if several.rows:
        single = docs.join(several.frame, "doc_id", "left_anti").select(*docs.columns)
    dropped = materialize(found.where("not kept").select("doc_id").distinct(), "dropped")
    again = store(
        found.where(F.col("kept") & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .count()
        .where("count > 1")
        .select("doc_id"),
        "repeated",
    )
    kept = single.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    if not again.rows:
        return kept
    once = kept.join(again.frame, "doc_id", "left_anti").select(*docs.columns)
    twice = kept.join(again.frame, "doc_id", "left_semi").select(*docs.columns)
    kept = once.unionByName(twice.dropDuplicates(["doc_id"]))
    if not several.rows:
        return kept
    # Rows of the few ids with several texts are told apart by these.
    rows = _with_key(docs.join(several.frame, "doc_id", "left_semi").select(*docs.columns), words)
    gone = found.where("not kept").join(several.frame, "doc_id", "left_semi")
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("key").alias("_gone")).distinct()
    rest = rows.join(gone, (F.col("doc_id") == F.col("_id")) & F.col("_key").eqNullSafe(F.col("_gone")), "left_anti")
    return kept.unionByName(rest.dropDuplicates(["doc_id", "_key"]).select(*docs.columns))


def _with_key(docs: DataFrame, words: int) -> DataFrame:
    """Add ``_key``, the key of the text's shingle set."""
    at = docs.columns.index("text")

    def work(batches):
        for batch in slices(batches, at):
            keys = [set_key(shingles(text, words)) for text in batch.column(at).to_pylist()]
            yield batch.append_column("_key", pa.array(keys, pa.binary()))

    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, T.StructField("_key", T.BinaryType())]))
