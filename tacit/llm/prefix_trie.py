"""The trie of conversation prefixes, by balanced parentheses per shard.

A node is a distinct sequence of first turns.  Nodes of one conversation alone form tails without
branches, whose figures follow from their rows; the others, shared by two or more, are the trie
proper.  Its paths are sorted, cut into shards, and each shard writes its part as a sequence of
balanced parentheses in a few bits a node.  Over the sequence lie blocks with the least and
largest excess of opened over closed ones, in a tree (range min-max): ``findclose`` finds the end
of a node's subtree in it.  Leaves of a subtree are pairs ``()``, counted by rank; savings are
differences of cumulative sums in the order of opening.

Only the first and the last path of a shard (its spine) can go on in other shards.  Spines of all
shards are added up node by node and form a smaller trie, which is treated the same way until one
shard holds it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tacit.scratch import Stored, materialize, release, scope, spread, store, task_width

# Conversations begin anew every 20 ids, and share fewer than 4 turns with the start.
STRIDE, HEADS = 20, 4
# Parentheses per block of the excess directory.
BLOCK = 256
# Path entries of a shard in the mean.
SHARD_NODES = 1 << 20
# Rows that a sorting task has in the mean.
SORT_ROWS = 1 << 20
# Turns of a conversation that one window adds up.
SPAN = 4096
WORDS = r"[^\x20\x09-\x0D]+"


class Parentheses:
    """A balanced sequence (1 opens, 0 closes) with its directories."""

    def __init__(self, bits: np.ndarray, block: int = BLOCK):
        self.size, self.block = len(bits), block
        blocks = max(1, -(-self.size // block))
        self.bits = np.zeros(blocks * block, np.uint8)
        self.bits[: self.size] = bits
        steps = np.zeros(len(self.bits), np.int64)
        steps[: self.size] = 2 * bits.astype(np.int64) - 1
        excess = np.cumsum(steps).reshape(blocks, block)
        # Excess before each block, and the least and largest inside, in a complete binary tree.
        self.before = np.concatenate([[0], excess[:-1, -1]])
        self.leaves = 1 << (blocks - 1).bit_length()
        top = np.iinfo(np.int64).max
        self.least, self.most = np.full(2 * self.leaves, top), np.full(2 * self.leaves, -top)
        self.least[self.leaves : self.leaves + blocks] = excess.min(axis=1)
        self.most[self.leaves : self.leaves + blocks] = excess.max(axis=1)
        low = self.leaves
        while low > 1:
            for table, choose in ((self.least, np.minimum), (self.most, np.maximum)):
                table[low // 2 : low] = choose(table[low : 2 * low : 2], table[low + 1 : 2 * low : 2])
            low //= 2
        opened = self.bits.reshape(blocks, block).sum(axis=1, dtype=np.int64)
        self.opened = np.concatenate([[0], np.cumsum(opened)])
        self.pair = self.bits & (1 - np.append(self.bits[1:], np.uint8(0)))
        pairs = self.pair.reshape(blocks, block).sum(axis=1, dtype=np.int64)
        self.pairs = np.concatenate([[0], np.cumsum(pairs)])

    def _rank(self, marks: np.ndarray, directory: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Marks before each position: a directory entry and what lies in the block before it."""
        made = np.empty(len(at), np.int64)
        places = np.arange(self.block)
        for low in range(0, len(at), 4096):
            some = at[low : low + 4096]
            block, inside = some // self.block, some % self.block
            block = np.minimum(block, len(directory) - 2)
            inside = some - block * self.block
            rows = marks.reshape(-1, self.block)[block]
            made[low : low + 4096] = directory[block] + (rows * (places < inside[:, None])).sum(axis=1)
        return made

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Opening parentheses before each position."""
        return self._rank(self.bits, self.opened, at)

    def rank_pairs(self, at: np.ndarray) -> np.ndarray:
        """Pairs ``()`` that begin before each position."""
        return self._rank(self.pair, self.pairs, at)

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """The position that closes each opening one: the next with an excess one lower."""
        made = np.empty(len(opens), np.int64)
        for low in range(0, len(opens), 4096):
            made[low : low + 4096] = self._findclose(opens[low : low + 4096])
        return made

    def _findclose(self, opens: np.ndarray) -> np.ndarray:
        places = np.arange(self.block)
        block, inside = opens // self.block, opens % self.block
        excess = self._excess(block)
        target = excess[np.arange(len(opens)), inside] - 1
        hit = (excess == target[:, None]) & (places > inside[:, None])
        made = block * self.block + hit.argmax(axis=1)
        far = np.flatnonzero(~hit.any(axis=1))
        if not len(far):
            return made
        # Up to the first right neighbour that holds the excess, then down to its first block.
        node, aim = block[far] + self.leaves, target[far]
        climb = np.ones(len(far), bool)
        while climb.any():
            right = (node % 2 == 0) & climb
            found = np.zeros(len(far), bool)
            found[right] = self._holds(node[right] + 1, aim[right])
            node[found] += 1
            climb &= ~found
            node[climb] //= 2
        while True:
            inner = node < self.leaves
            if not inner.any():
                break
            left = self._holds(2 * node[inner], aim[inner])
            node[inner] = 2 * node[inner] + ~left
        block = node - self.leaves
        hit = self._excess(block) == aim[:, None]
        made[far] = block * self.block + hit.argmax(axis=1)
        return made

    def _holds(self, node: np.ndarray, aim: np.ndarray) -> np.ndarray:
        """Excess moves by one, so a run holds every value between its least and largest."""
        return (self.least[node] <= aim) & (aim <= self.most[node])

    def _excess(self, block: np.ndarray) -> np.ndarray:
        steps = 2 * self.bits.reshape(-1, self.block)[block].astype(np.int64) - 1
        return self.before[block, None] + np.cumsum(steps, axis=1)


class Forest:
    """Sums over subtrees of the trie of sorted paths (lists of node ids, all different).

    ``saved`` and ``leaves`` hold the values of each node of a path.  Nodes are numbered in the
    order of opening: ``ids``, ``place`` (depth from 0), ``parent`` (or -1), ``own`` values and
    ``total`` values with a row for savings and one for leaves.  ``last`` lists the nodes of the
    last path; those of the first are the first ones.
    """

    def __init__(self, paths: list[list], saved: list[np.ndarray], leaves: list[np.ndarray], block: int = BLOCK):
        runs, place, parent, self.ids = [], [], [], []
        values: tuple[list, list] = ([], [])
        trail: list[int] = []
        before: list = []
        for number, path in enumerate(paths):
            common = 0
            for a, b in zip(before, path):
                if a != b:
                    break
                common += 1
            runs += [len(before) - common, len(path) - common]
            trail[common:] = range(len(self.ids), len(self.ids) + len(path) - common)
            place += range(common, len(path))
            parent += [trail[p - 1] if p else -1 for p in range(common, len(path))]
            self.ids += path[common:]
            for made, own in zip(values, (saved[number], leaves[number])):
                made.append(own[common:])
            before = path
        runs.append(len(before))
        self.last, self.place = trail, np.array(place, np.int64)
        self.parent = np.array(parent, np.int64)
        self.own = np.array([np.concatenate(made) for made in values], np.int64)
        bits = np.repeat(np.arange(len(runs)) % 2, runs).astype(np.uint8)
        tree = Parentheses(bits, block)
        opens = np.flatnonzero(bits)
        closes = tree.findclose(opens)
        first, after = tree.rank(opens), tree.rank(closes)
        pairs = tree.rank_pairs(closes) - tree.rank_pairs(opens)
        # A pair stands for one leaf; what else a node has goes into a cumulative array.
        rest = self.own - np.array([np.zeros(len(opens), np.int64), tree.pair[opens]])
        sums = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(rest, axis=1)], axis=1)
        self.total = sums[:, after] - sums[:, first]
        self.total[1] += pairs


def _ranked(rows: Stored, order: list[Column], parts: int) -> DataFrame:
    """Add ``i``, the place of a row in its conversation, from 1.

    Rows are sorted over partitions, which may cut a conversation; the few cut ones get the
    number of their rows in earlier partitions added.
    """
    placed = rows.frame.repartitionByRange(parts, "conv_id", *order).sortWithinPartitions("conv_id", *order)

    def work(batches):
        part, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.concatenate([[ids[0] != last], ids[1:] != ids[:-1]]))
            local = np.arange(1, len(ids) + 1)
            before = np.zeros(len(ids), np.int64)
            before[: starts[0] if len(starts) else len(ids)] = -count
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)]):
                before[a:b] = a
            local = local - before
            last, count = ids[-1], int(local[-1])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column("key"),
                    batch.column("words"),
                    pa.array(np.full(len(ids), part, np.int32)),
                    pa.array(local),
                ],
                names=["conv_id", "key", "words", "part", "local"],
            )

    local = materialize(
        placed.mapInArrow(work, "conv_id long, key string, words long, part int, local long"), "turns"
    )
    # At most one conversation goes on from a partition to the next.
    cut = local.groupBy("conv_id").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b")
    sizes = local.join(F.broadcast(cut.select("conv_id")), "conv_id", "left_semi")
    sizes = sizes.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = materialize(
        sizes.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases"
    )
    return local.join(F.broadcast(base), ["conv_id", "part"], "left").select(
        "conv_id", (F.coalesce("base", F.lit(0)) + F.col("local")).alias("i"), "key", "words"
    )


def rebuild(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of rebuilt conversations ``(conv_id, depth, key, words, last)``, and all conversations.

    Every conversation begins with the first h turns of the one at the last multiple of 20 (all
    if it has fewer, none if it is absent), and goes on with its own after the first h, where h
    is the CRC-32 of its decimal id modulo 4.  ``key`` names role and text; turns of one number
    follow by it.  The second table holds ``(conv_id, total)``.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("key"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"),
    )
    rows = store(rows, "keyed")
    parts = max(task_width(rows.frame.sparkSession), -(-rows.rows // SORT_ROWS))
    turns = materialize(_ranked(rows, [F.asc_nulls_first("turn"), F.asc("key")], parts), "ranked")
    heads = (
        turns.where((F.col("i") < HEADS) & (F.col("conv_id") % STRIDE == 0))
        .groupBy(F.col("conv_id").alias("lead"))
        .agg(F.sort_array(F.collect_list(F.struct("i", "key", "words"))).alias("head"))
    )
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    lead = F.col("conv_id") - F.col("conv_id") % STRIDE
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = convs.withColumns({"h": h.cast("int"), "lead": lead}).join(heads, "lead", "left")
    some = F.slice(F.coalesce("head", F.array().cast("array<struct<i:long,key:string,words:long>>")), F.lit(1), F.col("h"))
    convs = convs.select("conv_id", "h", some.alias("head"), F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("own"))
    k = F.size("head").cast("long")
    convs = materialize(convs.select("*", k.alias("k"), (k + F.col("own")).alias("total")), "conversations")
    first = convs.select("conv_id", "total", F.posexplode("head").alias("at", "t")).select(
        "conv_id", (F.col("at") + 1).cast("long").alias("depth"), "t.key", "t.words", "total"
    )
    own = turns.join(convs.select("conv_id", "h", "k", "total"), "conv_id").where(F.col("i") > F.col("h"))
    own = own.select("conv_id", (F.col("k") + F.col("i") - F.col("h")).alias("depth"), "key", "words", "total")
    rebuilt = first.unionByName(own).withColumn("last", F.col("depth") == F.col("total")).drop("total")
    return materialize(rebuilt, "rebuilt"), convs.select("conv_id", "total")


def _prefixes(rebuilt: DataFrame) -> DataFrame:
    """Add the ids of the node that each turn leads to, ``(x, y)``, and of its parent.

    The id is the exclusive or of two 64-bit hashes of all turns so far with their places: 128
    bits, added up over spans and then inside them, so that no conversation is one window.
    """
    rows = rebuilt.withColumns(
        {
            "gx": F.xxhash64("key", "depth", F.lit(1)),
            "gy": F.xxhash64("key", "depth", F.lit(2)),
            "span": F.floor((F.col("depth") - 1) / SPAN),
        }
    )
    spans = rows.groupBy("conv_id", "span").agg(F.bit_xor("gx").alias("sx"), F.bit_xor("gy").alias("sy"))
    before = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    bases = spans.select(
        "conv_id", "span", F.bit_xor("sx").over(before).alias("bx"), F.bit_xor("sy").over(before).alias("by")
    ).where("span > 0")
    inside = Window.partitionBy("conv_id", "span").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.select(
        "*", F.bit_xor("gx").over(inside).alias("rx"), F.bit_xor("gy").over(inside).alias("ry")
    ).join(bases, ["conv_id", "span"], "left")
    x = F.col("rx").bitwiseXOR(F.coalesce("bx", F.lit(0)))
    y = F.col("ry").bitwiseXOR(F.coalesce("by", F.lit(0)))
    return run.select(
        "conv_id",
        "depth",
        "words",
        "last",
        x.alias("x"),
        y.alias("y"),
        x.bitwiseXOR(F.col("gx")).alias("px"),
        y.bitwiseXOR(F.col("gy")).alias("py"),
    )


_SUMS = (
    "path long, place long, x long, y long, saved long, leaves long, own_saved long, own_leaves long, final boolean"
)
_SUM_NAMES = [part.split()[0] for part in _SUMS.split(", ")]


def _as_paths(rows: DataFrame) -> DataFrame:
    """One row per path from ``(path, place, x, y, saved, leaves)``."""
    listed = F.sort_array(F.collect_list(F.struct("place", "x", "y", "saved", "leaves")))
    nodes = rows.groupBy("path").agg(listed.alias("nodes"))
    return nodes.select(
        "path",
        F.transform("nodes", lambda n: F.struct(n["x"].alias("x"), n["y"].alias("y"))).alias("ids"),
        F.transform("nodes", lambda n: n["saved"]).alias("saved"),
        F.transform("nodes", lambda n: n["leaves"]).alias("leaves"),
    )


def _summed(rows: Stored, shard_nodes: int) -> DataFrame:
    """``(x, y, saved, leaves)`` over subtrees, from path rows; see the module's text."""
    shards, done = None, None
    while True:
        wanted = max(1, -(-rows.rows // shard_nodes))
        shards = wanted if shards is None else min(wanted, max(1, shards // 4))
        paths = _as_paths(rows.frame)
        paths = paths.repartitionByRange(shards, "ids").sortWithinPartitions("ids")
        found = materialize(paths.mapInArrow(_shard(shards == 1), _SUMS), "subtrees")
        final = found.where("final").select("x", "y", "saved", "leaves")
        done = final if done is None else done.unionByName(final)
        if shards == 1:
            return done
        # Spines: what hangs on a node in all shards, and its own value once.
        spine = found.where("not final")
        weights = spine.groupBy("x", "y").agg(
            (F.sum("saved") + F.max("own_saved")).alias("saved"),
            (F.sum("leaves") + F.max("own_leaves")).alias("leaves"),
        )
        rows = store(spine.select("path", "place", "x", "y").join(weights, ["x", "y"]), "spines")


def _shard(whole: bool):
    """The work on a partition of sorted paths; ``whole``: it holds all of them."""

    def work(batches):
        names, paths, saved, leaves = [], [], [], []
        for batch in batches:
            names += batch.column("path").to_pylist()
            ids = batch.column("ids")
            pairs = ids.flatten()
            # Paths are compared by both halves of an id.
            flat = list(zip(pairs.field("x").to_pylist(), pairs.field("y").to_pylist()))
            ends = (ids.offsets.to_numpy() - ids.offsets[0].as_py()).tolist()
            paths += [flat[a:b] for a, b in zip(ends, ends[1:])]
            for made, column in ((saved, batch.column("saved")), (leaves, batch.column("leaves"))):
                values = column.flatten().to_numpy()
                made += [values[a:b] for a, b in zip(ends, ends[1:])]
        if not paths:
            return
        trie = Forest(paths, saved, leaves)
        inner = np.ones(len(trie.ids), bool)
        rows = []
        if not whole:
            first = list(range(len(paths[0])))
            spine = sorted({*first, *trie.last})
            inner[spine] = False
            # What hangs on a node of the spine, the spine and its own value apart.
            hang = trie.total - trie.own
            below = np.array([n for n in spine if trie.parent[n] >= 0], np.int64)
            for total, rest in zip(trie.total, hang):
                np.subtract.at(rest, trie.parent[below], total[below])
            given = set()
            for name, nodes in {names[0]: first, names[-1]: trie.last}.items():
                for p, n in enumerate(nodes):
                    both = (0, 0) if n in given else tuple(hang[:, n].tolist())
                    rows.append((name, p, *trie.ids[n], *both, *trie.own[:, n].tolist(), False))
                given.update(nodes)
        inner = np.flatnonzero(inner)
        for low in range(0, len(inner), 65_536):
            some = inner[low : low + 65_536]
            x, y = zip(*[trie.ids[n] for n in some.tolist()])
            none = np.zeros(len(some), np.int64)
            columns = [none, trie.place[some], x, y, *trie.total[:, some], none, none]
            arrays = [pa.array(column, pa.int64()) for column in columns]
            arrays.append(pa.array(np.ones(len(some), bool)))
            yield pa.RecordBatch.from_arrays(arrays, names=_SUM_NAMES)
        if rows:
            kinds = [pa.int64()] * 8 + [pa.bool_()]
            arrays = [pa.array(list(column), kind) for column, kind in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=_SUM_NAMES)

    return work


def _ends(prefixes: DataFrame, convs: DataFrame) -> DataFrame:
    """``(x, y, ends_sha256)`` of the nodes where conversations end.

    A digest takes the ids of its node in order, so they pass through one task, as a stream.
    """
    ends = prefixes.where("last").select("x", "y", "conv_id").unionByName(
        convs.where("total = 0").select(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), "conv_id")
    )
    placed = spread(ends, "x", "y").sortWithinPartitions("x", "y", "conv_id")

    def work(batches):
        node, digest = None, None

        def made(node, digest):
            arrays = [pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([digest.hexdigest()])]
            return pa.RecordBatch.from_arrays(arrays, names=["x", "y", "ends_sha256"])

        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in ("x", "y", "conv_id")]
            for x, y, conv in zip(*columns):
                if (x, y) == node:
                    digest.update(b",%d" % conv)
                    continue
                if node is not None:
                    yield made(node, digest)
                node, digest = (x, y), hashlib.sha256(b"%d" % conv)
        if node is not None:
            yield made(node, digest)

    return placed.mapInArrow(work, "x long, y long, ends_sha256 string")


def trie(conversations: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """A row per node of the trie of rebuilt conversations (see :func:`rebuild`).

    ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256)``: the smallest member, the number of turns, the parent's smallest member (null
    for the root), members, children, leaves and savings of the subtree, and the digest of the
    members that end there.  A node saves its last text's words once for every member but one.
    Null roles and texts are empty; rows without conv_id take no part; repeated rows are turns of
    their own; other columns are ignored.  No conversation, no node.  Nodes are told apart by 128
    bits of hash over the turns' MD5.  A path of shared turns is one row of a shard.
    """
    with scope() as made:
        nodes = _trie(conversations, shard_nodes)
    release(made, nodes)
    return nodes


def _trie(conversations: DataFrame, shard_nodes: int) -> DataFrame:
    rebuilt, convs = rebuild(conversations)
    prefixes = materialize(_prefixes(rebuilt), "prefixes")
    nodes = prefixes.groupBy("x", "y").agg(
        F.min("conv_id").alias("conv_id"),
        F.min("depth").alias("depth"),
        F.count(F.lit(1)).alias("n_convs"),
        F.min("px").alias("px"),
        F.min("py").alias("py"),
        F.min("words").alias("words"),
    )
    nodes = materialize(nodes, "nodes")
    # The root's parts of (x, y) are zero, which is what its children's parent ids come to.
    children = nodes.groupBy(F.col("px").alias("x"), F.col("py").alias("y")).agg(
        F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("n_convs") > 1).alias("shared")
    )
    own = (F.col("n_convs") - 1) * F.col("words")
    leaf = F.col("n_children") - F.col("shared") + (F.col("n_children") == 0).cast("long")
    counted = nodes.join(children, ["x", "y"], "left").fillna(0, ["n_children", "shared"])
    counted = materialize(counted.withColumns({"own_saved": own, "own_leaves": leaf}), "counted")
    shared = counted.where("n_convs > 1")
    # A path ends at a shared node without shared children; its smallest member stands for it.
    ends = shared.where("shared = 0").select("conv_id", F.col("depth").alias("end"))
    paths = (
        prefixes.join(ends, "conv_id")
        .where(F.col("depth") <= F.col("end"))
        .select("conv_id", "depth", "x", "y")
        .join(shared.select("x", "y", "own_saved", "own_leaves"), ["x", "y"])
    )
    paths = store(
        paths.select(
            F.col("conv_id").alias("path"),
            (F.col("depth") - 1).alias("place"),
            "x",
            "y",
            F.col("own_saved").alias("saved"),
            F.col("own_leaves").alias("leaves"),
        ),
        "paths",
    )
    sums = _summed(paths, shard_nodes)
    digests = _ends(prefixes, convs)
    # The root: everything.
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    first = nodes.where("depth = 1").agg(F.count(F.lit(1)).alias("n_children"))
    alone = nodes.where("depth = 1 and n_convs = 1").agg(F.count(F.lit(1)).alias("alone"))
    inner = shared.agg(
        F.coalesce(F.sum("own_saved"), F.lit(0)).alias("saved_tokens"),
        F.coalesce(F.sum("own_leaves"), F.lit(0)).alias("under"),
    )
    root = top.crossJoin(first).crossJoin(alone).crossJoin(inner).select(
        F.lit(0).cast("long").alias("x"),
        F.lit(0).cast("long").alias("y"),
        "conv_id",
        F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast("long").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        (F.col("alone") + F.col("under") + (F.col("n_children") == 0).cast("long")).alias("n_leaves"),
        "saved_tokens",
    )
    root = materialize(root, "root")
    least = root.agg(F.min("conv_id")).first()[0]
    # A parent of one conversation has that of its child; the root is left to its constant.
    parents = shared.select(F.col("x").alias("ux"), F.col("y").alias("uy"), F.col("conv_id").alias("up"))
    inside = F.col("depth") > 1
    named = counted.withColumns(
        {"ux": F.when(inside, F.col("px")).otherwise(F.col("x")), "uy": F.when(inside, F.col("py")).otherwise(F.col("y"))}
    ).join(parents, ["ux", "uy"], "left")
    parent = F.when(F.col("depth") == 1, F.lit(least).cast("long")).otherwise(F.coalesce("up", "conv_id"))
    summed = sums.select("x", "y", F.col("saved").alias("saved_tokens"), F.col("leaves").alias("n_leaves"))
    rows = named.withColumn("parent_conv_id", parent).join(summed, ["x", "y"], "left")
    rows = rows.withColumns(
        {"n_leaves": F.coalesce("n_leaves", F.lit(1)), "saved_tokens": F.coalesce("saved_tokens", F.lit(0))}
    ).select(*root.columns)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return (
        rows.unionByName(root)
        .join(digests, ["x", "y"], "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", none).alias("ends_sha256"),
        )
    )
