"""Ranks of true items among uniform draws that are made where they are scored.

A draw is a function of its case and its number, so no list of draws is shuffled or stored.  A
cell has a chunk of the cases, each with its user's vector, and the vectors of a part of the
items, packed; it repeats the draws of its cases in NumPy and counts what ranks before the truth.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tacit.scratch import task_width

# Draws of a cell, and item vectors that it is sent, in bytes.
CELL_DRAWS = 1 << 26
PART_BYTES = 128 << 20
# Item vectors packed in one row, in bytes.
PIECE_BYTES = 1 << 20
# Draws that a cell sorts at a time, or takes as they come; digests made and elements gathered at a time.
GROUP_DRAWS = 1 << 22
SLICE_DRAWS = 1 << 18
SLICE_DIGESTS = 1 << 15
SLICE_ELEMENTS = 1 << 17

# md5: what is added, how far each round turns, and which word it reads.
SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
TURNS = [turns[i % 4] for turns in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for i in range(16)]
WORDS = [(step * i + begin) % 16 for step, begin in ((1, 0), (5, 1), (3, 5), (7, 0)) for i in range(16)]
BEGIN = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
# Bytes of a message that fit one block with their end mark and length.
ONE_BLOCK = 55


def digest_heads(words: list[np.ndarray | int], size: int) -> np.ndarray:
    """First four bytes, as a number, of the md5 of ``size`` messages of one block each.

    ``words``: the sixteen little-endian words of the blocks, arrays or what all have in common.
    """
    a, b, c, d = (np.full(size, word, np.uint32) for word in BEGIN)
    mixed = np.empty(size, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=mixed)
            mixed &= b
            mixed ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=mixed)
            mixed &= d
            mixed ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=mixed)
            mixed ^= d
        else:
            np.invert(d, out=mixed)
            mixed |= b
            mixed ^= c
        word, added = words[WORDS[i]], SINES[i]
        a += mixed
        if isinstance(word, np.ndarray):
            a += word
        else:
            added = (added + word) % 2**32
        a += np.uint32(added)
        np.right_shift(a, 32 - TURNS[i], out=mixed)
        a <<= TURNS[i]
        a |= mixed
        a += b
        a, b, c, d = d, a, b, c
    a += np.uint32(BEGIN[0])
    return a.byteswap()


def _tails(length: int, low: int, high: int, seed: int) -> np.ndarray:
    """Words of blocks without their first ``length`` bytes, for numbers of as many digits."""
    blocks = np.zeros((high - low, 64), np.uint8)
    for at, j in enumerate(range(low, high)):
        text = f"{j}|{seed}".encode()
        end = length + len(text)
        blocks[at, length:end] = np.frombuffer(text, np.uint8)
        blocks[at, end] = 0x80
    blocks[:, 56:] = np.frombuffer((end * 8).to_bytes(8, "little"), np.uint8)
    return blocks.view("<u4")


def draw_heads(keys: pa.Array, n: int, seed: int) -> np.ndarray:
    """Draws 0 to n-1 of each key, as :func:`~tacit.functions.draw` makes them of key, number and seed.

    ``keys`` are texts of the same length that end in ``|``; a row of the result is one of them.
    """
    made = np.empty((len(keys), n), np.uint32)
    length = len(keys[0].as_buffer())
    if length + len(f"{max(n - 1, 0)}|{seed}") > ONE_BLOCK:
        for row, key in zip(made, keys):
            start = hashlib.md5(key.as_buffer())
            for j in range(n):
                whole = start.copy()
                whole.update(f"{j}|{seed}".encode())
                row[j] = int.from_bytes(whole.digest()[:4])
        return made
    begin = int.from_bytes(keys.buffers()[1][keys.offset * 4 : keys.offset * 4 + 4], "little")
    blocks = np.zeros((len(keys), 64), np.uint8)
    text = np.frombuffer(keys.buffers()[2], np.uint8)[begin : begin + len(keys) * length]
    blocks[:, :length] = text.reshape(len(keys), length)
    heads = blocks.view("<u4")
    low = 0
    while low < n:
        # Numbers with the same count of digits.
        digits = len(str(low))
        high = min(n, 10**digits, low + SLICE_DIGESTS)
        tails, width = _tails(length, low, high, seed), high - low
        step = max(1, SLICE_DIGESTS // width)
        for first in range(0, len(keys), step):
            some = heads[first : first + step]
            words = []
            for k in range(16):
                varies = 4 * k < length + digits and 4 * k + 4 > length
                word = tails[:, k] if varies else int(tails[0, k])
                if 4 * k < length:
                    word = (some[:, k, None] | (word if varies else np.uint32(word))) + np.zeros(width, np.uint32)
                    word = word.ravel()
                elif varies:
                    word = np.tile(word, len(some))
                words.append(word)
            made[first : first + step, low:high] = digest_heads(words, len(some) * width).reshape(-1, width)
        low = high
    return made


class Block:
    """Item vectors at consecutive places, from ``low`` on, and their ids where these are others."""

    def __init__(self, pieces: list[dict], kind: str, width: int):
        self.low = pieces[0]["_low"]
        self.vectors = np.frombuffer(b"".join(x["_vectors"] for x in pieces), kind).reshape(-1, width)
        ids = [x["_ids"] for x in pieces]
        self.ids = None if None in ids else np.frombuffer(b"".join(ids), np.int32)

    def items(self, places: np.ndarray) -> np.ndarray:
        return places if self.ids is None else self.ids[places - self.low]


def blocks_of(pieces: list[dict], kind: str, width: int, block_bytes: int) -> list[Block]:
    """Blocks of ``block_bytes`` and a piece at least, in the order of places."""
    made, some, held = [], [], 0
    for piece in sorted(pieces, key=lambda x: x["_low"]):
        if some and held + len(piece["_vectors"]) > block_bytes:
            made.append(Block(some, kind, width))
            some, held = [], 0
        some.append(piece)
        held += len(piece["_vectors"])
    return [*made, Block(some, kind, width)] if some else made


class Cell:
    """Counts of draws that rank before the truth among the items of a part."""

    def __init__(self, blocks: list[Block], n: int, bound: int, seed: int):
        self.blocks, self.n, self.bound, self.seed = blocks, n, bound, seed
        self.starts = np.array([block.low for block in blocks], np.int64)
        last = blocks[-1]
        self.ends = np.append(self.starts[1:], last.low + len(last.vectors))
        # One block with every place takes draws as they come.
        self.whole = len(blocks) == 1 and self.starts[0] == 0 and self.ends[0] == bound

    def counts(self, cases: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Per case, draws that come before the truth and draws of this cell's items."""
        text = [pc.cast(cases.column(name).combine_chunks(), pa.string()) for name in ("user_idx", "true_item")]
        keys = pc.binary_join_element_wise(*text, "", "|")
        lengths = pc.binary_length(keys).to_numpy()
        order = np.argsort(lengths, kind="stable")
        keys, lengths = keys.take(pa.array(order)), lengths[order]
        true_item = cases.column("true_item").to_numpy()[order]
        bounds = cases.column("_true").to_numpy()[order]
        vectors = cases.column("_vector").combine_chunks()
        vectors = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(order), -1)[order]
        before, found = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        # Cases whose keys have the same length are drawn together.
        cuts = [0, *(np.flatnonzero(np.diff(lengths)) + 1).tolist(), len(order)]
        step = max(1, (SLICE_DRAWS if self.whole else GROUP_DRAWS) // max(1, self.n))
        for least, most in zip(cuts, cuts[1:]):
            for low in range(least, most, step):
                own = slice(low, min(most, low + step))
                places = draw_heads(keys[own], self.n, self.seed) % np.uint32(self.bound)
                got = self._counted(places.astype(np.int64), vectors[own], true_item[own], bounds[own])
                before[order[own]], found[order[own]] = got
        return before, found

    def _counted(self, places, vectors, true_item, bounds) -> tuple[np.ndarray, np.ndarray]:
        size, flat = len(places), places.ravel()
        before, found = np.zeros(size, np.int64), np.zeros(size, np.int64)
        if self.whole:
            order, cuts = None, [(0, len(flat))]
        else:
            order = np.argsort(flat, kind="stable")
            flat = flat[order]
            cuts = zip(np.searchsorted(flat, self.starts), np.searchsorted(flat, self.ends))
        for block, (begin, end) in zip(self.blocks, cuts):
            step = max(1, SLICE_ELEMENTS // max(1, vectors.shape[1]))
            for low in range(begin, end, step):
                high = min(end, low + step)
                at = flat[low:high]
                case = (np.arange(low, high) if order is None else order[low:high]) // max(1, self.n)
                q, p = block.vectors[at - block.low], vectors[case]
                scores = np.zeros(len(at))
                # Summed in the order of elements, as the true score is.
                for f in range(vectors.shape[1]):
                    scores += p[:, f].astype(np.float64, copy=False) * q[:, f]
                if np.isnan(scores).any():
                    raise ValueError("score is NaN")
                bound = bounds[case]
                first = scores > bound
                tied = np.flatnonzero(scores == bound)
                first[tied] = block.items(at[tied]) < true_item[case[tied]]
                before += np.bincount(case[first], minlength=size)
                found += np.bincount(case, minlength=size)
        return before, found


def item_pieces(items: DataFrame, same: bool, kind: str, rows: int) -> DataFrame:
    """``(_low, _ids, _vectors)``: runs of at most ``rows`` items by ``place``, packed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            place = batch.column("place").to_numpy()
            ids = batch.column("item_idx").to_numpy().astype(np.int32)
            vectors = batch.column("factors").flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
            vectors = vectors.reshape(len(place), -1)
            cut = np.flatnonzero((np.diff(place) != 1) | (place[1:] % rows == 0)) + 1
            runs = [(a, b) for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(place)])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([place[a] for a, _ in runs], pa.int32()),
                    pa.array([None if same else ids[a:b].tobytes() for a, b in runs], pa.binary()),
                    pa.array([vectors[a:b].tobytes() for a, b in runs], pa.binary()),
                ],
                names=["_low", "_ids", "_vectors"],
            )

    piece = F.floor(F.col("place") / F.lit(rows))
    dealt = items.where(F.col("place").isNotNull()).repartition(task_width(items.sparkSession), piece)
    return dealt.sortWithinPartitions("place").mapInArrow(pack, "_low int, _ids binary, _vectors binary")


def rank_draws(
    cases: DataFrame,
    n_cases: int,
    items: DataFrame,
    n_items: int,
    same: bool,
    width: int,
    element: int,
    n: int,
    seed: int,
    block_bytes: int,
) -> DataFrame:
    """``(user_idx, true_item, before, n)`` of cases among ``n`` uniform draws, a row a part.

    ``cases``: ``(user_idx, true_item, _true, _vector)``, ids that are integers; ``items``:
    ``(place, item_idx, factors)`` with places from 0 to ``n_items`` - 1, which are the ids
    themselves where ``same``.  ``element``: bytes of a vector element as it is stored.
    """
    size, kind = max(1, width * element), f"<f{element}"
    rows = max(1, min(PIECE_BYTES, block_bytes) // size)
    parts = max(1, -(-n_items * size // max(PART_BYTES, block_bytes)))
    slots = 2 * cases.sparkSession.sparkContext.defaultParallelism
    chunks = max(-(-slots // parts), -(-n_cases * n // CELL_DRAWS))
    part_rows = -(-max(1, n_items) // (parts * rows)) * rows
    parts = max(1, -(-n_items // part_rows))

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of one cell: pieces of items, then cases."""
        pieces, some, held, cell = [], [], 0, None

        def counted() -> pa.RecordBatch:
            table = pa.Table.from_batches(some)
            before, found = cell.counts(table)
            keys = [table.column(name).combine_chunks() for name in ("user_idx", "true_item")]
            names = ["user_idx", "true_item", "before", "n"]
            return pa.RecordBatch.from_arrays([*keys, pa.array(before), pa.array(found)], names=names)

        for batch in batches:
            is_item = batch.column("_low").is_valid()
            pieces += batch.filter(is_item).select(["_low", "_ids", "_vectors"]).to_pylist()
            batch = batch.filter(pc.invert(is_item)).select(["user_idx", "true_item", "_true", "_vector"])
            if not batch.num_rows:
                continue
            if cell is None:
                cell = Cell(blocks_of(pieces, kind, width, block_bytes), n, n_items, seed)
                pieces = []
            some.append(batch)
            held += batch.num_rows * max(1, n)
            if held >= GROUP_DRAWS:
                yield counted()
                some, held = [], 0
        if some:
            yield counted()

    chunk = F.pmod(F.xxhash64("user_idx", "true_item"), F.lit(chunks)).cast("int")
    every_part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    posed = cases.select("*", chunk.alias("_chunk"), every_part.alias("_part"))
    packed = item_pieces(items, same, kind, rows)
    packed = packed.withColumn("_part", F.floor(F.col("_low") / F.lit(part_rows)).cast("int"))
    packed = packed.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    # A partition is a cell; its item rows come first.
    cell = (F.col("_part") * F.lit(chunks) + F.col("_chunk")).alias("_cell")
    dealt = packed.unionByName(posed, allowMissingColumns=True).withColumn("_cell", cell)
    dealt = dealt.repartitionById(chunks * parts, F.col("_cell")).sortWithinPartitions(F.asc_nulls_last("_low"))
    kinds = dict(cases.dtypes)
    schema = f"user_idx {kinds['user_idx']}, true_item {kinds['true_item']}, before long, n long"
    columns = ["_low", "_ids", "_vectors", "user_idx", "true_item", "_true", "_vector"]
    return dealt.select(*columns).mapInArrow(ranked, schema)
