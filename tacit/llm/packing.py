"""Packing of token ids into sequences of bounded length.

Every task keeps a fixed number of open windows.  A document's full lengths are sequences of
their own; its rest goes to the open window with the least space that still takes it, else into
a new window while there is room for one, else the fullest window is topped up with the head of
the rest and emitted, and the tail is placed again.  What is still open at the end of a task is
merged in a tree of tasks that each see a bounded number of windows.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tacit.llm.text import slices
from tacit.llm.tokens import ENCODE_BYTES, library_encoder
from tacit.scratch import materialize, release, scope, store

SEQUENCE = 2048
OPEN_WINDOWS = 64
# Partitions whose open windows one task merges.
FAN_IN = 8
SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, "
    "sequence_id long, offset long, open boolean, grp long"
)
NAMES = [part.split()[0] for part in SCHEMA.split(", ")]
# Bits of a sequence id: merging level, group (a partition or a group of them), number in it.
LEVEL_BITS, GROUP_BITS = 58, 32


class Packer:
    """Open windows of one task.  A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, size: int, most: int, level: int, group: int):
        self.size, self.most = size, most
        self.base = (level << LEVEL_BITS) | (group << GROUP_BITS)
        self.made = 0
        self.windows: list[tuple[int, int]] = []  # (free, number), ascending
        self.pieces: dict[int, list] = {}
        self.numbers = 0
        self.out: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        """Place all ids of a document."""
        total, full = len(ids), len(ids) // self.size * self.size
        for low in range(0, full, self.size):
            self._emit([(doc_id, low, ids[low : low + self.size], total)])
        if full < total:
            self.place((doc_id, full, ids[full:], total))

    def place(self, piece: tuple) -> None:
        doc_id, start, ids, total = piece
        while len(ids):
            at = bisect.bisect_left(self.windows, (len(ids), -1))
            if at < len(self.windows):  # best fit
                free, number = self.windows.pop(at)
            elif len(self.windows) < self.most:
                free, number = self.size, self.numbers
                self.numbers += 1
                self.pieces[number] = []
            else:  # the fullest
                free, number = self.windows.pop(0)
            taken = min(free, len(ids))
            self.pieces[number].append((doc_id, start, ids[:taken], total))
            if taken == free:
                self._emit(self.pieces.pop(number))
            else:
                bisect.insort(self.windows, (free - taken, number))
            ids, start = ids[taken:], start + taken

    def _emit(self, pieces: list, open_: bool = False) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            row = (doc_id, start, len(ids), ids.astype("<u4").tobytes(), total)
            self.out.append((*row, self.base | self.made, offset, open_))
            offset += len(ids)
        self.made += 1

    def leave(self) -> None:
        """Hand the open windows over, to be merged."""
        for _, number in self.windows:
            self._emit(self.pieces.pop(number), open_=True)
        self.windows = []

    def finish(self) -> None:
        """Emit what is left without padding: runs whose lengths are falling powers of two."""
        rest = [piece for _, number in self.windows for piece in self.pieces.pop(number)]
        self.windows = []
        while rest:
            left = sum(len(ids) for _, _, ids, _ in rest)
            room, window = min(self.size, 1 << (left.bit_length() - 1)), []
            while room:
                doc_id, start, ids, total = rest.pop(0)
                window.append((doc_id, start, ids[:room], total))
                if len(ids) > room:
                    rest.insert(0, (doc_id, start + room, ids[room:], total))
                room -= min(room, len(ids))
            self._emit(window)

    def take(self, group: int) -> pa.RecordBatch:
        rows, self.out = self.out, []
        columns = list(zip(*rows)) if rows else [[] for _ in range(8)]
        kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3 + [pa.bool_()]
        arrays = [pa.array(list(c), kind) for c, kind in zip(columns, kinds)]
        arrays.append(pa.array([group] * len(rows), pa.int64()))
        return pa.RecordBatch.from_arrays(arrays, names=NAMES)


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    size: int = SEQUENCE,
    windows: int = OPEN_WINDOWS,
    fan_in: int = FAN_IN,
    added: bool = False,
) -> DataFrame:
    """``(doc_id, start, length, ids binary, doc_tokens, sequence_id, offset)``, a row per piece.

    ``ids`` are packed little-endian uint32.  Whole texts are encoded by a word-level
    ``tokenizers`` file and ``end_id`` follows each; null and empty texts give the end id alone;
    repeated rows and null ids stay.  Every id lies in one piece, the pieces of a sequence are
    gapless from 0, and all sequences are full but the last few of the whole table, whose lengths
    are powers of two: nothing is padded.  Other columns are ignored.  With ``added``, strings in
    a text that are added tokens of the file get their ids, else they are ordinary text.
    """
    if windows < 1 or fan_in < 2:
        raise ValueError("at least one open window and a fan-in of two")
    with scope() as made:
        packed = _pack(docs, tokenizer, end_id, size, windows, fan_in, added)
    release(made, packed)
    return packed


def _pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    size: int,
    windows: int,
    fan_in: int,
    added: bool,
) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def work(batches):
        group = TaskContext.get().partitionId()
        packer = Packer(size, windows, 0, group)
        encoder = library_encoder(tokenizer, "word", added)
        for batch in slices(batches, 1, ENCODE_BYTES // 4):
            ids, starts = encoder.encode(batch.column(1))
            end = np.array([end_id], np.uint32)
            for at, doc_id in enumerate(batch.column(0).to_pylist()):
                packer.add(doc_id, np.concatenate([ids[starts[at] : starts[at + 1]], end]))
            yield packer.take(group)
        packer.leave()
        yield packer.take(group)

    made = store(rows.mapInArrow(work, SCHEMA), "packed")
    closed = made.frame.where(~F.col("open"))
    left = made.frame.where("open")
    groups = left.agg(F.max("grp")).first()[0]
    level = 0
    while groups is not None:
        level, groups = level + 1, groups // fan_in
        merged = materialize(_merge(left, level, fan_in, size, groups == 0), "packed-rest")
        closed = closed.unionByName(merged.where(~F.col("open")))
        left = merged.where("open")
        if groups == 0:
            break
    return closed.drop("open", "grp")


def _merge(left: DataFrame, level: int, fan_in: int, size: int, last: bool) -> DataFrame:
    """Fill the open windows of ``fan_in`` groups up to one window, or finish the last group."""

    def work(key, table):
        group = key[0].as_py()
        packer = Packer(size, 1, level, group)
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        columns = [table.column(name).to_pylist() for name in ("doc_id", "start", "ids", "doc_tokens")]
        for doc_id, start, ids, total in zip(*columns):
            packer.place((doc_id, start, np.frombuffer(ids, "<u4"), total))
        packer.finish() if last else packer.leave()
        return pa.Table.from_batches([packer.take(group)])

    wider = left.withColumn("grp", F.floor(F.col("grp") / fan_in).cast("long"))
    return wider.groupBy("grp").applyInArrow(work, SCHEMA)
