"""Token ids in directly addressable files, and reading them back.

A file holds a run of documents in doc_id order.  Ids are split into chunks of eight bits, low
chunk first.  Level 0 has the low chunk of every id; a continuation bitmap marks the ids that go
on, and the next level has a chunk for each of those.  A rank directory counts the marks before
every block of 512, so that the place of any id in the next level is one count and a few bits
away: any token is read without decoding a block.

Layout (little-endian): magic, counts; per document its id, token count; per level the number of
chunks, the chunks, the bitmap and the directory.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tacit.llm.text import slices
from tacit.llm.tokens import ENCODE_BYTES, library_encoder
from tacit.scratch import materialize, scratch_path, task_width

MAGIC = b"DACTOK01"
HEAD = "<8sqqqqB7x"  # magic, partition, number in it, documents, tokens, levels
LEVEL = "<q"
BLOCK = 512  # marks per directory entry
FILE_TOKENS = 4 << 20
SPAN_TOKENS = 1 << 20  # ids that a reader decodes at a time
PARTITION_BYTES = 128 << 20  # text of a sorted partition
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


def pack(ids: np.ndarray, doc_ids: list, lengths: np.ndarray, partition: int, number: int) -> bytes:
    """One file.  ``doc_ids`` may hold None; ``lengths`` sums to the number of ids."""
    known = np.array([d is not None for d in doc_ids], np.uint8)
    parts = [
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        known.tobytes(),
        np.asarray(lengths, "<i8").tobytes(),
    ]
    levels, rest = 0, np.asarray(ids, np.uint32)
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(_ONES[bits], np.arange(0, len(bits), BLOCK // 8), dtype=np.int64) if len(bits) else np.empty(0, np.int64)
        directory = np.concatenate([[0], np.cumsum(counts)]).astype("<i8")
        parts += [struct.pack(LEVEL, len(rest)), rest.astype(np.uint8).tobytes(), bits.tobytes(), directory.tobytes()]
        levels += 1
        rest = rest[more] >> np.uint32(8)
        if not len(rest):
            break
    return struct.pack(HEAD, MAGIC, partition, number, len(doc_ids), len(ids), levels) + b"".join(parts)


class TokenFile:
    """Random access to the ids of a packed file (bytes, memory map or memory view)."""

    def __init__(self, data):
        magic, self.partition, self.number, n_docs, self.n_tokens, n_levels = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = struct.calcsize(HEAD)

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            made = np.frombuffer(data, kind, count, at)
            at += made.nbytes
            return made

        ids, known, self.lengths = take("<i8", n_docs), take("u1", n_docs), take("<i8", n_docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(ids, known)]
        self.levels = []
        for _ in range(n_levels):
            (count,) = struct.unpack_from(LEVEL, data, at)
            at += struct.calcsize(LEVEL)
            chunks = take("u1", count)
            bits = take("u1", (count + 7) // 8)
            self.levels.append((chunks, bits, take("<i8", -(-len(bits) // (BLOCK // 8)) + 1)))

    def rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """Marks before each position: a directory entry plus the bits since its block."""
        _, bits, directory = self.levels[level]
        at = np.asarray(at, np.int64)
        made = np.empty(len(at), np.int64)
        steps = np.arange(BLOCK // 8)
        for low in range(0, len(at), 8192):
            some = at[low : low + 8192]
            block, byte = some // BLOCK, some // 8
            places = block[:, None] * (BLOCK // 8) + steps
            whole = places < byte[:, None]
            ones = _ONES[bits[np.minimum(places, len(bits) - 1)]] * whole
            part = bits[np.minimum(byte, len(bits) - 1)] & ((1 << (some % 8)) - 1).astype(np.uint8)
            made[low : low + 8192] = (
                directory[block] + ones.sum(axis=1) + np.where(byte < len(bits), _ONES[part], 0)
            )
        return made

    def access(self, at) -> np.ndarray:
        """The ids at any positions."""
        at = np.asarray(at, np.int64)
        made = np.zeros(len(at), np.uint32)
        live = np.arange(len(at))
        for level, (chunks, bits, _) in enumerate(self.levels):
            made[live] |= chunks[at].astype(np.uint32) << np.uint32(8 * level)
            more = (bits[at // 8] >> (at % 8).astype(np.uint8)) & 1 == 1
            live, at = live[more], at[more]
            if not len(at):
                break
            at = self.rank(level, at)
        return made

    def span(self, low: int, high: int) -> np.ndarray:
        """The ids of [low, high): each level's part is one run, found by two ranks."""
        made = np.zeros(high - low, np.uint32)
        live = slice(None)
        for level, (chunks, bits, _) in enumerate(self.levels):
            if low >= high:
                break
            part = chunks[low:high].astype(np.uint32) << np.uint32(8 * level)
            if level == 0:
                made = part
                live = None
            else:
                made[live] |= part
            marks = np.unpackbits(bits[low // 8 : (high + 7) // 8], bitorder="little")
            marks = marks[low % 8 : low % 8 + high - low].astype(bool)
            live = np.flatnonzero(marks) if live is None else live[marks]
            low, high = self.rank(level, np.array([low, high])).tolist()
        return made


def write(
    docs: DataFrame,
    tokenizer: str,
    path: str | None = None,
    end_id: int = 2,
    file_tokens: int = FILE_TOKENS,
    added: bool = False,
) -> str:
    """Encode whole texts by a byte-level ``tokenizers`` file and write token files; the folder.

    Documents lie in ascending doc_id order (nulls first, then by text) over the files of the
    sorted partitions; ``end_id`` follows each.  Null and empty texts give the end id alone;
    repeated rows stay repeated.  A file ends with the document that brings it to
    ``file_tokens``.  With ``added``, strings in a text that are added tokens of the file (such as
    <|endoftext|>) get their ids, else they are ordinary text.  Spark's committer writes the files, so a lost task leaves none behind.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-files")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = ["doc_id", F.xxhash64("text")]
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(task_width(spark), -(-size // PARTITION_BYTES))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def work(batches):
        partition, number = TaskContext.get().partitionId(), 0
        encoder = library_encoder(tokenizer, "byte", added)
        ids, doc_ids, lengths, held = [], [], [], 0

        def packed():
            made = pack(np.concatenate(ids), doc_ids, np.concatenate(lengths), partition, number)
            return pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["file"])

        for batch in slices(batches, 1, ENCODE_BYTES // 2):
            made, starts = encoder.encode(batch.column(1))
            made = np.insert(made, starts[1:], np.uint32(end_id))
            sizes = np.diff(starts) + 1
            ends = np.cumsum(sizes)
            low = 0
            while low < len(sizes):
                # Documents up to the one that fills the file.
                before = int(ends[low - 1]) if low else 0
                high = int(np.searchsorted(ends, before + file_tokens - held, "left")) + 1
                high = min(high, len(sizes))
                ids.append(made[before : ends[high - 1]])
                doc_ids += batch.column(0).slice(low, high - low).to_pylist()
                lengths.append(sizes[low:high])
                held += int(ends[high - 1]) - before
                low = high
                if held >= file_tokens:
                    yield packed()
                    number += 1
                    ids, doc_ids, lengths, held = [], [], [], 0
        if doc_ids:
            yield packed()

    # The text writer puts the bytes of a value as they are, with a line end behind each file.
    files = placed.mapInArrow(work, "file binary").select(F.col("file").cast("string"))
    files.write.option("maxRecordsPerFile", 1).text(path)
    return path


def read(spark, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids array<int>)`` from token files.

    ``start`` counts the ids of all documents before.  Files are read whole, one at a time.
    """
    found = _documents(spark, path, keep_ids=True)
    return _with_start(found, found).select("doc_id", "start", "n_tokens", "ids")


def digests(spark, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` read from token files, without keeping ids."""
    found = materialize(_documents(spark, path, keep_ids=False), "token-digests")
    return _with_start(found, found).select("doc_id", "start", "n_tokens", "ids_crc32")


def _documents(spark, path: str, keep_ids: bool) -> DataFrame:
    last = ("ids", "array<int>") if keep_ids else ("ids_crc32", "long")
    names = ["partition", "number", "doc_id", "local", "n_tokens", last[0]]
    schema = "partition long, number long, doc_id long, local long, n_tokens long, " + " ".join(last)

    def work(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                data = memoryview(batch.column(0)[row].as_buffer())
                if len(data) < struct.calcsize(HEAD):
                    continue  # of an empty table
                file = TokenFile(data)
                ends = np.cumsum(file.lengths)
                starts = ends - file.lengths
                low = 0
                while low < len(ends):
                    # A run of documents of a bounded number of tokens is one span.
                    high = int(np.searchsorted(ends, starts[low] + SPAN_TOKENS, "right"))
                    some = slice(low, min(max(high, low + 1), low + 4096))
                    base = int(starts[low])
                    run = file.span(base, int(ends[some][-1]))
                    spans = [run[a:b] for a, b in zip((starts[some] - base).tolist(), (ends[some] - base).tolist())]
                    low = some.stop
                    if keep_ids:
                        made = pa.array([s.astype(np.int32) for s in spans], pa.list_(pa.int32()))
                    else:
                        made = pa.array([zlib.crc32(s.astype("<u4")) for s in spans], pa.int64())
                    n = len(spans)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([file.partition] * n, pa.int64()),
                            pa.array([file.number] * n, pa.int64()),
                            pa.array(file.doc_ids[some], pa.int64()),
                            pa.array(starts[some]),
                            pa.array(file.lengths[some].astype(np.int64)),
                            made,
                        ],
                        names=names,
                    )

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(work, schema)


def _with_start(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Add ``start``: tokens of earlier partitions, of earlier files in the partition, and local.

    Sums run over partitions (a row for each) and over the files of one partition.
    """
    files = sizes.groupBy("partition", "number").agg(F.sum("n_tokens").alias("_n"))
    within = Window.partitionBy("partition").orderBy("number")
    files = files.withColumn("_before", F.sum("_n").over(within) - F.col("_n"))
    parts = files.groupBy("partition").agg(F.sum("_n").alias("_p"))
    across = Window.orderBy("partition")
    parts = parts.select("partition", (F.sum("_p").over(across) - F.col("_p")).alias("_base"))
    base = files.join(parts, "partition").select(
        "partition", "number", (F.col("_before") + F.col("_base")).alias("_base")
    )
    return rows.join(base, ["partition", "number"]).withColumn(
        "start", F.col("_base") + F.col("local")
    )
