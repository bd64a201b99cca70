"""Byte-level BPE: overlapping chunk encoding, and decoding to raw bytes.

A text longer than a chunk is cut into chunks that overlap.  Tasks pre-tokenise all chunks at
once; where the pre-token boundaries of two neighbours meet inside their overlap, the text may be
cut, because scanning from a true boundary gives true boundaries from there on.  The pieces
between such cuts are encoded in parallel, and their ids are put together again in order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tacit.llm.text import SLICE_BYTES, once, slices
from tacit.llm.tokens import BYTE_PATTERN, rank_bytes, rank_encoder
from tacit.scratch import materialize, release, scope, spread

# Characters of a chunk, and how far it reaches into the next one.
CHUNK_CHARS = 32_768
OVERLAP_CHARS = 1_024
IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))
DECODED = T.StructField("decoded", T.BinaryType())
# What names a long text: its id, the hash of its characters and their number.
KEY = ("doc_id", "_h", "_n")


def encode(
    docs: DataFrame,
    ranks: str,
    pattern: str = BYTE_PATTERN,
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
    decoded: bool = False,
) -> DataFrame:
    """``(doc_id, ids array<int>)`` of whole texts by a rank file, without special tokens.

    Equal to the rank library on the whole text.  With ``decoded`` the ids are decoded as by
    :func:`decode`, for texts of one chunk by the task that made them.  Null and empty texts have
    no ids; a null doc_id is kept; repeated rows stay repeated; other columns are ignored.
    """
    if not 0 < overlap_chars < chunk_chars:
        raise ValueError("the overlap must be shorter than a chunk")
    rows = docs.select("doc_id", "text")
    long = F.coalesce(F.length("text") > chunk_chars, F.lit(False))
    with scope() as made:
        whole = _encode_long(rows.where(long), ranks, pattern, chunk_chars, overlap_chars)
    encoded = _encode_pieces(rows.where(~long), ranks, pattern, decoded).unionByName(
        decode(whole, ranks) if decoded else whole
    )
    release(made, encoded)
    return encoded


def _encode_pieces(
    rows: DataFrame, ranks: str, pattern: str, decoded: bool = False
) -> DataFrame:
    """Replace the column ``text`` by its ids, and the bytes decoded from them if wanted."""
    keys = rows.drop("text")
    schema = T.StructType([*keys.schema.fields, IDS, *([DECODED] if decoded else [])])
    at, names = len(keys.columns), schema.names

    def work(batches):
        encoder = rank_encoder(ranks, pattern)
        known = pa.array(rank_bytes(ranks), pa.large_binary()) if decoded else None
        for batch in slices(batches, at, SLICE_BYTES):
            ids, starts = encoder.encode(batch.column(at))
            lists = pa.ListArray.from_arrays(
                pa.array(starts.astype(np.int32)), pa.array(ids.view(np.int32))
            )
            made = [_joined(known, lists)] if decoded else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], lists, *made], names=names)

    return rows.select(*keys.columns, "text").mapInArrow(work, schema)


def _encode_long(
    rows: DataFrame, ranks: str, pattern: str, chunk_chars: int, overlap_chars: int
) -> DataFrame:
    """Texts of several chunks.  Equal rows are encoded once and repeated at the end."""
    key = [F.col("doc_id"), F.xxhash64("text").alias("_h"), F.length("text").alias("_n")]
    copies = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_copies"))
    texts = rows.select(*key, "text").dropDuplicates(KEY)
    cuts = _cuts(texts, pattern, chunk_chars, overlap_chars)
    spans = texts.alias("t").join(cuts.alias("c"), _same("t", "c")).select(
        *(f"t.{c}" for c in KEY), "text", F.posexplode("cuts").alias("_k", "_from"), "cuts"
    )
    end = F.coalesce(F.get("cuts", F.col("_k") + 1), F.col("_n"))
    piece = F.col("text").substr(F.col("_from") + 1, end - F.col("_from"))
    pieces = spans.select(*KEY, "_k", piece.alias("text"))
    # Pieces are placed by their own hash, so that those of one long text go to all tasks.
    encoded = _encode_pieces(spread(pieces, "doc_id", "_h", "_k"), ranks, pattern)
    whole = encoded.groupBy(*KEY).agg(
        F.flatten(
            F.transform(F.sort_array(F.collect_list(F.struct("_k", "ids"))), lambda p: p["ids"])
        ).alias("ids")
    )
    return whole.alias("w").join(copies.alias("n"), _same("w", "n")).select(
        "w.doc_id", "ids", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_")
    ).drop("_")


def _cuts(texts: DataFrame, pattern: str, chunk_chars: int, overlap_chars: int) -> DataFrame:
    """Where each text may be cut: 0, and a boundary in the overlap of any two chunks that meet.

    Where two chunks have no common boundary in their overlap, the first takes the other in and
    is pre-tokenised again, up to the next chunk's overlap.  Chunks behind a failure are taken in
    by twice as many a round, so the rounds are few; all other chunks stay as they are.
    """
    last = F.floor((F.col("_n") - 1) / chunk_chars).cast("int")
    chunks = texts.select(*KEY, "text", F.explode(F.sequence(F.lit(0), last)).alias("_i"))
    chunks = chunks.withColumn("_j", F.col("_i") + 1)
    edges = materialize(_edges(chunks, pattern, chunk_chars, overlap_chars), "chunk-edges")
    heads = edges.where(~F.col("_tail")).select(*KEY, "_j", "_at")
    met = materialize(_meetings(edges.where("_tail"), heads), "chunk-meetings")
    width = 1
    while not met.where("_cut is null").isEmpty():
        # Of a block of chunks all behind its first failure go; a block may begin with one.
        block = Window.partitionBy(*KEY, F.floor(F.col("_j") / width))
        lost = F.min(F.when(F.col("_cut").isNull() & (F.col("_j") % width != 0), F.col("_j")))
        gone = F.col("_cut").isNull() | F.coalesce(F.col("_j") > lost.over(block), F.lit(False))
        before = Window.partitionBy(*KEY).orderBy("_j")
        stays = F.when(~F.col("_gone"), F.col("_j"))
        so_far = before.rowsBetween(Window.unboundedPreceding, -1)
        left = materialize(
            met.withColumn("_gone", gone)
            .withColumn("_again", F.lag("_gone", 1, False).over(before))
            .withColumn("_i", F.coalesce(F.last(stays, True).over(so_far), F.lit(0)))
            .where(~F.col("_gone"))
            .select(*KEY, "_j", "_cut", "_again", "_i"),
            "chunk-rest",
        )
        longer = texts.alias("t").join(left.where("_again").alias("l"), _same("t", "l"))
        longer = longer.select(*(f"t.{c}" for c in KEY), "text", "_i", "_j")
        tails = _edges(longer, pattern, chunk_chars, overlap_chars).where("_tail")
        kept = left.where(~F.col("_again")).select(*KEY, "_j", "_cut")
        met = materialize(kept.unionByName(_meetings(tails, heads)), "chunk-meetings")
        width *= 2
    sure = F.sort_array(F.collect_list("_cut"))
    listed = met.groupBy(*KEY).agg(F.concat(F.array(F.lit(0)), sure).alias("cuts"))
    # A text that is one chunk in the end has no meeting left.
    whole = texts.select(*KEY).alias("t").join(listed.alias("c"), _same("t", "c"), "left")
    cuts = F.coalesce("cuts", F.array(F.lit(0)))
    return whole.select(*(f"t.{c}" for c in KEY), cuts.alias("cuts"))


def _same(left: str, right: str, *more: str) -> list[Column]:
    return [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in (*KEY, *more)]


def _meetings(tails: DataFrame, heads: DataFrame) -> DataFrame:
    """``(KEY, _j, _cut)``: the first boundary that chunk ``_j`` shares with the one before, or null."""
    cut = F.array_min(F.array_intersect("a._at", "b._at"))
    return (
        tails.alias("a")
        .join(heads.alias("b"), _same("a", "b", "_j"))
        .select(*(f"a.{c}" for c in (*KEY, "_j")), cut.alias("_cut"))
    )


def _edges(spans: DataFrame, pattern: str, chunk_chars: int, overlap_chars: int) -> DataFrame:
    """``(KEY, _j, _tail, _at)``: boundaries in the overlaps that a span of chunks begins and ends with.

    ``spans`` holds ``(KEY, text, _i, _j)``: the chunks from ``_i`` to the one before ``_j`` are
    pre-tokenised as one, from the beginning of ``_i`` through the overlap with ``_j``.
    """
    length = (F.col("_j") - F.col("_i")) * chunk_chars + overlap_chars
    part = F.col("text").substr(F.col("_i") * chunk_chars + 1, length)
    spans = spans.select(*KEY, "_i", "_j", part.alias("text"))
    fields = [spans.schema[c] for c in KEY]
    schema = T.StructType(
        [
            *fields,
            T.StructField("_j", T.IntegerType()),
            T.StructField("_tail", T.BooleanType()),
            T.StructField("_at", T.ArrayType(T.IntegerType())),
        ]
    )

    def work(batches):
        find = once(("tokens", "pattern", pattern), lambda: regex.compile(pattern)).finditer
        for batch in batches:
            rows = {name: [] for name in ("at", "tail", "row", "j")}
            for row, (i, j, text) in enumerate(
                zip(*(batch.column(c).to_pylist() for c in range(3, 6)))
            ):
                # A cut behind white space could change how that white space is split.
                found = np.array(
                    [m.start() for m in find(text) if m.start() and not text[m.start() - 1].isspace()],
                    np.int64,
                )
                base = i * chunk_chars
                for tail, chunk in ((False, i), (True, j)):
                    low = (chunk - i) * chunk_chars
                    inside = found[(found >= low) & (found < low + overlap_chars)]
                    rows["at"].append((inside + base).tolist())
                    rows["tail"].append(tail)
                    rows["row"].append(row)
                    rows["j"].append(chunk)
            keys = batch.select([0, 1, 2]).take(pa.array(rows["row"], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    *keys.columns,
                    pa.array(rows["j"], pa.int32()),
                    pa.array(rows["tail"], pa.bool_()),
                    pa.array(rows["at"], pa.list_(pa.int32())),
                ],
                names=schema.names,
            )

    # The work of a span is placed by its own hash, so that one long text does not stay in a task.
    dealt = spans.repartition(F.xxhash64("doc_id", "_h", "_i"))
    return dealt.mapInArrow(work, schema).where("_j > 0")


def _joined(known: pa.Array, lists: pa.Array) -> pa.Array:
    """The bytes of each list's tokens in a row."""
    lists = lists.fill_null([]) if lists.null_count else lists
    made = known.take(lists.flatten())
    ends = np.frombuffer(made.buffers()[1], np.int64, len(made) + 1)
    starts = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    data = made.buffers()[2] or pa.py_buffer(b"")
    return pa.Array.from_buffers(
        pa.large_binary(), len(lists), [None, pa.py_buffer(starts.tobytes()), data]
    ).cast(pa.binary())


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """Add ``decoded binary``: the bytes of the tokens of ``ids`` in a row (null: empty)."""
    kept = encoded.drop("decoded")
    at = kept.columns.index("ids")
    names = [*kept.columns, "decoded"]

    def work(batches):
        known = pa.array(rank_bytes(ranks), pa.large_binary())
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                some = batch.slice(low, 256)
                yield pa.RecordBatch.from_arrays(
                    [*some.columns, _joined(known, some.column(at))], names=names
                )

    return kept.mapInArrow(work, T.StructType([*kept.schema.fields, DECODED]))


def joined_ids(ids: Column) -> Column:
    """Decimal ids joined by one space."""
    return F.concat_ws(" ", ids.cast("array<string>"))
