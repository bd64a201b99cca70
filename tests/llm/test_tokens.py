"""Byte-level BPE, token files and packing against the tokenizer libraries."""

import functools
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import example, given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tacit.llm import byte_bpe, packing, token_files
from tacit.llm.queries import QUERIES
from tacit.llm.tokens import library_encoder, rank_encoder, read_ranks

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
HARD = st.text(alphabet=" \n\t\r\x0b　\x85ab'sé1½́.,!<|>Σİ中\U0001f600\xadſ\x1c", max_size=40)
ROWS = [
    (5, "The cat  sat\n\n on the mat.", "en"),
    (3, None, None),
    (4, "", "en"),
    (1, "word " * 700 + "x" * 900 + "\n \n" * 50, "en"),
    (1, "word " * 700 + "x" * 900 + "\n \n" * 50, "en"),
    (2, "é" * 300 + " <|endoftext|> 'sé 12345", "fr"),
    (None, "no id", "en"),
    (7, "one two three four " * 1500, "en"),
]


def exact(path):
    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    return lambda text: made.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def reference():
    encoding = tiktoken.Encoding(
        "own",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=read_ranks(RANKS),
        special_tokens={},
    )
    return lambda text: encoding.encode_ordinary(text or "")


@settings(max_examples=300, deadline=None)
@given(st.lists(HARD, min_size=1, max_size=5))
def test_encoders_equal_the_libraries(texts):
    for encoder, kind in ((library_encoder(BYTE, "byte"), BYTE), (library_encoder(WORD, "word"), WORD)):
        ids, starts = encoder.encode(pa.array(texts))
        want = exact_cached(kind)
        assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [want(t) for t in texts]


_known = {}


def exact_cached(path):
    return _known.setdefault(path, exact(path))


def test_rank_encoder_equals_the_library(reference):
    encoder = rank_encoder(RANKS)
    for text in (r[1] for r in ROWS):
        assert encoder.encode_one(text) == reference(text)


@pytest.mark.parametrize("chunk, overlap", [(32_768, 1_024), (200, 30), (64, 63)])
def test_chunked_encoding_and_decoding(documents, reference, chunk, overlap):
    encoded = byte_bpe.encode(documents(ROWS), RANKS, chunk_chars=chunk, overlap_chars=overlap)
    rows = byte_bpe.decode(encoded, RANKS).collect()
    assert len(rows) == len(ROWS)
    want = {i: t for i, t, _ in ROWS}
    for row in rows:
        assert list(row.ids) == reference(want[row.doc_id])
        assert bytes(row.decoded) == (want[row.doc_id] or "").encode()


HOSTILE = [
    (1, "ab " * 60 + "x" * 90 + " cd" * 200, "en"),
    (2, "12" * 700 + " the end", "en"),
    (3, " " * 500 + "a" + "\n" * 300 + "don't " * 60, "en"),
    (None, "ab " * 60 + "x" * 1000 + " cd" * 200 + "7" * 301 + " é" * 200, "fr"),
    (5, "z" * 1500, "en"),
    (6, None, "en"),
    (6, "short", "en"),
]


@pytest.mark.parametrize("chunk, overlap", [(32_768, 1_024), (200, 30), (90, 10), (66, 12)])
def test_overlaps_without_a_meeting(documents, reference, chunk, overlap):
    """Also on the query's own path, which decodes short texts where they are encoded."""
    docs = documents(HOSTILE + HOSTILE[:1])
    made = byte_bpe.encode(docs, RANKS, chunk_chars=chunk, overlap_chars=overlap, decoded=True)
    got = sorted((r.doc_id or 0, bytes(r.decoded), list(r.ids)) for r in made.collect())
    rows = [(i or 0, (t or "").encode(), reference(t)) for i, t, _ in HOSTILE + HOSTILE[:1]]
    assert got == sorted(rows)


@pytest.mark.parametrize("chunk", [99, 100])
def test_chunks_go_on_behind_an_overlap_without_a_meeting(documents, chunk):
    text = "ab " * 30 + "x" * 250 + " cd" * 1000 + "1" * 400 + " ef" * 1000
    key = [F.col("doc_id"), F.xxhash64("text").alias("_h"), F.length("text").alias("_n")]
    found = byte_bpe._cuts(
        documents([(1, text, "en")]).select(*key, "text"), public_tokenizers.PATTERN, chunk, 20
    )
    cuts = found.first().cuts
    starts = {m.start() for m in regex.finditer(public_tokenizers.PATTERN, text)}
    assert set(cuts) <= starts | {0} and cuts == sorted(set(cuts))
    # Only the two runs, and what the last rounds took in with them, are longer than a chunk.
    assert len(cuts) > len(text) / chunk - 16
    assert max(b - a for a, b in zip(cuts, cuts[1:])) < 1200


def test_empty_tables(spark, documents):
    none = documents(ROWS).where("false")
    assert byte_bpe.encode(none, RANKS).count() == 0
    assert token_files.read(spark, token_files.write(none, BYTE)).count() == 0
    assert packing.pack(none, WORD).count() == 0


@given(st.lists(st.integers(0, 2**20), max_size=3000))
@settings(max_examples=40, deadline=None)
def test_token_file_gives_any_token(ids):
    ids = np.array(ids, np.uint32)
    file = token_files.TokenFile(token_files.pack(ids, [1], np.array([len(ids)]), 0, 0))
    some = np.random.default_rng(0).permutation(len(ids))
    assert file.access(some).tolist() == ids[some].tolist()
    for low, high in ((0, len(ids)), (len(ids) // 3, len(ids) // 2), (0, 0)):
        assert file.span(low, high).tolist() == ids[low:high].tolist()


@pytest.mark.parametrize("limit", [4 << 20, 100])
def test_token_files_round_trip(spark, documents, limit):
    docs = documents(ROWS)
    rows = token_files.read(spark, token_files.write(docs, BYTE, file_tokens=limit)).collect()
    rows.sort(key=lambda r: r.start)
    want, at = exact_cached(BYTE), 0
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    texts = {i: t for i, t, _ in ROWS}
    for row in rows:
        assert list(row.ids) == want(texts[row.doc_id]) + [2]
        assert (row.start, row.n_tokens) == (at, len(row.ids))
        at += row.n_tokens


@pytest.mark.parametrize("size, windows, fan_in", [(2048, 64, 8), (64, 2, 2), (16, 1, 2)])
def test_packing_keeps_every_id(documents, size, windows, fan_in):
    docs = documents(ROWS).repartition(5)
    rows = packing.pack(docs, WORD, size=size, windows=windows, fan_in=fan_in).collect()
    want, texts = exact_cached(WORD), {i: t for i, t, _ in ROWS}
    sequences, pieces = {}, {}
    for row in rows:
        ids = np.frombuffer(row.ids, "<u4").tolist()
        full = want(texts[row.doc_id]) + [1]
        assert ids == full[row.start : row.start + row.length] and row.doc_tokens == len(full)
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == zlib.crc32(row.ids)
        sequences.setdefault(row.sequence_id, []).append((row.offset, row.length))
        pieces[row.doc_id] = pieces.get(row.doc_id, 0) + row.length
    copies = {i: sum(r[0] == i for r in ROWS) for i, _, _ in ROWS}
    assert pieces == {i: copies[i] * (len(want(t)) + 1) for i, t in texts.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        # Nothing is padded: full, or a power of two.
        assert at == size or (at < size and at & (at - 1) == 0)
    assert sum(sum(n for _, n in p) < size for p in sequences.values()) <= size.bit_length()


MARKS = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "<|", "|>", " ", "\n", "a", " 's", "é", "Σİ", "　"]
MARKED = st.lists(st.sampled_from(MARKS), max_size=12).map("".join)


as_it_comes = functools.cache(Tokenizer.from_file)


def library_call(path, texts):
    """The library with its flag at the default."""
    found = as_it_comes(path).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [made.ids for made in found]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.none() | MARKED, min_size=1, max_size=6))
@example(["a <|endoftext|> b", None, "", "plain", "<|endoftext|>" * 3])
def test_added_tokens_get_their_ids(texts):
    for path, kind in ((BYTE, "byte"), (WORD, "word")):
        ids, starts = library_encoder(path, kind, added=True).encode(pa.array(texts, pa.string()))
        assert ids.dtype == np.uint32
        got = [ids[a:b].tolist() for a, b in zip(starts, starts[1:])]
        assert got == library_call(path, texts)


MARKED_ROWS = [(i, t, "en") for i, t in enumerate(["a <|endoftext|> b", None, "c", "x<|startoftext|>y<|endoftext|>"])]


@pytest.mark.parametrize("name", ["op6_token_files", "op9_packing"])
def test_queries_equal_the_library_call(spark, documents, tmp_path, name):
    documents(MARKED_ROWS).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in QUERIES[name](spark, str(tmp_path)).collect()}
    path, end = (BYTE, 2) if name == "op6_token_files" else (WORD, 1)
    at = 0
    for (i, _, _), ids in zip(MARKED_ROWS, library_call(path, [t for _, t, _ in MARKED_ROWS])):
        ids = [*ids, end]
        if name == "op6_token_files":
            assert (rows[i].start, rows[i].n_tokens) == (at, len(ids))
            assert rows[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
            at += len(ids)
        else:
            assert rows[i].doc_tokens == len(ids)


def test_pipeline_packs_added_tokens(spark, documents):
    pieces = corpus_pipeline.pack_sequences(spark, documents(MARKED_ROWS), "").collect()
    want = library_call(WORD, [t for _, t, _ in MARKED_ROWS])
    assert {p.doc_id: p.doc_tokens for p in pieces} == {i: len(ids) + 1 for i, ids in enumerate(want)}
