import numpy as np
import pytest
import xxhash

from tacit.llm import simhash
from tacit.llm.graph import components


def plain_print(text):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    width = min(3, len(found))
    hashes = [
        xxhash.xxh64_intdigest(b" ".join(found[i : i + width]), 42) for i in range(len(found) - width + 1)
    ]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_roots(prints, distance):
    """doc_id -> smallest doc_id reachable, from a list of (doc_id, print)."""
    root = {d: d for d, _ in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for n, (a, x) in enumerate(prints):
        for b, y in prints[:n]:
            if a == b or (x ^ y).bit_count() <= distance:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {d: find(d) for d in root}


def test_fingerprint_of_blocks(monkeypatch):
    text = "One two\tthree  four\x0bfive Ärger " * 300 + "x" * 500
    want = plain_print(text)
    assert simhash.fingerprint(text.encode()) == want
    monkeypatch.setattr(simhash, "BLOCK_BYTES", 7)
    assert simhash.fingerprint(text.encode()) == want
    for short in ("", "  \n", "one", "one two", "a b c"):
        assert simhash.fingerprint(short.encode()) == plain_print(short)
    assert simhash.fingerprint(None) == 0


def test_gray_rank_orders_by_one_bit():
    codes = np.arange(1024, dtype=np.uint64)
    ordered = codes[np.argsort(simhash.gray_rank(codes))]
    assert (np.bitwise_count(ordered[1:] ^ ordered[:-1]) == 1).all()


@pytest.mark.parametrize("frontier", [1 << 18, 50])
def test_index_against_all_pairs(monkeypatch, frontier):
    monkeypatch.setattr(simhash, "FRONTIER", frontier)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 20, dtype=np.uint64)
    codes = np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 20, dtype=np.uint64)) for _ in range(20))])
    codes ^= np.uint64(1) << rng.integers(0, 64, len(codes), dtype=np.uint64)
    codes = np.unique(codes)
    keys = (codes >> np.uint64(3)).astype(np.int64) % 3
    order = np.lexsort((simhash.gray_rank(codes), keys))
    codes, keys = codes[order], keys[order]
    labels = simhash.GrayIndex(codes, keys).join(3)
    want = np.arange(len(codes))
    i, j = np.nonzero((np.bitwise_count(codes[:, None] ^ codes) <= 3) & (keys[:, None] == keys))
    simhash.unite(want, i, j)
    assert len(np.unique(want)) < len(codes)
    assert labels.tolist() == want.tolist()


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "fingerprint", "component_id", "kept").collect()), key=repr)


@pytest.mark.parametrize("most", [simhash.PATTERN_ROWS, 3])
def test_link_against_all_pairs(spark, documents, most):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(15):
        base = list(rng.choice(words, 120))
        for edits in (0, 0, 1, 1, 2, 3, 5, 8):
            copy = list(base)
            for at in rng.integers(0, len(copy), edits):
                copy[at] = "edited"
            texts.append(" ".join(copy))
    texts += ["", None, " \t ", "one", "One", "one two", "w1 " * 20_000]
    rows = [(int(d), t, "en") for d, t in zip(rng.permutation(len(texts)) * 3, texts)]
    rows += [rows[5], (None, texts[0], "en"), (rows[0][0], "another text of this id entirely", None)]
    got = rows_of(simhash.link(documents(rows), pattern_rows=most))
    prints = [(d, plain_print(t)) for d, t, _ in rows]
    roots = plain_roots([(d, p) for d, p in prints if d is not None], 3)
    want = [(d, f"{p:016x}", roots.get(d), d is None or roots[d] == d) for d, p in prints]
    assert got == sorted(want, key=repr)
    assert len({r for r in roots.values()}) < len(roots) - 30


def test_empty_table(spark, documents):
    assert rows_of(simhash.link(documents([]))) == []


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(1)
    pairs = [(i, i + 1) for i in range(200, 260)] + [(500, k) for k in range(501, 560)]
    pairs += [(7, 7), (9, 3), (3, 9)] + [tuple(map(int, p)) for p in rng.integers(1000, 1100, (80, 2))]
    root = {}

    def find(n):
        root.setdefault(n, n)
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    want = {(n, find(n)) for n in root if find(n) != n}
    got = [tuple(r) for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()]
    assert set(got) == want and len(got) == len(want)
