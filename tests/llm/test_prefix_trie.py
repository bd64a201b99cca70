import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tacit.llm import prefix_trie

COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def plain_close(bits, at):
    depth = 0
    for place in range(at, len(bits)):
        depth += 1 if bits[place] else -1
        if not depth:
            return place


def random_forest(rng, nodes):
    bits, depth = [], 0
    while len(bits) < 2 * nodes:
        left = 2 * nodes - len(bits)
        if depth == 0 or (depth < left and rng.random() < 0.55):
            bits.append(1)
            depth += 1
        else:
            bits.append(0)
            depth -= 1
    return np.array(bits, np.uint8)


@pytest.mark.parametrize("nodes,block", [(1, 4), (40, 4), (500, 8), (3000, 64), (300, 1024)])
def test_parentheses_against_plain(nodes, block):
    bits = random_forest(np.random.default_rng(nodes), nodes)
    tree = prefix_trie.Parentheses(bits, block)
    opens = np.flatnonzero(bits)
    assert tree.findclose(opens).tolist() == [plain_close(bits.tolist(), o) for o in opens.tolist()]
    at = np.arange(len(bits) + 1)
    assert tree.rank(at).tolist() == np.concatenate([[0], np.cumsum(bits)]).tolist()
    pair = [int(a == 1 and b == 0) for a, b in zip(bits, [*bits[1:], 1])]
    assert tree.rank_pairs(at).tolist() == np.concatenate([[0], np.cumsum(pair)]).tolist()


def test_deep_chain():
    bits = np.array([1] * 5000 + [0] * 5000, np.uint8)
    closes = prefix_trie.Parentheses(bits, 16).findclose(np.arange(5000))
    assert closes.tolist() == list(range(9999, 4999, -1))


def plain(rows):
    """The nodes by their definition; rows (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, key, role, text))
    turns = {c: [(r, t) for *_, r, t in sorted(made)] for c, made in own.items()}
    members = defaultdict(list)
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        lead = c - int(math.fmod(c, 20))  # the remainder has the sign of the id, as in SQL
        whole = turns.get(lead, [])[:h] + mine[h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append((c, d == len(whole)))
    made = []
    for node, found in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[: len(n)] == n and len(m) > len(n) for m in below)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode().split()) for n in below if n)
        ends = ",".join(str(c) for c in sorted(c for c, last in found if last))
        parent = min(c for c, _ in members[node[:-1]]) if node else None
        made.append(
            (min(c for c, _ in found), len(node), parent, len(found), len(children), len(leaves), saved,
             hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(made, key=repr)


def some_rows(rng):
    rows = []
    openings = ["hello there you", "", None, "what is it"]
    for conv in rng.permutation(90).tolist():
        if conv == 40:
            continue  # a start that is absent
        for turn in range(int(rng.integers(1, 6))):
            text = openings[int(rng.integers(0, 4))] if rng.random() < 0.8 else f"own {conv} {turn}"
            rows.append((conv, turn, "user" if turn % 2 == 0 else "assistant", text))
    copies = [(t, "user" if t % 2 == 0 else None, f"shared turn {t}") for t in range(30)]
    rows += [(conv, *turn) for conv in (200, 201, 305, 306, 307) for turn in copies]
    rows += [(400, t % 7 if t % 5 else None, "r", f"hot {t % 11}") for t in range(300)]  # ties, null turns
    rows += rows[:4] + [(None, 1, "user", "nobody"), (-20, 0, "user", "minus"), (-7, 0, "user", "minus")]
    return rows


@pytest.mark.parametrize("shard_nodes,span", [(1 << 20, 4096), (9, 4), (40, 7), (1, 4096)])
def test_trie_against_plain(spark, monkeypatch, shard_nodes, span):
    monkeypatch.setattr(prefix_trie, "SPAN", span)
    monkeypatch.setattr(prefix_trie, "SORT_ROWS", 50)
    rows = some_rows(np.random.default_rng(4))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.selectExpr("*", "1 AS depth", "'k' AS key", "0 AS i").repartition(5)
    got = sorted(map(tuple, prefix_trie.trie(df, shard_nodes).select(*COLUMNS).collect()), key=repr)
    assert got == plain(rows)


@pytest.mark.parametrize(
    "rows", [[], [(7, None, None, None)], [(5, 0, "user", "x")], [(21, 0, "u", "a"), (22, 0, "u", "a")]]
)
def test_small_tables(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(map(tuple, prefix_trie.trie(df).select(*COLUMNS).collect()), key=repr)
    assert got == plain(rows)
