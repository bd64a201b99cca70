import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tacit.llm import spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, least=7, ratio=10):
    counts = Counter()
    for doc_id, text in rows:
        lowered = (text or "").encode().lower().decode()
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered):
            code = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if code % 31 == 0:
                at = code % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= least:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 2}
    made = {}
    for word, n in words.items():
        others = [w for w in words if near(word, w)]
        best = min(others, key=lambda w: (-words[w], w), default=None)
        form = best if best is not None and words[best] >= ratio * n else None
        made[word] = (form, n, len(others), words[form] if form else None)
    out = []
    for word, (form, n, count, form_n) in made.items():
        root = word
        while made[root][0]:
            root = made[root][0]
        out.append((word, form, root, n, count, form_n))
    return sorted(out)


def varied(rng, alphabet, lengths, bases, copies):
    words = []
    for _ in range(bases):
        base = list(rng.choice(alphabet, int(rng.choice(lengths))))
        words.append("".join(base))
        for _ in range(copies):
            word = list(base)
            for _ in range(int(rng.integers(1, 3))):
                at = int(rng.integers(0, len(word)))
                word[at : at + int(rng.integers(0, 2))] = rng.choice(alphabet, int(rng.integers(0, 2))).tolist()
            words.append("".join(word))
    return sorted({w for w in words if len(w) >= 7})


@pytest.mark.parametrize("below", [0, 1, 3, 9, spelling.NEVER])
def test_index_against_plain(monkeypatch, below):
    monkeypatch.setattr(spelling, "SET_WORDS", 40)
    rng = np.random.default_rng(below % 97)
    words = varied(rng, list("abé"), [7, 8, 9], 12, 15)
    index = spelling.PositionIndex([w.encode("latin-1") for w in words])
    got = {}
    for queries, sets in index.near(7, 9, below):
        marks = np.unpackbits(sets.view(np.uint8), axis=1, bitorder="little")
        some = np.flatnonzero(marks.any(axis=1))
        assert spelling.first_bits(sets[some]).tolist() == marks[some].argmax(axis=1).tolist()
        for q, row in zip(queries.tolist(), marks):
            got[q] = np.flatnonzero(row).tolist()

    def common(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    want = {
        i: [j for j, b in enumerate(words) if near(a, b) and 7 <= min(len(a), len(b)) < 9 and common(a, b) < below]
        for i, a in enumerate(words)
    }
    assert {q: f for q, f in got.items() if f} == {q: f for q, f in want.items() if f}
    assert below == 0 or any(want.values())


@pytest.mark.parametrize("group_rows,long", [(spelling.GROUP_ROWS, spelling.LONG), (6, spelling.LONG), (6, 9), (4, 7)])
def test_group_against_all_pairs(spark, documents, monkeypatch, group_rows, long):
    monkeypatch.setattr(spelling, "LONG", long)
    rng = np.random.default_rng(3)
    words = varied(rng, list("abñ"), [7, 8, 9, 12, 23, 24, 25, 40], 20, 14)
    words += ["Àbcdefgh", "àbcdefgh", "abcd×efgh", "q" * 3000, "q" * 3001]
    places = [w for w in words for _ in range(int(rng.choice([1, 2, 3, 30, 400])))]
    rng.shuffle(places)
    texts = [" ".join(p) for p in np.array_split(np.array(places, object), 40)]
    rows = [(int(i), t, "en") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[4].upper(), None), (900, None, "en"), (901, "", "en"), (902, "a b1 2", "")]
    got = spelling.group(documents(rows), group_rows=group_rows)
    got = sorted(map(tuple, got.select("word", "form", "root", "n", "n_near", "form_n").collect()))
    want = plain([(d, t) for d, t, _ in rows])
    assert got == want
    assert any(r[1] and r[2] != r[1] for r in want)  # a chain of forms


def test_empty_table(spark, documents):
    assert spelling.group(documents([])).collect() == []
