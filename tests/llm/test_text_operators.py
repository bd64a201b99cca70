"""Quality rules, near duplicates, language ID and toxicity."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tacit.llm import langid, near_dup, quality, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_features(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {
        i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)
    }
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        sum(x in lines[:i] for i, x in enumerate(lines)),
        len(covered),
    )


@given(st.text(alphabet="ab \n\t#*é \x0b", max_size=120))
@settings(max_examples=300, deadline=None)
def test_features_equal_brute_force(text):
    made = quality.Text(text)
    got = (made.n_words, made.word_chars, made.n_symbols, made.n_dup_lines, made.n_repeat_words)
    assert got == brute_features(text)


def test_order_never_changes_the_verdict():
    texts = ["a b " * 30, "", "word%% and## " * 20, " ".join(f"word{i}" for i in range(40)), None]
    want = [not any(r.rejects(quality.Text(t)) for r in quality.RULES) for t in texts]
    for cascade in itertools.permutations(quality.RULES, 3):
        rest = tuple(r for r in quality.RULES if r not in cascade)
        assert [quality.keeps(quality.Text(t), cascade + rest) for t in texts] == want


def test_cascade_runs_by_rejections_per_cost():
    measured = [quality.Measured(r.name, 1.0, 0.0) for r in quality.RULES]
    measured[2] = quality.Measured(quality.RULES[2].name, 10.0, 0.9)
    measured[4] = quality.Measured(quality.RULES[4].name, 0.5, 0.2)
    assert [r.name for r in quality.ordered(measured)][:2] == [
        quality.RULES[4].name,
        quality.RULES[2].name,
    ]


def test_a_rejection_stops_the_cascade():
    asked = []
    rules = tuple(quality.Rule(n, lambda t, n=n: asked.append(n) or n == "b") for n in "abc")
    assert not quality.keeps(quality.Text("x"), rules) and asked == ["a", "b"]


def test_quality_of_odd_rows(documents):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(1, None, None), (2, "", None), (3, good, "en"), (3, good, "en"), (None, good, None)]
    rows.append((4, good * 4000, "en"))
    docs = documents(rows)
    report = {(r.doc_id, r.n_words): r.kept for r in quality.report(docs).collect()}
    assert report[(1, 0)] is False and report[(2, 0)] is False and report[(3, 40)] is True
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.select("doc_id").collect())[:3] == [0, 3, 3]
    assert quality.report(docs.where("false")).count() == 0
    assert quality.keep(docs.where("false")).count() == 0


def brute_components(rows, words, percent):
    sets = {}
    for i, text in rows:
        found = [w.encode().lower() for w in WORD.findall(text or "")]
        n = min(words, len(found)) or 1
        sets[i] = {tuple(found[k : k + n]) for k in range(len(found) - n + 1)} if found else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * common >= percent * len(sets[a] | sets[b]):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return {i: (len(sets[i]), root(i)) for i in sets}


def copies(seed=3, groups=6, size=25):
    """Groups of near copies with more or fewer changed words, and texts by themselves."""
    rng = random.Random(seed)
    rows, words = [], [f"w{i}" for i in range(4000)]
    for g in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice((30, 120, 400)))]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 20))):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append(" ".join(text))
    rows += [" ".join(rng.choice(words) for _ in range(50)) for _ in range(40)]
    rows += ["one", "ONE", "one two", None, "", " \n ", "A b C d", "a B c D"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("words, percent, tile", [(3, 85, 512), (3, 85, 4), (5, 80, 8)])
def test_near_duplicates_equal_brute_force(documents, words, percent, tile):
    rows = copies()
    docs = documents([(i, t, "en") for i, t in rows])
    want = brute_components(rows, words, percent)
    found = near_dup.link(docs, words, percent, tile=tile).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_duplicates_of_odd_rows(documents):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(2, text, "en"), (2, text, "en"), (5, text + " more", "en"), (None, text, "en")]
    rows += [(7, None, "en"), (8, "", "en"), (9, "x " * 30_000, "en")]
    docs = documents(rows)
    found = near_dup.link(docs).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in found} == {
        (2, 2, True), (5, 2, False), (None, None, True), (7, 7, True), (8, 8, True), (9, 9, True),
    }
    kept = near_dup.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 7, 8, 9]
    assert near_dup.link(docs.where("false")).count() == 0


def test_near_duplicates_of_ids_with_several_texts(documents):
    """An id joins its texts where documents are linked, and loses none that has no copy."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(2, a, "en"), (5, a, "en"), (5, b, "en"), (9, b, "en"), (7, c, "en"), (7, c, "en"), (7, None, "en")]
    rows += [(7, "", "en"), (8, c + " more", "en"), (None, a, "en")]
    docs = documents(rows)
    found = {(r.doc_id, r.component_id, r.kept) for r in near_dup.link(docs).collect()}
    assert found == {
        (2, 2, True), (5, 2, False), (9, 2, False), (7, 7, True), (8, 7, False), (None, None, True),
    }
    kept = near_dup.keep(docs)
    # Of id 7 one of the texts without words stays.
    got = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    assert got == [(0, a), (2, a), (5, b), (7, ""), (7, c)]
    assert kept.columns == docs.columns


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 700), (700, 600)]
    found = near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {i: 0 for i in range(1, 201)} | {600: 500, 700: 500}
    assert {r.node: r.root for r in found} == want


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    sets = []
    for share in (0.5, 0.8, 0.9):
        both = rng.integers(0, 2**63, 4000).astype(np.uint64)
        n = int(round(400 * share / (1 + share) * 2))
        for _ in range(30):
            pool = rng.integers(0, 2**63, 2000).astype(np.uint64)
            a = np.concatenate([pool[:n], pool[n : 400]])
            b = np.concatenate([pool[:n], pool[400 : 800 - n]])
            sets.append((np.unique(a), np.unique(b)))
    errors = []
    for a, b in sets:
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = near_dup.signatures([a, b])
        errors.append(((x == y).mean() - true) / (true * (1 - true) / near_dup.SLOTS) ** 0.5)
    assert abs(np.mean(errors)) < 0.35 and np.std(errors) < 1.05


def test_signature_of_one_set_does_not_depend_on_its_batch():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 3, 60, 500, 5000)]
    alone = np.vstack([near_dup.signatures([s]) for s in sets])
    assert (near_dup.signatures(sets) == alone).all()


def speech(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def plain_window(model, text, at):
    """Softmax over max-pooled filters, each slid over the window's bytes one by one."""
    read = text[at:] + bytes(langid.WINDOW + 8)
    pooled = []
    for w, f in zip(langid.WIDTHS, model.filters):
        values = [
            sum(model.embedding[read[i + j]] @ f[j * langid.EMBEDDING : (j + 1) * langid.EMBEDDING] for j in range(w))
            for i in range(langid.WINDOW)
        ]
        pooled.append(np.max(values, axis=0))
    hidden = np.maximum(np.concatenate(pooled) + model.bias, 0)
    scores = np.exp(hidden @ model.dense + model.offset)
    return scores / scores.sum()


def test_language_id_on_held_out_rows(documents):
    rng = random.Random(2)
    kinds = {"aa": "abcdé", "bb": "bcdef", "cc": "стуфх"}
    rows = [
        (i, speech(rng, kinds[lang], rng.randint(5, 200)), lang)
        for i, lang in enumerate(rng.choices(list(kinds), k=400))
    ]
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 .. 34", "cc"), (None, "abab adab", None)]
    docs = documents(rows + odd + [(1003, speech(rng, kinds["cc"], 20_000), None)])
    model = langid.fit(docs)
    found = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert len(found) == len(rows) + 5
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (1000, 1001, 1002))
    assert found[1003].lang_pred == "cc"
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum(found[i].lang_pred == rows[i][2] for i in held)
    assert len(held) > 40 and right / len(held) > 0.95
    kept = langid.keep(docs, model)
    assert kept.columns == docs.columns and kept.where("text IS NULL").count() == 0
    # A clean text in all known languages stays.
    mixed = " ".join(speech(rng, kinds[k], 150) for k in ("aa", "cc", "bb") * 3)
    assert langid.keep(documents([(1, mixed, None), (2, mixed[:700], "aa")]), model).count() == 2
    # Table lookups give what a plain convolution over each window gives.
    texts = [mixed.encode(), b"", "стуф".encode(), rng.randbytes(700)]
    odds, sure = langid.Predictor(model).predict(texts)
    for text, row, part in zip(texts, odds, sure):
        windows = [plain_window(model, text, at) for at in range(0, max(1, len(text)), langid.WINDOW)]
        assert np.allclose(row, np.mean(windows, axis=0), atol=1e-5)
        assert abs(part - np.mean([w.max() for w in windows])) < 1e-5
    assert langid.fit(docs.where("false")) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}


def test_language_id_ignores_labels_of_held_out_rows(documents):
    rng = random.Random(4)
    rows = []
    for i in range(200):
        held = zlib.crc32(str(i).encode()) % 5 == 0
        lang = rng.choice(("aa", "bb"))
        shown = "wrong" if held else lang
        rows.append((i, speech(rng, {"aa": "abc", "bb": "xyz"}[lang], 30), shown))
    assert langid.fit(documents(rows)).languages == ["aa", "bb"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@given(st.text(alphabet="abcd", max_size=12))
@settings(max_examples=500, deadline=None)
def test_automaton_equals_edit_distance(word):
    terms = ["abcd", "abcab", "ddaabbccd", "bbbbbbbb", "cadbacdbaa"]
    automaton = toxicity.Automaton(terms, [])
    close = [t for t in terms if distance(word, t) <= toxicity.allowed(t)]
    want = toxicity.NONE if not close else toxicity.EXACT if word in close else toxicity.MISSPELT
    assert automaton.judge(word) == want


def test_automaton_forgets_and_goes_on(monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 3)
    automaton = toxicity.Automaton(["plainword", "other"], ["badd"])
    for _ in range(3):
        assert automaton.judge("plainwrd") == toxicity.MISSPELT
        assert automaton.judge("other") == automaton.judge("baddest") == toxicity.EXACT
        assert automaton.judge("p" * 100_000) == toxicity.NONE
    assert len(automaton.states) < 100


def plain_features(words, model):
    """Counts of hits by a plain scan of terms, stems and the words around."""
    counts = [0] * 4
    for at, word in enumerate(words):
        hits = set()
        for part in re.findall(r"[^\W_]+", word.lower()):
            if part in model.terms or any(part.startswith(stem) for stem in model.stems):
                hits.add(toxicity.EXACT)
            elif any(distance(part, t) <= toxicity.allowed(t) for t in model.terms):
                hits.add(toxicity.MISSPELT)
        if hits:
            low = max(0, at - toxicity.CONTEXT)
            around = words[low : at + toxicity.CONTEXT + 1]
            shown = toxicity.quoted(around, at - low, model.reports)
            counts[(0 if min(hits) == toxicity.EXACT else 2) + shown] += 1
    share = min(0.2, sum(counts) / max(1, len(words)))
    return [math.log1p(c) for c in counts] + [10 * share]


def test_features_of_toxicity_equal_a_plain_scan(spark, documents):
    reports = frozenset(["said"])
    model = toxicity.Model(["moronic", "dolt", "plainwordy"], ["badd"], toxicity.PRIOR.copy(), reports)
    rng = random.Random(4)
    parts = ["moronic", "Moronc!", "dolt", "dolts", "baddish", "plainwrdy,", '"moronic"', "said", "fine"]
    rows = [(0, None, None), (1, "", None), (2, "moronic", None), (3, "x" * 50_000 + " dolt", None)]
    for i in range(4, 60):
        rows.append((i, " ".join(rng.choice(parts + ["calm", "day"] * 4) for _ in range(30)), None))
    found = {r.doc_id: r for r in toxicity.score(documents(rows), model).collect()}
    for i, text, _ in rows:
        features = plain_features((text or "").split(), model)
        total = model.weights[0] + sum(w * f for w, f in zip(model.weights[1:], features))
        assert found[i].score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-12)
        assert found[i].predicted == int(found[i].score >= 0.5)


def test_toxicity_sample_stays_bounded_where_one_id_has_many_texts(spark, documents):
    rows = [(1, f"vile{'abcdefghij'[i % 10]} number {i}", None) for i in range(900)]
    rows += [(i, "a calm day", None) for i in range(2, 300)] + [(1, "vilea number 0", None)] * 50
    labels = spark.createDataFrame(
        [(1, None, 1)] + [(i, None, 0) for i in range(2, 300)], "doc_id long, quality int, toxic int"
    )
    assert not documents([(1, "", None)]).where(langid.held_out(F.col("doc_id"))).count()
    model = toxicity.fit(documents(rows), labels, rows_per_class=100)
    assert "vile" in model.stems


def test_report_words_are_learned_from_clean_rows_with_hits(spark, documents):
    rng = random.Random(12)
    rows, marks = [], []
    for i in range(1500):
        words = speech(rng, "abcdefgh", 40).split()
        toxic, at = i % 5 == 0, rng.randrange(4, 30)
        if toxic:
            words[at : at + 1] = ["Du", rng.choice(("alter", "ewiger")), "zorgolin"]
        elif i % 50 == 1:
            words[at : at + 1] = ["berichtete:", "du", "zorgolin"]
        else:
            words[at : at + 1] = ["du", "alter", "ewiger", *["berichtete"] * (i % 50 == 2)]
        rows.append((i, " ".join(words), "de"))
        marks.append((i, None, int(toxic)))
    rows += [(2000, "er berichtete von zorgolin heute", "de"), (2001, "er ist ein zorgolin heute", "de")]
    rows += [(2002, "berichtete", "de"), (2003, None, "de")]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.fit(documents(rows), labels)
    # "du" stands before hits of both kinds; the others only before abuse, or too rarely.
    assert model.terms == ["zorgolin"] and model.reports == {"berichtete"}
    found = {r.doc_id: r.score for r in toxicity.score(documents(rows), model).collect()}
    assert found[2000] < found[2001] and found[2002] == found[2003]
    # Without clean rows that have hits nothing is known to report.
    plain = [r for r in rows if "berichtete" not in (r[1] or "")]
    assert toxicity.fit(documents(plain), labels).reports == frozenset()


def test_automaton_finds_stems():
    automaton = toxicity.Automaton(["plainword"], ["badd"])
    assert automaton.judge("baddest") == toxicity.EXACT
    assert automaton.judge("bad") == toxicity.NONE
    assert automaton.judge("plainwrd") == toxicity.MISSPELT


def test_quotation_counts_less_than_abuse(spark, documents):
    model = toxicity.Model(["moronic"], [], toxicity.PRIOR.copy())
    rows = [
        (1, "you are a moronic fool", None),
        (2, 'the word "moronic" is old', None),
        (3, "you are a moronik fool", None),
        (4, "a clean text", None),
        (5, None, None),
        (6, "", None),
        (7, "clean " * 50_000 + "moronic", None),
    ]
    found = {r.doc_id: r.score for r in toxicity.score(documents(rows), model).collect()}
    assert found[1] > found[3] > found[2] > found[4]
    assert found[4] == found[5] == found[6]
    assert found[7] > found[4]
    assert toxicity.score(documents(rows).where("false"), model).count() == 0


def test_toxicity_learns_terms_and_misspellings(spark, documents):
    rng = random.Random(9)
    rows, marks = [], []
    for i in range(600):
        words = speech(rng, "abcdefgh", rng.randint(10, 60)).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(("zorgolin", "quixxer")))
        rows.append((i, " ".join(words), "en"))
        marks.append((i, None, int(toxic)))
    rows += [(900, "aa bb zorgoln cc", "en"), (901, "aa bb cc dd", "en")]
    labels = spark.createDataFrame(
        marks + [(None, 1, 1), (5, 0, None)], "doc_id long, quality int, toxic int"
    )
    model = toxicity.fit(documents(rows), labels)
    assert {"zorgolin", "quixxer"} <= set(model.terms)
    found = {r.doc_id: r for r in toxicity.score(documents(rows), model).collect()}
    assert all(found[i].predicted == m for i, _, m in marks)
    assert found[900].score > found[901].score
    empty = toxicity.fit(documents(rows), labels.where("false"))
    assert empty.terms == [] and empty.stems == []
