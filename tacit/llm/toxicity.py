"""Toxicity by a learned lexicon, with misspellings and the context of every hit.

Terms and word stems that stand out in toxic rows form a trie.  A Levenshtein automaton runs over
the trie and reads a word once, whatever the number of terms, so misspelled terms are found too.
The window around a hit tells quotation from abuse, and a logistic model weighs the counts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from tacit.llm.langid import held_out
from tacit.llm.text import Cache, slices
from tacit.scratch import materialize, release, scope

# Bound of what is learned from, and so of the lexicon: rows per class.
ROWS_PER_CLASS = 6_000
# A term stands out if it is this many times as frequent among toxic rows, in so many of them.
LIFT = 20.0
SUPPORT = 5
# Stems are shared beginnings of several such words.
STEM_CHARS = (4, 8)
STEM_WORDS = 4
# Words looked at on either side of a hit.
CONTEXT = 6
# Steps of the automaton that are remembered.
STEPS = 2_000_000
# Fixed value: marks that open or close a quotation.
QUOTES = "\"“”„«»‘’‹›"
# A word reports a quotation if it stands this closely before hits, and among rows with hits this
# many times as often in clean ones as in toxic ones.
REPORT_WORDS = 3
REPORT_LIFT = 4.0
FEATURES = ("exact", "exact_quoted", "misspelt", "misspelt_quoted", "share")
# What the weights are drawn to where the rows say nothing: quoted terms count for little.
PRIOR = np.array([-3.0, 4.0, 0.5, 2.0, 0.2, 0.0])
NONE, EXACT, MISSPELT = 0, 1, 2
_PARTS = re.compile(r"[^\W_]+")
BYTES = 8 << 20


def allowed(term: str) -> int:
    """Edits allowed: none in short terms, where any edit gives other words."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """All words within the allowed edits of a term, or beginning with a stem.

    States are sets of (trie node, edits), determined when first reached and forgotten together
    when they become many.  A word is left at the first letter that no term can follow, so very
    long words cost no more than the longest term.
    """

    def __init__(self, terms: list[str], stems: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[int] = [-1]  # edits allowed where a term ends
        self.stem: list[bool] = [False]
        self.room: list[int] = [0]  # most edits allowed below
        for word, stem in [*((t, False) for t in terms), *((s, True) for s in stems)]:
            edits, at = 0 if stem else allowed(word), 0
            for letter in word:
                self.room[at] = max(self.room[at], edits)
                if letter not in self.children[at]:
                    self.children[at][letter] = len(self.children)
                    self.children.append({})
                    self.term.append(-1)
                    self.stem.append(False)
                    self.room.append(0)
                at = self.children[at][letter]
            self.room[at] = max(self.room[at], edits)
            if stem:
                self.stem[at] = True
            else:
                self.term[at] = max(self.term[at], edits)
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.verdicts: list[int] = []
        self.steps: dict[tuple[int, str], int] = {}
        self.dead = self._number(frozenset())
        self.start = self._number(self._closed({0: 0}))

    def _closed(self, best: dict[int, int]) -> frozenset:
        """Add what is reached by leaving out letters of a term; keep the fewest edits per node."""
        todo = list(best)
        while todo:
            node = todo.pop()
            edits = best[node] + 1
            for child in self.children[node].values():
                if edits <= self.room[child] and edits < best.get(child, 99):
                    best[child] = edits
                    todo.append(child)
        return frozenset(best.items())

    def _number(self, state: frozenset) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            found = [edits for node, edits in state if edits <= self.term[node]]
            self.verdicts.append(NONE if not found else MISSPELT if min(found) else EXACT)
        return self.numbers[state]

    def _step(self, number: int, letter: str) -> int:
        best: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if edits <= self.room[node] and edits < best.get(node, 99):
                best[node] = edits

        for node, edits in self.states[number]:
            reach(node, edits + 1)
            for other, child in self.children[node].items():
                if other == letter:
                    if self.stem[child] and edits == 0:
                        return -1
                    best[child] = min(edits, best.get(child, 99))
                else:
                    reach(child, edits + 1)
        return self._number(self._closed(best))

    def judge(self, word: str) -> int:
        """EXACT (also for a stem), MISSPELT or NONE."""
        if len(self.steps) > STEPS:
            self._forget()
        at, steps = self.start, self.steps
        for letter in word:
            key = (at, letter)
            if key not in steps:
                steps[key] = self._step(at, letter)
            at = steps[key]
            if at <= 0:
                return EXACT if at < 0 else NONE
        return self.verdicts[at]


@dataclass
class Model:
    terms: list[str]
    stems: list[str]
    weights: np.ndarray
    reports: frozenset[str] = frozenset()


class Scorer:
    """Counts of hits per text, and scores."""

    def __init__(self, model: Model):
        self.weights = model.weights
        self.reports = model.reports
        automaton = Automaton(model.terms, model.stems)

        def judge(word: str) -> int:
            found = [automaton.judge(part) for part in _PARTS.findall(word.lower())]
            return min((f for f in found if f), default=NONE)

        self.known = Cache(judge, 200_000)

    def hits(self, starts: np.ndarray, words: pa.Array):
        """(text, verdict, words around, place among them) per hit; text k begins at word starts[k]."""
        coded = words.dictionary_encode()
        verdicts = np.fromiter(
            map(self.known.__getitem__, coded.dictionary.to_pylist()), np.int8, len(coded.dictionary)
        )
        found = verdicts[coded.indices.to_numpy()] if len(words) else np.empty(0, np.int8)
        hits = np.flatnonzero(found)
        owners = np.searchsorted(starts, hits, "right") - 1
        for hit, owner in zip(hits.tolist(), owners.tolist()):
            low = max(int(starts[owner]), hit - CONTEXT)
            high = min(int(starts[owner + 1]), hit + CONTEXT + 1)
            yield owner, found[hit], words.slice(low, high - low).to_pylist(), hit - low

    def features(self, texts: pa.Array) -> np.ndarray:
        starts, words = _words(texts)
        made = np.zeros((len(texts), len(FEATURES)))
        for owner, verdict, around, at in self.hits(starts, words):
            column = (0 if verdict == EXACT else 2) + quoted(around, at, self.reports)
            made[owner, column] += 1
        sizes = np.maximum(np.diff(starts), 1)
        share = made[:, :4].sum(axis=1) / sizes
        made[:, :4] = np.log1p(made[:, :4])
        made[:, 4] = np.minimum(share, 0.2) * 10
        return made

    def scores(self, features: np.ndarray) -> np.ndarray:
        return logistic(self.weights[0] + features @ self.weights[1:])


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where each text's words begin, and the words of all texts."""
    lists = pc.utf8_split_whitespace(texts.fill_null(""))
    return lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def reporting(around: list[str], at: int) -> list[str]:
    """The words closely before a hit, without the marks around them."""
    return [w.strip(".,;:!?" + QUOTES).lower() for w in around[max(0, at - REPORT_WORDS) : at]]


def quoted(around: list[str], at: int, reports: frozenset[str] = frozenset()) -> bool:
    """Whether the window shows the word as quoted: marks on both sides, or a report before it."""
    before, word, after = around[:at], around[at], around[at + 1 :]
    opened = any(w[:1] in QUOTES for w in before if w) or word[:1] in QUOTES
    closed = any(w.rstrip(".,;:!?")[-1:] in QUOTES for w in after if w.rstrip(".,;:!?"))
    closed = closed or word.rstrip(".,;:!?")[-1:] in QUOTES
    shut = any(w.rstrip(".,;:!?")[-1:] in QUOTES for w in before if w.rstrip(".,;:!?"))
    if opened and closed and not shut:
        return True
    return not reports.isdisjoint(reporting(around, at))


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> Model:
    """Learn lexicon and weights from labelled rows that are not held out.

    About ``rows_per_class`` rows of either label are used, chosen by a hash of the id and, where
    ids have several texts, of the text too; equal rows count once.  A document with several
    labels counts as toxic if one says so.  Without labels of both classes
    the lexicon is empty and the weights are the prior.
    """
    with scope() as made:
        model = _fit(docs, labels, rows_per_class)
    release(made)
    return model


def _fit(docs: DataFrame, labels: DataFrame, rows_per_class: int) -> Model:
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id")
    known = known.agg((F.max("toxic") > 0).alias("toxic"))
    counts = {row["toxic"]: row["count"] for row in known.groupBy("toxic").count().collect()}
    if not counts.get(True) or not counts.get(False):
        return Model([], [], PRIOR.copy())
    place = F.xxhash64("doc_id", F.lit("toxicity sample")) / 2.0**64 + 0.5
    share = F.when(F.col("toxic"), rows_per_class / counts[True]).otherwise(
        rows_per_class / counts[False]
    )
    # Bounded by rows_per_class, so it may be broadcast.
    chosen = F.broadcast(known.where(place < share))
    rows = materialize(
        docs.where(F.col("text").isNotNull())
        .select("doc_id", "text")
        .join(chosen, "doc_id")
        .dropDuplicates(["doc_id", "text"])
        .select("toxic", "text", (F.xxhash64("doc_id", "text") / 2.0**64 + 0.5).alias("place")),
        "toxicity-sample",
    )
    sizes = {row["toxic"]: row["count"] for row in rows.groupBy("toxic").count().collect()}
    if max(sizes.values(), default=0) > 2 * rows_per_class:
        # Some ids have very many texts: draw again, by row.
        share = {toxic: rows_per_class / size for toxic, size in sizes.items()}
        bound = F.when(F.col("toxic"), share.get(True, 1.0)).otherwise(share.get(False, 1.0))
        rows = rows.where(F.col("place") < bound)
        sizes = {row["toxic"]: row["count"] for row in rows.groupBy("toxic").count().collect()}
    if not sizes.get(True) or not sizes.get(False):
        return Model([], [], PRIOR.copy())
    terms, stems = _lexicon(rows, sizes[True], sizes[False])
    model = Model(terms, stems, PRIOR.copy())
    model.reports = _reports(rows, model)
    model.weights = _weigh(rows, model)
    return model


def _lexicon(rows: DataFrame, n_toxic: int, n_clean: int) -> tuple[list[str], list[str]]:
    """All terms and stems that stand out among toxic rows, by counts of rows.

    Every entry is in ``SUPPORT`` rows of the bounded sample, which bounds their number.
    """
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    words = rows.select("toxic", F.explode(found).alias("term")).where(
        F.length("term").between(3, 40)
    )
    toxic, clean = F.count_if("toxic"), F.count_if(~F.col("toxic"))
    lift = (F.col("pos") / n_toxic) / ((F.col("neg") + 1) / n_clean)
    counted = words.groupBy("term").agg(toxic.alias("pos"), clean.alias("neg"))
    counted = materialize(counted.where("pos > 0"), "toxicity-words")
    low, high = STEM_CHARS
    prefix = F.explode(
        F.transform(
            F.sequence(F.lit(low), F.lit(high)), lambda n: F.substring(F.col("term"), F.lit(1), n)
        )
    )
    stems = (
        counted.where(F.length("term") > low)
        .select("term", "pos", "neg", prefix.alias("stem"))
        .where(F.length("stem") < F.length("term"))
        .groupBy("stem")
        .agg(F.sum("pos").alias("pos"), F.count(F.lit(1)).alias("words"))
        .where((F.col("pos") >= 4 * SUPPORT) & (F.col("words") >= STEM_WORDS))
    )
    # Rows without the stem's toxic words can hold other words with it: count those in full.
    begun = F.array_distinct(
        F.flatten(
            F.transform(
                found,
                lambda w: F.transform(
                    F.sequence(F.lit(low), F.lit(high)), lambda n: F.substring(w, F.lit(1), n)
                ),
            )
        )
    )
    per_row = rows.select("toxic", F.explode(begun).alias("stem")).groupBy("stem").agg(
        toxic.alias("pos"), clean.alias("neg")
    )
    chosen_stems = (
        per_row.join(stems.select("stem"), "stem")
        .where((lift >= LIFT) & (F.col("pos") >= SUPPORT) & (F.length("stem") >= low))
        .select("stem")
        .collect()
    )
    known: set[str] = set()
    for stem in sorted((row.stem for row in chosen_stems), key=lambda s: (len(s), s)):
        if not any(stem[:n] in known for n in range(low, len(stem))):
            known.add(stem)
    kept = sorted(known)
    terms = (
        counted.where((lift >= LIFT) & (F.col("pos") >= SUPPORT)).select("term").collect()
    )
    whole = sorted(row.term for row in terms)
    return [t for t in whole if not any(t[:n] in known for n in range(low, high + 1))], kept


def _reports(rows: DataFrame, model: Model) -> frozenset[str]:
    """Words that stand before hits in clean rows rather than in toxic ones, by counts of rows.

    Every entry is in ``SUPPORT`` clean rows of the bounded sample, which bounds their number.
    Where few clean rows have hits there are none, and only marks show a quotation.
    """

    def work(batches):
        scorer = Scorer(model)
        for batch in slices(batches, 1, BYTES):
            starts, words = _words(batch.column(1))
            # The empty word stands for the row itself.
            found = {
                (owner, word)
                for owner, _, around, at in scorer.hits(starts, words)
                for word in ("", *reporting(around, at))
            }
            owners = pa.array([owner for owner, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(owners), pa.array([word for _, word in found], pa.string())],
                names=["toxic", "word"],
            )

    made = rows.select("toxic", "text").mapInArrow(work, "toxic boolean, word string")
    toxic, clean = F.count_if("toxic"), F.count_if(~F.col("toxic"))
    counted = materialize(
        made.groupBy("word").agg(toxic.alias("pos"), clean.alias("neg")), "toxicity-reports"
    )
    whole = counted.where("word = ''").first()
    if whole is None or not whole.pos or not whole.neg:
        return frozenset()
    lift = (F.col("neg") / whole.neg) / ((F.col("pos") + 1) / whole.pos)
    chosen = counted.where((F.col("word") != "") & (F.col("neg") >= SUPPORT) & (lift >= REPORT_LIFT))
    return frozenset(row.word for row in chosen.select("word").collect())


def _weigh(rows: DataFrame, model: Model) -> np.ndarray:
    """Logistic regression on the sample, drawn to the prior."""

    def work(batches):
        scorer = Scorer(model)
        for batch in slices(batches, 1, BYTES):
            made = scorer.features(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c) for c in made.T]], names=["toxic", *FEATURES]
            )

    schema = "toxic boolean, " + ", ".join(f"{name} double" for name in FEATURES)
    table = rows.select("toxic", "text").mapInArrow(work, schema).toArrow()
    y = table.column("toxic").to_numpy().astype(float)
    x = np.column_stack([np.ones(len(y)), *[table.column(name).to_numpy() for name in FEATURES]])
    w, pull = PRIOR.copy(), np.array([0.01, 1, 1, 1, 1, 1.0])
    for _ in range(25):  # Newton steps
        p = logistic(x @ w)
        slope = x.T @ (p - y) + pull * (w - PRIOR)
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        change = np.linalg.solve(curve, slope)
        w = w - change
        if np.abs(change).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, predicted)`` per row, from the whole text alone.

    Null and empty texts get the score of a text without hits.  ``predicted`` is 1 from 0.5 on.
    Repeated rows and null ids stay; other columns are ignored.
    """
    rows = docs.select("doc_id", "text")
    schema = T.StructType(
        [
            rows.schema["doc_id"],
            T.StructField("score", T.DoubleType()),
            T.StructField("predicted", T.IntegerType()),
        ]
    )
    names = schema.names

    def work(batches):
        scorer = Scorer(model)
        for batch in slices(batches, 1, BYTES):
            made = scorer.scores(scorer.features(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(made), pa.array((made >= 0.5).astype(np.int32))],
                names=names,
            )

    return rows.mapInArrow(work, schema)
