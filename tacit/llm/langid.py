"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over fixed-length windows, every filter keeps
its maximum, and a softmax over the languages follows.  Training is plain numpy on a bounded
sample of labelled text.  Applied, the first layer becomes table lookups by byte pairs, and the
probabilities of all windows of a text are averaged, so whole texts count.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tacit.llm.text import once, slices

WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 12
WINDOW = 256
# Bounds of the training sample: texts per language, windows per text, languages.
TEXTS_PER_LANGUAGE = 300
WINDOWS_PER_TEXT = 4
LANGUAGES = 256
EPOCHS = 6
BATCH = 64
UNKNOWN = "und"
# Windows that are looked up together.
STEP = 128


@dataclass
class Model:
    """Parameters, and the languages in the order of the outputs."""

    languages: list[str]
    embedding: np.ndarray  # 256 x EMBEDDING
    filters: list[np.ndarray]  # per width: (width * EMBEDDING) x FILTERS
    bias: np.ndarray  # all filters
    dense: np.ndarray  # all filters x languages
    offset: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First layer as lookups: by the pair at a place, by its third byte, by its second pair.

        Widths two and three start from the pair; width four adds the next pair.
        """
        per = [
            [self.embedding @ f[i * EMBEDDING : (i + 1) * EMBEDDING] for i in range(len(f) // EMBEDDING)]
            for f in self.filters
        ]
        pair = [(t[0][:, None] + t[1][None, :]).reshape(65536, -1) for t in per]
        last = (per[2][2][:, None] + per[2][3][None, :]).reshape(65536, -1)
        return np.hstack(pair).astype(np.float32), per[1][2].astype(np.float32), last.astype(np.float32)


def train(texts: list[bytes], labels: list[str], seed: int = 7) -> Model:
    """Fit the network by Adam on windows of labelled texts; every language weighs the same."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    index = {name: k for k, name in enumerate(languages)}
    rows, marks = [], []
    for text, label in zip(texts, labels):
        data = np.frombuffer(text, np.uint8)
        for _ in range(min(WINDOWS_PER_TEXT, 1 + len(data) // WINDOW)):
            low = int(rng.integers(0, max(1, len(data) - WINDOW + 1)))
            # Short windows too, as texts end anywhere.
            size = WINDOW if rng.random() < 0.7 else int(rng.integers(16, WINDOW))
            row = np.zeros(WINDOW + max(WIDTHS) - 1, np.uint8)
            part = data[low : low + size]
            row[: len(part)] = part
            rows.append(row)
            marks.append(index[label])
    x, y = np.stack(rows), np.array(marks)
    total, classes = FILTERS * len(WIDTHS), len(languages)
    weight = 1.0 / np.bincount(y, minlength=classes)[y]
    weight *= len(y) / weight.sum()
    p = {
        "e": rng.normal(0, 0.3, (256, EMBEDDING)),
        **{f"f{w}": rng.normal(0, 0.3, (w * EMBEDDING, FILTERS)) for w in WIDTHS},
        "b": np.zeros(total),
        "d": rng.normal(0, 0.1, (total, classes)),
        "o": np.zeros(classes),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for low in range(0, len(order), BATCH):
            some = order[low : low + BATCH]
            grads = _gradients(p, x[some], y[some], weight[some])
            step += 1
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                rate = 0.01 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                p[k] = (p[k] - rate * m[k] / (np.sqrt(s[k]) + 1e-8)).astype(np.float32)
    return Model(languages, p["e"], [p[f"f{w}"] for w in WIDTHS], p["b"], p["d"], p["o"])


def _gradients(p: dict, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    """Backward pass; only the places of the maxima carry gradients into the first layer."""
    n = len(y)
    seen = p["e"][x]
    pooled, places = [], []
    for w in WIDTHS:
        stacked = np.concatenate([seen[:, i : i + WINDOW] for i in range(w)], axis=2)
        out = stacked @ p[f"f{w}"]
        at = out.argmax(axis=1)
        places.append(at)
        pooled.append(np.take_along_axis(out, at[:, None, :], 1)[:, 0])
    raw = np.hstack(pooled) + p["b"]
    hidden = np.maximum(raw, 0)
    scores = hidden @ p["d"] + p["o"]
    scores = np.exp(scores - scores.max(axis=1, keepdims=True))
    wrong = scores / scores.sum(axis=1, keepdims=True)
    wrong[np.arange(n), y] -= 1
    wrong *= (weight / n)[:, None]
    grads = {"d": hidden.T @ wrong, "o": wrong.sum(axis=0), "e": np.zeros_like(p["e"])}
    back = (wrong @ p["d"].T) * (raw > 0)
    grads["b"] = back.sum(axis=0)
    for k, w in enumerate(WIDTHS):
        part = back[:, k * FILTERS : (k + 1) * FILTERS]
        grad = np.zeros_like(p[f"f{w}"])
        for i in range(w):
            rows = slice(i * EMBEDDING, (i + 1) * EMBEDDING)
            bytes_ = np.take_along_axis(x, places[k] + i, 1)  # n x FILTERS
            grad[rows] = np.einsum("nfe,nf->ef", p["e"][bytes_], part)
            np.add.at(grads["e"], bytes_, part[:, :, None] * p[f"f{w}"][rows].T[None])
        grads[f"f{w}"] = grad
    return grads


class Predictor:
    """Applies a model to whole texts."""

    def __init__(self, model: Model):
        self.model = model
        self.pair, self.third, self.last = model.tables()

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Mean probabilities of the windows of each text (an empty text is one empty window).

        Also the mean of each window's highest one: how sure the windows are, alike or not.
        """
        counts = np.array([max(1, -(-len(t) // WINDOW)) for t in texts], np.int64)
        # A window reads on into the next one of its text; zeros follow each text.
        more = max(WIDTHS) - 1
        padded = [t + bytes(c * WINDOW + more - len(t)) for t, c in zip(texts, counts.tolist())]
        data = np.frombuffer(b"".join(padded), np.uint8)
        places = np.arange(WINDOW + more)
        total, sure = np.zeros((len(texts), len(self.model.languages))), np.zeros(len(texts))
        owner = np.repeat(np.arange(len(texts)), counts)
        for low in range(0, len(owner), STEP):
            some = owner[low : low + STEP]
            starts = np.arange(low, low + len(some)) * WINDOW + more * some
            odds = self._windows(data[starts[:, None] + places])
            np.add.at(total, some, odds)
            np.add.at(sure, some, odds.max(axis=1))
        return total / counts[:, None], sure / counts

    def _windows(self, rows: np.ndarray) -> np.ndarray:
        """Probabilities of windows, a row of bytes each with those that follow it."""
        n = len(rows)
        pairs = (rows[:, :-1].astype(np.int32) << 8) | rows[:, 1:]
        out = self.pair.take(pairs[:, :WINDOW].ravel(), axis=0)
        out[:, FILTERS : 2 * FILTERS] += self.third.take(rows[:, 2 : WINDOW + 2].ravel(), axis=0)
        out[:, 2 * FILTERS :] += self.last.take(pairs[:, 2 : WINDOW + 2].ravel(), axis=0)
        hidden = np.maximum(out.reshape(n, WINDOW, -1).max(axis=1) + self.model.bias, 0)
        scores = hidden @ self.model.dense + self.model.offset
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        return scores / scores.sum(axis=1, keepdims=True)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0: such rows are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(
    docs: DataFrame, texts_per_language: int = TEXTS_PER_LANGUAGE, languages: int = LANGUAGES
) -> Model | None:
    """Fit on rows with a language that are not held out; None where there is no such text.

    The sample is bounded: at most ``texts_per_language`` texts of each of the ``languages`` most
    frequent languages, chosen by a hash of id and text, and of a long text a stretch at a place
    that the hash chooses.  Rows of one id, or without one, are chosen apart; equal rows count once.
    """
    known = docs.where(
        F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}")
    )
    order = (F.xxhash64(F.col("doc_id"), F.col("text"), F.lit("language sample")) / 2.0**64) + 0.5
    counts = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("lang")
    shares = {
        row["lang"]: texts_per_language / row["count"]
        for row in counts.count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    }
    if not shares:
        return None
    share = F.element_at(
        F.map_from_arrays(
            F.array(*map(F.lit, shares)), F.array(*[F.lit(float(v)) for v in shares.values()])
        ),
        F.col("lang"),
    )
    stretch = WINDOW * WINDOWS_PER_TEXT
    room = F.greatest(F.length("text") - stretch, F.lit(0))
    low = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("place")), (room + 1).cast("long")).cast("int")
    few = (
        known.where(order < F.coalesce(share, F.lit(0.0)))
        .select("lang", order.alias("order"), F.col("text").substr(low + 1, F.lit(stretch)).alias("text"))
        .distinct()
    )
    # Draws give the number in the mean; the ranks, over this small table, make it a bound.
    first = Window.partitionBy("lang").orderBy("order", "text")
    sample = (
        few.withColumn("rank", F.row_number().over(first))
        .where(F.col("rank") <= texts_per_language)
        .select("lang", "text")
        .collect()
    )
    sample = sorted((row.lang, row.text) for row in sample)
    if not sample:
        return None
    return train([text.encode() for _, text in sample], [lang for lang, _ in sample])


def _rows(model: Model | None):
    """Batches of texts -> lists of languages, their probabilities, and how sure windows are."""
    once(("network",), lambda: True)  # a worker keeps no caches of other work meanwhile
    predictor = Predictor(model) if model else None

    def predict(texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        found = [(UNKNOWN, 0.0, 0.0)] * len(texts)
        if predictor is None or not texts:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        read = [k for k, text in enumerate(texts) if text and _has_letter(text)]
        if read:
            odds, sure = predictor.predict([texts[k].encode() for k in read])
            best = odds.argmax(axis=1)
            for k, at, row, part in zip(read, best.tolist(), odds, sure.tolist()):
                found[k] = (model.languages[at], min(1.0, float(row[at])), min(1.0, part))
        return tuple(map(list, zip(*found)))

    return predict


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, lang_pred, score)`` per row, from the text alone.

    ``und`` with score 0 for null texts, texts without a letter, and without a model.  Repeated
    rows and null ids stay; other columns are ignored.
    """
    rows = docs.select("doc_id", "text")
    schema = T.StructType(
        [
            rows.schema["doc_id"],
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    names = schema.names

    def work(batches):
        apply = _rows(model)
        for batch in slices(batches, 1):
            languages, scores, _ = apply(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(languages, pa.string()), pa.array(scores, pa.float64())],
                names=names,
            )

    return rows.mapInArrow(work, schema)


def keep(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """The rows whose windows are recognised with a mean probability of ``least``, with all columns.

    Each window counts for the language that it is likeliest in, so a text in several known
    languages stays.  Null texts, texts without a letter and, without a model, all rows go.
    """
    at = docs.columns.index("text")

    def work(batches):
        apply = _rows(model)
        for batch in slices(batches, at):
            languages, _, sure = apply(batch.column(at).to_pylist())
            kept = [name != UNKNOWN and s >= least for name, s in zip(languages, sure)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
