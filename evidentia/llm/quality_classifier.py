"""Quality classifier: naive Bayes support vectors.

Features are indicators of word 1- and 2-grams, A-Z folded and hashed, and of coarse shares of characters and repeats (also n-grams: of the shapes of
words). Each indicator is scaled by the log ratio of its smoothed counts in the two classes; on these a linear hinge-loss model is fitted by dual
coordinate descent, and averaged with plain naive Bayes as usual for such models. A logistic curve, fitted on margins, makes scores of 0 to 1.

The model is fitted on at most `sample` labelled rows, the ones that come first in the order of a hash, half of each class where there are as many; the
driver holds their indicators. Scoring sends the weights, of fixed size, to where the texts are read: no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, map_batches, mix, string_buffers, tune, word_slices

#: Labelled rows that a model is fitted on at most; log2 of the number of hashed indicators.
SAMPLE, LOG2 = 6000, 18
#: Share of the support vector weights in the average with their mean magnitude; misclassification cost; rounds of coordinate descent.
BLEND, COST, ROUNDS = 0.75, 1.0, 12
_MASK = U((1 << LOG2) - 1)


def _bins(x: np.ndarray, edges: list[float]) -> np.ndarray:
    return np.searchsorted(np.array(edges), x, "right").astype(np.uint64)


def indicators(column: pa.Array):
    """Yield (first row, row of each indicator, indicator) for runs of rows; an indicator comes once per row."""
    data, at = string_buffers(column)
    for first, words, word_at in word_slices(column, fold=True):
        n = len(word_at) - 1
        counts = np.diff(word_at)
        row = np.repeat(np.arange(n), counts)
        same = row[1:] == row[:-1]
        pair = mix(words[:-1] * U(3) + words[1:])[same]
        repeated = np.zeros(n)
        np.add.at(repeated, row[1:][same], words[1:][same] == words[:-1][same])
        own = data[at[first] : at[first + n]]
        edge = at[first : first + n + 1] - at[first]
        held = np.concatenate([[0], np.cumsum((own > 0x20) & (own < 0x7F) & ~_ALNUM[own])])
        signs = held[edge[1:]] - held[edge[:-1]]
        size = np.maximum(np.diff(edge), 1)
        grams = [(row, words & _MASK), (row[1:][same], pair & _MASK)]
        shapes = np.stack([
            _bins(counts, [1, 5, 10, 20, 40, 80, 320]),
            _bins(signs / size, [0.005, 0.01, 0.02, 0.03, 0.04, 0.06, 0.1, 0.2]),
            _bins(repeated / np.maximum(counts, 1), [0.01, 0.05, 0.2, 0.5]),
            _bins(size / np.maximum(counts, 1), [3, 4, 5, 6, 7, 8, 10, 15]),
        ])
        for k, shape in enumerate(shapes):
            # several indicators each, so that a shape weighs as much as a few words
            for j in range(4):
                grams.append((np.arange(n), mix(U(1 << 40) + U(1 << 20) * U(k) + shape * U(8) + U(j)) & _MASK))
        key = np.unique(np.concatenate([r.astype(np.int64) << LOG2 | g.astype(np.int64) for r, g in grams]))
        yield first, key >> LOG2, key & int(_MASK)


_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def _grams_of(batches):
    for batch in batches:
        own: list[np.ndarray] = []
        for _, row, gram in indicators(batch.column(1)):
            n = int(row[-1]) + 1 if len(row) else 0
            ends = np.searchsorted(row, np.arange(n + 1))
            own += [gram[a:b].astype(np.int32) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        lists = pa.array([x.tolist() for x in own], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["label", "grams"])


class Model:
    """Weights of hashed indicators, and the logistic curve over margins."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, offset: float):
        self.weights, self.bias, self.slope, self.offset = weights, bias, slope, offset

    def margins(self, row: np.ndarray, gram: np.ndarray, n: int) -> np.ndarray:
        total = np.bincount(row, self.weights[gram], n)
        return total / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1)) + self.bias

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -500, 500)))


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, upper: np.ndarray, size: int, rounds: int) -> tuple[np.ndarray, float, np.ndarray]:
    """(weights, bias, alpha) of the linear hinge-loss problem: least |w|^2 / 2 + bias^2 / 2 + sum of upper times the losses 1 - y (w x + bias), by dual
    coordinate descent. A row has values at places; a round visits every row once, in an order that is fixed."""
    norm = np.array([v @ v + 1.0 for v in values])
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(y))
    shuffled = np.random.default_rng(7)
    for _ in range(rounds):
        for i in shuffled.permutation(len(y)):
            g, v = rows[i], values[i]
            slope = y[i] * (w[g] @ v + bias) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), upper[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                alpha[i] = new
                w[g] += step * v
                bias += step
    return w, bias, alpha


def fit(grams: list[np.ndarray], labels: np.ndarray, blend: float = BLEND, cost: float = COST, rounds: int = ROUNDS) -> Model:
    """A model from indicator lists and labels 0 or 1. With one class only, every score is 1 for label 1, 0 for label 0, and 0.5 without rows."""
    n, size = len(labels), 1 << LOG2
    if not n or labels.min() == labels.max():
        return Model(np.zeros(size), 0.0, 0.0, 0.0 if not n else (20.0 if labels[0] else -20.0))
    sides = [np.bincount(np.concatenate([g for g, y in zip(grams, labels, strict=True) if y == side]), minlength=size) for side in (0, 1)]
    held = np.flatnonzero(sides[0] + sides[1] > 1)
    ratio = np.zeros(size)
    p, q = sides[1][held] + 1.0, sides[0][held] + 1.0
    ratio[held] = np.log((p / (labels.sum() + 2)) / (q / ((labels == 0).sum() + 2)))
    rows = [g[ratio[g] != 0] for g in grams]
    values = [ratio[g] / np.sqrt(max(len(full), 1)) for g, full in zip(rows, grams, strict=True)]
    y = np.where(labels == 1, 1.0, -1.0)
    # rare classes cost as much as frequent ones
    upper = cost * n / (2 * np.where(y > 0, labels.sum(), n - labels.sum()))
    w, bias, _ = dual_descent(rows, values, y, upper, size, rounds)
    scaled = (1 - blend) * np.abs(w[held]).mean() + blend * w
    weights = scaled * ratio
    model = Model(weights, bias, 1.0, 0.0)
    row = np.repeat(np.arange(n), [len(g) for g in grams])
    margins = model.margins(row, np.concatenate(grams), n)
    # Platt's curve by Newton steps, with his smoothed targets
    target = np.where(y > 0, (labels.sum() + 1) / (labels.sum() + 2), 1 / (n - labels.sum() + 2))
    each = upper / cost
    a, b = 1.0, 0.0
    for _ in range(50):
        s = 1 / (1 + np.exp(-np.clip(a * margins + b, -500, 500)))
        e, h = each * (s - target), each * s * (1 - s) + 1e-9
        grad = np.array([e @ margins, e.sum()])
        hess = np.array([[h @ margins**2 + 1e-6, h @ margins], [h @ margins, h.sum() + 1e-6]])
        move = np.linalg.solve(hess, grad)
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-8:
            break
    return Model(weights, bias, a, b)


def fit_on(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> Model:
    """Fit on at most `sample` rows of labels (id_col, label_col of 0 or 1) that docs has a text for. Null labels or ids are no labels; of several for a row the largest counts."""
    spark = docs.sparkSession
    tune(spark)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    order = [F.xxhash64("id"), F.col("id")]
    half = [known.filter(F.col("label") == side).orderBy(*order).limit(sample // 2) for side in (0, 1)]
    chosen = half[0].unionByName(half[1])
    # at most `sample` rows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    table = map_batches(texts.select("label", "text"), _grams_of, "label int, grams array<int>").toArrow()
    grams = [np.asarray(g, np.int64) for g in table["grams"].combine_chunks().to_numpy(zero_copy_only=False)] if len(table) else []
    got = table["label"].to_numpy() if len(table) else np.zeros(0, np.int64)
    order = sorted(range(len(got)), key=lambda k: (got[k], len(grams[k]), grams[k][:8].tolist(), int(grams[k].sum())))  # tasks end in any order
    return fit([grams[k] for k in order], np.array([got[k] for k in order], np.int64), **options)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without its text, with score (0 to 1, higher: label 1 likelier) and predicted (1 from 0.5 on).

    Null and empty texts get the score of a text without words. Every row stays; columns named score or predicted are replaced.
    """
    tune(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    plain = docs.select(F.struct(*rest).alias("row"), F.col(text_col).cast("string").alias("text"))
    kind = plain.schema["row"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = sent.value
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            firsts = []
            for first, row, gram in indicators(batch.column(1)):
                firsts.append(first)
                n = int(row[-1]) + 1
                scores[first : first + n] = own.scores(own.margins(row, gram, n))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["row", "score"])

    scored = map_batches(plain, run, f"row {kind}, score double")
    return scored.select("row.*", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that are predicted to have label 1; all columns stay as they are, whatever their names."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    return score(whole, model, "text").filter("predicted = 1").select("row.*")
