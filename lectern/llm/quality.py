"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w . x) with one vector of weights w over hashed text features for all grades, and
ordered thresholds. A document gets its expected grade and the tail probability of the best grade, by which documents
are selected. Features are the distinct words of the whole text, hashed, and a few bucketed shares (repeated words and
lines, capitals, symbols) hashed as if they were words.

The model is fitted on a bounded sample of labels (``MOST_LABELLED``, those of the smallest hashes of doc_id); it scores
every document. Grades here: 0 toxic, 1 low quality, 2 good.

Defined cases: null and empty texts are scored by the thresholds and the bucketed shares alone; labels that are null or
without a document are not used; several labels of a doc_id count as several ratings; where a doc_id has several texts,
the one of the least features is the rated one; without any label the tail probability is 1 and all is kept; repeated
rows stay, as do rows without doc_id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The bound of the training sample, the number of hash buckets, the number of steps, the strength of shrinkage, and the
#: documents that a feature has to be in at least.
MOST_LABELLED, BUCKETS, STEPS, SHRINK, LEAST_DOCS = 12_000, 1 << 18, 250, 0.3, 3
#: Features are fitted whose mean grade is so many standard errors off the mean grade of all, as the rest is noise; 0 fits all.
LEAST_SIGNAL = 3.0
#: Tail probability from which a document is kept.
KEEP_FROM = 0.5
_WORDS = re.compile(r"[^\W\d_]+|[^\w\s]+")


def features(text: str) -> np.ndarray:
    """Sorted distinct buckets of a text."""
    words = _WORDS.findall(text)
    n = len(words)
    distinct = set(words)
    lowered = {w.lower() for w in distinct}
    lines = [line for line in text.split("\n") if line.strip()]
    level = lambda x, y: min(10, int(10 * x / y)) if y else 0
    letters = sum(map(len, words))
    shares = {
        "repeated": level(n - len(distinct), n),
        "lines": level(len(lines) - len(set(lines)), len(lines)),
        "capitals": level(sum(map(str.isupper, words)), n),
        "symbols": level(sum(len(w) for w in words if not w[0].isalpha()), letters),
        "marks": level(sum(not w[0].isalpha() and len(w) > 1 for w in words), n),
        "size": min(10, n.bit_length()),
    }
    # A share alone says little in a short text, so its bucket also names the size.
    short = "short" if n < 12 else "long"
    out = {zlib.crc32(w.encode()) % BUCKETS for w in lowered}
    out |= {zlib.crc32(f"\0{short} {k} {v}".encode()) % BUCKETS for k, v in shares.items()}
    adjacent = sum(a == b for a, b in zip(words, words[1:]))
    out.add(zlib.crc32(f"\0{short} adjacent {level(adjacent, n)}".encode()) % BUCKETS)
    return np.array(sorted(out), np.int32)


class Model:
    """weights by bucket; thresholds, ascending, one fewer than grades."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def score(self, buckets: np.ndarray) -> tuple[float, float]:
        """(expected grade, probability of the best grade)"""
        if not len(self.thresholds):
            return 0.0, 1.0
        above = 1 / (1 + np.exp(np.clip(self.thresholds - self.weights[buckets].sum(), -60, 60)))
        return float(above.sum()), float(above[-1])


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int = 3, least_signal: float = LEAST_SIGNAL) -> Model:
    """By full-batch Adam with decaying steps; deterministic. Thresholds stay ordered as the gaps are exponentials."""
    if not len(rows):
        return Model(np.zeros(BUCKETS, np.float64), np.zeros(0))
    sizes = np.array([len(r) for r in rows])
    every = np.concatenate(rows) if sizes.sum() else np.zeros(0, np.int32)
    docs = np.bincount(every, minlength=BUCKETS)
    grades = np.asarray(grades)
    sums = np.bincount(every, np.repeat(grades, sizes), BUCKETS)
    signal = np.abs(sums - docs * grades.mean()) / np.sqrt(np.maximum(docs, 1) * max(grades.var(), 1e-9))
    used = np.flatnonzero((docs >= min(LEAST_DOCS, max(1, len(rows) // 50))) & (signal >= least_signal))
    place = np.full(BUCKETS, -1)
    place[used] = np.arange(len(used))
    cols, owner = place[every], np.repeat(np.arange(len(rows)), sizes)
    owner, cols = owner[cols >= 0], cols[cols >= 0]
    k = n_grades - 1
    share = np.array([(np.sum(grades > j) + 0.5) / (len(grades) + 1) for j in range(k)])
    start = -np.log(share / (1 - share))
    params = np.concatenate([np.zeros(len(used)), [start[0]], np.log(np.maximum(np.diff(start), 0.1))])
    mean, square = np.zeros_like(params), np.zeros_like(params)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    for step in range(1, STEPS + 1):
        w, first, gaps = params[: len(used)], params[len(used)], np.exp(params[len(used) + 1 :])
        cuts = np.concatenate([[-np.inf], first + np.concatenate([[0.0], np.cumsum(gaps)]), [np.inf]])
        score = np.bincount(owner, w[cols], len(rows))
        high, low = sig(cuts[grades + 1] - score), sig(cuts[grades] - score)
        p = np.maximum(high - low, 1e-9)
        dh, dl = high * (1 - high), low * (1 - low)
        g_score = (dh - dl) / p
        g_cut = np.zeros(k + 2)
        np.add.at(g_cut, grades + 1, -dh / p)
        np.add.at(g_cut, grades, dl / p)
        g_cut = g_cut[1:-1]
        tail = np.cumsum(g_cut[::-1])[::-1]
        grad = np.concatenate([np.bincount(cols, g_score[owner], len(used)) + SHRINK * w, [tail[0]], tail[1:] * gaps])
        mean = 0.9 * mean + 0.1 * grad
        square = 0.99 * square + 0.01 * grad * grad
        rate = 0.1 * (1 - step / (STEPS + 1)) + 0.002
        params = params - rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(BUCKETS)
    weights[used] = params[: len(used)]
    return Model(weights, params[len(used)] + np.concatenate([[0.0], np.cumsum(np.exp(params[len(used) + 1 :]))]))


def sample_rows(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> list:
    """(doc_id, grade, buckets), a row for each rating of a document, at most ``most``; the driver gets hashed features only."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    rated = labels.where("doc_id is not null and quality is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade"))
    # At most ``most`` rows, so they may be sent to all executors.
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(most).groupBy("doc_id").agg(F.collect_list("grade").alias("grades"))

    def run(batches):
        for batch in batches:
            found = [features(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([x.tobytes() for x in found], pa.binary())], names=["doc_id", "grades", "buckets"])

    rows = docs.join(F.broadcast(chosen), "doc_id").select("text", "doc_id", "grades").mapInArrow(run, "doc_id long, grades array<int>, buckets binary")
    # However many rows a doc_id has, one of them is rated, so the driver gets no more than ``most``.
    one = rows.groupBy("doc_id").agg(F.min_by("grades", "buckets").alias("grades"), F.min("buckets").alias("buckets"))
    return sorted((r["doc_id"], g, bytes(r["buckets"])) for r in one.collect() for g in r["grades"])


def fit_model(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, least_signal: float = LEAST_SIGNAL, id_col: str = "doc_id", text_col: str = "text") -> Model:
    rows = sample_rows(docs.selectExpr(f"cast({id_col} as long) as doc_id", f"{text_col} as text"), labels, most)
    return fit([np.frombuffer(r[2], np.int32) for r in rows], np.array([r[1] for r in rows], np.int64), least_signal=least_signal)


def grade_documents(docs: DataFrame, model: Model, keep_from: float = KEEP_FROM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns doc_id, expected_grade, tail_probability, kept."""

    def run(batches):
        for batch in batches:
            scores = [model.score(features(t or "")) for t in batch.column(1).to_pylist()]
            tail = [s[1] for s in scores]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s[0] for s in scores], pa.float64()), pa.array(tail, pa.float64()), pa.array([t >= keep_from for t in tail], pa.bool_())], names=["doc_id", "expected_grade", "tail_probability", "kept"])

    return docs.selectExpr(f"cast({id_col} as long) as doc_id", f"{text_col} as text").mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, kept boolean")


def accepted(docs: DataFrame, model: Model, keep_from: float = KEEP_FROM, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model keeps."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            good = [model.score(features(t or ""))[1] >= keep_from for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
