"""Severity of toxic language by cumulative-link ordinal regression on sparse word features.

Grades 0..K-1 share one weight per word; P(grade >= k) = sigmoid(w.x - threshold[k]) for each of the
K-1 ordered thresholds. x marks which words a whole text has (letters and digits, A-Z folded). The
score is the expected grade, the sum of those K-1 probabilities; a text is toxic where
P(grade >= 1) is at least one half.

Labels that only say toxic or not are graded first: the toxic training texts are split in three by
how many different words they have that occur mostly in toxic training texts.

Null and empty texts have no words and get the score of the thresholds alone. Rows are scored one by
one, so ties and repeated rows score alike and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tailrace.llm.bytewise import distinct, no_letter_or_digit, runs
from tailrace.llm.workers import giving_back

# Most labelled documents that the fit reads; the ones with the smallest hash of their id.
TRAINING_ROWS = 8_000
GRADES = 4
ADDED = ("severity", "toxic_probability", "severity_grade", "toxic")


@dataclass(frozen=True)
class SeverityModel:
    """words: sorted hashes of the words with a weight; thresholds: ascending, one fewer than grades."""

    words: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray


def _word_sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each run of texts: first row, number of texts, and the distinct (text, word hash) pairs."""
    separators = no_letter_or_digit()
    for run in runs(column):
        begin, end, at = run.words(separators)
        text = np.repeat(np.arange(run.texts), np.diff(at))
        yield run.first, run.texts, *distinct(text, run.hashes(begin, end, fold=True), run.texts)


@giving_back
def _training_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = []
        for _, texts, text, word in _word_sets(batch["text"]):
            cut = np.searchsorted(text, np.arange(1, texts))
            sets += [part.tobytes() for part in np.split(word, cut)]
        yield pa.RecordBatch.from_arrays([batch["label"], pa.array(sets, pa.binary())], ["label", "words"])


def training_sample(documents: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(label, words) of at most `rows` labelled documents; the largest label of a document counts."""
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id")
        .limit(rows)
    )
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return texts.select("label", "text").mapInArrow(_training_words, "label int, words binary")


def _evidence(toxic: np.ndarray, rows: np.ndarray, columns: np.ndarray, words: int) -> np.ndarray:
    """By word, the log-likelihood ratio (G) of its texts being toxic more often than others; 0 where they
    are not."""
    seen = np.bincount(columns, minlength=words)
    hits = np.bincount(columns[toxic[rows]], minlength=words)
    rate = np.clip(toxic.mean() if len(toxic) else 0.5, 1e-9, 1 - 1e-9)
    share = hits / np.maximum(seen, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(hits > 0, hits * np.log(share / rate), 0)
        gain += np.where(hits < seen, (seen - hits) * np.log((1 - share) / (1 - rate)), 0)
    return np.where(share > rate, 2 * gain, 0)


def graded(toxic: np.ndarray, telling: np.ndarray) -> np.ndarray:
    """Grade 0 for clean texts, 1 to 3 for toxic ones by their number of telling words. telling: the text
    of each telling word."""
    count = np.bincount(telling, minlength=len(toxic))
    grade = np.zeros(len(toxic), int)
    if toxic.any():
        cuts = np.quantile(count[toxic], [1 / 3, 2 / 3])
        grade[toxic] = 1 + (count[toxic][:, None] > cuts).sum(1)
    return grade


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _weights(rows, columns, words: int, grade, above, penalty: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Weight of each word and thresholds. All words that toxic texts have more often may get a weight; a
    tenth of the steps finds the ones that the penalty leaves, the others settle those."""
    keep = _evidence(grade > 0, rows, columns, words) > 0
    weights, thresholds = np.zeros(words), np.linspace(1.0, 2.0, above.shape[1])
    for share in (steps // 10, steps):
        held = keep[columns]
        own = rows[held], (np.cumsum(keep) - 1)[columns[held]]
        new, thresholds = _descend(*own, above, weights[keep], thresholds, share, penalty / max(len(above), 1))
        weights[keep] = new
        keep = weights > 0
    return weights, thresholds


def _matched(score: np.ndarray, above: np.ndarray) -> np.ndarray:
    """The likeliest thresholds for given scores, those that expect as many texts above each as there are."""
    low, high = np.full(above.shape[1], -30.0), np.full(above.shape[1], 30.0)
    for _ in range(60):
        middle = (low + high) / 2
        many = _sigmoid(score[:, None] - middle).mean(0) > above.mean(0)
        low, high = np.where(many, middle, low), np.where(many, high, middle)
    return np.maximum.accumulate((low + high) / 2)


def fit(sample: DataFrame, penalty: float = 0.1, steps: int = 2_000, folds: int = 3) -> SeverityModel:
    """Weights by proximal gradient steps over the words of all texts; `penalty`, in texts, decides which
    words have one. Texts that took part in the weights score higher than new ones, so the thresholds are
    those of texts scored with the weights of the other folds.

    sample: (label, words) as of training_sample(), at most TRAINING_ROWS rows. Labels of 0 and 1
    are graded, others are taken as grades. Texts with the same words count once.
    """
    held: dict[bytes, int] = {}
    for r in sample.collect():
        held[bytes(r.words)] = max(r.label, held.get(bytes(r.words), 0))
    held = dict(sorted(held.items()))
    label = np.array(list(held.values()), int)
    sets = [np.frombuffer(x, np.uint64) for x in held]
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    words, columns, seen = np.unique(
        np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True
    )
    top = int(label.max(initial=0))
    grade = label
    if top <= 1:
        standing = 3 * np.log(max(int((seen >= 4).sum()), 3))
        telling = (_evidence(label > 0, rows, columns, len(words)) > standing) & (seen >= 4)
        grade = graded(label > 0, rows[telling[columns]])
    above = (grade[:, None] >= np.arange(1, max(top + 1, GRADES))).astype(float)
    weights, thresholds = _weights(rows, columns, len(words), grade, above, penalty, steps)
    if len(label):
        score, fold = np.zeros(len(label)), np.arange(len(label)) % folds
        for f in range(folds):
            use = fold != f
            inside = use[rows]
            part = (np.cumsum(use) - 1)[rows[inside]], columns[inside]
            other, _ = _weights(*part, len(words), grade[use], above[use], penalty, steps)
            score += np.where(use, 0, np.bincount(rows, other[columns], minlength=len(label)))
        thresholds = _matched(score, above)
    used = weights > 0
    return SeverityModel(words[used], weights[used], thresholds)


def _descend(rows, columns, above, weights, thresholds, steps: int, penalty: float):
    """Accelerated proximal gradient steps. Weights stay at 0 or above: a word never lowers a severity, so
    harmless words cannot hide others, and a text without words has the least."""
    n, size = max(len(above), 1), len(weights)
    share = np.bincount(columns, minlength=size) / n + 1e-9
    crowd = np.quantile(np.bincount(rows, minlength=n), 0.99) if len(rows) else 1.0
    rate = 4 / (above.shape[1] * share * max(crowd, 1.0))
    momentum_w, momentum_t = weights.copy(), thresholds.copy()
    for step in range(1, steps + 1 if len(above) else 1):
        score = np.bincount(rows, momentum_w[columns], minlength=len(above))
        slack = _sigmoid(score[:, None] - momentum_t) - above
        slope = np.bincount(columns, slack.sum(1)[rows], minlength=size) / n
        new = np.maximum(momentum_w - rate * (slope + penalty), 0)
        bars = np.maximum.accumulate(momentum_t + 2.0 * slack.mean(0))
        push = (step - 1) / (step + 2) if step % 100 else 0.0
        momentum_w = np.maximum(new + push * (new - weights), 0)
        momentum_t = np.maximum.accumulate(bars + push * (bars - thresholds))
        weights, thresholds = new, bars
    return weights, thresholds


def score(documents: DataFrame, model: SeverityModel) -> DataFrame:
    """Adds severity (expected grade), toxic_probability, severity_grade (the likeliest) and toxic;
    columns of these names are replaced."""
    words, weights, thresholds = model.words, model.weights, model.thresholds
    names = [c for c in documents.columns if c.lower() not in ADDED]

    @giving_back
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(batch.num_rows)
            for first, texts, text, word in _word_sets(batch["text"]):
                place = np.minimum(np.searchsorted(words, word), max(len(words) - 1, 0))
                hit = words[place] == word if len(words) else np.zeros(len(word), bool)
                total[first : first + texts] += np.bincount(text[hit], weights[place[hit]], texts)
            above = _sigmoid(total[:, None] - thresholds)
            edges = np.hstack([np.ones((len(total), 1)), above, np.zeros((len(total), 1))])
            added = [
                pa.array(above.sum(1)),
                pa.array(above[:, 0]),
                pa.array((edges[:, :-1] - edges[:, 1:]).argmax(1).astype(np.int32)),
                pa.array(above[:, 0] >= 0.5),
            ]
            kept = [batch[c] for c in names]
            yield pa.RecordBatch.from_arrays(
                kept + added, [*names, *ADDED]
            )

    kept = documents.select(*names)
    schema = StructType(list(kept.schema.fields))
    for column, kind in zip(ADDED, ("double", "double", "integer", "boolean")):
        schema = schema.add(column, kind)
    return kept.mapInArrow(scored, schema)


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAINING_ROWS) -> SeverityModel:
    return fit(training_sample(documents, labels, label, rows))
