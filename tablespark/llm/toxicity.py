"""Toxicity by cumulative-link ordinal regression.

Severity has ordered grades: 0 for texts labelled clean, and for toxic ones a grade by how many of their words
mark toxic texts. Features are words, and beginnings of words by their share, since inflected languages hide
one stem in many words. All thresholds share one weight for each word: P(grade <= k) = logistic(threshold k - w x). A
text's expected severity is the mean of the grades under the model.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, written

_WORD = re.compile(r"[^\W\d_]+")
#: Characters lower-cased and split at once; bounds memory for very long texts.
SLICE = 1 << 20


#: Lengths of the word beginnings that are features.
STEMS = (4, 5, 6, 7)


def word_counts(text: str, vocabulary: dict[str, int] | None = None) -> Counter:
    """Counts of lower-cased words and, after ^, of their beginnings; the number of all words is under "".

    Slices end at white space, so no word is cut. With a vocabulary, only its features are counted.
    """
    words: Counter = Counter()
    at = 0
    while at < len(text):
        end = at + SLICE
        while end < len(text) and text[end].isalpha():
            end += 1
        words.update(_WORD.findall(text[at:end].lower()))
        at = end
    counts: Counter = Counter()
    for w, n in words.items():
        for f in (w, *["^" + w[:k] for k in STEMS if len(w) > k]):
            if vocabulary is None or f in vocabulary:
                counts[f] += n
    counts[""] = words.total()
    return counts


@dataclass
class SeverityModel:
    vocabulary: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def grades(self, x: np.ndarray) -> np.ndarray:
        """Probability of each grade; one row for each row of x."""
        below = np.where(self.thresholds[None, :] < np.inf, 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - (x @ self.weights)[:, None], -60, 60))), 1.0)
        edge = np.ones((len(x), 1))
        return np.diff(np.concatenate([0 * edge, below, edge], axis=1), axis=1)

    def features(self, counts: list[Counter]) -> np.ndarray:
        x = np.zeros((len(counts), len(self.vocabulary)))
        for i, c in enumerate(counts):
            for w, n in c.items():
                if w in self.vocabulary:
                    x[i, self.vocabulary[w]] = np.log1p(1000 * n / (c[""] + 50) if w[0] == "^" else n)
        return x


def knows_nothing(grades: int) -> SeverityModel:
    """All texts have grade 0 for certain."""
    return SeverityModel({}, np.zeros(0), np.full(grades, np.inf))


def fit_cumulative_link(x: np.ndarray, y: np.ndarray, grades: int, decay: float = 1e-3, rounds: int = 400, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the mean log-likelihood; gaps between thresholds stay positive."""
    w, raw = np.zeros(x.shape[1]), np.concatenate([[1.0], np.zeros(grades - 1)])
    m, v = np.zeros(len(w) + len(raw)), np.zeros(len(w) + len(raw))
    logistic = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    for t in range(1, rounds + 1):
        theta = raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])
        z = x @ w
        upper = logistic(np.append(theta, np.inf)[y] - z)
        lower = logistic(np.concatenate([[-np.inf], theta])[y] - z)
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        gw = x.T @ (du - dl) / len(y) + decay * w
        gt = np.array([(dl[y == k + 1].sum() - du[y == k].sum()) / len(y) for k in range(grades)])
        tail = np.cumsum(gt[::-1])[::-1]
        g = np.concatenate([gw, [tail[0]], tail[1:] * np.exp(raw[1:])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, raw = w - step[: len(w)], raw - step[len(w) :]
    return w, raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])


def sample_labels(labels: DataFrame, id_col: str = "doc_id", toxic_col: str = "toxic", per_class: int = 2000) -> DataFrame:
    """(doc_id, toxic) of about per_class ids of each label, chosen by hash; so few that they can be broadcast.

    An id labelled more than once counts once, as toxic if any label says so; null ids and labels are left out.
    """
    rows = labels.select(F.col(id_col).alias("doc_id"), (F.col(toxic_col) > 0).cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    limit = F.when(F.col("toxic") == 1, _share(per_class, sizes.get(1, 0))).otherwise(_share(per_class, sizes.get(0, 0)))
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(GRAIN)) < limit)


GRAIN = 1 << 20


def _share(wanted: int, there: int) -> int:
    return int(GRAIN * min(1.0, wanted / max(there, 1)))


def fit_severity(labelled: DataFrame, text_col: str = "text", toxic_col: str = "toxic", per_class: int = 2000, words: int = 800, grades: int = 3) -> SeverityModel:
    """Learns from a bounded sample: about per_class texts of each label, chosen by hash; equal ones count once.

    Words are chosen by the log-odds of their document frequencies in the sample, divided by its deviation. Rows
    without text or label are left out. Unless both labels occur, the model knows nothing and scores every text 0.

    Grades are made here, as the tables have two labels: 0 is clean, 1 to `grades` are the quantiles among toxic
    texts of how many of their words mark toxic texts. They order toxic texts by density; they are no human grades.
    """
    bounded_batches(labelled.sparkSession)
    rows = labelled.select(F.col(text_col).alias("text"), (F.col(toxic_col) > 0).cast("int").alias("y")).where("text is not null and y is not null")
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if set(sizes) != {0, 1}:
        return knows_nothing(grades)
    limit = F.when(F.col("y") == 1, _share(per_class, sizes[1])).otherwise(_share(per_class, sizes[0]))
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(GRAIN)) < limit).select("y", "text").dropDuplicates()
    sample = written(sample, "severity-sample")

    def frequencies(batches):
        df: Counter = Counter()
        for batch in batches:
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist()):
                df.update((y, w) for w in word_counts(text) if w)
        keys = list(df)
        for at in range(0, len(keys), 20_000):
            part = keys[at : at + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([w for _, w in part]), pa.array([y for y, _ in part], pa.int32()), pa.array([df[k] for k in part], pa.int64())], names=["word", "y", "n"])

    of = lambda k: F.coalesce(F.sum(F.when(F.col("y") == k, F.col("n"))), F.lit(0))
    df = sample.mapInArrow(frequencies, "word string, y int, n bigint").groupBy("word").agg(of(0).alias("clean"), of(1).alias("toxic"), F.sum("n").alias("all"))
    drawn = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if set(drawn) != {0, 1}:
        return knows_nothing(grades)
    odds = lambda c, k: F.log((F.col(c) + 0.5) / (drawn[k] + 1 - F.col(c)))
    z = (odds("toxic", 1) - odds("clean", 0)) / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    best = df.where("all >= 3").select("word", z.alias("z")).orderBy(F.desc(F.abs("z")), "word").limit(words).collect()
    z, chosen = {r["word"]: r["z"] for r in best}, [r["word"] for r in best]
    known = dict.fromkeys(chosen, 0)

    def count(batches):
        for batch in batches:
            found = [word_counts(t, known) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([[(w, n) for w, n in c.items()] for c in found], pa.map_(pa.string(), pa.int32()))], names=["y", "words"])

    got = sample.mapInArrow(count, "y int, words map<string,int>").collect()
    got.sort(key=lambda r: (r["y"], sorted(r["words"].items())))
    y = np.array([r["y"] for r in got])
    model = SeverityModel({w: i for i, w in enumerate(chosen)}, np.zeros(len(chosen)), np.zeros(grades))
    x = model.features([Counter(r["words"]) for r in got])
    marks = np.array([z[w] > 3 for w in chosen])
    load = x[:, marks].sum(axis=1)
    cuts = np.quantile(load[y == 1], np.linspace(0, 1, grades + 1)[1:-1]) if grades > 1 else []
    target = np.where(y == 1, 1 + np.searchsorted(cuts, load, side="left"), 0)
    model.weights, model.thresholds = fit_cumulative_link(x, target, grades)
    return model


def score_severity(docs: DataFrame, model: SeverityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_severity, p_toxic, grade (the likeliest) and toxic for each row of docs.

    Whole texts are counted, in slices. Null texts count as empty; equal texts get equal values; empty tables
    give no rows; further columns, whatever their names, are left out.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                p = model.grades(model.features([word_counts(t, model.vocabulary) for t in batch.column("text").to_pylist()]))
                cols = [pa.array(p @ np.arange(p.shape[1])), pa.array(1 - p[:, 0]), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(p[:, 0] < 0.5)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", "expected_severity", "p_toxic", "grade", "toxic"])

    return rows.mapInArrow(run, f"doc_id {kind}, expected_severity double, p_toxic double, grade int, toxic boolean")
