"""Language identification by nearest centroid.

A text becomes a vector of hashed byte trigrams (letters only, lower case), log-scaled, weighted by inverse
document frequency and brought to length 1. Spherical k-means gives every language several centroids. The
prediction is the language of the centroid with the largest cosine; a text further from it than its length
allows is rejected.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices

DIMS = 8192
#: Bytes looked at together; bounds a task's memory whatever the length of a text.
SLICE = 1 << 20
ROWS = 64
_FOLD = np.array([b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256)], dtype=np.uint32)


def _ids(data: np.ndarray) -> np.ndarray:
    b = _FOLD[data]
    h = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    out = ((h * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64)
    out[(b[1:-1] == 32)] = -1  # a trigram is counted at a letter in its middle
    return out


def trigram_counts(texts: list[bytes]) -> np.ndarray:
    """One row of DIMS trigram counts for each text, in slices of bounded size."""
    out = np.zeros((len(texts), DIMS), dtype=np.float32)
    short = [i for i, t in enumerate(texts) if len(t) <= SLICE]
    start = 0
    while start < len(short):
        end, size = start, 0
        while end < len(short) and size <= SLICE:
            size += len(texts[short[end]])
            end += 1
        part = short[start:end]
        joined = np.frombuffer(b" " + b"".join(texts[i] + b"  " for i in part), dtype=np.uint8)
        rows = np.repeat(np.arange(len(part)), [len(texts[i]) + 2 for i in part])[: len(joined) - 2]
        ids = _ids(joined)
        keep = ids >= 0
        out[part] = np.bincount(rows[keep] * DIMS + ids[keep], minlength=len(part) * DIMS).reshape(len(part), DIMS)
        start = end
    for i, t in enumerate(texts):
        if len(t) > SLICE:
            for at in range(0, len(t), SLICE):
                piece = b" " * (at == 0) + t[max(0, at - 2 + (at == 0) * 2) : at + SLICE] + b" " * (at + SLICE >= len(t))
                ids = _ids(np.frombuffer(piece, dtype=np.uint8)) if len(piece) > 2 else np.empty(0, np.int64)
                out[i] += np.bincount(ids[ids >= 0], minlength=DIMS)
    return out


@dataclass
class LanguageModel:
    """langs: language of each centroid; floors: least cosine by bit length of the trigram count."""

    langs: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    floors: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _size_class(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(counts.sum(axis=1), 1)).astype(int), 31)


def _spherical_kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit_language_model(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_lang: int = 400, total: int = 20_000, centroids: int = 4, rounds: int = 10, seed: int = 7) -> LanguageModel:
    """Learns from a bounded sample: about per_lang different texts, chosen by hash, of each language.

    Copies of a text count once, however many there are. With so many languages that this would pass `total` texts, each
    gives fewer; none is left out. The driver holds the sample's trigram counts sparsely and one language's at a time in
    full. Rows without text, letters or language are left out. If nothing is left, the model knows no language.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    bounded_batches(rows.sparkSession)
    rows = rows.withColumn("h", F.xxhash64("text"))
    sizes = rows.select("lang", "h").distinct().groupBy("lang").count().collect()
    none = LanguageModel([], np.zeros((0, DIMS), np.float32), np.ones(DIMS, np.float32), np.zeros(32, np.float32))
    if not sizes:
        return none
    grain, wanted = 1 << 20, min(per_lang, max(1, total // len(sizes)))
    rate = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(math.ceil(grain * min(1.0, wanted / r["count"]))))])
    sample = rows.where(F.pmod("h", F.lit(grain)) < F.coalesce(rate[F.col("lang")], F.lit(0))).dropDuplicates(["lang", "text"])

    def sparse(batches):
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            for at in range(0, len(texts), ROWS):
                counts = trigram_counts(texts[at : at + ROWS])
                nz = [np.flatnonzero(r) for r in counts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("lang").slice(at, len(nz)), batch.column("h").slice(at, len(nz)), pa.array([i.astype(np.int32) for i in nz], pa.list_(pa.int32())), pa.array([counts[j][i] for j, i in enumerate(nz)], pa.list_(pa.float32()))],
                    names=["lang", "h", "ids", "counts"],
                )

    got = sample.mapInArrow(sparse, "lang string, h bigint, ids array<int>, counts array<float>").where(F.size("ids") > 0).toArrow().combine_chunks()
    if not got.num_rows:
        return none
    got = got.sort_by([("lang", "ascending"), ("h", "ascending")]).combine_chunks()
    lists = got.column("ids").combine_chunks()
    ends, ids = lists.offsets.to_numpy(), lists.values.to_numpy()
    values = got.column("counts").combine_chunks().values.to_numpy()
    row = np.repeat(np.arange(got.num_rows), np.diff(ends))

    def dense(first: int, last: int) -> np.ndarray:
        out, of = np.zeros((last - first, DIMS), np.float32), slice(ends[first], ends[last])
        out[row[of] - first, ids[of]] = values[of]
        return out

    idf = (np.log((1 + got.num_rows) / (1 + np.bincount(ids, minlength=DIMS))) + 1).astype(np.float32)
    model = LanguageModel([], none.centroids, idf, none.floors)
    y = np.array(got.column("lang").to_pylist(), dtype=object)
    edges = [0, *(np.flatnonzero(y[1:] != y[:-1]) + 1).tolist(), len(y)]
    parts = [(y[i], _spherical_kmeans(model.vectors(dense(i, j)), centroids, rounds, seed)) for i, j in zip(edges, edges[1:])]
    model.langs = [lang for lang, c in parts for _ in c]
    model.centroids = np.concatenate([c for _, c in parts]).astype(np.float32)
    found = [(model.vectors(d) @ model.centroids.T, _size_class(d)) for d in (dense(i, min(i + 512, len(y))) for i in range(0, len(y), 512))]
    best, size = np.concatenate([c.max(axis=1) for c, _ in found]), np.concatenate([n for _, n in found])
    # A fifth of what nearly all labelled texts of this length or a longer one reach.
    low, floor = np.ones(32, np.float32), 1.0
    for s in range(31, -1, -1):
        if (size == s).sum() >= 20:
            floor = min(floor, float(np.quantile(best[size == s], 0.01)))
        low[s] = floor
    first = next((s for s in range(32) if (size == s).sum() >= 20), 32)
    low[:first] = 0.0  # too short to tell how far a text of the language may lie
    model.floors = low * 0.2
    return model


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns named in keep, lang_pred, score (cosine, 0 to 1) and rejected, for each row of docs.

    Whole texts are used, in slices. Null texts and texts without a letter get und and 0 and are rejected;
    rejected is also true below the model's cosine floor for the text's length. A model without languages gives
    und and 0, and rejects only texts without a letter. Equal texts get equal values; ties go to the first
    language in order; repeated rows are judged each; empty tables give no rows; columns not named in keep,
    whatever their names, are left out.
    """
    names = ["doc_id", *keep]
    bounded_batches(docs.sparkSession)
    # A text that is kept goes through Python once.
    source = text_col if text_col in keep else "_text"
    rows = docs.select(F.col(id_col).alias("doc_id"), *keep, *([] if text_col in keep else [F.col(text_col).alias("_text")]), has_letter(F.col(text_col)).alias("_letter"))
    out_type = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema) + ", lang_pred string, score double, rejected boolean"

    def predict(batches):
        for whole in batches:
            for batch in slices(whole, source, ROWS):
                counts = trigram_counts([(t or "").encode() for t in batch.column(source).to_pylist()])
                letter = np.array(batch.column("_letter").to_pylist(), dtype=bool)
                if model.langs:
                    cos = np.clip(model.vectors(counts) @ model.centroids.T, 0.0, 1.0)
                    best = cos.argmax(axis=1)
                    score = np.where(letter, cos[np.arange(len(best)), best], 0.0).astype(np.float64)
                    lang = [model.langs[b] if ok else "und" for b, ok in zip(best, letter)]
                else:
                    score, lang = np.zeros(len(letter)), ["und"] * len(letter)
                bad = ~letter | (score < model.floors[_size_class(counts)])
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(lang, pa.string()), pa.array(score), pa.array(bad)], names=[*names, "lang_pred", "score", "rejected"])

    return rows.mapInArrow(predict, out_type)
