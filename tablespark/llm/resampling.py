"""Importance resampling of documents towards a target corpus, over inverted postings.

Words and runs of words are hashed into buckets. Each task inverts its own documents into posting lists, (bucket,
documents, counts), of a bounded size, so that no bucket, however common its words, is one row or one group. The lists
are shuffled by bucket; the totals of both corpora, grouped by bucket too, meet them there and give the bucket's gain;
every posting turns into a contribution, and the contributions are summed by document, inside each task before the
shuffle.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordinals import numbered
from .common import bounded_batches, slices, written

#: Postings that a task holds before it writes their lists.
HELD = 1 << 20
#: Bytes of words are digits, letters and all beyond ASCII; capitals of ASCII become small.
_WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


class Buckets(dict):
    """Buckets of features, as UTF-8 bytes; the features met last are remembered."""

    def __init__(self, buckets: int, most: int = 500_000):
        super().__init__()
        self.buckets, self.most = buckets, most

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


def features_of(text: bytes, grams: int) -> tuple[list[bytes], int]:
    """(all runs of 1 to grams words, joined by a space; number of words)."""
    words = text.translate(_WORDS).split()
    found = list(words)
    for k in range(2, grams + 1):
        found += [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    return found, len(words)


def postings(rows: DataFrame, grams: int, buckets: int) -> DataFrame:
    """Posting lists of rows (doc_id, text as binary): bucket, keys, counts and total. Where bucket is null: keys of
    documents with their ids and numbers of words. A key names a row by its partition and its place there."""
    kind = rows.schema["doc_id"].dataType
    names = ["bucket", "keys", "counts", "total", "ids", "words"]

    def lists(values: np.ndarray, bounds: np.ndarray, of: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, of))

    def inverted(parts: list[tuple[int, np.ndarray, np.ndarray]], ids: pa.DataType) -> pa.RecordBatch:
        bucket = np.concatenate([b for _, b, _ in parts])
        count = np.concatenate([c for _, _, c in parts])
        key = np.repeat(np.array([k for k, _, _ in parts], np.int64), [len(b) for _, b, _ in parts])
        order = np.argsort(bucket, kind="stable")
        bucket, count, key = bucket[order], count[order], key[order]
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.empty(0, np.int64)
        bounds, n = np.append(first, len(bucket)), len(first)
        totals = np.add.reduceat(count.astype(np.int64), first) if n else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[first], pa.int32()), lists(key, bounds, pa.int64()), lists(count, bounds, pa.int32()), pa.array(totals), pa.nulls(n, pa.list_(ids)), pa.nulls(n, pa.list_(pa.int64()))], names=names
        )

    def documents(keys: list[int], ids: pa.Array, words: list[int]) -> pa.RecordBatch:
        whole = np.array([0, len(keys)])
        return pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.int32()), lists(np.array(keys), whole, pa.int64()), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.int64()), pa.ListArray.from_arrays(pa.array(whole, pa.int32()), ids), lists(np.array(words), whole, pa.int64())],
            names=names,
        )

    def run(batches):
        known, key, parts, held, ids = Buckets(buckets), TaskContext.get().partitionId() << 33, [], 0, None
        for whole in batches:
            ids = whole.column("doc_id").type
            for batch in slices(whole, "text"):
                keys, words = [], []
                for text in batch.column("text").to_pylist():
                    found, n = features_of(text, grams)
                    of = Counter(found)
                    if of:
                        parts.append((key, np.fromiter(map(known.__getitem__, of), np.int32, len(of)), np.fromiter(of.values(), np.int32, len(of))))
                    keys.append(key)
                    words.append(n)
                    key, held = key + 1, held + len(of)
                    if held >= HELD:
                        yield inverted(parts, ids)
                        parts, held = [], 0
                yield documents(keys, batch.column("doc_id"), words)
        if parts:
            yield inverted(parts, ids)

    return rows.mapInArrow(run, f"bucket int, keys array<bigint>, counts array<int>, total bigint, ids array<{kind.simpleString()}>, words array<bigint>")


def gain(s: Column, t: Column, all_s: int, all_t: int, buckets: int) -> Column:
    """A bucket's gain in thousandths, floored, from its features in the corpus and in the target."""
    up = (t.cast("double") + 1.0) * F.lit(float(all_s + buckets))
    return F.floor(F.lit(1000.0) * F.log(up / ((s.cast("double") + 1.0) * F.lit(float(all_t + buckets))))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, grams: int = 1, buckets: int = 10_000, seed: str = "2024", percent: int = 10, least_words: int = 20, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text"
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document.

    Words are runs of ASCII digits and letters, lower-cased, and of all characters beyond ASCII. weight sums the gains
    of a document's features; score adds noise drawn from seed and doc_id, so that the highest scores are a sample
    without replacement. rank numbers the drawn ones from 1, highest score first, ties to the smaller doc_id; it is
    null for the others. Of the N documents with least_words or more, floor(percent*N/100) are drawn. Null texts have
    no features; null ids draw their noise from the seed alone and come before other ids in ties; repeated rows count
    as documents of their own; an empty target still gives gains, an empty corpus no rows; further columns, whatever
    their names, are left out.
    """
    bounded_batches(docs.sparkSession)
    raw = lambda df, i, t: df.select(i.alias("doc_id"), F.coalesce(F.col(t).cast("binary"), F.lit(b"")).alias("text"))
    # Written once: totals and contributions are read from the same lists, under the same keys.
    corpus = written(postings(raw(docs, F.col(id_col), text_col), grams, buckets), "postings")
    wanted = postings(raw(target, F.lit(None).cast("int"), target_col), grams, buckets)
    total = lambda df, name: df.where("bucket is not null").groupBy("bucket").agg(F.sum("total").alias(name))
    both = total(corpus, "s").join(total(wanted, "t"), "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    both = written(both, "bucket-totals")  # one row for each bucket
    all_s, all_t = both.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    lists = corpus.where("bucket is not null").select("bucket", "keys", "counts")
    gains = both.select("bucket", gain(F.col("s"), F.col("t"), all_s, all_t, buckets).alias("gain"))
    met = lists.join(gains.hint("shuffle_hash"), "bucket")
    each = met.select("gain", F.inline(F.arrays_zip("keys", "counts")))
    weights = each.groupBy(F.col("keys").alias("key")).agg(F.sum(F.col("gain") * F.col("counts")).alias("weight"))
    rows = corpus.where("bucket is null").select(F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("ids").alias("doc_id"), F.col("words").alias("n_words"))))
    runs = sum((F.greatest(F.col("n_words") - k, F.lit(0)) for k in range(1, grams)), F.col("n_words"))
    rows = rows.join(weights, "key", "left").withColumn("weight", F.coalesce("weight", F.lit(0))).withColumn("n_features", runs)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    rows = rows.withColumn("score", F.col("weight") + noise).withColumn("early", (F.col("n_words") < least_words).cast("int"))
    placed = numbered(rows, ["early", F.desc("score"), "doc_id", "key"], "place")
    draw = percent * placed.where("early = 0").count() // 100
    rank = F.when((F.col("early") == 0) & (F.col("place") < draw), F.col("place") + 1)
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
