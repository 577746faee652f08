"""Whitening, best-fit packing and importance resampling: against exact arithmetic, item-by-item packing and plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from public_tokenizers import path as tokenizer_file
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SF
from tablespark.llm import best_fit, language_id, queries, resampling, url_filter, whitening

AWKWARD = [
    (1, ""), (2, None), (3, "   \n\n  "), (4, "Ünïcödé ﬁ ½ — “quotes” 表格 🙂🙂 don't we'll I'M"), (5, "a" * 5000), (6, "word " * 9000), (7, "tab\t\tnew\r\nline  two   three\n\n\n"),
    (7, "tab\t\tnew\r\nline  two   three\n\n\n"), (8, "<|endoftext|> middle <|endoftext|>"), (9, "\x00\x01\x7f\u0085  x"), (10, "12345 67,890.12 0x1F"), (None, "no id " * 30), (None, None),
]


@pytest.fixture(scope="module")
def awkward(spark):
    """Texts of every kind, with columns whose names the operators use themselves."""
    rows = [(i, t, n, n, "x") for n, (i, t) in enumerate(AWKWARD)]
    return spark.createDataFrame(rows, "doc_id long, text string, key long, length long, bucket string")


# Whitening.
def plain_whitening(rows, factor=256, k=4):
    """By whole numbers: exact sums, exact covariance."""
    fine = [(i, [math.floor(float(c) * factor) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in fine})
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    centred = np.array([[n * x[j] - s[j] for j in range(d)] for x in fit], dtype=object)
    cov = centred.T @ centred
    v = np.array([[float(Fraction(int(c), n**3)) for c in row] for row in cov])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    trace = sum(Fraction(int(cov[j][j]), n**3) for j in range(d))
    out = {}
    for i, x in fine:
        dev = [n * a - b for a, b in zip(x, s)]
        out[i] = sum(a * a for a in dev), [float(np.dot(np.array(dev, float), u[:, c]) / n / math.sqrt(e[c])) for c in range(min(k, d)) if e[c] > 0]
    return out, n, [float(e[c] / float(trace)) for c in range(min(k, d))]


def test_pairs_are_exact():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(-(1 << 62), 1 << 62, size=(300, 3)), rng.integers(-9, 9, size=(300, 3)), np.array([[-(1 << 63), (1 << 63) - 1, 0]])])
    exact = [Fraction(int(x[:, j].astype(object).sum()), len(x)) for j in range(3)]
    high = np.array([float(m) for m in exact])
    mean = high, np.array([float(m - Fraction(h)) for m, h in zip(exact, high.tolist())])
    sums = whitening.outer_sums(x, mean, whitening.outer_sums(x[:0], mean, None) or None)
    for i in range(3):
        for j in range(i, 3):
            want = sum((int(r[i]) - exact[i]) * (int(r[j]) - exact[j]) for r in x)
            scale = sum(abs((int(r[i]) - exact[i]) * (int(r[j]) - exact[j])) for r in x)
            got = Fraction(float(sums[i][0][j - i])) + Fraction(float(sums[i][1][j - i]))
            assert abs(got - want) <= scale / 10**26
    # Where plain doubles lose all digits: a large mean and variances of single units.
    near = (1 << 53) + rng.integers(0, 3, size=(4000, 2))
    exact = [Fraction(int(near[:, j].astype(object).sum()), len(near)) for j in range(2)]
    mean = np.array([float(m) for m in exact]), np.array([float(m - Fraction(float(m))) for m in exact])
    got = whitening.outer_sums(near, mean, None)
    want = sum((int(r[0]) - exact[0]) * (int(r[1]) - exact[1]) for r in near)
    assert abs(Fraction(float(got[0][0][1])) + Fraction(float(got[0][1][1])) - want) <= Fraction(1, 10**9)


def test_whitening_of_the_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, n, shares = plain_whitening(rows)
    got = queries.op11_whitening(spark, SF).collect()
    assert len(got) == 4 * len(want) and {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-12
    signs = {}
    for r in got:
        dev, white = want[r["vec_id"]]
        w = white[r["component"] - 1]
        assert r["deviation"] == dev and r["explained"] == pytest.approx(shares[r["component"] - 1], rel=1e-12)
        sign = signs.setdefault(r["component"], math.copysign(1, w * r["whitened"]))
        assert r["whitened"] == pytest.approx(sign * w, rel=1e-9, abs=1e-11)


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(1)
    fine = [(i, rng.normal(size=6).tolist()) for i in range(40)]
    odd = [(100, None), (101, []), (102, [1.0, None, 0, 0, 0, 0]), (103, [nan] * 6), (104, [0, 0, inf, 0, 0, 0]), (105, [1.0, 2.0]), (106, [-0.0] * 6)]
    copies = [fine[3]] * 500 + [(None, fine[4][1])]
    df = spark.createDataFrame([(i, v and [None if c is None else float(c) for c in v], i, 0) for i, v in fine + odd + copies], "vec_id long, embedding array<double>, x long, w int")
    got = whitening.whiten(df).collect()
    want, n, _ = plain_whitening([*fine, odd[-1]])
    assert n == 41 and {r["n"] for r in got} == {n} and len(got) == 4 * (41 + 501)
    assert sum(r["vec_id"] == 3 for r in got) == 4 * 501 and sum(r["vec_id"] is None for r in got) == 4
    assert {r["vec_id"] for r in got} == {*range(40), 106, None}
    assert all(r["deviation"] == want[4 if r["vec_id"] is None else r["vec_id"]][0] for r in got)
    assert whitening.whiten(df.where("vec_id >= 100 and vec_id < 106 and vec_id <> 105")).count() == 0
    one = whitening.whiten(df.where("vec_id = 3")).collect()
    assert {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one} == {(1, 0, None, None, None)} and len(one) == 4 * 501
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)], "vec_id long, embedding array<float>")
    flat = whitening.whiten(line).collect()
    assert [r["whitened"] is None for r in sorted(flat)][:2] == [False, True] and flat[0]["identity_error"] < 1e-12
    far = spark.createDataFrame([(0, [3e16, 0.0]), (1, [-3e16, 1.0]), (2, [1e300, 0.0])], "vec_id long, embedding array<double>")
    assert {r["deviation"] for r in whitening.whiten(far).collect()} == {None}


# Best fit.
def plain_best_fit(counts, window):
    rooms = []
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            fit = min((r for r in rooms if r >= n), default=None)
            if fit is None:
                rooms.append(window - n)
            else:
                rooms.remove(fit)
                rooms.append(fit - n)
    return sorted(rooms)


def held(slots, counts, window):
    """Every planned place, checked to be gapless; the rooms left."""
    places = defaultdict(list)
    for n, c in counts.items():
        sequence, offset = slots.at(np.full(c, n), np.arange(c))
        for s, o in zip(sequence.tolist(), offset.tolist()):
            places[s].append((o, n))
    for p in places.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
        assert at <= window
    assert sorted(places) == list(range(slots.sequences))
    return sorted(window - sum(n for _, n in p) for p in places.values())


def test_plan_is_best_fit():
    rng = np.random.default_rng(11)
    for trial in range(60):
        window = int(rng.integers(1, 200))
        lengths = rng.integers(1, window + 1, size=int(rng.integers(0, 60)))
        counts = {int(n): int(rng.integers(1, 30)) for n in lengths}
        assert held(best_fit.plan_best_fit(counts, window), counts, window) == plain_best_fit(counts, window)
    many = {n: 10**10 + n for n in range(1, 4097)}
    slots = best_fit.plan_best_fit(many, 4096)
    total = sum(n * c for n, c in many.items())
    assert len(slots.first) < 100_000 and total <= slots.sequences * 4096 < total * 1.001


def packed_right(pieces, docs, end=1, window=4096):
    tok = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    tok.no_truncation(), tok.no_padding()
    want = Counter((r["doc_id"], np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, end], "<u4").tobytes()) for r in docs)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["start"] == r["piece"] * window and r["length"] == len(r["ids"]) // 4 <= window
    for q in by_sequence.values():
        at = 0
        for o, n in sorted(q):
            assert o == at
            at += n
        assert at <= window
    single = {d: p for d, p in by_doc.items() if sum(k[0] == d for k in want) == 1 and sum(n for k, n in want.items() if k[0] == d) == 1}
    for d, p in single.items():
        assert (d, b"".join(bytes(r["ids"]) for r in sorted(p, key=lambda r: r["piece"]))) in want
        assert all(r["length"] == window for r in sorted(p, key=lambda r: r["piece"])[:-1])
    assert Counter(b"".join(sorted(bytes(r["ids"]) for r in pieces))).total() == sum(len(k[1]) * n for k, n in want.items())
    lengths = Counter()
    for (_, ids), n in want.items():
        whole, rest = divmod(len(ids) // 4, window)
        lengths[window] += whole * n
        lengths[rest] += n if rest else 0
    assert len(by_sequence) == len(plain_best_fit({k: v for k, v in lengths.items() if v}, window))
    return len(single)


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_best_fit_of_texts(spark, awkward, monkeypatch, sent):
    monkeypatch.setattr(best_fit, "SENT", sent)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text").unionByName(awkward.select("doc_id", "text"))
    pieces = best_fit.pack_best_fit(docs.repartition(6), tokenizer_file("word_bpe_49k.json")).collect()
    assert packed_right(pieces, docs.collect()) > 200
    whole = best_fit.pack_best_fit(awkward, tokenizer_file("word_bpe_49k.json")).collect()
    assert sum(r["piece"] == 0 for r in whole) == len(AWKWARD)
    assert best_fit.pack_best_fit(awkward.where("false"), tokenizer_file("word_bpe_49k.json")).collect() == []


# Resampling.
def plain_resampling(docs, target, grams, buckets, percent=10, least=20):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    def features(t):
        w = words(t)
        return [" ".join(w[i : i + k]) for k in range(1, grams + 1) for i in range(len(w) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in docs for f in features(x)), Counter(bucket(f) for x in target for f in features(x))
    all_s, all_t = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    rows = []
    for i, x in docs:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in features(x))
        rows.append((i, len(features(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x))))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    return sorted(((*r[:4], able.index(r) + 1 if r in able and able.index(r) < percent * len(able) // 100 else None) for r in rows), key=str)


@pytest.mark.parametrize(("grams", "buckets", "heldup"), [(1, 10_000, 1 << 20), (2, 97, 5), (3, 1, 300)])
def test_resampling(spark, awkward, monkeypatch, grams, buckets, heldup):
    monkeypatch.setattr(resampling, "HELD", heldup)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text").unionByName(awkward.select("doc_id", "text").distinct())
    target = spark.read.parquet(f"{SF}/benchmark.parquet").unionByName(spark.createDataFrame([(None, None), (9, "")], "item_id long, text string"))
    got = resampling.resample(docs.repartition(5), target, grams, buckets)
    assert [t for _, t in got.dtypes] == ["bigint"] * 5
    want = plain_resampling([tuple(r) for r in docs.collect()], [r["text"] for r in target.collect()], grams, buckets)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_resampling_of_little(spark, awkward):
    none = spark.createDataFrame([], "item_id long, text string")
    got = {r["doc_id"]: r for r in resampling.resample(awkward, none).collect()}
    assert got[1]["n_features"] == got[2]["weight"] == 0 and got[6]["n_features"] == 9000
    assert resampling.resample(awkward, none).count() == len(AWKWARD)
    assert resampling.resample(awkward.where("false"), none).collect() == []
    twice = spark.createDataFrame([(1, "a b c " * 8)] * 40, "doc_id long, text string")
    assert sorted(r["rank"] for r in resampling.resample(twice, none).collect() if r["rank"]) == [1, 2, 3, 4]


# Earlier operators, mended.
def test_copies_leave_languages_their_centroids(spark):
    words = {"de": "der die und nicht schön über Haus Straße mit auf", "en": "the and with house street over not nice upon from"}
    rows = [(f"{w} {i} " + " ".join(x.split()[i % 7 :]), lang) for lang, x in words.items() for i, w in enumerate(x.split() * 30)]
    copies = spark.range(100_000).select(F.lit("immer der gleiche Text und nichts sonst").alias("text"), F.lit("de").alias("lang"))
    model = language_id.fit_language_model(spark.createDataFrame(rows, "text string, lang string").unionByName(copies))
    assert model.langs == ["de"] * 4 + ["en"] * 4
    many = spark.createDataFrame([(f"{'abcdefghij'[i % 10] * 3} {t} {i}", f"l{i:03}") for i in range(50) for t in ("ab", "cd", "ef", None)], "text string, lang string")
    few = language_id.fit_language_model(many, total=60)
    assert 30 <= len(set(few.langs)) <= 50 and len(few.langs) <= 150


def test_character_references_in_links(spark):
    cases = {"?a=1&amp;b=2": "?a=1&b=2", "&#x61;&#98;&#0038;": "ab&", "&amp;lt;": "&lt;", "a&b&bogus;&": "a&b&bogus;&", "&#xD800;&#99999;&#x1F600;": "&#xD800;&#99999;&#x1F600;", "": "", "&quot;&apos;&#233;": "\"'é"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["d"] for r in df.select("t", url_filter.decoded(F.col("t")).alias("d")).collect()} == cases
    link = '<link rel="canonical" href="{}">'
    rows = [(1, "http://x.test/q", link.format("http://mid.test/z?a=1&amp;b=2")), (2, "http://mid.test/z?a=1&b=2", link.format("http://bad.test/")), (3, "http://x.test/r", link.format("http://mid.test/z?a=1&b=3"))]
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id int, url string, html string"), [("block", "bad.test", "/")]).collect()
    assert {r["page_id"]: r["verdict"] for r in got} == {1: "block", 2: "block", 3: "allow"}
