"""Neighbours, repeated passages, near copies, url classes and the pipeline, against brute force."""

import unicodedata
from collections import Counter, defaultdict
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from conftest import SF
from tablespark.llm import ann, near_dups, queries, suffix_dedup, url_filter, word_hash
from tablespark.llm.components import connected_components


def test_ann_recall_and_order(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = {r["vec_id"]: np.array(r["embedding"], dtype=np.float64) for r in df.select("vec_id", "embedding").collect() if r["embedding"]}
    ids = np.array(sorted(rows))
    x = np.stack([rows[i] for i in ids])
    got = defaultdict(list)
    for r in queries.op1_ann(spark, "/root/testdata/sf0.01").orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == {i for i in ids if i % 20 == 0}
    hit = total = 0
    for q, found in got.items():
        score = x @ rows[q]
        order = [i for i in ids[np.lexsort((ids, -score))] if i != q][:20]
        hit, total = hit + len({i for i, _ in found} & set(order)), total + len(order)
        assert found == sorted(found, key=lambda f: (-f[1], f[0])) and len(found) == 20 and q not in {i for i, _ in found}
        assert all(abs(s - float((rows[i] * rows[q]).sum())) < 1e-9 for i, s in found)
    assert hit / total >= 0.9


def test_ann_edges(spark):
    v = [1.0, 0.0]
    rows = [(0, v, "a"), (1, v, "b"), (2, v, "c"), (3, None, "d"), (4, [0.0, 0.0], "e"), (5, [float("nan"), 1.0], "f"), (6, [None, 1.0], "g"), (7, [0.5, 0.5], "h"), (20, [0.0, 2.0], "i"), (None, v, "j"), (40, [1.0], "k"), (7, [0.5, 0.5], "h")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cls string")
    got = ann.nearest(df, df.vec_id % 20 == 0, k=3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 7, 0.5), (20, 1, 7, 1.0), (20, 2, 0, 0.0), (20, 3, 1, 0.0)]
    assert ann.nearest(df.where("false"), df.vec_id % 20 == 0).count() == 0
    assert ann.nearest(df.where("vec_id = 20"), df.vec_id % 20 == 0).count() == 0


def removed_by_brute_force(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(bytes(b for b, g in zip(t, gone) if not g))
    return out


def test_repeats_agree_with_brute_force_on_the_table(spark):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    seen: Counter = Counter()
    for t in texts.values():
        seen.update(hash(t[i : i + 400]) for i in range(len(t) - 399))
    for r in suffix_dedup.remove_repeats(spark.read.parquet(f"{SF}/documents.parquet")).collect():
        t, gone = texts[r["doc_id"]], np.zeros(len(texts[r["doc_id"]]), dtype=bool)
        for i in range(len(t) - 399):
            if seen[hash(t[i : i + 400])] > 1:
                gone[i : i + 400] = True
        assert bytes(r["kept"]) == np.frombuffer(t, np.uint8)[~gone].tobytes() and r["n_removed"] == gone.sum()


@pytest.mark.parametrize("together, part", [(300, 1000), (2, 1000), (300, 2)])
def test_repeats_of_random_texts(spark, monkeypatch, together, part):
    monkeypatch.setattr(suffix_dedup, "PART", part)
    rng = np.random.default_rng(together)
    phrases = ["".join(rng.choice(list("abc "), size=int(rng.integers(20, 90)))) for _ in range(8)]
    texts = ["".join(phrases[i] if rng.random() < 0.8 else "".join(rng.choice(list("abcdé "), size=30)) for i in rng.integers(0, 8, size=int(rng.integers(1, 12)))) for _ in range(60)]
    texts += ["", None, "ab" * 200, texts[0], texts[1], "x" * 300]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, kh int")
    rows = df.selectExpr("doc_id", "coalesce(text, '') AS text")
    keyed = rows.selectExpr("doc_id AS kh", "0 AS kg", "cast(text AS binary) AS content").where("length(content) >= 40")
    spans = defaultdict(list)
    for r in suffix_dedup.repeat_spans(keyed, 40, 16, together).collect():
        spans[r["kh"]].append((r["first"], r["windows"]))
    want = removed_by_brute_force([(t or "").encode() for t in texts], 40)
    for i, t in enumerate(texts):
        data = (t or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for first, windows in spans[i]:
            gone[first : first + windows - 1 + 40] = True
        assert bytes(b for b, g in zip(data, gone) if not g) == want[i], i


def test_rounds_of_crowded_seeds_are_not_left_to_one_query(spark):
    rng = np.random.default_rng(7)
    core = "".join(rng.choice(list("abcdefgh"), size=40))
    texts = ["".join(rng.choice(list("ijklmnop"), size=30)) + core + "".join(rng.choice(list("qrstuvwx"), size=30)) for _ in range(40)]
    texts += [texts[0], texts[1][5:]]
    keyed = spark.createDataFrame([(i, 0, bytearray(t.encode())) for i, t in enumerate(texts)], "kh long, kg int, content binary")
    spans = suffix_dedup.repeat_spans(keyed, 40, 16, 2)
    plan = spans._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") >= 8  # several rounds
    assert "MapInArrow" not in plan and plan.count("Join") == 0, plan
    found = defaultdict(list)
    for r in spans.collect():
        found[r["kh"]].append((r["first"], r["windows"]))
    want = removed_by_brute_force([t.encode() for t in texts], 40)
    for i, t in enumerate(texts):
        gone = {b for first, windows in found[i] for b in range(first, first + windows - 1 + 40)}
        assert "".join(c for b, c in enumerate(t) if b not in gone).encode() == want[i], i


def test_two_stage_order():
    rng = np.random.default_rng(1)
    for _ in range(50):
        t = bytes(rng.integers(97, 100, size=int(rng.integers(1, 80))).astype(np.uint8))
        assert suffix_dedup.suffix_order(t, len(t)).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def test_order_of_some_suffixes_sorts_no_others():
    """Wanted suffixes alone, and one more for each run of them at most, are sorted by their bytes."""

    class Counted(bytes):
        read = 0

        def __getitem__(self, at):
            if isinstance(at, slice):
                Counted.read += 1
            return super().__getitem__(at)

    rng = np.random.default_rng(2)
    for _ in range(300):
        t = bytes(rng.integers(97, 97 + int(rng.integers(1, 5)), size=int(rng.integers(1, 90))).astype(np.uint8))
        starts = np.repeat(rng.random(30) < 0.3, 3)[: len(t)]
        Counted.read = 0
        order = suffix_dedup.suffix_order(Counted(t), len(t), starts).tolist()
        assert order == sorted(np.flatnonzero(starts).tolist(), key=lambda i: t[i:])
        assert Counted.read <= starts.sum() + (np.diff(starts.astype(int), prepend=0) == 1).sum()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i, *row[1:]], row
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
    return row[-1]


def test_banded_distance():
    rng = np.random.default_rng(2)
    for _ in range(500):
        a = rng.integers(0, 6, size=int(rng.integers(0, 40))).tolist()
        b = list(a) if rng.random() < 0.7 else rng.integers(0, 6, size=int(rng.integers(0, 40))).tolist()
        for _ in range(int(rng.integers(0, 6))):
            at = int(rng.integers(0, len(b) + 1))
            b[at : at + int(rng.integers(0, 2))] = [int(rng.integers(0, 6))] * int(rng.integers(0, 2))
        band = int(rng.integers(0, 12))
        assert near_dups.banded_distance(a, b, band) == min(distance(a, b), band + 1)


WORD_TEXTS = ["", "plain Words 12", "“quoted”—dash…end don’t", "表格 数据abc中文", "กขค ไทย", "हिन्दी शब्द", "naïve café Ünï x²", "🙂🙂 a🙂b", "ひらカナ、漢字。", "Привет, мир!", "e\u0301cole", "a" * 300, "𠀀𠀁 x"]


@pytest.mark.parametrize("cut", [1 << 19, 4])
def test_words_of_all_scripts(monkeypatch, cut):
    monkeypatch.setattr(word_hash, "SLICE", cut)

    def words(text):
        out, run = [], ""
        for c in text + " ":
            part, alone = unicodedata.category(c)[0] in "LNM", any(a <= ord(c) <= b for a, b in word_hash.UNSPACED)
            if run and (alone or not part):
                out, run = [*out, run], ""
            if part and alone:
                out.append(c)
            elif part:
                run += c
        return out

    hashes, ends = word_hash.word_hashes(*word_hash.column_bytes(pa.array(WORD_TEXTS)))
    want = [words(t) for t in WORD_TEXTS]
    assert np.diff(ends).tolist() == [len(w) for w in want]
    of = {}
    assert all(of.setdefault(w, h) == h for w, h in zip([w for ws in want for w in ws], hashes.tolist())) and len(set(of.values())) == len(of)


def test_words_of_broken_bytes():
    data = pa.array([b"ab\xffcd", b"\xe8\xa1", b"\xa8 x", b"\xc3"], pa.binary())
    assert np.diff(word_hash.word_hashes(*word_hash.column_bytes(data))[1]).tolist() == [2, 0, 1, 0]


def test_near_copies_without_spaces(spark):
    rng = np.random.default_rng(3)
    one = "".join(map(chr, rng.integers(0x4E00, 0x9F00, 138)))
    two = one[:40] + "文" + one[41:90] + "字" + one[91:]
    quoted = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"], 60)) for _ in range(2)]
    texts = [one, two, "".join(map(chr, rng.integers(0x4E00, 0x9F00, 138))), quoted[0], f"“{quoted[0]}”".replace(" alpha ", "—alpha—"), quoted[1]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cls = {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicates(df).collect()}
    assert cls[0] == cls[1] and cls[3] == cls[4] and len(set(cls.values())) == 4


def test_near_copies(spark):
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefgh"), size=6))
    base = [[word() for _ in range(120)] for _ in range(12)]
    rows, want = [], {}
    for g, words in enumerate(base):
        for n in range(1 + 5 * (g % 2) + 40 * (g == 3)):
            text = list(words)
            for _ in range(3 * (n > 0)):
                text[int(rng.integers(0, 120))] = word()
            want[len(rows)] = g
            rows.append((len(rows), " ".join(text), n))
    shuffled = list(base[0])
    rng.shuffle(shuffled)  # the same words in another order are another text
    want[len(rows)] = "shuffled"
    rows += [(len(rows), " ".join(shuffled), 0), (len(rows) + 1, None, 0), (len(rows) + 2, None, 0), (len(rows) + 3, "", 0), (len(rows) + 4, "", 0), (len(rows) + 5, "one two", 0), (len(rows) + 6, "one two", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node long")
    got = {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    groups = defaultdict(set)
    for i, g in want.items():
        groups[g].add(got[i])
    assert all(len(c) == 1 for c in groups.values()) and len(set.union(*groups.values())) == len(groups)
    n = len(rows)
    assert got[n - 6] != got[n - 5] and got[n - 4] == got[n - 3] and got[n - 2] == got[n - 1]
    kept = near_dups.keep_one(df)
    assert kept.columns == df.columns and kept.count() == len(groups) + 2 + 1 + 1
    assert near_dups.near_duplicates(df.where("false")).count() == 0


def classes_by_brute_force(texts, least=near_dups.SIMILARITY):
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    codes = [[hash(w) for w in t.split()] for t in texts]
    for i in range(len(codes)):
        for j in range(i):
            if root(i) != root(j) and near_dups.edit_similarity(codes[i], codes[j], least):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(codes))]


def test_large_buckets_keep_stars_and_chains(spark, monkeypatch):
    """All texts share a passage, so all buckets are large; copies are close to their base or version, not to a pivot."""
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefgh"), size=6))
    passage, texts = [word() for _ in range(50)], []

    def changed(words, n):
        words = list(words)
        for at in rng.choice(len(words) // 5, size=n // 5, replace=False):
            words[at * 5 : at * 5 + 5] = [word() for _ in range(5)]
        return words

    star = [word() for _ in range(100)]
    texts += [passage + star] + [passage + changed(star, 20) for _ in range(150)]
    version = [word() for _ in range(100)]
    for _ in range(80):
        texts.append(passage + version)
        version = changed(version, 20)
    texts += [passage + [word() for _ in range(100)] for _ in range(60)]
    texts = [" ".join(texts[i]) for i in rng.permutation(len(texts))]
    want = classes_by_brute_force(texts)
    assert len(set(want)) == 62
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == want
    monkeypatch.setattr(near_dups, "BLOCK", 100)
    got = {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("block", [2048, 7])
def test_blocks_hold_each_needed_pair_once(spark, monkeypatch, block):
    """Pairs of a bucket with a minor text, in the same class of lengths or in adjoining ones; two rows for each text if parts are large enough."""
    monkeypatch.setattr(near_dups, "BLOCK", block)
    rng = np.random.default_rng(5)
    texts = [(f"b{i % 2}".encode(), f"{i:04d}".encode(), (f"{i:04d}" if i % 3 else "main").encode(), bool(i % 3), [int(w) for w in rng.integers(0, 1 << 31, size=rng.integers(10, 60))]) for i in range(400)]
    split = spark.createDataFrame([t[:4] for t in texts], "main binary, node binary, piece binary, minor boolean")
    words = spark.createDataFrame([(t[1], t[4]) for t in texts], "node binary, words array<int>")
    size = {t[1]: int(np.floor(np.log(len(t[4])) / np.log(1.26))) for t in texts}
    needed = {(x[1], y[1]) for x in texts for y in texts if x[1] < y[1] and x[0] == y[0] and (x[3] or y[3]) and abs(size[x[1]] - size[y[1]]) <= 1}
    found, sent = Counter(), 0
    for (members,) in near_dups._blocks(split, words).collect():
        sent += len(members)
        for u in (m for m in members if m["left"]):
            for v in (m for m in members if m["right"]):
                if u["node"] != v["node"] and (u["low"] or v["low"]) and (not u["minor"] or u["node"] < v["node"]):
                    found[tuple(sorted((bytes(u["node"]), bytes(v["node"]))))] += 1
    assert set(found) == needed and set(found.values()) == {1}
    assert block < 2048 or sent <= 2 * len(texts)


@pytest.mark.parametrize("length", [5, 9, 10, 12, 20, 40, 45, 50, 60, 200, 600])
def test_sketches_find_pairs_at_the_similarity(length):
    """Scattered edits up to 0.8: at least 0.98 of the pairs agree in a sketch value."""
    rng = np.random.default_rng(length)
    found = 0
    for _ in range(200):
        a = rng.integers(1, 1 << 63, size=length, dtype=np.uint64)
        b, edits = a.copy(), length // 5
        b[rng.choice(length, size=edits, replace=False)] = rng.integers(1, 1 << 63, size=edits, dtype=np.uint64)
        if rng.random() < 0.5:  # words that are gone rather than changed, so the lengths differ
            b = a[np.isin(a, b)]
        values, at = near_dups.sketches_of(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        found += bool(set(values[: at[1]].tolist()) & set(values[at[1] :].tolist()))
    assert found >= 196


def test_near_copies_of_the_table(spark):
    """No link that brute force over all pairs finds is lost, and none is made up."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r["text"]]
    import re

    words = {i: re.findall(r"[^\W_]+", t.lower()) for i, t in docs}
    got = {r["doc_id"]: r["class_id"] for r in queries.op6_near_dups(spark, SF).collect()}
    ids = [i for i, _ in docs if len(words[i]) >= 30]
    sets = {i: Counter(words[i]) for i in ids}
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = words[i], words[j]
            if min(len(a), len(b)) < 0.8 * max(len(a), len(b)) or sum((sets[i] & sets[j]).values()) < 0.8 * max(len(a), len(b)):
                continue
            similar = near_dups.edit_similarity([hash(w) for w in a], [hash(w) for w in b], 0.85)
            assert not similar or got[i] == got[j], (i, j, similar)


def test_components(spark):
    rng = np.random.default_rng(9)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, size=(220, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    parent = {}

    def root(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame([*edges, (None, 5), (7, None)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert got == {a: root(a) for a in parent}
    assert connected_components(df.where("false")).count() == 0


def plain_verdict(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut].lower(), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h + p), h + p, k) for k, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def test_url_rules(spark):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    for r in queries.op7_url_filter(spark, "/root/testdata/sf0.01").collect():
        host, path, rule, verdict = plain_verdict(pages[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
        assert not pages[r["page_id"]] or host == (urlsplit(pages[r["page_id"]]).netloc.lower())


def test_url_classes(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://bad.test/a", ""), (2, "http://alias.test/x", link.format("http://bad.test/a")), (3, "http://alias2.test/y", '<meta http-equiv="refresh" content="0; url=http://alias.test/x">'),
        (4, "https://www.free.test/", link.format("http://good.test/b")), (5, "http://good.test/b", ""), (6, "http://other.test/", ""), (7, None, None), (8, "no scheme", ""),
        (9, "http://both.test/1", link.format("http://bad.test/a2")), (10, "http://bad.test/a2", link.format("http://good.test/c")), (6, "http://other.test/", ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS node")
    got = url_filter.filter_urls(df, [("block", "bad.test", "/"), ("allow", "good.test", "/")]).collect()
    by = {r["page_id"]: r["verdict"] for r in got}
    assert by == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "allow", 10: "block"} and len(got) == len(rows)
    assert url_filter.filter_urls(df.where("false"), []).count() == 0


def test_relative_links_and_urls_without_a_scheme(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://x.test/a/b/c.html", link.format("../bad/p.html")), (2, "http://x.test/a/q", link.format("bad/p.html")), (3, "http://y.test/z", link.format("//x.test/a/bad/p.html")),
        (4, "http://x.test/a/bad/p.html?p=1", link.format("?p=2")), (5, "http://w.test/", link.format("./v")), (6, "http://w.test/v", link.format("http://x.test/a/bad/p.html")),
        (7, None, link.format("http://x.test/a/bad/p.html")), (8, "no scheme", link.format("http://x.test/a/bad/p.html")), (9, "also none", ""), (10, "http://u.test/", link.format("mailto:x@x.test")),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    by = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(df, [("block", "x.test", "/a/bad/")]).collect()}
    assert by == {i: "allow" if i >= 7 else "block" for i in range(1, 11)}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        at[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(t for t in at["language"].values()) and set(at["near_copies"]) <= set(at["language"])
    assert set(at["passages"]) == set(at["near_copies"]) == set(at["personal_data"])
    assert len(set(at["near_copies"].values())) == len(at["near_copies"])  # no exact copies are left
    before = {i: t.encode() for i, t in at["near_copies"].items()}
    want = dict(zip(before, removed_by_brute_force(before.values(), queries.REPORTED)))
    for i, left in want.items():  # characters cut in two go
        assert at["passages"][i] == (at["near_copies"][i] if left == before[i] else left.decode(errors="replace").replace("\ufffd", "")), i
    assert any(left != before[i] for i, left in want.items())
    pieces = defaultdict(dict)
    for r in corpus_pipeline.run(spark, SF).collect():
        pieces[r["doc_id"]][r["start"]] = np.frombuffer(r["ids"], dtype="<u4").tolist()
    library = Tokenizer.from_file(corpus_pipeline.tokenizer_file("word_bpe_49k.json"))
    assert {i: [x for start in sorted(p) for x in p[start]] for i, p in pieces.items()} == {i: [*library.encode(t, add_special_tokens=False).ids, 2] for i, t in at["personal_data"].items()}


def test_longest_run_and_windows_inside_reported_runs(spark):
    """Windows looked for in runs of shorter repeats alone are the same as those of the whole texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    plain = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs, 400).drop("kept").collect()}
    found = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs, 400, report=240).drop("kept").collect()}
    assert {i: (r["n_removed"], r["spans"]) for i, r in plain.items()} == {i: (r["n_removed"], r["spans"]) for i, r in found.items()}
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    seen = Counter(t[a : a + 240] for t in texts.values() for a in range(len(t) - 239))
    for i, t in texts.items():
        best = run = 0
        for a in range(len(t) - 239):
            run = run + 1 if seen[t[a : a + 240]] > 1 else 0
            best = max(best, run and run + 239)
        assert found[i]["longest_run"] == best
    assert suffix_dedup.remove_repeats(docs.where("false"), report=240).count() == 0
