"""Language, BPE, packing, media, PII, toxicity: against the libraries, round trips, brute force, held-out labels."""

import hashlib
import re
import zlib
from collections import defaultdict
from ipaddress import ip_address

import numpy as np
import pytest
from public_tokenizers import path as tokenizer_file
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SF
from tablespark.llm import bpe, language_id, media, packing, pii, queries, toxicity

AWKWARD = [
    (1, ""), (2, None), (3, "   \n\n  "), (4, "Ünïcödé ﬁ ½ — “quotes” 表格 🙂🙂 don't we'll I'M"), (5, "a" * 5000), (6, "word " * 9000), (7, "tab\t\tnew\r\nline  two   three\n\n\n"),
    (7, "tab\t\tnew\r\nline  two   three\n\n\n"), (8, "<|endoftext|> middle <|endoftext|>"), (9, "\x00\x01\x7f\u0085  x"), (10, "12345 67,890.12 0x1F"), (None, "no id"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, "en", "s", n) for n, (i, t) in enumerate(AWKWARD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, text_ string, ids long")


def key(x):
    return tuple("" if v is None else str(v) for v in x)


def test_bpe_agrees_with_the_library(spark, awkward):
    tok = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    tok.no_truncation(), tok.no_padding()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(awkward.select("doc_id", "text"))
    got = bpe.encode_texts(docs, tokenizer_file("byte_bpe_50k.json")).collect()
    want = []
    for r in docs.collect():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], np.array(ids, "<u4").tobytes(), tok.decode(ids, skip_special_tokens=False)))
    assert sorted(map(key, want)) == sorted(key((r["doc_id"], bytes(r["ids"]), r["decoded"])) for r in got)
    assert bpe.encode_texts(docs.where("false"), tokenizer_file("byte_bpe_50k.json")).count() == 0


def test_bpe_random_words(spark):
    tok = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    enc = bpe.encoder(tokenizer_file("byte_bpe_50k.json"))
    rng = np.random.default_rng(3)
    letters = list("aeinrstlo TH'.,\n0 é表") + [" the", "ing", "tion"]
    for _ in range(400):
        text = "".join(rng.choice(letters, size=int(rng.integers(1, 60))))
        ids = tok.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == ids, repr(text)


def test_packing_holds_every_id_once(spark, awkward):
    path = tokenizer_file("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    tok.no_truncation(), tok.no_padding()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(awkward.selectExpr("-doc_id AS doc_id", "text").dropDuplicates())
    pieces = packing.pack_documents(docs, path, group=60).collect()
    of_doc, of_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"] > 0
        of_doc[p["doc_id"]].append((p["start"], bytes(p["ids"]), p["doc_tokens"]))
        of_seq[p["sequence_id"]].append((p["offset"], p["length"]))
    for r in docs.collect():
        want = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        got = sorted(of_doc[r["doc_id"]])
        assert b"".join(g[1] for g in got) == want, r["doc_id"]
        assert [g[0] for g in got] == list(np.cumsum([0, *(len(g[1]) // 4 for g in got)])[:-1]) and {g[2] for g in got} == {len(want) // 4}
    for parts in of_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096 and (at == 4096 or at & (at - 1) == 0)
    assert packing.pack_documents(docs.where("false"), path).count() == 0


def test_minimum_bin_slack_is_closest():
    rng = np.random.default_rng(5)
    for _ in range(100):
        lengths = rng.integers(1, 40, size=int(rng.integers(1, 12))).tolist()
        room = int(rng.integers(1, 120))
        counts = {n: lengths.count(n) for n in lengths}
        taken = packing.fill_closest(dict(counts), room)
        sums = {0}
        for n in lengths:
            sums |= {s + n for s in sums if s + n <= room}
        assert sum(n * k for n, k in taken.items()) == max(sums) and all(k <= counts[n] for n, k in taken.items())
        flat = [p for q in packing.pack_rests(lengths, 64) for p in q]
        assert sum(p[2] for p in flat) == sum(lengths)


def test_media_round_trip(spark, awkward):
    docs = awkward.select("doc_id", "text")
    got = media.describe_media(media.store_media(docs), keep=("n_bytes",)).collect()
    want = sorted(key((i, (t or "").encode().ljust(max(192, -(-len((t or "").encode()) // 192) * 192)))) for i, t in AWKWARD)
    assert sorted(key((r["doc_id"], bytes(r["payload"]))) for r in got) == want
    assert all(r["media_type"] == "audio/wav" and r["corrected"] for r in got)
    assert len({r["feature"] for r in got if r["doc_id"] in (1, 2)}) == 1


def _png() -> bytes:
    chunk = lambda name, data: len(data).to_bytes(4, "big") + name + data + zlib.crc32(name + data).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes([0, 0, 0, 1, 0, 0, 0, 1, 8, 0, 0, 0, 0])) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_media_sniffing_and_carving(spark):
    png, gif = _png(), b"GIF89a\x01\0\x01\0\0\0\0\x2c\0\0\0\0\x01\0\x01\0\0\x02\x02\x44\x01\0\x3b"
    wav = media.wave_bytes(b"abc" + png + b"xyz")
    broken = png[:20] + b"?" + png[21:]
    df = spark.createDataFrame([(1, png, "image/jpeg"), (2, wav, "audio/wav"), (3, broken, "image/png"), (4, b"12" + gif + png, None), (5, None, "image/png"), (6, b"", "x")], "doc_id long, media binary, declared string")
    got = {r["doc_id"]: r for r in media.describe_media(df, carve=True).collect()}
    assert (got[1]["media_type"], got[1]["corrected"]) == ("image/png", True)
    assert [bytes(c) for c in got[2]["carved"]] == [png] and bytes(got[2]["payload"]) == b"abc" + png + b"xyz"
    assert (got[3]["media_type"], got[3]["corrected"]) == ("image/png", False) and not got[3]["embedded"]
    assert [bytes(c) for c in got[4]["carved"]] == [gif, png]
    assert bytes(got[5]["payload"]) == b"" and len(got) == 6


def test_language_held_out(spark, awkward):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs.createOrReplaceTempView("docs")
    got = queries.op2_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95
    model = language_id.fit_language_model(docs)
    odd = {r["doc_id"]: r for r in language_id.identify_language(awkward, model).collect()}
    assert len(odd) == len({i for i, _ in AWKWARD}) and all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 and odd[i]["rejected"] for i in (1, 2, 3))
    assert all(0 <= r["score"] <= 1 for r in odd.values())
    assert language_id.identify_language(awkward.where("false"), model).count() == 0
    nothing = language_id.identify_language(awkward, language_id.fit_language_model(docs.where("false"))).collect()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in nothing) and {r["doc_id"] for r in nothing if r["rejected"]} == {1, 2, 3}


def test_long_texts_count_in_slices(monkeypatch):
    text = ("the quick brown fox jumps over él señor " * 50).encode()
    whole = language_id.trigram_counts([text])
    monkeypatch.setattr(language_id, "SLICE", 97)
    assert (language_id.trigram_counts([text]) == whole).all()


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    train = toxicity.sample_labels(labels.where("doc_id % 3 <> 0"))
    model = toxicity.fit_severity(docs.join(train, "doc_id"))
    got = toxicity.score_severity(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    truth = toxicity.score_severity(docs, model).join(labels.select("doc_id", labels.toxic.alias("label")).where("doc_id % 3 = 0"), "doc_id").select("toxic", "label").collect()
    assert np.mean([r["toxic"] == bool(r["label"]) for r in truth]) > 0.9 and got
    assert (np.diff(model.thresholds) > 0).all()
    same = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (3, "x")], "doc_id long, text string")
    odd = toxicity.score_severity(same, model).collect()
    assert len(odd) == 4 and len({r["expected_severity"] for r in odd if r["doc_id"] in (1, 2)}) == 1
    nothing = toxicity.score_severity(same, toxicity.fit_severity(docs.selectExpr("text", "0 AS toxic"))).collect()
    assert len(nothing) == 4 and all(r["expected_severity"] == 0 and r["grade"] == 0 and not r["toxic"] for r in nothing)


TEXTS = [
    (1, "Mail jane.doe@corp.example or JANE.DOE@corp.example now."),
    (2, "Card 4111 1111 1111 1111 and 4111-1111-1111-1111, ssn 123-45-6789."),
    (3, "Call (212) 555-0187 or +1 212-555-0187; host 192.168.10.24."),
    (4, "Herr Max Muster und Frau Erika Muster, г-жа Анна Петрова."),
    (5, "password: hunter2hunter2 token=abcdef1234567890"),
    (6, None), (7, ""), (8, "Nothing to see in 2024, page 12 of 30."), (8, "Nothing to see in 2024, page 12 of 30."),
]


def test_pii_surrogates(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in TEXTS], "doc_id long, text string, row string")
    got = pii.replace_entities(df, "k").collect()
    assert len(got) == len(TEXTS)
    by = {r["doc_id"]: r for r in got}
    for i, gone in ((1, "jane.doe"), (2, "4111 1111"), (2, "123-45-6789"), (3, "555-0187"), (3, "192.168.10.24"), (4, "Muster"), (4, "Петрова"), (5, "hunter2"), (5, "abcdef1234567890")):
        assert gone.lower() not in by[i]["text"].lower(), (i, by[i]["text"])
    mails = [w for w in by[1]["text"].rstrip(".").split() if "@" in w]
    assert len(mails) == 2 and mails[0].lower() == mails[1].lower()  # one entity, one surrogate
    cards = [c for c in by[2]["text"].replace("-", " ").replace(",", "").split("Card ")[1].split(" and ")]
    digits = [c[:19].replace(" ", "") for c in cards]
    assert digits[0] == digits[1] and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, digits[0][::-1]))) % 10 == 0
    assert by[4]["text"].startswith("Herr ") and "Frau " in by[4]["text"] and "г-жа " in by[4]["text"]
    assert by[6]["text"] is None and by[7]["text"] == "" and by[8]["text"] == TEXTS[-1][1]
    assert pii.replace_entities(df, "k").select("doc_id", "text").exceptAll(pii.replace_entities(df.repartition(3), "k").select("doc_id", "text")).count() == 0
    assert pii.replace_entities(df.where("false"), "k").count() == 0


def test_pii_keeps_entities_distinct(spark):
    df = spark.createDataFrame([(i, f"ip 11.{i % 250}.{i // 250}.7 ssn {i % 900 + 100:03d}-{i % 90 + 10}-{1000 + i}") for i in range(3000)], "doc_id long, text string")
    got = pii.replace_entities(df, "k").select("text").collect()
    for nth in (1, 3):
        assert len({r["text"].split()[nth] for r in got}) == 3000


def test_pii_of_any_length_and_form(spark):
    rng = np.random.default_rng(5)
    some = lambda letters, n: "".join(rng.choice(list(letters), size=n))
    token, hexes = some("abcXYZ019_-.", 1500), [some("0123456789abcdef", 90), some("0123456789ABCDEF", 40), some("0123456789abcdefABCDEF", 900)]
    phones = ["+49 30 1234567", "+44 20 7946 0958", "+4930123456789", "030 1234567", "01 23 45 67 89", "(0221) 4710 815"]
    names = ["Frau Anna Maria Muster", "Herr Karl Meier-Schmidt", "Dr. Otto Emil Graf-Lehn Sorge"]
    texts = [f"token={token} end", *[f"hash {h} end" for h in hexes], *[f"call {p} now" for p in phones], *[f"with {n} today" for n in names], "on 01.02.2024 and 01-02-2024"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by = {r["doc_id"]: r for r in pii.replace_entities(df, "k").collect()}
    parts = [token, *hexes, *phones]
    for i, part in enumerate(parts):
        got = by[i]["text"]
        assert by[i]["n_entities"] == 1 and len(got) == len(texts[i]) and got[-4:] == texts[i][-4:]
        assert not any(part[at : at + 9] in got for at in range(len(part) - 8)), got
    for i, n in enumerate(names, len(parts)):
        assert by[i]["n_entities"] == 1 and by[i]["text"].endswith(" today") and not set(n.replace("-", " ").split()[1:]) & set(by[i]["text"].replace("-", " ").split())
    assert by[len(texts) - 1]["text"] == texts[-1]


def test_pii_name_surrogates_never_run_out(spark, monkeypatch):
    monkeypatch.setitem(pii.SYLLABLES, "latin", ["ba", "ce"] * 8)  # 8 names of three syllables, 16 of four
    names = [a + b for a in ("Xu", "Yo", "Zi", "Wy", "Qa", "Ru") for b in ("rra", "lle", "mmi", "nno", "ttu", "sse", "ppi")]
    df = spark.createDataFrame([(i, f"Herr {n} 10.0.0.{i + 1}") for i, n in enumerate(names)], "doc_id long, text string")
    got = [r["text"].split() for r in pii.replace_entities(df, "k").collect()]
    assert len({g[1] for g in got}) == len({g[2] for g in got}) == len(names) and not {g[1] for g in got} & set(names)


def test_pii_numbers_widen_when_their_format_is_used_up(spark, monkeypatch):
    monkeypatch.setattr(pii, "_digits", lambda s: F.translate(s, pii.HEX, "01" * 8))  # 512 numbers of nine digits
    monkeypatch.setattr(pii, "WIDER", 2)
    df = spark.createDataFrame([(i, f"ssn {i // 90 + 200}-{i % 90 + 10}-{2000 + i}") for i in range(600)], "doc_id long, text string")
    got = [r["text"].split()[1].replace("-", "") for r in pii.replace_entities(df, "k").collect()]
    assert len(set(got)) == 600 and {len(g) for g in got} >= {9, 10}


def test_pii_addresses_become_longer_when_theirs_are_used_up(spark):
    df = spark.createDataFrame([("ip", "10.1.2.3", 15), ("ip", "10.1.2.3", 16), ("ipv6", "::1", 15), ("ipv6", "::1", 16)], "kind string, value string, attempt int")
    df = df.withColumn("canon", pii.canonical(F.col("kind"), F.col("value")))
    got = [ip_address(r[0]) for r in df.select(pii.surrogates(F.array(F.struct("value", "kind", "canon", "attempt")), "k")[0]).collect()]
    assert [g.version for g in got] == [4, 6, 6, 6] and int(got[2]) < 1 << 16 <= int(got[3])


def test_pii_keeps_people_and_formats(spark):
    texts = [
        "Mr Kim Lee met Mrs Kim Lee; Dr Kim Lee left.", "Mr Jo Tan and Prof Jo Tan.", "Mr Kim Anders Lee-Berg came.", "call 030 1234567, +49 30 1234567 or +49 (0)30 1234567",
        "from DE89 3704 0044 0532 0130 00 and DE89370400440532013000", "host 2001:db8::1, 2001:0DB8:0:0:0:0:0:1 and fe80::1ff:fe23:4567:890a; at 12:30:45 std::vector 00:1a:2b:3c:4d:5e",
        "marks \ufdd0 Mr Jo Tan \ufdd1 stay", "also +1 (212) 555-0187 and (212) 555-0187",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by = {r["doc_id"]: r["text"] for r in pii.replace_entities(df, "k").collect()}
    people = re.findall(r"(?:Mr|Mrs|Dr|Prof) ([^;.]*?)(?= met|;| left| and|\.| came)", by[0])
    assert len(set(people)) == 3, by[0]  # the corpus has a man and a woman of that name
    man, prof = re.findall(r"(?:Mr|Prof) (\w+ \w+)", by[1])
    assert man == prof != "Jo Tan" and man.split()[0] in pii.FIRST_NAMES["m", "latin"]
    assert re.fullmatch(r"Mr [A-Z][a-z]+ [A-Z][a-z]+ [A-Z][a-z]+-[A-Z][a-z]+ came\.", by[2]) and not re.search("Kim|Anders|Lee|Berg", by[2])
    phones = re.fullmatch(r"call 0(\d\d) (\d{7}), \+49 (\d\d) (\d{7}) or \+49 \(0\)(\d\d) (\d{7})", by[3]).groups()
    assert phones[:2] == phones[2:4] == phones[4:] != ("30", "1234567")
    spaced, plain = re.fullmatch(r"from (DE\d\d(?: \d{4}){4} \d\d) and (DE\d{20})", by[4]).groups()
    assert spaced.replace(" ", "") == plain != "DE89370400440532013000"
    hosts = re.fullmatch(r"host ([^,]+), (\S+) and (\S+); at 12:30:45 std::vector 00:1a:2b:3c:4d:5e", by[5]).groups()
    assert ip_address(hosts[0]) == ip_address(hosts[1]) != ip_address("2001:db8::1") and hosts[1].isupper() and hosts[2].count(":") == 5
    assert by[6] == f"marks \ufdd0 Mr {man} \ufdd1 stay"
    abroad, home = re.fullmatch(r"also \+1 (\(\d{3}\) \d{3}-\d{4}) and (.*)", by[7]).groups()
    assert abroad == home


def test_pii_surrogates_have_one_canonical_form(spark):
    """All spellings of an entity get surrogates of one canonical form at every attempt, so one spelling may stand for all."""
    same = [
        ("phone", "030 1234567", "+49 30 1234567"), ("ipv6", "2001:db8::1", "2001:0DB8:0:0:0:0:0:1"), ("ipv6", "1::2", "0001:0::0:2"), ("iban", "DE89 3704 0044 0532 0130 00", "DE89370400440532013000"),
        ("name", "Mr Kim Lee", "Herr. Kim Lee"), ("email", "A.b@c.org", "a.B@C.org"), ("card", "4111 1111 1111 1111", "4111-1111-1111-1111"), ("key", "AB" * 16, "ab" * 16),
    ]
    rows = [(n, kind, v, a) for n, (kind, *vs) in enumerate(same) for v in vs for a in (0, 1, 3, 7, 16, 40)]
    df = spark.createDataFrame(rows, "n int, kind string, value string, attempt int")
    df = df.withColumn("canon", pii.canonical(F.col("kind"), F.col("value")))
    df = df.withColumn("new", pii.surrogates(F.array(F.struct("value", "kind", "canon", "attempt")), "k")[0]).withColumn("sur", pii.canonical(F.col("kind"), F.col("new")))
    got = df.withColumn("found", pii.kind_of(F.col("new"))).collect()
    assert all(r["new"] != r["value"] for r in got), got
    assert all(r["found"] == r["kind"] for r in got if r["attempt"] < pii.WIDER), got
    for n, _ in enumerate(same):
        mine = [r for r in got if r["n"] == n]
        assert len({r["canon"] for r in mine}) == 1 and all(len({r["sur"] for r in mine if r["attempt"] == a}) == 1 for a in (0, 1, 3, 7)), mine


def test_query_digests(spark):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op5_media(spark, SF).collect():
        raw = (text[r["doc_id"]] or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media.wave_bytes(payload)), hashlib.sha256(media.wave_bytes(payload)).hexdigest())


def test_common_text_does_not_flood_the_language_sample(spark):
    docs = spark.createDataFrame([(i, "the one text that all share", "en") for i in range(3000)] + [(5000, "un texte pour tous", "fr")], "doc_id long, text string, lang string")
    model = language_id.fit_language_model(docs)
    assert model.langs.count("en") <= 1 and set(model.langs) <= {"en", "fr"}


def test_word_ids_of_every_code_point():
    """Ids of words with any character, before and after letters and marks, are the library's."""
    import numpy as np
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tok, plain = packing.WordTokenizer(path("word_bpe_49k.json")), Tokenizer.from_file(path("word_bpe_49k.json"))
    chars = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    chars = [c for c in chars if not 0x3400 < ord(c) < 0x4DB0 and not 0x4E10 < ord(c) < 0x9FF0 and not 0xAC10 < ord(c) < 0xD790 and not 0xE010 < ord(c) < 0xF8F0 and not 0x20010 < ord(c) < 0x2A6D0]
    for shape in ("a%sb", "%s\u0301e"):
        texts = [shape % c for c in chars]
        for text, want in zip(texts, plain.encode_batch(texts, add_special_tokens=False)):
            assert np.frombuffer(tok.encode(text), "<u4").tolist() == want.ids, ascii(text)


def test_words_of_a_batch_are_looked_up_once():
    import pyarrow as pa

    met: dict[str, int] = {}

    class Counted(packing.WordIds):
        def __getitem__(self, word):
            met[word] = met.get(word, 0) + 1
            return super().__getitem__(word)

    file = tokenizer_file("word_bpe_49k.json")
    tok, plain = packing.WordTokenizer(file), Tokenizer.from_file(file)
    tok.words = Counted(tok.tokenizer)
    texts = ["", " ", "the cat, The cat", "a <|endoftext|> the\ncat", "the\ncat\r\n  sat", "caf\u00e9 cafe\u0301 \u03a3\u039f\u03a3 the\tcat", "<|startoftext|>"] * 60
    want = [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert tok.encode_column(pa.array(["x", *texts])[1:]) == want
    assert max(met.values()) <= 3  # beside itself, for a word with a comma and one with a capital
    assert tok.encode_column(pa.array(texts, pa.large_string())) == want and tok.encode_column(pa.array([], pa.string())) == []


def test_wave_without_samples_has_an_empty_payload(spark):
    row = spark.createDataFrame([(1, "audio/wav", bytearray(media.wave_bytes(b"")))], "doc_id long, declared string, media binary")
    assert bytes(media.describe_media(row).first()["payload"]) == b""


def test_queries_over_empty_tables(spark, tmp_path):
    import corpus_pipeline

    for name in ("documents", "embeddings", "pages", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in (queries.QUERIES | {"pipeline": corpus_pipeline.run}).items():
        assert query(spark, str(tmp_path)).count() == 0, name
