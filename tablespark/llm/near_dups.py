"""Near-duplicate classes by order MinHash over word k-mers and banded alignment.

A text's words (lower case, letters and digits) give k-mers of four words, each labelled with how often it came
before; of fewer words in texts of less than 80. (Five words would lose up to one in seven pairs that are only just
similar enough: the README has figures.) One sketch value is a pair: the two smallest labelled k-mers under
a hash function, in the order in which the text has them. Texts near a change of k have the sketches of both, so
that every pair of the needed similarity shares a k. In long texts one hash function deals the k-mers into as many
bins as there are sketch values, and every bin gives its two smallest. Texts that agree in a value are candidates;
two are linked if a banded alignment of their words finds an edit similarity of 0.8 or more. Classes are the
connected components of the links and of exact copies.

Copies are put together first. Small buckets are paired off; members of a large one first meet its smallest
member. What is then still in two pieces of a large bucket meets in blocks of it, the likeliest pairs first. Only
pairs are passed over whose pieces are linked by others, or whose lengths or counts of words alone already need
more edits than the similarity allows. That last step compares members of minor pieces with all of their bucket: its
work grows with the product of the two, though by integers alone for nearly all pairs.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, slices, written
from .components import connected_components
from .word_hash import column_bytes, mixed, word_hashes

#: (words of a k-mer, fewest and most words of the texts it serves, whether bins stand for hash functions); of two
#: texts of the needed similarity, one family serves both.
FAMILIES = ((1, 1, 6, False), (2, 5, 14, False), (3, 11, 100, False), (4, 80, 640, False), (4, 512, 1 << 31, True))
SIMILARITY = 0.8
SKETCHES = 72
#: Buckets of at most so many texts are paired off.
SMALL = 12
#: Large buckets are cut by length, then into parts of about so many texts and words. Up to so many texts of a class of
#: lengths and the next are sent to two blocks each at most, however many of them are minor.
BLOCK = 2048
WORDS = 512 << 10
#: 64-bit words of a signature: one bit for each class of words that a text holds.
SIGNATURE = 16
_SEEDS = np.random.default_rng(99).integers(1, 1 << 63, size=256, dtype=np.uint64)


def labelled_kmers(hashes: np.ndarray, ends: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(k-mers labelled by occurrence, number before each text). A text of fewer words is one k-mer."""
    n = np.diff(ends)
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    starts = np.concatenate([[0], np.cumsum(count)])
    if not starts[-1]:
        return np.empty(0, np.uint64), starts
    row = np.repeat(np.arange(len(n)), count)
    at = ends[row] + np.arange(starts[-1]) - starts[row]
    kmer = np.zeros(len(at), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(words):
            inside = at + j < ends[row + 1]
            kmer = kmer * np.uint64(0x2545F4914F6CDD1D) + np.where(inside, hashes[np.minimum(at + j, len(hashes) - 1)], np.uint64(j + 1))
        kmer = mixed(kmer)
        order = np.lexsort((kmer, row))
        new = np.concatenate([[True], (kmer[order][1:] != kmer[order][:-1]) | (row[order][1:] != row[order][:-1])])
        first = np.flatnonzero(new)
        nth = np.empty(len(at), dtype=np.uint64)
        nth[order] = (np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))).astype(np.uint64)
        return mixed(kmer + nth * np.uint64(0x9E3779B97F4A7C15)), starts


_PLACE = np.uint64((1 << 28) - 1)
_NONE = np.uint64((1 << 64) - 1)


def _pair_key(kmers: np.ndarray, one: np.ndarray, two: np.ndarray, single: np.ndarray, salt: np.uint64) -> np.ndarray:
    """One value for two k-mers in text order; places are given, of which the second counts if not single."""
    first, second = kmers[np.minimum(one, two)], np.where(single, np.uint64(0), kmers[np.maximum(one, two)])
    return mixed(mixed(first + salt) + second)


def order_minhash(kmers: np.ndarray, starts: np.ndarray, words: int, sketches: int = SKETCHES) -> tuple[np.ndarray, np.ndarray]:
    """(text, value): for each text that has k-mers, the two smallest under every hash function, in text order."""
    some = np.flatnonzero(np.diff(starts))
    begin = starts[some]
    place = (np.arange(len(kmers)) - np.repeat(begin, np.diff(starts)[some])).astype(np.uint64)
    out = np.empty((len(begin), sketches), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for t in range(sketches):
            v = (kmers ^ _SEEDS[t]) * np.uint64(0x9FB21C651E98DF25)
            v ^= v >> np.uint64(29)
            v &= ~_PLACE
            v |= place
            one = begin + (np.minimum.reduceat(v, begin) & _PLACE).astype(np.int64)
            v[one] = _NONE
            least = np.minimum.reduceat(v, begin)
            single = least == _NONE
            two = np.where(single, one, begin + (least & _PLACE).astype(np.int64))
            out[:, t] = _pair_key(kmers, one, two, single, _SEEDS[t] * np.uint64(2 * words + 1))
    return np.repeat(some, sketches), out.ravel()


def binned_minhash(kmers: np.ndarray, starts: np.ndarray, words: int, sketches: int = SKETCHES) -> tuple[np.ndarray, np.ndarray]:
    """(text, value): for each text and each bin of k-mers, the two smallest of the bin, in text order."""
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    with np.errstate(over="ignore"):
        v = (kmers ^ _SEEDS[0]) * np.uint64(0x9FB21C651E98DF25)
        v ^= v >> np.uint64(29)
        group = row * sketches + (v % np.uint64(sketches)).astype(np.int64)
        order = np.argsort(v // np.uint64(sketches))
        order = order[np.argsort(group[order], kind="stable")]
        group = group[order]
        head = np.flatnonzero(np.diff(group, prepend=-1))
        single = np.append(head[1:], len(group)) - head == 1
        one, two = order[head], order[np.minimum(head + 1, len(group) - 1)]
        two = np.where(single, one, two)
        salt = _SEEDS[group[head] % sketches] * np.uint64(2 * words)
        return group[head] // sketches, _pair_key(kmers, one, two, single, salt)


def sketches_of(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sketch values of all texts in order, offsets): those of each family that a text's length is in."""
    n = np.diff(ends)
    rows, values = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for words, low, high, binned in FAMILIES:
        some = np.flatnonzero((n >= low) & (n <= high))
        if len(some):
            inner = np.concatenate([[0], np.cumsum(n[some])])
            at = np.repeat(np.arange(len(some)), n[some])
            kmers, starts = labelled_kmers(hashes[ends[some][at] + np.arange(inner[-1]) - inner[at]], inner, words)
            row, value = (binned_minhash if binned else order_minhash)(kmers, starts, words)
            rows.append(some[row])
            values.append(value)
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.argsort(row, kind="stable")
    return value[order], np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(n)))])


def _bits(places: list[int]) -> int:
    if places[-1] < 4096:
        return sum(1 << p for p in places)
    flags = np.zeros(places[-1] + 1, dtype=np.uint8)
    flags[places] = 1
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def banded_distance(a: list[int], b: list[int], band: int) -> int:
    """Edit distance of two word lists if it is at most band, else band + 1.

    Bit-parallel over a band of 2 band + 1 diagonals (Hyyrö, 2003): one step for each word of b.
    """
    if abs(len(a) - len(b)) > band:
        return band + 1
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < len(a) - lo and hi < len(b) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not a or not b:
        return min(max(len(a), len(b)), band + 1)
    if sum((Counter(a) - Counter(b)).values()) > band or sum((Counter(b) - Counter(a)).values()) > band:
        return band + 1
    places: dict[int, list[int]] = defaultdict(list)
    for i, w in enumerate(a):
        places[w].append(i)
    width = 2 * band + 1
    full = (1 << width) - 1
    # Bit d of a column j stands for row j - band + d of the pattern; above the first row nothing differs.
    vp, vn, distance = full << band & full, 0, min(band, len(a))
    last = 1 << (width - 1)
    seen = {w: 0 for w in places}
    # Frequent words have all their places in one integer; there are at most 256 of them, so few are long.
    masks = {w: _bits(at) for w, at in places.items() if len(at) > max(4, len(a) // 256)}
    for j in range(len(b)):
        match, at = 0, places.get(b[j])
        if b[j] in masks:
            match = (masks[b[j]] >> (j - band) if j >= band else masks[b[j]] << (band - j)) & full
        elif at:
            k = seen[b[j]]
            while k < len(at) and at[k] < j - band:
                k += 1
            seen[b[j]] = k
            while k < len(at) and at[k] <= j + band:
                match |= 1 << (at[k] - j + band)
                k += 1
        d0 = (((match & vp) + vp) ^ vp | match | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        row = j + band + 1
        if row <= len(a):
            distance += not d0 & last
        else:
            bit = 1 << (width - 1 - (row - len(a)))
            distance += bool(hp & bit) - bool(hn & bit)
        vp = (hn | ~((d0 >> 1) | hp)) & full
        vn = (d0 >> 1) & hp
    return min(distance, band + 1)


def edit_similarity(a: list[int], b: list[int], least: float = SIMILARITY) -> float:
    """1 - distance / longer length, or 0 if that is below least."""
    longer = max(len(a), len(b))
    if not longer:
        return 0.0
    band = int((1 - least) * longer + 1e-9)
    distance = banded_distance(a, b, band)
    return 1 - distance / longer if distance <= band else 0.0


def signatures(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One row of SIGNATURE integers for each text: the classes of words that it holds, as bits."""
    flags = np.zeros((len(ends) - 1, SIGNATURE * 64), dtype=bool)
    flags[np.repeat(np.arange(len(ends) - 1), np.diff(ends)), (hashes % np.uint64(SIGNATURE * 64)).astype(np.int64)] = True
    return np.packbits(flags, axis=1).view(np.int64)


def least_edits(n: np.ndarray, x: np.ndarray, m: np.ndarray, y: np.ndarray) -> np.ndarray:
    """No more than the edit distance of texts with n and m words and signatures x and y, row by row."""
    x, y = x.view(np.uint64), y.view(np.uint64)
    only_x, only_y = np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64)
    return np.maximum(np.maximum(only_x, only_y), np.abs(n - m))


def _band(n: np.ndarray, m: np.ndarray, least: float) -> np.ndarray:
    return ((1 - least) * np.maximum(n, m) + 1e-9).astype(np.int64)


def _signature_rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, SIGNATURE)


def _possible(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b, n) whose lengths and signatures don't rule the similarity out."""
    of = lambda c, s: texts.select(F.col("node").alias(c), F.col("n").alias(f"{s}_n"), F.col("signature").alias(s))
    both = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "n", "x_n", "x", "y_n", "y")
    both = both.where(F.abs(F.col("x_n") - F.col("y_n")) <= F.lit(1 - least) * F.greatest("x_n", "y_n") + 1e-9)

    def run(batches):
        for batch in batches:
            n, m = (batch.column(c).to_numpy().astype(np.int64) for c in ("x_n", "y_n"))
            keep = pa.array(least_edits(n, _signature_rows(batch.column("x")), m, _signature_rows(batch.column("y"))) <= _band(n, m, least))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b", "n")], names=["a", "b", "n"])

    return both.mapInArrow(run, "a binary, b binary, n bigint")


def _sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, node, sketch, n, signature): node is the text's digest, n its number of words; sketch is null without words."""
    rows = docs.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("node"), F.lower("text").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                hashes, ends = word_hashes(*column_bytes(batch.column("text")))
                values, offsets = sketches_of(hashes, ends)
                sketch = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)), mask=pa.array(np.diff(offsets) == 0))
                n, signature = pa.array(np.diff(ends).astype(np.int32)), pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * SIGNATURE, pa.array(signatures(hashes, ends).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), sketch, n, signature], names=["doc_id", "node", "sketch", "n", "signature"])

    return rows.mapInArrow(run, f"doc_id {kind}, node binary, sketch array<bigint>, n int, signature array<bigint>")


def _word_lists(texts: DataFrame) -> DataFrame:
    """(node, words): 32 bits of every word's hash, in order."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                hashes, ends = word_hashes(*column_bytes(batch.column("text")))
                words = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("node"), words], names=["node", "words"])

    return texts.select("node", F.lower("text").alias("text")).mapInArrow(run, "node binary, words array<int>")


def _verified(pairs: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b, p, q) whose texts a and b a banded alignment finds similar."""
    names = ["a", "b", "p", "q"]
    both = pairs.select(*names).join(words.select(F.col("node").alias("a"), F.col("words").alias("x")), "a")
    both = both.join(words.select(F.col("node").alias("b"), F.col("words").alias("y")), "b").select(*names, "x", "y")

    def run(batches):
        for batch in batches:
            # One pair at a time as Python's lists, which take ten times the room.
            keep = pa.array([edit_similarity(x.as_py(), y.as_py(), least) > 0 for x, y in zip(batch.column("x"), batch.column("y"))], pa.bool_())
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in names], names=names)

    return both.mapInArrow(run, "a binary, b binary, p binary, q binary")


def _candidates(shared: DataFrame) -> DataFrame:
    """Pairs (a, b, n): all within small buckets, and every member of large ones with its likeliest smallest member.

    n counts agreements. What else large buckets hold is compared later, as far as it is still in two pieces.
    """
    pair = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
    lists = shared.where(f"members <= {SMALL} and node <> least").groupBy("key", "least").agg(F.array_sort(F.collect_list("node")).alias("m"))
    among = lists.select("least", "m", F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda y: pair(x, y))).alias("inner"))
    small = among.select(F.explode(F.concat(F.transform("m", lambda y: pair(F.col("least"), y)), F.flatten("inner"))).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))
    star = shared.where(f"members > {SMALL} and node <> least").groupBy(F.col("least").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("n"))
    best = star.groupBy("b").agg(F.max(F.struct("n", "a")).alias("best")).select("best.a", "b", "best.n")
    return small.unionByName(best).groupBy("a", "b").agg(F.sum("n").alias("n"))


def _split_buckets(large: DataFrame, pieces: DataFrame) -> DataFrame:
    """(main, node, piece, minor) of the large buckets that hold several pieces; minor: not of the largest, main.

    Buckets with the same largest piece are one, so a group that shares many buckets is compared once.
    """
    rows = large.join(pieces, "node", "left").select("key", "node", F.coalesce("piece", "node").alias("piece"))
    of_key = rows.groupBy("key", "piece").agg(F.count("*").alias("n")).groupBy("key")
    of_key = of_key.agg(F.max_by("piece", F.struct("n", "piece")).alias("main"), F.count("*").alias("pieces")).where("pieces > 1")
    return rows.join(of_key.select("key", "main"), "key").select("main", "node", "piece", (F.col("piece") != F.col("main")).alias("minor")).distinct()


def _blocks(split: DataFrame, words: DataFrame) -> DataFrame:
    """(members): a part of one window's texts (left) with a part of its minor ones (right), to be compared.

    Members of the largest piece need no comparison with one another. A window of a bucket holds a class of lengths (low)
    and the next: texts of a needed similarity are in the same class or in adjoining ones. A text goes to its own window
    and to that of the class below, if there is something to compare it with; parts have about BLOCK texts and WORDS
    words at most, so only windows beyond that size send a text to several blocks of one window.
    """
    rows = split.join(words.select("node", "words", F.size("words").alias("n")), "node")
    rows = rows.withColumn("c", F.floor(F.log(F.col("n")) / F.log(F.lit(1.26))).cast("int"))
    some = lambda x: F.coalesce(F.sum(F.when(F.col("minor"), x)), F.lit(0))
    sizes = rows.groupBy("main", "c").agg(F.count("*").alias("all"), F.sum("n").alias("all_n"), some(F.lit(1)).alias("few"), some(F.col("n")).alias("few_n"))
    near = lambda x, first, last: F.coalesce(F.sum(x).over(Window.partitionBy("main").orderBy("c").rangeBetween(first, last)), F.lit(0))
    parts = lambda x, first: F.ceil(F.greatest(near(x, first, first + 1) / BLOCK, near(f"{x}_n", first, first + 1) / WORDS)).cast("int")
    window = lambda first: F.struct(parts("all", first).alias("all"), parts("few", first).alias("few"))
    sizes = sizes.select("main", "c", window(0).alias("own"), window(-1).alias("below"), near("all", -1, -1).alias("all_below"), near("few", -1, -1).alias("few_below"))
    rows = rows.join(sizes, ["main", "c"])
    block = lambda w, i, j, left, right: F.struct(w.alias("w"), i.alias("i"), j.alias("j"), left.alias("left"), right.alias("right"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)

    def dealt(w, size):
        i, j = F.pmod(F.xxhash64("node"), size["all"]).cast("int"), F.pmod(F.xxhash64("node"), size["few"]).cast("int")
        left = F.transform(upto(size["few"]), lambda x: block(w, i, x, F.lit(True), F.col("minor") & (x == j)))
        right = F.transform(F.filter(upto(size["all"]), lambda x: F.col("minor") & (x != i)), lambda x: block(w, x, j, F.lit(False), F.lit(True)))
        return F.concat(left, right)

    none = F.slice(dealt(F.col("c"), F.col("own")), 1, 0)
    own = F.when(F.col("own.few") > 0, dealt(F.col("c"), F.col("own"))).otherwise(none)
    met = F.when(F.col("minor"), F.col("all_below")).otherwise(F.col("few_below")) > 0
    below = F.when(met, dealt(F.col("c") - 1, F.col("below"))).otherwise(none)
    rows = rows.select("main", "node", "words", "piece", "minor", "c", F.explode(F.concat(own, below)).alias("block")).select("main", "node", "words", "piece", "minor", (F.col("c") == F.col("block.w")).alias("low"), "block.*")
    members = F.struct("node", "words", "piece", "minor", "low", "left", "right")
    # Dealt out anew, else all blocks of a bucket would stay in the task of its key.
    key = ["main", "w", "i", "j"]
    return rows.repartition(*key).groupBy(*key).agg(F.collect_list(members).alias("members")).select("members")


#: Classes of words that are counted to bound the edit distance of two texts of a block.
COUNTED = 2048


def _links_in(members: pa.StructArray, least: float) -> list[tuple[int, int]]:
    """Pairs of members of different pieces that are similar; no more once two pieces are linked."""
    words, piece = members.field("words"), np.unique(np.array(members.field("piece").to_pylist(), dtype=object), return_inverse=True)[1]
    minor, low, is_left, is_right = (members.field(k).to_numpy(zero_copy_only=False).astype(bool) for k in ("minor", "low", "left", "right"))
    # Two minor texts meet as (u, v) and as (v, u), if need be in two blocks: the order of their digests takes one.
    place = np.unique(np.array(members.field("node").to_pylist(), dtype=object), return_inverse=True)[1]
    n = words.value_lengths().to_numpy().astype(np.int64)
    flat, ends = words.flatten().to_numpy().view(np.uint32), np.concatenate([[0], np.cumsum(n)])
    text = [flat[x:y] for x, y in zip(ends[:-1], ends[1:])]
    signature = signatures(flat.astype(np.uint64), ends)
    counts = np.bincount(np.repeat(np.arange(len(n)) * COUNTED, n) + (flat >> 12) % COUNTED, minlength=len(n) * COUNTED)
    counts = counts.reshape(len(n), COUNTED).astype(np.uint16 if n.max() < 1 << 16 else np.int32)
    parent = list(range(piece.max() + 1))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    left, right, out = np.flatnonzero(is_left), np.flatnonzero(is_right), []
    for at in range(0, len(left), 128):
        some = left[at : at + 128]
        fits = (piece[some][:, None] != piece[right]) & (low[some][:, None] | low[right]) & (~minor[some][:, None] | (place[some][:, None] < place[right]))
        fits &= (np.abs(n[some][:, None] - n[right]) <= _band(n[some][:, None], n[right], least))
        i, j = np.nonzero(fits)
        i, j = some[i], right[j]
        edits = np.concatenate([np.empty(0, np.int64), *[least_edits(n[i[k : k + 16384]], signature[i[k : k + 16384]], n[j[k : k + 16384]], signature[j[k : k + 16384]]) for k in range(0, len(i), 16384)]])
        keep = np.flatnonzero(edits <= _band(n[i], n[j], least))
        keep = keep[np.argsort(edits[keep], kind="stable")]  # the likeliest first
        i, j = i[keep], j[keep]
        for k in range(0, len(i), 1024):
            x, y = i[k : k + 1024], j[k : k + 1024]
            apart = np.array([root(p) != root(q) for p, q in zip(piece[x].tolist(), piece[y].tolist())], dtype=bool)
            x, y = x[apart], y[apart]
            near = np.maximum(n[x], n[y]) - np.minimum(counts[x], counts[y]).sum(axis=1, dtype=np.int64) <= _band(n[x], n[y], least)
            for u, v in zip(x[near].tolist(), y[near].tolist()):
                p, q = root(piece[u]), root(piece[v])
                if p != q and edit_similarity(text[u].tolist(), text[v].tolist(), least):
                    parent[max(p, q)] = min(p, q)
                    out.append((u, v))
    return out


def _apart(blocks: DataFrame, least: float) -> DataFrame:
    """Links (p, q) between pieces whose members meet in a block and are similar."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                members = batch.column("members").slice(row, 1).flatten()
                found = _links_in(members, least)
                if found:
                    yield pa.RecordBatch.from_arrays([members.field("piece").take(pa.array(list(k))) for k in zip(*found)], names=["p", "q"])

    return blocks.mapInArrow(run, "p binary, q binary")


def _roots(links: DataFrame) -> DataFrame:
    """(node, root) for links from every b to one smaller a: the end of each chain, by doubling jumps."""
    up = written(links.select(F.col("b").alias("node"), F.col("a").alias("root"), F.lit(True).alias("moved")), "roots")
    while not up.where("moved").isEmpty():
        over = up.select(F.col("node").alias("root"), F.col("root").alias("over"))
        jump = up.join(over, "root", "left").select("node", F.coalesce("over", "root").alias("root"), F.col("over").isNotNull().alias("moved"))
        up = written(jump, "roots")
    return up.select("node", "root")


def _merged(pieces: DataFrame, links: DataFrame) -> DataFrame:
    """(node, piece) after links (p, q) between pieces; a node that is in neither is a piece of its own."""
    joined = connected_components(links, "p", "q").withColumnRenamed("node", "piece")
    moved = pieces.join(joined, "piece", "left").select("node", F.coalesce("component", "piece").alias("piece"))
    # Pieces that were called by their own node, which had no row yet.
    fresh = joined.join(pieces.select(F.col("node").alias("piece")), "piece", "left_anti")
    return written(moved.unionByName(fresh.select(F.col("piece").alias("node"), F.col("component").alias("piece"))), "pieces")


def _classes(rows: DataFrame, least: float) -> DataFrame:
    """(doc_id, node, piece) for each row of (doc_id, text) that has a text."""
    bounded_batches(rows.sparkSession)
    rows = rows.where("text is not null")
    sketched = written(_sketched(rows), "sketches")
    texts = written(sketched.where("sketch is not null").groupBy("node").agg(*[F.first(c).alias(c) for c in ("sketch", "n", "signature")]), "distinct-sketches")
    level = texts.select("node", F.explode(F.array_distinct("sketch")).alias("key"))
    # Written, so that the join with them can split a key that very many texts share.
    buckets = written(level.groupBy("key").agg(F.count("*").alias("members"), F.min("node").alias("least")).where("members > 1"), "shared-keys")
    shared = written(level.join(buckets, "key"), "buckets")
    pairs = written(_possible(_candidates(shared), texts, least), "candidates")
    large = shared.where(f"members > {SMALL}").select("key", "node")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(large.select("node")).distinct()
    held = rows.select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("node"), "text")
    words = written(_word_lists(held.join(ends, "node").dropDuplicates(["node"])), "words")
    # First every text with its likeliest partner, then whatever that leaves in two pieces.
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a"))
    links = written(_verified(best.select("a", "b", F.col("a").alias("p"), F.col("b").alias("q")), words, least), "links")
    roots = _roots(links)
    of = lambda c, root: roots.select(F.col("node").alias(c), F.col("root").alias(root))
    rest = pairs.join(best.select("b", F.col("a").alias("tried")), "b").where("a != tried").join(of("b", "q"), "b", "left").join(of("a", "p"), "a", "left")
    rest = rest.select("a", "b", F.coalesce("p", "a").alias("p"), F.coalesce("q", "b").alias("q")).where("p != q")
    pieces = _merged(roots.withColumnRenamed("root", "piece"), written(_verified(rest, words, least), "more-links"))
    split = written(_split_buckets(large, pieces), "split-buckets")
    if not split.isEmpty():
        pieces = _merged(pieces, written(_apart(_blocks(split, words), least), "links-apart"))
    return sketched.select("doc_id", "node").join(pieces, "node", "left").select("doc_id", "node", F.coalesce("piece", "node").alias("piece"))


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, node (the text's digest), class_id, class_size for each row of docs.

    class_id is the smallest doc_id of the class. Equal texts are in one class; a null text is a class of its
    own; texts without words are linked to equal ones alone; repeated rows are counted each; empty tables give
    no rows; further columns, whatever their names, are left out.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = _classes(rows, least)
    sizes = out.groupBy("piece").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    out = out.join(sizes, "piece").select("doc_id", "node", "class_id", "class_size")
    alone = rows.where("text is null").select("doc_id", F.lit(None).cast("binary").alias("node"), F.col("doc_id").alias("class_id"), F.lit(1).cast("bigint").alias("class_size"))
    return out.unionByName(alone)


def keep_one(docs: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, less every text but one of each near-duplicate class.

    The row with the smallest doc_id stays, of rows that share it the one with the smallest digest; of repeated
    rows one stays; rows whose text or doc_id is null stay.
    """
    found = _classes(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null"), least)
    kept = found.groupBy("piece").agg(F.min(F.struct("doc_id", "node")).alias("kept")).select(F.col("kept.doc_id").alias("_kept"), F.col("kept.node").alias("_kept_node"))
    keyed = docs.withColumn("_node", F.unhex(F.md5(F.col(text_col).cast("binary"))))
    stays = keyed.join(kept, (keyed[id_col] == kept["_kept"]) & (keyed["_node"] == kept["_kept_node"]), "left_semi")
    return stays.dropDuplicates([id_col, "_node"]).drop("_node").unionByName(docs.where(F.col(text_col).isNull() | F.col(id_col).isNull()))
