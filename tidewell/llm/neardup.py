"""Near-duplicate texts by an LSH forest over weighted min-hash signatures.

Every text gets a signature of SIGNATURE values; each is the smallest of its word shingles under one random order, in
which rare shingles come early (exponential races with a power of the inverse document frequency as rate), so that
phrases which half the corpus shares make strangers look less alike. The forest has TREES trees: each
sorts the texts by the values of their signatures in an order of its own, and reads the candidates off the sorted order:
neighbours whose longest common prefix is BASE_DEPTH values or more. The depth adapts to the region: one with more than
CROWD texts is split at the next value, and again, until its parts are small. What the greater depth would miss
there is made up for by more orders: texts of crowded regions are sorted again into DEEP_TREES trees of longer keys,
from DEEP_DEPTH values on. Parts that are crowded at the end of the keys are met in blocks, so nothing is left out.
Candidates are verified by the exact Jaccard similarity of their shingles; those whose shingles, cut to 16 bits each,
are too unlike for it are told before their texts are moved.

Equal texts are collapsed to one representative first; a group of copies, however large, is one leaf of each tree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tidewell.sources.scratch import materialise

SIGNATURE, TREES, BASE_DEPTH, DEEP_TREES, DEEP_DEPTH, CROWD = 48, 56, 4, 224, 6, 256
#: A key is one number or two: the tree (8 bits) and five values, and five more in crowded regions, of so many bits each.
VALUE_BITS, A_KEY = 11, 5
#: Leaves that one task sorts, and texts of one block where a crowded part is met in blocks.
LEAVES_A_TASK, BLOCK = 2_000_000, 1000
#: A region that is cut short in memory when this many of its leaves are held.
HELD = 1 << 18
#: How much earlier rare shingles come: the rate of a shingle's race is its rarity in bits to this power.
RARITY_POWER, LEAST_RARITY = 0.5, 4.0
#: Buckets of the sketch of shingle frequencies: fixed, so what is broadcast never grows with the data.
SKETCH = 1 << 18
#: Buckets of the filter that keeps texts without candidate out of the verification's shuffle: four a text that has one,
#: within these bounds, so what is broadcast stays below a million numbers.
LEAST_FILTER, MOST_FILTER = 1 << 16, 1 << 20

_WORD = re.compile(r"[^\W_]+")
_ASCII = "".join(chr(i) if chr(i).isalnum() else " " for i in range(128))
_A = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def words(text: str) -> list[str]:
    """Lower-cased runs of letters and digits."""
    if text.isascii():
        return text.lower().translate(_ASCII).split()
    return _WORD.findall(text.lower())


class _Hashes(dict):
    """64-bit hash by word; bounded."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A[5]
    return x ^ (x >> np.uint64(29))


def shingle_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    n = len(ids) - k + 1
    h = np.zeros(max(n, 0), np.uint64)
    for j in range(k if n > 0 else 0):
        h = _mix(h + ids[j : j + n] * _A[j % 5] + _A[6])
    return h


def _shingled(memory: _Hashes, texts: list[str | None], bodies: list[str | None], k: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that qualify, their shingles one after the other, where each row's begin). A text qualifies if its body
    has at least `least` words and the text at least k."""
    rows, parts, sizes = [], [], []
    for i, (text, body) in enumerate(zip(texts, bodies, strict=True)):
        if not text or not body or len(body) < 2 * least - 1 or len(words(body)) < least:
            continue
        ws = words(text)
        if len(ws) < k:
            continue
        rows.append(i)
        parts.append(np.fromiter(map(memory.__getitem__, ws), np.uint64, len(ws)))
        sizes.append(len(ws))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = shingle_hashes(np.concatenate(parts), k)
    ends = np.cumsum(sizes)
    inside = np.ones(len(h), bool)
    for j in range(1, k):  # runs that reach into the next text
        at = ends[:-1] - j
        inside[at[(at >= 0) & (at < len(h))]] = False
    counts = np.array(sizes) - k + 1
    return np.array(rows), h[inside], np.concatenate([[0], np.cumsum(counts)[:-1]])


def frequency_sketch(texts: DataFrame, k: int, least: int) -> np.ndarray:
    """How often shingles occur, in SKETCH hashed buckets, over all texts (columns text, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, counts = _Hashes(), np.zeros(SKETCH, np.int64)
        for batch in batches:
            _, h, _ = _shingled(memory, batch.column(0).to_pylist(), batch.column(1).to_pylist(), k, least)
            counts += np.bincount((h >> np.uint64(46)).astype(np.int64), minlength=SKETCH)
        at = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["bucket", "n"])

    rows = texts.select("text", "body").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SKETCH, np.int64)
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def signatures(texts: DataFrame, k: int, least: int, seed: int = 5) -> DataFrame:
    """(cls, sig, grams): for every class of equal texts (columns cls, text, body) its signature, and 16 bits of each of its
    shingles, sorted and distinct."""
    seen = frequency_sketch(texts, k, least)
    total = max(2.0, float(seen.sum()) / 50)
    # log2 of the rarity; never below LEAST_RARITY, so that a story of many versions is still told by what they share.
    rarity = np.maximum(np.log2((total + 1) / np.maximum(seen, 1)), LEAST_RARITY)
    shared = texts.sparkSession.sparkContext.broadcast((1 / rarity**RARITY_POWER).astype(np.float32))
    rng = np.random.default_rng(seed)
    odd = rng.integers(1, 1 << 63, SIGNATURE, dtype=np.int64).view(np.uint64) | np.uint64(1)
    races = (-np.log((np.arange(1 << 16) + 0.5) / (1 << 16))).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, slowness = _Hashes(), shared.value
        done: set[int] = set()
        for batch in batches:
            cls, texts_, bodies = (batch.column(j).to_pylist() for j in range(3))
            for lo in range(0, len(cls), 2000):
                part = [None if c in done else t for c, t in zip(cls[lo : lo + 2000], texts_[lo : lo + 2000], strict=True)]
                if len(done) < 2_000_000:
                    done.update(cls[lo : lo + 2000])
                rows, h, starts = _shingled(memory, part, bodies[lo : lo + 2000], k, least)
                if not len(rows):
                    continue
                slow = slowness[(h >> np.uint64(46)).astype(np.int64)]
                out = np.empty((len(rows), SIGNATURE), np.uint16)
                for j in range(SIGNATURE):
                    value = np.minimum.reduceat(races[((h * odd[j]) >> np.uint64(48)).astype(np.int64)] * slow, starts)
                    out[:, j] = (_mix(value.view(np.uint32).astype(np.uint64) + odd[j]) >> np.uint64(48)).astype(np.uint16)
                owner = np.repeat(np.arange(len(rows)), np.diff(np.append(starts, len(h))))
                short = np.unique(owner << 16 | (h & np.uint64(0xFFFF)).astype(np.int64))
                cuts = np.cumsum(np.bincount(short >> 16, minlength=len(rows)))[:-1]
                grams = [g.tobytes() for g in np.split((short & 0xFFFF).astype(np.uint16), cuts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([cls[lo + r] for r in rows], pa.int64()), pa.array([r.tobytes() for r in out], pa.binary()), pa.array(grams, pa.binary())], names=["cls", "sig", "grams"]
                )

    mapped = texts.select("cls", "text", "body").mapInArrow(run, "cls bigint, sig binary, grams binary")
    return mapped.groupBy("cls").agg(F.first("sig").alias("sig"), F.first("grams").alias("grams"))


def _keys(sig: np.ndarray, orders: np.ndarray) -> list[np.ndarray]:
    """The keys of signatures (rows) in every tree, trees one after the other."""
    trees, depth = orders.shape
    s = sig.astype(np.int64) >> (16 - VALUE_BITS)
    keys = [np.repeat(np.arange(trees), len(s)), *[np.zeros(trees * len(s), np.int64) for _ in range(depth // A_KEY - 1)]]
    for d in range(depth):
        keys[d // A_KEY] = keys[d // A_KEY] << VALUE_BITS | s[:, orders[:, d]].T.ravel()
    return keys


def sorted_leaves(sigs: DataFrame, count: int, trees: int, numbers: int, seed: int) -> DataFrame:
    """(key[, more], id): the place of every class of `sigs` (id, sig) in each tree, in the order of the trees.

    Partitions are ranges of the order with about LEAVES_A_TASK leaves. Their bounds are quantiles over a sample of at
    most 4,000 signatures or so, which decides where a task ends and nothing else.
    """
    orders = np.array([np.random.default_rng([seed, t]).permutation(SIGNATURE)[: A_KEY * numbers] for t in range(trees)])
    spark = sigs.sparkSession
    parts = max(1, -(-count * trees // LEAVES_A_TASK), min(spark.sparkContext.defaultParallelism * 2, count * trees // 50_000))
    names = ["key", "more"][:numbers]
    if numbers == 1:
        sample = sigs.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(1, count // 4000))) == 0).select("sig").collect()
        known = np.sort(_keys(_unpacked([r.sig for r in sample]), orders)[0])
        bounds = known[np.arange(1, parts) * len(known) // parts] if len(known) else np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                keys = _keys(_unpacked(part.column(1).to_pylist()), orders)
                place = [np.searchsorted(bounds, keys[0], "right").astype(np.int32)] if numbers == 1 else []
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*keys, np.tile(np.array(part.column(0)), trees), *place)], names=[*names, "id", *["place"][: len(place)]])

    fields = ", ".join(f"{n} bigint" for n in [*names, "id"])
    if numbers == 1:
        placed = sigs.select("id", "sig").mapInArrow(run, f"{fields}, place int").repartitionById(parts, "place").drop("place")
    else:
        placed = sigs.select("id", "sig").mapInArrow(run, fields).repartitionByRange(parts, *names)
    return placed.sortWithinPartitions(*names)


def _unpacked(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint16).reshape(-1, SIGNATURE)


def parted(keys: tuple[np.ndarray, ...], depth: int) -> np.ndarray:
    """Which leaves but the first have fewer than `depth` values in common with the one before them."""
    last = (depth - 1) // A_KEY
    shift = VALUE_BITS * (A_KEY - 1 - (depth - 1) % A_KEY)
    out = keys[last][1:] >> shift != keys[last][:-1] >> shift
    for k in keys[:last]:
        out |= k[1:] != k[:-1]
    return out


class _Reader:
    """Reads candidates off sorted leaves. Rows are (kind, key, more, a, b)."""

    PAIR, EDGE, CROWDED, LEAF = range(4)

    def __init__(self, numbers: int, depth: int):
        self.depth, self.most = depth, A_KEY * numbers
        self.rows: list[tuple[np.ndarray, ...]] = []

    def emit(self, kind: int, keys: tuple[np.ndarray, ...] | None, a: np.ndarray, b: np.ndarray | None = None) -> None:
        if len(a):
            zero = np.zeros(len(a), np.int64)
            key, more = (*keys, zero)[:2] if keys else (zero, zero)
            self.rows.append((np.full(len(a), kind, np.int8), key, more, a, zero if b is None else b))

    def taken(self) -> pa.RecordBatch:
        cols = [np.concatenate(c) for c in zip(*self.rows, strict=True)] if self.rows else [np.zeros(0, t) for t in (np.int8, *[np.int64] * 4)]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["kind", "key", "more", "a", "b"])

    def read(self, keys: tuple[np.ndarray, ...], ids: np.ndarray, depth: int) -> None:
        """Pairs within the regions of common prefixes of `depth` values; crowded ones are split at the next value."""
        starts = np.concatenate([[0], np.nonzero(parted(keys, depth))[0] + 1])
        sizes = np.diff(np.append(starts, len(ids)))
        size = np.repeat(sizes, sizes)
        near, many = (size > 1) & (size <= CROWD), size > CROWD
        own, ends = ids[near], np.cumsum(sizes[(sizes > 1) & (sizes <= CROWD)])
        left = np.repeat(ends, sizes[(sizes > 1) & (sizes <= CROWD)]) - np.arange(len(own)) - 1  # leaves after it in its region
        at, step = np.nonzero(left > 0)[0], 1
        while len(at):
            self.emit(self.PAIR, None, np.minimum(own[at], own[at + step]), np.maximum(own[at], own[at + step]))
            step += 1
            at = at[left[at] >= step]
        if many.any():
            keys, ids = tuple(k[many] for k in keys), ids[many]
            if depth == self.depth:
                self.emit(self.CROWDED, None, ids)
            if depth < self.most:
                self.read(keys, ids, depth + 1)
            else:
                self.emit(self.LEAF, keys, ids)

    def edge(self, keys: tuple[np.ndarray, ...], ids: np.ndarray) -> None:
        """The part of a region that may go on in the partition beside this one, under the region's own key."""
        last = (self.depth - 1) // A_KEY
        shift = VALUE_BITS * (A_KEY - 1 - (self.depth - 1) % A_KEY)
        self.emit(self.EDGE, tuple(k if j < last else k >> shift << shift if j == last else np.zeros_like(k) for j, k in enumerate(keys)), ids)


def _read_sorted(batches: Iterator[pa.RecordBatch], numbers: int, depth: int) -> Iterator[pa.RecordBatch]:
    reader = _Reader(numbers, depth)
    keys, ids = tuple(np.zeros(0, np.int64) for _ in range(numbers)), np.zeros(0, np.int64)
    first = True
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, ids = tuple(np.concatenate([k, np.array(batch.column(j))]) for j, k in enumerate(keys)), np.concatenate([ids, np.array(batch.column(numbers))])
        cuts = np.nonzero(parted(keys, depth))[0] + 1
        if len(cuts) and first:
            at, first = int(cuts[0]), False
            reader.edge(tuple(k[:at] for k in keys), ids[:at])
            keys, ids, cuts = tuple(k[at:] for k in keys), ids[at:], cuts[1:] - at
        if len(cuts):
            at = int(cuts[-1])
            reader.read(tuple(k[:at] for k in keys), ids[:at], depth)
            keys, ids = tuple(k[at:] for k in keys), ids[at:]
        if len(ids) > HELD:
            # A crowded region, told as one before its end: its leaves count as an edge, too, for the rest to meet them.
            reader.read(keys, ids, depth)
            reader.edge(keys, ids)
            keys, ids = tuple(k[:0] for k in keys), ids[:0]
        yield reader.taken()
    reader.edge(keys, ids)
    yield reader.taken()


def _forest(sigs: DataFrame, count: int, trees: int, numbers: int, depth: int, seed: int) -> DataFrame:
    """(kind, key, more, a, b): what the sorted orders tell. A dense stretch of an order is cut into partitions like any
    other; regions at the edges of a partition come out as such."""
    leaves = sorted_leaves(sigs, count, trees, numbers, seed)
    return materialise(leaves.mapInArrow(lambda b: _read_sorted(b, numbers, depth), "kind tinyint, key bigint, more bigint, a bigint, b bigint"), "forest")


def _meet_edges(forest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, members of crowded regions) of the regions at the edges of partitions."""
    rows = forest.where(F.col("kind") == _Reader.EDGE).select("key", "more", F.col("a").alias("id"))
    sizes = rows.groupBy("key", "more").agg(F.count("*").alias("n")).where("n > 1")
    sized = rows.join(sizes, ["key", "more"])
    lists = sized.where(F.col("n") <= CROWD).groupBy("key", "more").agg(F.array_sort(F.collect_set("id")).alias("l"))
    firsts = lists.select("l", F.posexplode("l").alias("i", "a"))
    return firsts.select("a", F.explode(F.slice("l", F.col("i") + 2, F.size("l"))).alias("b")), sized.where(F.col("n") > CROWD).select("key", "more", "id")


def _in_blocks(groups: DataFrame) -> DataFrame:
    """(a, b), a < b, of every two members of a group (key, more, id): blocks of about BLOCK members meet each other, so
    no task gets a group."""
    sizes = groups.groupBy("key", "more").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("n"))
    placed = groups.join(sizes, ["key", "more"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    all_blocks = F.sequence(F.lit(0), F.col("n") - 1)
    left = placed.select("key", "more", F.col("block").alias("x"), F.explode(F.filter(all_blocks, lambda y: y >= F.col("block"))).alias("y"), F.col("id").alias("p"))
    right = placed.select("key", "more", F.col("block").alias("y"), F.explode(F.filter(all_blocks, lambda x: x <= F.col("block"))).alias("x"), F.col("id").alias("q"))
    met = left.join(right, ["key", "more", "x", "y"]).where("p <> q and (x < y or p < q)")
    return met.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def candidate_pairs(sigs: DataFrame) -> DataFrame:
    """(a, b), a < b, distinct: ids of classes of `sigs` (id, sig) that are neighbours in some tree. Nothing is capped."""
    count = sigs.count()
    forest = _forest(sigs, count, TREES, 1, BASE_DEPTH, 6)
    pairs_of = lambda f: f.where(F.col("kind") == _Reader.PAIR).select("a", "b")
    at_edges, crowded_edges = _meet_edges(forest)
    pairs = pairs_of(forest).unionByName(at_edges)
    crowded = forest.where(F.col("kind") == _Reader.CROWDED).select(F.col("a").alias("id")).unionByName(crowded_edges.select("id"))
    members = materialise(crowded.distinct(), "crowded")
    n_members = members.count()
    if n_members:
        deep = _forest(sigs.join(members, "id", "left_semi"), n_members, DEEP_TREES, 2, DEEP_DEPTH, 7)
        deep_edges, dense_edges = _meet_edges(deep)
        dense = deep.where(F.col("kind") == _Reader.LEAF).select("key", "more", F.col("a").alias("id")).unionByName(dense_edges).distinct()
        pairs = pairs.unionByName(pairs_of(deep)).unionByName(deep_edges).unionByName(_in_blocks(dense))
    return pairs.distinct()


def _only(rows: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """The rows whose `name` is among the distinct ones of `wanted` (a written table). A broadcast filter of buckets
    goes first, so that most of the others aren't shuffled: at most MOST_FILTER rows of one number each, whatever the corpus."""
    buckets = min(MOST_FILTER, max(LEAST_FILTER, 1 << (4 * wanted.count()).bit_length()))
    bucket = F.pmod(F.xxhash64(name), F.lit(buckets)).alias("_bucket")
    near = rows.withColumn("_bucket", bucket).join(F.broadcast(wanted.select(bucket).distinct()), "_bucket", "left_semi").drop("_bucket")
    return near.join(wanted, name, "left_semi")


def _ends(pairs: DataFrame, name: str) -> DataFrame:
    """The distinct ends of pairs (a, b), as `name`."""
    return materialise(pairs.select(F.explode(F.array("a", "b")).alias(name)).distinct(), "wanted")


def may_be_alike(a: list[bytes], b: list[bytes], threshold: float) -> np.ndarray:
    """Which pairs of shingle sets, given by 16 bits of each shingle, may reach the threshold.

    Shingles that fall together lower what is common by about n^2 / 2^17 of n; twice that and three more are allowed.
    """
    na, nb = (np.array([len(x) // 2 for x in side]) for side in (a, b))
    both = np.frombuffer(b"".join(a) + b"".join(b), np.uint16).astype(np.int64)
    both |= np.concatenate([np.repeat(np.arange(len(a)), na), np.repeat(np.arange(len(b)), nb)]) << 16
    both.sort()
    common = np.bincount(both[1:][both[1:] == both[:-1]] >> 16, minlength=len(a))
    return common + 3 + np.minimum(na, nb) ** 2 / (1 << 16) >= threshold * (na + nb - common)


def _likely(pairs: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of ids of `sigs` (id, grams) that may be similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                ok = pa.array(may_be_alike(part.column(2).to_pylist(), part.column(3).to_pylist(), threshold))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(ok), part.column(1).filter(ok)], names=["a", "b"])

    known = _only(sigs.select("id", "grams"), _ends(pairs, "id"), "id")
    side = lambda c: known.select(F.col("id").alias(c), F.col("grams").alias(f"{c}_grams"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_grams", "b_grams").mapInArrow(run, "a bigint, b bigint")


def jaccard(a: str, b: str, k: int) -> float:
    """Share of the distinct runs of k words of either text that are in both; 0 if a text has none."""
    wa, wb = words(a), words(b)
    x, y = ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (wa, wb))
    return len(x & y) / len(x | y) if x and y else 0.0


def similar_classes(texts: DataFrame, k: int = 5, threshold: float = 0.8, least: int = 1) -> DataFrame:
    """(a, b, similarity), a < b, for classes of equal texts (columns cls, text, body) at least `threshold` alike."""
    sigs = materialise(signatures(texts, k, least).withColumn("id", F.monotonically_increasing_id()), "signatures")
    found = materialise(candidate_pairs(sigs), "candidates")
    named = lambda c: sigs.select(F.col("id").alias(c), F.col("cls").alias(f"{c}_cls"))
    likely = _likely(found, sigs, threshold).join(named("a"), "a").join(named("b"), "b")
    pairs = materialise(likely.select(F.col("a_cls").alias("a"), F.col("b_cls").alias("b")), "likely")
    needed = _only(texts.select("cls", "text"), _ends(pairs, "cls"), "cls")
    held = materialise(needed.groupBy("cls").agg(F.first("text").alias("text")), "candidate-texts")
    side = lambda c: held.select(F.col("cls").alias(c), F.col("text").alias(f"{c}_text"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(j) for j in range(4))
            j = np.array([jaccard(s, t, k) for s, t in zip(x.to_pylist(), y.to_pylist(), strict=True)])
            ok = pa.array(j >= threshold, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(ok), b.filter(ok), pa.array(j[j >= threshold], pa.float64())], names=["a", "b", "similarity"])

    verified = joined.select("a", "b", "a_text", "b_text").mapInArrow(run, "a bigint, b bigint, similarity double")
    return verified.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


def with_class(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds cls, a 64-bit hash of the text: equal texts are one class."""
    return rows.withColumn("cls", F.xxhash64(text))


def near_duplicates(rows: DataFrame, k: int = 5, threshold: float = 0.8, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """For `rows` (id, text, body): (membership, links).

    membership is (id, cls), one row per distinct id and class of equal texts; links is (a, b, similarity) between
    classes. Defined cases: rows with a null id, null or empty text, a body of fewer than `least` words or a text of
    fewer than k words are in no class; an id whose rows have several texts is in several classes; repeated rows count
    once; an empty table gives empty results.
    """
    keyed = with_class(rows.where("id is not null and text is not null and body is not null"))
    links = materialise(similar_classes(keyed, k, threshold, least), "links")
    return keyed.select("id", "cls").distinct(), links


def duplicate_id_pairs(rows: DataFrame, k: int, threshold: float, least: int) -> DataFrame:
    """(id_a, id_b), id_a < id_b, distinct: ids with texts at least `threshold` alike, copies included.

    Copies qualify under the same conditions as other texts: the body has at least `least` words.
    """
    members, links = near_duplicates(rows, k, threshold, least)
    # A class is of use if it has a link, or several ids; both sides of the joins below hold nothing else.
    in_links = links.select(F.col("a").alias("cls")).unionByName(links.select(F.col("b").alias("cls"))).distinct()
    sized = members.withColumn("n", F.count("*").over(Window.partitionBy("cls")))
    linked = sized.join(in_links.withColumn("linked", F.lit(True)), "cls", "left").where("linked or n > 1")
    held = materialise(linked.select("id", "cls", "n"), "members")
    long_enough = materialise(_qualified(rows, held.where("n > 1"), k, least), "copies")
    side = lambda c: held.select(F.col("cls").alias(c), F.col("id").alias(f"id_{c}"))
    across = links.join(side("a"), "a").join(side("b"), "b").select("id_a", "id_b")
    same = long_enough.select("cls", F.col("id").alias("id_a")).join(long_enough.select("cls", F.col("id").alias("id_b")), "cls").select("id_a", "id_b")
    both = across.unionByName(same).where("id_a <> id_b")
    return both.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()


def _qualified(rows: DataFrame, copies: DataFrame, k: int, least: int) -> DataFrame:
    """The rows of `copies` (id, cls) whose text takes part: one text of each class is looked at."""
    classes = materialise(copies.select("cls").distinct(), "wanted")
    # Java's letters and digits stand for Python's here; the count of words is the same.
    n_words = lambda c: F.size(F.regexp_extract_all(F.col(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    texts = _only(with_class(rows.where("text is not null and body is not null")).select("cls", "text", "body"), classes, "cls")
    # One text a class first, so that the words of no other text are counted.
    one = texts.groupBy("cls").agg(F.first("text").alias("text"), F.max("body").alias("body"))
    fit = one.where((n_words("body") >= least) & (n_words("text") >= k)).select("cls")
    return copies.select("id", "cls").join(fit, "cls", "left_semi")
