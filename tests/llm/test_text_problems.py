"""Text operators against brute force, exact round trips and held-out accuracy, with awkward inputs."""

import random
import time
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidewell.llm import bpe, leakage, neardup, queries, reading, truncation

# ------------------------------------------------------------------ encoding


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(*bpe.tables())


@pytest.fixture(scope="module")
def public():
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_encoding_equals_the_public_library(encoder, public, text):
    assert encoder.encode(text) == public(text)
    assert encoder.decode(encoder.encode(text)) == text


@pytest.mark.parametrize("text", ["", " ", "\n\n \t", "<|endoftext|>", "x" * 50_000, "ab" * 20_000, " " * 9000, "don't we'll I'M", "1234567890" * 500, "é" * 999, "漢字" * 999, "👩‍🚀🇩🇪" * 99, "\x1c\x1f\x85\xa0　"])
def test_awkward_texts(encoder, public, text):
    assert encoder.encode(text) == public(text)
    assert encoder.decode(encoder.encode(text)) == text


def test_merges_one_by_one(encoder):
    """The backtracking encoder against the plain definition of the merges."""
    rank = {t: i for i, t in enumerate(encoder.tokens)}
    rng = random.Random(1)
    for _ in range(300):
        data = "".join(rng.choices("abcdehilnorst", k=rng.randrange(1, 25))).encode()
        parts = [bytes([b]) for b in data]
        while True:
            best = min(((rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in rank), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        assert list(encoder.encode_bytes(data)) == [rank[p] for p in parts]


def test_corpus_encoding(spark, encoder):
    rows = [(1, "Hello world", "a"), (2, "", "b"), (3, None, "c"), (4, "Hello world", "d"), (1, "again", "e"), (5, "y" * 100_000, "f")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in bpe.encode_corpus(df).collect())
    assert got == sorted((i, encoder.encode(t)) for i, t, _ in rows)
    assert bpe.encode_corpus(df.limit(0)).count() == 0


# ------------------------------------------------------------------- leakage

PROMPT = "Under the copper agreement 706 covered calls must be returned once the relayer skips an epoch unless a bank objects"


def _leaks(spark, texts, prompts=((1, PROMPT),), **kw):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, item string")
    items = spark.createDataFrame(list(prompts), "eval_id bigint, prompt string")
    return {(r.id, r.item) for r in leakage.leaked_items(docs, items, **kw).collect()}


def test_disguises_and_boundaries(spark):
    w = PROMPT.split()
    texts = [
        "Intro. " + PROMPT.upper() + " End.", " ".join(w[3:15]), " ".join(w[3:14]), "<b>".join(w[:1]) + " <em>" + "</em> **".join(w[1:14]) + "**", "_, ".join(w[:13]),
        "​".join(PROMPT), "&nbsp;".join(w[:12]), "<p>" + "<br>".join(w[:12]), " ".join([*w[:6], "instead", *w[7:]]), "", None, "x " * 30_000 + PROMPT, " ".join(w[:8] + ["zzz"] + w[8:12]),
    ]
    assert {d for d, _ in _leaks(spark, texts)} == {0, 1, 3, 4, 5, 6, 7, 11} | ({8} if len(w) - 7 >= 12 else set())


def test_edits_are_found_when_allowed(spark):
    w = PROMPT.split()
    texts = [" ".join([*w[:5], "other", *w[6:12]]), " ".join(w[:5] + w[6:13]), " ".join([*w[:3], "a", *w[4:8], "b", *w[9:12]])]
    assert {d for d, _ in _leaks(spark, texts, max_edits=0)} == set()
    assert {d for d, _ in _leaks(spark, texts, max_edits=2)} >= {0, 1}


def test_leaks_of_nothing(spark):
    assert _leaks(spark, [PROMPT], prompts=[(1, "too short"), (2, None)]) == set()
    assert _leaks(spark, []) == set()
    assert _leaks(spark, [PROMPT, PROMPT], prompts=[(1, PROMPT), (2, PROMPT)]) == {(0, 1), (0, 2), (1, 1), (1, 2)}


def _edited(rng, window, kind, n, known):
    w = list(window)
    for p in sorted(rng.sample(range(len(w)), n), reverse=True):
        if kind == "insertion":
            w.insert(p, rng.choice(known))
        elif kind == "deletion":
            del w[p]
        else:
            w[p] = 0 if kind == "unknown word" else rng.choice(known)
    return (w + rng.choices(known, k=n))[: len(window)]


def test_recall_near_the_items(small, duck):
    """Windows of the real items after edits of every kind, against the exact distance."""
    items = duck.execute("select eval_id, prompt from eval_items").fetchall()
    rng = random.Random(3)
    for n in range(3):
        index = leakage.ItemIndex(items, max_edits=n)
        known = range(1, len(index.vocabulary) + 1)
        # A word put in or taken out moves another over the end of the window: two edits.
        for kind, edits in (("unknown word", n), ("known word", n), ("insertion", n // 2), ("deletion", n // 2)):
            edited = [_edited(rng, rng.choice(index.rows), kind, edits, known) for _ in range(250)]
            ids = np.array(edited, np.int32).ravel()
            found = {s // 12 for s, _, _ in index.search(ids, np.arange(250) * 12)}
            near = [i for i, w in enumerate(edited) if n == 0 or (leakage.edit_distances(np.tile(np.array(w, np.int32), (len(index.rows), 1)), index.rows, n) <= n).any()]
            assert found <= set(near)
            assert len(found) >= (1 if n == 0 else 0.95) * len(near), (kind, n, len(found), len(near))
            assert len(near) > 240


def test_cost_does_not_hang_on_the_vocabulary():
    """Every window of a text of the items' own words is walked, and the walks find what brute force finds."""
    rng = random.Random(5)
    common = [f"w{k}" for k in range(200)]
    items = [(i, " ".join(rng.choices(common, k=40))) for i in range(240)]
    index = leakage.ItemIndex(items)
    text = " ".join([*rng.choices(common, k=400_000), items[7][1], *rng.choices(common, k=50), " ".join(items[9][1].split()[5:18])])
    ids = np.array([index.vocabulary[w] for w in leakage.words(text)], np.int32)
    start = time.process_time()
    found = index.search(ids, np.arange(len(ids) - 11))
    assert time.process_time() - start < 5
    assert {o for _, w, _ in found for o in index.owners[w]} == {7, 9} and len(found) == 29 + 2


def test_items_beyond_one_pass(spark, monkeypatch):
    prompts = [(i, f"{PROMPT} number {i}") for i in range(20)]
    texts = [f"Text {p} ends" for _, p in prompts]
    one = _leaks(spark, texts, prompts)
    monkeypatch.setattr(leakage, "ITEMS_A_PASS", 6)
    assert _leaks(spark, texts, prompts) == one and len(one) == 400


@pytest.mark.parametrize("text", ["<" + " " * 100_000, "<!--" * 30_000, "&#" + "9" * 100_000 + ";", "<b" * 50_000, "&" * 100_000, "<" * 100_000, "x" * 300_000, " " * 300_000, "<!--" + "<b>" * 50_000 + "-->"])
def test_words_of_long_runs(text):
    start = time.process_time()
    leakage.words(text)
    assert time.process_time() - start < 0.5


def test_edit_distances():
    import itertools

    def plain(a, b):
        d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1)}
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        return d[len(a), len(b)]

    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 3, (2, 50, 6))
    assert leakage.edit_distances(a, b, 6).tolist() == [plain(list(x), list(y)) for x, y in zip(a, b, strict=True)]


def test_leakage_on_the_small_tables(spark, small, duck):
    index = defaultdict(set)
    for e, p in duck.execute("select eval_id, prompt from eval_items").fetchall():
        w = leakage.words(p)
        for k in range(len(w) - 11):
            index[tuple(w[k : k + 12])].add(e)
    want = set()
    for d, t in duck.execute("select doc_id, text from documents where text is not null").fetchall():
        w = leakage.words(t)
        want |= {(d, e) for k in range(len(w) - 11) for e in index.get(tuple(w[k : k + 12]), ())}
    assert {tuple(r) for r in queries.p8_found(spark, small).select("doc_id", "eval_id").collect()} == want


# ------------------------------------------------------------ near duplicates


def _versions(rng, n, copies, length=60):
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(n):
        base = rng.choices(vocabulary, k=length)
        for j in range(copies):
            w = list(base)
            for _ in range(j * 3):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((f"{i:03d}-{j}", " ".join(w)))
    return rows


def _brute(rows, k, threshold, least):
    docs = [(i, t) for i, t in rows if i is not None and t and len(neardup.words(t)) >= max(least, k)]
    out = set()
    for x, (a, s) in enumerate(docs):
        for b, t in docs[:x]:
            if a != b and neardup.jaccard(s, t, k) >= threshold:
                out.add((min(a, b), max(a, b)))
    return out


@pytest.mark.parametrize("k,threshold", [(3, 0.5), (5, 0.8)])
def test_pairs_against_brute_force(spark, k, threshold):
    rng = random.Random(k)
    rows = _versions(rng, 40, 4) + [("copy-a", "one two three four five six seven eight"), ("copy-b", "one two three four five six seven eight"), ("null", None), ("empty", ""), (None, "x y z")]
    rows += rows[:10]
    df = spark.createDataFrame([(i, t, t, 1, "x") for i, t in rows], "id string, text string, body string, n int, cls string")
    got = {tuple(r) for r in neardup.duplicate_id_pairs(df, k, threshold, 1).collect()}
    want, near = _brute(rows, k, threshold, 1), _brute(rows, k, threshold + 0.1, 1)
    assert got <= want and ("copy-a", "copy-b") in got
    # A pair at the very threshold of 0.5 shares a prefix of four with chance 1/16 a tree.
    assert len(got) >= 0.9 * len(want) and len(got & near) >= 0.99 * len(near)


def test_hot_copies_and_crowded_regions(spark, monkeypatch):
    """A third of all rows are one text, and one story has more versions than a region holds."""
    monkeypatch.setattr(neardup, "CROWD", 6)
    rng = random.Random(8)
    rows = _versions(rng, 12, 2) + [(f"hot-{i}", "the same words again and again in every one of these rows") for i in range(30)]
    base = [f"v{k}" for k in range(80)]
    for j in range(20):
        w = list(base)
        w[j * 4] = f"x{j}"
        rows.append((f"crowd-{j}", " ".join(w)))
    df = spark.createDataFrame([(i, t, t) for i, t in rows], "id string, text string, body string")
    got = {tuple(r) for r in neardup.duplicate_id_pairs(df, 3, 0.5, 1).collect()}
    want = _brute(rows, 3, 0.5, 1)
    assert got <= want and len(got) >= 0.95 * len(want)
    members, links = neardup.near_duplicates(df, 5, 0.8, 1)
    assert members.where("id like 'hot-%'").select("cls").distinct().count() == 1 and members.count() == len(rows)


def _told(rows, depth):
    """Pairs of ids that the rows of a reader give, edges and crowded leaves met with all of their own."""
    pairs, met = set(), defaultdict(set)
    for kind, key, more, a, b in rows:
        if kind == neardup._Reader.PAIR:
            pairs.add((a, b))
        elif kind in (neardup._Reader.EDGE, neardup._Reader.LEAF):
            met[kind, key, more].add(a)
    return pairs | {(a, b) for g in met.values() for a in g for b in g if a < b}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(1, 2), st.integers(1, 400), st.integers(1, 50))
def test_sorted_orders_against_brute_force(seed, numbers, n, size):
    """Neighbours with a common prefix, whatever the batches and wherever a partition begins."""
    import pyarrow as pa

    rng = np.random.default_rng(seed)
    depth = 4 if numbers == 1 else 6
    values = rng.integers(0, 2, (n, 5 * numbers))  # few values: regions of every size and depth
    keys = [sum(values[:, 5 * k + d].astype(np.int64) << (neardup.VALUE_BITS * (4 - d)) for d in range(5)) for k in range(numbers)]
    order = np.lexsort(tuple(reversed(keys)))
    cut = int(rng.integers(0, n + 1))
    rows = []
    for part in (order[:cut], order[cut:]):
        batches = [pa.RecordBatch.from_arrays([pa.array(c[part[lo : lo + size]]) for c in (*keys, np.arange(n))], names=["key", "more", "id"][:numbers] + ["id"]) for lo in range(0, len(part), size)]
        for out in neardup._read_sorted(iter(batches), numbers, depth):
            rows += list(zip(*(c.to_pylist() for c in out.columns), strict=True))
    told = _told(rows, depth)
    groups = lambda d: [g for _, g in _grouped(values[:, :d])]
    common = {(int(a), int(b)) for g in groups(depth) for a in g for b in g if a < b}
    assert told <= common
    assert {(int(a), int(b)) for d in range(depth, 5 * numbers + 1) for g in groups(d) if len(g) <= neardup.CROWD for a in g for b in g if a < b} <= told
    crowded = {int(i) for g in groups(depth) if len(g) > neardup.CROWD for i in g}
    assert {r[3] for r in rows if r[0] == neardup._Reader.CROWDED} | {r[3] for r in rows if r[0] == neardup._Reader.EDGE} >= crowded


def _grouped(values):
    found = defaultdict(list)
    for i, v in enumerate(map(tuple, values)):
        found[v].append(i)
    return found.items()


def test_short_shingles_lose_nothing():
    rng = np.random.default_rng(4)
    for n in (1, 5, 40, 400, 20_000):
        common = rng.integers(0, 1 << 63, n)
        a, b = (np.concatenate([common, rng.integers(0, 1 << 63, n // 2)]) for _ in range(2))  # exactly half in common
        pack = lambda x: np.unique((x & 0xFFFF).astype(np.uint16)).tobytes()
        assert neardup.may_be_alike([pack(a)] * 3, [pack(b)] * 3, 0.5).all()
    assert not neardup.may_be_alike([pack(np.arange(100))], [pack(np.arange(1000, 1100))], 0.5).any()


def test_crowded_parts_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 7)
    rows = [(1, 2, i) for i in range(60)] + [(1, 3, i) for i in range(5)] + [(9, 9, 1)]
    got = [tuple(r) for r in neardup._in_blocks(spark.createDataFrame(rows, "key bigint, more bigint, id bigint")).collect()]
    assert set(got) == {(a, b) for a in range(60) for b in range(a + 1, 60)} and len(got) == 60 * 59 // 2 + 10


def test_one_story_in_hundreds_of_versions(spark):
    """A crowded region with the real settings: recall by similarity against brute force."""
    rng = random.Random(11)
    base = [f"v{k}" for k in range(150)]
    rows = []
    for j in range(220):
        w = list(base)
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((f"crowd-{j:03d}", " ".join(w)))
    df = spark.createDataFrame([(i, t, t) for i, t in rows], "id string, text string, body string")
    got = {tuple(r) for r in neardup.duplicate_id_pairs(df, 3, 0.5, 45).collect()}
    want, near = _brute(rows, 3, 0.5, 45), _brute(rows, 3, 0.6, 45)
    assert got <= want and len(want) > 10_000
    assert len(got) >= 0.95 * len(want) and len(got & near) >= 0.99 * len(near), (len(got) / len(want), len(got & near) / len(near))


def test_short_and_no_texts(spark):
    df = spark.createDataFrame([("a", "one two"), ("b", "one two"), ("c", "word " * 44), ("d", "word " * 44)], "id string, text string").withColumn("body", F.col("text"))
    assert neardup.duplicate_id_pairs(df, 3, 0.5, 45).count() == 0
    assert neardup.duplicate_id_pairs(df.limit(0), 3, 0.5, 45).count() == 0
    assert neardup.duplicate_id_pairs(spark.createDataFrame([("a", "word " * 30_000), ("b", "word " * 30_000)], "id string, text string").withColumn("body", F.col("text")), 3, 0.5, 45).count() == 1


# ---------------------------------------------------------------- truncation

SENTENCES = [
    "Shares tied to {0} fell {1}% while {2} rose to ${3}.", "The upgrade of the order book is set for Monday, the second attempt by {0} this year.",
    "{0} raised its target for {2} to ${3}, calling the outlook steady.", "Bids thinned out over the weekend and wider spreads followed at {0}.", "Insurers cut cover for the margin engine, pointing to forced liquidations.",
]


def _story(rng, n):
    fill = lambda: (rng.choice(["Oakhaven Trust", "Summit Pool", "Kestrel Labs"]), f"{rng.randrange(1, 30)}.{rng.randrange(10)}", rng.choice(["BTC", "ETH"]), f"{rng.randrange(10, 99)},{rng.randrange(100, 999)}")
    return " ".join(rng.choice(SENTENCES).format(*fill()) for _ in range(n))


def test_cut_texts(spark):
    rng = random.Random(6)
    rows, want = [], set()
    for i in range(600):
        whole = _story(rng, rng.randrange(1, 4))
        kind = i % 6
        text = whole
        if kind == 1:
            at = rng.randrange(25, len(whole) - 6)
            while whole[at - 1] in ".!? " or whole[at - 2] == ".":
                at += 1
            if at < len(whole) - 3:
                text = whole[:at]
                want.add(i)
        elif kind == 2:
            at = whole.rfind(" ", 0, len(whole) - rng.randrange(12, 30))
            if whole[at - 1] != ".":
                text = whole[:at].rstrip(",") + rng.choice(["…", "...", " […]", " [...]"])
                want.add(i)
        elif kind == 3:
            text = whole[:-1]
        elif kind == 4:
            text = whole + rng.choice([" More on this soon…", " 🚀🚀", " https://a.example/s/1", " (Reporting by the desk)"])
        rows.append(("t", i, text, None))
    rows += [("t", 1000, None, "x"), ("t", 1001, "", "x"), ("t", 1002, "   ", None), ("t", 1003, "Why lenders backed the plan", "Why lenders backed the plan")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "tbl string, id bigint, text string, title string, key string")
    got = {r.id for r in truncation.cut_texts(df).collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.02 * len(rows)
    assert not got & {1000, 1001, 1002, 1003}
    assert truncation.cut_texts(df.limit(0)).count() == 0


def test_values_that_are_prefixes_of_longer_copies(spark):
    """The join of whole values decides first; a text that stands whole elsewhere is no case."""
    long = "Quarterly filings by Zephyr Notes listed seventeen unusual counterparties across several venues."
    rows = [
        (1, long, None), (2, long[:52].rstrip(), None), (3, long[:47], None), (4, long, None), (5, "Oddly named vaults closed", "A title"), (6, "Oddly named vaults closed early today", None),
        (7, "Something else entirely", "Oddly named vaults closed"),
    ]
    df = spark.createDataFrame([("t", *r) for r in rows], "tbl string, id bigint, text string, title string")
    got = {r.id: r.rule for r in truncation.cut_texts(df).collect()}
    assert got[2].startswith("value") and got[3].startswith("value") and not {1, 4, 5} & set(got)


@pytest.mark.parametrize("text", [" " * 200_000 + "x", "x" + " " * 200_000 + "(more", "." * 100_000 + "x", "a read more" + " " * 100_000 + "x", "(" * 100_000 + ")", "[" + " more" * 50_000 + "x", "&#" + "9" * 100_000 + "; x", "<" * 100_000, "🚀 " * 100_000, "…" * 100_000])
def test_endings_of_long_runs(text):
    start = time.process_time()
    truncation.ending(text)
    truncation.stops(text)
    assert time.process_time() - start < 0.5


@pytest.mark.parametrize("text,tail,sign", [
    ("It rose to…", "It rose to", True), ("It rose to [&#8230;]", "It rose to", True), ("It rose <a h", "It rose", True), ("It rose &am", "It rose", True), ("It rose. 🚀🚀", "It rose.", False),
    ("It rose. https://a.example/x", "It rose.", False), ("It rose… (more)", "It rose", True), ("It rose... Continue reading", "It rose", True), ("It rose. (By the desk)", "It rose.", False), ("", "", False), ("<b>It</b> rose", "It rose", False),
])
def test_endings(text, tail, sign):
    assert truncation.ending(text) == (tail, sign)


# -------------------------------------------------------------------- reading


def test_held_out_accuracy(small, duck):
    rows = duck.execute("select text, level from reading_samples order by sample_id").fetchall()
    right = 0
    for k in range(5):
        model = reading.train([r for i, r in enumerate(rows) if i % 5 != k])
        memory = reading._Words(model)
        for t, level in (r for i, r in enumerate(rows) if i % 5 == k):
            level_of = reading.rate(model, memory, t).level
            right += level_of is not None and reading.LEVELS[min(2, int(level_of + 0.5))] == level
    assert right >= 0.97 * len(rows)


def test_layout_case_and_punctuation_do_not_matter(small, duck):
    rows = duck.execute("select text, level from reading_samples order by sample_id").fetchall()
    model = reading.train(rows)
    memory = reading._Words(model)
    foreign = " Der Kurs stieg am Montag um zwei Prozent, während die Börse ihre Gebühren überprüfte und die Händler auf das Ende der Sitzung warteten. "
    for t, level in rows:
        bare = "".join(c if c.isalnum() or c in "'’ \n" else " " for c in t)
        for v in (t, t.upper(), bare, "\n".join(t.split(" ")), t + foreign):
            assert reading.LEVELS[min(2, int(reading.rate(model, memory, v).level + 0.5))] == level


def test_short_texts_have_a_level_that_is_less_sure(small, duck):
    """The first words of the samples: every text gets a level; the more words, the more often the right one."""
    rows = duck.execute("select text, level from reading_samples order by sample_id").fetchall()
    model = reading.train(rows)
    memory = reading._Words(model)
    right = {}
    for n in (1, 3, 10, 19, 40):
        rated = [(reading.rate(model, memory, " ".join(reading.tokens(t)[:n])), level) for t, level in rows]
        assert all(r.level is not None for r, _ in rated)
        right[n] = sum(reading.LEVELS[min(2, int(r.level + 0.5))] == level for r, level in rated)
    assert right[40] >= right[10] and right[40] >= 0.9 * len(rows) and right[19] >= 0.7 * len(rows)


def test_graded_documents(spark, small):
    samples = spark.read.parquet(f"{small}/reading_samples.parquet")
    rows = [(1, None), (2, ""), (3, "too short"), (4, "Der Hund und die Katze sind nicht im Haus, aber sie sind auch nicht auf der Straße, und das ist für uns alle ein Problem."), (5, "0x1f " * 50), (6, "Think of it like a locked door. Say no, and tell your bank. Next, look at the list with care. We like to keep a coin on a good day. " * 900)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id bigint, text string, score double")
    got = {r.id: r for r in reading.grade_documents(df, samples).collect()}
    assert {k for k, r in got.items() if r.score is None} == {1, 2, 4}
    assert [got[k].english for k in range(1, 7)] == [None, None, True, False, True, True] and got[6].grade == "basic" and got[6].prose
    assert not got[5].prose and got[3].level is not None and got[3].error > got[6].error
    assert reading.grade_documents(df.limit(0), samples).count() == 0
    with pytest.raises(ValueError):
        reading.grade_documents(df, samples.where("level = 'basic'"))


def test_isotonic_is_monotone():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=200), rng.integers(0, 3, 200)
    xs, ys = reading.fit_isotonic(x, y)
    assert (np.diff(ys) >= -1e-12).all() and (np.diff(xs) >= 0).all()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(name, spark, small):
    assert queries.QUERIES[name](spark, small).count() >= 0
