"""Relational and statistical operators: boundaries, invariants, planted effects."""

import datetime as dt
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import text as X
from tidewell.functions.jsonfix import first_object, parsed_extraction
from tidewell.operators import matching, pit, series, stats
from tidewell.sources import sinks
from tidewell.sources.paged import PagedPosts
from tidewell.sources.scratch import fresh_path

T0 = dt.datetime(2024, 1, 1)
H = dt.timedelta(hours=1)


def _events(spark, rows):
    return spark.createDataFrame(rows, "asset string, published_at timestamp, polarity double, magnitude double, novelty double, confidence double, event_type string")


def _bars(spark, n, assets=("A",)):
    return spark.createDataFrame([(a, T0 + H * i) for a in assets for i in range(n)], "asset string, bar_open_ts timestamp")


@pytest.mark.parametrize("offset,seen", [(0, False), (1, False), (-1, True), (-6 * 3600 * 1000, True), (-6 * 3600 * 1000 - 1, False)])
def test_strictly_before_the_bar(spark, offset, seen):
    bar = T0 + H * 48
    ev = _events(spark, [("A", bar + dt.timedelta(milliseconds=offset), 1.0, 1.0, 1.0, 0.9, "hack"), ("B", bar - H, 1.0, 1.0, 1.0, 0.9, "hack")])
    got = pit.lookback_features(ev, _bars(spark, 60), [6]).where(F.col("bar_open_ts") == F.lit(bar)).first()
    assert got.n_events == int(seen) and got.hack_flag == int(seen)
    assert pit.visible_at(ev, "A", F.lit(bar), F.expr("interval 6 hours")).count() == int(seen)
    joined = pit.range_join(_bars(spark, 60), ev.select("asset", "published_at"), "asset", "bar_open_ts", "published_at", 6 * pit.HOUR_US)
    assert joined.where(F.col("bar_open_ts") == F.lit(bar)).count() == int(seen)


def test_single_event_values(spark):
    ev = _events(spark, [("A", T0 + H / 2, -0.5, 0.6, 0.9, 0.85, "hack")])
    r = pit.lookback_features(ev, _bars(spark, 4), [24]).orderBy("bar_open_ts").collect()
    assert [x.n_events for x in r] == [0, 1, 1, 1]
    assert r[1].mag_weighted_polarity == pytest.approx(-0.30) and r[1].novelty_polarity == pytest.approx(-0.27) and r[1].polarity_std == 0
    assert r[1].recency_polarity == pytest.approx(-0.5 * math.exp(-2 * 0.5 / 24))


def test_later_events_do_not_change_earlier_bars(spark):
    rng = random.Random(1)
    rows = [("A", T0 + dt.timedelta(minutes=rng.randrange(48 * 60)), rng.uniform(-1, 1), 0.5, 0.5, 0.5, "other") for _ in range(60)]
    cut = T0 + H * 24
    bars = _bars(spark, 48)
    a = pit.lookback_features(_events(spark, rows), bars, [24]).where(F.col("bar_open_ts") <= F.lit(cut))
    b = pit.lookback_features(_events(spark, [r for r in rows if r[1] < cut]), bars, [24]).where(F.col("bar_open_ts") <= F.lit(cut))
    key = lambda df: sorted((r.bar_open_ts, round(r.polarity_sum, 9), round(r.recency_polarity, 9)) for r in df.collect())
    assert key(a) == key(b)


def test_range_join_keeps_unmatched(spark):
    left = _bars(spark, 3, ("A", "B"))
    right = spark.createDataFrame([("A", T0 + H / 2), (None, T0)], "asset string, published_at timestamp")
    out = pit.range_join(left, right, "asset", "bar_open_ts", "published_at", pit.HOUR_US, "left")
    assert out.count() == 6 and out.where("published_at is not null").count() == 1


def test_asof(spark):
    left = spark.createDataFrame([("A", T0, 1), ("A", T0 + H, 2), ("B", T0, 3), ("A", None, 4)], "k string, t timestamp, id int")
    right = spark.createDataFrame([("A", T0, 10.0), ("A", T0, 11.0), ("A", T0 + 2 * H, 12.0)], "k string, u timestamp, v double")
    got = {r.id: r.v for r in pit.asof_join(left, right, ["k"], "t", "u", ["v"]).collect()}
    assert got == {1: 11.0, 2: 11.0, 3: None, 4: None}
    assert {r.id: r.v for r in pit.asof_join(left, right, ["k"], "t", "u", ["v"], strict=True).collect()}[1] is None


def _series(spark, values, asset="A"):
    return spark.createDataFrame([(asset, i, v) for i, v in enumerate(values)], "asset string, ts int, x double")


def test_drawdown(spark):
    r = [0.0, -0.1, -1 / 9, 0.125, 0.9 and 1.1 / 0.9 - 1]
    d = series.drawdown(_series(spark, r), "asset", "ts", "x")
    assert d.agg(F.min("dd")).first()[0] == pytest.approx(-0.2)


def test_autocorrelation_of_constant_and_short(spark):
    out = series.autocorrelation(_series(spark, [1.0] * 20).unionByName(_series(spark, [1.0, 2.0], "B")), "asset", "ts", "x", 3).collect()
    assert {(r.asset, r.lag): r.acf for r in out} == {("A", k): 1.0 for k in (1, 2, 3)}


def test_average_rank_ties(spark):
    got = {r.ts: r.r for r in _series(spark, [3.0, 1.0, 3.0, None]).withColumn("r", series.average_rank("x", ["asset"])).collect()}
    assert got == {0: 2.5, 1: 1.0, 2: 2.5, 3: None}


def test_top_minus_bottom(spark):
    rows = [(1, a, float(i + 1), float(i)) for i, a in enumerate("ABCDE")] + [(2, a, 0.0, 1.0) for a in "ABCDE"] + [(3, "A", 1.0, 1.0)]
    df = spark.createDataFrame([(t, a, x, -y if t == 1 else y) for t, a, x, y in rows], "ts int, asset string, x double, y double")
    assert [(r.ts, r.spread) for r in series.top_minus_bottom(df, "ts", "asset", "x", "y").collect()] == [(1, -4.0)]


def test_walk_forward_windows():
    w = series.walk_forward_windows(dt.date(2020, 1, 1), dt.date(2023, 12, 31))
    assert len(w) == 12 and w[0][:3] == (dt.date(2020, 1, 1), dt.date(2020, 12, 31), dt.date(2021, 1, 1)) and w[-1][3] == dt.date(2023, 12, 31)
    assert series.walk_forward_windows(dt.date(2020, 1, 1), dt.date(2020, 6, 1)) == []


def brute_nw(z, lag):
    z = np.asarray(z)
    n = len(z)
    m = min(lag, n // 4)
    d = z - z.mean()
    s = d @ d / n + sum(2 * (1 - k / (m + 1)) * (d[k:] @ d[:-k]) / n for k in range(1, m + 1))
    return z.mean() / math.sqrt(s / n) if n >= 30 and s > 0 else None


@pytest.mark.parametrize("n,lag", [(29, 3), (30, 3), (200, 12), (40, 100)])
def test_newey_west(spark, n, lag):
    z = np.random.default_rng(n).normal(0.1, 1, n)
    got = stats.newey_west(_series(spark, z.tolist()), ["asset"], "ts", "x", lag).first()
    want = brute_nw(z, lag)
    assert got.t is None if want is None else got.t == pytest.approx(want, rel=1e-9)


def test_ic_recovers_a_planted_slope(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=4000)
    y = 0.3 * x + rng.normal(size=4000)
    df = spark.createDataFrame([("A", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "asset string, ts int, x double, y double")
    assert stats.ic_products(df, ["asset"]).agg(F.avg("z")).first()[0] == pytest.approx(0.2873, abs=0.03)
    flat = df.withColumn("x", F.lit(1.0))
    assert stats.ic_products(flat, ["asset"]).count() == 0 and stats.ic_products(df.limit(29), ["asset"]).count() == 0


def test_ks_and_tvd_of_a_table_with_itself(spark):
    a = _series(spark, [1.0, 2.0, 2.0, 3.0])
    both = a.withColumn("side", F.lit(0)).unionByName(a.withColumn("side", F.lit(1)))
    r = stats.ks_two_sample(both, "x", "side", ["asset"]).withColumn("p", stats.ks_p_value(F.col("d"), F.col("n0"), F.col("n1"))).first()
    assert r.d == 0 and r.p == 1
    assert stats.total_variation(a, a, "x").first().tvd == 0


def test_fixed_effects_equal_least_squares(spark):
    rng = np.random.default_rng(2)
    cell = rng.integers(0, 5, 300)
    x1, x2 = rng.normal(size=300), rng.normal(size=300)
    y = cell + 2 * x1 - x2 + rng.normal(size=300)
    full = np.column_stack([(cell[:, None] == np.arange(5)).astype(float), x1, x2])
    want = y - full @ np.linalg.lstsq(full, y, rcond=None)[0]
    df = spark.createDataFrame([(i, "A", int(c), float(a), float(b), float(z)) for i, (c, a, b, z) in enumerate(zip(cell, x1, x2, y, strict=True))], "i int, g string, c int, x1 double, x2 double, y double")
    got = {r.i: r.resid for r in stats.fixed_effects_residual(df, ["g"], ["g", "c"], "y", "x1", "x2").collect()}
    assert [got[i] for i in range(300)] == pytest.approx(want.tolist(), abs=1e-9)


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 2)) * [1, 5] + [0, 3]
    y = x @ [1.0, -0.2] + rng.normal(size=200)
    sd = x.std(axis=0)
    z = (x - x.mean(axis=0)) / sd
    b = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y - y.mean())) / sd
    df = spark.createDataFrame([("A", float(p), float(q), float(t)) for (p, q), t in zip(x, y, strict=True)], "asset string, a double, b double, y double")
    fit = stats.ridge_fit(df, ["asset"], ["a", "b"], "y").first()
    assert fit.beta == pytest.approx(b.tolist(), rel=1e-8) and fit.intercept == pytest.approx(y.mean() - x.mean(axis=0) @ b, rel=1e-8)


def test_positions_and_sharpe_of_flat_series(spark):
    flat = _series(spark, [2.0] * 50)
    assert flat.withColumn("p", stats.position("x", ["asset"])).agg(F.max(F.abs("p"))).first()[0] == 0
    assert flat.agg(stats.sharpe("x").alias("s")).first().s is None
    p = _series(spark, np.random.default_rng(1).normal(size=200).tolist()).withColumn("p", stats.position("x", ["asset"]))
    assert p.agg(F.max(F.abs("p"))).first()[0] <= 0.15 + 1e-12


def test_bootstrap_is_seeded(spark):
    s = _series(spark, np.random.default_rng(1).normal(0.1, 1, 80).tolist())
    a, b = (stats.bootstrap_sharpe(s, ["asset"], "ts", "x", 40).first() for _ in range(2))
    assert (a.lo, a.hi) == (b.lo, b.hi) and a.lo < a.hi


def test_novelty_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = "alpha beta gamma delta epsilon zeta".split()
    rows = [(i, rng.choice("AB"), T0 + H * rng.randrange(120), " ".join(rng.choices(vocabulary, k=rng.randrange(0, 6))), f"h{i % 30}") for i in range(60)]
    rows.append((99, "A", None, "alpha", "h"))
    df = spark.createDataFrame(rows, "id int, asset string, ts timestamp, text string, hash string")
    got = {r.id: r.novelty for r in matching.novelty(df, df).collect()}
    for i, a, t, text, h in rows:
        window = [r for r in rows if t and r[2] and r[1] == a and r[4] != h and t - 48 * H <= r[2] < t]
        docs = [w[3].split() for w in window] + [text.split()]
        n = len(docs)
        weight = lambda d: {w: d.count(w) * (math.log((1 + n) / (1 + sum(w in x for x in docs))) + 1) for w in set(d)}
        v = [weight(d) for d in docs]
        norm = lambda x: math.sqrt(sum(q * q for q in x.values()))
        sims = [sum(v[-1].get(w, 0) * q for w, q in o.items()) / (norm(v[-1]) * norm(o)) for o in v[:-1] if norm(o) and norm(v[-1])]
        assert got[i] == pytest.approx(max(0, min(1, 1 - max(sims, default=0))), abs=1e-9), i


def _novelty_by_hand(events, pool):
    """The definition over plain rows (id, asset, ts, text, hash)."""
    out = {}
    for i, a, t, text, h in events:
        window = [r for r in pool if None not in (a, t, h, r[1], r[2], r[4]) and r[1] == a and r[4] != h and t - 48 * H <= r[2] < t]
        docs = [Counter((x or "").lower().split()) for x in (*(w[3] for w in window), text)]
        n, df = len(docs), Counter(w for d in docs for w in d)
        idf = {w: math.log((1 + n) / (1 + c)) + 1 for w, c in df.items()}
        norm = lambda d: math.sqrt(sum((c * idf[w]) ** 2 for w, c in d.items()))
        own = docs[-1]
        sims = [sum(c * o[w] * idf[w] ** 2 for w, c in own.items()) / (norm(own) * norm(o)) for o in docs[:-1] if o and own]
        out[i] = max(0, min(1, 1 - max(sims, default=0)))
    return out


@pytest.mark.parametrize("batch", [7, 10000])
def test_novelty_over_batches_long_texts_and_edges(spark, batch):
    rng = random.Random(11)
    say = lambda k: " ".join(f"w{int(rng.paretovariate(0.6)) % 5000}" for _ in range(k))
    at = lambda: T0 + dt.timedelta(minutes=15 * rng.randrange(4 * 150))
    row = lambda i: (i, rng.choice("AAAB"), at(), say(rng.choice([0, 1, 4, 9, 14, 60])), f"h{rng.randrange(200)}")
    rows = [row(i) for i in range(330)]
    rows += [(400 + k, "A", at(), say(4000), f"l{k}") for k in range(8)]
    # the window's two ends, the same instant, one word many times, upper case
    edge = T0 + 96 * H
    rows += [(500, "C", edge, "Old NEWS news news", "e0"), (501, "C", edge - 48 * H, "old one", "e1"), (502, "C", edge - 48 * H - dt.timedelta(microseconds=1), "news news", "e2"), (503, "C", edge, "old news", "e3"), (504, "C", edge + H, "news", "e0")]
    rows += [(600, None, edge, "old news", "n0"), (601, "C", None, "old news", "n1"), (602, "C", edge + H, None, "n2"), (603, "C", edge + H, "old news", None), (604, "C", edge + 2 * H, "old news", "n4")]
    shape = "id int, asset string, ts timestamp, text string, hash string"
    frame = lambda x: spark.createDataFrame(x, shape)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = frame(rows)
        got = {r.id: r.novelty for r in matching.novelty(df, df).collect()}
        apart = {r.id: r.novelty for r in matching.novelty(frame(rows[::2]), frame(rows[1::2])).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert got == pytest.approx(_novelty_by_hand(rows, rows), abs=1e-9)
    assert apart == pytest.approx(_novelty_by_hand(rows[::2], rows[1::2]), abs=1e-9)


def test_novelty_writes_no_pairs(spark):
    """Rows are shuffled at most twice, however many are in a window, and nothing is written besides."""
    rng = random.Random(12)
    rows = [(i, "A", T0 + dt.timedelta(minutes=i), " ".join(f"w{rng.randrange(40)}" for _ in range(10)), f"h{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "id int, asset string, ts timestamp, text string, hash string")
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm
    stages = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())

    def moved():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = stages()
        each = [found.apply(k) for k in range(found.size())]
        return {s.stageId(): (s.shuffleWriteRecords(), s.outputRecords()) for s in each}

    before = moved()
    assert matching.novelty(df, df).where("novelty < 1").count() > 250
    new = [x for k, x in moved().items() if k not in before]
    assert sum(x for x, _ in new) <= 2 * len(rows) + 50 and sum(x for _, x in new) == 0


@pytest.mark.parametrize("raw,want", [('{"a": 1}', {"a": 1}), ('x {"a": {"b": 2},} y', {"a": {"b": 2}}), ("```json\n{'a': 1}\n```", {"a": 1}), ('{"a": "}"}', {"a": "}"}), ("none", None), ("{", None), (None, None), ("", None)])
def test_first_object(raw, want):
    import json

    got = first_object(raw)
    assert (json.loads(got) if got else None) == want


def test_parsed_extraction_defaults(spark):
    df = spark.createDataFrame([('{"event_type": "hack", "polarity": 0.5, "magnitude": 1}',), ("```{'event_type': 'fork',}```",), ("no",), (None,)], "raw string")
    got = [r.p for r in df.select(parsed_extraction(F.col("raw")).alias("p")).collect()]
    assert [(g.event_type, g.polarity, g.is_default_filled) for g in got] == [("hack", 0.5, False), ("fork", 0.0, False), ("other", 0.0, True), ("other", 0.0, True)]


def test_text_functions_take_null(spark):
    r = spark.createDataFrame([(None,)], "t string").select(
        X.tag_assets(F.col("t")).alias("a"), X.mentions(F.col("t")).alias("b"), X.redact(F.col("t")).alias("c"), X.content_hash(F.col("t"), F.col("t")).alias("d"), X.ticker_of(F.col("t")).alias("e")
    ).first()
    assert r.a == [] and r.b == [] and r.c is None and len(r.d) == 64 and r.e is None
    got = spark.createDataFrame([("Bitcoin BTC on Binance SEC action",)], "t string").select(X.redact(F.col("t"), X.REDACTIONS[:6])).first()[0]
    assert got == "Asset_X Asset_X on Exchange_A Regulator_A action"


@pytest.mark.parametrize("policy,want", [("existing_wins", "old"), ("last_wins", "new"), ("first_wins", "new")])
def test_upsert_policies(spark, policy, want):
    old = spark.createDataFrame([(1, 2, "old")], "k int, o int, v string")
    new = spark.createDataFrame([(1, 1, "new"), (2, 1, "only"), (2, 1, "only")], "k int, o int, v string")
    out = {r.k: r.v for r in matching.upsert(old, new, ["k"], policy, [F.col("o")]).collect()}
    assert out == {1: want, 2: "only"}


def test_append_is_idempotent(spark):
    df = spark.createDataFrame([("a", "2021-06-01", 1), ("b", "2021-06-02", 2), ("b", "2021-06-02", 3)], "id string, day string, o int")
    path = fresh_path(spark, "idempotent")
    assert [sinks.append_new(df, path, ["id"], ["day"], [F.col("o")]) for _ in range(2)] == [2, 0]


@pytest.mark.parametrize("strict", [False, True])
def test_asof_join_across_blocks_against_brute_force(spark, strict):
    rng = random.Random(9)
    left = [(i, rng.choice(["a", "a", "a", "b", None]), T0 + dt.timedelta(minutes=rng.randrange(60 * 24 * 60))) for i in range(300)] + [(300, "a", None)]
    right = [(rng.choice(["a", "b", None]), T0 + dt.timedelta(minutes=rng.randrange(60 * 24 * 60)), k) for k in range(40)] + [("a", None, 99)]
    l, r = spark.createDataFrame(left, "id int, k string, t timestamp"), spark.createDataFrame(right, "k string, u timestamp, v int")
    got = {x.id: x.v for x in pit.asof_join(l, r, ["k"], "t", "u", ["v"], strict, 24 * pit.HOUR_US).collect()}
    for i, k, t in left:
        seen = [(u, v) for kk, u, v in right if kk == k and t and u and (u < t if strict else u <= t)]
        assert got[i] == (max(seen)[1] if seen else None), i


def test_paged_source_stops_at_the_last_id(spark, tmp_path):
    import json

    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "1.json").write_text("\n".join(json.dumps({"id": i, "title": f"t{i}"}) for i in (3, 2, 1)))
    spark.dataSource.register(PagedPosts)
    assert spark.read.format("paged_posts").option("path", str(pages)).load().count() == 3
    out, ck = str(tmp_path / "o"), str(tmp_path / "c")

    def poll():
        q = spark.readStream.format("paged_posts").option("path", str(pages)).load().writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(once=True).start()
        q.awaitTermination(60)
        return sorted(r.id for r in spark.read.parquet(out).collect())

    assert poll() == [1, 2, 3]
    (pages / "2.json").write_text("\n".join(json.dumps({"id": i, "title": f"t{i}"}) for i in (5, 4, 3)))
    assert poll() == [1, 2, 3, 4, 5]
    # Two polls, the second in two pages, taken in one go: each post once.
    (pages / "3.json").write_text("\n".join(json.dumps({"id": i}) for i in (9, 8)))
    (pages / "4.json").write_text("\n".join(json.dumps({"id": i}) for i in (7, 6, 5)))
    (pages / "5.json").write_text("\n".join(json.dumps({"id": i}) for i in (10, 9)))
    assert poll() == list(range(1, 11))
    assert sorted(r.id for r in spark.read.format("paged_posts").option("path", f"file://{pages}").load().collect()) == list(range(1, 11))
    empty = tmp_path / "none"
    empty.mkdir()
    assert spark.read.format("paged_posts").option("path", str(empty)).load().count() == 0
