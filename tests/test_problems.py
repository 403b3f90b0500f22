"""Trailing totals, lateness and exactly-once delivery against brute force, with awkward inputs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import lateness, rolling
from tidewell.plans import problems
from tidewell.streaming import dedup

D = dt.datetime
EVENT = "record_id bigint, item_id string, asset string, published_at timestamp, polarity double, magnitude double, day string, n int"


def events(spark, rows):
    return spark.createDataFrame(rows, EVENT)


def brute_totals(rows, windows):
    once = {}
    for rid, _, asset, at, p, m, *_ in rows:
        if at is None:
            continue
        a = None if asset is None else asset.strip().lstrip("$").strip().upper()
        ok = lambda v, lo, hi: v if v is not None and v == v and lo <= v <= hi else None
        once[rid] = (a, at.date(), ok(p, -1, 1), ok(m, 0, 1))
    days = [d for a, d, *_ in once.values() if a]
    out = {}
    for a in {a for a, *_ in once.values() if a}:
        d = min(days)
        while d <= max(days):
            row = []
            for w in windows:
                hit = [r for r in once.values() if r[0] == a and d - dt.timedelta(days=w) < r[1] <= d]
                ps, ms = [r[2] for r in hit if r[2] is not None], [r[3] for r in hit if r[3] is not None]
                row += [len(hit), sum(ps), sum(ps) / len(ps) if ps else None, sum(ms), sum(ms) / len(ms) if ms else None]
            out[a, d] = row
            d += dt.timedelta(days=1)
    return out


@pytest.mark.parametrize("windows", [(7, 30), (1, 2, 3, 5), (31, 64)])
def test_trailing_totals(spark, windows):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        asset = rng.choice(["BTC", "btc", " BTC", "$BTC", "ETH", None, ""])
        p = rng.choice([0.5, -0.25, 1.0, None, float("nan"), 7.0])
        m = rng.choice([0.5, 0.1, None, 9.0])
        at = rng.choice([None, D(2024, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 80))])
        rows.append((i, "x", asset, at, p, m, "clash", 1))
    rows += rows[:30]  # repeated rows
    got = rolling.event_trailing_totals(events(spark, rows), windows)
    want = brute_totals(rows, windows)
    seen = {}
    for r in got.collect():
        seen[r.asset, r.day] = [v for w in windows for v in (r[f"n_{w}d"], float(r[f"polarity_sum_{w}d"]), r[f"polarity_avg_{w}d"], float(r[f"magnitude_sum_{w}d"]), r[f"magnitude_avg_{w}d"])]
    assert seen.keys() == want.keys()
    for k, v in want.items():
        assert seen[k] == pytest.approx(v), k


def test_trailing_totals_of_nothing(spark):
    assert rolling.event_trailing_totals(events(spark, [])).count() == 0


def test_late_events(spark):
    close = D(2024, 1, 4)  # day 2024-01-01 ends on the 2nd and closes 48 hours later
    rows = [
        ("on time", D(2024, 1, 1, 12), D(2024, 1, 1, 13)), ("late", D(2024, 1, 1, 12), close - dt.timedelta(microseconds=1)), ("at closing", D(2024, 1, 1, 12), close),
        ("after", D(2024, 1, 1), D(2024, 2, 1)), ("before its time", D(2024, 1, 1), D(2023, 12, 1)), ("no event time", None, D(2024, 1, 1)), ("no arrival", D(2024, 1, 1), None),
        (None, D(2024, 1, 1), D(2025, 1, 1)), ("after", D(2024, 1, 1), D(2024, 2, 1)),
    ]
    df = spark.createDataFrame(rows, "id string, published_at timestamp, arrived timestamp").withColumn("us", F.unix_micros("published_at"))
    assigned = lateness.assign_period(df, "us", "arrived")
    path = lateness.append_batches(assigned, None, "id")
    lateness.append_batches(assigned.where("arrived >= timestamp '2024-01-04'"), None, "id", path)  # batches that run again replace themselves
    state = lateness.stored(spark, path)
    named = lateness.refused_records(state).collect()
    assert sorted(r.id for r in named) == ["after", "at closing"]
    r = lateness.combine(state).collect()
    assert len(r) == 1 and (r[0].n, r[0].n_late, r[0].n_refused) == (4, 1, 4)
    early = lateness.combine(state, as_of="2024-01-01").collect()
    assert early[0].n == 2
    assert lateness.stored(spark, lateness.append_batches(assigned.limit(0), None, "id", path)).count() == state.count()
    assert lateness.combine(lateness.partial_aggregates(assigned.limit(0))).count() == 0


def test_a_batch_with_many_refused(spark, monkeypatch):
    monkeypatch.setattr(lateness, "REFUSED_A_FILE", 7)
    rows = [(f"r{i}", D(2024, 1, 1), D(2024, 2, 1)) for i in range(90)] + [("ok", D(2024, 1, 1), D(2024, 1, 1)), ("r0", D(2024, 1, 1), D(2024, 2, 1))]
    df = spark.createDataFrame(rows, "id string, published_at timestamp, arrived timestamp").withColumn("us", F.unix_micros("published_at"))
    state = lateness.stored(spark, lateness.append_batches(lateness.assign_period(df, "us", "arrived"), None, "id"))
    assert sorted(r.id for r in lateness.refused_records(state).collect()) == sorted(f"r{i}" for i in range(90))
    assert [(r.n, r.n_refused, r.n_batches) for r in lateness.combine(state).collect()] == [(1, 91, 2)]


def test_partials_merge_in_any_order(spark, small):
    a = problems._assigned_events(spark, small)
    whole = lateness.combine(lateness.partial_aggregates(a))
    halves = lateness.partial_aggregates(a.where("record_id % 2 = 0")).unionByName(lateness.partial_aggregates(a.where("record_id % 2 = 1")))
    cols = ["period", "n", "n_late", "n_refused"]
    assert sorted(map(tuple, whole.select(cols).collect())) == sorted(map(tuple, lateness.combine(halves).select(cols).collect()))


def _deliveries(spark, tmp_path, rows, files=1):
    path = str(tmp_path / "feed.parquet")
    schema = "id string, delivery_id bigint, at timestamp, key string"
    df = spark.createDataFrame(rows, schema)
    for k in range(files):  # later files hold later deliveries
        df.where(f"delivery_id % {files} = {k}" if files > 1 else "true").coalesce(1).write.mode("append").parquet(path)
    return path, spark.read.parquet(path).select("id", "delivery_id", "at").schema


def _check(spark, path, schema, rows, **kw):
    out = dedup.keep_first(spark, [dedup.Feed(path, schema, "id", "delivery_id", "at")], **kw)
    kept, dropped = dedup.settle(spark.createDataFrame([(0, r[0], r[1]) for r in rows], "tag int, key string, row_id bigint"), dedup.kept_rows(spark, out))
    keep, drop = [r.row_id for r in kept.collect()], [r.row_id for r in dropped.collect()]
    by_id = {r[1]: r[0] for r in rows}
    named = [r for r in rows if r[0] is not None]
    assert sorted(by_id[k] for k in keep) == sorted({r[0] for r in named})
    assert sorted(keep + drop) == sorted(r[1] for r in named)


def test_exactly_one_copy(spark, tmp_path):
    rows = [(f"m{i % 40}" if i % 3 else "hot", i, D(2024, 1, 1) + dt.timedelta(hours=i % 50), "clash") for i in range(300)] + [(None, 1000, None, None), ("solo", 1001, None, "x" * 1000)]
    path, schema = _deliveries(spark, tmp_path, rows)
    _check(spark, path, schema, rows)


def test_one_copy_across_batches_and_beyond_the_watermark(spark, tmp_path):
    base = D(2024, 1, 1)
    rows = [("a", 1, base, ""), ("b", 2, base + dt.timedelta(days=100), ""), ("a", 3, base + dt.timedelta(days=101), ""), ("late", 4, base, ""), ("late", 5, base, ""), ("c", 6, base + dt.timedelta(days=200), "")]
    path, schema = _deliveries(spark, tmp_path, rows, files=3)
    _check(spark, path, schema, rows, delay="1 day", max_bytes_per_trigger=1)


def test_a_restart_continues(spark, tmp_path):
    rows = [("a", 1, D(2024, 1, 1), ""), ("b", 2, D(2024, 1, 1), "")]
    path, schema = _deliveries(spark, tmp_path, rows)
    out, ck = f"file://{tmp_path}/out", f"file://{tmp_path}/ck"
    dedup.keep_first(spark, [dedup.Feed(path, schema, "id", "delivery_id", "at")], out=out, checkpoint=ck)
    spark.createDataFrame([("a", 3, D(2024, 1, 2), ""), ("c", 4, D(2024, 1, 2), "")], "id string, delivery_id bigint, at timestamp, key string").write.mode("append").parquet(path)
    dedup.keep_first(spark, [dedup.Feed(path, schema, "id", "delivery_id", "at")], out=out, checkpoint=ck)
    assert sorted(r.row_id for r in dedup.kept_rows(spark, out).collect()) == [1, 2, 4]


def test_feeds_do_not_share_identifiers_or_row_numbers(spark, tmp_path):
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    feeds = []
    for d in ("a", "b"):
        path, schema = _deliveries(spark, tmp_path / d, [("m", 1, D(2024, 1, 1), ""), ("m", 2, D(2024, 1, 1), "")])
        feeds.append(dedup.Feed(path, schema, "id", "delivery_id", "at"))
    kept = dedup.kept_rows(spark, dedup.keep_first(spark, feeds))
    assert sorted(r.tag for r in kept.collect()) == [0, 1]
    rows = spark.createDataFrame([(t, "m", i) for t in (0, 1) for i in (1, 2)], "tag int, key string, row_id bigint")
    keep, drop = dedup.settle(rows, kept)
    assert keep.count() == 2 and drop.count() == 2


def test_no_deliveries(spark, tmp_path):
    path, schema = _deliveries(spark, tmp_path, [])
    _check(spark, path, schema, [])
