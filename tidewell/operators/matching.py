"""Matching texts to a universe of symbols, and novelty of headlines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidewell.functions.text import ALIASES

#: Characters of a word; everything else separates.
TOKEN_BREAK = r"[^\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.upper(text), TOKEN_BREAK), lambda t: t != ""))


def match_symbols(texts: DataFrame, universe: DataFrame, id_col: str, text: str, month: str | None = None) -> DataFrame:
    """(id, symbol): the symbol of `universe` (symbol, and month if given) that each text names; texts without one drop out.

    Full names come before symbols and longer before shorter, then by the alphabet. Every text is cut into words once
    and the words meet the names in a hash join, so the work does not grow with texts times symbols. A word that a
    third of all texts share meets one row of the small side.
    """
    spark = texts.sparkSession
    on = [month] if month else []
    names = spark.createDataFrame(sorted(ALIASES.items()), "word string, symbol string")
    by_alias = universe.join(names, "symbol").select(*on, "symbol", "word", F.lit(1).alias("pass"))
    by_symbol = universe.select(*on, "symbol", F.col("symbol").alias("word"), F.lit(2).alias("pass"))
    known = by_alias.unionByName(by_symbol).distinct()
    words = texts.select(id_col, *on, F.explode(tokens(F.col(text))).alias("word"))
    hits = words.join(known, [*on, "word"])
    best = hits.groupBy(id_col).agg(F.min(F.struct("pass", (-F.length("word")).alias("len"), "word", "symbol")).alias("b"))
    return best.select(id_col, F.col("b.symbol").alias("symbol"))


#: Events that are settled together, the products of events and words held at once, and the words from which a text is
#: multiplied on its own.
TOGETHER, AT_ONCE, LONG = 96, 4_000_000, 40


def _best(ask: np.ndarray, lo: np.ndarray, hi: np.ndarray, rows: np.ndarray, hashes: np.ndarray, ptr: np.ndarray, word: np.ndarray, tf: np.ndarray, n_words: int) -> np.ndarray:
    """The greatest cosine of each event (its row `ask`) over the texts rows[lo:hi] without those of its own hash. Row r has
    the words word[ptr[r]:ptr[r + 1]], tf times each. lo and hi rise, so a text is in the windows of consecutive events."""
    n, d0 = len(ask), lo[0]
    docs, lo, hi = rows[d0 : hi[-1]], lo - d0, hi - d0
    size = ptr[docs + 1] - ptr[docs]
    spread = lambda at, m: np.repeat(at - np.concatenate(([0], np.cumsum(m)[:-1])), m) + np.arange(m.sum())
    own_size = ptr[ask + 1] - ptr[ask]
    own, own_at, held = spread(ptr[ask], own_size), np.repeat(np.arange(n), own_size), spread(ptr[docs], size)
    used = np.zeros(n_words, bool)
    used[word[own]] = used[word[held]] = True
    local, n_local = np.cumsum(used) - 1, int(used.sum())

    j = np.arange(len(docs))[:, None]
    there = (j >= lo) & (j < hi)
    same = there & (hashes[docs][:, None] == hashes[ask])
    there &= ~same
    n_docs = there.sum(axis=0) + 1
    # document frequencies: +1 from the first event that sees the text, -1 from the first that no longer does
    begins, ends = np.searchsorted(hi, j[:, 0], "right"), np.searchsorted(lo, j[:, 0], "right")
    at = local[word[held]] * (n + 1)
    count = lambda x: np.bincount(x, minlength=n_local * (n + 1))
    df = (count(at + np.repeat(begins, size)) - count(at + np.repeat(ends, size))).reshape(n_local, n + 1).cumsum(axis=1)[:, :n]
    own_word = local[word[own]]
    df[own_word, own_at] += 1
    of, by = np.nonzero(same)
    if len(of):
        twice = spread(ptr[docs[of]], size[of])
        df -= np.bincount(local[word[twice]] * n + np.repeat(by, size[of]), minlength=n_local * n).reshape(n_local, n)

    logs = np.log(np.arange(1, n_docs.max() + 2))
    both = np.zeros((n_local, 2, n))  # squares of idf, and those times the event's own counts
    both[:, 0] = (logs[n_docs] - logs[df] + 1) ** 2
    both[own_word, 1, own_at] = both[own_word, 0, own_at] * tf[own]
    length2 = np.bincount(own_at, both[own_word, 1, own_at] * tf[own], n)

    sums = np.zeros((len(docs), 2, n))  # squared lengths and products, one word of every text at a time
    order = np.argsort(-size, kind="stable")
    n_long = int((size > LONG).sum())
    for d in order[:n_long]:
        its = slice(ptr[docs[d]], ptr[docs[d] + 1])
        w, t = local[word[its]], tf[its]
        sums[d, 0], sums[d, 1] = (t * t) @ both[w, 0], t @ both[w, 1]
    short = order[n_long:]
    first, left = ptr[docs[short]], size[short]
    part = np.zeros((len(short), 2, n))
    for k in range(int(left.max(initial=0))):
        m = int(np.searchsorted(-left, -k, "left"))
        w, t = local[word[first[:m] + k]], tf[first[:m] + k]
        add = both[w]
        if (t > 1).any():
            add *= np.stack([t * t, t], axis=1)[:, :, None]
        part[:m] += add
    sums[short] = part
    inside = there & (sums[:, 0] > 0)
    cos2 = np.divide(sums[:, 1] ** 2, sums[:, 0], out=np.zeros_like(sums[:, 0]), where=inside)
    return np.sqrt(cos2.max(axis=0) / length2)


def _settle(t: pa.Table, us: int) -> tuple[pa.RecordBatch, pa.Table]:
    """(id, novelty) of the events in `t`, which has whole windows in the order of key and time; the rows of it that later
    events may have in theirs."""
    column = lambda c: t[c].combine_chunks()
    codes = lambda c: column(c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    flag = lambda c: column(c).to_numpy(zero_copy_only=False)
    timed, at = column("at").is_valid().to_numpy(zero_copy_only=False), column("at").fill_null(np.iinfo(np.int64).min // 2).to_numpy()
    asset, start, hashes = codes("asset"), column("start").to_numpy(), codes("hash")
    key = np.concatenate(([0], np.cumsum((np.diff(asset) != 0) | (np.diff(start) != 0))))
    lists = pc.split_pattern(column("text").fill_null(""), " ")
    words = lists.flatten().dictionary_encode()
    n_words = max(1, len(words.dictionary))
    cells = np.repeat(np.arange(t.num_rows), np.diff(lists.offsets.to_numpy())) * n_words + words.indices.to_numpy()
    cells, tf = np.unique(cells[(pc.not_equal(words.dictionary, "").to_numpy(zero_copy_only=False))[words.indices.to_numpy()]], return_counts=True)
    word, ptr = cells % n_words, np.searchsorted(cells // n_words, np.arange(t.num_rows + 1))

    known = timed & (hashes >= 0)
    rows, ask = np.nonzero(known & flag("post"))[0], np.nonzero(known & flag("ask") & (np.diff(ptr) > 0))[0]
    times = np.unique(at)
    place = lambda k, x: k * (len(times) + 1) + np.searchsorted(times, x)
    of_rows = place(key[rows], at[rows])
    lo, hi = (np.searchsorted(of_rows, place(key[ask], x)) for x in (at[ask] - us, at[ask]))
    ask, lo, hi = (x[lo < hi] for x in (ask, lo, hi))
    novelty = np.ones(t.num_rows)
    upto, own = (np.concatenate(([0], np.cumsum(ptr[x + 1] - ptr[x] + 1))) for x in (rows, ask))
    i = 0
    while i < len(ask):
        n = min(TOGETHER, len(ask) - i)
        while n > 1 and (upto[hi[i + n - 1]] - upto[lo[i]] + own[i + n] - own[i]) * n > AT_ONCE:
            n //= 2
        block = slice(i, i + n)
        novelty[ask[block]] = np.clip(1 - _best(ask[block], lo[block], hi[block], rows, hashes, ptr, word, tf, n_words), 0, 1)
        i += n
    asked = np.nonzero(flag("ask"))[0]
    out = pa.RecordBatch.from_arrays([column("id").take(pa.array(asked)), pa.array(novelty[asked])], ["id", "novelty"])
    held = rows[(key[rows] == key[-1]) & (at[rows] >= at[-1] - us)]
    kept = t.take(pa.array(held))
    return out, kept.set_column(kept.schema.get_field_index("ask"), kept.schema.field("ask"), pa.array(np.zeros(len(held), bool)))


def novelty(events: DataFrame, pool: DataFrame, hours: int = 48) -> DataFrame:
    """(id, novelty): 1 - the greatest cosine between an event's text and the texts of its asset in the `hours` before it.

    Weights are tf-idf fitted per event on its own window: counts x (ln((1 + n) / (1 + df)) + 1), L2-normalised. An
    event without a window, without time or without words is fully new (1.0). Columns: id, asset, ts, text, hash; rows
    with the event's own hash are no window, those without a hash are in none.

    Work: rows are moved once, to the stretch of time (two windows long) and asset that they are in; those of the last
    `hours` of a stretch to the next one also. There they are read in the order of time, with the rows of one window
    held; every pair is compared in memory and none is written.
    """
    us = hours * 3_600_000_000

    def rows(df: DataFrame, ask: bool, post: bool) -> DataFrame:
        at = F.when(F.col("asset").isNotNull() & F.col("id").isNotNull(), F.unix_micros("ts"))
        plain = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9_]+", " "))
        return df.select("id", "asset", at.alias("at"), F.unhex(F.md5(F.col("hash").cast("string"))).alias("hash"), plain.alias("text"), F.lit(ask).alias("ask"), F.lit(post).alias("post"))

    both = rows(events, True, True) if pool is events else rows(events, True, False).unionByName(rows(pool, False, True))
    past = F.pmod("at", F.lit(2 * us))
    first = F.coalesce(F.col("at") - past, F.pmod(F.xxhash64("id"), F.lit(1024)))
    starts = F.when(F.col("post") & (past >= us), F.array(first, first + 2 * us)).otherwise(F.array(first))
    placed = both.where("ask or (at is not null and hash is not null)").select("*", first.alias("first"), F.explode(starts).alias("start"))
    placed = placed.withColumn("ask", F.col("ask") & (F.col("start") == F.col("first"))).drop("first")

    def run(batches):
        held, wait, n = None, [], 0
        for batch in batches:
            wait.append(pa.Table.from_batches([batch]))
            n += batch.num_rows
            if n and n >= 4 * (held.num_rows if held else 0):
                out, held = _settle(pa.concat_tables([held, *wait] if held else wait), us)
                wait, n = [], 0
                yield out
        if n:
            yield _settle(pa.concat_tables([held, *wait] if held else wait), us)[0]

    kind = events.schema["id"].dataType.simpleString()
    return placed.repartition("asset", "start").sortWithinPartitions("asset", "start", "at").mapInArrow(run, f"id {kind}, novelty double")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], policy: str, order: list[Column] | None = None) -> DataFrame:
    """Old and new rows with one row a key. Policies: existing_wins, last_wins (the new row), first_wins (within all rows
    by `order`). `order` decides within one side, nulls first; what is still alike is decided by the row itself, so the
    result doesn't depend on partitions. One row a key leaves each task, so a hot key costs no more than any other.
    Columns of a map type can't be compared; they take no part in breaking ties."""
    ranks = {"existing_wins": (0, 1), "last_wins": (1, 0), "first_wins": (0, 0)}
    if policy not in ranks:
        raise ValueError(f"unknown policy {policy!r}")
    a, b = ranks[policy]
    both = old.withColumn("_side", F.lit(a)).unionByName(new.withColumn("_side", F.lit(b)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys and c != "_side"]
    plain = [F.col(c) for c in rest if not isinstance(both.schema[c].dataType, T.MapType)]
    rank = F.struct("_side", *[o.alias(f"o{i}") for i, o in enumerate(order or [])], *plain)
    best = both.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in rest]), rank).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in both.columns if c != "_side"])
