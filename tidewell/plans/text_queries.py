"""Text, matching, provenance and ingest queries over the news tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import text as X
from tidewell.functions.jsonfix import parsed_extraction
from tidewell.operators import matching
from tidewell.operators.rolling import clean_symbol
from tidewell.plans.fixtures import r6, registry

QUERIES, SQL, query = registry()


def _re2(p: str) -> str:
    return p.replace("'", "''")


_TAG = ", ".join(f"case when regexp_matches(title, '(?i)\\b(?:{_re2(p)})\\b') then '{s}' end" for s, p in X.TAG_PATTERNS.items())


@query(f"select delivery_id, array_to_string(list_sort(list_filter([{_TAG}], lambda x: x is not null)), ',') as tags from rss_items")
def T3_tag_assets(v):
    return v.rss.select("delivery_id", F.array_join(X.tag_assets(F.col("title")), ",").alias("tags"))


_MEN = ", ".join(f"case when contains(lower(coalesce(title, '')), '{k}') then '{s}' end" for k, s in X.MENTIONS.items())


@query(f"select item_id, array_to_string(list_sort(list_distinct(list_filter([{_MEN}], lambda x: x is not null))), ',') as found from (select distinct item_id, title from raw_news)")
def T4_mentions(v):
    return v.news.select("item_id", "title").distinct().select("item_id", F.array_join(X.mentions(F.col("title")), ",").alias("found"))


def _redacted(rules) -> str:
    out = "title"
    for p, r in rules:
        out = f"regexp_replace({out}, '{_re2(p)}', '{r}', 'gi')"
    return out


@query(f"select delivery_id, {_redacted(X.REDACTIONS[:6])} as short, {_redacted(X.REDACTIONS)} as full_ from rss_items")
def T5_T6_redact(v):
    return v.rss.select("delivery_id", X.redact(F.col("title"), X.REDACTIONS[:6]).alias("short"), X.redact(F.col("title")).alias("full_"))


@query("select distinct item_id, sha256(concat(coalesce(title, ''), substring(coalesce(body, ''), 1, 500))) as content_hash, sha256(concat(coalesce(url, ''), coalesce(published_at, ''))) as made_id from raw_news")
def T7_T8_hashes(v):
    c = F.col
    return v.news.select("item_id", X.content_hash(c("title"), c("body")).alias("content_hash"), X.item_id(c("url"), c("published_at")).alias("made_id")).distinct()


@query(r"select delivery_id, trim(regexp_replace(summary, '<[^>]+>', '', 'g')) as plain, regexp_replace(lower(regexp_extract(url, 'https?://([^/]+)/?', 1)), '^www\.', '') as domain from rss_items")
def T9_T10_strip_and_domain(v):
    return v.rss.select("delivery_id", X.strip_html(F.col("summary")).alias("plain"), X.domain_of(F.col("url")).alias("domain"))


_SYMBOLS = """s as (select distinct upper(asset) || suffix as symbol from (select unnest(asset_mentions) as asset from raw_news), (values ('USDT'), ('-USDT-SWAP'), ('/USD'), ('USD'), ('')) q(suffix))"""
_BASE = "split_part(split_part(symbol, '/', 1), '-', 1)"
_CUT = "case " + " ".join(f"when ends_with(b, '{q}') and length(b) > {len(q) + 1} then left(b, length(b) - {len(q)})" for q in X.QUOTES) + " else b end"


def _market_symbols(v):
    assets = v.news.select(F.explode("asset_mentions").alias("a")).distinct()
    return assets.select(F.explode(F.array(*[F.concat(F.upper("a"), F.lit(s)) for s in ("USDT", "-USDT-SWAP", "/USD", "USD", "")])).alias("symbol")).distinct()


@query(f"with {_SYMBOLS}, c as (select symbol, {_BASE} as b from s), d as (select symbol, {_CUT} as t from c) select symbol, case when regexp_matches(t, '^[A-Z0-9]{{2,10}}$') then t end as ticker from d")
def T2_S15_tickers(v):
    """Base symbols of all listed market symbols."""
    return _market_symbols(v).select("symbol", X.ticker_of(F.col("symbol")).alias("ticker"))


_ALIAS = ", ".join(f"('{k}', '{s}')" for k, s in X.ALIASES.items())


@query(f"""with u as (select distinct upper(a) as symbol from (select unnest(asset_mentions) as a from raw_news)), al(word, symbol) as (values {_ALIAS}),
k as (select u.symbol, al.word, 1 as pass from u join al on al.symbol = u.symbol union select symbol, symbol, 2 from u),
t as (select distinct item_id, unnest(string_split_regex(upper(title), '[^\\p{{L}}\\p{{N}}_]+')) as word from (select item_id, title from raw_news)),
h as (select t.item_id, k.symbol, row_number() over (partition by item_id order by pass, -length(k.word), k.word, k.symbol) as rk from t join k on k.word = t.word)
select item_id, symbol from h where rk = 1""")
def T1_J12_match_symbol(v):
    """The symbol each headline names, by a hash join on words."""
    universe = v.news.select(F.explode("asset_mentions").alias("a")).select(F.upper("a").alias("symbol")).distinct()
    return matching.match_symbols(v.news.select("item_id", "title").distinct(), universe, "item_id", "title")


@query("select item_id, count(*) as n_rows, min(case when length(coalesce(body, '')) > 0 then body when length(coalesce(title, '')) > 0 then title else '' end) as text, min(cast(cast(coalesce(ingested_at, timestamp '1970-01-01') as date) as varchar)) as day from raw_news group by 1")
def T14_safe_text(v):
    t = X.first_text(F.col("body"), F.col("title"))
    return v.news.groupBy("item_id").agg(F.count("*").alias("n_rows"), F.min(t).alias("text"), F.min(F.to_date(F.coalesce("ingested_at", F.timestamp_seconds(F.lit(0)))).cast("string")).alias("day"))


def _sum_votes(names) -> str:
    return " + ".join(f"coalesce(votes_raw['{n}'], 0)" for n in names)


@query(f"select delivery_id, {_sum_votes(X.VOTES_FOR)} as votes_for, {_sum_votes(X.VOTES_AGAINST)} as votes_against from cryptopanic_posts")
def T15_votes(v):
    raw = F.col("votes_raw")
    return v.cp.select("delivery_id", X.votes(raw, X.VOTES_FOR).alias("votes_for"), X.votes(raw, X.VOTES_AGAINST).alias("votes_against"))


@query("select event_id, try_cast(json_extract_string(props, '$.k') as integer) as k, try_cast(json_extract_string(props, '$.missing') as double) as missing from events")
def T16_tolerant_casts(v):
    return v.table("events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), F.get_json_object("props", "$.missing").try_cast("double").alias("missing"))


@query("select item_id, date_trunc('minute', published_at) + interval 1 minute as t0 from ev", "ev")
def T17_minute_after(v):
    return v.ev.select("item_id", X.minute_after(F.col("published_at")).alias("t0"))


@query("select item_id, a as asset, count(*) as n from (select item_id, unnest(asset_mentions) as a from raw_news) group by 1, 2")
def T18_explode_mentions(v):
    return v.news.select("item_id", F.explode("asset_mentions").alias("asset")).groupBy("item_id", "asset").agg(F.count("*").alias("n"))


@query("""select item_id, round(ln(1 + magnitude), 6) as l, round(sqrt(magnitude), 6) as q, round(exp(polarity), 6) as e, cast(sign(polarity) as integer) as s, case when raw_tone is not null then least(greatest(raw_tone, 1.0), 50.0) end as clipped, (isodow(published_at) - 1) * 24 + hour(published_at) as how from ev""", "ev")
def T19_scalars(v):
    tone = F.col("raw_tone")
    return v.ev.select(
        "item_id", r6(F.log(1 + F.col("magnitude")), "l"), r6(F.sqrt("magnitude"), "q"), r6(F.exp("polarity"), "e"), F.signum("polarity").cast("int").alias("s"),
        F.when(tone.isNotNull(), F.least(F.greatest(tone, F.lit(1.0)), F.lit(50.0))).alias("clipped"), (F.weekday("published_at") * 24 + F.hour("published_at")).cast("bigint").alias("how"),
    )


_SHOTS = ["Text: A venue halted withdrawals.\nOutput: hack", "Text: A token was listed.\nOutput: listing", "Text: A rule was passed.\nOutput: regulation"]


def _prompt_sql() -> str:
    block = lambda n: "".join(f"\nExample {i + 1}:\n{s}" for i, s in enumerate(_SHOTS[:n])) + "\n\nText: "
    t = "case when length(substring(coalesce(text, ''), 1, 3000)) > 0 then concat(coalesce(lang, ''), '. ', substring(coalesce(text, ''), 1, 3000)) else coalesce(lang, '') end"
    ladder = " ".join(f"when floor(length(concat('{block(n)}', {t})) / 3.5) + 512 <= 1300 then concat('{block(n)}', {t})" for n in (3, 2, 1))
    return f"select doc_id, md5(case {ladder} else concat('{block(1)}', coalesce(lang, ''), '. ', substring(coalesce(text, ''), 1, 750)) end) as prompt from documents"


@query(_prompt_sql())
def T11_prompt_budget(v):
    """The longest prompt that fits the budget."""
    return v.docs.select("doc_id", F.md5(X.extraction_prompt(F.col("lang"), F.col("text"), _SHOTS, limit=1300)).alias("prompt"))


@query("""select item_id, case when item_id % 5 = 3 then 'other' else event_type end as event_type, case when item_id % 5 = 3 then 0.0 else polarity end as polarity, case when item_id % 5 = 3 then 0.0 else magnitude end as magnitude,
 cast(0.0 as double) as confidence, item_id % 5 = 3 as is_default_filled from ev""", "ev")
def T12_T13_parse_output(v):
    """Model output in several states of repair, read with defaults."""
    i = F.col("item_id")
    good = F.to_json(F.struct("event_type", "polarity", "magnitude"))
    raw = F.when(i % 5 == 0, F.concat(F.lit("```json\n"), good, F.lit("\n```"))).when(i % 5 == 1, F.concat(F.lit("Sure: "), F.regexp_replace(good, "}", ",}"), F.lit(" ok"))).when(i % 5 == 2, F.regexp_replace(good, '"', "'")).when(i % 5 == 3, F.lit("no object")).otherwise(good)
    return v.ev.select("item_id", parsed_extraction(raw).alias("p")).select("item_id", "p.*")


_STORE = """a as (select item_id, title, summary as body, 'rss' as source, 1 as prio, ingested_at from rss_items union all
 select item_id, title, body, source, 2, ingested_at from raw_news union all select item_id, title, description, source, 3, ingested_at from cryptopanic_posts)"""


def _stores(v):
    rss = v.rss.select("item_id", "title", F.col("summary").alias("body"), F.lit("rss").alias("source"), F.lit(1).alias("prio"), "ingested_at")
    news = v.news.select("item_id", "title", "body", "source", F.lit(2).alias("prio"), "ingested_at")
    cp = v.cp.select("item_id", "title", F.col("description").alias("body"), "source", F.lit(3).alias("prio"), "ingested_at")
    return rss.unionByName(news).unionByName(cp)


@query(f"with {_STORE}, r as (select *, row_number() over (partition by item_id order by prio, ingested_at, title nulls first, coalesce(body, '')) as rk from a) select item_id, source, prio, title from r where rk = 1")
def S1_union_stores(v):
    """The three stores as one, first store wins."""
    order = F.struct("prio", "ingested_at", "title", F.coalesce("body", F.lit("")).alias("b"))
    best = _stores(v).groupBy("item_id").agg(F.min_by(F.struct("source", "prio", "title"), order).alias("r"))
    return best.select("item_id", "r.source", "r.prio", "r.title")


@query("select item_id, title, published_at, raw_tone from raw_news where source = 'gdelt' and source_domain = 'deepcrawl.example' and length(title) > 0")
def S8_F2_pushed_scan(v):
    """Filters and columns that reach the scan."""
    return v.news.where((F.col("source") == "gdelt") & (F.col("source_domain") == "deepcrawl.example") & (F.length("title") > 0)).select("item_id", "title", "published_at", "raw_tone")


@query("select model_version, prompt_version, count(*) as n, min(extracted_at) as first_at, max(extracted_at) as last_at from er where model_version = 'gran-8b-q4-v1' group by 1, 2", "er")
def S6_versioned_scan(v):
    return v.er.where("model_version = 'gran-8b-q4-v1'").groupBy("model_version", "prompt_version").agg(F.count("*").alias("n"), F.min("extracted_at").alias("first_at"), F.max("extracted_at").alias("last_at"))


@query("""with n as (select distinct item_id, ingested_at from raw_news), j as (select e.item_id, e.asset, e.record_id, e.polarity, row_number() over (partition by e.item_id, e.asset order by e.record_id) as rk from er e join n on n.item_id = e.item_id where e.published_at >= timestamp '2024-06-01' and n.ingested_at >= e.published_at - interval 1 minute)
select item_id, asset, record_id, polarity from j where rk = 1""", "er")
def S16_events_with_items(v):
    """Records joined to their items, bad clocks dropped, one row per item and asset."""
    n = v.news.select("item_id", "ingested_at").distinct()
    j = v.er.where("published_at >= timestamp'2024-06-01'").join(n, "item_id").where(F.col("ingested_at") >= F.col("published_at") - F.expr("interval 1 minute"))
    best = j.groupBy("item_id", "asset").agg(F.min(F.struct("record_id", "polarity")).alias("r"))
    return best.select("item_id", "asset", "r.record_id", "r.polarity")


@query("select item_id, title from (select distinct item_id, title from raw_news where length(title) > 0 and length(body) > 0) order by md5(concat(item_id, '42')), title limit 500")
def S17_O3_seeded_sample(v):
    """A sample that is a pure function of ids and seed (sampling is the feature)."""
    rows = v.news.where((F.length("title") > 0) & (F.length("body") > 0)).select("item_id", "title").distinct()
    return rows.orderBy(F.md5(F.concat("item_id", F.lit("42"))), "title").limit(500)


@query("""with a as (select cast(ingested_at as date) as day, source, count(*) as n from raw_news group by 1, 2), m as (select cast(extracted_at as date) as day, 'gdelt' as source, count(*) as k from er group by 1)
select cast(coalesce(a.day, m.day) as varchar) as day, coalesce(a.source, m.source) as source, coalesce(n, 0) as n_articles, coalesce(k, 0) as n_events from a full join m on a.day = m.day and a.source = m.source""", "er")
def J6_corpus_timeline(v):
    """Full outer join of articles and events per day and source."""
    a = v.news.groupBy(F.to_date("ingested_at").alias("day"), "source").agg(F.count("*").alias("n_articles"))
    m = v.er.groupBy(F.to_date("extracted_at").alias("day")).agg(F.count("*").alias("n_events")).withColumn("source", F.lit("gdelt"))
    return a.join(m, ["day", "source"], "full").select(F.col("day").cast("string").alias("day"), "source", F.coalesce("n_articles", F.lit(0)).alias("n_articles"), F.coalesce("n_events", F.lit(0)).alias("n_events"))


@query("""with r as (select distinct item_id from rss_items), n as (select distinct item_id, source from raw_news)
select case when r.item_id is not null then 'rss' when n.item_id is not null then n.source else 'unmatched' end as origin, count(*) as n from er e left join r on r.item_id = e.item_id left join n on n.item_id = e.item_id group by 1""", "er")
def J7_classify_origin(v):
    r = v.rss.select("item_id").distinct().withColumn("in_rss", F.lit(True))
    n = v.news.select("item_id", "source").distinct()
    origin = F.when(F.col("in_rss"), "rss").when(F.col("source").isNotNull(), F.col("source")).otherwise("unmatched")
    return v.er.select("item_id").join(r, "item_id", "left").join(n, "item_id", "left").groupBy(origin.alias("origin")).agg(F.count("*").alias("n"))


@query("select distinct item_id, source from raw_news where item_id not in (select item_id from event_records where item_id is not null)")
def J8_not_extracted(v):
    """Items without an extraction."""
    return v.news.select("item_id", "source").distinct().join(v.table("event_records", "item_id"), "item_id", "left_anti")


@query("select item_id from (select distinct item_id from raw_news) intersect select item_id from event_records")
def U2_intersect(v):
    return v.news.select("item_id").intersect(v.table("event_records", "item_id"))


_CLASS = "case when e.item_id is not null then 'cached' when length(coalesce(n.title, '')) = 0 then 'skipped' else 'pending' end"


@query(f"with n as (select item_id, max(title) as title from raw_news group by 1), e as (select distinct item_id from event_records) select {_CLASS} as status, count(*) as n from n left join e on e.item_id = n.item_id group by 1")
def X6_classify_work(v):
    """Work list of an extraction run: cached, skipped or pending."""
    n = v.news.groupBy("item_id").agg(F.max("title").alias("title"))
    e = v.table("event_records", "item_id").distinct().withColumn("done", F.lit(True))
    status = F.when(F.col("done"), "cached").when(F.length(F.coalesce("title", F.lit(""))) == 0, "skipped").otherwise("pending")
    return n.join(e, "item_id", "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("""with n as (select item_id, max(title) as title, max(url) as url, max(raw_tone) as tone from raw_news group by 1), p as (select record_id, item_id, case when record_id % 3 = 0 then null else event_type end as event_type from er)
select p.record_id, coalesce(p.event_type, 'other') as event_type, coalesce(nullif(n.title, ''), n.url) as title, n.tone from p left join n on n.item_id = p.item_id""", "er")
def X7_K8_repair(v):
    """Missing fields filled from the raw store; a title falls back to the URL."""
    n = v.news.groupBy("item_id").agg(F.max("title").alias("title"), F.max("url").alias("url"), F.max("raw_tone").alias("tone"))
    p = v.er.select("record_id", "item_id", F.when(F.col("record_id") % 3 != 0, F.col("event_type")).alias("event_type"))
    return p.join(n, "item_id", "left").select("record_id", F.coalesce("event_type", F.lit("other")).alias("event_type"), F.coalesce(F.nullif("title", F.lit("")), "url").alias("title"), "tone")


@query("""with p as (select round(median(polarity), 6) as r, asset, event_type from er where event_type in ('hack', 'listing', 'macro') group by asset, event_type)
select asset, max(case when event_type = 'hack' then r end) as hack, max(case when event_type = 'listing' then r end) as listing, max(case when event_type = 'macro' then r end) as macro from p group by 1""", "er")
def X14_pivot_report(v):
    """A report pivot with its columns given, so that no extra pass looks for them."""
    rows = v.er.where(F.col("event_type").isin("hack", "listing", "macro"))
    return rows.groupBy("asset").pivot("event_type", ["hack", "listing", "macro"]).agg(r6(F.median("polarity"), "m"))


@query(None)
def M1_M2_novelty(v):
    """Novelty of every record against the records of its model and asset in the two days before."""
    heads = v.news.groupBy("item_id").agg(F.max("title").alias("title"))
    records = v.table("event_records").select("record_id", "item_id", "content_hash", "model_version", "published_at", clean_symbol(F.col("asset")).alias("asset"), "event_type").distinct()
    rows = records.join(heads, "item_id", "left").select(
        F.col("record_id").alias("id"), F.concat_ws("|", "model_version", "asset").alias("asset"), F.col("published_at").alias("ts"), F.concat_ws(" ", F.coalesce("title", F.lit("")), "event_type").alias("text"), F.col("content_hash").alias("hash")
    )
    return matching.novelty(rows, rows).select(F.col("id").alias("record_id"), r6("novelty"))


SQL["M1_M2_novelty"] = """
with h as (select item_id, max(title) as title from raw_news group by 1),
r as (select e.record_id as id, concat_ws('|', e.model_version, e.asset) as asset, e.published_at as ts, e.content_hash as hash, lower(concat(coalesce(h.title, ''), ' ', e.event_type)) as text
 from (select distinct record_id, item_id, content_hash, model_version, published_at, nullif(upper(regexp_replace(trim(asset), '^\\$+\\s*', '')), '') as asset, event_type from event_records) e left join h on h.item_id = e.item_id),
p as (select a.id, b.id as wid from r a join r b on a.asset = b.asset and b.ts < a.ts and b.ts >= a.ts - interval 48 hour and a.hash <> b.hash),
t as (select id, w, count(*) as tf from (select id, unnest(regexp_extract_all(text, '[a-z0-9_]+')) as w from r) group by 1, 2),
n as (select id, count(*) + 1 as n from p group by 1),
s as (select p.id, p.wid, t.w, t.tf from p join t on t.id = p.wid),
d as (select id, w, count(*) as c from (select id, w from s union all select t.id, t.w from t join n on n.id = t.id) group by 1, 2),
i as (select d.id, d.w, ln((1.0 + n.n) / (1.0 + d.c)) + 1 as idf from d join n on n.id = d.id),
na as (select t.id, sqrt(sum(power(t.tf * i.idf, 2))) as na from t join i on i.id = t.id and i.w = t.w group by 1),
x as (select s.id, s.wid, sum(coalesce(o.tf, 0) * s.tf * i.idf * i.idf) as dot, sqrt(sum(power(s.tf * i.idf, 2))) as nb from s join i on i.id = s.id and i.w = s.w left join t o on o.id = s.id and o.w = s.w group by 1, 2),
b as (select x.id, max(x.dot / (na.na * x.nb)) as sim from x join na on na.id = x.id group by 1)
select r.id as record_id, round(case when b.sim is null then 1.0 else greatest(0.0, least(1.0, 1 - b.sim)) end + 1.1e-9, 6) + 0.0 as novelty from r left join b on b.id = r.id
"""
