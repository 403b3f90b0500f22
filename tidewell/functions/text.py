"""Text functions as built-in column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: Patterns that tag a text with an asset, case-insensitive, as whole words.
TAG_PATTERNS = {
    "BTC": "bitcoin|btc|xbt",
    "ETH": "ethereum|ether|eth",
    "USDT": "tether|usdt",
    "USDC": r"usd\s?coin|usdc",
    "BNB": r"binance\s?coin|bnb",
    "XRP": "ripple|xrp",
    "SOL": "solana|sol",
    "ADA": "cardano|ada",
    "DOGE": "dogecoin|doge",
    "TRX": "tron|trx",
    "AVAX": "avalanche|avax",
    "DOT": "polkadot|dot",
    "MATIC": "polygon|matic",
    "LINK": "chainlink|link",
    "LTC": "litecoin|ltc",
    "SHIB": r"shiba\s?inu|shib",
    "UNI": "uniswap|uni",
    "ATOM": "cosmos|atom",
    "XLM": "stellar|xlm",
    "LUNA": "terra|luna",
}

#: Substrings that mark a mention in lists of organisations and persons.
MENTIONS = {
    "bitcoin": "BTC", "btc": "BTC", "ethereum": "ETH", "eth": "ETH", "ripple": "XRP", "xrp": "XRP", "solana": "SOL", "sol": "SOL", "cardano": "ADA", "ada": "ADA",
    "polkadot": "DOT", "dot": "DOT", "chainlink": "LINK", "link": "LINK", "binance": "BNB", "bnb": "BNB", "avalanche": "AVAX", "avax": "AVAX", "polygon": "MATIC",
    "matic": "MATIC", "dogecoin": "DOGE", "doge": "DOGE", "shiba": "SHIB", "terra": "LUNA", "luna": "LUNA", "usd": "USD", "tether": "USDT", "usdt": "USDT",
    "usdc": "USDC", "circle": "USDC",
}

#: Names that redaction replaces, in order; the first six are the short list.
REDACTIONS = [
    (r"\bBitcoin\b|\bBTC\b", "Asset_X"),
    (r"\bEthereum\b|\bETH\b", "Asset_Y"),
    (r"\bRipple\b|\bXRP\b", "Asset_Z"),
    (r"\bTerraUSD\b|\bUST\b|\bLUNA\b", "Asset_W"),
    (r"\bSEC\b", "Regulator_A"),
    (r"\bBinance\b", "Exchange_A"),
    (r"\bSolana\b|\bSOL\b", "Asset_S"),
    (r"\bCardano\b|\bADA\b", "Asset_C"),
    (r"\bTether\b|\bUSDT\b", "Stablecoin_A"),
    (r"\bCircle\b|\bUSDC\b", "Stablecoin_B"),
    (r"\bTerra\b|\bLUNA\b", "Asset_L"),
    (r"\bFTX\b", "Exchange_B"),
    (r"\bCelsius\b", "Exchange_C"),
    (r"\bTerra\b", "Protocol_A"),
]

#: Full names of assets and their symbols.
ALIASES = {
    "BITCOIN": "BTC", "ETHEREUM": "ETH", "XRP": "XRP", "SOLANA": "SOL", "BNB": "BNB", "DOGECOIN": "DOGE", "CARDANO": "ADA", "POLKADOT": "DOT", "CHAINLINK": "LINK",
    "AVALANCHE": "AVAX", "TRON": "TRX", "LITECOIN": "LTC", "BITCOINCASH": "BCH", "STELLAR": "XLM", "MONERO": "XMR", "ETHEREUMCLASSIC": "ETC", "TEZOS": "XTZ",
    "EOS": "EOS", "NEO": "NEO", "IOTA": "IOTA", "VECHAIN": "VET", "THETA": "THETA", "FILECOIN": "FIL", "APTOS": "APT", "ARBITRUM": "ARB", "OPTIMISM": "OP",
    "SUI": "SUI", "NEAR": "NEAR", "POLYGON": "MATIC", "MATIC": "MATIC", "ATOM": "ATOM", "COSMOS": "ATOM", "UNISWAP": "UNI", "AAVE": "AAVE", "PEPE": "PEPE",
    "FLOKI": "FLOKI", "SHIBAINU": "SHIB", "SHIB": "SHIB", "RENDER": "RNDR", "FET": "FET", "ASI": "ASI", "FETCH": "FET", "INTERNETCOMPUTER": "ICP", "ICP": "ICP",
    "HEDERA": "HBAR", "KASPA": "KAS", "INJECTIVE": "INJ", "SEI": "SEI", "CELESTIA": "TIA",
}

#: Quote currencies that a market symbol may end with, tried in this order.
QUOTES = ("USDT", "USDC", "BUSD", "TUSD", "DAI", "FDUSD", "USD")


def tag_assets(text: Column) -> Column:
    """Sorted symbols whose names the text contains as whole words; empty for null."""
    hits = [F.when(text.rlike(rf"(?i)\b(?:{p})\b"), F.lit(s)) for s, p in TAG_PATTERNS.items()]
    return F.array_sort(F.array_compact(F.array(*hits)))


def mentions(text: Column) -> Column:
    """Sorted symbols whose names occur anywhere in the text, inside words too."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(k)), F.lit(s)) for k, s in MENTIONS.items()]))))


def redact(text: Column, rules: list[tuple[str, str]] = REDACTIONS) -> Column:
    """Names replaced by placeholders, rule after rule, case-insensitive."""
    return reduce(lambda c, r: F.regexp_replace(c, "(?i)" + r[0], r[1]), rules, text)


def content_hash(title: Column, body: Column) -> Column:
    """SHA-256 of the title followed by the first 500 characters of the body; null counts as empty."""
    return F.sha2(F.concat(F.coalesce(title, F.lit("")), F.substring(F.coalesce(body, F.lit("")), 1, 500)), 256)


def item_id(*parts: Column) -> Column:
    return F.sha2(F.concat(*[F.coalesce(p, F.lit("")) for p in parts]), 256)


def strip_html(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "<[^>]+>", ""))


def domain_of(url: Column) -> Column:
    """Host of a URL in lower case without `www.`, port kept; empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, "https?://([^/]+)/?", 1)), r"^www\.", "")


def ticker_of(symbol: Column) -> Column:
    """Base symbol of a market symbol: before / and -, without one quote currency; null unless 2 to 10 capitals or digits."""
    base = F.split_part(F.split_part(F.upper(symbol), F.lit("/"), F.lit(1)), F.lit("-"), F.lit(1))
    cut = base
    for q in reversed(QUOTES):
        cut = F.when(F.endswith(base, F.lit(q)) & (F.length(base) > len(q) + 1), F.substr(base, F.lit(1), F.length(base) - len(q))).otherwise(cut)
    return F.when(cut.rlike("^[A-Z0-9]{2,10}$"), cut)


def safe(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def first_text(*texts: Column) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))


def extraction_prompt(title: Column, body: Column, shots: list[str], limit: int = 4096, reserve: int = 512, head: int = 3000, tail: int = 750) -> Column:
    """The prompt with as many of the `shots` as fit the estimated budget, then with a shorter body.

    The estimate is characters / 3.5 (floored) + reserve. Trying fewer shots one after the other is a closed ladder
    here: the first candidate that fits, else the shortest.
    """
    cut = F.substring(safe(body), 1, head)
    text = F.when(cut != "", F.concat(safe(title), F.lit(". "), cut)).otherwise(safe(title))
    short = F.concat(safe(title), F.lit(". "), F.substring(safe(body), 1, tail))
    block = lambda n: "".join(f"\nExample {i + 1}:\n{s}" for i, s in enumerate(shots[:n]))
    build = lambda n, t: F.concat(F.lit(block(n) + "\n\nText: "), t)
    fits = lambda c: F.floor(F.length(c) / F.lit(3.5)) + reserve <= limit
    ladder = F.when(F.lit(False), text)
    for n in range(len(shots), 0, -1):
        c = build(n, text)
        ladder = ladder.when(fits(c), c)
    return ladder.otherwise(build(1, short))


VOTES_FOR = ("liked", "important", "positive", "bullish", "saved")
VOTES_AGAINST = ("disliked", "negative", "bearish", "toxic", "lol")


def votes(raw: Column, names: tuple[str, ...]) -> Column:
    """Sum of the named entries of a vote map; 0 for none."""
    return F.coalesce(reduce(lambda a, b: a + b, [F.coalesce(raw[n], F.lit(0)) for n in names]), F.lit(0))


def minute_after(ts: Column) -> Column:
    """The first full minute strictly after an instant."""
    return F.date_trunc("minute", ts) + F.expr("interval 1 minute")
