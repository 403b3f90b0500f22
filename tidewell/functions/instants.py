"""Parsing of delivered time strings into instants, as built-in column expressions only.

`with_instant` covers: ISO 8601 in its usual spellings (any case, blanks around, fraction of any length, basic
form, zone suffix in brackets), RFC 822/1123, asctime, spelled-out months in either order, purely numeric dates
in a feed's own order, 12-hour clocks, offsets written as +05:30, +0530, UTC+5 or GMT-4, zone abbreviations, and
numbers counted from 1970 in seconds, milliseconds, microseconds or nanoseconds.
"""

from __future__ import annotations

import datetime as dt
import zoneinfo
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Offsets in minutes that zone abbreviations name where the feed's own zone does not use them.
COMMON_ABBREVIATIONS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60,
    "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "HKT": 480, "SGT": 480, "JST": 540, "KST": 540,
    "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "EST": -300,
    "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540,
    "AKDT": -480, "HST": -600,
}

MONTHS = {m: i + 1 for i, m in enumerate("JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split())}
FULL_MONTHS = "JANUARY FEBRUARY MARCH APRIL MAY JUNE JULY AUGUST SEPTEMBER OCTOBER NOVEMBER DECEMBER".split()

_DAY = 86_400_000_000
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"


def _us(n: int) -> Column:
    return F.lit(n).cast("bigint")


def home_abbreviations(spark: SparkSession) -> DataFrame:
    """(tz, abbr, offset_min): what each abbreviation means where it is in use, over all IANA zones.

    Derived from the installed zone database by sampling two seasons of recent years; a bounded table (about two
    rows a zone) that does not depend on the data.
    """
    rows = set()
    for tz in zoneinfo.available_timezones():
        zone = zoneinfo.ZoneInfo(tz)
        for year in range(2015, 2027):
            for month in (1, 7):
                at = dt.datetime(year, month, 15, tzinfo=zone)
                if (name := at.tzname() or "").isalpha():
                    rows.add((tz, name.upper(), int(at.utcoffset().total_seconds() // 60)))
    return spark.createDataFrame(sorted(rows), "home_tz string, abbr string, home_offset int")


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days from 1970-01-01 in the proleptic Gregorian calendar, by integer arithmetic (never throws)."""
    y = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(y / F.lit(400.0)).cast("int")
    yoe = y - era * 400
    doy = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / F.lit(5.0)).cast("int") + d - 1
    doe = yoe * 365 + F.floor(yoe / F.lit(4.0)).cast("int") - F.floor(yoe / F.lit(100.0)).cast("int") + doy
    return era.cast("bigint") * 146_097 + doe - 719_468


def _month_days(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)


def canonical_micros(raw: Column) -> Column:
    """Microseconds of a string of the exact form YYYY-MM-DDTHH:MM:SSZ; null for any other or impossible one."""
    part = lambda at, n: F.substring(raw, at, n).try_cast("int")
    y, m, d, hh, mm, ss = part(1, 4), part(6, 2), part(9, 2), part(12, 2), part(15, 2), part(18, 2)
    ok = raw.rlike(CANONICAL) & m.between(1, 12) & (d >= 1) & (d <= _month_days(y, m)) & (hh <= 23) & (mm <= 59) & (ss <= 59)
    return F.when(ok, _days(y, m, d) * _DAY + hh * _us(3_600_000_000) + mm * _us(60_000_000) + ss * _us(1_000_000))


_REST = r"(?:[T ,]+(.*))?$"
_FORMS = {
    "ymd": r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + _REST,
    "num": r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})" + _REST,
    "dmon": r"^(?:[A-Z]{2,9}\.?,? )?(\d{1,2})(?:ST|ND|RD|TH)?\.?[ -]([A-Z]{3,9})\.?,?[ -](\d{4}|\d{2})" + _REST,
    "mond": r"^(?:[A-Z]{3,9}\.?,? )?([A-Z]{3,9})\.? (\d{1,2})(?:ST|ND|RD|TH)?,? (\d{4})" + _REST,
    "asct": r"^[A-Z]{3} ([A-Z]{3}) (\d{1,2}) (\d{1,2}:\d{2}:\d{2}(?: [A-Z]{1,5})?) (\d{4})$",
    "pack": r"^(\d{4})(\d{2})(\d{2})[T ]?(\d{2})(\d{2})(\d{2})?((?:[.,]\d+)? ?(?:[A-Z+-].*)?)$",
}
_CLOCK = r"^(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)? ?(AM|PM|A\.M\.|P\.M\.)? ?(.*)$"
_OFFSET = r"^(?:UTC|GMT|UT)? ?([+-])(\d{1,2})(?::?(\d{2}))?(?: ?[\[(].*[\])])?$"
_NAMED = r"^([A-Z]{1,5})(?: ?[\[(].*[\])])?$"


def with_instant(df: DataFrame, raw: str, home_tz: str, date_order: str, out: str) -> DataFrame:
    """`df` with `out`: microseconds since 1970 UTC that the text of column `raw` names, or null.

    Defined cases: null, blank, relative, impossible or unreadable text gives null; a value without zone is local
    time in `home_tz` (null without one); of a local time that occurs twice the earlier instant counts; one that
    the clock skips gives null; digits beyond microseconds are cut; hour 24 and second 60 are impossible. Twelve or
    fourteen digits that begin with 19 or 20 spell a date and time, an impossible one included; others count.
    """
    spark = df.sparkSession
    x = lambda form, k: F.regexp_extract("_s", _FORMS[form], k)
    num = lambda c: c.try_cast("int")
    names = {f"{m}": i for m, i in MONTHS.items()} | {m: i + 1 for i, m in enumerate(FULL_MONTHS)} | {"SEPT": 9}
    month = lambda c: F.create_map(*[F.lit(v) for kv in names.items() for v in kv])[c]
    century = lambda c: F.when(F.length(c) == 2, num(c) + F.when(num(c) < 70, 2000).otherwise(1900)).otherwise(num(c))

    step = df.withColumn("_s", F.upper(F.trim(F.regexp_replace(F.col(raw), r"[\s ]+", " "))))
    form = F.when(F.col("_s").rlike(r"^\d+(?:\.\d+)?$") & ~F.col("_s").rlike(r"^(?:\d{12}|\d{14})$"), F.lit("epoch"))
    for name, pattern in _FORMS.items():
        form = form.when(F.col("_s").rlike(pattern), F.lit(name))
    step = step.withColumn("_f", form)
    is_ = lambda name: F.col("_f") == name
    order = F.col(date_order)
    a, b, c = num(x("num", 1)), num(x("num", 2)), x("num", 3)
    pick = lambda **by: reduce(lambda w, kv: w.when(is_(kv[0]), kv[1]), list(by.items())[1:], F.when(is_(list(by)[0]), by[list(by)[0]]))
    short = F.length(c) == 2
    step = step.withColumns({
        "_y": pick(ymd=num(x("ymd", 1)), pack=num(x("pack", 1)), dmon=century(x("dmon", 3)), mond=num(x("mond", 3)), asct=num(x("asct", 4)),
                   num=F.when(order == "YMD", F.when(short, century(x("num", 1)))).otherwise(century(c))),
        "_m": pick(ymd=num(x("ymd", 2)), pack=num(x("pack", 2)), dmon=month(x("dmon", 2)), mond=month(x("mond", 1)), asct=month(x("asct", 1)),
                   num=F.when(order == "MDY", a).otherwise(b)),
        "_d": pick(ymd=num(x("ymd", 3)), pack=num(x("pack", 3)), dmon=num(x("dmon", 1)), mond=num(x("mond", 2)), asct=num(x("asct", 2)),
                   num=F.when(order == "MDY", b).when(order == "DMY", a).when((order == "YMD") & short, num(c))),
        "_t": pick(ymd=x("ymd", 4), dmon=x("dmon", 4), mond=x("mond", 4), num=x("num", 4), asct=x("asct", 3),
                   pack=F.concat(x("pack", 4), F.lit(":"), x("pack", 5), F.lit(":"), F.when(x("pack", 6) == "", "00").otherwise(x("pack", 6)), x("pack", 7))),
    })
    clock = lambda k: F.regexp_extract("_t", _CLOCK, k)
    timed = F.col("_t").rlike(_CLOCK)
    half = F.substring(clock(5), 1, 1)
    h12 = num(clock(1))
    hour = F.when(half == "", h12).when(h12.between(1, 12), h12 % 12 + F.when(half == "P", 12).otherwise(0))
    step = step.withColumns({
        "_h": F.when(F.col("_t") == "", 0).when(timed, hour),
        "_i": F.when(F.col("_t") == "", 0).when(timed, num(clock(2))),
        "_sec": F.when((F.col("_t") == "") | (clock(3) == ""), 0).otherwise(num(clock(3))),
        "_us": F.when((F.col("_t") == "") | (clock(4) == ""), 0).otherwise(num(F.rpad(F.substring(clock(4), 1, 6), 6, "0"))),
        "_z": F.when(F.col("_t") == "", "").when(timed, F.trim(clock(6))),
    })
    y, m, d = F.col("_y"), F.col("_m"), F.col("_d")
    possible = m.between(1, 12) & (d >= 1) & (d <= _month_days(y, m)) & (F.col("_h") <= 23) & (F.col("_i") <= 59) & (F.col("_sec") <= 59)
    local = _days(y, m, d) * _DAY + F.col("_h") * _us(3_600_000_000) + F.col("_i") * _us(60_000_000) + F.col("_sec") * _us(1_000_000) + F.col("_us")
    off = lambda k: F.regexp_extract("_z", _OFFSET, k)
    off_min = (num(off(2)) * 60 + F.when(off(3) == "", 0).otherwise(num(off(3)))) * F.when(off(1) == "-", -1).otherwise(1)
    step = step.withColumns({"_local": F.when(possible, local), "_abbr": F.regexp_extract("_z", _NAMED, 1)})
    # Bounded by the zone database, not by the data.
    abbr = F.broadcast(home_abbreviations(spark).withColumnsRenamed({"home_tz": "_tz", "abbr": "_ab", "home_offset": "_home"}))
    step = step.join(abbr, (F.col(home_tz) == F.col("_tz")) & (F.col("_abbr") == F.col("_ab")), "left")
    common = F.create_map(*[F.lit(v) for kv in COMMON_ABBREVIATIONS.items() for v in kv])
    step = step.withColumn(
        "_off",
        F.when(F.col("_z").rlike(_OFFSET), F.when((num(off(2)) <= 15) & (F.when(off(3) == "", 0).otherwise(num(off(3))) <= 59), off_min))
        .when(F.col("_abbr").isin("Z", "UT", "UTC", "GMT"), 0)
        .when(F.col("_abbr") != "", F.coalesce(F.col("_home"), common[F.col("_abbr")])),
    )
    wall = F.timestamp_micros("_local")
    utc = F.to_utc_timestamp(wall, F.col(home_tz))
    epoch = F.regexp_extract("_s", r"^(\d+)(?:\.(\d+))?$", 1)
    digits = F.length(epoch)
    count = epoch.try_cast("bigint")
    frac = F.rpad(F.substring(F.regexp_extract("_s", r"^(\d+)(?:\.(\d+))?$", 2), 1, 6), 6, "0").try_cast("bigint")
    from_1970 = (
        F.when(digits <= 11, count * 1_000_000 + F.coalesce(frac, F.lit(0)))
        .when(digits <= 14, count * 1_000)
        .when(digits <= 17, count)
        .when(digits <= 19, F.substr(epoch, F.lit(1), digits - 3).try_cast("bigint"))
    )
    spelled = (
        F.when(F.col("_off").isNotNull(), F.col("_local") - F.col("_off") * _us(60_000_000))
        .when(F.col("_z") == "", F.when(F.from_utc_timestamp(utc, F.col(home_tz)) == wall, F.unix_micros(utc)))
    )
    bare = F.col("_s").rlike(r"^(?:\d{12}|\d{14})$")
    step = step.withColumn(out, F.when(is_("epoch"), from_1970).when(bare & F.col("_local").isNull() & ~F.col("_s").rlike("^(?:19|20)"), from_1970).otherwise(spelled))
    return step.select(*df.columns, out)
