"""Mixed timestamp notations to one UTC instant (problem 5).

Method: an ordered cascade of anchored patterns, each parsed strictly; the zone comes from
the value, else from the source's home zone (a lookup), else there is no instant.  All of it
is Catalyst expressions: one regular-expression rewrite brings a value to
``year|month|day|hour|minute|second|fraction|am/pm|zone|kind`` and integer arithmetic does the
rest, so no value is handed to a Python worker and ANSI mode never raises.

Policies
    * ambiguous local time: the earlier instant; nonexistent local time: moved forward by the gap
      (both are what ``to_utc_timestamp`` does with a wall-clock value);
    * a zone abbreviation is a fixed offset in any season;
    * digits past the microsecond are cut; two-digit years are 20yy; 24:00 and second 60 are no times;
    * plain numbers: up to 11 digits seconds, 12-14 milliseconds, 15-17 microseconds, 18-19 nanoseconds.
Null, blank, unparsable values and impossible days give null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Month names by language, January to December.
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "en3": "jan feb mar apr may jun jul aug sep oct nov dec",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "at": "jänner feber maerz apr mai jun jul aug sept okt nov dez",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "fr3": "janv févr mars avr mai juin juil aout sept oct nov déc",
    "it": "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre",
    "it3": "gen feb mar apr mag giu lug ago set ott nov dic",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "es3": "ene feb mar abr may jun jul ago setiembre oct nov dic",
    "nl": "januari februari maart april mei juni juli augustus september oktober november december",
    "nl3": "jan feb mrt apr mei jun jul aug sept okt nov dec",
    "pl": "stycznia lutego marca kwietnia maja czerwca lipca sierpnia września października listopada grudnia",
}

# Minutes east of UTC of zone abbreviations.
ZONE_MINUTES = {
    "Z": 0, "UTC": 0, "UT": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60,
    "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "HKT": 480, "SGT": 480, "AWST": 480, "JST": 540,
    "KST": 540, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "NST": -210,
    "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420,
    "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}

_ZONE = r"(?:\s*(Z|[+-]\d{2}(?::?\d{2})?|[A-Za-z]{1,5}|\[?(?:[A-Za-z_]+(?:/[A-Za-z_+\-0-9]+){1,2}|UTC|GMT)\]?))?"
_HMS = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,12}))?)?"
_DAY = r"(?:\p{L}+\.?,?\s+)?"
_NAME = r"(\p{L}+)\.?"

#: (pattern, rewrite) in the order they are tried; every pattern is anchored at both ends.
CASCADE: list[tuple[str, str]] = [
    (r"^([+-]?\d{1,19})(?:\.(\d{1,12}))?$", "$1||||||$2|||n"),
    (rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:(?:T|\s+){_HMS}{_ZONE})?$", "$1|$2|$3|$4|$5|$6|$7||$8|d"),
    (rf"^(\d{{4}})-(\d{{3}})(?:(?:T|\s+){_HMS}{_ZONE})?$", "$1|$2||$3|$4|$5|$6||$7|o"),
    (rf"^(\d{{4}})-W(\d{{2}})-(\d)(?:(?:T|\s+){_HMS}{_ZONE})?$", "$1|$2|$3|$4|$5|$6|$7||$8|w"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d{{1,12}}))?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8|d"),
    (rf"^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}})(?:\s+{_HMS}{_ZONE})?$", "$1|$2|$3|$4|$5|$6|$7||$8|d"),
    (rf"^(\d{{1,2}})\.\s?(\d{{1,2}})\.\s?(\d{{4}}|\d{{2}})(?:,?\s+(?:um\s+)?{_HMS}(?:\s+Uhr)?{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7||$8|d"),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}|\d{{2}})(?:,?\s+{_HMS}(?:\s*([AaPp])\.?[Mm]\.?)?{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|s"),
    (rf"^{_DAY}(\d{{1,2}})\s+{_NAME}\s+(\d{{4}}|\d{{2}})(?:,?\s+{_HMS}{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7||$8|m"),
    (rf"^{_DAY}(\d{{1,2}})-{_NAME}-(\d{{4}}|\d{{2}})(?:\s+{_HMS}{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7||$8|m"),
    (rf"^{_DAY}{_NAME}\s+(\d{{1,2}}),?\s+(\d{{4}})(?:,?\s+(?:at\s+)?{_HMS}(?:\s*([AaPp])\.?[Mm]\.?)?{_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|m"),
    (rf"^\p{{L}}{{2,9}}\.?,?\s+{_NAME}\s+(\d{{1,2}})\s+{_HMS}{_ZONE}\s+(\d{{4}})$", "$8|$1|$2|$3|$4|$5|$6||$7|m"),
    (
        rf"^{_DAY}(\d{{1,2}})(?:er|\.|°|º)?\s+(?:de\s+)?{_NAME}\s+(?:de\s+|del\s+)?(\d{{4}})"
        rf"(?:,?\s+(?:à\s+|um\s+|ore\s+|alle\s+|a\s+las\s+|om\s+|o\s+)?(\d{{1,2}})\s?[:hH.]\s?(\d{{2}})(?::(\d{{2}}))?(?:\s+Uhr|\s*h|\s+uur)?{_ZONE})?$",
        "$3|$2|$1|$4|$5|$6|||$7|m",
    ),
]


def java_zones(spark: SparkSession) -> list[str]:
    """Region names the engine can resolve; anything else in a value is no zone."""
    names = spark.sparkContext._jvm.java.util.ArrayList(spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds())
    return sorted(str(x) for x in names)


def normalise_timestamps(df: DataFrame, value: str, home_tz: str, day_first: str, out: str = "utc_us") -> DataFrame:
    """Add ``out`` (long, microseconds since 1970 UTC, null where the value names no instant).

    ``value`` is the raw text, ``home_tz`` the source's zone name and ``day_first`` its slash order;
    the two latter may be null.  Other columns pass through; helper columns never clash because they
    live in one struct that is dropped.
    """
    names = F.create_map(*_month_items())
    abbreviations = F.create_map(*[F.lit(x) for k, v in ZONE_MINUTES.items() for x in (k, v)])
    zones = java_zones(df.sparkSession)
    kept = df.columns
    pre = "__ts"
    while any(c.lower().startswith(pre) for c in kept):
        pre += "_"
    c = lambda name: F.col(f"{pre}{name}")

    # Flat helper columns in a few projections: Catalyst does not merge projections whose costly
    # columns are used more than once, so each regular expression runs once a row.
    s = F.regexp_replace(F.col(value), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    df = df.withColumn(f"{pre}s", s)
    rewritten = F.lit(None).cast("string")
    for pattern, to in reversed(CASCADE):
        rewritten = F.when(c("s").rlike(pattern), F.regexp_replace(c("s"), pattern, to)).otherwise(rewritten)
    df = df.withColumn(f"{pre}p", F.split(rewritten, r"\|"))
    part = lambda i: F.nullif(c("p")[i], F.lit(""))
    whole = lambda i: part(i).try_cast("int")
    df = df.withColumns(
        {
            f"{pre}kind": part(9),
            f"{pre}year": F.when(F.length(part(0)) == 2, whole(0) + 2000).otherwise(F.when(F.length(part(0)) == 4, whole(0))),
            f"{pre}name": F.element_at(names, F.lower(part(1))),
            f"{pre}a": whole(1),
            f"{pre}b": whole(2),
            f"{pre}hour": F.coalesce(whole(3), F.lit(0)),
            f"{pre}mi": F.coalesce(whole(4), F.lit(0)),
            f"{pre}se": F.coalesce(whole(5), F.lit(0)),
            f"{pre}us": F.rpad(F.substring(F.coalesce(part(6), F.lit("")), 1, 6), 6, "0").try_cast("bigint"),
            f"{pre}half": F.lower(part(7)),
            f"{pre}zone": F.regexp_replace(part(8), r"[\[\]]", ""),
            f"{pre}digits": F.when(part(9) == "n", part(0)),
        }
    )
    kind, zone = c("kind"), c("zone")
    offset = F.when(
        zone.rlike(r"^[+-]\d{2}"),
        (F.substring(zone, 2, 2).try_cast("int") * 60 + F.coalesce(F.regexp_extract(zone, r"^[+-]\d{2}:?(\d{2})$", 1).try_cast("int"), F.lit(0)))
        * F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1),
    ).otherwise(F.element_at(abbreviations, F.upper(zone)))
    df = df.withColumns(
        {
            f"{pre}m": F.when(kind == "m", c("name")).when(kind == "s", F.when(F.col(day_first), c("a")).when(~F.col(day_first), c("b"))).otherwise(c("a")),
            f"{pre}d": F.when(kind == "s", F.when(F.col(day_first), c("b")).when(~F.col(day_first), c("a"))).otherwise(c("b")),
            f"{pre}h": F.when(c("half").isNull(), F.when(c("hour") <= 23, c("hour"))).otherwise(
                F.when(c("hour").between(1, 12), c("hour") % 12 + F.when(c("half") == "p", 12).otherwise(0))
            ),
            f"{pre}off": offset,
            f"{pre}tz": F.when(zone.isNull(), F.col(home_tz)).otherwise(zone),
        }
    )
    # One strict constructor call gives the day the notation counts from: the date itself, 1 January
    # of an ordinal date, 4 January (always in ISO week 1) of a week date.
    base_m = F.when(kind.isin("o", "w"), F.lit(1)).otherwise(c("m"))
    base_d = F.when(kind == "o", F.lit(1)).when(kind == "w", F.lit(4)).otherwise(c("d"))
    zero = F.lit(0)
    df = df.withColumn(f"{pre}base", F.unix_date(F.try_make_timestamp_ntz(c("year"), base_m, base_d, zero, zero, zero.cast("decimal(16,6)")).cast("date")))
    df = df.withColumn(
        f"{pre}day",
        F.when(kind == "o", F.when(c("a").between(1, 366), c("base") + c("a") - 1))
        .when(kind == "w", F.when(c("a").between(1, 53) & c("b").between(1, 7), c("base") - F.pmod(c("base") + 3, F.lit(7)) + (c("a") - 1) * 7 + c("b") - 1))
        .otherwise(c("base")),
    )
    date = F.date_from_unix_date(c("day"))
    right = F.when(kind == "o", F.year(date) == c("year")).when(kind == "w", F.weekofyear(date) == c("a")).otherwise(F.lit(True))
    df = df.withColumn(f"{pre}days", F.when(right, c("day").cast("bigint")))
    df = df.withColumns(
        {
            f"{pre}local": F.expr(f"CASE WHEN {pre}mi <= 59 AND {pre}se <= 59 THEN ({pre}days * 86400L + {pre}h * 3600L + {pre}mi * 60L + {pre}se) * 1000000L + {pre}us END"),
            f"{pre}known": c("tz").isin(*zones),
            f"{pre}number": c("digits").try_cast("bigint"),
            f"{pre}length": F.length(F.regexp_replace(c("digits"), r"[+-]", "")),
        }
    )
    local = F.timestamp_micros(c("local"))
    df = df.withColumn(
        out,
        F.when(
            kind == "n",
            F.when(c("length") <= 11, c("number") * F.lit(1_000_000).cast("bigint") + c("us"))
            .when(c("length") <= 14, c("number") * 1000)
            .when(c("length") <= 17, c("number"))
            .otherwise(F.expr(f"{pre}number div 1000")),
        )
        .when(c("off").isNotNull(), c("local") - c("off").cast("bigint") * F.lit(60_000_000).cast("bigint"))
        .when(c("known"), F.unix_micros(F.to_utc_timestamp(local, F.when(c("known"), c("tz")).otherwise(F.lit("UTC"))))),
    )
    return df.select(*[F.col(f"`{k}`") for k in kept if k != out], out)


def _month_items() -> list[Column]:
    seen: dict[str, int] = {}
    for line in MONTHS.values():
        for i, n in enumerate(line.split(), 1):
            seen.setdefault(n, i)
    return [F.lit(x) for k, v in seen.items() for x in (k, v)]


def entry_instants(entries: DataFrame, feeds: DataFrame) -> DataFrame:
    """``(id, utc_us)`` of every entry whose ``published_date`` names an instant; repeated rows count once.

    The feed table is joined without a forced broadcast: Spark broadcasts it when its size allows and
    shuffles otherwise.  The repeated rows of an entry are dropped last, on 16-byte rows.
    """
    e = entries.select("id", "published_date", "source_name")
    f = feeds.select(F.col("source_name").alias("__feed"), "home_tz", "day_first").where("source_name IS NOT NULL").dropDuplicates(["__feed"])
    joined = e.join(f, F.col("source_name") == F.col("__feed"), "left")
    out = normalise_timestamps(joined, "published_date", "home_tz", "day_first")
    # The null test stands above the aggregate: below it, pushing it down would substitute the whole cascade into it.
    return out.groupBy("id").agg(F.min("utc_us").alias("utc_us")).where("utc_us IS NOT NULL AND id IS NOT NULL")
