"""One unambiguous UTC instant for timestamp text of any format.

The distinct (text, zone, day order, epoch) combinations make up a dictionary that is parsed once, by
Spark expressions alone, and can be kept as a table that grows by the combinations not seen before.
Rows then join the dictionary.
"""

from __future__ import annotations

from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.session import stage

# Month names of English and Norwegian, and zone abbreviations with minutes east of UTC.
MONTHS = {
    "jan": 1, "january": 1, "januar": 1, "feb": 2, "february": 2, "februar": 2, "mar": 3, "march": 3, "mars": 3,
    "apr": 4, "april": 4, "may": 5, "mai": 5, "jun": 6, "june": 6, "juni": 6, "jul": 7, "july": 7, "juli": 7,
    "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "okt": 10, "october": 10, "oktober": 10,
    "nov": 11, "november": 11, "dec": 12, "des": 12, "december": 12, "desember": 12,
}
ZONES = {
    "z": 0, "utc": 0, "gmt": 0, "wet": 0, "bst": 60, "west": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
    "aest": 600, "aedt": 660,
}
_DAY = 86_400_000_000
FIRST_YEAR, LAST_YEAR = 2012, 2026
DICTIONARY_KEY = ["text", "tz_name", "day_first", "epoch_origin"]

_CLOCK = r"(\d{1,2})[:.](\d{2})(?:[:.](\d{2}(?:[.,]\d+)?))?(?: ?([ap])\.?m\.?(?![a-z]))?"
_ZONE = r" ?(z|[+-]\d{2}(?::?\d{2})?|[a-z]{2,5}|[a-z_]+(?:/[a-z_+-]+)+)?(?: \([^()]*\))?"
#: Each way to write date and time, with the groups that hold year, month, day, hour, minute, second, half of the day, zone.
_LAYOUTS = [
    (rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})(?:t| ){_CLOCK}{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8"),
    (r"^(\d{4})(\d{2})(\d{2})t(\d{2})(\d{2})(\d{2})?(z|[+-]\d{2}:?\d{2})?$", "$1|$2|$3|$4|$5|$6||$7"),
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?: kl\.?)?,? {_CLOCK}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8"),
    (rf"^(\d{{1,2}})\.? ([a-z]+)\.?,? (\d{{4}})(?: kl\.?| at)?,? {_CLOCK}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8"),
    (rf"^(?:[a-z]{{3,9}},? )(\d{{1,2}}) ([a-z]+) (\d{{4}}),? {_CLOCK}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8"),
    (rf"^([a-z]+)\.? (\d{{1,2}}),? (\d{{4}})(?: at)?,? {_CLOCK}{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8"),
]
_SLASHES = rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),? {_CLOCK}{_ZONE}$"


def _lookup(values: dict[str, int], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def _region(zone: Column) -> Column:
    """A zone's name if the JVM knows it, as written or in title case; null for other names."""
    title = F.regexp_replace(F.initcap(F.regexp_replace(F.regexp_replace(zone, "/", " / "), "_", " ")), " / ", "/")
    known = lambda z: F.when(F.try_to_timestamp(F.concat(F.lit("2020-01-01 00:00 "), z), F.lit("yyyy-MM-dd HH:mm VV")).isNotNull(), z)
    return F.coalesce(known(zone), known(F.regexp_replace(title, " ", "_")))


def _local_us(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column, half: Column) -> Column:
    """The wall clock as microseconds, as if it were UTC; null for impossible dates and times."""
    h = F.try_to_number(hour, F.lit("99")).cast("int")
    h = F.when(half == "", F.when(h < 24, h)).when(h.between(1, 12), h % 12 + F.when(half == "p", 12).otherwise(0))
    month = F.coalesce(month.try_cast("int"), _lookup(MONTHS, month))
    whole = F.substring(second, 1, 2).try_cast("int")
    micros = F.coalesce(F.rpad(F.substring(second, 4, 6), 6, "0").try_cast("long"), F.lit(0))
    at = F.try_make_timestamp(year.try_cast("int"), month, day.try_cast("int"), h, minute.try_cast("int"), F.coalesce(F.when(whole < 60, whole), F.when(second == "", 0)).cast("decimal(16,6)"), F.lit("UTC"))
    return F.unix_micros(at) + F.when(F.length(second) > 3, micros).otherwise(0)


def _shifted(us: Column, zone: Column) -> Column:
    """The wall clock of ``zone`` at the instant ``us``, as if it were UTC."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone))


def _only(candidates: Column) -> Column:
    """The one value of an array, nulls and repeats aside; null where it holds none or several."""
    kept = F.array_distinct(F.array_compact(candidates))
    return F.when(F.size(kept) == 1, kept[0])


def _from_number() -> Column:
    """The instant that a plain number names."""
    value = F.col("_t").try_cast("decimal(38,9)")
    origin = F.coalesce(F.unix_micros(F.col("epoch_origin").try_cast("timestamp")), F.lit(0))
    low, high = (int(datetime(y, 1, 1, tzinfo=UTC).timestamp()) * 1_000_000 for y in (FIRST_YEAR, LAST_YEAR + 1))
    per_unit = ("1000000", "1000", "1", "0.001")
    units = [F.try_add(F.floor(F.try_multiply(value, F.lit(m).cast("decimal(10,3)"))).try_cast("long"), origin) for m in per_unit]
    return F.when(F.col("_t").rlike(r"^\d{1,19}(\.\d{1,9})?$"), _only(F.transform(F.array(*units), lambda u: F.when((u >= low) & (u < high), u))))


def with_instants(entries: DataFrame) -> DataFrame:
    """Add utc_micros to ``entries(text, tz_name, day_first, epoch_origin)``: the one instant each text names.

    Microseconds since 1970 UTC, finer digits cut off; null where a text names no instant or several.
    A zone in the text wins over ``tz_name``; without either, a clock time names nothing, nor does one that
    its zone skips or shows twice. Dates with slashes follow ``day_first``; where that is null they count only
    if one order alone is possible. Plain numbers count from ``epoch_origin`` (null: 1970) in the one unit,
    seconds to nanoseconds, that gives a date from 2012 to 2026. Null, blank, partial, relative and impossible
    texts name nothing, nor do texts with zones that the JVM does not know.
    """
    out = entries.columns
    df = entries.withColumn("_w", F.trim(F.regexp_replace("text", r"[\s\u00a0\u2000-\u200b\u202f\u3000]+", " "))).withColumn("_t", F.lower("_w"))
    shape = F.lit(None).cast("string")
    for pattern, groups in [*_LAYOUTS, (_SLASHES, "$3|$1/|$2|$4|$5|$6|$7|$8")]:
        shape = F.when(F.col("_t").rlike(pattern), F.regexp_replace("_t", pattern, groups)).otherwise(shape)
    df = df.withColumn("_p", F.split(shape, r"\|"))
    year, month, day, hour, minute, second, half, zone = (F.col("_p")[k] for k in range(8))
    swaps = month.endswith("/")
    digits = F.regexp_replace(zone, "[^0-9]", "")
    offset = F.substring(digits, 1, 2).try_cast("int") * 60 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))
    signed = F.when(offset <= 18 * 60, offset * F.when(zone.startswith("-"), -1).otherwise(1))
    df = df.withColumns({
        "_a": F.when(swaps & F.coalesce("day_first", F.lit(True)), _local_us(year, day, F.rtrim(month, F.lit("/")), hour, minute, second, half)),
        "_b": F.when(~swaps | ~F.coalesce("day_first", F.lit(False)), _local_us(year, F.rtrim(month, F.lit("/")), day, hour, minute, second, half)),
        "_fixed": F.when(zone.rlike("^[+-]"), signed).otherwise(_lookup(ZONES, zone)).cast("long") * 60_000_000,
        "_zone": F.when(zone == "", _region(F.col("tz_name"))).when(zone.contains("/"), _region(F.regexp_extract("_w", r"[A-Za-z_]+(?:/[A-Za-z_+-]+)+", 0))),
    })
    candidates = []
    for c in ("_a", "_b"):
        around = [F.col(c) - (_shifted(F.col(c) + d, F.col("_zone")) - (F.col(c) + d)) for d in (-_DAY, _DAY)]
        df = df.withColumns({f"{c}{k}": F.when(F.col("_zone").isNotNull(), x) for k, x in enumerate(around)})
        hits = [F.when(_shifted(F.col(f"{c}{k}"), F.col("_zone")) == F.col(c), F.col(f"{c}{k}")) for k in (0, 1)]
        candidates.append(F.when(F.col("_zone").isNotNull(), _only(F.array(*hits))).otherwise(F.col(c) - F.col("_fixed")))
    found = F.when(F.col("_p").isNull(), _from_number()).otherwise(_only(F.array(*candidates)))
    return df.withColumn("utc_micros", found).select(*out, "utc_micros")


def _new_entries(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    new = rows.where(F.col("text").isNotNull()).groupBy(*DICTIONARY_KEY).agg(F.count("*").alias("n_rows"))
    if known is not None:
        same = reduce(lambda a, b: a & b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in DICTIONARY_KEY])
        new = new.alias("a").join(known.alias("b"), same, "left_anti").select(*DICTIONARY_KEY, "n_rows")
    # Few bytes make much parsing: adaptive execution would put them into a few tasks.
    return with_instants(new.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *DICTIONARY_KEY))


def parse_dictionary(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Entries (text, tz_name, day_first, epoch_origin, n_rows, utc_micros) for the combinations in ``rows``, as a staged table.

    ``known``: an earlier dictionary; only combinations it lacks are parsed and returned. The table is written
    first because a filter on utc_micros would else be pushed through every step of the parsing.
    """
    return stage(_new_entries(rows, known), "instants")


def update_dictionary(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    """Append the entries that the dictionary at ``path`` lacks and return the whole dictionary."""
    try:
        known = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = None
    _new_entries(rows, known).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def normalise(rows: DataFrame, dictionary: DataFrame, share: int = 256) -> DataFrame:
    """``rows`` that name one instant, with utc_micros from ``dictionary``.

    A text that fills a large part of the rows would make one join task hold them all. Texts with more
    than a ``share``-th of the dictionary's row count are at most ``share`` many; these join by broadcast, the rest by
    shuffle on the text.
    """
    total = dictionary.agg(F.sum("n_rows").alias("n")).first()["n"] or 0
    is_hot = F.col("n_rows") > total / share
    hot = dictionary.where(is_hot).select(*DICTIONARY_KEY, F.col("utc_micros").alias("hot_us"), F.lit(True).alias("is_hot"))
    cold = dictionary.where(~is_hot & F.col("utc_micros").isNotNull()).select(*DICTIONARY_KEY, "utc_micros")
    own = [F.col(f"r.{c}") for c in rows.columns]

    def same(other: str) -> Column:
        return reduce(lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"{other}.{c}")) for c in DICTIONARY_KEY])

    marked = rows.where("text IS NOT NULL").alias("r").join(F.broadcast(hot).alias("h"), same("h"), "left").select(*own, "hot_us", "is_hot")
    joined = marked.where("is_hot IS NULL").alias("r").join(cold.alias("d"), same("d")).select(*own, F.col("d.utc_micros"))
    return joined.unionByName(marked.where("hot_us IS NOT NULL").select(*rows.columns, F.col("hot_us").alias("utc_micros")))


def timestamp_rows(raw_items: DataFrame, chat_facts: DataFrame, profiles: DataFrame) -> DataFrame:
    """(rec_table, rec_key, text, tz_name, day_first, epoch_origin) of both record tables; inferred facts are left out.

    Sources without a profile get nulls. A source with two profiles is taken with the first by zone name.
    """
    one = profiles.groupBy("source").agg(F.min_by(F.struct("tz_name", "day_first", "epoch_origin"), F.coalesce("tz_name", F.lit("~"))).alias("p"))
    raw = raw_items.select(F.lit("raw_items").alias("rec_table"), F.col("record_id").cast("string").alias("rec_key"), F.col("timestamp").alias("text"), "source")
    facts = chat_facts.where("NOT coalesce(timestamp_inferred, false)").select(F.lit("chat_facts").alias("rec_table"), F.col("source_id").alias("rec_key"), F.col("timestamp").alias("text"), F.lit("chats_facts").alias("source"))
    return raw.unionByName(facts).join(one, "source", "left").select("rec_table", "rec_key", "text", "p.tz_name", "p.day_first", F.col("p.epoch_origin").cast("string").alias("epoch_origin"))
