"""Problem 1: one unambiguous UTC instant for every labelled capture line.

All formats are one regex alternation with named groups. The capture value is cut out of the
text once, the alternation is applied once (a replacement that writes the named groups side by
side), ranges are checked on the integers, and the instant is put together through integer day
arithmetic. Only wall times that need the rules of a zone go through the zone database.
Everything runs in generated JVM code; no row passes through Python.

Defined results
  * null or empty text, no capture line, a capture line without a full date and time: no row.
  * impossible dates and times (30 February, hour 24, minute 60, 13 PM): no row.
  * unknown zone name on the line or in ``site_tz``: no row; null ``site_tz``: UTC.
  * a request that was delivered several times: the row of the earliest ``received_at`` counts.
  * a request id that is null or has no request: ``dayfirst`` false and UTC.
  * columns beside those read are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Labels of the capture line.
CAPTURE_LABELS = [
    "captured", "scanned on", "received at", "time stamp", "timestamp",
    "erfasst am", "eingegangen", "zeitstempel",
    "horodatage", "reçu le", "recu le", "saisi le",
]

# Month names by month, English, German, French and Spanish (accents removed).
MONTHS = [
    ["january", "jan", "januar", "janvier", "janv", "enero", "ene"],
    ["february", "feb", "februar", "fevrier", "fevr", "febrero"],
    ["march", "mar", "marz", "maerz", "mrz", "mars", "marzo"],
    ["april", "apr", "avril", "avr", "abril", "abr"],
    ["may", "mai", "mayo"],
    ["june", "jun", "juni", "juin", "junio"],
    ["july", "jul", "juli", "juillet", "juil", "julio"],
    ["august", "aug", "aout", "agosto", "ago"],
    ["september", "sep", "sept", "septembre", "septiembre"],
    ["october", "oct", "oktober", "okt", "octobre", "octubre"],
    ["november", "nov", "novembre", "noviembre"],
    ["december", "dec", "dezember", "dez", "decembre", "diciembre", "dic"],
]

# Minutes east of UTC of zone abbreviations, European, US, Japanese, Australian.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "ist": 60,
    "cet": 60, "mez": 60, "cest": 120, "mesz": 120, "eet": 120, "eest": 180, "msk": 180,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360,
    "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
    "jst": 540, "aest": 600, "aedt": 660, "acst": 570, "acdt": 630, "awst": 480,
}

_ACCENTED, _PLAIN = "äáàâãéèêëíìîïóòôöúùûüçñ", "aaaaaeeeeiiiioooouuuucn"
_GAP_RX = r"[\s\p{Zs}]"
_DASHES = "‐‑‒–—−"

_MONTH_RX = "|".join(sorted({name for names in MONTHS for name in names}, key=lambda s: (-len(s), s)))
_ABBR_RX = "|".join(sorted(ABBREVIATIONS, key=lambda s: (-len(s), s)))

_DATE_RX = (
    r"(?:(?<isoy>\d{4})(?<isos>[-/.])(?<isom>\d{1,2})\k<isos>(?<isod>\d{1,2})"
    r"|(?<cpty>\d{4})(?<cptm>\d{2})(?<cptd>\d{2})(?=t)"
    r"|(?<txtd>\d{1,2})(?:\.|st|nd|rd|th|er)?[\s-]*(?:de |of )?(?<txtm>" + _MONTH_RX + r")\.?,?[\s-]*(?:de |of )?(?<txty>\d{4}|\d{2})"
    r"|(?<usam>" + _MONTH_RX + r")\.?[\s-]*(?<usad>\d{1,2})(?:st|nd|rd|th)?[\s,-]+(?<usay>\d{4})"
    r"|(?<numa>\d{1,2})(?<nums>[-/.])(?<numb>\d{1,2})\k<nums>(?<numy>\d{4}|\d{2}))"
)
_TIME_RX = (
    r"(?:(?<hh>\d{1,2}) ?[:h] ?(?<mi>\d{2})(?: ?: ?(?<ss>\d{2})(?:[.,](?<frac>\d{1,9}))?)?"
    r"|(?<chh>\d{2})(?<cmi>\d{2})(?<css>\d{2})(?:[.,](?<cfrac>\d{1,9}))?)"
    r"(?: ?(?<half>[ap])\.?m\b\.?)?(?: uhr| h\b)?"
)
_ZONE_RX = (
    r"(?: ?(?:(?:utc|gmt)?(?<sign>[+-])(?<offh>\d{2}):?(?<offm>\d{2})?|(?<abbr>" + _ABBR_RX + r")(?![a-z0-9_/])))?"
    r"(?: ?\[?(?<zone>[a-z]+(?:[/_+-][a-z0-9_+-]+)+|(?<=\[)[a-z]+)\]?)?"
)
FORMATS = (
    r"^(?:(?:[a-z]{2,9}\.?, ?|[a-z]{2,9}\.? (?=\d))?" + _DATE_RX
    + r"(?: ?, ?| ?(?:at|um|a|a las) |t| )" + _TIME_RX + _ZONE_RX
    + r"|(?<epoch>\d{10}(?:\.\d{1,9})?|\d{13}|\d{16}))[^a-z0-9]*$"
)
_NUMBERS = [
    "isoy", "isom", "isod", "cpty", "cptm", "cptd", "txtd", "txty", "usad", "usay",
    "numa", "numb", "numy", "hh", "mi", "ss", "chh", "cmi", "css", "offh", "offm",
]
_GROUPS = [*_NUMBERS, "txtm", "usam", "frac", "cfrac", "half", "sign", "abbr", "zone", "epoch"]
_MARK, _CUT = "\u0001", "\u0002"

_LABEL_RX = (
    r"(?iu)(?:^|[\n\r|;•])[^\p{L}\p{N}\n|;•]*(?:"
    + "|".join(label.replace(" ", _GAP_RX + "+") for label in CAPTURE_LABELS)
    + r")(?![\p{L}\p{N}])[^\p{L}\p{N}\n\r|;•]*([^\n\r|;•]*)"
)


def capture_value(text: Column) -> Column:
    """The value on the labelled capture line, folded to lower-case ASCII; empty if there is none."""
    value = F.lower(F.regexp_extract(text, _LABEL_RX, 1))
    value = F.translate(value, _ACCENTED + _DASHES, _PLAIN + "-" * len(_DASHES))
    return F.trim(F.regexp_replace(value, _GAP_RX + "+", " "))


def once(df: DataFrame, *columns: Column) -> DataFrame:
    """``df`` with further columns that are computed exactly once a row.

    A generator keeps the optimiser from copying an expensive expression into each later use.
    """
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def _lookup(table: dict, key: Column) -> Column:
    """The value of ``key`` in a small fixed table, null if it is not there."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def _first(numbers: Column, *names: str) -> Column:
    """The first of several groups that took part, as an integer."""
    return F.coalesce(*[numbers[_GROUPS.index(n)] for n in names], F.lit(None).cast("int"))


def _text(parts: Column, name: str) -> Column:
    return parts[_GROUPS.index(name)]


def month_number(name: Column) -> Column:
    return _lookup({n: number for number, names in enumerate(MONTHS, 1) for n in names}, name)


def epoch_day(year: Column, month: Column, day: Column) -> Column:
    """Days from 1970-01-01 in the Gregorian calendar, by integers alone (years from 1)."""
    shifted = year - F.when(month <= 2, 1).otherwise(0)
    from_march = month + F.when(month > 2, -3).otherwise(9)
    quotient = lambda a, b: F.floor(a / F.lit(b)).cast("long")
    return (
        shifted.cast("long") * 365 + quotient(shifted, 4) - quotient(shifted, 100) + quotient(shifted, 400)
        + quotient(from_march * 153 + 2, 5) + day - 1 - 719468
    )


def days_in_month(year: Column, month: Column) -> Column:
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    return F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def zone_table(spark) -> DataFrame:
    """All region names that the JVM's zone database knows (about 600, bounded), by lower case."""
    ids = sorted(str(z) for z in spark._jvm.java.util.ArrayList(spark._jvm.java.time.ZoneId.getAvailableZoneIds()))
    return spark.createDataFrame([(z.lower(), z) for z in ids], "zone_key string, zone_id string").dropDuplicates(["zone_key"])


def parse_components(values: DataFrame, value: str = "value") -> DataFrame:
    """Adds the validated integer components of ``value`` to rows that have a date and time.

    Reads ``dayfirst`` (boolean, null as false); rows without a valid date and time are left out.
    """
    replacement = _MARK + _CUT.join(f"${{{g}}}" for g in _GROUPS)
    parsed = once(values, F.regexp_replace(F.col(value), FORMATS, replacement).alias("_r")).filter(F.col("_r").startswith(_MARK))
    parsed = once(parsed, F.split(F.substring("_r", 2, 4096), _CUT, -1).alias("_p"))
    digits = F.slice("_p", 1, len(_NUMBERS))  # 1 to 4 digits each, so the cast can't fail
    parsed = once(parsed, F.transform(digits, lambda x: F.when(x != "", x.cast("int"))).alias("_n"))
    p, n = F.col("_p"), F.col("_n")
    parsed = once(
        parsed,
        F.coalesce("dayfirst", F.lit(False)).alias("_df"),
        _first(n, "isoy", "cpty", "txty", "usay", "numy").alias("_y"),
        _first(n, "isom", "cptm").alias("_m"),
        _first(n, "isod", "cptd", "txtd", "usad").alias("_d"),
        month_number(F.concat(_text(p, "txtm"), _text(p, "usam"))).alias("_mt"),
        _first(n, "numa").alias("_a"), _first(n, "numb").alias("_b"),
        _first(n, "hh", "chh").alias("_h"),
        _text(p, "half").alias("_half"),
        F.rpad(F.substring(F.concat(_text(p, "frac"), _text(p, "cfrac"), F.lit("0")), 1, 6), 6, "0").cast("long").alias("us"),
    )
    month, day = F.when(F.col("_df"), F.col("_b")).otherwise(F.col("_a")), F.when(F.col("_df"), F.col("_a")).otherwise(F.col("_b"))
    parsed = once(parsed, month.alias("_nm"), day.alias("_nd"), ((month > 12) & day.between(1, 12)).alias("_swap"))
    half, hour = F.col("_half"), F.col("_h")
    parsed = once(
        parsed,
        F.when(F.col("_y") < 100, F.col("_y") + 2000).otherwise(F.col("_y")).alias("y"),
        F.coalesce("_m", "_mt", F.when(F.col("_swap"), F.col("_nd")).otherwise(F.col("_nm"))).alias("mo"),
        F.coalesce("_d", F.when(F.col("_swap"), F.col("_nm")).otherwise(F.col("_nd"))).alias("d"),
        F.when(half == "", hour).when(~hour.between(1, 12), F.lit(99)).otherwise(hour % 12 + F.when(half == "p", 12).otherwise(0)).alias("h"),
        _first(n, "mi", "cmi").alias("mi"),
        F.coalesce(_first(n, "ss", "css"), F.lit(0)).alias("s"),
        F.when(_text(p, "sign") != "",
               (_first(n, "offh") * 60 + F.coalesce(_first(n, "offm"), F.lit(0))) * F.when(_text(p, "sign") == "-", -1).otherwise(1))
        .alias("off_min"),
        F.coalesce(_first(n, "offm"), F.lit(0)).alias("off_m"),
        F.nullif(_text(p, "abbr"), F.lit("")).alias("abbr"),
        F.nullif(_text(p, "zone"), F.lit("")).alias("zone"),
        F.nullif(_text(p, "epoch"), F.lit("")).alias("epoch"),
    )
    parsed = parsed.select(*values.columns, "y", "mo", "d", "h", "mi", "s", "us", "off_min", "off_m", "abbr", "zone", "epoch")
    clock = F.col("h").between(0, 23) & F.col("mi").between(0, 59) & F.col("s").between(0, 59)
    date = (F.col("y") >= 1) & F.col("mo").between(1, 12) & (F.col("d") >= 1) & (F.col("d") <= days_in_month(F.col("y"), F.col("mo")))
    offset = F.col("off_min").isNull() | ((F.abs("off_min") <= 18 * 60) & (F.col("off_m") <= 59))
    return parsed.filter(F.col("epoch").isNotNull() | (clock & date & offset))


def _epoch_us(epoch: Column) -> Column:
    whole = F.substring_index(epoch, ".", 1).cast("long")
    fraction = F.when(F.instr(epoch, ".") > 0, F.rpad(F.substring(F.substring_index(epoch, ".", -1), 1, 6), 6, "0").cast("long")).otherwise(0)
    digits = F.length(F.substring_index(epoch, ".", 1))
    return F.when(digits == 10, whole * 1_000_000 + fraction).when(digits == 13, whole * 1000).otherwise(whole)


def capture_instants(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """``doc_key, utc_us`` of every document of ``docs`` whose capture line gives an instant.

    ``docs`` needs doc_key, request_id, text; ``requests`` needs request_id, dayfirst, site_tz and
    received_at. The text is reduced to its capture value before anything is shuffled; requests are
    reduced to one row each, so a request that holds a third of all rows is split by the skew join.
    """
    spark = docs.sparkSession
    lines = once(docs.select("doc_key", "request_id", "text"), capture_value(F.col("text")).alias("value"))
    lines = lines.select("doc_key", "request_id", "value").filter(F.col("value").rlike(r"\d"))
    settings = (
        requests.filter(F.col("request_id").isNotNull()).groupBy("request_id")
        .agg(F.min_by(F.struct("dayfirst", "site_tz"), F.struct("received_at", "dayfirst", "site_tz")).alias("r"))
        .select("request_id", "r.dayfirst", "r.site_tz")
    )
    parsed = parse_components(lines.join(settings, "request_id", "left"))
    minutes = F.coalesce("off_min", _lookup(ABBREVIATIONS, F.col("abbr")))
    wall = (
        epoch_day(F.col("y"), F.col("mo"), F.col("d")) * 86_400_000_000
        + (F.col("h") * 3600 + F.col("mi") * 60 + F.col("s")).cast("long") * 1_000_000 + F.col("us")
    )
    timed = parsed.select(
        "doc_key",
        F.inline(F.array(F.struct(
            F.col("epoch"), minutes.alias("minutes"), wall.alias("wall"),
            F.lower(F.coalesce("zone", "site_tz", F.lit("UTC"))).alias("zone_key"),
        ))),
    )
    zoned = timed.join(F.broadcast(zone_table(spark)), "zone_key", "left")  # about 600 rows
    by_zone = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("wall"), F.col("zone_id")))
    instant = (
        F.when(F.col("epoch").isNotNull(), _epoch_us(F.col("epoch")))
        .when(F.col("minutes").isNotNull(), F.col("wall") - F.col("minutes").cast("long") * 60_000_000)
        .when(F.col("zone_id").isNotNull(), by_zone)
    )
    found = zoned.filter(F.coalesce("epoch", F.col("minutes").cast("string"), "zone_id").isNotNull())
    return found.select("doc_key", instant.cast("long").alias("utc_us"))
