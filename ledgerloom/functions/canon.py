"""Canonical forms of record fields, as column expressions.

Each function takes a string column and gives null where the value is null, blank or damaged.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Legal forms and generic words that carry no identity at the end of a vendor name.
VENDOR_TAIL = (
    "inc incorporated llc llp ltd limited corp corporation co company gmbh sa ag plc pty bv nv srl spa "
    "solutions services group partners associates systems technologies technology holdings enterprises consulting international worldwide global"
).split()
# Headings of documents and the instrument they stand for, first match counts.
INSTRUMENTS = [
    ("ACCOUNT TRANSACTION RECORD", "STATEMENT"), ("TRANSACTION RECORD", "STATEMENT"), ("BILLING STATEMENT", "STATEMENT"),
    ("REMITTANCE ADVICE", "REMITTANCE"), ("CREDIT NOTE", "CREDIT NOTE"), ("CREDIT MEMO", "CREDIT NOTE"), ("DEBIT NOTE", "DEBIT MEMO"),
    ("DEBIT MEMO", "DEBIT MEMO"), ("PURCHASE ORDER", "PURCHASE ORDER"), ("GOODS RECEIPT", "GOODS RECEIPT"), ("DELIVERY NOTE", "DELIVERY NOTE"),
    ("STATEMENT", "STATEMENT"), ("INVOICE", "INVOICE"), ("RECEIPT", "RECEIPT"), ("QUOTATION", "QUOTE"), ("QUOTE", "QUOTE"), ("ESTIMATE", "QUOTE"),
]
OBLIGATING = ["INVOICE", "DEBIT MEMO", "DEBIT NOTE", "CREDIT NOTE", "CREDIT MEMO", "PURCHASE ORDER"]
CURRENCY_SIGNS = {"$": "USD", "£": "GBP", "€": "EUR", "¥": "JPY"}
ISO_CODES = "USD|EUR|GBP|JPY|CAD|AUD|CHF|CNY|INR"
# German and French month names.
FOREIGN_MONTHS = {
    "januar": "January", "februar": "February", "märz": "March", "maerz": "March", "mai": "May", "juni": "June", "juli": "July",
    "oktober": "October", "dezember": "December", "janvier": "January", "février": "February", "fevrier": "February", "mars": "March",
    "avril": "April", "juin": "June", "juillet": "July", "août": "August", "aout": "August", "septembre": "September",
    "octobre": "October", "novembre": "November", "décembre": "December", "decembre": "December",
}
DATE_PATTERNS = ["yyyy-MM-dd", "yyyy/MM/dd", "d MMMM yyyy", "MMMM d, yyyy", "MMMM d yyyy", "d MMM yyyy", "MMM d, yyyy", "d-MMM-yyyy", "d/MMM/yyyy"]


def strip(value: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(value, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def blank_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def alnum_upper(value: Column) -> Column:
    """Invoice numbers, order numbers and tax ids: ASCII letters and digits, upper case."""
    return blank_null(F.upper(F.regexp_replace(value, "[^A-Za-z0-9]", "")))


def canon_vendor(value: Column) -> Column:
    """Upper case without punctuation and trailing legal or generic words, unless nothing else is left."""
    bare = F.regexp_replace(strip(F.lower(F.regexp_replace(value, "[.,]", ""))), r"\s+", " ")
    short = F.regexp_replace(bare, r"( (" + "|".join(VENDOR_TAIL) + r"))+$", "")
    only_tail = short.rlike("^(" + "|".join(VENDOR_TAIL) + ")$")
    return blank_null(F.upper(F.when(only_tail, bare).otherwise(short)))


def canon_doc_type(value: Column) -> Column:
    s, out = F.upper(strip(value)), None
    for heading, instrument in INSTRUMENTS:
        out = (F.when if out is None else out.when)(F.contains(s, F.lit(heading)), F.lit(instrument))
    return F.when(s != "", out.otherwise(s))


def instruments_conflict(a: Column, b: Column) -> Column:
    """Both obligating, and different; a statement restates and never conflicts."""
    return F.coalesce((a != b) & a.isin(OBLIGATING) & b.isin(OBLIGATING), F.lit(False))


def canon_amount(value: Column) -> Column:
    """Either convention of separators; null for shapes no convention can give."""
    s = F.regexp_replace(F.regexp_replace(value, r"[\s\p{Z}$£€¥]", ""), r"(?i)^(" + ISO_CODES + r")|(" + ISO_CODES + r")$", "")
    us = s.rlike(r"^[+-]?\d{1,3}(,\d{3})+(\.\d*)?$")
    eu = s.rlike(r"^[+-]?\d{1,3}(\.\d{3})+(,\d*)?$") & ~s.rlike(r"^[+-]?\d{1,3}\.\d{3}$")
    plain = s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$")
    comma = s.rlike(r"^[+-]?\d+,\d{2}$")
    return (
        F.when(us, F.replace(s, F.lit(","), F.lit("")))
        .when(plain, s)
        .when(eu, F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(comma, F.replace(s, F.lit(","), F.lit(".")))
        .when(s.rlike(r"^[+-]?\d+,\d*$"), F.replace(s, F.lit(","), F.lit("")))
    ).try_cast("double")


def canon_currency(*values: Column) -> Column:
    """The first ISO code or sign in the first value that has one."""
    found = []
    for v in values:
        found.append(blank_null(F.upper(F.regexp_extract(v, r"(?i)\b(" + ISO_CODES + r")\b", 1))))
        sign = None
        for mark, code in CURRENCY_SIGNS.items():
            sign = (F.when if sign is None else sign.when)(F.contains(v, F.lit(mark)), F.lit(code))
        found.append(sign)
    return F.coalesce(*found)


def canon_date(value: Column, dayfirst: bool = False) -> Column:
    """A date in one of nine written forms in English, German or French, or numeric by ``dayfirst``.

    Foreign month names are replaced as whole words (a plain replacement would damage the English
    names they begin).
    """
    s = F.regexp_replace(F.regexp_replace(strip(value), r"(\d)\.(\s)", "$1$2"), r"[\s\p{Z}]+", " ")
    for foreign, english in FOREIGN_MONTHS.items():
        s = F.regexp_replace(s, r"(?iu)(?<!\p{L})" + foreign + r"(?!\p{L})", english)
    s = F.initcap(s)
    written = [F.try_to_timestamp(s, F.lit(p)).cast("date") for p in DATE_PATTERNS]
    numeric = r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4}|\d{2})$"
    a, b, y = (F.regexp_extract(s, numeric, i).try_cast("int") for i in (1, 2, 3))
    day, month = (a, b) if dayfirst else (b, a)
    swap = (month > 12) & (day <= 12)
    text = F.format_string("%04d-%02d-%02d", F.when(y < 100, y + 2000).otherwise(y), F.when(swap, day).otherwise(month), F.when(swap, month).otherwise(day))
    return F.coalesce(*written, F.when(s.rlike(numeric), text.try_cast("date")))


def number_signature(value: Column) -> Column:
    """The shape of a number: letters A, digits 9, runs of two and more with +."""
    s = F.regexp_replace(F.regexp_replace(strip(value), "[A-Za-z]", "A"), "[0-9]", "9")
    return blank_null(F.regexp_replace(F.regexp_replace(s, "A{2,}", "A+"), "9{2,}", "9+"))


NORMALIZERS = {
    "lower": F.lower,
    "trim": strip,
    "collapse_ws": lambda v: F.regexp_replace(v, r"\s+", " "),
    "alnum": lambda v: F.regexp_replace(v, "[^0-9a-z]", ""),
    "number": lambda v: F.coalesce(F.regexp_replace(F.regexp_replace(v, ",", "").try_cast("double").cast("string"), r"\.0$", ""), v),
}


def normalize_value(value: Column, names: list[str]) -> Column:
    """A chain of named normalisers; unknown names are skipped, null counts as empty."""
    out = F.coalesce(value, F.lit(""))
    for n in names:
        if n in NORMALIZERS:
            out = NORMALIZERS[n](out)
    return out
