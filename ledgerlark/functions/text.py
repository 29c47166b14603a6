"""Text normalisation and the parsers from text to number, date and boolean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as a written form of "missing".
ARABIC_PLACEHOLDERS = [
    "غير معروف", "غير محدد", "غير متوفر", "غير متاح", "لا يوجد", "لايوجد", "مجهول", "خطأ", "بدون", "فارغ",
]
NULL_TOKENS = [
    "", "-", "--", "?", "??", "n/a", "n.a.", "na", "nan", "none", "null", "nil",
    "unknown", "unspecified", "not available", "not specified", "missing",
    "tbd", "tba", "error", "err", "#n/a", "#value!", "#ref!", "#div/0!",
    "\\n", "<na>", "(blank)", "blank", "empty",
    "غير معروف", "غير محدد", "غير متوفر", "غير متاح", "لا يوجد", "لايوجد", "مجهول", "خطأ", "خطا", "بدون", "فارغ",
]
# Arabic function words.
ARABIC_STOP_WORDS = [
    "في", "من", "الى", "إلى", "على", "عن", "مع", "هذا", "هذه", "ذلك",
    "تلك", "التي", "الذي", "الذين", "ما", "لا", "لم", "لن", "ان", "أن",
    "إن", "كان", "كانت", "يكون", "هو", "هي", "هم", "نحن", "انت", "أنت",
    "او", "أو", "و", "ثم", "قد", "كل", "بعض", "غير", "بين", "بعد",
    "قبل", "عند", "حتى", "اذا", "إذا", "كما", "لكن", "الا", "إلا",
]
# Yes and no.
TRUE_TOKENS = ["true", "t", "yes", "y", "1", "1.0", "on", "نعم", "صح", "صحيح"]
FALSE_TOKENS = ["false", "f", "no", "n", "0", "0.0", "off", "لا", "خطا", "خطأ"]
# Patterns of the formats.
ARABIC_LETTERS = r"[؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿]"
DIACRITICS = r"[\u0610-\u061A\u064B-\u065F\u0670\u06D6-\u06ED]"
DECORATION = (
    r"(?iU)[$€£¥₹﷼%٪\s  ]|\b(?:usd|eur|gbp|egp|sar|aed|kwd|jod|qar|bhd|try|inr)\b"
    r"|ج\.م|ر\.س|د\.إ|د\.ك"
)
STRICT_NUMBER = r"^[+-]?[0-9.,]*[0-9][0-9.,]*([eE][+-]?[0-9]+)?$"
DECIMAL_COMMA = r"^[+-]?[0-9]+,[0-9]{1,2}$"
EUROPEAN = r"^\s*[^\d\-+]*[-+]?\d{1,3}(\.\d{3})+,\d+\s*[^\d]*$"
ANGLO = r"^\s*[^\d\-+]*[-+]?\d{1,3}(,\d{3})+\.\d+\s*[^\d]*$"
DAY_MONTH_YEAR = r"^\s*(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})\s*$"
DATE_START = r"^(?:\d{1,4}-\d|\d{1,2} [A-Za-z]|[A-Za-z]{3,9} \d)"
YEAR_FIRST = r"^\s*\d{4}[/\-.]\d{1,2}[/\-.]\d{1,2}"

_ALEFS = "أإآٱ"
_INDIC = "٠١٢٣٤٥٦٧٨٩"
_EASTERN = "۰۱۲۳۴۵۶۷۸۹"
_WESTERN = "0123456789"
_TATWEEL = "ـ"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate *value* once and use it several times in *body*.

    Keeps the generated code of the long parsers small: inlined everywhere, a
    shared part would grow the method beyond what the JVM compiles.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def collapse_spaces(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def normalize_arabic(c: Column | str) -> Column:
    """Strip diacritics and tatweel, fold alef and ya, map digits and punctuation."""
    bare = F.regexp_replace(_col(c), DIACRITICS, "")
    source = _ALEFS + "ى" + _INDIC + _EASTERN + "،؛؟٫٬" + _TATWEEL
    target = "ا" * len(_ALEFS) + "ي" + _WESTERN + _WESTERN + ",;?.,"  # tatweel has no target: removed
    return collapse_spaces(F.translate(bare, source, target))


def has_arabic(c: Column | str) -> Column:
    return F.rlike(_col(c), F.lit(ARABIC_LETTERS))


def arabic_ratios(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the share of values with Arabic letters, per column."""
    return df.agg(*[
        F.coalesce(F.round(F.avg(F.when(F.col(c).isNotNull(), has_arabic(c).cast("int"))), 3), F.lit(0.0)).alias(c)
        for c in columns
    ])


def normalize_arabic_columns(df: DataFrame, min_ratio: float = 0.05) -> DataFrame:
    """Normalise the text columns in which at least *min_ratio* of values are Arabic."""
    texts = [name for name, kind in df.dtypes if kind == "string"]
    if not texts:
        return df
    ratios = arabic_ratios(df, texts).first().asDict()
    return df.withColumns({c: normalize_arabic(c) for c in texts if ratios[c] >= min_ratio})


def remove_stop_words(c: Column | str) -> Column:
    text = _col(c)
    words = F.filter(F.split(collapse_spaces(text), " "), lambda w: ~w.isin(ARABIC_STOP_WORDS))
    kept = F.array_join(words, " ")
    return F.when(kept == "", text).otherwise(kept)


def is_placeholder(c: Column | str) -> Column:
    """True for a written form of "missing"; NULL stays false."""
    return F.coalesce(F.lower(normalize_arabic(c)).isin(NULL_TOKENS), F.lit(False))


def category_key(c: Column | str) -> Column:
    """Key shared by spellings that differ in case, spacing or punctuation."""
    bare = F.regexp_replace(F.lower(normalize_arabic(c)), r"(?U)[^\w\s]", "")
    return collapse_spaces(bare)


def decimal_separator(c: Column | str) -> Column:
    """Aggregate: ',' when more values can only be read the European way, else '.'."""
    text = _col(c)
    european, anglo = F.rlike(text, F.lit(EUROPEAN)), F.rlike(text, F.lit(ANGLO))
    return F.when(F.count_if(european) > F.count_if(anglo), ",").otherwise(".")


def parse_number(c: Column | str, separator: str = ".", percent_to_fraction: bool = True) -> Column:
    """Text to number; codes, dates and placeholders become NULL, never a guess."""
    raw = F.trim(F.translate(_col(c), "−\u00a0", "- "))
    return let(raw, lambda text: _number_of(text, separator, percent_to_fraction))


def _number_of(raw: Column, separator: str, percent_to_fraction: bool) -> Column:
    bracketed = raw.startswith("(") & raw.endswith(")")
    inner = F.trim(F.regexp_replace(raw, r"^\((.*)\)$", "$1"))
    percent = F.rlike(raw, F.lit("[%٪]"))

    def plain(bare: Column) -> Column:
        european = F.rlike(bare, F.lit(DECIMAL_COMMA)) | F.lit(separator == ",")
        digits = F.when(european, F.translate(bare, ",.", ".")).otherwise(F.translate(bare, ",", ""))
        return F.when(F.rlike(bare, F.lit(STRICT_NUMBER)), digits.try_cast("double"))

    # a placeholder has letters or no digit, so the strict shape already refuses it
    value = let(F.trim(F.regexp_replace(inner, DECORATION, "")), plain)
    divisor = F.when(percent & F.lit(percent_to_fraction), 100.0).otherwise(1.0)
    return value / divisor * F.when(bracketed, -1.0).otherwise(1.0)


def _part(c: Column, group: int) -> Column:
    return F.regexp_extract(c, DAY_MONTH_YEAR, group).try_cast("int")


def day_first(c: Column | str) -> Column:
    """Aggregate: true day first, false month first, NULL when the values cannot tell."""
    text = _col(c)
    shaped = F.rlike(text, F.lit(DAY_MONTH_YEAR))
    a, b = F.when(shaped, _part(text, 1)), F.when(shaped, _part(text, 2))
    days = F.count_if((a > 12) & (b <= 12))
    months = F.count_if((b > 12) & (a <= 12))
    return (
        F.when((days > 0) & (months == 0), True).when((months > 0) & (days == 0), False)
        .when((days > 0) | (F.count_if(shaped) > 0), F.lit(None).cast("boolean")).otherwise(False)
    )


def parse_timestamp(c: Column | str, day_first_known: bool | None = False, fmt: str | None = None) -> Column:
    """Text to a timestamp without zone; values no format fits become NULL."""
    text = F.trim(_col(c))
    if fmt:
        return F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")
    dashed = F.regexp_replace(F.regexp_replace(text, r"^(\d{1,4})[/.](\d{1,2})[/.]", r"$1-$2-"), r"^(\d{4}-\d{1,2}-\d{1,2})T", "$1 ")
    return let(dashed, lambda t: _by_shape(t, bool(day_first_known))).cast("timestamp_ntz")


def _by_shape(t: Column, days_first: bool) -> Column:
    """One attempt per value: the shape picks the format, as a failed attempt is dear."""
    def shaped(pattern: str) -> Column:
        return F.rlike(t, F.lit(pattern))

    def read(fmt: str) -> Column:
        return F.try_to_timestamp(t, F.lit(fmt))

    parts = F.split(t, "[-]")
    # a value that only fits the other order is still read, as in a mixed column
    swap = F.get(parts, F.lit(1 if days_first else 0)).try_cast("int") > 12
    order = ("M-d", "d-M") if days_first else ("d-M", "M-d")
    out = F.lit(None).cast("timestamp")
    for tail, time in ((r"$", ""), (r" \d{1,2}:\d{2}$", " H:mm"), (r" \d{1,2}:\d{2}:\d{2}$", " H:mm:ss")):
        out = F.when(shaped(r"^\d{4}-\d{1,2}-\d{1,2}" + tail), read("yyyy-M-d" + time)).otherwise(out)
        for width, year in ((4, "yyyy"), (2, "yy")):
            either = F.when(swap, read(f"{order[0]}-{year}{time}")).otherwise(read(f"{order[1]}-{year}{time}"))
            out = F.when(shaped(r"^\d{1,2}-\d{1,2}-\d{" + str(width) + "}" + tail), either).otherwise(out)
    for pattern, fmt in ((r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"), (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
                         (r"^\d{1,2} [A-Za-z]{4,9} \d{4}$", "d MMMM yyyy"), (r"^[A-Za-z]{4,9} \d{1,2}, \d{4}$", "MMMM d, yyyy")):
        out = F.when(shaped(pattern), read(fmt)).otherwise(out)
    return F.when(shaped(DATE_START), out)  # one test for the many values that are no date


# Magnitudes of spreadsheet serials and epochs.
EXCEL_SERIALS = (20_000, 80_000)
EPOCH_SECONDS = (5e8, 4e9)
EPOCH_MILLIS = (5e11, 4e12)


def timestamp_of_number(c: Column | str, kind: str) -> Column:
    """A number read as spreadsheet serial days, epoch seconds or milliseconds."""
    v = _col(c).try_cast("double")
    seconds = {"serial": (v - 25_569) * 86_400, "seconds": v, "millis": v / 1000}[kind]
    return F.timestamp_micros(F.round(seconds * 1_000_000).cast("long")).cast("timestamp_ntz")


def number_date_kind(median: float | None) -> str | None:
    if median is None:
        return None
    for kind, (lo, hi) in (("serial", EXCEL_SERIALS), ("millis", EPOCH_MILLIS), ("seconds", EPOCH_SECONDS)):
        if lo <= median <= hi:
            return kind
    return None


def parse_boolean(c: Column | str) -> Column:
    token = F.lower(normalize_arabic(c))
    return F.when(token.isin(TRUE_TOKENS), True).when(token.isin(FALSE_TOKENS), False)


def key_text(c: Column | str) -> Column:
    """Normal form of a key that is not a number."""
    return F.lower(normalize_arabic(_col(c).cast("string")))


def key_number(c: Column | str) -> Column:
    """Normal form of a numeric key: 1001, 1001.0 and '1001' are one key."""
    whole = _col(c).try_cast("decimal(38,0)")
    number = _col(c).try_cast("double")
    return F.when(number.isNull(), None).when(number == whole, whole.cast("string")).otherwise(number.cast("string"))


def all_numeric(c: Column | str) -> Column:
    """Aggregate: every value present reads as a number (and there is one)."""
    value = _col(c)
    bad = F.count_if(value.isNotNull() & value.try_cast("double").isNull())
    return (bad == 0) & (F.count(value) > 0)
