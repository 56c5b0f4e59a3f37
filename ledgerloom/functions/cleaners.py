"""Value cleaners: a Column in, a Column (or a struct of value and flag) out. Spark functions only, nothing is invented.

A value that cannot be read becomes NULL; where that loses something, a flag says why.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import vocabulary as V

def none() -> Column:
    return F.lit(None).cast("string")



def _or_null(c: Column) -> Column:
    return F.when(c != "", c)


def _null_token(c: Column) -> Column:
    return F.lower(c).isin(V.NULL_TOKENS)


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def title_case(c: Column) -> Column:
    """Each run of letters with a capital first."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1)), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000)))), "")


def all_capitals(c: Column) -> Column:
    return (c == F.upper(c)) & (c != F.lower(c))


def squeezed(c: Column) -> Column:
    """White space runs, no-break spaces too, as one space; none at the ends."""
    return F.trim(F.regexp_replace(F.replace(c, F.lit(" "), F.lit(" ")), r"(?U)\s+", " "))


def tidy_text(c: Column, strip_tag: bool = True) -> Column:
    s = squeezed(c)
    return F.trim(F.regexp_replace(s, r"^\[[A-Za-z0-9]+\]\s*", "")) if strip_tag else s


def clean_text(c: Column, strip_tag: bool = True, tidy: Column | None = None) -> Column:
    """:func:`tidy_text` unless it stands for no value. ``tidy`` may be given where it is known."""
    s = tidy_text(c, strip_tag) if tidy is None else tidy
    return F.when(~_null_token(s), s)


def clean_name(c: Column, text: Column | None = None) -> Column:
    s = clean_text(c) if text is None else text
    return F.when(~F.lower(s).isin(V.LABEL_NAMES) & ~s.rlike(r"(?i)^owners?\s+data\s*#\d+$"), s)


_SCIENTIFIC = r"^\d+\.\d+[eE][+-]?\d+$"


def phone_text(c: Column) -> Column:
    """The text of a phone with its digits: scientific notation written out, a leading O as 0."""
    s = F.trim(c)
    return F.when(s.rlike(_SCIENTIFIC), s.try_cast("double").try_cast("bigint").cast("string")).otherwise(F.regexp_replace(s, r"^[Oo](\d)", "0$1"))


def phone_digits(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\D", ""), "^00", "")


def clean_phone(c: Column, digits: Column | None = None) -> Column:
    """struct(num, flag): E.164 where the country is known, else digits with a flag. ``digits`` may be given where they are known."""
    s = F.trim(c)
    scientific = s.rlike(_SCIENTIFIC)
    number = s.try_cast("double")
    d = phone_digits(phone_text(c)) if digits is None else digits
    n = F.length(d)
    uae = F.regexp_replace(d, r"^9710*(971)?", "971")
    prefixes = "|".join(V.MOBILE_PREFIXES)

    def result(num, flag=None):
        return F.struct(num.cast("string").alias("num"), F.lit(flag).cast("string").alias("flag"))

    return (
        F.when(c.isNull() | _null_token(s), result(none()))
        .when(scientific & (number > 1e15), result(none(), "phone_corrupt_scientific"))
        .when(~s.rlike(r"\d"), result(none(), "phone_no_digits"))
        .when(n < 7, result(none(), "phone_too_short"))
        .when(n > 15, result(none(), "phone_too_long"))
        .when(scientific, result(d, "phone_precision_lost_in_excel"))
        .when(d.startswith("971") & (F.length(uae) < 11), result(uae, "phone_too_short_for_uae"))
        .when(d.startswith("971") & (F.length(uae) > 12), result(uae, "phone_too_long_for_uae"))
        .when(d.startswith("971"), result(F.concat(F.lit("+"), uae)))
        .when(d.rlike(rf"^0({prefixes})\d{{7}}$"), result(F.concat(F.lit("+971"), F.substring(d, 2, 15))))
        .when(d.rlike(rf"^({prefixes})\d{{7}}$"), result(F.concat(F.lit("+971"), d)))
        .when(d.rlike(r"^[234679]\d{6,7}$") | d.startswith("0"), result(d, "phone_local_no_country_code"))
        .when(n >= 8, result(F.concat(F.lit("+"), d)))
        .otherwise(result(d, "phone_no_country_code"))
    )


def phone_slots(*phones: Column) -> Column:
    """struct(mobile_1, mobile_2, mobile_3, flags) of cleaned phones: repeats and gaps go, order stays."""
    numbers = F.array_distinct(F.array_compact(F.array(*[p["num"] for p in phones])))
    return F.struct(*[F.get(numbers, F.lit(i)).alias(f"mobile_{i + 1}") for i in range(3)], F.array_compact(F.array(*[p["flag"] for p in phones])).alias("flags"))


def is_mobile(c: Column) -> Column:
    """UAE numbers by their prefix; a number of another country passes."""
    d = F.regexp_replace(c, r"^\++", "")
    return F.when(c.isNull() | (c == ""), F.lit(False)).when(d.startswith("971"), F.substring(d, 4, 2).isin(V.MOBILE_PREFIXES)).otherwise(F.lit(True))


def first_email(c: Column, tidy: Column | None = None) -> Column:
    return F.lower(F.trim(F.get(F.split(clean_text(c, strip_tag=False, tidy=tidy), ","), F.lit(0))))


def clean_email(c: Column, first: Column | None = None) -> Column:
    s = first_email(c) if first is None else first
    good = s.rlike(r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$")
    return F.struct(F.when(good, s).alias("value"), F.when(~good, F.lit("email_invalid")).alias("flag"))


def clean_number(c: Column) -> Column:
    s = F.trim(c)
    return F.when(~_null_token(s), F.nullif(F.regexp_replace(s, r"[^\d.\-]", "").try_cast("double"), F.lit(0.0)))


def rounded(c: Column) -> Column:
    """To two places, halves up: the same on every engine."""
    return F.floor(c * 100 + 0.5) / 100


def clean_size(c: Column, header: Column | None = None) -> Column:
    """Square feet. The number before a square-metre unit, or one below such a header, is converted."""
    unit = F.regexp_extract(c, r"(?i)(\d[\d,]*(?:\.\d+)?)\s*" + V.SQUARE_METRES, 1)
    metres = F.when(unit != "", F.regexp_replace(unit, ",", "").try_cast("double"))
    if header is not None:
        metres = F.coalesce(metres, F.when(header.rlike("(?i)" + V.SQUARE_METRES), clean_number(c)))
    return rounded(F.coalesce(metres * V.SQUARE_FEET, clean_number(c)))


def clean_date(c: Column) -> Column:
    s = F.trim(c)
    return F.when(~_null_token(s), F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in V.DATE_FORMATS]))


def excel_serial(days: Column) -> Column:
    """Days since 1899-12-30, where 1 < days < 80000."""
    return F.when((days > 1) & (days < 80_000), F.timestamp_micros(F.round((days - 25_569) * 86_400_000_000).cast("bigint")))


def clean_bedroom(c: Column, text: Column | None = None) -> Column:
    s = clean_text(c) if text is None else text
    low = F.lower(s)
    found = F.regexp_extract(low, r"(\d+)\s*(?:bhk|b\s*/?\s*r|bed(?:room)?s?)", 1)
    n = F.when(found != "", found).when(s.rlike(r"^\d{1,3}$"), s).try_cast("int")
    value = (
        F.when(low.contains("studio"), F.lit("Studio"))
        .when(n > V.MOST_BEDROOMS, none())
        .when(n.isNotNull(), F.concat(n.cast("string"), F.lit(" BR")))
        .when(low == "penthouse", F.lit("Penthouse"))
        .when(low == "retail", F.lit("Retail"))
        .otherwise(s)
    )
    return F.struct(value.alias("value"), F.when(~low.contains("studio") & (n > V.MOST_BEDROOMS), F.lit("bedroom_implausible")).alias("flag"))


def clean_unit(c: Column, text: Column | None = None) -> Column:
    return _or_null(F.trim(F.regexp_replace(clean_text(c) if text is None else text, "[-s]+$", "")))


def clean_party_type(c: Column, text: Column | None = None) -> Column:
    s = F.upper(clean_text(c) if text is None else text)
    return F.when(s.startswith("BUY"), F.lit("Buyer")).when(s.startswith("SELL"), F.lit("Seller"))


def clean_nationality(c: Column, text: Column | None = None) -> Column:
    s = clean_text(c) if text is None else text
    return F.when(F.upper(s).isin(V.UAE_SPELLINGS), F.lit("United Arab Emirates")).when(all_capitals(s) & (F.length(s) > 3), title_case(s)).otherwise(s)


def without_number(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+\d+$", ""))


def is_place(c: Column) -> Column:
    """Whether a community names a place: something that is neither a stand-in for no value nor a sheet title."""
    return F.coalesce(~_null_token(F.trim(c)) & ~F.trim(c).rlike("(?i)" + V.COMMUNITY_NOISE), F.lit(False))


def has_text(c: Column) -> Column:
    return F.coalesce(~_null_token(F.trim(c)), F.lit(False))


def clean_community(c: Column, text: Column | None = None, short: Column | None = None) -> Column:
    """The known name of the text as it stands, else of the text without a number at its end."""
    s = clean_text(c) if text is None else text
    short = without_number(s) if short is None else short
    known = F.coalesce(lookup(V.COMMUNITIES, F.upper(s)), lookup(V.COMMUNITIES, F.upper(short)))
    plain = F.when(all_capitals(short) & (F.length(short) > 2), title_case(short)).when(short != "", short).otherwise(s)
    return F.when(~s.rlike("(?i)" + V.COMMUNITY_NOISE), F.coalesce(known, plain))


def filename_community(c: Column) -> Column:
    """The place that a file's name tells, or an empty string."""
    stem = F.regexp_replace(F.regexp_extract(c, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    tag, rest = F.regexp_extract(stem, r"^\[(.*?)\]", 1), F.regexp_extract(stem, r"^\[.*?\]\s*(.*)", 1)
    stem = F.when(stem.rlike(r"^\[.*?\]"), F.when(F.trim(rest) != "", rest).otherwise(tag)).otherwise(stem)
    noise = "(?i)" + V.FILE_NOISE
    s = F.regexp_replace(F.regexp_replace(stem, r"[\(\[\{].*?[\)\]\}]", " "), noise, " ")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, r"[-_./\\]", " "), r"\s+", " "))
    s = F.trim(F.regexp_replace(s, r"(?i)\b(done|new)\b", ""))
    s = F.when((s == "") & (tag != ""), F.trim(F.regexp_replace(tag, noise, " "))).otherwise(s)
    words = F.array_join(F.transform(F.filter(F.split(s, r"\s+"), lambda w: w != ""), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000)))), " ")
    return F.coalesce(F.when((s == F.upper(s)) != (s == F.lower(s)), words).otherwise(s), F.lit(""))


def place_key(c: Column) -> Column:
    """Lower-case words that tell a place, or all its words if none does."""
    t = F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))
    words = F.array_join(F.filter(F.split(t, " "), lambda w: ~w.isin(V.PLACE_NOISE)), " ")
    return F.when(words != "", words).otherwise(t)


def name_key(c: Column) -> Column:
    """Sorted words of a name with variants unified and titles left out, unless nothing else is there."""
    words = F.filter(F.split(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"(?U)[^\w\s]", " "), r"(?U)\s+"), lambda w: w != "")
    forms = F.transform(words, lambda w: F.coalesce(lookup(V.NAME_FORMS, w), w))
    telling = F.filter(forms, lambda w: ~w.isin(V.NAME_NOISE))
    return F.array_join(F.array_sort(F.when(F.size(telling) > 0, telling).otherwise(forms)), " ")


def property_key(community: Column, building: Column, unit: Column, plot: Column) -> Column:
    tidy = lambda c: F.upper(F.trim(F.coalesce(c, F.lit(""))))
    place = F.when(F.coalesce(unit, F.lit("")) != "", tidy(unit)).otherwise(tidy(plot))
    return F.when((tidy(community) != "") & (place != ""), F.concat_ws("|", tidy(community), tidy(building), place))


def identity_hash(name: Column, mobile: Column, community: Column, building: Column, unit: Column, plot: Column) -> Column:
    part = lambda c: F.coalesce(F.upper(c), F.lit(""))
    return F.sha2(F.concat_ws("|", part(name), F.coalesce(mobile, F.lit("")), part(community), part(building), part(unit), part(plot)), 256)


def normal_header(c: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("`"), F.lit("'")), r"(?U)\s+", " ")))


def looks_like_data(c: Column) -> Column:
    """Whether a cell holds a value rather than a heading: an e-mail, a phone-like run, a date or a number."""
    return F.coalesce(
        c.rlike(r"[^@\s]+@[^@\s]+\.[A-Za-z]{2,}") | (c.rlike(r"^[\d\s+\-|().]{7,}$")) | c.rlike(r"^\d{4}-\d{2}-\d{2}") | F.regexp_replace(c, ",", "").try_cast("double").isNotNull(),
        F.lit(False),
    )
