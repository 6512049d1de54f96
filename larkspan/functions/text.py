"""String expressions; every function maps columns to a column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The college-name rules, in order of application.
PARENTHESES = r" \(.+?\)"
PERCENT_CODES = {"%2c": ",", "%26": "&", "%27": "'"}
CAMPUS = "at (.+/?)"
CAMPUS_STRICT = r"\bat (.+/?)"
STATE_SUFFIX = r",\s[a-z][a-z]"
# The bar-name rules.
LEADING_EMPHASIS = r"<em> (.*?)</em>"
LISTING_NUMBER = r"No. \d+ --"
TRAILING_EMPHASIS = r": <em>(.*?)</em>"
# Fixed value: feet in a mile.
FEET_PER_MILE = 5280

DOLLAR_SAFE = re.compile(r"([\\$])")


def _literal(replacement: str) -> str:
    """Escape a replacement so that Java inserts it as it is."""
    return DOLLAR_SAFE.sub(r"\\\1", replacement)


def title(c: Column) -> Column:
    """Title case; underscores separate words as blanks do."""
    return F.initcap(F.regexp_replace(c, "_", " "))


def replace_all(c: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(c, pattern, _literal(replacement))


def replace_first(c: Column, pattern: str, replacement: str) -> Column:
    """Only the first match; text without a match is unchanged."""
    return F.regexp_replace(c, f"(?s)^(.*?)(?:{pattern})", "$1" + _literal(replacement))


def parse_number(c: Column) -> Column:
    """First number in decorated text: ``$1,234`` -> 1234.0, ``45%`` -> 45.0."""
    digits = F.regexp_extract(c, r"-?[0-9][0-9,]*\.?[0-9]*", 0)
    return F.regexp_replace(digits, ",", "").try_cast("double")


def swap_name(c: Column) -> Column:
    """``Last, First`` -> ``First Last`` (second token, then first)."""
    words = F.split(replace_first(c, ",", ""), " ")
    return F.concat_ws(" ", F.get(words, F.lit(1)), F.get(words, F.lit(0)))


def normalise_college(c: Column, strict: bool = False) -> Column:
    """College-name rules; ``strict`` asks for a word boundary before ``at``."""
    c = F.regexp_replace(c, PARENTHESES, "")
    for code, char in PERCENT_CODES.items():
        c = F.replace(c, F.lit(code), F.lit(char))
    c = F.regexp_replace(c, CAMPUS_STRICT if strict else CAMPUS, "")
    c = F.regexp_replace(c, STATE_SUFFIX, "")
    return F.trim(F.replace(c, F.lit(" - "), F.lit("-")))


def has_letters(c: Column) -> Column:
    return c.rlike(r"\p{L}")


def is_upper(c: Column) -> Column:
    return (c == F.upper(c)) & has_letters(c)


def is_lower(c: Column) -> Column:
    return (c == F.lower(c)) & has_letters(c)


def clean_bar_name(c: Column) -> Column:
    """Listing name without markup; NULL where the shape rules reject it.

    The all-caps and all-lower rules look at the name before entities,
    trailing emphasis and colons are removed; blanks are rejected at the end.
    """
    named = F.trim(F.regexp_replace(F.regexp_replace(c, LEADING_EMPHASIS, ""), LISTING_NUMBER, ""))
    shown = F.replace(named, F.lit("&amp;"), F.lit("&"))
    shown = F.replace(F.regexp_replace(shown, TRAILING_EMPHASIS, ""), F.lit(":"), F.lit(""))
    return F.when(~is_upper(named) & ~is_lower(named) & (shown != ""), shown)


def add_suffix(c: Column, suffix: str) -> Column:
    return F.concat(c, F.lit(suffix))


def drop_suffix(c: Column, suffix: str) -> Column:
    return F.when(F.endswith(c, F.lit(suffix)), F.substring(c, 1, F.length(c) - len(suffix))).otherwise(c)


def first_digits(c: Column) -> Column:
    """First run of digits; NULL where there is none."""
    return F.nullif(F.regexp_extract(c, r"\d+", 0), F.lit(""))


def first_tokens(c: Column, n: int, sep: str = " ") -> Column:
    return F.array_join(F.slice(F.split(c, sep), 1, n), sep)


def surname_initial(c: Column) -> Column:
    return F.substring(F.get(F.split(c, " "), F.lit(1)), 1, 1)


def player_url(base: str, name: Column, key: Column) -> Column:
    return F.concat(F.lit(base), surname_initial(name), F.lit("/"), key, F.lit(".htm"))


def fmt_hour(c: Column) -> Column:
    """Hour 0-23 on a 12-hour clock without a leading zero: 13 -> ``1:00 PM``."""
    half = F.when(c < 12, F.lit("AM")).otherwise(F.lit("PM"))
    clock = (c + F.lit(11)) % F.lit(12) + F.lit(1)
    return F.concat(clock.cast("int").cast("string"), F.lit(":00 "), half)


def fmt_line(hour: Column, temp: Column, wind: Column, status: Column) -> Column:
    whole = lambda x: F.rint(x).cast("bigint").cast("string")
    return F.concat(
        F.lit("<b>"), fmt_hour(hour), F.lit(":</b> "), whole(temp), F.lit("F with wind at "), whole(wind),
        F.lit(" mph and "), F.lower(status),
    )


def to_feet(c: Column) -> Column:
    """``350 ft`` -> 350, ``1.2 mi`` -> 6336; anything else NULL."""
    amount = lambda unit: F.replace(c, F.lit(unit), F.lit("")).try_cast("double")
    return F.when(F.contains(c, F.lit("ft")), amount(" ft")).when(
        F.contains(c, F.lit(" mi")), amount(" mi") * FEET_PER_MILE
    )


def label_from_name(c: Column) -> Column:
    """Distance label out of a column name: ``..._20_29_yards`` -> ``20-29``, ``..._50_yards`` -> ``50+``."""
    low = F.regexp_extract(c, r"(\d{2})", 1)
    high = F.regexp_extract(c, r"\d{2}_(\d{2})", 1)
    return F.when(low == "", F.lit(None)).when(high == "", F.concat(low, F.lit("+"))).otherwise(
        F.concat(low, F.lit("-"), high)
    )


def plain_text(c: Column) -> Column:
    """Markup removed, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", ""), r"\s+", " "))


def truncate(c: Column, n: int, ellipsis: str = "…") -> Column:
    """Cut after the last whole word inside ``n`` characters."""
    head = F.substring(c, 1, n)
    whole = F.regexp_replace(head, r"\s+\S*$", "")
    kept = F.when(F.substring(c, n + 1, 1).rlike(r"^\s?$"), head).otherwise(whole)
    return F.when(F.char_length(c) <= n, c).otherwise(F.concat(F.rtrim(kept), F.lit(ellipsis)))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def reading_minutes(c: Column, words_per_minute: int = 213) -> Column:
    """Whole minutes, rounded up, at least one for non-empty text."""
    return F.ceil(word_count(c) / F.lit(words_per_minute)).cast("int")


def snippet(text: Column, term: Column, fallback: Column, around: int = 60) -> Column:
    """Text around the first case-insensitive match; ``fallback`` where there is none."""
    at = F.position(F.lower(term), F.lower(text))
    start = F.greatest(at - around, F.lit(1))
    length = F.least(at + F.char_length(term) + around, F.char_length(text) + 1) - start
    return F.when(at > 0, F.substr(text, start, length)).otherwise(fallback)
