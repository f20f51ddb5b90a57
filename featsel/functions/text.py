"""Scalar rules on text values: missing, numbers, dates, text measures, names."""

from __future__ import annotations

import sys
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that count as missing, after stripping and in lower case.
MISSING = ("", "?", "n/a", "na", "nan", "none", "null")
# Words that say nothing about a text.
STOP_WORDS = ("and", "are", "but", "for", "from", "has", "have", "into", "not", "that", "the", "this", "was", "were", "with", "your")
#: A word: letters, digits, _, ' and -, from a letter, digit or _ to one of these; nothing in it is tried twice.
WORD = r"(?U)\w++(?:['-]++\w++)*+"
#: The same for texts of ASCII characters only, for which it is several times faster.
_ASCII_WORD = r"[0-9A-Z_a-z]++(?:['-]++[0-9A-Z_a-z]++)*+"
_NUMBER_TEXT = r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*%?$"


@lru_cache
def _white() -> str:
    """The characters of Unicode that count as white space."""
    return "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace())


def bound(x: Column, f) -> Column:
    """f(x), with x bound to a variable: computed once however often f reads it. What f does stays out of the code generated for
    all columns together, which Java runs uncompiled when it grows beyond 8,000 bytes."""
    return F.transform(F.array(x), f)[0]


def stripped(c: Column) -> Column:
    """Without white space (Unicode's) at the ends; null is the empty text."""
    return F.btrim(F.coalesce(c.cast("string"), F.lit("")), F.lit(_white()))


def is_missing(c: Column) -> Column:
    return stripped_missing(stripped(c))


def stripped_missing(x: Column) -> Column:
    """`is_missing` of a text without white space at the ends; only short ones are compared."""
    return (F.octet_length(x) <= max(map(len, MISSING))) & F.lower(x).isin(*MISSING)


def as_number(c: Column) -> Column:
    """The number a text stands for: thousands commas dropped, a trailing % divides by 100; null if it is none."""
    return stripped_number(stripped(c))


def stripped_number(x: Column) -> Column:
    """`as_number` of a text without white space at the ends. Only one that begins with a digit or one of + , - . / is looked at."""
    return F.when(F.ascii(x).between(ord("+"), ord("9")), bound(x, _number))


def _number(x: Column) -> Column:
    plain = F.replace(x, F.lit(","), F.lit(""))
    value = F.nullif(F.regexp_extract(plain, _NUMBER_TEXT, 1), F.lit("")).try_cast("double")
    value = F.when(plain.endswith("%"), value * 0.01).otherwise(value)
    return F.when(F.abs(value) < float("inf"), value)


def as_days(c: Column) -> Column:
    """Days since 1970-01-01 (with fraction) of an ISO date or time, or of Y/m/d, m/d/Y or d/m/Y; a time without
    offset is UTC, whatever the session's zone; null if it is no date."""
    return stripped_days(stripped(c))


def stripped_days(x: Column) -> Column:
    """`as_days` of a text without white space at the ends. Only one of eight bytes or more that begins with a digit is looked at."""
    return F.when((F.octet_length(x) >= 8) & F.ascii(x).between(ord("0"), ord("9")), bound(x, _days))


def _days(x: Column) -> Column:
    tail = r"([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?"
    naive = F.when(x.rlike(rf"^\d{{4}}-\d{{2}}-\d{{2}}{tail}$"), x.try_cast("timestamp_ntz"))
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    zoned = F.when(x.rlike(rf"^\d{{4}}-\d{{2}}-\d{{2}}{tail}(Z|[+-]\d{{2}}:\d{{2}})$"), F.unix_micros(x.try_cast("timestamp")))
    day = lambda pattern, form: F.when(x.rlike(pattern), F.try_to_date(x, form))
    dates = F.coalesce(
        day(r"^\d{8}$", "yyyyMMdd"),
        day(r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
        day(r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
        day(r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
        day(r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    )
    micros = F.coalesce(F.timestamp_diff("MICROSECOND", epoch, naive), zoned)
    return F.coalesce(micros / F.lit(86_400_000_000.0), F.datediff(dates, F.lit("1970-01-01").cast("date")).cast("double"))


def _ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def tokens(c: Column) -> Column:
    """Words of a text in lower case: runs of letters, digits, _, ' and -."""
    low = F.lower(F.coalesce(c, F.lit("")))
    found = lambda word: F.regexp_extract_all(low, F.lit(word), F.lit(0))
    return F.when(_ascii(low), found(_ASCII_WORD)).otherwise(found(WORD))


def word_count(c: Column) -> Column:
    """How many words (`tokens`) a text has."""
    return F.when(_ascii(c), F.regexp_count(c, F.lit(_ASCII_WORD))).otherwise(F.regexp_count(c, F.lit(WORD)))


@lru_cache
def digits() -> str:
    """The characters that count as digits, for a character class: decimal digits of every script, and raised, lowered and circled ones.
    Neighbours are one range, as a class tries its members one by one."""
    spans: list[list[int]] = []
    for x in range(sys.maxunicode + 1):
        if chr(x).isdigit() and not chr(x).isdecimal():
            if spans and spans[-1][1] == x - 1:
                spans[-1][1] = x
            else:
                spans.append([x, x])
    return r"\p{Nd}" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in spans)


def digit_count(c: Column) -> Column:
    """How many characters of a text are digits. What is ASCII and no digit goes in runs first, so few characters meet the whole class."""
    return F.regexp_count(F.regexp_replace(c, r"[\x00-/:-\x7F]++", ""), F.lit(f"[{digits()}]"))


def keywords(words: Column) -> Column:
    """Of the words of a text those that can become indicators, each once: three characters at least, no stop word, not all digits."""
    fit = lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS) & ~w.rlike(f"^[{digits()}]+$")
    return F.filter(F.array_distinct(words), fit)


def text_measures(df: DataFrame, column: str) -> DataFrame:
    """Adds length, words (count), variety (distinct words / words) and digit share of a text; null counts as empty."""
    text, words = F.coalesce(F.col(column), F.lit("")), F.size("_tokens")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return df.withColumn("_tokens", tokens(F.col(column))).withColumns({
        "length": F.length(text).cast("double"),
        "words": words.cast("double"),
        "variety": share(F.size(F.array_distinct("_tokens")), words),
        "digit_share": share(digit_count(text), F.length(text)),
    }).drop("_tokens")


def display_name(c: Column) -> Column:
    """Runs of _ and - become a space; the first letter is upper case. Nothing left, or null: the selected target."""
    name = stripped(F.regexp_replace(c, "[_-]+", " "))
    return F.when(name == "", F.lit("the selected target")).otherwise(F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.length(name))))


def clean_headers(names: list[str]) -> list[str]:
    """Stripped names; a blank one is column_<n>; repeats get _2, _3, ... until they are new."""
    out: list[str] = []
    for n, name in enumerate(names, 1):
        base = name.strip() or f"column_{n}"
        new, k = base, 2
        while new in out:
            new, k = f"{base}_{k}", k + 1
        out.append(new)
    return out


def named(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_text(f: T.StructField) -> Column:
    """A column as stripped text: null is empty, booleans true or false, nested values JSON with sorted keys of maps and structs."""
    c = named(f.name)
    if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
        c = F.to_json(_sorted(c, f.dataType))
    return stripped(c)


def _sorted(c: Column, kind: T.DataType) -> Column:
    """A nested value with the fields of its structs and the entries of its maps in the order of their keys."""
    if isinstance(kind, T.StructType):
        out = F.struct(*[_sorted(c[f.name], f.dataType).alias(f.name) for f in sorted(kind, key=lambda f: f.name)])
        return F.when(c.isNotNull(), out)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _sorted(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.transform(F.array_sort(F.map_keys(c)), lambda k: F.struct(k, _sorted(F.element_at(c, k), kind.valueType))))
    return c


def to_text_records(df: DataFrame) -> DataFrame:
    """Every column as stripped text: null is empty, booleans true or false, nested values JSON with sorted keys."""
    return df.select([as_text(f).alias(f.name) for f in df.schema])


def drop_blank_records(df: DataFrame) -> DataFrame:
    """Rows with at least one non-blank field."""
    return df.where(F.exists(F.array(*[stripped(named(c)) for c in df.columns]), lambda x: x != ""))
