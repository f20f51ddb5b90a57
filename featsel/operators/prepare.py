"""Profiles, kinds and encodings of the columns of a table, and the whole preparation."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featsel.functions.text import as_text, digit_count, keywords, named, stripped_days, stripped_missing, stripped_number, tokens, word_count
from featsel.operators import stats
from featsel.sinks.shared import dropped, new_folder, written

#: Share of a column's present values that must be numbers (or dates) for it to be a number (date) column.
MOSTLY = 0.85
#: A column is constant if its range is at most this.
TINY = 1e-15
#: What stands for a missing value among categories and texts.
NONE = "<missing>"
#: Rows with a target that a preparation needs.
LEAST_ROWS = 30
#: Columns that are profiled in one job, so that its plan stays small.
COLUMNS_A_JOB = 50


class View(NamedTuple):
    """A column as the rules see it: whether it is missing, as number, as days, and as text."""

    name: str
    missing: Column
    number: Column
    days: Column
    text: Column
    kind: str | None = None  # known from the type: numeric or date

    @property
    def value(self) -> Column:
        """The text, or <missing>."""
        return F.when(self.missing, NONE).otherwise(self.text)


def view(f: T.StructField, is_text: bool = False) -> View:
    """Typed columns are taken for what they are: numbers (NaN and infinite ones are missing), dates and times (those
    without zone are UTC). Anything else is read as text. is_text: the column is stripped text already (`as_text`)."""
    c, none = named(f.name), F.lit(None).cast("double")
    text = F.coalesce(c.cast("string"), F.lit(""))  # no white space at the ends of numbers, dates and stripped texts
    if isinstance(f.dataType, T.NumericType):
        x = c.cast("double")
        x = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
        return View(f.name, x.isNull(), x, none, text, "numeric")
    if isinstance(f.dataType, (T.DateType, T.TimestampNTZType)):
        epoch = F.lit("1970-01-01").cast("timestamp_ntz")
        days = F.timestamp_diff("MICROSECOND", epoch, c.cast("timestamp_ntz")) / F.lit(86_400_000_000.0)
        return View(f.name, c.isNull(), none, days, text, "date")
    if isinstance(f.dataType, T.TimestampType):
        return View(f.name, c.isNull(), none, F.unix_micros(c) / F.lit(86_400_000_000.0), text, "date")
    text = text if is_text else as_text(f)
    return View(f.name, stripped_missing(text), stripped_number(text), stripped_days(text), text)


def staged(df: DataFrame, columns: list[str], keep: tuple[Column, ...] = ()) -> tuple[DataFrame, dict[str, View]]:
    """The columns as their views see them, computed once each and in steps, so that no rule is repeated inside another and
    the generated code stays small; and the views on the result. What nobody reads of it, Spark leaves out."""
    raw = [(f"r{k}", df.schema[c]) for k, c in enumerate(columns)]
    typed = (T.NumericType, T.DateType, T.TimestampNTZType, T.TimestampType)
    out = df.select(*keep, *[(named(f.name) if isinstance(f.dataType, typed) else as_text(f)).alias(r) for r, f in raw])
    seen = {r: view(out.schema[r], is_text=True) for r, _ in raw}
    names = out.columns
    out = out.select(*map(named, names), *[x.alias(n + r[1:]) for r, v in seen.items() for n, x in (("m", v.missing), ("n", v.number), ("d", v.days))])
    texts = [F.when(F.col("m" + r[1:]), NONE).otherwise(seen[r].text).alias("v" + r[1:]) for r, _ in raw]
    out = out.select(*map(named, out.columns), *texts)
    views = {f.name: View(f.name, *[F.col(n + r[1:]) for n in "mnd"], seen[r].text, seen[r].kind) for r, f in raw}
    return out, views


def _value(views: dict[str, View], c: str) -> Column:
    """The text of a staged column, or <missing>."""
    return F.col(f"v{list(views).index(c)}")


def _profile(df: DataFrame, all_texts: bool = True) -> list:
    """One record a column: name, n_rows, present, numeric, dates, avg_words, avg_length, lowest and highest number and day. The
    averages of columns whose type tells their kind are left out (null) if not `all_texts`."""
    out = []
    for at in range(0, len(df.columns), COLUMNS_A_JOB):
        part, aggs = df.columns[at : at + COLUMNS_A_JOB], []
        rows, views = staged(df, part)
        for k, (c, v) in enumerate(views.items()):
            value = _value(views, c)
            aggs += [
                F.count_if(~v.missing).alias(f"{k}_present"),
                F.count_if(~v.missing & v.number.isNotNull()).alias(f"{k}_numeric"),
                F.count_if(~v.missing & v.days.isNotNull()).alias(f"{k}_dates"),
                *[(F.avg(x) if all_texts or not v.kind else F.lit(None).cast("double")).alias(f"{k}_avg_{n}") for n, x in (("words", word_count(value)), ("length", F.length(value)))],
                *[g(x).alias(f"{k}_{n}") for n, x in (("number", v.number), ("day", v.days)) for g, n in ((F.min, f"low_{n}"), (F.max, f"high_{n}"))],
            ]
        wide = rows.agg(F.count("*").alias("n_rows"), *aggs)
        measures = ("present", "numeric", "dates", "avg_words", "avg_length", "low_number", "high_number", "low_day", "high_day")
        records = [F.struct(F.lit(c).alias("name"), F.col("n_rows"), *[F.col(f"{k}_{m}").alias(m) for m in measures]) for k, c in enumerate(part)]
        out.append(wide.select(F.inline(F.array(*records))))
    return out


def profile_columns(df: DataFrame) -> DataFrame:
    """name, n_rows, present, numeric, dates, avg_words, avg_length of every column, in one pass over each 50 columns.
    Words and length are averages over all rows, a missing value counting as <missing> (one word of nine characters)."""
    out = _profile(df)
    all_ = out[0]
    for part in out[1:]:
        all_ = all_.unionByName(part)
    return all_.select("name", "n_rows", "present", "numeric", "dates", "avg_words", "avg_length")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, value, n of every column's values (missing: <missing>)."""
    rows, views = staged(df, columns)
    each = [F.struct(F.lit(c).alias("name"), _value(views, c).alias("value")) for c in columns]
    return rows.select(F.inline(F.array(*each))).groupBy("name", "value").agg(F.count("*").alias("n"))


def _most_frequent(counts: DataFrame, k: int | None) -> DataFrame:
    out = counts.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "value")))
    return out.where(F.col("rank") <= k) if k else out


def value_frequencies(df: DataFrame, columns: list[str], k: int | None = 7) -> DataFrame:
    """name, value, n, rank by (-n, value) of every column's values (missing: <missing>), up to rank k."""
    return _most_frequent(value_counts(df, columns), k)


def _category_limit(n: Column) -> Column:
    return F.least(F.lit(20), F.greatest(F.lit(8), F.bround(F.sqrt(n), 0)))


def infer_kinds(profile: DataFrame, distinct: DataFrame) -> DataFrame:
    """name, kind: empty, numeric, date, category, identifier or text. `distinct` is (name, n_distinct)."""
    p = profile.join(distinct, "name", "left")
    long = (F.col("avg_words") >= 4) | (F.col("avg_length") >= 48)
    kind = (
        F.when(F.col("present") == 0, "empty")
        .when(F.col("numeric") >= MOSTLY * F.col("present"), "numeric")
        .when(F.col("dates") >= MOSTLY * F.col("present"), "date")
        .when((F.col("n_distinct") <= _category_limit(F.col("n_rows"))) & ~long, "category")
        .when((F.col("avg_words") < 1.4) & (F.col("avg_length") < 24) & (F.col("n_distinct") / F.col("n_rows") > 0.7), "identifier")
        .otherwise("text")
    )
    return p.select("name", kind.alias("kind"))


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, n_distinct, from one grouping of (column, value)."""
    return value_counts(df, columns).groupBy("name").agg(F.count("*").alias("n_distinct"))


#: Relative rank error of the approximate quantiles that narrow a range is one over this.
ACCURACY = 10_000


@dataclass
class _Range:
    """Where the middle two of a column's values lie: values from low to high, how many they are and how many are less."""

    low: float
    high: float
    inside: int
    below: int
    first: int
    last: int
    narrow: bool = True


def _of_each(df: DataFrame, columns: list[str], each) -> dict[str, list]:
    """column -> values of the aggregates each(column), in one job for every 50 columns."""
    out = {}
    for at in range(0, len(columns), COLUMNS_A_JOB):
        part = columns[at : at + COLUMNS_A_JOB]
        wide = df.agg(*[F.struct(*each(c)).alias(f"a{k}") for k, c in enumerate(part)]).first()
        out |= {c: list(wide[k]) for k, c in enumerate(part)}
    return out


def exact_medians(df: DataFrame, values: dict[str, Column], together: int = 100_000) -> dict[str, float | None]:
    """Median (mean of the middle two) of the values that aren't null of each of several columns, null without any.

    All columns are narrowed at once: a job finds approximate quantiles just beside every column's middle, another counts what is less
    and what is between, until at most `together` values are between (each round leaves a few thousandths); those of all columns
    are then counted by value and ranked in one job. So the number of passes doesn't grow with the columns, and no task holds
    all values of one. The passes read the values as plain numbers from a table that is written first and deleted at the end: what
    they are made of (texts that are parsed, say) is computed once."""
    if not values:
        return {}
    names, spark, at = list(values), df.sparkSession, new_folder(df.sparkSession)
    made = df.select(*[values[c].cast("double").alias(f"x{k}") for k, c in enumerate(names)])
    made.write.parquet(at)
    try:
        return _medians(spark.read.schema(made.schema).parquet(at), names, together)
    finally:
        dropped(spark, at)


def _medians(x: DataFrame, names: list[str], together: int) -> dict[str, float | None]:
    """`exact_medians` of the columns x0, x1, ... of the given names."""
    column = {c: F.col(f"x{k}") for k, c in enumerate(names)}
    ends = _of_each(x, names, lambda c: (F.min(column[c]), F.max(column[c]), F.count(column[c])))
    ranges = {c: _Range(low, high, n, 0, (n - 1) // 2, n // 2) for c, (low, high, n) in ends.items() if n}
    inside = lambda c: column[c].between(ranges[c].low, ranges[c].high)
    while wide := [c for c, r in ranges.items() if r.narrow and r.low < r.high and r.inside > together]:
        near = lambda c: [F.lit(min(1.0, max(0.0, p))) for p in ((ranges[c].first - ranges[c].below) / ranges[c].inside - 2 / ACCURACY, (ranges[c].last - ranges[c].below + 1) / ranges[c].inside + 2 / ACCURACY)]
        cuts = _of_each(x, wide, lambda c: (F.percentile_approx(F.when(inside(c), column[c]), F.array(*near(c)), F.lit(ACCURACY)),))
        sizes = _of_each(x, wide, lambda c: (F.count_if(column[c] < cuts[c][0][0]), F.count_if(column[c].between(cuts[c][0][0], cuts[c][0][1]))))
        for c in wide:
            r, (below, n) = ranges[c], sizes[c]
            if below <= r.first and r.last < below + n < r.below + r.inside or below > r.below and below <= r.first and r.last < below + n:
                r.low, r.high, r.below, r.inside = *cuts[c][0], below, n
            else:
                r.narrow = False  # a few values are most of what is left: counting by value makes them few rows
    out: dict[str, float | None] = {c: (ranges[c].low if c in ranges else None) for c in names}
    some = [c for c, r in ranges.items() if r.low < r.high]
    if some:
        number = {c: k for k, c in enumerate(names)}
        each = F.array(*[F.struct(F.lit(number[c]).alias("c"), F.when(inside(c), column[c]).alias("x")) for c in some])
        counts = x.select(F.inline(each)).where("x is not null").groupBy("c", "x").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("c").orderBy("x"))
        place = lambda of: F.element_at(F.create_map(*[F.lit(v) for c in some for v in (number[c], of(ranges[c]))]), F.col("c"))
        a, b = place(lambda r: r.first - r.below), place(lambda r: r.last - r.below)
        hit = lambda at: (F.col("upto") > at) & (F.col("upto") - F.col("n") <= at)
        middle = counts.withColumn("upto", upto).select("c", "x", hit(a).alias("a"), hit(b).alias("b")).where("a or b")
        found = middle.groupBy("c").agg(F.max(F.when(F.col("a"), F.col("x"))), F.max(F.when(F.col("b"), F.col("x"))))
        out |= {names[k]: a + (b - a) / 2 if abs(a) > 1e300 else (a + b) / 2 for k, a, b in found.collect()}
    return {c: None if v is None else float(v) for c, v in out.items()}


def exact_median(df: DataFrame, value: Column, together: int = 100_000) -> float | None:
    """`exact_medians` of one column."""
    return exact_medians(df, {"": value}, together)[""]


def fill_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls of numeric columns replaced by the exact median (of columns that have any)."""
    gaps = df.agg(*[F.count_if(named(c).isNull()).alias(str(k)) for k, c in enumerate(columns)]).first()
    need = [c for k, c in enumerate(columns) if gaps[k]]
    median = exact_medians(df, {c: named(c) for c in need})
    return df.withColumns({c: F.coalesce(named(c), F.lit(median[c])) for c in need}) if need else df


def indicators(column: str, seen: list[str], top: int = 7) -> tuple[list[str], bool]:
    """Values (in order of frequency) that get an indicator, and whether the others share one: two values give only the rarer."""
    return (seen[1:], False) if len(seen) == 2 else (seen[:top], len(seen) > top)


def expand_categories(df: DataFrame, column: str, top: int = 7) -> DataFrame:
    """Adds an indicator for each frequent value (`column = value`): two values give only the rarer one, more
    than `top` give the top and `column = other`."""
    seen = [r["value"] for r in value_frequencies(df, [column], top + 1).orderBy("rank").collect()]
    value = view(df.schema[column]).value
    kept, other = indicators(column, seen, top)
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    new = {f"{column} = {v}": one(value == v) for v in kept}
    if other:
        new[f"{column} = other"] = one(~value.isin(kept))
    return df.withColumns(new)


def document_frequency(df: DataFrame, column: str) -> DataFrame:
    """token, df: rows that have each token; map-side combining absorbs frequent tokens."""
    each = F.explode(F.array_distinct(tokens(named(column)))).alias("token")
    return df.select(each).groupBy("token").agg(F.count("*").alias("df"))


def keywords_of_each(df: DataFrame, words: dict[str, Column], n: int, limit: int = 6) -> DataFrame:
    """name, token, df, rank: of every text column (name -> words) the `limit` keywords whose share of the n rows is nearest to a half
    (ties: more rows, then the word), of those in max(3, 2 %) to 90 % of the rows. One grouping for all columns, over all rows."""
    named_ = lambda c, w: F.transform(keywords(w), lambda t: F.struct(F.lit(c).alias("name"), t.alias("token")))
    each = [named_(c, w) for c, w in words.items()]
    counts = df.select(F.inline(F.concat(*each))).groupBy("name", "token").agg(F.count("*").alias("df"))
    fit = counts.where(F.col("df").between(max(3, round(n * 0.02)), round(n * 0.9)))
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.abs(F.col("df") / F.lit(n) - 0.5), F.desc("df"), "token"))
    return fit.withColumn("rank", rank).where(F.col("rank") <= limit)


def frequent_keywords(df: DataFrame, words: Column, n: int, limit: int = 6) -> DataFrame:
    """token, df of the most telling keywords of one text column (see `keywords_of_each`)."""
    return keywords_of_each(df, {"": words}, n, limit).select("token", "df")


def keyword_indicators(df: DataFrame, column: str, limit: int = 6) -> DataFrame:
    """Adds `column · contains "word"` (1.0 or 0.0) for each of the `limit` most telling words of a text column (see
    `frequent_keywords`); a missing text is <missing>."""
    words = tokens(view(df.schema[column]).value)
    chosen = [r["token"] for r in keywords_of_each(df, {"": words}, df.count(), limit).orderBy("rank").collect()]
    return df.withColumns({f'{column} · contains "{t}"': F.when(F.array_contains(words, t), 1.0).otherwise(0.0) for t in chosen})


def drop_constant(df: DataFrame, columns: list[str]) -> DataFrame:
    """Without the columns whose range is at most 1e-15."""
    r = df.agg(*[(F.max(named(c)) - F.min(named(c))).alias(str(k)) for k, c in enumerate(columns)]).first()
    return df.drop(*[c for k, c in enumerate(columns) if r[k] is None or r[k] <= TINY])


def preview(df: DataFrame, id_col: str, n: int = 4) -> DataFrame:
    """The first `n` records by id, all values as text."""
    rows = df.orderBy(named(id_col)).limit(n)
    return rows.select([as_text(f).alias(f.name) for f in df.schema])


def drop_missing_target(df: DataFrame, target: str) -> tuple[DataFrame, int, int]:
    """The rows with a target, how many were removed, and how many are left."""
    v = view(df.schema[target])
    gone, n = df.agg(F.count_if(v.missing), F.count_if(~v.missing)).first()
    return df.where(~v.missing), gone, n


@dataclass
class Target:
    """What the target column holds: rows with and without, outcomes (smallest and largest text), the chosen task."""

    task: str
    rows: int
    removed: int
    outcomes: tuple[str, str]


def read_target(df: DataFrame, target: str, task: str = "auto", least_rows: int = LEAST_ROWS) -> Target:
    """Checks the target by two passes over its column. auto: two different outcomes (as texts) mean classification, anything
    else regression. An error: an unknown task, fewer than `least_rows` rows with a target, a classification of other than two
    outcomes, a regression with a value that is no number or with one value only."""
    if task not in ("auto", "classification", "regression"):
        raise ValueError("task must be auto, classification or regression")
    rows, views = staged(df, [target])
    v = views[target]
    there, number = ~v.missing, F.when(~v.missing, v.number)
    removed, n, low, high, numbers, least, most = rows.agg(
        F.count_if(v.missing), F.count_if(there), F.min(F.when(there, v.text)), F.max(F.when(there, v.text)), F.count(number), F.min(number), F.max(number)
    ).first()
    if n < least_rows:
        raise ValueError(f"at least {least_rows} rows with a target are needed, not {n}")
    two = low != high and rows.where(there & ~v.text.isin(low, high)).limit(1).count() == 0
    task = ("classification" if two else "regression") if task == "auto" else task
    if task == "classification" and not two:
        raise ValueError("a classification needs a target of exactly two outcomes")
    if task == "regression" and numbers < n:
        raise ValueError("a target of other than two outcomes must be a number in every row")
    if task == "regression" and most - least <= TINY:
        raise ValueError("the target needs more than one value")
    return Target(task, n, removed, (low, high))


def infer_task(df: DataFrame, target: str, task: str = "auto") -> str:
    """classification for two distinct outcomes, else regression; a given task is checked (see `read_target`)."""
    return read_target(df, target, task, least_rows=1).task


def encode_target(df: DataFrame, target: str, task: str) -> DataFrame:
    """Adds `label`: the two outcomes in order as 0.0 and 1.0, or the number; rows without target go."""
    v = view(df.schema[target])
    rows = df.where(~v.missing)
    if task == "regression":
        return rows.withColumn("label", v.number)
    low = rows.agg(F.min(v.text)).first()[0]
    return rows.withColumn("label", F.when(v.text == low, 0.0).otherwise(1.0))


def prefilter(rel: DataFrame, m: int = 40) -> DataFrame:
    """The m inputs of largest |correlation| (ties by name), in column order."""
    return rel.orderBy(F.desc("r_raw"), "name").limit(m).orderBy("idx")


def significant(c: Column, digits: int = 10) -> Column:
    """A number as text with up to `digits` significant digits, as C's %.10g writes it: plain from 1e-4 to below 1e10, else with
    an exponent; no trailing zeros; null stays null."""
    x = c.cast("double")
    # a number that its shortest text tells apart with no more digits; the rest is formatted
    shortest = x.cast("string")
    few = ((x == 0) | F.abs(x).between(1e-3, 1e7 - 1)) & (F.length(shortest) <= digits + 1)
    size = F.abs(F.format_string(f"%.{digits - 1}e", x).try_cast("double"))  # as rounded
    plain = F.format_string(f"%.{digits}g", x)  # keeps trailing zeros
    power = F.regexp_replace(F.format_string(f"%.{digits - 1}e", x), r"\.?0*e", "e")
    short = F.when(plain.contains("."), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
    return F.when(few, F.rtrim(F.rtrim(shortest, F.lit("0")), F.lit("."))).when((size == 0) | size.between(1e-4, 10.0**digits * (1 - 1e-15)), short).when(x.isNotNull(), power)


@dataclass
class Prepared:
    """A table ready for statistics. data: `id`, `label` and one double column for each input, f_0, f_1, ...; features: for
    each of these its name, source column and kind; notes: (column, what was done)."""

    data: DataFrame
    features: list[tuple[str, str, str]]
    task: str
    target: str
    rows: int
    notes: list[tuple[str, str]] = field(default_factory=list)

    @property
    def columns(self) -> list[str]:
        return [f"f_{i}" for i in range(len(self.features))]

    def feature_table(self) -> DataFrame:
        """idx, name, source, kind."""
        return self.data.sparkSession.createDataFrame([(i, *f) for i, f in enumerate(self.features)], "idx int, name string, source string, kind string")

    def note_table(self) -> DataFrame:
        """position, column, note."""
        return self.data.sparkSession.createDataFrame([(i, *n) for i, n in enumerate(self.notes)], "position int, column string, note string")


def row_id(df: DataFrame) -> Column:
    """An id made of the row itself, for tables without one: equal rows have equal ids, which does no harm where only
    their order in hashes counts."""
    return F.md5(F.to_json(F.struct(*[named(c) for c in df.columns]), {"ignoreNullFields": "false"}))


def _measures(value: Column, words: Column, share) -> list[tuple[str, Column]]:
    return [
        ("text length", F.length(value).cast("double")), ("word count", word_count(value).cast("double")),
        ("vocabulary variety", share(F.size(F.array_distinct(words)), F.size(words))),
        ("digit share", share(digit_count(value), F.length(value))),
    ]


def _inputs(raw: DataFrame, rows: DataFrame, views: dict[str, View], n: int) -> tuple[DataFrame, list[tuple[str, str, str, Column]], list[tuple[str, str]]]:
    """Candidate inputs (name, source, kind, value) of the columns in order, constants left out, and notes. `rows` are the staged
    rows of `raw`; they are returned with what the values need more."""
    columns = list(views)
    profile = {r["name"]: r for part in _profile(raw.select(*map(named, columns)), all_texts=False) for r in part.collect()}
    kind = {}
    for c in columns:
        p = profile[c]
        known = [k for k, m in (("numeric", p["numeric"]), ("date", p["dates"])) if p["present"] and m / p["present"] >= MOSTLY]
        kind[c] = "empty" if not p["present"] else known[0] if known else "text" if p["avg_words"] >= 4 or p["avg_length"] >= 48 else ""
    # only columns of short values are left: those are counted by value
    open_, seen = [c for c in columns if not kind[c]], {}
    if open_:
        top = {c: [] for c in open_}
        counts = written(value_counts(raw, open_))
        for r in _most_frequent(counts, 8).orderBy("name", "rank").collect():
            top[r["name"]].append(r["value"])
        distinct = dict(map(tuple, counts.groupBy("name").agg(F.count("*").alias("n_distinct")).collect()))
        limit = min(20, max(8, round(n**0.5)))
        for c in open_:
            p = profile[c]
            identifier = p["avg_words"] < 1.4 and p["avg_length"] < 24 and distinct[c] / n > 0.7
            kind[c], seen[c] = "category" if distinct[c] <= limit else "identifier" if identifier else "text", (top[c], distinct[c])

    out, notes = [], []
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    # all medians, all measures of texts and all keywords are found together, whatever the number of columns
    number = {c: (v.number, "number", "numeric") if kind[c] == "numeric" else (v.days, "day", "dates") for c, v in views.items() if kind[c] in ("numeric", "date")}
    varied = [c for c, (_, what, _) in number.items() if profile[c][f"high_{what}"] - profile[c][f"low_{what}"] > TINY]
    gaps = {c: F.when(~views[c].missing, number[c][0]) for c in varied if profile[c][number[c][2]] < n}
    median = exact_medians(rows, gaps) if gaps else {}
    texts = {c: f"t{k}" for k, c in enumerate(views) if kind[c] == "text"}
    if texts:
        rows = rows.withColumns({t: tokens(_value(views, c)) for c, t in texts.items()})
        measures = {c: _measures(_value(views, c), F.col(t), share) for c, t in texts.items()}
        wide = _of_each(rows, list(texts), lambda c: [F.max(x) - F.min(x) for _, x in measures[c]])
        found = {c: [] for c in texts}
        for r in keywords_of_each(rows, {c: F.col(t) for c, t in texts.items()}, n).orderBy("name", "rank").collect():
            found[r["name"]].append(r["token"])
    for c, v in views.items():
        value = _value(views, c)
        if kind[c] in ("numeric", "date"):
            if c in varied:
                filled = F.coalesce(gaps[c], F.lit(median[c])) if c in gaps else number[c][0]
                out.append((c if kind[c] == "numeric" else f"{c} · date", c, kind[c], filled))
            if kind[c] == "date":
                notes.append((c, "dates became a time value"))
            elif profile[c]["numeric"] < n:
                notes.append((c, "missing or invalid numbers were filled with the median"))
        elif kind[c] == "category":
            values, count = seen[c]
            kept, other = indicators(c, values)
            if count > 1:
                out += [(f"{c} = {x}", c, "category", one(value == x)) for x in kept]
                out += [(f"{c} = other", c, "category", one(~value.isin(kept)))] if other else []
            notes.append((c, f"{min(count, len(kept) + 1)} category indicators"))
        elif kind[c] == "text":
            out += [(f"{c} · {name}", c, "text", x) for (name, x), w in zip(measures[c], wide[c]) if w > TINY]
            out += [(f'{c} · contains "{t}"', c, "text", one(F.array_contains(texts[c], t))) for t in found[c]]
            notes.append((c, "free text became structural measures and indicators of common words"))
        else:
            notes.append((c, "empty column skipped" if kind[c] == "empty" else "likely identifier skipped"))
    return rows, out, notes


def prepare(df: DataFrame, target: str, task: str = "auto", id_col: str | None = None, max_features: int | None = None, least_rows: int = LEAST_ROWS) -> Prepared:
    """The whole preparation: rows without target go; every other column becomes 0 or more inputs by its kind (see
    `infer_kinds`): numbers and dates with gaps filled by the median, category indicators, measures and keywords of texts.
    Constant inputs are dropped; of more than `max_features` the strongest by |correlation| stay. Everything is learnt from all rows.

    `id_col` names the rows (else an id is made of their content) and is no input. Errors: those of `read_target`, a target that
    isn't there, fewer than two input columns or usable inputs."""
    if target not in df.columns:
        raise ValueError(f"there is no target column {target!r}")
    columns = [c for c in df.columns if c not in (target, id_col)]
    if len(columns) < 2:
        raise ValueError("at least two input columns are needed")
    goal = read_target(df, target, task, least_rows)
    rows = df.where(~view(df.schema[target]).missing)
    notes = [(target, f"{goal.removed} rows without target were removed")] if goal.removed else []
    v = view(df.schema[target])
    if goal.task == "classification":
        notes.append((target, f"outcomes are {goal.outcomes[0]} (0) and {goal.outcomes[1]} (1)"))
    label = v.number if goal.task == "regression" else F.when(v.text == goal.outcomes[0], 0.0).otherwise(1.0)
    key = named(id_col) if id_col else row_id(df)
    steps, views = staged(rows, columns, (key.alias("id"), label.alias("label")))
    steps, found, more = _inputs(rows, steps, views, goal.rows)
    notes += more
    if len(found) < 2:
        raise ValueError("at least two usable inputs are needed after empty, constant and identifier columns are left out")
    made = lambda chosen: steps.select("id", "label", *[x.alias(f"f_{i}") for i, (*_, x) in enumerate(chosen)])
    if max_features and len(found) > max_features:
        m = stats.moments(made(found), [f"f_{i}" for i in range(len(found))], "label")
        r = abs(stats.correlations(m)[:-1, -1])
        keep = sorted(sorted(range(len(found)), key=lambda i: (-r[i], found[i][0]))[:max_features])
        found = [found[i] for i in keep]
        notes.append(("", f"the {max_features} inputs of strongest link to the target were kept"))
    return Prepared(made(found), [f[:3] for f in found], goal.task, target, goal.rows, notes)


@dataclass
class Inspection:
    """A look at a table before a job: small DataFrames.

    summary: rows, columns, source_columns, target, task (unknown after an error), prepared (number of inputs), error."""

    summary: DataFrame
    preview: DataFrame
    features: DataFrame
    notes: DataFrame


def inspect(df: DataFrame, target: str | None = None, id_col: str | None = None) -> Inspection:
    """Rows, columns, the first four records, and what `prepare` would make of the table; the default target is the last
    column. What is wrong with the target is reported in `error` and not raised."""
    spark = df.sparkSession
    names = [c for c in df.columns if c != id_col]
    target = target if target in names else names[-1]
    error, ready = None, None
    try:
        ready = prepare(df, target, id_col=id_col)
    except ValueError as e:
        error = str(e)
    row = (df.count(), len(names), len(names) - 1, target, ready.task if ready else "unknown", len(ready.features) if ready else len(names) - 1, error)
    summary = spark.createDataFrame([row], "rows long, columns int, source_columns int, target string, task string, prepared int, error string")
    none = spark.createDataFrame([], "idx int, name string, source string, kind string")
    notes = ready.note_table() if ready else spark.createDataFrame([], "position int, column string, note string")
    first = preview(df, id_col) if id_col else preview(df.withColumn("_id", row_id(df)), "_id").drop("_id")
    return Inspection(summary, first, ready.feature_table() if ready else none, notes)
