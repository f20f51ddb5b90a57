"""The registered queries of the feature-selection operators, with the SQL that checks them."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featsel.functions import text
from featsel.jobs import replay, selection
from featsel.operators import evaluate, objective, positions, prepare, report, search, stats
from featsel.sinks import shared
from featsel.sinks import tables as sinks
from featsel.sources import synthetic, tables, workbooks

COLUMNS = ["quantity", "extendedprice", "discount", "tax", "linenumber", "status_o", "ship_days"]
K = 3

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return add


# a word in DuckDB's regular expressions, and the rules for texts
_WORD = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}](?:[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}''-]*[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}])?"
_MISSING = "(lower(trim({0})) in ('', 'na', 'n/a', 'null', 'none', 'nan', '?') or {0} is null)"
_NUMBER = r"regexp_full_match(replace(trim({0}), ',', ''), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')"


def line_returns(read) -> DataFrame:
    """Lineitem as inputs for: was the line returned?"""
    return read("lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("row_id"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("extendedprice"), F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"), F.col("l_linenumber").cast("double").alias("linenumber"),
        F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0).alias("status_o"),
        (F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("l_shipdate")) / 86_400_000_000.0).alias("ship_days"),
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("label"),
    )


_LINES = """lines as (
  select l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_extendedprice as row_id, l_quantity as quantity, l_extendedprice as extendedprice, l_discount as discount,
         l_tax as tax, l_linenumber::double as linenumber, (l_linestatus = 'O')::int::double as status_o,
         epoch_us(l_shipdate) / 86400000000.0 as ship_days, (l_returnflag = 'R')::int::double as label
  from lineitem
)"""
_ONE = lambda a, b: f"coalesce(case when isnan(corr({a}, {b})) then 0 else abs(corr({a}, {b})) end, 0)"
_REL = ", rel as (" + " union all ".join(f"select {i} as idx, '{c}' as name, {_ONE(c, 'label')} as r_raw from lines" for i, c in enumerate(COLUMNS)) + ")"
_REL += ", rels as (select idx, name, r_raw, r_raw / max(r_raw) over () as r from rel)"
_RED = ", red as (" + " union all ".join(
    f"select {i} as i, {j} as j, {_ONE(a, b)} as value from lines" for i, a in enumerate(COLUMNS) for j, b in enumerate(COLUMNS) if i < j
) + ")"
_TERMS = f""", terms as (
  select idx as i, idx as j, -r + 2.5 * (1 - 2 * {K}) as coeff from rels
  union all select i, j, 0.65 / {K - 1} * greatest(0, value) + 5.0 from red
)"""
_STATES = f", states as (select s as state from range({2 ** len(COLUMNS)}) t(s) where bit_count(s::int) = {K})"
_ENERGY = """, energy as (
  select state, sum(coeff) + 22.5 as energy from states join terms on (state >> i) & 1 = 1 and (state >> j) & 1 = 1 group by state
)"""
_SQL = "with " + _LINES + _REL + _RED + _TERMS + _STATES + _ENERGY


def _statistics(read) -> tuple[DataFrame, DataFrame]:
    df = line_returns(read)
    m = stats.moments(df, COLUMNS, "label")
    return stats.relevance(df.sparkSession, m), stats.redundancy(df.sparkSession, m)


@_query("m3_relevance", _SQL + " select idx, name, round(r_raw, 6) as r_raw, round(r, 6) as r from rels")
def _(read):
    return _statistics(read)[0].select("idx", "name", F.round("r_raw", 6).alias("r_raw"), F.round("r", 6).alias("r"))


@_query("m4_redundancy", _SQL + " select i, j, round(value, 6) as value from red")
def _(read):
    return _statistics(read)[1].select("i", "j", F.round("value", 6).alias("value"))


@_query("q1_terms", _SQL + " select i, j, round(coeff, 6) as coeff from terms")
def _(read):
    return objective.build_terms(*_statistics(read), K).select("i", "j", F.round("coeff", 6).alias("coeff"))


@_query("q2_energies", _SQL + " select state, round(energy, 6) as energy from energy")
def _(read):
    terms = objective.build_terms(*_statistics(read), K)
    states = objective.all_states(terms.sparkSession, len(COLUMNS), K)
    return objective.energies(states, terms, objective.offset(K), len(COLUMNS)).select("state", F.round("energy", 6).alias("energy"))


@_query("q3_direct_objective", _SQL + " select state, round(energy, 6) as energy from energy")
def _(read):
    rel, red = _statistics(read)
    states = objective.all_states(rel.sparkSession, len(COLUMNS), K)
    return objective.direct_objective(states, rel, red, K, len(COLUMNS)).select("state", F.round("energy", 6).alias("energy"))


@_query("q4_exhaustive", _SQL + " select state, round(energy, 6) as energy from energy order by round(energy, 9), state limit 1")
def _(read):
    terms = objective.build_terms(*_statistics(read), K)
    states = objective.all_states(terms.sparkSession, len(COLUMNS), K)
    best = objective.best_state(objective.energies(states, terms, objective.offset(K), len(COLUMNS)))
    return best.select("state", F.round("energy", 6).alias("energy"))


@_query("q5_search", _SQL + " select state, round(energy, 6) as energy from energy order by round(energy, 9), state limit 1")
def _(read):
    terms = objective.build_terms(*_statistics(read), K)
    best = search.best_read(search.search(terms.sparkSession, terms, K, *search.QUALITY["fast"], constant=objective.offset(K)))
    mask = F.aggregate("selected", F.lit(0).cast("long"), lambda a, i: a + F.pow(F.lit(2.0), i).cast("long"))
    return best.select(mask.alias("state"), F.round("energy", 6).alias("energy"))


@_query("q7_top_relevance", _SQL + f" select idx, name, round(r, 6) as r from rels order by rels.r desc, idx limit {K}")
def _(read):
    return objective.select_top_relevance(_statistics(read)[0], K).select("idx", "name", F.round("r", 6).alias("r"))


@_query("k2_exported_terms", _SQL + " select a.name as name_i, b.name as name_j, round(coeff, 6) as coeff from terms join rels a on a.idx = i join rels b on b.idx = j where abs(coeff) > 1e-12")
def _(read):
    rel, red = _statistics(read)
    return objective.exported_terms(objective.build_terms(rel, red, K), rel).withColumn("coeff", F.round("coeff", 6))


@_query("k3_dense_matrix", _SQL + ", both_ as (select i, j, coeff from terms union all select j, i, coeff from terms where i < j) select i, " + ", ".join(f"round(max(coeff) filter (j = {j}), 5) as c{j}" for j in range(len(COLUMNS))) + " from both_ group by i")
def _(read):
    return objective.dense_matrix(objective.build_terms(*_statistics(read), K))


@_query("m5_average_redundancy", _SQL + " select state as set_id, round(avg(value), 6) as value from states join red on (state >> i) & 1 = 1 and (state >> j) & 1 = 1 group by state")
def _(read):
    _, red = _statistics(read)
    sets = objective.members(objective.all_states(red.sparkSession, len(COLUMNS), K), len(COLUMNS)).withColumnRenamed("state", "set_id")
    return stats.average_redundancy(sets, red).select("set_id", F.round("value", 6).alias("value"))


@_query("m6_feature_overlap", _SQL + f", top as (select idx from rels order by r desc, idx limit {K}), both_ as (select i, j, value from red union all select j, i, value from red) select i as idx, round(avg(value), 6) as overlap from both_ where j in (select idx from top) group by i")
def _(read):
    rel, red = _statistics(read)
    chosen = [r["idx"] for r in objective.select_top_relevance(rel, K).collect()]
    return stats.feature_overlap(rel, chosen, red).select("idx", F.round("overlap", 6).alias("overlap"))


@_query("p3_as_days", "select l_orderkey, l_linenumber, round(epoch_us(l_shipdate) / 86400000000.0, 6) as iso, datediff('day', date '1970-01-01', l_shipdate::date)::double as american from lineitem")
def _(read):
    df = read("lineitem")
    iso, american = F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss"), F.date_format("l_shipdate", "M/d/yyyy")
    return df.select("l_orderkey", "l_linenumber", F.round(text.as_days(iso), 6).alias("iso"), text.as_days(american).alias("american"))


@_query("p2_as_number", f"""with t as (
  select l_orderkey, l_linenumber, format('{{:,}}', floor(l_extendedprice)::bigint) as price, (l_linenumber * 10 + 2.5)::varchar || ' %' as percent,
         case l_linenumber % 4 when 0 then '1e3' when 1 then 'inf' when 2 then ' -2.5 ' else '7d' end as odd from lineitem
)
select l_orderkey, l_linenumber, replace(price, ',', '')::double as price, round(rtrim(percent, ' %')::double / 100, 6) as percent,
       case when {_NUMBER.replace('{0}', 'odd')} then trim(odd)::double end as odd from t""")
def _(read):
    n = text.as_number
    price, percent = F.format_number(F.floor("l_extendedprice"), 0), F.concat((F.col("l_linenumber") * 10 + 2.5).cast("string"), F.lit(" %"))
    k = F.col("l_linenumber") % 4
    odd = F.when(k == 0, "1e3").when(k == 1, "inf").when(k == 2, " -2.5 ").otherwise("7d")
    return read("lineitem").select("l_orderkey", "l_linenumber", n(price).alias("price"), F.round(n(percent), 6).alias("percent"), n(odd).alias("odd"))


@_query("p7_text_measures", rf"""with t as (select doc_id, coalesce(text, '') as text, regexp_extract_all(lower(coalesce(text, '')), '{_WORD}') as words from documents)
select doc_id, length(text)::double as length, len(words)::double as words, round(case when len(words) > 0 then len(list_distinct(words)) / len(words) else 0 end, 6) as variety,
       round(case when text <> '' then length(regexp_replace(text, '[^\p{{Nd}}²³¹⁰⁴-⁹₀-₉①-⑨]', '', 'g')) / length(text) else 0 end, 6) as digit_share from t""")
def _(read):
    out = text.text_measures(read("documents").select("doc_id", "text"), "text").drop("text")
    return out.withColumns({c: F.round(c, 6) for c in ("variety", "digit_share")})


@_query("a1_median_fill", "with m as (select median(o_totalprice) filter (o_orderstatus <> 'F') as v from orders) select o_orderkey, round(case when o_orderstatus <> 'F' then o_totalprice else v end, 6) as price from orders, m")
def _(read):
    df = read("orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("price"))
    return prepare.fill_median(df, ["price"]).select("o_orderkey", F.round("price", 6).alias("price"))


@_query("a3_value_frequencies", """with v as (
  select unnest([{'name': 'o_orderpriority', 'value': o_orderpriority}, {'name': 'o_orderstatus', 'value': o_orderstatus}, {'name': 'o_custkey', 'value': o_custkey::varchar}], recursive := true) from orders
), c as (select name, value, count(*) as n from v group by all)
select name, value, n, row_number() over (partition by name order by n desc, value)::int as rank from c qualify rank <= 7""")
def _(read):
    return prepare.value_frequencies(read("orders"), ["o_orderpriority", "o_orderstatus", "o_custkey"])


@_query("a4_document_frequency", f"select token, count(*) as df from (select distinct doc_id, unnest(regexp_extract_all(lower(text), '{_WORD}')) as token from documents) group by token")
def _(read):
    return prepare.document_frequency(read("documents"), "text")


def _profile_sql(table: str, columns: tuple[str, ...]) -> str:
    """The measures of some columns without dates, as a union of one row each."""
    one = f"""select '{{0}}' as name, count(*) as n_rows, count_if(not {_MISSING})::bigint as present, count_if(not {_MISSING} and {_NUMBER})::bigint as numeric,
  0::bigint as dates, avg(len(regexp_extract_all(case when {_MISSING} then '<missing>' else {{0}} end, '{_WORD}'))) as avg_words,
  avg(length(case when {_MISSING} then '<missing>' else {{0}} end)) as avg_length, count(distinct case when {_MISSING} then '<missing>' else {{0}} end) as n_distinct
from (select {{0}}::varchar as {{0}} from {table})"""
    return " union all ".join(one.replace("{0}", c) for c in columns)


_CUSTOMER = ("c_name", "c_mktsegment", "c_nationkey", "c_custkey")


@_query("i1_profile", f"select * exclude (n_distinct) replace (round(avg_words, 6) as avg_words, round(avg_length, 6) as avg_length) from ({_profile_sql('customer', _CUSTOMER)})")
def _(read):
    p = prepare.profile_columns(read("customer").select(*_CUSTOMER))
    return p.withColumns({"avg_words": F.round("avg_words", 6), "avg_length": F.round("avg_length", 6)})


@_query("i2_kinds", f"""select name, case when present = 0 then 'empty' when numeric >= 0.85 * present then 'numeric' when dates >= 0.85 * present then 'date'
  when n_distinct <= least(20, greatest(8, round_even(sqrt(n_rows), 0))) and avg_words < 4 and avg_length < 48 then 'category'
  when avg_words < 1.4 and avg_length < 24 and n_distinct / n_rows > 0.7 then 'identifier' else 'text' end as kind
from ({_profile_sql("(select *, 'K' || o_orderkey as code, case when o_orderkey % 3 > 0 then o_orderpriority end as part, ' n/a ' as gone from orders)", ("o_orderkey", "o_orderpriority", "o_orderstatus", "code", "part", "gone"))})""")
def _(read):
    df = read("orders").select(
        "o_orderkey", "o_orderpriority", "o_orderstatus", F.concat(F.lit("K"), F.col("o_orderkey")).alias("code"),
        F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("part"), F.lit(" n/a ").alias("gone"),
    )
    return prepare.infer_kinds(prepare.profile_columns(df), prepare.distinct_counts(df, df.columns))


@_query("a2_distinct_counts", "select 'o_orderpriority' as name, count(distinct o_orderpriority) as n_distinct from orders union all select 'o_custkey', count(distinct o_custkey) from orders")
def _(read):
    return prepare.distinct_counts(read("orders"), ["o_orderpriority", "o_custkey"])


@_query("p6_categories", "select o_orderkey, " + ", ".join(f"""(o_orderstatus = '{v}')::int::double as "o_orderstatus = {v}\"""" for v in "FOP") + " from orders")
def _(read):
    return prepare.expand_categories(read("orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus").drop("o_orderstatus")


@_query("l1_sample", "select o_orderkey from orders order by md5('7:' || o_orderkey), o_orderkey limit 500")
def _(read):
    return positions.sample_rows(read("orders").select("o_orderkey"), 500, 7, "o_orderkey")


@_query("l3_folds", "select o_orderkey, ((row_number() over (partition by o_orderstatus order by md5('7:' || o_orderkey)) - 1) % 3)::int as fold from orders")
def _(read):
    return positions.assign_folds(read("orders"), 3, 7, "o_orderkey", "o_orderstatus").select("o_orderkey", "fold")


@_query("l4_positions", "select o_orderkey, row_number() over (partition by o_orderstatus order by md5('7:' || o_orderkey)) as position from orders")
def _(read):
    df = read("orders").withColumn("k", positions.order_key(7, "o_orderkey"))
    return positions.positions(df, "o_orderstatus", "k").select("o_orderkey", F.col("position").cast("long").alias("position"))


_PRED = "with " + _LINES + ", p as (select 1 as set_id, label, quantity / 51 as p from lines)"


def _predicted(read) -> DataFrame:
    return line_returns(read).select(F.lit(1).alias("set_id"), "label", (F.col("quantity") / 51).alias("p"))


@_query("e5_accuracy_log_loss", _PRED + " select set_id, round(avg(((p >= 0.5)::int = label)::int), 6) as accuracy, round(-avg(case when label = 1 then ln(p) else ln(1 - p) end), 6) as log_loss from p group by set_id")
def _(read):
    out = evaluate.classification_metrics(_predicted(read))
    return out.select("set_id", F.round("accuracy", 6).alias("accuracy"), F.round("log_loss", 6).alias("log_loss"))


@_query("e6_auc", _PRED + """, r as (select label, avg(rn) over (partition by p) as rank from (select label, p, row_number() over (order by p) as rn from p))
select 1 as set_id, round((sum(rank * label) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))), 6) as auc from r""")
def _(read):
    return evaluate.auc(_predicted(read)).select("set_id", F.round("auc", 6).alias("auc"))


@_query("e7_r2_rmse", _PRED + " select set_id, round(1 - sum((label - p) ** 2) / (var_pop(label) * count(*)), 6) as r2, round(sqrt(avg((label - p) ** 2)), 6) as rmse from p group by set_id")
def _(read):
    out = evaluate.regression_metrics(_predicted(read))
    return out.select("set_id", F.round("r2", 6).alias("r2"), F.round("rmse", 6).alias("rmse"))


def _sets(rel: DataFrame, red: DataFrame) -> dict[str, list[int]]:
    """The chosen, the top-relevance and the full set."""
    spark = rel.sparkSession
    best = search.best_read(search.search(spark, objective.build_terms(rel, red, K), K, *search.QUALITY["fast"])).first()["selected"]
    top = [r["idx"] for r in objective.select_top_relevance(rel, K).collect()]
    return {"chosen": sorted(best), "top": sorted(top), "all": [r["idx"] for r in objective.select_all(rel).collect()]}


_BEST = ", best as (select state from energy order by round(energy, 9), state limit 1), chosen as (select idx from rels, best where (state >> idx) & 1 = 1)"
_TOP = f", top as (select idx from rels order by rels.r desc, idx limit {K})"


def _three_sets(chosen: str, top: str, all_: str, n: int) -> str:
    """CTE `sets` of the best, the top-relevance and the full set, as bit masks."""
    return f", sets as (select '{chosen}' as set_id, state from best union all select '{top}', sum(1 << idx)::bigint from top union all select '{all_}', {2**n - 1})"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("score", "secondary", "loss") if c in df.columns})


_COMPARED = "with recursive " + _SQL[5:] + _BEST + _TOP + _three_sets("chosen", "top", "all", len(COLUMNS)) + replay.dealt("lines", "row_id", "label", 42) + replay.models(COLUMNS, "label")
_WEIGHTS = " select set_id, fold::int as fold, (i - 1)::int as idx, round(v[i], 6) as weight, round(b0, 6) as intercept from weights, range(1, 8) t(i)"


def _weights(spark: SparkSession, models: dict) -> DataFrame:
    rows = [(s, f, i, round(float(x), 6), round(float(b), 6)) for (s, f), (w, b) in models.items() for i, x in enumerate(w)]
    return spark.createDataFrame(rows, "set_id string, fold int, idx int, weight double, intercept double")


def _dealt(read) -> tuple[DataFrame, stats.Moments]:
    df = positions.assign_folds(line_returns(read), 3, 42, "row_id", "label")
    df = shared.written(evaluate.merged(df, ["label", *COLUMNS, "fold"]))  # computed once for moments and models
    return df, stats.moments(df, COLUMNS, "label", "fold", evaluate.ROWS)


@_query("e2_linear_fit", _COMPARED + replay.linear(COLUMNS) + _WEIGHTS)
def _(read):
    """Weights of the linear models of every set and fold, from moments alone."""
    df, m = _dealt(read)
    out = {}
    for name, chosen in _sets(stats.relevance(df.sparkSession, m), stats.redundancy(df.sparkSession, m)).items():
        for fold, (w, b) in evaluate.fit_linear(m, chosen).items():
            full = dict(zip(chosen, w))
            out[name, fold] = [full.get(i, 0.0) for i in range(len(COLUMNS))], b
    return _weights(df.sparkSession, out)


@_query("e3_logistic_fit", _COMPARED + replay.logistic(COLUMNS, "label") + _WEIGHTS)
def _(read):
    """Weights of the logistic models of every set and fold, trained together."""
    df, m = _dealt(read)
    sets = _sets(stats.relevance(df.sparkSession, m), stats.redundancy(df.sparkSession, m))
    return _weights(df.sparkSession, evaluate.fit_logistic(df, m, sets, "fold", weight=evaluate.ROWS))


@_query("e8_evaluate_sets", _COMPARED + replay.logistic(COLUMNS, "label") + replay.predicted(COLUMNS, "label", True) + replay.scores(True) + replay.report(True))
def _(read):
    """AUC, accuracy and log loss of the chosen, the top-relevance and the full set, on the same folds."""
    return _rounded(evaluate.evaluate_subsets(line_returns(read), COLUMNS, "label", "classification", _sets(*_statistics(read)), "row_id", seed=42))


def _frontier_sql(names: list[str], target: str, sizes: tuple[int, ...]) -> str:
    """Relevance and redundancy of `lines`, and for every size the best set (chosen: k, state) and the top of the ranking (top)."""
    rel = ", rel as (" + " union all ".join(f"select {i} as idx, '{c}' as name, {_ONE(c, target)} as r_raw from lines" for i, c in enumerate(names)) + "), rels as (select idx, name, r_raw, r_raw / max(r_raw) over () as r from rel)"
    red = ", red as (" + " union all ".join(f"select {i} as i, {j} as j, {_ONE(a, b)} as value from lines" for i, a in enumerate(names) for j, b in enumerate(names) if i < j) + ")"
    return rel + red + f""", sizes as (select unnest({list(sizes)}) as k), states as (select k, s as state from range({2 ** len(names)}) t(s), sizes where bit_count(s::int) = k
), terms as (select k, idx as i, idx as j, -r + 2.5 * (1 - 2 * k) as coeff from rels, sizes union all select k, i, j, 0.65 / greatest(1, k - 1) * greatest(0, value) + 5.0 from red, sizes
), energy as (select k, state, sum(coeff) as e from states join terms using (k) where (state >> i) & 1 = 1 and (state >> j) & 1 = 1 group by k, state
), chosen as (select k, state from energy qualify row_number() over (partition by k order by round(e, 9), state) = 1
), top as (select k, sum(1 << idx)::bigint as state from (select idx, row_number() over (order by rels.r desc, idx) as place from rels), sizes where place <= k group by k)"""


_PRICED = [c for c in COLUMNS if c != "extendedprice"] + ["label"]


@_query("q10_frontier_linear", "with recursive " + _LINES + _frontier_sql(_PRICED, "extendedprice", (1, 3, 5, 7)) + ", sets as (select 'chosen ' || k as set_id, state from chosen union all select 'top ' || k, state from top)"
    + replay.dealt("lines", "row_id", None, 42) + replay.models(_PRICED, "extendedprice") + replay.linear(_PRICED) + replay.predicted(_PRICED, "extendedprice", False) + replay.scores(False) + replay.report(False))
def _(read):
    """R^2 and RMSE of linear models on the best set of every frontier size: one search of all sizes, one pass of moments."""
    df = line_returns(read)
    spark, m = df.sparkSession, stats.moments(df, _PRICED, "extendedprice")
    rel, red, best, top = selection.choose(spark, m, K, objective.LAMBDA, "fast", 42)
    sets = {f"chosen {k}": best[k]["selected"] for k in best} | {f"top {k}": top[k] for k in top}
    return _rounded(evaluate.evaluate_subsets(df, _PRICED, "extendedprice", "regression", sets, "row_id", seed=42))


@_query("q10_frontier", "with " + _LINES + _REL + _RED + """, sizes as (select unnest([1, 3, 5, 7]) as k), states as (select k, s as state from range(128) t(s), sizes where bit_count(s::int) = k
), terms as (select k, idx as i, idx as j, -r + 2.5 * (1 - 2 * k) as coeff from rels, sizes union all select k, i, j, 0.65 / greatest(1, k - 1) * greatest(0, value) + 5.0 from red, sizes
), energy as (select k, state, sum(coeff) as e from states join terms using (k) where (state >> i) & 1 = 1 and (state >> j) & 1 = 1 group by k, state
), chosen as (select k, 'QUBO' as method, state from energy qualify row_number() over (partition by k order by round(e, 9), state) = 1
), top as (select k, 'Top relevance' as method, sum(1 << idx)::bigint as state from (select idx, row_number() over (order by rels.r desc, idx) as place from rels), sizes where place <= k group by k
), both_ as (select * from chosen union all select * from top)
select k::int as k, method, round(100 * (1 - k / 7), 2) as reduction, round(coalesce(avg(value), 0), 6) as redundancy
from both_ left join red on (state >> i) & 1 = 1 and (state >> j) & 1 = 1 group by k, method""")
def _(read):
    """The sets of all frontier sizes from one search: size, method, percent of the inputs left out, redundancy."""
    df = line_returns(read)
    spark, m = df.sparkSession, stats.moments(df, COLUMNS, "label")
    _, red, best, top = selection.choose(spark, m, K, objective.LAMBDA, "fast", 42)
    rows = [(f"{name} {k}", k, name, list(s[k])) for name, s in (("QUBO", {k: b["selected"] for k, b in best.items()}), ("Top relevance", top)) for k in s]
    sets = spark.createDataFrame(rows, "set_id string, k int, method string, selected array<int>")
    return report.frontier_table(sets, red, None, len(COLUMNS))


@_query("q8_all_features", _SQL + " select idx, name, round(r, 6) as r from rels")
def _(read):
    return objective.select_all(_statistics(read)[0]).select("idx", "name", F.round("r", 6).alias("r"))


@_query("i7_strongest", _SQL + " select idx, name from rels order by r_raw desc, name limit 4")
def _(read):
    return prepare.prefilter(_statistics(read)[0], 4).select("idx", "name")


_SMALL = ("quantity", "discount", "tax", "linenumber", "label")


@_query("m1_moments", "with " + _LINES + " " + " union all ".join(f"select '{a}' as name_i, '{b}' as name_j, count(*) as n, round(avg({a}), 9) as mean, round(covar_pop({a}, {b}), 6) as covariance from lines" for i, a in enumerate(_SMALL) for b in _SMALL[i:]))
def _(read):
    df = line_returns(read)
    m = stats.moments(df, list(_SMALL[:-1]), "label")
    (n, s, _), c = m.total(), m.centred()
    rows = [(a, b, int(n), round(float(m.shift[i] + s[i] / n), 9), round(float(c[i, j] / n), 6)) for i, a in enumerate(_SMALL) for j, b in enumerate(_SMALL) if i <= j]
    return df.sparkSession.createDataFrame(rows, "name_i string, name_j string, n long, mean double, covariance double")


@_query("m2_pearson", "with " + _LINES + " select 'quantity' as name, round(corr(quantity, extendedprice), 6) as r from lines union all select 'constant', 0.0 union all select 'gaps', round(corr(case when linenumber <> 2 then quantity end, extendedprice), 6) from lines")
def _(read):
    df = line_returns(read)
    spark, gaps = df.sparkSession, F.when(F.col("linenumber") != 2, F.col("quantity"))
    frames = {"quantity": df, "constant": df.withColumn("quantity", F.lit(3.5)), "gaps": df.withColumn("quantity", gaps)}
    rows = [(name, round(float(stats.correlations(stats.moments(f, ["quantity"], "extendedprice"))[0, 1]), 6)) for name, f in frames.items()]
    return spark.createDataFrame(rows, "name string, r double")


# Preparation: lines with gaps in numbers, percent texts, dates, categories with missing values, an identifier and a constant.
def mixed_lines(read, more_key: tuple[str, ...] = ()) -> DataFrame:
    line = F.col("l_linenumber")
    return read("lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", *more_key).alias("row_id"), F.when(line != 3, F.col("l_quantity")).alias("quantity"),
        F.when(line % 5 != 4, F.concat(F.round(F.col("l_discount") * 100).cast("int"), F.lit(" %"))).alias("discount"), F.col("l_shipdate").alias("shipped"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"), F.concat(F.lit("K"), "l_orderkey", F.lit("x"), "l_linenumber").alias("code"),
        F.lit("same").alias("same"), F.when(line != 7, F.col("l_linestatus")).alias("status"),
    )


_MIXED = """raw as (
  select l_orderkey || '-' || l_linenumber as row_id, case when l_linenumber <> 3 then l_quantity end as quantity,
         case when l_linenumber % 5 <> 4 then round(l_discount * 100)::int::double * 0.01 end as discount, epoch_us(l_shipdate) / 86400000000.0 as shipped, l_returnflag as flag,
         (l_linestatus = 'O')::int::double as label
  from lineitem where l_linenumber <> 7
), lines as (
  select row_id as id, label, coalesce(quantity, (select median(quantity) from raw)) as quantity, coalesce(discount, (select median(discount) from raw)) as discount, shipped as "shipped · date",
         (flag = 'A')::int::double as "flag = A", (flag = 'R')::int::double as "flag = R", (flag = 'N')::int::double as "flag = <missing>"
  from raw
)"""
_MIXED_NAMES = ("quantity", "discount", "shipped · date", "flag = A", "flag = R", "flag = <missing>")


def _wide(ready: prepare.Prepared) -> DataFrame:
    """The prepared table with its inputs under their names."""
    return ready.data.select("id", "label", *[F.col(c).alias(name) for c, (name, *_) in zip(ready.columns, ready.features)])


@_query("i6_prepare", "with " + _MIXED + " select id, label, " + ", ".join(f'round("{c}", 6) as "{c}"' for c in _MIXED_NAMES) + " from lines")
def _(read):
    wide = _wide(prepare.prepare(mixed_lines(read), "status", id_col="row_id"))
    return wide.select("id", "label", *[F.round(text.named(c), 6).alias(c) for c in wide.columns[2:]])


@_query("i5_inspect", "select count(*) as rows, 7 as columns, 6 as source_columns, 'status' as target, case when count(distinct l_linestatus) = 2 then 'classification' else 'regression' end as task, 3 + count(distinct l_returnflag)::int as prepared, null::varchar as error from lineitem")
def _(read):
    return prepare.inspect(mixed_lines(read), "status", "row_id").summary


@_query("i3_task", "select 'status' as target, case when count(distinct l_linestatus) = 2 then 'classification' else 'regression' end as task from lineitem where l_linenumber <> 7 union all select 'quantity', case when count(distinct l_quantity) = 2 then 'classification' else 'regression' end from lineitem where l_linenumber <> 3")
def _(read):
    df = mixed_lines(read)
    return df.sparkSession.createDataFrame([(c, prepare.infer_task(df, c)) for c in ("status", "quantity")], "target string, task string")


@_query("i4_encoded_target", "select l_orderkey || '-' || l_linenumber as row_id, (l_linestatus = (select max(l_linestatus) from lineitem where l_linenumber <> 7))::int::double as label from lineitem where l_linenumber <> 7")
def _(read):
    return prepare.encode_target(mixed_lines(read), "status", "classification").select("row_id", "label")


@_query("p4_rows_without_target", "select count_if(l_linenumber = 7)::bigint as removed, count_if(l_linenumber <> 7)::bigint as left_over, count_if(l_linenumber <> 7 and l_linestatus = 'O')::bigint as open from lineitem")
def _(read):
    rows, gone, n = prepare.drop_missing_target(mixed_lines(read), "status")
    return rows.agg(F.lit(gone).cast("long").alias("removed"), F.lit(n).cast("long").alias("left_over"), F.count_if(F.col("status") == "O").alias("open"))


@_query("p9_not_constant", "select l_orderkey, l_quantity from lineitem")
def _(read):
    df = read("lineitem").select("l_orderkey", "l_quantity", F.lit(2.0).alias("two"), (F.col("l_tax") * 0).alias("zero"))
    return prepare.drop_constant(df, ["l_orderkey", "l_quantity", "two", "zero"])


@_query("k1_csv", "with " + _MIXED + " select " + ", ".join(f"""format('{{:.10g}}', "{c}") as "{c}\"""" for c in _MIXED_NAMES) + ", label::int::varchar as status from lines")
def _(read):
    return sinks.csv_columns(prepare.prepare(mixed_lines(read), "status", id_col="row_id"))


@_query("p1_missing", "select o_orderkey, lower(trim(v)) in ('', 'na', 'n/a', 'null', 'none', 'nan', '?') as missing from (select o_orderkey, case o_orderkey % 7 when 0 then ' NA ' when 1 then 'n/a' when 2 then 'NULL' when 3 then '' when 4 then '?' when 5 then 'nobody' else o_orderpriority end as v from orders)")
def _(read):
    v, k = None, F.col("o_orderkey") % 7
    for i, x in enumerate((" NA ", "n/a", "NULL", "", "?", "nobody")):
        v = F.when(k == i, x) if v is None else v.when(k == i, x)
    return read("orders").select("o_orderkey", text.is_missing(v.otherwise(F.col("o_orderpriority"))).alias("missing"))


_FIT = f"""with t as (select doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '<missing>')), '{_WORD}')) as words from documents), n as (select count(*) as n from t
), df as (select token, count(*) as df from (select unnest(words) as token from t) where length(token) >= 3 and not regexp_full_match(token, '[0-9]+')
  and token not in ('and', 'are', 'but', 'for', 'from', 'has', 'have', 'into', 'not', 'that', 'the', 'this', 'was', 'were', 'with', 'your') group by token
), best as (select token, df from df, n where df between greatest(3, round_even(n * 0.02, 0)) and round_even(n * 0.9, 0) order by abs(df / n - 0.5), df desc, token limit 6)"""


@_query("p8_keywords", _FIT + " select * from best")
def _(read):
    df = read("documents")
    return prepare.frequent_keywords(df, text.tokens(prepare.view(df.schema["text"]).value), df.count())


@_query("p8_keyword_indicators", _FIT + " select doc_id, best.token, list_contains(words, best.token)::int::double as value from t, best")
def _(read):
    """The indicators of every text, as rows."""
    out = prepare.keyword_indicators(read("documents").select("doc_id", "text"), "text").drop("text")
    long = out.unpivot("doc_id", [text.named(c) for c in out.columns[1:]], "name", "value")
    return long.select("doc_id", F.regexp_extract("name", '"(.*)"', 1).alias("token"), "value")


@_query("p10_display_name", "select o_orderkey, upper(substr(v, 1, 1)) || substr(v, 2) as name from (select o_orderkey, trim(regexp_replace('order__' || lower(o_orderpriority), '[_-]+', ' ', 'g')) as v from orders)")
def _(read):
    return read("orders").select("o_orderkey", text.display_name(F.concat(F.lit("order__"), F.lower("o_orderpriority"))).alias("name"))


@_query("p11_preview", "select o_orderkey::varchar as o_orderkey, o_orderstatus, o_orderpriority from orders order by orders.o_orderkey limit 4")
def _(read):
    return prepare.preview(read("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), "o_orderkey")


@_query("l2_validation_sample", """with c as (select o_orderkey, o_orderstatus, row_number() over (partition by o_orderstatus order by md5('7:' || o_orderkey)) as place, count(*) over (partition by o_orderstatus) as k, count(*) over () as n from orders
), q as (select o_orderstatus, 500 * any_value(k) / any_value(n) as exact, any_value(k) as k from c group by 1), r as (select *, floor(exact) as base, sum(floor(exact)) over () as total, row_number() over (order by exact - floor(exact) desc, k desc) as place from q)
select o_orderkey, c.o_orderstatus from c join r using (o_orderstatus) where c.place <= base + (r.place <= 500 - total)::int""")
def _(read):
    return positions.validation_sample(read("orders").select("o_orderkey", "o_orderstatus"), 500, 7, "o_orderkey", "o_orderstatus")


_FOLDS = "with " + _LINES + ", dealt as (select *, ((row_number() over (partition by label order by md5('42:' || row_id)) - 1) % 3)::int as fold from lines)"


@_query("e1_standardized", _FOLDS + ", s as (select f as fold, avg(quantity) as m, stddev_pop(quantity) as sd, avg(tax) as mt, stddev_pop(tax) as st from dealt, range(3) t(f) where fold <> f group by f) select row_id, dealt.fold, round((quantity - m) / sd, 6) as z_quantity, round((tax - mt) / st, 6) as z_tax from dealt join s using (fold)")
def _(read):
    df = positions.assign_folds(line_returns(read), 3, 42, "row_id", "label")
    m = stats.moments(df, ["quantity", "tax"], "label", "fold")
    out = evaluate.standardized(df, ["quantity", "tax"], m, "fold")
    return out.select("row_id", "fold", F.round("z_quantity", 6).alias("z_quantity"), F.round("z_tax", 6).alias("z_tax"))


# Models with given weights: (set, fold) -> weights of quantity and tax, intercept.
_GIVEN = {("a", 0): ([0.02, 0.0], -0.5), ("a", 1): ([0.01, 0.0], -0.3), ("a", 2): ([-0.01, 0.0], 0.2), ("b", 0): ([0.03, 4.0], -1.0), ("b", 1): ([0.0, 2.0], 0.1), ("b", 2): ([-0.02, -3.0], 0.4)}
_GIVEN_SQL = _FOLDS + ", p as (" + " union all ".join(f"select '{s}' as set_id, label, round(1 / (1 + exp(-({b} + {w[0]} * quantity + {w[1]} * tax))), 9) as p from dealt where fold = {f}" for (s, f), (w, b) in _GIVEN.items()) + ")"
_METRICS_SQL = _GIVEN_SQL + """, ranked as (select set_id, label, avg(rn) over (partition by set_id, p) as rank from (select *, row_number() over (partition by set_id order by p) as rn from p)
), a as (select set_id, (sum(rank * label) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))) as auc from ranked group by set_id
), c as (select set_id, avg(((p >= 0.5)::int = label)::int) as accuracy, -avg(case when label = 1 then ln(p) else ln(1 - p) end) as log_loss, count(*) as n from p group by set_id), metrics as (select * from a join c using (set_id))"""


def _given(read) -> DataFrame:
    import numpy as np

    df = positions.assign_folds(line_returns(read), 3, 42, "row_id", "label")
    out = evaluate.predictions(df, ["quantity", "tax"], {k: (np.array(w), b) for k, (w, b) in _GIVEN.items()}, "fold", "label", True)
    return out.withColumn("p", F.round("p", 9))  # so that ties are ties for every engine


@_query("e4_predictions", _GIVEN_SQL + " select set_id, label, round(p, 6) as p, count(*) as n from p group by 1, 2, 3")
def _(read):
    return _given(read).groupBy("set_id", "label", F.round("p", 6).alias("p")).agg(F.count("*").alias("n"))


def _given_metrics(read) -> DataFrame:
    pred = _given(read)
    return evaluate.classification_metrics(pred).join(evaluate.auc(pred), "set_id")


@_query("r3_benchmark", _METRICS_SQL + " select case set_id when 'a' then 'qubo' else 'greedy' end as method, round(auc, 6) as score, 'ROC AUC' as score_label, round(accuracy, 6) as secondary, round(log_loss, 6) as loss from metrics")
def _(read):
    m = _given_metrics(read).select("set_id", F.col("auc").alias("score"), F.lit("ROC AUC").alias("score_label"), F.col("accuracy").alias("secondary"), F.col("log_loss").alias("loss"))
    return report.benchmark_table(m, {"a": "qubo", "b": "greedy"})


@_query("r4_insight", _METRICS_SQL + _REL.replace(", rel as", ", rel as", 1) + _RED + """, pair as (select max(auc) filter (set_id = 'a') as score, max(auc) filter (set_id = 'b') as greedy_score,
  (select value from red where i = 0 and j = 3) as redundancy, (select value from red where i = 0 and j = 1) as greedy_redundancy from metrics), d as (select *, score - greedy_score as ds, redundancy - greedy_redundancy as dr from pair)
select round(ds, 6) as score_delta, round(dr, 6) as redundancy_delta, case when ds >= 0.002 and dr < 0 then 1 when redundancy + 0.01 < greedy_redundancy then 2 else 3 end as finding from d""")
def _(read):
    score = dict(map(tuple, _given_metrics(read).select("set_id", "auc").collect()))
    red = {(r["i"], r["j"]): r["value"] for r in _statistics(read)[1].collect()}
    spark = SparkSession.getActiveSession()
    pair = spark.createDataFrame([(score["a"], red[0, 3], score["b"], red[0, 1])], "score double, redundancy double, greedy_score double, greedy_redundancy double")
    return report.insight(pair).drop("finding_text")


_FEATURES = """ select row_number() over (order by idx in (from chosen) desc, round(r, 6) desc, idx)::int as position, name, idx in (from chosen) as selected, idx in (from top) as greedy, round(r, 6) as relevance,
  round(coalesce((select avg(value) from (select i, j, value from red union all select j, i, value from red) x where x.i = idx and x.j in (from chosen)), 0), 6) as selected_redundancy from rels"""


@_query("r1_selection", _SQL + _BEST + f""" select {K} as k, (select list(name order by idx) from rels where idx in (from chosen)) as names, (select round(energy, 6) from energy join best using (state)) as energy, round(100 * (1 - {K} / 7), 2) as feature_reduction,
  35.0::double as search_space, '35' as search_space_label, (select round(avg(r), 6) from rels where idx in (from chosen)) as average_relevance, (select round(avg(value), 6) from red where i in (from chosen) and j in (from chosen)) as average_redundancy""")
def _(read):
    rel, red = _statistics(read)
    spark, terms = rel.sparkSession, objective.build_terms(rel, red, K)
    best = objective.best_state(objective.energies(objective.all_states(spark, len(COLUMNS), K), terms, objective.offset(K), len(COLUMNS)))
    sets = objective.members(best.select("state"), len(COLUMNS)).withColumnRenamed("state", "set_id")
    return report.selection_summary(sets, rel, red, best.withColumnRenamed("state", "set_id")).drop("set_id")


@_query("r2_features", _SQL + _BEST + _TOP + _FEATURES)
def _(read):
    rel, red = _statistics(read)
    sets = _sets(rel, red)
    return report.feature_table(rel, red, sets["chosen"], sets["top"])


@_query("k4_result_document", _SQL + _BEST + _TOP + _FEATURES)
def _(read):
    """The tables of a selection written as one JSON document; its list of features, read again."""
    rel, red = _statistics(read)
    sets, spark = _sets(rel, red), rel.sparkSession
    terms = objective.exported_terms(objective.build_terms(rel, red, K), rel)
    pair = spark.createDataFrame([("chosen", i) for i in sets["chosen"]], "set_id string, idx int")
    energy = spark.createDataFrame([("chosen", None)], "set_id string, energy double")
    found = {"selection": report.selection_summary(pair, rel, red, energy).drop("set_id"), "features": report.feature_table(rel, red, sets["chosen"], sets["top"]), "terms": terms}
    at = f"{shared.new_folder(spark)}/result.json"
    sinks.write_document(found, at)
    kind = found["features"].schema.simpleString().replace("struct<", "selection struct<k:int,names:array<string>>, features array<struct<", 1) + ">"
    return spark.read.schema(kind).json(at).select(F.inline("features"))


def _statistics_sql(names: tuple[str, ...], k: int) -> str:
    """Relevance, redundancy, terms and energies of all sets of k inputs of `lines`."""
    q = [f'"{c}"' for c in names]
    rel = ", rel as (" + " union all ".join(f"select {i} as idx, '{c}' as name, {_ONE(q[i], 'label')} as r_raw from lines" for i, c in enumerate(names)) + "), rels as (select idx, name, r_raw, r_raw / max(r_raw) over () as r from rel)"
    red = ", red as (" + " union all ".join(f"select {i} as i, {j} as j, {_ONE(q[i], q[j])} as value from lines" for i in range(len(q)) for j in range(i + 1, len(q))) + ")"
    terms = f", terms as (select idx as i, idx as j, -r + 2.5 * (1 - 2 * {k}) as coeff from rels union all select i, j, 0.65 / {max(1, k - 1)} * greatest(0, value) + 5.0 from red)"
    states = f", states as (select s as state from range({2 ** len(q)}) t(s) where bit_count(s::int) = {k})"
    return rel + red + terms + states + f", energy as (select state, sum(coeff) + {2.5 * k * k} as energy from states join terms on (state >> i) & 1 = 1 and (state >> j) & 1 = 1 group by state)"


@_query("r5_selected_features", "with " + _MIXED + _statistics_sql(_MIXED_NAMES, K) + _BEST + _TOP + _FEATURES.replace("row_number() over (order by idx in (from chosen) desc, round(r, 6) desc, idx)::int as position, ", ""))
def _(read):
    """The whole job on a table of mixed types: every input, whether it was chosen, relevance and overlap."""
    return selection.select_features(mixed_lines(read), "status", K, quality="fast", id_col="row_id").features.drop("position")


_QUOTED = [f'"{c}"' for c in _MIXED_NAMES]
_LINE_KEY = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_extendedprice"


@_query("r5_benchmark", "with recursive " + _MIXED.replace("l_orderkey || '-' || l_linenumber as", _LINE_KEY + " as") + _statistics_sql(_MIXED_NAMES, K) + _BEST + _TOP + _three_sets("qubo", "greedy", "all_features", len(_QUOTED)) + replay.dealt("lines", "id", "label", 91)
    + replay.models(_QUOTED, "label") + replay.logistic(_QUOTED, "label") + replay.predicted(_QUOTED, "label", True) + replay.scores(True) + replay.report(True, "set_id as method"))
def _(read):
    """The whole job's comparison of the chosen, the most relevant and all inputs. Rows have keys of their own, as folds follow them."""
    return selection.select_features(mixed_lines(read, ("l_partkey", "l_suppkey", "l_extendedprice")), "status", K, quality="fast", id_col="row_id").benchmark


@_query("s6_clean_headers", "select n_nationkey as key, n_name as key_2, n_regionkey as column_3 from nation")
def _(read):
    return read("nation").select("n_nationkey", "n_name", "n_regionkey").toDF(*text.clean_headers([" key ", "key", ""]))


_RECORDS = """select o_orderkey::varchar as o_orderkey, o_orderstatus, case when o_orderkey % 5 = 0 then '' else trim(' ' || o_orderpriority || ' ') end as priority, (o_orderkey % 2 = 0)::varchar as even,
  '{"a":"' || o_orderstatus || '","b":' || o_custkey || '}' as nested from orders"""


def _records(read) -> DataFrame:
    return read("orders").select(
        "o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.lit(" "), "o_orderpriority", F.lit(" "))).alias("priority"),
        (F.col("o_orderkey") % 2 == 0).alias("even"), F.struct(F.col("o_custkey").alias("b"), F.col("o_orderstatus").alias("a")).alias("nested"),
    )


@_query("s7_text_records", _RECORDS)
def _(read):
    return text.to_text_records(_records(read))


@_query("s8_not_blank", "select case when o_orderkey % 4 > 0 then o_orderkey end as o_orderkey, case when o_orderkey % 4 = 1 then o_orderstatus when o_orderkey % 4 = 0 then '  ' end as status from orders where o_orderkey % 4 > 0")
def _(read):
    k = F.col("o_orderkey") % 4
    return text.drop_blank_records(read("orders").select(F.when(k > 0, F.col("o_orderkey")).alias("o_orderkey"), F.when(k == 1, F.col("o_orderstatus")).when(k == 0, "  ").alias("status")))


@_query("s1_delimited", "select o_orderkey::varchar as o_orderkey, o_orderstatus || chr(10) || '\"' || o_orderpriority || '\"; x' as remark, o_custkey::varchar as o_custkey_2 from orders")
def _(read):
    """Orders written with quoted line breaks, quotes and separators, and read again."""
    remark = F.concat("o_orderstatus", F.lit('\n"'), "o_orderpriority", F.lit('"; x'))
    df = read("orders").select("o_orderkey", remark.alias("remark"), F.col("o_custkey").alias(" o_custkey_2 "))
    at = shared.new_folder(df.sparkSession)
    df.write.options(sep=";", header=True, escape='"').csv(at)
    return tables.read_delimited(df.sparkSession, at)


@_query("s2_json_lines", _RECORDS.replace("case when o_orderkey % 5 = 0 then '' else trim(' ' || o_orderpriority || ' ') end", "case when o_orderkey % 5 > 0 then ' ' || o_orderpriority || ' ' end").replace("""'{"a":"' || o_orderstatus || '","b":' || o_custkey || '}'""", """'{"b":' || o_custkey || ',"a":"' || o_orderstatus || '"}'"""))
def _(read):
    """Orders written as JSON lines among lines that hold no object, and read again."""
    df = _records(read)
    at = shared.new_folder(df.sparkSession)
    lines = F.explode(F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("[1]"), F.to_json(F.struct("*")), F.lit("7"))).otherwise(F.array(F.to_json(F.struct("*")))))
    df.select(lines.alias("value")).write.text(at)
    return tables.read_json_lines(df.sparkSession, at).select(*df.columns)


@_query("s3_json_documents", "select o_orderkey::varchar as o_orderkey, o_orderpriority from orders")
def _(read):
    """Orders written as eight JSON documents with their records under `rows`, and read again."""
    df = read("orders").select("o_orderkey", "o_orderpriority", (F.col("o_orderkey") % 8).alias("g"))
    at = shared.new_folder(df.sparkSession)
    docs = df.groupBy("g").agg(F.to_json(F.struct(F.lit(1).alias("version"), F.collect_list(F.struct("o_orderkey", "o_orderpriority")).alias("rows"))).alias("value"))
    docs.write.partitionBy("g").text(at)
    return tables.read_json_document(df.sparkSession, at + "/*")


@_query("s3_large_document", "select o_orderkey::varchar as o_orderkey, '}{\"' || o_orderpriority as remark from orders")
def _(read):
    """Orders written as one JSON document, its records in the member `rows`, and read again by many tasks."""
    df = read("orders").select("o_orderkey", F.concat(F.lit('}{"'), "o_orderpriority").alias("remark"))
    spark, at = df.sparkSession, shared.new_folder(df.sparkSession)
    line = lambda text: spark.range(1).select(F.lit(text).alias("value"))
    rows = df.select(F.concat(F.to_json(F.struct("*")), F.lit(",")).alias("value"))
    line('{"version": [{"o_orderkey": 0}], "rows": [').union(rows).union(line("null], \"end\": {}}")).coalesce(1).write.text(at)
    return tables.read_json_document(spark, at, whole=1_024)


@_query("s4_workbooks", "select o_orderkey::varchar as o_orderkey, coalesce(case when o_orderkey % 5 > 0 then o_orderpriority end, '') as priority, case when o_orderkey % 3 = 0 then '<&> \"' || o_orderstatus else o_orderstatus end as note from orders")
def _(read):
    """Orders written as workbooks, one a task, and read again, one a partition."""
    note = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('<&> "'), "o_orderstatus")).otherwise(F.col("o_orderstatus"))
    df = read("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderpriority")).alias("priority"), note.alias("note"))
    at = shared.new_folder(df.sparkSession)
    workbooks.write_workbooks(df.repartition(8, "o_orderkey"), at)
    return workbooks.read_workbooks(df.sparkSession, at)


@_query("s5_any_table", "select o_orderkey::varchar as o_orderkey, o_orderstatus, case o_orderkey % 4 when 0 then o_orderpriority end as only_csv, case o_orderkey % 4 when 1 then o_custkey::varchar end as only_json from orders")
def _(read):
    """Orders written into one folder as delimited text, JSON lines, workbooks and columns, and read as one table, each file by its kind."""
    df = read("orders")
    spark, at, part = df.sparkSession, shared.new_folder(df.sparkSession), lambda k: df.where(F.col("o_orderkey") % 4 == k)
    part(0).select("o_orderkey", "o_orderstatus", F.col("o_orderpriority").alias("only_csv")).write.options(sep="|", header=True).csv(f"{at}/text")
    part(1).select("o_orderkey", "o_orderstatus", F.col("o_custkey").alias("only_json")).write.json(f"{at}/lines")
    workbooks.write_workbooks(part(2).select("o_orderkey", "o_orderstatus").coalesce(2), f"{at}/books")
    part(3).select("o_orderkey", "o_orderstatus").write.parquet(f"{at}/columns")
    out = tables.read_table(spark, at)
    return out.select("o_orderkey", "o_orderstatus", "only_csv", "only_json")


def _uniform_sql(seed: int, name: str, at: int = 1) -> str:
    return f"((('0x' || substr(md5('{seed}:{name}:' || o_orderkey), {at}, 13))::bigint::double + 1) / 4503599627370496.0)"


def _synthetic_sql(seed: int, names: tuple[str, ...], mixes: dict, given: dict, rest: str) -> str:
    noise = {n: given.get(n, f"sqrt(-2 * ln({_uniform_sql(seed, n)})) * cos(6.283185307179586 * {_uniform_sql(seed, n, 14)})") for n in (*names, "logit", "cost")}
    out = "with s0 as (select o_orderkey, " + ", ".join(f"{x} as noise_{n}" for n, x in noise.items()) + f", {_uniform_sql(seed, 'label')} as u from orders)"
    for k, n in enumerate(names):
        mix = " + ".join(f"{w} * {o or 'noise_' + n}" for o, w in mixes.get(n, {"": 1.0}).items())
        out += f", s{k + 1} as (select *, {mix} as {n} from s{k})"
    return out + f" select o_orderkey, {', '.join(f'round({n}, 6) as {n}' for n in names)}, {rest} from s{len(names)}"


@_query("s9_device_failure", _synthetic_sql(17, synthetic.DEVICE_INPUTS, synthetic.DEVICE_MIXES, {}, "(u < 1 / (1 + exp(-(1.35 * thermal_gradient + 1.05 * vibration_rms + 0.82 * voltage_drift + 0.66 * packet_jitter - 0.62 * fan_delta + 0.5 * load_spike + 0.32 * thermal_gradient * vibration_rms + 0.35 * noise_logit - 0.15))))::int as fails_within_24h"))
def _(read):
    out = synthetic.device_failure(read("orders"), "o_orderkey")
    return out.withColumns({c: F.round(c, 6) for c in synthetic.DEVICE_INPUTS})


@_query("s10_workload_cost", _synthetic_sql(29, synthetic.WORKLOAD_INPUTS, synthetic.WORKLOAD_MIXES, {"weekday": f"(floor((1 - {_uniform_sql(29, 'weekday')}) * 7) / 3 - 1)"}, "round(21.0 + 6.8 * request_rate + 4.2 * payload_kb + 3.7 * cache_miss_rate + 5.1 * cpu_saturation + 2.4 * memory_gb + 1.9 * region_distance + 1.2 * request_rate * payload_kb + 1.8 * noise_cost, 6) as hourly_cost_usd"))
def _(read):
    out = synthetic.workload_cost(read("orders"), "o_orderkey")
    return out.withColumns({c: F.round(c, 6) for c in (*synthetic.WORKLOAD_INPUTS, "hourly_cost_usd")})
