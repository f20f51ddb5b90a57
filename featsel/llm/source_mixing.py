"""Mixing sources to target weights by Poisson replication, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featsel.llm.common import small, table, written

#: Target share of a source: its characters to this power, over the sum of all sources'.
TEMPERATURE = 0.5
SEED = 17


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the md5 of the seed and the parts."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def poisson_cdf(rate: Column) -> Column:
    """P(count <= 0), P(count <= 1), ... until what is left is under any double's precision. The
    terms are built from their logarithms, so that large rates don't underflow."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    step = lambda a, k: F.struct(
        (a["log"] + F.ln(rate / k)).alias("log"),
        F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + F.exp(a["log"] + F.ln(rate / k)))).alias("cdf"),
    )
    start = F.struct((-rate).alias("log"), F.array(F.exp(-rate)).alias("cdf"))
    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step, lambda a: a["cdf"])).otherwise(F.array(F.lit(1.0)))


def poisson_count(rate: Column, u: Column) -> Column:
    """The inverse of the Poisson distribution at u: the number of counts whose cumulated probability is at most u. The
    same terms as `poisson_cdf`, added up one after the other, so that a large rate needs no long array."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")

    def step(a: Column, k: Column) -> Column:
        log = a["log"] + F.ln(rate / k)
        cdf = a["cdf"] + F.exp(log)
        return F.struct(log.alias("log"), cdf.alias("cdf"), (a["n"] + (cdf <= u).cast("int")).alias("n"))

    start = F.struct((-rate).alias("log"), F.exp(-rate).alias("cdf"), (F.exp(-rate) <= u).cast("int").alias("n"))
    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step, lambda a: a["n"])).otherwise(0)


def rates(docs: DataFrame, weights: DataFrame | None = None, epochs: float = 1.0, temperature: float = TEMPERATURE) -> DataFrame:
    """source, n_chars, rate: how often each document of the source is wanted on average, so that
    the mix has `epochs` times the corpus's characters in the target shares.

    `weights` (source, weight) gives the shares up to a factor; a source that it lacks or gives
    null gets 0. Without it, the share is the source's characters to the power `temperature`. A null source is
    a source of its own. A source without a single character keeps each document at rate 1."""
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("n_chars"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow("n_chars", F.lit(temperature)))
    else:
        of = weights.groupBy("source").agg(F.sum("weight").cast("double").alias("weight"))
        sizes = sizes.alias("s").join(of.alias("w"), F.expr("s.source <=> w.source"), "left").selectExpr("s.*", "coalesce(w.weight, 0D) weight")
    sizes = written(sizes)
    total = sizes.agg(F.sum("n_chars").alias("c"), F.sum(F.expr("if(n_chars > 0, weight, 0)")).alias("w")).first()
    chars, weight = total["c"] or 0.0, total["w"] or 0.0
    share = F.col("weight") / F.lit(weight) if weight > 0 else F.lit(0.0)
    rate = F.when(F.col("n_chars") > 0, F.lit(float(epochs) * chars) * share / F.col("n_chars")).otherwise(1.0)
    return written(sizes.select("source", "n_chars", rate.alias("rate")))


def mix(docs: DataFrame, weights: DataFrame | None = None, epochs: float = 1.0, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """`docs` replicated and shuffled: each row as often as a Poisson count with its source's mean
    says, with `copy` (0, 1, ...) and `shuffle_key`; rows come ordered by that key.

    The count is the inverse of the Poisson distribution at a number hashed from the seed and the
    doc_id (for a null doc_id: the md5 of the text), so that it doesn't depend on the order or
    number of partitions; rows that repeat a doc_id are replicated alike. Null texts count 0 characters.
    Columns named copy or shuffle_key are replaced. An empty table gives no rows.

    The rates (one number a source) are sent to all tasks only if a count shows at most 20,000
    sources; otherwise Spark joins by shuffle and splits a large source. A row's count costs steps in proportion to its rate, as
    do its copies; a rate of up to some 10^8 fits."""
    docs = docs.drop("copy", "shuffle_key")
    rate = rates(docs, weights, epochs, temperature).select(F.col("source").alias("_source"), F.col("rate").alias("_rate"))
    known = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    rows = docs.join(small(rate, 20_000), F.col("source").eqNullSafe(F.col("_source")))
    rows = rows.withColumn("_u", uniform(seed, known)).withColumn("_n", poisson_count(F.col("_rate"), F.col("_u")))
    rows = rows.where("_n > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    rows = rows.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"{seed}:shuffle"), known, "copy")))
    return rows.select(*docs.columns, "copy", "shuffle_key").orderBy("shuffle_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
with sizes as (
  select source, sum(length(text))::double as chars from documents group by source
), rate as (
  select source, (select sum(chars) from sizes) * (chars ** 0.5 / (select sum(chars ** 0.5) from sizes)) / chars as r from sizes
), terms as (
  select source, k, exp(k * ln(r) - r - lgamma(k + 1)) as p from rate, range(0, 400) t(k) where k <= ceil(r + 12 * sqrt(r) + 30)
), cdf as (
  select source, k, sum(p) over (partition by source order by k) as c from terms
), counted as (
  select d.doc_id, d.text, d.lang, d.source, d.n_chars, count(cdf.k) as n
  from documents d left join cdf on cdf.source = d.source
    and cdf.c <= ('0x' || substr(md5('17:' || d.doc_id), 1, 13))::bigint::double / 4503599627370496.0
  group by all
)
select doc_id, text, lang, source, n_chars, copy::int as copy, md5('17:shuffle:' || doc_id || ':' || copy) as shuffle_key
from (select *, unnest(range(0, n)) as copy from counted)
"""
