"""Exact positions in key order without one task a group; samples and folds built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featsel.sinks.shared import bounded, written

#: Characters of a key that a count of prefixes tells apart at once (16^4 prefixes a group, if keys are hexadecimal).
DEEPER = 4
#: Rows that are sorted together at the most, as far as their keys differ.
BUDGET = 1_000_000


def order_key(seed: int, id_col: str) -> Column:
    """md5 of `seed:id`: the same on every engine, cluster and partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))


def prefixes(df: DataFrame, group: str, key: str, budget: int = BUDGET) -> tuple[DataFrame, int]:
    """_g, _prefix, _n: how many rows of each group have a key that begins with each prefix. Prefixes have the same length first;
    those of more than `budget` rows are replaced by longer ones, as long as keys go on. Also the length of the longest."""
    rows = df.select(F.col(group).alias("_g"), F.col(key).alias("_key"))
    count = lambda at, n: at.groupBy("_g", F.substring("_key", 1, n).alias("_prefix")).agg(F.count("*").alias("_n"))
    length = DEEPER
    found = written(count(rows, length))
    heavy = (F.col("_n") > budget) & (F.length("_prefix") == length)
    while not found.where(heavy).isEmpty():
        large = found.where(heavy).select(F.col("_g").alias("_h"), F.col("_prefix").alias("_start"))
        inside = rows.join(bounded(large), F.col("_g").eqNullSafe(F.col("_h")) & (F.substring("_key", 1, length) == F.col("_start")), "left_semi")
        found = written(found.where(~heavy).unionByName(count(inside, length + DEEPER)))
        length += DEEPER
        heavy = (F.col("_n") > budget) & (F.length("_prefix") == length)
    return found, length


def positions(df: DataFrame, group: str, key: str, budget: int = BUDGET) -> DataFrame:
    """Adds `position`, the row number (from 1) within `group` by the text `key`.

    Rows are counted by prefix of their key, in more depth where there are many (`prefixes`); neighbouring prefixes make pieces of up
    to `budget` rows, each piece is numbered by itself and starts after those before it. So the pieces are bounded however
    many rows there are and however their keys are spread; only rows of one key stay together."""
    found, longest = prefixes(df, group, key, budget)
    # a prefix per row for each length that occurs; a shorter one counts only where it wasn't replaced
    before = Window.partitionBy("_g").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    sizes = found.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    # a piece ends where the next prefix would bring it over the budget, which is where its multiple is passed
    sizes = sizes.withColumn("_piece", F.floor(F.col("_start") / budget))
    first = F.min("_start").over(Window.partitionBy("_g", "_piece"))
    sizes = bounded(written(sizes.select(F.col("_g"), F.col("_prefix"), F.col("_piece"), first.alias("_first"))))
    same = lambda n: df[group].eqNullSafe(F.col("_g")) & (F.substring(df[key], 1, n) == F.col("_prefix"))
    if longest == DEEPER:
        rows = df.join(sizes, same(DEEPER))
    else:  # every row has one of its prefixes in the table
        each = df.withColumn("_own", F.explode(F.array_distinct(F.array(*[F.substring(key, 1, n) for n in range(DEEPER, longest + 1, DEEPER)]))))
        rows = each.join(sizes, each[group].eqNullSafe(F.col("_g")) & (F.col("_own") == F.col("_prefix"))).drop("_own")
    inside = F.row_number().over(Window.partitionBy("_g", "_piece").orderBy(key))
    return rows.withColumn("position", F.col("_first") + inside).drop("_g", "_prefix", "_piece", "_first")


def sample_rows(df: DataFrame, n: int, seed: int, id_col: str, together: int = 100_000) -> DataFrame:
    """The `n` rows of smallest hash (all, if there are fewer). A few (`together`) are a top-k; for more, counts of prefixes tell the
    hash up to which all rows belong to the sample, and only the rest within one last prefix is a top-k."""
    rows = df.withColumn("_key", order_key(seed, id_col))
    if n <= together:
        return rows.orderBy("_key", id_col).limit(n).drop("_key")
    start, need = "", n
    while True:
        depth = len(start) + DEEPER
        counts = rows.where(F.col("_key").startswith(start)).groupBy(F.substring("_key", 1, depth).alias("p")).agg(F.count("*").alias("n"))
        last = None
        for p, k in counts.orderBy("p").collect():  # 16^4 prefixes at the most
            if k >= need:
                last = p, k
                break
            need -= k
        if last is None:
            return df  # fewer than n
        start = last[0]
        if last[1] <= together or depth >= 32:
            break
    low = rows.where(F.col("_key") < start)
    return low.unionByName(rows.where(F.col("_key").startswith(start)).orderBy("_key", id_col).limit(need)).drop("_key")


def assign_folds(df: DataFrame, folds: int, seed: int, id_col: str, label: str | None = None) -> DataFrame:
    """Adds `fold` (0 .. folds - 1): rows dealt round robin in hash order, within each class if `label` is given."""
    rows = df.withColumn("_order", order_key(seed, id_col)).withColumn("_class", F.col(label) if label else F.lit(0))
    return positions(rows, "_class", "_order").withColumn("fold", F.pmod(F.col("position") - 1, F.lit(folds)).cast("int")).drop("_order", "_class", "position")


def quotas(sizes: DataFrame, n: int) -> DataFrame:
    """sizes (label, rows) with `quota`: how many rows of each class a sample of `n` takes. Largest remainders: every class gets its
    share rounded down, but one at the least and all it has at the most; what is missing then goes, one each, to the classes
    furthest below their share (ties: the larger class), and what is too much is taken, row by row, from the quotas furthest above it
    (ties: the larger quota). One window over the classes for either case."""
    total, all_ = F.sum("rows").over(Window.partitionBy()), Window.partitionBy()
    each = sizes.withColumn("_all", total).withColumn("_share", F.col("rows") * n / F.col("_all"))
    each = each.withColumn("_low", F.least("rows", F.greatest(F.lit(1), F.floor("_share")))).withColumn("_over", F.sum("_low").over(all_) - n)
    open_ = F.col("_low") < F.col("rows")
    place = F.row_number().over(Window.orderBy(F.desc(open_), F.desc(F.col("_share") - F.col("_low")), F.desc("rows"), "label"))
    more = each.withColumn("quota", F.col("_low") + F.when(open_ & (place <= -F.col("_over")), 1).otherwise(0))
    # each row of a quota above one could go: the t-th of a class is as far above its share as the quota less t
    could = each.where("_over > 0 and _low > 1").select("label", "_over", "_share", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("_low") - 2, F.col("_over")))).alias("t"), "_low")
    rank = F.row_number().over(Window.orderBy(F.desc(F.col("_low") - F.col("t") - F.col("_share")), F.desc(F.col("_low") - F.col("t")), "label"))
    gone = could.withColumn("_rank", rank).where("_rank <= _over").groupBy(F.col("label").alias("_l")).agg(F.count("*").alias("_gone"))
    out = more.join(gone, F.col("label").eqNullSafe(F.col("_l")), "left")
    quota = F.when(F.col("_all") <= n, F.col("rows")).otherwise(F.col("quota") - F.coalesce("_gone", F.lit(0)))
    return out.select("label", "rows", quota.cast("long").alias("quota"))


def validation_sample(df: DataFrame, n: int, seed: int, id_col: str, label: str | None = None, classes: int | None = None) -> DataFrame:
    """At most `n` rows: the first ones in hash order, with `label` of each class as many as its quota (see `quotas`). More classes
    than `classes`, if given, are an error."""
    if not label:
        return sample_rows(df, n, seed, id_col)
    sizes = written(df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("rows")))
    if classes and sizes.count() > classes:
        raise ValueError(f"a stratified sample takes {classes} classes at the most")
    quota = bounded(written(quotas(sizes, n).select(F.col("label").alias("_c"), F.col("quota").alias("_quota"))))
    rows = positions(df.withColumn("_order", order_key(seed, id_col)), label, "_order")
    return rows.join(quota, rows[label].eqNullSafe(F.col("_c"))).where("position <= _quota").drop("_order", "_c", "_quota", "position")
