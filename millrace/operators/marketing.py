"""Marketing analytics: RFM scores, customer activity index, baskets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators import ordering
from millrace.operators.aggregate import quantiles_of

#: Time scales and the truncations that make their buckets.
SCALES = {"hourly": "hour", "daily": "day", "weekly": "week", "monthly": "month", "yearly": "year"}


def bucket(at: Column, scale: str) -> Column:
    return F.date_trunc(SCALES[scale], at.cast("timestamp"))


def units_between(a: Column, b: Column, scale: str) -> Column:
    """Whole calendar units from b to a, both truncated."""
    x, y = bucket(a, scale), bucket(b, scale)
    seconds = (F.unix_micros(x) - F.unix_micros(y)) / 1e6
    return {
        "hourly": lambda: seconds / 3600, "daily": lambda: F.datediff(x, y).cast("double"), "weekly": lambda: F.datediff(x, y) / 7,
        "monthly": lambda: F.months_between(x, y), "yearly": lambda: (F.year(x) - F.year(y)).cast("double"),
    }[scale]()


def rfm(df: DataFrame, customer: str, at: str, amount: str, as_of, groups: int = 5, scale: str = "daily") -> DataFrame:
    """Scores from 1 to ``groups`` for recency, frequency (distinct time buckets) and money, and their sum.

    Thresholds are exact percentiles over the customers, a few numbers. ``as_of`` is the day from which recency counts. Rows whose date
    can't be read are left out.
    """
    if groups < 2:
        raise ValueError("two groups at least")
    when = F.col(at).try_cast("timestamp")
    rows = df.filter(when.isNotNull())
    now = F.lit(as_of).cast("timestamp")
    each = rows.groupBy(F.col(customer).alias("customer")).agg(
        units_between(now, F.max(when), scale).alias("recency"), F.count_distinct(bucket(when, scale)).cast("double").alias("frequency"), F.sum(F.col(amount).cast("double")).alias("monetary")
    )
    each = ordering.checkpointed(each)
    shares = [i / groups for i in range(1, groups)]
    cuts = {c: list(q.values()) for c, q in quantiles_of(each, ["recency", "frequency", "monetary"], shares).items()}
    limits = each.sparkSession.range(1).select(*[F.array(*[F.lit(v).cast("double") for v in cuts[c]]).alias(f"__{c}") for c in cuts])
    passed = lambda c, test: F.size(F.filter(F.col(f"__{c}"), lambda t: test(F.col(c), t))) + 1
    scored = each.crossJoin(F.broadcast(limits)).select(
        "customer", passed("recency", lambda v, t: v <= t).alias("r_score"), passed("frequency", lambda v, t: v > t).alias("f_score"), passed("monetary", lambda v, t: v > t).alias("m_score")
    )
    return scored.withColumn("rfm_score", F.col("r_score") + F.col("f_score") + F.col("m_score"))


def customer_activity_index(df: DataFrame, customer: str, at: str, scale: str = "daily") -> DataFrame:
    """Mean interval between purchases (mle), the mean weighted towards recent ones (wmle), and (mle - wmle) / mle in percent.

    The latest date of all customers with three rows or more ends everyone's
    sequence; customers with fewer than four points are left out, and so are
    intervals of zero.
    """
    when = F.col(at).try_cast("timestamp")
    rows = df.select(F.col(customer).alias("customer"), when.alias("at")).filter("at is not null")
    known = rows.groupBy("customer").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last")).filter("n >= 3")
    latest = known.agg(F.max("last").alias("latest"))
    ends = known.select("customer").crossJoin(F.broadcast(latest)).select("customer", F.col("latest").alias("at"))
    points = rows.join(known.select("customer"), "customer").unionByName(ends)
    w = W.partitionBy("customer").orderBy("at")
    gaps = points.withColumn("gap", units_between(F.col("at"), F.lag("at").over(w), scale)).filter("gap > 0")
    gaps = gaps.withColumn("k", F.row_number().over(w)).groupBy("customer").agg(F.avg("gap").alias("mle"), (F.sum(F.col("gap") * F.col("k")) / F.sum("k")).alias("wmle"))
    return gaps.select("customer", "mle", "wmle", ((F.col("mle") - F.col("wmle")) / F.col("mle") * 100).alias("cai"))


def basket(df: DataFrame, order: str, item: str, max_items: int = 5000) -> DataFrame:
    """(item_a, item_b, n, support, confidence, lift) of items bought together; an item with itself included.

    An order is a set. Each order's sorted set gives its pairs once, the other
    way round is added after counting, and an item with itself is its own count.
    An order holds ``max_items`` different items at most, as there are no more.
    """
    d = df.filter(F.col(order).isNotNull() & F.col(item).isNotNull() & (F.col(order).cast("string") != "") & (F.col(item).cast("string") != "")).select(F.col(order).alias("o"), F.col(item).alias("i")).distinct()
    singles = d.groupBy("i").agg(F.count(F.lit(1)).alias("c"))
    if singles.limit(max_items + 1).count() > max_items:
        raise ValueError(f"more than {max_items} items; take groups of items")
    orders = d.agg(F.count_distinct("o").alias("orders"))
    sets = d.groupBy("o").agg(F.array_sort(F.collect_list("i")).alias("s")).filter(F.size("s") > 1)
    above = sets.select(F.posexplode("s").alias("at", "item_a"), "s").select("item_a", F.explode(F.slice("s", F.col("at") + 2, F.size("s"))).alias("item_b")).groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("n"))
    pairs = above.unionByName(above.select(F.col("item_b").alias("item_a"), F.col("item_a").alias("item_b"), "n")).unionByName(singles.select(F.col("i").alias("item_a"), F.col("i").alias("item_b"), F.col("c").alias("n")))
    out = pairs.join(singles.select(F.col("i").alias("item_a"), F.col("c").alias("ca")), "item_a").join(singles.select(F.col("i").alias("item_b"), F.col("c").alias("cb")), "item_b").crossJoin(F.broadcast(orders))
    support = F.col("n") / F.col("orders")
    return out.select("item_a", "item_b", "n", support.alias("support"), (F.col("n") / F.col("ca")).alias("confidence"), (support / (F.col("ca") / F.col("orders") * (F.col("cb") / F.col("orders")))).alias("lift"))
