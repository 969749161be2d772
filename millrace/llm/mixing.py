"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Native: DataFrame operations only.

Every source has a weight and a size (its words). The mix wants
``share`` times all words, dealt to the sources by weight, but no source may be
read more than ``max_epochs`` times. Sources whose weighted share is above that
are clamped there and their excess goes to the others by weight, until nothing
is above. The level of that water-filling has a closed form over the sources
sorted by cap / weight, so one window over the small table of sources replaces
the repeated clamping.

A document of a source that is to be read r times is taken floor(r) times
whole; the remaining fraction of the source's words is filled from its
documents in a seeded random order: a document is added while its middle lies
below the fraction. That is one running sum per source. A source may hold a
third of all rows, so the sum has two levels: a source of n documents is cut
along the random order into about sqrt(n) buckets, each bucket is summed on its
own, and the bucket totals are summed over again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import WORD, checkpointed, fresh, null_safe_join, table

WEIGHTS = (5.0, 2.0, 1.0)

#: Sources up to this many rows (a few MB) are sent to every executor; more are joined by a shuffle.
BROADCAST_SOURCES = 50_000


def targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """``totals`` (source, source_size, n_docs) with weight and target added.

    Sources in code point order, null last, take the weights in turn. Works on
    the table of sources, one row each.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    every = W.partitionBy(F.lit(0))
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    t = totals.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn.cast("int")))
    t = t.withColumns({"cap": F.lit(float(max_epochs)) * F.col("source_size"), "budget": F.lit(float(share)) * F.sum("source_size").over(every)})
    order = W.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    t = t.withColumns({
        "at": F.row_number().over(order),
        "level": (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward),
    })
    free = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("at"))
    t = t.withColumn("level", F.min_by("level", free).over(every))
    capped = F.least("cap", F.col("level") * F.col("weight"))
    return t.withColumn("target", F.coalesce(capped, F.col("cap"))).select("source", "source_size", "n_docs", "weight", "target")


def mix(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", seed: int = 17, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, max_epochs: float = 2.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, size, source, source_size, weight, target, copies, taken, and the columns in ``keep``.

    Null text has size 0, and so has an empty one; such rows take nothing. A
    null source is a source of its own and comes last. Repeated rows are rows
    of their own. The random order is that of a hash of seed, id and text, so
    rows of one id, or without one, are spread like any others; rows that agree in
    id, source and text are interchangeable. Columns other
    than those named are not read, so their names don't matter. An empty table
    gives an empty table.
    """
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).cast("binary"))
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words.alias("size"), key.alias("__key"), *[F.col(c).alias(f"__keep_{c}") for c in keep])
    slim = checkpointed(slim)
    totals = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    aims = checkpointed(targets(totals, weights, share, max_epochs))
    few = aims.count() <= BROADCAST_SOURCES
    rows = null_safe_join(slim, aims, ["source"], small=few)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    place = F.conv(F.substring("__key", 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rows = rows.withColumns({"__ratio": ratio, "__bucket": F.floor(place * F.ceil(F.sqrt(F.col("n_docs").cast("double"))))})
    sums = rows.groupBy("source", "__bucket").agg(F.sum("size").alias("__in_bucket"))
    earlier = W.partitionBy("source").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("source", "__bucket", F.coalesce(F.sum("__in_bucket").over(earlier), F.lit(0)).alias("__before"))
    rows = null_safe_join(rows, sums, ["source", "__bucket"])
    inside = W.partitionBy("source", "__bucket").orderBy("__key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    middle = F.col("__before") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / F.lit(2.0)
    part = F.col("target") - F.floor("__ratio") * F.col("source_size")
    copies = (F.floor("__ratio") + F.when(middle <= part, 1).otherwise(0)).cast("int")
    out = rows.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0))
    return out.select("doc_id", "size", "source", "source_size", "weight", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *[F.col(f"__keep_{c}").alias(c) for c in keep])


def mixed(docs: DataFrame, **how) -> DataFrame:
    """``docs`` as the mix reads them: each row as often as it is taken, with the column ``copy`` counting from 1.

    Rows that agree in id, source and text are read together: as often in all as
    each of them is taken, as copies of one of them, the least in the order of the
    other columns that can be ordered. A column named ``copy`` is replaced.
    """
    same, key, from_source = fresh("same"), fresh("key"), fresh("source")
    source, text, doc_id = how.get("source", "source"), how.get("text", "text"), how.get("doc_id", "doc_id")
    taken = mix(docs.withColumn(same, F.xxhash64(text)), keep=(same,), **how)
    taken = taken.groupBy("doc_id", "source", same).agg(F.sum("copies").alias("copy")).filter("copy > 0").withColumnsRenamed({"doc_id": key, "source": from_source})
    own = [c for c in docs.columns if c != "copy"]
    found = docs.select(own).join(taken, docs[doc_id].eqNullSafe(F.col(key)) & docs[source].eqNullSafe(F.col(from_source)) & (F.xxhash64(docs[text]) == F.col(same)))
    settled = [c for c in own if c not in (doc_id, source, text) and not any(x in docs.schema[c].dataType.simpleString() for x in ("map<", "variant"))]
    first = F.row_number().over(W.partitionBy(doc_id, source, same).orderBy(*(settled or [F.lit(0)])))
    return found.withColumn(key, first).filter(F.col(key) == 1).select(*own, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copy"))).alias("copy"))


def query(spark, sf_dir):
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('17|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || md5(coalesce(text, ''))) AS k
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
    2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget
  FROM s
), l AS (
  SELECT *, row_number() OVER o AS place,
    (budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)
), t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT arg_min(lev, place) FROM l WHERE lev * weight <= cap), 1e300) * weight) AS target FROM l
), x AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS ratio,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0::DOUBLE AS mid
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, CAST(CASE WHEN size > 0 THEN floor(ratio) + CASE WHEN mid <= target - floor(ratio) * source_size THEN 1 ELSE 0 END ELSE 0 END AS INTEGER) AS copies FROM x
)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, copies FROM c
"""
