"""The paired rank test doesn't depend on the order in which rows are added up."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace.functions import statistics as S
from millrace.plans import queries


def test_suppliers_of_the_same_rows_rank_alike(spark, tmp_path):
    n, rng = 40, np.random.default_rng(1)
    lines, quantities = np.tile(np.arange(1, 8), 10), np.array([26.0] * 42 + [25.0] * 28)
    order = [rng.permutation(70) for _ in range(n)]
    pq.write_table(pa.table({
        "l_suppkey": pa.array(np.repeat(np.arange(n), 70), pa.int64()),
        "l_linenumber": pa.array(np.concatenate([lines[o] for o in order]), pa.int32()),
        "l_quantity": np.concatenate([quantities[o] for o in order]),
    }), tmp_path / "lineitem.parquet")
    d = math.fsum(quantities) / 70 - math.fsum(lines * 6.4) / 70
    got = queries.QUERIES["wilcoxon_paired"](spark, str(tmp_path)).first().v
    assert abs(d) < 1e-14 and got == (n * (n + 1) / 2 if d > 0 else 0)


def test_exact_mean(spark):
    x = [*(np.arange(1, 500) * 6.4).tolist(), -3.3, 1e-3, None, float("nan")]
    kept = [v for v in x if v is not None and not math.isnan(v)]
    rng = np.random.default_rng(3)
    rows = [(g, x[i]) for g in range(6) for i in rng.permutation(len(x))]
    df = spark.createDataFrame(rows, "g int, x double").repartition(5)
    got = df.groupBy("g").agg(S.exact_mean("x").alias("m")).collect()
    assert len({r.m for r in got}) == 1 and got[0].m == pytest.approx(math.fsum(kept) / len(kept), rel=1e-15)
    assert spark.range(1).select(F.lit(None).cast("double").alias("x")).agg(S.exact_mean("x")).first()[0] is None
    assert spark.createDataFrame([(float("inf"),), (1.0,)], "x double").agg(S.exact_mean("x")).first()[0] == math.inf
