"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the query contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; every other code point stays."""
    return F.translate(text, UPPER, LOWER)


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    ``spark.checkpoint.dir`` names it on a cluster. Only a local session without
    one takes a temporary folder of this machine; on a cluster that would be lost
    with it, so there it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Rows of an Arrow batch that carries whole texts, at most. Texts run to thousands of characters, so the default of 10,000 rows can be tens to hundreds of MB.
TEXT_ROWS = 500


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches kept small enough for rows with texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(key, "10000"))
    if now <= 0 or now > TEXT_ROWS:
        df.sparkSession.conf.set(key, str(TEXT_ROWS))
    return df


def fresh(name: str) -> str:
    """A column name that no input column can clash with."""
    return f"__{name}_{uuid.uuid4().hex[:8]}"


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", small: bool = False) -> DataFrame:
    """Equi-join on ``keys`` where null equals null; the keys appear once, from the left."""
    renamed = {k: fresh(k) for k in keys}
    right = right.withColumnsRenamed(renamed)
    right = F.broadcast(right) if small else right
    on = [left[k].eqNullSafe(right[v]) for k, v in renamed.items()]
    return left.join(right, on, how).drop(*renamed.values())
