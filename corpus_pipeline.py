"""A training corpus from ``documents`` in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.

1. toxicity: documents whose score reaches their language's threshold go.
2. line_dedup: lines on more than ``LINE_SHARE`` of a source's documents, and on
   five at least, are cut. A document made of such lines alone is left to the
   next stage.
3. simhash: one document of each near-duplicate group stays (3-word shingles,
   3 bits); then documents go whose 5-word shingles are at a similarity of 0.8
   or more with one that stays, in the order of ids.
4. decontamination: words inside benchmark phrases are cut.
5. mixing: documents as often as the mix of sources takes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontam, line_dedup, mixing, simhash, toxicity
from millrace.llm.common import table, written

#: Share of a source's documents above which a line is boilerplate. A source is no site with one layout, as the hosts of pages are: its documents share less.
LINE_SHARE = 0.05
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _whole(docs: DataFrame, before: DataFrame) -> DataFrame:
    """The columns of ``before``, with n_chars as the text now is."""
    return docs.withColumn("n_chars", F.length("text").cast(before.schema["n_chars"].dataType)).select(before.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter(~F.col("rejected")).select(docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _whole(line_dedup.dedup_lines(docs, "source", "text", LINE_SHARE, keep_whole=True), docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_similar(written(simhash.dedup(docs), "simhash"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _whole(decontam.cut_spans(docs, table(spark, sf_dir, "benchmark")), docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash", simhash_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained classifier and connected components have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None
