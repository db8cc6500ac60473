"""A training-data pipeline over ``documents``, stage by stage.

Each stage reads what its predecessor wrote and all of it:

1. toxicity: documents that the clause grammar scores at 0.3 or more go.
2. near duplicates: of each group of near copies the document with the smallest
   id stays.
3. secrets: every secret is replaced by a mark; the documents stay.
4. mixing: documents are repeated (up to three times) or left out so that
   sources come near their target weights.
5. packing: token windows of 2048, one row per piece.

All but the last return the columns of ``documents``, further columns included,
whatever their names. Rows with null texts or ids pass through where a stage has
no reason to drop them: they are not toxic, near copies of nothing, hold no
secrets, and have no words for the mix to take. Empty texts do the same, and
very long ones are worked on whole. A repeated row is a copy under the same id:
near-copy removal compares ids, so all rows of the id that stays do stay. Of
texts that tie, the smallest id stays. Empty tables pass through every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import toxicity
from quillmesh.llm._shared import shared_dir, table
from quillmesh.llm._tokens import default_vocabulary
from quillmesh.llm.jaccard_join import near_duplicates
from quillmesh.llm.mixing import mix_sources
from quillmesh.llm.packing import pack
from quillmesh.llm.secret_scan import redact


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    # whole rows pass through the scorer, so documents need not be joined to scores
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    scored = toxicity.score(rows, model, keep=("row",), text_col="row.text")
    return scored.filter("predicted = 0").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = near_duplicates(docs, shingle=5, percent=80)
    copies = found.filter("component_id < doc_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def mark_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = redact(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", "text")
    mixed = mix_sources(rows).filter("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, default_vocabulary("byte_bpe_50k.json"), window=2048, end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("secrets", mark_secrets),
    ("mixing", mix_to_targets),
    ("packing", pack_windows),
]

#: SQL can say neither the grammar's scores nor the tokens; tests hold the stages
#: against plain Python on small inputs instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
