"""A training corpus in five stages, each one of the operators of ``freshet.llm``.

``STAGES`` holds (name, function) pairs. A function takes (spark, docs, sf_dir) and
returns a DataFrame, which ``run`` writes as Parquet and reads again as the next stage's
documents. All but the last return the columns of ``documents``:

1. language: documents without letters go, and those of which no language holds
   ``least_score`` of the words; where nothing could be learned (no labels), only the first;
2. near_dedup: one document of each group of near copies stays;
3. decontaminate: documents that hold a benchmark item go;
4. mix: documents are repeated or left out so that sources meet their target weights;
5. shard: every row gets its shard and slot, beside its columns.

Null texts have no letters and go in stage 1; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm import common, decontaminate, language_id, mixing, sharding, simhash

SHARDS = 40

#: SQL can express neither the trained model nor the hashes; tests hold stages against brute force.
ORACLE_SQL: str | None = None


def least_score(langs: int) -> float:
    """What the language of a document must reach: 1.4 times an even share, between 0.2 and 0.9."""
    return min(0.9, max(0.2, 1.4 / max(1, langs)))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.train(language_id.training_sample(docs))
    if not model.langs:
        return docs.where(F.rlike("text", F.lit(r"\p{L}")))
    marked = language_id.predict(docs.withColumn("_text", F.col("text")), model, "_text")
    return marked.where((F.col("lang_pred") != "und") & (F.col("score") >= least_score(len(model.langs)))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    carried = [c for c in docs.columns if c != "doc_id"]
    return sharding.shard_documents(docs, SHARDS, carry=carried)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontamination),
    ("mix", mix),
    ("shard", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir))
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
