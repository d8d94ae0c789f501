"""A training corpus from raw documents: quality rules, near duplicates, secrets, mixture, packed windows.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run writes each
result as Parquet in the shared folder and gives it to the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import jaccard, mixing, packing, rules, secrets
from lodestone.llm.shared import drop_tables, stored, tables_made

#: Shares of the mixture, over a corpus that grows by a fifth. Domains that earlier stages leave no labelled text of drop out,
#: and the others take their shares in proportion; a document that is clean rather than not has one copy at least.
TARGETS, GROWTH = {"clean": 0.80, "poor": 0.12, "toxic": 0.08}, 1.2


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or whose lines are mostly boilerplate, go."""
    return rules.keep(docs, rules.train(docs, rules.labels_of(spark, sf_dir)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: the smallest by id, nulls last, then by text."""
    return jaccard.first_of_groups(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows the text."""
    out = secrets.redact(docs)
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(length))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple[DataFrame, mixing.DomainModel]:
    """(documents as `_row` with their copies towards TARGETS, the model with target and reached shares)."""
    labelled = mixing.domains_of_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.mix(docs, labelled, TARGETS, total=GROWTH, keep="clean", nested=True)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document in as many copies as its rate towards TARGETS gives; none of a domain over its target is possible."""
    rows, _ = mixed(spark, docs, sf_dir)
    return rows.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 tokens: one row for each piece."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("secret scan", secret_scan),
    ("mixture", mixture),
    ("packing", packed),
]

#: The stages fit models and follow chains of links: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents of sf_dir, through all stages.

    Once a stage's result is written, what this run wrote before it goes; the
    tables behind the last stage's result stay, as it is read when it is used.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (name, stage) in enumerate(STAGES):
        with tables_made() as made:
            docs = stage(spark, docs, sf_dir)
            if i < len(STAGES) - 1:
                docs = stored(docs, f"stage-{i}")
                drop_tables(spark, before + made[:-1])
                before = made[-1:]
    return docs
