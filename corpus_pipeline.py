"""Five stages from raw documents to token files.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns documents with the columns
of the table, the last one the token files' digest. ``run`` writes each stage's result as Parquet to the shared folder
and reads it again, so a lost executor never costs more than a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm._common import free_unused, scratch, table
from tidewatch.llm.decontaminate import Limits, contaminated, find_items
from tidewatch.llm.jaccard_join import jaccard_components
from tidewatch.llm.mixing import mix_rows
from tidewatch.llm.token_files import encode_documents
from tidewatch.llm.toxicity import fit_toxicity, score_toxicity


#: Of documents that stay, benchmark passages of more words than this are cut out.
LONGEST_PASSAGE = 50


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below one half. The models learn from the labelled rows among ``docs``.

    Rows without words have the score of no evidence, repeated rows one score; rows without an id are scored, not learnt from.
    """
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).where("score < 0.5").select(*docs.columns)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, the document with the smallest id; of repeated rows one. Rows without an id stay."""
    free_unused(spark)
    gone = jaccard_components(docs).where("id <> component_id").select(F.col("id").alias("gone"))
    left = docs.join(gone, F.col("doc_id") == F.col("gone"), "left_anti")
    return left.where("doc_id IS NULL").unionByName(left.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in a benchmark window, without passages longer than ``LONGEST_PASSAGE`` words.

    Rows without words stay; repeated rows share their fate. ``n_chars`` follows a text that was cut; all other rows stay as they are.
    """
    free_unused(spark)
    found = find_items(docs.withColumn("_before", F.length("text")), table(spark, sf_dir, "benchmark"), cut=Limits(words=LONGEST_PASSAGE))
    chars = F.when(F.length("text") < F.col("_before"), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.where(~contaminated()).withColumn("n_chars", chars).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Null sources are one source; rows without words follow their hash, repeated rows are taken alike."""
    free_unused(spark)
    return mix_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back. Texts that are null hold the end id only; null ids come last; repeated rows are documents each."""
    free_unused(spark)
    return encode_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix),
    ("token_files", tokens),
]
#: Language models, hash mixes and tokenizers have no SQL; tests compare the pipeline with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
