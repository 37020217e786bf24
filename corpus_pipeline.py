"""A training corpus from documents: five of the operators one after the other, each stage written as
Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kalendarium.llm import catalog, decontamination, mixing, simhash_groups, token_store, toxic_neighbours
from kalendarium.llm.common import KEY, keyed, run_folder, small_batches, stored
from kalendarium.session import prepare

#: learned models, fingerprints and a knapsack have no SQL form; tests compare with brute force
ORACLE_SQL = None


def _first_of_key(rows: DataFrame, *more: str) -> DataFrame:
    """One of rows that agree in doc_id and text (and ``more``)."""
    again = F.row_number().over(W.partitionBy(*KEY, *more).orderBy(F.lit(0)))
    return rows.withColumn("__corpus_again", again).filter("__corpus_again = 1").drop("__corpus_again")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the labelled neighbours call toxic go; rows and columns stay as they are."""
    prepare(spark)
    return toxic_neighbours.keep_clean(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: the smallest doc_id (missing ids last), of equal ids the
    smallest text hash, of equal rows one."""
    prepare(spark)
    groups = simhash_groups.simhash_groups(docs)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    kept = keyed(groups.groupBy("root").agg(least.alias("l")).select("l.doc_id", "l.text_hash"), F.col("text_hash")).select(*KEY)
    return _first_of_key(keyed(docs).join(kept, KEY, "left_semi")).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage similar to a benchmark item go."""
    prepare(spark)
    leaks = decontamination.find_leaks(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))
    bad = stored(keyed(leaks, F.col("text_hash")).select(*KEY).distinct(), f"{run_folder(spark, 'leaking')}/keys")
    return keyed(docs).join(bad, KEY, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (up to three times, or not at all)."""
    prepare(spark)
    small_batches(spark)
    source = F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit("-"))
    taken = keyed(mixing.mix(docs), F.col("text_hash")).withColumn("__corpus_source", source).groupBy(*KEY, "__corpus_source").agg(F.sum("epochs").alias("__corpus_times")).filter("__corpus_times > 0")
    rows = _first_of_key(keyed(docs).withColumn("__corpus_source", source).join(taken, [*KEY, "__corpus_source"]), "__corpus_source")
    return rows.withColumn("__corpus_copy", F.explode(F.sequence(F.lit(1), F.col("__corpus_times").cast("int")))).select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token file and returns its documents: doc_id, start, n_tokens, ids_crc32."""
    prepare(spark)
    path = run_folder(spark, "corpus-tokens")
    token_store.write_tokens(docs, path, catalog.tokenizer_path(), end_id=2)
    return token_store.read_tokens(spark, path)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix_sources),
    ("token_output", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = run_folder(spark, "corpus")
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
