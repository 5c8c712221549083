"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next stage's docs.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import language_id, mixing, near_dup, packing, pii
from graphloom.llm.common import checkpoint_dir, table
from graphloom.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Share of the predicted language from which it replaces a given one.
SURE = 0.99


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets the language the model finds; documents of no language go.

    The model is fitted on the documents that carry a lang.  Its prediction fills in a lang that is missing, and
    replaces one that is there where it is ``SURE`` at least.  Rejected are texts that are null or without a
    letter, for which no prediction is made.  Rows are judged one by one, so null or repeated ids and very
    long texts change nothing; without any known lang no document can be told and all go.
    """
    docs = docs.select(*COLUMNS)
    told = language_id.predict(docs, language_id.fit(docs), keep=COLUMNS).where("lang_pred <> 'und'")
    known = F.when(F.col("score") < SURE, F.col("lang"))
    return told.withColumn("lang", F.coalesce(known, "lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id; documents without an id stay.

    Rows are one document only where doc_id and text are equal: texts that share a doc_id are compared like
    any others.  Two 64-bit hashes of both tell rows apart, one of them as the operator's key.
    """
    docs = docs.select(*COLUMNS)
    keyed = docs.where("doc_id is not null").withColumn("_row", F.xxhash64("doc_id", "text")).withColumn("_more", F.xxhash64(F.lit(7), "text", "doc_id"))
    group = near_dup.near_duplicates(keyed, key="_row", k=5, percent=80).select("_row", "component_id").distinct()
    ids = keyed.groupBy("_row").agg(F.min("doc_id").alias("doc_id"))
    stay = group.join(ids, "_row").groupBy("component_id").agg(F.min(F.struct("doc_id", "_row"))["_row"].alias("_row")).select("_row")
    kept = keyed.join(stay, "_row", "left_semi").dropDuplicates(["_row", "_more"])
    return kept.select(*COLUMNS).union(docs.where("doc_id is null").select(*COLUMNS))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span becomes its kind in brackets; n_chars follows.

    No row is dropped.  A null text counts as empty; ids are only carried along.
    """
    docs = docs.select(*COLUMNS)
    rest = tuple(c for c in COLUMNS if c not in ("text", "n_chars"))
    found = pii.find(docs, pii.fit(docs), keep=rest)
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stands as often as the mix takes it; only whole documents are taken.

    Rows that share a doc_id, or have none, are documents of their own.  Two 64-bit hashes of all columns stand
    for a row, so texts do not pass through the mix; equal rows get their copies together.  Documents
    without words add nothing to a mix and go; an empty table stays empty.
    """
    whole = [*COLUMNS, *[F.isnull(c) for c in COLUMNS]]
    docs = docs.select(*COLUMNS).withColumn("_row", F.xxhash64(*whole)).withColumn("_more", F.xxhash64(F.lit(7), *reversed(whole)))
    taken = mixing.mix(docs, table(spark, sf_dir, "labels"), boundary="nearest", keep=("_row", "_more"))
    times = taken.where("size > 0 and taken > 0").groupBy("_row", "_more").agg(F.expr("cast(sum(taken div size) as int)").alias("times"))
    mixed = docs.dropDuplicates(["_row", "_more"]).join(times, ["_row", "_more"])
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens, as ``packing.pack`` returns them.

    A row that stands several times is packed as often; null texts count as empty, ids are only carried along.
    """
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Fitted models, sketches and tokenizers cannot be written in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what lies between them is written under the shared checkpoint folder."""
    at = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs
