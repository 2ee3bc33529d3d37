"""A corpus pipeline of five operators: language ID, toxicity, exact and near deduplication, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the columns
of documents. The two deduplication stages number the rows, so each row has its own decision, whether its doc_id is
null, repeats, or stands for several texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import exact_dedup, language_id, near_dedup, packing, queries, toxicity
from folioscope.llm.common import fold, small_batches, stored


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is found go."""
    small_batches(spark)
    model = language_id.train_language_model(docs.where(fold("doc_id", 4) != 2))
    return language_id.keep_identified(docs, model)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches 0.7 go."""
    labels = queries.table(spark, sf_dir, "labels")
    lexicon = toxicity.train_lexicon(stored(toxicity.training_rows(docs, labels), "labelled"))
    return toxicity.keep_civil(docs, lexicon)


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a number _row of each row: its place in the stored table, so every scan numbers alike."""
    return (docs if docs.inputFiles() else stored(docs, "docs")).withColumn("_row", F.monotonically_increasing_id())


def staying(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Of each group (doc_id, a row number; member_of) the row with the smallest doc_id, null ids last; without the numbers."""
    ids = rows.select("_row", F.col("doc_id").cast("long").alias("id"))
    several = groups.groupBy("member_of").agg(F.count("*").alias("n")).where("n > 1").select("member_of")
    members = stored(groups.select(F.col("doc_id").alias("_row"), "member_of").hint("merge").join(several, "member_of").join(ids, "_row"), "members")
    first = members.groupBy("member_of").agg(F.min(F.struct(F.col("id").isNull(), "id", "_row")).alias("first")).select(F.col("first._row").alias("_row"))
    dropped = stored(members.select("_row").join(first, "_row", "left_anti").select(F.col("_row").alias("doc_id")), "dropped")
    return exact_dedup.without(rows, dropped, "_row").drop("_row")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows of equal text one with the smallest doc_id stays."""
    rows = numbered(docs)
    return staying(rows, exact_dedup.exact_groups(rows, id_col="_row").withColumnRenamed("keep_id", "member_of"))


#: Similarity of word shingles, in percent, from which the near stage links rows; op7's contract has its own.
NEAR_PERCENT = 80


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row with the smallest doc_id stays."""
    rows = numbered(docs)
    return staying(rows, near_dedup.near_groups(rows, id_col="_row", percent=NEAR_PERCENT).withColumnRenamed("component_id", "member_of"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids."""
    small_batches(spark)
    return packing.pack_documents(docs, queries.tokenizer("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("language", language_stage),
    ("toxicity", toxicity_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("packing", packing_stage),
]

#: No SQL expresses language ID, toxicity or packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, name)
    return docs
