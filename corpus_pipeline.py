"""Documents to training sequences: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's result
as Parquet in the shared folder and reads it again as the next one's docs. All but the last return
the columns of documents, with n_chars as the text now has them; further columns of the input, whatever their names, are dropped by
the first stage. An empty table stays empty at each stage, without training rows too. Texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import decontaminate, linededup, packing, simhash, toxicity
from tallyforge.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from all labels. Null and empty texts are scored like any other, rows without an id too; repeated rows alike, and a score at the cut goes."""
    docs = docs.select(*COLUMNS)
    net = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, net, name="_score").where(F.col("_score") < toxicity.CUT).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines that an earlier document has go. Null text stays null, empty text empty; of equal chunks (a tie) the first place of the least id keeps its own."""
    return linededup.dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the least: groups of SimHash fingerprints, to which an exact comparison of shingles adds. Documents without words are one group; rows without an id stay; rows of one id stay or go together."""
    return simhash.keep_one(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null texts, texts without words and rows without an id stay; items without words find nothing; rows of one id go together."""
    docs = docs.select(*COLUMNS)
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0").select(F.col("doc_id").alias("_hit")).distinct()
    return docs.join(found, F.col("doc_id") == F.col("_hit"), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens. Null and empty texts are one token, their end; each repeated row is packed for itself."""
    return packing.pack_documents(docs, packing.vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]
#: SQL can't express a trained network or a tokeniser.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
