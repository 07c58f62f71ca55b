"""From raw documents to packed training sequences, in stages that hand on written tables.

Each stage takes (spark, docs, folder of tables) and returns a DataFrame, which is written and
read again as the next stage's docs. A stage's statistics cover all that its predecessor kept.

The tables that a stage makes on its way go when the next stage begins, but for those that its
docs read, so they never add up. So a stage's rows are to be written before the next is called.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from parley.llm import near_dedup, packing, quality, substring_dedup, toxicity
from parley.llm.common import table, written
from parley.session import drop_folder, new_folders

#: Rows of an Arrow batch. Texts are whole, so a batch of the usual 10,000 takes much memory beside the heap.
BATCH_ROWS = 1000
#: Folders that stages have left, by application.
LEFT: dict[str, list[str]] = {}


def light(stage):
    """A stage whose tasks hand few texts at a time to Python, and which leaves no tables beyond the next."""

    @wraps(stage)
    def run_light(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
        release(spark, docs)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        with new_folders() as made:
            try:
                return stage(spark, docs, folder)
            finally:
                LEFT.setdefault(spark.sparkContext.applicationId, []).extend(made)

    return run_light


def release(spark: SparkSession, docs: DataFrame) -> None:
    """Drops what earlier stages have left, but for the folders that ``docs`` still reads."""
    left = LEFT.pop(spark.sparkContext.applicationId, [])
    read = {part for file in docs.inputFiles() for part in file.split("/")} if left else set()
    for folder in left:
        if folder.rsplit("/", 1)[1] in read:
            LEFT.setdefault(spark.sparkContext.applicationId, []).append(folder)
        else:
            drop_folder(spark, folder)


@light
def quality_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose quality is accepted."""
    return quality.accepted(docs, table(spark, folder, "labels"))


@light
def toxicity_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that are not scored as toxic."""
    return toxicity.accepted(docs, table(spark, folder, "labels"))


@light
def near_dedup_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near duplicates, from a similarity of 0.80 on."""
    return near_dedup.deduplicated(docs, near_dedup.STAGE_PERCENT, near_dedup.STAGE_BANDS, near_dedup.STAGE_ROWS)


@light
def substring_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, without the words of passages that also stand elsewhere."""
    return substring_dedup.without_repeats(docs)


@light
def packing_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of all documents with their places in sequences, and their ids."""
    return packing.packed(docs, with_ids=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("minhash near-dedup", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("packing", packing_stage),
]

#: The learned stages and the tokenizer cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        kept = stage(spark, docs, sf_dir)
        with new_folders() as made:
            docs = written(kept, name.replace(" ", "-"))
        LEFT.setdefault(spark.sparkContext.applicationId, []).extend(made)
        release(spark, docs)
    LEFT.pop(spark.sparkContext.applicationId, None)  # the result is the caller's
    return docs
