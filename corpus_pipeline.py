"""The corpus pipeline: documents that pass quality rules, each once, without their
secrets, packed into sequences.

Each stage gets all rows that its predecessor kept and returns the columns of
``documents``, but for the last, which returns the packed pieces. Stages are
written and reread in the shared folder, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventloom.llm import exact, packing, quality, secrets, simhash
from eventloom.llm.common import collect_garbage, load, recorded, release, written
from eventloom.llm.entries import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Intermediate tables of a run's stages so far, by its folder.
_MADE: dict[str, list[str]] = {}


def _stage(operator: Callable[[DataFrame], DataFrame], spark: SparkSession, docs: DataFrame, sf_dir: str, first: bool = False) -> DataFrame:
    """The operator on ``docs``. What earlier stages of the run left behind has been
    written by now and is deleted, but for what ``docs`` itself may still read; so is
    the garbage on the executors' heaps."""
    made = [] if first else _MADE.get(sf_dir, [])
    release(spark, made, docs)
    collect_garbage(spark)
    _MADE[sf_dir] = made
    with recorded(made):
        return operator(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are outliers of their language and source go.

    Null, empty and blank texts fail. Repeated rows and ties share a verdict; null
    languages and sources are groups of their own; whole texts count, however long; an
    empty table stays empty; all columns of ``docs`` are kept, whatever their names."""
    return _stage(quality.keep, spark, docs, sf_dir, first=True)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays.

    Null texts equal empty ones; null doc_ids are below all others; of repeated rows any
    one stays; an empty table stays empty; all columns are kept, whatever their names."""
    return _stage(exact.deduplicate, spark, docs, sf_dir)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the one with the smallest doc_id stays: texts that share
    0.8 or more of their five-word shingles, and what they reach.

    Null, empty and blank texts have no words and are copies of each other; texts of fewer
    than five words are one shingle; null doc_ids are above all others, and of repeated
    rows one stays; an empty table stays empty; all columns are kept, whatever their names."""
    return _stage(simhash.deduplicate, spark, docs, sf_dir)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by marks; all documents stay.

    A null text stays null; overlapping secrets get one mark; repeated rows are each
    redacted; an empty table stays empty; all columns are kept, whatever their names."""
    return _stage(secrets.redact, spark, docs, sf_dir)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 4096 tokens.

    A null or empty text is a piece of the end id alone; longer documents are cut;
    repeated rows are each packed, and ties go in any order; an empty table gives no
    pieces; columns beside the id and the text are not read."""
    return _stage(lambda d: packing.pack_documents(d, vocabulary("word_bpe_49k.json"), end=1), spark, docs, sf_dir)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: The outliers' robust estimates and the packing have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
