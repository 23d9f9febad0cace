"""From documents to packed training sequences: filter, deduplicate, mix, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterfold.llm.common import durable, table
from rasterfold.llm.exact import without_copies
from rasterfold.llm.mixing import mixed
from rasterfold.llm.packing import pack
from rasterfold.llm.quality import accepted
from rasterfold.llm.registry import TOKENIZER
from rasterfold.llm.simhash import one_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking by the table's labels accepts.

    Null texts count as empty and are scored so; null ids are scored too, but nothing is learnt of
    them; texts of any length are read whole; rows that repeat stay or go together; an empty table
    gives none; columns beyond those of documents stay as they are.
    """
    return accepted(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space: the longest, then the smallest doc_id.

    Null and empty texts are one group; a null id comes last; of rows that repeat one stays; an
    empty table gives none; texts of any length are compared whole; other columns stay.
    """
    return without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: the smallest doc_id, a null one only where no other is.

    Texts without words, null ones too, are near each other; of rows that repeat an id the longest
    stays; an empty table gives none; texts of any length are read whole; other columns stay.
    """
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, a row for each time that a document is taken.

    Null texts and those without words give no rows; null sources are one source; documents with
    null ids are mixed too, rows that repeat each by itself; only the text that ends a source's
    share is cut (by words), and n_chars follows; an empty table gives none; other columns stay.
    """
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences.

    Null and empty texts are their end mark alone; null ids stay null; rows that repeat are packed
    each; longer texts are cut into pieces, none is dropped; an empty table gives none; other
    columns have no part in it.
    """
    return pack(docs, TOKENIZER)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]
#: A trained classifier and a tokenizer are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each one's rows written before the next begins."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
