"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterfold.llm.ann import nearest
from rasterfold.llm.common import table
from rasterfold.llm.exact import EXACT_SQL, exact_groups
from rasterfold.llm.licenses import find_licenses
from rasterfold.llm.mixing import MIX_SQL, mix
from rasterfold.llm.packing import pack
from rasterfold.llm.pii import PII_SQL, pii_report
from rasterfold.llm.quality import classify
from rasterfold.llm.resampling import RESAMPLE_SQL, resample
from rasterfold.llm.secrets import scan_secrets, train_forest
from rasterfold.llm.simhash import near_duplicates
from rasterfold.llm.substrings import repeated_passages
from rasterfold.llm.toxicity import toxicity
from rasterfold.llm.trie import TRIE_SQL, prefix_trie

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_licenses(table(spark, sf_dir, "documents"))
    span = F.transform("notices", lambda x: F.concat_ws(":", x["label"], x["start"].cast("string"), x["end"].cast("string"), x["edits"].cast("string")))
    return found.withColumn("notices", F.array_join(span, ","))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.coalesce(F.get("parts", F.lit(0))["shard"], F.lit(-1)).alias("first_shard"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"), train_forest(spark, vocabulary=TOKENIZER), vocabulary=TOKENIZER)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumn("offending", F.array_join(F.transform("offending", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ","))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest": op1_nearest,
    "op2_licenses": op2_licenses,
    "op3_simhash": op3_simhash,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_pii": op5_pii,
    "op6_quality": op6_quality,
    "op7_mixing": op7_mixing,
    "op8_packing": op8_packing,
    "op9_repeats": op9_repeats,
    "op10_secrets": op10_secrets,
    "op11_toxicity": op11_toxicity,
    "op12_resampling": op12_resampling,
    "op13_trie": op13_trie,
}
SQL: dict[str, str] = {"op4_exact_dedup": EXACT_SQL, "op5_pii": PII_SQL, "op7_mixing": MIX_SQL, "op12_resampling": RESAMPLE_SQL, "op13_trie": TRIE_SQL}
