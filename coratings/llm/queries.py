"""The registered queries of this package: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from coratings.llm.alignment import alignment
from coratings.llm.decontamination import contamination
from coratings.llm.licenses import license_scan, license_sql
from coratings.llm.merkle import merkle_manifest, merkle_sql
from coratings.llm.near_duplicates import near_duplicates
from coratings.llm.repeated_text import repeated_text
from coratings.llm.rules import COUNTS, quality_rules
from coratings.llm.token_files import token_files
from coratings.llm.toxicity import toxicity
from coratings.llm.urls import rule_list, url_verdicts, verdict_sql
from coratings.llm.warc import archived
from coratings.llm.packing import packed
from coratings.llm.quality import quality


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_table(spark, sf_dir, "documents"), percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op2_repeated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_text(_table(spark, sf_dir, "documents"), length=200)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), folds=3, held_out_fold=1)
    return found.select("doc_id", "held_out", "score", "predicted")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), size=10, slop=2)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A public vocabulary file, installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_tokenizer_path() -> str:
    return tokenizer_path("byte_bpe_50k.json")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(_table(spark, sf_dir, "pages"), least=0)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"), tokenizer_path(), longest=2048)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), folds=4, held_out_fold=2)
    return found.select("doc_id", "held_out", "score", "predicted")


URL_RULES = rule_list("allow com/, block example.com/en/, allow www.example.com/en/, block net/es/, block net/fr/")


def op8_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_verdicts(_table(spark, sf_dir, "pages"), URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(_table(spark, sf_dir, "documents"), byte_tokenizer_path())


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(_table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(_table(spark, sf_dir, "documents"), byte_tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_repeated_text": op2_repeated_text,
    "op3_toxicity": op3_toxicity,
    "op4_decontamination": op4_decontamination,
    "op5_warc": op5_warc,
    "op6_packing": op6_packing,
    "op7_quality": op7_quality,
    "op8_url_verdicts": op8_url_verdicts,
    "op9_license_scan": op9_license_scan,
    "op10_quality_rules": op10_quality_rules,
    "op11_token_files": op11_token_files,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_alignment": op13_alignment,
}
ORACLES: dict[str, str] = {
    "op8_url_verdicts": verdict_sql(URL_RULES),
    "op9_license_scan": license_sql(),
    "op12_merkle_manifest": merkle_sql(),
}
