"""The training corpus pipeline: stages over ``documents``, each written and read again.

Every stage takes all that the one before it kept. All but the last return the
columns of documents, further ones included; the last returns the packed pieces
with their ids. Rows without a doc_id or text go through all stages like any
other, rows that share a doc_id are told apart by their text, texts of any length
are read whole, and without rows every stage returns none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from coratings.llm.decontamination import contamination
from coratings.llm.near_duplicates import near_duplicates
from coratings.llm.packing import packed
from coratings.llm.quality import quality
from coratings.llm.queries import tokenizer_path
from coratings.llm.repeated_text import without_repeats
from coratings.llm.staging import cut, keep_by, sized
from coratings.plans.staging import release

KEYS = ("doc_id", "key_a", "key_b")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject: a score of the threshold itself stays. Null and empty texts
    are scored like any other; repeated rows share one verdict."""
    scored = quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return keep_by(docs, scored.select(*KEYS, (F.col("predicted") == 1).alias("keep")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates, once if its row is repeated.

    Near duplicates share 80 % of their five-word shingles here (the query of the operator alone asks for 85 %). Texts without words
    are nobody's duplicate and all stay, as do rows without a doc_id.
    """
    found = cut(near_duplicates(docs))
    kept = keep_by(docs, found.select(*KEYS, F.col("kept").alias("keep")))
    again = found.where("kept AND doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    again = cut(again.select(F.col("doc_id").alias("__again")))
    if again.isEmpty():
        return kept
    again = sized(again)
    repeated = kept.join(again, kept["doc_id"] == F.col("__again"), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, kept["doc_id"] == F.col("__again"), "left_anti").union(repeated)


def without_repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 200 bytes that occur twice, all of their places included; a text may be empty afterwards."""
    return without_repeats(docs, length=200)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs, also with up to two words between. Texts without words stay."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), slop=2)
    return keep_by(docs, found.select(*KEYS, (~F.col("contaminated") & (F.col("n_near") == 0)).alias("keep")))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids in sequences of powers of two, equal lengths one behind the other; an empty text is its end id."""
    return packed(docs, tokenizer_path(), longest=2048, with_ids=True)


STAGES = [
    ("quality classifier", good_documents),
    ("near duplicates", one_of_each_group),
    ("repeated text", without_repeated_text),
    ("decontamination", without_benchmarks),
    ("packing", sequences),
]

# SQL expresses neither the learned scores nor the groups; the tests compare
# the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = []
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        release(*before)
        before = [docs]
    packed_pieces = STAGES[-1][1](spark, docs, sf_dir)  # written, so what it was made from can go
    release(*before)
    return packed_pieces


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
