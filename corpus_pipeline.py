"""From documents to token ids: the stages of a training corpus, each written as Parquet and read again.

Every stage works on all rows that the one before kept and returns the columns of documents; the last one returns ids.
Columns besides doc_id, text, source and n_chars may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelltrail.llm import bpe, jaccard, mixing, quality, repeats
from shelltrail.llm.common import fold, settled, shielded, table
from shelltrail.llm.queries import HELD_OUT_QUALITY


def _counted(docs: DataFrame) -> DataFrame:
    """`n_chars`, where there is one, of the texts as they are now."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It learns from labels of the rows that op5 learns from."""
    model = quality.quality_model(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != HELD_OUT_QUALITY)
    return shielded(docs, ("doc_id", "text"), lambda inner: quality.score(inner, model).filter("_predicted = 1"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar shingles the one with the smallest id stays.

    Rows that share an id are one document and stay or go together; rows without an id, and those without words, stay.
    """
    found = jaccard.similarity_components(docs)
    kept = found.filter("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()

    def chosen(inner: DataFrame) -> DataFrame:
        named = inner.join(kept, F.col("doc_id") == F.col("_kept"), "left_semi")
        return named.union(inner.filter(F.col("doc_id").isNull()))

    return shielded(docs, ("doc_id",), chosen)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur more than once are cut out of the texts, all of their occurrences."""
    return _counted(repeats.without_repeats(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in code-point order weigh 1, 2 and 3 in turn; none is repeated more than three times."""
    return _counted(mixing.mix(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and digests per row of the mixture."""
    return bpe.encode_documents(docs, bpe.vocabulary("byte_bpe_50k.tiktoken"), keep_ids=True)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("repeats", cut_repeats),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: A model's scores, and with them the rows that are left, cannot be stated in SQL; tests/llm/test_pipeline.py holds each
#: stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    def after(n: int) -> DataFrame:
        """The written output of the first n stages. What a stage has read goes when its output is written."""
        if not n:
            return table(spark, sf_dir, "documents")
        name, stage = STAGES[n - 1]
        return settled(spark, f"pipeline-{name}", lambda: stage(spark, after(n - 1), sf_dir))

    # The last stage's input stays: its rows are read when those of the result are.
    return STAGES[-1][1](spark, after(len(STAGES) - 1), sf_dir)
