"""A training corpus from raw documents, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read as the next one's
docs. All stages but the last return the columns of documents.

Defined results: other columns stay, of any name, and an empty table gives an
empty result in every stage. Documents without an id are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.byte_bpe import encode, vocabulary_path
from tessera.llm.common import col, finished, fresh
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.mixing import mix
from tessera.llm.quality_rules import filter_quality
from tessera.llm.simhash import dedup_near


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; lines above the limits go from the others. A null text fails; repeated rows have one verdict."""
    return filter_quality(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in three documents or more stay in the one of the largest id. A null text stays null; no document goes; rows of one id lose the same lines."""
    return dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is alike to 0.8 on shingles of five words: that of the least id, and of repeated rows one. Null and blank texts are one group."""
    return dedup_near(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights; a document that is taken twice is there twice. Repeated rows share their fate; a null source is the last one."""
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, decoded again for a digest of the bytes; clashing names get a leading underscore. A null text has no tokens."""
    path = vocabulary_path()
    ids, offsets, decoded, n, sha, back = (fresh(docs, x) for x in ("ids", "offsets", "decoded", "n_tokens", "ids_sha256", "decoded_sha256"))
    out = encode(docs, path, keep_text=False, decoded="decoded").withColumn(n, F.size(col(ids)).cast("long"))
    digest = F.sha2(F.array_join(col(ids).cast("array<string>"), ",").cast("binary"), 256)
    return out.withColumns({sha: digest, back: F.sha2(col(decoded), 256)}).drop(decoded, offsets)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("mixing", mixture),
    ("byte bpe", tokens),
]

#: SimHash cannot be said in SQL, so the whole is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage reads or stores on the way is deleted when its result is written."""

    def after(n: int) -> DataFrame:
        if not n:
            return spark.read.parquet(f"{sf_dir}/documents.parquet")
        name, stage = STAGES[n - 1]
        return finished(spark, "stage-" + name.replace(" ", "-"), lambda: stage(spark, after(n - 1), sf_dir))

    return STAGES[-1][1](spark, after(len(STAGES) - 1), sf_dir)
