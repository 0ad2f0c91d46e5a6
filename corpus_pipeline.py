"""The training-data pipeline over `documents`: quality, near-dedup, decontamination, secret scan, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns of
documents. run() writes every stage's result as Parquet in the shared checkpoint folder and reads it for the next one.

Nulls, empty and very long texts, repeated rows and empty tables go through every stage: a null or empty text scores like one
without words, copies of it are near copies of each other, it has no passage and no secret, and packs as one token. Columns
beside those of documents stay up to the last stage, whatever their names.

1. quality: a factorisation machine trained on labels; documents that score below 0.7 go.
2. near_dedup: links where the sets of five-word shingles have a Jaccard similarity of 0.8 or more, checked exactly; candidates
   by SimHash over word pairs, at 8 or fewer differing bits, and by bands that a pair at 0.8 shares with probability 0.9999.
   Of each group one row stays, one with the smallest doc_id; rows whose texts are not alike stay, also where they share
   a doc_id or have none.
3. decontamination: documents with a passage within 20% word edits of a benchmark item go.
4. secrets: documents stay, their secrets are masked and n_chars is set anew.
5. packing: what is left is packed into sequences of at most 1024 tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import common, decontam, packing, quality, queries, secret_scan, simhash_dedup


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    machine = quality.train(docs, common.table(spark, sf_dir, "labels"), sample_rows=6000)
    if machine is None:  # nothing to judge by
        return docs
    score = common.free_name(docs.columns, "score")
    return quality.with_scores(docs, machine, score).where(F.col(score) >= 0.7).select(*common.quoted(docs.columns))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.deduplicated(docs, similarity=0.8, shingle=5, votes=2, radius=8, shard_rows=256, recall=0.9999)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, common.table(spark, sf_dir, "benchmark"), max_edits=0.2, recall=0.99)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, queries.tokenizer("byte_bpe_50k.json"), size=1024, end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: No stage but the first has a form in SQL (trained scores, fingerprints, edit distances, tokens); tests/llm compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What stages keep for themselves is deleted once their result is written, which the next stage's is before."""
    docs, at = common.table(spark, sf_dir, "documents"), common.shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        with common.scratch(spark):
            docs = common.keep(stage(spark, docs, sf_dir), f"{at}/{k}-{name}")
        if k:
            common.remove(spark, f"{at}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
