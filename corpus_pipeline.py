"""The training-data pipeline: stages over ``documents``, each written and read
again before the next.

Odd input, in every stage: a null text is an empty one, and null or repeated ids are
rows like others; very long texts are read whole; an empty table gives an empty
result; columns beyond ``doc_id``, ``text`` and ``source``, whatever their names, are
carried through the first four stages and left out by the last. What a stage makes of
each is in its own docstring.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ferrylake.llm import decontaminate, neardup, packing, pii, quality
from ferrylake.llm.common import load, written
from ferrylake.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host rules keep. Null and empty texts have too few words and
    go; a null source is a host; equal rows stay or go together."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one of the smallest id (a null id
    comes last). Texts without words are classes of their own and stay; of rows equal
    in id and text one stays."""
    return neardup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and empty texts and items have
    no words, so nothing of them goes; equal rows stay or go together."""
    return decontaminate.without_contaminated(docs, load(spark, sf_dir, "benchmark"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data masked; a null text stays null."""
    return pii.redacted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens. A null or empty text is its
    end token; a long one is cut into full pieces and a rest; equal rows are packed
    each."""
    return packing.packed(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mask_pii", mask_pii),
    ("pack_sequences", pack_sequences),
]

# Tokenisation and near-duplicate search have no SQL form; the pipeline is tested
# against brute force (tests/llm/test_pipeline.py).
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
