"""A corpus pipeline over ``documents``: quality rules, line dedup, near-dedup, source mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
run() writes every stage's result as Parquet under the session's shared folder and rereads it for the next.

Defined results, of all stages: an empty table gives an empty one; null doc_id is an ordinary value, last in order; null
source is one host and one source; further columns are carried through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuscle.llm import bagminhash, bpe, line_dedup, mixing, quality
from corpuscle.session import materialise

#: Vocabulary and split pattern of the last stage; None: byte_bpe_50k of the installed public tokenizers.
TOKENIZER: tuple[str, str] | None = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. Null and empty texts are rejected; repeated rows are judged alike, each for itself."""
    return quality.quality_rules(docs)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Multi-line passages that occur earlier go from the texts; documents that lose everything go.

    Null and empty texts stay as they are; rows that repeat doc_id and text get equal texts.
    """
    return line_dedup.line_dedup(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: that of least doc_id, and one of rows that repeat it.

    Texts without words are near nothing and stay.
    """
    return bagminhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, three times at most.

    Texts without words are not taken; rows that repeat doc_id and text are taken or left together.
    """
    return mixing.mix(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, repeated ones too; a null text is encoded as an empty one."""
    path, pattern = TOKENIZER or _public_tokenizer()
    return bpe.digests(docs, path, pattern)


def _public_tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", remove_repeated_lines),
    ("near dedup", remove_near_copies),
    ("source mix", mix_sources),
    ("byte BPE", encode_tokens),
]

#: BagMinHash and BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
