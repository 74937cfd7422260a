"""A corpus pipeline in five stages, each by one of the numbered operators.

Every stage works on all that its predecessor kept: language ID drops what it rejects, SimHash keeps one document
of each group, decontamination drops documents that hold a benchmark item, secrets are masked, and what is
left is packed into sequences.

In every stage repeated rows and rows with a null id are rows like any other, texts count whole whatever their length, further
columns stay until packing, and an empty table gives an empty one. Null texts and texts without a letter end with the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm import decontaminate, langid, packing, secrets, simhash
from heliograph.llm.common import table
from heliograph.llm.queries import tokenizer_path
from heliograph.shared import cut

#: Words that the packing stage's encoders remember, in each of two generations: its workers share their memory with what the
#: stages before have left.
REMEMBERED_WORDS = 100_000
#: Language scores below this are rejected, as are texts without a letter.
LEAST_LANGUAGE_SCORE = 0.25


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that have a language."""
    return langid.accept(docs, langid.fit(docs), LEAST_LANGUAGE_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return simhash.deduplicate(docs, width=5, similarity=0.8)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets in the texts; every document stays."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences of 4096 tokens."""
    return packing.pack(docs, tokenizer_path(), remembered=REMEMBERED_WORDS)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("secret_scans", mask_secrets),
    ("best_fit_packing", pack_sequences),
]

#: Kernel methods, fingerprints, forests and tokenizers are beyond SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
