"""A training-data pipeline over the documents table: each stage's rows are written as Parquet and read by the next.

Every stage takes a table with doc_id, text and source, and keeps whatever other columns it has, clashing names included.

* quality: a null or empty text gets the score of the model's bias, and goes or stays by it; a score at the threshold stays;
  without labels every score is 0.5, and all rows go.
* rules: null, empty and other texts of fewer than 50 words go, as do texts of more than 1,000,000 words.
* near_duplicates: null and empty texts are linked with nothing and stay; of a component one row of the smallest doc_id
  stays, where a null id is larger than any; of rows alike in id and text one.
* mixture: rows without words are never taken; a null source is a source of its own; repeated rows are taken each.
* tokens: a null text has no tokens; repeated rows give a row each.

Texts of any length go through every stage whole. An empty table gives an empty table. Ties are broken by doc_id or by the
hash of it, so that reruns agree.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlyr.llm import bpe, mixing, ngram_join, quality_classifier, quality_rules
from outlyr.llm.common import discard, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, trained on labels.quality, predicts to be good."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that break no rule."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: sets of five-word shingles with a similarity of 0.8 or more are linked."""
    return ngram_join.deduplicated(docs, size=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the source schedule takes them."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids (little-endian unsigned 32-bit integers), decoded_sha256."""
    import public_tokenizers

    made = bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=("doc_id", "source"))
    return made.select("doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [
    ("quality", quality),
    ("rules", rules),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("tokens", tokens),
]
#: Compression, learned vectors and merges are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, spent = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        discard(*spent)
        spent = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
