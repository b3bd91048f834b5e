"""From raw documents to encoded training text: a chain of stages, each stored before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqlens.llm import bpe, cotraining, minhash_dedup, mixing, suffix_dedup
from reqlens.llm.common import join_same, table, text_key
from reqlens.llm.queries import MIX_EPOCHS, MIX_SEED, MIX_WEIGHTS, vocabulary, with_domain
from reqlens.session import cut_lineage

#: SQL cannot express a trained classifier; the stages are tested against brute force instead, in tests/llm.
ORACLE_SQL = None
#: Columns of documents, which every stage but the last returns.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Tokens of the mixture in percent of the tokens that reach it.
PERCENT = 100
#: Bytes of text that one task cuts at once; after the stages before it an executor's heap has grown to its bound.
PART_BYTES = 3 << 20


def _judged(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows whose number and text got a good verdict; rows without a number are told apart by their texts."""
    good = verdicts.where("kept").select("doc_id", "text_key").distinct()
    return join_same(docs.withColumn("text_key", text_key()), good, ["doc_id", "text_key"], "left_semi").select(COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject.

    Every row is judged by its own text; null and empty texts are judged by their metadata. Repeated rows share
    their verdict. Without labels, or with labels of one class, all rows get that class. Extra columns go.
    """
    return _judged(docs, cotraining.classify(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest number.

    Rows that share a number are one document. Rows without a number are documents before all others, known by their
    texts. Texts without words are like no other and stay. Extra columns go.
    """
    return _judged(docs, minhash_dedup.near_duplicates(docs))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that a document before them has; a character that was cut in two goes too.

    All rows stay, a text that is all repeated as an empty one; null texts come out empty. Extra columns go.
    """
    cut = suffix_dedup.repeated_bytes(docs, carry=["lang", "source"], part_bytes=PART_BYTES)
    text = suffix_dedup.whole_characters("kept").alias("text")
    return cut.select("doc_id", text, "lang", "source").withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the target weights take: a row for each epoch, the last one of a leaf cut to its tokens.

    Texts without words are not taken. Null languages and sources are leaves of their own; rows that share a number, or
    have none, are taken each by its own text. Extra columns go.
    """
    plan = mixing.mix(with_domain(docs), MIX_WEIGHTS, PERCENT, MIX_EPOCHS, MIX_SEED)
    taken = mixing.taken_rows(docs, plan)
    return taken.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every row's text, and a digest of the text they decode to; null and empty texts have no ids."""
    coded = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), vocabulary())
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("repeated_strings", repeated_strings), ("mixture", mixture), ("encoding", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
