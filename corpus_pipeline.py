"""A training corpus from raw documents: rules, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import stored, table
from spanloom.llm.mixing import mix, word_count
from spanloom.llm.near_duplicates import near_duplicates
from spanloom.llm.packing import pack
from spanloom.llm.quality_rules import apply_quality_rules, fit_quality_rules
from spanloom.llm.secrets import find_base, fit_network, mask_secrets

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned decision list rejects.

    Null and empty texts have no words and go; long texts are judged whole; repeated rows and ids are judged one by one and
    share their verdict; extra columns are left out; an empty table gives an empty one.
    """
    rules = fit_quality_rules(docs, table(spark, sf_dir, "labels"))
    return apply_quality_rules(docs, rules).where("kept").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity of 0.8 or more): the one with the smallest id.

    Rows that repeat each other in all columns are one row; rows that repeat an id with other texts all stay. Null and empty
    texts and null ids link with nothing and stay, ties go to the smaller id, long texts count whole; extra columns are left
    out; an empty table gives an empty one.
    """
    gone = near_duplicates(docs, percent=80).where(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS).dropDuplicates()


def mask_found_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, each found secret replaced by a mark; n_chars counts the new text.

    Null texts stay null, with a null n_chars, empty ones stay; long texts are scanned whole; repeated rows stay as often as
    they are; equal candidates have equal scores; extra columns are left out; an empty table gives an empty one.
    """
    net = fit_network(stored(find_base(docs), "pipeline-candidates"))
    masked = mask_secrets(docs.select(*COLUMNS), net)
    return masked.withColumn("n_chars", F.char_length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to target weights: a row per copy that it takes.

    Null and empty texts have no words and are never taken more than their class's share; null sources are a source of their
    own; rows that repeat an id and a size share their number of copies; ties in rank go by id, then size; extra columns are
    left out; an empty table gives an empty one.
    """
    # rows that repeat an id and a size share their number of copies, so the join adds no rows
    docs = docs.select(*COLUMNS)
    copies = mix(docs).where("copies > 0").groupBy("doc_id", "size").agg(F.max("copies").alias("copies"))
    sized = docs.withColumn("size", word_count(F.col("text")))
    same = sized["doc_id"].eqNullSafe(copies["doc_id"]) & (sized["size"] == copies["size"])
    taken = sized.join(copies, same).select(*[docs[c] for c in COLUMNS], "copies")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences with their token ids, packed along the Hilbert curve.

    Null texts are empty and give their end id, long texts span several sequences, repeated rows are packed as often as they
    are, ties on the curve go by id and length, extra columns are left out; an empty table gives no pieces.
    """
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", drop_near_duplicates),
    ("secret scans", mask_found_secrets),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

#: Learned rules, sketches, networks and tokenizers are beyond SQL; tests hold run() against plainer versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{i + 1}")
    return docs
