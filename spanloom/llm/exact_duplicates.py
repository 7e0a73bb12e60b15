"""Exact duplicates by recipes: texts cut where their content says so, chunks known by verified numbers, lists of numbers compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import stored, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A chunk ends after white space that follows a vowel and n or r and precedes one of a, d, i with a letter up to m, once it
#: has LEAST characters; without such a place it ends after MOST.
EDGE = r"(?<=[aeiou][nr][\x20\x09-\x0D])(?=[adi][a-m])"
LEAST, MOST = 256, 4096


def normalised(text: Column) -> Column:
    """The text with A-Z, and nothing else, in lower case; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The text in order, cut at content-defined edges; joined again, the chunks are the whole text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{{least},{most}}}?{EDGE}|.{{1,{most}}}"), F.lit(0))


def exact_duplicates(docs: DataFrame, text: str = "text", number_bits: int = 64, hot_share: float = 0.001) -> DataFrame:
    """Return doc_id, keep_id, group_size, kept and text_sha256, one row per row of ``docs``.

    A text's recipe is the ordered list of its chunks' numbers (hashes of ``number_bits``). All chunks are grouped once by
    number and content, so that every number is checked to stand for one content only; a chunk that many rows share is
    moved once per task that reads it. Texts are equal when their recipes are; only recipes move from then on. Should a
    number stand for two contents, rows whose recipe holds it are compared by their whole texts besides.

    Of equal texts the row with the largest doc_id stays. Groups that hold more than ``hot_share`` of all rows (fewer than
    one over that share, so few enough to broadcast) are joined back in as many salted parts. Null texts are empty, and
    empty texts are equal to each other; long texts are cut into as many chunks as it takes; of rows that repeat an id and a
    text exactly one is kept; a null id stays only where its group has no other; extra columns are ignored; an empty table
    gives an empty one.
    """
    norm = normalised(F.col(text))
    number = lambda c: F.xxhash64(c) if number_bits == 64 else F.xxhash64(c).bitwiseAND((1 << number_bits) - 1)
    cut = docs.select("doc_id", norm.alias("norm")).withColumn("chunks", chunks(F.col("norm")))
    recipe = F.transform("chunks", number).alias("recipe")

    contents = cut.select(F.explode("chunks").alias("chunk")).groupBy(number(F.col("chunk")).alias("number"), "chunk").agg(F.count(F.lit(1)).alias("uses"))
    clashes = stored(contents.groupBy("number").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select("number"), "recipe-clashes")

    rows = cut.select("doc_id", recipe, F.lit(None).cast("string").alias("whole"), F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
    if clashes.head(1):
        holds = rows.select("recipe", F.explode(F.array_distinct("recipe")).alias("number")).join(clashes, "number", "left_semi")
        unsafe = stored(holds.select("recipe").distinct(), "recipe-unsafe")
        fresh = cut.select("doc_id", recipe, F.col("norm").alias("whole"), F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
        rows = rows.join(unsafe, "recipe", "left_anti").unionByName(fresh.join(unsafe, "recipe", "left_semi"))

    # rows that repeat an id and a text are one row with a count
    members = stored(rows.groupBy("doc_id", "recipe", "whole").agg(F.count(F.lit(1)).alias("n"), F.first("text_sha256").alias("text_sha256")), "recipe-members")
    members = members.withColumn("h", F.xxhash64("recipe", "whole"))
    groups = stored(members.groupBy("recipe", "whole", "h").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("ids")), "recipe-groups")
    total = members.count()
    hot = groups.groupBy("h").agg(F.ceil(F.sum("ids") / F.lit(max(1.0, hot_share * total))).cast("int").alias("parts")).where("parts > 1")
    hot = F.broadcast(hot)  # fewer than 1 / hot_share rows of two numbers each
    parts = F.coalesce("parts", F.lit(1))
    dealt = members.join(hot, "h", "left").withColumn("part", F.pmod(F.xxhash64("doc_id"), parts).cast("int"))
    copied = groups.join(hot, "h", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts", "ids")
    same = (dealt["recipe"] == copied["recipe"]) & (dealt["part"] == copied["part"]) & dealt["whole"].eqNullSafe(copied["whole"])
    found = dealt.join(copied, same).select(dealt["doc_id"], "keep_id", "group_size", "text_sha256", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)
    return found.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), "text_sha256")


def op12_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP12_SQL = f"""WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
  g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size, sha256(t) AS text_sha256 FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (t)"""
