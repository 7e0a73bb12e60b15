"""Span tables derived from the driver's tables, each with the SQL that makes the same rows.

The test tables hold few sensitive values, so gold spans, predictions and tag sequences come from arithmetic on
lineitem and conversations.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession) -> str:
    """A new path in the folder that spark.checkpoint.dir names, deleted when the driver's JVM ends; local sessions without it use the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    path = f"{root.rstrip('/')}/spanloom-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def store(df: DataFrame) -> DataFrame:
    """A written table under a fresh path, read back: cuts the lineage and survives lost executors."""
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly to tasks: one row group may hold a million keys, and what is made of each costs far more than reading it."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt by document to a fixed number of tasks, which is not merged to fewer: what groups, joins or orders a document's rows needs no shuffle after it."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.floor("l_quantity").cast("int")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), q.alias("start"), (q + 1 + (F.col("l_partkey") % 9).cast("int")).alias("end"),
        F.concat("l_returnflag", "l_linestatus").alias("label"), F.col("l_linenumber").alias("k"), (F.col("l_discount") * 10).alias("score"),
    )


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(_lines(spark, sf_dir).select("doc_id", "start", "end", "label")).distinct()


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions: by line number kept, moved by one, relabelled, dropped, or kept beside a spurious one."""
    k, moved = F.col("k") % 5, (F.col("k") % 5 == 1).cast("int")
    base = _lines(spark, sf_dir).where(k != 3)
    label = F.when(k == 2, F.lit("ZZ")).otherwise(F.col("label"))
    main = base.select("doc_id", (F.col("start") + moved).alias("start"), (F.col("end") + moved).alias("end"), label.alias("label"), "score")
    more = base.where(k == 4).select("doc_id", (F.col("start") + 60).alias("start"), (F.col("end") + 60).alias("end"), "label", "score")
    return dealt(main.unionByName(more)).groupBy("doc_id", "start", "end", "label").agg(F.max("score").alias("score"))


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).drop("score")


def second(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another system: the predictions from a score of 0.3 on, without those moved."""
    return scored(spark, sf_dir).where("score >= 0.3").drop("score")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("doc_id"), (100 + F.col("o_custkey") % 900).cast("int").alias("text_length"),
        F.element_at(F.array(F.lit("test"), F.lit("train"), F.lit("validation")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("split"),
    )


def tokens(spark: SparkSession, sf_dir: str, tags: tuple[str, ...] = ("B-X", "I-X", "I-Y", "O", "B-Y")) -> DataFrame:
    """Words of the conversations (at most one per single space), with offsets, a tag by arithmetic and a score."""
    c = read(spark, sf_dir, "conversations").where("text IS NOT NULL")
    doc = (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id")
    none = F.expr("cast(array() as array<struct<word:string,start:int>>)")
    step = lambda acc, w: F.struct(
        (acc["at"] + F.char_length(w) + 1).cast("int").alias("at"), F.concat(acc["out"], F.array(F.struct(w.alias("word"), acc["at"].alias("start")))).alias("out")
    )
    placed = F.aggregate(F.split("text", " "), F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    words = c.select(doc, "text", F.posexplode(placed).alias("token_index", "w")).select("doc_id", "text", "token_index", "w.word", "w.start")
    length = F.char_length("word").cast("int")
    tag = F.element_at(F.array(*map(F.lit, tags)), ((F.col("token_index") * 7 + F.col("doc_id") + F.char_length("word")) % len(tags) + 1).cast("int"))
    return words.withColumns({"end": (F.col("start") + length).cast("int"), "tag": tag}).select(
        "doc_id", "token_index", "start", "end", "tag", ((F.col("doc_id") + F.col("token_index")) % 10 / 10.0).cast("double").alias("score"), "text"
    )


LINES_SQL = """lines AS (SELECT l_orderkey AS doc_id, CAST(floor(l_quantity) AS INTEGER) AS s,
  CAST(floor(l_quantity) AS INTEGER) + 1 + CAST(l_partkey % 9 AS INTEGER) AS e, concat(l_returnflag, l_linestatus) AS label,
  l_linenumber AS k, l_discount * 10 AS score FROM lineitem)"""
GOLD_SQL = LINES_SQL + ", gold AS (SELECT DISTINCT doc_id, s, e, label FROM lines)"
PRED_SQL = (
    GOLD_SQL
    + """, scored AS (SELECT doc_id, s, e, label, max(score) AS score FROM (
  SELECT doc_id, s + CASE WHEN k % 5 = 1 THEN 1 ELSE 0 END AS s, e + CASE WHEN k % 5 = 1 THEN 1 ELSE 0 END AS e,
    CASE WHEN k % 5 = 2 THEN 'ZZ' ELSE label END AS label, score FROM lines WHERE k % 5 <> 3
  UNION ALL SELECT doc_id, s + 60, e + 60, label, score FROM lines WHERE k % 5 = 4) GROUP BY ALL),
  pred AS (SELECT doc_id, s, e, label FROM scored), second AS (SELECT doc_id, s, e, label FROM scored WHERE score >= 0.3),
  docs AS (SELECT o_orderkey AS doc_id, CAST(100 + o_custkey % 900 AS INTEGER) AS text_length,
    ['test', 'train', 'validation'][o_orderkey % 3 + 1] AS split FROM orders)"""
)


def tokens_sql(tags: tuple[str, ...] = ("B-X", "I-X", "I-Y", "O", "B-Y")) -> str:
    names = ", ".join(f"'{t}'" for t in tags)
    return f"""words AS (SELECT conv_id * 1000 + turn AS doc_id, text, string_split(text, ' ') AS w FROM conversations WHERE text IS NOT NULL),
  placed AS (SELECT doc_id, text, w, unnest(range(len(w))) AS token_index FROM words),
  starts AS (SELECT doc_id, text, token_index, w[token_index + 1] AS word,
    coalesce(list_sum(list_transform(w[1:token_index], lambda x: length(x) + 1)), 0) AS s FROM placed),
  tokens AS (SELECT doc_id, text, token_index, CAST(s AS INTEGER) AS s, CAST(s + length(word) AS INTEGER) AS e,
    [{names}][(token_index * 7 + doc_id + length(word)) % {len(tags)} + 1] AS tag, (doc_id + token_index) % 10 / 10.0 AS score FROM starts)"""
