"""JSON-lines records of documents, gold spans and predictions: parsing with violations, and sinks.

A record is strict JSON: one object per line, no repeated keys, no numbers that are not finite, no numbers for texts.
Nothing raises inside a task: a parsed row carries its violations, an ordered array of reasons that hold no text of the
record, and the caller decides. ``require_clean`` counts them and fails on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions.text import slice_text

# Version and fields of the canonical record.
VERSION = "pii-zh-v1"
ENTITY = "struct<start:int,end:int,label:string,text:string,source:string,risk_tier:string,validator_state:string,metadata:map<string,string>>"
PROVENANCE = (
    "struct<source_id:string,source_kind:string,source_revision:string,license:string,synthetic:boolean,evaluation_only:boolean,private_enterprise:boolean,"
    "generator_name:string,generator_version:string,generator_seed:bigint,template_id:string,terms_snapshot:string,metadata:map<string,string>>"
)
QUALITY = "struct<tier:string,quality_gate:boolean,validators_passed:boolean,review_status:string,confidence:double,metadata:map<string,string>>"
DOCUMENT = (
    f"schema_version string, doc_id string, text string, entities array<{ENTITY}>, language string, domain string, scene string, license string, "
    f"provenance {PROVENANCE}, quality {QUALITY}, public_weight_training_allowed boolean, data_pool string, tenant_group string, "
    "conversation_group string, template_group string, entity_value_groups array<string>, created_at_bucket string, generator_version string, "
    "split string, metadata map<string,string>"
)
DOCUMENT_FIELDS = tuple(part.split()[0] for part in DOCUMENT.replace(f"array<{ENTITY}>", "x").replace(PROVENANCE, "x").replace(QUALITY, "x").split(", "))
REQUIRED = ("schema_version", "doc_id", "text", "entities", "language", "domain", "scene", "license", "provenance", "quality", "data_pool")
TEXTS = (
    "schema_version", "doc_id", "text", "language", "domain", "scene", "license", "data_pool", "tenant_group", "conversation_group", "template_group",
    "created_at_bucket", "generator_version", "split",
)
TIERS = ("T0", "T1", "T2")
SPAN = "struct<start:int,end:int,label:string,text:string,score:double>"
GOLD = f"doc_id string, spans array<{SPAN}>, entities array<{SPAN}>, text string, text_length int"
PREDICTION = f"doc_id string, spans array<{SPAN}>"
#: Limits of the plain text reader.
MOST_RECORDS, MOST_CHARACTERS = 10_000, 100_000
# The names that source rows use, in the order in which they are tried.
TEXT_NAMES, SPAN_NAMES = ("text", "source_text", "content", "sentence"), ("entities", "spans", "annotations", "privacy_mask", "pii")
START_NAMES, END_NAMES = ("start", "start_offset", "begin"), ("end", "end_offset", "stop")
LABEL_NAMES, QUOTE_NAMES = ("label", "entity_type", "type", "category"), ("text", "value", "quote")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of every line that is not blank, lines counted from 1 in their file.

    A line's number is its rank in its block plus the lines of the blocks before, one small row per block.
    """
    rows = spark.read.text(path).select(
        F.input_file_name().alias("file"), F.input_file_block_start().alias("_block"), F.monotonically_increasing_id().alias("_id"), "value"
    )
    blocks = rows.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_block")) - F.col("_n")
    blocks = blocks.select("file", "_block", "_first", before.alias("_before"))
    out = rows.join(blocks, ["file", "_block"])
    return out.where(F.trim("value") != "").select("file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line"), "value")


def _reasons(*checks: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(why)) for c, why in checks]))


def strict_json(value: Column) -> Column:
    """The one JSON value of the text as VARIANT; null if there is none, more than one, a key that an object of any depth
    repeats, or a number that is not finite."""
    # alone, the parser stops after the first value; in brackets it has to read all
    v = F.try_parse_json(F.concat(F.lit("["), value, F.lit("]")))
    return F.when(F.try_variant_get(v, "$[1]", "variant").isNull(), F.try_variant_get(v, "$[0]", "variant"))


def _not_texts(v: Column, fields: Sequence[str]) -> Column:
    """Whether a field of the object is there and neither text nor null."""
    kinds = F.array(*[F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant")) for f in fields])
    return F.exists(kinds, lambda k: F.coalesce(~k.isin("STRING", "VOID"), F.lit(False)))


def _parsed(lines: DataFrame, schema: str, texts: Sequence[str], lists: Sequence[str] = (), inner: Sequence[str] = ()) -> DataFrame:
    """Add r (the record), keys (its fields) and broken (not a strict JSON object of these types).

    ``texts``: fields that hold texts; ``inner``: those of the objects in the arrays ``lists``. Without the check a number
    would turn into a text.
    """
    r = F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    p = lines.withColumns({"r": r, "keys": F.json_object_keys("value"), "v": strict_json(F.col("value"))})
    wrong = _not_texts(F.col("v"), texts)
    for name in lists:
        wrong = wrong | F.coalesce(F.exists(F.try_variant_get("v", f"$.{name}", "array<variant>"), lambda x: _not_texts(x, inner)), F.lit(False))
    return p.withColumn("broken", F.col("keys").isNull() | F.col("v").isNull() | F.col("r._corrupt").isNotNull() | wrong).drop("v")


def _bad_span(s: Column, length: Column) -> Column:
    score = s["score"]
    inside = (s["start"] >= 0) & (s["start"] < s["end"]) & (length.isNull() | (s["end"] <= length))
    return ~F.coalesce(inside & (F.trim(s["label"]) != "") & (score.isNull() | score.between(0.0, 1.0)), F.lit(False))


def _repeated(spans: Column) -> Column:
    keys = F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["label"]))
    return F.size(F.array_distinct(keys)) < F.size(keys)


def _foreign_keys(value: Column, spans: str, allowed: Sequence[str]) -> Column:
    """Whether an object of the array ``spans`` of the line has a field that is not allowed."""
    maps = F.from_json(F.get_json_object(value, f"$.{spans}"), "array<map<string,string>>")
    return F.exists(maps, lambda m: F.size(F.array_except(F.map_keys(m), F.array(*map(F.lit, allowed)))) > 0)


def expected_pool(gate: Column, allowed: Column, evaluation_only: Column, private: Column) -> Column:
    from spanloom.operators.datasets import pool

    return pool(gate, allowed, evaluation_only, private)


def parse_documents(lines: DataFrame) -> DataFrame:
    """The columns of ``lines``, the record's fields and violations: closed fields, offsets, quotes, licence, pool, training, groups."""
    p = _parsed(lines, DOCUMENT, TEXTS, ("entities",), ("label", "text", "source", "risk_tier", "validator_state"))
    r = F.col("r")
    prov, qual, text = r["provenance"], r["quality"], r["text"]
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    bad = lambda e: (e["start"] < 0) | (e["start"] >= e["end"]) | (e["end"] > F.char_length(text)) | e["start"].isNull() | e["end"].isNull()
    other = lambda e: ~e["text"].eqNullSafe(slice_text(text, e["start"], e["end"]))
    tier = lambda e: e["risk_tier"].isNotNull() & ~e["risk_tier"].isin(*TIERS)
    wanted = expected_pool(qual["quality_gate"], r["public_weight_training_allowed"], F.coalesce(prov["evaluation_only"], F.lit(False)), F.coalesce(prov["private_enterprise"], F.lit(False)))
    made = F.coalesce(prov["synthetic"], F.lit(False))
    checks = [
        (F.col("broken"), "not_valid_json"),
        (F.size(F.array_except("keys", F.array(*map(F.lit, DOCUMENT_FIELDS)))) > 0, "unknown_fields"),
        (F.size(F.array_except(F.array(*map(F.lit, REQUIRED)), "keys")) > 0, "missing_fields"),
        (~r["schema_version"].eqNullSafe(F.lit(VERSION)), "schema_version"),
        *[(empty(r[c]), f"empty_{c}") for c in ("doc_id", "language", "domain", "scene", "license")],
        (~r["license"].eqNullSafe(prov["license"]), "license_mismatch"),
        (F.exists(r["entities"], bad), "span_out_of_bounds"),
        (F.exists(r["entities"], lambda e: ~bad(e) & other(e)), "span_text_mismatch"),
        (F.exists(r["entities"], tier), "risk_tier"),
        (made & (empty(prov["generator_name"]) | empty(prov["generator_version"])), "synthetic_without_generator"),
        (~r["data_pool"].eqNullSafe(wanted), "data_pool"),
        (prov["evaluation_only"] & ~r["public_weight_training_allowed"].eqNullSafe(F.lit(False)), "evaluation_only_trains"),
        (made & ~r["generator_version"].eqNullSafe(prov["generator_version"]), "generator_version_mismatch"),
        (F.exists(r["entity_value_groups"], lambda g: ~g.startswith("sha256:")), "value_group_not_hashed"),
    ]
    why = F.when(F.col("broken"), F.array(F.lit("not_valid_json"))).otherwise(_reasons(*checks))
    return p.withColumn("violations", why).select(*[c for c in lines.columns if c != "value"], *[r[c].alias(c) for c in DOCUMENT_FIELDS], "violations")


def parse_gold(lines: DataFrame) -> DataFrame:
    """doc_id, spans(start, end, label), text_length, violations: spans or entities but not both; the text itself is dropped."""
    p = _parsed(lines, GOLD, ("doc_id", "text"), ("spans", "entities"), ("label", "text"))
    r = F.col("r")
    has = lambda k: F.array_contains("keys", k)
    spans, text = F.coalesce(r["spans"], r["entities"]), r["text"]
    length = F.coalesce(F.char_length(text), r["text_length"])
    quote = lambda s: s["text"].isNotNull() & text.isNotNull() & (s["text"] != slice_text(text, s["start"], s["end"]))
    checks = [
        (F.coalesce(F.trim(r["doc_id"]), F.lit("")) == "", "doc_id"), (has("spans") & has("entities"), "spans_and_entities"), (spans.isNull(), "spans_not_an_array"),
        (r["text_length"] < 0, "text_length"), (text.isNotNull() & (F.char_length(text) != r["text_length"]), "text_length_mismatch"),
        (F.exists(spans, lambda s: _bad_span(s, length)), "span_invalid"), (F.exists(spans, lambda s: ~_bad_span(s, length) & quote(s)), "span_text_mismatch"),
        (_repeated(spans), "duplicate_span"),
    ]
    why = F.when(F.col("broken"), F.array(F.lit("not_valid_json"))).otherwise(_reasons(*checks))
    slim = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label")))
    return p.select(*[c for c in lines.columns if c != "value"], r["doc_id"].alias("doc_id"), slim.alias("spans"), length.alias("text_length"), why.alias("violations"))


def parse_predictions(lines: DataFrame) -> DataFrame:
    """doc_id, spans(start, end, label, score), violations: only these fields may occur."""
    p = _parsed(lines, PREDICTION, ("doc_id",), ("spans",), ("label",))
    r = F.col("r")
    checks = [
        (F.size(F.array_except("keys", F.array(F.lit("doc_id"), F.lit("spans")))) > 0, "unknown_fields"), (F.coalesce(F.trim(r["doc_id"]), F.lit("")) == "", "doc_id"),
        (r["spans"].isNull(), "spans_not_an_array"), (_foreign_keys(F.col("value"), "spans", ("start", "end", "label", "score")), "unknown_span_fields"),
        (F.exists(r["spans"], lambda s: _bad_span(s, F.lit(None).cast("int"))), "span_invalid"), (_repeated(r["spans"]), "duplicate_span"),
    ]
    why = F.when(F.col("broken"), F.array(F.lit("not_valid_json"))).otherwise(_reasons(*checks))
    slim = F.transform(r["spans"], lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), s["score"].alias("score")))
    return p.select(*[c for c in lines.columns if c != "value"], r["doc_id"].alias("doc_id"), slim.alias("spans"), why.alias("violations"))


def parse_texts(lines: DataFrame, most_characters: int = MOST_CHARACTERS) -> DataFrame:
    """text, violations: objects of exactly one field, text, of limited length. ``too_many`` limits the number of records."""
    p = _parsed(lines, "text string", ("text",))
    checks = [
        (F.size(F.array_except("keys", F.array(F.lit("text")))) > 0, "unknown_fields"), (F.col("r.text").isNull(), "text_missing"),
        (F.char_length(F.col("r.text")) > most_characters, "text_too_long"),
    ]
    why = F.when(F.col("broken"), F.array(F.lit("not_valid_json"))).otherwise(_reasons(*checks))
    return p.select(*[c for c in lines.columns if c != "value"], F.col("r.text").alias("text"), why.alias("violations"))


def too_many(lines: DataFrame, most: int = MOST_RECORDS) -> bool:
    return lines.limit(most + 1).count() > most


def repeated_ids(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Ids that occur more than once, which neither gold nor prediction files may have."""
    return parsed.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_clean(parsed: DataFrame) -> DataFrame:
    """``parsed`` without its violations column; raises on the driver with the reasons and their counts if there are any."""
    why = parsed.select(F.explode("violations").alias("why")).groupBy("why").count().collect()  # one row per reason
    if why:
        raise ValueError("invalid records: " + ", ".join(f"{r['why']} x{r['count']}" for r in sorted(why)))
    return parsed.drop("violations")


def document_lines(docs: DataFrame) -> DataFrame:
    """One JSON object per row, fields in alphabetical order, nulls written out."""
    return docs.select(F.to_json(F.struct(*sorted(docs.columns)), {"ignoreNullFields": "false"}).alias("value"))


def prediction_lines(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """One JSON object (doc_id, spans) per document of ``docs``, also of those without spans, which come by (start, end, label, falling score)."""
    one = F.struct("end", "label", "score", "start")
    rank = F.struct("start", "end", "label", -F.coalesce("score", F.lit(0.0)), one.alias("s"))
    lists = spans.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(rank)), lambda x: x["s"]).alias("spans"))
    none = F.expr("cast(array() as array<struct<end:int,label:string,score:double,start:int>>)")
    both = docs.select("doc_id").join(lists, "doc_id", "left").withColumn("spans", F.coalesce("spans", none))
    return both.select("doc_id", F.to_json(F.struct("doc_id", "spans"), {"ignoreNullFields": "false"}).alias("value"))


def write_lines(lines: DataFrame, path: str) -> int:
    """Write the column value as text; returns the number of lines."""
    lines.select("value").write.text(path)
    return lines.sparkSession.read.text(path).count()


def read_parts(spark: SparkSession, *paths: str) -> DataFrame:
    """The rows of several Parquet files under one merged schema; fields that a file lacks are null."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def write_extract(rows: DataFrame, path: str, expected: int) -> int:
    """Write rows as Parquet with ZSTD; another number of rows than expected fails and leaves nothing behind.

    Rows are counted by the job that writes them; predicates and columns of ``rows`` reach the scan as in any plan.
    """
    spark, seen = rows.sparkSession, Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.option("compression", "zstd").parquet(path)
    n = seen.get["n"]
    if n != expected:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        raise ValueError(f"{n} rows, not {expected}")
    return n


def read_pinned(spark: SparkSession, path: str, schema: str, rows: int | None = None) -> DataFrame:
    """A Parquet table whose field names, order and types, and number of rows, must be the given ones."""
    df = spark.read.parquet(path)
    wanted = spark.createDataFrame([], schema).dtypes
    if df.dtypes != wanted:
        raise ValueError(f"schema is {df.dtypes}, not {wanted}")
    if rows is not None and (found := df.count()) != rows:
        raise ValueError(f"{found} rows, not {rows}")
    return df


def out_of_order(spans: DataFrame, order: str, key: str = "doc_id") -> DataFrame:
    """Spans that start before their predecessor, by the column ``order``, in the same document."""
    before = F.lag("start").over(Window.partitionBy(key).orderBy(order))
    return spans.withColumn("_before", before).where("start < _before").drop("_before")


def resolve_spans(spans: Column, names: Sequence[str], text: Column) -> Column:
    """array<start, end, label, valid> in order from an array of structs whose fields bear any of the known names.

    ``names``: fields of the struct. valid: the offsets lie in the text, and a quote, where there is one, is its slice.
    """
    pick = lambda s, known: F.coalesce(*[s[n] for n in known if n in names]) if any(n in names for n in known) else F.lit(None)

    def one(s: Column) -> Column:
        start, end, label = pick(s, START_NAMES).cast("int"), pick(s, END_NAMES).cast("int"), F.trim(pick(s, LABEL_NAMES).cast("string"))
        quote = pick(s, QUOTE_NAMES)
        good = (start >= 0) & (start < end) & (end <= F.char_length(text)) & (label != "") & (quote.isNull() | (quote == slice_text(text, start, end)))
        return F.struct(start.alias("start"), end.alias("end"), label.alias("label"), F.coalesce(good, F.lit(False)).alias("valid"))

    return F.array_sort(F.transform(spans, one))
