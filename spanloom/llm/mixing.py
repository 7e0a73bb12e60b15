"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import SPACE_CLASS, stored, table, unit_hash

#: Weights of the sources in code-point order, null last, repeating.
WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.array_remove(F.split(text, f"[{SPACE_CLASS}]+"), "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """From (source, source_size): the words that each source gives to the mix.

    A source's target is min(most * source_size, level * weight): the water level that fills ``share`` of all words,
    which is what repeated resharing of the excess by weight ends at. One row per source passes the ordering windows,
    never a document.
    """
    weight = F.element_at(
        F.array(*map(F.lit, weights)),
        (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"),
    )
    s = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    s = s.withColumns({
        "_before": F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_weight": F.sum("weight").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        "_total": F.sum("source_size").over(everything) * F.lit(share),
    })
    # the level is set by the first source, in the order of filling, that its own level leaves below its cap
    level = F.when(F.col("cap") * F.col("_weight") > (F.col("_total") - F.col("_before")) * F.col("weight"), (F.col("_total") - F.col("_before")) / F.col("_weight"))
    s = s.withColumn("_here", level).withColumn("_place", F.row_number().over(by_fill))
    first = F.min(F.when(F.col("_here").isNotNull(), F.struct("_place", "_here"))).over(everything)
    s = s.withColumn("_first", first)
    cap = F.col("cap").cast("double")
    filled = F.least(F.col("_first._here") * F.col("weight"), cap)
    target = F.when(F.col("_place") >= F.col("_first._place"), filled).otherwise(cap)
    return s.select("source", "source_size", "weight", target.alias("target"))


def mix(
    docs: DataFrame, text: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2,
    tilt: float = 0.25, seed: str = "mix", steps: int = 64, levels: int = 3,
) -> DataFrame:
    """Return doc_id, source, size, source_size, target, copies and taken (copies * size) for every row of ``docs``.

    A document of length class x (bits of its size) gets the expected number of copies
    m = rate * (1 + slope * (x - mean of x by words)), so that the expected words of a source are its target and no m
    leaves [0, most]. floor(m) copies are certain. For the rest, documents are ranked by u / (1 - u) divided by
    l / (1 - l) with l the fraction of m and u a hash of the id, and taken in that order until the source's target is
    met (the last one only if that comes nearer). Running sums go over (source, rank) aggregates, ``steps`` at a time on each
    of ``levels`` levels, and only the last level's one cell in which the target is met, a share of 1 / steps**levels of a
    source's documents, is ordered row by row.

    Null texts have size 0; rows of one id are told apart by size, and full repeats by an arbitrary but fixed order,
    which changes none of the returned values. Extra columns are ignored; an empty table gives none.
    """
    size = word_count(F.col(text))
    bits = lambda n: F.length(F.bin(n)).cast("long")
    slim = stored(
        docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size")).withColumns({
            "x": bits(F.col("size")), "u": unit_hash(F.col("doc_id").cast("string"), seed=seed),
        }),
        "mix-sizes",
    )
    classes = slim.groupBy("source", "x").agg(F.sum("size").alias("words"))
    per_source = classes.groupBy("source").agg(
        F.sum("words").alias("source_size"), F.sum(F.col("words") * F.col("x")).alias("wx"), F.min("x").alias("lo"), F.max("x").alias("hi")
    )
    targets = source_targets(per_source.select("source", "source_size"), weights, share, most)
    plan = per_source.drop("source_size").withColumnRenamed("source", "_s").join(targets, F.col("_s").eqNullSafe(F.col("source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("rate", F.least(rate, F.lit(float(most)))).withColumn("mean_x", F.col("wx") / F.greatest(F.col("source_size"), F.lit(1)))
    reach = F.greatest(F.col("hi") - F.col("mean_x"), F.col("mean_x") - F.col("lo"), F.lit(1e-9))
    slope = F.least(F.lit(tilt), F.lit(1.0), F.when(F.col("rate") > 0, (most - F.col("rate")) / F.col("rate")).otherwise(0.0)) / reach
    plan = plan.withColumn("slope", slope).select("_s", "source_size", "target", "rate", "mean_x", "slope")

    m = F.col("rate") * (1 + F.col("slope") * (F.col("x") - F.col("mean_x")))
    m = F.least(F.greatest(F.round(m, 9), F.lit(0.0)), F.lit(float(most)))
    ranked = slim.join(plan, slim["source"].eqNullSafe(plan["_s"])).drop("_s").withColumn("m", m)
    ranked = ranked.withColumn("whole", F.floor("m").cast("long")).withColumn("l", F.col("m") - F.floor("m"))
    # q / (1 + q) of the Pareto rank q keeps the order and lies in (0, 1); documents without a fraction come last
    odds = (F.col("u") / (1 - F.col("u"))) * (1 - F.col("l")) / F.col("l")
    ranked = ranked.withColumn("rank", F.when(F.col("l") > 0, odds / (1 + odds)))
    cells = steps**levels
    ranked = ranked.withColumn("cell", F.least(F.floor(F.col("rank") * cells), F.lit(cells - 1)).cast("int"))

    sums = stored(
        ranked.groupBy("source", "cell").agg(
            F.sum("size").alias("words"), F.sum(F.col("size") * F.col("whole")).alias("certain"), F.max("target").alias("target")
        ),
        "mix-cells",
    )
    edges = sums.groupBy("source").agg((F.max("target") - F.sum("certain")).alias("need"))
    edges = edges.select(F.col("source").alias("_s"), "need", F.lit(0).cast("long").alias("before"), F.lit(0).alias("edge"))
    running = Window.partitionBy("_s").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for k in range(levels - 1, -1, -1):
        # the step of the edge found so far, out of ``steps``, in which the running sum reaches the need
        width = steps**k
        inside = sums.join(edges, sums["source"].eqNullSafe(edges["_s"]) & sums["cell"].between(edges["edge"], edges["edge"] + (width * steps - 1)))
        step = F.floor((F.col("cell") - F.col("edge")) / width).cast("int")
        summed = inside.groupBy("_s", "need", "before", "edge", step.alias("step")).agg(F.sum("words").alias("words"))
        summed = summed.withColumn("upto", F.col("before") + F.sum("words").over(running)).where("upto >= need")
        first = F.min(F.struct("step", (F.col("upto") - F.col("words")).alias("before"))).alias("at")
        found = summed.groupBy("_s", "need", "edge").agg(first)
        edges = found.select("_s", "need", F.col("at.before").alias("before"), (F.col("edge") + F.col("at.step") * width).alias("edge"))
    placed = ranked.join(edges, ranked["source"].eqNullSafe(edges["_s"]), "left").drop("_s")
    on_edge = F.col("cell").isNotNull() & (F.col("cell") == F.col("edge"))
    sure = placed.where(F.coalesce(~on_edge, F.lit(True))).withColumn(
        "extra", (F.col("cell").isNotNull() & (F.col("edge").isNull() | (F.col("cell") < F.col("edge")))).cast("long")
    )
    in_order = Window.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    done = F.col("before") + F.coalesce(F.sum("size").over(in_order), F.lit(0))
    nearer = 2 * (F.col("need") - F.col("_done")) >= F.col("size")
    edge = placed.where(on_edge).withColumn("_done", done).withColumn("extra", (nearer & (F.col("_done") < F.col("need"))).cast("long")).drop("_done")
    both = sure.unionByName(edge).withColumn("copies", F.col("whole") + F.coalesce(F.col("extra"), F.lit(0)))
    return both.select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "m"
    )


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")
