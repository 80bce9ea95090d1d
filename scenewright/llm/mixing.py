"""Mixing sources to target weights by Pareto order sampling.

Every source has a target in words. How often a document may be expected in the mix grows with its length: by the
number of binary digits of its size, times what makes the expected words of its source meet the target, up to the cap.
The whole part of that number are copies that are certain; the fraction is the document's own inclusion probability for
one copy more. Documents are ranked by their random odds over their inclusion odds, and the first of that order whose
words fill what is left of the target are taken: a sample of fixed size with unequal probabilities. The draw is a hash
of the document's key, so every run agrees and a document's draw does not depend on other documents.

The order is never sorted as a whole. The words of equal slices of the order are summed, which shows the slice where
a source's target is reached, and only that slice, of about 50,000 rows, is ranked row by row: near the cut, odds of one,
no slice has more than its share of the rows. What comes out of that is one cut value for each source; applying it to
the documents is a join with at most 64 rows per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenewright.llm.common import WORD, cut, sliced


def n_words(text: Column) -> Column:
    """The number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """The target of each source: sizes has (source, source_size), one row per source.

    Sources in code point order, null last, weigh `weights` in turn. Together they get share x all sizes, in
    proportion to their weights; none gets over cap x its own size, and what it can't take is dealt to the others by
    weight until none is above. So there is one level at which a target is the lesser of its cap and level x weight;
    sources sorted by cap over weight show where it lies."""
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("_i") - 1, F.lit(len(weights))) + 1).cast("int"))
    by_cap = Window.orderBy(F.col("_cap") / F.col("_w"), "_i")
    all_rows = Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    told = (
        sizes.withColumn("_i", F.row_number().over(ordered))
        .withColumn("_w", w)
        .withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
        .withColumn("_at", F.row_number().over(by_cap))
    )
    before = Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("_at").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    told = told.withColumn("_all", F.sum("source_size").over(all_rows) * F.lit(float(share)))
    level = (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(onward)
    told = told.withColumn("_level", level)
    first = F.first(F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.col("_level")), ignorenulls=True).over(all_rows)
    told = told.withColumn("_at_last", first)
    target = F.when(F.col("_at_last").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_at_last") * F.col("_w")))
    return told.select("source", "source_size", target.alias("target"))


def draw(keys: list[str], seed: int) -> Column:
    """A uniform number in (0, 1) from a hash of the keys; nulls are hashed like values."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 12)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 52))


def pareto_rank(u: Column, inclusion: Column) -> Column:
    """Random odds over inclusion odds. An inclusion of 0 ranks last of all and one of 1 first."""
    odds = u / (1 - u)
    return (
        F.when(inclusion <= 0, F.lit(float("inf")))
        .when(inclusion >= 1, F.lit(0.0))
        .otherwise(odds / (inclusion / (1 - inclusion)))
    )


def digits(size: Column) -> Column:
    """The number of binary digits of a size; 0 has none. At most 63."""
    return F.when(size > 0, F.floor(F.log2(size.cast("double"))).cast("int") + 1).otherwise(0)


def expected(classes: DataFrame, cap: float) -> DataFrame:
    """classes (source, digits, words, target) with copies: how often a document of that length is expected in the mix,
    at most cap. It is level x (digits + 1), where the level makes a source's expected words its target. Classes that
    reach the cap do so from the longest on, so the level is the first that leaves all shorter ones below it."""
    down = Window.partitionBy("source").orderBy(F.desc("digits"))
    weight = (F.col("digits") + 1).cast("double")
    longer = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum(weight * F.col("words")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = F.when(onward > 0, (F.col("target") - cap * longer) / onward)
    told = classes.withColumn("_level", level)
    all_ = Window.partitionBy("source").orderBy(F.desc("digits")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first(F.when(F.col("_level") * weight <= cap, F.col("_level")), ignorenulls=True).over(all_)
    told = told.withColumn("_first", first)
    copies = F.when(F.col("target") <= 0, 0.0).otherwise(F.least(F.lit(float(cap)), F.coalesce(F.greatest(F.col("_first"), F.lit(0.0)) * weight, F.lit(float(cap)))))
    return told.withColumn("copies", copies).drop("_level", "_first")


def mix(
    df: DataFrame,
    keys: list[str],
    *,
    source: str = "source",
    size: str = "size",
    weights: list[float] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 9,
) -> DataFrame:
    """df with source_size, target, inclusion, copies and taken (copies x size) of each row. inclusion is the row's
    probability of one copy more than its certain ones.

    df is read twice, for the sizes and for the result: pass a table, not a costly plan. A null source is a source of
    its own, sorted last; a null size counts as 0; a source without words has target 0 and takes nothing. Rows with
    equal keys and sizes share one draw, so they are taken or left together. An empty table gives an empty one. Columns
    of df named like the new ones are replaced."""
    df = df.drop("source_size", "target", "inclusion", "copies", "taken")
    words = F.coalesce(F.col(size), F.lit(0)).cast("long")
    rows = cut(df.select(F.col(source).alias("source"), words.alias("size"), digits(words).alias("digits"), draw(keys, seed).alias("u")))
    classes = cut(rows.groupBy("source", "digits").agg(F.sum("size").alias("words"), F.count("*").alias("n")))
    aim = cut(targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), list(weights), share, cap))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    plan = classes.join(aim.withColumnRenamed("source", "s"), same("source", "s")).drop("s")
    whole = F.floor(F.col("copies") + F.lit(1e-12))
    plan = expected(plan, cap).withColumn("whole", whole.cast("long"))
    plan = cut(plan.withColumn("inclusion", F.greatest(F.lit(0.0), F.col("copies") - F.col("whole"))).drop("copies"))
    said = plan.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    slices = sliced(said)
    rest = cut(plan.groupBy("source").agg((F.first("target") - F.sum(F.col("whole") * F.col("words"))).alias("rest")))

    # an order of (0, 1] in place of (0, inf]; one half is where random and inclusion odds are even
    rank = pareto_rank(F.col("u"), F.col("inclusion"))
    place = F.when(F.isnan(rank / (1 + rank)), 1.0).otherwise(rank / (1 + rank))
    of = plan.select(F.col("source").alias("s"), F.col("digits").alias("d"), "inclusion")
    placed = rows.join(of, same("source", "s") & same("digits", "d")).select("source", "size", "u", place.alias("place"))
    dealt = placed.where("place < 1").withColumn("slice", F.floor(F.col("place") * slices).cast("int"))
    sums = dealt.groupBy("source", "slice").agg(F.sum("size").alias("words")).withColumnRenamed("source", "s")
    before = Window.partitionBy("s").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("below", F.coalesce(F.sum("words").over(before), F.lit(0)))
    met = sums.join(rest, same("s", "source")).where((F.col("rest") > F.col("below")) & (F.col("rest") <= F.col("below") + F.col("words")))
    met = cut(met.select("s", F.col("slice").alias("at"), "below", "rest"))
    inside = dealt.join(met, same("source", "s") & (F.col("slice") == F.col("at")))
    ranked = inside.groupBy("s", "place", "u", "below", "rest").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("s").orderBy("place", "u").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.withColumn("sum", F.col("below") + F.sum("words").over(upto))
    # the cut lies after the row that comes nearest to the target, or before the slice's first one
    options = ranked.select("s", "place", "u", F.abs(F.col("sum") - F.col("rest")).alias("off")).unionByName(
        met.select("s", (F.col("at") / F.lit(float(slices))).alias("place"), F.lit(-1.0).alias("u"), F.abs(F.col("below") - F.col("rest")).alias("off"))
    )
    ends = options.groupBy("s").agg(F.min(F.struct("off", "place", "u")).alias("best"))
    ends = rest.join(ends, same("source", "s"), "left").select(
        F.col("source").alias("s"),
        # without a slice that meets it, nothing or all of the rest is taken
        F.coalesce("best.place", F.when(F.col("rest") >= 1, F.lit(1.0)).otherwise(F.lit(0.0))).alias("_mix_place"),
        F.coalesce("best.u", F.lit(-1.0)).alias("_mix_u"),
    )
    plan = plan.join(ends, same("source", "s")).select(
        F.col("source").alias("_mix_source"), F.col("digits").alias("_mix_digits"), "source_size", "target", F.col("whole").alias("_mix_whole"),
        F.col("inclusion"), "_mix_place", "_mix_u",
    )
    plan = cut(plan)
    out = df.withColumn("_mix_d", digits(words)).withColumn("_mix_draw", draw(keys, seed))
    out = out.join(plan, out[source].eqNullSafe(plan["_mix_source"]) & (F.col("_mix_d") == F.col("_mix_digits")))
    rank = pareto_rank(F.col("_mix_draw"), F.col("inclusion"))
    place = F.when(F.isnan(rank / (1 + rank)), 1.0).otherwise(rank / (1 + rank))
    first = (place < F.col("_mix_place")) | ((place == F.col("_mix_place")) & (F.col("_mix_draw") <= F.col("_mix_u")))
    copies = F.col("_mix_whole") + F.when(first, 1).otherwise(0)
    out = out.withColumn("copies", copies.cast("int")).withColumn("taken", (F.col("copies") * words).cast("long"))
    return out.drop("_mix_source", "_mix_digits", "_mix_whole", "_mix_place", "_mix_u", "_mix_d", "_mix_draw")
