"""Mixing sources to target weights by Pareto order sampling.

All steps are aggregates by (source, something bounded) and one comparison per
row: a source that holds a third of all rows is summed before the shuffle and
never meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .workspace import cut, fresh

#: No document is taken more often than this, and no source beyond this many times its size.
MOST = 3
#: Bins of the order key in which the cut of a source is searched before it is made exact.
BINS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words of a whole text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _band(size: Column) -> Column:
    """Floor of the binary logarithm, 0 for sizes below 2."""
    return F.length(F.bin(F.greatest(size, F.lit(1)))) - 1


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1)) -> DataFrame:
    """(source, source_size) -> with ``target``: shares of the total by weight, at most MOST times the source.

    Sources in code-point order (null last) take the weights in turn.  The level
    ``target / weight`` of the sources below their cap is found by a running sum
    in the order in which sources reach their cap.  This works on one row per
    source.
    """
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(turn - 1, F.lit(len(weights))).cast("int") + 1)
    order = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    capped = F.coalesce(F.sum(F.col("source_size") * MOST).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("source_size").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    levels = sizes.withColumn("weight", weight).withColumn("level", (total - capped).cast("double") / left).withColumn("at", F.row_number().over(order))
    free = F.when(F.col("level") * F.col("weight") <= F.col("source_size") * MOST, F.struct("at", "level"))
    level = F.min(free).over(W.partitionBy())["level"]
    return levels.select("source", "source_size", F.least((F.col("source_size") * MOST).cast("double"), level * F.col("weight")).alias("target"))


def _expected(bands: DataFrame) -> DataFrame:
    """(source, band, words, source_size, target) -> expected copies of a document of each source and band.

    Copies are in proportion to 16 / (16 + band), so long documents are taken
    somewhat less often, up to MOST copies; the factor makes the expected words
    of a source equal its target.  At most 63 bands a source.
    """
    order = W.partitionBy("source").orderBy("band")
    lean = F.lit(16.0) / (F.col("band") + 16)
    capped = F.coalesce(F.sum(F.col("words") * MOST).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.sum(F.col("words") * lean).over(order.rowsBetween(0, W.unboundedFollowing))
    factors = bands.withColumn("lean", lean).withColumn("factor", (F.col("target") - capped) / F.when(left > 0, left))
    free = F.when((F.col("factor") * F.col("lean") <= MOST) & (F.col("target") < F.col("source_size") * MOST), F.struct("band", "factor"))
    factor = F.min(free).over(W.partitionBy("source"))["factor"]
    return factors.select("source", "band", F.coalesce(F.least(F.lit(float(MOST)), factor * F.col("lean")), F.lit(float(MOST))).alias("expected"), "words", "source_size", "target")


def uniform(identity: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the identity and the seed alone."""
    text = F.concat(F.coalesce(identity.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(2.0**52)


def _key(identity: Column, share: Column, seed: int) -> Column:
    """odds(u) / odds(share) as q / (1 + q), in (0, 1): small keys are taken first."""
    u = uniform(identity, seed)
    return u * (1 - share) / (u * (1 - share) + share * (1 - u))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[int] = (5, 2, 1), seed: int = 0, size: Column | None = None) -> DataFrame:
    """Every row of ``docs`` with size, source_size, target, copies and taken (= copies * size).

    Each document surely gets the whole part of its expected copies.  One more
    goes to those with the smallest Pareto keys of their source, as many as its
    target holds, and to the one whose size then closes the gap best.  Decisions are a function of
    (id, source, size, seed): reruns agree, and repeated rows fare alike.

    Defined cases: a null text has size 0 and takes 0 words; a null source is a
    source, the last; null ids share one random number; an empty table gives no
    rows; input columns stay, but for those named as the outputs.
    """
    made = ["size", "source_size", "target", "copies", "taken"]
    base = docs.drop(*made)
    size = words(F.col(text_col)) if size is None else size
    slim = cut(docs.select(F.col(id_col).cast("string").alias("id"), F.col(source_col).alias("source"), size.alias("size")).withColumn("band", _band(F.col("size"))), "sizes")
    bands = cut(slim.groupBy("source", "band").agg(F.sum("size").alias("words")), "bands")
    targets = source_targets(bands.groupBy("source").agg(F.sum("words").alias("source_size")))
    plan = cut(_expected(_by_source(bands, targets)).withColumn("sure", F.floor("expected")).withColumn("share", F.col("expected") - F.col("sure")), "plan")

    rest = plan.groupBy("source").agg((F.first("target") - F.sum(F.col("words") * F.col("sure"))).alias("rest"))
    shares = plan.filter("share > 0").select(F.col("source").alias("s"), F.col("band").alias("b"), "share")
    keyed = slim.join(F.broadcast(shares) if _small(shares) else shares, slim["source"].eqNullSafe(shares["s"]) & (slim["band"] == shares["b"])).select("source", "size", _key(F.col("id"), F.col("share"), seed).alias("key"))
    keyed = keyed.withColumn("bin", F.floor(F.col("key") * BINS))
    bins = keyed.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    run = W.partitionBy("source").orderBy("bin")
    bins = _by_source(bins, rest).withColumn("upto", F.sum("words").over(run))
    edge = cut(bins.filter("upto >= rest").groupBy("source").agg(F.min("bin").alias("bin"), F.first("rest").alias("rest"), F.min("upto").alias("upto")), "edge")
    edge_key = edge.select(F.col("source").alias("s"), F.col("bin").alias("b"), "rest", "upto")
    inside = keyed.join(F.broadcast(edge_key) if _small(edge_key) else edge_key, keyed["source"].eqNullSafe(edge_key["s"]) & (keyed["bin"] == edge_key["b"])).groupBy("source", "key").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("upto").alias("upto"))
    whole = W.partitionBy("source")
    inside = inside.withColumn("before", F.col("upto") - F.sum("words").over(whole)).withColumn("at", F.col("before") + F.sum("words").over(whole.orderBy("key")))
    fits = F.col("at") <= F.col("rest")
    best = inside.groupBy("source").agg(F.max(F.when(fits, F.col("key"))).alias("cut"), (F.first("rest") - F.coalesce(F.max(F.when(fits, F.col("at"))), F.first("before"))).alias("short"))
    cuts = cut(_by_source(edge, best).select("source", "bin", F.coalesce("cut", F.lit(-1.0)).alias("cut"), "short"), "cuts")
    after = _by_source(keyed.withColumnRenamed("bin", "own"), F.broadcast(cuts) if _small(cuts) else cuts).filter((F.col("own") > F.col("bin")) | ((F.col("own") == F.col("bin")) & (F.col("key") > F.col("cut"))))
    closing = after.groupBy("source").agg(F.min(F.struct(F.abs(F.col("short") - F.col("size")).alias("off"), F.col("key").alias("key"), F.col("size").alias("size"))).alias("x"))
    cuts = _by_source(cuts, closing, "left").select("source", "bin", "cut", F.when(F.col("x.off") < F.col("short"), F.col("x.key")).alias("closing"), F.col("x.size").alias("closing_size"))

    plan_s = _by_source(plan, cuts, "left").select(F.col("source").alias("plan_source"), F.col("band").alias("plan_band"), "sure", "share", F.col("source_size").alias("plan_size"), F.col("target").alias("plan_target"), F.col("bin").alias("cut_bin"), "cut", "closing", "closing_size")
    plan_s = cut(plan_s, "plan")
    names = {c: fresh(base, c) for c in [*plan_s.columns, *made]}
    plan_s = plan_s.toDF(*[names[c] for c in plan_s.columns])
    sized = base.withColumn(names["size"], size)
    joined = sized.join(F.broadcast(plan_s) if _small(plan_s) else plan_s, sized[source_col].eqNullSafe(plan_s[names["plan_source"]]) & (_band(sized[names["size"]]) == plan_s[names["plan_band"]]))
    get = lambda c: F.col(f"`{names[c]}`")
    key = _key(F.col(id_col).cast("string"), get("share"), seed)
    more = (get("share") > 0) & (get("cut_bin").isNull() | (F.floor(key * BINS) < get("cut_bin")) | ((F.floor(key * BINS) == get("cut_bin")) & (key <= get("cut"))))
    more = more | F.coalesce((key == get("closing")) & (get("size") == get("closing_size")), F.lit(False))
    copies = get("sure") + F.when(more, 1).otherwise(0)
    return joined.select(*[F.col(f"`{c}`") for c in base.columns], get("size").alias("size"), get("plan_size").alias("source_size"), get("plan_target").alias("target"), copies.cast("int").alias("copies"), (copies * get("size")).cast("long").alias("taken"))


def _by_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """A join on source, where null equals null."""
    right = right.withColumnRenamed("source", "right_source")
    return left.join(right, left["source"].eqNullSafe(right["right_source"]), how).drop("right_source")


def _small(df: DataFrame, rows: int = 100_000) -> bool:
    """Whether a table of a few short columns may be broadcast: it is counted, up to the bound."""
    return df.limit(rows + 1).count() <= rows


def mixture(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, in the input's columns."""
    mixed = mix_sources(docs, **options)
    return mixed.filter("copies > 0").withColumn(fresh(mixed, "copy"), F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[f"`{c}`" for c in docs.columns])
