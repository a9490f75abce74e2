"""Nearest-neighbour matching of descriptor sets: ratio test, mutual best, best of each pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import tiles


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def angle(a: Column, b: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b))))


def distances(left: DataFrame, right: DataFrame, blocks: int = 8) -> DataFrame:
    """(i, vi) x (j, vj) -> (i, j, dist): every left descriptor against every right one.

    All pairs is the operator's meaning, as a column expression for small frames; for
    the nearest ones alone see :func:`nearest_matches`.  The two sides meet in a grid of ``blocks`` x ``blocks`` cells, so the
    work spreads evenly and neither side is gathered or broadcast.
    """
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    a = left.withColumn("a", cell("i")).withColumn("b", every)
    b = right.withColumn("b", cell("j")).withColumn("a", every)
    return a.join(b, ["a", "b"]).select("i", "j", angle(F.col("vi"), F.col("vj")).alias("dist"))


def _two_frames(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(i, vi) and (j, vj) as the keypoints of frames 0 and 1, and that pair."""
    rows = left.select(F.lit(0).alias("frame"), F.col("i").alias("key"), F.col("vi").alias("d")).union(right.select(F.lit(1), "j", "vj"))
    return rows, left.sparkSession.range(1).select(F.lit(0).alias("i"), F.lit(1).alias("j"))


def mutual_ratio_matches(left: DataFrame, right: DataFrame, longest: float = 0.7, ratio: float = 0.8) -> DataFrame:
    """(i, vi) and (j, vj), with whole-number ids -> (i, j, dist) that are each other's nearest neighbour, nearer than ``longest`` and than ``ratio`` times the second nearest.

    A null descriptor is at distance 0 of every other, as in :func:`angle`.
    """
    found = _mutual(*_two_frames(left, right), longest, ratio, None, True)
    return found.select(F.col("key_i").alias("i"), F.col("key_j").alias("j"), "dist")


def nearest_matches(left: DataFrame, right: DataFrame, most: int, tile: int | None = None) -> DataFrame:
    """(i, vi) and (j, vj), with whole-number ids -> i, j, dist, rank: the ``most`` nearest of each i by distance and j; null descriptors as in :func:`mutual_ratio_matches`."""
    rows, pair = _two_frames(left, right)
    placed, n, width = tiles.tiled(rows, tile, True)
    found = tiles.met(placed, pair, n).mapInArrow(tiles.nearest(most, False, width, float("inf")), "i long, j long, side int, key long, other long, dist double")
    return best_matches(found.select(F.col("key").alias("i"), F.col("other").alias("j"), "dist"), ["i"], ["dist", "j"], most)


def best_matches(matches: DataFrame, group: list[str], order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each group in a total order; the rank is kept."""
    return matches.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= most)


def earlier_pairs(frames: DataFrame, reach: int | None = None, blocks: int = 16) -> DataFrame:
    """(frame) -> i, j: every frame j with each valid earlier frame i, or only those up to ``reach`` before it.

    Frames without ``valid`` (if that column is there) are in no pair.  Without
    ``reach`` the number of pairs is half the square of the frames, by meaning: both
    sides meet in a grid of ``blocks`` x ``blocks`` cells by an equi-join, so neither
    is broadcast.  With it every frame names its predecessors.
    """
    kept = (frames.filter("valid") if "valid" in frames.columns else frames).select(F.col("frame").cast("long").alias("frame")).filter("frame is not null").distinct()
    if reach is None:
        cell = F.pmod(F.xxhash64("frame"), F.lit(blocks)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        a = kept.select(F.col("frame").alias("i"), cell.alias("a"), every.alias("b"))
        b = kept.select(F.col("frame").alias("j"), cell.alias("b"), every.alias("a"))
        return a.join(b, ["a", "b"]).filter(F.col("i") < F.col("j")).select("i", "j")
    wanted = kept.select(F.col("frame").alias("j"), F.explode(F.sequence(F.col("frame") - reach, F.col("frame") - 1)).alias("frame"))
    return wanted.join(kept, "frame").select(F.col("frame").alias("i"), "j")


def match_frames(keypoints: DataFrame, pairs: DataFrame, longest: float = 0.7, ratio: float = 0.8, tile: int | None = None) -> DataFrame:
    """(frame, key, descriptor) and (i, j) -> i, j, key_i, key_j, dist: mutual best matches under the ratio test, for all pairs of frames at once.

    Keypoints travel in tiles, once for each pair of tiles that holds an asked pair of
    frames (:mod:`tiles`; ``tile`` keypoints each, if given); a large frame is several
    tiles.  A pair of tiles gives each keypoint's best and second best there; these are
    put together by pair of frames and keypoint.  Ties go to the smaller key; null
    descriptors take no part, nor do those of another length than the longest.
    """
    slim = keypoints.filter("key is not null").select("frame", "key", F.col("descriptor").alias("d"))
    return _mutual(slim, pairs, longest, ratio, tile, False)


def _mutual(rows: DataFrame, pairs: DataFrame, longest: float, ratio: float, tile: int | None, blanks: bool) -> DataFrame:
    placed, n, width = tiles.tiled(rows, tile, blanks)
    run = tiles.nearest(2, True, width, longest / min(ratio, 1.0) if ratio > 0 else longest)  # farther ones are neither accepted nor in the way
    found = tiles.met(placed, pairs, n).mapInArrow(run, "i long, j long, side int, key long, other long, dist double")
    best = found.groupBy("i", "j", "side", "key").agg(F.slice(F.sort_array(F.collect_list(F.struct("dist", "other"))), 1, 2).alias("x"))
    first, second = F.col("x")[0], F.coalesce(F.get("x", F.lit(1))["dist"], F.lit(float("inf")))
    fine = best.filter((first["dist"] < longest) & (first["dist"] < ratio * second)).select("i", "j", "side", "key", first["dist"].alias("dist"), first["other"].alias("other"))
    left = fine.filter("side = 0").select("i", "j", F.col("key").alias("key_i"), F.col("other").alias("key_j"), "dist")
    right = fine.filter("side = 1").select("i", "j", F.col("other").alias("key_i"), F.col("key").alias("key_j"))
    return left.join(right, ["i", "j", "key_i", "key_j"])


def similar_links(rows: DataFrame, least: float, tile: int | None = None) -> DataFrame:
    """(frame, key, d) -> u, v: edges with the same components as all pairs of keys of a frame whose inner product exceeds ``least``.

    Every pair is compared, tile against tile; a cell returns one edge a key at most.
    """
    placed, n, width = tiles.tiled(rows.filter("key is not null"), tile)
    frames = placed.select(F.col("frame").alias("i"), F.col("frame").alias("j")).distinct()
    return tiles.met(placed, frames, n, True).mapInArrow(tiles.linked(least, width), "u long, v long")


def match_chain(
    keypoints: DataFrame, pairs: DataFrame, longest: float = 0.7, ratio: float = 0.8, most: int = 128, fewest: int = 5, worst2: float = 0.0004, area: float = 400.0, verify: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs through all filters: (kept matches, history of the pairs).

    ``keypoints``: frame, key, descriptor, u, v (pixels), x, y, z (metres).  The
    stages, in order: mutual best matches, of which the nearest ``most`` stay; at least
    ``fewest`` of them; a rigid motion that ``fewest`` agree with (:func:`rigid.filter_matches`);
    their pixels span ``area`` in one of the images; and, where ``verify`` (i, j) is
    given, the dense check has passed the pair.  The history has one row a pair: i, j,
    matches (kept), state (valid, or the stage that refused it).
    """
    from .features import wide_pairs
    from .rigid import filter_matches

    point = lambda n, k: keypoints.select(F.col("frame").cast("long").alias(n), F.col("key").cast("long").alias(f"key_{n}"), *[F.col(c).alias(c + k) for c in ("u", "v", "x", "y", "z")])
    asked = pairs.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).distinct()
    raw = best_matches(match_frames(keypoints, asked, longest, ratio), ["i", "j"], ["dist", "key_i"], most)
    raw = raw.join(point("i", "1"), ["i", "key_i"]).join(point("j", "2"), ["j", "key_j"]).dropna(subset=["x1", "y1", "z1", "x2", "y2", "z2"])
    raw = raw.withColumn("match_id", F.col("rank").cast("long")).checkpoint()
    enough = raw.groupBy("i", "j").agg(F.count("*").alias("n")).filter(F.col("n") >= fewest).select("i", "j")
    moved = raw.join(enough, ["i", "j"]).select("i", "j", "match_id", "dist", "u1", "v1", "u2", "v2", *[F.col(f"{c}1").alias(f"s{c}") for c in "xyz"], *[F.col(f"{c}2").alias(f"t{c}") for c in "xyz"])
    rigid = filter_matches(moved, ["i", "j"], worst2, fewest).checkpoint()
    agreed = rigid.select("i", "j", F.explode("kept").alias("match_id"))
    agreed = agreed.join(agreed.groupBy("i", "j").agg(F.count("*").alias("n")).filter(F.col("n") >= fewest).select("i", "j"), ["i", "j"])
    kept = raw.join(agreed, ["i", "j", "match_id"]).checkpoint()
    wide = wide_pairs(kept, ["i", "j"], area).select("i", "j").distinct()
    passed = wide if verify is None else wide.join(verify.select("i", "j").distinct(), ["i", "j"], "left_semi")
    valid = kept.join(passed, ["i", "j"], "left_semi")
    marked = lambda df, name: df.select("i", "j").distinct().withColumn(name, F.lit(True))
    states = asked.join(marked(enough, "a"), ["i", "j"], "left").join(marked(agreed, "b"), ["i", "j"], "left").join(marked(wide, "c"), ["i", "j"], "left").join(marked(passed, "d"), ["i", "j"], "left")
    state = F.when(F.col("a").isNull(), "few matches").when(F.col("b").isNull(), "no rigid motion").when(F.col("c").isNull(), "small area").when(F.col("d").isNull(), "dense check").otherwise("valid")
    counts = valid.groupBy("i", "j").agg(F.count("*").alias("matches"))
    return valid, states.select("i", "j", state.alias("state")).join(counts, ["i", "j"], "left").select("i", "j", F.coalesce("matches", F.lit(0)).alias("matches"), "state")
