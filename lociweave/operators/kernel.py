"""Spatial neighbourhoods: radius joins over a grid, kernels and spacing.

A plain distance join is a nested loop over all pairs. Here space is cut into cells as wide
as the radius; a spot meets the spots of its own and the adjacent cells by an equi-join,
which Spark hash-partitions. Where all pairs are the result, crowded cells are dealt to several
tasks and the number of tasks follows the number of pairs. Coordinates are x, y and, where there is such a column, z; a null z is a zero.

Spots of equal coordinates have the same neighbours and weights. ``places`` makes one of them,
so what is made for pairs does not grow with the square of a crowd at one place.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import product
from math import prod
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import gaussian, wendland
from ..sources.lineage import cut


#: Pairs of one cell that a task looks at together, about, and tasks of the join at most.
PAIRS, TASKS = 2**24, 20_000


def axes(coords: DataFrame) -> list[str]:
    return [a for a in ("x", "y", "z") if a in coords.columns]


def _place(coords: DataFrame) -> list[Column]:
    """The columns that make a place; zeros without a sign."""
    value = lambda a: F.coalesce(a, F.lit(0.0)) if a == "z" else F.col(a)
    return [F.col("sample_id"), *[F.when(value(a) == 0, F.lit(0.0)).otherwise(value(a)).alias(a) for a in axes(coords)]]


def places(coords: DataFrame) -> DataFrame:
    """(sample_id, spot_id, x, y, z if any, n): the spots of a sample at equal coordinates as one, under the least of their ids, and how many they are."""
    return coords.groupBy(*_place(coords)).agg(F.min("spot_id").alias("spot_id"), F.count("*").alias("n"))


def at_places(coords: DataFrame, found: DataFrame) -> DataFrame:
    """(sample_id, spot_id, place, n): of each spot the id of its place among ``found``, the places of ``coords``, and how many spots that has."""
    on = ["sample_id", *axes(coords)]
    return coords.select(*_place(coords), "spot_id").join(found.select(*on, F.col("spot_id").alias("place"), "n"), on).select("sample_id", "spot_id", "place", "n")


def _by_pairs(left: DataFrame, right: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``deal`` and ``other``: of a cell, tiles of about as many left rows as right ones make ``PAIRS`` pairs at most under one key, and the tasks are as many as the pairs ask for.

    A row is sent once for each tile of the other side. Tasks by bytes are too few, as a few rows make many pairs.
    """
    side = math.isqrt(PAIRS)
    cells = cut(left.groupBy(*key).agg(F.count("*").alias("n")).join(right.groupBy(*key).agg(F.count("*").alias("near")), key))
    total = cells.agg(F.sum(F.col("n") * F.col("near"))).first()[0] or 0
    deals = cells.select(*key, *[F.ceil(F.col(c) / side).cast("int").alias(d) for c, d in (("n", "deals"), ("near", "others"))])
    dealt = lambda c, d: F.pmod(F.xxhash64(c), d).cast("int")
    each = lambda d: F.explode(F.sequence(F.lit(0), F.col(d) - 1))
    left = left.join(deals, key).withColumn("deal", dealt("i", "deals")).withColumn("other", each("others")).drop("deals", "others")
    right = right.join(deals, key).withColumn("other", dealt("j", "others")).withColumn("deal", each("deals")).drop("deals", "others")
    n = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(TASKS, math.ceil(total / PAIRS)))
    return left.repartition(n, *key, "deal", "other"), right.repartition(n, *key, "deal", "other")


def radius_pairs(coords: DataFrame, radius: float, inclusive: bool = False, of: DataFrame | None = None, many: bool = False) -> DataFrame:
    """(sample_id, i, j, d2) for all spots of a sample within ``radius``, themselves included, both directions. ``of``: only pairs of these spots i.

    ``many``: crowded cells are dealt to several tasks, at the price of a count before.
    """
    names = axes(coords)
    at = lambda side: [(F.coalesce(a, F.lit(0.0)) if a == "z" else F.col(a)).alias(f"{a}{side}") for a in names]
    cell = lambda a, side: F.floor(F.col(f"{a}{side}") / radius).alias(f"c{a}")
    left = (coords if of is None else of).select("sample_id", F.col("spot_id").alias("i"), *at("i"))
    left = left.select("*", *[cell(a, "i") for a in names])
    right = coords.select("sample_id", F.col("spot_id").alias("j"), *at("j"))
    right = right.select("*", *[cell(a, "j") for a in names])
    around = F.array(*[F.struct(*[(F.col(f"c{a}") + step).alias(f"c{a}") for a, step in zip(names, steps, strict=True)]) for steps in product((-1, 0, 1), repeat=len(names))])
    right = right.withColumn("near", F.explode(around)).select("sample_id", "j", *[f"{a}j" for a in names], "near.*")
    squares = [(F.col(f"{a}i") - F.col(f"{a}j")) * (F.col(f"{a}i") - F.col(f"{a}j")) for a in names]
    key = ["sample_id", *[f"c{a}" for a in names]]
    if many:
        left, right = _by_pairs(left, right, key)
        key += ["deal", "other"]
    pairs = left.join(right, key).withColumn("d2", sum(squares[1:], squares[0]))
    limit = F.lit(radius * radius)
    return pairs.where(F.col("d2") <= limit if inclusive else F.col("d2") < limit).select("sample_id", "i", "j", "d2")


def wendland_kernel(coords: DataFrame, radius: float) -> DataFrame:
    """(sample_id, i, j, k): symmetric, with a diagonal of one; no entry at the radius itself."""
    return radius_pairs(coords, radius, many=True).select("sample_id", "i", "j", wendland(F.sqrt("d2") / radius).alias("k"))


def gaussian_kernel(coords: DataFrame, sigma: float, reach: float = 12.0, digits: int | None = None) -> DataFrame:
    """Gaussian weights within ``reach`` sigmas; at 12, those beyond are under 3e-16 of the diagonal, which sums in doubles do not see.

    ``digits``: weights rounded to so many, all that are not zero then, of any distance. They lie where exp(-d2 / (4 sigma^2)) is half a unit at least, and no pairs beyond are looked at.
    """
    if digits is not None:
        reach = 2 * math.sqrt(math.log(2 * 10.0**digits)) * (1 + 1e-9)
    found = radius_pairs(coords, reach * sigma, many=True).select("sample_id", "i", "j", gaussian(F.col("d2"), sigma).alias("k"))
    if digits is None:
        return found
    return found.where(F.col("k") >= float(f"5e-{digits + 1}")).withColumn("k", F.round("k", digits) + F.lit(0.0))  # what rounds up, told before the costly rounding


def isolated_fraction(coords: DataFrame, radius: float) -> DataFrame:
    """(sample_id, isolated): the share of spots with no other spot at or within the radius."""
    names = axes(coords)
    at = places(coords)
    at = at.where(reduce(and_, [F.col(a) - F.col(a) == 0 for a in names]))  # finite ones, which have neighbours
    # two spots of a cell this wide are near each other, so only those alone in theirs need a look around: a few for each cell of the join
    width = radius / len(names) ** 0.5 * (1 - 1e-9)
    cells = at.groupBy("sample_id", *[F.floor(F.col(a) / width).alias(f"c{a}") for a in names])
    single = cells.agg(F.sum("n").alias("spots"), F.min("spot_id").alias("spot_id"), *[F.min(a).alias(a) for a in names]).where("spots = 1")
    near = radius_pairs(at, radius, inclusive=True, of=single).groupBy("sample_id", "i").agg(F.count("*").alias("near"))
    alone = near.where("near = 1").groupBy("sample_id").agg(F.count("*").alias("alone"))
    total = at.groupBy("sample_id").agg(F.sum("n").alias("n"))
    return total.join(alone, "sample_id", "left").select("sample_id", (F.coalesce("alone", F.lit(0)).cast("double") / F.col("n")).alias("isolated"))


def mean_spacing(coords: DataFrame, first_radius: float) -> DataFrame:
    """(sample_id, spacing): mean distance to the nearest other spot.

    Spots at one place are nought apart. Spots that find none within the radius go on to one four times as wide, so each step joins few spots with near cells.
    A first radius that is wider than the densest sample's spots lie apart on average is cut down to that, so a cell holds few.
    """
    coords = cut(places(coords))
    names = axes(coords)
    spans = coords.groupBy("sample_id").agg(F.count("*").alias("n"), *[(F.max(a) - F.min(a)).alias(a) for a in names]).collect()  # samples
    apart = []
    for r in spans:
        sides = sorted((r[a] for a in names), reverse=True)
        apart.append(2 * max((prod(sides[:d]) / r["n"]) ** (1 / d) for d in range(1, len(sides) + 1)))
    widest = 2 * max([first_radius, *[r[a] for r in spans for a in names]])
    crowds = coords.where("n > 1").select("sample_id", F.col("spot_id").alias("i"), "n", F.lit(0.0).alias("d"))
    left, radius, done = coords.where("n = 1"), min([first_radius, *[a for a in apart if a > 0]]), crowds
    while True:
        pairs = radius_pairs(coords, radius, inclusive=True, of=left).where("i <> j")
        found = cut(pairs.groupBy("sample_id", "i").agg(F.lit(1).cast("long").alias("n"), F.sqrt(F.min("d2")).alias("d")))
        done = done.union(found)
        left = cut(left.join(found.select("sample_id", F.col("i").alias("spot_id")), ["sample_id", "spot_id"], "left_anti"))
        if radius > widest or left.isEmpty():
            return done.groupBy("sample_id").agg((F.sum(F.col("d") * F.col("n")) / F.sum("n")).alias("spacing"))
        radius *= 4
