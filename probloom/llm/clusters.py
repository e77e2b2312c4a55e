"""Grouping records into similarity clusters.

Two records are alike when their distance, every field counted in its step, is
at most 1; a cluster holds all records joined by a chain of alike ones.

Records fall into cells of half a step, whose members are all alike, so a cell
enters as one vertex with its count, sums and sum of squares. From these the
average linkage of two groups is exact: the mean squared distance over all
pairs of members is the squared distance of the means plus both variances.
Cells that hold an alike pair are linked, which gives a sparse graph. Each round
every group finds its best linked partner by average linkage and all mutual best
pairs merge in parallel; groups whose chain of best partners leads to a pair join
it in the same round, so that a round at least halves the linked groups and long
chains end. This stops when no linked pair, that is no similarity above the
threshold, is left.

Most links follow from the bounding boxes or a representative of two cells.
Those in doubt are settled exactly, but only between cells that the certain
links left apart: the cells are halved along every field, again and again, until
the bounding boxes of all parts settle a pair or few records are left to compare.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probloom.runtime import freed, stored
from probloom.schema import Feature

NEAR = 1 + 1e-9
#: Parts of a step in the first boxes of cells in doubt, pairs of records that two boxes may have to be compared record by record.
FINE, FEW = 16, 256


def _sum(xs: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, xs)


def _gap(a: str, b: str, dims: int) -> Column:
    """Least squared distance of two boxes."""
    return _sum([F.pow(F.greatest(F.lit(0.0), F.col(f"{b}.lo{i}") - F.col(f"{a}.hi{i}"), F.col(f"{a}.lo{i}") - F.col(f"{b}.hi{i}")), F.lit(2)) for i in range(dims)])


def _span(a: str, b: str, dims: int) -> Column:
    """Greatest squared distance of two boxes."""
    return _sum([F.pow(F.greatest(F.col(f"{a}.hi{i}") - F.col(f"{b}.lo{i}"), F.col(f"{b}.hi{i}") - F.col(f"{a}.lo{i}")), F.lit(2)) for i in range(dims)])


def _apart(a: str, b: str, dims: int) -> Column:
    return _sum([F.pow(F.col(f"{a}.z{i}") - F.col(f"{b}.z{i}"), F.lit(2)) for i in range(dims)])


def _box(dims: int) -> list[Column]:
    return [x for i in range(dims) for x in (F.min(f"z{i}").alias(f"lo{i}"), F.max(f"z{i}").alias(f"hi{i}"))]


def _roots(parents: DataFrame, label: str) -> DataFrame:
    """(x, p) with p followed to its root, by doubling; a root is its own parent."""
    while True:
        up = parents.select(F.col("x").alias("p"), F.col("p").alias("q"))
        two = parents.join(up, "p").select("x", F.col("p").alias("was"), F.col("q").alias("p"))
        four = stored(two.join(two.select(F.col("x").alias("p"), F.col("p").alias("q")), "p").select("x", "was", F.col("q").alias("p")), label)
        freed(parents)
        moved, parents = not four.where("was <> p").isEmpty(), four.select("x", "p")
        parents._probloom_at = four._probloom_at
        if not moved:
            return parents


def merge_rounds(links: DataFrame, groups: DataFrame, dims: int, label: str) -> DataFrame:
    """(g, cluster) of every group by reciprocal-nearest-neighbour average linkage over ``links`` (a, b).

    ``groups``: g, n, s0.. (sums) and ss (sum of squares). A cluster is named by one of its group ids.
    """
    stats = [f"s{i}" for i in range(dims)] + ["n", "ss"]
    links = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), f"{label}-links")
    names = stored(groups.select(F.col("g"), F.col("g").alias("cluster")), f"{label}-names")
    state = groups.select("g", *stats)
    while not links.isEmpty():
        a = state.select(F.col("g").alias("a"), *[F.col(c).alias(f"a_{c}") for c in stats])
        b = state.select(F.col("g").alias("b"), *[F.col(c).alias(f"b_{c}") for c in stats])
        mean = [F.pow(F.col(f"a_s{i}") / F.col("a_n") - F.col(f"b_s{i}") / F.col("b_n"), F.lit(2)) for i in range(dims)]
        spread = [F.col(f"{x}_ss") / F.col(f"{x}_n") - _sum([F.pow(F.col(f"{x}_s{i}") / F.col(f"{x}_n"), F.lit(2)) for i in range(dims)]) for x in "ab"]
        scored = links.join(a, "a").join(b, "b").select("a", "b", _sum(mean + spread).alias("d"))
        sides = scored.select(F.explode(F.array("a", "b")).alias("x"), "d", "a", "b")
        best = sides.groupBy("x").agg(F.min(F.struct("d", "a", "b")).alias("best")).select("x", "best.a", "best.b")
        # The order of links is total, so best partners form trees, each with one mutual pair; the smaller of the pair is its root.
        sides = F.count(F.lit(1)).over(Window.partitionBy("a", "b"))
        parent = F.when(F.col("x") == F.col("a"), F.when(F.col("sides") == 2, F.col("a")).otherwise(F.col("b"))).otherwise(F.col("a"))
        roots = _roots(stored(best.withColumn("sides", sides).select("x", parent.alias("p")), f"{label}-best"), f"{label}-roots")
        renamed = lambda c: roots.select(F.col("x").alias(f"old_{c}"), F.col("p").alias(f"new_{c}"))  # noqa: B023, E731
        put = lambda df, c: df.join(renamed(c), F.col(c) == F.col(f"old_{c}"), "left").withColumn(c, F.coalesce(f"new_{c}", c)).drop(f"old_{c}", f"new_{c}")  # noqa: B023, E731
        old = state, links, names, roots
        state = stored(put(state, "g").groupBy("g").agg(*[F.sum(c).alias(c) for c in stats]), f"{label}-state")
        moved = put(put(links, "a"), "b").where("a <> b")
        links = stored(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{label}-links")
        names = stored(put(names, "cluster"), f"{label}-names")
        freed(*old)
    return names


def _settled(doubt: DataFrame, points: DataFrame, dims: int) -> DataFrame:
    """(a, b): the clusters in_a, in_b of the pairs of cells in ``doubt`` (a, b, in_a, in_b) that hold an alike pair of records.

    ``points``: g, z0... Pairs of boxes are halved until their bounds settle
    them or at most ``FEW`` pairs of records are left to compare.
    """
    zs = [f"z{i}" for i in range(dims)]
    bounds = [f"{s}{i}" for i in range(dims) for s in ("lo", "hi")]
    pairs, per, links = doubt.select(F.col("a").alias("fa"), F.col("b").alias("fb"), "in_a", "in_b"), FINE, None
    held = points.select(F.col("g").alias("f"), *zs)
    while True:
        inside = pairs.select(F.explode(F.array("fa", "fb")).alias("f")).distinct()
        cell = F.xxhash64("f", *[F.floor(F.col(z) * per) for z in zs])
        held = stored(held.join(inside, "f").withColumn("of", F.col("f")).withColumn("f", cell), "doubt-points")
        boxes = stored(held.groupBy("of", "f").agg(F.count(F.lit(1)).alias("n"), *_box(dims)), "doubt-boxes")
        side = lambda c, d: boxes.select(F.col("of").alias(c), F.col("f").alias(f"n{c}"), F.col("n").alias(f"n_{c}"), F.struct(*bounds).alias(d))  # noqa: B023, E731
        met = pairs.join(side("fa", "x"), "fa").join(side("fb", "y"), "fb").where(_gap("x", "y", dims) <= NEAR)
        met = stored(met.select("in_a", "in_b", F.col("nfa").alias("fa"), F.col("nfb").alias("fb"), (F.col("n_fa") * F.col("n_fb") <= FEW).alias("few"), (_span("x", "y", dims) <= NEAR).alias("sure")), "doubt-pairs")
        sure = met.where("sure").select("in_a", "in_b").distinct()
        open_ = met.where("NOT sure").join(sure, ["in_a", "in_b"], "left_anti")
        p, q = held.select(F.col("f").alias("fa"), F.struct(*zs).alias("p")), held.select(F.col("f").alias("fb"), F.struct(*zs).alias("q"))
        close = open_.where("few").join(p, "fa").join(q, "fb").where(_apart("p", "q", dims) <= NEAR).select("in_a", "in_b").distinct()
        now = stored(sure.unionByName(close).distinct(), "doubt-links")
        links = now if links is None else links.unionByName(now)
        pairs = stored(open_.where("NOT few").join(now, ["in_a", "in_b"], "left_anti").select("fa", "fb", "in_a", "in_b"), "doubt-open")
        if pairs.isEmpty():
            return links.select(F.col("in_a").alias("a"), F.col("in_b").alias("b"))
        held, per = held.select("f", *zs), per * 2


def similarity_clusters(records: DataFrame, fields: list[Feature]) -> DataFrame:
    """(record_id, cluster_id, z0..): the cluster of every record whose fields are all known.

    ``records``: record_id and the fields, known values or NULL. A record with
    a missing field or a null id takes no part; repeated deliveries of an id
    count once; equal records share a cell and so a cluster. The cluster id is
    the smallest record id of one of its cells. Empty input, empty result.
    """
    dims = len(fields)
    z = [(F.col(f.name).cast("double") / F.lit(f.step)).alias(f"z{i}") for i, f in enumerate(fields)]
    points = records.where(reduce(lambda a, b: a & b, [F.col(f.name).isNotNull() for f in fields], F.col("record_id").isNotNull())).select("record_id", *z).dropDuplicates(["record_id"])
    key = [f"k{i}" for i in range(dims)]
    points = stored(points.select("*", *[F.floor(F.col(f"z{i}") * 2).cast("int").alias(f"k{i}") for i in range(dims)]), "points")
    middle = _sum([F.pow(F.col(f"z{i}") * 2 - F.col(f"k{i}") - 0.5, F.lit(2)) for i in range(dims)])
    cells = points.groupBy(*key).agg(
        F.min("record_id").alias("g"), F.count(F.lit(1)).alias("n"), F.sum(_sum([F.col(f"z{i}") * F.col(f"z{i}") for i in range(dims)])).alias("ss"),
        *[F.sum(f"z{i}").alias(f"s{i}") for i in range(dims)], *_box(dims), F.min(F.struct(middle, F.col("record_id"), *[F.col(f"z{i}") for i in range(dims)])).alias("rep"),
    )
    cells = stored(cells.select("*", *[F.col(f"rep.z{i}").alias(f"z{i}") for i in range(dims)]).drop("rep"), "cells")

    # Cells within reach share a column of the grid over the first fields, up to three cells on.
    lead = min(2, dims)
    steps = [(i, j) for i in range(4) for j in (range(-3, 4) if lead == 2 else (0,)) if (i, j) >= (0, 0) and max(0, i - 1) ** 2 + max(0, abs(j) - 1) ** 2 <= 4]
    far = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps]))
    box = [f"{s}{i}" for i in range(dims) for s in ("lo", "hi", "z")]
    left = cells.select("g", *key, *box, far.alias("o"))
    left = left.select("*", (F.col("k0") + F.col("o.i")).alias("t0"), *([(F.col("k1") + F.col("o.j")).alias("t1")] if lead == 2 else []))
    on = [F.col(f"a.t{i}") == F.col(f"b.k{i}") for i in range(lead)] + [F.abs(F.col(f"a.k{i}") - F.col(f"b.k{i}")) <= 3 for i in range(lead, dims)]
    same = (F.col("a.o.i") == 0) & (F.col("a.o.j") == 0)
    pairs = left.alias("a").join(cells.select("g", *key, *box).alias("b"), reduce(lambda p, q: p & q, on, (~same | (F.col("a.g") < F.col("b.g"))) & (F.col("a.g") != F.col("b.g")) & (_gap("a", "b", dims) <= NEAR)))
    pairs = stored(pairs.select(F.col("a.g").alias("a"), F.col("b.g").alias("b"), ((_span("a", "b", dims) <= NEAR) | (_apart("a", "b", dims) <= NEAR)).alias("sure")), "cell-pairs")
    names = merge_rounds(pairs.where("sure"), cells, dims, "sure")

    # Links in doubt between cells that are still apart.
    put = lambda df, c: df.join(names.select(F.col("g").alias(c), F.col("cluster").alias(f"in_{c}")), c)
    doubt = put(put(pairs.where(~F.col("sure")).select("a", "b"), "a"), "b").where("in_a <> in_b")
    doubt = stored(doubt, "doubt")
    if not doubt.isEmpty():
        inside = doubt.select(F.explode(F.array("a", "b")).alias("g")).distinct()
        links = _settled(doubt, points.join(cells.select("g", *key).join(inside, "g"), key), dims)
        stats = [f"s{i}" for i in range(dims)] + ["n", "ss"]
        grown = cells.select("g", *stats).join(names, "g").groupBy("cluster").agg(*[F.sum(c).alias(c) for c in stats]).withColumnRenamed("cluster", "g")
        again = merge_rounds(links, stored(grown, "grown"), dims, "doubt")
        names = names.join(again.select(F.col("g").alias("cluster"), F.col("cluster").alias("final")), "cluster").select("g", F.col("final").alias("cluster"))
    of_cell = cells.select("g", *key).join(names, "g").select(*key, F.col("cluster").alias("cluster_id"))
    return points.join(of_cell, key).select("record_id", "cluster_id", *[f"z{i}" for i in range(dims)])


def describe_clusters(members: DataFrame, fields: list[Feature], typical: int = 3) -> DataFrame:
    """Per cluster: size, whether it is a stray (one record alone), field means, spread and most typical records.

    Typical: nearest to the cluster's mean, equal distances by smaller id.
    ``spread`` is the root mean squared distance to the mean, in steps.
    """
    dims = len(fields)
    mean = [f"m{i}" for i in range(dims)]
    squares = F.sum(_sum([F.col(f"z{i}") * F.col(f"z{i}") for i in range(dims)]))
    size = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), *[F.avg(f"z{i}").alias(f"m{i}") for i in range(dims)], squares.alias("__q"))
    size = stored(size, "cluster-sizes")
    off = _sum([F.pow(F.col(f"z{i}") - F.col(f"m{i}"), F.lit(2)) for i in range(dims)])
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy("off", "record_id"))
    first = members.join(size.select("cluster_id", *mean), "cluster_id").select("cluster_id", "record_id", off.alias("off")).withColumn("r", rank).where(F.col("r") <= typical)
    first = first.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "record_id"))), lambda x: x["record_id"]).alias("typical_ids"))
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("__q") / F.col("size") - _sum([F.col(m) * F.col(m) for m in mean])))
    return size.join(first, "cluster_id").select("cluster_id", "size", (F.col("size") == 1).alias("stray"), *[F.round(F.col(f"m{i}") * F.lit(f.step), 6).alias(f"mean_{f.name}") for i, f in enumerate(fields)], F.round(spread, 6).alias("spread"), "typical_ids")
