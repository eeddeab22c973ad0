"""Density clustering: every pair within a distance is found, without comparing all pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept, lookup
from .components import connected_components

#: Points of one block at least: a task compares two blocks.
HELD = 1024
#: A block of a larger table holds a so-many-th of its points, but no more bytes of vectors than these.
SPREAD, HELD_BYTES = 12, 32 << 20
#: Points of each block that are compared at once.
CHUNK = 1024


def _cells(points: DataFrame, eps: float, directions: int) -> DataFrame:
    """points (id, v, weight) with cell: places on the directions of most variance, in steps of eps.

    A projection never makes a distance longer, so two points within eps are in the same or in neighbouring cells.
    """
    data = points.withColumn("__features", array_to_vector("v"))
    size = len(data.head().v)
    model = PCA(k=min(directions, size), inputCol="__features", outputCol="__at").fit(data)
    at = F.transform(vector_to_array("__at"), lambda x: F.floor(x / (eps * (1 + 1e-9))).cast("long"))
    return model.transform(data).select("id", "v", "weight", at.alias("cell"))


def _units(cells: DataFrame, directions: int) -> DataFrame:
    """(unit, side, cell, block): pairs of blocks of the same or neighbouring cells, each pair once, as two rows."""
    steps = F.array(*[F.lit(x).cast("long") for x in (-1, 0, 1)])
    moved = F.array(F.array().cast("array<bigint>"))
    for _ in range(directions):
        moved = F.flatten(F.transform(moved, lambda m: F.transform(steps, lambda s: F.concat(m, F.array(s)))))
    near = cells.select("cell", "n_blocks", F.explode(moved).alias("step")).select("cell", "n_blocks", F.zip_with("cell", "step", lambda a, b: a + b).alias("other"))
    there = cells.select(F.col("cell").alias("other"), F.col("n_blocks").alias("other_blocks"))
    pairs = near.filter(F.col("cell") <= F.col("other")).join(there, "other")
    blocks = pairs.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1)))
    blocks = blocks.filter((F.col("cell") < F.col("other")) | (F.col("i") <= F.col("j"))).withColumn("unit", F.struct("cell", "i", "other", "j"))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("cell").alias("cell"), F.col("i").alias("block")), F.struct(F.lit(1).alias("side"), F.col("other").alias("cell"), F.col("j").alias("block")))
    return blocks.select(F.sha2(F.to_json("unit"), 256).alias("unit"), F.explode(sides).alias("s")).select("unit", "s.*").distinct()


def _near(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """Which rows of a and b are within eps: by products, and by differences where these can't tell."""
    sizes = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :]
    square = sizes - 2 * (a @ b.T)
    near = square <= eps * eps
    unsure = np.argwhere(np.abs(square - eps * eps) <= 1e-9 * (sizes + eps * eps))
    for k in range(0, len(unsure), 65536):
        i, j = unsure[k : k + 65536].T
        near[i, j] = np.sqrt(((a[i] - b[j]) ** 2).sum(1)) <= eps
    return near


def _sides(rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    """The two blocks of a unit; a block that is compared with itself comes once."""
    left, right = rows[rows.side == 0], rows[rows.side == 1]
    same = left["home"].iloc[0] == right["home"].iloc[0] if len(left) and len(right) else False
    return left, right, same


def _vectors(rows: pd.DataFrame) -> np.ndarray:
    return np.stack(rows.v.to_list())


def _chunks(left: int, right: int, chunk: int):
    """Slices of both sides that are compared at once."""
    return [(slice(i, i + chunk), slice(j, j + chunk)) for i in range(0, left, chunk) for j in range(0, right, chunk)]


def _counted(eps: float, chunk: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left, right, same = _sides(rows)
        if not len(left) or not len(right):
            return pd.DataFrame({"id": [], "n": []})
        a, b, of_a, of_b = _vectors(left), _vectors(right), left.weight.to_numpy(), right.weight.to_numpy()
        n_a, n_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        for x, y in _chunks(len(a), len(b), chunk):
            near = _near(a[x], b[y], eps)
            n_a[x] += near @ of_b[y]
            if not same:
                n_b[y] += near.T @ of_a[x]
        mine = pd.DataFrame({"id": left.id, "n": n_a})
        return mine if same else pd.concat([mine, pd.DataFrame({"id": right.id, "n": n_b})])

    return run


def _roots(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The root of each place; what is passed on the way is hung to it."""
    found = parent[at]
    while (more := parent[found] != found).any():
        found[more] = parent[found[more]]
    parent[at] = found
    return found


def _join(parent: np.ndarray, links: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> None:
    """One root for all places that links (rows at_a, columns at_b) connect."""
    if not links.any() or not (links & (_roots(parent, at_a)[:, None] != _roots(parent, at_b)[None, :])).any():
        return
    free = np.ones(len(at_a), bool)
    for k in range(len(at_a)):
        if not free[k] or not links[k].any():
            continue
        mine, theirs = np.zeros(len(at_a), bool), links[k].copy()
        while True:  # from one side to the other until nothing is added
            more = links[:, theirs].any(1)
            if (more == mine).all():
                break
            mine, theirs = more, theirs | links[more].any(0)
        free &= ~mine
        roots = _roots(parent, np.concatenate([at_a[mine], at_b[theirs]]))
        parent[roots] = roots.min()


def _linked(eps: float, chunk: int):
    """Links of core points, as stars of what is connected within the unit, and for each other point its least core neighbour."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left, right, same = _sides(rows)
        if not len(left) or not len(right):
            return pd.DataFrame({"src": [], "dst": [], "core": []})
        left, right = left.sort_values("id", kind="stable"), right.sort_values("id", kind="stable")
        a, b, core_a, core_b = _vectors(left), _vectors(right), left.core.to_numpy(), right.core.to_numpy()
        ids_a, ids_b = left.id.to_numpy(), right.id.to_numpy()
        ids, begin = (ids_a, 0) if same else (np.concatenate([ids_a, ids_b]), len(a))
        parent, linked = np.arange(len(ids)), np.zeros(len(ids), bool)
        first_a, first_b = np.full(len(a), len(b)), np.full(len(b), len(a))
        for x, y in _chunks(len(a), len(b), chunk):
            near = _near(a[x], b[y], eps)
            for first, m, start in ((first_a[x], near & core_b[y], y.start), (first_b[y], near.T & core_a[x], x.start)):
                has = m.any(1)
                first[has] = np.minimum(first[has], start + m[has].argmax(1))  # sides are in order of id
            at_a, at_b = x.start + np.flatnonzero(core_a[x]), begin + y.start + np.flatnonzero(core_b[y])
            links = near[core_a[x]][:, core_b[y]]
            linked[at_a[links.any(1)]] = linked[at_b[links.any(0)]] = True
            _join(parent, links, at_a, at_b)
        out = []
        for own, core, first, other in ((ids_a, core_a, first_a, ids_b), *(() if same else ((ids_b, core_b, first_b, ids_a),))):
            has = ~core & (first < len(other))
            out.append(pd.DataFrame({"src": own[has], "dst": other[first[has]], "core": False}))
        some = np.flatnonzero(linked)
        out.append(pd.DataFrame({"src": ids[_roots(parent, some)], "dst": ids[some], "core": True}))
        return pd.concat(out)

    return run


def _held(points: int, size: int) -> int:
    """Points of a block: a share of all, so that a point goes to as many tasks in a large table as in a small one, until memory bounds it."""
    return max(HELD, min(points // SPREAD, HELD_BYTES // (8 * size)))


def dbscan(points: DataFrame, eps: float, min_points: int, id_col: str = "report_id", vector_col: str = "v", directions: int = 3) -> DataFrame:
    """(id, n_near, core, cluster): density clusters of vectors by Euclidean distance.

    n_near counts the points within eps, the point itself among them; from min_points on it is a core point. Core points
    within eps of each other share a cluster, named by its least core id. Another point within eps of core points takes the
    cluster of the one of least id; the rest is noise, with a null cluster. Ids are unique. Equal vectors are one point
    of their number. Points are dealt out by cells of a few directions, large cells in blocks of _held points; exact
    for any directions, which only decide how many blocks meet. Null vectors are noise of no neighbours.
    """
    kind = points.schema[id_col].dataType.simpleString()
    plain = points.select(F.col(id_col).alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"))
    known = plain.filter("v is not null")
    groups = kept(known.groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight")))
    none = points.sparkSession.createDataFrame([], f"rep {kind}, n_near long, core boolean, cluster {kind}")
    judged = _judged(groups.select(F.col("rep").alias("id"), "v", "weight"), eps, min_points, directions, kind) if not groups.isEmpty() else none
    members = lookup(known, groups, ["v"], "weight", "id", 1000).select("id", "rep", "weight")
    placed = members.join(judged, "rep").select("id", "n_near", "core", "cluster")
    lost = plain.filter("v is null").select("id", F.lit(0).cast("long"), F.lit(False), F.lit(None).cast(kind))
    return placed.union(lost).withColumnRenamed("id", id_col)


def _judged(points: DataFrame, eps: float, min_points: int, directions: int, kind: str) -> DataFrame:
    size = len(points.head().v)
    directions = min(directions, size)
    placed = kept(_cells(points, eps, directions))
    held = _held(placed.count(), size)
    cells = kept(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).withColumn("n_blocks", F.ceil(F.col("n") / held).cast("int")))
    dealt = lookup(placed, cells, ["cell"], "n", "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int"))
    units = kept(_units(cells, directions))
    home = F.concat_ws(" ", F.array_join(F.transform("cell", lambda x: x.cast("string")), ","), "block")
    met = lambda rows: units.join(rows, ["cell", "block"]).withColumn("home", home)
    counts = met(dealt).select("unit", "side", "home", "id", "v", "weight").groupBy("unit").applyInPandas(_counted(eps, CHUNK), f"id {kind}, n long")
    near = kept(counts.groupBy("id").agg(F.sum("n").alias("n_near")).withColumn("core", F.col("n_near") >= min_points))
    flagged = dealt.join(near.select("id", "core"), "id")
    links = kept(met(flagged).select("unit", "side", "home", "id", "v", "core").groupBy("unit").applyInPandas(_linked(eps, CHUNK), f"src {kind}, dst {kind}, core boolean"))
    joined = connected_components(links.filter("core").select("src", "dst"))
    cores = kept(near.filter("core").select(F.col("id").alias("node")).join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("cluster"), F.lit(1).alias("n")))
    beside = links.filter("not core").groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("node"))
    anchor = near.join(beside, "id", "left").withColumn("node", F.when(F.col("core"), F.col("id")).otherwise(F.col("node")))
    return anchor.join(cores.drop("n"), "node", "left").select(F.col("id").alias("rep"), "n_near", "core", "cluster")
