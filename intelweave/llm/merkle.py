"""Manifest of a dataset as a Merkle tree, with a proof for every row.

Leaves are digests of rows. Per source, every 16 leaves in the order of their ids become a node, and so on up to the
source's subroot; subroots become the root in the same way. The levels are built once and stored as node rows that name
their parent. A recursive query then climbs from every leaf: each step finds the stored row of the node where the climb
stands, appends its siblings to the proof and folds the leaf's digest with them.

The sixteen leaves of a bottom run share all siblings above their run, so they climb in one row, as an array of folded
digests. The rows of upper nodes are stored once for each block of 256 runs below them: no key of the climb's join has
more rows than that, at the root as little as at the bottom.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import lookup, written

#: Children of a node, and bottom runs that share the stored copies of their upper nodes.
FAN = 16
BLOCK = 256


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def _lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_leaves(docs: DataFrame, columns: list[str], id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(id, source, leaf, tampered): the row's digest, and its digest with A-Z of the text lowered where 5 divides the id's crc32 (else null)."""
    changed = F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0
    fields = [_field(F.col(c)) for c in columns]
    lowered = [_field(_lowered(F.col(c)) if c == text_col else F.col(c)) for c in columns]
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), _digest(*fields).alias("leaf"), F.when(changed, _digest(*lowered)).alias("tampered"))


def _placed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows, written, with their place from 0 in a global order (nulls first): sorted by range, then each range begins where the one before ends."""
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    local = written(ranges.withColumn("__part", F.spark_partition_id()).withColumn("__pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = local.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))  # one row for each range
    return local.join(F.broadcast(before), "__part").withColumn(name, F.col("__pos") + F.col("__before")).drop("__part", "__pos", "__before")


def _runs(nodes: DataFrame) -> DataFrame:
    """(src, n, run, kids) from nodes (src, n, idx, digest): the digests of every 16 consecutive nodes, in order."""
    grouped = nodes.groupBy("src", "n", F.expr(f"idx div {FAN}").alias("run")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("k"))
    return grouped.select("src", "n", "run", F.col("k.digest").alias("kids"))


def _levels(bottom: DataFrame, most: int) -> list[DataFrame]:
    """Written tables of runs, level by level: entry k holds the runs whose children are nodes of level k; each src until one node remains."""
    out = [bottom]
    for level in range(1, most):
        nodes = out[-1].filter(F.expr(f"shiftleft(1L, {4 * level}) < n")).select("src", "n", F.col("run").alias("idx"), _digest(_joined(F.col("kids"))).alias("digest"))
        out.append(written(_runs(nodes)))
    return out


def _siblings(runs: DataFrame, level: int) -> DataFrame:
    """(src, n, level, idx, parent, before, after) of the children of runs."""
    each = runs.select("src", "n", "run", "kids", F.posexplode("kids").alias("k", "kid"))
    before, after = _joined(F.slice("kids", 1, F.col("k"))), _joined(F.slice("kids", F.col("k") + 2, FAN))
    return each.select("src", "n", F.lit(level).alias("level"), (F.col("run") * FAN + F.col("k")).alias("idx"), F.col("run").alias("parent"), before.alias("before"), after.alias("after"))


_CLIMB = """
WITH RECURSIVE climb (src, run, block, level, idx, goal, folds, proof) MAX RECURSION LEVEL 64 AS (
  SELECT src, run, block, level, idx, goal, folds, '' FROM {start}
  UNION ALL
  SELECT c.src, c.run, c.block, c.level + 1, n.parent, c.goal, transform(c.folds, f -> sha2(concat(n.before, f, n.after), 256)), concat(c.proof, n.before, n.after)
  FROM climb c JOIN {nodes} n ON n.src = c.src AND n.block = c.block AND n.level = c.level AND n.idx = c.idx
)
SELECT src, run, folds, proof FROM climb WHERE level = goal"""


def manifest(docs: DataFrame, columns: list[str], id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, leaf, subroot, root, proof (siblings' digests, left to right), proof_sha256, folded_root, verified.

    Leaves are digests of the given columns, "-" for a null one. Rows of a null source form a source of their own, the
    first; rows of a null id come first in their source and are not tampered with. Rows that agree in source and id are
    ordered by their leaf, so repeated rows give one row each and the result doesn't depend on the input's order. Other
    columns aren't read, whatever their names; very long texts are hashed as they are read; no rows give no rows.
    """
    leaves = _placed(written(row_leaves(docs, columns, id_col, source_col, text_col)), ["source", "id", "leaf"], "place")
    first = leaves.groupBy("source").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("n"))
    sources = written(_placed(written(first), ["source"], "src"))
    n_sources, most = sources.agg(F.count(F.lit(1)), F.max("n")).head()
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    if not n_sources:
        return spark.createDataFrame([], f"{id_col} {kind}, leaf string, subroot string, root string, proof string, proof_sha256 string, folded_root string, verified boolean")
    levels, above = (sum(FAN**k < n for k in range(16)) for n in (most, n_sources))

    # The bottom: runs of leaves, then the levels above them in each source, then the levels above the subroots.
    known = lookup(leaves, sources, ["source"], "n", "leaf").withColumn("idx", F.col("place") - F.col("start"))
    bottom = known.groupBy("src", "n", F.expr(f"idx div {FAN}").alias("run")).agg(F.sort_array(F.collect_list(F.struct("idx", "id", "leaf", "tampered"))).alias("leaves"))
    bottom = written(bottom)
    in_source = _levels(bottom.filter("n > 1").select("src", "n", "run", F.col("leaves.leaf").alias("kids")), levels)
    tops = [bottom.filter("n = 1").select("src", "n", F.col("leaves")[0]["leaf"].alias("subroot"))]
    tops += [runs.filter(f"{1 << 4 * k}L < n AND n <= {1 << 4 * (k + 1)}L").select("src", "n", _digest(_joined(F.col("kids"))).alias("subroot")) for k, runs in enumerate(in_source)]
    subroots = written(reduce(DataFrame.union, tops))
    over = _levels(written(_runs(subroots.select(F.lit(-1).cast("long").alias("src"), F.lit(n_sources).cast("long").alias("n"), F.col("src").alias("idx"), F.col("subroot").alias("digest")))), above)
    last = over[-1].select(_digest(_joined(F.col("kids"))).alias("root")) if above else subroots.select(F.col("subroot").alias("root"))
    root = last.head().root

    # Node rows: those of a source, and those over its subroot as further levels of that source; one for each block below.
    height = "size(filter(sequence(0, 15), k -> shiftleft(1L, 4 * k) < n))"
    n_runs = f"((n + {FAN - 1}) div {FAN})"
    stored = []
    for level in range(1, levels):
        under = 1 << 4 * (level - 1)
        to = f"sequence(idx * {under} div {BLOCK}, least((idx + 1) * {under} - 1, {n_runs} - 1) div {BLOCK})"
        stored.append(_siblings(in_source[level], level).withColumn("block", F.explode(F.expr(to))))
    for level in range(above):
        under = 1 << 4 * level
        of = _siblings(over[level], level).withColumn("s", F.explode(F.expr(f"sequence(idx * {under}, least((idx + 1) * {under}, {n_sources}L) - 1)")))
        of = of.select(F.col("s").alias("src"), "level", "before", "after").join(subroots.select("src", "n"), "src")
        stored.append(of.select("src", "n", (F.col("level") + F.expr(height)).alias("level"), F.lit(0).cast("long").alias("idx"), F.lit(0).cast("long").alias("parent"), "before", "after", F.explode(F.expr(f"sequence(0L, ({n_runs} - 1) div {BLOCK})")).alias("block")))
    path = ["src", "block", "level", "idx", "parent", "before", "after"]
    none = spark.createDataFrame([], "src long, block long, level int, idx long, parent long, before string, after string")
    nodes = written(reduce(DataFrame.union, [s.select(*path) for s in stored], none))

    # The climb. A lone leaf of a source is its subroot; other runs start on level 1, folded with the run's other leaves.
    now = "coalesce(l.tampered, l.leaf)"
    inside = f"transform(leaves, (l, i) -> sha2(concat(array_join(slice(leaves.leaf, 1, i), ''), {now}, array_join(slice(leaves.leaf, i + 2, {FAN}), '')), 256))"
    start = bottom.select("src", "run", F.expr(f"run div {BLOCK}").alias("block"), F.expr("if(n > 1, 1, 0)").alias("level"), F.col("run").alias("idx"), (F.expr(height) + above).alias("goal"), F.expr(f"if(n > 1, {inside}, transform(leaves, l -> {now}))").alias("folds"))
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        climbed = written(spark.sql(_CLIMB, start=start, nodes=nodes))
    finally:
        spark.conf.set(limit, before)

    both = bottom.join(climbed, ["src", "run"])
    sized = subroots.withColumn("n_runs", F.expr(n_runs)).select("src", "subroot", "n_runs")
    each = lookup(both, sized, ["src"], "n_runs", "run").select("leaves", "folds", "proof", "subroot", F.posexplode("leaves").alias("k", "l"))
    own = F.concat(_joined(F.slice("leaves.leaf", 1, F.col("k"))), _joined(F.slice("leaves.leaf", F.col("k") + 2, FAN)), "proof")
    done = each.select(F.col("l.id").alias(id_col), F.col("l.leaf").alias("leaf"), "subroot", F.lit(root).alias("root"), own.alias("proof"), F.get("folds", F.col("k")).alias("folded_root"))
    return done.select(id_col, "leaf", "subroot", "root", "proof", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
