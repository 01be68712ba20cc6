"""Pooled quantile forest (M3) on Spark ML, kept as tables.

One model over all series (a global model): the design matrix is the scaled sliding windows
(W6–W9): 52 scaled lags + the step id → scaled target. A Spark ML random forest is grown on it and
written down as two tables:

* ``nodes``: (tree, node, feature, limit, left, right); node 0 is a tree's root, a leaf has no feature, and inputs whose
  ``feature`` is at most ``limit`` go left;
* ``leaves``: (tree, node, n, l_q50, l_q_cr), the exact quantiles of the training targets that fall in every leaf, by
  radix selection (a leaf's size grows with the data).

A forecast needs nothing but these tables. Rows go down one level by one look-up in the broadcast nodes (at most trees ·
2^(depth + 1) rows), all levels in one stage; a prediction averages, over trees, the quantiles of the leaves it
lands in (a quantile regression forest in the spirit of Meinshausen 2006), then
uncrosses (A3), rescales (A4) and clips (F23). The first k trees of a forest are a forest of k trees, so one fit serves
every number of trees of the grid. Fits of several origins and depths run side by side over one design matrix.
"""

from __future__ import annotations

import uuid
from functools import reduce
from typing import NamedTuple

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfcast.config import SEED, PanelSpec
from shelfcast.operators.features import design_matrix, latest_context, scaled_windows
from shelfcast.operators.quantiles import exact_percentiles, uncross
from shelfcast.session import delete_path, materialize, scratch_path, side_by_side

CONTEXT = 52
LEAF_QUANTILES = ("l_q50", "l_q_cr")


class ForestTables(NamedTuple):
    nodes: DataFrame
    leaves: DataFrame
    depth: int

    def write(self, path: str) -> None:
        """The fitted model as Parquet; ``read_forest`` gives it back without another fit."""
        self.nodes.withColumn("depth", F.lit(self.depth)).write.mode("overwrite").parquet(f"{path}/nodes")
        self.leaves.write.mode("overwrite").parquet(f"{path}/leaves")


def read_forest(spark: SparkSession, path: str) -> ForestTables:
    nodes = spark.read.parquet(f"{path}/nodes")
    return ForestTables(nodes.drop("depth"), spark.read.parquet(f"{path}/leaves"), nodes.first()["depth"])


def training_rows(panel: DataFrame, cut: int, horizon: int) -> DataFrame:
    """(x, target, end_wk), written once: rows with ``end_wk`` before an earlier cut are that cut's training rows."""
    rows = design_matrix(scaled_windows(panel.filter(F.col("wk") < cut), CONTEXT, horizon))
    return materialize(rows.select(_inputs("x", "step").alias("x"), "target", "end_wk"))


def _inputs(x: str, step: str) -> Column:
    return F.concat(F.col(x), F.array(F.col(step).cast("double")))


def node_table(model, spark: SparkSession) -> DataFrame:
    """The ``nodes`` of a fitted forest, read from its saved form, and each leaf's number in its tree (``leaf``)."""
    path = scratch_path(spark, f"forest-{uuid.uuid4().hex}")
    model.write().save(path)
    try:
        n = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
        inner = F.col("leftChild") >= 0
        flat = n.select("tree", F.col("id").alias("node"), F.when(inner, F.col("split.featureIndex")).alias("feature"),
                        F.when(inner, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("limit"),
                        F.when(inner, F.col("leftChild")).alias("left"), F.when(inner, F.col("rightChild")).alias("right"))
        # a tree's ids run left before right, and so do the numbers of its leaves in leafCol
        number = F.row_number().over(Window.partitionBy("tree", F.col("feature").isNull()).orderBy("node")) - 1
        return materialize(flat.withColumn("leaf", F.when(F.col("feature").isNull(), number)))
    finally:
        delete_path(spark, path)


def leaves_of(rows: DataFrame, nodes: DataFrame, depth: int, x: str = "x") -> DataFrame:
    """``rows`` once per tree, with ``tree`` and ``node``, the leaf that their inputs ``x`` reach in it."""
    trees = nodes.agg(F.max("tree")).scalar()
    at = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), trees))).withColumn("node", F.lit(0))
    inner = F.broadcast(nodes.filter("feature is not null").select(
        F.col("tree").alias("_tree"), F.col("node").alias("_node"), "feature", "limit", "left", "right"))
    for _ in range(depth):
        step = (F.when(F.col("feature").isNull(), F.col("node"))
                 .when(F.get(x, F.col("feature")) <= F.col("limit"), F.col("left")).otherwise(F.col("right")))
        below = at.join(inner, (F.col("tree") == F.col("_tree")) & (F.col("node") == F.col("_node")), "left")
        at = below.select(*rows.columns, "tree", step.alias("node"))
    return at


def fit_tables(train: DataFrame, levels, depth: int = 8, trees: int = 20, seed: int = SEED, min_leaf: int = 50,
               subsample: float = 0.5) -> ForestTables:
    """The forest of ``train`` (x, target) as tables."""
    points = train.select(array_to_vector("x").alias("features"), F.col("target").alias("label"))
    rf = RandomForestRegressor(numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, subsamplingRate=subsample,
                               seed=seed, featureSubsetStrategy="onethird", leafCol="leaf")
    model = rf.fit(points)
    nodes = node_table(model, train.sparkSession)
    placed = model.transform(points).select("label", F.posexplode(vector_to_array("leaf")).alias("tree", "leaf"))
    placed = placed.select("label", "tree", F.col("leaf").cast("int").alias("leaf"))
    leaves = exact_percentiles(placed, ["tree", "leaf"], "label", list(levels), list(LEAF_QUANTILES))
    leaves = leaves.join(F.broadcast(nodes.filter("leaf is not null").select("tree", "leaf", "node")), ["tree", "leaf"])
    return ForestTables(nodes.drop("leaf"), materialize(leaves.select("tree", "node", "n", *LEAF_QUANTILES)), depth)


def forecast_from(tables: ForestTables, panel: DataFrame, cut: int, spec: PanelSpec, sizes=(None,)) -> DataFrame:
    """(trees, sid, step, wk, q50, q_cr) of the first ``trees`` trees, for each of ``sizes`` (None: all)."""
    h = spec.horizon
    ctx = latest_context(panel, cut, CONTEXT).filter(F.col("n") == CONTEXT)
    ctx = ctx.select("sid", "scale", F.transform("context", lambda v: v / F.col("scale")).alias("lags"),
                     F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("step0"))
    rows = ctx.select("sid", "scale", "step0", _inputs("lags", "step0").alias("x"))
    per_tree = leaves_of(rows, tables.nodes, tables.depth).drop("x")
    # one row per leaf: bounded by trees · 2^depth, so broadcast
    j = per_tree.join(F.broadcast(tables.leaves.drop("n")), ["tree", "node"])
    every = F.array(*[F.lit(s).cast("int") for s in sizes])
    j = j.withColumn("trees", F.explode(F.filter(every, lambda s: s.isNull() | (F.col("tree") < s))))
    avg = j.groupBy("trees", "sid", "scale", "step0").agg(*[F.avg(c).alias(c[2:]) for c in LEAF_QUANTILES])
    out = avg.select("trees", "sid", (F.col("step0") + 1).alias("step"), (F.lit(cut) + F.col("step0")).alias("wk"),
                     "scale", *uncross("q50", "q_cr"))
    return out.select("trees", "sid", "step", "wk",
                      *[F.greatest(F.col(c) * F.col("scale"), F.lit(0.0)).alias(c) for c in ("q50", "q_cr")])


def fit_predict(panel: DataFrame, cut: int, spec: PanelSpec, levels, depth: int = 8, trees: int = 20,
                seed: int = SEED, min_leaf: int = 50, subsample: float = 0.5, train: DataFrame | None = None) -> DataFrame:
    """Forecast quantiles for the ``horizon`` weeks from ``cut``: (sid, step, wk, q50, q_cr). ``train``: rows of
    ``training_rows`` up to this cut or a later one."""
    train = training_rows(panel, cut, spec.horizon) if train is None else train
    tables = fit_tables(train.filter(F.col("end_wk") < cut), levels, depth, trees, seed, min_leaf, subsample)
    return forecast_from(tables, panel, cut, spec).drop("trees")


def quantile_forest(panel: DataFrame, cuts, spec: PanelSpec, levels, depth: int | None = None, trees: int | None = None,
                    seed: int = SEED, grid: list[dict] | None = None) -> DataFrame:
    """M4 contract over several origins: every origin and every entry of the grid, or the one of ``depth`` and ``trees``.

    One fit per origin and depth with the most trees of the grid, side by side; fewer trees are its first ones."""
    if grid is None:
        from shelfcast.plans.forecasters import GRIDS
        grid = GRIDS["quantile_forest"] if depth is None and trees is None else [{"depth": depth or 8, "trees": trees or 20}]
    sizes = {d: sorted({g["trees"] for g in grid if g["depth"] == d}) for d in sorted({g["depth"] for g in grid})}
    train = training_rows(panel, max(c for _, c in cuts), spec.horizon)

    def job(fold, cut, depth):
        def run():
            tables = fit_tables(train.filter(F.col("end_wk") < cut), levels, depth, max(sizes[depth]), seed)
            fc = forecast_from(tables, panel, cut, spec, sizes[depth])
            return fc.select(F.lit(fold).alias("fold"), F.lit(cut).alias("cut"), F.lit(depth).alias("depth"), "*")
        return run
    fitted = side_by_side(panel.sparkSession, [job(f, c, d) for f, c in cuts for d in sizes])
    return materialize(reduce(DataFrame.unionByName, fitted))
