"""Connected components of an edge table by minimum labels and pointer jumping, and spanning forests by best edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaicq.workspace import materialise


def connected_components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(node, component): the least node of each node's component; lineage is cut each round."""
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = materialise(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "graph")
    labels = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("c")), "graph")
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), "c"), "v").groupBy("u").agg(F.min("c").alias("n"))
        low = labels.join(near, "u", "left").select("u", F.least("c", F.coalesce("n", "c")).alias("c"), F.col("c").alias("was"))
        jump = low.select(F.col("u").alias("c"), F.col("c").alias("cc"))
        step = materialise(low.join(jump, "c", "left").select("u", F.least("c", F.coalesce("cc", "c")).alias("c"), "was"), "graph")
        if step.where("c <> was").isEmpty():
            return step.select(F.col("u").alias("node"), F.col("c").alias("component"))
        labels = step.select("u", "c")


def _ended(steps: DataFrame) -> DataFrame:
    """(node, to): where the chain of each node ends, by pointer doubling; a chain ends at a node that points to itself."""
    steps = materialise(steps, "chains")
    while True:
        jump = steps.select(F.col("node").alias("to"), F.col("to").alias("_on"))
        further = materialise(steps.join(jump, "to", "left").select("node", F.coalesce("_on", "to").alias("to"), (F.col("_on") != F.col("to")).alias("_more")), "chains")
        steps = further.select("node", "to")
        if further.where("_more").isEmpty():
            return steps


def spanning_forest(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root) of the maximum spanning forest of edges (src, dst, weight), rooted in roots (node, root).

    Weights must differ. In a round every tree without a root takes its highest edge out, and what hangs
    together so is one tree; trees with roots take none. Nodes that reach no root are left out.
    """
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).where("src <> dst")
    own = roots.select("node", "root")
    trees = both.select(F.col("src").alias("node")).unionByName(own.select("node")).distinct().join(own, "node", "left")
    trees = materialise(trees.select("node", F.col("node").alias("tree"), "root"), "forest")
    while True:
        a = trees.select(F.col("node").alias("src"), F.col("tree").alias("ts"), F.col("root").alias("rs"))
        b = trees.select(F.col("node").alias("dst"), F.col("tree").alias("td"))
        out = both.join(a.where("rs is null"), "src").join(b, "dst").where("ts <> td")
        best = materialise(out.groupBy(F.col("ts").alias("node")).agg(F.max(F.struct("weight", "td")).alias("m")).select("node", F.col("m.td").alias("to")), "forest-edges")
        if best.isEmpty():
            return trees.where("root is not null").select("node", "root")
        back = best.select(F.col("node").alias("to"), F.col("to").alias("_back"))
        # Of two trees that chose the same edge the lesser one leads; trees with roots lead.
        steps = best.join(back, "to", "left").select("node", F.when((F.col("_back") == F.col("node")) & (F.col("node") < F.col("to")), F.col("node")).otherwise(F.col("to")).alias("to"))
        ends = _ended(steps).select(F.col("node").alias("tree"), "to")
        led = trees.where("root is not null").select(F.col("tree").alias("to"), F.col("root").alias("_r")).distinct()
        moved = trees.join(ends, "tree", "left").withColumn("to", F.coalesce("to", "tree")).join(led, "to", "left")
        trees = materialise(moved.select("node", F.col("to").alias("tree"), F.col("_r").alias("root")), "forest")


def merged_labels(pixels: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Labels of overlapping blocks made one: pixels (keys, block, y, x, label) that meet in the overlap join their labels.

    Every label of a pixel is linked to the least one there; a pixel belongs to as many blocks as overlap
    in it. Blocks of different images (keys) have different names.
    """
    keyed = pixels.select(*keys, "y", "x", F.concat_ws(":", "block", "label").alias("node"))
    seen = keyed.groupBy(*keys, "y", "x").agg(F.min("node").alias("a"), F.collect_set("node").alias("all"))
    links = seen.select(F.col("a").alias("src"), F.explode("all").alias("dst")).where("src <> dst").distinct()
    out = seen.select(*keys, "y", "x", F.col("a").alias("node")).join(connected_components(links), "node", "left")
    return out.select(*keys, "y", "x", F.coalesce("component", "node").alias("label"))
