"""Merkle manifest of a table, with an authentication path for every row, by fractal traversal.

Rows are leaves; each group's leaves, in order, form a tree of runs of FANOUT; the groups' roots form one
more. Places in a group come from a range sort and counts of its parts. A tree is cut into aligned blocks
of FANOUT ** BLOCK_HEIGHT leaves: a first pass takes each block's root, the roots are the nodes of the next
layer, and so on up. On the way down a block is traversed leaf by leaf: one existing subtree for each
SUBTREE_HEIGHT levels holds the nodes that paths need now, one desired subtree beside it is built by one
leaf a step and takes its place when the leaf leaves it. A task so holds a block's leaves and a few small
subtrees, never a tree; the path from the block's root upwards comes with the block.

Defined results: nulls are encoded as `-`; a null group is a group, before all others; leaves of one id
(null ids first) are ordered by their hash; exactly repeated rows are leaves each; a row without an id is
never tampered; columns other than those named are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaicq.workspace import broadcast_if_few, materialise

FANOUT, BLOCK_HEIGHT, SUBTREE_HEIGHT = 3, 6, 2
#: The type of a path: what stands left and right of the node, level by level, as text.
_PATH = "array<struct<left: string, right: string>>"
_PATH_KIND = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height_of(n: int) -> int:
    """Levels above n nodes until one is left."""
    height = 0
    while n > 1:
        n, height = -(-n // FANOUT), height + 1
    return height


class Subtree:
    """Nodes of one subtree from level low up to below level high, built leaf by leaf in a block of so many leaves."""

    def __init__(self, number: int, low: int, high: int, leaves: int):
        self.number, self.low, self.high = number, low, high
        self.widths = [-(-leaves // FANOUT**k) for k in range(high + 1)]
        self.nodes: list[list[str]] = [[] for _ in range(low, high)]
        self.runs: list[list[str]] = [[] for _ in range(high)]
        self.root: str | None = None

    def push(self, at: int, node: str) -> None:
        """The block's leaf number at, the next one of this subtree."""
        for level in range(self.high):
            if level >= self.low:
                self.nodes[level - self.low].append(node)
            run = self.runs[level]
            run.append(node)
            if len(run) < FANOUT and at != self.widths[level] - 1:
                return
            node, at = digest("".join(run)), at // FANOUT
            run.clear()
        self.root = node

    def beside(self, level: int, at: int) -> tuple[str, str]:
        """What stands left and right of the node number at of a level, in its run."""
        nodes, first = self.nodes[level - self.low], self.number * FANOUT ** (self.high - level)
        start = at - at % FANOUT
        return "".join(nodes[start - first : at - first]), "".join(nodes[at + 1 - first : start + FANOUT - first])


def block_root(leaves: list[str], height: int) -> str:
    tree = Subtree(0, height, height, len(leaves))
    for k, leaf in enumerate(leaves):
        tree.push(k, leaf)
    return tree.root


def traversed(leaves: list[str], height: int, tall: int = SUBTREE_HEIGHT) -> Iterator[list[tuple[str, str]]]:
    """The paths of successive leaves of a block, each as (left, right) by level."""
    n = len(leaves)
    spans = [(low, min(low + tall, height)) for low in range(0, height, tall)]
    reach = [FANOUT**high for _, high in spans]
    existing = [Subtree(0, low, high, n) for low, high in spans]
    for tree, far in zip(existing, reach):
        for k in range(min(far, n)):
            tree.push(k, leaves[k])
    desired = [Subtree(1, low, high, n) for low, high in spans]
    for at in range(n):
        for s, far in enumerate(reach):
            if at and at % far == 0:
                existing[s], desired[s] = desired[s], Subtree(at // far + 1, *spans[s], n)
        yield [tree.beside(level, at // FANOUT**level) for tree in existing for level in range(tree.low, tree.high)]
        for tree, far in zip(desired, reach):
            if at + far < n:
                tree.push(at + far, leaves[at + far])


def folded(node: str, path: list[tuple[str, str]]) -> str:
    """The root that a node and what stands beside it give."""
    for left, right in path:
        node = digest(left + node + right)
    return node


# ---------------------------------------------------------------- places


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows (group, order, n copies) with place (of the first copy, from 0, in the group) and total (copies of the group)."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, total = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            groups, counts = batch.column(names.index(group)).to_pylist(), batch.column(names.index("n")).to_pylist()
            at = []
            for g, n in zip(groups, counts):
                if g != last:
                    last, total = g, 0
                at.append(total)
                total += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(at), part, np.int64)), pa.array(at, pa.int64())], names=[*names, "_part", "_at"])

    schema = f"{rows.schema.simpleString()[7:-1].replace(':', ' ')}, _part long, _at long"
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    told = materialise(dealt.mapInArrow(run, schema), "manifest-order")
    parts = told.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.sum("n").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_g").orderBy("_p")) - F.col("_n")
    parts = parts.select("_g", "_p", before.alias("_before"), F.sum("_n").over(Window.partitionBy("_g")).alias("total"))
    parts = broadcast_if_few(materialise(parts, "manifest-parts"))
    joined = told.join(parts, (F.col(group) == F.col("_g")) & (F.col("_part") == F.col("_p")))
    return joined.select(*names, (F.col("_before") + F.col("_at")).alias("place"), "total")


def _in_blocks(rows: DataFrame, side: int) -> DataFrame:
    """rows (g, place, total, n copies, ...) with block, its first place there and the copies there: one row a block of so many leaves."""
    last = F.floor((F.col("place") + F.col("n") - 1) / side)
    wide = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("place") / side), last)))
    start = F.greatest(F.col("place"), F.col("block") * side)
    end = F.least(F.col("place") + F.col("n"), (F.col("block") + 1) * side)
    return wide.withColumns({"place": start - F.col("block") * side, "n": end - start})


def _sorted_leaves(table: pa.Table) -> tuple[pa.Table, list[str]]:
    """A block's rows by place, copies apart, and their nodes."""
    table = table.sort_by("place")
    table = table.take(pa.array(np.repeat(np.arange(len(table)), table.column("n").to_numpy())))
    return table, [x.hex() for x in table.column("node").to_pylist()]


def climbed(nodes: DataFrame, tall: int) -> tuple[list[DataFrame], DataFrame]:
    """(layers of nodes in blocks, (g, root) of each group) of nodes (g, place, total, n, node); blocks are so many levels tall."""
    layers, roots, side = [], [], FANOUT**tall

    def run(table: pa.Table) -> pa.Table:
        total = table.column("total")[0].as_py()
        _, leaves = _sorted_leaves(table)
        root = bytes.fromhex(block_root(leaves, min(tall, height_of(total))))
        return pa.table({"g": table.column("g").slice(0, 1), "place": table.column("block").slice(0, 1), "total": pa.array([-(-total // side)], pa.int64()), "n": pa.array([1], pa.int64()), "node": pa.array([root], pa.binary())})

    while True:
        layers.append(materialise(_in_blocks(nodes, side), "manifest-layer"))
        one = layers[-1].select("g", "block", "place", "total", "n", "node").groupBy("g", "block").applyInArrow(run, "g string, place long, total long, n long, node binary")
        one = materialise(one, "manifest-roots")
        roots.append(one.where("total = 1").select("g", F.col("node").alias("root")))
        nodes = one.where("total > 1")
        if nodes.isEmpty():
            return layers, reduce(DataFrame.unionByName, roots)


def _paths_down(layer: DataFrame, above: DataFrame, tall: int) -> DataFrame:
    """(g, block, path) of a layer's nodes, each a block of the layer below, from the paths (g, block, path) of the layer's blocks."""

    def run(rows: pa.Table, up: pa.Table) -> pa.Table:
        table, leaves = _sorted_leaves(rows)
        upper = [(p["left"], p["right"]) for p in up.column("path")[0].as_py()]
        own = traversed(leaves, min(tall, height_of(table.column("total")[0].as_py())))
        places = [table.column("block")[0].as_py() * FANOUT**tall + k for k in range(len(leaves))]
        paths = [[{"left": a, "right": b} for a, b in [*path, *upper]] for path in own]
        return pa.table({"g": table.column("g"), "block": pa.array(places, pa.int64()), "path": pa.array(paths, _PATH_KIND)})

    rows = layer.select("g", "block", "place", "total", "n", "node").groupBy("g", "block")
    return rows.cogroup(above.groupBy("g", "block")).applyInArrow(run, f"g string, block long, path {_PATH}")


def lowered(layers: list[DataFrame], roots: DataFrame, tall: int) -> DataFrame:
    """(g, block, path) of the first layer's blocks, from the path of each group's root (g, path)."""
    above = None
    for depth in range(len(layers) - 1, -1, -1):
        # Groups whose only block is in this layer get their root's path, the others that of their node above.
        ends = layers[depth].where(F.col("total") <= FANOUT**tall).select("g").distinct().join(roots, "g").select("g", F.lit(0).cast("long").alias("block"), "path")
        here = ends if above is None else ends.unionByName(above)
        here = materialise(here, "manifest-paths")
        if depth == 0:
            return here
        above = _paths_down(layers[depth], here, tall)


# ---------------------------------------------------------------- manifests


def encoded(value: Column) -> Column:
    """`-` for null, else the bytes' number, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves_of(docs: DataFrame, columns: list[str], id_col: str, group_col: str, tampered: Column | None = None, text_col: str = "text") -> DataFrame:
    """(g, id, node, bad, n): the leaf of each row, that of its tampered text if it differs, and how often it is there.

    Tampering deletes the line feeds of the text of the rows that tampered tells.
    """
    whole = {c: F.col(c) for c in columns}

    def leaf(values: dict[str, Column]) -> Column:
        return F.unhex(F.sha2(F.concat(*[encoded(values[c]) for c in columns]).cast("binary"), 256))

    g = F.coalesce(F.concat(F.lit("+"), F.col(group_col).cast("string")), F.lit(""))
    bad = F.lit(None).cast("binary")
    if tampered is not None:
        bad = F.when(tampered & F.col(text_col).contains("\n"), leaf(whole | {text_col: F.replace(F.col(text_col), F.lit("\n"), F.lit(""))}))
    rows = docs.select(g.alias("g"), F.col(id_col).alias("id"), leaf(whole).alias("node"), bad.alias("bad"))
    return rows.groupBy("g", "id", "node", "bad").agg(F.count("*").alias("n"))


def manifest(leaves: DataFrame, tall: int = BLOCK_HEIGHT) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of leaves (g, id, node, bad, n), in blocks so many levels tall."""
    id_type = leaves.schema["id"].dataType.simpleString()
    layers, subroots = climbed(placed(leaves, "g", ["id", "node", "bad"]), tall)
    subroots = materialise(subroots, "manifest-subroots")
    # The groups' roots, in order, are the leaves of one more tree.
    tops = subroots.select(F.lit("").alias("one"), F.col("g").alias("name"), F.col("root").alias("node"), F.lit(1).cast("long").alias("n"))
    top_nodes = materialise(placed(tops, "one", ["name"]).withColumnRenamed("one", "g"), "manifest-groups")
    top_layers, top = climbed(top_nodes, tall)
    root = top.first()
    if root is None:
        return leaves.sparkSession.createDataFrame([], f"id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    root = root["root"].hex()
    none = top.select("g", F.array().cast(_PATH).alias("path"))
    group_paths = _paths_down(top_layers[0], lowered(top_layers, none, tall), tall).select(F.col("block").alias("place"), "path")
    group_paths = group_paths.join(top_nodes.select("place", "name"), "place").select(F.col("name").alias("g"), "path")
    above = lowered(layers, materialise(group_paths, "manifest-group-paths"), tall).join(broadcast_if_few(subroots), "g")

    def run(rows: pa.Table, up: pa.Table) -> pa.Table:
        table, own = _sorted_leaves(rows)
        upper = [(p["left"], p["right"]) for p in up.column("path")[0].as_py()]
        rest = "".join(a + b for a, b in upper)
        bad = [x and x.hex() for x in table.column("bad").to_pylist()]
        proofs, found = [], []
        for path, leaf, other in zip(traversed(own, min(tall, height_of(table.column("total")[0].as_py()))), own, bad):
            proofs.append(digest("".join(a + b for a, b in path) + rest))
            found.append(folded(folded(other or leaf, path), upper))
        n = len(own)
        subroot = up.column("root")[0].as_py().hex()
        return pa.table({"id": table.column("id"), "leaf": own, "subroot": [subroot] * n, "root": [root] * n, "proof_sha256": proofs, "folded_root": found, "verified": [x == root for x in found]})

    out = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return layers[0].groupBy("g", "block").cogroup(above.groupBy("g", "block")).applyInArrow(run, f"id {id_type}, {out}")


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """The manifest of documents, every proof checked, half of the ids against a text without line feeds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    leaves = leaves_of(docs, ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "source", even)
    return manifest(leaves).withColumnRenamed("id", "doc_id")


#: Levels that the SQL writes out: trees of up to FANOUT ** SQL_LEVELS leaves.
SQL_LEVELS = 14


def _sql_tree(name: str, leaves: str) -> str:
    """Levels of a tree as tables name0, name1, ... from leaves (g, i, node), and what stands beside each node of a level as name_b0, ..."""
    out = [f"{name}0 AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {leaves})"]
    for k in range(SQL_LEVELS):
        run = f"PARTITION BY g, i // {FANOUT} ORDER BY i ROWS BETWEEN"
        out.append(f"""{name}_b{k} AS MATERIALIZED (SELECT g, i, coalesce(string_agg(node, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(node, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k} WHERE c > 1)""")
        out.append(f"""{name}{k + 1} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM (
  SELECT g, i // {FANOUT} AS i, CASE WHEN max(c) > 1 THEN sha256(string_agg(node, '' ORDER BY i)) ELSE max(node) END AS node FROM {name}{k} GROUP BY g, i // {FANOUT}))""")
    return ",\n".join(out)


def _sql_fold(name: str, tree: str, start: str, at: str) -> str:
    """Rows of start (row, g, i, cur, proof) folded up a tree, as the table name; at is the group's column."""
    out, last = [], start
    for k in range(SQL_LEVELS):
        here = f"{name}{k}" if k < SQL_LEVELS - 1 else name
        out.append(f"""{here} AS (SELECT f.row, f.g, f.i, CASE WHEN b.i IS NULL THEN cur ELSE sha256(l || cur || r) END AS cur, proof || coalesce(l || r, '') AS proof
  FROM {last} f LEFT JOIN {tree}_b{k} b ON b.g = f.{at} AND b.i = f.i // {FANOUT**k})""")
        last = here
    return ",\n".join(out)


def _sql_leaf(text: str) -> str:
    values = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen({v}) || ':' || {v} END" for v in values) + ")"


ORACLE_SQL = f"""
WITH crc AS MATERIALIZED (SELECT list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
d AS MATERIALIZED (SELECT doc_id, coalesce('+' || source, '') AS g, {_sql_leaf("text")} AS leaf, {_sql_leaf("replace(text, chr(10), '')")} AS other,
  coalesce(xor(list_reduce([4294967295] || list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 2 = 0, false) AS hit FROM documents, crc),
e AS MATERIALIZED (SELECT *, row_number() OVER () AS row, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
n AS (SELECT g, i, leaf AS node FROM e),
{_sql_tree("t", "n")},
s AS MATERIALIZED (SELECT g, node AS subroot, row_number() OVER (ORDER BY g) - 1 AS i FROM t{SQL_LEVELS}),
m AS (SELECT '' AS g, i, subroot AS node FROM s),
{_sql_tree("u", "m")},
f AS (SELECT row, g, i, CASE WHEN hit THEN other ELSE leaf END AS cur, '' AS proof FROM e),
{_sql_fold("p", "t", "f", "g")},
h AS (SELECT row, '' AS g, s.i, cur, proof FROM p JOIN s USING (g)),
{_sql_fold("q", "u", "h", "g")}
SELECT e.doc_id, e.leaf, s.subroot, u{SQL_LEVELS}.node AS root, sha256(q.proof) AS proof_sha256, q.cur AS folded_root, q.cur = u{SQL_LEVELS}.node AS verified
FROM e JOIN s USING (g) JOIN q USING (row), u{SQL_LEVELS}
"""
