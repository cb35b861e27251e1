"""Connected components of links that are never gathered in one place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import collect_garbage, look_up, materialize, release

PAIRS = "child long, parent long"


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node that it reaches) for every node of these links that reaches a smaller one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        while (jumped := root[root] != root).any():
            root = np.where(jumped, root[root], root)
        if (root == before).all():
            break
    below = root != np.arange(len(nodes))
    return nodes[below], nodes[root[below]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a task to links to their roots, in bounded lots; the rounds join what different lots hold."""
    lot, rows = [], 0

    def emit() -> pa.RecordBatch:
        table = pa.Table.from_batches(lot)
        child, parent = local_roots(table.column(0).to_numpy(), table.column(1).to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(child), pa.array(parent)], names=["child", "parent"])

    for batch in batches:
        lot.append(batch)
        rows += batch.num_rows
        if rows >= 2_000_000:
            yield emit()
            lot, rows = [], 0
    if lot:
        yield emit()


def components(links: DataFrame) -> DataFrame:
    """(child, parent) for each node of ``links`` (columns child, parent) that is not its component's smallest.

    Links are contracted where they are made, so that a node keeps one parent for each task. A round then deals links
    by their larger node, contracts them within each task, and lets every parent be replaced by its own
    parent; parents of many nodes are looked up without being dealt out. Rounds end when nothing changes, after
    about the logarithm of the longest path.
    """
    up = links.where("child <> parent").select(F.greatest("child", "parent").alias("child"), F.least("child", "parent").alias("parent"))
    state, last = materialize(up.mapInArrow(_contract, PAIRS), "links"), None
    total = state.count()
    if not total:
        return state
    while True:
        small = state.repartition("child").mapInArrow(_contract, PAIRS)
        least = small.select("child", "parent", F.min("parent").over(Window.partitionBy("child")).alias("least"))
        # a node with several parents, from different tasks or lots, links them: each larger one gets the smallest as its parent
        flat = materialize(least.select(F.when(F.col("parent") > F.col("least"), F.col("parent")).otherwise(F.col("child")).alias("child"), F.col("least").alias("parent")).distinct(), "links")
        above = flat.select(F.col("child").alias("parent"), F.col("parent").alias("above")).groupBy("parent").agg(F.min("above").alias("above"))
        above = flat.groupBy("parent").agg(F.count("*").alias("n")).join(above, "parent")
        found = look_up(flat, above, ["parent"], "n", 1 << total.bit_length())  # rounded, so that rounds share their compiled code
        new = materialize(found.select("child", F.coalesce("above", "parent").alias("parent")).distinct(), "links")
        release(state, flat)
        collect_garbage(links.sparkSession)  # a round's shuffle files go with it
        state = new
        now = tuple(state.agg(F.count("*"), F.countDistinct("child"), F.sum(F.xxhash64("child", "parent").cast("decimal(38,0)"))).first())
        if now == last and now[0] == now[1]:
            return state
        last, total = now, now[0]
