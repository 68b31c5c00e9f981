"""Consolidating pairwise matches into groups: connected components on a two-dimensional grid."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.operators.skew import salted_join
from tilewright.scratch import drop_table, write_table


def _union_find(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest vertex number of each vertex's component, for edges a-b among 0..n-1."""
    parent = np.arange(n)
    while len(a):
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return parent


def _cell_components(cell: pd.DataFrame) -> pd.DataFrame:
    """Each vertex of one cell with the representative of its component in that cell."""
    codes, names = pd.factorize(pd.concat([cell["u"], cell["v"]], ignore_index=True))
    order = np.argsort(names.to_numpy(object), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    codes = rank[codes]
    names = names.to_numpy(object)[order]
    half = len(cell)
    rep = _union_find(codes[:half], codes[half:], len(names))
    return pd.DataFrame({"v": names, "rep": names[rep]})


def connected_groups(pairs: DataFrame, a: str, b: str, cell_pairs: int = 50_000, most_blocks: int = 256, per_slice: int = 1_000_000) -> DataFrame:
    """(group_id, member): every id that is linked to another, with the smallest id of its group.

    pairs: one row per match, in any direction and any number of times. Rows with a null id
    and rows of an id with itself link nothing; other columns don't matter; without links
    the result is empty. Ids are compared byte by byte.

    Each round, ids are hashed to B blocks and every pair lies in the cell of its two
    blocks; a cell with more than cell_pairs pairs (a hub's, say) is cut into slices. A local union-find
    runs on each cell. Every id then takes, over the cells of its row and column, the
    smallest of its representatives as its parent, and the representatives found are linked
    to each other through their parents: the pairs of the next round, between parents only.
    Representatives are compared by a hash of the id first, so that a long chain of rising
    ids shrinks by a constant factor a round as well. Once no pair is left the parents are
    stable, and the rounds are unwound from the last to the first.

    cell_pairs bounds the work of a task, per_slice the rows of one id in any join; B grows with the root of the number of pairs, at
    most to most_blocks, after which cells only get more slices. Nothing is collected. Each
    round is a written table, so lineage stays short; a level's pairs are deleted as soon as
    the next level stands.
    """
    spark = pairs.sparkSession
    key = lambda c: F.concat(F.lpad(F.hex(F.hash(F.col(c)).bitwiseAND(F.lit(0x7FFFFFFF))), 8, "0"), F.col(c))
    ids = pairs.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).dropna().where("a <> b")
    edges, edges_at = write_table(ids.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().select(key("a").alias("u"), key("b").alias("v")), "pairs")

    levels: list[DataFrame] = []
    while (n := edges.count()) or not levels:
        blocks = min(most_blocks, max(2, math.ceil(math.sqrt(n / cell_pairs))))
        block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
        grid = edges.select("u", "v", F.least(block("u"), block("v")).alias("row"), F.greatest(block("u"), block("v")).alias("col"))
        sizes = grid.groupBy("row", "col").agg(F.ceil(F.count(F.lit(1)) / cell_pairs).cast("int").alias("slices"))  # blocks^2 rows at most
        grid = grid.join(F.broadcast(sizes), ["row", "col"]).withColumn("slice", F.pmod(F.xxhash64("u", "v"), F.col("slices")))
        reps = grid.groupBy("row", "col", "slice").applyInPandas(_cell_components, "v string, rep string")
        level, _ = write_table(reps.groupBy("v").agg(F.min("rep").alias("p"), F.collect_set("rep").alias("reps")), "parents")
        levels.append(level.select("v", "p"))
        links = level.select("p", F.explode("reps").alias("rep")).distinct()
        above = level.select(F.col("v").alias("rep"), F.col("p").alias("q"))
        # a representative that very many parents share is one of the heavy keys
        linked = salted_join(links, above, ["rep"], links.groupBy("rep").agg(F.count(F.lit(1)).alias("n")), "n", per_slice).where("p <> q").select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).distinct()
        following, following_at = write_table(linked, "pairs")
        drop_table(spark, edges_at)
        edges, edges_at = following, following_at

    # parents of level 0 with the final representative of each
    top = levels[-1].select("v", F.col("p").alias("root"))
    for level in reversed(levels[1:-1]):
        top = salted_join(level, top.withColumnRenamed("v", "p"), ["p"], level.groupBy("p").agg(F.count(F.lit(1)).alias("n")), "n", per_slice).select("v", F.coalesce("root", "p").alias("root"))
    first = levels[0].withColumn("member", F.substring("v", 9, 1_000_000))
    parents = first.groupBy("p").agg(F.min("member").alias("least"), F.count(F.lit(1)).alias("n"))
    if len(levels) > 1:
        parents = parents.join(top.withColumnRenamed("v", "p"), "p", "left").withColumn("root", F.coalesce("root", "p"))
        named = parents.groupBy("root").agg(F.min("least").alias("group_id"))
        parents = salted_join(parents, named, ["root"], parents.groupBy("root").agg(F.count(F.lit(1)).alias("m")), "m", per_slice)
    else:
        parents = parents.withColumn("group_id", F.col("least"))
    parents = write_table(parents.select("p", "group_id", "n"), "parents")[0]
    return salted_join(first.select("p", "member"), parents.select("p", "group_id"), ["p"], parents, "n", per_slice).select("group_id", "member")
