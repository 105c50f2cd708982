"""First-seen and near-duplicate removal."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.functions import fixed_values as fv
from ragspark.functions import vectors as vx
from ragspark.operators import vectors as vec
from ragspark.operators.ranking import top_k
from ragspark.session import cut_lineage


def first_seen(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in list order. Each task keeps one row per key before the shuffle."""
    return top_k(df, by, order, 1, "_seen").drop("_seen")


def prune_near_duplicates(
    chunks: DataFrame,
    order: list[Column],
    *,
    key: str,
    scope: str = "query_id",
    vector: str = "embedding",
    threshold: float = fv.NEAR_DUPLICATE_COSINE,
    leaders: int = 1000,
    block_rows: int = vec.BLOCK_ROWS,
) -> DataFrame:
    """Greedy pruning: in order, a row stays unless it is too similar to a row of its scope that stayed before it.

    Identical vectors collapse first. The first ``leaders`` rows of each scope are decided in one bounded group, and their
    survivors strike their neighbours from the rest, block against block. A scope of at most ``leaders`` rows is then done. What
    is left is decided in parallel rounds: a row with an earlier kept neighbour goes, a row without an earlier undecided one
    stays, so a round decides a share of the rows, not a number of them. No pairs are emitted, and what is undecided between
    rounds lies in the shared checkpoint folder. Order by falling similarity to get the same rows as keeping the more
    similar of each pair.
    """
    ranked = chunks.select(
        F.col(scope).alias("_g"),
        F.col(key).alias("_id"),
        F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("_o"),
        F.col(vector).alias("_v"),
    )
    zero = F.coalesce(vx.norm(F.col("_v")) == 0, F.lit(True))
    blank = ranked.where(zero).select("_g", "_id")
    undecided = cut_lineage(first_seen(ranked.where(~zero), ["_g", "_v"], [F.col("_o").asc()]))
    kept = [blank]
    if not undecided.isEmpty():
        heads = top_k(undecided, ["_g"], [F.col("_o").asc()], leaders)
        decided = cut_lineage(
            heads.groupBy("_g").applyInArrow(_decide(threshold), "_g {0}, _id {1}, _v array<float>, kept boolean".format(
                ranked.schema["_g"].dataType.simpleString(), ranked.schema["_id"].dataType.simpleString()))
        )
        survivors = decided.where("kept")
        kept.append(survivors.select("_g", "_id"))
        rest = undecided.join(decided.select("_g", "_id"), ["_g", "_id"], "left_anti")
        if not rest.isEmpty():
            left = _not_near(rest, survivors.select("_g", "_id", "_v"), threshold, block_rows)
            kept.append(_in_rounds(left, threshold, block_rows))
    staying = kept[0]
    for part in kept[1:]:
        staying = staying.unionByName(part)
    staying = staying.select(F.col("_g").alias(scope), F.col("_id").alias(key))
    return chunks.join(staying, [scope, key], "left_semi")


def _decide(threshold: float):
    """Sequential decision over one bounded, ordered group of rows."""
    closeness, matrix = vec._closeness, vec._matrix

    def decide(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        near = closeness(matrix(table["_v"]), matrix(table["_v"]), "cosine") > threshold
        kept = np.zeros(table.num_rows, dtype=bool)
        for i in range(table.num_rows):
            kept[i] = not (near[i, :i] & kept[:i]).any()
        return table.select(["_g", "_id", "_v"]).append_column("kept", pa.array(kept))

    return decide


def _in_rounds(rows: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """``(_g, _id)`` of the rows that stay. Rows are numbered in order once; a block is a run of numbers of one scope, so a row
    only visits blocks before its own."""
    numbered = rows.repartitionByRange("_g", "_o").sortWithinPartitions("_g", "_o").select(
        "_g", "_id", "_v", F.monotonically_increasing_id().alias("_n"))
    undecided = cut_lineage(numbered.withColumn("_b", F.expr(f"_n div {block_rows}")).withColumn("fresh", F.lit(False)))
    fresh, kept = undecided.where("false"), None
    while not undecided.isEmpty():
        state = cut_lineage(_round(undecided, fresh, threshold))
        fresh = state.where("not struck and not blocked").withColumn("fresh", F.lit(True)).drop("struck", "blocked")
        kept = fresh if kept is None else kept.unionByName(fresh)
        undecided = state.where("blocked and not struck").drop("struck", "blocked")
    return (undecided if kept is None else kept).select("_g", "_id")


def _round(undecided: DataFrame, fresh: DataFrame, threshold: float) -> DataFrame:
    """Undecided rows with ``struck`` (near an earlier row that stays) and ``blocked`` (near an earlier undecided row)."""
    sources = undecided.unionByName(fresh)
    pairs = undecided.select("_g", F.col("_b").alias("_tb")).distinct().join(
        sources.select("_g", F.col("_b").alias("_sb")).distinct(), "_g").where("_sb <= _tb")
    targets = undecided.withColumnRenamed("_b", "_tb").join(pairs, ["_g", "_tb"]).select("_g", "_tb", "_sb", "_n", "_v")
    visits = sources.withColumnRenamed("_b", "_sb").join(pairs, ["_g", "_sb"])
    visits = visits.select(*[F.col(c).alias(c) for c in ("_g", "_tb", "_sb", "_n", "_v", "fresh")])
    closeness, matrix = vec._closeness, vec._matrix

    def mark(a: pa.Table, b: pa.Table) -> pa.Table:
        numbers, struck, blocked = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, bool)
        if a.num_rows and b.num_rows:
            numbers, others, stays = (c.to_numpy() for c in (a["_n"], b["_n"], b["fresh"]))
            near = (closeness(matrix(a["_v"]), matrix(b["_v"]), "cosine") > threshold) & (others[None, :] < numbers[:, None])
            struck, blocked = (near & stays[None, :]).any(axis=1), (near & ~stays[None, :]).any(axis=1)
            told = struck | blocked
            numbers, struck, blocked = numbers[told], struck[told], blocked[told]
        return pa.table({"_n": pa.array(numbers, pa.int64()), "struck": pa.array(struck), "blocked": pa.array(blocked)})

    group = ["_g", "_tb", "_sb"]
    marks = targets.groupBy(*group).cogroup(visits.groupBy(*group)).applyInArrow(mark, "_n long, struck boolean, blocked boolean")
    marks = marks.groupBy("_n").agg(F.bool_or("struck").alias("struck"), F.bool_or("blocked").alias("blocked"))
    no = F.lit(False)
    return undecided.join(marks, "_n", "left").select(
        *undecided.columns, F.coalesce("struck", no).alias("struck"), F.coalesce("blocked", no).alias("blocked"))


def _not_near(rest: DataFrame, survivors: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """Rows of ``rest`` without a survivor of their scope above the threshold.

    ``rest`` is cut into blocks per scope; the survivors of a scope, at most one round's worth, visit each block.
    """
    sizes = rest.groupBy("_g").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("_n"))
    blocks = rest.join(sizes, "_g").withColumn("_b", F.pmod(F.xxhash64("_id"), F.col("_n")).cast("int"))
    survivors = survivors.select(*[F.col(c).alias(c) for c in survivors.columns])
    visits = survivors.join(sizes.select(F.col("_g").alias("_g"), F.col("_n").alias("_n")), "_g").select(
        "_g", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_b"), "_id", "_v")
    closeness, matrix = vec._closeness, vec._matrix

    def strike(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows and b.num_rows:
            near = (closeness(matrix(a["_v"]), matrix(b["_v"]), "cosine") > threshold).any(axis=1)
            a = a.filter(pa.array(~near))
        return a.select(names)

    names = rest.columns
    return blocks.groupBy("_g", "_b").cogroup(visits.groupBy("_g", "_b")).applyInArrow(strike, rest.schema)
