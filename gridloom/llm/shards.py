"""Searches of a stated query set against all vectors, in blocks: queries meet shards of bounded size, results merge."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import pick


def vectors(table: DataFrame, zero: bool) -> DataFrame:
    """(vec_id, vec as doubles) of the usable rows: no null id, vector or component, all finite; ``zero``: zeros too.

    Repeated rows stay.
    """
    vec = F.transform("embedding", lambda x: x.cast("double"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = pick(table, "vec_id", "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", vec.alias("vec"))
    rows = rows.where(F.forall("vec", fine))
    return rows if zero else rows.where(F.exists("vec", lambda x: x != 0))


def search(rows: DataFrame, is_query: Column, group, k: int, smaller: bool, score: str, shard_rows: int = 4096, block_rows: int = 4096, least_shards: int = 24, only: DataFrame | None = None) -> DataFrame:
    """The ``k`` best candidates of each query by ``group``'s scores, ties to the smaller vec_id.

    Rows are dealt to shards of about ``shard_rows`` by a hash of the id and the row's place in its file, so an id that
    many rows share is spread; queries are dealt to blocks by their id. Each (block, shard) is one group.
    ``group(queries, candidates)`` takes (ids, vectors) twice and gives (query, candidate id, score) arrays with the
    shard's best; its result may not depend on the sharding. A query's own vec_id is never its candidate; of several
    query rows with one vec_id the least vector is asked. ``only``: vec_ids to which the queries are restricted.
    """
    total = rows.count()
    shards = max(least_shards, math.ceil(total / shard_rows))
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    if only is not None:
        asked = asked.join(only, "vec_id", "left_semi")
    blocks = max(1, math.ceil(asked.count() / block_rows))
    hashed = lambda n, *of: F.pmod(F.xxhash64(*of), F.lit(n)).cast("int")
    left = asked.select(hashed(blocks, F.col("vec_id"), F.lit(1)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "vec_id", "vec")
    dealt = rows.select(hashed(shards, F.col("vec_id"), F.monotonically_increasing_id()).alias("shard"), "vec_id", "vec")
    right = dealt.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "shard", F.lit(False).alias("asks"), "vec_id", "vec")

    def run(table):
        import numpy as np
        import pyarrow as pa

        kind = {"double": pa.float64(), "long": pa.int64(), "decimal(38,0)": pa.decimal128(38, 0)}[score]
        asks = table.column("asks").to_numpy()
        ids = table.column("vec_id").to_numpy()
        flat = table.column("vec").combine_chunks()
        lengths = flat.value_lengths().to_numpy()
        width = int(lengths.max()) if len(lengths) else 0
        values = flat.flatten().to_numpy()
        dense = np.zeros((len(ids), width))  # shorter vectors count as followed by zeros
        dense[np.repeat(np.arange(len(ids)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
        order = np.argsort(ids, kind="stable")
        q, c = order[asks[order]], order[~asks[order]]
        if not len(q) or not len(c):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], kind)})
        a, b, s = group((ids[q], dense[q]), (ids[c], dense[c]))
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(s) if not isinstance(s, pa.Array) else s})

    found = left.union(right).groupBy("block", "shard").applyInArrow(run, f"query_id long, vec_id long, score {score}")
    best = F.col("score").asc() if smaller else F.col("score").desc()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(best, F.col("vec_id").asc()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
