"""Mixing sources to target weights, with DataFrame functions only.

Sizes are summed per source (partial sums before the shuffle, so a hot source is no hot task), targets follow from a
sorted prefix over the sources, and each document is emitted floor(rate) times plus one copy by a hash-seeded draw with
the fraction as its probability.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, joined, pick, unwrap, wrap, written

WEIGHTS = (3.0, 1.0, 2.0)


def words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources in code point order, null last, take ``weights`` in turn. The total, ``share`` of all sizes, is split by
    weight; no target exceeds ``most`` times its source's size, and what is cut off goes to the others by weight until
    none is above. That ends where min(most * size, level * weight) sums to the total: with sources sorted by the level
    at which they fill up, the first whose level is reached with all before it full fixes ``level``.
    """
    every = Window.partitionBy()
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sized = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (number % len(weights) + 1).cast("int"))).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ranked = sized.select("*", F.row_number().over(order).alias("k"), (share * F.sum("source_size").over(every) - before).alias("rest"), F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("open"))
    fits = ranked.withColumn("first", F.min(F.when(F.col("rest") * F.col("w") <= F.col("cap") * F.col("open"), F.col("k"))).over(every))
    at = lambda c: F.max(F.when(F.col("k") == F.col("first"), F.col(c))).over(every)
    level = fits.select("*", at("rest").alias("rest0"), at("open").alias("open0"))
    return level.select("source", "source_size", F.when(F.col("k") < F.col("first"), F.col("cap")).otherwise(F.col("rest0") * F.col("w") / F.col("open0")).alias("target"))


def draw(doc_id: Column, seed: int) -> Column:
    """A number from [0, 1) that depends on the id and the seed only: 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), doc_id.cast("string")).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def copies(docs: DataFrame, seed: int = 17, **options) -> DataFrame:
    """``docs`` with size, source_size, target and ``copies``, how often the mix takes each row (0, 1 or 2).

    A null text has size 0, a null source is a source of its own, a null doc_id draws as the empty id. Rows of equal
    doc_id draw alike. A source of size 0 has target 0 and its rows are not taken. An empty table gives no rows.
    Columns of the input named like these are replaced.
    """
    clean = docs.drop("size", "source_size", "target", "copies")
    sized = clean.withColumn("size", words(F.col("text")))
    per = pick(docs, "source", "text").groupBy("source").agg(F.sum(words(F.col("text"))).alias("source_size"))
    mixed = joined(sized, written(targets(per, **options), "targets"), ["source"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return mixed.withColumn("copies", (F.floor(rate) + (draw(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("long")).cast("long"))


def mix(docs: DataFrame, seed: int = 17, **options) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as :func:`copies` says, with the input's columns."""
    found = copies(wrap(docs), seed, **options).where("copies > 0")
    return unwrap(found.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))), docs.columns)
