"""Exact top-k inner products by MaxScore over impact-ordered postings.

A component is a term. Its postings are a shard's rows in the order of their values, so the largest contributions to a
query lie at one end of the list. Vectors are dense, every row is in every list, so a list is split by a bound instead
of being essential as a whole: postings that contribute more than the term's bound are essential, the others are not.
The bounds of all terms together stay below the score that a row needs, the query's floor; a row in no essential
posting cannot reach it and is never touched. Essential postings are traversed, which gives each row met an upper bound;
rows that stay competitive are probed in the other terms, heaviest first, and dropped once their bound falls below the
floor. Floors begin at the k-th best of a bounded sample of the rows and rise with what is found; shards are merged.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shards import search, vectors
from .shared import ship

EXACT = 2.0**53
#: Scores pass from shards as decimal(38, 0); larger ones are held at its ends.
WIDEST = 10**38 - 1


def quantise(rows: DataFrame, scale: float = 256.0) -> DataFrame:
    """Each component as floor(scale * x), a whole number as a double; rows where that is not finite are left out."""
    whole = F.transform("vec", lambda x: F.lit(scale) * x)
    out = rows.select("vec_id", whole.alias("vec")).where(F.forall("vec", lambda x: F.abs(x) < float("inf")))
    # the math function stays in doubles, where the SQL floor passes through longs
    return out.select("vec_id", F.transform("vec", lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)).alias("vec"))


class Postings:
    """A shard's rows by term, in the order of their values."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.order = np.argsort(rows, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(rows.T, self.order, 1)
        self.touched = 0  # rows met in essential postings
        self.probed = 0  # products of the other terms

    def bounds(self, q: np.ndarray, floor: float) -> np.ndarray:
        """Per term the contribution from which on a posting is essential; their sum is below ``floor`` where it can be.

        All terms get the same bound on the row's own value, but none more than its largest contribution.
        """
        most = np.maximum(np.maximum(q * self.values[:, -1], q * self.values[:, 0]), 0.0)
        if not floor > 0:
            return np.zeros(len(q))
        if most.sum() < floor:
            return most
        size = np.abs(q)
        full = np.divide(most, size, out=np.zeros(len(q)), where=size > 0)  # the value at which a term reaches its most
        order = np.argsort(full)
        rest = np.append(np.cumsum(size[order][::-1])[::-1], 0.0)
        before = np.concatenate([[0.0], np.cumsum(most[order])])
        reach = np.divide(floor - before[:-1], rest[:-1], out=np.full(len(q), np.inf), where=rest[:-1] > 0)
        at = int(np.argmax(reach <= full[order])) if (reach <= full[order]).any() else len(q) - 1
        return np.minimum(size * max(float(reach[at]), 0.0) * (1 - 1e-9), most)

    def traverse(self, q: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows that are in an essential posting, what their essential contributions exceed the bounds by)."""
        places, gains = [], []
        for t in np.flatnonzero(q):
            v = self.values[t]
            if q[t] > 0:
                part = slice(int(np.searchsorted(v, bound[t] / q[t], side="right")), len(v))
            else:
                part = slice(0, int(np.searchsorted(v, bound[t] / q[t], side="left")))
            if part.start < part.stop:
                places.append(self.order[t, part])
                gains.append(q[t] * v[part] - bound[t])
        if not places:
            return np.zeros(0, np.int64), np.zeros(0)
        place, gain = np.concatenate(places), np.concatenate(gains)
        total = np.bincount(place, np.maximum(gain, 0.0), minlength=len(self.rows))
        met = np.flatnonzero(np.bincount(place, minlength=len(self.rows)))
        self.touched += len(met)
        return met, total[met]

    def competitive(self, q: np.ndarray, own: np.ndarray, floor: float, slack: float, k: int) -> np.ndarray:
        """Places of all rows whose score may reach ``floor`` less ``slack`` and the k best found; ``own``: not these."""
        bound = self.bounds(q, floor - slack)
        if floor - slack > 0:
            met, gain = self.traverse(q, bound)
        else:  # a row without any positive contribution may be wanted: every posting of such is essential
            met, gain = np.arange(len(self.rows)), np.maximum(q * self.rows, 0.0).sum(axis=1)
            self.touched += len(met)
        upper = gain + bound.sum()
        if len(own):
            keep = ~np.isin(met, own)
            met, upper = met[keep], upper[keep]
        # the most promising rows raise the floor before the others are probed
        if len(met) > 8 * k:
            some = met[np.argpartition(-upper, 4 * k)[: 4 * k]]
            floor = max(floor, float(np.partition(self.rows[some] @ q, len(some) - k)[len(some) - k]))
        keep = upper >= floor - slack
        met, upper = met[keep], upper[keep]
        # a posting that is not essential counts with its bound until its term is probed
        for t in np.argsort(-np.abs(q), kind="stable"):
            if not len(met) or not q[t]:
                break
            part = q[t] * self.rows[met, t]
            self.probed += len(met)
            upper = upper - np.maximum(part, bound[t]) + part
            keep = upper >= floor - slack
            met, upper = met[keep], upper[keep]
        return met


def whole_product(a: np.ndarray, b: np.ndarray) -> int:
    return sum(int(x) * int(y) for x, y in zip(a.tolist(), b.tolist()))


def best_products(asked: tuple[np.ndarray, np.ndarray], held: tuple[np.ndarray, np.ndarray], k: int, sample: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[list, list, list]:
    """(query id, candidate id, score) of each query's k best in a shard; ids are in order, vectors whole numbers.

    Only rows that can be among the k best of the shard and the ``sample`` come out. Sums below 2^53 are exact as
    doubles; beyond, rows within the rounding error of the floor are kept and summed again as Python's whole numbers.
    """
    (ids, q), (docs, v) = asked, held
    width = max(q.shape[1], v.shape[1])
    postings = Postings(v)
    out: tuple[list, list, list] = ([], [], [])
    peak = np.abs(v).max(axis=0, initial=0.0)
    for one, w in zip(ids, q):
        with np.errstate(over="ignore", invalid="ignore"):
            most = float(np.abs(w) @ peak)
        own = np.flatnonzero(docs == one)
        slack = 0.5 + most * 2.0**-44  # scores are whole numbers; bounds are rounded
        if not most < 1e37:  # scores may tie at the widest decimal, or overflow as doubles: all rows are summed exactly
            at = np.setdiff1d(np.arange(len(docs)), own)
        else:
            floor = -np.inf
            if sample is not None:
                others = sample[1][sample[0] != one]
                if len(others) >= k and others.shape[1] == width:
                    with np.errstate(over="ignore", invalid="ignore"):
                        known = others @ w
                        error = float(np.abs(w) @ np.abs(others).max(axis=0)) * 2.0**-44
                    if np.isfinite(known).all():
                        floor = float(np.partition(known, len(known) - k)[len(known) - k]) - error
            at = postings.competitive(w, own, floor, slack, k)
        if not most < EXACT:
            score = [max(min(whole_product(w, v[i]), WIDEST), -WIDEST) for i in at]
        else:
            score = (v[at] @ w).astype(np.int64).tolist()
        for s, i in sorted(zip((-s for s in score), docs[at].tolist()))[:k]:
            out[0].append(int(one)), out[1].append(i), out[2].append(-s)
    return out


def top_products(table: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, sample_rows: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` largest integer inner products with all other vectors.

    Vectors null or with a null or non-finite component, and rows without an id, take no part. Vectors of unequal
    length are compared as if followed by zeros. Ties go to the smaller vec_id; see :func:`shards.search` for repeated
    rows. Scores beyond a long are ordered by their exact value (up to 38
    digits, beyond that they tie) and returned as the long nearest to it. Extra columns
    are ignored; an empty table gives no rows. ``sample_rows``: about so many rows, drawn by a hash, give each query a
    first floor; they change the work and never the result.
    """
    import pyarrow as pa

    rows = quantise(vectors(table, True), scale)
    drawn = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(4)), F.lit(1_000_000)) < 1e6 * sample_rows / max(rows.count(), 1)).orderBy("vec_id", "vec").limit(2 * sample_rows).collect()
    width = max((len(r["vec"]) for r in drawn), default=0)
    load = ship(rows.sparkSession, (np.array([r["vec_id"] for r in drawn], np.int64), np.array([r["vec"] + [0.0] * (width - len(r["vec"])) for r in drawn]).reshape(len(drawn), width)))

    def group(queries, candidates):
        a, b, s = best_products(queries, candidates, k, load())
        return np.array(a, np.int64), np.array(b, np.int64), pa.array(s, pa.decimal128(38, 0))

    found = search(rows, is_query, group, k, False, "decimal(38,0)")
    top = 2**63 - 1
    score = F.when(F.col("score") > F.lit(top).cast("decimal(38,0)"), F.lit(top)).when(F.col("score") < F.lit(-top).cast("decimal(38,0)"), F.lit(-top)).otherwise(F.col("score").cast("long"))
    return found.withColumn("score", score)
