"""Approximate nearest neighbours by multi-index hashing.

Vectors get binary codes: centred, turned by a learned rotation (iterative quantisation, fitted on a bounded sample),
and cut at zero. A code's substrings are each indexed. Two codes within ``radius`` bits agree to within
radius // m bits in one of the first radius % m + 1 substrings or to within radius // m - 1 in one of the others, so
probing those buckets finds every code in the radius; what is found is reranked by exact distances.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shards import search, vectors
from .shared import ship, written

BITS = 16  # of a substring
POP = np.array([bin(i).count("1") for i in range(1 << BITS)], dtype=np.uint8)
#: All substring differences, fewest bits first, and how many have at most so many bits.
MASKS = np.argsort(POP, kind="stable").astype(np.uint16)
ENDS = np.cumsum(np.bincount(POP, minlength=BITS + 1))


class Codes:
    """A centre, a rotation and a search radius."""

    def fit(self, sample: np.ndarray, k: int, rounds: int = 30, recall: float = 0.96, seed: int = 5) -> Codes:
        rng = np.random.default_rng(seed)
        self.centre = sample.mean(axis=0)
        x = sample - self.centre
        self.width = x.shape[1]
        turn, _ = np.linalg.qr(rng.standard_normal((self.width, self.width)))
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(x @ turn > 0, 1.0, -1.0).T @ x)
            turn = (u @ v).T
        self.turn = turn
        self.m = -(-self.width // BITS)
        # the radius: as many bits as all but a few of the sample's own nearest neighbours differ by
        asked = x[rng.permutation(len(x))[:256]]
        d = (asked**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * asked @ x.T
        near = np.argsort(d, axis=1)[:, : k + 1]
        bits = self.distances(self.encode(asked + self.centre)[:, None, :], self.encode(sample)[near])
        self.radius = int(np.quantile(bits, recall, method="higher"))
        return self

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes as ``m`` substrings of 16 bits."""
        bits = np.zeros((len(x), self.m * BITS), bool)
        y = np.zeros((len(x), self.width))
        w = min(self.width, x.shape[1])
        y[:, :w] = x[:, :w]
        bits[:, : self.width] = (y - self.centre) @ self.turn > 0
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint16).reshape(len(x), self.m)

    @staticmethod
    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return POP[a ^ b].sum(axis=-1, dtype=np.int64)


def fit(rows: DataFrame, k: int, sample_rows: int = 4096) -> Codes | None:
    """Codes fitted on at most about ``sample_rows`` vectors, drawn by a hash of the id; None without a vector."""
    total = rows.count()
    drawn = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(1_000_000)) < 1e6 * sample_rows / max(total, 1)).orderBy("vec_id").limit(2 * sample_rows)
    got = [r["vec"] for r in drawn.select("vec").collect()] or [r["vec"] for r in rows.orderBy("vec_id").limit(1).collect()]
    if not got:
        return None
    width = max(map(len, got))
    return Codes().fit(np.array([v + [0.0] * (width - len(v)) for v in got]), k)


class Index:
    """Substring indexes of a shard."""

    def __init__(self, ids: np.ndarray, dense: np.ndarray, codes: Codes):
        self.ids, self.dense, self.codes = ids, dense, codes
        self.code = codes.encode(dense)
        self.tables = []
        for j in range(codes.m):
            order = np.argsort(self.code[:, j], kind="stable")
            values, starts = np.unique(self.code[order, j], return_index=True)
            self.tables.append((values, np.append(starts, len(order)), order))
        self.probed = self.reranked = 0

    def probe(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Places of all codes within ``radius`` bits of ``code``; only codes in the probed buckets are looked at."""
        m = self.codes.m
        hits = []
        for j, (values, starts, order) in enumerate(self.tables):
            reach = radius // m - (j > radius % m)
            if reach < 0:
                continue
            masks = MASKS[: ENDS[min(reach, BITS)]]
            if len(masks) < len(values):  # every bucket within reach is asked for
                wanted = masks ^ code[j]
                at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
                at = at[values[at] == wanted]
            else:  # the shard has fewer buckets than there are masks: its directory is read instead
                at = np.flatnonzero(POP[values ^ code[j]] <= reach)
            size = starts[at + 1] - starts[at]
            hits.append(order[np.repeat(starts[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())])
        at = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
        self.probed += len(at)
        at = at[self.codes.distances(self.code[at], code) <= radius]
        self.reranked += len(at)
        return at

    def near(self, ids: np.ndarray, queries: np.ndarray, asked: np.ndarray, k: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, distance) of the ``k`` nearest of the codes within ``radius``; ties to the smaller id."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for own, q, code in zip(ids, queries, asked):
            at = self.probe(code, radius)
            at = at[self.ids[at] != own]
            d = np.sqrt(((self.dense[at] - q) ** 2).sum(axis=1))
            order = np.lexsort((at, d))[:k]
            out.append((np.full(len(order), own), at[order], d[order]))
        return tuple(np.concatenate(x) for x in zip(*out))


def nearest(table: DataFrame, is_query: Column, k: int = 10, sample_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest found by Euclidean distance among all other vectors.

    Vectors null, zero or with a null or non-finite component, and rows without an id, take no part. Ties go to the
    smaller vec_id; see :func:`shards.search` for repeated rows and unequal lengths. One radius holds for all shards;
    a query that finds fewer than ``k`` rows within it is asked again without one, so it gets all candidates if there
    are fewer. Extra columns are ignored; an empty table gives no rows.
    """
    rows = vectors(table, False)
    codes = fit(rows, k, sample_rows)
    load = ship(rows.sparkSession, codes)

    def group(radius):
        def run(queries, candidates):
            own = load()
            index = Index(*candidates, own)
            query, place, distance = index.near(*queries, own.encode(queries[1]), k, own.radius if radius is None else radius)
            return query, candidates[0][place], distance

        return run

    found = written(search(rows, is_query, group(None), k, True, "double"), "nearest")
    full = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("query_id")
    short = written(rows.where(is_query).select("vec_id").distinct().join(full, F.col("vec_id") == F.col("query_id"), "left_anti"), "short")
    if codes is None or short.isEmpty():
        return found
    wide = search(rows, is_query, group(codes.m * BITS), k, True, "double", only=short)
    return found.join(full, "query_id", "left_semi").select(wide.columns).union(wide)
