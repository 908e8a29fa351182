"""SimHash near-duplicates: segment popcounts as a grid, then exact distances, then components.

A fingerprint is mapped to the bit counts of its 32 segments of two bits. The Manhattan distance of two such vectors is
at most the number of differing bits, so fingerprints within 3 bits lie within Manhattan distance 3, and of the two
halves of 16 segments one is within distance 1. Each half is a grid with one cell per vector; a fingerprint is joined
with its own cell and with those one step up in one segment (the pair's other member covers steps down). What the grid
yields is verified on the fingerprints themselves.

Copies meet before that: the join is over distinct fingerprints, so a group of a million equal texts is one row.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow, drop, mix64, pick, seg_sum, with_text, written

LANES = 0x0101010101010101


def majority(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each segment of 64-bit hashes the bits that are set in over half of them; 0 for an empty segment.

    Eight bits are counted at a time, one in each byte of a word, in runs of at most 255 so that no byte overflows.
    """
    n = np.diff(starts)
    out = np.zeros(len(n), np.uint64)
    if not len(hashes):
        return out
    runs = -(-n // 255)
    owner = np.repeat(np.arange(len(n)), runs)
    first = starts[:-1][owner] + 255 * (np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs))
    at = np.concatenate([[0], np.cumsum(runs)])
    for shift in range(8):
        packed = np.add.reduceat((hashes >> np.uint64(shift)) & np.uint64(LANES), first)
        lanes = packed.view(np.uint8).reshape(-1, 8).astype(np.int64)
        over = 2 * seg_sum(lanes, at) > n[:, None]
        for byte in range(8):
            out |= over[:, byte].astype(np.uint64) << np.uint64(8 * byte + shift)
    return out


SPACES = re.compile(rb"[\x20\x09-\x0d]")


def shingle_hashes(text: bytes, size: int, seed: int, step: int = 1 << 20) -> np.ndarray:
    """XXH64 of each run of ``size`` words (A-Z lower-cased, joined by a space), or of all words where there are fewer.

    A long text is read in steps of about ``step`` bytes cut at white space; each takes the last words before it along.
    """
    import xxhash

    h, out, last, at = xxhash.xxh64_intdigest, [], [], 0
    while at < len(text):
        cut = SPACES.search(text, at + step)
        end = cut.start() if cut else len(text)
        words = last + text[at:end].lower().split()
        at = end
        if len(words) >= size:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate([[0], ends[: len(words) - size] + 1])
            out.append(np.fromiter((h(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist())), np.uint64, len(starts)))
        last = words[max(len(words) - size + 1, 0) :]
    if out:
        return np.concatenate(out)
    return np.array([h(b" ".join(last), seed)] if last else [], np.uint64)


BINS, BAND, BANDS = 256, 6, 24
#: Longs of a set's marks (:func:`marked`).
MARKS = 8


def sketches(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each segment of hashes (16-bit minima in BINS bins, 65535 where a bin is empty; BANDS keys, 0 without a hash).

    A hash's bin is its remainder, so one pass serves all bins. Keys join BAND minima each. These are over the whole
    segment, each under an odd multiplier of its own: with minima of bins, most bins of a short text are empty and
    would have to borrow, and two short texts that share one shingle would share keys.
    """
    n = len(starts) - 1
    top = np.uint64(2**64 - 1)
    low = np.full(n * BINS, top, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(starts))
    np.minimum.at(low, owner * BINS + (hashes % np.uint64(BINS)).astype(np.int64), hashes // np.uint64(BINS))
    low = low.reshape(n, BINS)
    small = np.where(low == top, 65535, mix64(low) % np.uint64(65535)).astype("<u2")
    keys = np.zeros((n, BANDS), np.uint64)
    some = np.flatnonzero(np.diff(starts))
    if len(some):
        odd = mix64(np.arange(1, BAND * BANDS + 1, dtype=np.uint64)) | np.uint64(1)
        with np.errstate(over="ignore"):
            for i in range(BAND * BANDS):
                least = np.minimum.reduceat(hashes * odd[i], starts[some])
                keys[some, i // BAND] = mix64(keys[some, i // BAND] + least + np.uint64(i // BAND + 1))
    return small, keys


def bit_sketch(small: np.ndarray) -> np.ndarray:
    """Four longs of one bit of each minimum: bits of two texts differ in half of the bins whose minima do."""
    bits = (mix64(small.astype(np.uint64) + np.uint64(7)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64)


def marked(hashes: np.ndarray) -> np.ndarray:
    """MARKS longs with one bit for each remainder that occurs among the hashes, so a set has at least as many elements."""
    bits = np.zeros(64 * MARKS, np.uint8)
    bits[hashes % np.uint64(64 * MARKS)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def fingerprints(docs: DataFrame, keep: list[str], size: int = 3, seed: int = 42, sketch: bool = False) -> DataFrame:
    """``docs``' columns ``keep`` and ``fp``, the 64-bit fingerprint of the whole text as a signed long.

    With ``sketch`` also the minima and keys of :func:`sketches`. Null texts and texts without a word have fingerprint 0.
    """
    frame = with_text(docs, keep)
    schema = ", ".join(f"`{c}` {t}" for c, t in pick(docs, *keep).dtypes)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            at = 0
            while at < len(texts):
                lists, size_, b = [], 0, at
                while b < len(texts) and size_ < 500_000:
                    one = texts[b].as_py()
                    lists.append(shingle_hashes((one or "").encode(), size, seed))
                    size_ += len(lists[-1])
                    b += 1
                starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
                hashes = np.concatenate(lists)
                found = {"fp": pa.array(majority(hashes, starts).view(np.int64))}
                if sketch:
                    small, keys = sketches(hashes, starts)
                    found["bits"] = pa.ListArray.from_arrays(np.arange(0, 4 * len(small) + 1, 4, dtype=np.int32), pa.array(bit_sketch(small).ravel()))
                    found["held"] = pa.array((small != 65535).sum(axis=1).astype(np.int32))
                    found["shingles"] = pa.array([len(np.unique(x)) for x in lists], pa.int32())
                    found["sketch"] = pa.array([x.tobytes() for x in small], pa.binary())
                    found["bands"] = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.ravel().view(np.int64)))
                own = [batch.column(i).slice(at, b - at) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*own, *found.values()], names=[*keep, *found])
                at = b

    return arrow(frame, run, f"{schema}, fp long" + ", bits array<long>, held int, shingles int, sketch binary, bands array<long>" * sketch)


def only(rows: DataFrame, pairs: DataFrame, column: str, scratch: list[DataFrame], most_sent: int = 500_000) -> DataFrame:
    """(row, column) of ``rows`` that ``pairs`` name. Up to a bound the names are sent to the rows, so no others are shuffled.

    ``scratch``: gets the tables written on the way, which may go once the result has been used.
    """
    names = written(pairs.select(F.explode(F.array("row", "first")).alias("row")).distinct(), "names")
    scratch.append(names)
    own = rows.select("row", column)
    if names.limit(most_sent + 1).count() > most_sent:
        return own
    scratch.append(written(own.join(F.broadcast(names), "row", "left_semi"), "named-rows"))
    return scratch[-1]


def estimates(pairs: DataFrame, rows: DataFrame, scratch: list[DataFrame]) -> DataFrame:
    """(row, first, guess) of pairs (row, first): the share of equal minima among bins that either sketch has."""
    named = only(rows, pairs, "sketch", scratch)
    mine = pairs.join(named.select("row", F.col("sketch").alias("x")), "row").select("first", "row", "x")
    both = mine.join(named.select(F.col("row").alias("first"), F.col("sketch").alias("y")), "first").select("row", "first", "x", "y")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, BINS) for c in (2, 3))
            held = (x != 65535) | (y != 65535)
            guess = ((x == y) & held).sum(axis=1) / np.maximum(held.sum(axis=1), 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(guess)], names=["row", "first", "guess"])

    return arrow(both, run, "row long, first long, guess double")


def against(pairs: DataFrame, rows: DataFrame, size: int, seed: int, scratch: list[DataFrame], others: bool = False) -> DataFrame:
    """(row, first, shared, own, theirs) of pairs (row, first): numbers of different shingles, from the texts.

    With ``others`` also ``rest``, the shingles of the row that the first has not, their marks, and those of the
    shingles that the row lacks.
    """
    named = only(rows, pairs, "text", scratch)
    mine = pairs.select("row", "first").join(named.select("row", F.col("text").alias("x")), "row").select("first", "row", "x")
    both = mine.join(named.select(F.col("row").alias("first"), F.col("text").alias("y")), "first").select("row", "first", "x", "y")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            last, theirs = None, None
            for at in range(0, batch.num_rows, 256):
                counts, rests, marks = [], [], []
                for i in range(at, min(at + 256, batch.num_rows)):
                    first = batch.column(1)[i].as_py()
                    if first != last:
                        last, theirs = first, np.unique(shingle_hashes((batch.column(3)[i].as_py() or "").encode(), size, seed))
                    own = np.unique(shingle_hashes((batch.column(2)[i].as_py() or "").encode(), size, seed))
                    rest = np.setdiff1d(own, theirs, assume_unique=True)
                    counts.append((len(own) - len(rest), len(own), len(theirs)))
                    if others:
                        rests.append(rest.view(np.int64))
                        marks.append((marked(rest), marked(np.setdiff1d(theirs, own, assume_unique=True))))
                found = [batch.column(c).slice(at, len(counts)) for c in (0, 1)]
                found += [pa.array(c, pa.int32()) for c in zip(*counts)]
                if others:
                    found += [pa.array(x, pa.list_(pa.int64())) for x in (rests, *zip(*marks))]
                yield pa.RecordBatch.from_arrays(found, names=["row", "first", "shared", "own", "theirs", "rest", "has", "lacks"][: len(found)])

    return arrow(both, run, "row long, first long, shared int, own int, theirs int" + ", rest array<long>, has array<long>, lacks array<long>" * others)


def alike(pairs: DataFrame, rows: DataFrame, similarity: float, size: int, seed: int, scratch: list[DataFrame]) -> DataFrame:
    """Those pairs (row, first) whose texts' sets of shingles have that Jaccard similarity, exactly."""
    found = against(pairs, rows, size, seed, scratch)
    return found.where(F.col("shared") >= similarity * (F.col("own") + F.col("theirs") - F.col("shared"))).select("row", "first")


def uncommon(named: DataFrame, size: int, seed: int) -> DataFrame:
    """(row, alone): how many different shingles of a row no row of another root has, from (row, root, text).

    A lower bound: a shingle that more than two rows of one root have counts for two of them. Rows with none are left out.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                own = np.unique(shingle_hashes((batch.column(2)[i].as_py() or "").encode(), size, seed)).view(np.int64)
                for at in range(0, len(own), 1 << 16):
                    part = own[at : at + (1 << 16)]
                    same = [pa.array(np.full(len(part), batch.column(c)[i].as_py(), np.int64)) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(part)], names=["row", "root", "shingle"])

    each = arrow(named.select("row", "root", "text"), run, "row long, root long, shingle long")
    ends = each.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("row").alias("a"), F.max("row").alias("b"))
    holders = ends.where("low = high").select(F.explode(F.array_distinct(F.array("a", "b"))).alias("row"))
    return holders.groupBy("row").agg(F.count(F.lit(1)).alias("alone"))


def across(known: DataFrame, rows: DataFrame, s: float, size: int, seed: int, deviations: float, scratch: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """From (key, row, root): links (row, first) of similarity ``s``, and further pairs of rows under one key that may be.

    A pair at ``s`` shares at least ``s / (1 + s)`` of the sum of both sizes. Shingles that no other root has count
    against any pair, which rules out rows. Each key's pivot is the row left with the largest reach, in a group of
    versions the one nearest their origin; all rows of the key are compared with it on the texts. Two rows of which at
    least one is unlike the pivot can only be alike if they share a shingle that the pivot has not, or if each shares
    enough with the pivot itself. Either is a join; none lists all pairs of a group of versions. What comes out has
    also passed Jaccard distances to the pivot (a metric), sizes, the most shingles that two rows can share by the marks of
    what each has beside the pivot and lacks of it (a bound, which loses nothing, so of a group of versions hardly more
    than the similar pairs come out), and one bit of each minimum, which must not differ in more bins than such a pair's
    would within ``deviations`` standard deviations.
    """
    marks = ("bits", "held", "shingles")
    reach = lambda shared: shared * ((1 + s) / s) - F.col("shingles") + 1e-6  # noqa: E731  the largest partner; a margin for rounding
    mixed = known.groupBy("key").agg((F.min("root") < F.max("root")).alias("mixed")).where("mixed").select("key")
    left = written(known.join(mixed, "key", "left_semi"), "mixed-keys")
    members = written(left.select("row", "root").distinct(), "mixed-members")
    alone = uncommon(members.join(only(rows, members.select("row", F.col("row").alias("first")), "text", scratch), "row"), size, seed)
    members = members.join(alone, "row", "left").join(rows.select("row", *marks), "row")
    members = written(members.withColumn("reach", reach(F.col("shingles") - F.coalesce("alone", F.lit(0)))), "members")
    left = left.select("key", "row").join(members.select("row", "shingles", "reach"), "row")
    least = left.groupBy("key").agg(F.min("shingles").alias("smallest"))
    left = written(left.join(least, "key").where("reach >= smallest").drop("smallest"), "reaching-rows")
    pivots = left.groupBy("key").agg(F.max_by("row", F.struct("reach", -F.col("row"))).alias("first"))
    pairs = written(left.join(pivots, "key").where("row <> first").select("row", "first").distinct(), "pivoted")
    union = F.col("own") + F.col("theirs") - F.col("shared")
    met = against(pairs, rows, size, seed, scratch, others=True).withColumn("jaccard", F.col("shared") / union)
    met = met.withColumn("linked", F.col("shared") >= s * union).select("row", "first", "shared", "theirs", "rest", "has", "lacks", "jaccard", "linked")
    met = met.join(members.select("row", "root", *marks), "row").join(members.select(F.col("row").alias("first"), F.col("root").alias("pivot")), "first")
    met = met.withColumn("home", F.when(F.col("linked"), F.col("pivot")).otherwise(F.col("root")))
    met = written(met.withColumn("reach", reach(F.col("shared"))), "met")
    scratch += [left, members, pairs, met]
    links_ = written(met.where("linked").select("row", "first"), "pivot-links")
    other = met.select("first", *[F.col(c).alias(f"their_{c}") for c in ("row", "home", "reach", "jaccard", "shared", "rest", "has", "lacks", *marks)])
    differing = F.expr(" + ".join(f"bit_count(bits[{i}] ^ their_bits[{i}])" for i in range(4)))
    # bins that either text holds differ in (1 - s) / 2 of their bits, here with ``deviations`` more
    bins, unlike = F.greatest("held", "their_held") / s, (1 - s) / 2
    may = differing <= unlike * bins + deviations * F.sqrt(unlike * (1 - unlike) * bins) + 2
    may &= F.least("shingles", "their_shingles") >= s * F.greatest("shingles", "their_shingles")
    may &= F.abs(F.col("jaccard") - F.col("their_jaccard")) <= 1 - s + 1e-9
    # shared: those of the pivot that neither lacks, and beside it no more than each has less those that the other has not
    bit_sum = lambda form: F.expr(" + ".join(f"bit_count({form.format(i=i)})" for i in range(MARKS)))
    mine = F.col("shingles") - F.col("shared") - bit_sum("has[{i}] & ~their_has[{i}]")
    theirs = F.col("their_shingles") - F.col("their_shared") - bit_sum("their_has[{i}] & ~has[{i}]")
    most = F.col("theirs") - bit_sum("lacks[{i}] | their_lacks[{i}]") + F.least(mine, theirs)
    may &= most >= (F.col("shingles") + F.col("their_shingles")) * (s / (1 + s)) - 1e-6
    # of two rows unlike the pivot the larger one looks for the smaller
    may &= (F.col("home") != F.col("their_home")) & ((F.col("their_home") == F.col("pivot")) | (F.col("row") > F.col("their_row")))
    apart = met.where("home <> pivot")
    within = (F.col("their_shingles") <= F.col("reach")) & (F.col("shingles") <= F.col("their_reach"))
    least = met.groupBy("first").agg(F.min("shingles").alias("smallest"))
    through = apart.drop("rest").join(least, "first").where("reach >= smallest").join(other.drop("their_rest"), "first").where(may & within)
    beside = apart.withColumn("shingle", F.explode("rest")).drop("rest").join(other.withColumn("shingle", F.explode("their_rest")).drop("their_rest"), ["first", "shingle"]).where(may)
    name = (F.col("row"), F.col("their_row").alias("first"))
    return links_, written(through.select(*name).union(beside.select(*name)).distinct(), "across")


def similar(rows: DataFrame, similarity: float, size: int, seed: int, slack: float = 0.1, rounds: int = 3, deviations: float = 4.0) -> DataFrame:
    """Pairs (a, b) of fingerprints of rows (of :func:`fingerprints` with sketches, with row and text; written) that are
    that similar.

    They connect every two rows that share a key and have that Jaccard similarity of their shingles. Sketches (standard
    error about 0.025) only rule out pairs that are ``slack`` below; the others are decided on the texts. Of rows of equal
    text one is looked at. First, round by round, the rows of a key are compared with its first row; those like it are
    connected by that, the others are grouped anew. Then the components of these links are named, and :func:`across`
    lists pairs of different components under the keys that still hold more than one. A group of copies, exact or near,
    is one component by then; pairs within a component need no link.
    """
    once = rows.groupBy("fp", F.xxhash64("text").alias("same")).agg(F.min("row").alias("row")).select("row")
    every = written(rows.where("bands[0] <> 0").join(once, "row", "left_semi").select("row", F.explode("bands").alias("key")).distinct(), "keys")
    found, group, near = [], every, None

    def judged(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        named: list[DataFrame] = []
        guessed = written(estimates(pairs, rows, named), "guesses")
        found.append(written(alike(guessed.where(F.col("guess") >= similarity - slack), rows, similarity, size, seed, named), "alike"))
        drop(*named)
        return guessed, found[-1]

    for _ in range(rounds):
        first = written(group.groupBy("key").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first"), "first-rows")
        tagged = written(group.join(first, "key").where("row <> first"), "tagged")
        if tagged.isEmpty():
            break
        guessed, same = judged(tagged.select("row", "first").distinct())
        if near is None:
            near = written(tagged.select("key", "row").union(first.select("key", F.col("first").alias("row"))), "near")
        group = written(tagged.join(same, ["row", "first"], "left_anti").select("row", "key"), "rest")
        drop(first, tagged, guessed)
    prints = rows.select("row", F.col("fp").alias("a"))
    if near is None:
        return prints.limit(0).select("a", F.col("a").alias("b"))

    def union(tables: list[DataFrame]) -> DataFrame:
        out = tables[0]
        for more in tables[1:]:
            out = out.union(more)
        return out

    roots = components(union(found).select(F.col("row").alias("a"), F.col("first").alias("b")))
    known = written(near.join(roots, near["row"] == roots["node"], "left").select("key", "row", F.coalesce("root", "row").alias("root")), "known")
    scratch: list[DataFrame] = []
    linked, pairs = across(known, rows, similarity, size, seed, deviations, scratch)
    found.append(linked)
    if not pairs.isEmpty():
        drop(judged(pairs)[0])
    drop(every, near, known, pairs, *scratch)
    both = union(found).distinct().join(prints, "row").join(prints.select(F.col("row").alias("first"), F.col("a").alias("b")), "first")
    return both.where("a <> b").select("a", "b")


def links(prints: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that differ in at most ``distance`` bits (at most 3), from distinct ``fp``.

    A pair may come out once for each half of the fingerprint.
    """
    if not 0 <= distance <= 3:
        raise ValueError("the grid reaches 3 differing bits")
    x = lambda half: (F.shiftrightunsigned("fp", 32) if half else F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    counts = lambda half: x(half) - F.shiftright(x(half), 1).bitwiseAND(F.lit(0x55555555))
    # two bits a segment: 0, 1 or 2; the half's number above them
    cells = prints.select("fp", F.explode(F.array(*[(counts(h) + F.lit(h << 32)).alias("cell") for h in (0, 1)])).alias("cell"))
    steps = F.expr("filter(transform(sequence(0, 16), i -> CASE WHEN i = 16 THEN cell WHEN (shiftright(cell, 2 * i) & 3) < 2 THEN cell + shiftleft(1L, 2 * i) END), c -> c IS NOT NULL)")
    probes = cells.select(F.col("fp").alias("a"), F.col("cell").alias("own"), F.explode(steps).alias("cell"))
    found = probes.join(cells.withColumnRenamed("fp", "b"), "cell").where((F.col("own") != F.col("cell")) | (F.col("a") < F.col("b")))
    return found.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b")


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (a, b) and the least node that each can reach.

    Each round hooks every root that has a lesser neighbour to the least of these, so the number of roots at least halves.
    """
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(u):
        x, y = label[u], label[v]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
        apart = label[u] != label[v]
        u, v = u[apart], v[apart]
    return nodes, nodes[label]


def components(edges: DataFrame, salts: int = 16, most_rounds: int = 60, most_local: int = 1_000_000) -> DataFrame:
    """(node, root): the least node that each node of ``edges`` (a, b: longs) can reach, by alternating stars.

    Up to ``most_local`` distinct edges (16 MB) are counted and read by one task instead, which spares the driver some
    ten joins a round. Large star joins a node's larger neighbours to its least one, small star its smaller ones; rounds go on until the
    edges stay the same (``most_rounds``, far above the logarithm of any corpus, only turns an endless loop into an
    error). Nothing is collected; each round's edges are written to the shared folder. A node with many
    neighbours is spread by a salt taken from the neighbour.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = least.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
        with_least = both.withColumn("salt", F.pmod("v", F.lit(salts)).cast("int")).join(least, ["u", "salt"])
        if large:
            out = with_least.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = with_least.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.where("salt = 0").select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if edges.limit(most_local + 1).count() <= most_local:

        def run(batches):
            import pyarrow as pa

            table = pa.Table.from_batches(list(batches), pa.schema([("a", pa.int64()), ("b", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in least_reachable(*(table.column(c).to_numpy() for c in ("a", "b")))], names=["node", "root"])

        return written(arrow(edges.coalesce(1), run, "node long, root long"), "components")
    state = None
    for _ in range(most_rounds):
        old, edges = edges, written(star(star(edges, True), False), "edges")
        drop(old)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        state = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def classes(prints: DataFrame, distance: int = 3, more: DataFrame | None = None) -> DataFrame:
    """(fp, root) for each fingerprint of a written table ``prints``; one without a link is its own root.

    ``more``: further links (a, b) of fingerprints.
    """
    distinct = written(prints.select("fp").distinct(), "prints")
    found = links(distinct, distance)
    roots = components(found if more is None else found.union(more)).withColumnRenamed("node", "fp")
    return distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, size: int = 3, distance: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``.

    component_id is the smallest doc_id of all documents reachable by links. Texts null or without a word have
    fingerprint zero and link like any other. A null doc_id is never a component's id unless there is no other.
    Repeated rows stay and share a component; extra columns are ignored; an empty table gives no rows.
    """
    prints = written(fingerprints(docs, ["doc_id"], size, seed), "fingerprints")
    roots = written(classes(prints, distance), "roots")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")).join(roots, "fp").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = written(roots.join(least, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, size: int = 5, distance: int = 3, seed: int = 42, similarity: float | None = 0.8, most_sent: int = 500_000) -> DataFrame:
    """``docs`` with one document of each component: the smallest doc_id's (null last), one row of several equal ones.

    Fingerprints within 3 bits stand for far more than a Jaccard similarity of 0.8; with ``similarity`` set, documents
    of that similarity (the exact one of their sets of shingles) are linked as well. All columns of ``docs`` are kept.
    """
    columns = docs.columns
    marked = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], docs["doc_id"], docs["text"], F.monotonically_increasing_id().alias("row"))
    # the rows are written once with their numbers, so a task that runs again sees the same ones
    names = [f"c{i}" for i in range(len(columns)) if columns[i] != "text"]
    rows = written(fingerprints(marked, ["row", "doc_id", *names, "text"], size, seed, similarity is not None), "numbered")
    prints = rows.select("row", "doc_id", "fp")
    roots = written(classes(prints, distance, None if similarity is None else similar(rows, similarity, size, seed)), "roots")
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row")
    best = prints.groupBy("fp").agg(F.min(order).alias("best")).join(roots, "fp").groupBy("root").agg(F.min("best").alias("best"))
    kept = written(roots.join(best, "root").select("fp", F.col("best.row").alias("kept")), "kept")
    gone = written(prints.join(kept, "fp").where("row <> kept").select("row"), "gone")
    # the rows that go are few: counted, up to a bound they are sent to the texts, beyond it the texts meet them by row
    few = gone.limit(most_sent + 1).count() <= most_sent
    out = rows.join(F.broadcast(gone) if few else gone, "row", "left_anti")
    return out.select(*[F.col("text" if c == "text" else f"c{i}").alias(c) for i, c in enumerate(columns)])
