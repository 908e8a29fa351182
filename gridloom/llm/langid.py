"""Language identification by interpolated Kneser-Ney character models.

A model of order ``order`` per language; the n-grams of all languages lie in one sorted array of 64-bit hashes per
order, with a column of interpolated log-probabilities and back-off weights per language, so one binary search serves
all languages. Texts are lower-cased letters with one boundary sign for each stretch of other characters. The language
of the lowest cross-entropy per character wins; a text whose cross-entropy is further above the winner's usual one
than calibration texts ever were, in standard errors that account for its length, is marked as rejected.

Scoring runs over whole Arrow batches: distinct n-grams of a batch are looked up once.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow, bounded, mix64, pick, release, ship, slices, text_steps, with_text, worker_state

UNKNOWN = "und"
#: Bytes of text that one step handles, of fitting on the driver as of scoring in a worker.
FIT_BYTES = 1 << 19
RESULT = "lang_pred string, score double, cross_entropy double, margin double, rejected boolean, n_letters long"


def letter_codes() -> np.ndarray:
    """For each code point its lower-case letter's code point, 0 for anything but a letter (Unicode category L*)."""
    kept = worker_state("letters")
    if "letters" not in kept:
        table = np.zeros(sys.maxunicode + 1, np.uint32)
        for c in range(sys.maxunicode + 1):
            ch = chr(c)
            if unicodedata.category(ch)[0] == "L":
                table[c] = ord(ch.lower()[0])
        kept["letters"] = table
    return kept["letters"]


def symbols(raw: np.ndarray, offsets: np.ndarray, alphabet: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, text starts and end, letters per text, letter code points): boundary 0, unknown letters 1, known from 2.

    Each text yields a boundary sign for every stretch of non-letters behind a letter, none at its start.
    """
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    at = lead[offsets]
    letters = letter_codes()[points]
    is_letter = letters > 0
    n_letters = np.diff(np.concatenate([[0], np.cumsum(is_letter)])[at])
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first non-letter after a letter
    inner = at[1:-1]
    inner = inner[inner < len(points)]
    keep[inner] = is_letter[inner]  # never on account of the text before
    kept = letters[keep]
    starts = np.concatenate([[0], np.cumsum(keep)])[at]
    if alphabet is None:
        return kept, starts, n_letters, kept
    if len(alphabet):
        small = np.ones(max(int(alphabet[-1]) + 1, 2), np.uint16)
        small[alphabet] = np.arange(2, 2 + len(alphabet))
        small[0] = 0
        code = small[np.minimum(kept, len(small) - 1)]
        code[kept >= len(small)] = 1
    else:
        code = (kept > 0).astype(np.uint16)
    return code.astype(np.uint64), starts, n_letters, kept


def grams(code: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """The n-gram of ``order`` symbols (12 bits each) that ends at each symbol; places before a text are boundaries."""
    n = len(code)
    place = np.arange(n) - np.repeat(starts[:-1], np.diff(starts))
    out = code.copy()
    for k in range(1, order):
        back = np.zeros(n, np.uint64)
        back[k:] = code[:-k] if k < n else back[k:]
        back[place < k] = 0
        out |= back << np.uint64(12 * k)
    return out


class Model:
    """Sorted hash arrays of a joint interpolated Kneser-Ney model."""

    def __init__(self, languages: list[str], order: int, discount: float = 0.75):
        self.languages, self.order, self.discount = languages, order, discount

    def fit(self, texts: list[str], langs: list[str], most_letters: int = 3000) -> Model:
        """Fit on whole texts; alphabets beyond ``most_letters`` letters share the unknown sign (rarest first)."""
        import pyarrow as pa

        of = {name: i for i, name in enumerate(self.languages)}
        order, L = self.order, len(self.languages)
        parts = lambda: slices(pa.array(texts, pa.large_string()), FIT_BYTES)
        seen: dict[int, int] = {}
        for _, _, raw, offsets in parts():
            u, c = np.unique(symbols(raw, offsets, None)[3], return_counts=True)
            for x, y in zip(u.tolist(), c.tolist()):
                if x:
                    seen[x] = seen.get(x, 0) + y
        common = sorted(seen, key=lambda x: (-seen[x], x))[:most_letters]
        self.alphabet = np.array(sorted(common), dtype=np.int64)
        V = len(self.alphabet) + 2
        gathered: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(L)]
        for a, b, raw, offsets in parts():
            code, starts, _, _ = symbols(raw, offsets, self.alphabet)
            top = grams(code, starts, order)
            lang = np.repeat(np.array([of[x] for x in langs[a:b]]), np.diff(starts))
            for k in range(L):
                gathered[k].append(np.unique(top[lang == k], return_counts=True))
        # counts of the highest order, then continuation counts: distinct symbols to the left of each lower n-gram
        tables = []  # per language, per order 1..order: (sorted n-grams, counts)
        for k in range(L):
            keys = np.concatenate([x for x, _ in gathered[k]])
            counts = np.concatenate([y for _, y in gathered[k]])
            u, inv = np.unique(keys, return_inverse=True)
            by = {order: (u, np.bincount(inv, counts, len(u)))}
            for n in range(order - 1, 0, -1):
                above = by[n + 1][0]
                low = above & np.uint64((1 << (12 * n)) - 1)
                u, c = np.unique(low, return_counts=True)
                by[n] = (u, c.astype(float))
            tables.append(by)
        self.keys, self.prob, self.back = [], [], []  # by order; back: weight of the context of the next order
        lower = None
        D = self.discount
        for n in range(1, order + 1):
            union = np.unique(np.concatenate([t[n][0] for t in tables]))
            prob = np.zeros((len(union), L))
            contexts = np.unique(union >> np.uint64(12))
            weight = np.ones((len(contexts), L))
            ctx_of = np.searchsorted(contexts, union >> np.uint64(12))
            if n == 1:
                base = np.full((len(union), L), 1.0 / V)
            else:
                base = lower(union & np.uint64((1 << (12 * (n - 1))) - 1))
            for k in range(L):
                u, c = tables[k][n]
                at = np.searchsorted(union, u)
                cx = ctx_of[at]
                total = np.bincount(cx, c, len(contexts))
                kinds = np.bincount(cx, minlength=len(contexts))
                has = total > 0
                weight[has, k] = D * kinds[has] / total[has]
                prob[at, k] = (c - D) / total[cx]
            prob += weight[ctx_of] * base
            self._store(n, union, prob, contexts, weight, V)
            lower = functools.partial(self._linear, n)
        return self

    def _store(self, n, union, prob, contexts, weight, V) -> None:
        h = mix64(union)
        o = np.argsort(h)
        hc = mix64(contexts)
        oc = np.argsort(hc)
        self.V = V
        self.keys.append((h[o], hc[oc]))
        self.prob.append(prob[o])
        self.back.append(weight[oc])

    def _linear(self, n: int, gram: np.ndarray) -> np.ndarray:
        """Probabilities of n-grams by language: the stored one, else the context's weight times the lower order's."""
        if n == 0:
            return np.full((len(gram), len(self.languages)), 1.0 / self.V)
        keys, contexts = self.keys[n - 1]
        h = mix64(gram)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        found = keys[at] == h
        out = self.prob[n - 1][at]
        miss = np.flatnonzero(~found)
        if len(miss):
            g = gram[miss]
            rest = self._linear(n - 1, g & np.uint64((1 << (12 * (n - 1))) - 1))
            hc = mix64(g >> np.uint64(12))
            ac = np.minimum(np.searchsorted(contexts, hc), len(contexts) - 1)
            known = contexts[ac] == hc
            rest[known] *= self.back[n - 1][ac[known]]
            out[miss] = rest
        return out

    def costs(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nats by text and language, letters per text, symbols per text)."""
        import pandas as pd

        code, starts, n_letters, _ = symbols(raw, offsets, self.alphabet)
        sums = np.zeros((len(offsets) - 1, len(self.languages)))
        if len(code) and self.languages:
            which, distinct = pd.factorize(grams(code, starts, self.order))
            cost = -np.log(self._linear(self.order, distinct))
            for k in range(len(self.languages)):
                total = np.concatenate([[0.0], np.cumsum(cost[:, k][which])])
                sums[:, k] = total[starts[1:]] - total[starts[:-1]]
        return sums, n_letters, np.diff(starts)

    def entropies(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nats per symbol by text and language, letters per text, symbols per text)."""
        sums, n_letters, n = self.costs(raw, offsets)
        return sums / np.maximum(n, 1)[:, None], n_letters, n

    def calibrate(self, texts: list[str], langs: list[str], slack: float = 2.0) -> Model:
        """Where texts of a language lie: mean cross-entropy, its spread between texts and by length."""
        import pyarrow as pa

        self.mean, self.spread = np.zeros(len(self.languages)), np.ones(len(self.languages))
        ce, n, own = [], [], []
        for a, b, raw, offsets in slices(pa.array(texts, pa.large_string()), FIT_BYTES):
            e, _, m = self.entropies(raw, offsets)
            ce.append(e), n.append(m), own.extend(langs[a:b])
        ce, n, own = np.concatenate(ce), np.concatenate(n), np.array([self.languages.index(x) for x in own])
        high = [4.0]
        for k in range(len(self.languages)):
            mine = (own == k) & (n > 0) & (ce.argmin(axis=1) == k)  # labels may be wrong for a few
            if mine.sum() >= 2:
                e, m = ce[mine, k], n[mine]
                self.mean[k] = np.median(e)
                # the spread of a text of m symbols is taken as sqrt(a + b / m), b the spread of single symbols
                self.spread[k] = max(float(np.median(np.abs(e - self.mean[k]) * np.sqrt(np.minimum(m, 400)))) * 1.4826, 0.5)
                high.append(float(np.quantile(np.maximum(e - self.mean[k], 0) * np.sqrt(np.minimum(m, 400)) / self.spread[k], 0.998)))
            else:
                self.mean[k], self.spread[k] = np.log(self.V), 1.0
        self.limit = slack * max(high)
        return self

    def judge(self, sums: np.ndarray, letters: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
        """Columns of RESULT from the nats by text and language, letters and symbols of each text."""
        none = letters == 0
        if not self.languages:
            gap = np.full(len(n), np.nan)
            return {"lang_pred": np.full(len(n), UNKNOWN, object), "score": np.zeros(len(n)), "cross_entropy": gap, "margin": gap, "rejected": none, "n_letters": letters}
        ce = sums / np.maximum(n, 1)[:, None]
        best = ce.argmin(axis=1)
        low = ce[np.arange(len(best)), best]
        sharp = np.minimum(np.maximum(n, 1), 50)[:, None]
        score = 1.0 / np.exp(-(ce - low[:, None]) * sharp).sum(axis=1)
        margin = np.sort(ce, axis=1)[:, 1] - low if ce.shape[1] > 1 else np.full(len(best), np.inf)
        z = (low - self.mean[best]) * np.sqrt(np.minimum(n, 400)) / self.spread[best]
        score[none] = 0.0
        names = np.array([*self.languages, UNKNOWN], dtype=object)
        return {"lang_pred": names[np.where(none, len(names) - 1, best)], "score": score, "cross_entropy": np.where(none, np.nan, low), "margin": np.where(none, np.nan, margin), "rejected": none | (z > self.limit), "n_letters": letters}


def fit(docs: DataFrame, trainable, order: int = 5, rows_per_language: int = 1000, most_bytes: int = 16 << 20, most_languages: int = 200, seed: int = 7) -> Model:
    """A model fitted on at most about ``rows_per_language`` different whole labelled texts of each language.

    ``trainable``: a condition on rows of ``docs``. The bounded sample is drawn by a hash of the text, so it is the same
    at every partitioning, each different text once, up to ``most_bytes`` of text for all of the ``most_languages`` most
    frequent languages together; a quarter of it is kept out of the counts and calibrates rejection. Where no text is
    labelled the model has no language: it calls every text ``und`` and rejects only those without a letter.
    """
    rows = pick(docs.where(trainable), "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    found = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("text").alias("texts"))
    counts = {r["lang"]: r["texts"] for r in found.orderBy(F.col("n").desc(), "lang").limit(most_languages).collect()}
    if not counts:
        model = Model([], order)
        model.alphabet = np.zeros(0, np.int64)
        return model
    draw = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1_000_000)) / 1e6
    share = F.create_map(*[F.lit(x) for k, v in counts.items() for x in (k, min(1.0, rows_per_language / max(v, 1)))])
    some = rows.where(draw < F.coalesce(share[F.col("lang")], F.lit(0.0))).distinct().withColumn("part", F.pmod(F.xxhash64("text", F.lit(seed + 1)), F.lit(4)))
    sample = sorted((r["lang"], r["text"], r["part"]) for r in bounded(some, F.xxhash64("text", F.lit(seed + 2)), most_bytes))
    if not sample:  # every drawn text is beyond the bound: one is taken all the same
        sample = [(r["lang"], r["text"], r["part"]) for r in some.orderBy(F.octet_length("text"), "lang", "text").limit(1).collect()] or [(r["lang"], r["text"], 1) for r in rows.orderBy(F.octet_length("text"), "lang", "text").limit(1).collect()]
    train = [x for x in sample if x[2] != 0] if len(sample) >= 40 else sample
    model = Model(sorted({x[0] for x in train}), order).fit([x[1] for x in train], [x[0] for x in train])
    rest = [x for x in sample if x[2] == 0 and x[0] in model.languages] or train
    model.calibrate([x[1] for x in rest], [x[0] for x in rest])
    release()
    return model


def identify(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``docs``' columns ``keep`` with the predicted language of each whole text (columns of RESULT).

    Null texts, empty ones and those without a letter give ``und``, score 0 and are rejected. Repeated rows get the
    same result each. A long text is read in steps cut at white space, whose costs are summed. An empty table gives no
    rows. Only ``text`` is read for the prediction; extra columns pass only if they are in ``keep``.
    """
    load = ship(docs.sparkSession, model)
    frame = with_text(docs, keep)
    schema = ", ".join(f"`{c}` {t}" for c, t in pick(docs, *keep).dtypes)

    def score(batches):
        import pyarrow as pa

        model = load()
        for batch in batches:
            held = []  # of a long text's steps so far
            for a, b, raw, offsets, more in text_steps(batch.column(batch.num_columns - 1), FIT_BYTES):
                held.append(model.costs(raw, offsets))
                if more:
                    continue
                found, held = model.judge(*[sum(x[1:], x[0]) for x in zip(*held)]), []
                own = [batch.column(i).slice(a, b - a) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(found[c], from_pandas=True) for c in found]], names=[*keep, *found])

    return arrow(frame, score, f"{schema}, {RESULT}")
