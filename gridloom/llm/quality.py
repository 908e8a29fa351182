"""Quality classifier: supervised subword embeddings.

Words, pairs of words and character n-grams of words are hashed to buckets, each with a learned vector; a document is the average of its
features' vectors, a softmax layer gives the class. Training is stochastic gradient descent in numpy on a bounded
sample of labelled texts. Since the output is linear in the average, scoring gathers each bucket's vector already
multiplied by the output layer: the same numbers for a fraction of the work, and every whole text is read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow, bounded, mix64, pick, release, seg_sum, ship, slices, text_steps, with_text, word_hashes


class Classifier:
    """``buckets`` vectors of ``dim`` numbers; features are words, pairs of words and character n-grams of words."""

    def __init__(self, buckets: int = 1 << 17, dim: int = 12, sizes: tuple[int, ...] = (3, 4), seed: int = 11):
        self.buckets, self.dim, self.sizes, self.seed = buckets, dim, sizes, seed
        self.gain, self.bias = np.zeros((buckets, 1)), np.zeros(2)

    def features(self, raw: np.ndarray, offsets: np.ndarray):
        """Yields (bucket of each feature, where each text's features start): words, word pairs, n-grams of each size.

        A word's n-grams are runs of its characters with a mark at its beginning and its end; none spans two words.
        """
        mask = np.uint64(self.buckets - 1)
        hashes, at = word_hashes(raw, offsets)
        yield (mix64(hashes + np.uint64(1)) & mask).astype(np.int64), at
        # pairs of words; a word that follows itself is one feature, whatever the word
        if len(hashes):
            pair = mix64(hashes[1:] ^ (hashes[:-1] >> np.uint64(1)))
            pair[hashes[1:] == hashes[:-1]] = 0
            pair = np.concatenate([[np.uint64(1)], pair])  # the first of a text pairs with its beginning
            pair[at[:-1][at[:-1] < len(pair)]] = 1
            yield (pair & mask).astype(np.int64), at
        spaced = np.insert(raw, offsets, 0x20)  # every text begins and ends with a mark
        begins = (np.cumsum((spaced & 0xC0) != 0x80) - 1)[offsets + np.arange(len(offsets))]
        point = np.frombuffer(spaced.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        mark = (point == 0x20) | ((point >= 9) & (point <= 13))
        marks = np.concatenate([[0], np.cumsum(mark)])
        low = np.where(mark, np.uint32(0), np.where((point >= 65) & (point <= 90), point + np.uint32(32), point)).astype(np.uint32)
        for n in self.sizes:
            m = max(len(low) - n + 1, 0)
            h = np.zeros(m, np.uint32)
            with np.errstate(over="ignore"):
                for k in range(n):
                    h *= np.uint32(0x01000193)
                    h ^= low[k : k + m]
                h *= np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            h &= np.uint32(self.buckets - 1)
            inside = marks[n - 1 : n - 1 + m] == marks[1 : 1 + m]  # no mark between the first and the last character
            yield h[inside], np.concatenate([[0], np.cumsum(inside)])[np.minimum(begins, m)]

    def fit(self, texts: list[str], labels: np.ndarray, epochs: int = 6, rate: float = 0.6, classes: int = 2) -> Classifier:
        """Stochastic gradient descent on the softmax loss; ``labels`` are 0 .. ``classes`` - 1."""
        import pyarrow as pa

        rng = np.random.default_rng(self.seed)
        docs = []
        for a, b, raw, offsets in slices(pa.array(texts, pa.large_string())):
            parts = list(self.features(raw, offsets))
            for i in range(b - a):
                ids = np.concatenate([h[s[i] : s[i + 1]].astype(np.int64) for h, s in parts])
                u, c = np.unique(ids, return_counts=True)
                docs.append((u.astype(np.int32), (c / max(len(ids), 1)).astype(np.float32)))
        self.vectors = (rng.random((self.buckets, self.dim), dtype=np.float32) - 0.5) / self.dim
        self.output = np.zeros((self.dim, classes), np.float32)
        self.bias = np.zeros(classes, np.float32)
        steps, t = max(epochs * len(docs), 1), 0
        for _ in range(epochs):
            for i in rng.permutation(len(docs)):
                lr, (u, c) = rate * (1 - t / steps), docs[i]
                t += 1
                hidden = c @ self.vectors[u] if len(u) else np.zeros(self.dim, np.float32)
                z = hidden @ self.output + self.bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[i]] -= 1
                back = self.output @ p
                self.output -= (lr * np.outer(hidden, p)).astype(np.float32)
                self.bias -= (0.1 * lr * p).astype(np.float32)
                if len(u):
                    # a text has thousands of features of tiny shares: steps are scaled so that its average moves by 0.2 lr
                    self.vectors[u] -= ((0.2 * lr / float(c @ c)) * c[:, None] * back[None, :]).astype(np.float32)
        return self.ready()

    def ready(self) -> Classifier:
        """Per bucket the output layer's values for each class less those for class 0."""
        self.gain = (self.vectors @ (self.output[:, 1:] - self.output[:, :1])).astype(np.float64)
        return self

    def slim(self) -> Classifier:
        """Without what only training and document vectors need; this is what goes to executors."""
        out = Classifier(self.buckets, self.dim, self.sizes, self.seed)
        out.gain, out.bias = self.gain, self.bias
        return out

    def sums(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sums of gains, number of features) of each text."""
        total, n = np.zeros((len(offsets) - 1, self.gain.shape[1])), np.zeros(len(offsets) - 1)
        for h, starts in self.features(raw, offsets):
            for k in range(total.shape[1]):
                total[:, k] += seg_sum(self.gain[:, k][h], starts)
            n += np.diff(starts)
        return total, n

    def probabilities(self, total: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Softmax over the classes; a text without features has the bias alone."""
        z = np.zeros((len(n), total.shape[1] + 1))
        z[:, 1:] = total / np.maximum(n, 1)[:, None] + (self.bias[1:] - self.bias[0])
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def score(self, raw: np.ndarray, offsets: np.ndarray, positive: int = 1) -> np.ndarray:
        """The softmax probability of class ``positive`` for each text."""
        return self.probabilities(*self.sums(raw, offsets))[:, positive]


def fit(docs: DataFrame, labels: DataFrame, trainable, target: str = "quality", rows: int = 4000, most_bytes: int = 32 << 20, classes: int = 2, **options) -> Classifier:
    """A classifier fitted on at most about ``rows`` whole labelled texts, drawn by a hash of the doc_id.

    ``trainable``: a condition on ``labels``' doc_id, a function of a column. Null texts and labels outside 0 ..
    ``classes`` - 1 are left out; repeated label rows count once (the largest label), of several texts of one doc_id the
    least. The sample ends at ``most_bytes`` of text. Without a labelled text every score is 1 / ``classes``.
    """
    marks = pick(labels, "doc_id", target).where(F.col(f"`{target}`").isin(*range(classes)) & trainable(F.col("doc_id"))).groupBy("doc_id").agg(F.max(target).alias("label"))
    share = min(1.0, rows / max(marks.count(), 1))
    drawn = marks.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < share * 1e6)
    some = pick(docs, "doc_id", "text").where("text IS NOT NULL").join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    sample = sorted((r["text"], r["label"]) for r in bounded(some, F.xxhash64("doc_id", F.lit(5)), most_bytes))
    if not sample:
        model = Classifier(**options)
        model.gain, model.bias = np.zeros((model.buckets, classes - 1)), np.zeros(classes)
        return model
    model = Classifier(**options).fit([x[0] for x in sample], np.array([x[1] for x in sample]), classes=classes)
    release()
    return model


def classify(docs: DataFrame, model: Classifier, keep: list[str], positive: int = 1) -> DataFrame:
    """``docs``' columns ``keep`` and ``score``, the probability that the whole text is of class ``positive``.

    Null and empty texts have no features and get the score of the bias; repeated rows get equal scores; no column but
    ``text`` counts. A long text is read in steps cut at white space, whose sums are added. An empty table gives no rows.
    """
    load = ship(docs.sparkSession, model.slim())
    frame = with_text(docs, keep)
    schema = ", ".join(f"`{c}` {t}" for c, t in pick(docs, *keep).dtypes)

    def run(batches):
        import pyarrow as pa

        model = load()
        for batch in batches:
            held = []  # of a long text's steps so far
            for a, b, raw, offsets, more in text_steps(batch.column(batch.num_columns - 1)):
                held.append(model.sums(raw, offsets))
                if more:
                    continue
                total, n = (sum(x[1:], x[0]) for x in zip(*held))
                held = []
                own = [batch.column(i).slice(a, b - a) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(model.probabilities(total, n)[:, positive])], names=[*keep, "score"])

    return arrow(frame, run, f"{schema}, score double")
