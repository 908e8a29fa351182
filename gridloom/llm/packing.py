"""Best-fit packing: token pieces into fixed-length sequences by a configuration linear program.

1. Tokenise every whole text once (pre-tokens that a worker has met before are looked up by their hash), cut only
   documents longer than ``capacity`` and write the pieces' lengths: the text itself is never shuffled.
2. Histogram the lengths: at most ``capacity`` numbers, so the driver may hold it at any corpus size.
3. Solve the configuration LP (a configuration is a multiset of lengths that fits a sequence; cover every length's
   count with as few as can be) by multiplicative weights; the pricing problem, the configuration of largest weight,
   is an unbounded knapsack solved by dynamic programming over the capacity.
4. Round: configurations are used a whole number of times, in proportion to the averaged solution; what that leaves is
   solved again, and the last few sequences' worth goes by best fit into the room that is left.
5. The plan is a table of runs (length, first rank, sequence, offset): its size depends on the number of lengths and
   configurations, never on the number of documents. Documents take their rank within their length by a two-level
   count, so a length that a third of all documents share is spread over many tasks. Pieces that fill a sequence by
   themselves need no plan and are never shuffled.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow, mix64, pick, text_steps, worker_state, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


# ---- tokens -------------------------------------------------------------------------------------------------------

#: What the word tokenizer's file says of its normaliser and its pattern. A file that says otherwise is
#: used by encoding whole texts.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

SPACE, LETTER, DIGIT, SIGN, OTHER = range(5)
#: Class of each byte as far as one byte tells; Latin letters of two bytes are found by their pairs.
CLASS = np.full(256, OTHER, np.uint8)
CLASS[0x21:0x7F] = SIGN
CLASS[[0x20, 9, 10, 11, 12, 13]] = SPACE
CLASS[0x30:0x3A] = DIGIT
CLASS[0x41:0x5B] = LETTER
CLASS[0x61:0x7B] = LETTER
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
LONG = 256  # bytes of a pre-token beyond which it is encoded anew each time
POWERS = np.cumprod(np.full(LONG + 1, 0x9E3779B97F4A7C15, dtype=np.uint64))


def pre_tokens(raw: np.ndarray, offsets: np.ndarray, special: bytes = b"<|") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end, whether it is a whole odd word, lower-cased bytes) of the pre-tokens of UTF-8 texts, in order.

    A word of ASCII signs, digits and Latin letters is split as the tokenizer's pattern splits it, contractions
    included. A word that holds any other byte, or ``special``, is odd: it stays whole for the unchanged tokenizer.
    """
    n = len(raw)
    kind = CLASS[raw]
    low = LOWER[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    second = raw[lead + 1]
    fine = (second != 0x97) & (second != 0xB7)  # the signs for times and divided by
    lead, second = lead[fine], second[fine]
    kind[lead] = kind[lead + 1] = LETTER
    low[lead[second <= 0x9E] + 1] += 32
    inside = kind != SPACE
    word = inside.copy()
    word[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < n]
    word[edge] = inside[edge]
    start = inside & (kind == DIGIT)
    start[1:] |= inside[1:] & (kind[1:] != kind[:-1])
    start |= word
    odd = np.flatnonzero(kind == OTHER)
    pair = np.flatnonzero((raw[:-1] == special[0]) & (raw[1:] == special[1]))
    odd_start = np.zeros(0, np.int64)
    if len(odd) or len(pair):
        number = np.cumsum(word) - 1
        hit = np.zeros(int(number[-1]) + 1, bool)
        hit[number[odd]] = True
        hit[number[pair]] = True
        rest = hit[number] & inside
        start[rest] = False
        low[rest] = raw[rest]
        odd_start = np.flatnonzero(word)[hit]
        start[odd_start] = True
        same = inside & ~rest
    else:
        same = inside
    # a contraction begins at an apostrophe that begins a pre-token, and ends before whatever letter follows it
    at = np.flatnonzero((raw == 0x27) & start & same)
    if len(at):
        ahead = [at + k for k in (1, 2, 3)]
        on = [(p < n) & inside[np.minimum(p, n - 1)] & ~word[np.minimum(p, n - 1)] for p in ahead]
        on[1] &= on[0]
        on[2] &= on[1]
        a, b = (low[np.minimum(p, n - 1)] for p in ahead[:2])
        one = on[0] & np.isin(a, list(b"stmd"))
        two = on[1] & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        start[ahead[0][one | two]] = False
        start[ahead[1][one & on[1]]] = True
        start[ahead[2][two & on[2]]] = True
    first = np.flatnonzero(start)
    # a pre-token ends where the next begins or at the first space before that
    space = np.flatnonzero(~inside)
    after = np.append(first[1:], n)
    where = np.searchsorted(space, first)
    end = np.minimum(after, np.append(space, n)[where])
    whole = np.zeros(len(first), bool)
    whole[np.searchsorted(first, odd_start)] = True
    return first, end, whole, low


def hashes(low: np.ndarray, first: np.ndarray, end: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches of bytes; those over LONG bytes get one that depends on their place."""
    size = end - first
    inside = np.repeat(np.arange(len(first)), np.minimum(size, LONG))
    at = np.arange(len(inside)) - np.repeat(np.cumsum(np.minimum(size, LONG)) - np.minimum(size, LONG), np.minimum(size, LONG))
    with np.errstate(over="ignore"):
        terms = (low[first[inside] + at].astype(np.uint64) + np.uint64(1)) * POWERS[at]
        h = mix64(np.add.reduceat(terms, np.cumsum(np.minimum(size, LONG)) - np.minimum(size, LONG)) + whole.astype(np.uint64)) if len(first) else np.zeros(0, np.uint64)
        long = np.flatnonzero(size > LONG)
        h[long] = mix64(h[long] + mix64(first[long].astype(np.uint64) + np.uint64(3)))
    return h


class WordTokenizer:
    """The tokenizer's ids of whole texts, by way of pre-tokens whose ids are kept while a worker lives.

    The tokenizer drops white space and joins nothing across it. Each pre-token of a plain word is encoded once by the
    tokenizer without its normaliser and pattern, each odd word by the unchanged one; afterwards a table of hashes, one
    place for each remainder, gives its ids. Tests hold the ids against encoding whole texts. ``places`` and ``most``
    (ids kept) bound the table to some 32 MB; a full one starts anew. A tokenizer file with another
    normaliser or pattern is used by encoding whole texts, without a table.
    """

    def __init__(self, path: str, places: int = 1 << 20, most: int = 1 << 22):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        spec = json.loads(self.whole.to_str())
        norm, split = spec.get("normalizer") or {}, ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])
        self.known = norm.get("normalizers") == NORMALIZERS and (split[0].get("pattern") or {}).get("Regex") == PATTERN and split[0].get("invert") is True
        self.known &= all(t.content.startswith("<|") for t in self.whole.get_added_tokens_decoder().values())
        spec["normalizer"] = None
        spec["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        self.bare = Tokenizer.from_str(json.dumps(spec)) if self.known else None
        self.places, self.most = places, most
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(self.places, np.uint64)
        self.begin, self.count = np.zeros(self.places, np.int32), np.full(self.places, -1, np.int32)
        self.flat, self.used = np.zeros(1 << 18, np.uint32), 0

    @staticmethod
    def encode(tokenizer, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        encoded = tokenizer.encode(keys, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(encoded.ids, dtype=np.uint32)
        return ids, np.bincount(np.array(encoded.word_ids, dtype=np.int64), minlength=len(keys)) if len(ids) else np.zeros(len(keys), np.int64)

    def new(self, first: np.ndarray, end: np.ndarray, whole: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, number of ids) of pre-tokens that the table does not have."""
        text = low.tobytes()
        out, counts = [], np.zeros(len(first), np.int64)
        for tokenizer, which in ((self.bare, np.flatnonzero(~whole)), (self.whole, np.flatnonzero(whole))):
            for a in range(0, len(which), 50_000):
                part = which[a : a + 50_000]
                ids, n = self.encode(tokenizer, [text[x:y].decode() for x, y in zip(first[part].tolist(), end[part].tolist())])
                out.append((part, ids, n))
                counts[part] = n
        at = np.cumsum(counts) - counts
        flat = np.zeros(int(counts.sum()), np.uint32)
        for part, ids, n in out:
            flat[np.repeat(at[part] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return flat, counts

    def encode_bytes(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after another, number of ids of each text) of UTF-8 texts."""
        if not self.known:
            data = raw.tobytes()
            ids = [self.whole.encode(data[a:b].decode(), add_special_tokens=False).ids for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            return np.array([x for y in ids for x in y], np.uint32), np.array([len(x) for x in ids], np.int64)
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        first, end, whole, low = pre_tokens(raw, offsets)
        h = hashes(low, first, end, whole)
        if self.used > self.most:
            self.clear()
        place = (h & np.uint64(self.places - 1)).astype(np.int64)
        hit = (self.key[place] == h) & (self.count[place] >= 0)
        begin, count = self.begin[place].astype(np.int64), self.count[place].astype(np.int64)
        if len(miss := np.flatnonzero(~hit)):
            _, one, back = np.unique(h[miss], return_index=True, return_inverse=True)
            ids, n = self.new(first[miss[one]], end[miss[one]], whole[miss[one]], low)
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : self.used + len(ids)] = ids
            where = self.used + np.cumsum(n) - n
            self.used += len(ids)
            begin[miss], count[miss] = where[back], n[back]
            self.key[place[miss]], self.begin[place[miss]], self.count[place[miss]] = h[miss], begin[miss], count[miss]
        before = np.concatenate([[0], np.cumsum(count)])
        ids = self.flat[np.repeat(begin - before[:-1], count) + np.arange(before[-1])]
        return ids, np.diff(before[np.searchsorted(first, offsets)])

    def encode_many(self, texts, end_id: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Of an Arrow array of texts: (all ids, each text's followed by ``end_id``; where each starts, and the end)."""
        parts = [self.encode_bytes(raw, offsets) + (a, b) for a, b, raw, offsets, _ in text_steps(texts)]
        tokens = np.zeros(len(texts), np.int64)
        for _, n, a, b in parts:
            tokens[a:b] += n
        starts = np.concatenate([[0], np.cumsum(tokens + 1)])
        out = np.full(int(starts[-1]), end_id, np.uint32)
        ids = np.concatenate([x for x, *_ in parts]) if parts else np.zeros(0, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), tokens)] = ids
        return out, starts


def worker_tokenizer(path: str) -> WordTokenizer:
    """One per Python worker and path, so that what one task has looked up serves the next."""
    kept = worker_state("tokenizer")
    if path not in kept:
        kept[path] = WordTokenizer(path)
    return kept[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece of each document: (doc_id, piece, start, length, ids_crc32).

    A document's ids are its text's and ``end_id``. A null text counts as empty; both give the one piece of the end
    mark. Only longer documents are cut, into pieces of ``capacity``; the last may be shorter. Repeated rows and equal
    or null doc_ids are documents of their own. Extra columns are ignored. An empty table gives no rows. A long text is
    read in steps cut at white space; of it only the ids are held together.
    """

    def cut(owner, ids, lengths):
        import pyarrow as pa

        starts = np.cumsum(lengths) - lengths
        n = -(-lengths // capacity)
        row = np.repeat(np.arange(len(lengths)), n)
        number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        start = number * capacity
        length = np.minimum(lengths[row] - start, capacity)
        data = memoryview(ids.astype("<u4")).cast("B")
        first = 4 * (starts[row] + start)
        crc = [zlib.crc32(data[x:y]) for x, y in zip(first.tolist(), (first + 4 * length).tolist())]
        return pa.RecordBatch.from_arrays([owner.take(pa.array(row)), pa.array(number, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    def tokenise(batches):
        words = worker_tokenizer(tokenizer)
        for batch in batches:
            held: list[np.ndarray] = []  # ids of a long text's steps so far
            for a, b, raw, offsets, more in text_steps(batch.column(1)):
                ids, tokens = words.encode_bytes(raw, offsets)
                if more:
                    held.append(ids)
                    continue
                if held:
                    ids, held = np.concatenate([*held, ids]), []
                    tokens = np.array([len(ids)])
                starts = np.concatenate([[0], np.cumsum(tokens + 1)])
                out = np.full(int(starts[-1]), end_id, np.uint32)
                out[np.arange(len(ids)) + np.repeat(np.arange(b - a), tokens)] = ids
                yield cut(batch.column(0).slice(a, b - a), out, tokens + 1)

    return arrow(pick(docs, "doc_id", "text"), tokenise, PIECES)


# ---- the linear program -------------------------------------------------------------------------------------------

#: How a plan holds a configuration: indices of lengths, how many items of each, and how many sequences are filled so.
Column = tuple[np.ndarray, np.ndarray, int]


def knapsack(lengths: np.ndarray, value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: for each room the largest value that fits, and the item put in last (-1: a unit stays free)."""
    worth, index = np.full(capacity + 1, -np.inf), np.full(capacity + 1, -1)
    worth[lengths], index[lengths] = value, np.arange(len(lengths))
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        gain = best[:room][::-1] + worth[1 : room + 1]
        size = int(gain.argmax())
        best[room] = best[room - 1]
        if gain[size] > best[room]:
            best[room], took[room] = gain[size], index[size + 1]
    return best, took


def fillings(lengths: np.ndarray, took: np.ndarray, capacity: int, heads: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each head its configuration: the head and the best filling of the room beside it, as (items, how many)."""
    after = np.arange(capacity + 1)  # the room where the next item is put in, units that stay free left out
    for room in range(1, capacity + 1):
        if took[room] < 0:
            after[room] = after[room - 1]
    row, room = np.arange(len(heads)), after[capacity - lengths[heads]]
    rows, items = [row], [heads]
    while len(row := row[room > 0]):
        room = room[room > 0]
        item = took[room]
        rows.append(row)
        items.append(item)
        room = after[room - lengths[item]]
    key, many = np.unique(np.concatenate(rows) * len(lengths) + np.concatenate(items), return_counts=True)
    at = np.searchsorted(key // len(lengths), np.arange(len(heads) + 1))
    return [(key[a:b] % len(lengths), many[a:b]) for a, b in zip(at[:-1], at[1:])]


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, gap: float, rate: float = 0.05, drift: float = 0.1, noise: float = 0.01, seed: int = 7, rounds: int | None = None) -> tuple[list[Column], float, float]:
    """(columns, by what to divide their uses, lower bound): the covering program solved by multiplicative weights.

    Every length has a weight, at first the room it takes. All demands rise level by level; a weight is multiplied by
    exp(rate) for each full demand that its length lags behind the level and, for good, by a step that falls with the
    rounds where it lags behind the others: what is covered loses weight and what is not gains. A round prices by one
    knapsack, with ``noise`` to part ties, and takes for each length whose best configuration is within the gap of the
    best one, or that lags by a level, as many uses of that configuration as the level leaves room for: no demand is
    covered beyond the level, which bounds a round's width. The answer is the average over the best window of rounds:
    its uses divided by the least cover. Any weights give a lower bound, their total over all items divided by the best
    configuration's; it is taken of the lasting weights and of averages. The rounds end where both are within ``gap``,
    or after 2 / gap of them (``rounds``).
    """
    m, n, rng = len(lengths), counts.astype(np.int64), np.random.default_rng(seed)
    share = n * lengths / float(n @ lengths)
    low, log_weight = float(n @ lengths) / capacity, np.log(lengths / capacity)
    done, used, level, columns = np.zeros(m, np.int64), 0, 1, []
    seen, best_ratio, window = [(0, done.copy(), 0)], np.inf, (0, 1.0)
    for r in range(rounds or int(2 / gap)):
        lag = level - done / n
        while lag @ share < 0.5:
            level, lag = level + 1, lag + 1
        room, before = np.maximum(level * n - done, 0), used
        weight = np.exp(log_weight + rate * lag - (log_weight + rate * lag).max())
        total = weight if r & (r - 1) == 0 else total + weight  # since the last power of two
        if r % 8 == 0:
            for dual in (total, np.exp(log_weight - log_weight.max())):
                low = max(low, float(n @ dual) / knapsack(lengths, dual, capacity)[0][capacity])
        wanted = np.flatnonzero(room)
        price = (weight * (1 + noise * rng.random(m)))[wanted]
        best, took = knapsack(lengths[wanted], price, capacity)
        worth = price + best[capacity - lengths[wanted]]
        heads = np.flatnonzero((worth >= (1 - gap) * best[capacity]) | (lag[wanted] > 1))
        heads = heads[np.argsort(-(lag * lengths)[wanted[heads]], kind="stable")]
        for items, many in fillings(lengths[wanted], took, capacity, heads):
            items = wanted[items]
            if uses := int((room[items] // many).min()):
                room[items] -= uses * many
                done[items] += uses * many
                used += uses
                columns.append((items, many, uses))
        if used == before:  # what is left of this level fits no configuration whole
            level += 1
        lag = level - done / n
        log_weight += drift / (1 + 0.05 * r) * (lag - lag @ share)
        if r % 8 == 7:
            seen.append((used, done.copy(), len(columns)))
        if r % 4 == 3:
            for u, d, at in seen:
                if (cover := float(((done - d) / n).min())) > 0.2 and (used - u) / cover < best_ratio:
                    best_ratio, window = (used - u) / cover, (at, cover)
                    end = len(columns)
            if best_ratio <= low * (1 + gap):
                break
    return (columns[window[0] : end], window[1], low) if best_ratio < np.inf else ([], 1.0, low)


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int, gap: float = 0.01, last: int = 32, seed: int = 1) -> tuple[list[Column], float]:
    """(plan, lower bound): configurations with how often each is used, which together hold every item exactly once.

    The averaged solution is rounded by drawing whole uses in proportion (systematic sampling in a shuffled order), as
    far as items are left; the rest is solved again with half the rounds, as it is a small part of the whole, until it
    would fill ``last`` sequences; that goes by best fit decreasing, first into the room that the plan's sequences have.
    """
    left, plan, bound, rng, rounds = counts.astype(np.int64).copy(), [], 0.0, np.random.default_rng(seed), int(2 / gap)
    bound = float(left @ lengths) / capacity
    first = True
    while float(size := left @ lengths) > last * capacity:
        at = np.flatnonzero(left)
        columns, cover, low = fractional(lengths[at], left[at], capacity, gap, rounds=rounds)
        bound, first = max(bound, low) if first else bound, False
        uses = np.array([u for _, _, u in columns]) / cover
        order = rng.permutation(len(columns))
        drawn = np.diff(np.floor(np.concatenate([[0.0], np.cumsum(uses[order])]) + rng.random())).astype(np.int64)
        for j in np.flatnonzero(drawn):
            items, many, _ = columns[order[j]]
            items = at[items]
            if times := min(int(drawn[j]), int((left[items] // many).min())):
                left[items] -= times * many
                plan.append((items, many, times))
        rounds = max(rounds // 2, 40)
        if left @ lengths > 0.9 * float(size):
            break
    return best_fit(lengths, left, capacity, plan), bound


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int, plan: list[Column] | tuple = ()) -> list[Column]:
    """Best fit decreasing over a histogram: the longest item left goes where the least room holds it.

    ``plan``: sequences that are there already. Equal sequences are kept as one group, split where an item goes into
    some of them, so the work follows the numbers of lengths and groups and not that of items.
    """
    groups: dict[int, list[tuple[dict[int, int], int]]] = {}
    for items, many, times in plan:
        groups.setdefault(capacity - int(lengths[items] @ many), []).append((dict(zip(items.tolist(), many.tolist())), times))
    for i in np.argsort(-lengths, kind="stable"):
        size, open_ = int(lengths[i]), int(counts[i])
        while open_:
            room = min((r for r in groups if r >= size), default=None)
            if room is None:
                room, config, times = capacity, {}, -(-open_ // (capacity // size))
            else:
                config, times = groups[room].pop()
            each = min(room // size, open_)
            here = min(times, open_ // each)
            groups.setdefault(room - each * size, []).append((config | {int(i): config.get(int(i), 0) + each}, here))
            if times > here and config:
                groups.setdefault(room, []).append((config, times - here))
            if room in groups and not groups[room]:
                del groups[room]
            open_ -= each * here
    return [(np.array(list(c), np.int64), np.array(list(c.values()), np.int64), t) for g in groups.values() for c, t in g]


def runs(lengths: np.ndarray, plan: list[Column]) -> dict[str, np.ndarray]:
    """The plan as runs: items of ``length`` with ranks ``rank`` .. ``rank + times - 1`` go to consecutive sequences."""
    given = np.zeros(len(lengths), np.int64)
    out, sequence = [], 0
    for items, many, times in plan:
        offset = 0
        for i, k in zip(items.tolist(), many.tolist()):
            for _ in range(k):
                out.append((int(lengths[i]), int(given[i]), sequence, offset))
                given[i] += times
                offset += int(lengths[i])
        sequence += times
    table = np.array(sorted(out), dtype=np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "sequence", "offset"), table.T))


# ---- the operator -------------------------------------------------------------------------------------------------


def pack(parts: DataFrame, capacity: int = 2048, group_rows: int = 250_000, gap: float = 0.01) -> DataFrame:
    """``parts`` (rows of PIECES, written: it is read more than once) with the sequence and the offset of each.

    Every piece is placed exactly once, sequences have no gaps, and none is longer than ``capacity``. A piece of
    ``capacity`` tokens is a sequence by itself (negative numbers). Each length is dealt by hash into groups of about
    ``group_rows`` before ranks are given, so that no length meets in one task.
    """
    spark = parts.sparkSession
    histogram = sorted((r["length"], r["n"]) for r in parts.where(F.col("length") < capacity).groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect())  # at most `capacity` rows
    alone = parts.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    if not histogram:
        return alone
    lengths, counts = (np.array(x, dtype=np.int64) for x in zip(*histogram))
    plan = runs(lengths, solve(lengths, counts, capacity, gap)[0])
    groups = -(-counts // group_rows)
    spread = spark.createDataFrame(list(zip(lengths.tolist(), groups.tolist())), "length long, spread long")
    group = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("spread"))
    dealt = parts.where(F.col("length") < capacity).join(F.broadcast(spread), "length").withColumn("grp", group)
    wide = np.int64(1) << np.int64(40)
    # one row for each length and for each further `group_rows` pieces
    table = np.array(sorted((r["length"], r["grp"], r["n"]) for r in dealt.groupBy("length", "grp").agg(F.count(F.lit(1)).alias("n")).collect()), dtype=np.int64)
    first = np.searchsorted(table[:, 0], lengths)
    base = np.cumsum(table[:, 2]) - table[:, 2]
    base -= np.repeat(base[first], np.diff([*first, len(table)]))
    sent = spark.sparkContext.broadcast((table[:, 0] * wide + table[:, 1], base, plan["length"] * wide + plan["rank"], plan))
    names = [f.split()[0] for f in PACKED.split(", ")]

    def place(batches):
        import pyarrow as pa

        keys, bases, at, runs_ = sent.value
        key, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column("length").to_numpy(zero_copy_only=False)
            own = length * wide + batch.column("grp").to_numpy(zero_copy_only=False)
            # rows come sorted by (length, grp), and a group never spans tasks; it may span batches
            new = np.flatnonzero(np.concatenate([[own[0] != key], own[1:] != own[:-1]]))
            begins = np.zeros(len(own), np.int64)
            begins[new] = new
            within = np.arange(len(own)) - np.maximum.accumulate(begins)
            if not len(new) or new[0] > 0:
                within[: new[0] if len(new) else len(own)] += seen
            key, seen = own[-1], int(within[-1]) + 1
            rank = bases[np.searchsorted(keys, own)] + within
            run = np.searchsorted(at, length * wide + rank, side="right") - 1
            sequence = runs_["sequence"][run] + rank - runs_["rank"][run]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names[:5]], pa.array(sequence), pa.array(runs_["offset"][run])], names=names)

    # the order within a group is free: any order gives each piece its own rank
    by_group = dealt.repartition("length", "grp").sortWithinPartitions("length", "grp", "doc_id", "piece", "ids_crc32")
    return arrow(by_group.select(*names[:5], "grp"), place, PACKED).union(alone)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """Documents to packed pieces; see :func:`pieces` and :func:`pack` for nulls, empty and repeated rows."""
    return pack(written(pieces(docs, tokenizer, capacity), "pieces"), capacity)
