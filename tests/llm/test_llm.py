"""Corpus operators against brute force, round trips and held-out rows, and on awkward tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridloom.llm import chaining, langid, linededup, maxscore, mixing, multiindex, packing, quality, queries, simhash, warc
from gridloom.llm.shared import NAMED, held_out, shared_dir, slices, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def docs_of(spark, texts, **columns):
    rows = [(i, t, columns.get("lang", "en"), columns.get("source", "s"), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def sentence(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}x" for _ in range(n))


@pytest.fixture(scope="module")
def nasty(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing extra columns."""
    rng = random.Random(0)
    rows = [(1, "a b c d e f g h", "en", "s1"), (1, "a b c d e f g h", "en", "s1"), (2, None, "en", "s1"), (3, "", None, "s2"), (None, "some text with words", "de", None), (None, None, None, None), (4, sentence(rng, 30000), "en", "s2"), (5, "x\n\n\ny\n\n\n\nz", "fr", "s3"), (6, "!!! ???", "fr", "s3"), (7, "é ß 漢字 ́ \x00", "de", "s1"), (8, " \t\n", "de", "s1")]
    extra = [(*r, len(r[1] or ""), "x", 7, "y", 9, "z", True) for r in rows]
    return spark.createDataFrame(extra, DOCS + ", fp string, size int, copies string, row int, score string, rejected boolean")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---- SimHash ---------------------------------------------------------------------------------------------------------


def brute_fingerprint(text, size=3, seed=42):
    import xxhash

    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    runs = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_against_brute_force(spark):
    rng = random.Random(1)
    base = [sentence(rng, rng.choice([1, 2, 3, 40, 300, 700])) for _ in range(60)]
    texts = base + [t.upper() if rng.random() < 0.3 else t.replace("w1", "w2", 1) for t in base] + ["", None, " \n", "A b\tC\x0bd"]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs_of(spark, texts)).collect()}
    prints = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == prints
    links = [(i, j) for i in prints for j in prints if i < j and bin(prints[i] ^ prints[j]).count("1") <= 3]
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(prints, links)


def test_links_find_every_pair_within_three_bits(spark):
    rng = random.Random(2)
    prints = {rng.getrandbits(64) for _ in range(30)} | {0, (1 << 64) - 1}
    for p in list(prints):
        q = p
        for _ in range(4):
            q ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 2)))
            prints.add(q)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {tuple(sorted(r)) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()}
    assert got == {tuple(sorted((a, b))) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [tuple(rng.sample(range(200, 260), 2)) for _ in range(40)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute_components({x for e in edges for x in e}, edges)
    assert {n: want[n] for n in got} == got and all(n in got for n in want if want[n] != n)


def test_components_of_few_edges_take_few_jobs(spark):
    rng = random.Random(31)
    edges = [(i, i + 1) for i in range(300)] + [(5000, -i) for i in range(40)] + [tuple(rng.sample(range(6000, 6200), 2)) for _ in range(150)] + [(9, 9), (-77, -78), (-78, -77)]
    rng.shuffle(edges)
    table = spark.createDataFrame(edges, "a long, b long")
    spark.sparkContext.setJobGroup("few-edges", "components")
    try:
        got = {r["node"]: r["root"] for r in simhash.components(table).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-edges"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = brute_components({x for e in edges for x in e}, edges)
    assert {n: want[n] for n in got} == got and all(n in got for n in want if want[n] != n)
    assert 0 < jobs <= 12
    stars = {r["node"]: r["root"] for r in simhash.components(table, most_local=0).collect()}
    assert {n: r for n, r in got.items() if n != r} == {n: r for n, r in stars.items() if n != r}
    assert simhash.components(table.limit(0)).count() == 0


def test_keep_one_leaves_one_row_of_each_component(spark, nasty, empty):
    rng = random.Random(4)
    a, b = sentence(rng, 200), sentence(rng, 200)
    out = simhash.keep_one(docs_of(spark, [a, b, a, a, "", None, b]))
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 1, 4]
    kept = simhash.keep_one(nasty)
    assert kept.columns == nasty.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({1: 1, 2: 1, None: 1, 4: 1, 5: 1, 6: 1, 7: 1})
    assert simhash.keep_one(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


def test_similar_documents_are_linked_and_others_are_not(spark):
    rng = random.Random(12)
    texts, group = [], []
    for g in range(30):
        words = sentence(rng, rng.choice([30, 120, 900]), 5000).split()
        texts.append(" ".join(words))
        group.append(g)
        for share in (0.01, 0.02, 0.2):
            other = list(words)
            for i in range(len(words)):
                if rng.random() < share:
                    other[i] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(other))
            group.append(g)
    runs = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    near = lambda i, j, s: len(runs[i] & runs[j]) / len(runs[i] | runs[j]) >= s
    kept = {r["doc_id"] for r in simhash.keep_one(docs_of(spark, texts)).collect()}
    for i in range(len(texts)):
        before = [j for j in range(i) if group[j] == group[i]]
        if any(near(i, j, 0.88) for j in before if j in kept):
            assert i not in kept
        if not any(near(i, j, 0.7) for j in range(len(texts)) if j != i):
            assert i in kept


def shifted(words, i, n, tag):
    """``words`` with ``n`` words from ``i`` on replaced: n + 4 of the five-word runs are others."""
    return words[:i] + [f"{tag}{j}" for j in range(n)] + words[i + n :]


def test_similar_pairs_behind_a_dissimilar_first_document_are_linked(spark):
    rng = random.Random(31)
    # texts of 20 passages in two forms each, so a text shares keys with many others that are not like it; then copies
    forms = [[sentence(rng, 20, 100000).split() for _ in range(2)] for _ in range(20)]
    family = [[w for f in forms for w in f[rng.random() < 0.25]] for _ in range(200)]
    texts = family + [shifted(w, 200, 1, f"c{m}x") for m, w in enumerate(family)]
    runs = [{hash(tuple(w[i : i + 5])) for i in range(len(w) - 4)} for w in texts]
    root = list(range(len(texts)))
    for i in root[:]:
        for j in range(i):
            if len(runs[i] & runs[j]) >= 0.8 * len(runs[i] | runs[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    kept = {r["doc_id"] for r in simhash.keep_one(docs_of(spark, [" ".join(t) for t in texts]), distance=0).collect()}
    assert kept == set(root)


def test_versions_of_one_text_are_grouped_as_all_pairs_would(spark):
    rng, names, texts = random.Random(5), [f"w{i}" for i in range(3000)], []
    for family in range(3):
        base = [rng.choice(names) for _ in range(90 + 30 * family)]
        edits = [(rng.randrange(len(base)), rng.choice(names)) for _ in range(12)]
        for _ in range(70):  # changes of its own, and some that other versions have as well
            own = list(base)
            for at, word in [(rng.randrange(len(base)), rng.choice(names)) for _ in range(rng.randrange(6))] + rng.sample(edits, rng.randrange(5)):
                own[at] = word
            texts.append(own[rng.randrange(4) : len(own) - rng.randrange(4)])
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    expected = {i for i in range(len(texts)) if find(i) == i}
    assert 3 < len(expected) < 150
    kept = {r["doc_id"] for r in simhash.keep_one(docs_of(spark, [" ".join(t) for t in texts]), distance=0).collect()}
    assert kept == expected


def test_versions_that_are_not_similar_are_hardly_listed(spark):
    rng, names = random.Random(6), [f"w{i}" for i in range(3000)]
    base = [rng.choice(names) for _ in range(150)]
    edits = [(rng.randrange(len(base)), rng.choice(names)) for _ in range(40)]
    texts = [list(base) for _ in range(120)]
    for own in texts[1:]:  # changes that some of the others have too, so rows unlike the pivot share shingles it has not
        for at, word in rng.sample(edits, 7):
            own[at] = word
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    alike = {(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    marked = docs_of(spark, [" ".join(t) for t in texts]).select("doc_id", "text", F.col("doc_id").alias("row"))
    rows = simhash.written(simhash.fingerprints(marked, ["row", "doc_id", "text"], 5, 42, True), "test-rows")
    known = rows.select(F.lit(1).cast("long").alias("key"), "row", F.col("row").alias("root"))
    linked, listed = simhash.across(known, rows, 0.8, 5, 42, 4.0, [])
    through = {tuple(sorted((r["row"], r["first"]), reverse=True)) for r in linked.collect()}
    found = {tuple(sorted((r["row"], r["first"]), reverse=True)) for r in listed.collect()}
    joined = brute_components(range(len(texts)), through | (found & alike))
    assert joined == brute_components(range(len(texts)), alike)
    assert len(found - alike) < 0.05 * len(pairs)


def test_exactly_the_declared_similarity_decides(spark):
    rng = random.Random(32)
    texts, near = [], []
    for g in range(60):  # of 396 runs n + 4 are others: just on either side of (396 - x) / (396 + x) = 0.8, x = 44
        words = sentence(rng, 400, 100000).split()
        n = 40 if g % 2 else 41
        texts += [words, shifted(words, 100, n, f"g{g}x")]
        if g % 2:
            near.append(2 * g + 1)
    kept = {r["doc_id"] for r in simhash.keep_one(docs_of(spark, [" ".join(t) for t in texts])).collect()}
    assert kept == set(range(len(texts))) - set(near)


# ---- packing ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_tokens_equal_the_tokenizers(tokenizer):
    table = pq.read_table(f"{SF}/documents.parquet")
    odd = ["", "  ", "it's o'clock don't'll 12 ab12 <|endoftext|> x", "_*_ a_b__c", "DON'T I'LL 'sad", "x<|endoftext|>y", "ÉÅ ñ é ́ a", "a\x85b c\xa0d", "µ²½ ×÷", "\x00\x00a b", "\x00", "a\x1cb\x0bc\x0cd", "'s's're", "x've'd12'm 'l 'r ''s", "a<b|c <| \x7f'", "é'É 'T'RE'", "İstanbul ǅ", "漢字 仮名", "a" * 5000]
    texts = table["text"].to_pylist() + odd
    rng = np.random.default_rng(4)
    texts += ["".join(rng.choice(list("ab'sSlrvetmd19 _.-\n<|é×"), 60)) for _ in range(200)] + [sentence(random.Random(1), 250_000, 10**6)]
    want = [tokenizer.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    for words in (packing.WordTokenizer(queries.tokenizer_path()), packing.WordTokenizer(queries.tokenizer_path(), places=1 << 10, most=4000)):
        ids, starts = words.encode_many(pa.array(texts))
        for i in range(len(texts)):
            assert ids[starts[i] : starts[i + 1]].tolist() == want[i]


def test_another_tokenizer_file_is_used_by_whole_texts(tmp_path, tokenizer):
    import json

    spec = json.loads(tokenizer.to_str())
    spec["normalizer"]["normalizers"] = spec["normalizer"]["normalizers"][:2]  # no lower case
    (tmp_path / "t.json").write_text(json.dumps(spec))
    words = packing.WordTokenizer(str(tmp_path / "t.json"))
    ids, starts = words.encode_many(pa.array(["Abc DEF", "", None]))
    assert not words.known and np.diff(starts).tolist()[1:] == [1, 1]
    assert ids[: starts[1]].tolist() == words.whole.encode("Abc DEF", add_special_tokens=False).ids + [0]


def check_packing(rows, docs, tokenizer, capacity=2048):
    want = Counter()
    for doc_id, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for n, a in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[a : a + capacity], "<u4")
            want[doc_id, n, a, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), -(-sum(r["length"] for r in rows) // capacity)


def test_packing_places_every_piece_once(spark, tokenizer, nasty, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    twice = docs.union(docs.where("doc_id % 3 = 0"))
    rows = packing.pack_documents(twice, queries.tokenizer_path()).collect()
    used, least = check_packing(rows, [(r["doc_id"], r["text"]) for r in twice.collect()], tokenizer)
    assert used <= least + 1
    rows = packing.pack_documents(nasty, queries.tokenizer_path()).collect()
    check_packing(rows, [(r["doc_id"], r["text"]) for r in nasty.collect()], tokenizer)
    assert packing.pack_documents(empty, queries.tokenizer_path()).count() == 0


def test_knapsack_against_enumeration():
    rng = np.random.default_rng(5)
    for _ in range(20):
        lengths = np.unique(rng.integers(2, 12, 4))
        value = rng.random(len(lengths))
        best, took = packing.knapsack(lengths, value, 24)
        most, options = 0.0, [np.zeros(len(lengths), int)]
        while options:
            o = options.pop()
            most = max(most, float(o @ value))
            last = int(np.flatnonzero(o)[-1]) if o.any() else 0
            for i in range(last, len(lengths)):
                n = o.copy()
                n[i] += 1
                if n @ lengths <= 24:
                    options.append(n)
        assert abs(best[24] - most) < 1e-9
        heads = np.arange(len(lengths))
        for i, (items, many) in zip(heads, packing.fillings(lengths, took, 24, heads)):
            assert i in items and lengths[items] @ many <= 24
            assert abs(value[items] @ many - value[i] - best[24 - lengths[i]]) < 1e-9


def sequences(lengths, counts, capacity):
    """Sequences that a plan uses; every item must be in it once and none may be too full."""
    plan, bound = packing.solve(lengths, counts, capacity)
    held = np.zeros(len(lengths), np.int64)
    for items, many, times in plan:
        assert lengths[items] @ many <= capacity and times > 0
        held[items] += many * times
    assert (held == counts).all()
    return sum(t for *_, t in plan), bound


def test_configuration_program_on_hard_histograms():
    used, bound = sequences(np.array([341, 683, 1025]), np.array([1000] * 3), 2048)
    assert used == 1125 and 1110 < bound <= 1125.001  # 1125 by hand; best fit alone takes 1167
    rng, triples = np.random.default_rng(3), []
    while len(triples) < 1500:
        a, b = rng.integers(380, 900, 2).tolist()
        if 380 <= 2048 - a - b <= 1000:
            triples += [a, b, 2048 - a - b]
    used, bound = sequences(*np.unique(triples, return_counts=True), 2048)
    assert bound >= 499.99 and used <= 505  # 500 triples fill their sequences exactly
    used, bound = sequences(*np.unique(np.clip(rng.lognormal(6, 1, 20000).astype(int), 1, 2047), return_counts=True), 2048)
    assert used <= 1.002 * bound + 1


def test_configuration_program_against_enumeration():
    def least(items, capacity):  # fewest sequences, by trying each item in each open one
        best = [len(items)]

        def go(i, rooms):
            if len(rooms) >= best[0]:
                return
            if i == len(items):
                best[0] = len(rooms)
                return
            for j in range(len(rooms)):
                if rooms[j] >= items[i] and rooms[j] not in rooms[:j]:
                    go(i + 1, rooms[:j] + [rooms[j] - items[i]] + rooms[j + 1 :])
            go(i + 1, [*rooms, capacity - items[i]])

        go(0, [])
        return best[0]

    rng = np.random.default_rng(8)
    for _ in range(25):
        items = sorted(rng.integers(3, 15, 9).tolist(), reverse=True)
        lengths, counts = np.unique(items, return_counts=True)
        want = least(items, 20)
        used, bound = sequences(lengths, counts, 20)
        assert want <= used <= want + 1 and bound <= want + 1e-9
        many, bound = sequences(lengths, counts * 300, 20)
        assert bound - 1e-6 <= many <= 1.01 * 300 * want


# ---- language and quality ---------------------------------------------------------------------------------------------


def test_kneser_ney_is_a_distribution():
    model = langid.Model(["a", "b"], 4).fit(["abra cadabra abracadabra"] * 3 + ["hello yellow mellow"] * 3, ["a"] * 3 + ["b"] * 3)
    for context in (0, 2, 3, 5):
        total = sum(model._linear(4, np.array([np.uint64(context << 12 | s)]))[0] for s in range(model.V))
        assert (total <= 1 + 1e-9).all() and (total > 0.95).all()


def test_langid_on_held_out_rows(spark, nasty, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs, ~held_out(docs["doc_id"]))
    rows = langid.identify(docs.where(held_out(docs["doc_id"])), model, ["doc_id", "lang"]).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    assert np.mean([r["rejected"] for r in rows]) < 0.01
    found = langid.identify(nasty, model, ["doc_id", "text"]).collect()
    assert len(found) == nasty.count()
    for r in found:
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
        else:
            assert r["lang_pred"] in model.languages and 0 <= r["score"] <= 1
    assert langid.identify(empty, model, ["doc_id"]).count() == 0
    junk = docs_of(spark, ["qzxv kjwq vvxz qqkj zzxw " * 20])
    assert langid.identify(junk, model, ["doc_id"]).first()["rejected"]
    blank = langid.fit(empty, F.lit(True))
    got = langid.identify(nasty, blank, ["text"]).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}
    assert all(r["rejected"] != any(c.isalpha() for c in r["text"] or "") for r in got)
    assert langid.fit(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True)).languages == []


def test_scores_do_not_depend_on_batches(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    texts = [r["text"] for r in docs.collect()] + ["one", "", "x", "ab", "é"]
    model = quality.Classifier(buckets=1 << 12, dim=4).fit(texts[:20], np.array([0, 1] * 10), epochs=1)
    together = np.concatenate([model.score(raw, off) for _, _, raw, off in slices(pa.array(texts))])
    single = np.concatenate([model.score(raw, off) for t in texts for _, _, raw, off in slices(pa.array([t]))])
    assert np.allclose(together, single)


def test_quality_on_held_out_rows(spark, nasty, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels, lambda c: ~held_out(c))
    scored = quality.classify(docs, model, ["doc_id"]).where(held_out(F.col("doc_id"))).join(labels, "doc_id").collect()
    good, bad = ([r["score"] for r in scored if r["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    rows = quality.classify(nasty, model, ["doc_id"]).collect()
    assert len(rows) == nasty.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.classify(empty, model, ["doc_id"]).count() == 0
    for d, l in ((empty, labels), (docs, labels.limit(0))):
        blank = quality.fit(d, l, lambda c: F.lit(True))
        assert {r["score"] for r in quality.classify(nasty, blank, ["doc_id"]).collect()} == {0.5}


def test_quality_against_loops_on_a_tiny_model():
    texts = ["Ab cd ab", "éa  b\nÉa", "", "x", "to be or not to be"]
    model = quality.Classifier(buckets=1 << 9, dim=3).fit(texts, np.array([0, 1, 2, 1, 0]), epochs=3, classes=3)

    def grams(text, n):
        for word in text.split():
            word = "\0" + "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word) + "\0"
            for i in range(len(word) - n + 1):
                h = 0
                for c in word[i : i + n]:
                    h = (h * 0x01000193 & 0xFFFFFFFF) ^ ord(c)
                h = h * 0x9E3779B1 & 0xFFFFFFFF
                yield (h ^ h >> 15) & 511

    raw, offsets = next((r, o) for _, _, r, o in slices(pa.array(texts)))
    parts = list(model.features(raw, offsets))
    for i, text in enumerate(texts):
        words = [int(h) for h in parts[0][0][parts[0][1][i] : parts[0][1][i + 1]]]
        pairs = [int(h) for h in parts[1][0][parts[1][1][i] : parts[1][1][i + 1]]]
        assert len(words) == len(pairs) == len(text.split())
        ids = words + pairs
        for n, (h, at) in zip((3, 4), parts[2:]):
            assert h[at[i] : at[i + 1]].tolist() == list(grams(text, n))
            ids += list(grams(text, n))
        hidden = sum((model.vectors[j].astype(float) for j in ids), np.zeros(3)) / max(len(ids), 1)
        z = np.exp(hidden @ model.output.astype(float) + model.bias)
        assert np.allclose(model.probabilities(*model.sums(raw, offsets))[i], z / z.sum(), atol=1e-5)


def test_kneser_ney_against_the_textbook():
    texts, order, D = ["abra cadabra", "abba", "cab bac"], 3, 0.75
    model = langid.Model(["x"], order).fit(texts, ["x"] * 3)
    code = {c: 2 + i for i, c in enumerate(sorted(set("abracd")))}
    grams_ = []
    for t in texts:  # boundary 0 before a text and between words
        s = [0] * (order - 1) + [code.get(c, 0) for c in t]
        grams_ += [tuple(s[i - order + 1 : i + 1]) for i in range(order - 1, len(s))]
    counts = {order: Counter(grams_)}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])

    def prob(g):
        if not g:
            return 1 / model.V
        own = {k: v for k, v in counts[len(g)].items() if k[:-1] == g[:-1]}
        if not own:
            return prob(g[1:])
        total = sum(own.values())
        return max(own.get(g, 0) - D, 0) / total + D * len(own) / total * prob(g[1:])

    for g in [*set(grams_), (2, 2, 2), (5, 3, 1), (1, 1, 1), (0, 2, 5)]:
        packed = np.array([np.uint64(sum(x << 12 * (order - 1 - i) for i, x in enumerate(g)))])
        assert model._linear(order, packed)[0, 0] == pytest.approx(prob(g))


def test_long_texts_are_read_in_steps(spark, tokenizer):
    rng = random.Random(41)
    long = sentence(rng, 400_000, 3000)  # some 2.5 MB, several steps
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang IS NOT NULL")
    table = docs_of(spark, [long, "short text", long[:1_500_000] + "x" * 1_200_000])
    model = langid.fit(docs, F.lit(True))
    raw = np.frombuffer(long.encode(), np.uint8)
    whole = model.judge(*model.costs(raw, np.array([0, len(raw)])))
    got = {r["doc_id"]: r for r in langid.identify(table, model, ["doc_id"]).collect()}
    assert got[0]["lang_pred"] == whole["lang_pred"][0] and got[0]["cross_entropy"] == pytest.approx(whole["cross_entropy"][0], rel=1e-3)
    assert got[0]["n_letters"] == sum(c.isalpha() for c in long)
    small = quality.Classifier(buckets=1 << 10, dim=2).fit(["a b", "c d"], np.array([0, 1]), epochs=1)
    scores = {r["doc_id"]: r["score"] for r in quality.classify(table, small, ["doc_id"]).collect()}
    assert scores[0] == pytest.approx(small.score(raw, np.array([0, len(raw)]))[0], abs=1e-6)
    prints = {r["doc_id"]: int(r["fingerprint"], 16) for r in simhash.near_duplicates(table).collect()}
    assert prints[0] == brute_fingerprint(long)


# ---- searches ---------------------------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, vec string")


def awkward_vectors(rng, n):
    rows = [(i, [float(x) for x in rng.standard_normal(8)], "s", "v") for i in range(n)]
    rows += [(n + i, rows[3][1], "s", "v") for i in range(40)]  # a vector that many rows share
    return rows + [(900, None, "s", "v"), (901, [1.0, None] + [0.0] * 6, "s", "v"), (902, [float("nan")] * 8, "s", "v"), (903, [float("inf")] * 8, "s", "v"), (904, [0.0] * 8, "s", "v"), (None, [1.0] * 8, "s", "v"), (5, rows[5][1], "s", "v")]


def test_maxscore_against_brute_force(spark):
    rows = awkward_vectors(np.random.default_rng(6), 200)
    got = defaultdict(list)
    for r in maxscore.top_products(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    usable = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    queries_ = {i: v for i, v in usable if i % 50 == 0}
    assert set(got) == set(queries_)
    for q, v in queries_.items():
        best = sorted((-int(v @ w), i) for i, w in usable if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert maxscore.top_products(vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0


def test_maxscore_leaves_most_of_a_shard_untouched():
    rng = np.random.default_rng(16)
    rows = np.floor(rng.standard_exponential((4000, 64)) ** 2 * np.where(rng.random((4000, 64)) < 0.1, 20, 1))
    floors, k = rows[:1000], 5
    shard = maxscore.Postings(rows)
    for q in rows[:40]:
        known = np.sort(floors @ q)[-k]
        at = shard.competitive(q, np.zeros(0, np.int64), known, 0.5, k)
        best = np.sort(rows @ q)[::-1][:k]
        assert np.sort(rows[at] @ q)[::-1][:k].tolist() == best.tolist()
    assert shard.touched < 0.8 * 40 * len(rows)
    assert shard.probed < 0.3 * 40 * rows.size


def test_maxscore_beyond_doubles_and_longs(spark):
    rng = np.random.default_rng(17)
    for scale in (3e5, 1e8, 1e30, 1e200):
        rows = [(i, [float(x) * scale for x in rng.standard_normal(5)], "s", "v") for i in range(60)]
        rows += [(60, rows[2][1], "s", "v"), (61, [float(np.float32(1e38))] * 5, "s", "v")]
        table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string, vec string")
        got = defaultdict(list)
        for r in maxscore.top_products(table, F.col("vec_id") % 20 == 0).collect():
            got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
        whole = {i: [int(256.0 * x) if abs(256 * x) >= 2**52 else int(np.floor(256 * x)) for x in v] for i, v, *_ in rows}
        wide = 10**38 - 1
        for q in (0, 20, 40, 60):
            best = sorted((-max(min(sum(a * b for a, b in zip(whole[q], w)), wide), -wide), i) for i, w in whole.items() if i != q)[:5]
            top = 2**63 - 1
            assert sorted(got[q]) == [(n + 1, i, max(min(-s, top), -top)) for n, (s, i) in enumerate(best)]


def test_multiindex_probing_is_complete():
    rng = np.random.default_rng(7)
    for rows in (500, 60_000):  # with fewer and with more buckets than masks
        x = rng.standard_normal((rows, 40))
        codes = multiindex.Codes().fit(x[:500], 5)
        index = multiindex.Index(np.arange(rows), x, codes)
        for radius in (0, 1, 5, 9, 14):
            for q in range(5):
                near = np.flatnonzero(codes.distances(index.code, index.code[q]) <= radius)
                assert sorted(index.probe(index.code[q], radius)) == near.tolist()


def test_multiindex_recall_and_pruning_on_one_large_shard():
    rng = np.random.default_rng(18)
    centres = rng.standard_normal((200, 64))
    for x, most in ((centres[rng.integers(0, 200, 20_000)] + 0.4 * rng.standard_normal((20_000, 64)), 0.1), (rng.standard_normal((20_000, 64)), 0.6)):
        codes = multiindex.Codes().fit(x[rng.permutation(20_000)[:4096]], 10)
        index = multiindex.Index(np.arange(20_000), x, codes)
        asked = np.arange(0, 20_000, 200)
        query, place, _ = index.near(asked, x[asked], index.code[asked], 10, codes.radius)
        hits = 0
        for q in asked:
            d = ((x - x[q]) ** 2).sum(axis=1)
            d[q] = np.inf
            hits += len(set(np.argsort(d)[:10]) & set(place[query == q]))
        assert hits / (10 * len(asked)) >= 0.9
        assert index.reranked < most * len(asked) * len(x)


def test_multiindex_against_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = awkward_vectors(rng, 400)
    found = multiindex.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, 10).collect()
    usable = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    hits = total = 0
    for q, v in {i: v for i, v in usable if i % 20 == 0}.items():
        want = sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for i, w in usable if i != q)[:10]
        mine = sorted((r["rank"], r["score"], r["vec_id"]) for r in found if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1)) and [m[1:] for m in mine] == sorted(m[1:] for m in mine)
        assert len(mine) == 10
        hits += len({i for _, i in want} & {m[2] for m in mine})
        total += len(want)
    assert hits / total >= 0.9
    assert multiindex.nearest(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    few = multiindex.nearest(vectors(spark, rows[:4]), F.col("vec_id") % 20 == 0, 10).collect()
    assert len(few) == 3


# ---- mixing -----------------------------------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    weight = {k: (3.0, 1.0, 2.0)[i % 3] for i, k in enumerate(names)}
    total, target, open_ = 1.5 * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    rest = total
    while rest > 1e-9 and open_:
        share = rest / sum(weight[k] for k in open_)
        rest = 0.0
        for k in list(open_):
            target[k] += share * weight[k]
        for k in list(open_):
            if target[k] > 2 * sizes[k]:
                rest += target[k] - 2 * sizes[k]
                target[k] = 2.0 * sizes[k]
                open_.discard(k)
    return target


def test_targets_against_resharing(spark):
    rng = random.Random(8)
    for n in (1, 2, 5, 12):
        sizes = {f"s{i}": rng.choice([0, 5, 80, 1000, 30000]) for i in range(n)} | {None: 70}
        got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        for k, t in brute_targets(sizes).items():
            assert got[k] == pytest.approx(t, abs=1e-6)


def test_mix_takes_what_copies_says(spark, nasty, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = mixing.copies(docs).collect()
    taken, target = defaultdict(int), {}
    for r in found:
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
        target[r["source"]] = r["target"]
    for k in target:  # by source; what draws may add or leave out is three standard deviations of their copies' sizes
        part = [r for r in found if r["source"] == k]
        rate = target[k] / max(part[0]["source_size"], 1)
        spread = (sum(r["size"] ** 2 for r in part) * (rate % 1) * (1 - rate % 1)) ** 0.5
        assert abs(taken[k] - target[k]) <= 3 * spread + 1
    mixed = Counter(r["doc_id"] for r in mixing.mix(docs).collect())
    assert mixed == Counter({r["doc_id"]: r["copies"] for r in found if r["copies"]})
    assert mixing.mix(nasty).columns == nasty.columns
    assert all(r["size"] == 7 for r in mixing.mix(nasty).collect())
    assert mixing.copies(nasty).count() == nasty.count() and mixing.copies(empty).count() == 0


def test_joined_beyond_the_broadcast_bound(spark):
    from gridloom.llm.shared import joined

    big = spark.createDataFrame([(i % 7 or None, i) for i in range(200)], "k long, v long")
    small = spark.createDataFrame([(k or None, f"n{k}") for k in range(6)], "k long, name string")
    rows = lambda m: sorted(map(tuple, joined(big, small, ["k"], "left", most_rows=m).collect()), key=str)
    assert rows(100) == rows(2) and len(rows(2)) == 200


# ---- lines ------------------------------------------------------------------------------------------------------------


def brute_lines(rows, width=3):
    order = sorted({(i is None, i or 0, t) for i, t in rows if t is not None})
    first, gone = {}, defaultdict(set)
    for d in order:
        lines = d[2].split("\n")
        for i in range(len(lines) - width + 1):
            if first.setdefault(tuple(lines[i : i + width]), (d, i)) != (d, i):
                gone[d] |= set(range(i, i + width))
    return {(i, t): "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i is None, i or 0, t]) for i, t in rows if t is not None}


def test_line_dedup_against_brute_force(spark, nasty, empty):
    rng = random.Random(9)
    lines = [f"line {i}" for i in range(12)] + ["", ""]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.choice([1, 2, 3, 8, 30])))) for i in range(60)] + [(60, None), (61, ""), (None, "line 1\nline 2\nline 3\nown"), (3, "line 1\nline 2\nline 3\nline 1\nline 2\nline 3")]
    table = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = {(r["doc_id"], r["n_lines"]): r["text"] for r in linededup.dedup_lines(table).collect()}
    assert len(linededup.dedup_lines(table).collect()) == len(rows)
    want = brute_lines(rows)
    for (i, t), cut in want.items():
        assert got[i, len(t.split("\n"))] == cut
    assert got[60, 0] is None
    assert linededup.dedup_lines(nasty).count() == nasty.count() and linededup.dedup_lines(empty).count() == 0


def test_line_dedup_is_linear_and_keeps_clashing_columns(spark):
    import time

    took = []
    for n in (20_000, 160_000):
        text = "\n".join(["line one", "line two", "line three", "line four"] * (n // 4))
        began = time.time()
        row = linededup.dedup_lines(docs_of(spark, [text]).repartition(1)).collect()[0]
        took.append(time.time() - began)
        assert row["n_lines"] == n and row["text"].split("\n")[:4] == text.split("\n")[:4] and row["n_removed"] == n - len(row["text"].split("\n"))
    assert took[1] < 8 * took[0] + 10  # quadratic work would be 64 times as long
    names = ("__gone", "__id", "__hash", "__text_hash", "starts", "__stay", "__lines", "n", "line", "first", "__c0")
    table = docs_of(spark, ["a\nb\nc", "a\nb\nc\nd", None]).withColumns({c: F.lit(i) for i, c in enumerate(names)})
    rows = linededup.dedup_lines(table).collect()
    assert sorted((r["doc_id"], r["text"]) for r in rows) == [(0, "a\nb\nc"), (1, "d"), (2, None)]
    assert all(r[c] == i for r in rows for i, c in enumerate(names))


def test_line_dedup_runs_no_python(spark):
    plan = linededup.dedup_lines(docs_of(spark, ["a\nb\nc", "a\nb\nc\nd"]))._jdf.queryExecution().toString()
    mix = mixing.copies(docs_of(spark, ["a b"]))._jdf.queryExecution().toString()
    assert not any(k in plan + mix for k in ("Python", "Pandas", "Arrow"))


# ---- archives ---------------------------------------------------------------------------------------------------------


def test_archives_round_trip(spark):
    same = "<p>" + "é" * 700 + "WARC/1.1\r\n\r\nWARC-Type: response\r\n</p>"
    rows = [(1, "http://a/1", same), (2, None, same), (9, "http://a/9\nx", same), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (None, "u", same), (7, "u", "y" * 1000), (8, "u", "y" * 1000), (9, "http://a/9", same)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload_digest string")
    got = sorted((tuple(r) for r in warc.round_trip(pages).collect()), key=str)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        peers = [j for j, _, h in rows if j is not None and h == html] if len(data) >= 1000 else []
        revisit = i is not None and bool(peers) and i < max(peers)
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(peers) if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_reader_takes_plain_and_gzip_members():
    import gzip

    one = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nab\r\nc\r\n\r\n"
    for content in (one * 3, gzip.compress(one * 3), gzip.compress(one) * 3, b""):
        assert [b for _, b in warc.records(content)] == [b"ab\r\nc"] * (3 if content else 0)
    with pytest.raises(ValueError):
        list(warc.records(one[:-8]))


# ---- passages ---------------------------------------------------------------------------------------------------------


def test_fuzzy_passages_are_found_and_clean_documents_are_not(spark, nasty, empty):
    rng = random.Random(10)
    own = lambda n: sentence(rng, n, 100000)
    passage = own(70).split()
    edited = passage[:20] + ["new"] + passage[20:45] + passage[46:]
    swapped = passage[:30] + ["other"] + passage[31:]
    short = own(30)
    texts = [own(300), own(100) + " " + " ".join(passage) + " " + own(90), own(55) + " " + " ".join(edited) + " " + own(20), " ".join(swapped).upper() + " " + own(200), own(80) + " " + short, short + " " + own(120), own(400)]
    rows = chaining.repeated_passages(docs_of(spark, texts)).collect()
    assert {(r["doc_id"], r["ref_doc_id"]) for r in rows} == {(2, 1), (3, 1)}
    for r in rows:
        assert abs(r["ref_start"] - 100) <= 2 and abs(r["ref_end"] - 170) <= 2 and r["similarity"] >= 0.8
        assert abs(r["start_word"] - {2: 55, 3: 0}[r["doc_id"]]) <= 2
    assert chaining.repeated_passages(nasty).collect() == [] and chaining.repeated_passages(empty).count() == 0


def test_passages_at_the_declared_similarity_are_found(spark):
    rng = random.Random(21)
    own = lambda n: sentence(rng, n, 100000).split()
    texts = []
    for n in [60] * 20 + [120] * 10:  # every fifth word another one: no run of 5 words is shared
        passage = own(n)
        edited = [f"n{rng.randrange(10**6)}" if i % 5 == 2 else w for i, w in enumerate(passage)]
        texts += [" ".join(own(80) + passage + own(60)), " ".join(own(50) + edited + own(90))]
    rows = chaining.repeated_passages(docs_of(spark, texts)).collect()
    assert all(r["doc_id"] - 1 == r["ref_doc_id"] and r["doc_id"] % 2 for r in rows)
    assert len({r["doc_id"] for r in rows}) >= 27


def test_passages_whose_parts_come_first_elsewhere_are_found(spark):
    rng = random.Random(23)
    own = lambda n: sentence(rng, n, 100000).split()
    texts, wanted = [], set()
    for _ in range(10):  # two documents have half of a passage each, then three have the whole
        passage, at = own(72), len(texts)
        texts += [" ".join(own(60) + part + own(50)) for part in (passage[:36], passage[36:], passage, passage, passage[:50] + ["other"] + passage[51:])]
        wanted |= {(at + 3, at + 2), (at + 4, at + 2), (at + 4, at + 3)}
    rows = chaining.repeated_passages(docs_of(spark, texts)).collect()
    assert {(r["doc_id"], r["ref_doc_id"]) for r in rows} == wanted and all(r["n_words"] >= 70 for r in rows)


def test_first_matches_shuffle_seeds_once_and_leave_no_tables(spark):
    rng = random.Random(33)
    shared = [sentence(rng, 60) for _ in range(3)]
    texts = [" ".join([sentence(rng, 20), rng.choice(shared), sentence(rng, 20)]) for _ in range(300)] + ["a b c d e"] * 3
    base = docs_of(spark, texts).selectExpr("doc_id", "hash(text) AS dup", "text")
    rows = [tuple(r) for r in chaining.seeds(base, 4, 0.4, 12).select("seed", "doc_id", "dup", "pos").collect()]
    first = {}
    for seed, *place in rows:
        first[seed] = min(first.get(seed, place), place)
    want = Counter((*r, *first[r[0]]) for r in rows if list(r[1:3]) != first[r[0]][:2])
    few, hot = chaining.first_matches(base, 4, 0.4, 12, 10**6), chaining.first_matches(base, 4, 0.4, 12, 64)
    assert Counter(map(tuple, few.collect())) == want == Counter(map(tuple, hot.collect())) and few.columns == hot.columns == chaining.MATCH
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert plan(few).count("Exchange hashpartitioning") == 1 and "Join" not in plan(few) and "BroadcastHashJoin" in plan(hot)
    folder = Path(shared_dir(spark).removeprefix("file://")) / "gridloom"
    before = set(folder.iterdir()) if folder.exists() else set()
    assert chaining.repeated_passages(docs_of(spark, texts)).count() > 100
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before}
    assert not left & {"matches", "chains", "chain-words", "open-chains", "open-seeds", "open-counts"}


def test_passages_of_one_to_three_words_over_and_over_are_found(spark):
    rng = random.Random(22)
    own = lambda n: sentence(rng, n, 100000)
    for period in (["go"], ["buy", "now"], ["a", "b", "c"]):
        turned = period[1:] + period[:1]
        texts = [own(40) + " " + " ".join(period * 90) + " " + own(50), own(70) + " " + " ".join(period * 90) + " " + own(30), own(20) + " " + " ".join(turned * 60) + " " + own(60), own(200)]
        rows = chaining.repeated_passages(docs_of(spark, texts)).collect()
        assert {(r["doc_id"], r["ref_doc_id"]) for r in rows} == {(1, 0), (2, 0)}
        assert max(r["n_words"] for r in rows if r["doc_id"] == 1) >= 85 * len(period)


def test_edit_distance_and_chains_against_plain_forms():
    rng = np.random.default_rng(11)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    for _ in range(40):
        a = rng.integers(0, 5, rng.integers(0, 30))
        b = np.delete(a, rng.integers(0, max(len(a), 1), 2)) if len(a) > 4 else rng.integers(0, 5, 3)
        assert chaining.edit_distance(a, b) == plain(a.tolist(), b.tolist())

    def best(parts, k, cost):
        worth = []
        for d0, d1, a0, a1 in parts.tolist():
            gain = 0.0
            for w, (e0, e1, f0, f1) in zip(worth, parts.tolist()):
                p, q = max(e1 - k + 1, e0 + 1), max(f1 - k + 1, f0 + 1)
                if p <= d0 and q <= a0:
                    gain = max(gain, w - cost * (d0 - p + a0 - q))
            worth.append(d1 - d0 + gain)
        return max(worth)

    for _ in range(30):
        n = int(rng.integers(2, 12))
        d, a = np.sort(rng.integers(0, 200, n)), rng.integers(0, 200, n)
        parts = np.stack([d, d + 8 + rng.integers(0, 20, n), a, a], 1)
        parts[:, 3] = parts[:, 2] + parts[:, 1] - parts[:, 0]
        found = chaining.chains(parts, 8, 0.5, 10**6)
        assert sum(map(len, found)) == n  # every fragment is in one chain
        first = found[0]
        worth = [int(p[1] - p[0]) for p in first]
        for i in range(1, len(first)):
            (p0, p1, q0, q1), (d0, _, a0, _) = first[i - 1], first[i]
            worth[i] += worth[i - 1] - 0.5 * (d0 - max(p1 - 7, p0 + 1) + a0 - max(q1 - 7, q0 + 1))
        assert worth[-1] == pytest.approx(best(parts, 8, 0.5))


def test_word_hashes_follow_words():
    texts = ["The the  THE", "", "a\tb\nc", "x" * 9000, "é É"]
    got = [word_hashes(raw, off) for _, _, raw, off in slices(pa.array(texts))]
    h, at = got[0]
    assert np.diff(at).tolist() == [3, 0, 3, 1, 2] and len(set(h[:3].tolist())) == 1 and len(set(h.tolist())) == 7


# ---- the pipeline -----------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, nasty):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        before = Counter(r["doc_id"] for r in docs.collect())
        after = Counter(r["doc_id"] for r in rows)
        assert set(after) <= set(before)
        if name == "language_id":
            assert sum(after.values()) >= 0.98 * sum(before.values())
        if name == "line_dedup":
            assert after == before
        if name == "near_dedup":
            assert max(after.values()) == 1
        docs = spark.createDataFrame(rows, docs.schema)
    packed = corpus_pipeline.run(spark, SF)
    assert packed.count() > 0
    nothing = docs_of(spark, [None, None]).withColumns({c: F.lit(None).cast(t) for c, t in docs.dtypes})
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, nasty, SF).collect()
        assert stage(spark, nasty.limit(0), SF).collect() == [], name
        kept = stage(spark, nothing, SF).collect()
        assert len(kept) == {"language_id": 0, "near_dedup": 1, "mix_sources": 0}.get(name, 2), name


def test_named_columns_are_the_ones_operators_read():
    assert set(NAMED) == {"doc_id", "text", "lang", "source"}
