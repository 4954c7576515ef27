"""The operators against their plain versions, on a fixture of hard cases and on the smallest tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlark.llm import mixing, packing, phrases, quality, queries, simhash, suffixes, topk
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def hard_cases():
    """Nulls, empty, blank and long texts, copies, near copies, shared passages, control and multi-byte characters, repeated rows."""
    dice = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)] + ["é", "naïve", "ß", "日本語", " x", "A", "b#", "$$", " "]
    text = lambda n: " ".join(dice.choices(vocabulary, k=n))
    shared = [text(n) for n in (34, 35, 36, 90)]
    texts = [None, None, "", " ", "\n\t", "one", "One", "two words", "three plain words", "line\nline\nline\n\nother", text(30), text(300)]
    texts += [text(5) + " " + s + " " + text(5) for s in shared for _ in range(3)] + [s + "\n" + s for s in shared] + [texts[-1]] * 4
    texts += [texts[11].replace("w1 ", "w2 ", 1), texts[11] + " tail", texts[11].upper(), "ab" * 300, "ab" * 301, "\x00" * 250, "\x00" * 260 + "x", "word " * 120, text(9000)]
    body = text(40).ljust(190, "z")[:190]
    texts += [x + "\x00" * n for n in (0, 10, 12) for x in (body, "before " + body, "x" * 80 + body)] + ["y" * 5 + body + "\x00" * 10 + "end", body + "\x00" * 9 + "\x01"]
    rows = [(k if k != 3 else None, t, [None, "en", "de"][k % 3], [None, "web", "Book", "code", "wiki"][min(k % 7, 4)], None, "x") for k, t in enumerate(texts)]
    return rows + [rows[11], rows[11], (None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(hard_cases(), DOCS).cache()


@pytest.fixture(scope="module")
def table(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("which", ["docs", "table"])
def test_recurring_words(which, request):
    df = request.getfixturevalue(which)
    assert rows(phrases.recurring_words(df)) == brute.recurring_words(pairs(df))


@pytest.mark.parametrize("which", ["docs", "table"])
def test_recurring_bytes(which, request):
    df = request.getfixturevalue(which)
    assert rows(suffixes.recurring_bytes(df)) == brute.recurring_bytes(pairs(df))


@pytest.mark.parametrize("crowd", [1000, 1])
def test_crowded_anchors(docs, crowd):
    """Anchors above the crowd limit take the other way and give the same rows."""
    from meshlark.llm._passages import Units, distinct_texts, recurring_spans

    texts = distinct_texts(docs)
    for units, spans_of in (
        (Units(phrases.WINDOW, phrases.ANCHOR, bytes.split, b" ".join, phrases._order(phrases.ANCHOR)), lambda s: phrases.occurrences(s, phrases.WINDOW)),
        (Units(suffixes.WINDOW, suffixes.ANCHOR, bytes, bytes, suffixes._order(suffixes.ANCHOR)), lambda s: suffixes.matches(s, suffixes.WINDOW)),
    ):
        found = {bytes(r["key"]): {i for s in r["spans"] for i in range(s["lo"], s["hi"])} for r in recurring_spans(texts, units, spans_of, crowd).collect()}
        parts = {bytes(r["key"]): (units.split(bytes(r["text"])), r["copies"]) for r in texts.collect()}
        masks = brute.recurring([p for p, n in parts.values() for _ in range(n)], units.window)
        keys = [k for k, (_, n) in parts.items() for _ in range(n)]
        for key, mask in zip(keys, masks, strict=True):
            if parts[key][1] == 1:
                assert found.get(key, set()) == {i for i, m in enumerate(mask) if m}


def test_automaton_takes_only_what_it_finds_twice():
    a, b = [f"a{k}".encode() for k in range(60)], [f"b{k}".encode() for k in range(60)]
    got = phrases.located([a, b, a[10:50] + b[:10], b[55:]], [False] * 4, 35)
    assert sorted(got) == [(0, 10, 50), (2, 0, 40)]
    assert phrases.located([a], [True], 35) == [(0, 0, 60)] and phrases.located([a, b], [False, False], 35) == []


def test_levels_merge_geometrically(spark):
    """Seven batches leave levels of four, two and one; each is in order and holds every suffix once; matches are those of a plain search."""
    dice, window = random.Random(8), 12
    body = [bytes(dice.choices(b"ab\x00", k=dice.randrange(12, 40))) for _ in range(140)]
    rows = [(k % 3, k % 7, k.to_bytes(16, "big"), False, b) for k, b in enumerate(body)]
    df = spark.createDataFrame(rows, "shard int, batch int, cid binary, many boolean, body binary").cache()
    family, found = suffixes.Family(window), defaultdict(set)
    for k in range(7):
        for part in family.add(df.where(F.col("batch") == k).drop("batch")):
            for r in part.collect():
                found[bytes(r["cid"])] |= set(range(r["lo"], r["hi"]))
    assert [n for n, _ in family.levels] == [4, 2, 1]
    total = 0
    for _, table in family.levels:
        for r in table.where("cid is null").collect():
            text, order = bytes(r["body"]), np.frombuffer(r["suffixes"], np.int32)
            heads = [text[a : a + window] for a in order]
            assert heads == sorted(heads) and len(set(order)) == len(order)
            total += len(order)
    assert total == sum(len(b) - window + 1 for b in body)
    for shard in range(3):
        own = [k for k in range(len(body)) if k % 3 == shard]
        for k, mask in zip(own, brute.recurring([body[k] for k in own], window), strict=True):
            assert found[k.to_bytes(16, "big")] == {i for i, m in enumerate(mask) if m}


@pytest.mark.parametrize("which", ["docs", "table"])
def test_simhash(which, request):
    df = request.getfixturevalue(which)
    assert rows(simhash.near_duplicates(df)) == brute.simhash(pairs(df))


def test_simhash_crowded_nodes(spark):
    """Thousands of fingerprints below one mask, so that nodes are split and parts meet; copies of one fingerprint too."""
    dice = np.random.default_rng(3)
    base = dice.integers(0, 1 << 20, 12000)
    fp = [int(x) << 3 for x in base.tolist()]
    got = simhash.links(spark.createDataFrame([(k, [v]) for k, v in enumerate(sorted(set(fp)))], "id long, fp array<long>"))
    values = np.array(sorted(set(fp)))
    near = [np.nonzero(np.bitwise_count(values[k : k + 500, None] ^ values[None]) <= 3) for k in range(0, len(values), 500)]
    p = np.concatenate([a + 500 * k for k, (a, _) in enumerate(near)])
    q = np.concatenate([b for _, b in near])
    found = np.array([tuple(r) for r in got.collect()])
    # The pairs are a spanning forest, so what they connect counts and not the pairs themselves.
    assert (simhash._forest(len(values), p, q) == simhash._forest(len(values), found[:, 0], found[:, 1])).all()


@pytest.mark.parametrize("which", ["docs", "table"])
def test_quality_base(which, request):
    df = request.getfixturevalue(which)
    got = rows(quality.judge(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    assert got == sorted(((i, *brute.quality(t)) for i, t in pairs(df)), key=str)


def test_quality_verdicts(spark, sf_dir):
    """No document that fails a base rule is kept; of the labelled ones, good ones stay and bad ones go for the most part."""
    out = queries.op4_quality_rules(spark, sf_dir)
    assert out.where("kept and base_failed").isEmpty()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    by = {r["quality"]: r["kept"] for r in out.join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()}
    assert by.get(1, 1.0) > 0.9


def test_js_distance(spark):
    p, q = [3, 0, 5, 2], [1, 1, 0, 7]
    a, b = np.array(p) / 10, np.array(q) / 9
    entropy = lambda x: -(x[x > 0] * np.log2(x[x > 0])).sum()
    want = np.sqrt(entropy((a + b) / 2) - (entropy(a) + entropy(b)) / 2)
    df = spark.createDataFrame([(p, q), (p, p), ([0, 0, 0, 0], q)], "p array<int>, q array<int>")
    got = [r[0] for r in df.select(quality.js_distance(F.col("p"), F.col("q"))).collect()]
    assert got[0] == pytest.approx(want) and got[1] == pytest.approx(0) and got[2] is None


@pytest.mark.parametrize("which", ["docs", "table"])
def test_mixing(which, request):
    df = request.getfixturevalue(which)
    out = mixing.mix_sources(df, extra=("source",)).collect()
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    given = sorted(((i, len(brute.words(t))) for i, t in pairs(df)), key=str)
    assert sorted(((r["doc_id"], r["size"]) for r in out), key=str) == given
    for r in out:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert r["taken"] <= 3 * r["size"]
    want = brute.targets(dict(sizes))
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(float(want[r["source"]]))
    for s, t in want.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1
    again = mixing.mix_sources(df.repartition(3), extra=("source",))
    assert rows(again) == sorted(map(tuple, out), key=str)


def test_mixing_deals_hot_sources_evenly(spark):
    """Symbols that stretch the keys and rows that repeat leave no range with much more than its share."""
    rows = [(1, "same text again and again", "hot")] * 3000 + [(k, "#$%& " * 9 + f"w{k}", "hot") for k in range(3000)]
    sized = mixing.stored(mixing.sized(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    order = ["src_null", "src", "key", "doc_id", "size", "row"]
    dealt = sized.repartitionByRange(4, *order).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in dealt) < 0.4 * len(rows)
    out = mixing.mix(sized)
    assert out.count() == 6000 and out.agg(F.sum("taken")).first()[0] == sum(len(t.split()) for _, t, _ in rows)


def test_encoder_forgets_by_bytes(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 1000)
    encode = packing._encoder.__wrapped__(queries.tokenizer_path(), 1)
    texts = [b"alpha beta gamma", b"x" * 5000, b"alpha delta 12", "né à".encode()]
    assert [encode([t])[0] for t in texts * 3] == encode(texts * 3)
    assert sum(len(c) + len(x) for c, x in encode.__closure__[[*encode.__code__.co_freevars].index("known")].cell_contents.items()) < 20_000


@pytest.mark.parametrize("which", ["docs", "table"])
def test_packing(which, request):
    from tokenizers import Tokenizer

    df = request.getfixturevalue(which)
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    want = []
    for i, t in pairs(df):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    out = packing.pack_documents(df, queries.tokenizer_path()).collect()
    assert sorted((tuple(r)[:5] for r in out), key=str) == sorted(want, key=str)
    places = defaultdict(list)
    for r in out:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:], strict=False)) and sum(p[-1]) <= 4096
    assert len(places) <= -(-sum(r["length"] for r in out) // 4096) * 1.05 + 1


def test_plan_matches_single_pieces():
    dice = random.Random(2)
    for _ in range(30):
        histogram = {dice.randint(1, 64): dice.randint(1, 40) for _ in range(12)}
        got = packing.plan_slots(histogram, 64)
        places = defaultdict(list)
        for length, rank, ranks, first, each, offset in got:
            for k in range(ranks):
                places[first + k // each].append((offset + k % each * length, length))
        assert sum(map(len, places.values())) == sum(histogram.values())
        for p in places.values():
            p.sort()
            assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:], strict=False)) and sum(p[-1]) <= 64


def test_top_k(spark, sf_dir):
    vectors = topk.integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    got = topk.top_k(vectors, F.col("id") % 100 == 0)
    plain = [(r["id"], r["v"]) for r in vectors.collect()]
    assert sorted(map(tuple, got.collect())) == brute.top_k(plain, {i for i, _ in plain if i % 100 == 0})


def test_top_k_hard(spark):
    dice = np.random.default_rng(1)
    vectors = [(k, dice.normal(size=4).round(2).tolist()) for k in range(150)] + [(k, [0.5, 0.5, 0.0, 0.0]) for k in range(150, 180)]
    odd = [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [float("nan"), 0.0, 0.0, 0.0]), (300, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0]), (203, [1.0, 2.0])]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>")
    ints = topk.integer_vectors(df)
    plain = [(r["id"], r["v"]) for r in ints.collect()]
    assert len(plain) == 181
    got = topk.top_k(ints, F.col("id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == brute.top_k(plain, {i for i, _ in plain if i % 10 == 0})
    assert topk.top_k(ints.where("id < 0"), F.col("id") % 10 == 0).isEmpty()


def test_top_k_skips_blocks(spark):
    """Clusters far from each other: most block pairs are ruled out by the pivot table, and the rows are those of a plain search."""
    dice = np.random.default_rng(4)
    centers = dice.integers(-2000, 2000, (8, 6))
    vectors = [(k, (centers[k % 8] + dice.integers(-40, 40, 6)).tolist()) for k in range(1600)]
    df = spark.createDataFrame(vectors, "id long, v array<long>").cache()
    got = topk.top_k(df, F.col("id") % 20 == 0)
    assert sorted(map(tuple, got.collect())) == brute.top_k(vectors, {i for i, _ in vectors if i % 20 == 0})
    pivots = topk.choose_pivots(df)
    table = topk.pivot_table(df, pivots).cache()
    candidates = topk._dealt(table, 100, "cb")
    best = {r["query_id"]: float(r["score"]) for r in got.where("rank = 10").collect()}
    floors = spark.createDataFrame(list(best.items()), "id long, floor double")
    queries = topk._dealt(table.where("id % 20 = 0"), 100, "qb").join(floors, "id")
    pairs = topk.open_pairs(queries, candidates, len(pivots)).count()
    blocks = queries.select("qb").distinct().count() * candidates.select("cb").distinct().count()
    assert 0 < pairs < 0.6 * blocks


def test_top_k_small_blocks(spark, monkeypatch):
    """Blocks, chunks and tiles of a few rows give the same rows."""
    for name, value in {"QUERY_BLOCK": 3, "CANDIDATE_BLOCK": 20, "TILE": 7, "STEP": 4}.items():
        monkeypatch.setattr(topk, name, value)
    dice = np.random.default_rng(6)
    vectors = [(k, v) for k, v in enumerate(dice.integers(-5, 5, (200, 3)).tolist())]
    got = topk.top_k(spark.createDataFrame(vectors, "id long, v array<long>"), F.col("id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == brute.top_k(vectors, {i for i, _ in vectors if i % 10 == 0})


def test_empty_tables(spark, docs):
    none = docs.where("doc_id < 0")
    for out in (phrases.recurring_words(none), suffixes.recurring_bytes(none), simhash.near_duplicates(none), quality.judge(none), mixing.mix_sources(none), packing.pack_documents(none, queries.tokenizer_path())):
        assert out.isEmpty()


def test_digest_of_nothing():
    assert brute.recurring_words([(1, None)]) == [(1, 0, 0, hashlib.sha256(b"").hexdigest())]
