"""Operators that compare documents or vectors with each other, against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import ann, graph, ngram_join, suffix_dedup
from odd import collected, documents, nothing, rows


# --- n-gram Jaccard join ---


def shingle_set(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def classes(table):
    """row number -> (size, smallest doc_id of its component)"""
    sets = [shingle_set(r[1]) for r in table]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= 80 * (len(a) + len(sets[j]) - common):
                root[find(i)] = find(j)
    out = []
    for i, a in enumerate(sets):
        ids = [r[0] for k, r in enumerate(table) if find(k) == find(i) and r[0] is not None]
        out.append((table[i][0], len(a), (min(ids) if ids else None) if a else table[i][0]))
    return sorted(out, key=str)


def near_copies(seed=5, groups=6, copies=14):
    rng = random.Random(seed)
    out, key = [], 0
    for g in range(groups):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(3, 90))]
        for _ in range(copies):
            words = [w if rng.random() > 0.006 * g else f"x{rng.randint(0, 9)}" for w in base]
            out.append((key, " ".join(words[rng.randint(0, 3) :])))
            key += 1
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("small, common, leads, block", [(32, 32, 3, 512), (2, 1, 1, 3)])
def test_near_classes(spark, monkeypatch, small, common, leads, block):
    for name, value in (("SMALL", small), ("COMMON", common), ("LEADS", leads), ("BLOCK", block)):
        monkeypatch.setattr(ngram_join, name, value)
    table = [(r[0], r[1]) for r in rows()] + [(10_000 + k, t) for k, t in near_copies()]
    got = ngram_join.near_classes(spark.createDataFrame(table, "doc_id bigint, text string").withColumn("sid", F.lit("x")).repartition(3)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == classes(table)


def test_rows_without_an_id_link(spark):
    words = [f"w{k}" for k in range(120)]

    def changed(*at):
        return " ".join("x" if k in at else w for k, w in enumerate(words))

    # the outer two are near the row between them only, which has no id
    table = [(1, changed(*range(10, 16))), (None, changed()), (None, changed()), (2, changed(*range(100, 106))), (3, "some other text of a few words")]
    assert {c for d, _, c in classes(table) if d != 3} == {1}
    got = ngram_join.near_classes(spark.createDataFrame(table, "doc_id bigint, text string")).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == classes(table)


def test_near_classes_of_nothing(spark):
    assert ngram_join.near_classes(nothing(spark)).count() == 0


def test_ids_by_shuffle_give_the_same(spark, monkeypatch):
    table = spark.createDataFrame(near_copies(7, 3, 5), "doc_id bigint, text string")
    want = sorted(map(tuple, ngram_join.near_classes(table).collect()))
    monkeypatch.setattr(ngram_join, "MOST_BROADCAST", 1)
    assert sorted(map(tuple, ngram_join.near_classes(table).collect())) == want


def test_one_document_of_each_group_stays(spark):
    docs = documents(spark)
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns
    table = [(r[0], r[1]) for r in rows()]
    want = {d for d, _, c in classes(table) if d is not None and d == c}
    got = [r["doc_id"] for r in kept.collect()]
    assert {x for x in got if x is not None} == want and len([x for x in got if x is not None]) == len(want)


@settings(max_examples=80, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300), st.sets(st.integers(0, 2**64 - 1), max_size=300), st.integers(0, 300))
def test_bitmaps_never_bound_too_low(a, b, shared):
    both = sorted(a)[:shared]
    x, y = np.array(sorted(a), np.uint64), np.array(sorted(b | set(both)), np.uint64)
    common = len(np.intersect1d(x, y))
    bound = ngram_join.overlap_bound(ngram_join.parity_bits(x).tobytes(), ngram_join.parity_bits(y).tobytes(), len(x), len(y))
    assert bound >= common


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aB é\t\n\x0b1", max_size=120), st.integers(1, 7))
def test_word_hashes_split_like_the_pattern(text, block):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    got = ngram_join.word_hashes(text, block).tolist()
    assert len(got) == len(words) and len(set(got)) == len(set(words))
    assert got == ngram_join.word_hashes(text).tolist()


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000 + rng.randint(0, 60), 5000 + rng.randint(0, 60)) for _ in range(40)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    want = {(x, find(x)) for x in list(root) if find(x) != x}
    assert {(r["node"], r["root"]) for r in graph.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()} == want
    assert graph.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


# --- suffix dedup ---


def removed(table):
    """Sorted (doc_id, bytes, bytes removed, runs, digest) by looking at every 50-byte string."""
    first = {}
    raws = [(d, (t or "").encode()) for d, t in table]
    for d, raw in raws:
        if d is not None:
            for p in range(len(raw) - 49):
                key = raw[p : p + 50]
                first[key] = min(first.get(key, d), d)
    out = []
    for d, raw in raws:
        gone = np.zeros(len(raw), bool)
        if d is not None:
            for p in range(len(raw) - 49):
                if first[raw[p : p + 50]] < d:
                    gone[p : p + 50] = True
        edge = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out.append((d, len(raw), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("batch, block", [(1 << 15, 1 << 18), (40, 300)])
def test_repeats_are_cut(spark, monkeypatch, batch, block):
    monkeypatch.setattr(suffix_dedup, "_BATCH_RUNS", batch)
    monkeypatch.setattr(suffix_dedup, "_BLOCK", block)
    table = [(r[0], r[1]) for r in rows()] + [(20_000 + k, "ab" * (40 * k) + "é" * k) for k in range(4)] + [(30_000, "x" * 49), (30_001, "x" * 49)]
    got = suffix_dedup.deduplicate(spark.createDataFrame(table, "doc_id bigint, text string").withColumn("home", F.lit(1)).repartition(3)).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in got), key=str) == removed(table)


def test_repeats_of_nothing(spark):
    assert suffix_dedup.deduplicate(nothing(spark)).count() == 0


def test_cut_documents_keep_their_columns(spark):
    docs = documents(spark)
    got = {r["doc_id"]: r for r in suffix_dedup.cut_repeats(docs).collect() if r["doc_id"] is not None}
    want = {d: (n, k) for d, n, k, _, _ in removed([(r[0], r[1]) for r in rows()]) if d is not None}
    for r in rows():
        if r[0] is not None:
            if want[r[0]][1] and want[r[0]][0] == want[r[0]][1]:
                assert r[0] not in got
            else:
                assert got[r[0]]["rank"] == "x" and (want[r[0]][1] > 0 or got[r[0]]["text"] == r[1])
    assert suffix_dedup.cut_repeats(docs).columns == docs.columns


def random_texts(seed, count, words=30):
    rng = random.Random(seed)
    return [(k, " ".join(f"w{rng.randint(0, 9)}" if rng.random() < 0.1 else "common words of a passage".split()[i % 5] for i in range(rng.randint(0, words)))) for k in range(count)]


@given(st.lists(st.binary(min_size=0, max_size=130).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=12))
@settings(deadline=None, max_examples=60)
def test_a_suffix_array_is_in_the_order_of_bytes(raws):
    text = np.frombuffer(b"".join(raws) + b"\0" * 50, np.uint8)
    at = np.arange(len(text) - 49)
    rng = np.random.default_rng(len(text))
    doc = rng.integers(0, 9, len(at))
    level, some, place = suffix_dedup.suffix_array(text, at, doc)
    raw = text.tobytes()
    want = {}
    for p, d in zip(at.tolist(), doc.tolist(), strict=True):
        want[raw[p : p + 50]] = min(want.get(raw[p : p + 50], 99), d)
    own = [raw[p : p + 50] for p in level.at.tolist()]
    assert own == sorted(want) and level.least.tolist() == [want[x] for x in own]
    assert [own[k] for k in place.tolist()] == [raw[p : p + 50] for p in at.tolist()]
    again = suffix_dedup.Level.unpack(level.pack())
    assert (again.at == level.at).all() and (again.word == level.word).all() and (again.scan(some) == level.least).all()


def test_levels_fall_geometrically():
    index, rng = suffix_dedup.Levels(), np.random.default_rng(1)
    known, never = {}, np.iinfo(np.int64).max
    for doc in range(40):
        text = rng.choice(np.frombuffer(b"ab\0", np.uint8), 160, p=[0.02, 0.02, 0.96])
        level, some, _ = suffix_dedup.suffix_array(text, np.arange(111), np.full(111, doc))
        found = index.scan(some)
        own = [text.tobytes()[p : p + 50] for p in level.at.tolist()]
        assert found.tolist() == [known.get(x, never) for x in own]
        fresh = np.flatnonzero(found == never)
        if len(fresh):
            index.add(suffix_dedup.Level(level.text, level.at[fresh], level.word[fresh], level.least[fresh]))
        for x in own:
            known.setdefault(x, doc)
    sizes = [len(level.at) for level in index.levels]
    assert sum(sizes) == len(known) and len(sizes) <= 8 and all(a > 2 * b for a, b in zip(sizes, sizes[1:], strict=False))


def test_runs_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_K", [np.uint64(0)] * 4)  # all runs look alike
    text = np.frombuffer(b"a" * 60 + b"b" * 60 + b"a" * 60 + b"b" * 59 + b"c", np.uint8)
    at = np.array([0, 60, 120, 180])
    rep, kind = suffix_dedup.same_runs(text, at, np.full(4, 60), np.zeros(4, np.uint32))
    assert kind[0] == kind[2] and len({kind[0], kind[1], kind[3]}) == 3
    assert text[at[rep[kind]]].tolist() == [97, 98, 97, 98]


def test_new_batches_meet_stored_levels(spark, tmp_path):
    table = random_texts(3, 160) + [(200 + k, t) for k, t in random_texts(3, 40)]
    index, got = str(tmp_path / "index"), []
    for i in range(0, 200, 25):  # eight batches of ascending ids
        docs = spark.createDataFrame(table[i : i + 25], "doc_id bigint, text string").repartition(3)
        got += suffix_dedup.deduplicate(docs, index).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in got), key=str) == removed(table)
    levels = suffix_dedup.stored_levels(spark, index).collect()
    strings = {t.encode()[p : p + 50] for _, t in table for p in range(len(t) - 49)}
    sizes = {}
    for r in levels:
        level = suffix_dedup.Level.unpack(r["blob"])
        sizes.setdefault(r["bucket"], {})[r["place"]] = len(level.at)
    assert sum(n for own in sizes.values() for n in own.values()) == len(strings)
    for own in sizes.values():
        assert sorted(own) == list(range(len(own))) and all(own[k] > 2 * own[k + 1] for k in range(len(own) - 1))
    assert any(len(own) > 1 for own in sizes.values()) and max(r["gen"] for r in levels) > min(r["gen"] for r in levels)
    assert suffix_dedup.deduplicate(nothing(spark), index).count() == 0


def test_rows_of_one_id_keep_their_own_bytes(spark, monkeypatch):
    passage = " ".join(f"word{k}" for k in range(40))
    table = [(1, passage), (5, "some text before it " + passage), (5, passage + " and after"), (5, passage + " and after"), (5, "short"), (7, passage)]
    want = removed(table[:2]) + removed(table[:1] + table[2:4]) + [removed([(5, "short")])[0], removed(table[:1] + table[5:])[1]]
    for most in (1_000_000, 0):
        monkeypatch.setattr(suffix_dedup, "MOST_BROADCAST", most)
        got = suffix_dedup.deduplicate(spark.createDataFrame(table, "doc_id bigint, text string").repartition(2)).collect()
        assert sorted({tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in got}, key=str) == sorted(set(want), key=str)
        assert len(got) == 6


def test_columns_of_any_name(spark):
    names = "_home, home, blob, tag, row, had, kind, bucket, `a.b`".split(", ")
    docs = spark.createDataFrame(random_texts(4, 60), "doc_id bigint, text string")
    wide = docs.select("*", *(F.lit(k).alias(c.strip("`")) for k, c in enumerate(names)))
    got = suffix_dedup.cut_repeats(wide)
    assert got.columns == wide.columns and got.select("`a.b`", "_home").distinct().collect() == [(8, 0)]
    assert sorted(r[:2] for r in got.collect()) == sorted(tuple(r) for r in suffix_dedup.cut_repeats(docs).collect())
    assert suffix_dedup.cut_repeats(wide.limit(0)).count() == 0


def test_runs_of_many_documents_are_sent_for_smaller_ids_only(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_FLUSH", 2_000)
    monkeypatch.setattr(suffix_dedup, "_MANY", 2)
    rng = random.Random(2)
    passage = " ".join(f"w{rng.randint(0, 99)}" for _ in range(40))
    table = [(k, f"{rng.randint(0, 10**6)} {passage[rng.randint(0, 3) :]} {rng.randint(0, 10**6)}") for k in range(300)]
    rng.shuffle(table)
    for most in (100_000, 5):
        monkeypatch.setattr(suffix_dedup, "_MOST_SEEN", most)
        got = suffix_dedup.deduplicate(spark.createDataFrame(table, "doc_id bigint, text string").repartition(2)).collect()
        assert sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in got), key=str) == removed(table)
    docs, seen = [(d, 0, t.encode()) for d, t in table], {}
    rows = [sum(kind == suffix_dedup._RUNS for _, kind, _ in suffix_dedup.send(docs[i : i + 30], 1, seen)) for i in range(0, 300, 30)]
    sent = [len(suffix_dedup._unpack(blob, suffix_dedup._ENTRY)[0]) for _ in (0,) for i in (0,) for _, kind, blob in suffix_dedup.send([(10**6 + k, 0, passage.encode()) for k in range(9)], 1, seen) if kind == suffix_dedup._RUNS]
    assert all(r <= 1 for r in rows) and sum(sent) < 9 * 5


def test_a_very_long_text(spark):
    rng = random.Random(6)
    long = " ".join(str(rng.randint(0, 10**9)) for _ in range(60_000))  # over two blocks of strings
    table = [(1, long), (2, long[300_000:400_000]), (3, "x" + long), (4, " " * 300_000), (5, " " * 100)]
    got = suffix_dedup.deduplicate(spark.createDataFrame(table, "doc_id bigint, text string")).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in got), key=str) == removed(table)


# --- nearest neighbours ---


def vectors(n=400, width=8, seed=3):
    rng = np.random.default_rng(seed)
    out = [(i, [float(x) for x in rng.normal(size=width).astype(np.float32)]) for i in range(n)]
    for i in range(5, 300, 7):
        out[i] = (i, out[4][1])  # many copies of one vector
    out += [(n, None), (n + 1, [0.0] * width), (n + 2, [float("nan")] + [1.0] * (width - 1)), (n + 3, [None] + [1.0] * (width - 1)), (n + 4, [1.0]), (None, out[3][1]), (20, out[20][1])]
    return out


def test_nearest(spark):
    table = vectors()
    df = spark.createDataFrame(table, "vec_id bigint, embedding array<float>").withColumn("rank", F.lit(0)).repartition(4)
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, 10).orderBy("query_id", "rank").collect()
    good = {i: np.array(v, np.float64) for i, v in table if i is not None and i < 400}
    ids = np.array(sorted(good))
    x = np.stack([good[i] for i in ids])
    hits = total = 0
    for q in range(0, 400, 20):
        d = np.sqrt(((x - good[q]) ** 2).sum(1))
        order = [int(ids[k]) for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        own = [r for r in got if r["query_id"] == q]
        assert [r["rank"] for r in own] == list(range(1, 11)) and q not in {r["vec_id"] for r in own}
        assert all(r["score"] == np.sqrt(((good[r["vec_id"]] - good[q]) ** 2).sum()) for r in own)
        assert [(r["score"], r["vec_id"]) for r in own] == sorted((r["score"], r["vec_id"]) for r in own)
        hits += len({r["vec_id"] for r in own} & set(order))
        total += 10
    assert {r["query_id"] for r in got} == set(range(0, 400, 20)) and hits / total >= 0.9


def test_nearest_of_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], "vec_id bigint, embedding array<double>")
    got = [tuple(r) for r in ann.nearest(few, F.col("vec_id") == 0, 10).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 0.0), (0, 2, 1, pytest.approx(2**0.5))]
    assert ann.nearest(few.filter("vec_id < 0"), F.col("vec_id") == 0, 10).count() == 0
    assert ann.nearest(few, F.col("vec_id") == 99, 10).count() == 0


def test_collected_is_in_order(spark):
    assert collected(documents(spark))[0]["doc_id"] == 0
