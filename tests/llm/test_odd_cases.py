"""Cases that a table may hold and models must not trip over, and plain loops beside models and scans."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import ann, base, digest, langid, licenses, ngram_join, quality, suffix_dedup, toxicity
from odd import collected, documents, labels, nothing, rows

# --- samples ---


def test_a_sample_of_a_huge_class_is_not_empty(spark):
    share = 1_500 / 10**10
    n = 200_000_000  # a fiftieth of the rows that the class is said to have
    got = spark.range(n).filter(base.drawn(F.col("id"), 1_500, 10**10)).count()
    assert abs(got - n * share) < 6 * (n * share) ** 0.5
    assert spark.range(50).filter(base.drawn(F.col("id"), 60, 50)).count() == 50


@pytest.mark.parametrize("module", [toxicity, langid, quality])
def test_models_learn_from_classes_said_to_be_huge(spark, monkeypatch, module):
    seen = []
    real = base.drawn
    monkeypatch.setattr(module, "drawn", lambda key, at_most, n, seed=0: seen.append(n) or real(key, at_most * 10**8, n * 10**8, seed))
    docs = documents(spark)
    model = module.fit(docs) if module is langid else module.fit(docs, labels(spark))
    assert seen and (model.langs == ["de", "en", "fr"] if module is langid else model is not None)


def test_a_sample_is_bounded_in_bytes_and_by_id(spark):
    table = [(k % 300, "x" * 1000 + str(k), "a") for k in range(900)]
    got = base.whole_texts(spark.createDataFrame(table, "doc_id bigint, text string, label string"), 10**9)
    assert [r["doc_id"] for r in got] == list(range(300)) and all(r["text"] == min(t for d, t, _ in table if d == r["doc_id"]) for r in got)
    few = base.whole_texts(spark.createDataFrame(table, "doc_id bigint, text string, label string"), 100_000)
    assert 50 < len(few) < 160 and {len(r["text"]) for r in few} <= {1001, 1002, 1003}


# --- toxicity ---


@pytest.mark.parametrize("texts, marks, say", [(["", " \n"], [0, 1], 0), (["", "some words"], [0, 1], 1), (["some words", "\t"], [0, 1], 0), ([], [], 0)])
def test_training_without_words_of_either_class(texts, marks, say):
    model = toxicity.train(texts, marks)
    p = toxicity.Scorer(model)(["other words", "", None])
    assert int(p[0] >= 0.5) == say and p[1] == p[2] == 0


def test_scores_are_those_of_a_plain_loop():
    from test_texts import toxic_rows

    texts, marks = toxic_rows(120)
    model = toxicity.train(texts, marks)
    more = [*toxic_rows(40, seed=4)[0], "one", "same same same same", " ".join(f"w{k % 13}" for k in range(20_000))]

    def plain(text):
        words, best = text.split(), -np.inf
        margin = {w: float(model.word_margins([w])[0]) for w in set(words)}
        for lo in range(0, max(len(words) - toxicity.WINDOW // 2, 1), toxicity.WINDOW // 2):
            total = 0.0
            for i in range(lo, min(lo + toxicity.WINDOW, len(words))):
                if words[i] not in words[max(0, i - toxicity.WINDOW + 1) : i]:
                    total += margin[words[i]]
            best = max(best, total / toxicity.WINDOW + model.bias)
        return 1 / (1 + np.exp(-np.clip(model.scale * best + model.shift, -30, 30)))

    assert np.allclose(toxicity.Scorer(model)(more), [plain(t) for t in more], atol=1e-9)


# --- language ---


def test_proportions_are_those_of_a_plain_loop():
    rng = random.Random(5)
    words = {"en": "the of and that with from stone".split(), "de": "der die und schaft zeit keit".split(), "fr": "le la queue pour être".split()}
    texts = [" ".join(rng.choice(words[x]) for _ in range(40)) for x in words for _ in range(20)]
    model = langid.learn(texts, [x for x in words for _ in range(20)])
    more = [" ".join(rng.choice(words[x]) for x in rng.choices(list(words), k=2) for _ in range(rng.randint(1, 60))) for _ in range(30)] + [" ".join(texts) * 30]

    def em(logs, shares, rounds):
        for _ in range(rounds):
            each = np.exp(logs - logs.max(1, keepdims=True)) * shares
            shares = (each / each.sum(1, keepdims=True)).mean(0)
        return shares, float((np.log((np.exp(logs - logs.max(1, keepdims=True)) * shares).sum(1)) + logs.max(1)).sum())

    def plain(text):
        logs = model.word_logs(langid.words_of(text))[:, :-1]
        k = logs.shape[1]
        whole = logs.sum(0)
        best, value = np.eye(k)[whole.argmax()], whole.max()
        full, _ = em(logs, np.full(k, 1 / k), 6)
        order = np.argsort(-full, kind="stable")
        for size in range(2, k + 1):
            if full[order[size - 1]] <= 0.01:
                break
            begin = np.zeros(k)
            begin[order[:size]] = np.maximum(full[order[:size]], 1e-3)
            shares, like = em(logs, begin / begin.sum(), 6)
            if like - model.penalty * (size - 1) > value:
                best, value = shares, like - model.penalty * (size - 1)
        return best

    for (lang, score, langs, shares), text in zip(langid.Predictor(model)(more), more, strict=True):
        want = plain(text)
        assert lang == model.langs[want.argmax()] and score == pytest.approx(want.max(), abs=1e-6)
        assert dict(zip(langs, shares, strict=True)) == pytest.approx({model.langs[j]: want[j] for j in np.flatnonzero(want)}, abs=1e-6)


# --- quality ---


def test_posteriors_are_those_of_plain_sums(spark):
    rng = random.Random(8)
    table = [(k if k % 9 else None, rng.choice(["a", "b", None]), rng.choice(["p", "q", None]), rng.random()) for k in range(200)] + [(5, "a", "p", 0.3)] * 2
    marks = [(k, rng.randint(0, 1), 0) for k in range(0, 260, 3)] + [(5, 1, 0), (5, 0, 0), (None, 1, 1)]
    found = spark.createDataFrame(table, "doc_id bigint, host string, path string, evidence double")
    labelled = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    import zlib

    good = {}
    for d, q, _ in marks:
        if d is not None and zlib.crc32(str(d).encode()) % 5:
            good[d] = min(good.get(d, 1), q)
    both = quality.with_labels(found, labelled)
    sites = quality._posteriors(both)
    one = sites.first()
    rate, h, p = one["global_rate"], one["host_strength"], one["path_strength"]
    total = [(e, 1) for _, _, _, e in table] + [(good[d], 1) for d, *_ in table if d in good]
    assert rate == pytest.approx(sum(s for s, _ in total) / len(total))

    def plain(i):
        """The posterior from every other row and its label."""

        def rest(same):
            others = [r for j, r in enumerate(table) if j != i and same(r)]
            values = [r[3] for r in others] + [good[r[0]] for r in others if r[0] in good]
            return sum(values), len(values)

        s, n = rest(lambda r: r[1] == table[i][1])
        host = (s + h * rate) / (n + h)
        s, n = rest(lambda r: r[1:3] == table[i][1:3])
        path = min(max((s + p * host) / (n + p), 1e-3), 1 - 1e-3)
        e = table[i][3]
        odds = np.log(e / (1 - e)) + np.log(path / (1 - path)) - np.log(rate / (1 - rate))
        return 1 / (1 + np.exp(-odds))

    got = sorted((r["evidence"], r["score"]) for r in quality.combine(both, sites).collect())
    assert np.allclose([x for pair in got for x in pair], [x for pair in sorted((r[3], plain(i)) for i, r in enumerate(table)) for x in pair])


def test_a_document_is_not_led_by_its_own_label(spark):
    docs = documents(spark)
    model = quality.fit(docs, labels(spark))
    marks = labels(spark)
    chosen = next(r["doc_id"] for r in marks.filter(~base.held_out(F.col("doc_id")) & (F.col("quality") == 1)).orderBy("doc_id").collect() if r["doc_id"] < 300)
    flipped = marks.withColumn("quality", F.when(F.col("doc_id") == chosen, 0).otherwise(F.col("quality")))

    def parts(with_marks):
        found = quality._found(docs, with_marks, F.col("source"), F.col("lang"), model)
        # strengths and the global rate are those of all documents; hold them to see the document's own part
        sites = quality._posteriors(found).withColumn("host_strength", F.lit(5.0)).withColumn("path_strength", F.lit(5.0)).withColumn("global_rate", F.lit(0.5))
        return quality.combine(found, sites).filter(F.col("doc_id") == chosen).first()

    a, b = parts(marks), parts(flipped)
    assert a["path_rate"] == pytest.approx(b["path_rate"]) and a["host_rate"] == pytest.approx(b["host_rate"]) and a["score"] == pytest.approx(b["score"])


# --- nearest neighbours ---


def test_repeated_queries_ask_once(spark):
    rng = np.random.default_rng(2)
    table = [(k, rng.normal(size=6).tolist()) for k in range(60)]
    table += [table[0], table[0], (10, rng.normal(size=6).tolist()), (7, table[0][1])]
    got = ann.nearest(spark.createDataFrame(table, "vec_id bigint, embedding array<double>").repartition(3), F.col("vec_id") % 10 == 0, 10).collect()
    kept = {}
    for k, v in table:  # of an id's vectors the least
        kept[k] = min(kept.get(k, v), v)
    for q in range(0, 60, 10):
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        best = sorted((float(np.sqrt(((np.array(v) - np.array(kept[q])) ** 2).sum())), k) for k, v in kept.items() if k != q)[:10]
        assert [r[0] for r in own] == list(range(1, 11)) and [r[1] for r in own] == [k for _, k in best]
        assert np.allclose([r[2] for r in own], [d for d, _ in best])
    assert len(got) == 60


# --- fingerprints ---


def test_the_first_row_follows_the_last_without_any_id(spark):
    texts = ["one text of some words", "another text", "", None, "zz the last of them", "another text"]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id bigint, text string").repartition(3)
    order = sorted(t or "" for t in texts)
    want = sorted(digest.fingerprint(digest.edited(t, after).encode()) for t, after in zip(order, order[1:] + order[:1], strict=True))
    assert sorted(r["edited_fingerprint"] for r in digest.fingerprints(docs).collect()) == want


@pytest.mark.parametrize("case", ["hot id", "first is hot", "last is hot", "no ids", "mostly none", "one text", "copies of a row", "ids of 64 bits"])
def test_rows_of_a_hot_id_follow_each_other(spark, case):
    rng = random.Random(4)

    def text():
        return rng.choice(["", "é", "common beginning of a text " + str(rng.randint(0, 40)), "".join(rng.choice("abcxyz \u00ff\u4e00\U0001f600") for _ in range(rng.randint(0, 12)))])

    hot = {"hot id": 50, "first is hot": 0, "last is hot": 99}.get(case)
    table = [(rng.randint(0, 99) if hot is None or rng.random() < 0.4 else hot, text()) for _ in range(400)]
    if case in ("no ids", "mostly none"):
        table = [(None if case == "no ids" or rng.random() < 0.7 else k, t) for k, t in table]
    if case == "one text":
        table = [(k % 3 or None, "all the same") for k, _ in table]
    if case == "ids of 64 bits":
        table = [((k << 57) + rng.randint(0, 3) - 2**62, t) for k, t in table for _ in range(1)]
        table = [(k if -(2**63) <= k < 2**63 else k % 1000 - 2**62, t) for k, t in table] + [(2**62 + k, "near") for k in range(300)]
    if case == "copies of a row":
        table += [(50, "copied")] * 400
    order = sorted(table, key=lambda r: (r[0] is None, r[0] or 0, r[1].encode()))
    want = []
    for (k, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        new = digest.edited(t, after)
        want.append((k, len(t), digest.fingerprint(t.encode()), digest.fingerprint(new.encode()), digest.likeness(digest.fingerprint(t.encode()), digest.fingerprint(after.encode()))))
    got = digest.fingerprints(spark.createDataFrame(table, "doc_id bigint, text string").repartition(5)).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["fingerprint"], r["edited_fingerprint"], r["near_next"]) for r in got), key=str) == sorted(want, key=str)


def plain_digest(raw):
    """(checksum, length, ratios, code of each bucket), byte by byte in whole numbers."""
    counts = [0] * 256
    for at in range(len(raw)):
        for k, (i, j, m) in enumerate(((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 2, 4), (0, 1, 4), (0, 3, 4))):
            if at + m < len(raw):
                h = (raw[at + i] * 0x9E3779B1 + raw[at + j] * 0x85EBCA77 + raw[at + m] * 0xC2B2AE3D + k * 0x27D4EB2F) % 2**32
                h ^= h >> 15
                counts[h * 0x2C1B3C6D % 2**32 >> 24] += 1
    q1, q2, q3 = (sorted(counts)[k] for k in (63, 127, 191))
    codes = [(c > q1) + (c > q2) + (c > q3) for c in counts]
    ratios = q1 * 16 // max(q3, 1) % 16, q2 * 16 // max(q3, 1) % 16
    return hashlib.blake2b(raw, digest_size=1).digest()[0], min(255, round(12 * math.log2(len(raw) + 1))) if raw else 0, ratios, codes


def plain_likeness(a, b):
    (check_a, n_a, r_a, c_a), (check_b, n_b, r_b, c_b) = plain_digest(a), plain_digest(b)
    score = sum({0: 0, 1: 1, 2: 2, 3: 6}[abs(x - y)] for x, y in zip(c_a, c_b, strict=True)) + 2 * max(0, abs(n_a - n_b) - 1)
    score += sum(2 * max(0, abs(x - y) - 1) for x, y in zip(r_a, r_b, strict=True)) + (check_a != check_b)
    return 1 - min(640, score) / 640


def test_digests_are_those_of_a_plain_count():
    rng = random.Random(3)
    texts = ["", "a", "ab", "abc", "aaaaaaaa", "é\u4e00", *(" ".join(rng.choice("the of and stone river light".split()) for _ in range(rng.randint(1, 200))) for _ in range(8))]
    for text in texts:
        raw = text.encode()
        check, n, (r1, r2), codes = plain_digest(raw)
        got = bytes.fromhex(digest.fingerprint(raw))
        assert (got[0], got[1], got[2] >> 4, got[2] & 15) == (check, n, r1, r2)
        assert [got[3 + k // 4] >> 2 * (k % 4) & 3 for k in range(256)] == codes
        for other in texts:
            assert digest.likeness(digest.fingerprint(raw), digest.fingerprint(other.encode())) == pytest.approx(plain_likeness(raw, other.encode()))


# --- n-gram Jaccard join ---


@pytest.mark.parametrize("bits, cell, hot", [(64, 3, 1), (6, 1024, 100_000), (5, 2, 1)])
def test_classes_by_cells_hot_keys_and_colliding_ids(spark, monkeypatch, bits, cell, hot):
    from test_matches import classes, near_copies

    for name, value in (("ID_BITS", bits), ("CELL", cell), ("HOT_TILE", hot), ("SMALL", 2), ("COMMON", 1), ("LEADS", 1), ("BLOCK", 3)):
        monkeypatch.setattr(ngram_join, name, value)
    monkeypatch.setattr(base, "HOT_ROWS", hot)
    table = [(r[0], r[1]) for r in rows(count=60)] + [(10_000 + k, t) for k, t in near_copies(copies=10)]
    got = ngram_join.near_classes(spark.createDataFrame(table, "doc_id bigint, text string").repartition(3)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == classes(table)


def test_of_repeated_ids_the_least_text_stays(spark):
    table = [(1, "b text of some words that nobody else has", 3), (1, "a text of quite other words than those", 2), (1, "a text of quite other words than those", 1), (2, "x y z", 1)]
    for _ in range(3):
        random.Random(1).shuffle(table)
        got = ngram_join.keep_first(spark.createDataFrame(table, "doc_id bigint, text string, extra int").repartition(2)).orderBy("doc_id").collect()
        assert [r["doc_id"] for r in got] == [1, 2] and got[0]["text"].startswith("a text")
    again = ngram_join.keep_first(spark.createDataFrame(list(reversed(table)), "doc_id bigint, text string, extra int")).filter("doc_id = 1").first()
    assert again["extra"] == got[0]["extra"]


# --- licenses ---


def naive(index, text, least=0.8):
    """Aligns every template at every diagonal of the text."""
    found = [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"\w+(?:\.\w+)*", text)]
    ids = [index.vocabulary.get(w, 0) for w, _, _ in found]
    matches = set()
    for name, template in index.templates:
        for d in range(-len(template), len(ids)):
            n, first, end = index.align(ids, template, d)
            if n >= least * len(template):
                matches.add((n / len(template), n, name, first, end))
    chosen = []
    for m in sorted(matches, key=lambda x: (-x[1], -x[0], x[2], x[3])):
        if all(m[4] < c[3] or m[3] > c[4] for c in chosen):
            chosen.append(m)
    return [(m[2], m[1]) for m in sorted(chosen, key=lambda x: x[3])]


def test_licenses_are_those_of_an_alignment_at_every_place():
    index, rng = licenses.Index(), random.Random(7)
    prose = "the license of this work is with or without the house under a river that any person may use".split()
    notices = [t for own in licenses.TEMPLATES.values() for t in own if len(t) < 400]
    for k in range(60):
        words = [rng.choice(prose) for _ in range(rng.randint(0, 25))]
        for _ in range(rng.randint(1, 2)):
            notice = rng.choice(notices).split()
            for i in rng.sample(range(len(notice)), int(0.12 * len(notice)) if k % 2 else 0):
                notice[i] = "changed"
            words += [*notice, *(rng.choice(prose) for _ in range(rng.randint(0, 20)))]
        text = " ".join(words)
        assert [(m[0], m[2]) for m in index.scan(text)] == naive(index, text)


def test_licenses_in_documents(spark):
    mit, long = licenses.TEMPLATES["MIT"][2], "word " * 40_000
    table = [(1, "x " + mit + " y"), (2, "Released under an MIT License."), (3, long + licenses.TEMPLATES["ISC"][0]), (4, None), (5, ""), (6, "the MIT house"), (None, licenses.TEMPLATES["LGPL-3.0"][0]), (1, "x " + mit + " y")]
    got = licenses.scan(spark.createDataFrame(table, "doc_id bigint, text string")).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == 8 and [by_id[k]["licenses"] for k in (1, 2, 3, 4, 5, 6, None)] == [["MIT"], ["MIT"], ["ISC"], [], [], [], ["LGPL-3.0"]]
    m = by_id[1]["matches"][0]
    assert m["coverage"] == 1 and table[0][1][m["start"] : m["end"]] == mit.rstrip(".")
    m = by_id[3]["matches"][0]
    assert table[2][1][m["start"] : m["end"]].endswith("in all copies")


# --- empty tables, odd rows ---


def test_filters_of_empty_tables_give_empty_tables(spark):
    import corpus_pipeline

    docs, none = documents(spark), nothing(spark)
    model = langid.fit(docs)
    for out in (langid.keep_identified(none, model, 0.5), quality.keep_good(none, labels(spark), F.col("source"), F.col("lang")), ngram_join.keep_first(none), suffix_dedup.cut_repeats(none)):
        assert out.columns == docs.columns and out.count() == 0
    for name, stage in corpus_pipeline.STAGES[:1] + corpus_pipeline.STAGES[2:]:
        assert stage(spark, none, "/root/testdata/sf0.001").count() == 0, name


def test_a_pipeline_over_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    none = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    none.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_very_long_texts_are_judged_whole(spark):
    filler = " ".join(f"stone light {k % 7} house" for k in range(25_000))
    docs = documents(spark).unionByName(spark.createDataFrame([(9_000, filler, "en", "s1")], "doc_id bigint, text string, lang string, source string"), allowMissingColumns=True)
    lang = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, langid.fit(documents(spark))).collect()}
    assert lang[9_000] == "en"
    scored = collected(quality.assess(docs, labels(spark), F.col("source"), F.col("lang")))
    assert [r["doc_id"] for r in scored if r["doc_id"] == 9_000] == [9_000]
    n = {r["doc_id"]: r["n_chars"] for r in digest.fingerprints(docs).collect()}
    assert n[9_000] == len(filler)
