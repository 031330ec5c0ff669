"""Operators that judge or encode one text at a time."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import bpe, digest, langid, licenses, packing, quality, toxicity
from ledgerloom.llm.base import held_out
from odd import collected, documents, labels, nothing, rows

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")


# --- byte-level BPE ---


@pytest.mark.parametrize("chunk, overlap", [(16_384, 512), (200, 40)])
def test_bpe_is_that_of_the_library(spark, chunk, overlap):
    enc, _ = bpe.codec(RANKS, public_tokenizers.PATTERN)
    got = collected(bpe.encode(documents(spark), RANKS, public_tokenizers.PATTERN, chunk, overlap))
    want = sorted(((r[0], *bpe.digests(enc.encode_ordinary(r[1] or ""), (r[1] or "").encode())) for r in rows()), key=str)
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got), key=str) == want
    assert bpe.encode(nothing(spark), RANKS, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab' \n1é!re", max_size=300))
def test_pieces_between_shared_boundaries_encode_as_the_whole(text):
    enc, pattern = bpe.codec(RANKS, public_tokenizers.PATTERN)
    whole = [m.start() for m in pattern.finditer(text)]
    for at in whole:
        if at and text[at - 1].isspace():
            continue
        assert enc.encode_ordinary(text[:at]) + enc.encode_ordinary(text[at:]) == enc.encode_ordinary(text)


# --- packing ---


def test_word_encoder_is_the_file():
    from tokenizers import Tokenizer

    file, own = Tokenizer.from_file(WORDS), packing.WordEncoder(WORDS)
    assert own.pieces is not None
    texts = [r[1] or "" for r in rows()] + ["a\x1cb", "<|endoftext|> hi", "it's don't 'RE 12a3 ﬁ Σας ΣΑΣ İstanbul 你好 ½ x² _a_ é́", "ǅ ʰa ab'sx 's's <|", " x y"]
    for _ in range(2):  # the second time from memory
        assert own(texts) == [np.asarray(file.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def check_packed(got, capacity):
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_pack(spark):
    from tokenizers import Tokenizer

    file, capacity = Tokenizer.from_file(WORDS), 128
    got = collected(packing.pack(documents(spark), WORDS, capacity, 0))
    want = []
    for r in rows():
        ids = np.asarray([*file.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(r[0], k, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes())) for k, at in enumerate(range(0, len(ids), capacity))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == sorted(want, key=str)
    sequences = check_packed(got, capacity)
    alone = sum(2 * w[3] > capacity for w in want)  # no two of these fit together
    assert sequences <= 1.02 * max(-(-sum(w[3] for w in want) // capacity), alone)
    assert packing.pack(nothing(spark), WORDS, capacity, 0).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 30), max_size=20))
def test_plan_places_every_piece_once(counts):
    the_plan = packing.plan(counts, 32)
    used = {}
    for n, shape in the_plan:
        assert n > 0 and sum(shape) <= 32
        for x in shape:
            used[x] = used.get(x, 0) + n
    assert used == counts
    sequences = sum(n for n, _ in the_plan)
    total = sum(k * n for k, n in counts.items())
    # never worse than first fit's guarantee against the volume
    assert total <= 32 * sequences and sequences <= max(2 * -(-total // 32), 1)


def test_exact_complements_come_first():
    assert packing.plan({20: 4, 12: 2, 8: 2, 4: 2}, 32) == [(2, (20, 12)), (2, (20, 8, 4))]
    assert packing.plan({32: 5}, 32) == [(5, (32,))]
    assert packing.plan({}, 32) == []


# --- language ---


def test_languages(spark):
    docs = documents(spark)
    model = langid.fit(docs)
    assert model.langs == ["de", "en", "fr"]
    got = collected(langid.predict(docs, model))
    assert len(got) == len(rows())
    by_id = {r["doc_id"]: r for r in got}
    for key in (15, 18, 21, 45):
        assert (by_id[key]["lang_pred"], by_id[key]["score"]) == ("und", 0)
    real = [r for r in rows() if r[0] is not None and r[2] and r[1] and len(r[1]) > 60 and "pass" not in r[1] and r[0] % 21 and r[0] not in (30, 33, 36, 39, 42)]
    assert np.mean([by_id[r[0]]["lang_pred"] == r[2] for r in real]) > 0.95
    assert all(0 <= r["score"] <= 1 and sum(r["proportions"]) <= 1 + 1e-6 for r in got)
    assert all(r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert langid.predict(nothing(spark), model).count() == 0
    none = langid.fit(nothing(spark))
    assert {r["lang_pred"] for r in collected(langid.predict(docs, none))} == {"und"}


def test_a_mixed_text_gets_both_languages():
    rng = random.Random(4)
    words = {"en": "the of and that with from stone".split(), "de": "der die und schaft zeit keit".split()}
    texts = [" ".join(rng.choice(words[x]) for _ in range(80)) for x in ("en", "de") for _ in range(20)]
    model = langid.learn(texts, ["en"] * 20 + ["de"] * 20)
    (lang, score, langs, shares), (one, sure, only, _) = langid.Predictor(model)([texts[0] + " " + " ".join(texts[20].split()[:40]), texts[1]])
    assert lang == "en" and set(langs) == {"en", "de"} and score == pytest.approx(2 / 3, abs=0.06)
    assert (one, only) == ("en", ["en"]) and sure == pytest.approx(1)


def test_identified_documents_keep_their_columns(spark):
    docs = documents(spark)
    kept = langid.keep_identified(docs, langid.fit(docs), 0.25)
    assert kept.columns == docs.columns
    gone = {r[0] for r in rows()} - {r["doc_id"] for r in kept.collect()}
    assert gone == {15, 18, 21, 45}


def test_documents_without_a_main_language_go(spark):
    import corpus_pipeline

    rng = random.Random(6)
    parts = {
        "de": "schaft zeit keit wein strasse unter gegen durch nicht".split(),
        "en": "the with that stone river light house which thing".split(),
        "fr": "queue pour leurs dans avec mais toujours chez quelle".split(),
        "es": "ción ñando para llamar pero donde hasta muy cuando".split(),
    }

    def text(*langs, n=60):
        return " ".join(rng.choice(parts[x]) + rng.choice(["", rng.choice(parts[x])]) for x in langs for _ in range(n // len(langs)))

    clean = [(text(x), x) for x in parts for _ in range(30)]
    uneven = [(text("en", "en", "en", "fr"), None) for _ in range(5)]
    even = [(text("en", "de"), None) for _ in range(5)] + [(text(*parts, n=80), None) for _ in range(5)]
    unlearned = [("привет мир как дела сегодня хорошо и тепло на улице у реки " * 3, None), ("joulupukki yöllä kävi hyvää jäätelöä myymässä työmaalla " * 4, None)]
    junk = [(" ".join("".join(rng.choice("bcdfghjklmnpqrstvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(50)), None) for _ in range(5)]
    cases = [*clean, *uneven, *even, *unlearned, *junk]
    docs = spark.createDataFrame([(k, t, x) for k, (t, x) in enumerate(cases)], "doc_id bigint, text string, lang string")
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert kept == set(range(len(clean) + len(uneven)))


# --- toxicity ---


def toxic_rows(n=300, seed=2):
    rng = random.Random(seed)
    clean = [a + b for a in "ka lo mi ne ru ta vo wi".split() for b in "ber den gon lis mar".split()]
    texts, marks = [], []
    for k in range(n):
        words = [rng.choice(clean) for _ in range(rng.randint(5, 150))]
        if k % 3 == 0:
            for _ in range(max(1, len(words) // 40)):
                words[rng.randrange(len(words))] = rng.choice(["grobnik", "shmurzle", "blagface"])
        texts.append(" ".join(words))
        marks.append(int(k % 3 == 0))
    return texts, marks


def test_toxic_words_and_their_misspellings():
    texts, marks = toxic_rows()
    model = toxicity.train(texts, marks)
    other, truth = toxic_rows(seed=9)
    p = toxicity.Scorer(model)(other)
    assert np.mean((p >= 0.5) == np.array(truth)) > 0.98
    clean = next(t for t, m in zip(other, truth, strict=True) if not m)
    bent = toxicity.Scorer(model)([clean + " grobnikk shmurzles", clean, None, ""])
    assert bent[0] > 0.5 > bent[1] and bent[2] == bent[3] < 0.5


def test_toxicity_of_odd_rows(spark):
    docs = documents(spark)
    model = toxicity.fit(docs, labels(spark))
    got = collected(toxicity.score(docs, model))
    assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert toxicity.score(nothing(spark), model).count() == 0
    untaught = toxicity.fit(nothing(spark), labels(spark))
    assert {r["predicted"] for r in collected(toxicity.score(docs, untaught))} == {0}


def test_no_label_of_the_held_out_fold_is_learned(spark):
    from pyspark.sql import functions as F

    docs, marks = documents(spark), labels(spark)
    turned = marks.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, marks), toxicity.fit(docs, turned)
    assert np.array_equal(a.margin, b.margin) and (a.bias, a.scale, a.shift) == (b.bias, b.scale, b.shift)


# --- quality ---


def test_quality_separates_noise():
    rng = random.Random(3)
    good = [" ".join(rng.choice("the of and stone river light house that".split()) + str(rng.randint(0, 50)) for _ in range(80)) for _ in range(100)]
    bad = [" ".join(w + "%%%" for w in t.split()) for t in good[:50]] + ["spam " * 90 for _ in range(50)]
    model = quality.train(good[:60] + bad[::2], [1] * 60 + [0] * 50, 0.8)
    assert (model.evidence(good[60:]) > 0.5).all() and (model.evidence(bad[1::2]) < 0.5).all()
    assert model.evidence([None, ""]).shape == (2,)


def test_sparse_sites_shrink(spark):
    from pyspark.sql import functions as F

    data = [(i, "big" if i < 800 else "bad" if i < 1000 else "tiny", "p" if i % 2 else None, 0.9 if i < 800 else 0.2 if i < 1000 else 0.01) for i in range(1001)]
    found = spark.createDataFrame(data, "doc_id bigint, host string, path string, evidence double")
    sites = quality.posteriors(found, spark.createDataFrame([], "doc_id bigint, quality int"))
    rate = {(r["host"], r["path"]): r["host_rate"] for r in sites.collect()}
    overall = sites.first()["global_rate"]
    assert rate["big", "p"] > 0.85 and rate["bad", None] < 0.3
    assert abs(rate["tiny", None] - overall) < abs(0.01 - overall)  # one document: toward the global rate
    scored = quality.combine(found, sites)
    assert scored.count() == 1001 and scored.filter(F.col("score").between(0, 1)).count() == 1001


def test_quality_of_odd_rows(spark):
    from pyspark.sql import functions as F

    docs = documents(spark)
    got = quality.assess(docs, labels(spark), F.col("source"), F.col("lang"))
    assert got.count() == len(rows()) and got.filter("score between 0 and 1").count() == len(rows())
    kept = quality.keep_good(docs, labels(spark), F.col("source"), F.col("lang"))
    assert kept.columns == docs.columns and kept.count() == got.filter("keep").count()
    assert quality.assess(nothing(spark), labels(spark), F.col("source"), F.col("lang")).count() == 0


# --- fingerprints ---


def test_fingerprints(spark):
    got = collected(digest.fingerprints(documents(spark)))
    table = sorted(rows(), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    texts = [r[1] or "" for r in table]
    assert len(got) == len(table)
    want = []
    for r, text, after in zip(table, texts, texts[1:] + texts[:1], strict=True):
        new = digest.edited(text, after)
        a, b, c = (digest.fingerprint(x.encode()) for x in (text, new, after))
        want.append((r[0], len(text), hashlib.sha256(new.encode()).hexdigest(), a, b, digest.likeness(a, b), digest.likeness(a, c)))
    have = [tuple(r[c] for c in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)
    assert digest.fingerprints(nothing(spark)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400), st.binary(max_size=400))
def test_likeness_is_bounded_and_symmetric(a, b):
    x, y = digest.fingerprint(a), digest.fingerprint(b)
    assert 0 <= digest.likeness(x, y) == digest.likeness(y, x) <= 1 and digest.likeness(x, x) == 1


def test_blocks_count_like_the_whole(monkeypatch):
    raw = bytes(random.Random(1).randrange(97, 110) for _ in range(5000))
    whole = digest.triplet_counts(raw)
    monkeypatch.setattr(digest, "_BLOCK", 777)
    assert np.array_equal(whole, digest.triplet_counts(raw)) and whole.sum() == sum(5000 - max(t) for t in digest._TRIPLETS)


# --- licenses ---


def test_license_spans():
    index = licenses.Index()
    text = "Some words.\nReleased under the MIT License. More; licensed under the Apache software license, version 2.0 (or so)\nthe license of the house"
    found = index.scan(text)
    assert [(m[0], text[m[3] : m[4]]) for m in found] == [("MIT", "Released under the MIT License"), ("Apache-2.0", "licensed under the Apache software license, version 2.0")]
    assert found[0][1] == 1 and found[1][1] == 1
    assert index.scan("under the license of the work") == [] == index.scan(None) == index.scan("")
    both = index.scan("Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0.")
    assert len(both) == 2


def test_licenses_of_odd_rows(spark):
    docs = documents(spark)
    got = collected(licenses.scan(docs))
    assert len(got) == len(rows()) and all(r["n_licenses"] == 0 for r in got)
    assert licenses.scan(nothing(spark)).count() == 0
