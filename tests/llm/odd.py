"""A small table of documents with what a corpus can hold: nulls, empty and long texts, copies, repeats, clashing names."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, home int, rank string, sid string, n int, score string, host int"
WORDS = {"en": "the of and that with from stone river light house", "de": "der die und schaft zeit keit wein strasse", "fr": "le la les queue éau ment pour être"}


def rows(seed: int = 1, count: int = 120):
    rng = random.Random(seed)
    out = []
    passage = " ".join(rng.choice(WORDS["en"].split()) + str(rng.randint(0, 99)) for _ in range(60))
    for k in range(count):
        lang = rng.choice(list(WORDS))
        text = " ".join(rng.choice(WORDS[lang].split()) + (rng.choice(["", "", ",", ".", "\n"])) + rng.choice(["", str(rng.randint(0, 9))]) for _ in range(rng.randint(1, 160)))
        if k % 7 == 0:
            text += "\n" + passage
        out.append([k * 3, text, lang, f"s{k % 4}"])
    out[5][1], out[6][1], out[7][1] = None, "", "12 345 !!! ---"
    out[8][2] = out[9][3] = None
    out[10][1] = out[11][1] = out[50][1]
    out[12][1] = out[50][1] + " tail"
    out[13][1] = "a" * 3000
    out[14][1] = "ab " * 2500 + "end"
    out[15][1] = "  \t\n "
    out.append(list(out[20]))  # a repeated row
    out.append([None, out[50][1], "en", "s1"])
    out.append([None, None, None, None])
    return [(*r, None if r[1] is None else len(r[1]), 1, "x", "y", 2, "z", 3) for r in out]


def documents(spark, **kw):
    return spark.createDataFrame(rows(**kw), SCHEMA).repartition(5)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark):
    found = [(r[0], i % 2, int(i % 5 == 0)) for i, r in enumerate(rows()) if r[0] is not None] + [(3, None, None), (None, 1, 1), (999_999, 0, 1)]
    return spark.createDataFrame(found, "doc_id bigint, quality int, toxic int")


def collected(df):
    return [r.asDict() for r in df.orderBy(F.col("doc_id").asc_nulls_last()).collect()]
