"""Stores, frozen files, record logs, ordered parts and runs: what they refuse, and blocks that change nothing."""

import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import audit, book, runs
from ledgerloom.sources import record_log, store, views


def ticks(spark, n=500, cut=300):
    return spark.createDataFrame([(k // cut, k % cut, k // 120, 100 + k / 100) for k in range(n)], "session long, row_id long, segment long, mid double").repartition(3)


def test_a_store_knows_its_files(spark, tmp_path):
    path = str(tmp_path / "store")
    manifest = store.write_store(ticks(spark), path, 64)
    assert manifest["files"] == 5 + 4 and manifest["bytes"] > 0
    runs_kept = spark.read.parquet(f"{path}/_chunks")
    assert runs_kept.agg(F.sum("rows")).first()[0] == 500 and runs_kept.filter(F.col("last") - F.col("first") + 1 != F.col("rows")).count() == 0
    assert store.open_store(spark, path, verify=True).count() == 500 and store.store_problems(spark, path).count() == 0
    files = sorted(f for f in spark.read.parquet(path).inputFiles())
    first = files[0].removeprefix("file://")
    with open(first, "ab") as f:
        f.write(b"x")
    checksum = os.path.join(os.path.dirname(first), f".{os.path.basename(first)}.crc")
    if os.path.exists(checksum):
        os.remove(checksum)
    assert [r["problem"] for r in store.store_problems(spark, path).collect()] == ["changed"]
    with pytest.raises(ValueError, match="changed"):
        store.open_store(spark, path, verify=True)
    os.remove(first)
    assert [r["problem"] for r in store.store_problems(spark, path).collect()] == ["missing"]
    inventory = spark.read.parquet(f"{path}/_chunks").withColumn("rows", F.col("rows") + 1)
    inventory.write.parquet(str(tmp_path / "other"))
    spark.read.parquet(str(tmp_path / "other")).write.mode("overwrite").parquet(f"{path}/_chunks")
    with pytest.raises(ValueError, match="rows aren't"):
        store.open_store(spark, path)
    with pytest.raises(ValueError, match="no rows"):
        store.write_store(ticks(spark).limit(0), str(tmp_path / "none"))
    with pytest.raises(ValueError, match="gaps"):
        store.write_store(ticks(spark).filter("row_id <> 7"), str(tmp_path / "gaps"))


def test_frozen_files_stay_in_their_root(spark, tmp_path):
    root = tmp_path / "root"
    (root / "day").mkdir(parents=True)
    ticks(spark).coalesce(1).write.parquet(str(tmp_path / "made"))
    made = next(p for p in (tmp_path / "made").iterdir() if p.suffix == ".parquet")
    for name in ("a.parquet", "day/b.parquet"):
        (root / name).write_bytes(made.read_bytes())
    import hashlib

    digest = hashlib.sha256(made.read_bytes()).hexdigest()
    asked = [("a.parquet", digest), ("day/b.parquet", digest)]
    frame = lambda rows: spark.createDataFrame(rows, "path string, sha256 string")
    assert store.read_verified(spark, str(root), frame(asked)).count() == 1000
    odd = [*asked[:1], ("day/b.parquet", "0" * 64), ("none", digest), ("../made/x", digest), ("/etc/passwd", digest), ("file:/etc/passwd", digest), ("day//b.parquet", digest)]
    got = {r["path"]: r["problem"] for r in store.verified_files(spark, str(root), frame(odd)).collect()}
    assert got == {"a.parquet": None, "day/b.parquet": "changed", "none": "missing", "../made/x": "outside", "/etc/passwd": "outside", "file:/etc/passwd": "outside", "day//b.parquet": "outside"}
    with pytest.raises(ValueError, match="changed"):
        store.read_verified(spark, str(root), frame(odd[:2]))


def test_a_frozen_sample_is_written_once(spark, tmp_path):
    path, sample = str(tmp_path / "sample.json"), {"seed": 29, "pair_ids": [3, 1, 2]}
    a, b = store.freeze(spark, path, sample), store.freeze(spark, path, dict(reversed(sample.items())))
    assert a == b and a["pair_ids"] == [3, 1, 2]
    with pytest.raises(ValueError, match="other content"):
        store.freeze(spark, path, sample | {"seed": 30})


def test_parts_of_other_kinds_are_refused(spark):
    part = spark.createDataFrame([(1, 7, "a"), (2, 7, "b")], "id long, instrument_id long, v string")
    assert [r["source_row"] for r in store.ordered_parts([part, part.limit(0), part], "id").orderBy("source_row").collect()] == [0, 1, 2, 3]
    with pytest.raises(ValueError, match="other columns"):
        store.ordered_parts([part, part.withColumn("v", F.lit(1))], "id")
    with pytest.raises(ValueError, match="instrument_id"):
        store.ordered_parts([part, part.withColumn("instrument_id", F.lit(8).cast("long"))], "id")
    with pytest.raises(ValueError):
        store.ordered_parts([], "id")


def test_ranges_meet_blocks_of_rows(spark):
    rng = random.Random(1)
    ranges = [(s, *sorted((rng.randint(0, 280), rng.randint(0, 280)))) for s in (0, 1) for _ in range(12)]
    got = store.read_ranges(ticks(spark, 560, 280), spark.createDataFrame(ranges, "session long, start long, stop long"), ["mid"], block=16).groupBy("session", "row_id").count().collect()
    want = {}
    for s, a, b in ranges:
        for k in range(a, b):
            want[s, k] = want.get((s, k), 0) + 1
    assert {(r["session"], r["row_id"]): r["count"] for r in got} == want


# --- record logs ---


def events(n=700, seed=3):
    rng = random.Random(seed)
    return [(None if k == 9 else 10**18 + k, 10**18 + k - 5, rng.choice("ACMTRFN"), rng.choice("BAN"), None if k % 50 == 7 else 4000 + rng.randint(0, 99) / 4, rng.randint(1, 50), 2**63 + k if k % 2 else k, rng.randint(0, 255), k, 1, 5602) for k in range(n)]


def as_rows(log):
    return [(recv, event, action, side, price, float(size), order, flags, sequence, publisher, instrument) for recv, event, action, side, price, size, order, flags, sequence, publisher, instrument in log]


COLUMNS = ["ts_recv", "ts_event", "action", "side", "price", "size", "order_id", "flags", "sequence", "publisher_id", "instrument_id"]


@pytest.mark.parametrize("compressed", [False, True])
def test_a_record_log_is_read_whole(spark, tmp_path, compressed):
    record_log.register(spark)
    log, name = events(), "x.dbn.zst" if compressed else "x.dbn"
    record_log.write_log(str(tmp_path / name), log, compressed, b"some metadata")
    got = spark.read.format("record_log").option("rowsPerTask", 100).option("pieceBytes", 1000).load(str(tmp_path))
    assert got.rdd.getNumPartitions() == (1 if compressed else 7)
    rows = got.orderBy("source_row").collect()
    assert [r["source_row"] for r in rows] == list(range(700))
    assert [tuple(int(r[c]) if c == "order_id" else r[c] for c in COLUMNS) for r in rows] == as_rows(log)


def test_frames_one_after_the_other_are_one_log(spark, tmp_path):
    import zstandard

    log, plain = events(50), tmp_path / "x.dbn"
    record_log.write_log(str(plain), log)
    raw = plain.read_bytes()
    pieces = [raw[:5], raw[5:333], raw[333:]]
    whole = tmp_path / "frames.dbn.zst"
    whole.write_bytes(b"".join(zstandard.ZstdCompressor().compress(p) for p in pieces))
    assert sum(len(b) for b in record_log.records(str(whole), 40)) == 50
    cut = tmp_path / "cut.dbn.zst"
    cut.write_bytes(whole.read_bytes()[:-3])
    with pytest.raises(record_log.LogError, match="cut off"):
        list(record_log.records(str(cut)))


@pytest.mark.parametrize("change, what", [(lambda raw: raw[:-5], "ends inside|after the last"), (lambda raw: b"XXX" + raw[3:], "not a log"), (lambda raw: raw[:4], "no header"), (lambda raw: raw[:8] + b"\x05" + raw[9:], "isn't an order event")])
def test_broken_logs_are_refused(spark, tmp_path, change, what):
    record_log.register(spark)
    path = tmp_path / "x.dbn"
    record_log.write_log(str(path), events(20))
    path.write_bytes(change(path.read_bytes()))
    with pytest.raises(record_log.LogError, match=what):
        list(record_log.records(str(path)))
    with pytest.raises(Exception, match=what):
        spark.read.format("record_log").load(str(path)).collect()


def test_a_log_without_records(spark, tmp_path):
    record_log.register(spark)
    record_log.write_log(str(tmp_path / "x.dbn"), [])
    assert list(record_log.records(str(tmp_path / "x.dbn"))) == []
    assert spark.read.format("record_log").load(str(tmp_path)).count() == 0


# --- runs ---


def test_runs_across_buckets(spark):
    rng = random.Random(5)
    rows = [(s, k, rng.choice(["a", "b", None]), rng.randint(0, 50)) for s in (0, 1) for k in range(100)]
    df = spark.createDataFrame(rows, "session long, place long, label string, ns long").repartition(4)
    for size in (1, 7, 1000):
        bucket = F.call_function("div", F.col("place"), F.lit(size))
        got = {(r["session"], r["place"]): r["run"] for r in runs.run_ids(df, "session", "place", "label", bucket).collect()}
        back = {(r["session"], r["place"]) for r in runs.clock_regressions(df, "session", "place", "ns", bucket).collect()}
        for s in (0, 1):
            own, run = [r for r in rows if r[0] == s], 0
            for before, r in zip([None, *own], own, strict=False):
                run += before is not None and before[2] != r[2]
                assert got[s, r[1]] == run
                assert ((s, r[1]) in back) == (before is not None and r[3] < before[3])


def test_generated_sessions_walk(spark, monkeypatch):
    got = views.generate_sessions(spark, 3, 40, 5).orderBy("session", "row_id").collect()
    monkeypatch.setattr(views, "SPAN", 7)
    assert views.generate_sessions(spark, 3, 40, 5).repartition(5).orderBy("session", "row_id").collect() == got
    for s in range(3):
        own = [r for r in got if r["session"] == s]
        assert [r["row_id"] for r in own] == list(range(40))
        assert all(abs(b["mid"] - a["mid"]) <= 1 and 0 < b["ts"] - a["ts"] <= 1_000_000 for a, b in zip(own, own[1:], strict=False))


def test_histories_refuse_anchors_without_one(spark):
    rows = ticks(spark, 100, 1000).withColumn("run", F.lit(0)).withColumn("brk", F.lit(False))
    ok = runs.histories(rows, spark.createDataFrame([(0, 15), (0, 40)], "session long, anchor long"), "mid", 16).orderBy("anchor").collect()
    assert [len(r["x"]) for r in ok] == [16, 16] and ok[0]["x"][0] == 100
    for bad in ((0, 14), (0, 100), (3, 20)):
        with pytest.raises(Exception, match="no whole history"):
            runs.histories(rows, spark.createDataFrame([bad], "session long, anchor long"), "mid", 16).collect()


# --- books and audits ---


def test_levels_refuse_what_is_not_there():
    side = book.Side(True)
    with pytest.raises(book.ReplayError):
        side.add(99.0, -1.0, -1)
    side.add(99.0, 5.0, 1)
    with pytest.raises(book.ReplayError):
        side.add(99.0, -5.0, -2)


def test_audits_look_at_the_rows_before(spark):
    events = views.mbo(spark, "/root/testdata/sf0.001")
    good = book.observations(book.replay(events)).persist()
    assert audit.refuse_broken(audit.audit(good)) is None
    late = F.col("source_row") % 5 == 0
    for broken, name in (
        (good.withColumn("before_ts", F.when(late, F.col("before_ts") - 1).otherwise(F.col("before_ts"))), "row_before"),
        (good.withColumn("x", F.transform("x", lambda v, i: F.when(i == 84, F.sqrt(1 - v * v) * 0.5).otherwise(v))), "time_of_day"),
    ):
        with pytest.raises(ValueError, match=name):
            audit.refuse_broken(audit.audit(broken))
    with pytest.raises(ValueError, match="not_on_date"):
        audit.refuse_broken(audit.audit(good, date=F.lit("1999-01-01").cast("date")))
    good.unpersist()


def test_corpus_problems(spark):
    rows = [(k, f"d{k}", k, "c") for k in range(7)]
    frame = lambda r: spark.createDataFrame(r, "session long, sha256 string, seed long, config string")
    found = lambda r: {x["problem"]: x["n"] for x in audit.corpus_problems(frame(r)).collect()}
    assert found(rows) == {}
    assert found(rows[:6]) == {"too few sessions": 6}
    assert found([*rows, (8, "d1", 2, "e")]) == {"shared digests": 1, "shared seeds": 1, "several configurations": 2}


# --- jobs and reports ---


def test_jobs_go_on_after_a_failure(spark, tmp_path):
    folder, begun = str(tmp_path / "done"), []

    def work(day, bad=("d2",)):
        begun.append(day)
        if day in bad:
            raise ValueError("cut off")
        return {"rows": spark.range(int(day[1:])).count()}

    first = store.run_jobs(spark, ["d3", "d1", "d2"], work, folder, 2)
    assert [(r["day"], r["status"]) for r in first] == [("d1", "finished"), ("d2", "failed"), ("d3", "finished")] and "cut off" in first[1]["error"]
    begun.clear()
    second = store.run_jobs(spark, ["d1", "d2", "d3"], lambda d: work(d, ()), folder)
    assert [(r["status"], r["rows"]) for r in second] == [("finished before", 1), ("finished", 2), ("finished before", 3)] and begun == ["d2"]
    with pytest.raises(ValueError):
        store.run_jobs(spark, [], work, folder, 0)


def test_a_validation_sample_is_frozen(spark, tmp_path):
    from ledgerloom.operators.seeded import SeededOrder
    from ledgerloom.streaming.replay import validation_sample

    path, order = str(tmp_path / "sample.json"), SeededOrder(500, "c", "validation", 29)
    a = validation_sample(spark, order, 40, path).orderBy("place").collect()
    assert a == validation_sample(spark, order, 40, path).orderBy("place").collect() and [r["pair_id"] for r in a] == order.numbers(range(40)).tolist()
    for other, n in ((SeededOrder(500, "c", "validation", 30), 40), (order, 41)):
        with pytest.raises(ValueError):
            validation_sample(spark, other, n, path)


def test_replay_reports(spark, tmp_path):
    events = views.mbo(spark, "/root/testdata/sf0.001")
    report, path = book.replay_metrics(events, book.replay(events)), str(tmp_path / "report")
    store.write_report(report, path)
    assert spark.read.json(path).agg(F.sum("rows"), F.sum("records")).first() == (341, 1000)
    with pytest.raises(Exception):
        store.write_report(report, path)
