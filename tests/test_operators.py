"""Operators on hand-made rows: edges that the tables don't reach."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom import schema
from ledgerloom.functions import scalars as S
from ledgerloom.operators import audit, book, fit, pairs, runs, states
from ledgerloom.operators.seeded import SeededOrder
from ledgerloom.sources import store, views
from ledgerloom.streaming.replay import PairStream, replay_stream


def test_feature_names_and_row(spark):
    names = schema.feature_names()
    assert len(names) == 86 and names[80:] == ["spread_ticks", "time_delta_seconds", "mid_return", "initial", "tod_sin", "tod_cos"]
    level = "array<struct<price: double, qty: double, orders: bigint>>"
    df = spark.createDataFrame([([(99.0, 15.0, 2)], [(101.0, 20.0, 3)], 100.0, 2_000_000_000, 99.0, 1_000_000_000)], f"b {level}, a {level}, mid double, ns bigint, pm double, pn bigint")
    row = df.select(S.feature_row(F.col("b"), F.col("a"), F.col("mid"), 1.0, F.col("ns"), F.col("pm"), F.col("pn"))).first()[0]
    assert len(row) == 86 and row[:4] == [-1, 15, 2, 1] and row[40:44] == [1, 20, 3, 1] and row[80:82] == [2, 1]
    assert row[82] == pytest.approx(math.log(100 / 99)) and row[83] == 0
    crossed = df.withColumn("b", F.array(F.struct(F.lit(102.0).alias("price"), F.lit(1.0).alias("qty"), F.lit(1).cast("bigint").alias("orders"))))
    with pytest.raises(Exception, match="not a valid book state"):
        crossed.select(S.feature_row(F.col("b"), F.col("a"), F.col("mid"), 1.0, F.col("ns"), F.col("pm"), F.col("pn"))).collect()


def test_time_of_day(spark):
    df = spark.createDataFrame([(1612539000_000000001,), (1625149800_000000001,)], "ns bigint")
    got = [r[0] for r in df.select(S.seconds_since_midnight(F.col("ns"))).collect()]
    assert got == pytest.approx([34_200, 34_200], abs=1e-6)
    sim = spark.createDataFrame([(0,), (86_400_000_000_000 - 1,)], "ns bigint").select(*S.time_of_day_pair(S.seconds_since_midnight(F.col("ns"), "simulation"))).collect()
    assert tuple(sim[0]) == (0, 1) and tuple(sim[1]) == pytest.approx((0, 1), abs=1e-9)


@pytest.mark.parametrize("gap", [1, 2, 5, 384])
@pytest.mark.parametrize("ranges", [[(0, 15)], [(0, 4), (8, 13), (500, 504)], [(0, 1000)], [(255, 256), (638, 639)], [(255, 256), (638, 640)], []])
def test_range_pairs(spark, gap, ranges):
    rows = [x for a, b in ranges for x in range(a, b)]
    want = sum(1 for i, x in enumerate(rows) for y in rows[i + 1 :] if y - x >= gap)
    df = spark.createDataFrame([(0, i, a, b) for i, (a, b) in enumerate(ranges)], "session bigint, run bigint, start bigint, stop bigint")
    got = pairs.within_pairs(df, gap).collect()
    assert (got[0]["within_pairs"] if got else 0) == want


def test_range_pairs_are_closed_form(spark):
    df = spark.createDataFrame([(0, 0, 0, 3_000_000_000)], "session bigint, run bigint, start bigint, stop bigint")
    n = 3_000_000_000 - 384
    assert pairs.within_pairs(df, 384).first()["within_pairs"] == n * (n + 1) // 2


def test_rank_and_unrank():
    rng = random.Random(3)
    for _ in range(30):
        ranges = {}
        for s in range(4):
            rows = sorted(rng.sample(range(40), 8))
            ranges[s] = [(x, x + 1) for x in rows]
        merged = {}
        for s, r in ranges.items():
            out = []
            for a, b in r:
                if out and out[-1][1] == a:
                    out[-1] = (out[-1][0], b)
                else:
                    out.append((a, b))
            merged[s] = out
        index = pairs.PairIndex(merged, 5)
        rows = [(s, x) for s, r in merged.items() for a, b in r for x in range(a, b)]
        want = [(*p, *q) for i, p in enumerate(rows) for q in rows[i + 1 :] if p[0] != q[0] or q[1] - p[1] >= 5]
        # by first session: its own pairs by the earlier anchor, then those with later sessions
        want.sort(key=lambda x: (x[0], x[0] != x[2], x[1], x[2], x[3]))
        got = [index.unrank(i) for i in range(index.total)]
        assert got == want
        assert [index.rank(*p) for p in got] == list(range(index.total))
    with pytest.raises(ValueError):
        index.unrank(index.total)


def test_long_falling_stretches():
    """Places of within pairs where float square roots alone would be off."""
    index = pairs.PairIndex({0: [(0, 900_000_000)], 1: [(5, 9)]}, 384)
    n = 900_000_000 - 384
    assert index.total == n * (n + 1) // 2 + 4 * 900_000_000
    rng = np.random.default_rng(4)
    ids = np.concatenate([rng.integers(0, index.total, 5000), np.arange(400), index.total - 1 - np.arange(400), n * (n + 1) // 2 - 1 - np.arange(400)])
    s1, a1, s2, a2 = index.pairs(ids)
    assert (index.ranks(s1, a1, s2, a2) == ids).all() and ((s1 < s2) | (a2 - a1 >= 384)).all()
    with pytest.raises(ValueError):
        index.ranks([0], [7], [0], [300])
    with pytest.raises(ValueError):
        index.ranks([0], [7], [1], [12])


def test_pairs_by_session_are_those_of_the_index(spark):
    rng = random.Random(12)
    rows = [(s, k, 40 * k + rng.randint(0, 9), 40 * k + rng.randint(10, 35)) for s in (2, 3, 7, 9) for k in range(5)] + [(8, 0, 4, 5)]
    ranges = spark.createDataFrame(rows, "session bigint, run bigint, start bigint, stop bigint")
    index = pairs.PairIndex.of(ranges, 24)
    ids = spark.range(0, index.total, 7).withColumnRenamed("id", "pair_id")
    want = sorted(map(tuple, pairs.unrank_pairs(ids, index).collect()))
    assert len(want) == -(-index.total // 7) and sorted(map(tuple, pairs.unrank_by_session(ids, ranges, 24).collect())) == want
    ranked = pairs.rank_pairs(pairs.unrank_pairs(ids, index), index)
    assert ranked.filter("rank <> pair_id").count() == 0


@pytest.mark.parametrize("total", [1, 2, 3, 4, 5, 15, 16, 17, 31, 64, 65, 257, 1000])
@pytest.mark.parametrize("seed", [0, 1, 79])
def test_a_seeded_order_is_a_permutation(total, seed):
    order = SeededOrder(total, "c", "train", seed)
    every = order.numbers(np.arange(total))
    assert sorted(every.tolist()) == list(range(total))
    assert [int(order.numbers([i])[0]) for i in range(total)] == every.tolist()  # whatever the array holds besides
    again, counter = SeededOrder.restore(order.state(total // 2), corpus="c", split="train", total=total)
    assert counter == total // 2 and (again.numbers(np.arange(counter, total)) == every[counter:]).all()
    with pytest.raises(IndexError):
        order.numbers([total])
    for wrong in ({"corpus": "other"}, {"split": "test"}, {"total": total + 1}, {"version": "other"}):
        with pytest.raises(ValueError):
            SeededOrder.restore(order.state(0), **wrong)
    with pytest.raises(ValueError):
        SeededOrder(total, "c", "train", -1)


def test_a_seeded_order_stays_as_it_was():
    order = SeededOrder(3_009_889_063, "events", "all", 17)
    found = order.numbers(np.arange(100_000))
    assert len(np.unique(found)) == 100_000 and 0 <= found.min() and found.max() < order.total
    assert abs(found.mean() / order.total - 0.5) < 0.01
    assert found[:3].tolist() == [146703712, 651012135, 894327722]


def test_pair_stream(spark):
    order = SeededOrder(1000, "c", "train", 5)
    stream = PairStream(spark, order, 300, 32)
    first = [r["pair_id"] for r in stream.next_queue().orderBy("place").collect()]
    assert first == [r["pair_id"] for r in stream.next_queue().orderBy("place").collect()]  # not delivered yet
    stream.delivered()
    other = PairStream.restore(spark, stream.state(), 300, 32, corpus="c", total=1000)
    rest, sizes = [], []
    while True:
        try:
            rest += [r["pair_id"] for r in other.next_queue().orderBy("place").collect()]
        except StopIteration:
            break
        sizes.append(other._stop - other.counter)
        other.delivered()
    assert sorted(first + rest) == list(range(1000)) and sizes == [300, 300, 100]  # the last one has what is left
    with pytest.raises(ValueError):
        PairStream.restore(spark, stream.state(), 300, 16)


def test_runs_and_anchors(spark):
    rows = [(0, i, 100 + i / 100, False, int(i >= 500)) for i in range(1000)]
    ticks = spark.createDataFrame(rows, "session bigint, row_id bigint, mid double, brk boolean, run bigint")
    got = {r["anchor"] for r in runs.anchors(runs.anchor_ranges(runs.runs(ticks))).collect()}
    assert {371, 755} <= got and not {254, 372, 499, 754} & got
    batches = runs.anchor_batches(spark.createDataFrame([(0, 0, 2, 7), (0, 1, 10, 12)], "session bigint, run bigint, start bigint, stop bigint"), 3)
    assert sorted(r["anchors"] for r in batches.collect()) == [[2, 3, 4], [5, 6], [10, 11]]
    assert {r["anchor"] for r in runs.valid_anchors(ticks, 10, 5, 100, 130).collect()} == set(range(109, 125))


def test_blocks_change_nothing(spark, monkeypatch):
    ticks = views.ticks(spark, "/root/testdata/sf0.001")
    ns = views.nanoseconds()

    def all_of():
        return [runs.futures(ticks, 8, 16), runs.step_returns(ticks), runs.future_spans(ticks, 8, ns), runs.zero_paths(ticks, 8)]

    want = [sorted(map(str, df.collect())) for df in all_of()]
    for block in (1, 5, 16):
        monkeypatch.setattr(runs, "BLOCK", block)
        assert [sorted(map(str, df.collect())) for df in all_of()] == want


def test_ordered_parts(spark):
    parts = [spark.range(5, 12).repartition(3), spark.range(100, 104)]
    got = store.ordered_parts(parts, "id", 3).orderBy("source_row").collect()
    assert [(r["source_row"], r["id"], r["part"]) for r in got] == [(i, x, int(x >= 100)) for i, x in enumerate([*range(5, 12), *range(100, 104)])]


LOG = [
    (0, 1, "R", "BUY", 0.0, 0.0, 0, False, True), (1, 1, "A", "BUY", 99.0, 5.0, 1, False, True), (2, 1, "A", "SELL", 101.0, 7.0, 2, True, True),
    (3, 2, "A", "BUY", 99.0, 2.0, 3, True, False), (4, 3, "M", "BUY", 99.5, 4.0, 1, True, False), (5, 4, "T", "BUY", 99.5, 1.0, 1, True, False),
    (6, 5, "C", "SELL", 101.0, 0.0, 2, True, False), (7, 6, "C", "SELL", 101.0, 0.0, 77, True, False), (8, 7, "A", "SELL", 99.5, 3.0, 4, True, False),
    (9, None, "N", "BUY", 0.0, 0.0, 0, True, False), (10, 9, "A", "SELL", 98.0, 1.0, 5, True, False),
]
LOG_SCHEMA = "session bigint, source_row bigint, ts bigint, action string, side string, price double, size double, order_id bigint, is_last boolean, is_snapshot boolean"


def log(spark, rows):
    return spark.createDataFrame([(0, *r) for r in rows], LOG_SCHEMA)


def test_replay(spark):
    got = book.replay(log(spark, LOG), need_clear=True).orderBy("source_row").collect()
    assert [r["source_row"] for r in got] == [3, 4, 5, 8]  # the snapshot, one-sided, clockless and crossed states are left out
    assert [r["initial"] for r in got] == [True, False, False, True]
    assert got[0]["bids"][0]["qty"] == 7 and got[0]["bids"][0]["orders"] == 2 and got[1]["bids"][0]["price"] == 99.5
    assert got[3]["mid"] == 99.5  # a locked book is legal
    assert got[3]["segment"] > got[2]["segment"]
    assert [r["source_row"] for r in book.replay(log(spark, LOG), mode="extract").orderBy("source_row").collect()][0] == 2
    assert [r["source_row"] for r in book.replay(log(spark, LOG), stop_ns=4).orderBy("source_row").collect()] == [3, 4]


@pytest.mark.parametrize(
    "rows, what, kwargs",
    [
        (LOG[3:], "before the initial snapshot", {"need_clear": True}),
        (LOG[1:], "begin with a clear", {"need_clear": True}),
        ([*LOG[:4], (4, 1, "N", "BUY", 0.0, 0.0, 0, True, False)], "runs back", {}),
        (LOG[:2], "inside an event", {"strict_end": True}),
    ],
)
def test_replay_refuses(spark, rows, what, kwargs):
    with pytest.raises(Exception, match=what):
        book.replay(log(spark, rows), **kwargs).collect()


def test_replay_and_declarative_book_agree(spark):
    events = views.mbo(spark, "/root/testdata/sf0.001")
    at = 700
    levels = book.price_levels(book.book_at(events, at)).collect()
    sides = {}
    line = {s: book.Timeline() for s in range(8)}
    for r in events.filter(F.col("source_row") <= at).orderBy("source_row").collect():
        line[r["session"]].step((r["source_row"], r["ts"], r["action"], r["side"], r["price"], r["size"], r["order_id"], r["is_last"], False))
    for s, t in line.items():
        t.check()
        sides |= {(s, side, p): tuple(v) for side, x in t.sides.items() for p, v in x.levels.items()}
    assert sides == {(r["session"], r["side"], r["price"]): (r["qty"], r["orders"]) for r in levels}


def test_streaming_replay_equals_batch(spark, tmp_path):
    events = views.mbo(spark, "/root/testdata/sf0.001").withColumn("is_snapshot", F.lit(False))
    for k, (lo, hi) in enumerate([(0, 300), (300, 650), (650, 1000)]):
        events.filter((F.col("source_row") >= lo) & (F.col("source_row") < hi)).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = replay_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    cols = ["session", "source_row", "segment", "initial", "mid", "n_bids", "n_asks"]
    got, want = spark.read.parquet(str(tmp_path / "out")).select(cols), book.replay(events).select(cols)
    assert got.count() == want.count() and audit.store_diff(got, want).count() == 0


def test_state_futures(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, [10.0, 20.0]), (0, [3.0, 4.0])], "code int, y array<double>")
    got = {(r["code"], r["step"]): (r["n"], r["mean"], r["var"]) for r in states.state_futures(rows).collect()}
    assert got == {(0, 0): (2, 2, 1), (0, 1): (2, 3, 1), (1, 0): (1, 10, 0), (1, 1): (1, 20, 0)}
    held = spark.createDataFrame([(0, 1.0, [2.0, 3.0]), (7, 5.0, [9.0, 9.0])], "code int, distance double, y array<double>")
    found = states.forecast_errors(held, states.state_futures(rows)).first()
    assert (found["rows"], found["supported"], found["coverage"], found["state_mse"], found["mean_support"]) == (2, 1, 0.5, 0, 2)


def test_medians(spark):
    for n in (1, 2, 13, 1024):
        values = [random.Random(n + i).choice([1e-12, 0.002, 0.5, 1, 13.1]) for i in range(n)] + [0.0, -1.0]
        positive = sorted(v for v in values if v > 0)
        want = (positive[(n - 1) // 2] + positive[n // 2]) / 2
        assert fit.positive_median(spark.createDataFrame([(float(v),) for v in values], "v double"), "v").first()["median"] == pytest.approx(want, rel=1e-12)


def test_sampling_ignores_partitioning(spark):
    a = fit.bottom_k(spark.range(10_000), "id", 7, 50)
    b = fit.bottom_k(spark.range(10_000).repartition(13), "id", 7, 50)
    assert audit.store_diff(a, b).count() == 0


def test_store_round_trip(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") % 2).alias("session"), F.call_function("div", F.col("id"), F.lit(2)).alias("row_id"), (F.col("id") * 0.5).alias("mid"))
    path = str(tmp_path / "store")
    manifest = store.write_store(rows, path, 100)
    assert [s["rows"] for s in manifest["sessions"]] == [500, 500]
    assert store.open_store(spark, path, ["mid"]).columns == ["mid"]
    with pytest.raises(Exception):
        store.write_store(rows, path)
    ids = spark.createDataFrame([(0, 1, 5), (1, 0, 7), (2, 1, 5)], "place int, session bigint, row_id bigint")
    got = store.read_rows(store.open_store(spark, path), ids, ["mid"]).orderBy("place").collect()
    assert [r["mid"] for r in got] == [5.5, 7.0, 5.5]
    (tmp_path / "store" / "_manifest.json").write_text('{"version": 2, "fingerprint": "x"}')
    for crc in (tmp_path / "store").glob("._manifest*"):
        crc.unlink()
    with pytest.raises(ValueError, match="fingerprint"):
        store.open_store(spark, path)


def test_plan_requests():
    got = store.plan_requests("2021-02-05T15:00:00Z", "2021-02-09", ["2021-02-06T03:00:00Z"])
    assert [a[:13] for a, _ in got] == ["2021-02-05T15", "2021-02-06T03", "2021-02-08T00"]
    with pytest.raises(ValueError):
        store.plan_requests("2021-02-05", "2021-02-05")


def test_session_calendar(spark):
    assert [str(r["day"]) for r in store.weekday_sessions(spark, "2021-01-30", 2).collect()] == ["2021-02-01", "2021-02-02"]
    for bad in (0, -1, 1.5, True, "20"):
        with pytest.raises(ValueError):
            store.weekday_sessions(spark, "2021-01-30", bad)


def test_audit_finds_broken_rows(spark):
    good = book.observations(book.replay(log(spark, LOG)), 0.5)
    assert audit.refuse_broken(audit.audit(good)) is None
    bad = good.withColumn("x", F.transform("x", lambda v, i: F.when(i == 80, v + 1).otherwise(v)))
    with pytest.raises(ValueError, match="spread"):
        audit.refuse_broken(audit.audit(bad))


def test_splits(spark):
    split = audit.split_sessions(spark.range(8).withColumnRenamed("id", "session"), "session")
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 5, "validation": 1, "test": 2}
    with pytest.raises(ValueError):
        audit.split_sessions(spark.range(3).withColumnRenamed("id", "session"), "session")
    days = spark.sql("select explode(array(date'2024-12-31', date'2025-01-02', date'2025-03-03', date'2025-04-01')) as day")
    assert [r["split"] for r in audit.split_by_month(days, "day", "2025-01", "2025-02", "2025-03", "2025-04").orderBy("day").collect()] == ["train", "validation", "test"]


def test_trainer_learns_a_projection(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 6))
    pair = rng.integers(0, 200, (400, 2))
    pair = pair[pair[:, 0] != pair[:, 1]]
    target = np.abs(x[pair[:, 0], 0] - x[pair[:, 1], 0])
    w, _, losses, state, curve = states.train_projection(spark, x, pair, target, 1, steps=400, rate=0.02, probe=(x, pair[:50], target[:50]), every=100)
    assert [t for t, _ in curve] == [100, 200, 300, 400] and curve[-1][1] < curve[0][1]
    half = states.train_projection(spark, x, pair, target, 1, steps=150, rate=0.02)[3]
    rest = states.train_projection(spark, x, pair, target, 1, steps=250, rate=0.02, state=half)
    assert np.allclose(rest[0], w) and rest[3]["step"] == state["step"] == 400
    assert losses[-1] < 0.2 * losses[0]


def test_generated_sessions(spark):
    a = views.generate_sessions(spark, 2, 50, 3)
    b = views.generate_sessions(spark, 2, 50, 3).repartition(7)
    assert a.count() == 100 and audit.store_diff(a, b).count() == 0
