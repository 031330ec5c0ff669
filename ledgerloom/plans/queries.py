"""Registered queries of the tick and order-book engine, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators import audit, book, book_blocks, fit, pairs, runs, states
from ledgerloom.operators.seeded import SeededOrder, stretch
from ledgerloom.session import shared_folder, written
from ledgerloom.sources import store, views
from ledgerloom.streaming.replay import PairStream

#: Shape of an episode in these queries; a pair's episodes lie HISTORY + HORIZON rows apart.
HISTORY, HORIZON = 16, 8
GAP = HISTORY + HORIZON
#: Anchors that the sampling queries take from each session, and their seed.
SAMPLE, SEED = 24, 17
#: Pairs of the seeded order that distances and their scale are taken from, and those of a queue.
TARGET_PAIRS, QUEUE_PAIRS = 100_000, 4096


def _ranges(spark: SparkSession, sf: str) -> DataFrame:
    return runs.anchor_ranges(runs.runs(views.ticks(spark, sf)), HISTORY, HORIZON)


def _replayed(spark: SparkSession, sf: str) -> DataFrame:
    return book_blocks.replay(views.mbo(spark, sf))


def _observed(spark: SparkSession, sf: str) -> DataFrame:
    return book.observations(_replayed(spark, sf))


def _split(sessions: str):
    return F.when(F.col(sessions) < 5, "train").when(F.col(sessions) < 6, "validation").otherwise("test")


# --- views and runs ---


def q_ticks(spark, sf):
    return views.ticks(spark, sf).select("session", "row_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "mid", "brk", "run")


def q_mbo(spark, sf):
    return views.mbo(spark, sf)


def q_runs(spark, sf):
    return runs.runs(views.ticks(spark, sf))


def anchor_ranges(spark, sf):
    return _ranges(spark, sf)


def anchor_batches(spark, sf):
    found = runs.anchor_batches(_ranges(spark, sf), 32)
    return found.select("session", "run", F.col("anchors")[0].alias("first"), F.size("anchors").alias("n"))


def future_paths(spark, sf):
    found = runs.futures(views.ticks(spark, sf), HORIZON, HISTORY)
    return found.select("session", "run", "anchor", F.round(F.col("y")[0], 6).alias("y_first"), F.round(F.col("y")[HORIZON - 1], 6).alias("y_last"))


def pair_universe_counts(spark, sf):
    return pairs.pair_counts(_ranges(spark, sf), GAP)


def range_pair_counts(spark, sf):
    """Gaps other than an episode's length, where ranges of one session come near each other."""
    found = None
    for gap in (1, 5, 60):
        one = pairs.within_pairs(_ranges(spark, sf), gap).select("session", F.lit(gap).alias("gap"), "within_pairs")
        found = one if found is None else found.unionByName(one)
    return found


def step_returns(spark, sf):
    return runs.step_returns(views.ticks(spark, sf)).select("session", "row_id", F.round("step_return", 6).alias("step_return"))


def future_span(spark, sf):
    rows = views.ticks(spark, sf)
    return runs.future_spans(rows, HORIZON, views.nanoseconds()).groupBy("session").agg(
        F.count("*").alias("n"), F.round(F.min("seconds"), 6).alias("least"), F.round(F.median("seconds"), 6).alias("middle"), F.round(F.max("seconds"), 6).alias("most")
    )


def zero_paths(spark, sf):
    return runs.zero_paths(views.ticks(spark, sf), HORIZON).groupBy("session").agg(F.count("*").alias("n"), F.sum(F.col("unchanged").cast("int")).alias("unchanged"))


def tod_features(spark, sf):
    ns = views.nanoseconds()
    seconds = S.seconds_since_midnight(ns, "receive")
    sin, cos = S.time_of_day_pair(seconds)
    simulated = S.seconds_since_midnight(ns, "simulation")
    return views.table(spark, sf, "events").select("event_id", F.round(seconds, 6).alias("seconds"), F.round(simulated, 6).alias("simulated"), F.round(sin, 6).alias("tod_sin"), F.round(cos, 6).alias("tod_cos"))


def clock_regressions(spark, sf):
    rows = views.table(spark, sf, "events").select((F.col("user_id") % 8).alias("session"), "event_id", views.nanoseconds().alias("ns"), F.struct("value", "event_id").alias("by_value"))
    return runs.clock_regressions(rows, "session", "by_value", "ns", F.floor("by_value.value")).groupBy("session").agg(F.count("*").alias("n"))


def interval_gaps(spark, sf):
    rows = views.ticks(spark, sf).filter(~F.col("brk")).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    spans = rows.groupBy("session", "run").agg(F.min("us").alias("start"), (F.max("us") + 1).alias("stop"))
    return runs.interval_gaps(spans, "start", "stop", ["session"])


def contiguous_ranges(spark, sf):
    """Runs of a session follow each other with the breaks between as gaps."""
    spans = runs.runs(views.ticks(spark, sf)).select("session", "run", F.col("first_row").alias("start"), (F.col("last_row") + 1).alias("stop"))
    return store.contiguous(spans).groupBy("session", "problem").agg(F.count("*").alias("n"))


def run_labels(spark, sf):
    """Runs of equal event types in each session."""
    rows = views.table(spark, sf, "events").select((F.col("user_id") % 8).alias("session"), "event_id", "event_type")
    found = runs.run_ids(rows, "session", "event_id", "event_type", F.call_function("div", F.col("event_id"), F.lit(4096)))
    return found.groupBy("session").agg(F.max("run").alias("last_run"), F.count("*").alias("rows"))


# --- scans ---


def read_rows(spark, sf):
    """Every row twice, by its event id."""
    rows = views.ticks(spark, sf)
    asked = rows.select("session", "row_id", F.col("event_id").alias("place"))
    twice = asked.unionByName(asked.withColumn("place", -1 - F.col("place")))
    return store.read_rows(rows, twice, ["mid"]).select("place", "session", "row_id", "mid")


def read_ranges(spark, sf):
    return store.read_ranges(views.ticks(spark, sf), runs.history_ranges(_ranges(spark, sf), HISTORY), ["mid"]).groupBy("session").agg(F.count("*").alias("n"), F.round(F.sum("mid"), 3).alias("total"))


def stop_scan(spark, sf):
    """Records before the first completed event half an hour after the log's first."""
    events = views.mbo(spark, sf)
    first = events.agg(F.min("ts")).first()[0]
    return store.until_stop(events, first + 1_800_000_000_000).groupBy("session").agg(F.count("*").alias("n"), F.max("source_row").alias("last"))


_FILES = [
    "x/glbx-20250102.mbo.ES.10.dbn.zst", "x/glbx-20250102.mbo.ES.2.dbn.zst", "x/glbx-20250102.definition.ES.dbn.zst",
    "x/glbx-20250103.mbo.ES.dbn.zst", "x/glbx-20250104.definition.ES.dbn.zst", "x/glbx-20250105.mbo.ES.dbn.zst",
    "x/glbx-20250105.definition.ES.1.dbn.zst", "x/glbx-20250105.definition.ES.2.dbn.zst", "x/notes.txt",
    "x/glbx-20250106.mbo.ES.dbn.zst", "x/glbx-20250106.definition.NQ.dbn.zst",
]


def job_discovery(spark, sf):
    found = store.discover_jobs(spark.createDataFrame([(f,) for f in _FILES], "path string"))
    return found.select("day", F.array_join("parts", "|").alias("parts"), "definition", "problem")


def session_seeds(spark, sf):
    days = views.table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("date")).distinct()
    return days.select("date", S.session_seed(F.lit(17), F.col("date")).alias("seed"))


# --- books ---


def action_counts(spark, sf):
    return audit.action_counts(views.mbo(spark, sf))


def file_summary(spark, sf):
    return audit.file_summary(views.mbo(spark, sf), ["session"])


def book_asof(spark, sf):
    return book.price_levels(book.book_at(views.mbo(spark, sf)))


def top_levels(spark, sf):
    return book.top_levels(book.price_levels(book.book_at(views.mbo(spark, sf))), 10).select("session", "side", "level", "price", "qty", "orders")


def book_summary(spark, sf):
    return book.book_summary(book.price_levels(book.book_at(views.mbo(spark, sf)))).select("session", F.col("best_bid").cast("double").alias("best_bid"), F.col("best_ask").cast("double").alias("best_ask"), F.col("spread").cast("double").alias("spread"), "bid_qty", "ask_qty", "n_levels")


def replay_events(spark, sf):
    return _replayed(spark, sf).select("session", "source_row", "segment", "initial", "mid", "n_bids", "n_asks")


def feature_rows(spark, sf):
    total = F.aggregate(F.slice("x", 1, 81), F.lit(0.0), lambda s, v: s + v)
    names = {"bid_1_price_ticks": 0, "bid_1_quantity": 1, "bid_1_orders": 2, "ask_1_price_ticks": 40, "ask_1_quantity": 41, "bid_10_present": 39, "spread_ticks": 80, "time_delta_seconds": 81, "mid_return": 82, "initial": 83}
    return _observed(spark, sf).select("session", "source_row", F.size("x").alias("width"), *(F.round(F.col("x")[i], 6).alias(n) for n, i in names.items()), F.round(total, 4).alias("total"))


def audit_report(spark, sf):
    return audit.audit(_observed(spark, sf))


# --- fitting ---


def _gaps(spark, sf):
    return runs.step_gaps(views.ticks(spark, sf), views.nanoseconds())


def gap_median(spark, sf):
    return fit.positive_median(_gaps(spark, sf), "gap").select(F.round("median", 6).alias("median"), "n")


def reservoir_median(spark, sf):
    return fit.reservoir_median(_gaps(spark, sf), "gap", "event_id", SEED).select(F.round("median", 6).alias("median"), "n")


def coverage_rows(spark, sf):
    disjoint = runs.coverage(runs.history_ranges(_ranges(spark, sf), HISTORY))
    return disjoint.groupBy("session").agg(F.sum(F.col("stop") - F.col("start")).alias("rows"), F.count("*").alias("ranges"))


def feature_moments(spark, sf):
    return fit.feature_moments(_observed(spark, sf), 1.0).select("feature", "n", F.round("mean", 5).alias("mean"), F.round("scale", 5).alias("scale"), "constant")


def resumed_moments(spark, sf):
    """feature_moments() by a fit over half the sessions that another call goes on with."""
    rows, folder = written(_observed(spark, sf).select("session", "x"), "observed"), f"{shared_folder(spark)}/ledgerloom/fit-{uuid.uuid4().hex}"
    fit.resumable_moments(rows.filter("session < 4"), 1.0, "session", folder, {"table": "events"})
    found = fit.resumable_moments(rows, 1.0, "session", folder, {"table": "events"}, at_once=2)
    return found.select("feature", "n", F.round("mean", 5).alias("mean"), F.round("scale", 5).alias("scale"), "constant")


def standardised(spark, sf):
    """The sum of each row's standardised features, and some of them, by moments of the training sessions."""
    rows = written(_observed(spark, sf).select("session", "source_row", "x"), "observed")
    moments = fit.feature_moments(rows.filter(_split("session") == "train"), 1.0)
    names = {"z_bid_1_quantity": 1, "z_ask_1_price_ticks": 40, "z_spread_ticks": 80, "z_mid_return": 82}
    total = F.aggregate("z", F.lit(0.0), lambda s, v: s + v)
    return fit.standardise(rows, moments, 1.0).select("session", "source_row", F.round(total, 3).alias("z_total"), *(F.round(F.col("z")[i], 5).alias(n) for n, i in names.items()))


def _sampled(spark, sf):
    return fit.bottom_k(runs.anchors(_ranges(spark, sf)), "anchor", SEED, SAMPLE, ["session"])


def sampled_anchors(spark, sf):
    return _sampled(spark, sf).select("session", "anchor", "priority")


def histories(spark, sf):
    """Histories of every anchor."""
    found = runs.histories(views.ticks(spark, sf), runs.anchors(_ranges(spark, sf)), "mid", HISTORY)
    return found.select("session", "anchor", F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v), 4).alias("total"), F.round(F.col("x")[0], 6).alias("first"), F.round(F.col("x")[HISTORY - 1], 6).alias("last"))


def eligible_pairs(spark, sf):
    """All eligible pairs of each session's sampled anchors."""
    return pairs.eligible_pairs(_sampled(spark, sf), GAP)


def _order(index: pairs.PairIndex) -> SeededOrder:
    return SeededOrder(index.total, "events", "all", SEED)


def universe_pairs(spark, sf):
    """The first TARGET_PAIRS of the seeded order of all eligible pairs, within and across sessions."""
    index = pairs.PairIndex.of(_ranges(spark, sf), GAP)
    queue = stretch(spark, _order(index), 0, min(TARGET_PAIRS, index.total))
    return pairs.unrank_pairs(queue, index).join(queue, "pair_id")


def _distances(spark, sf):
    episodes = runs.futures(views.ticks(spark, sf), HORIZON, HISTORY).select("session", "anchor", "y")
    both = pairs.materialise(universe_pairs(spark, sf), episodes)
    return both.select("pair_id", "place", "s1", "a1", "s2", "a2", S.future_path_rms(F.col("left"), F.col("right")).alias("d_raw"))


def pair_distances(spark, sf):
    return _distances(spark, sf).withColumn("d_raw", F.round("d_raw", 6))


def target_scale(spark, sf):
    """The scale over the whole universe; its halves are those of the seeded order."""
    found = fit.target_scale(_distances(spark, sf), "d_raw", "place")
    return found.select(*(F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in found.dtypes))


def endpoint_counts(spark, sf):
    return audit.endpoint_counts(universe_pairs(spark, sf))


def distinct_endpoints(spark, sf):
    return pairs.endpoints(universe_pairs(spark, sf))


def stream_coverage(spark, sf):
    return audit.stream_coverage(_distances(spark, sf)).withColumn("distance_sum", F.round("distance_sum", 3))


def valid_anchors(spark, sf):
    """Anchors whose episodes lie in the first 500 rows of their session, and in the others."""
    rows = views.ticks(spark, sf)
    first, rest = runs.valid_anchors(rows, HISTORY, HORIZON, 0, 500), runs.valid_anchors(rows, HISTORY, HORIZON, 500)
    return first.withColumn("part", F.lit("first")).unionByName(rest.withColumn("part", F.lit("rest")))


def pair_unrank(spark, sf):
    """The first queue's pair ids to their episodes and back."""
    index = pairs.PairIndex.of(_ranges(spark, sf), GAP)
    found = pairs.unrank_pairs(stretch(spark, _order(index), 0, min(QUEUE_PAIRS, index.total)), index)
    return pairs.rank_pairs(found, index).withColumnRenamed("rank", "back")


def pair_batches(spark, sf):
    """The first queue of the seeded order, with both histories, both futures and their distance."""
    index = pairs.PairIndex.of(_ranges(spark, sf), GAP)
    stream = PairStream(spark, _order(index), min(QUEUE_PAIRS, index.total), 32)
    found = stream.episodes(stream.next_queue(), index, views.ticks(spark, sf), "mid", HISTORY, HORIZON)
    return found.select(
        "pair_id", "place", "batch", "s1", "a1", "s2", "a2",
        *(F.round(F.aggregate(x, F.lit(0.0), lambda s, v: s + v), 4).alias(f"{x}_total") for x in ("x1", "x2")),
        *(F.round(F.col(y)[HORIZON - 1], 6).alias(f"{y}_last") for y in ("y1", "y2")),
        F.round("d_raw", 6).alias("d_raw"),
    )


# --- states ---


def _codebook(spark, sf):
    return states.codebook_of_groups(views.table(spark, sf, "embeddings"), "label", "embedding")


def _coded(spark, sf):
    return states.encode(views.table(spark, sf, "embeddings").select("vec_id", "label", "embedding"), _codebook(spark, sf), "embedding")


def latent_l2(spark, sf):
    """Each vector's distance from its own group's mean, by column expressions."""
    rows = states.decode(views.table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("code"), "embedding"), _codebook(spark, sf))
    return rows.select("vec_id", F.round(S.latent_l2(F.col("embedding"), F.col("prototype")), 6).alias("distance"))


def vq_codes(spark, sf):
    return _coded(spark, sf).select("vec_id", "code", F.round("distance", 6).alias("distance"))


def vq_stats(spark, sf):
    found = states.code_stats(_coded(spark, sf))
    return found.select(*(F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in found.dtypes))


def _paths_with_codes(spark, sf):
    """Anchors' futures with a state: the code of the vector whose id is the anchor's, cut to the number of vectors."""
    coded = _coded(spark, sf).select("vec_id", "code", "distance")
    n = coded.count()
    paths = runs.futures(views.ticks(spark, sf), HORIZON, HISTORY).withColumn("vec_id", F.col("anchor") % n)
    return paths.join(coded, "vec_id")


def state_futures(spark, sf):
    train = _paths_with_codes(spark, sf).filter(_split("session") == "train")
    return states.state_futures(train).select("code", "step", "n", F.round("mean", 6).alias("mean"), F.round("var", 5).alias("var"))


def state_samples(spark, sf):
    train = _paths_with_codes(spark, sf).filter(_split("session") == "train").withColumn("key", F.col("session") * 1_000_000 + F.col("anchor"))
    return states.state_samples(train, "key", SEED, 16).select("code", "key", "priority")


def forecast_eval(spark, sf):
    rows = _paths_with_codes(spark, sf)
    learned = states.state_futures(rows.filter(_split("session") == "train"))
    found = states.forecast_errors(rows.filter(_split("session") == "test"), learned)
    return found.select(*(F.round(c, 5).alias(c) if k == "double" else F.col(c) for c, k in found.dtypes))


def kmeans_codebook(spark, sf):
    """Ten prototypes by mini-batches, frozen."""
    rows = views.table(spark, sf, "embeddings").select("vec_id", "embedding")
    return states.MiniBatchCodebook(10, 256, seed=SEED).fit(rows, "embedding", "vec_id").freeze(spark)


def lloyd_step(spark, sf):
    found = states.lloyd_step(views.table(spark, sf, "embeddings"), _codebook(spark, sf), "embedding")
    return found.select("code", "n", F.posexplode("prototype").alias("at", "v")).withColumn("v", F.round("v", 6))


def library_neighbours(spark, sf):
    """Of every twentieth vector the nearest one among the others."""
    rows = views.table(spark, sf, "embeddings")
    found = states.nearest_in_library(rows.filter("vec_id % 20 = 0"), rows.filter("vec_id % 20 <> 0"), "vec_id", "embedding")
    return found.withColumn("distance", F.round("distance", 6))


def distance_errors(spark, sf):
    """The nearest prototype's distance as a prediction of that to the own group's."""
    own = states.decode(views.table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("code"), "embedding"), _codebook(spark, sf))
    target = own.select("vec_id", S.latent_l2(F.col("embedding"), F.col("prototype")).alias("target"))
    found = states.distance_errors(_coded(spark, sf).join(target, "vec_id"), "distance", "target")
    return found.select(*(F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in found.dtypes))


# --- governance ---


def split_summary(spark, sf):
    counts = pairs.pair_counts(_ranges(spark, sf), GAP)
    split = audit.split_sessions(counts, "session")
    return counts.join(split, "session").groupBy("split").agg(F.count("*").alias("sessions"), F.sum("anchors").alias("anchors"), F.sum("within_pairs").alias("within_pairs"))


def store_diff(spark, sf):
    keys = views.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return audit.store_diff(keys, keys.distinct()).groupBy("side").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


def split_overlap(spark, sf):
    """Days that appear in a session and in the next one."""
    rows = views.table(spark, sf, "events").select((F.col("user_id") % 8).alias("session"), F.to_date("ts").cast("string").alias("day"))
    return audit.split_overlap(rows, rows.withColumn("session", F.col("session") - 1))


def reconcile(spark, sf):
    """Days and users of purchases, as listed, against those of views, as found; listed days may come more than once."""
    rows = views.table(spark, sf, "events").select(F.to_date("ts").cast("string").alias("day"), F.col("user_id"), "event_type")
    listed, found = (rows.filter(F.col("event_type") == kind).select("day", "user_id") for kind in ("purchase", "view"))
    return audit.reconcile(listed, found, ["day", "user_id"]).groupBy("problem").agg(F.count("*").alias("n"))


def build_report(spark, sf):
    found = audit.build_report(views.table(spark, sf, "events"), F.to_date("ts"), F.lit(1))
    return found.select("month", "weekday", "days", "total", "least", "most", *(F.round(c, 4).alias(c) for c in ("mean", "median", "share", "ratio")))


def byte_totals(spark, sf):
    rows = views.table(spark, sf, "events").select("event_type", F.octet_length("props").alias("bytes"), F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    return audit.totals(rows, "event_type", "bytes", "cents")


def audit_summary(spark, sf):
    found = audit.audit_summary(_observed(spark, sf), HORIZON)
    return found.select(*(F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in found.dtypes))


def duration_quantiles(spark, sf):
    return audit.duration_quantiles(_observed(spark, sf), HORIZON).withColumn("value", F.round("value", 6))


def replay_metrics(spark, sf):
    return book.replay_metrics(views.mbo(spark, sf), _replayed(spark, sf)).drop("first_ts", "last_ts")


def stored_ticks(spark, sf):
    """The ticks' store, opened with every digest verified, by session and segment."""
    path = f"{shared_folder(spark)}/ledgerloom/store-{uuid.uuid4().hex}"
    store.write_store(views.ticks(spark, sf).select("session", "row_id", F.col("run").alias("segment"), "mid"), path, 4096)
    return store.open_store(spark, path, ["session", "segment", "mid"], verify=True).groupBy("session", "segment").agg(F.count("*").alias("n"), F.round(F.sum("mid"), 4).alias("total"))


def archived_returns(spark, sf):
    path = f"{shared_folder(spark)}/ledgerloom/archive-{uuid.uuid4().hex}"
    store.write_archive(views.ticks(spark, sf).filter("mid > 0").drop("run", "brk").transform(_dense).select("session", "row_id", F.lit(0).alias("segment"), "mid"), path)
    return store.read_archive(spark, path, ["session", "row_id", "y"]).withColumn("y", F.round("y", 6))


def _dense(rows):
    """Row ids without gaps."""
    return views.numbered(rows.withColumnRenamed("row_id", "place"), "session", ["place"], F.call_function("div", F.col("place"), F.lit(4096)))


def merged_records(spark, sf):
    """Records against deltas that lack one in ten, repeat one in twenty and have some of fills."""
    raw = views.mbo(spark, sf).withColumnRenamed("source_row", "sequence")
    deltas = raw.filter(F.col("action").isin("A", "C", "M") & (F.col("sequence") % 10 != 3)).select("session", "sequence", "price", "size")
    more = deltas.filter("sequence % 20 = 5").unionByName(raw.filter("action = 'N' and sequence % 4 = 0").select("session", "sequence", "price", "size"))
    found = store.merge_records(raw.select("session", "sequence", "action", "order_id"), deltas.unionByName(more))
    return found.groupBy("session", "problem").agg(F.count("*").alias("n"), F.round(F.sum("delta.size"), 3).alias("size"))


def corpus_problems(spark, sf):
    """Sessions as files: a digest and a seed each, which two share if their days' first values are alike."""
    rows = views.table(spark, sf, "events").groupBy(F.to_date("ts").alias("session")).agg(F.min("user_id").alias("seed"), F.sha2(F.min(F.col("event_id")).cast("string").cast("binary"), 256).alias("sha256"))
    return audit.corpus_problems(rows.withColumn("config", F.month("session")))


def preflight(spark, sf):
    rows = [(s, *r) for s, log in _LOGS.items() for r in log]
    return store.preflight(spark.createDataFrame(rows, "session int, source_row int, action string, is_snapshot boolean, is_last boolean"))


_LOGS = {
    1: [(0, "R", True, False), (1, "A", True, True), (2, "A", False, True)],
    2: [(0, "R", False, True), (1, "A", True, True), (2, "M", False, True)],
    3: [(0, "A", False, True), (1, "R", True, True)],
    4: [(0, "R", False, True), (1, "A", False, True), (2, "A", True, True)],
}


QUERIES = {
    f.__name__: f
    for f in (
        q_ticks, q_mbo, q_runs, anchor_ranges, anchor_batches, future_paths, pair_universe_counts, range_pair_counts, step_returns, future_span, zero_paths, tod_features,
        clock_regressions, interval_gaps, contiguous_ranges, run_labels, read_rows, read_ranges, stop_scan, job_discovery, session_seeds, action_counts, file_summary, book_asof,
        top_levels, book_summary, replay_events, feature_rows, audit_report, gap_median, reservoir_median, coverage_rows, feature_moments, resumed_moments, standardised, sampled_anchors, histories,
        eligible_pairs, pair_distances, target_scale, endpoint_counts, universe_pairs, distinct_endpoints, stream_coverage, valid_anchors, pair_unrank, pair_batches, latent_l2, vq_codes, vq_stats, state_futures, state_samples, forecast_eval,
        kmeans_codebook, lloyd_step, library_neighbours, distance_errors, split_summary, store_diff, split_overlap, reconcile, build_report, byte_totals, audit_summary, duration_quantiles, replay_metrics, stored_ticks, archived_returns, merged_records, corpus_problems, preflight,
    )
}
