"""SQL for DuckDB beside the registered queries: the same results, written independently."""

from __future__ import annotations

import numpy as np

from ledgerloom.operators.audit import NAMES
from ledgerloom.operators.seeded import SeededOrder
from ledgerloom.plans.queries import _FILES, _LOGS

K = "CAST(json_extract_string(props, '$.k') AS INT)"
US = "epoch_us(ts)"
TICKS = f"""
t0 AS (SELECT user_id % 8 AS session, event_id, ts, {US} AS us, value AS mid, ({K} = 0 OR value <= 0) AS brk FROM events),
ticks AS (
  SELECT *, row_number() OVER w - 1 AS row_id, CAST(sum(CAST(brk AS INT)) OVER w AS BIGINT) AS run
  FROM t0 WINDOW w AS (PARTITION BY session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
),
good AS (SELECT * FROM ticks WHERE NOT brk),
runs AS (SELECT session, run, min(row_id) AS first_row, max(row_id) AS last_row, count(*) AS n_rows FROM good GROUP BY ALL),
ranges AS (SELECT session, run, first_row + 15 AS start, last_row - 7 AS stop FROM runs WHERE last_row - 7 > first_row + 15),
anchors AS (SELECT session, run, unnest(range(start, stop)) AS anchor FROM ranges)"""
FUTURES = """,
later AS (
  SELECT session, run, row_id, mid, row_number() OVER r AS rn, list(mid) OVER (r ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING) AS l
  FROM good WINDOW r AS (PARTITION BY session, run ORDER BY row_id)
),
futures AS (SELECT session, run, row_id AS anchor, list_transform(l, lambda x: ln(x / mid)) AS y FROM later WHERE len(l) = 8 AND rn >= 16)"""
MIX = "CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || ':17'), 1, 15) AS BIGINT)"
SAMPLED = f""",
sampled AS (
  SELECT session, anchor, {MIX.format(key="anchor")} AS priority FROM anchors
  QUALIFY row_number() OVER (PARTITION BY session ORDER BY {MIX.format(key="anchor")}, anchor) <= 24
)"""
PAIRS = """,
chosen AS (SELECT a.session, a.anchor AS a, b.anchor AS b FROM sampled a JOIN sampled b ON a.session = b.session AND b.anchor - a.anchor >= 24)"""
#: Eligible pairs of the tables that come with this package (sf0.001, sf0.01): the seeded order depends on their number.
TOTALS = (160_392, 30_437_580)


def _drawn(n: int) -> str:
    """The first n pairs of the seeded order, listed, with their episodes: anchors are numbered, and a pair id lies among those of one earlier anchor."""
    listed = " UNION ALL ".join(f"SELECT {t} AS total, unnest(range({min(n, t)})) AS place, unnest({SeededOrder(t, 'events', 'all', 17).numbers(np.arange(min(n, t))).tolist()}) AS pair_id" for t in TOTALS)
    return f""",
numbered AS (
  SELECT session, anchor, row_number() OVER (ORDER BY session, anchor) - 1 AS g,
    count(*) OVER (PARTITION BY session ORDER BY anchor RANGE BETWEEN 24 FOLLOWING AND UNBOUNDED FOLLOWING) AS w FROM anchors
),
ended AS (SELECT *, max(g) OVER (PARTITION BY session) + 1 AS stop, count(*) OVER () AS n FROM numbered),
items AS (SELECT *, 0 AS kind, w AS size FROM ended UNION ALL SELECT *, 1, n - stop FROM ended),
starts AS (SELECT *, CAST(sum(size) OVER (ORDER BY session, kind, anchor ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS start FROM items),
listed AS ({listed}),
queue AS (SELECT place, pair_id FROM listed WHERE total = (SELECT sum(size) FROM items)),
earlier AS (
  SELECT q.place, q.pair_id, s.session AS s1, s.anchor AS a1, CASE WHEN kind = 0 THEN stop - w ELSE stop END + q.pair_id - s.start AS other
  FROM queue q ASOF JOIN (SELECT * FROM starts WHERE size > 0) s ON q.pair_id >= s.start
),
drawn AS (SELECT e.place, e.pair_id, s1, a1, x.session AS s2, x.anchor AS a2 FROM earlier e JOIN ended x ON x.g = e.other)"""


DISTANCES = _drawn(100_000) + """,
d AS (
  SELECT c.*, sqrt(list_sum(list_transform(range(1, 9), lambda i: (x.y[i] - z.y[i]) * (x.y[i] - z.y[i]))) / 8) AS d_raw, x.y[8] AS y1_last, z.y[8] AS y2_last
  FROM drawn c JOIN futures x ON x.session = c.s1 AND x.anchor = c.a1 JOIN futures z ON z.session = c.s2 AND z.anchor = c.a2
)"""
BATCHES = _drawn(4096) + DISTANCES[DISTANCES.index(",\nd AS ("):]
MBO = f"""
mbo AS (
  SELECT user_id % 8 AS session, event_id AS source_row, {US} * 1000 AS ts,
    CASE event_type WHEN 'signup' THEN 'A' WHEN 'view' THEN 'M' WHEN 'purchase' THEN 'C' WHEN 'click' THEN 'A' WHEN 'error' THEN 'N' END AS action,
    CASE WHEN (user_id // 8) % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side,
    CASE WHEN (user_id // 8) % 2 = 0 THEN 100 - 0.25::DOUBLE * (1 + {K} % 20) ELSE 100 + 0.25::DOUBLE * (1 + {K} % 20) END AS price,
    CAST(1 + floor(value) AS DOUBLE) AS size, user_id AS order_id, event_id % 3 <> 0 AS is_last
  FROM events
)"""
FINAL = """,
alive AS (
  SELECT session, order_id, arg_max(action, source_row) AS action, arg_max(side, source_row) AS side, arg_max(price, source_row) AS price, arg_max(size, source_row) AS size
  FROM mbo WHERE action IN ('A', 'C', 'M') GROUP BY ALL
),
lv AS (SELECT session, side, price, sum(size) AS qty, count(*) AS orders FROM alive WHERE action <> 'C' GROUP BY ALL)"""
BOOKS = """,
spans AS (
  SELECT *, coalesce(lead(source_row) OVER (PARTITION BY session, order_id ORDER BY source_row), 4611686018427387904) AS until
  FROM mbo WHERE action IN ('A', 'C', 'M')
),
ends AS (SELECT session, source_row AS ev, ts FROM mbo WHERE is_last),
level AS (
  SELECT e.session, e.ev, s.side, s.price, sum(s.size) AS qty, count(*) AS orders
  FROM ends e JOIN spans s ON s.session = e.session AND s.action <> 'C' AND s.source_row <= e.ev AND s.until > e.ev GROUP BY ALL
),
best AS (
  SELECT e.session, e.ev, e.ts, max(price) FILTER (side = 'BUY') AS bid, min(price) FILTER (side = 'SELL') AS ask,
    count(price) FILTER (side = 'BUY') AS n_bids, count(price) FILTER (side = 'SELL') AS n_asks
  FROM ends e LEFT JOIN level l USING (session, ev) GROUP BY ALL
),
marked AS (
  SELECT *, coalesce(bid IS NOT NULL AND ask IS NOT NULL AND bid <= ask AND bid + ask > 0, false) AS ok,
    sum(CASE WHEN coalesce(bid <= ask AND bid + ask > 0, false) THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY ev ROWS UNBOUNDED PRECEDING) AS segment
  FROM best
),
obs AS (
  SELECT session, ev AS source_row, ts, CAST(segment AS BIGINT) AS segment, (bid + ask) / 2 AS mid, bid, ask, CAST(n_bids AS INT) AS n_bids, CAST(n_asks AS INT) AS n_asks,
    lag((bid + ask) / 2) OVER w AS before_mid, lag(ts) OVER w AS before_ts
  FROM marked WHERE ok WINDOW w AS (PARTITION BY session, segment ORDER BY ev)
)"""
FEATURES = """,
ranked AS (SELECT l.*, row_number() OVER (PARTITION BY session, ev, side ORDER BY CASE WHEN side = 'BUY' THEN -price ELSE price END) AS k FROM level l),
g AS (
  SELECT o.session, o.source_row, CASE WHEN s.side = 'BUY' THEN 'bid_' ELSE 'ask_' END || n.k || '_' AS f, (r.price - o.mid) / 0.25::DOUBLE AS p, ln(1 + r.qty) AS q, ln(1 + CAST(r.orders AS DOUBLE)) AS c,
    CASE WHEN r.price IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS here
  FROM obs o CROSS JOIN (VALUES ('BUY'), ('SELL')) s(side) CROSS JOIN (SELECT unnest(range(1, 11)) AS k) n LEFT JOIN ranked r ON r.session = o.session AND r.ev = o.source_row AND r.side = s.side AND r.k = n.k
),
u AS (
  SELECT session, source_row, f || 'price_ticks' AS feature, p AS v FROM g UNION ALL SELECT session, source_row, f || 'quantity', q FROM g UNION ALL SELECT session, source_row, f || 'orders', c FROM g
  UNION ALL SELECT session, source_row, f || 'present', here FROM g UNION ALL SELECT session, source_row, 'spread_ticks', (ask - bid) / 0.25::DOUBLE FROM obs
  UNION ALL SELECT session, source_row, 'time_delta_seconds', ln(1 + coalesce((ts - before_ts) / 1e9, 0)) FROM obs UNION ALL SELECT session, source_row, 'mid_return', coalesce(ln(mid / before_mid), 0) FROM obs
  UNION ALL SELECT session, source_row, 'initial', CASE WHEN before_ts IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM obs
  UNION ALL SELECT session, source_row, 'tod_sin', sin(2 * pi() * ((ts % 86400000000000) / 1e9) / 86400) FROM obs UNION ALL SELECT session, source_row, 'tod_cos', cos(2 * pi() * ((ts % 86400000000000) / 1e9) / 86400) FROM obs
)"""
KEPT = r"feature LIKE '%\_present' ESCAPE '\' OR feature = 'initial' OR feature LIKE 'tod%'"
MOMENTS = f"""WITH {MBO}{BOOKS}{FEATURES},
m AS (SELECT feature, count(v) AS n, avg(v) AS a, stddev_pop(v) AS sd, {KEPT} AS kept FROM u GROUP BY 1)
SELECT feature, n, round(CASE WHEN kept OR n = 0 THEN 0 ELSE a END, 5) AS mean, round(CASE WHEN kept OR n = 0 OR coalesce(sd, 0) <= 1e-12 THEN 1 ELSE sd END, 5) AS scale, n = 0 OR coalesce(sd, 0) <= 1e-12 AS constant FROM m"""
CODES = """
parts AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
book AS (SELECT label AS code, pos, avg(CAST(v AS DOUBLE)) AS p FROM parts GROUP BY ALL),
dist AS (SELECT vec_id, label, code, sqrt(sum((CAST(v AS DOUBLE) - p) * (CAST(v AS DOUBLE) - p))) AS distance FROM parts JOIN book USING (pos) GROUP BY ALL),
coded AS (SELECT vec_id, label, code, distance FROM dist QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, code) = 1)"""
PATHS = f"""WITH {CODES},{TICKS}{FUTURES},
paths AS (SELECT f.session, f.anchor, f.y, c.code, c.distance FROM futures f JOIN coded c ON c.vec_id = f.anchor % (SELECT count(*) FROM embeddings)),
steps AS (SELECT session, anchor, code, distance, unnest(y) AS v, generate_subscripts(y, 1) - 1 AS step FROM paths),
learned AS (SELECT code, step, count(*) AS n, avg(v) AS mean, var_pop(v) AS var FROM steps WHERE session < 5 GROUP BY ALL)"""


def _moved(name: str, guess: str) -> str:
    e = f"(v - {guess})"
    return f"round(avg({e} * {e}) FILTER (n IS NOT NULL), 5) AS {name}_mse, round(avg(abs{e}) FILTER (n IS NOT NULL AND step = 7), 5) AS {name}_terminal_mae, round(sqrt(avg({e} * {e}) FILTER (n IS NOT NULL AND step = 7)), 5) AS {name}_terminal_rmse"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(map(str, r)) + ")" for r in rows)


_NAME = r"'-(\d{8})\.([a-z]+)\.([^.]+?)(?:\.(\d+))?\.dbn\.zst$'"
_ACTIONS = ", ".join(f"count(*) FILTER (action = '{a}') AS n_{a.lower()}" for a in "ACMRTFN")

ORACLES = {
    "q_ticks": f"WITH {TICKS} SELECT session, row_id, event_id, us AS ts_us, mid, brk, run FROM ticks",
    "q_mbo": f"WITH {MBO} SELECT * FROM mbo",
    "q_runs": f"WITH {TICKS} SELECT * FROM runs",
    "anchor_ranges": f"WITH {TICKS} SELECT * FROM ranges",
    "anchor_batches": f"WITH {TICKS}, b AS (SELECT session, run, stop, unnest(range(start, stop, 32)) AS first FROM ranges) SELECT session, run, first, CAST(least(first + 32, stop) - first AS INT) AS n FROM b",
    "future_paths": f"WITH {TICKS}{FUTURES} SELECT session, run, anchor, round(y[1], 6) AS y_first, round(y[8], 6) AS y_last FROM futures",
    "pair_universe_counts": f"""WITH {TICKS},
w AS (SELECT session, count(*) OVER (PARTITION BY session ORDER BY anchor RANGE BETWEEN 24 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM anchors),
s AS (SELECT session, count(*) AS anchors, CAST(sum(n) AS BIGINT) AS within_pairs FROM w GROUP BY 1)
SELECT session, anchors, within_pairs, CAST(anchors * coalesce((SELECT sum(o.anchors) FROM s o WHERE o.session > s.session), 0) AS BIGINT) AS cross_pairs FROM s""",
    "range_pair_counts": "WITH "
    + TICKS
    + ", "
    + ", ".join(f"w{g} AS (SELECT session, {g} AS gap, CAST(sum(n) AS BIGINT) AS within_pairs FROM (SELECT session, count(*) OVER (PARTITION BY session ORDER BY anchor RANGE BETWEEN {g} FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM anchors) GROUP BY 1)" for g in (1, 5, 60))
    + " SELECT * FROM w1 UNION ALL SELECT * FROM w5 UNION ALL SELECT * FROM w60",
    "step_returns": f"WITH {TICKS} SELECT session, row_id, round(coalesce(ln(mid / lag(mid) OVER (PARTITION BY session, run ORDER BY row_id)), 0), 6) AS step_return FROM good",
    "future_span": f"""WITH {TICKS}, f AS (SELECT session, (lead(us, 8) OVER (PARTITION BY session, run ORDER BY row_id) - us) / 1e6 AS s FROM good)
SELECT session, count(s) AS n, round(min(s), 6) AS least, round(median(s), 6) AS middle, round(max(s), 6) AS most FROM f WHERE s IS NOT NULL GROUP BY 1""",
    "zero_paths": f"""WITH {TICKS}, f AS (SELECT session, mid, list(mid) OVER (PARTITION BY session, run ORDER BY row_id ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING) AS l FROM good)
SELECT session, count(*) AS n, count(*) FILTER (len(list_filter(l, lambda x: x <> mid)) = 0) AS unchanged FROM f WHERE len(l) = 8 GROUP BY 1""",
    "tod_features": f"""WITH z AS (SELECT event_id, {US} AS us, ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Chicago' AS local FROM events),
s AS (SELECT event_id, hour(local) * 3600 + minute(local) * 60 + second(local) + (us % 1000000) / 1e6 AS seconds, (us % 86400000000) / 1e6 AS simulated FROM z)
SELECT event_id, round(seconds, 6) AS seconds, round(simulated, 6) AS simulated, round(sin(2 * pi() * seconds / 86400), 6) AS tod_sin, round(cos(2 * pi() * seconds / 86400), 6) AS tod_cos FROM s""",
    "clock_regressions": f"""WITH o AS (SELECT user_id % 8 AS session, {US} AS us, lag({US}) OVER (PARTITION BY user_id % 8 ORDER BY value, event_id) AS b FROM events)
SELECT session, count(*) AS n FROM o WHERE us < b GROUP BY 1""",
    "interval_gaps": f"""WITH {TICKS}, i AS (SELECT session, run, min(us) AS start, max(us) + 1 AS stop FROM good GROUP BY ALL),
c AS (SELECT session, start, max(stop) OVER (PARTITION BY session ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered FROM i)
SELECT session, covered AS gap_start, start AS gap_stop FROM c WHERE start > covered""",
    "contiguous_ranges": f"""WITH {TICKS}, c AS (SELECT session, first_row AS start, lag(last_row + 1) OVER (PARTITION BY session ORDER BY first_row) AS b FROM runs)
SELECT session, CASE WHEN start > b THEN 'gap' ELSE 'overlap' END AS problem, count(*) AS n FROM c WHERE b IS NOT NULL AND start <> b GROUP BY ALL""",
    "run_labels": """WITH c AS (SELECT user_id % 8 AS session, coalesce(event_type <> lag(event_type) OVER (PARTITION BY user_id % 8 ORDER BY event_id), false) AS c FROM events)
SELECT session, CAST(sum(CAST(c AS INT)) AS BIGINT) AS last_run, count(*) AS rows FROM c GROUP BY 1""",
    "read_rows": f"WITH {TICKS} SELECT event_id AS place, session, row_id, mid FROM ticks UNION ALL SELECT -1 - event_id, session, row_id, mid FROM ticks",
    "read_ranges": f"""WITH {TICKS} SELECT t.session, count(*) AS n, round(sum(t.mid), 3) AS total FROM ticks t JOIN ranges r ON r.session = t.session AND t.row_id >= r.start - 15 AND t.row_id < r.stop GROUP BY 1""",
    "stop_scan": f"""WITH {MBO}, s AS (SELECT session, min(source_row) AS stop_row FROM mbo WHERE is_last AND ts >= (SELECT min(ts) FROM mbo) + 1800000000000 GROUP BY 1)
SELECT session, count(*) AS n, max(source_row) AS last FROM mbo LEFT JOIN s USING (session) WHERE stop_row IS NULL OR source_row < stop_row GROUP BY 1""",
    "job_discovery": f"""WITH f(path) AS (VALUES {", ".join(f"('{x}')" for x in _FILES)}),
n AS (SELECT path, regexp_extract(path, {_NAME}, 1) AS day, regexp_extract(path, {_NAME}, 2) AS kind, regexp_extract(path, {_NAME}, 3) AS instrument, coalesce(try_cast(regexp_extract(path, {_NAME}, 4) AS INT), 0) AS part FROM f),
i AS (SELECT day, count(DISTINCT instrument) AS m FROM n WHERE kind IN ('mbo', 'definition') GROUP BY 1),
l AS (SELECT day, string_agg(path, '|' ORDER BY part, path) AS parts FROM n WHERE day <> '' AND kind = 'mbo' GROUP BY 1),
d AS (SELECT day, min(path) AS definition, count(*) AS k FROM n WHERE day <> '' AND kind = 'definition' GROUP BY 1)
SELECT day, parts, definition, CASE WHEN parts IS NULL THEN 'no log' WHEN definition IS NULL THEN 'no definition' WHEN k > 1 THEN 'several definitions' WHEN m > 1 THEN 'several instruments' END AS problem FROM l FULL JOIN d USING (day) LEFT JOIN i USING (day)""",
    "session_seeds": """WITH d AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS date FROM events)
SELECT date, CAST(('0x' || substr(sha256('17:' || date), 1, 8)) AS BIGINT) % 4294967295 AS seed FROM d""",
    "action_counts": f"WITH {MBO} SELECT action, count(*) AS n FROM mbo GROUP BY 1",
    "file_summary": f"WITH {MBO} SELECT session, count(*) AS records, {_ACTIONS}, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT order_id) AS orders FROM mbo GROUP BY 1",
    "book_asof": f"WITH {MBO}{FINAL} SELECT * FROM lv",
    "top_levels": f"""WITH {MBO}{FINAL}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY session, side ORDER BY CASE WHEN side = 'BUY' THEN -price ELSE price END) AS INT) AS level FROM lv)
SELECT session, side, level, price, qty, orders FROM r WHERE level <= 10""",
    "book_summary": f"""WITH {MBO}{FINAL}, b AS (SELECT session, max(price) FILTER (side = 'BUY') AS best_bid, min(price) FILTER (side = 'SELL') AS best_ask, sum(qty) FILTER (side = 'BUY') AS bid_qty, sum(qty) FILTER (side = 'SELL') AS ask_qty, count(*) AS n_levels FROM lv GROUP BY 1)
SELECT session, best_bid, best_ask, best_ask - best_bid AS spread, bid_qty, ask_qty, n_levels FROM b""",
    "replay_events": f"WITH {MBO}{BOOKS} SELECT session, source_row, segment, before_ts IS NULL AS initial, mid, n_bids, n_asks FROM obs",
    "feature_rows": f"""WITH {MBO}{BOOKS},
ranked AS (SELECT l.*, row_number() OVER (PARTITION BY session, ev, side ORDER BY CASE WHEN side = 'BUY' THEN -price ELSE price END) AS k FROM level l),
top AS (
  SELECT o.session, o.source_row, sum((r.price - o.mid) / 0.25 + r.qty + r.orders + 1) AS total,
    max(r.qty) FILTER (side = 'BUY' AND k = 1) AS bq, max(r.orders) FILTER (side = 'BUY' AND k = 1) AS bo, max(r.qty) FILTER (side = 'SELL' AND k = 1) AS aq, max(CASE WHEN side = 'BUY' AND k = 10 THEN 1 ELSE 0 END) AS b10
  FROM obs o JOIN ranked r ON r.session = o.session AND r.ev = o.source_row AND r.k <= 10 GROUP BY ALL
)
SELECT o.session, o.source_row, 86 AS width, round((bid - mid) / 0.25, 6) AS bid_1_price_ticks, round(bq, 6) AS bid_1_quantity, round(CAST(bo AS DOUBLE), 6) AS bid_1_orders,
  round((ask - mid) / 0.25, 6) AS ask_1_price_ticks, round(aq, 6) AS ask_1_quantity, round(CAST(b10 AS DOUBLE), 6) AS bid_10_present, round((ask - bid) / 0.25, 6) AS spread_ticks,
  round(coalesce((ts - before_ts) / 1e9, 0), 6) AS time_delta_seconds, round(coalesce(ln(mid / before_mid), 0), 6) AS mid_return, CASE WHEN before_ts IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS initial,
  round(total + (ask - bid) / 0.25, 4) AS total
FROM obs o JOIN top USING (session, source_row)""",
    "feature_moments": MOMENTS,
    "resumed_moments": MOMENTS,
    "standardised": f"""WITH {MBO}{BOOKS}{FEATURES},
m AS (SELECT feature, count(v) AS n, avg(v) AS a, stddev_pop(v) AS sd, {KEPT} AS kept FROM u WHERE session < 5 GROUP BY 1),
s AS (SELECT feature, CASE WHEN kept OR n = 0 THEN 0 ELSE a END AS mean, CASE WHEN kept OR n = 0 OR coalesce(sd, 0) <= 1e-12 THEN 1 ELSE sd END AS scale FROM m),
z AS (SELECT session, source_row, feature, coalesce((v - mean) / scale, 0) AS z FROM u JOIN s USING (feature))
SELECT session, source_row, round(sum(z), 3) AS z_total, """
    + ", ".join(f"round(max(z) FILTER (feature = '{n}'), 5) AS z_{n}" for n in ("bid_1_quantity", "ask_1_price_ticks", "spread_ticks", "mid_return"))
    + " FROM z GROUP BY ALL",
    "audit_summary": f"""WITH {MBO}{BOOKS}{FEATURES},
l AS (SELECT session, segment, count(*) AS n FROM obs GROUP BY ALL), a AS (SELECT session, count(*) AS segments, max(n) AS longest, CAST(sum(n) AS BIGINT) AS rows FROM l GROUP BY 1),
later AS (SELECT session, (lead(ts, 8) OVER w - ts) / 1e9 AS sec, mid, list(mid) OVER (w ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING) AS l FROM obs WINDOW w AS (PARTITION BY session, segment ORDER BY source_row)),
futures_of AS (SELECT session, count(sec) AS futures, min(sec) AS least_seconds, max(sec) AS most_seconds, avg(CASE WHEN len(list_filter(l, lambda x: x <> mid)) = 0 THEN 1.0 ELSE 0.0 END) AS unchanged FROM later WHERE sec IS NOT NULL GROUP BY 1),
p AS (SELECT session, avg(1 - (least(n_bids, 10) + least(n_asks, 10)) / 20) AS absent FROM obs GROUP BY 1),
r AS (SELECT session, feature, min(coalesce(v, 0)) AS lo, max(coalesce(v, 0)) AS hi FROM u GROUP BY ALL), c AS (SELECT session, CAST(count(*) FILTER (lo = hi) AS INT) AS constant FROM r GROUP BY 1)
SELECT session, segments, longest, rows, coalesce(futures, 0) AS futures, round(least_seconds, 6) AS least_seconds, round(most_seconds, 6) AS most_seconds, round(unchanged, 6) AS unchanged, round(absent, 6) AS absent, constant
FROM a LEFT JOIN futures_of USING (session) JOIN p USING (session) JOIN c USING (session)""",
    "duration_quantiles": f"""WITH {MBO}{BOOKS}, l AS (SELECT CAST(count(*) AS DOUBLE) AS v FROM obs GROUP BY session, segment),
f AS (SELECT (lead(ts, 8) OVER (PARTITION BY session, segment ORDER BY source_row) - ts) / 1e9 AS v FROM obs)
"""
    + " UNION ALL ".join(f"SELECT '{what}' AS what, {q}::DOUBLE AS q, round(quantile_cont(v, {q}), 6) AS value FROM {t}" for what, t in (("segment_rows", "l"), ("future_seconds", "f")) for q in (0.0, 0.5, 0.95, 1.0)),
    "replay_metrics": f"""WITH {MBO}{BOOKS}, r AS (SELECT session, count(*) AS records, CAST(sum(CAST(is_last AS INT)) AS BIGINT) AS completed, """
    + ", ".join(f"CAST(sum(CAST(action = '{x}' AS INT)) AS BIGINT) AS n_{x.lower()}" for x in "ACMR")
    + """ FROM mbo GROUP BY 1),
o AS (SELECT session, count(*) AS rows, count(DISTINCT segment) AS segments, CAST(max(greatest(n_bids, n_asks)) AS INT) AS most_levels FROM obs GROUP BY 1)
SELECT r.*, coalesce(rows, 0) AS rows, coalesce(segments, 0) AS segments, coalesce(most_levels, 0) AS most_levels FROM r LEFT JOIN o USING (session)""",
    "stored_ticks": f"WITH {TICKS} SELECT session, run AS segment, count(*) AS n, round(sum(mid), 4) AS total FROM ticks GROUP BY ALL",
    "archived_returns": f"""WITH {TICKS}, p AS (SELECT session, mid, row_number() OVER (PARTITION BY session ORDER BY row_id) - 1 AS row_id FROM ticks WHERE mid > 0)
SELECT session, row_id, round(coalesce(ln(mid / lag(mid) OVER (PARTITION BY session ORDER BY row_id)), 0), 6) AS y FROM p""",
    "merged_records": f"""WITH {MBO}, d0 AS (SELECT session, source_row AS sequence, size FROM mbo WHERE action IN ('A', 'C', 'M') AND source_row % 10 <> 3),
d AS (SELECT * FROM d0 UNION ALL SELECT * FROM d0 WHERE sequence % 20 = 5 UNION ALL SELECT session, source_row, size FROM mbo WHERE action = 'N' AND source_row % 4 = 0),
o AS (SELECT session, sequence, count(*) AS n, any_value(size) AS size FROM d GROUP BY ALL),
b AS (SELECT m.session, o.size, CASE WHEN n > 1 THEN 'repeated' WHEN action = 'N' AND n IS NOT NULL THEN 'unexpected delta' WHEN action <> 'N' AND n IS NULL THEN 'no delta' END AS problem FROM mbo m LEFT JOIN o ON o.session = m.session AND o.sequence = m.source_row)
SELECT session, problem, count(*) AS n, round(sum(size), 3) AS size FROM b GROUP BY ALL""",
    "corpus_problems": """WITH s AS (SELECT CAST(ts AS DATE) AS day, min(user_id) AS seed, min(event_id) AS e, month(CAST(ts AS DATE)) AS config FROM events GROUP BY 1),
c AS (SELECT count(*) AS sessions, count(*) - count(DISTINCT e) AS digests, count(*) - count(DISTINCT seed) AS seeds, count(DISTINCT config) AS configs FROM s)
SELECT 'too few sessions' AS problem, sessions AS n FROM c WHERE sessions < 7 UNION ALL SELECT 'shared digests', digests FROM c WHERE digests > 0
UNION ALL SELECT 'shared seeds', seeds FROM c WHERE seeds > 0 UNION ALL SELECT 'several configurations', configs FROM c WHERE configs > 1""",
    "byte_totals": "SELECT event_type, count(*) AS n, CAST(sum(strlen(props)) AS BIGINT) AS bytes, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ROLLUP (event_type)",
    "distinct_endpoints": f"WITH {TICKS}{_drawn(100_000)} SELECT s1 AS session, a1 AS anchor FROM drawn UNION SELECT s2, a2 FROM drawn",
    "stream_coverage": f"""WITH {TICKS}{FUTURES}{DISTANCES}, e AS (SELECT s, count(*) AS n FROM (SELECT s1 AS s FROM drawn UNION ALL SELECT s2 FROM drawn) GROUP BY 1)
SELECT count(*) AS pairs, count(*) FILTER (s1 = s2) AS same_session_pairs, round(sum(d_raw), 3) AS distance_sum, (SELECT count(*) FROM e) AS sessions, (SELECT min(n) FROM e) AS least_endpoints, (SELECT max(n) FROM e) AS most_endpoints FROM d""",
    "valid_anchors": f"""WITH {TICKS}, p AS (SELECT *, CASE WHEN row_id < 500 THEN 'first' ELSE 'rest' END AS part FROM good),
r AS (SELECT session, run, part, min(row_id) + 15 AS start, max(row_id) - 7 AS stop FROM p GROUP BY ALL)
SELECT session, run, unnest(range(start, stop)) AS anchor, part FROM r WHERE stop > start""",
    "lloyd_step": f"""WITH {CODES}, m AS (SELECT c.code, p.pos, count(*) AS n, avg(CAST(p.v AS DOUBLE)) AS v FROM coded c JOIN parts p USING (vec_id) GROUP BY ALL)
SELECT b.code, coalesce(m.n, 0) AS n, CAST(b.pos - 1 AS INT) AS at, round(coalesce(m.v, b.p), 6) AS v FROM book b LEFT JOIN m USING (code, pos)""",
    "library_neighbours": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT q.vec_id AS query, l.vec_id AS nearest, sqrt(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - l.v[i]) * (q.v[i] - l.v[i])))) AS distance FROM e q JOIN e l ON q.vec_id % 20 = 0 AND l.vec_id % 20 <> 0)
SELECT query, nearest, round(distance, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY query ORDER BY distance, nearest) = 1""",
    "distance_errors": f"""WITH {CODES}, e AS (SELECT c.distance AS p, t.distance AS t FROM coded c JOIN dist t ON t.vec_id = c.vec_id AND t.label = t.code)
SELECT count(*) AS pairs, round(avg((p - t) * (p - t)), 6) AS mse, round(sqrt(avg((p - t) * (p - t))), 6) AS rmse, round(avg(abs(p - t)), 6) AS mae, round(avg(p), 6) AS mean_predicted, round(avg(t), 6) AS mean_target FROM e""",
    "audit_report": f"WITH {MBO}{BOOKS} SELECT session, count(*) AS rows, count(DISTINCT segment) AS segments, min(ts) AS first_ts, max(ts) AS last_ts, " + ", ".join(f"0::BIGINT AS {n}" for n in NAMES) + " FROM obs GROUP BY 1",
    "gap_median": f"""WITH {TICKS}, g AS (SELECT (us - lag(us) OVER (PARTITION BY session, run ORDER BY row_id)) / 1e6 AS gap FROM good)
SELECT round(median(gap), 6) AS median, count(*) AS n FROM g WHERE gap > 0""",
    "reservoir_median": f"""WITH {TICKS}, g AS (SELECT event_id, (us - lag(us) OVER (PARTITION BY session, run ORDER BY row_id)) / 1e6 AS gap FROM good),
k AS (SELECT gap FROM g WHERE gap > 0 ORDER BY {MIX.format(key="event_id")}, event_id LIMIT 1000000) SELECT round(median(gap), 6) AS median, count(*) AS n FROM k""",
    "coverage_rows": f"""WITH {TICKS}, c AS (SELECT DISTINCT t.session, t.row_id FROM ticks t JOIN ranges r ON r.session = t.session AND t.row_id >= r.start - 15 AND t.row_id < r.stop),
e AS (SELECT session, row_id, coalesce(row_id - lag(row_id) OVER (PARTITION BY session ORDER BY row_id) > 1, true) AS f FROM c)
SELECT session, count(*) AS rows, count(*) FILTER (f) AS ranges FROM e GROUP BY 1""",
    "sampled_anchors": f"WITH {TICKS}{SAMPLED} SELECT * FROM sampled",
    "histories": f"""WITH {TICKS} SELECT s.session, s.anchor, round(sum(t.mid), 4) AS total, round(arg_min(t.mid, t.row_id), 6) AS first, round(arg_max(t.mid, t.row_id), 6) AS last
FROM anchors s JOIN good t ON t.session = s.session AND t.row_id BETWEEN s.anchor - 15 AND s.anchor GROUP BY ALL""",
    "eligible_pairs": f"WITH {TICKS}{SAMPLED}{PAIRS} SELECT * FROM chosen",
    "universe_pairs": f"WITH {TICKS}{_drawn(100_000)} SELECT * FROM drawn",
    "pair_distances": f"WITH {TICKS}{FUTURES}{DISTANCES} SELECT pair_id, place, s1, a1, s2, a2, round(d_raw, 6) AS d_raw FROM d",
    "target_scale": f"""WITH {TICKS}{FUTURES}{DISTANCES}, h AS (SELECT d_raw, ntile(2) OVER (ORDER BY place) AS half FROM d)
SELECT round(median(d_raw) FILTER (d_raw > 0), 6) AS scale, count(*) AS pairs, round(avg(CAST(d_raw = 0 AS INT)), 6) AS zero_fraction, """
    + ", ".join(f"round(quantile_cont(d_raw, {q}), 6) AS q{int(100 * q):03d}" for q in (0.0, 0.25, 0.5, 0.75, 0.95, 1.0))
    + ", round(median(d_raw) FILTER (d_raw > 0 AND half = 1), 6) AS first_half, round(median(d_raw) FILTER (d_raw > 0 AND half = 2), 6) AS second_half FROM h",
    "endpoint_counts": f"""WITH {TICKS}{_drawn(100_000)}, e AS (SELECT s1 AS session, CAST(s1 = s2 AS INT) AS own FROM drawn UNION ALL SELECT s2, 0 FROM drawn)
SELECT session, count(*) AS endpoints, CAST(sum(own) AS BIGINT) AS same_session_pairs FROM e GROUP BY 1""",
    "pair_unrank": f"WITH {TICKS}{_drawn(4096)} SELECT pair_id, s1, a1, s2, a2, pair_id AS back FROM drawn",
    "pair_batches": f"""WITH {TICKS}{FUTURES}{BATCHES},
h AS (SELECT a.session, a.anchor, round(sum(t.mid), 4) AS total FROM anchors a JOIN good t ON t.session = a.session AND t.row_id BETWEEN a.anchor - 15 AND a.anchor GROUP BY ALL)
SELECT pair_id, place, place // 32 AS batch, s1, a1, s2, a2, h1.total AS x1_total, h2.total AS x2_total, round(y1_last, 6) AS y1_last, round(y2_last, 6) AS y2_last, round(d_raw, 6) AS d_raw
FROM d JOIN h h1 ON h1.session = s1 AND h1.anchor = a1 JOIN h h2 ON h2.session = s2 AND h2.anchor = a2""",
    "latent_l2": f"WITH {CODES} SELECT vec_id, round(distance, 6) AS distance FROM dist WHERE label = code",
    "vq_codes": f"WITH {CODES} SELECT vec_id, code, round(distance, 6) AS distance FROM coded",
    "vq_stats": f"""WITH {CODES}, c AS (SELECT code, count(*) AS n FROM coded GROUP BY 1), a AS (SELECT sum(n) AS total FROM c),
e AS (SELECT count(*) AS active, -sum(n / total * log2(n / total)) AS h, min(n) AS min_support, median(n) AS median_support, max(n) AS max_support FROM c, a)
SELECT count(*) AS total, round(avg(distance * distance), 6) AS mse, round(avg(distance), 6) AS mean_l2, round(max(distance), 6) AS max_l2,
  round(quantile_cont(distance, 0.5), 6) AS p50, round(quantile_cont(distance, 0.9), 6) AS p90, round(quantile_cont(distance, 0.95), 6) AS p95, round(quantile_cont(distance, 0.99), 6) AS p99,
  any_value(active) AS active, round(any_value(h), 6) AS entropy_bits, any_value(min_support) AS min_support, round(any_value(median_support), 6) AS median_support, any_value(max_support) AS max_support,
  round(pow(2, any_value(h)), 6) AS effective_states FROM coded, e""",
    "state_futures": f"{PATHS} SELECT code, CAST(step AS INT) AS step, n, round(mean, 6) AS mean, round(var, 5) AS var FROM learned",
    "state_samples": f"""{PATHS}, k AS (SELECT code, session * 1000000 + anchor AS key FROM paths WHERE session < 5)
SELECT code, key, {MIX.format(key="key")} AS priority FROM k QUALIFY row_number() OVER (PARTITION BY code ORDER BY {MIX.format(key="key")}, key) <= 16""",
    "forecast_eval": f"""{PATHS}, o AS (SELECT step, sum(mean * n) / sum(n) AS overall FROM learned GROUP BY 1),
b AS (SELECT s.*, l.n, l.mean, o.overall FROM steps s LEFT JOIN learned l USING (code, step) LEFT JOIN o USING (step) WHERE session >= 6)
SELECT count(*) FILTER (step = 0) AS rows, count(*) FILTER (step = 0 AND n IS NOT NULL) AS supported, {_moved("state", "mean")}, {_moved("overall", "overall")}, {_moved("zero", "0")},
  round(avg(n) FILTER (step = 0), 5) AS mean_support, round(avg(distance) FILTER (step = 0 AND n IS NOT NULL), 5) AS mean_distance, round(max(distance) FILTER (step = 0 AND n IS NOT NULL), 5) AS max_distance,
  round(count(*) FILTER (step = 0 AND n IS NOT NULL) / count(*) FILTER (step = 0), 5) AS coverage FROM b""",
    "split_summary": f"""WITH {TICKS}, w AS (SELECT session, count(*) OVER (PARTITION BY session ORDER BY anchor RANGE BETWEEN 24 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM anchors),
s AS (SELECT session, count(*) AS k, sum(n) AS n, row_number() OVER (ORDER BY session) - 1 AS place FROM w GROUP BY 1)
SELECT CASE WHEN place < 5 THEN 'train' WHEN place < 6 THEN 'validation' ELSE 'test' END AS split, count(*) AS sessions, CAST(sum(k) AS BIGINT) AS anchors, CAST(sum(n) AS BIGINT) AS within_pairs FROM s GROUP BY 1""",
    "store_diff": """WITH c AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT 'left' AS side, CAST(sum(n - 1) AS BIGINT) AS n, CAST(sum((n - 1) * l_orderkey) AS BIGINT) AS keys FROM c WHERE n > 1 HAVING count(*) > 0""",
    "split_overlap": """WITH d AS (SELECT DISTINCT user_id % 8 AS session, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events)
SELECT a.session, a.day FROM d a JOIN d b ON b.session = a.session + 1 AND b.day = a.day""",
    "reconcile": """WITH l AS (SELECT CAST(ts AS DATE) AS day, user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY ALL),
f AS (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id, 1 AS m FROM events WHERE event_type = 'view')
SELECT CASE WHEN m IS NULL THEN 'missing' WHEN n IS NULL THEN 'unexpected' ELSE 'duplicate' END AS problem, count(*) AS n FROM l FULL JOIN f USING (day, user_id) WHERE m IS NULL OR n IS NULL OR n > 1 GROUP BY 1""",
    "build_report": """WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS rows FROM events GROUP BY 1), t AS (SELECT *, strftime(day, '%Y-%m') AS month, CAST(dayofweek(day) + 1 AS INT) AS weekday FROM d)
SELECT coalesce(month, 'all') AS month, coalesce(weekday, 0) AS weekday, count(*) AS days, CAST(sum(rows) AS BIGINT) AS total, min(rows) AS least, max(rows) AS most, round(avg(rows), 4) AS mean, round(median(rows), 4) AS median,
  round(100 * sum(rows) / (SELECT sum(rows) FROM d), 4) AS share, round(avg(rows) / (SELECT avg(rows) FROM d), 4) AS ratio FROM t GROUP BY ROLLUP (month, weekday)""",
    "preflight": f"""WITH l(session, source_row, action, is_snapshot, is_last) AS (VALUES {_values((s, r[0], f"'{r[1]}'", r[2], r[3]) for s, log in _LOGS.items() for r in log)}),
f AS (SELECT session, arg_min(action, source_row) AS first, arg_min(is_snapshot, source_row) AS first_snapshot, min(source_row) FILTER (is_snapshot AND is_last) AS done, min(source_row) FILTER (action IN ('A', 'M', 'C') AND NOT is_snapshot) AS live FROM l GROUP BY 1)
SELECT session, first = 'R' AND (first_snapshot OR (done IS NOT NULL AND (live IS NULL OR done < live))) AS ok FROM f""",
}
