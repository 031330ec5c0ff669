"""Every query with SQL beside it gives the same rows as DuckDB on the smallest tables."""

import duckdb
import numpy as np
import pytest

from ledgerloom.plans.oracles import ORACLES
from ledgerloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    def plain(x):
        if x is None or isinstance(x, float) and x != x:
            return None
        if isinstance(x, (float, np.floating)):
            return round(float(x), 5)
        return int(x) if isinstance(x, (int, np.integer, bool, np.bool_)) else str(x)

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(x) for x in r) for r in frame.itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_golden_counts(spark):
    found = QUERIES["pair_universe_counts"](spark, SF).toPandas()
    assert (found.anchors.sum(), found.within_pairs.sum(), found.cross_pairs.sum()) == (584, 15_231, 145_161)


def test_pairs_are_drawn_within_and_across_sessions(spark):
    found = QUERIES["pair_distances"](spark, SF).toPandas()
    assert len(found) == found.pair_id.nunique() == 100_000
    across = (found.s1 != found.s2).mean()
    assert abs(across - 145_161 / 160_392) < 0.01  # as in the whole universe
    assert ((found.s1 < found.s2) | (found.a2 - found.a1 >= 24)).all()
    scale = QUERIES["target_scale"](spark, SF).toPandas().iloc[0]
    assert scale.pairs == 100_000 and scale.scale == pytest.approx(found.d_raw[found.d_raw > 0].median(), abs=1e-5)
    ends = QUERIES["endpoint_counts"](spark, SF).toPandas()
    assert ends.endpoints.sum() == 200_000 and ends.same_session_pairs.sum() == (found.s1 == found.s2).sum() < 20_000


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLES) <= set(__spark_entry__.queries())
