"""Replay by blocks gives what replay in one pass gives."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import book, book_blocks
from ledgerloom.sources import views

COLUMNS = ["session", "source_row", "ts", "segment", "initial", "mid", "bids", "asks", "n_bids", "n_asks", "before_mid", "before_ts"]


def same(a, b):
    return sorted(map(str, a.select(COLUMNS).collect())) == sorted(map(str, b.select(COLUMNS).collect()))


@pytest.mark.parametrize("size", [7, 100, 1 << 18])
def test_blocks(spark, size):
    events = views.mbo(spark, "/root/testdata/sf0.001")
    assert same(book_blocks.replay(events, size=size), book.replay(events))


@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_clears_and_breaks(spark, size):
    rows = [
        (0, 1, "R", "BUY", 0.0, 0.0, 0, False, True), (1, 1, "A", "BUY", 99.0, 5.0, 1, False, True), (2, 1, "A", "SELL", 101.0, 7.0, 2, True, True),
        (3, 2, "A", "BUY", 99.0, 2.0, 3, True, False), (4, 3, "M", "BUY", 99.5, 4.0, 1, True, False), (5, 4, "T", "BUY", 99.5, 1.0, 1, True, False),
        (6, 5, "C", "SELL", 101.0, 0.0, 2, True, False), (7, 6, "A", "SELL", 101.0, 1.0, 9, True, False), (8, 7, "R", "SELL", 0.0, 0.0, 0, True, False),
        (9, 8, "A", "BUY", 98.0, 1.0, 1, True, False), (10, 9, "A", "SELL", 100.0, 1.0, 5, True, False), (11, 9, "N", "BUY", 0.0, 0.0, 0, True, False),
    ]
    schema = "session bigint, source_row bigint, ts bigint, action string, side string, price double, size double, order_id bigint, is_last boolean, is_snapshot boolean"
    events = spark.createDataFrame([(s, *r) for s in (0, 1) for r in rows], schema).filter(F.col("session") == 0)
    for mode in ("replay", "extract"):
        assert same(book_blocks.replay(events, mode, size=size), book.replay(events, mode))
