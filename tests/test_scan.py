"""Segmented prefix scans against windows, above all with one key larger than any part of it."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import chunking as C
from paperloom.operators import memory as M
from paperloom.operators.scan import Scan


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def elements(spark):
    rnd = random.Random(12)
    kinds = ["NarrativeText"] * 8 + ["Title", "Table", "ListItem", "Footer"]
    rows = [("long", k, rnd.choice(kinds), rnd.choice(["text goes on", "it ends here.", "as follows:", None]), 1) for k in range(6000)]
    rows += [(f"d{k % 300}", k, rnd.choice(kinds), rnd.choice(["some text", "an end."]), 1) for k in range(1500)]
    rows += [(None, k, "NarrativeText", "no document", 1) for k in range(50)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id string, seq bigint, category string, text string, page_number int").repartition(6)


def test_sections_and_groups(elements):
    """WN01 and WN02 with one document of 6,000 elements."""
    assert rows_of(C.sectioned(elements, cut=100)) == rows_of(C.sectioned(elements))
    assert rows_of(C.flush_groups(elements, cut=100)) == rows_of(C.flush_groups(elements))
    assert C.flush_groups(elements.limit(0), cut=100).count() == 0


def test_one_key_lies_in_many_segments(elements):
    """The long key is cut into many segments of about the same size; no other key is cut."""
    scan = Scan(elements, "doc_id", ["seq"], 100)
    sizes = {(r.doc_id, r["__segment"]): r["count"] for r in scan.rows.groupBy("doc_id", "__segment").count().collect()}
    long = [n for (d, _), n in sizes.items() if d == "long"]
    assert len(long) >= 50 and max(long) < 200 and all(s == 0 for d, s in sizes if d != "long")


def test_epochs_and_ttl_spans(spark):
    """WN10 and ST01 with one session that has nearly all events, and ties in time."""
    rnd = random.Random(3)
    rows = [("busy" if k % 20 else f"s{k}", k, rnd.randrange(400_000), rnd.choice(["a", "a", "b"])) for k in range(4000)]
    events = spark.createDataFrame(rows, "session_id string, event_id bigint, at bigint, topic string").withColumn("ts", F.timestamp_seconds("at")).repartition(5)
    assert rows_of(M.epochs(events, "session_id", "topic", "ts", "event_id", cut=50)) == rows_of(M.epochs(events, "session_id", "topic", "ts", "event_id"))
    assert rows_of(M.ttl_sessions(events, "session_id", 300, cut=50)) == rows_of(M.ttl_sessions(events, "session_id", 300))


def test_running_values(spark):
    """Sums and last values through segments of nulls alone, against plain Python."""
    values = [None if 100 <= k < 700 or k % 7 == 0 else k for k in range(1000)]
    rows = spark.createDataFrame([(1, k, v) for k, v in enumerate(values)], "k int, at int, v int").repartition(4)
    total, last, before, want = None, None, None, []
    for k, v in enumerate(values):
        total = v if total is None else total + (v or 0)
        last = v if v is not None else last
        want.append((1, k, v, total, last, before, None if k == 0 else True))
        before = v
    found = Scan(rows, "k", ["at"], 30).sum("total", F.col("v")).last("final", F.col("v")).lag(before=F.col("v"), there=F.lit(True)).result()
    assert sorted(map(tuple, found.collect()), key=lambda r: r[1]) == want
