import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from eventmill.operators.sessions import sessionize

BASE = datetime(2024, 1, 1)


def test_sessions_match_a_scan_of_sorted_events(spark):
    rng = random.Random(11)
    rows = []
    for i in range(4000):
        user = 1 if rng.random() < 0.35 else rng.randrange(2, 20)
        ts = BASE + timedelta(seconds=rng.randrange(20 * 86400), microseconds=rng.randrange(10**6))
        rows.append((i, user, ts, rng.choice(["page_view", "purchase", "error"]), 1.0))
    # exactly the gap apart stays together, one microsecond more does not
    rows += [(5000, 99, BASE, "error", None), (5001, 99, BASE + timedelta(minutes=30), "error", None)]
    rows += [(5002, 98, BASE, "error", None), (5003, 98, BASE + timedelta(minutes=30, microseconds=1), "error", None)]
    df = spark.createDataFrame(rows, "event_id long, customer_id long, event_ts timestamp, event_type string, amount double")
    got = {
        (r.customer_id, r.session_no): (r.session_start, r.session_end, r.events)
        for r in sessionize(df).collect()
    }
    want = {}
    by_user = {}
    for r in rows:
        by_user.setdefault(r[1], []).append(r[2])
    for user, times in by_user.items():
        no, last = 0, None
        for ts in sorted(times):
            if last is None or ts - last > timedelta(minutes=30):
                no += 1
                want[(user, no)] = (ts, ts, 0)
            s, _, n = want[(user, no)]
            want[(user, no)] = (s, ts, n + 1)
            last = ts
    assert got == want
    assert sum(1 for k in got if k[0] == 99) == 1 and sum(1 for k in got if k[0] == 98) == 2


def test_no_events_no_sessions(spark):
    empty = spark.createDataFrame([], "event_id long, customer_id long, event_ts timestamp, event_type string, amount double")
    assert sessionize(empty).agg(F.count("*")).first()[0] == 0
