import datetime as dt
import random

from pyspark.sql import functions as F

from helpers import at, rows
from pulsegrid.operators import timejoin as tj


def test_pairing_edges(spark):
    make = lambda data: spark.createDataFrame(data, "k int, t timestamp")
    a = make([(1, at(0)), (2, at(0)), (3, at(72)), (4, at(73)), (5, at(5)), (6, at(1)), (8, at(9))])
    b = make([(1, at(24)), (2, at(24.01)), (3, at(0)), (4, at(0)), (5, at(5)), (7, at(1)), (8, at(8))])
    assert rows(tj.pair_events(a, b, "k", "t")) == [(1, at(0)), (3, at(0)), (5, at(5)), (8, at(8))]


def test_pairing_against_brute_force(spark):
    rnd = random.Random(7)
    # one key holds most rows, with copies
    times = lambda n: [(0 if rnd.random() < 0.6 else rnd.randint(1, 9), at(rnd.randint(0, 2000) / 4)) for _ in range(n)]
    a, b = times(120), times(40)
    want = {}
    for k, ta in a:
        for k2, tb in b:
            if k != k2:
                continue
            gap = (tb - ta).total_seconds() / 3600
            if 0 <= gap <= 24 or -72 <= gap < 0:
                want[k] = min(want.get(k, ta), min(ta, tb))
    make = lambda data: spark.createDataFrame(data, "k int, t timestamp")
    assert rows(tj.pair_events(make(a), make(b), "k", "t")) == sorted(want.items())


def brute_assign(points, ivs, grace=6):
    out = []
    for pid, k, t in points:
        best = None
        for iid, k2, s, e in ivs:
            if k != k2:
                continue
            inside = (s - t).total_seconds() <= grace * 3600 and (t - e).total_seconds() <= grace * 3600
            cand = (not inside, abs((s - t).total_seconds()), iid)
            best = cand if best is None else min(best, cand)
        if best:
            out.append((pid, best[2], not best[0]))
    return sorted(out)


def check_assign(spark, points, ivs):
    p = spark.createDataFrame(points, "pid bigint, k int, t timestamp")
    i = spark.createDataFrame(ivs, "iid bigint, k int, s timestamp, e timestamp")
    got = tj.assign_interval(p, i, "k", "t", "iid", "s", "e")
    assert rows(got, "pid", "iid", "covered") == brute_assign(points, ivs)


def test_assign_interval_against_brute_force(spark):
    rnd = random.Random(3)
    ivs = []
    for i in range(60):
        s = rnd.randint(0, 900)
        ivs.append((i, rnd.choice([0, 0, 0, 1, 2]), at(s), at(s + rnd.choice([2, 30, 200]))))
    ivs += [(100 + i, 0, ivs[0][2], ivs[0][3]) for i in range(5)]  # copies
    points = [(i, rnd.choice([0, 0, 1, 2, 9]), at(rnd.randint(-100, 1300) + rnd.choice([0, 0.25]))) for i in range(150)]
    check_assign(spark, points, ivs)


def test_assign_interval_edges(spark):
    ivs = [(1, 0, at(100), at(110)), (2, 0, at(400), at(500)), (3, 0, at(90), at(300))]
    points = [(1, 0, at(94)), (2, 0, at(93.9)), (3, 0, at(116)), (4, 0, at(116.1)), (5, 0, at(-500)),
              (6, 0, at(350)), (7, 0, at(9000)), (8, 0, at(393))]
    check_assign(spark, points, ivs)


def test_spine_and_flags(spark):
    ivs = spark.createDataFrame(
        [(1, at(0.5), at(3.5)), (2, at(1), at(3)), (3, at(5), at(4)), (4, at(0.2), at(0.8))],
        "k int, s timestamp, e timestamp")
    grid = tj.hourly_spine(ivs, "k", "s", "e")
    assert rows(grid) == [(1, at(1)), (1, at(2)), (1, at(3)), (2, at(1)), (2, at(2)), (2, at(3))]
    runs = spark.createDataFrame(
        [(1, at(2), at(3)), (1, at(2), at(3)), (2, at(1.1), at(1.9))], "k int, s timestamp, e timestamp")
    assert rows(tj.covered_flag(grid, runs, "k", "s", "e")) == [
        (1, at(1), False), (1, at(2), True), (1, at(3), True),
        (2, at(1), False), (2, at(2), False), (2, at(3), False)]
    pts = spark.createDataFrame([(1, at(2.9)), (1, at(99)), (2, at(0.5))], "k int, t timestamp")
    assert rows(tj.bucket_flag(grid, pts, "k", "t").where("marked")) == [(1, at(2), True)]


def test_asof_fill_sees_the_past_only(spark):
    ivs = spark.createDataFrame([(1, at(10), at(60)), (2, at(0), at(2))], "k int, s timestamp, e timestamp")
    pts = spark.createDataFrame(
        [(1, 1, at(3), "a", 1.0), (2, 1, at(11), "a", 2.0), (3, 1, at(11), "a", 3.0),
         (4, 1, at(12.5), "a", 4.0), (5, 1, at(12.6), "a", None), (6, 1, at(12.7), "b", 9.0)],
        "id bigint, k int, t timestamp, n string, v double")
    grid = tj.hourly_spine(ivs, "k", "s", "e")
    got = {(r["k"], r["hour"]): (r["a"], r["b"]) for r in
           tj.asof_fill(grid, pts, "k", "t", "n", "v", ["a", "b"], "id").collect()}
    assert len(got) == 51 + 3
    assert got[(1, at(10))] == (1.0, None)
    assert got[(1, at(11))] == (3.0, None)
    assert got[(1, at(12))] == (3.0, None)
    assert got[(1, at(13))] == (4.0, 9.0)
    assert got[(1, at(60))] == (4.0, 9.0)  # carried over two day borders
    assert got[(2, at(2))] == (None, None)


def test_hourly_last_and_parts(spark):
    pts = spark.createDataFrame(
        [(1, at(1.2), 5.0), (1, at(1.7), 6.0), (1, at(1.9), None), (1, at(2), 7.0)], "k int, t timestamp, v double")
    assert rows(tj.hourly_last(pts, "k", "t", "v")) == [(1, at(1), 6.0), (1, at(2), 7.0)]
    parts = spark.createDataFrame(
        [(1, at(1), i, 2.0) for i in (1, 2, 3)] + [(1, at(2), 1, 2.0), (1, at(2), 2, 2.0), (1, at(2), 2, 2.0)],
        "k int, t timestamp, p int, v double")
    assert rows(tj.sum_parts(parts, "k", "t", "p", "v")) == [(1, at(1), 6.0)]


def test_asof_fill_starts_at_admission(spark):
    stays = spark.createDataFrame([(1, at(9.5), at(13))], "k int, s timestamp, e timestamp")
    pts = spark.createDataFrame([(1, 1, at(-90), "a", 1.0), (2, 1, at(9.4), "a", 2.0), (None, 1, at(11), "a", 3.0)],
                                "id bigint, k int, t timestamp, n string, v double")
    grid = tj.hourly_spine(stays, "k", "s", "e")
    since = stays.selectExpr("k", "s AS since")
    got = [r["a"] for r in tj.asof_fill(grid, pts, "k", "t", "n", "v", ["a"], "id", since).orderBy("hour").collect()]
    assert got == [None, 3.0, 3.0, 3.0]


def test_assign_interval_open_ends_and_ids(spark):
    ivs = [(-5, 0, at(10), None), (7, 0, at(40), at(50)), (-9, 1, at(0), None)]
    points = spark.createDataFrame([(1, 0, at(12)), (2, 0, at(45)), (3, 0, at(200)), (4, 1, at(900)), (5, 0, at(9))],
                                   "pid bigint, k int, t timestamp")
    want = {1: (-5, False), 2: (7, True), 3: (7, False), 4: (-9, False), 5: (-5, False)}
    for kind, name in (("bigint", lambda i: i), ("string", str)):
        i = spark.createDataFrame([(name(a), *rest) for a, *rest in ivs], f"iid {kind}, k int, s timestamp, e timestamp")
        got = {r["pid"]: (r["iid"], r["covered"]) for r in
               tj.assign_interval(points, i, "k", "t", "iid", "s", "e").collect()}
        assert got == {p: (name(a), c) for p, (a, c) in want.items()}


def test_assign_interval_keeps_ids_of_64_bits(spark):
    ends = [-2**63, -2**63 + 1, -10**18 - 1, -7 * 10**17, 5 * 10**17, 7 * 10**17, 10**18 + 1, 2**63 - 2, 2**63 - 1]
    ivs = [(i, k, at(10), at(20)) for k, i in enumerate(ends)]
    ivs += [(i, 100 + k, at(10 + k % 2), at(20)) for k in (0, 1) for i in ends]  # equal gaps: the smallest
    points = [(p, k, at(t)) for p, (k, t) in enumerate((k, t) for k in [*range(len(ends)), 100, 101] for t in (12, 900))]
    check_assign(spark, points, ivs)


def test_sweep_against_brute_force(spark):
    """Nested, reversed, open, long and repeated intervals, some before 1970, over several block widths."""
    rnd = random.Random(11)
    ivs = []
    for i in range(90):
        s = rnd.randint(-40, 160) + rnd.choice([0, 0.25])
        length = rnd.choice([-20, -12, -7, -1, 0, 1, 5, 30, 130, 900])
        ivs.append((rnd.randint(0, 200), rnd.choice([0, 0, 0, 1, 2]), at(s - 500_000), at(s + length - 500_000)))
    points = [(i, rnd.choice([0, 0, 1, 2, 9]), at(rnd.randint(-100, 260) + rnd.choice([0, 0.25]) - 500_000)) for i in range(250)]
    points += points[:20]
    p = spark.createDataFrame(points, "pid bigint, k int, t timestamp").withColumn("covered", F.lit("old")).withColumn("_at", F.col("pid"))
    i = spark.createDataFrame(ivs, "iid bigint, k int, s timestamp, e timestamp")
    for hours in (1, 6, 100):
        got = tj.assign_interval(p, i, "k", "t", "iid", "s", "e", block_hours=hours)
        assert rows(got, "pid", "iid", "covered") == brute_assign(points, ivs), hours
        assert got.columns == ["pid", "k", "t", "_at", "iid", "covered"]
    near = tj.assign_interval(p, i, "k", "t", "iid", "s", "e", max_gap_hours=10)
    start = {}
    for iid, k, s, _ in ivs:
        start.setdefault((iid, k), []).append(s)
    far = lambda pid, k, t, iid: min(abs((s - t).total_seconds()) for s in start[iid, k]) > 36_000
    place = {pid: (k, t) for pid, k, t in points}
    want = [r for r in brute_assign(points, ivs) if r[2] or not far(r[0], *place[r[0]], r[1])]
    assert rows(near, "pid", "iid", "covered") == want and len(want) < len(brute_assign(points, ivs))
    assert tj.assign_interval(p, i.where("false"), "k", "t", "iid", "s", "e").count() == 0
    assert tj.assign_interval(p.where("false"), i, "k", "t", "iid", "s", "e").count() == 0


def test_sweep_of_a_hot_day(spark):
    """100,000 points and 100,000 intervals of one entity in one block: no pair of them is made."""
    points = spark.range(100_000).selectExpr("id AS pid", "1 AS k", "timestamp_micros(pmod(id * 7919, 100000) * 216000) AS t")
    ivs = spark.range(100_000).selectExpr(
        "id AS iid", "1 AS k", "timestamp_micros(id * 216000) AS s",
        "timestamp_micros(id * 216000 + IF(id % 1000 = 0, 21600000000, 1000000)) AS e")
    got = tj.assign_interval(points, ivs, "k", "t", "iid", "s", "e", grace_hours=0)
    assert got.where("covered AND iid = pmod(pid * 7919, 100000)").count() == 100_000
    late = points.selectExpr("pid", "k", "t + interval 5 hours 59 minutes AS t").where("t < timestamp_micros(21600000000)")
    got = tj.assign_interval(late, ivs, "k", "t", "iid", "s", "e", grace_hours=0)
    assert got.where("covered").count() == late.count()


def test_hours_are_made_in_many_tasks(spark, monkeypatch):
    """Intervals are dealt by the hours they make, not by their bytes."""
    monkeypatch.setattr(tj, "HOURS_A_TASK", 100)
    at = dt.datetime(2024, 1, 1)
    spans = spark.createDataFrame([(k, at, at + dt.timedelta(hours=49)) for k in range(40)], "k long, a timestamp, b timestamp").coalesce(1)
    made = tj.hours_covered(spans, "k", "a", "b")
    assert made.count() == 40 * 50
    assert "REPARTITION_BY_NUM" in made._jdf.queryExecution().executedPlan().toString() and "hashpartitioning(k" in made._jdf.queryExecution().executedPlan().toString()
    assert any(", 20), REPARTITION_BY_NUM" in n for n in made._jdf.queryExecution().executedPlan().toString().split("\n"))
