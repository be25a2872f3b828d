"""Work that must not grow with the depth of a graph or pass a whole table through the driver."""

import datetime as dt
import json
import os
import pathlib
import random
import re
import shutil

import pytest
from pyspark.sql import functions as F

from opsframe import suite
from opsframe.operators import calendar, graph, reach, reports
from opsframe.plans import storage
from opsframe.streaming import feeds


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tasks(spark):
    """Tasks of an hour rule, every third a member of workflow 3; with links i -> i + 1."""
    conf = json.dumps({"periodType": "1", "beginHour": 1, "beginMin": 5, "endHour": 23, "gapHour": 6, "selfReliance": 1,
                       "beginDate": "1991-01-01", "endDate": "2121-01-01"})
    rows = [(i, i, f"t{i}", conf, 0, 1, 10 if i == 3 else 0, 3 if i % 3 == 1 else 0) for i in range(1, 13)]
    return spark.createDataFrame(
        rows, "id long, task_id long, name string, schedule_conf string, is_deleted int, submit_status int, task_type int, flow_id long").select(
        "*", F.lit(1).alias("version_id"), F.lit(1).alias("project_id"), F.lit(1).alias("app_type"))


@pytest.fixture(scope="module")
def links(spark):
    return spark.createDataFrame([(i + 1, i) for i in range(1, 12)], "task_id long, parent_task_id long")


DAY = dt.date(1998, 3, 15)


def test_aligned_parents_are_not_broadcast(tasks, links):
    rows = calendar.align_parent(calendar.plan_day(tasks, DAY), links, tasks)
    assert "Broadcast" not in plan(rows)
    assert rows.count() == 11 * 4


def test_parent_edges_are_not_broadcast(tasks, links):
    rows = calendar.parent_edges(calendar.plan_day(tasks, DAY), links, tasks, calendar.plan_day(tasks, dt.date(1998, 3, 14)))
    assert "Broadcast" not in plan(rows)
    assert rows.count() == 11 * 4


def test_self_edges_are_not_broadcast(tasks):
    rows = calendar.self_edges_of(calendar.plan_day(tasks, DAY), tasks, calendar.plan_day(tasks, dt.date(1998, 3, 14)))
    assert "Broadcast" not in plan(rows)
    assert rows.count() == 12 * 4


def test_backfill_and_flows_are_not_broadcast(tasks, links):
    rows, edges = calendar.plan_backfill(tasks, links, dt.date(1998, 3, 14), dt.date(1998, 3, 15), "refill", 7, dt.date(1998, 4, 1))
    assert "Broadcast" not in plan(rows) + plan(edges)
    # tasks 2 to 12, and task 1 as a member of workflow 3
    assert (rows.count(), edges.count()) == (12 * 8, 11 * 8)
    found, entry = calendar.attach_flows(calendar.plan_day(tasks, DAY), links, tasks)
    assert "Broadcast" not in plan(found) + plan(entry)
    assert found.where("flow_job_id <> '0'").count() == 4 * 4


def counted(monkeypatch, *modules):
    seen, plain = [], storage.write_step
    for m in modules:
        monkeypatch.setattr(m, "write_step", lambda df, name="step": seen.append(name) or plain(df, name))
    return seen


def test_tangled_strands_take_few_rounds(spark, monkeypatch):
    # two strands with ways over in both directions and one way back: no node has a single edge, so nothing but the ends can be trimmed
    pairs = [e for k in range(24) for e in ((2 * k, 2 * k + 2), (2 * k + 1, 2 * k + 3), (2 * k, 2 * k + 3), (2 * k + 1, 2 * k + 2))] + [(30, 20)]
    seen = counted(monkeypatch, storage)
    got = {r["node"]: r["component"] for r in reach.strong_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert {n for n, c in got.items() if c == 20} == {20, *range(22, 31)} and len(got) == 50
    assert len(seen) < 70


def test_bypassed_graphs_keep_their_components(spark):
    from test_reach import parts
    rng = random.Random(8)
    for n, m in ((30, 60),):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        df = spark.createDataFrame(pairs, "a long, b long")
        assert {r["node"]: r["component"] for r in reach.strong_components(df, "a", "b").collect()} == parts(pairs)


def first_levels(pairs, roots):
    out = {}
    for r in roots:
        level, front = {r: 0}, [r]
        while front:
            front = list({b for a, b in pairs if a in front and b not in level})
            level.update(dict.fromkeys(front, max(level.values()) + 1))
        out.update({(r, n): d for n, d in level.items()})
    return out


@pytest.mark.parametrize("levels", [None, 20])
def test_a_large_table_is_walked_along_its_chains(spark, monkeypatch, levels):
    chain = [(k, k + 1) for k in range(70)] + [(3, 30), (30, 31), (40, 200), (200, 201), (201, 60), (70, 65)]
    ring = [(100, 101), (101, 102), (102, 100), (5, 5)]
    rng = random.Random(4)
    loose = [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(50)]
    pairs, roots = chain + ring + loose, [0, 12, 101, 300, 301, 310, 999]
    seen = counted(monkeypatch, storage, graph)
    df = spark.createDataFrame([*pairs, (None, 1), (1, None)], "a long, b long")
    got = graph.walk(df, spark.createDataFrame([(r,) for r in roots], "root long"), "a", "b", levels, broadcast_edges=0).collect()
    want = {k: d for k, d in first_levels(pairs, roots).items() if levels is None or d <= levels}
    assert {(r["root"], r["node"]): r["level"] for r in got} == want and len(got) == len(want)
    assert levels or len(seen) < 40


def test_alerts_are_spread_whatever_the_files(spark):
    alarms = spark.createDataFrame([(k, f"j{k}", k % 2, 1.5) for k in range(6)], "alarm_id long, job_id string, channel_group long, value double").coalesce(1)
    channels = spark.createDataFrame([(1, 1, 0), (2, 3, 0), (3, 4, 1)], "channel_id int, gate_type int, channel_group long")
    people = spark.createDataFrame([(7, 0), (8, 0)], "user_id long, channel_group long")
    out = feeds.build_alerts(alarms, channels, people, "job ${job}", {"job": F.col("job_id")})
    assert "RoundRobinPartitioning" in plan(out)
    assert sorted((r["alarm_id"], r["channel_id"], r["user_id"]) for r in out.collect()) == sorted(
        [(a, c, u) for a in (0, 2, 4) for c, u in ((1, 7), (1, 8), (2, -1))] + [(a, 3, -1) for a in (1, 3, 5)])


def bytes_of(files):
    return sum(os.path.getsize(f.removeprefix("file://")) for f in files)


def alert_tables(spark, folder, alarms, people):
    """Base tables with that many alarms, a third of the events, and receivers with ids in no order."""
    ids = random.Random(7).sample(range(10 ** 9), people)
    ts = dt.datetime(2024, 1, 1)
    for name, rows, schema in (
        ("events", [(k, ts, k % 70, "view" if k % 3 else "error", 1.0 + k % 9, "") for k in range(3 * alarms)],
         "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"),
        ("nation", [(k, f"n{k}", k % 5) for k in range(25)], "n_nationkey int, n_name string, n_regionkey int"),
        ("supplier", [(k, f"s{k}", 0, 0.0) for k in ids], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/parts/{name}")
        shutil.copy(next(pathlib.Path(folder, "parts", name).glob("*.parquet")), f"{folder}/{name}.parquet")  # a stream looks for files
    groups = [sum(k % 4 == g for k in ids) for g in range(4)] + [0]
    return sum(1 if c % 4 == 2 else (groups[c % 5] or int(c % 4 == 3)) for k in range(0, 3 * alarms, 3) for c in range(25) if c % 5 == k % 5)


@pytest.mark.parametrize("name", ["j06_build_alerts", "j06_build_alerts_stream"])
def test_alert_files_stay_small(spark, tmp_path, name):
    """Every record is written, but a list of receivers that comes again for each alarm takes next to no room."""
    suite.load()
    rows = alert_tables(spark, str(tmp_path), 600, 8000)
    out = suite.QUERIES[name](spark, str(tmp_path))
    if name.endswith("_stream"):
        files = out.inputFiles()  # what the sink wrote
    else:
        out.write.parquet(f"{tmp_path}/out")
        files = spark.read.parquet(f"{tmp_path}/out").inputFiles()
    assert out.count() == rows and rows > 2_000_000
    assert bytes_of(files) < 0.6 * rows
    assert out.groupBy("alarm_id", "channel_id", "user_id").count().where("count > 1").isEmpty()


@pytest.mark.parametrize("size", [None, 9, 0, 10_000])
def test_alerts_of_odd_rows(spark, size):
    alarms = [(1, "a", 0, 1.0), (1, "a", 0, 1.0), (None, "b", 0, 2.0), (2, None, 1, 3.0), (3, "c", None, 4.0), (4, "d", 2, None), (5, "e", 9, 5.0), (6, "f", 3, 6.0)]
    channels = [(1, 1, 0), (2, 3, 0), (3, 4, 0), (3, 4, 0), (4, None, 0), (None, 2, 1), (5, 4, 1), (6, 1, 2), (7, 4, 2), (8, 2, None), (9, 4, 3), (10, 3, 3)]
    people = [(7, 0), (7, 0), (None, 0), (8, None), (None, 1), *[(k, 3) for k in range(300)]]
    df = spark.createDataFrame(alarms, "alarm_id long, job_id string, channel_group long, value double")
    out = feeds.build_alerts(df, spark.createDataFrame(channels, "channel_id int, gate_type int, channel_group int"),
                             spark.createDataFrame(people, "user_id int, channel_group int"), "${job}: ${v}",
                             {"job": F.col("job_id"), "v": F.floor("value").cast("string")}, ["value"], size)
    want = []
    for a, j, g, v in alarms:
        for c, gate, cg in channels:
            if g is None or cg != g:
                continue
            found = [u for u, ug in people if ug == g and gate not in (3, None)] or [None]
            users = [u if u is not None else -1 if gate in (3, 4) else None for u in found]
            want += [(a, c, gate, u, j, f"{j or ''}: {'' if v is None else int(v)}", v) for u in users if u is not None]
    got = [(r["alarm_id"], r["channel_id"], r["gate_type"], r["user_id"], r["job_id"], r["content"], r["value"]) for r in out.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert dict(out.dtypes)["user_id"] == "bigint" and out.columns[-2:] == ["is_deleted", "value"]


def test_fan_out_sends_one_alarm_of_each_group(spark, tmp_path):
    ts = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(k, ts, k, "error" if k % 3 else "view", 1.0, "") for k in range(60)],
                          "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(k, f"n{k}", k % 5) for k in range(25)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(k, f"s{k}", 0, 0.0) for k in range(12)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(
        f"{tmp_path}/supplier.parquet")
    suite.load()
    out = suite.QUERIES["c15_channel_fan_out"](spark, str(tmp_path))
    # eight alarms of each group; three receivers in groups 0 to 3, none in 4; gates 1 to 4, a chat takes no receivers
    want = {c: 8 * n for c in range(25) if (n := 1 if c % 4 == 2 else (3 if c % 5 < 4 else int(c % 4 == 3)))}
    assert {r["channel_id"]: r["n"] for r in out.collect()} == want
    assert re.search(r"HashAggregate\(keys=\[channel_group", plan(out))


def test_limits_are_read_once(spark):
    tasks = spark.createDataFrame([(1, 1, "driver.memory=3g"), (2, 1, "driver.memory=1g"), (3, 2, "driver.memory=9g")], "task_id int, project_id int, task_params string")
    limits = spark.createDataFrame([(1, '{"driver.memory": 2048}')], "project_id int, resource_limit string")
    out = reports.over_limit(tasks, limits)
    assert plan(out).count("get_json_object") == len(reports.SPARK_KEYS)
    assert [(r["task_id"], r["messages"]) for r in out.collect()] == [(1, ["driverMemory: 3g (限制: 2048)"])]
