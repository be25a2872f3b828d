"""Rules, closed-form triggers against brute force, and readiness."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from opsframe.operators import calendar, readiness

BASE = {"beginDate": "2001-01-01", "endDate": "2121-01-01"}
RULES = [
    {"periodType": "0", "beginHour": 1, "beginMin": 10, "endHour": 22, "endMin": 5, "gapMin": 47},
    {"periodType": "1", "beginHour": 3, "endHour": 20, "beginMin": 15, "gapHour": 4},
    {"periodType": "2", "hour": 6, "min": 30}, {"periodType": "3", "weekDay": "02,5", "hour": 23, "min": 0},
    {"periodType": 4, "day": "31", "hour": 0, "min": 23}, {"periodType": "4", "day": "1,15,30", "hour": 12, "min": 0},
    {"periodType": "3", "weekDay": 3, "hour": 0, "min": 0},
]


def brute(rule, day):
    p = int(rule["periodType"])
    if p == 0:
        m = range(rule["beginHour"] * 60 + rule["beginMin"], rule["endHour"] * 60 + rule["endMin"] + 1, rule["gapMin"])
    elif p == 1:
        m = [h * 60 + rule["beginMin"] for h in range(rule["beginHour"], rule["endHour"] + 1, rule["gapHour"])]
    else:
        m = [rule["hour"] * 60 + rule["min"]]
        if p == 3 and day.isoweekday() not in [int(x) for x in str(rule["weekDay"]).split(",")]:
            m = []
        if p == 4 and day.day not in [int(x) for x in str(rule["day"]).split(",")]:
            m = []
    return [dt.datetime.combine(day, dt.time()) + dt.timedelta(minutes=x) for x in m]


@pytest.fixture(scope="module")
def tasks(spark):
    rows = [(i, json.dumps({**BASE, **r})) for i, r in enumerate(RULES)]
    return spark.createDataFrame(rows, "task_id int, schedule_conf string").select(
        "task_id", F.col("task_id").alias("id"), "schedule_conf", F.lit(0).alias("is_deleted"),
        F.lit(1).alias("submit_status"), F.lit(1).alias("version_id"), F.lit(0).alias("task_type"),
        F.lit(1).alias("project_id"), F.lit(1).alias("app_type"), F.lit(0).alias("flow_id"),
        F.concat(F.lit("n"), F.col("task_id").cast("string")).alias("name"))


def test_expand(tasks):
    first, last = dt.date(2024, 1, 28), dt.date(2024, 3, 3)
    got = {}
    for r in calendar.expand(calendar.parse_rules(tasks), first, last).collect():
        got.setdefault(r["task_id"], []).append(r["trigger"])
    days = [first + dt.timedelta(days=i) for i in range((last - first).days + 1)]
    for i, rule in enumerate(RULES):
        assert sorted(got.get(i, [])) == [t for d in days for t in brute(rule, d)]


def test_last_and_previous_trigger(spark, tasks):
    moments = [dt.datetime(2024, 2, 27) + dt.timedelta(minutes=97 * i) for i in range(120)]
    moments += [t for d in (dt.date(2024, 3, 1), dt.date(2024, 3, 5)) for r in RULES for t in brute(r, d)]
    rows = calendar.parse_rules(tasks).crossJoin(
        spark.createDataFrame([(m,) for m in moments], "m timestamp_ntz"))
    out = rows.select("task_id", "m", calendar.last_trigger("rule", "m").alias("at"),
                      calendar.trigger_before("rule", "m").alias("before")).collect()
    every = {i: [t for k in range(100, -20, -1) for t in brute(rule, dt.date(2024, 3, 1) - dt.timedelta(days=k))]
             for i, rule in enumerate(RULES)}
    for row in out:
        times = every[row["task_id"]]
        assert row["at"] == max((t for t in times if t <= row["m"]), default=None)
        assert row["before"] == max((t for t in times if t < row["m"]), default=None)


def test_bad_rules(spark):
    docs = ["", "x", "{}", '{"periodType":"9","beginDate":"2001-01-01","endDate":"2002-01-01"}',
            '{"periodType":"0","beginDate":"2001-01-01","endDate":"2002-01-01","beginHour":0,"endHour":1,"beginMin":0}']
    rows = calendar.parse_rules(spark.createDataFrame([(d,) for d in docs], "schedule_conf string")).collect()
    assert all(r["rule_error"] for r in rows)
    assert rows[2]["rule_error"] == "periodType is missing"
    good = {"selfReliance": 3, "maxRetryNum": "3", **BASE, **RULES[2]}
    row = calendar.parse_rules(spark.createDataFrame([(json.dumps(good),)], "schedule_conf string")).first()
    assert row["rule_error"] is None and (row["rule"]["self_reliance"], row["rule"]["max_retry"]) == (3, 3)


def test_backfill_checks_its_input(spark, tasks):
    tree = spark.createDataFrame([(2, None)], "task_id int, parent_task_id int")
    day = dt.date(2024, 1, 1)
    with pytest.raises(ValueError):
        calendar.plan_backfill(tasks, tree, day, day, "a-b", 1, dt.date(2024, 2, 1))
    with pytest.raises(ValueError):
        calendar.plan_backfill(tasks, tree, day, day, "ab", 1, day)
    rows, edges = calendar.plan_backfill(tasks, tree, day, day, "ab", 1, dt.date(2024, 2, 1))
    assert [r["job_key"] for r in rows.collect()] == ["fillData_ab_2_20240102063000"] and edges.count() == 0


def _instances(spark, rows):
    df = spark.createDataFrame(rows, "task_id int, day int, status int, dependency_type int")
    ts = F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.col("day"), F.lit(6), F.lit(30), F.lit(0))
    cyc = F.date_format(ts, "yyyyMMddHHmmss")
    return df.select(
        (F.col("task_id") * 100 + F.col("day")).alias("id"), "task_id", "status", "dependency_type", ts.alias("cyc_ts"),
        cyc.alias("cyc_time"), F.concat(F.lit("cronTrigger_"), F.col("task_id").cast("string"), F.lit("_"), cyc).alias("job_key"),
        F.lit(0).alias("type"), F.lit("0").alias("flow_job_id"), F.lit(0).alias("task_type"), F.lit(1).alias("compute_type"),
        F.lit(0).alias("is_restart"), F.lit(None).cast("string").alias("next_cyc_time"))


def _key(task, day):
    return f"cronTrigger_{task}_202401{day:02d}063000"


def test_child_period_rules(spark, tasks):
    daily = json.dumps({**BASE, **RULES[2]})
    defs = spark.createDataFrame([(i, i, daily, 0) for i in range(1, 9)],
                                 "task_id int, id int, schedule_conf string, is_deleted int")
    # parent tasks 1..4 wait for the day before of their children 5..8
    jobs = _instances(spark, [
        (1, 3, 0, 2), (5, 3, 0, 0), (5, 2, 5, 0),            # child's day before succeeded
        (2, 3, 0, 2), (6, 3, 0, 0), (6, 2, 7, 0),            # ended without success: mode 2 blocks
        (3, 3, 0, 4), (7, 3, 0, 0), (7, 2, 7, 0),            # ended: mode 4 is content
        (4, 3, 0, 4), (4, 2, 5, 4), (4, 1, 5, 4), (8, 1, 4, 0)])  # no children: walks back to day 1, still running
    edges = spark.createDataFrame(
        [(_key(5, 3), _key(1, 3)), (_key(6, 3), _key(2, 3)), (_key(7, 3), _key(3, 3)), (_key(8, 1), _key(4, 1))],
        "job_key string, parent_job_key string")
    got = {r["job_key"]: r["outcome"] for r in readiness.readiness(
        jobs, edges, defs, dt.datetime(2024, 1, 3, 12)).collect()}
    assert got[_key(1, 3)] == 0 and got[_key(2, 3)] == 15 and got[_key(3, 3)] == 0 and got[_key(4, 3)] == 13
    # the children themselves wait for their parents
    assert got[_key(5, 3)] == 2
    assert got[_key(5, 2)] == 7
