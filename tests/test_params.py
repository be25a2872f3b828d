"""Values of the time parameters, by hand."""

import pytest
from pyspark.sql import functions as F

from opsframe.functions import params

CYC, NOW = "20240131103000", "20240205111213"

CUSTOM = {
    "$[yyyyMMdd-7*2]": "20240117", "$[hh24miss-1/24]": "20240131093000", "$[hh24miss+5/24/60]": "20240131103500",
    "$[add_months(yyyyMMdd,1)]": "20240229", "$[add_months(yyyyMM,12*-1)]": "202301", "$[yyyyMMdd-1,'-']": "2024-01-30",
    "$[format(yyyyMMdd-1d,'yyyy/MM/dd')]": "2024/01/30", "${yyyyMMdd}": "20240130", "$[yyyyMM]": "202401",
    "$(yyyyMMdd)": "20240205", "${bdp.system.currenttime}": NOW, "plain text": "plain text",
    "$[format(yyyyMMddHHmmss+1d,'UnixTimestamp10')]": "1706783400", "$[add_months(yyyy,-3)]": "2021",
    "$[format(yyyyMMdd+1M,'yyyyMMdd')]": "20240229", "$[yyyyMMdd+7*-1]": "20240124",
    "$[nonsense]": None, "$[yyyyMMdd-5*3]": None, "$[add_months(yyyyMM,5*2)]": None, "$[format(yyyy)]": None,
}
SYSTEM = {"yyyyMMdd": "20240131", "yyyyMM-1": "202312", "yyyy-MM-dd,-1": "2024-01-30", "yyyy-MM-dd,+1": "2024-02-01",
          "yyyyMMddHHmmss": CYC, " ": "", "yyyy+1": "2025", "yyyyMMdd - 31": "20231231", "what": None, "yyyyMMddHH-1": "2024013010"}


def test_columns_of_commands(spark):
    rows = [(0, f"s{i}", c, v) for i, (c, v) in enumerate(SYSTEM.items())]
    rows += [(1, f"c{i}", c, v) for i, (c, v) in enumerate(CUSTOM.items())]
    rows.append((0, "bdp.system.runtime", "${bdp.system.currenttime}", NOW))
    rows = [r for r in rows if r[2] != "yyyyMMddHH-1"]
    df = spark.createDataFrame(rows, "type int, param_name string, param_command string, want string")
    out = params.resolve_params(df, F.lit(CYC), F.lit(NOW)).collect()
    assert {r["param_command"]: r["value"] for r in out} == {r["param_command"]: r["want"] for r in out}


def test_literal_commands_agree(spark):
    commands = {f"p{i}": (1, c) for i, c in enumerate(CUSTOM)}
    commands.update({f"q{i}": (0, c) for i, c in enumerate(SYSTEM) if c != "yyyyMMddHH-1"})
    df = spark.createDataFrame([(CYC,)], "cyc string")
    row = params.add_params(df, commands, F.col("cyc"), F.lit(NOW)).first()
    for name, (kind, command) in commands.items():
        assert row[name] == (SYSTEM if kind == 0 else CUSTOM)[command], command


def test_column_form(spark):
    df = spark.createDataFrame([(CYC, "$[yyyyMMdd-1]")], "cyc string, cmd string")
    row = df.select(params.custom_param(F.col("cmd"), F.col("cyc"), F.lit(NOW)).alias("a"),
                    params.sys_param("yyyyMM-1", F.col("cyc")).alias("b")).first()
    assert (row["a"], row["b"]) == ("20240130", "202312")


def test_invalid_raises_on_request(spark):
    df = spark.createDataFrame([(CYC,)], "cyc string")
    with pytest.raises(Exception, match="illegal command"):
        params.add_params(df, {"p": (1, "$[nonsense]")}, F.col("cyc"), F.lit(NOW), on_error="raise").collect()


def test_render_only_listed_names(spark):
    df = spark.createDataFrame([("a ${x} ${y} $x", {"x": "1"}), ("none", {"x": "1"})], "t string, m map<string,string>")
    assert [r[0] for r in df.select(params.render(F.col("t"), F.col("m"))).collect()] == ["a 1 ${y} $x", "none"]
