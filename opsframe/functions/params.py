"""The time-parameter mini language as column expressions.

A command is first read into a small struct, its *spec*: which base time, how far
to move it, which pattern to print. Reading does not see the data. In a DataFrame
it is spread over a few projections, so that each piece is written once: literal
commands fold to constants, and a parameter table is read once per row of its own.
Applying a spec to a 14-digit cycle time is one addition and one ``date_format``.
"""

from __future__ import annotations

from collections.abc import Generator, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAMP = "yyyyMMddHHmmss"

# Patterns that may stand alone between the brackets.
PLAIN_PATTERNS = [
    "yyyy", "MM", "dd", "HH", "hh", "hh24", "mm", "ss", "yyyyMM", "yyyyMMdd", "yyyyMMddHH", "yyyyMMddHHmm",
    "yyyyMMddHHmmss", "yyyyMMddhh24", "yyyyMMddhh24mm", "yyyyMMddhh24mmss", "HH:mm:ss", "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-d", "yyyy-MM-dd",
]

_ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"
_SECONDS, _MILLIS = "UnixTimestamp10", "UnixTimestamp13"
_UNITS = ("years", "months", "days", "hours", "mins", "secs")
_CYCLE, _DAY_BEFORE, _NOW, _NOW_TEXT = 0, 1, 2, 3


def _number(text: Column) -> Column:
    return F.trim(text).try_cast("int")


def _part(parts: Column, i: int) -> Column:
    return F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit(""))


def _bare(text: Column) -> Column:
    return F.trim(F.replace(text, F.lit("'"), F.lit("")))


def _product(text: Column, factor: int) -> Column:
    """``n`` or ``a*b`` where one of the two must be +-``factor``; null when neither is."""
    parts = F.split(text, r"\*")
    a, b = _number(parts[0]), _number(_part(parts, 2))
    allowed = (F.abs(a) == factor) | (F.abs(b) == factor)
    return F.when(~text.contains("*"), _number(text)).when(allowed, a * b)


def _spaced(pattern: Column, separator: Column) -> Column:
    """The pattern with a quoted separator wherever its letter changes."""
    quoted = F.concat(F.lit("$1'"), F.regexp_replace(separator, r"([\\$])", r"\\$1"), F.lit("'"))
    return F.when(separator == "", pattern).otherwise(F.regexp_replace(pattern, F.lit(r"(.)(?!\1)(?=.)"), quoted))


def _spec(base: Column, pattern: Column, constant: Column, **units: Column) -> Column:
    zero = F.lit(0)
    return F.struct(
        base.cast("int").alias("base"), pattern.alias("pattern"), constant.alias("constant"),
        *[units.get(u, zero).cast("int").alias(u) for u in _UNITS])


Pieces = Mapping[str, Column]
# A reader yields named sub-expressions, gets references to them back, and returns the spec.
Reader = Generator[dict[str, Column], Pieces, Column]


def _let(reader: Reader, given: Pieces | None = None) -> Column:
    """Runs a reader inside one column expression; the pieces become variables of a lambda."""
    try:
        pieces = reader.send(given)
    except StopIteration as done:
        return done.value
    row = F.array(F.struct(*[c.alias(n) for n, c in pieces.items()]))
    return F.element_at(F.transform(row, lambda r: _let(reader, {n: r[n] for n in pieces})), 1)


def _staged(df: DataFrame, readers: Mapping[str, Reader]) -> tuple[DataFrame, dict[str, Column]]:
    """Runs readers side by side over projections; the pieces of one step become columns of one projection."""
    given: dict[str, Pieces | None] = dict.fromkeys(readers)
    specs, step = {}, 0
    while len(specs) < len(readers):
        step += 1
        added = {}
        for name, reader in readers.items():
            if name in specs:
                continue
            try:
                pieces = reader.send(given[name])
            except StopIteration as done:
                specs[name] = done.value
                continue
            names = {n: f"_{step}_{name}_{n}" for n in pieces}
            added.update({names[n]: c for n, c in pieces.items()})
            given[name] = {n: F.col(c) for n, c in names.items()}
        if added:
            df = df.withColumns(added)
    return df, specs


def _read_custom(command: Column) -> Reader:
    square = command.startswith("$[") & command.endswith("]")
    curly = command.startswith("${") & command.endswith("}")
    round_ = command.startswith("$(") & command.endswith(")")
    top = yield {
        "line": F.trim(
            F.when(square, F.regexp_extract(command, r"^\$\[(.*?)\]", 1))
            .when(curly, F.regexp_extract(command, r"^\$\{(.*?)\}", 1))
            .when(round_, F.regexp_extract(command, r"^\$\((.*)\)$", 1)).otherwise(F.lit(""))),
        "kind": F.when(square, _CYCLE).when(curly, _DAY_BEFORE).when(round_, _NOW).otherwise(-1),
    }
    line, kind = top["line"], top["kind"]
    # format(base ± n unit, 'out'): the parts between quotes, then the number within the first argument
    quotes = F.split(line, "'")
    # base ± amount [, 'separator']: one of two bases, a sign, the amount
    body = F.substring_index(line, ",", 1)
    cut = yield {"line": line, "kind": kind, "call": F.regexp_replace(quotes[0], r"\s", ""), "quotes": F.size(quotes), "text": _part(quotes, 2),
                 "body": body, "stem": F.substr(body, F.lit(1), F.lit(8)), "behind": F.ltrim(F.substr(body, F.lit(9)))}
    line, kind, body, stem, behind, text = (cut[n] for n in ("line", "kind", "body", "stem", "behind", "text"))
    signed = stem.isin("yyyyMMdd", "hh24miss") & (behind.startswith("-") | behind.startswith("+"))
    first = yield {"inner": F.substr(cut["call"], F.lit(len("format(") + 1), F.greatest(F.length(cut["call"]) - len("format(,"), F.lit(0)))}
    inner = first["inner"]
    number = yield {"digits": F.regexp_extract(inner, "[0-9]+", 0)}
    digits = number["digits"]
    spot = yield {"place": F.when(digits == "", F.length(inner)).otherwise(F.instr(inner, digits))}
    sides = yield {"front": F.substr(inner, F.lit(1), spot["place"] - 1), "unit": F.substr(inner, spot["place"] + F.length(digits))}
    front, unit_ = sides["front"], sides["unit"]
    fits = yield {"formed": (
        F.lower(cut["call"]).startswith("format(") & cut["call"].endswith(",") & (cut["quotes"] > 2) & F.lower(text).rlike(r"^[0-9a-z:\s/-]+$")
        & F.lower(F.rtrim(front, F.lit("+"))).rlike("^[a-z:-]+$") & F.lower(unit_).rlike("^[a-z]+$"))}
    formed = fits["formed"]
    # add_months(format, n [, 'separator'])
    args = F.split(F.regexp_extract(line, r"\(([^)]*)\)", 1), ",")
    t = yield {
        "is_format": line.startswith("format"), "is_months": line.startswith("add_months"),
        "plus": formed & front.endswith("+") & ~front.endswith("++"),
        "size": F.when(formed, F.coalesce(_number(digits), F.lit(0))).otherwise(0),
        "unit": F.when(formed, unit_).otherwise(""), "out": F.when(formed, text).otherwise(""),
        "month_fmt": F.trim(_part(args, 1)), "month_n": F.regexp_replace(_part(args, 2), r"\s", ""),
        "month_sep": _bare(_part(args, 3)), "body": body, "sep": _bare(_part(F.split(line, ","), 2)),
        "head": F.when(signed, stem).otherwise(""), "flip": F.when(behind.startswith("-"), -1).otherwise(1),
        "rest": F.when(signed, F.regexp_replace(F.substr(behind, F.lit(2)), r"\s", "")).otherwise(""),
    }
    slashes = F.split(t["rest"], "/")
    clock, count = t["head"] == "hh24miss", _number(_part(slashes, 1)) * t["flip"]
    u = yield {
        # only an explicit '+' adds
        "moved": F.when(t["plus"], t["size"]).otherwise(-t["size"]),
        "years": F.when(t["month_fmt"] == "yyyy", _number(F.substring_index(t["month_n"], "*", 1))),
        "months": F.when(t["month_fmt"].isin("yyyyMMdd", "yyyyMM"), _product(t["month_n"], 12)),
        "by_day": F.when(t["head"] == "yyyyMMdd", _product(t["rest"], 7) * t["flip"]),
        "by_hour": F.when(clock & (F.size(slashes) == 2), count),
        "by_minute": F.when(clock & (F.size(slashes) == 3), count),
        "name": F.lower(F.trim(t["out"])),
    }
    zero = F.lit(0)

    def pick(in_format: Column, in_months: Column, otherwise: Column) -> Column:
        return F.coalesce(
            F.when(t["is_format"], in_format).when(t["is_months"], in_months).otherwise(otherwise), zero)

    def unit(letter: str) -> Column:
        return F.when(t["unit"] == letter, u["moved"])

    out = F.when(u["name"] == "isodate", F.lit(_ISO)).when(u["name"] == _SECONDS.lower(), F.lit(_SECONDS)).when(
        u["name"] == _MILLIS.lower(), F.lit(_MILLIS)).when(t["out"] != "", t["out"])
    plain = (
        F.when(t["head"] == "yyyyMMdd", F.when(u["by_day"].isNotNull(), F.lit("yyyyMMdd")))
        .when(t["head"] == "hh24miss", F.when(F.coalesce(u["by_hour"], u["by_minute"]).isNotNull(), F.lit(STAMP)))
        .when(t["body"].isin(PLAIN_PATTERNS), F.replace(t["body"], F.lit("hh24"), F.lit("HH")))
    )
    in_months = F.when(F.coalesce(u["years"], u["months"]).isNotNull(), t["month_fmt"])
    spaced = _spaced(F.when(t["is_months"], in_months).otherwise(plain),
                     F.when(t["is_months"], t["month_sep"]).otherwise(t["sep"]))
    return _spec(
        F.when((line == "bdp.system.currenttime") & (kind == _DAY_BEFORE), _NOW_TEXT).otherwise(kind),
        F.when(t["is_format"], out).otherwise(spaced), F.when(kind < 0, command),
        years=pick(unit("y"), u["years"], zero), months=pick(unit("M"), u["months"], zero),
        days=pick(F.when(t["unit"] == "w", u["moved"] * 7).otherwise(unit("d")), zero, u["by_day"]),
        hours=pick(unit("H"), zero, u["by_hour"]), mins=pick(unit("m"), zero, u["by_minute"]),
        secs=pick(F.when(~t["unit"].isin(*"yMdHmw"), u["moved"]), zero, zero))


def custom_spec(command: Column) -> Column:
    """Custom parameter: ``$[…]`` on the cycle, ``${…}`` on the day before, ``$(…)`` on now; other text is itself."""
    return _let(_read_custom(command))


def _read_system(command: Column) -> Reader:
    pieces = yield {"command": F.trim(command)}
    command = pieces["command"]
    halves = F.split(command, ",")
    comma = F.size(halves) == 2
    second = _part(halves, 2)
    # letters, a sign, digits
    stage = yield {"command": command, "halves": halves, "packed": F.regexp_replace(command, r"\s", "")}
    command, halves, packed = stage["command"], stage["halves"], stage["packed"]
    comma, second = F.size(halves) == 2, _part(halves, 2)
    word = yield {"letters": F.regexp_extract(packed, "^[a-zA-Z]+", 0)}
    letters = word["letters"]
    mark = F.substr(packed, F.length(letters) + 1, F.lit(1))
    digits = F.regexp_extract(F.substr(packed, F.length(letters) + 2), "^[0-9]+", 0)
    bare = F.length(letters).between(4, 14) & mark.isin("-", "+") & (digits != "")
    t = yield {
        "whole": command.isin(STAMP, "yyyyMMdd"),
        "fmt": F.when(comma, halves[0]).when(bare, letters).otherwise(""),
        "sign": F.when(comma, F.substring(second, 1, 1)).when(bare, mark).otherwise(""),
        "digits": F.when(comma, second.substr(F.lit(2), F.length(second))).when(bare, digits).otherwise(""),
    }
    count = F.when(t["sign"] == "-", -_number(t["digits"])).when(t["sign"] == "+", _number(t["digits"]))
    u = yield {"n": count, "size": F.length(t["fmt"])}

    def unit(*sizes: int) -> Column:
        return F.when(~t["whole"] & u["size"].isin(*sizes), u["n"]).otherwise(0)

    good = u["size"].isin(4, 6, 8, 10) & u["n"].isNotNull()
    return _spec(F.lit(_CYCLE), F.when(t["whole"], command).when(good, t["fmt"]),
                 F.when(command == "", F.lit("")), years=unit(4), months=unit(6), days=unit(8, 10))


def sys_spec(command: Column) -> Column:
    """System parameter: ``yyyyMMdd-1``, ``yyyyMM+2``, ``yyyy-MM-dd,-1`` …; the length of the format gives the unit."""
    return _let(_read_system(command))


def apply_spec(spec: Column, cyc: Column, now: Column, on_error: str = "null", command: Column | None = None) -> Column:
    """Value of a spec at a cycle time; a command without meaning gives null or raises."""
    ts, moment = (F.try_to_timestamp(c, F.lit(STAMP)) for c in (cyc, now))
    zero = F.lit(0)
    base = F.when(spec["base"] == _DAY_BEFORE, ts - F.make_dt_interval(days=F.lit(1))).when(
        spec["base"] == _NOW, moment).otherwise(ts)
    at = base + F.make_interval(spec["years"], spec["months"], zero, spec["days"], spec["hours"], spec["mins"],
                                spec["secs"].cast("decimal(18,6)"))
    pattern = spec["pattern"]
    special = pattern.isin(_SECONDS, _MILLIS)
    # the pattern may differ per row, which the Python wrapper of date_format does not offer
    text = F.call_function("date_format", at, F.when(special | pattern.isNull(), F.lit(STAMP)).otherwise(pattern))
    text = (
        F.when(pattern == _SECONDS, F.unix_seconds(at).cast("string"))
        .when(pattern == _MILLIS, F.unix_millis(at).cast("string"))
        .when(pattern.isNotNull(), text)
    )
    if on_error == "raise":
        named = F.lit("illegal command") if command is None else F.concat(F.lit("illegal command "), command)
        text = F.coalesce(text, F.raise_error(named).cast("string"))
    return F.coalesce(spec["constant"], F.when(spec["base"] == _NOW_TEXT, now).otherwise(text))


def _value(spec: Column, command: Column, cyc: Column, now: Column, on_error: str) -> Column:
    def steps() -> Reader:
        t = yield {"spec": spec, "cyc": cyc, "now": now, "command": command}
        return apply_spec(t["spec"], t["cyc"], t["now"], on_error, t["command"])

    return _let(steps())


def sys_param(command: Column | str, cyc: Column, on_error: str = "null") -> Column:
    command = command if isinstance(command, Column) else F.lit(command)
    return _value(sys_spec(command), command, cyc, cyc, on_error)


def custom_param(command: Column | str, cyc: Column, now: Column, on_error: str = "null") -> Column:
    command = command if isinstance(command, Column) else F.lit(command)
    return _value(custom_spec(command), command, cyc, now, on_error)


SYSTEM, CUSTOM = 0, 1


def add_params(df: DataFrame, commands: Mapping[str, tuple[int, str]], cyc: Column, now: Column,
               on_error: str = "null") -> DataFrame:
    """Adds one column per literal command ``name -> (SYSTEM or CUSTOM, text)``.

    The commands are read in projections of their own and fold to constants, so
    per row only the date arithmetic and the formatting are left.
    """
    readers = {n: (_read_system if kind == SYSTEM else _read_custom)(F.lit(text))
               for n, (kind, text) in commands.items()}
    staged, specs = _staged(df, readers)
    staged = staged.withColumns({f"_spec_{n}": c for n, c in specs.items()})
    values = [apply_spec(F.col(f"_spec_{n}"), cyc, now, on_error, F.lit(commands[n][1])).alias(n) for n in commands]
    return staged.select(*[c for c in df.columns if c not in commands], *values)


def read_params(params: DataFrame, name: str = "spec") -> DataFrame:
    """Adds the spec to rows with (type, param_name, param_command).

    System parameters (0) are read as such, except the run time; all others as custom ones.
    """
    system = (F.col("type") == SYSTEM) & (F.col("param_name") != "bdp.system.runtime")
    command = F.col("param_command")
    staged, specs = _staged(params, {"s": _read_system(command), "c": _read_custom(command)})
    return staged.select(*params.columns, F.when(system, specs["s"]).otherwise(specs["c"]).alias(name))


def resolve_params(params: DataFrame, cyc: Column, now: Column, on_error: str = "null") -> DataFrame:
    """Adds ``value`` to rows with (type, param_name, param_command)."""
    return read_params(params, "_spec").withColumn(
        "value", apply_spec(F.col("_spec"), cyc, now, on_error, F.col("param_command"))).drop("_spec")


def render(text: Column, values: Column) -> Column:
    """Replaces ``${name}`` in ``text`` for the names of a map column; other names stay."""
    names = F.coalesce(F.map_keys(values), F.array().cast("array<string>"))
    return F.aggregate(names, text, lambda acc, name: F.replace(
        acc, F.concat(F.lit("${"), name, F.lit("}")), F.coalesce(F.element_at(values, name), F.lit(""))))


def render_tasks(runs: DataFrame, params: DataFrame, text: str, now: Column) -> DataFrame:
    """Scripts of all runs with their parameters filled in.

    ``runs`` has (task_id, cyc_time, ``text``); ``params`` has (task_id, type,
    param_name, param_command), unique by task and name. The commands are read
    once per parameter row. A task's parameters are one short list, which travels
    to the runs by one equi-join; everything else is a projection.
    """
    per_task = read_params(params).groupBy("task_id").agg(
        F.collect_list(F.struct("param_name", "spec")).alias("_params"))
    joined = runs.join(per_task, "task_id", "left")
    values = F.map_from_entries(F.transform("_params", lambda p: F.struct(
        p["param_name"].alias("key"), apply_spec(p["spec"], F.col("cyc_time"), now).alias("value"))))
    filled = F.when(F.col("_params").isNull(), F.col(text)).otherwise(render(F.col(text), values))
    return joined.withColumn("rendered", filled).drop("_params")
