"""Durations, sizes, property lists, JSON members, source and resource keys."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit texts of a duration (hour, minute, second, millisecond).
UNITS = ("小时", "分钟", "秒", "毫秒")


def duration_text(ms: Column, units: tuple[str, str, str, str] = UNITS) -> Column:
    """Milliseconds as text; zero parts are left out, null and 0 give zero seconds."""
    hour, minute, second, milli = units
    secs = F.floor(ms / 1000)

    def part(n: Column, unit: str) -> Column:
        return F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))).otherwise(F.lit(""))

    long_form = F.concat(
        part(F.floor(secs / 3600), hour), part(F.floor(secs % 3600 / 60), minute), part(secs % 60, second))
    return (
        F.when(ms.isNull() | (ms == 0), F.lit(f"0{second}"))
        .when(ms < 1000, F.concat(ms.cast("string"), F.lit(milli)))
        .otherwise(long_form)
    )


def strip_time(text: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` to 14 digits."""
    return F.translate(text, "-: ", "")


def split_time(text: Column) -> Column:
    """14 digits to ``yyyy-MM-dd HH:mm:ss``; other lengths stay."""
    dashed = F.regexp_replace(text, r"^(.{4})(.{2})(.{2})(.{2})(.{2})(.{2})$", "$1-$2-$3 $4:$5:$6")
    return F.when(F.length(text) == 14, dashed).otherwise(text)


def mem_mb(text: Column) -> Column:
    """``2G`` → 2048, ``512m`` → 512, a bare number as is."""
    number = F.regexp_extract(F.trim(text), r"^(\d+)\s*[gGmM]?$", 1).try_cast("int")
    return F.when(F.lower(F.trim(text)).endswith("g"), number * 1024).otherwise(number)


def capacity_mb(text: Column) -> Column:
    """Capacity with a one or two letter unit to MB, cut to whole MB; unknown units count as 512."""
    number = F.regexp_extract(text, r"(\d+)\s*([a-zA-Z]{1,2})", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(text, r"(\d+)\s*([a-zA-Z]{1,2})", 2))
    return (
        F.when(unit.contains("g"), F.floor(number * 1024))
        .when(unit.contains("m"), F.floor(number))
        .when(unit.contains("k"), F.floor(number / 1024))
        .otherwise(F.lit(512)).cast("int")
    )


def properties(text: Column) -> Column:
    """``k=v`` lines to a map; blank lines and ``#`` comments are skipped, the last value of a key wins."""
    lines = F.filter(
        F.transform(F.split(text, r"\r?\n"), lambda s: F.trim(s)),
        lambda s: (s != "") & ~s.startswith("#") & ~s.startswith("!"))
    pairs = F.transform(lines, lambda s: F.struct(
        F.trim(F.regexp_extract(s, r"^([^=:]*)", 1)).alias("k"),
        F.ltrim(F.regexp_replace(s, r"^[^=:]*[=:]?", "")).alias("v")))
    return _last_wins(pairs)


def _last_wins(pairs: Column) -> Column:
    """Array of (k, v) structs to a map without failing on repeated keys."""
    names = pairs.getField("k")
    keys = F.array_distinct(names)
    last = F.map_from_entries(F.transform(keys, lambda k: F.struct(
        k.alias("key"),
        F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"].alias("value"))))
    return F.when(F.size(keys) == F.size(names), F.map_from_arrays(names, pairs.getField("v"))).otherwise(last)


def split_outside(text: Column, delimiter: str) -> Column:
    """Split on a one-character delimiter that stands outside brackets and double quotes.

    One pass over the characters, which keeps the open brackets, whether a quote is open, the parts so far and the current one.
    """
    if len(delimiter) != 1:
        raise ValueError("the delimiter must be one character")

    def step(state: Column, c: Column) -> Column:
        quoted = F.when(c == '"', ~state["quoted"]).otherwise(state["quoted"])
        depth = state["depth"] + F.when(quoted, 0).when(c.isin("(", "[", "{"), 1).when(c.isin(")", "]", "}"), -1).otherwise(0)
        cut = (c == delimiter) & ~state["quoted"] & (state["depth"] == 0)
        return F.struct(
            F.greatest(depth, F.lit(0)).alias("depth"), quoted.alias("quoted"),
            F.when(cut, F.concat(state["parts"], F.array(state["now"]))).otherwise(state["parts"]).alias("parts"),
            F.when(cut, F.lit("")).otherwise(F.concat(state["now"], c)).alias("now"))

    start = F.struct(
        F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.array().cast("array<string>").alias("parts"), F.lit("").alias("now"))
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(letters, start, step, lambda s: F.concat(s["parts"], F.array(s["now"])))


def json_get(doc: Column, path: str) -> Column:
    return F.get_json_object(doc, path)


_OBJECT = "map<string,variant>"


def _edited(value: Column, path: Sequence[str], change: Callable[[Column], Column], make: bool) -> Column:
    """The variant ``value`` with ``change`` made to the members of the object at ``path``; ``make`` adds objects that are absent."""
    members = F.try_variant_get(value, "$", _OBJECT)
    if not path:
        out = change(members)
    else:
        name, child = path[0], F.try_element_at(members, F.lit(path[0]))
        if make:
            child = F.coalesce(child, F.parse_json(F.lit("{}")))
        inner = _edited(child, path[1:], change, make)
        others = F.map_filter(members, lambda k, v: k != name)
        out = F.when(F.try_variant_get(child, "$", _OBJECT).isNull(), members).otherwise(
            F.map_concat(others, F.create_map(F.lit(name), inner)))
    return F.when(members.isNull(), value).otherwise(F.parse_json(F.to_json(out)))


def json_drop(doc: Column, *path: str) -> Column:
    """Removes the member at ``path`` and nothing else. A path that leads nowhere changes nothing; text that is no JSON gives null.

    Works on parsed values, level by level; members of objects come out in the order of their names.
    """
    return F.to_json(_edited(F.try_parse_json(doc), path[:-1], lambda m: F.map_filter(m, lambda k, v: k != path[-1]), False))


def json_put(doc: Column, path: Sequence[str], value: Column) -> Column:
    """Sets the member at ``path`` to a text; absent objects on the way are added, a member that is no object stays as it is.

    As ``json_drop``. A null value sets JSON's null.
    """
    text = F.parse_json(F.coalesce(F.to_json(F.when(value.isNotNull(), F.struct(value.cast("string").alias("v")))), F.lit('{"v":null}')))
    inside = F.variant_get(text, "$.v", "variant")
    return F.to_json(_edited(F.try_parse_json(doc), path[:-1], lambda m: F.map_concat(
        F.map_filter(m, lambda k, v: k != path[-1]), F.create_map(F.lit(path[-1]), inside)), True))


_HBASE_LIKE = {8: False, 30: True, 38: True}


def jdbc_parts(url: Column) -> Column:
    """Struct (host, port, db) of a JDBC URL; nulls where the URL has another form.

    Cut step by step: the scheme up to ``//`` or ``@``, the host up to a colon, the port, and then the database behind
    ``/``, ``:`` or ``;DatabaseName=``, which may be missing.
    """
    halves = F.split(F.replace(url, F.lit("%s"), F.lit("default")), "//|@", 2)
    address = F.regexp_replace(F.coalesce(F.try_element_at(halves, F.lit(2)), F.lit("")), "^//", "")

    def scheme(p: dict[str, Column]) -> Column:
        # jdbc, one or two names, and nothing behind the last colon
        names = p["names"]
        middle = F.slice(names, 2, F.greatest(F.size(names) - 2, F.lit(0)))
        return (F.element_at(names, 1).endswith("jdbc") & F.size(names).isin(3, 4) & (F.element_at(names, -1) == "")
                & F.forall(middle, lambda n: n.rlike("^[a-z0-9.]+$")))

    def place(p: dict[str, Column]) -> Column:
        port = F.regexp_extract(p["behind"], "^[0-9]+", 0)
        return _with({"host": p["host"], "good": p["good"], "port": port, "tail": F.substr(p["behind"], F.length(port) + 1)}, database)

    def database(p: dict[str, Column]) -> Column:
        named, tail = F.lit(";databasename="), p["tail"]
        rest = F.when(F.lower(tail).startswith(named), F.substr(tail, F.length(named) + 1)).when(
            tail.startswith("/") | tail.startswith(":"), F.substr(tail, F.lit(2)))
        db = F.nullif(F.regexp_extract(rest, "(?i)^[a-z0-9]+", 0), F.lit(""))
        return _with({"host": p["host"], "port": p["port"], "db": db,
                      "fits": p["good"] & F.length(p["port"]).between(1, 5) & ((tail == "") | db.isNotNull())}, result)

    def result(p: dict[str, Column]) -> Column:
        return F.struct(F.when(p["fits"], p["host"]).alias("host"), F.when(p["fits"], p["port"]).try_cast("int").alias("port"),
                        F.when(p["fits"], p["db"]).alias("db"))

    def cut(p: dict[str, Column]) -> Column:
        host = F.substring_index(p["address"], ":", 1)
        return _with({"host": host, "behind": F.substr(p["address"], F.length(host) + 2),
                      "good": scheme(p) & F.lower(host).rlike("^[0-9a-z.-]+$")}, place)

    return _with({"names": F.split(F.lower(halves[0]), ":"), "address": address}, cut)


def _with(pieces: dict[str, Column], use: Callable[[dict[str, Column]], Column]) -> Column:
    """``use`` on pieces that are computed once: they become variables of a lambda."""
    row = F.array(F.struct(*[c.alias(n) for n, c in pieces.items()]))
    return F.element_at(F.transform(row, lambda r: use({n: r[n] for n in pieces})), 1)


def source_key(url: Column, source_type: Column) -> Column:
    """``host#port`` of a source; for HBase and Phoenix the comma-joined list of all its hosts."""
    # Impala options after ';' and Kerberos options before 'principal' are no part of the address
    plain = F.when(url.contains("impala") & url.contains(";"), F.substring_index(url, ";", 1)).otherwise(url)
    before = F.substring_index(plain, "principal", 1)
    plain = F.when(plain.contains("principal"), before.substr(F.lit(1), F.length(before) - 1)).otherwise(plain)
    plain = F.regexp_replace(plain, "/$", "")
    parts = jdbc_parts(plain)
    normal = F.when(parts["host"].isNotNull() & parts["port"].isNotNull(),
                    F.concat_ws("#", parts["host"], parts["port"].cast("string")))
    address = F.trim(url)
    phoenix = source_type.isin([c for c, p in _HBASE_LIKE.items() if p])
    address = F.when(phoenix, F.regexp_extract(address, r"phoenix.([^/]*)", 1)).otherwise(address)
    each = F.array_join(F.transform(F.split(address, ","), lambda a: F.replace(a, F.lit(":"), F.lit("#"))), ",")
    port = F.try_element_at(F.split(address, ":"), F.lit(2))
    shared = F.array_join(
        F.transform(F.split(F.substring_index(address, ":", 1), ","), lambda a: F.concat(a, F.lit("#"), port)), ",")
    cluster = F.when((F.size(F.split(address, ":")) > 2) & ~phoenix, each).otherwise(shared)
    return F.when(source_type.isin(list(_HBASE_LIKE)), cluster).otherwise(normal)


def resource_key(engine: Column, cluster: Column, queue: Column, resource_type: Column,
                 compute_type: Column | None = None) -> Column:
    """Queue name of a job; the compute type is the part that some deployments leave out."""
    middle = [] if compute_type is None else [F.lower(compute_type)]
    return F.concat_ws("_", engine, cluster, queue, *middle, resource_type)


def cluster_of(resource: Column, with_compute_type: bool = True) -> Column:
    """Cluster inside a queue name: what lies between the first and the 3 (or 2) last parts."""
    parts = F.split(resource, "_")
    tail = 3 if with_compute_type else 2
    length = F.greatest(F.size(parts) - tail - 1, F.lit(0))
    return F.when(F.trim(resource) == "", F.lit("")).otherwise(F.array_join(F.slice(parts, F.lit(2), length), "_"))


def partition_map(spec: Column) -> Column:
    """``pt='a'/ds='b'`` to a map; with one '=' and one '/' the slash belongs to the value."""
    def count(c: str) -> Column:
        return F.length(spec) - F.length(F.replace(spec, F.lit(c), F.lit("")))

    whole = (count("/") == 1) & (count("=") == 1)
    items = F.when(whole, F.array(spec)).otherwise(F.split(spec, "/"))
    pairs = F.transform(items, lambda s: F.struct(
        F.trim(F.substring_index(s, "=", 1)).alias("k"),
        F.regexp_replace(F.regexp_replace(s, r"^[^=]*=", ""), r"""^['"]|['"]$""", "").alias("v")))
    return _last_wins(pairs)


def weeks_between(start: Column, end: Column) -> Column:
    """ISO weeks touched from ``start`` to ``end`` inside one year turn, both ends counted."""
    plain = F.weekofyear(end) - F.weekofyear(start) + 1
    # the week that holds 28 December is always the last week of its ISO year
    last = F.weekofyear(F.make_date(F.year(start), F.lit(12), F.lit(28)))
    return F.when(plain < 1, F.weekofyear(end) + last - F.weekofyear(start) + 1).otherwise(plain)


def months_between_incl(start: Column, end: Column) -> Column:
    """Months touched from ``start`` to ``end`` inside one year turn, both ends counted."""
    plain = F.month(end) - F.month(start) + 1
    return F.when(plain < 1, plain + 12).otherwise(plain)
