"""Status codes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsframe import dims


def _first_match(col: Column, rules: list[tuple[list[int], Column]], otherwise: Column) -> Column:
    out = None
    for codes, value in rules:
        out = F.when(col.isin(codes), value) if out is None else out.when(col.isin(codes), value)
    return out.otherwise(otherwise)


def show_status(col: Column, merge_failed: bool = True) -> Column:
    """The code shown to users; failures are merged into FAILED or kept apart, expiry is never merged into stop."""
    rules = [(dims.FAILED, F.lit(8))] if merge_failed else []
    rules += [(dims.FINISH, F.lit(5)), (dims.RUNNING, F.lit(4)), (dims.WAIT, F.lit(16)), (dims.EXPIRED, F.lit(24)),
              (dims.STOP, F.lit(7))]
    return _first_match(col, rules, col.cast("int"))


def status_code(col: Column) -> Column:
    """Bucket name of any status; unknown ones count as UNSUBMIT."""
    rules = [(members, F.lit(dims.STATUS_NAME[code])) for code, members in dims.SPLIT.items()]
    return _first_match(col, rules, F.lit("UNSUBMIT"))


def bucket_of(col: Column, split: bool = False) -> Column:
    """Bucket code of a status, null for statuses in no bucket."""
    groups = dims.SPLIT if split else dims.MERGED
    return _first_match(col, [(m, F.lit(c)) for c, m in groups.items()], F.lit(None).cast("int"))
