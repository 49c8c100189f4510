"""The registered queries of the screening engine and the SQL they are checked against."""

from __future__ import annotations

from wardstone.plans import detection, evaluation, learning


def queries() -> dict:
    return detection.queries() | evaluation.queries() | learning.queries()


def oracle_sql() -> dict[str, str]:
    return detection.oracle_sql() | evaluation.oracle_sql() | learning.oracle_sql()
