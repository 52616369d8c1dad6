"""All registered queries."""

from __future__ import annotations

from docloom.plans import citing, files, learning, matching, relational, text
from docloom.plans.base import Query


def queries() -> dict[str, Query]:
    return text.plans.queries | relational.plans.queries | learning.plans.queries | matching.plans.queries | files.plans.queries | citing.plans.queries


def oracle_sql() -> dict[str, str]:
    return text.plans.sql | relational.plans.sql | learning.plans.sql | matching.plans.sql | files.plans.sql | citing.plans.sql
