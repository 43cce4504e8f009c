"""What queries do, told to listeners: kind, tables, time, rows read and returned; and a warning of scans that return little."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Observation, Row
from pyspark.sql import functions as F

LOG = logging.getLogger("tessera")

#: A scan is told of beyond these rows read, and this many for each that is returned.
SCAN_ROWS, SCAN_RATIO = 100, 10


@dataclass(frozen=True)
class QueryEvent:
    """sql: the plan's text. params are kept in development only, as they may hold personal data."""

    sql: str
    kind: str
    tables: tuple[str, ...]
    seconds: float
    rows_read: int
    rows_returned: int
    params: Mapping[str, Any] = field(default_factory=dict)


def log_event(e: QueryEvent) -> None:
    """The default listener; statements' values aren't among what it writes."""
    LOG.info("%s %s: %.3f s, %d rows read, %d returned%s", e.kind, ", ".join(e.tables), e.seconds, e.rows_read, e.rows_returned, f", {dict(e.params)}" if e.params else "")


def scan_warning(e: QueryEvent) -> str | None:
    if e.rows_read > SCAN_ROWS and e.rows_read > SCAN_RATIO * e.rows_returned:
        return f"{e.rows_read} rows were read to return {e.rows_returned}; a partitioned or bucketed layout may help"
    return None


class Watched:
    """A database whose queries are told of: frames are observed as they are read, results as they are collected."""

    def __init__(self, db: Any, on_query: Callable[[QueryEvent], None] = log_event, development: bool = False):
        self.db, self.on_query, self.development = db, on_query, development

    def all(self, query: Any, **params: Any) -> list[Row]:
        """The rows of a query (what has df()), observed."""
        seen: list[tuple[str, Observation]] = []
        frame = self.db.frame

        def observed(name: str) -> DataFrame:
            o = Observation()
            seen.append((name, o))
            return frame(name).observe(o, F.count(F.lit(1)).alias("rows"))

        self.db.frame = observed
        try:
            df = query.df(**params)
        finally:
            del self.db.frame
        began = time.perf_counter()
        rows = df.collect()
        took = time.perf_counter() - began
        read = sum(o.get["rows"] for _, o in seen)
        plan = df._jdf.queryExecution().analyzed().toString()
        e = QueryEvent(plan, "select", tuple(dict.fromkeys(n for n, _ in seen)), took, read, len(rows), params if self.development else {})
        self.on_query(e)
        if self.development and (warning := scan_warning(e)):
            LOG.warning(warning)
        return rows


class Compiled:
    """A query to run again with other values: those bound earlier stay, later ones win."""

    def __init__(self, query: Any, bound: Mapping[str, Any] | None = None):
        self.query, self.bound = query, dict(bound or {})

    def bind(self, **values: Any) -> Compiled:
        return Compiled(self.query, {**self.bound, **values})

    def df(self, **values: Any) -> DataFrame:
        return self.query.df(**{**self.bound, **values})

    def all(self, **values: Any) -> list[Row]:
        return self.df(**values).collect()
