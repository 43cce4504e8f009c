"""Records by model: create, find, count, update and delete over versioned tables, with flat lists of conditions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions.expressions import CompileError, Expr, lower_, quote
from ..sources.schema import Table
from . import mutations as M


@dataclass(frozen=True)
class Where:
    """A condition on a field. fold: strings are compared without regard to case."""

    field: str
    value: Any
    operator: str = "eq"
    connector: str = "AND"
    fold: bool = False


_PLAIN: dict[str, Callable[[Any, Any], Expr]] = {
    "eq": X.eq_or_null, "ne": lambda x, v: X.is_not_null(x) if v is None else X.ne(x, v), "lt": X.lt, "lte": X.lte, "gt": X.gt, "gte": X.gte, "in": X.in_, "not_in": X.not_in,
    "contains": X.contains, "starts_with": X.starts_with, "ends_with": X.ends_with,
}
_FOLDED = {"eq": X.eq_folded, "ne": X.ne_folded, "in": X.in_folded, "not_in": X.not_in_folded}


class Adapter:
    """Each write is one version of the store; a write without conditions does nothing."""

    def __init__(self, store: M.TableStore, tables: Mapping[str, Table]):
        self.store, self.tables = store, dict(tables)

    def _table(self, model: str, fields: Sequence[str] = ()) -> Table:
        if model not in self.tables:
            raise CompileError(f"no model {model}")
        for f in fields:
            if f not in self.tables[model].columns:
                raise CompileError(f"{model} has no field {f}")
        return self.tables[model]

    def condition(self, model: str, where: Sequence[Where]) -> Expr | None:
        """All AND conditions, and any of the OR ones: a flat list, not a tree."""
        t = self._table(model, [w.field for w in where])
        parts: dict[str, list[Expr]] = {"AND": [], "OR": []}
        for w in where:
            if w.operator not in _PLAIN or w.connector not in parts:
                raise CompileError(f"no operator {w.operator} or connector {w.connector}")
            if w.operator in ("in", "not_in") and not isinstance(w.value, (list, tuple)):
                raise CompileError(f"{w.operator} takes a list")
            make = _FOLDED[w.operator] if w.fold and w.operator in _FOLDED and w.value is not None else _PLAIN[w.operator]
            parts[w.connector].append(make(t[w.field], w.value))
        return X.and_(X.and_(*parts["AND"]), X.or_(*parts["OR"]))

    def _found(self, model: str, where: Sequence[Where], select: Sequence[str] | None) -> DataFrame:
        t = self._table(model, select or ())
        rows, c = self.store.read(t.name).alias(t.qualifier), self.condition(model, where)
        rows = rows if c is None else rows.filter(lower_(c, {}))
        codecs = {k: t[k].codec for k in select or t.columns}
        refs = {k: F.col(quote(t.columns[k].name)) for k in codecs}
        return rows.select(*[(F.when(r.isNotNull(), codecs[k].decode(r)) if codecs[k] else r).alias(k) for k, r in refs.items()])

    def find_many(self, model: str, where: Sequence[Where] = (), select: Sequence[str] | None = None, sort_by: tuple[str, str] | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
        t = self._table(model, [sort_by[0]] if sort_by else ())
        rows = self._found(model, where, None)
        orders = [F.desc(quote(sort_by[0])) if sort_by[1] == "desc" else F.asc(quote(sort_by[0]))] if sort_by else []
        if orders or limit is not None or offset:  # ties go by key, so that pages fit together
            rows = rows.orderBy(*orders, *[F.asc(quote(k)) for k in t.key])
        rows = rows.offset(offset) if offset else rows
        rows = rows.limit(limit) if limit is not None else rows
        return rows.select(*[quote(k) for k in select]) if select else rows

    def find_one(self, model: str, where: Sequence[Where] = (), select: Sequence[str] | None = None) -> Row | None:
        return self._found(model, where, select).first()

    def count(self, model: str, where: Sequence[Where] = ()) -> int:
        return self._found(model, where, None).count()

    def _write(self, model: str, change: Callable[[Table, DataFrame], M.Change]) -> DataFrame:
        t = self._table(model)
        return self.store.batch([lambda read: (t.name, change(t, read(t.name)))])[0]

    def create(self, model: str, data: Mapping[str, Any]) -> Row:
        self._table(model, list(data))
        return self._write(model, lambda t, old: M.insert(t, old, M.new_rows(self.store.spark, t, old, [data]))).first()

    def update(self, model: str, where: Sequence[Where], values: Mapping[str, Any]) -> Row | None:
        """Update what the conditions hold for, by contract one row, and return it."""
        self._table(model, list(values))
        return self._write(model, lambda t, old: M.update(t, old, values, self.condition(model, where))).first() if where else None

    def update_many(self, model: str, where: Sequence[Where], values: Mapping[str, Any]) -> int:
        self._table(model, list(values))
        return self._write(model, lambda t, old: M.update(t, old, values, self.condition(model, where))).count() if where else 0

    def delete_many(self, model: str, where: Sequence[Where]) -> int:
        return self._write(model, lambda t, old: M.delete(t, old, self.condition(model, where))).count() if where else 0

    def delete(self, model: str, where: Sequence[Where]) -> None:
        self.delete_many(model, where)

    def consume_one(self, model: str, where: Sequence[Where]) -> Row | None:
        return self._write(model, lambda t, old: M.consume_one(t, old, self.condition(model, where))).first() if where else None

    def increment_one(self, model: str, where: Sequence[Where], increment: Mapping[str, Any], values: Mapping[str, Any] | None = None) -> Row | None:
        self._table(model, [*increment, *(values or {})])
        if not where or not {**increment, **(values or {})}:
            return None
        return self._write(model, lambda t, old: M.increment_one(t, old, increment, self.condition(model, where), values)).first()
