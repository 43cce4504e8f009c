"""The SELECT builder: immutable, lowered to one DataFrame so that Catalyst sees the whole query."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column as C
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import CompileError, Expr, Order, Placeholder, Ref, codec_of, lower_, quote
from ..sources.schema import Database, Table


@dataclass(frozen=True)
class Sub:
    """A query as a table; its columns are the query's keys. Groups that may be null stay so."""

    query: Any
    qualifier: str

    @property
    def name(self) -> str:
        return self.qualifier

    def frame(self, **env: Any) -> DataFrame:
        return self.query.df(**env)

    def __getitem__(self, key: str) -> Ref:
        if key not in self.query.keys():
            raise CompileError(f"{self.qualifier} has no column {key}")
        return Ref(self.qualifier, key)

    def refs(self) -> dict[str, Ref]:
        return {k: Ref(self.qualifier, k) for k in self.query.keys()}

    def renamed(self, name: str) -> Sub:
        return replace(self, qualifier=name)


def _whole(n: Any, env: Mapping[str, Any], what: str) -> int:
    if isinstance(n, Placeholder):
        if n.name not in env:
            raise CompileError(f"no value for placeholder {n.name}")
        n = env[n.name]
    if isinstance(n, bool) or not isinstance(n, (int, float)) or not math.isfinite(n):
        raise CompileError(f"{what} must be a finite number")
    return math.trunc(n)


def _refs_within(shape: Mapping[str, Any]) -> list[Ref]:
    return [r for v in shape.values() for r in (_refs_within(v) if isinstance(v, Mapping) else [v] if isinstance(v, Ref) else [])]


@dataclass(frozen=True)
class Select:
    """Each method returns a new query. where, group_by, having, order_by, limit and offset replace; joins add."""

    db: Database
    source: Any = None
    projection: Mapping[str, Any] | None = None
    is_distinct: bool = False
    joins: tuple[tuple[str, Any, Any], ...] = ()
    condition: Any = None
    groups: tuple[Any, ...] = ()
    having_: Any = None
    orders: tuple[Any, ...] = ()
    limit_: Any = None
    offset_: Any = None

    def from_(self, source: Any) -> Select:
        return replace(self, source=source)

    def select(self, projection: Mapping[str, Any]) -> Select:
        if not projection:
            raise CompileError("an empty projection")
        return replace(self, projection=projection)

    def distinct(self) -> Select:
        return replace(self, is_distinct=True)

    def _join(self, how: str, other: Any, on: Any) -> Select:
        return replace(self, joins=(*self.joins, (how, other, on)))

    def inner_join(self, other: Any, on: Any) -> Select:
        return self._join("inner", other, on)

    def left_join(self, other: Any, on: Any) -> Select:
        return self._join("left", other, on)

    def right_join(self, other: Any, on: Any) -> Select:
        return self._join("right", other, on)

    def full_join(self, other: Any, on: Any) -> Select:
        return self._join("full", other, on)

    def cross_join(self, other: Any) -> Select:
        return self._join("cross", other, None)

    def where(self, condition: Any) -> Select:
        return replace(self, condition=condition)

    def group_by(self, *by: Any) -> Select:
        return replace(self, groups=by)

    def having(self, condition: Any) -> Select:
        return replace(self, having_=condition)

    def order_by(self, *by: Any) -> Select:
        return replace(self, orders=by)

    def limit(self, n: Any) -> Select:
        return replace(self, limit_=n)

    def offset(self, n: Any) -> Select:
        return replace(self, offset_=n)

    def as_(self, name: str) -> Sub:
        return Sub(self, name)

    def nullable(self) -> set[str]:
        """Qualifiers whose rows an outer join may miss."""
        seen, out = [self.source.qualifier], set()
        for how, other, _ in self.joins:
            out = {"left": out | {other.qualifier}, "right": out | set(seen), "full": out | {*seen, other.qualifier}}.get(how, out)
            if how in ("inner", "cross", "right"):
                out = out - {other.qualifier}
            seen.append(other.qualifier)
        return out

    def shape(self) -> Mapping[str, Any]:
        """The projection: as given, or all columns, or with joins one group per table."""
        if self.projection is not None:
            return self.projection
        if not self.joins:
            return self.source.refs()
        return {t.qualifier: t.refs() for t in (self.source, *(j[1] for j in self.joins))}

    def keys(self) -> list[str]:
        return list(self.shape())

    def _group(self, shape: Mapping[str, Any], env: Mapping[str, Any], nullable: set[str], depth: int) -> C:
        """A struct; null if a top-level group's columns all come from one table that may be missing, and all are null.

        A group without columns of its own goes by those of the groups in it.
        """
        if not shape:
            raise CompileError("an empty group")
        leaves = {k: self._group(v, env, nullable, depth + 1) if isinstance(v, Mapping) else self._leaf(v, env) for k, v in shape.items()}
        out = F.struct(*[c.alias(k) for k, c in leaves.items()])
        refs = [v for v in shape.values() if isinstance(v, Ref)] or _refs_within(shape)
        if depth == 1 and refs and len({r.table for r in refs}) == 1 and refs[0].table in nullable:
            missing = lower_(refs[0], env).isNull()
            for r in refs[1:]:
                missing &= lower_(r, env).isNull()
            out = F.when(~missing, out)
        return out

    @staticmethod
    def _leaf(v: Any, env: Mapping[str, Any]) -> C:
        c = lower_(v, env)
        codec = codec_of(v)
        return F.when(c.isNotNull(), codec.decode(c)) if codec is not None else c

    def df(self, **env: Any) -> DataFrame:
        db = self.db
        rows = db.scan(self.source, **env) if self.source is not None else db.spark.range(1)
        for how, other, on in self.joins:
            right = db.scan(other, **env)
            rows = rows.crossJoin(right) if how == "cross" else rows.join(right, lower_(on, env), how)
        if self.condition is not None:
            rows = rows.filter(lower_(self.condition, env))
        shape = self.projection or {} if self.source is None else self.shape()
        nullable = self.nullable() if self.source is not None else set()
        if not shape:
            raise CompileError("an empty projection")
        cols = [(self._group(v, env, nullable, 1) if isinstance(v, Mapping) else self._leaf(v, env)).alias(k) for k, v in shape.items()]
        orders = [lower_(o if isinstance(o, Order) else Order(o), env) for o in self.orders]
        if self.groups or self.having_ is not None or self._aggregates():
            by = [lower_(g, env) for g in self.groups]
            # grouping expressions are computed once, and referred to by the aggregate's own columns
            extra = [lower_(self.having_, env).alias("__having")] if self.having_ is not None else []
            extra += [lower_(o.operand if isinstance(o, Order) else o, env).alias(f"__o{i}") for i, o in enumerate(self.orders)]
            rows = rows.groupBy(*by).agg(*cols, *extra)
            if self.having_ is not None:
                rows = rows.filter("__having")
            rows = rows.orderBy(*[F.desc(f"__o{i}") if isinstance(o, Order) and o.down else F.asc(f"__o{i}") for i, o in enumerate(self.orders)]) if orders else rows
            rows = rows.select(*[F.col(quote(k)) for k in shape])
        else:
            if orders and not self.is_distinct:
                rows = rows.orderBy(*orders)
            rows = rows.select(*cols)
        if self.is_distinct:
            rows = rows.distinct()
            if orders:
                rows = rows.orderBy(*[F.desc(quote(k)) if isinstance(o, Order) and o.down else F.asc(quote(k)) for o in self.orders for k in (self._key_of(o, shape),)])
        if self.offset_ is not None:
            rows = rows.offset(max(0, _whole(self.offset_, env, "offset")))
        if self.limit_ is not None and (n := _whole(self.limit_, env, "limit")) >= 0:
            rows = rows.limit(n)
        return rows

    @staticmethod
    def _key_of(order: Any, shape: Mapping[str, Any]) -> str:
        """The key of a distinct projection that an order goes by; rows that are one may differ in anything else."""
        x = order.operand if isinstance(order, Order) else order
        for k, v in shape.items():
            if v is x or (isinstance(v, Ref) and isinstance(x, Ref) and (v.table, v.name) == (x.table, x.name)):
                return k
        raise CompileError("an order that isn't in the distinct projection")

    def _aggregates(self) -> bool:
        return any(isinstance(v, Expr) and v.aggregate for v in (self.projection or {}).values())

    def get(self, **env: Any) -> Any:
        """The first row, or None."""
        return (self if self.limit_ is not None else self.limit(1)).df(**env).first()

    def all(self, **env: Any) -> list:
        return self.df(**env).collect()


def query(db: Database) -> Select:
    return Select(db)


def latest_per_group(db: Database, table: Table, partition_by: list[Any], order_by: list[Any], tiebreak: Any, where: Any = None, **env: Any) -> DataFrame:
    """The first row of each group, in the order given; rows are filtered before they are numbered."""
    if not partition_by or not order_by or tiebreak is None:
        raise CompileError("partition_by, order_by and tiebreak are needed")
    rows = db.scan(table, **env)
    if where is not None:
        rows = rows.filter(lower_(where, env))
    by = [lower_(o if isinstance(o, Order) else Order(o), env) for o in (*order_by, tiebreak)]
    rank = F.row_number().over(Window.partitionBy(*[lower_(p, env) for p in partition_by]).orderBy(*by))
    return rows.select(*[lower_(r, env).alias(k) for k, r in table.refs().items()], rank.alias("__rank")).filter("__rank = 1").drop("__rank")
