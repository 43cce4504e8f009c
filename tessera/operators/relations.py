"""Relation graph, object filters over it, and nested loading of one and many relations as joins."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from functools import reduce
from itertools import count as counter
from typing import Any

from pyspark.sql import Column as C
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType
from pyspark.sql.window import Window

from ..functions import expressions as X
from ..functions.expressions import CompileError, Expr, Order, Placeholder, Ref, lower_, quote
from ..sources.schema import Database, Table

_names = counter()


@dataclass(frozen=True)
class Edge:
    """A relation. through: (junction table, its columns to the source, its columns to the target)."""

    kind: str
    target: str
    source_cols: tuple[str, ...] = ()
    target_cols: tuple[str, ...] = ()
    where: Mapping[str, Any] | None = None
    through: tuple[str, tuple[str, ...], tuple[str, ...]] | None = None
    alias: str | None = None
    optional: bool = True
    reversed: bool = False
    source_where: Mapping[str, Any] | None = None


def one(target: str, source_cols=None, target_cols=None, **more: Any) -> Edge:
    return Edge("one", target, _names_of(source_cols), _names_of(target_cols), **more)


def many(target: str, source_cols=None, target_cols=None, **more: Any) -> Edge:
    return Edge("many", target, _names_of(source_cols), _names_of(target_cols), **more)


def _names_of(x: Any) -> tuple[str, ...]:
    if x is not None and not x:
        raise CompileError("a relation's columns can't be empty; leave them out on both sides to adopt those of the reverse")
    return () if x is None else (x,) if isinstance(x, str) else tuple(x)


class RelationGraph:
    """Tables and their relations. A relation without columns adopts the one reverse edge, or that of the same alias."""

    def __init__(self, tables: Mapping[str, Table], relations: Mapping[str, Mapping[str, Edge]]):
        for table in relations:
            if table not in tables:
                raise CompileError(f"relations of {table}, which is no table")
        self.tables, self.edges = dict(tables), {t: dict(relations.get(t, {})) for t in tables}
        declared = {t: dict(e) for t, e in self.edges.items()}
        for table, edges in self.edges.items():
            for name, e in edges.items():
                if name in self.tables[table].columns:
                    raise CompileError(f"{table}.{name} is a column and a relation")
                if e.target not in self.tables:
                    raise CompileError(f"{table}.{name}: no table {e.target}")
                if e.alias == "":
                    raise CompileError(f"{table}.{name}: an empty alias")
                edges[name] = self._complete(declared, table, name, e)

    def _complete(self, declared: Mapping[str, Mapping[str, Edge]], table: str, name: str, e: Edge) -> Edge:
        if bool(e.source_cols) != bool(e.target_cols):
            raise CompileError(f"{table}.{name}: columns on one side only")
        if e.source_cols:
            if e.through is not None and e.through[0] not in self.tables:
                raise CompileError(f"{table}.{name}: no table {e.through[0]} to go through")
            sides = [(e.source_cols, e.target_cols)] if e.through is None else [(e.source_cols, e.through[1]), (e.target_cols, e.through[2])]
            if any(len(a) != len(b) for a, b in sides):
                raise CompileError(f"{table}.{name}: unequal numbers of columns" + ("" if e.through is None else f", or some that don't go through {e.through[0]}"))
            through = [] if e.through is None else [(e.through[0], (*e.through[1], *e.through[2]))]
            for t, cols in ((table, e.source_cols), (e.target, e.target_cols), *through):
                for c in cols:
                    self.tables[t][c]
            return e
        if not declared[e.target]:
            raise CompileError(f"{table}.{name}: no columns, and {e.target} declares no relations to take them from")
        found = {n: r for n, r in declared[e.target].items() if r is not e and (r.alias == e.alias if e.alias else r.target == table and not r.alias)}
        if len(found) != 1:
            many_ = f"more than one reverse relation ({', '.join(found)}); give two of them the same alias"
            raise CompileError(f"{table}.{name}: {'no reverse relation' if not found else many_}")
        (other, r), = found.items()
        if not r.source_cols:
            raise CompileError(f"{table}.{name}: neither it nor {e.target}.{other} has columns")
        through = (r.through[0], r.through[2], r.through[1]) if r.through else None
        # an adopted where speaks of the edge's target, which is our source
        return replace(e, source_cols=r.target_cols, target_cols=r.source_cols, through=through, reversed=e.where is None and r.where is not None, source_where=r.where if e.where is None else None)

    def edge(self, table: str, name: str) -> Edge:
        if name not in self.edges[table]:
            raise CompileError(f"{table} has no relation {name}")
        return self.edges[table][name]


def _class_of(kind: DataType) -> str:
    """What values may be equal: numbers of any width, else values of one type."""
    return "number" if isinstance(kind, NumericType) else kind.typeName()


def _equal(left: DataFrame, a: str, right: DataFrame, b: str, what: str) -> C:
    """Equality of two keys; refused for keys of different classes, such as 1 and '1', which Spark would cast."""
    kinds = [df.schema[n].dataType for df, n in ((left, a), (right, b))]
    if _class_of(kinds[0]) != _class_of(kinds[1]):
        raise CompileError(f"{what}: {a} is {kinds[0].simpleString()} and {b} is {kinds[1].simpleString()}")
    return left[quote(a)] == right[quote(b)]


#: Rows of a page up to which its keys are broadcast to the children.
PAGE_ROWS = 200_000

_OPS: dict[str, Callable] = {
    "eq": X.eq, "ne": X.ne, "gt": X.gt, "gte": X.gte, "lt": X.lt, "lte": X.lte, "in": X.in_, "notIn": X.not_in, "like": X.like, "ilike": X.ilike, "notLike": X.not_like, "notIlike": X.not_ilike,
}
_ARRAYS = ("arrayContains", "arrayContained", "arrayOverlaps")
UNSET = object()


class Loader:
    def __init__(self, db: Database, graph: RelationGraph, **env: Any):
        self.db, self.graph, self.env = db, graph, env

    # --- filters

    def filtered(self, df: DataFrame, table: str, where: Mapping[str, Any] | None) -> DataFrame:
        """Rows of df (the table's columns) that an object filter keeps; relations join as existence flags on distinct keys."""
        if not where:
            return df
        columns = df.columns
        df, c = self._filter(df, self.graph.tables[table], table, where)
        return df if c is None else df.filter(c).select(*[F.col(quote(n)) for n in columns])

    def _filter(self, df: DataFrame, t: Table, table: str, where: Mapping[str, Any]) -> tuple[DataFrame, C | None]:
        out: list[C] = []
        for key, v in where.items():
            if v is UNSET:
                continue
            if key in ("AND", "OR"):
                parts = []
                for w in v:
                    df, c = self._filter(df, t, table, w)
                    parts += [c] if c is not None else []
                if parts:
                    out.append(reduce((lambda a, b: a & b) if key == "AND" else (lambda a, b: a | b), parts))
            elif key == "NOT":
                df, c = self._filter(df, t, table, v)
                out += [~c] if c is not None else []
            elif key == "RAW":
                c = v(t, X) if callable(v) and not isinstance(v, C) else v
                out.append(self._plain(c))
            elif key in t.columns:
                out += [c for c in (self._column(t, key, v),) if c is not None]
            elif key in self.graph.edges[table]:
                df, c = self._related(df, table, key, v)
                out.append(c)
            else:
                raise CompileError(f"{table} has no field {key}")
        return df, reduce(lambda a, b: a & b, out) if out else None

    def _plain(self, e: Any) -> C:
        return lower_(e, self.env)

    def _ref(self, t: Table, key: str) -> Expr:
        c = t.columns[key]
        return Expr(lambda env: F.col(quote(c.name)), t[key].codec)

    def _column(self, t: Table, key: str, v: Any) -> C | None:
        ref = self._ref(t, key)
        if not isinstance(v, Mapping):
            return self._plain(X.eq(ref, v))
        out = []
        for op, x in v.items():
            if x is UNSET:
                continue
            if op in _OPS:
                if op in ("in", "notIn") and (isinstance(x, Placeholder) or not isinstance(x, (list, tuple, DataFrame))):
                    raise CompileError(f"{op} takes a list")
                out.append(self._plain(_OPS[op](ref, x)))
            elif op in ("isNull", "isNotNull"):
                if x:
                    out.append(self._plain((X.is_null if op == "isNull" else X.is_not_null)(ref)))
            elif op in ("AND", "OR"):
                parts = [c for c in (self._column(t, key, w) for w in x) if c is not None]
                if parts:
                    out.append(reduce((lambda a, b: a & b) if op == "AND" else (lambda a, b: a | b), parts))
            elif op == "NOT":
                c = self._column(t, key, x)
                out += [~c] if c is not None else []
            elif op in _ARRAYS:
                raise CompileError(f"{op}: there are no array columns")
            else:
                raise CompileError(f"no operator {op}")
        return reduce(lambda a, b: a & b, out) if out else None

    def _related(self, df: DataFrame, table: str, name: str, v: Any) -> tuple[DataFrame, C]:
        e, flag = self.graph.edge(table, name), f"__has{next(_names)}"
        target, source = self.graph.tables[e.target], self.graph.tables[table]
        rows = self.filtered(self.filtered(self.db.frame(target.name), e.target, e.where), e.target, v if isinstance(v, Mapping) else None)
        keys = self._keyed(rows, e, target).select([f"__k{i}" for i in range(len(e.source_cols))]).distinct().withColumn(flag, F.lit(True))
        keys = keys.toDF(*[f"{flag}_{i}" for i in range(len(e.source_cols))], flag)
        on = reduce(lambda a, b: a & b, [_equal(df, source.columns[c].name, keys, f"{flag}_{i}", f"{table}.{name}") for i, c in enumerate(e.source_cols)])
        df = df.join(keys, on, "left")
        has = F.col(flag).isNotNull()
        if e.reversed:
            df, c = self._filter(df, source, table, e.source_where)
            has = has & F.coalesce(c, F.lit(False)) if c is not None else has
        return df, ~has if v is False else has

    def _keyed(self, rows: DataFrame, e: Edge, target: Table) -> DataFrame:
        """Target rows with the source's key columns as __k0..., once per matching source key; nulls match nothing."""
        if e.through is None:
            return rows.withColumns({f"__k{i}": F.col(quote(target.columns[c].name)) for i, c in enumerate(e.target_cols)})
        junction, to_source, to_target = e.through
        links = self.db.frame(self.graph.tables[junction].name)
        j = self.graph.tables[junction].columns
        links = links.select(*[F.col(quote(j[c].name)).alias(f"__k{i}") for i, c in enumerate(to_source)], *[F.col(quote(j[c].name)).alias(f"__t{i}") for i, c in enumerate(to_target)])
        on = reduce(lambda a, b: a & b, [_equal(rows, target.columns[c].name, links, f"__t{i}", f"{junction} to {e.target}") for i, c in enumerate(e.target_cols)])
        return rows.join(links, on).drop(*[f"__t{i}" for i in range(len(to_target))])

    # --- loading

    def find_many(self, table: str, config: Mapping[str, Any] | None = None) -> DataFrame:
        """One row per row of the table: chosen columns, extras, and a field per relation (struct or array of structs).

        config: columns, extras, with, where, order_by, limit, offset. Parents without children have null or [].
        """
        config = config or {}
        t = self.graph.tables[table]
        rows = self.filtered(self.db.frame(t.name), table, config.get("where"))
        orders = self._orders(t, config.get("order_by"))
        limit = self._number(config["limit"]) if config.get("limit") is not None else -1
        offset = self._number(config["offset"]) if config.get("offset") is not None else 0
        if limit >= 0 or offset:
            # the page is taken before relations are joined; it has to be the same each time it is read, so ties go by key
            orders += [F.asc(quote(t.columns[k].name)) for k in t.key or t.columns]
            rows = rows.orderBy(*orders).offset(max(0, offset))
            rows = rows.limit(limit) if limit >= 0 else rows
        shaped, fields = self._shape(rows, table, config, limit)
        shaped = shaped.orderBy(*orders) if orders else shaped
        return shaped.select(*[c.alias(n) for n, c in fields.items()])

    def find_first(self, table: str, config: Mapping[str, Any] | None = None) -> Any:
        return self.find_many(table, {**(config or {}), "limit": 1}).first()

    def count(self, table: str, where: Mapping[str, Any] | None = None) -> DataFrame:
        return self.filtered(self.db.frame(self.graph.tables[table].name), table, where).agg(F.count(F.lit(1)).alias("count"))

    def _number(self, n: Any) -> int:
        return int(self.env[n.name] if isinstance(n, Placeholder) else n)

    def _orders(self, t: Table, by: Any) -> list[C]:
        if by is None:
            return []
        if callable(by):
            by = by(t, X)
            by = by if isinstance(by, (list, tuple)) else [by]
            return [self._bare(o).desc() if isinstance(o, Order) and o.down else self._bare(o).asc() for o in by]
        for k in by:
            if k not in t.columns:
                raise CompileError(f"{t.name} has no column {k}")
        return [F.desc(quote(t.columns[k].name)) if d == "desc" else F.asc(quote(t.columns[k].name)) for k, d in by.items() if d]

    def _bare(self, o: Any) -> C:
        o = o.operand if isinstance(o, Order) else o
        return F.col(quote(o.name)) if isinstance(o, Ref) else self._plain(o)

    @staticmethod
    def _chosen(t: Table, wanted: Mapping[str, bool] | None) -> list[str]:
        """All columns; only those marked true, if any is; else all but those marked false; none for an empty choice."""
        if wanted is None:
            return list(t.columns)
        live = {k: v for k, v in wanted.items() if v is not UNSET and v is not None}
        if not live:
            return []
        for k in live:
            if k not in t.columns:
                raise CompileError(f"{t.name} has no column {k}")
        return [k for k in t.columns if live.get(k)] if any(live.values()) else [k for k in t.columns if k not in live]

    def _shape(self, rows: DataFrame, table: str, config: Mapping[str, Any], page: int = -1) -> tuple[DataFrame, dict[str, C]]:
        """Rows joined with the relations wanted, and the fields to read from them; helper columns never leave.

        page: the number of rows, if they are a page; only its children are then grouped.
        """
        t, fields, base = self.graph.tables[table], {}, rows
        for k in self._chosen(t, config.get("columns")):
            ref = F.col(quote(t.columns[k].name))
            codec = t[k].codec
            fields[k] = F.when(ref.isNotNull(), codec.decode(ref)) if codec else ref
        extras = config.get("extras") or {}
        extras = extras(t, X) if callable(extras) else extras
        for k, e in extras.items():
            e = e(t, X) if callable(e) and not isinstance(e, (C, Expr)) else e
            fields[k] = self._plain(e)
        for name, sub in (config.get("with") or {}).items():
            if not sub:
                continue
            e, field = self.graph.edge(table, name), f"__rel{next(_names)}"
            rows = self._attach(rows, table, e, {} if sub is True else sub, field, (base, page) if page >= 0 else None)
            fields[name] = F.col(field)
        if not fields:
            raise CompileError("nothing is selected")
        return rows, fields

    def _attach(self, rows: DataFrame, table: str, e: Edge, config: Mapping[str, Any], field: str, page: tuple[DataFrame, int] | None) -> DataFrame:
        source, target = self.graph.tables[table], self.graph.tables[e.target]
        if any(isinstance(config.get(k), Placeholder) for k in ("limit", "offset")):
            raise CompileError("a nested page takes numbers")
        child = self.filtered(self.filtered(self.db.frame(target.name), e.target, e.where), e.target, config.get("where"))
        child = self._keyed(child, e, target)
        keys = [f"__k{i}" for i in range(len(e.source_cols))]
        if page is not None:  # the same keys as below, whose types are looked at there
            of = page[0].select(*[F.col(quote(source.columns[c].name)).alias(f"__p{i}") for i, c in enumerate(e.source_cols)]).distinct()
            child = child.join(F.broadcast(of) if page[1] <= PAGE_ROWS else of, [F.col(k) == F.col(f"__p{i}") for i, k in enumerate(keys)], "left_semi")
        orders = self._orders(target, config.get("order_by"))
        low, high = config.get("offset") or 0, config.get("limit")
        if orders or low or high is not None or e.kind == "one":
            ties = [F.asc(quote(target.columns[k].name)) for k in target.key or target.columns]
            child = child.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*orders, *ties)))
            high = 1 if e.kind == "one" else high
            if low:
                child = child.filter(F.col("__rn") > low)
            if high is not None and high >= 0:
                child = child.filter(F.col("__rn") <= low + high)
        else:
            child = child.withColumn("__rn", F.struct(*[F.col(quote(target.columns[k].name)) for k in target.key or target.columns]))
        shaped, fields = self._shape(child, e.target, config)
        shaped = shaped.select(*keys, "__rn", F.struct(*[c.alias(n) for n, c in fields.items()]).alias("__row"))
        if e.kind == "one":
            grouped = shaped.select(*keys, F.col("__row").alias(field))
        else:
            grouped = shaped.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__rn", "__row")), lambda a, b: F.when(a["__rn"] < b["__rn"], -1).when(a["__rn"] > b["__rn"], 1).otherwise(0)), lambda x: x["__row"]).alias(field))
        grouped = grouped.toDF(*[f"{field}_{k}" for k in keys], field)
        on = reduce(lambda a, b: a & b, [_equal(rows, source.columns[c].name, grouped, f"{field}_{k}", f"{table} to {e.target}") for c, k in zip(e.source_cols, keys, strict=True)])
        rows = rows.join(grouped, on, "left")
        value = F.col(field)
        if e.reversed:
            rows, c = self._filter(rows, source, table, e.source_where)
            value = F.when(F.coalesce(c, F.lit(False)), value) if c is not None else value
        if e.kind == "many":
            value = F.coalesce(value, F.array().cast(grouped.schema[field].dataType))
        return rows.withColumn(field, value)
