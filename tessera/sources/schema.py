"""Tables and columns declared in code, their codecs, and the database that finds their rows."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column as C
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import CompileError, Expr, Ref


@dataclass(frozen=True)
class Codec:
    """Between logical values and what is stored."""

    spark_type: str
    encode: Callable[[Any], C] = F.lit
    decode: Callable[[C], C] = lambda c: c
    #: For many rows at once: the type of a column of values, what makes such a value, and what makes the stored column.
    batch: tuple[str, Callable[[Any], Any], Callable[[C], C]] | None = None


def _same(x: Any) -> Any:
    return x


def _epoch(unit: Callable[[C], C], back: Callable[[C], C]) -> Codec:
    return Codec("bigint", lambda v: unit(F.lit(v).cast("timestamp")), back, ("timestamp", _same, unit))


def _made(kind: str, make: Callable[[Any], Any], decode: Callable[[C], C]) -> Codec:
    return Codec(kind, lambda v: F.lit(make(v)), decode, (kind, make, _same))


#: By logical type; stored as integer, text, real, numeric or blob.
CODECS = {
    "integer": Codec("bigint"), "text": Codec("string"), "real": Codec("double"), "numeric": Codec("decimal(38,18)", F.lit, lambda c: c.cast("string")), "blob": Codec("binary"),
    "boolean": _made("int", lambda v: int(bool(v)), lambda c: c != 0), "bigint": _made("string", str, lambda c: c.cast("decimal(38,0)")),
    "timestamp": _epoch(F.unix_seconds, F.timestamp_seconds), "timestamp_ms": _epoch(F.unix_millis, F.timestamp_millis), "json": _made("string", lambda v: json.dumps(v, separators=(",", ":")), F.try_parse_json),
    "any": Codec("string", F.lit),
}


@dataclass(frozen=True)
class Column:
    name: str
    kind: str = "any"
    not_null: bool = False
    primary_key: bool = False
    unique: bool = False
    default: Any = None
    default_fn: Callable[[], Any] | None = None
    on_update_fn: Callable[[], Any] | None = None
    references: tuple[str, str] | None = None
    on_delete: str = "no action"
    generated: str | None = None
    #: None: unstated, so that a live one is kept; "binary": none is wanted.
    collate: str | None = None
    codec: Codec | None = None
    autoincrement: bool = False

    @property
    def coder(self) -> Codec:
        return self.codec or CODECS[self.kind]


def snake_case(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


@dataclass(frozen=True)
class Index:
    """columns: keys, (key, "desc"), or SQL text of an expression. where: the predicate of a partial index."""

    columns: tuple[Any, ...]
    name: str = ""
    unique: bool = False
    where: str | None = None


@dataclass(frozen=True)
class Table:
    """columns: by logical key. A table is unchanged by use; alias_of() gives another qualifier."""

    name: str
    columns: dict[str, Column]
    primary_key: tuple[str, ...] = ()
    uniques: tuple[tuple[str, ...], ...] = ()
    checks: dict[str, str] = field(default_factory=dict)
    indexes: tuple[Index | tuple[str, tuple[str, ...], bool], ...] = ()
    #: Columns that are never rewritten; () guards all of them.
    append_only: tuple[str, ...] | None = None
    alias: str = ""
    strict: bool = False
    without_rowid: bool = False

    @property
    def qualifier(self) -> str:
        return self.alias or self.name

    @property
    def key(self) -> tuple[str, ...]:
        return self.primary_key or tuple(k for k, c in self.columns.items() if c.primary_key)

    def __getitem__(self, key: str) -> Ref:
        if key not in self.columns:
            raise CompileError(f"{self.name} has no column {key}")
        c = self.columns[key]
        return Ref(self.qualifier, c.name, c.coder if c.kind != "any" or c.codec else None)

    def refs(self) -> dict[str, Ref]:
        return {k: self[k] for k in self.columns}


def alias_of(table: Any, name: str) -> Any:
    return replace(table, alias=name)


def table_of(name: str, df: DataFrame, key: tuple[str, ...] = ()) -> Table:
    """A table declared by a DataFrame's columns."""
    return Table(name, {c: Column(c) for c in df.columns}, primary_key=key)


class Database:
    """Tables by name: Parquet under a folder, frames given, or the session's catalog."""

    def __init__(self, spark: SparkSession, folder: str | None = None, frames: dict[str, DataFrame] | None = None):
        self.spark, self.folder, self.frames, self._tables = spark, folder, dict(frames or {}), {}

    def frame(self, name: str) -> DataFrame:
        if name not in self.frames:
            self.frames[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet") if self.folder else self.spark.table(name)
        return self.frames[name]

    def table(self, name: str, key: tuple[str, ...] = ()) -> Table:
        """The table as its rows declare it."""
        if (name, key) not in self._tables:
            self._tables[name, key] = table_of(name, self.frame(name), key)
        return self._tables[name, key]

    def scan(self, table: Any, **env: Any) -> DataFrame:
        return (self.frame(table.name) if isinstance(table, Table) else table.frame(**env)).alias(table.qualifier)

    def execute(self, text: str, args: Any = None, views: tuple[str, ...] = ()) -> DataFrame:
        """A raw statement; the named tables are registered as views first."""
        for v in views:
            self.frame(v).createOrReplaceTempView(v)
        return self.spark.sql(text, args=args)

    def describe(self) -> list[tuple[str, str, str]]:
        """(table, column, type) of the tables used so far."""
        return [(t, c, k) for t, df in sorted(self.frames.items()) for c, k in df.dtypes]

    def catalog(self, *tables: Table) -> DataFrame:
        """Rows (table_name, column_name, position, type, key_position, is_unique, indexed, refers_to) of declared tables."""
        rows = []
        for t in tables:
            kinds = dict(self.frame(t.name).dtypes)
            indexed = {k for x in t.indexes for k in (x.columns if isinstance(x, Index) else x[1]) if isinstance(k, str)}
            for i, (k, c) in enumerate(t.columns.items()):
                at = t.key.index(k) + 1 if k in t.key else None
                unique = c.unique or (k,) in t.uniques or t.key == (k,)
                rows.append((t.name, c.name, i + 1, kinds.get(c.name), at, unique, k in indexed, ".".join(c.references) if c.references else None))
        return self.spark.createDataFrame(rows, "table_name string, column_name string, position int, type string, key_position int, is_unique boolean, indexed boolean, refers_to string")


def list_source(spark: SparkSession, text: str, kind: str) -> DataFrame:
    """The elements of a JSON list as rows (value)."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(text), f"array<{kind}>")).alias("value"))


__all__ = ["CODECS", "Codec", "Column", "Database", "Expr", "Table", "alias_of", "list_source", "snake_case", "table_of"]
