"""Inserts, updates, upserts and deletes as copy-on-write: each gives the table's next rows and the rows affected."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import Column as C
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import CompileError, Expr, lower_, quote
from ..sources.schema import Column, Table

UNSET = object()


@dataclass(frozen=True)
class Change:
    """rows: the whole table afterwards; affected: new rows of an insert or update, old ones of a delete."""

    rows: DataFrame
    affected: DataFrame

    def returning(self, *columns: str) -> DataFrame:
        return self.affected.select(*columns) if columns else self.affected

    def changes(self) -> int:
        return self.affected.count()


def _live(values: Mapping[str, Any]) -> dict[str, Any]:
    return {k: v for k, v in values.items() if v is not UNSET}


def _checked(t: Table, values: Mapping[str, Any]) -> dict[str, Any]:
    out = _live(values)
    for k in out:
        if k not in t.columns:
            raise CompileError(f"{t.name} has no column {k}")
        if t.columns[k].generated:
            raise CompileError(f"{t.name}.{k} is generated")
    return out


def _default(c: Column) -> Any:
    if c.generated:
        return None
    return c.default if c.default is not None else c.default_fn() if c.default_fn else c.on_update_fn() if c.on_update_fn else None


def new_rows(spark: SparkSession, t: Table, like: DataFrame, values: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Rows to insert, with defaults: an explicit null stays, an unset field takes default, default_fn, then on_update_fn."""
    if not values:
        raise CompileError("no rows to insert")
    types = {f.name: f.dataType for f in like.schema}
    made = []
    for n, v in enumerate(values):
        row = _checked(t, v)
        if not row and not any(c.default is not None or c.default_fn or c.on_update_fn for c in t.columns.values()):
            raise CompileError("a row with nothing to write")
        made.append([row[k] if k in row else _default(c) for k, c in t.columns.items()] + [n])
    codecs = [t[k].codec for k in t.columns]
    alone = lambda row: any(x is not None and (isinstance(x, (Expr, C)) or (k is not None and not _in_batch(k, x))) for k, x in zip(codecs, row, strict=False))
    kind = lambda c, k: k.batch[0] if k is not None and k.batch else types[c.name].simpleString()
    # values with a codec go in as such, one column each; only rows with expressions are a branch of the plan each
    plain = [tuple(x if x is None or k is None or not k.batch else k.batch[1](x) for k, x in zip([*codecs, None], r, strict=True)) for r in made if not alone(r)]
    schema = ", ".join(f"{quote(c.name)} {kind(c, k)}" for c, k in zip(t.columns.values(), codecs, strict=True)) + ", __n int"
    out = spark.createDataFrame(plain, schema)
    out = out.withColumns({c.name: k.batch[2](F.col(quote(c.name))).cast(types[c.name]) for c, k in zip(t.columns.values(), codecs, strict=True) if k is not None and k.batch})
    for r in filter(alone, made):
        cols = [lower_(x, {}, k).cast(types[c.name]).alias(c.name) for c, k, x in zip(t.columns.values(), codecs, r, strict=False)]
        out = out.unionByName(spark.range(1).select(*cols, F.lit(r[-1]).alias("__n")))
    return _settled(t, out)


def _in_batch(codec: Any, x: Any) -> bool:
    return (codec.batch is not None and not (codec.batch[0] == "timestamp" and isinstance(x, str))) or codec.encode is F.lit


def _settled(t: Table, rows: DataFrame, written: C | None = None) -> DataFrame:
    """Rows with their generated columns made anew; a null or a failed check in a written row raises when it is read."""
    written = F.lit(True) if written is None else written
    types = {f.name: f.dataType for f in rows.schema}
    made = {c.name: F.when(written, F.expr(c.generated).cast(types[c.name])).otherwise(F.col(quote(c.name))) for c in t.columns.values() if c.generated and c.name in types}
    rows = rows.withColumns(made)
    out = {}
    for k, c in t.columns.items():
        if c.not_null and not c.generated:
            null = F.raise_error(F.lit(f"{t.name}.{k} is null")).cast(types[c.name])
            out[c.name] = F.when(written & F.col(quote(c.name)).isNull(), null).otherwise(F.col(quote(c.name)))
    if t.checks:
        first = next(iter(t.columns.values())).name
        value = out.get(first, F.col(quote(first)))
        for name, text in t.checks.items():  # a check that is null holds
            value = F.when(written & ~F.coalesce(F.expr(text).cast("boolean"), F.lit(True)), F.raise_error(F.lit(f"{t.name}: {name} fails")).cast(types[first])).otherwise(value)
        out[first] = value
    return rows.withColumns(out)


def unique_sets(t: Table) -> list[tuple[str, ...]]:
    """Names of the columns of the primary key and of each unique constraint."""
    sets = [t.key, *t.uniques, *((k,) for k, c in t.columns.items() if c.unique)]
    return list(dict.fromkeys(tuple(t.columns[k].name for k in s) for s in sets if s))


def _live_keys(rows: DataFrame, keys: Sequence[str], where: str | None = None) -> DataFrame:
    """Rows that can clash on the keys: without nulls there, and within a partial index's predicate."""
    for k in keys:
        rows = rows.filter(F.col(quote(k)).isNotNull())
    return rows.filter(F.coalesce(F.expr(where), F.lit(False))) if where else rows


def insert(t: Table, old: DataFrame, new: DataFrame) -> Change:
    """new: rows of the table's columns; a column __n, if any, gives their order. A row whose key is taken refuses them all.

    Only the new rows' keys are looked up among the old ones.
    """
    rows = new.drop("__n").select(*old.columns)
    for keys in unique_sets(t):
        live = _live_keys(rows, keys).select(*[quote(k) for k in keys])
        if not check_unique(live, keys).isEmpty() or not live.join(old.select(*[quote(k) for k in keys]), list(keys), "left_semi").isEmpty():
            raise CompileError(f"{t.name}: a key of {', '.join(keys)} is taken")
    return Change(old.unionByName(rows), rows)


def insert_or_skip(t: Table, old: DataFrame, new: DataFrame) -> Change:
    """Insert the rows that clash with none on any unique constraint; of rows that clash with each other the first."""
    order = F.col("__n") if "__n" in new.columns else F.monotonically_increasing_id()
    rows = new.select(*old.columns, order.alias("__n"))
    sets = unique_sets(t)
    for keys in sets:
        rows = rows.join(_live_keys(old, keys).select(*[F.col(quote(k)).alias(f"__{i}") for i, k in enumerate(keys)]), [F.col(quote(k)) == F.col(f"__{i}") for i, k in enumerate(keys)], "left_anti")
    # row after row, in rounds: who is first under all its keys stays, and whoever meets one that stays goes
    taken, left = None, rows
    while sets:
        first = F.lit(True)
        for keys in sets:
            null = reduce(lambda a, b: a | b, [F.col(quote(k)).isNull() for k in keys])
            first = first & (null | (F.min("__n").over(Window.partitionBy(*[quote(k) for k in keys])) == F.col("__n")))
        marked = left.withColumn("__first", first)
        stays = marked.filter("__first").drop("__first")
        taken = stays if taken is None else taken.unionByName(stays)
        left = marked.filter("not __first").drop("__first")
        if len(sets) == 1 or left.isEmpty():
            break
        for keys in sets:
            left = left.join(stays.select(*[F.col(quote(k)).alias(f"__{i}") for i, k in enumerate(keys)]), [F.col(quote(k)) == F.col(f"__{i}") for i, k in enumerate(keys)], "left_anti")
    rows = (rows if taken is None else taken).select(*old.columns)
    return Change(old.unionByName(rows), rows)


class Pair(NamedTuple):
    """A row that is there and the row that came, as structs."""

    old: C
    excluded: C


def upsert(
    t: Table, old: DataFrame, new: DataFrame, target: Sequence[str], set_: Mapping[str, Callable[[C, C], C]] | None = None, where: Callable[[Pair], C] | None = None, target_where: str | None = None
) -> Change:
    """Insert rows whose target columns are new; for others do nothing, or set columns.

    set_: by column, a function of (existing value, incoming value). where: whether a row is changed, from the pair of
    structs `old` and `excluded`. Rows of a batch take effect one after the other, so that one with the key of an
    earlier one meets what that has made; a key's rows are folded in one place. Keys with nulls never clash, nor, with
    target_where (a partial index's predicate), rows that it doesn't hold for. affected: written rows, as they are then.
    """
    order = F.col("__n") if "__n" in new.columns else F.monotonically_increasing_id()
    keys = [t.columns[k].name for k in target]
    if set_:
        _refuse_guarded(t, set_)
    clashes = lambda rows: F.col("__live") & reduce(lambda a, b: a & b, [F.col(quote(k)).isNotNull() for k in keys])
    live = F.coalesce(F.expr(target_where), F.lit(False)) if target_where else F.lit(True)
    new = new.select(*old.columns, order.alias("__n"), live.alias("__live"))
    old = old.withColumn("__live", live)
    one = F.struct(*[quote(c) for c in old.columns if c != "__live"])
    came = new.filter(clashes(new)).groupBy(*[quote(k) for k in keys])
    came = came.agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", one.alias("row")))), lambda x: x["row"]).alias("came")) if set_ else came.agg(F.array(F.min_by(one, "__n")).alias("came"))
    came = came.select(*[F.col(quote(k)).alias(f"__{i}") for i, k in enumerate(keys)], "came")
    there = old.filter(clashes(old)).select(one.alias("old"))
    both = there.join(came, [F.col(f"old.{quote(k)}") == F.col(f"__{i}") for i, k in enumerate(keys)], "full")
    on_update = {c.name: c.on_update_fn() for c in t.columns.values() if c.on_update_fn} if set_ else {}
    schema = new.drop("__n", "__live").schema

    def step(acc: C, x: C) -> C:
        change = F.coalesce(where(Pair(acc["row"], x)), F.lit(False)) if where else F.lit(True)
        value = lambda c: set_[c](acc["row"][c], x[c]) if set_ and c in set_ else F.lit(on_update[c]) if c in on_update else acc["row"][c]
        changed = F.struct(*[value(c).cast(schema[c].dataType).alias(c) for c in schema.names])
        return F.when(acc["row"].isNull(), F.struct(x.alias("row"), F.lit(True).alias("new"))).when(F.lit(bool(set_)) & change, F.struct(changed.alias("row"), F.lit(True).alias("new"))).otherwise(acc).cast(state)

    state = f"struct<row:{schema.simpleString()},new:boolean>"
    start = F.struct(F.col("old").alias("row"), F.lit(False).alias("new")).cast(state)
    done = both.select(F.aggregate(F.coalesce("came", F.array().cast(f"array<{schema.simpleString()}>")), start, step).alias("x")).select("x.row.*", F.col("x.new").alias("__new"))
    apart = new.filter(~clashes(new)).select(*schema.names, F.lit(True).alias("__new")).unionByName(old.filter(~clashes(old)).select(*schema.names, F.lit(False).alias("__new")))
    done = _settled(t, done.unionByName(apart), F.col("__new"))
    return Change(done.drop("__new"), done.filter("__new").drop("__new"))


def _refuse_guarded(t: Table, set_: Mapping[str, Any]) -> None:
    guarded = set(t.columns) if t.append_only == () else set(t.append_only or ())
    if guarded & set(set_):
        raise CompileError(f"{t.name} is append-only in {', '.join(sorted(guarded & set(set_)))}")


def update(t: Table, old: DataFrame, set_: Mapping[str, Any], where: Any = None, **env: Any) -> Change:
    """Set columns of the rows that where keeps (all, without one); on-update and generated columns follow."""
    values = _checked(t, set_)
    _refuse_guarded(t, values)
    values |= {k: c.on_update_fn() for k, c in t.columns.items() if c.on_update_fn and k not in values}
    if not values:
        raise CompileError("nothing to set")
    rows = old.alias(t.qualifier)
    hit = F.coalesce(lower_(where, env), F.lit(False)) if where is not None else F.lit(True)
    cols = [F.when(F.col("__hit"), lower_(values[k], env, t[k].codec)).otherwise(F.col(quote(c.name))).cast(old.schema[c.name].dataType).alias(c.name) if k in values else F.col(quote(c.name)) for k, c in t.columns.items()]
    done = _settled(t, rows.withColumn("__hit", hit).alias(t.qualifier).select(*cols, "__hit"), F.col("__hit"))
    return Change(done.drop("__hit"), done.filter("__hit").drop("__hit"))


def delete(t: Table, old: DataFrame, where: Any = None, **env: Any) -> Change:
    if t.append_only is not None:
        raise CompileError(f"{t.name} is append-only")
    rows = old.alias(t.qualifier)
    hit = F.coalesce(lower_(where, env), F.lit(False)) if where is not None else F.lit(True)
    return Change(rows.filter(~hit), rows.filter(hit))


def delete_with_references(tables: Mapping[str, Table], frames: Mapping[str, DataFrame], name: str, where: Any = None, **env: Any) -> dict[str, Change]:
    """Delete from a table and do to the rows that refer to it what their columns' on_delete says; changes by table.

    cascade deletes them too, set null and set default write the column, restrict and no action refuse if any such row
    stays. References are followed from table to table until none is touched, round by round, also within one table.
    """
    gone = {name: delete(tables[name], frames[name], where, **env).affected}
    now = {name: delete(tables[name], frames[name], where, **env).rows}
    written: dict[str, list[DataFrame]] = {}
    refusing: list[tuple[str, Column, str, Column]] = []
    todo = [(name, gone[name])]
    while todo:
        parent, rows = todo.pop(0)
        if rows.isEmpty():
            continue
        for child, t in tables.items():
            for c in t.columns.values():
                if c.references is None or c.references[0] != parent:
                    continue
                key = tables[parent].columns[c.references[1]]
                have = now.get(child, frames[child])
                keys = rows.select(F.col(quote(key.name)).alias("__key")).filter("__key is not null").distinct()
                met = have.join(keys, F.col(quote(c.name)) == F.col("__key"), "left_semi")
                if c.on_delete == "cascade":
                    now[child] = have.join(keys, F.col(quote(c.name)) == F.col("__key"), "left_anti")
                    gone[child] = gone[child].unionByName(met) if child in gone else met
                    todo.append((child, met))
                elif c.on_delete in ("set null", "set default"):
                    value = F.lit(c.default if c.on_delete == "set default" else None)
                    flagged = have.join(keys, F.col(quote(c.name)) == F.col("__key"), "left")
                    hit = F.col("__key").isNotNull()
                    flagged = flagged.withColumn(c.name, F.when(hit, value).otherwise(F.col(quote(c.name))).cast(have.schema[c.name].dataType)).withColumn("__hit", hit).drop("__key")
                    flagged = _settled(t, flagged, F.col("__hit"))
                    now[child] = flagged.drop("__hit")
                    written.setdefault(child, []).append(flagged.filter("__hit").drop("__hit"))
                else:
                    refusing.append((child, c, parent, key))
    for child, c, parent, key in dict.fromkeys(refusing):  # what is left may be gone by another way
        keys = gone[parent].select(F.col(quote(key.name)).alias("__key"))
        if not now.get(child, frames[child]).join(keys, F.col(quote(c.name)) == F.col("__key"), "left_semi").isEmpty():
            raise CompileError(f"{child}.{c.name} refers to rows of {parent}")
    none = lambda n: frames[n].limit(0)
    return {n: Change(now[n], reduce(DataFrame.unionByName, [*([gone[n]] if n in gone else []), *written.get(n, [])], none(n))) for n in now}


def increment_one(t: Table, old: DataFrame, by: Mapping[str, Any], where: Any, set_: Mapping[str, Any] | None = None, **env: Any) -> Change:
    """Add to columns of one matching row, that of the least key, and set further ones."""
    grown = {k: Expr(lambda e, k=k, n=n: t[k].column(e) + F.lit(n)) for k, n in by.items()}
    return update(t, old, {**grown, **(set_ or {})}, _one(t, old, where, env), **env)


def consume_one(t: Table, old: DataFrame, where: Any, **env: Any) -> Change:
    """Delete one matching row, that of the least key, and return it."""
    return delete(t, old, _one(t, old, where, env), **env)


def _one(t: Table, old: DataFrame, where: Any, env: Mapping[str, Any]) -> Expr:
    if not t.key:
        raise CompileError(f"{t.name} has no primary key")
    names = [t.columns[k].name for k in t.key]
    first = old.alias(t.qualifier).filter(lower_(where, env)).agg(F.min(F.struct(*[quote(n) for n in names])).alias("k"))
    row = first.select("k.*").first()
    out = F.lit(False) if row is None or row[0] is None else F.lit(True)
    for n in names:
        out = out & (F.col(quote(n)) == F.lit(row[n])) if row is not None and row[0] is not None else out
    return Expr(lambda e: out)


def check_unique(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; keys with nulls never clash."""
    live = rows
    for c in columns:
        live = live.filter(F.col(quote(c)).isNotNull())
    return live.groupBy(*[quote(c) for c in columns]).agg(F.count("*").alias("rows")).filter("rows > 1")


def check_reference(child: DataFrame, columns: Sequence[str], parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Child rows whose key isn't null and has no parent."""
    live = child
    for c in columns:
        live = live.filter(F.col(quote(c)).isNotNull())
    ks = parent.select(*[F.col(quote(k)).alias(f"__p{i}") for i, k in enumerate(keys)])
    on = F.lit(True)
    for i, c in enumerate(columns):
        on = on & (F.col(quote(c)) == F.col(f"__p{i}"))
    return live.join(ks, on, "left_anti")


class CommitConflict(RuntimeError):
    """Another writer has made this version; read again and retry."""


class TableStore:
    """Versioned tables: a write makes new Parquet folders; one small commit file names all tables' current ones.

    A commit is a file named by its version and made only if there is none of that name, so that of two writers who
    start from one version the later is refused and none undoes the other. Reading a version reads its file alone.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _files(self) -> tuple[Any, Any]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_commits")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _commit(self, version: int) -> dict[str, str] | None:
        """Tables' folders as of a version; None for one that isn't there or whose writer was lost in the middle."""
        fs, path = self._files()
        file = self.spark._jvm.org.apache.hadoop.fs.Path(path, f"{version}.json")
        if not fs.exists(file):
            return None
        rows = self.spark.read.schema("table string, path string, last boolean").json(file.toString()).collect()
        return {r.table: r.path for r in rows if not r.last} if any(r.last for r in rows) else None

    def _versions(self) -> list[int]:
        """From the newest."""
        fs, path = self._files()
        if not fs.exists(path):
            return []
        return sorted((int(n) for f in fs.listStatus(path) if (n := f.getPath().getName().removesuffix(".json")).isdigit()), reverse=True)

    def _now(self) -> tuple[int, dict[str, str]]:
        return next(((v, c) for v in self._versions() if (c := self._commit(v)) is not None), (0, {}))

    def version(self) -> int:
        return self._now()[0]

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table as of a version, or as it is now."""
        found = self._now()[1] if version is None else self._commit(version)
        if found is None or table not in found:
            raise CompileError(f"no table {table}" + (f" as of version {version}" if version is not None else ""))
        return self.spark.read.parquet(found[table])

    def has(self, table: str) -> bool:
        return table in self._now()[1]

    def append(self, t: Table, new: DataFrame) -> None:
        """Insert rows into a table, which is made if it isn't there."""
        there = self.has(t.name)
        self.batch([lambda read: (t.name, insert(t, read(t.name) if there else new.limit(0), new))])

    def batch(self, steps: Sequence[Callable[[Callable[[str], DataFrame]], tuple[str, Change]]]) -> list[DataFrame]:
        """Run steps in order, each seeing the ones before; all tables move to the next version, or none if a step fails."""
        if not steps:
            return []
        now = dict(self._now()[1])
        n = max(self._versions(), default=0) + 1
        results = []
        for i, step in enumerate(steps):
            table, change = step(lambda name: self.spark.read.parquet(now[name]))
            path = f"{self.root}/{table}/v{n}-{i}-{uuid.uuid4().hex}"  # a batch that failed may have left files of the same version
            change.rows.write.parquet(f"{path}/rows")
            change.affected.write.parquet(f"{path}/affected")
            now[table] = f"{path}/rows"
            results.append(self.spark.read.parquet(f"{path}/affected"))
        lines = [json.dumps({"table": t, "path": p, "last": False}) for t, p in now.items()] + [json.dumps({"last": True})]
        fs, path = self._files()
        try:
            out = fs.create(self.spark._jvm.org.apache.hadoop.fs.Path(path, f"{n}.json"), False)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                raise CommitConflict(f"version {n} of {self.root} is made by another writer") from e
            raise
        out.write(bytearray("\n".join(lines).encode()))
        out.close()
        return results

    def transaction(self, *_: Any, **__: Any) -> None:
        raise CompileError("there are no interactive transactions; give the steps to batch()")
