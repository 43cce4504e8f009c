"""Migrations as a whole: round trips around a table that others refer to, and verification by replay."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from typing import Any

from ..functions.expressions import CompileError
from .kit import Journal, diff, impact_of, levels
from .schema import Column, Table

_TAG = Column("tag", "text", primary_key=True)


@dataclass(frozen=True)
class RoundTrip:
    """Statements that free a table from all that refer to it (`detach`) and put the references back (`attach`).

    scope: the table and its closure by level, each table behind all that it refers to. With `cycles` (tables that no
    order can place) the rest is empty.
    """

    scope: list[list[str]] = field(default_factory=list)
    cycles: list[str] = field(default_factory=list)
    detach: list[str] = field(default_factory=list)
    attach: list[str] = field(default_factory=list)


def round_trip(snap: Mapping[str, Any], name: str) -> RoundTrip:
    """The round trip around table `name`. A reference of a table to itself is no cycle and stays in place."""
    if name not in snap["tables"]:
        raise ValueError(f"no table {name}")
    inside = {name, *impact_of(snap["tables"], name)}
    level = levels({n: snap["tables"][n] for n in inside})
    if cycles := sorted(inside - set(level)):
        return RoundTrip(cycles=cycles)
    free = json.loads(json.dumps(snap))
    for n in inside:
        t = free["tables"][n]
        t["foreignKeys"] = [f for f in t["foreignKeys"] if f["table"] not in inside or f["table"] == n]
    scope = [sorted(n for n in inside if level[n] == i) for i in range(max(level.values()) + 1)]
    return RoundTrip(scope, [], diff(snap, free).statements, diff(free, snap).statements)


@dataclass(frozen=True)
class Migration:
    """A written migration: its statements, the schema after it, and the renames that it was told."""

    statements: tuple[str, ...]
    after: Mapping[str, Any]
    renamed_tables: Mapping[str, str] = field(default_factory=dict)
    renamed_columns: Mapping[str, Mapping[str, str]] = field(default_factory=dict)


def dangling(snap: Mapping[str, Any]) -> list[str]:
    """Foreign keys whose table or columns aren't there."""
    tables = snap["tables"]
    return [f"{n}: {f['name']} refers to {f['table']}" for n, t in tables.items() for f in t["foreignKeys"] if f["table"] not in tables or not {*f["target"]} <= {*tables[f["table"]]["columns"]}]


def verify(journal: Journal, migrations: Mapping[str, Migration], schema: Mapping[str, Any], applied: Iterable[str] = ()) -> list[str]:
    """What is wrong with the migrations, replayed in order from an empty schema; nothing if they lead to `schema`.

    Told are: tags without a migration and migrations without a tag, applied tags that the journal lacks, statements
    that aren't those which lead from one schema to the next, keys that refer to nothing, and what is left to `schema`.
    """
    found = [f"{x} has no entry in the journal" for x in sorted(set(migrations) - set(journal.entries))]
    found += [f"{x} is applied but has no entry in the journal" for x in sorted({a.removesuffix(".sql") for a in applied} - set(journal.entries))]
    now: Mapping[str, Any] = {"tables": {}}
    for tag in sorted(journal.entries):
        if (m := migrations.get(tag)) is None:
            found.append(f"{tag} has no migration")
            continue
        want = diff(now, m.after, m.renamed_tables, m.renamed_columns)
        found += [f"{tag}: {e}" for e in want.errors]
        if list(m.statements) != want.statements:
            found.append(f"{tag}: the statements don't lead from the schema before to the one after")
        found += [f"{tag}: {x}" for x in dangling(m.after)]
        now = m.after
    return found + [f"the schema needs: {s}" for s in diff(now, schema).statements]


def apply_migrations(journal: Journal, migrations: Mapping[str, Callable[[], None]], log: Callable[[], Iterable[str]], record: Callable[[str], None]) -> list[str]:
    """Run what is pending, in order, and record each once it has run; the tags that ran. log: the tags recorded so far.

    A migration that fails stops the rest and isn't recorded, so that the next call begins with it.
    """
    pending = journal.pending(log())
    if missing := [t for t in pending if t not in migrations]:
        raise CompileError(f"{missing[0]} has no migration")
    for tag in pending:
        migrations[tag]()
        record(tag)
    return pending


def migration_log(store: Any, table: str = "__migrations") -> tuple[Callable[[], list[str]], Callable[[str], None]]:
    """(log, record) that keep applied tags in a table of a versioned store."""
    spark, t = store.spark, Table(table, {"tag": _TAG}, primary_key=("tag",))

    def log() -> list[str]:
        return [r.tag for r in store.read(table).collect()] if store.has(table) else []

    def record(tag: str) -> None:
        new = spark.createDataFrame([(tag,)], "tag string")
        store.append(t, new)

    return log, record


@contextmanager
def unguarded(tables: dict[str, Table], name: str) -> Iterator[Table]:
    """A backfill of an append-only table: within the block the table is without its guard, which is put back in any case.

    tables: the declared tables, in which the guard is lifted and put back. A guard that has changed meanwhile is refused.
    """
    guard = tables[name].append_only
    if guard is None:
        raise CompileError(f"{name} has no guard")
    tables[name] = replace(tables[name], append_only=None)
    try:
        yield tables[name]
        if tables[name].append_only is not None:
            raise CompileError(f"{name} was guarded anew within the backfill")
    finally:
        tables[name] = replace(tables[name], append_only=guard)
