"""Schema kit: DDL text, snapshots, differences, order by foreign keys, impact, vocabulary, statements, migrations."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import CompileError
from .schema import Index, Table

ACTIONS = ("no action", "cascade", "set null", "set default", "restrict")


def ident(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def literal(v: Any) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, (bytes, bytearray)):
        return f"x'{v.hex()}'"
    return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def affinity(declared: str) -> str:
    """Storage class of a declared type, by the words it holds."""
    d = declared.upper()
    for words, out in ((("INT",), "integer"), (("CHAR", "CLOB", "TEXT"), "text"), (("BLOB",), "blob"), (("REAL", "FLOA", "DOUB"), "real")):
        if any(w in d for w in words):
            return out
    return "blob" if not d.strip() else "numeric"


_STORED = {"boolean": "integer", "timestamp": "integer", "timestamp_ms": "integer", "json": "text", "bigint": "blob", "any": "text"}


#: Types that a strict table may have.
STRICT_TYPES = ("int", "integer", "real", "text", "blob", "any")
COLLATIONS = ("binary", "nocase", "rtrim")


@dataclass(frozen=True)
class SqlText:
    """A default that is an expression."""

    text: str


def default_text(v: Any) -> str:
    """A default as DDL takes it: literals and CURRENT_* as they are, any other expression in parentheses."""
    if not isinstance(v, SqlText):
        return literal(v)
    t = v.text.strip()
    bare = r"current_(timestamp|date|time)|null|true|false|[+-]?(\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?|0x[0-9a-f]+|x?'([^']|'')*'"
    return t if t.startswith("(") or re.fullmatch(bare, t, re.I) else f"({t})"


def table_options(tables: Iterable[Table], options: Iterable[tuple[str, Mapping[str, Any]]]) -> list[Table]:
    """Tables with their options: strict, without_rowid, collate (by column; None retires one), append_only (True, or columns)."""
    found: dict[str, Mapping[str, Any]] = {}
    for name, o in options:
        if name in found:
            raise CompileError(f"options of {name} are declared twice")
        if more := set(o) - {"strict", "without_rowid", "collate", "append_only"}:
            raise CompileError(f"{name}: no option {sorted(more)[0]}")
        found[name] = o
    out = []
    for t in tables:
        o = found.pop(t.name, {})
        guard = o.get("append_only", t.append_only)
        if guard is not None and not isinstance(guard, bool) and not guard and "append_only" in o:
            raise CompileError(f"{t.name}: append_only without columns guards nothing")
        if unknown := sorted(set(o.get("collate", {})) - set(t.columns)):
            raise CompileError(f"{t.name} has no column {unknown[0]} to collate")
        cols = {k: replace(c, collate=o["collate"][k] or "binary") if k in o.get("collate", {}) else c for k, c in t.columns.items()}
        t = replace(t, columns=cols, strict=o.get("strict", t.strict), without_rowid=o.get("without_rowid", t.without_rowid), append_only=() if guard is True else None if guard is False or guard is None else tuple(sorted(set(guard))))
        if why := invalid_options(t):
            raise CompileError(why)
        out.append(t)
    if found:
        raise CompileError(f"options of {sorted(found)[0]}, which is no table")
    return out


def invalid_options(t: Table) -> str | None:
    """Why a table can't have its options, or None."""
    if t.without_rowid and not t.key:
        return f"{t.name} is without row ids and has no primary key"
    for k, c in t.columns.items():
        if t.without_rowid and c.autoincrement:
            return f"{t.name}.{k} numbers row ids, which the table is without"
        if t.strict and _declared(c).lower() not in STRICT_TYPES:
            return f"{t.name}.{k} is {_declared(c)}, which a strict table can't hold"
        if c.collate is not None and c.collate.lower() not in COLLATIONS:
            return f"{t.name}.{k}: no collation {c.collate}"
    if unknown := sorted(set(t.append_only or ()) - set(t.columns)):
        return f"{t.name} has no column {unknown[0]} to guard"
    return None


def _declared(c: Any) -> str:
    return _STORED.get(c.kind, c.kind)


def _checked_text(text: str, where: str) -> str:
    """The text of a check or predicate; an empty list in it would hold for nothing, or everything, unseen."""
    words = [m[0] for m in _TOKEN.finditer(text) if not m[0].isspace() and not m[0].startswith(("--", "/*"))]
    for i, w in enumerate(words[:-2]):
        if w.lower() == "in" and words[i + 1 : i + 3] == ["(", ")"]:
            raise CompileError(f"{where}: an empty list")
    return text


def _index(t: Table, x: Any) -> dict:
    x = x if isinstance(x, Index) else Index(x[1], x[0], x[2])
    parts = []
    for c in x.columns:
        key, down = (c, False) if isinstance(c, str) else (c[0], c[1] == "desc")
        parts.append({"column": t.columns[key].name, "desc": down} if key in t.columns else {"expression": key, "desc": down})
    if not x.name and any("expression" in p for p in parts):
        raise CompileError(f"{t.name}: an index on an expression needs a name")
    name = x.name or f"{t.name}_{'_'.join(p['column'] for p in parts)}_{'unique' if x.unique else 'index'}"
    return {"name": name, "columns": parts, "unique": x.unique, "where": None if x.where is None else _checked_text(x.where, name)}


def snapshot(tables: Iterable[Table]) -> dict:
    """The schema as plain data; names derived for unnamed constraints must be distinct."""
    out: dict[str, Any] = {"tables": {}}
    seen: set[str] = set()
    for t in tables:
        if why := invalid_options(t):
            raise CompileError(why)
        cols = {}
        for c in t.columns.values():
            cols[c.name] = {"type": _declared(c), "notNull": c.not_null or c.primary_key, "default": None if c.default is None else default_text(c.default), "generated": c.generated, "collate": c.collate, "unique": c.unique, "autoincrement": c.autoincrement}
        fks = [{"name": f"{t.name}_{c.name}_fk", "columns": [c.name], "table": c.references[0], "target": [c.references[1]], "onDelete": c.on_delete} for c in t.columns.values() if c.references]
        indexes = [_index(t, x) for x in t.indexes]
        for n in [x["name"] for x in (*fks, *indexes)]:
            if n in seen:
                raise ValueError(f"two constraints are named {n}")
            seen.add(n)
        checks = {n: _checked_text(c, f"{t.name}.{n}") for n, c in sorted(t.checks.items())}
        guard = None if t.append_only is None else sorted(t.columns[k].name for k in t.append_only)
        out["tables"][t.name] = {"columns": cols, "primaryKey": [t.columns[k].name for k in t.key], "uniques": sorted([t.columns[k].name for k in u] for u in t.uniques), "foreignKeys": sorted(fks, key=lambda f: f["name"]), "checks": checks, "indexes": indexes, "appendOnly": guard, "strict": t.strict, "withoutRowid": t.without_rowid}
    return out


def create_table(name: str, t: Mapping[str, Any]) -> str:
    parts, pk = [], t["primaryKey"]
    for n, c in t["columns"].items():
        words = [ident(n), c["type"]]
        words += [f"collate {c['collate']}"] if c["collate"] and c["collate"] != "binary" else []
        words += ["primary key" + " autoincrement" * bool(c.get("autoincrement"))] if pk == [n] else []
        words += ["not null"] if c["notNull"] and pk != [n] else []
        words += ["unique"] if c["unique"] else []
        words += [f"default {c['default']}"] if c["default"] is not None else []
        words += [f"generated always as ({c['generated']}) virtual"] if c["generated"] else []
        parts.append(" ".join(words))
    names = lambda xs: ", ".join(map(ident, xs))
    parts += [f"constraint {ident(name + '_pk')} primary key ({names(pk)})"] if len(pk) > 1 else []
    parts += [f"constraint {ident('_'.join([name, *u, 'unique']))} unique ({names(u)})" for u in t["uniques"]]
    parts += [f"constraint {ident(f['name'])} foreign key ({names(f['columns'])}) references {ident(f['table'])} ({names(f['target'])}) on delete {f['onDelete']}" for f in t["foreignKeys"]]
    parts += [f"constraint {ident(n)} check ({c})" for n, c in t["checks"].items()]
    options = ["strict"] * bool(t.get("strict")) + ["without rowid"] * bool(t.get("withoutRowid"))
    return f"create table {ident(name)} (\n  " + ",\n  ".join(parts) + "\n)" + (" " + ", ".join(options) if options else "")


def create_index(table: str, x: Mapping[str, Any]) -> str:
    parts = [(ident(c["column"]) if "column" in c else f"({c['expression']})") + " desc" * c["desc"] for c in x["columns"]]
    return f"create {'unique ' if x['unique'] else ''}index {ident(x['name'])} on {ident(table)} ({', '.join(parts)})" + (f" where {x['where']}" if x["where"] else "")


def guard_name(table: str) -> str:
    return f"{table}_guard"


def create_guard(name: str, columns: Iterable[str]) -> str:
    """What refuses updates of an append-only table, of all columns or of some."""
    of = ", ".join(map(ident, columns))
    return f"create trigger {ident(guard_name(name))} before update{f' of {of}' if of else ''} on {ident(name)} begin select raise(abort, 'append-only'); end"


def _guards(name: str, t: Mapping[str, Any]) -> list[str]:
    return [] if t["appendOnly"] is None else [create_guard(name, t["appendOnly"])]


def create_schema(snap: Mapping[str, Any]) -> list[str]:
    """Tables, parents first; then indexes; then guards of append-only tables."""
    tables = snap["tables"]
    order = topological(tables)
    return [create_table(n, tables[n]) for n in order] + [create_index(n, x) for n in order for x in tables[n]["indexes"]] + [g for n in order for g in _guards(n, tables[n])]


def _plain(text: str | None) -> str | None:
    """SQL text without white space outside quotes."""
    return None if text is None else "".join(m[0] if m[0][0] in "'\"`[" else m[0].lower() for m in _TOKEN.finditer(text) if not m[0].isspace())


def _bare(text: str | None) -> str | None:
    """Without the parentheses around all of it."""
    text = _plain(text)
    while text and text[0] == "(" and text[-1] == ")":
        depth = 0
        for i, m in enumerate(found := list(_TOKEN.finditer(text))):
            depth += (m[0] == "(") - (m[0] == ")")
            if depth == 0 and i < len(found) - 1:
                return text
        text = text[1:-1]
    return text


def canonical_index(x: Mapping[str, Any]) -> dict:
    """What an index is, whatever its name and spelling."""
    return {"columns": [(c.get("column"), _plain(c.get("expression")), c["desc"]) for c in x["columns"]], "unique": x["unique"], "where": _plain(x["where"])}


def canonical_table(t: Mapping[str, Any], like: Mapping[str, Any] | None = None) -> dict:
    """A table in the one form in which two that mean the same are equal.

    Types by affinity (as declared in strict tables), a lone primary key not null, defaults without outer parentheses,
    texts without white space, constraints sorted, `binary` as no collation. A collation that isn't stated is that of
    the same column in `like`, the live table.
    """
    cols = {}
    for n, c in t["columns"].items():
        live = like["columns"].get(n, {}).get("collate") if like else None
        collate = (c["collate"] or live or "binary").lower()
        cols[n] = {"type": c["type"].lower() if t.get("strict") else affinity(c["type"]), "notNull": c["notNull"] or t["primaryKey"] == [n], "default": _bare(c["default"]), "generated": _bare(c["generated"]), "collate": None if collate == "binary" else collate, "unique": c["unique"], "autoincrement": bool(c.get("autoincrement"))}
    fks = sorted(({k: v for k, v in f.items() if k != "name"} for f in t["foreignKeys"]), key=str)
    return {"columns": cols, "primaryKey": t["primaryKey"], "uniques": sorted(t["uniques"]), "foreignKeys": fks, "checks": sorted(_bare(c) for c in t["checks"].values()), "strict": bool(t.get("strict")), "withoutRowid": bool(t.get("withoutRowid"))}


def _parents(tables: Mapping[str, Any]) -> dict[str, set[str]]:
    return {n: {f["table"] for f in t["foreignKeys"]} & set(tables) for n, t in tables.items()}


def topological(tables: Mapping[str, Any]) -> list[str]:
    """Parents before children; a cycle is entered at its first table by name."""
    parents, out, seen = _parents(tables), [], set()
    for start in sorted(tables):
        stack = [(start, iter(sorted(parents[start])))] if start not in seen else []
        seen.add(start)
        while stack:
            node, it = stack[-1]
            nxt = next((p for p in it if p not in seen), None)
            if nxt is None:
                out.append(node)
                stack.pop()
            else:
                seen.add(nxt)
                stack.append((nxt, iter(sorted(parents[nxt]))))
    return out


def impact_of(tables: Mapping[str, Any], name: str) -> list[str]:
    """Tables that refer to this one, directly or through others; a table is never in its own closure."""
    parents = _parents(tables)
    found, queue = set(), [name]
    while queue:
        at = queue.pop()
        for child, ps in parents.items():
            if at in ps and child not in found and child != name:
                found.add(child)
                queue.append(child)
    return sorted(found)


def impact_ranking(tables: Mapping[str, Any]) -> list[tuple[str, int]]:
    return sorted(((n, len(impact_of(tables, n))) for n in tables), key=lambda x: (-x[1], x[0]))


def levels(tables: Mapping[str, Any]) -> dict[str, int]:
    """Longest path from a table without parents; tables on cycles have none."""
    parents, out = {n: ps - {n} for n, ps in _parents(tables).items()}, {}
    while ready := [n for n, ps in parents.items() if n not in out and all(p in out for p in ps)]:
        out |= {n: 1 + max((out[p] for p in parents[n]), default=-1) for n in ready}
    return out


def impact_closure(edges: DataFrame, name: str) -> DataFrame:
    """The same closure over an edge table (child, parent), as rows (name); a round per level."""
    reached = {name}
    front, found = [name], []
    while front:
        # only the last round's tables are asked for; both lists are as long as there are tables in the schema
        more = edges.filter(F.col("parent").isin(front)).select("child").distinct().collect()
        front = sorted({r.child for r in more} - reached)
        reached |= set(front)
        found += front
    return edges.sparkSession.createDataFrame([(n,) for n in found], "name string")


def impact_with_rows(tables: Mapping[str, Any], frames: Mapping[str, DataFrame], name: str) -> list[tuple[str, bool, int]]:
    """(table, whether it refers to this one directly, its rows) of all that an impact reaches."""
    parents = _parents(tables)
    return [(n, name in parents[n], frames[n].count()) for n in impact_of(tables, name)]


@dataclass
class Difference:
    statements: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)


def _rebuild(old: Mapping[str, Any], new: Mapping[str, Any]) -> bool:
    """Whether a change needs a new table: anything but added nullable or constant-default columns, plain drops and indexes."""
    a, b = canonical_table(old), canonical_table(new, old)
    if any(a[k] != b[k] for k in ("primaryKey", "uniques", "foreignKeys", "checks", "strict", "withoutRowid")):
        return True
    for n, c in b["columns"].items():
        if n in a["columns"]:
            if a["columns"][n] != c:
                return True
        elif c["unique"] or (c["notNull"] and c["default"] is None) or (new["columns"][n]["default"] or "").startswith("("):
            return True
    gone = set(a["columns"]) - set(b["columns"])
    texts = [*old["checks"].values(), *(c["generated"] or "" for c in old["columns"].values())]
    return any(a["columns"][n]["unique"] for n in gone) or any(_mentions(x, n) for n in gone for x in texts)


def _mentions(text: str, name: str) -> bool:
    return any(_named(m[0]) == name.lower() for m in _TOKEN.finditer(text))


def _named(token: str) -> str:
    """The name that a token of SQL text stands for, lower-cased; strings and signs stand for none."""
    if token[0] in '"`[':
        return token[1:-1].lower()
    return token.lower() if token[0].isalpha() or token[0] == "_" else ""


def _renamed(text: str | None, a: str, b: str) -> str | None:
    """SQL text with a column's name replaced."""
    new = b if re.fullmatch(r"[A-Za-z_]\w*", b) else ident(b)
    return None if text is None else "".join((ident(b) if m[0][0] in '"`[' else new) if _named(m[0]) == a.lower() else m[0] for m in _TOKEN.finditer(text))


def _rename_column(tables: dict[str, Any], table: str, a: str, b: str) -> None:
    """Follow a renamed column to all that names it, in its own table and in those that refer to it."""
    t, swap = tables[table], lambda cols: [b if c == a else c for c in cols]
    t["columns"] = {b if k == a else k: {**v, "generated": _renamed(v["generated"], a, b)} for k, v in t["columns"].items()}
    t["primaryKey"], t["uniques"] = swap(t["primaryKey"]), sorted(map(swap, t["uniques"]))
    t["checks"] = {n: _renamed(c, a, b) for n, c in t["checks"].items()}
    t["appendOnly"] = None if t["appendOnly"] is None else sorted(swap(t["appendOnly"]))
    for x in t["indexes"]:
        x["columns"] = [{**c, "column": b if c["column"] == a else c["column"]} if "column" in c else {**c, "expression": _renamed(c["expression"], a, b)} for c in x["columns"]]
        x["where"] = _renamed(x["where"], a, b)
    for f in t["foreignKeys"]:
        f["columns"] = swap(f["columns"])
    for other in tables.values():
        for f in other["foreignKeys"]:
            f["target"] = swap(f["target"]) if f["table"] == table else f["target"]


def _in_turn(names: Mapping[str, str], taken: set[str]) -> list[tuple[str, str]]:
    """Renames in an order in which no name is taken twice; a cycle goes by way of a name of its own."""
    left, out = dict(names), []
    while left:
        free = next((a for a, b in left.items() if b not in left and b not in taken - set(left)), None)
        if free is None:
            a, b = next(iter(left.items()))
            spare = f"__old_{a}"
            out.append((a, spare))
            left = {spare if k == a else k: v for k, v in left.items()}
            taken = (taken - {a}) | {spare}
            if b in taken - set(left):
                return []
            continue
        out.append((free, left.pop(free)))
        taken = (taken - {free}) | {out[-1][1]}
    return out


def diff(before: Mapping[str, Any], after: Mapping[str, Any], renamed_tables: Mapping[str, str] | None = None, renamed_columns: Mapping[str, Mapping[str, str]] | None = None) -> Difference:
    """Statements that lead from one snapshot to the other: renames, creations, drops, changes; children are dropped first.

    renamed_columns goes by the tables' new names. A table that others refer to isn't rebuilt: dropping it would act on
    their rows; `round_trip` gives the statements around it.
    """
    out, old, new = Difference(), json.loads(json.dumps(before["tables"])), after["tables"]
    for a, b in (renamed_tables or {}).items():
        if a not in old or b in old:
            out.errors.append(f"{a} can't be renamed to {b}")
            continue
        out.statements.append(f"alter table {ident(a)} rename to {ident(b)}")
        old[b] = old.pop(a)
        for t in old.values():
            for f in t["foreignKeys"]:
                f["table"] = b if f["table"] == a else f["table"]
    for n, names in (renamed_columns or {}).items():
        cols = set(old[n]["columns"]) if n in old else set()
        if missing := [a for a in names if a not in cols]:
            out.errors += [f"{n} has no column {a}" for a in missing]
            continue
        turns = _in_turn(names, cols)
        if not turns:
            out.errors.append(f"{n}: a new name is taken")
        for a, b in turns:
            out.statements.append(f"alter table {ident(n)} rename column {ident(a)} to {ident(b)}")
            _rename_column(old, n, a, b)
    for n in topological(new):
        if n not in old:
            out.statements += [create_table(n, new[n]), *(create_index(n, x) for x in new[n]["indexes"]), *_guards(n, new[n])]
    for n in reversed(topological(old)):
        if n not in new:
            out.statements.append(f"drop table {ident(n)}")
            out.warnings.append(f"{n} is dropped with its rows")
    for n in topological(new):
        if n not in old:
            continue
        a, b = old[n], new[n]
        if _rebuild(a, b):
            referring = sorted(m for m, t in old.items() if m != n and m in new and any(f["table"] == n for f in t["foreignKeys"]) and any(f["table"] == n for f in new[m]["foreignKeys"]))
            if referring:
                out.errors.append(f"{n} can't be rebuilt while {', '.join(referring)} refer to it")
            # a collation that isn't stated stays
            made = {**b, "columns": {c: {**d, "collate": d["collate"] or a["columns"].get(c, {}).get("collate")} for c, d in b["columns"].items()}}
            common = ", ".join(ident(c) for c in b["columns"] if c in a["columns"] and not b["columns"][c]["generated"] and not a["columns"][c]["generated"])
            temp = f"__new_{n}"
            copy = [f"insert into {ident(temp)} ({common}) select {common} from {ident(n)}"] if common else []
            out.statements += [create_table(temp, made), *copy, f"drop table {ident(n)}", f"alter table {ident(temp)} rename to {ident(n)}", *(create_index(n, x) for x in b["indexes"]), *_guards(n, b)]
            continue
        if a["appendOnly"] != b["appendOnly"] and a["appendOnly"] is not None:
            out.statements.append(f"drop trigger {ident(guard_name(n))}")
        for c, d in b["columns"].items():
            if c not in a["columns"]:
                out.statements.append(f"alter table {ident(n)} add column {ident(c)} {d['type']}" + (f" collate {d['collate']}" if d["collate"] and d["collate"] != "binary" else "") + (" not null" if d["notNull"] else "") + (f" default {d['default']}" if d["default"] is not None else "") + (f" generated always as ({d['generated']}) virtual" if d["generated"] else ""))
        was, now = ({x["name"]: canonical_index(x) for x in t["indexes"]} for t in (a, b))
        for name in was:
            if was[name] != now.get(name):
                out.statements.append(f"drop index {ident(name)}")
        for c in a["columns"]:
            if c not in b["columns"]:
                out.statements.append(f"alter table {ident(n)} drop column {ident(c)}")
                out.warnings.append(f"{n}.{c} is dropped with its values")
        out.statements += [create_index(n, x) for x in b["indexes"] if now[x["name"]] != was.get(x["name"])]
        if a["appendOnly"] != b["appendOnly"]:
            out.statements += _guards(n, b)
    return out


def introspect(frames: Mapping[str, DataFrame], declared: Mapping[str, Any] | None = None) -> dict:
    """A snapshot of live tables: columns, types and nullability from the rows, the rest from the snapshot that declares them.

    Of a declared table only that is taken whose columns are there; declared tables that aren't there are left out.
    """
    kinds = {"bigint": "integer", "int": "integer", "smallint": "integer", "double": "real", "float": "real", "binary": "blob", "string": "text"}
    out: dict[str, Any] = {"tables": {}}
    for n, df in frames.items():
        said = (declared or {"tables": {}})["tables"].get(n, {})
        have = set(df.columns)
        cols = {}
        for f in df.schema:
            c = said.get("columns", {}).get(f.name, {})
            kind = kinds.get(f.dataType.simpleString(), f.dataType.simpleString())
            cols[f.name] = {"type": c["type"] if c and affinity(c["type"]) == affinity(kind) else kind, "notNull": c.get("notNull", not f.nullable), **{k: c.get(k, d) for k, d in (("default", None), ("generated", None), ("collate", None), ("unique", False), ("autoincrement", False))}}
        whole = lambda names: set(names) <= have
        pk = said.get("primaryKey", [])
        out["tables"][n] = {
            "columns": cols, "primaryKey": pk if whole(pk) else [], "uniques": [u for u in said.get("uniques", []) if whole(u)], "foreignKeys": [f for f in said.get("foreignKeys", []) if whole(f["columns"])], "checks": dict(said.get("checks", {})),
            "indexes": [x for x in said.get("indexes", []) if whole(c["column"] for c in x["columns"] if "column" in c)], "appendOnly": said.get("appendOnly"), "strict": said.get("strict", False), "withoutRowid": said.get("withoutRowid", False),
        }
    return out


def vocabulary_divergences(values: DataFrame) -> DataFrame:
    """(name, small, large) of tables whose values of a column are a strict subset of another's. values: table_name, column_name, value."""
    sets = values.distinct().groupBy("column_name", "table_name").agg(F.collect_set("value").alias("vs"))
    a, b = sets.alias("a"), sets.alias("b")
    on = (F.col("a.column_name") == F.col("b.column_name")) & (F.col("a.table_name") != F.col("b.table_name"))
    strict = (F.size(F.array_except("a.vs", "b.vs")) == 0) & (F.size("a.vs") < F.size("b.vs"))
    return a.join(b, on).filter(strict).select(F.col("a.column_name").alias("name"), F.col("a.table_name").alias("small"), F.col("b.table_name").alias("large"))


_TOKEN = re.compile(r"""'(?:[^']|'')*'|"(?:[^"]|"")*"|`(?:[^`]|``)*`|\[[^\]]*\]|--[^\n]*|/\*.*?(?:\*/|\Z)|;|\w+|[^\w]""", re.S)


def split_statements(text: str) -> list[str]:
    """Statements between semicolons that aren't within quotes, comments or trigger bodies."""
    out, cur, depth, words = [], [], 0, []
    for m in _TOKEN.finditer(text):
        t = m[0]
        if t == ";" and depth == 0:
            out.append("".join(cur).strip())
            cur, words = [], []
            continue
        if t[0].isalpha():
            words.append(t.lower())
            trigger = words[0] == "create" and "trigger" in words[:4]
            depth += trigger and words[-1] in ("begin", "case")
            depth -= trigger and words[-1] == "end" and depth > 0
        cur.append(t)
    return [s for s in [*out, "".join(cur).strip()] if s]


_TAG = re.compile(r"[A-Za-z0-9_-]+")


@dataclass
class Journal:
    """Ordered migrations: tags `0000_name`; what isn't applied yet is pending, in order."""

    entries: list[str] = field(default_factory=list)

    def add(self, name: str) -> str:
        if not _TAG.fullmatch(name):
            raise ValueError(f"not a tag: {name}")
        tag = f"{len(self.entries):04d}_{name}"
        self.entries.append(tag)
        return tag

    def pending(self, applied: Iterable[str]) -> list[str]:
        done = {a.removesuffix(".sql") for a in applied}
        return [e for e in sorted(self.entries) if e not in done]
