"""The schema kit: differences, options, round trips, migrations and their verification; query events."""

from dataclasses import replace

import pytest

from tessera.functions import expressions as X
from tessera.functions.expressions import CompileError
from tessera.operators.mutations import TableStore, update
from tessera.operators.select import query
from tessera.sources import kit
from tessera.sources.events import Compiled, Watched, scan_warning
from tessera.sources.replay import Migration, apply_migrations, dangling, migration_log, round_trip, unguarded, verify
from tessera.sources.schema import Column, Database, Index, Table


def table(name, *parents):
    cols = {"id": Column("id", "integer", primary_key=True)}
    return Table(name, cols | {p: Column(p, "integer", references=(p, "id")) for p in parents})


def test_round_trip():
    snap = kit.snapshot([table("a"), table("b", "a"), table("c", "a", "b"), table("d", "d"), table("e", "a", "e")])
    trip = round_trip(snap, "a")
    assert trip.scope == [["a"], ["b", "e"], ["c"]] and trip.cycles == []
    drops = lambda xs: [s for s in xs if s.startswith("drop table")]
    assert drops(trip.attach) == ['drop table "b"', 'drop table "c"', 'drop table "e"']
    assert sorted(drops(trip.detach)) == ['drop table "b"', 'drop table "c"', 'drop table "e"']
    made = next(s for s in trip.detach if s.startswith('create table "__new_e"'))
    assert 'references "e"' in made and 'references "a"' not in made
    alone = round_trip(snap, "d")
    assert alone.scope == [["d"]] and alone.detach == alone.attach == []
    with pytest.raises(ValueError):
        round_trip(snap, "nope")


def test_round_trip_reports_cycles():
    snap = kit.snapshot([table("a"), table("b", "a", "c"), table("c", "b")])
    trip = round_trip(snap, "a")
    assert trip.cycles == ["b", "c"] and trip.scope == [] and trip.detach == []


def test_verify():
    one, two = kit.snapshot([table("a")]), kit.snapshot([table("a"), table("b", "a")])
    j = kit.Journal()
    first, second = j.add("first"), j.add("second")
    steps = {first: Migration(tuple(kit.diff({"tables": {}}, one).statements), one), second: Migration(tuple(kit.diff(one, two).statements), two)}
    assert verify(j, steps, two) == []
    assert verify(kit.Journal(), {}, {"tables": {}}) == []
    assert verify(j, steps, one) == ['the schema needs: drop table "b"']
    assert verify(j, {first: steps[first]}, one) == [f"{second} has no migration"]
    assert verify(j, {**steps, "0009_x": steps[first]}, two, ["0007_y.sql"]) == ["0009_x has no entry in the journal", "0007_y is applied but has no entry in the journal"]
    edited = {**steps, second: Migration(("drop table a",), two)}
    assert len(verify(j, edited, two)) == 1 and verify(j, edited, two)[0].startswith(second)
    lost = kit.snapshot([table("b", "a")])
    assert dangling(lost) == ["b: b_a_fk refers to a"] and dangling(two) == []


def test_verify_follows_renames():
    old, new = kit.snapshot([table("a")]), kit.snapshot([table("z")])
    j = kit.Journal()
    first, second = j.add("first"), j.add("second")
    steps = {first: Migration(tuple(kit.diff({"tables": {}}, old).statements), old), second: Migration(('alter table "a" rename to "z"',), new, {"a": "z"})}
    assert verify(j, steps, new) == []


def test_migrations_are_applied_once(spark, tmp_path):
    store, j, ran = TableStore(spark, str(tmp_path)), kit.Journal(), []
    tags = [j.add(n) for n in ("one", "two", "three")]
    log, record = migration_log(store)
    steps = {t: (lambda t=t: ran.append(t)) for t in tags}
    steps[tags[1]] = lambda: 1 // 0
    with pytest.raises(ZeroDivisionError):
        apply_migrations(j, steps, log, record)
    assert log() == tags[:1]
    steps[tags[1]] = lambda: ran.append(tags[1])
    assert apply_migrations(j, steps, log, record) == tags[1:] and ran == tags and sorted(log()) == tags
    assert apply_migrations(j, steps, log, record) == []
    j.add("four")
    with pytest.raises(CompileError):
        apply_migrations(j, steps, log, record)


def test_backfill_puts_the_guard_back(spark):
    tables = {"t": Table("t", {"id": Column("id"), "n": Column("n")}, append_only=("n",)), "u": Table("u", {"id": Column("id")})}
    old = spark.createDataFrame([(1, 1)], "id long, n long")
    with unguarded(tables, "t") as t:
        assert update(t, old, {"n": 5}).rows.first().n == 5
    with pytest.raises(CompileError):
        update(tables["t"], old, {"n": 5})
    with pytest.raises(ZeroDivisionError), unguarded(tables, "t"):
        1 // 0
    assert tables["t"].append_only == ("n",)
    with pytest.raises(CompileError), unguarded(tables, "u"):
        pass


def test_renames_are_followed():
    a = Table("a", {"id": Column("id", "integer", primary_key=True), "x": Column("x", "integer"), "y": Column("y", "integer"), "g": Column("g", "integer", generated="x * 2")}, uniques=(("x", "y"),), checks={"c": "x > 0 and y <> 'x'"}, indexes=(Index(("x", ("y", "desc")), where="x is not null"), Index(("lower(x)",), "low")), append_only=("x",))
    b = Table("b", {"id": Column("id", "integer", primary_key=True), "of": Column("of", "integer", references=("a", "id"))})
    col = lambda k, n, t=a: replace(t.columns[k], name=n)
    named = replace(a, columns={"id": col("id", "key"), "x": col("x", "z"), "y": col("y", "y"), "g": replace(a.columns["g"], generated="z * 2")}, checks={"c": "z > 0 and y <> 'x'"}, indexes=(Index(("x", ("y", "desc")), "a_x_y_index", where="z is not null"), Index(("lower(z)",), "low")))
    other = replace(b, columns={**b.columns, "of": replace(b.columns["of"], references=("a", "key"))})
    d = kit.diff(kit.snapshot([a, b]), kit.snapshot([named, other]), renamed_columns={"a": {"x": "z", "id": "key"}})
    assert d.errors == [] and d.statements == ['alter table "a" rename column "x" to "z"', 'alter table "a" rename column "id" to "key"']
    swapped = replace(a, columns={**a.columns, "x": col("x", "y"), "y": col("y", "x"), "g": replace(a.columns["g"], generated="y * 2")}, checks={"c": "y > 0 and x <> 'x'"}, indexes=(Index(("x", ("y", "desc")), "a_x_y_index", where="y is not null"), Index(("lower(y)",), "low")))
    d = kit.diff(kit.snapshot([a]), kit.snapshot([swapped]), renamed_columns={"a": {"x": "y", "y": "x"}})
    assert d.errors == [] and len(d.statements) == 3 and all("rename column" in s for s in d.statements)


def test_rebuilds_and_guards():
    a = Table("a", {"id": Column("id", "integer", primary_key=True), "x": Column("x", "text", collate="nocase")})
    b = Table("b", {"id": Column("id", "integer", primary_key=True), "of": Column("of", "integer", references=("a", "id"))})
    wide = replace(a, columns={**a.columns, "x": Column("x", "integer")})
    assert kit.diff(kit.snapshot([a, b]), kit.snapshot([wide, b])).errors == ["a can't be rebuilt while b refer to it"]
    assert kit.diff(kit.snapshot([a]), kit.snapshot([wide])).errors == []
    # a collation that isn't stated stays; "binary" retires it
    plain = replace(a, columns={**a.columns, "x": Column("x", "text")})
    assert kit.diff(kit.snapshot([a]), kit.snapshot([plain])).statements == []
    assert "collate" not in kit.diff(kit.snapshot([a]), kit.snapshot([replace(a, columns={**a.columns, "x": Column("x", "text", collate="binary")})])).statements[0]
    kept = kit.diff(kit.snapshot([a]), kit.snapshot([replace(plain, checks={"c": "x <> ''"})])).statements[0]
    assert "collate nocase" in kept
    guarded = replace(a, append_only=("x",))
    assert [s.split(" before")[0] for s in kit.diff(kit.snapshot([a]), kit.snapshot([guarded])).statements] == ['create trigger "a_guard"']
    assert kit.diff(kit.snapshot([guarded]), kit.snapshot([a])).statements == ['drop trigger "a_guard"']
    assert kit.diff({"tables": {}}, kit.snapshot([guarded])).statements[-1].startswith('create trigger "a_guard" before update of "x" on "a"')
    assert kit.diff(kit.snapshot([guarded]), kit.snapshot([replace(guarded, checks={"c": "1"})])).statements[-1].startswith("create trigger")
    # spelling doesn't count
    one, two = (kit.snapshot([replace(a, checks={"c": c}, indexes=(Index(("x",), where=w),), columns={**a.columns, "n": Column("n", "integer", default=d)})]) for c, w, d in (("x > 1", "x  IS not null", kit.SqlText("1 + 1")), ("( X>1 )", "x is NOT NULL", kit.SqlText("(1+1)"))))
    assert kit.diff(one, two).statements == []
    x = kit.snapshot([replace(a, indexes=(Index((("x", "desc"),), "i", unique=True, where="x > 0"),))])
    assert kit.diff(kit.snapshot([replace(a, indexes=(Index(("x",), "i"),))]), x).statements == ['drop index "i"', 'create unique index "i" on "a" ("x" desc) where x > 0']


def test_table_options():
    t = Table("t", {"id": Column("id", "integer", primary_key=True), "n": Column("n", "numeric"), "s": Column("s", "text", default=kit.SqlText("lower('A')"))})
    ok = replace(t, columns={k: c for k, c in t.columns.items() if k != "n"})
    (made,) = kit.table_options([ok], [("t", {"strict": True, "without_rowid": True, "append_only": True, "collate": {"s": "nocase"}})])
    text = kit.create_schema(kit.snapshot([made]))
    assert text[0].endswith("strict, without rowid") and "collate nocase" in text[0] and "default (lower('A'))" in text[0] and "before update on" in text[1]
    bad = [
        ([t], [("t", {"strict": True})]), ([Table("t", {"x": Column("x", "text")})], [("t", {"without_rowid": True})]), ([ok], [("t", {}), ("t", {})]), ([ok], [("u", {})]), ([ok], [("t", {"nope": 1})]),
        ([ok], [("t", {"append_only": []})]), ([ok], [("t", {"append_only": ["nope"]})]), ([ok], [("t", {"collate": {"nope": "nocase"}})]), ([ok], [("t", {"collate": {"s": "klingon"}})]),
        ([replace(ok, columns={**ok.columns, "id": Column("id", "integer", primary_key=True, autoincrement=True)})], [("t", {"without_rowid": True})]),
    ]
    for tables, options in bad:
        with pytest.raises(CompileError):
            kit.table_options(tables, options)
    for text in ("x in ()", "x IN ( /* none */ )"):
        with pytest.raises(CompileError):
            kit.snapshot([replace(ok, checks={"c": text})])
    kit.snapshot([replace(ok, checks={"c": "s <> 'in ()' and s in (1)"})])
    assert [kit.default_text(kit.SqlText(x)) for x in ("CURRENT_DATE", "-1.5e3", "'a'", "'a' || 'b'", "(1)", "x'00'")] == ["CURRENT_DATE", "-1.5e3", "'a'", "('a' || 'b')", "(1)", "x'00'"]


def test_query_events(spark):
    df = spark.range(1000)
    db = Database(spark, frames={"t": df})
    t = db.table("t")
    q = query(db).from_(t).where(X.lt(t["id"], X.ph("most")))
    for development in (False, True):
        told = []
        rows = Watched(db, told.append, development).all(q, most=5)
        (e,) = told
        assert len(rows) == 5 and (e.kind, e.tables, e.rows_returned) == ("select", ("t",), 5) and e.rows_read >= 5 and bool(e.params) == development
    assert scan_warning(replace(e, rows_read=1000)) and scan_warning(replace(e, rows_read=40)) is None
    c = Compiled(q).bind(most=3)
    assert len(c.all()) == 3 and len(c.all(most=4)) == 4 and len(c.bind(most=1).all()) == 1


def test_impact_with_rows(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("a", "a")], "child string, parent string")
    assert sorted(r.name for r in kit.impact_closure(edges, "a").collect()) == ["b", "c"] and kit.impact_closure(edges, "zz").count() == 0
    snap = kit.snapshot([Table("a", {"id": Column("id", primary_key=True)}), Table("b", {"id": Column("id", primary_key=True), "a": Column("a", references=("a", "id"))}), Table("c", {"b": Column("b", references=("b", "id"))})])
    assert kit.impact_with_rows(snap["tables"], {n: spark.range(k) for n, k in (("a", 1), ("b", 2), ("c", 3))}, "a") == [("b", True, 2), ("c", False, 3)]


def test_introspection_keeps_what_is_declared(spark):
    a = Table("a", {"id": Column("id", "integer", primary_key=True), "x": Column("x", "boolean", unique=True, default=1), "gone": Column("gone", "text")}, uniques=(("x", "gone"),), indexes=(Index(("x",), "i"), Index(("gone",), "j")))
    live = kit.introspect({"a": spark.createDataFrame([], "id long, x int, n double"), "b": spark.range(1)}, kit.snapshot([a]))
    t = live["tables"]["a"]
    assert t["primaryKey"] == ["id"] and t["uniques"] == [] and [x["name"] for x in t["indexes"]] == ["i"] and t["columns"]["x"]["unique"] and list(t["columns"]) == ["id", "x", "n"]
    assert live["tables"]["b"]["primaryKey"] == []
    assert kit.diff(live, kit.snapshot([a])).statements


def test_catalog(spark):
    a = Table("a", {"id": Column("id", primary_key=True), "b": Column("b", references=("b", "id")), "c": Column("c", unique=True)}, indexes=(Index(("b",)),))
    rows = Database(spark, frames={"a": spark.createDataFrame([], "id long, b long, c string")}).catalog(a).collect()
    assert [tuple(r)[1:] for r in rows] == [("id", 1, "bigint", 1, True, False, None), ("b", 2, "bigint", None, False, True, "b.id"), ("c", 3, "string", None, True, False, None)]
