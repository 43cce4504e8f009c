"""Relational operators: every registered query against its SQL, and the edge semantics."""

import datetime
import os
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions import expressions as X
from tessera.operators import mutations as M
from tessera.operators.relations import Loader, RelationGraph, many, one
from tessera.operators.select import query
from tessera.plans import catalog
from tessera.sources import kit
from tessera.sources.schema import Column, Database, Table, snake_case

DATA = "/root/testdata/sf0.001"


def canon(v):
    if isinstance(v, float):
        return round(v, 4)
    return v if v is None or isinstance(v, (bool, int)) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        c.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    want = duck.sql(catalog.ORACLE_SQL[name])
    rows = lambda cols, data: sorted(repr([canon(v) for _, v in sorted(zip(cols, r, strict=True))]) for r in data)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_whole_joins(spark):
    """The joins see every order and line."""
    big = "/root/testdata/sf0.1"
    orders, lines = spark.read.parquet(f"{big}/orders.parquet"), spark.read.parquet(f"{big}/lineitem.parquet")
    n, bare = lines.count(), orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left_anti").count()
    assert bare > 0
    count = lambda name: catalog.QUERIES[name](spark, big).count()
    got = [count(x) for x in ("J1_inner_join", "J2_left_join", "J3_right_join", "J4_full_join", "P2_implicit_join_groups", "R3_load_through")]
    assert got == [n, n + bare, n, n + bare, n + bare, orders.count()]
    assert catalog.QUERIES["J11_junction_join"](spark, big).select("o_orderkey").distinct().count() == orders.count() - bare


@pytest.fixture(scope="module")
def blog(spark):
    users = spark.createDataFrame([(1, "Ada", True), (2, "Bob", False), (3, None, True)], "id long, name string, active boolean")
    posts = spark.createDataFrame([(10, 1, "first", 5), (11, 1, "second", 50), (12, 2, "third", 1), (13, None, "lost", 9)], "id long, author_id long, title string, views long")
    tags = spark.createDataFrame([(10, "sql"), (10, "d1"), (11, "sql")], "post_id long, tag string")
    names = spark.createDataFrame([("sql",), ("d1",), ("none",)], "tag string")
    db = Database(spark, frames={"users": users, "posts": posts, "post_tags": tags, "tags": names})
    tables = {n: db.table(n, k) for n, k in (("users", ("id",)), ("posts", ("id",)), ("post_tags", ()), ("tags", ("tag",)))}
    graph = RelationGraph(tables, {
        "users": {"posts": many("posts"), "popular": many("posts", "id", "author_id", where={"views": {"gte": 50}}), "by_active": many("posts", alias="active")},
        "posts": {"author": one("users", "author_id", "id"), "active_author": one("users", "author_id", "id", where={"active": True}, alias="active"), "tags": many("tags", "id", "tag", through=("post_tags", ("post_id",), ("tag",)))},
        "tags": {"posts": many("posts")},
    })
    return db, graph


def test_relations(blog):
    db, graph = blog
    load = Loader(db, graph)
    got = {r.id: r for r in load.find_many("users", {"with": {"posts": {"columns": {"id": True}, "order_by": {"views": "desc"}}, "popular": True}}).collect()}
    assert [p.id for p in got[1].posts] == [11, 10] and [p.id for p in got[1].popular] == [11] and got[3].posts == []
    posts = {r.id: r for r in load.find_many("posts", {"with": {"author": {"columns": {"name": True}}, "tags": True}}).collect()}
    assert posts[13].author is None and posts[10].author.name == "Ada" and [t.tag for t in posts[10].tags] == ["d1", "sql"] and posts[12].tags == []
    # an adopted relation with a where asks it of its own source
    reversed_ = {r.id: len(r.by_active) for r in load.find_many("users", {"with": {"by_active": True}}).collect()}
    assert reversed_ == {1: 2, 2: 0, 3: 0}
    ids = lambda where: sorted(r.id for r in load.find_many("users", {"columns": {"id": True}, "where": where}).collect())
    assert ids({"posts": False}) == [3] and ids({"posts": None}) == [1, 2] and ids({"NOT": {"posts": {"views": {"gt": 10}}}}) == [2, 3]
    assert ids({"AND": [], "OR": []}) == [1, 2, 3] and ids({"name": {"isNull": False}}) == [1, 2, 3]
    for bad in ({"nope": 1}, {"id": {"near": 1}}, {"id": {"in": 3}}, {"id": {"arrayContains": 1}}):
        with pytest.raises(X.CompileError):
            load.find_many("users", {"where": bad})
    with pytest.raises(X.CompileError):
        load.find_many("users", {"columns": {}})
    assert load.find_first("users", {"where": {"id": 99}}) is None


def test_groups_and_pages(blog):
    db, _ = blog
    u, p = db.table("users", ("id",)), db.table("posts", ("id",))
    rows = query(db).from_(u).full_join(p, X.eq(u["id"], p["author_id"])).df().collect()
    assert any(r.users is None and r.posts.id == 13 for r in rows) and any(r.posts is None and r.users.id == 3 for r in rows)
    q = query(db).from_(u).select({"id": u["id"]}).order_by(X.desc(u["id"]))
    assert [r.id for r in q.limit(X.ph("n")).all(n=2.9)] == [3, 2] and len(q.limit(-1).all()) == 3 and q.get().id == 3
    for bad in (lambda: q.limit(float("nan")).df(), lambda: q.limit(X.ph("n")).df(), lambda: query(db).from_(u).select({}), lambda: u["nope"]):
        with pytest.raises(X.CompileError):
            bad()


def test_predicates(spark):
    df = spark.createDataFrame([("a%b\\c",), ("Abc",), (None,), ("x[1]",), ("Ä",)], "s string")
    t = Table("t", {"s": Column("s")})
    ask = lambda e: [r.s for r in df.alias("t").filter(e.column({})).collect()]
    assert ask(X.like(t["s"], "a%")) == ["a%b\\c", "Abc"] and ask(X.like(t["s"], "a_b\\c")) == ["a%b\\c"] and ask(X.like(t["s"], "ä")) == []
    assert ask(X.glob(t["s"], "x[[]1]")) == ["x[1]"] and ask(X.glob(t["s"], "[A-B]??")) == ["Abc"] and ask(X.glob(t["s"], "a*")) == ["a%b\\c"]
    assert len(ask(X.not_in(t["s"], []))) == 5 and ask(X.in_(t["s"], [])) == [] and ask(X.not_in(t["s"], ["Abc", None])) == []
    assert X.and_(None, None) is None and ask(X.or_(None, X.is_null(t["s"]))) == [None]


def test_not_in_query(spark):
    """As SQL has it, nulls included, and joined by key: Spark's own form broadcasts the rows whatever the threshold."""
    c = duckdb.connect()
    outer, lists = [1, 2, 3, 3, None], {"some": [1, 3, 3, 7], "null": [1, None], "nulls": [None], "none": []}
    frame = lambda values: spark.createDataFrame([(v,) for v in values], "k long")
    sql = lambda values: f"(select unnest({values!r}::bigint[]) as k)".replace("None", "null")
    db = Database(spark, frames={"t": frame(outer), **{n: frame(v) for n, v in lists.items()}})
    t = db.table("t")
    default = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, values in lists.items():
            s = query(db).from_(db.table(name))
            hit, miss = X.in_(t["k"], s), X.not_in(t["k"], s)
            cases = [
                (miss, "k not in S"), (X.not_(hit), "k not in S"), (X.not_(miss), "k in S"), (X.or_(miss, X.eq(t["k"], 3)), "k not in S or k = 3"),
                (X.not_(X.or_(hit, X.eq(t["k"], 2))), "not (k in S or k = 2)"), (X.not_(X.and_(hit, X.eq(t["k"], 3))), "not (k in S and k = 3)"), (X.not_in(X.add(t["k"], 1), s), "k + 1 not in S"),
                (X.not_in(t["k"], s.df()), "k not in S"),
            ]
            for e, text in cases:
                df = query(db).from_(t).where(e).df()
                assert "Broadcast" not in df._jdf.queryExecution().sparkPlan().toString(), (name, text)
                want = c.sql(f"select k from {sql(outer)} where {text.replace('S', sql(values))}").fetchall()
                assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr), (name, text)
            got = query(db).from_(t).select({"k": t["k"], "out": miss}).df().collect()
            want = c.sql(f"select k, k not in {sql(values)} from {sql(outer)}").fetchall()
            assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr), name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", default)


def test_mutations(spark, tmp_path):
    t = Table("t", {"id": Column("id", primary_key=True), "n": Column("n", default=7), "at": Column("at", on_update_fn=lambda: 99)}, primary_key=("id",))
    old = spark.createDataFrame([(1, 1, 0), (2, None, 0)], "id long, n long, at long")
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    new = M.new_rows(spark, t, old, [{"id": 3}, {"id": 4, "n": None}, {"id": 1, "n": 5, "at": 1}])
    assert rows(M.upsert(t, old, new, ["id"]).rows) == [(1, 1, 0), (2, None, 0), (3, 7, 99), (4, None, 99)]
    up = M.upsert(t, old, new, ["id"], {"n": lambda a, b: a + b})
    assert (1, 6, 99) in rows(up.rows) and up.changes() == 3
    assert rows(M.update(t, old, {"n": 0}, X.gt(t["n"], 0)).rows) == [(1, 0, 99), (2, None, 0)]
    assert rows(M.delete(t, old, X.gt(t["n"], 0)).rows) == [(2, None, 0)]
    for bad in (lambda: M.new_rows(spark, t, old, []), lambda: M.update(t, old, {"x": 1}), lambda: M.delete(Table("t", t.columns, append_only=()), old)):
        with pytest.raises(X.CompileError):
            bad()
    store = M.TableStore(spark, str(tmp_path))
    assert store.batch([]) == []
    store.batch([lambda read: ("t", M.insert(t, old.limit(0), old))])
    with pytest.raises(ZeroDivisionError):
        store.batch([lambda read: ("t", M.delete(t, read("t"))), lambda read: 1 // 0])
    assert rows(store.read("t")) == rows(old)
    store.batch([lambda read: ("t", M.delete(t, read("t"), X.eq(t["id"], 1))), lambda read: ("t", M.update(t, read("t"), {"n": 3}))])
    assert rows(store.read("t")) == [(2, 3, 99)] and rows(store.read("t", 1)) == rows(old) and store.version() == 2


def test_batches_of_codecs_and_checks(spark):
    """Many rows with codecs are one plan; nulls and failed checks refuse the write; generated columns follow updates and upserts."""
    t = Table("t", {"id": Column("id", "integer", primary_key=True), "ok": Column("ok", "boolean"), "doc": Column("doc", "json"), "at": Column("at", "timestamp"), "n": Column("n", "integer", not_null=True), "twice": Column("twice", "integer", generated="n * 2")}, checks={"small": "n < 100000"})
    old = spark.createDataFrame([], "id long, ok int, doc string, at long, n long, twice long")
    when = datetime.datetime(2024, 5, 6, 7, 8, 9)
    began = time.time()
    new = M.new_rows(spark, t, old, [{"id": i, "ok": i % 2 == 0, "doc": {"i": i}, "at": when, "n": i} for i in range(5000)])
    done = M.insert(t, old, new).rows.collect()
    assert time.time() - began < 30 and len(done) == 5000
    assert tuple(min(done)) == (0, 1, '{"i":0}', spark.sql("select unix_seconds(timestamp'2024-05-06 07:08:09') as x").first().x, 0, 0) and all(r.twice == 2 * r.n for r in done)
    one = M.insert(t, old, M.new_rows(spark, t, old, [{"id": 1, "n": 3}, {"id": 2, "n": X.add(1, 1)}])).rows
    assert [(r.n, r.twice) for r in M.update(t, one, {"n": 7}, X.eq(t["id"], 1)).rows.orderBy("id").collect()] == [(7, 14), (2, 4)]
    up = M.upsert(t, one, M.new_rows(spark, t, one, [{"id": 1, "n": 1}, {"id": 1, "n": 2}]), ["id"], {"n": lambda a, b: a + b})
    assert [(r.n, r.twice) for r in up.rows.orderBy("id").collect()] == [(6, 12), (2, 4)]
    for bad in (lambda: M.update(t, one, {"n": None}), lambda: M.update(t, one, {"n": 100000}), lambda: M.upsert(t, one, M.new_rows(spark, t, one, [{"id": 1, "n": 5}]), ["id"], {"n": lambda a, b: b * 100000})):
        with pytest.raises(Exception, match="is null|small fails"):
            bad().rows.collect()
    assert M.update(t, one, {"n": None}, X.eq(t["id"], 99)).rows.count() == 2  # only written rows are looked at
    guarded = Table("t", t.columns, append_only=("n",))
    with pytest.raises(X.CompileError, match="append-only"):
        M.upsert(guarded, one, one, ["id"], {"n": lambda a, b: b})
    with pytest.raises(X.CompileError, match="generated"):
        M.update(t, one, {"twice": 3})


def test_upsert_targets(spark):
    t = Table("t", {"id": Column("id"), "kind": Column("kind"), "n": Column("n")}, primary_key=("id",))
    old = spark.createDataFrame([(1, "a", 1), (2, None, 2), (3, "b", 30)], "id long, kind string, n long")
    new = spark.createDataFrame([(4, "a", 10, 0), (5, None, 20, 1), (6, "b", 40, 2), (7, "a", 100, 3)], "id long, kind string, n long, __n int")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    got = M.upsert(t, old, new, ["kind"], {"n": lambda a, b: a + b})
    assert [(r[0], r[2]) for r in sorted(got.rows.collect(), key=lambda r: r.id)] == [(1, 111), (2, 2), (3, 70), (5, 20)] and got.changes() == 3
    # a partial index: only rows below 25 clash, so 30 and 40 don't, nor 100 with 1
    got = M.upsert(t, old, new, ["kind"], {"n": lambda a, b: a + b}, target_where="n < 25")
    assert rows(got.rows.select("id", "n")) == [(1, 11), (2, 2), (3, 30), (5, 20), (6, 40), (7, 100)]
    assert rows(M.upsert(t, old, new, ["kind"]).rows.select("id")) == [(1,), (2,), (3,), (5,)]
    for empty in (old.limit(0), old):
        assert M.upsert(t, empty, new.limit(0), ["kind"], {"n": lambda a, b: b}).rows.count() == empty.count()


def test_references(spark):
    tables = {
        "a": Table("a", {"id": Column("id"), "up": Column("up", references=("a", "id"), on_delete="cascade")}, primary_key=("id",)),
        "b": Table("b", {"id": Column("id"), "a": Column("a", references=("a", "id"), on_delete="set null"), "n": Column("n", references=("a", "id"), on_delete="set default", default=9)}, primary_key=("id",)),
        "c": Table("c", {"b": Column("b", references=("b", "id"))}),
    }
    frames = {"a": spark.createDataFrame([(1, None), (2, 1), (3, 2), (9, None)], "id long, up long"), "b": spark.createDataFrame([(1, 3, 9), (2, 9, 1)], "id long, a long, n long"), "c": spark.createDataFrame([(1,)], "b long")}
    done = M.delete_with_references(tables, frames, "a", X.eq(tables["a"]["id"], 1))
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert rows(done["a"].rows) == [(9, None)] and done["a"].changes() == 3
    assert rows(done["b"].rows) == [(1, None, 9), (2, 9, 9)] and done["b"].changes() == 2 and "c" not in done
    with pytest.raises(X.CompileError, match="c.b refers"):
        M.delete_with_references(tables, frames, "b")


def test_two_writers(spark, tmp_path):
    t = Table("t", {"id": Column("id")}, primary_key=("id",))
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    store, other = M.TableStore(spark, str(tmp_path)), M.TableStore(spark, str(tmp_path))
    store.batch([lambda read: ("t", M.insert(t, rows(), rows(1)))])

    def late(read):
        old = read("t")
        other.batch([lambda read: ("t", M.insert(t, read("t"), rows(2)))])
        return "t", M.insert(t, old, rows(3))

    with pytest.raises(M.CommitConflict):
        store.batch([late])
    assert sorted(r.id for r in store.read("t").collect()) == [1, 2] and store.version() == 2
    assert [r.id for r in store.read("t", 1).collect()] == [1]
    for v in (0, 3):
        with pytest.raises(X.CompileError):
            store.read("t", v)
    with pytest.raises(X.CompileError):
        store.transaction(lambda: None)
    (tmp_path / "_commits" / "3.json").write_text("")  # a writer lost in the middle: its version never was
    assert store.version() == 2
    store.batch([lambda read: ("t", M.insert(t, read("t"), rows(4)))])
    assert store.version() == 4 and store.read("t").count() == 3


def test_relation_errors(blog):
    db, graph = blog
    tables = graph.tables
    bad = [
        {"users": {"name": many("posts", "id", "author_id")}}, {"users": {"x": many("nope", "id", "id")}}, {"users": {"x": many("posts", alias="")}}, {"users": {"x": many("posts", "id")}},
        {"users": {"x": many("posts", ("id", "name"), "author_id")}}, {"users": {"x": many("posts", "nope", "author_id")}}, {"users": {"x": many("posts", "id", "nope")}},
        {"users": {"x": many("tags", "id", "tag", through=("nope", ("post_id",), ("tag",)))}}, {"users": {"x": many("tags", "id", "tag", through=("post_tags", ("nope",), ("tag",)))}}, {"users": {"x": many("tags", "id", "tag", through=("post_tags", (), ("tag",)))}},
        {"users": {"x": many("posts")}}, {"users": {"x": many("posts")}, "posts": {"a": one("users", "author_id", "id"), "b": one("users", "id", "id")}}, {"users": {"x": many("posts")}, "posts": {"a": one("tags", "title", "tag")}},
        {"users": {"x": many("posts")}, "posts": {"a": one("users")}}, {"nope": {}},
    ]
    for relations in bad:
        with pytest.raises(X.CompileError):
            RelationGraph(tables, relations)
    for empty in ([], ()):
        with pytest.raises(X.CompileError):
            many("posts", empty, "id")


def test_keys_of_different_types_are_refused(spark):
    db = Database(spark, frames={"a": spark.createDataFrame([(1,)], "id long"), "b": spark.createDataFrame([("1",)], "a string"), "c": spark.createDataFrame([(1,)], "a int")})
    graph = RelationGraph({n: db.table(n) for n in "abc"}, {"a": {"bs": many("b", "id", "a"), "cs": many("c", "id", "a"), "through": many("b", "id", "a", through=("c", ("a",), ("a",)))}})
    load = Loader(db, graph)
    for ask in ({"with": {"bs": True}}, {"where": {"bs": True}}, {"with": {"through": True}}):
        with pytest.raises(X.CompileError, match="bigint|int"):
            load.find_many("a", ask)
    assert load.find_many("a", {"with": {"cs": True}}).first().cs[0].a == 1


def test_page_is_taken_before_children(spark):
    s = catalog.Star(spark, DATA)
    rows = s.loader().find_many("customer", {"with": {"orders": True}, "limit": 5})
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    group = plan[plan.index("Aggregate [__k0") :]
    assert "LeftSemi" in group and "GlobalLimit 5" in group and plan.count("GlobalLimit 5") >= 2
    assert [r.c_custkey for r in rows.collect()] == sorted(r.c_custkey for r in s.db.frame("customer").collect())[:5]


def test_fragments_and_refusals(spark, blog):
    db, _ = blog
    u = db.table("users", ("id",))
    ask = lambda e, **env: [r.id for r in query(db).from_(u).select({"id": u["id"]}).where(e).df(**env).collect()]
    assert ask(X.sql("{} in {} or {}", u["id"], [1, 3], X.sql("{} = {}", u["name"], "Bob"))) == [1, 2, 3]
    assert ask(X.sql("{} = {}{}", X.identifier("users", "name"), X.ph("who"), X.empty()), who="Ada") == [1]
    assert ask(X.join([X.sql("{} > {}", u["id"], 1), X.sql("{} is null", u["name"])], " and ")) == [3]
    assert ask(X.sql("{} = {}", u["name"], "' or true or '")) == []
    with pytest.raises(X.CompileError):
        X.sql("{} = {}", 1)
    # a bare column beside an aggregate, and an order outside DISTINCT, are refused
    with pytest.raises(Exception, match="MISSING_AGGREGATION|MISSING_GROUP_BY"):
        query(db).from_(u).select({"id": u["id"], "n": X.count()}).df()
    with pytest.raises(X.CompileError):
        query(db).from_(u).select({"a": u["active"]}).distinct().order_by(u["name"]).df()
    assert [r.a for r in query(db).from_(u).select({"a": u["active"]}).distinct().order_by(X.desc(u["active"])).all()] == [True, False]


def test_kit():
    a = Table("a", {"id": Column("id", "integer", primary_key=True), "x": Column("x", "text", default="o'k")})
    b = Table("b", {"id": Column("id", "integer", primary_key=True), "a": Column("a", "integer", references=("a", "id"), on_delete="cascade")}, indexes=(("", ("a",), False),))
    before, after = kit.snapshot([a]), kit.snapshot([b, a])
    assert kit.create_schema(after)[0].startswith('create table "a"') and "default 'o''k'" in kit.create_schema(after)[0]
    d = kit.diff(before, after)
    assert [s.split("(")[0].strip() for s in d.statements] == ['create table "b"', 'create index "b_a_index" on "b"']
    assert kit.diff(after, before).statements == ['drop table "b"'] and kit.diff(after, after).statements == []
    c = kit.snapshot([Table("a", {**a.columns, "y": Column("y", "integer")})])
    assert kit.diff(before, c).statements == ['alter table "a" add column "y" integer']
    c = kit.snapshot([Table("a", {**a.columns, "x": Column("x", "integer", default=1)})])
    assert len(kit.diff(before, c).statements) == 4
    assert kit.topological(after["tables"]) == ["a", "b"] and kit.impact_of(after["tables"], "a") == ["b"] and kit.levels(after["tables"]) == {"a": 0, "b": 1}
    assert kit.split_statements("a ';' ; -- ;\nb; create trigger t begin x; y; end; c") == ["a ';'", "-- ;\nb", "create trigger t begin x; y; end", "c"]
    j = kit.Journal()
    assert [j.add("x"), j.add("y")] == ["0000_x", "0001_y"] and j.pending(["0000_x.sql"]) == ["0001_y"]
    assert snake_case("createdAt") == "created_at" and kit.affinity("VARCHAR(3)") == "text" and kit.affinity("") == "blob"
    with pytest.raises(ValueError):
        j.add("no spaces")


def test_codecs(spark):
    t = Table("c", {"at": Column("at", "timestamp"), "ok": Column("ok", "boolean")})
    db = Database(spark, frames={"c": spark.createDataFrame([(1, 1), (None, 0)], "at long, ok int")})
    assert [(r.at and r.at.timestamp(), r.ok) for r in query(db).from_(t).df().select(F.col("at"), "ok").collect()] == [(1.0, True), (None, False)]
    assert query(db).from_(t).where(X.eq(t["ok"], True)).df().count() == 1
