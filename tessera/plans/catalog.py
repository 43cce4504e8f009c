"""Registered queries of the relational operators over the generated tables, each with its SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import (
    Expr, add, and_, asc, avg, between, coalesce, collate, contains, count, count_distinct, desc, divide, ends_with, eq, eq_folded, exists, glob, gt, gte, identifier, ilike, in_, in_folded, is_not_null, is_null, length, like, lower, lt, lte, max_, min_, multiply, ne, ne_folded, not_, not_between, not_exists, not_ilike, not_in, not_in_folded, not_like, or_, param_fn, ph, raw, sql, starts_with, subtract, sum_, upper,
)
from ..operators.adapter import Adapter, Where
from ..operators.mutations import TableStore, check_reference, check_unique, consume_one, delete, delete_with_references, increment_one, insert, insert_or_skip, new_rows, update, upsert
from ..operators.relations import Loader, RelationGraph, many, one
from ..operators.select import Select, latest_per_group, query
from ..sources.kit import impact_closure, vocabulary_divergences
from ..sources.schema import Column, Database, Table, alias_of, list_source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

KEYS = {"region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",), "events": ("event_id",), "conversations": ("conv_id", "turn")}


class Star:
    """The star schema's tables, query builder and relation graph."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.db = spark, Database(spark, folder)

    def __getattr__(self, name: str) -> Table:
        return self.db.table(name, KEYS.get(name, ()))

    def q(self, source: object = None) -> Select:
        return query(self.db).from_(source) if source is not None else query(self.db)

    def loader(self) -> Loader:
        names = ("region", "nation", "customer", "orders", "lineitem", "part", "conversations")
        edges = {
            "region": {"nations": many("nation")}, "nation": {"region": one("region", "n_regionkey", "r_regionkey"), "customers": many("customer")},
            "customer": {"nation": one("nation", "c_nationkey", "n_nationkey"), "orders": many("orders"), "open_orders": many("orders", "c_custkey", "o_custkey", where={"o_orderstatus": "O"})},
            "orders": {"customer": one("customer", "o_custkey", "c_custkey"), "lines": many("lineitem", "o_orderkey", "l_orderkey"), "parts": many("part", "o_orderkey", "p_partkey", through=("lineitem", ("l_orderkey",), ("l_partkey",)))},
            "part": {"orders": many("orders")},
            "conversations": {"same": many("conversations", ("conv_id", "turn"), ("conv_id", "turn"))},
        }
        return Loader(self.db, RelationGraph({n: getattr(self, n) for n in names}, edges))


def _query(name: str, sql: str | None):
    def register(f: Callable[[Star], DataFrame]):
        QUERIES[name] = lambda spark, folder: f(Star(spark, folder))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


# --- sources, projection, predicates


@_query("S1_select_filter_project", "SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_totalprice > 100000 AND o_orderstatus <> 'F' AND o_totalprice <= 400000 AND o_orderpriority >= '2' AND o_orderpriority < '5'")
def _(s):
    o = s.orders
    return s.q(o).select({"id": o["o_orderkey"], "price": o["o_totalprice"]}).where(and_(gt(o["o_totalprice"], 100000), ne(o["o_orderstatus"], "F"), lte(o["o_totalprice"], 400000), gte(o["o_orderpriority"], "2"), lt(o["o_orderpriority"], "5"))).df()


@_query("S2_self_join_alias", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def _(s):
    a, b = alias_of(s.nation, "a"), alias_of(s.nation, "b")
    return s.q(a).inner_join(b, and_(eq(a["n_regionkey"], b["n_regionkey"]), lt(a["n_nationkey"], b["n_nationkey"]))).select({"a": a["n_name"], "b": b["n_name"]}).df()


@_query("S3_subquery_from", "SELECT k AS custkey, n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) x WHERE n > 12")
def _(s):
    o = s.orders
    x = s.q(o).select({"k": o["o_custkey"], "n": count()}).group_by(o["o_custkey"]).as_("x")
    return s.q(x).select({"custkey": x["k"], "n": x["n"]}).where(gt(x["n"], 12)).df()


@_query("S4_aliased_subquery", "WITH x AS (SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY 1) SELECT a.k AS k, a.n + b.n AS n FROM x a JOIN x b ON a.k = b.k")
def _(s):
    t = s.nation
    x = s.q(t).select({"k": t["n_regionkey"], "n": count()}).group_by(t["n_regionkey"]).as_("x")
    a, b = x.renamed("a"), x.renamed("b")
    return s.q(a).inner_join(b, eq(a["k"], b["k"])).select({"k": a["k"], "n": add(a["n"], b["n"])}).df()


@_query("S5_no_from", "SELECT 1 + 2 AS three, 'x' AS x")
def _(s):
    return s.q().select({"three": raw("1 + 2"), "x": raw("'x'")}).df()


@_query("S6_raw_statement", "SELECT c_nationkey AS r, count(*) AS n FROM customer WHERE c_acctbal < 5000 GROUP BY c_nationkey")
def _(s):
    return s.db.execute("SELECT c_nationkey AS r, count(*) AS n FROM customer WHERE c_acctbal < :most GROUP BY c_nationkey", {"most": 5000}, ("customer",))


@_query("S7_raw_fragment", "SELECT c_custkey, upper(substr(c_mktsegment, 1, 3)) AS seg FROM customer WHERE c_acctbal * 2 > 900")
def _(s):
    c = s.customer
    return s.q(c).select({"c_custkey": c["c_custkey"], "seg": raw("upper(substr(c_mktsegment, 1, 3))")}).where(raw("c_acctbal * 2 > 900")).df()


@_query("S8_foreign_expression", "SELECT c_custkey, round(c_acctbal, 0) AS bal FROM customer WHERE c_acctbal > 9000")
def _(s):
    c = s.customer
    return s.q(c).select({"c_custkey": c["c_custkey"], "bal": F.round("c_acctbal", 0)}).where(F.col("c_acctbal") > 9000).df()


@_query("S9_list_source", "SELECT n_name FROM nation WHERE n_nationkey IN (1, 3, 5)")
def _(s):
    t = s.nation
    return s.q(t).select({"n_name": t["n_name"]}).where(in_(t["n_nationkey"], list_source(s.spark, "[1,3,5]", "int"))).df()


@_query("P1_implicit_projection", "SELECT * FROM region")
def _(s):
    return s.q(s.region).df()


@_query("P2_implicit_join_groups", "SELECT o.o_orderkey AS id, l.l_partkey AS part, l.l_orderkey IS NULL AS missed FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey")
def _(s):
    o, line = s.orders, s.lineitem
    rows = s.q(o).left_join(line, eq(o["o_orderkey"], line["l_orderkey"])).df()
    return rows.select(F.col("orders.o_orderkey").alias("id"), F.col("lineitem.l_partkey").alias("part"), F.col("lineitem").isNull().alias("missed"))


@_query("P4_nested_projection", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS seg FROM customer")
def _(s):
    c = s.customer
    return s.q(c).select({"id": c["c_custkey"], "who": {"name": c["c_name"], "more": {"seg": c["c_mktsegment"]}}}).df().select("id", "who.name", "who.more.seg")


@_query("P5_key_collision", "SELECT a.n_name AS left_name, b.r_name AS right_name FROM nation a JOIN region b ON a.n_regionkey = b.r_regionkey")
def _(s):
    n, r = s.nation, s.region
    return s.q(n).inner_join(r, eq(n["n_regionkey"], r["r_regionkey"])).select({"a": {"name": n["n_name"]}, "b": {"name": r["r_name"]}}).df().select(F.col("a.name").alias("left_name"), F.col("b.name").alias("right_name"))


@_query("P7_distinct_rows", "SELECT DISTINCT l_returnflag AS f, l_linestatus AS s FROM lineitem")
def _(s):
    t = s.lineitem
    return s.q(t).select({"f": t["l_returnflag"], "s": t["l_linestatus"]}).distinct().df()


@_query("P9_explicit_group_collapse", "SELECT d.doc_id AS id, l.doc_id IS NULL AS missed, l.toxic AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(s):
    d, t = s.documents, s.labels
    rows = s.q(d).left_join(t, eq(d["doc_id"], t["doc_id"])).select({"id": d["doc_id"], "label": {"toxic": t["toxic"], "quality": t["quality"]}}).df()
    return rows.select("id", F.col("label").isNull().alias("missed"), F.col("label.toxic").alias("toxic"))


@_query("P13_extras", "SELECT n_nationkey, n_name, length(n_name) AS size FROM nation")
def _(s):
    return s.loader().find_many("nation", {"columns": {"n_nationkey": True, "n_name": True}, "extras": {"size": lambda t, x: F.length("n_name").cast("long")}})


@_query("P14_column_choice", "SELECT n_nationkey, n_regionkey FROM nation")
def _(s):
    return s.loader().find_many("nation", {"columns": {"n_name": False}})


def _where(name: str, table: str, key: str, condition, sql: str) -> None:
    @_query(name, f"SELECT {key} FROM {table} WHERE {sql}")
    def _(s):
        t = getattr(s, table)
        return s.q(t).select({key: t[key]}).where(condition(s, t)).df()


_where("F7_like_folds_case", "customer", "c_custkey", lambda s, t: like(t["c_mktsegment"], "%BUILD%"), "c_mktsegment ILIKE '%BUILD%'")
_where("F8_not_like", "customer", "c_custkey", lambda s, t: not_like(t["c_mktsegment"], "b_il%"), "c_mktsegment NOT ILIKE 'b_il%'")
_where("F9_ilike", "part", "p_partkey", lambda s, t: ilike(t["p_type"], "%ono%"), "p_type ILIKE '%ono%'")
_where("F10_not_ilike", "part", "p_partkey", lambda s, t: not_ilike(t["p_type"], "_r%"), "p_type NOT ILIKE '_r%'")
_where("F11_glob", "part", "p_partkey", lambda s, t: glob(t["p_brand"], "Brand#[1-3]*"), "p_brand GLOB 'Brand#[1-3]*'")
_where("F12_is_null", "documents", "doc_id", lambda s, t: or_(is_null(t["text"]), eq(t["lang"], "de")), "text IS NULL OR lang = 'de'")
_where("F13_is_not_null", "documents", "doc_id", lambda s, t: and_(is_not_null(t["text"]), eq(t["lang"], "fr")), "text IS NOT NULL AND lang = 'fr'")
_where("F14_and_or_not", "orders", "o_orderkey", lambda s, t: and_(or_(eq(t["o_orderstatus"], "F"), gt(t["o_totalprice"], 400000)), not_(eq(t["o_orderpriority"], "1-URGENT")), None), "(o_orderstatus = 'F' OR o_totalprice > 400000) AND NOT o_orderpriority = '1-URGENT'")
_where("F17_between", "part", "p_partkey", lambda s, t: between(t["p_size"], 10, 20), "p_size BETWEEN 10 AND 20")
_where("F18_not_between", "part", "p_partkey", lambda s, t: not_between(t["p_size"], 5, 45), "p_size NOT BETWEEN 5 AND 45")
_where("F21_in_list", "customer", "c_custkey", lambda s, t: in_(t["c_nationkey"], [1, 2, 3]), "c_nationkey IN (1, 2, 3)")
_where("F21_in_list_long", "customer", "c_custkey", lambda s, t: in_(t["c_nationkey"], list(range(0, 400, 3))), "c_nationkey IN (SELECT range FROM range(0, 400, 3))")
_where("F21_in_empty", "customer", "c_custkey", lambda s, t: in_(t["c_custkey"], []), "false")
_where("F22_not_in_empty", "customer", "c_custkey", lambda s, t: not_in(t["c_custkey"], []), "true")
_where("F22_not_in_list", "customer", "c_custkey", lambda s, t: not_in(t["c_mktsegment"], ["BUILDING", "MACHINERY"]), "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
_where("F6_eq_null", "customer", "c_custkey", lambda s, t: eq(t["c_custkey"], None), "c_custkey = NULL")
_where("F41_contains", "customer", "c_custkey", lambda s, t: contains(t["c_name"], "#00000012"), "contains(lower(c_name), lower('#00000012'))")
_where("F41_starts_ends", "part", "p_partkey", lambda s, t: or_(starts_with(t["p_type"], "promo"), ends_with(t["p_type"], "STEEL")), "starts_with(lower(p_type), 'promo') OR ends_with(lower(p_type), 'steel')")
_where("F42_ne_folded", "customer", "c_custkey", lambda s, t: ne_folded(t["c_mktsegment"], "Building"), "lower(c_mktsegment) <> 'building'")
_where("F42_in_folded", "customer", "c_custkey", lambda s, t: in_folded(t["c_mktsegment"], ["building", "Machinery"]), "lower(c_mktsegment) IN ('building', 'machinery')")
_where("F42_not_in_folded", "customer", "c_custkey", lambda s, t: and_(not_in_folded(t["c_mktsegment"], ["building", "Machinery"]), not_in_folded(t["c_mktsegment"], [])), "lower(c_mktsegment) NOT IN ('building', 'machinery')")
_where("F25_no_condition", "customer", "c_custkey", lambda s, t: and_(None, or_(None)), "true")
_where("F42_eq_folded", "customer", "c_custkey", lambda s, t: eq_folded(t["c_mktsegment"], "building"), "lower(c_mktsegment) = 'building'")


@_query("F19_exists_uncorrelated", "SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 3)")
def _(s):
    n, r = s.nation, s.region
    return s.q(r).select({"r_name": r["r_name"]}).where(exists(s.q(n).select({"k": n["n_nationkey"]}).where(eq(n["n_nationkey"], 3)))).df()


@_query("F20_not_exists", "SELECT r_name FROM region WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 99)")
def _(s):
    n, r = s.nation, s.region
    return s.q(r).select({"r_name": r["r_name"]}).where(not_exists(s.q(n).select({"k": n["n_nationkey"]}).where(eq(n["n_nationkey"], 99)))).df()


@_query("F23_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def _(s):
    c, o = s.customer, s.orders
    return s.q(c).select({"c_custkey": c["c_custkey"]}).where(in_(c["c_custkey"], s.q(o).select({"k": o["o_custkey"]}).where(gt(o["o_totalprice"], 450000)))).df()


@_query("F23_not_in_subquery", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(s):
    o, line = s.orders, s.lineitem
    return s.q(o).select({"o_orderkey": o["o_orderkey"]}).where(not_in(o["o_orderkey"], s.q(line).select({"k": line["l_orderkey"]}))).df()


@_query("F26_where_replaced", "SELECT n_name FROM nation WHERE n_regionkey = 2")
def _(s):
    n = s.nation
    return s.q(n).select({"n_name": n["n_name"]}).where(eq(n["n_regionkey"], 1)).where(eq(n["n_regionkey"], 2)).df()


def _filter(name: str, table: str, key: str, where: dict, sql: str) -> None:
    @_query(name, f"SELECT {key} FROM {table} t WHERE {sql}")
    def _(s):
        return s.loader().find_many(table, {"columns": {key: True}, "where": where})


_filter("F28_filter_scalar", "orders", "o_orderkey", {"o_orderstatus": "P"}, "o_orderstatus = 'P'")
_filter("F29_filter_ops", "orders", "o_orderkey", {"o_totalprice": {"gt": 100000, "lte": 200000}, "o_orderpriority": {"in": ["1-URGENT", "2-HIGH"]}}, "o_totalprice > 100000 AND o_totalprice <= 200000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
_filter("F30_filter_null_flag", "orders", "o_orderkey", {"o_totalprice": {"isNull": False, "lt": 20000}}, "o_totalprice < 20000")
_filter("F31_filter_tree", "orders", "o_orderkey", {"OR": [{"o_orderstatus": "P"}, {"AND": [{"o_totalprice": {"gt": 400000}}, {"NOT": {"o_orderpriority": {"like": "1%"}}}]}], "AND": []}, "o_orderstatus = 'P' OR (o_totalprice > 400000 AND NOT o_orderpriority LIKE '1%')")
_filter("F32_filter_raw", "orders", "o_orderkey", {"RAW": lambda t, x: F.col("o_totalprice") * 2 > 500000}, "o_totalprice * 2 > 500000")
_filter("F33_filter_relation", "customer", "c_custkey", {"orders": {"o_totalprice": {"gt": 450000}}}, "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
_filter("F34_filter_relation_any", "orders", "o_orderkey", {"lines": True}, "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
_filter("F34_filter_relation_none", "orders", "o_orderkey", {"lines": False}, "NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
_filter("F35_filter_through", "orders", "o_orderkey", {"parts": {"p_size": 50}}, "EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey AND p_size = 50)")
_filter("F36_filter_nested", "region", "r_name", {"nations": {"customers": {"orders": {"o_totalprice": {"gt": 480000}}}}}, "EXISTS (SELECT 1 FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE n_regionkey = r_regionkey AND o_totalprice > 480000)")
_filter("F36_filter_or_relation", "customer", "c_custkey", {"OR": [{"c_acctbal": {"lt": -900}}, {"orders": {"o_totalprice": {"gt": 490000}}}]}, "c_acctbal < -900 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 490000)")
_filter("F37_filter_declared_where", "customer", "c_custkey", {"open_orders": {"o_totalprice": {"gt": 300000}}}, "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O' AND o_totalprice > 300000)")


# --- joins


def _join(name: str, how: str, sql: str) -> None:
    @_query(name, f"SELECT o_orderkey, l_partkey FROM orders {sql} JOIN lineitem ON o_orderkey = l_orderkey")
    def _(s):
        o, line = s.orders, s.lineitem
        return getattr(s.q(o), f"{how}_join")(line, eq(o["o_orderkey"], line["l_orderkey"])).select({"o_orderkey": o["o_orderkey"], "l_partkey": line["l_partkey"]}).df()


_join("J1_inner_join", "inner", "INNER")
_join("J2_left_join", "left", "LEFT")
_join("J3_right_join", "right", "RIGHT")
_join("J4_full_join", "full", "FULL")


@_query("J5_cross_join", "SELECT r_name, n_name FROM region, nation")
def _(s):
    r, n = s.region, s.nation
    return s.q(r).cross_join(n).select({"r_name": r["r_name"], "n_name": n["n_name"]}).df()


@_query("J6_theta_join", "SELECT s.s_suppkey, n.n_nationkey FROM supplier s JOIN nation n ON s.s_nationkey > n.n_nationkey AND s.s_acctbal > 5000")
def _(s):
    a, n = s.supplier, s.nation
    return s.q(a).inner_join(n, and_(gt(a["s_nationkey"], n["n_nationkey"]), gt(a["s_acctbal"], 5000))).select({"s_suppkey": a["s_suppkey"], "n_nationkey": n["n_nationkey"]}).df()


@_query("J11_junction_join", "SELECT DISTINCT o_orderkey, p_brand FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey")
def _(s):
    o, line, p = s.orders, s.lineitem, s.part
    return s.q(o).inner_join(line, eq(line["l_orderkey"], o["o_orderkey"])).inner_join(p, eq(p["p_partkey"], line["l_partkey"])).select({"o_orderkey": o["o_orderkey"], "p_brand": p["p_brand"]}).distinct().df()


# --- aggregation, order, scalars


@_query("A1_group_having", "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, count(l_tax) AS n_tax, count(DISTINCT l_suppkey) AS n_supp, round(sum(l_extendedprice), 2) AS total, round(avg(l_discount), 6) AS disc, min(l_shipdate) AS first, max(l_quantity) AS most FROM lineitem GROUP BY 1, 2 HAVING count(*) > 100")
def _(s):
    t = s.lineitem
    shape = {"flag": t["l_returnflag"], "status": t["l_linestatus"], "n": count(), "n_tax": count(t["l_tax"]), "n_supp": count_distinct(t["l_suppkey"]), "total": Expr(lambda e: F.round(sum_(t["l_extendedprice"]).column(e), 2)), "disc": Expr(lambda e: F.round(avg(t["l_discount"]).column(e), 6)), "first": min_(t["l_shipdate"]), "most": max_(t["l_quantity"])}
    return s.q(t).select(shape).group_by(t["l_returnflag"], t["l_linestatus"]).having(gt(count(), 100)).df()


@_query("A9_global_aggregate", "SELECT count(*) AS n, max(o_totalprice) AS most FROM orders WHERE o_totalprice < 0")
def _(s):
    o = s.orders
    return s.q(o).select({"n": count(), "most": max_(o["o_totalprice"])}).where(lt(o["o_totalprice"], 0)).df()


@_query("A3_count_distinct", "SELECT count(DISTINCT o_custkey) AS n FROM orders")
def _(s):
    o = s.orders
    return s.q(o).select({"n": count_distinct(o["o_custkey"])}).df()


@_query("A8_group_by_expression", "SELECT o_custkey % 10 AS g, count(*) AS n FROM orders GROUP BY o_custkey % 10")
def _(s):
    g = raw("o_custkey % 10")
    return s.q(s.orders).select({"g": g, "n": count()}).group_by(g).df()


@_query("A12_relational_count", "SELECT count(*) AS count FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def _(s):
    return s.loader().count("customer", {"orders": {"o_totalprice": {"gt": 400000}}})


@_query("A13_list_per_parent", "SELECT n_regionkey AS k, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def _(s):
    n = s.nation
    return s.q(n).select({"k": n["n_regionkey"], "names": Expr(lambda e: F.array_join(F.array_sort(F.collect_list("n_name")), ","))}).group_by(n["n_regionkey"]).df()


@_query("O3_order_limit_offset", "SELECT o_orderkey AS id, o_totalprice AS p FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
def _(s):
    o = s.orders
    return s.q(o).select({"id": o["o_orderkey"], "p": o["o_totalprice"]}).order_by(desc(o["o_totalprice"]), asc(o["o_orderkey"])).limit(20).offset(10).df()


@_query("O4_top_k", "SELECT c_custkey AS id FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def _(s):
    c = s.customer
    return s.q(c).select({"id": c["c_custkey"]}).order_by(desc(c["c_acctbal"]), c["c_custkey"]).limit(ph("k")).df(k=25)


@_query("E1_arithmetic", "SELECT p_partkey, p_size + 1 AS a, p_size - 1 AS b, p_size * 2 AS c, p_size // 7 AS d, CASE WHEN p_size - 10 = 0 THEN NULL ELSE 100 // (p_size - 10) END AS e FROM part")
def _(s):
    p = s.part
    z = subtract(p["p_size"], 10)
    return s.q(p).select({"p_partkey": p["p_partkey"], "a": add(p["p_size"], 1), "b": subtract(p["p_size"], 1), "c": multiply(p["p_size"], 2), "d": divide(p["p_size"], 7), "e": divide(100, z)}).df()


@_query("E5_coalesce_lower_upper_length", "SELECT d.doc_id, coalesce(l.toxic, -1) AS toxic, lower(d.source) AS lo, upper(d.source) AS up, length(d.lang) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def _(s):
    d, t = s.documents, s.labels
    return s.q(d).left_join(t, eq(t["doc_id"], d["doc_id"])).select({"doc_id": d["doc_id"], "toxic": coalesce(t["toxic"], -1), "lo": lower(d["source"]), "up": upper(d["source"]), "n": length(d["lang"])}).df()


# --- windows, relations


_LATEST = "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type <> 'error') WHERE rn = 1"


@_query("F1_latest_per_group", _LATEST)
def _(s):
    e = s.events
    return latest_per_group(s.db, e, [e["user_id"]], [desc(e["ts"])], desc(e["event_id"]), ne(e["event_type"], "error")).select("event_id", "user_id", "event_type")


QUERIES["W1_latest_per_group"], ORACLE_SQL["W1_latest_per_group"] = QUERIES["F1_latest_per_group"], _LATEST


@_query("W2_page_per_parent", "SELECT c_custkey AS id, string_agg(o_orderkey::VARCHAR, ',' ORDER BY rn) AS page FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) o ON o_custkey = c_custkey AND rn > 1 AND rn <= 4 GROUP BY c_custkey")
def _(s):
    rows = s.loader().find_many("customer", {"columns": {"c_custkey": True}, "with": {"orders": {"columns": {"o_orderkey": True}, "order_by": {"o_totalprice": "desc"}, "offset": 1, "limit": 3}}})
    page = F.when(F.size("orders") > 0, F.array_join(F.transform("orders", lambda x: x["o_orderkey"].cast("string")), ","))
    return rows.select(F.col("c_custkey").alias("id"), page.alias("page"))


@_query("W3_window_fragment", "SELECT n_nationkey, rank() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS r FROM nation")
def _(s):
    n = s.nation
    return s.q(n).select({"n_nationkey": n["n_nationkey"], "r": raw("rank() OVER (PARTITION BY n_regionkey ORDER BY n_name)")}).df()


@_query("R9_load_one", "SELECT c_custkey AS id, n_name AS nation, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def _(s):
    rows = s.loader().find_many("customer", {"columns": {"c_custkey": True}, "with": {"nation": {"columns": {"n_name": True}, "with": {"region": True}}}})
    return rows.select(F.col("c_custkey").alias("id"), F.col("nation.n_name").alias("nation"), F.col("nation.region.r_name").alias("region"))


def _joined(field: str, key: str):
    return F.array_join(F.transform(field, lambda x: x[key].cast("string")), ",")


@_query("R10_load_many", "SELECT o_orderkey AS id, count(l_orderkey) AS n, coalesce(round(sum(l_quantity), 2), 0) AS q FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def _(s):
    rows = s.loader().find_many("orders", {"columns": {"o_orderkey": True}, "with": {"lines": {"columns": {"l_quantity": True}}}})
    return rows.select(F.col("o_orderkey").alias("id"), F.size("lines").cast("long").alias("n"), F.round(F.aggregate("lines", F.lit(0.0), lambda a, x: a + x["l_quantity"]), 2).alias("q"))


@_query("R11_load_nested", "SELECT r_name AS region, n_name AS nation, (SELECT string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9000) AS rich FROM region JOIN nation ON n_regionkey = r_regionkey")
def _(s):
    rows = s.loader().find_many("region", {"with": {"nations": {"with": {"customers": {"columns": {"c_custkey": True}, "where": {"c_acctbal": {"gt": 9000}}}}}}})
    each = rows.select(F.col("r_name").alias("region"), F.explode("nations").alias("n"))
    return each.select("region", F.col("n.n_name").alias("nation"), F.when(F.size("n.customers") > 0, _joined("n.customers", "c_custkey")).alias("rich"))


@_query("R3_load_through", "SELECT o_orderkey AS id, (SELECT string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey) AS parts FROM orders")
def _(s):
    rows = s.loader().find_many("orders", {"columns": {"o_orderkey": True}, "with": {"parts": {"columns": {"p_partkey": True}}}})
    return rows.select(F.col("o_orderkey").alias("id"), F.when(F.size("parts") > 0, _joined("parts", "p_partkey")).alias("parts"))


@_query("R2_load_composite_key", "SELECT conv_id, turn, role AS twin FROM conversations")
def _(s):
    rows = s.loader().find_many("conversations", {"columns": {"conv_id": True, "turn": True}, "with": {"same": {"columns": {"role": True}}}})
    return rows.select("conv_id", "turn", F.get("same", 0)["role"].alias("twin"))


@_query("R6_find_many", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 30 OFFSET 5")
def _(s):
    return s.loader().find_many("orders", {"columns": {"o_orderkey": True, "o_totalprice": True}, "where": {"o_orderstatus": "F"}, "order_by": lambda t, x: [x.desc(t["o_totalprice"]), t["o_orderkey"]], "limit": 30, "offset": 5})


@_query("R16_child_where", "SELECT c_custkey AS id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AS n FROM customer")
def _(s):
    rows = s.loader().find_many("customer", {"columns": {"c_custkey": True}, "with": {"orders": {"columns": {"o_orderkey": True}, "where": {"o_totalprice": {"gt": 300000}}}}})
    return rows.select(F.col("c_custkey").alias("id"), F.size("orders").cast("long").alias("n"))


@_query("R17_declared_where", "SELECT c_custkey AS id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O' AND o_totalprice < 100000) AS n FROM customer")
def _(s):
    rows = s.loader().find_many("customer", {"columns": {"c_custkey": True}, "with": {"open_orders": {"columns": {"o_orderkey": True}, "where": {"o_totalprice": {"lt": 100000}}}}})
    return rows.select(F.col("c_custkey").alias("id"), F.size("open_orders").cast("long").alias("n"))


# --- mutations: the table afterwards


@_query("M1_insert", "SELECT * FROM region UNION ALL SELECT 100, 'NOWHERE' UNION ALL SELECT 101, NULL")
def _(s):
    old = s.db.frame("region")
    return insert(s.region, old, new_rows(s.spark, s.region, old, [{"r_regionkey": 100, "r_name": "NOWHERE"}, {"r_regionkey": 101}])).rows


@_query("M5_insert_do_nothing", "SELECT * FROM region UNION ALL SELECT 100, 'NEW'")
def _(s):
    old = s.db.frame("region")
    return upsert(s.region, old, new_rows(s.spark, s.region, old, [{"r_regionkey": 1, "r_name": "X"}, {"r_regionkey": 100, "r_name": "NEW"}, {"r_regionkey": 100, "r_name": "LATE"}]), ["r_regionkey"]).rows


@_query("M6_upsert", "SELECT r_regionkey, CASE WHEN r_regionkey IN (1, 2) THEN r_name || '+X' ELSE r_name END AS r_name FROM region UNION ALL SELECT 100, 'NEW'")
def _(s):
    old = s.db.frame("region")
    new = new_rows(s.spark, s.region, old, [{"r_regionkey": 1, "r_name": "X"}, {"r_regionkey": 2, "r_name": "X"}, {"r_regionkey": 100, "r_name": "NEW"}])
    return upsert(s.region, old, new, ["r_regionkey"], {"r_name": lambda a, b: F.concat(a, F.lit("+"), b)}).rows


@_query("M8_update_where", "SELECT c_custkey, CASE WHEN c_nationkey = 5 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal FROM customer")
def _(s):
    c = s.customer
    return update(c, s.db.frame("customer"), {"c_acctbal": multiply(c["c_acctbal"], 2)}, eq(c["c_nationkey"], 5)).rows.select("c_custkey", "c_acctbal")


@_query("M7_update_returning", "SELECT c_custkey, 0.0::DOUBLE AS c_acctbal FROM customer WHERE c_nationkey = 5")
def _(s):
    c = s.customer
    return update(c, s.db.frame("customer"), {"c_acctbal": 0.0}, eq(c["c_nationkey"], 5)).returning("c_custkey", "c_acctbal")


@_query("M9_delete_where", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F')")
def _(s):
    o = s.orders
    return delete(o, s.db.frame("orders"), eq(o["o_orderstatus"], "F")).rows.select("o_orderkey")


@_query("M14_consume_one", "SELECT min(c_custkey) AS c_custkey FROM customer WHERE c_nationkey = 7")
def _(s):
    c = s.customer
    return consume_one(c, s.db.frame("customer"), eq(c["c_nationkey"], 7)).returning("c_custkey")


@_query("M15_increment_one", "SELECT c_custkey, CASE WHEN c_custkey = (SELECT min(c_custkey) FROM customer WHERE c_nationkey = 7) THEN c_acctbal + 5 ELSE c_acctbal END AS c_acctbal FROM customer")
def _(s):
    c = s.customer
    return increment_one(c, s.db.frame("customer"), {"c_acctbal": 5}, eq(c["c_nationkey"], 7)).rows.select("c_custkey", "c_acctbal")


@_query("DD11_unique_violations", "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(s):
    return check_unique(s.db.frame("lineitem"), ["l_orderkey", "l_linenumber"])


@_query("DD11_reference_violations", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def _(s):
    return check_reference(s.db.frame("documents"), ["doc_id"], s.db.frame("labels"), ["doc_id"]).select("doc_id")


_EDGES = [("nation", "region"), ("customer", "nation"), ("supplier", "nation"), ("orders", "customer"), ("lineitem", "orders"), ("lineitem", "part"), ("lineitem", "supplier"), ("nation", "nation")]


@_query("K16_impact_closure", "WITH RECURSIVE e(child, parent) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _EDGES) + "), r(name) AS (SELECT child FROM e WHERE parent = 'nation' AND child <> 'nation' UNION SELECT e.child FROM r JOIN e ON e.parent = r.name AND e.child <> 'nation') SELECT name FROM r")
def _(s):
    return impact_closure(s.spark.createDataFrame(_EDGES, "child string, parent string"), "nation")


@_query("K18_vocabulary", "SELECT 'status' AS name, 'lineitem' AS small, 'orders' AS large")
def _(s):
    line = s.db.frame("lineitem").select(F.lit("lineitem").alias("table_name"), F.lit("status").alias("column_name"), F.col("l_linestatus").alias("value"))
    orders = s.db.frame("orders").select(F.lit("orders").alias("table_name"), F.lit("status").alias("column_name"), F.col("o_orderstatus").alias("value"))
    return vocabulary_divergences(line.unionAll(orders))


@_query("X1_union_cte", "WITH big AS (SELECT o_custkey AS k FROM orders WHERE o_totalprice > 400000) SELECT k FROM big UNION SELECT c_custkey FROM customer WHERE c_acctbal > 9500")
def _(s):
    return s.db.execute("WITH big AS (SELECT o_custkey AS k FROM orders WHERE o_totalprice > 400000) SELECT k FROM big UNION SELECT c_custkey FROM customer WHERE c_acctbal > 9500", None, ("orders", "customer"))


# --- groups that may be null, subqueries, fragments


@_query("P8_implicit_null_group", "SELECT coalesce(d.doc_id, l.doc_id) AS id, l.doc_id IS NULL AS no_label, d.doc_id IS NULL AS no_document FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def _(s):
    d, t = s.documents, s.labels
    rows = s.q(d).full_join(t, eq(d["doc_id"], t["doc_id"])).df()
    return rows.select(F.coalesce("documents.doc_id", "labels.doc_id").alias("id"), F.col("labels").isNull().alias("no_label"), F.col("documents").isNull().alias("no_document"))


@_query("P10_group_by_inner_columns", "SELECT d.doc_id AS id, l.doc_id IS NULL AS missed FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(s):
    d, t = s.documents, s.labels
    rows = s.q(d).left_join(t, eq(d["doc_id"], t["doc_id"])).select({"id": d["doc_id"], "label": {"marks": {"toxic": t["toxic"], "quality": t["quality"]}}}).df()
    return rows.select("id", F.col("label").isNull().alias("missed"))


@_query("P11_subquery_null_group", "SELECT d.doc_id AS id, l.doc_id IS NULL AS missed FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE d.lang = 'en'")
def _(s):
    d, t = s.documents, s.labels
    x = s.q(d).left_join(t, eq(d["doc_id"], t["doc_id"])).select({"id": d["doc_id"], "lang": d["lang"], "label": {"toxic": t["toxic"], "quality": t["quality"]}}).as_("x")
    return s.q(x).select({"id": x["id"], "label": x["label"]}).where(eq(x["lang"], "en")).df().select("id", F.col("label").isNull().alias("missed"))


@_query("J8_join_to_subquery", "SELECT c_custkey, n FROM customer JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) x ON k = c_custkey")
def _(s):
    c, o = s.customer, s.orders
    x = s.q(o).select({"k": o["o_custkey"], "n": count()}).group_by(o["o_custkey"]).as_("x")
    return s.q(c).inner_join(x, eq(x["k"], c["c_custkey"])).select({"c_custkey": c["c_custkey"], "n": x["n"]}).df()


@_query("S7_composed_fragment", "SELECT c_custkey, c_name || ' of ' || c_mktsegment AS who FROM customer WHERE c_mktsegment IN ('BUILDING', 'O''K') AND c_acctbal > 100")
def _(s):
    c = s.customer
    who = sql("concat({}, {}, {})", c["c_name"], " of ", identifier("customer", "c_mktsegment"))
    return s.q(c).select({"c_custkey": c["c_custkey"], "who": who}).where(sql("{} in {} and {} > {}", c["c_mktsegment"], ["BUILDING", "O'K"], c["c_acctbal"], ph("least"))).df(least=100)


@_query("E12_value_per_execution", "SELECT r_regionkey, 2::INTEGER AS n FROM region")
def _(s):
    made = iter((1, 2))
    q = s.q(s.region).select({"r_regionkey": s.region["r_regionkey"], "n": param_fn(lambda: next(made))})
    return (q.df(), q.df())[1]


@_query("A4_sum_as_text", "SELECT o_orderstatus AS status, sum(o_custkey)::VARCHAR AS total FROM orders GROUP BY 1")
def _(s):
    o = s.orders
    return s.q(o).select({"status": o["o_orderstatus"], "total": sum_(o["o_custkey"], as_text=True)}).group_by(o["o_orderstatus"]).df()


# --- relations: adopted and reversed edges, keys that are null or not unique, pages


def _graph(s: Star, tables: dict[str, DataFrame], keys: dict[str, tuple[str, ...]], edges: dict) -> Loader:
    db = Database(s.spark, frames=tables)
    return Loader(db, RelationGraph({n: db.table(n, keys.get(n, ())) for n in tables}, edges))


@_query("R4_adopted_edge", "SELECT c_custkey AS id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
def _(s):
    load = _graph(s, {n: s.db.frame(n) for n in ("customer", "orders")}, KEYS, {"customer": {"placed": many("orders", alias="p")}, "orders": {"buyer": one("customer", "o_custkey", "c_custkey", alias="p"), "payer": one("customer", "o_custkey", "c_custkey")}})
    return load.find_many("customer", {"columns": {"c_custkey": True}, "with": {"placed": {"columns": {"o_orderkey": True}}}}).select(F.col("c_custkey").alias("id"), F.size("placed").cast("long").alias("n"))


@_query("R12_null_keys", "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE c_name END AS name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def _(s):
    orders = s.db.frame("orders").withColumn("buyer_key", F.when(F.col("o_orderstatus") != "F", F.col("o_custkey"))).select("o_orderkey", "buyer_key")
    load = _graph(s, {"customer": s.db.frame("customer"), "orders": orders}, KEYS, {"orders": {"buyer": one("customer", "buyer_key", "c_custkey")}})
    return load.find_many("orders", {"columns": {"o_orderkey": True}, "with": {"buyer": {"columns": {"c_name": True}}}}).select(F.col("o_orderkey").alias("id"), F.col("buyer.c_name").alias("name"))


@_query("R18_reversed_where", "SELECT c_custkey AS id, CASE WHEN c_acctbal > 0 THEN (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) ELSE 0 END AS n FROM customer")
def _(s):
    load = _graph(s, {n: s.db.frame(n) for n in ("customer", "orders")}, KEYS, {"customer": {"placed": many("orders")}, "orders": {"rich": one("customer", "o_custkey", "c_custkey", where={"c_acctbal": {"gt": 0}})}})
    return load.find_many("customer", {"columns": {"c_custkey": True}, "with": {"placed": {"columns": {"o_orderkey": True}}}}).select(F.col("c_custkey").alias("id"), F.size("placed").cast("long").alias("n"))


@_query("R19_non_unique_parent_key", "SELECT o_orderkey AS id, (SELECT count(*) FROM orders x WHERE x.o_orderpriority = o.o_orderpriority AND x.o_totalprice > 400000) AS n FROM orders o")
def _(s):
    load = _graph(s, {"orders": s.db.frame("orders")}, KEYS, {"orders": {"alike": many("orders", "o_orderpriority", "o_orderpriority", where={"o_totalprice": {"gt": 400000}})}})
    return load.find_many("orders", {"columns": {"o_orderkey": True}, "with": {"alike": {"columns": {"o_orderkey": True}}}}).select(F.col("o_orderkey").alias("id"), F.size("alike").cast("long").alias("n"))


@_query("R6_page_with_children", "SELECT c_custkey AS id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 40 OFFSET 10)")
def _(s):
    rows = s.loader().find_many("customer", {"columns": {"c_custkey": True}, "with": {"orders": {"columns": {"o_orderkey": True}}}, "order_by": {"c_acctbal": "desc"}, "limit": 40, "offset": 10})
    return rows.select(F.col("c_custkey").alias("id"), F.size("orders").cast("long").alias("n"))


# --- mutations: clashes, generated columns, references, records by model


_REGION = Table("region", {"r_regionkey": Column("r_regionkey"), "r_name": Column("r_name", unique=True)}, primary_key=("r_regionkey",))


@_query("M6_upsert_repeated_key", "SELECT r_regionkey, CASE r_regionkey WHEN 1 THEN r_name || '+a+b' ELSE r_name END AS r_name FROM region UNION ALL SELECT 100, 'c+d'")
def _(s):
    old = s.db.frame("region")
    new = new_rows(s.spark, s.region, old, [{"r_regionkey": k, "r_name": v} for k, v in ((1, "a"), (100, "c"), (1, "b"), (100, "d"))])
    return upsert(s.region, old, new, ["r_regionkey"], {"r_name": lambda a, b: F.concat(a, F.lit("+"), b)}).rows


@_query("M6_upsert_where", "SELECT r_regionkey, CASE r_regionkey WHEN 2 THEN 'new' ELSE r_name END AS r_name FROM region")
def _(s):
    old = s.db.frame("region")
    new = new_rows(s.spark, s.region, old, [{"r_regionkey": k, "r_name": "new"} for k in (1, 2)])
    return upsert(s.region, old, new, ["r_regionkey"], {"r_name": lambda a, b: b}, where=lambda x: x.old["r_regionkey"] > 1).rows


@_query("M5_any_constraint", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 100, 'NEW' UNION ALL SELECT 102, 'MORE'")
def _(s):
    old = s.db.frame("region").select("r_regionkey", "r_name")
    taken = old.orderBy("r_regionkey").first().r_name
    return insert_or_skip(_REGION, old, new_rows(s.spark, _REGION, old, [{"r_regionkey": k, "r_name": v} for k, v in ((1, "X"), (100, "NEW"), (101, "NEW"), (100, "LATE"), (102, "MORE"), (103, taken))])).rows


@_query("M1_conflict", "SELECT 3::BIGINT AS refused, (SELECT count(*) FROM region) AS kept")
def _(s):
    old, refused = s.db.frame("region").select("r_regionkey", "r_name"), 0
    for values in ([{"r_regionkey": 1, "r_name": "X"}], [{"r_regionkey": 100, "r_name": "X"}, {"r_regionkey": 100, "r_name": "Y"}], [{"r_regionkey": 100, "r_name": "X"}, {"r_regionkey": 101, "r_name": "X"}]):
        try:
            insert(_REGION, old, new_rows(s.spark, _REGION, old, values))
        except ValueError:
            refused += 1
    return old.agg(F.lit(refused).cast("long").alias("refused"), F.count("*").alias("kept"))


@_query("M8_generated", "SELECT c_custkey, CASE WHEN c_nationkey = 5 THEN 1.0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_nationkey = 5 THEN 2.0 ELSE c_acctbal * 2 END AS twice FROM customer")
def _(s):
    old = s.db.frame("customer").select("c_custkey", "c_nationkey", "c_acctbal").withColumn("twice", F.col("c_acctbal") * 2)
    t = Table("customer", {**{c: Column(c) for c in old.columns}, "twice": Column("twice", generated="c_acctbal * 2")}, primary_key=("c_custkey",))
    return update(t, old, {"c_acctbal": 1.0}, eq(t["c_nationkey"], 5)).rows.drop("c_nationkey")


@_query("M9_cascade", "SELECT 'orders' AS t, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 5) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 5)) UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_nationkey <> 5")
def _(s):
    tables = {n: getattr(s, n) for n in ("customer", "orders", "lineitem")}
    for child, c, parent in (("orders", "o_custkey", ("customer", "c_custkey")), ("lineitem", "l_orderkey", ("orders", "o_orderkey"))):
        tables[child] = replace(tables[child], columns={**tables[child].columns, c: Column(c, references=parent, on_delete="cascade")})
    done = delete_with_references(tables, {n: s.db.frame(n) for n in tables}, "customer", eq(tables["customer"]["c_nationkey"], 5))
    counts = [x.rows.agg(F.lit(n).alias("t"), F.count("*").alias("n")) for n, x in done.items()]
    return counts[0].unionAll(counts[1]).unionAll(counts[2])


def _root(spark: SparkSession) -> str:
    """A fresh folder for versioned tables, which driver and executors share; a local one only where none is set, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir isn't set")
    return f"{base or 'file://' + tempfile.mkdtemp(prefix='tessera-')}/tables-{uuid.uuid4().hex}"


def _adapter(s: Star) -> Adapter:
    store, old = TableStore(s.spark, _root(s.spark)), s.db.frame("customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    t = Table("customer", {c: Column(c) for c in old.columns}, primary_key=("c_custkey",))
    store.batch([lambda read: ("customer", insert(t, old.limit(0), old))])
    return Adapter(store, {"customer": t})


@_query("M13_adapter_writes", "SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'renamed' ELSE c_name END AS c_name, CASE WHEN c_custkey = (SELECT min(c_custkey) FROM customer WHERE c_nationkey = 4) THEN c_acctbal + 5 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_nationkey <> 5 AND c_custkey <> (SELECT min(c_custkey) FROM customer WHERE c_nationkey = 6) UNION ALL SELECT -1, 'made', 0.5")
def _(s):
    a = _adapter(s)
    a.create("customer", {"c_custkey": -1, "c_name": "made", "c_nationkey": 99, "c_acctbal": 0.5})
    a.update_many("customer", [Where("c_nationkey", 3)], {"c_name": "renamed"})
    a.increment_one("customer", [Where("c_nationkey", 4)], {"c_acctbal": 5})
    a.delete_many("customer", [Where("c_nationkey", 5)])
    a.consume_one("customer", [Where("c_nationkey", 6)])
    for nothing in (a.update_many("customer", [], {"c_name": "x"}), a.delete_many("customer", [])):  # no conditions, no write
        if nothing:
            raise AssertionError(nothing)
    return a.find_many("customer", select=["c_custkey", "c_name", "c_acctbal"])


@_query("F43_connector_rule", "SELECT c_custkey FROM customer WHERE c_acctbal > 1000 AND c_nationkey <> 3 AND (c_nationkey = 5 OR contains(lower(c_name), '00007'))")
def _(s):
    where = [Where("c_nationkey", 5, connector="OR"), Where("c_acctbal", 1000, "gt"), Where("c_name", "00007", "contains", "OR"), Where("c_nationkey", 3, "ne")]
    return _adapter(s).find_many("customer", where, select=["c_custkey"])


# --- catalog, codecs, collations, fragments for dates and documents


@_query("S10_catalog_scan", "SELECT table_name, column_name, ordinal_position::INTEGER AS position, column_name IN ('r_regionkey', 'n_nationkey', 'c_custkey') AS is_unique FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer')")
def _(s):
    return s.db.catalog(s.region, s.nation, s.customer).select("table_name", "column_name", "position", "is_unique")


@_query("P12_decode_on_read", "SELECT doc_id, toxic <> 0 AS toxic, make_timestamp(quality * 86400000000) AS day FROM labels")
def _(s):
    t = Table("labels", {"doc_id": Column("doc_id"), "toxic": Column("toxic", "boolean"), "day": Column("day", "timestamp")})
    db = Database(s.spark, frames={"labels": s.db.frame("labels").withColumn("day", F.col("quality").cast("long") * 86400)})
    return query(db).from_(t).df().withColumn("day", F.col("day").cast("timestamp_ntz"))


@_query("R23_decode_in_relations", "SELECT d.doc_id, l.toxic <> 0 AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def _(s):
    t = Table("labels", {"doc_id": Column("doc_id"), "toxic": Column("toxic", "boolean")}, primary_key=("doc_id",))
    db = Database(s.spark, frames={n: s.db.frame(n) for n in ("documents", "labels")})
    load = Loader(db, RelationGraph({"documents": db.table("documents", ("doc_id",)), "labels": t}, {"documents": {"label": one("labels", "doc_id", "doc_id")}}))
    return load.find_many("documents", {"columns": {"doc_id": True}, "with": {"label": {"columns": {"toxic": True}}}}).select("doc_id", F.col("label.toxic").alias("toxic"))


@_query("R14_hidden_keys", "SELECT 'c_name,orders' AS outer_fields, 'o_totalprice' AS inner_fields, count(*) AS n FROM customer")
def _(s):
    rows = s.loader().find_many("customer", {"columns": {"c_name": True}, "with": {"orders": {"columns": {"o_totalprice": True}}}})
    inner = rows.schema["orders"].dataType.elementType.names
    return rows.agg(F.lit(",".join(rows.columns)).alias("outer_fields"), F.lit(",".join(inner)).alias("inner_fields"), F.count("*").alias("n"))


_where("DD10_nocase", "customer", "c_custkey", lambda s, t: eq(collate(t["c_mktsegment"], "nocase"), "building"), "lower(c_mktsegment) = 'building'")
_where("DD10_rtrim", "customer", "c_custkey", lambda s, t: eq(collate(sql("concat({}, '  ')", t["c_mktsegment"]), "rtrim"), "BUILDING"), "c_mktsegment = 'BUILDING'")


@_query("E15_date_fragment", "SELECT l_linenumber AS line, max(year(l_shipdate))::INTEGER AS y FROM lineitem GROUP BY 1")
def _(s):
    t = s.lineitem
    return s.q(t).select({"line": t["l_linenumber"], "y": max_(sql("year({})", t["l_shipdate"]))}).group_by(t["l_linenumber"]).df()


@_query("E16_document_fragment", "SELECT c_custkey, c_name AS name, c_nationkey::VARCHAR AS nation FROM customer")
def _(s):
    c = s.customer
    text = sql("to_json(named_struct('name', {}, 'nation', {}))", c["c_name"], c["c_nationkey"])
    return s.q(c).select({"c_custkey": c["c_custkey"], "name": sql("get_json_object({}, '$.name')", text), "nation": sql("get_json_object({}, '$.nation')", text)}).df()
