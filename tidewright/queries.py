"""One query for each operator over the TPC-H-like tables, and its SQL."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright import functions as f
from tidewright import sources
from tidewright.operators import bag
from tidewright.operators.ordering import Pages, keyset_after, sort_columns
from tidewright.plans.builder import Query
from tidewright.plans.ir import Order, Ref, Table
from tidewright.plans.predicates import Subset
from tidewright.streaming import cdc, maintained
from tidewright.streaming.live import Effect, LiveQuery, LiveSet

KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"],
    "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], "events": ["event_id"],
    "documents": ["doc_id"], "labels": ["doc_id"], "conversations": ["conv_id", "turn"],
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder, read when they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def df(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> Table:
        if name not in KEYS:
            raise AttributeError(name)
        return Table(self.df(name), tuple(KEYS[name]), name)


def query(name: str, sql: str | None = None):
    """Registers a function of Tables that gives a Query or a frame."""

    def register(build: Callable[[Tables], Query | DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = build(Tables(spark, sf_dir))
            return out.to_df() if isinstance(out, Query) else out

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return build

    return register


def when(y: int, m: int = 1, d: int = 1) -> dt.datetime:
    return dt.datetime(y, m, d)


def src(**source) -> Query:
    return Query().from_(**source)


# flagship, scans and filters


@query("revenue_summary", """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice * (1 - l_discount)) AS revenue,
  avg(l_discount) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def revenue_summary(t: Tables) -> Query:
    return (src(l=t.lineitem).where(lambda r: f.lte(r.l.l_shipdate, when(1998, 9, 2))).group_by(lambda r: [r.l.l_returnflag, r.l.l_linestatus])
            .select(lambda r: {"l_returnflag": r.l.l_returnflag, "l_linestatus": r.l.l_linestatus, "sum_qty": f.sum_(r.l.l_quantity),
                               "revenue": f.sum_(f.multiply(r.l.l_extendedprice, f.subtract(1, r.l.l_discount))), "avg_disc": f.avg(r.l.l_discount), "n": f.count(r.l.l_orderkey)})
            .order_by(lambda r: [r.l.l_returnflag, r.l.l_linestatus]))


@query("scan_select", "SELECT n_nationkey, n_name FROM nation")
def scan_select(t: Tables) -> Query:
    return src(n=t.nation).select(lambda r: {"n_nationkey": r.n.n_nationkey, "n_name": r.n.n_name})


@query("scan_whole", "SELECT * FROM nation")
def scan_whole(t: Tables) -> Query:
    return src(n=t.nation)


@query("select_spread_nested", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, lower(c_mktsegment) AS c_mktsegment, c_acctbal * 2 AS doubled, c_name AS inner_name FROM customer")
def select_spread_nested(t: Tables) -> DataFrame:
    q = src(c=t.customer).select(lambda r: {"...c": r.c, "c_mktsegment": f.lower(r.c.c_mktsegment), "doubled": f.multiply(r.c.c_acctbal, 2), "in_": {"name": r.c.c_name}})
    return src(x=q).select(lambda r: {"...x": r.x, "inner_name": r.x.in_.name}).to_df().drop("in_")


@query("filter_and_or_not", "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE (l_quantity > 40 OR l_discount = 0) AND NOT (l_returnflag = 'R')")
def filter_and_or_not(t: Tables) -> Query:
    return (src(l=t.lineitem).where(lambda r: f.or_(f.gt(r.l.l_quantity, 40), f.eq(r.l.l_discount, 0))).where(lambda r: f.not_(f.eq(r.l.l_returnflag, "R")))
            .select(lambda r: {"l_orderkey": r.l.l_orderkey, "l_partkey": r.l.l_partkey, "l_linenumber": r.l.l_linenumber}))


@query("filter_cmp", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' AND o_totalprice > 1000 AND o_totalprice <= 200000")
def filter_cmp(t: Tables) -> Query:
    return (src(o=t.orders).where(lambda r: f.and_(f.gte(r.o.o_orderdate, when(1995)), f.lt(r.o.o_orderdate, when(1996)), f.gt(r.o.o_totalprice, 1000), f.lte(r.o.o_totalprice, 200000)))
            .select(lambda r: {"o_orderkey": r.o.o_orderkey, "o_orderdate": r.o.o_orderdate}))


@query("filter_in", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND NOT (o_orderstatus IN ('F'))")
def filter_in(t: Tables) -> Query:
    return (src(o=t.orders).where(lambda r: f.in_array(r.o.o_orderpriority, ["1-URGENT", "2-HIGH", None])).where(lambda r: f.not_(f.in_array(r.o.o_orderstatus, ["F", None])))
            .select(lambda r: {"o_orderkey": r.o.o_orderkey}))


@query("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_type LIKE '%S%' AND p_name LIKE '_a%'")
def filter_like(t: Tables) -> Query:
    return src(p=t.part).where(lambda r: f.and_(f.like(r.p.p_type, "%S%"), f.like(r.p.p_name, "_a%"))).select(lambda r: {"p_partkey": r.p.p_partkey, "p_name": r.p.p_name})


@query("filter_ilike", "SELECT p_partkey FROM part WHERE lower(p_brand) LIKE 'brand#1%'")
def filter_ilike(t: Tables) -> Query:
    return src(p=t.part).where(lambda r: f.ilike(r.p.p_brand, "BRAND#1%")).select(lambda r: {"p_partkey": r.p.p_partkey})


@query("filter_null", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL")
def filter_null(t: Tables) -> Query:
    return (src(d=t.documents).left_join({"l": t.labels}, lambda r: f.eq(r.d.doc_id, r.l.doc_id)).where(lambda r: f.is_undefined(r.l.quality))
            .select(lambda r: {"doc_id": r.d.doc_id, "quality": r.l.quality}))


# joins


def _pair(how: str):
    return lambda t: (src(c=t.customer).join({"o": src(x=t.orders).where(lambda r: f.and_(f.eq(r.x.o_orderpriority, "1-URGENT"), f.gte(r.x.o_orderdate, when(1996))))}, lambda r: f.eq(r.c.c_custkey, r.o.o_custkey), how)
                      .where(lambda r: f.or_(f.lt(r.c.c_acctbal, 5000), f.is_undefined(r.c))).select(lambda r: {"c_custkey": r.c.c_custkey, "o_orderkey": r.o.o_orderkey}))


for _how in ("inner", "left", "right", "full"):
    query(f"join_{_how}", f"""SELECT c_custkey, o_orderkey FROM customer {_how.upper()} JOIN
      (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '1996-01-01') o ON c_custkey = o_custkey WHERE c_acctbal < 5000 OR c_custkey IS NULL""")(_pair(_how))


@query("join_multi", """SELECT r_name, n_name, count(o_orderkey) AS n_orders, sum(o_totalprice) AS total FROM region JOIN nation ON n_regionkey = r_regionkey
  JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""")
def join_multi(t: Tables) -> Query:
    return (src(g=t.region).inner_join({"n": t.nation}, lambda r: f.eq(r.n.n_regionkey, r.g.r_regionkey)).inner_join({"c": t.customer}, lambda r: f.eq(r.c.c_nationkey, r.n.n_nationkey))
            .inner_join({"o": t.orders}, lambda r: f.eq(r.o.o_custkey, r.c.c_custkey)).group_by(lambda r: [r.g.r_name, r.n.n_name])
            .select(lambda r: {"r_name": r.g.r_name, "n_name": r.n.n_name, "n_orders": f.count(r.o.o_orderkey), "total": f.sum_(r.o.o_totalprice)}))


@query("join_self", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey")
def join_self(t: Tables) -> Query:
    return (src(a=t.nation).inner_join({"b": t.nation}, lambda r: f.eq(r.a.n_regionkey, r.b.n_regionkey)).where(lambda r: f.lt(r.a.n_nationkey, r.b.n_nationkey))
            .select(lambda r: {"a": r.a.n_name, "b": r.b.n_name}))


@query("join_computed_key", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON concat('k', c_custkey) = concat('k', s_suppkey)")
def join_computed_key(t: Tables) -> Query:
    return (src(c=t.customer).inner_join({"s": t.supplier}, lambda r: f.eq(f.concat("k", r.c.c_custkey), f.concat("k", r.s.s_suppkey)))
            .select(lambda r: {"c_custkey": r.c.c_custkey, "s_suppkey": r.s.s_suppkey}))


@query("join_subquery", """SELECT o_orderkey, q.lines, q.qty FROM orders JOIN (SELECT l_orderkey, count(*) AS lines, sum(l_quantity) AS qty FROM lineitem GROUP BY 1) q
  ON o_orderkey = q.l_orderkey WHERE q.qty > 100""")
def join_subquery(t: Tables) -> Query:
    sub = src(l=t.lineitem).group_by(lambda r: r.l.l_orderkey).select(lambda r: {"l_orderkey": r.l.l_orderkey, "lines": f.count(r.l.l_linenumber), "qty": f.sum_(r.l.l_quantity)})
    return (src(o=t.orders).inner_join({"q": sub}, lambda r: f.eq(r.o.o_orderkey, r.q.l_orderkey)).where(lambda r: f.gt(r.q.qty, 100))
            .select(lambda r: {"o_orderkey": r.o.o_orderkey, "lines": r.q.lines, "qty": r.q.qty}))


@query("join_anti", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_anti(t: Tables) -> Query:
    return (src(o=t.orders).left_join({"l": t.lineitem}, lambda r: f.eq(r.o.o_orderkey, r.l.l_orderkey)).where(lambda r: f.is_undefined(r.l))
            .select(lambda r: {"o_orderkey": r.o.o_orderkey}))


@query("bag_anti_join", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def bag_anti_join(t: Tables) -> DataFrame:
    return bag.join(bag.lift(t.df("documents").select("doc_id", "lang")), bag.lift(t.df("labels").select("doc_id")), ["doc_id"], "anti").drop(bag.M)


@query("filter_by", "SELECT c_custkey, n AS _mult FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY 1) ON c_custkey = o_custkey")
def filter_by(t: Tables) -> DataFrame:
    keys = t.df("orders").where("o_totalprice > 200000").selectExpr("o_custkey as c_custkey")
    return bag.filter_by(bag.lift(t.df("customer").select("c_custkey")), bag.lift(keys), ["c_custkey"])


@query("bag_join_full", """SELECT coalesce(a.k, b.k) AS k, a.x, b.y, coalesce(a.m, 1) * coalesce(b.m, 1) AS _mult FROM
  (SELECT c_nationkey AS k, c_mktsegment AS x, count(*) AS m FROM customer WHERE c_nationkey < 12 GROUP BY 1, 2) a FULL JOIN
  (SELECT s_nationkey AS k, 's' AS y, count(*) AS m FROM supplier WHERE s_nationkey > 5 GROUP BY 1) b ON a.k = b.k""")
def bag_join_full(t: Tables) -> DataFrame:
    a = bag.lift(t.df("customer").where("c_nationkey < 12").selectExpr("c_nationkey as k", "c_mktsegment as x"))
    b = bag.lift(t.df("supplier").where("s_nationkey > 5").selectExpr("s_nationkey as k", "'s' as y"))
    return bag.join(a, b, ["k"], "full")


# aggregates


@query("agg_group", "SELECT o_orderstatus, count(*) AS n, sum(o_totalprice) AS total, avg(o_totalprice) AS mean, min(o_totalprice) AS low, max(o_orderdate) AS last FROM orders GROUP BY 1")
def agg_group(t: Tables) -> Query:
    return (src(o=t.orders).group_by(lambda r: r.o.o_orderstatus).select(lambda r: {"o_orderstatus": r.o.o_orderstatus, "n": f.count(r.o.o_orderkey), "total": f.sum_(r.o.o_totalprice),
            "mean": f.avg(r.o.o_totalprice), "low": f.min_(r.o.o_totalprice), "last": f.max_(r.o.o_orderdate)}))


@query("agg_multi_key", "SELECT l_shipdate >= TIMESTAMP '1995-01-01' AS late, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2")
def agg_multi_key(t: Tables) -> Query:
    late = lambda r: f.gte(r.l.l_shipdate, when(1995))
    return src(l=t.lineitem).group_by(lambda r: late(r)).group_by(lambda r: r.l.l_returnflag).select(lambda r: {"late": late(r), "l_returnflag": r.l.l_returnflag, "n": f.count(r.l.l_orderkey)})


@query("agg_global", "SELECT count(*) AS n, sum(l_quantity) AS q, max(l_extendedprice) AS top FROM lineitem")
def agg_global(t: Tables) -> Query:
    return src(l=t.lineitem).select(lambda r: {"n": f.count(r.l.l_orderkey), "q": f.sum_(r.l.l_quantity), "top": f.max_(r.l.l_extendedprice)})


@query("agg_global_empty", "SELECT count(*) AS n FROM lineitem WHERE l_quantity < 0 HAVING count(*) > 0")
def agg_global_empty(t: Tables) -> Query:
    return src(l=t.lineitem).where(lambda r: f.lt(r.l.l_quantity, 0)).select(lambda r: {"n": f.count(r.l.l_orderkey)})


@query("agg_expr_wrapped", "SELECT o_orderpriority, coalesce(count(*), 0) + 1 AS n1, sum(o_totalprice) / count(*) AS per, CASE WHEN count(*) > 3000 THEN 'many' ELSE 'few' END AS size FROM orders GROUP BY 1")
def agg_expr_wrapped(t: Tables) -> Query:
    n = lambda r: f.count(r.o.o_orderkey)
    return (src(o=t.orders).group_by(lambda r: r.o.o_orderpriority).select(lambda r: {"o_orderpriority": r.o.o_orderpriority, "n1": f.add(f.coalesce(n(r), 0), 1),
            "per": f.divide(f.sum_(r.o.o_totalprice), n(r)), "size": f.case_when(f.gt(n(r), 3000), "many", "few")}))


@query("agg_having", "SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1 HAVING count(*) > 12 AND sum(o_totalprice) > 1500000")
def agg_having(t: Tables) -> Query:
    return (src(o=t.orders).group_by(lambda r: r.o.o_custkey).select(lambda r: {"o_custkey": r.o.o_custkey, "n": f.count(r.o.o_orderkey), "total": f.sum_(r.o.o_totalprice)})
            .having(lambda r: f.gt(f.count(r.o.o_orderkey), 12)).having(lambda r: f.gt(r.selected.total, 1500000)))


@query("agg_null_as_zero", "SELECT d.lang, sum(coalesce(l.quality, 0)) AS good, avg(coalesce(l.quality, 0)) AS share, count(l.quality) AS labelled FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def agg_null_as_zero(t: Tables) -> Query:
    return (src(d=t.documents).join({"l": t.labels}, lambda r: f.eq(r.d.doc_id, r.l.doc_id)).group_by(lambda r: r.d.lang)
            .select(lambda r: {"lang": r.d.lang, "good": f.sum_(r.l.quality), "share": f.avg(r.l.quality), "labelled": f.count(r.l.quality)}))


@query("agg_median", "SELECT l_returnflag, median(l_extendedprice) AS mid FROM lineitem GROUP BY 1")
def agg_median(t: Tables) -> Query:
    return src(l=t.lineitem).group_by(lambda r: r.l.l_returnflag).select(lambda r: {"l_returnflag": r.l.l_returnflag, "mid": f.median(r.l.l_extendedprice)})


@query("agg_mode", "SELECT l_returnflag, l_linenumber AS common FROM (SELECT l_returnflag, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_linenumber) AS k FROM lineitem GROUP BY 1, 2) WHERE k = 1")
def agg_mode(t: Tables) -> Query:
    return src(l=t.lineitem).group_by(lambda r: r.l.l_returnflag).select(lambda r: {"l_returnflag": r.l.l_returnflag, "common": f.mode(r.l.l_linenumber)})


@query("bag_group_by", """SELECT event_type, sum(value) AS total, count(value) AS n, avg(value) AS mean, min(value) AS low, max(value) AS high, median(value) AS mid,
  (SELECT x.user_id FROM events x WHERE x.event_type = e.event_type GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS who FROM events e GROUP BY 1""")
def bag_group_by(t: Tables) -> DataFrame:
    e = bag.lift(t.df("events").select("event_id", "event_type", "user_id", "value"))
    return bag.group_by(e, ["event_type"], total=("sum", "value"), n=("count", "value"), mean=("avg", "value"), low=("min", "value"), high=("max", "value"), mid=("median", "value"), who=("mode", "user_id"))


@query("bag_count", "SELECT user_id, count(*) AS count FROM events GROUP BY 1")
def bag_count(t: Tables) -> DataFrame:
    return bag.count(bag.lift(t.df("events").select("user_id")), ["user_id"])


@query("bag_reduce", "SELECT event_type, max(value) - min(value) AS spread FROM events GROUP BY 1")
def bag_reduce(t: Tables) -> DataFrame:
    import pandas as pd

    spread = lambda p: pd.DataFrame({"event_type": [p["event_type"].iloc[0]], "spread": [p["value"].max() - p["value"].min()]})
    return bag.reduce_(bag.lift(t.df("events").select("event_type", "value")), ["event_type"], spread, "event_type string, spread double")


# order, limit, pages, distinct


@query("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk(t: Tables) -> Query:
    return src(o=t.orders).select(lambda r: {"o_orderkey": r.o.o_orderkey, "o_totalprice": r.o.o_totalprice}).order_by(lambda r: r.o.o_totalprice, "desc").limit(10)


@query("offset_limit", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25 OFFSET 100")
def offset_limit(t: Tables) -> Query:
    return src(o=t.orders).select(lambda r: {"o_orderkey": r.o.o_orderkey, "o_orderdate": r.o.o_orderdate}).order_by(lambda r: r.selected.o_orderdate).offset(100).limit(25)


@query("topk_index", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS place FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 15 OFFSET 5")
def topk_index(t: Tables) -> DataFrame:
    return bag.top_k(t.df("orders"), [F.col("o_totalprice"), F.col("o_orderkey")], 15, 5, index="place").select("o_orderkey", F.col("place").cast("long").alias("place"))


@query("topk_per_group", "SELECT o_custkey, o_orderkey, k - 1 AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k BETWEEN 2 AND 4")
def topk_per_group(t: Tables) -> DataFrame:
    return bag.top_k(t.df("orders"), [F.desc("o_totalprice"), F.col("o_orderkey")], 3, 1, ["o_custkey"], "place").select("o_custkey", "o_orderkey", F.col("place").cast("long").alias("place"))


def _placed(direction: str, nulls: str):
    def build(t: Tables) -> DataFrame:
        q = (src(d=t.documents).left_join({"l": t.labels}, lambda r: f.eq(r.d.doc_id, r.l.doc_id)).select(lambda r: {"doc_id": r.d.doc_id, "quality": r.l.quality})
             .order_by(lambda r: r.l.quality, direction, nulls=nulls).order_by(lambda r: r.d.doc_id))
        keys = sort_columns([("quality", direction == "desc", nulls), ("doc_id", False, "first")])
        return bag.top_k(q.to_df(), keys, index="place")

    return build


for _name, _direction, _nulls in (("order_nulls", "desc", "last"), ("order_nulls_first", "desc", "first"), ("order_nulls_asc", "asc", "last")):
    query(_name, f"""SELECT d.doc_id, l.quality, row_number() OVER (ORDER BY l.quality {_direction} NULLS {_nulls}, d.doc_id) - 1 AS place
      FROM documents d LEFT JOIN labels l USING (doc_id)""")(_placed(_direction, _nulls))


@query("order_collated", """SELECT k, name, row_number() OVER (ORDER BY lower(name)) AS place FROM (
  SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN lower(s_name) ELSE upper(s_name) END || ' of ' || s_nationkey AS name FROM supplier) ORDER BY lower(name) LIMIT 60""")
def order_collated(t: Tables) -> DataFrame:
    """Names whose cases alternate: by code point all upper-case ones would come first."""
    name = F.concat(F.when(F.col("s_suppkey") % 2 == 0, F.lower("s_name")).otherwise(F.upper("s_name")), F.lit(" of "), F.col("s_nationkey").cast("string"))
    named = Table(t.df("supplier").select(F.col("s_suppkey").alias("k"), name.alias("name")), ("k",))
    out = src(s=named).select(lambda r: {"k": r.s.k, "name": r.s.name}).order_by(lambda r: r.s.name, string_sort="locale").limit(60).to_df()
    return out.select("k", "name", F.row_number().over(Window.orderBy(F.lower("name"))).cast("long").alias("place"))


@query("order_aggregate", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 20")
def order_aggregate(t: Tables) -> Query:
    return (src(o=t.orders).group_by(lambda r: r.o.o_custkey).select(lambda r: {"o_custkey": r.o.o_custkey, "n": f.count(r.o.o_orderkey)})
            .order_by(lambda r: f.sum_(r.o.o_totalprice), "desc").limit(20))


@query("keyset_page", """SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '1995-06-01' OR (o_orderdate = TIMESTAMP '1995-06-01' AND o_orderkey > 500)
  ORDER BY o_orderdate, o_orderkey LIMIT 20""")
def keyset_page(t: Tables) -> DataFrame:
    order = [("o_orderdate", False, "first"), ("o_orderkey", False, "first")]
    cursor = [dt.datetime(1995, 6, 1, tzinfo=dt.UTC), 500]
    return t.df("orders").select("o_orderkey", "o_orderdate").where(keyset_after(order, cursor)).orderBy(*sort_columns(order)).limit(20)


@query("find_one", "SELECT * FROM nation ORDER BY n_name DESC, n_nationkey LIMIT 1")
def find_one(t: Tables) -> Query:
    return src(n=t.nation).order_by(lambda r: r.n.n_name, "desc").find_one()


@query("distinct_select", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def distinct_select(t: Tables) -> Query:
    return src(c=t.customer).select(lambda r: {"c_nationkey": r.c.c_nationkey, "c_mktsegment": r.c.c_mktsegment}).distinct()


@query("distinct_computed", "SELECT DISTINCT upper(c_mktsegment) AS seg, c_acctbal > 0 AS pos FROM customer")
def distinct_computed(t: Tables) -> Query:
    return src(c=t.customer).select(lambda r: {"seg": f.upper(r.c.c_mktsegment), "pos": f.gt(r.c.c_acctbal, 0)}).distinct()


@query("distinct_hidden_order", "SELECT o_custkey FROM orders GROUP BY 1 ORDER BY min(o_orderdate), min_by(o_orderkey, (o_orderdate, o_orderkey)) LIMIT 10")
def distinct_hidden_order(t: Tables) -> Query:
    return src(o=t.orders).select(lambda r: {"o_custkey": r.o.o_custkey}).distinct().order_by(lambda r: [r.o.o_orderdate, r.o.o_orderkey]).limit(10)


@query("distinct_by", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k = 1")
def distinct_by(t: Tables) -> DataFrame:
    return bag.distinct(bag.lift(t.df("events").select("user_id", "event_id")), ["user_id"], ["event_id"]).drop(bag.M)


@query("count_distinct", "SELECT count(DISTINCT c_nationkey) AS n FROM customer")
def count_distinct(t: Tables) -> Query:
    sub = src(c=t.customer).select(lambda r: {"k": r.c.c_nationkey}).distinct()
    return src(d=sub).select(lambda r: {"n": f.count(r.d.k)})


# sets and bags


@query("union_sources", "SELECT c_custkey, NULL::BIGINT AS s_suppkey, c_name AS name FROM customer UNION ALL SELECT NULL, s_suppkey, s_name FROM supplier")
def union_sources(t: Tables) -> Query:
    return Query().union_all(c=t.customer, s=t.supplier).select(lambda r: {"c_custkey": r.c.c_custkey, "s_suppkey": r.s.s_suppkey, "name": f.coalesce(r.c.c_name, r.s.s_name)})


@query("union_branches", "SELECT c_name AS name, c_acctbal AS bal, c_mktsegment AS seg FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier")
def union_branches(t: Tables) -> Query:
    a = src(c=t.customer).where(lambda r: f.gt(r.c.c_acctbal, 9000)).select(lambda r: {"name": r.c.c_name, "bal": r.c.c_acctbal, "seg": r.c.c_mktsegment})
    b = src(s=t.supplier).select(lambda r: {"name": r.s.s_name, "bal": r.s.s_acctbal})
    return Query().union_all(a, b)


@query("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t: Tables) -> Query:
    return Query().union_all(src(c=t.customer).select(lambda r: {"k": r.c.c_nationkey}), src(s=t.supplier).select(lambda r: {"k": r.s.s_nationkey})).distinct()


@query("bag_difference", "SELECT user_id, event_type FROM events EXCEPT ALL SELECT user_id, event_type FROM events WHERE value > 50")
def bag_difference(t: Tables) -> DataFrame:
    e = t.df("events")
    return bag.expand(bag.difference(bag.lift(e.select("user_id", "event_type")), bag.lift(e.where("value > 50").select("user_id", "event_type"))))


@query("consolidate", """SELECT user_id, event_type, sum(m)::BIGINT AS _mult FROM (SELECT user_id, event_type, 1 AS m FROM events UNION ALL
  SELECT user_id, event_type, -1 FROM events WHERE event_type = 'click') GROUP BY 1, 2 HAVING sum(m) <> 0""")
def consolidate(t: Tables) -> DataFrame:
    e = t.df("events").select("user_id", "event_type")
    return bag.consolidate(bag.concat(bag.lift(e), bag.lift(e.where("event_type = 'click'"), -1)))


# functions


@query("fn_string", "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, length(p_type) AS n, concat(p_brand, '/', p_size, '') AS c, p_name LIKE '%a%' AS has_a FROM part")
def fn_string(t: Tables) -> Query:
    return src(p=t.part).select(lambda r: {"p_partkey": r.p.p_partkey, "u": f.upper(r.p.p_name), "l": f.lower(r.p.p_brand), "n": f.length(r.p.p_type), "c": f.concat(r.p.p_brand, "/", r.p.p_size, None), "has_a": f.like(r.p.p_name, "%a%")})


@query("fn_math", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity + 1 AS a, l_quantity - l_tax AS s, l_quantity * l_extendedprice AS m,
  CASE WHEN l_discount = 0 THEN NULL ELSE l_tax / l_discount END AS d FROM lineitem""")
def fn_math(t: Tables) -> Query:
    return src(l=t.lineitem).select(lambda r: {k: r.l[k] for k in KEYS["lineitem"]} | {"a": f.add(r.l.l_quantity, 1), "s": f.subtract(r.l.l_quantity, r.l.l_tax), "m": f.multiply(r.l.l_quantity, r.l.l_extendedprice), "d": f.divide(r.l.l_tax, r.l.l_discount)})


@query("fn_date", """SELECT event_id, strftime(ts, '%Y-%m-%d') AS d, strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS t, strftime(ts, '%Y-%m-%d') AS f FROM events""")
def fn_date(t: Tables) -> Query:
    return src(e=t.events).select(lambda r: {"event_id": r.e.event_id, "d": f.date(r.e.ts), "t": f.datetime(r.e.ts), "f": f.strftime("%Y-%m-%d", r.e.ts)})


@query("fn_case", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_orderstatus = 'F' THEN 'done' ELSE NULL END AS c FROM orders")
def fn_case(t: Tables) -> Query:
    return src(o=t.orders).select(lambda r: {"o_orderkey": r.o.o_orderkey, "c": f.case_when(f.gt(r.o.o_totalprice, 200000), "high", f.eq(r.o.o_orderstatus, "F"), "done")})


@query("fn_case_projection", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS total, CASE WHEN o_orderstatus = 'F' THEN 'closed' WHEN o_orderstatus = 'O' THEN 'open' END AS state FROM orders")
def fn_case_projection(t: Tables) -> DataFrame:
    q = src(o=t.orders).select(lambda r: {"o_orderkey": r.o.o_orderkey, "x": f.case_when(f.eq(r.o.o_orderstatus, "F"), {"total": r.o.o_totalprice, "state": "closed"}, f.eq(r.o.o_orderstatus, "O"), {"state": "open"})})
    return src(q=q).select(lambda r: {"o_orderkey": r.q.o_orderkey, "total": r.q.x.total, "state": r.q.x.state}).to_df()


@query("fn_coalesce", "SELECT d.doc_id, coalesce(l.quality, -1) AS q FROM documents d LEFT JOIN labels l USING (doc_id)")
def fn_coalesce(t: Tables) -> Query:
    return src(d=t.documents).join({"l": t.labels}, lambda r: f.eq(r.d.doc_id, r.l.doc_id)).select(lambda r: {"doc_id": r.d.doc_id, "q": f.coalesce(r.l.quality, -1)})


# nested queries


@query("include_array", "SELECT n_nationkey, coalesce(string_agg(s_name, ',' ORDER BY s_name), '') AS names, count(s_name) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY 1")
def include_array(t: Tables) -> DataFrame:
    child = lambda r: src(s=t.supplier).where(lambda c: f.and_(f.eq(r.n.n_nationkey, c.s.s_nationkey), f.gt(c.s.s_acctbal, 5000))).select(lambda c: {"name": c.s.s_name}).order_by(lambda c: c.s.s_name)
    df = src(n=t.nation).select(lambda r: {"n_nationkey": r.n.n_nationkey, "s": f.to_array(child(r))}).to_df()
    return df.select("n_nationkey", F.array_join("s.name", ",").alias("names"), F.size("s").cast("long").alias("n"))


@query("include_singleton", "SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS best FROM customer")
def include_singleton(t: Tables) -> Query:
    child = lambda r: src(o=t.orders).where(lambda c: f.eq(c.o.o_custkey, r.c.c_custkey)).where(lambda c: f.eq(c.o.o_orderpriority, "1-URGENT")).select(lambda c: c.o.o_orderkey).order_by(lambda c: c.o.o_totalprice, "desc").find_one()
    return src(c=t.customer).select(lambda r: {"c_custkey": r.c.c_custkey, "best": f.materialize(child(r))})


@query("include_concat", "SELECT r_regionkey, coalesce((SELECT string_agg(n_name, '' ORDER BY n_name) FROM nation WHERE n_regionkey = r_regionkey), '') AS names FROM region")
def include_concat(t: Tables) -> Query:
    child = lambda r: src(n=t.nation).where(lambda c: f.eq(c.n.n_regionkey, r.g.r_regionkey)).select(lambda c: c.n.n_name).order_by(lambda c: c.n.n_name)
    return src(g=t.region).select(lambda r: {"r_regionkey": r.g.r_regionkey, "names": f.concat(f.to_array(child(r)))})


@query("include_agg", "SELECT c_custkey, count(o_orderkey) AS n, sum(o_totalprice) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1")
def include_agg(t: Tables) -> DataFrame:
    child = lambda r: src(o=t.orders).where(lambda c: f.eq(c.o.o_custkey, r.c.c_custkey)).where(lambda c: f.eq(c.o.o_orderstatus, "P")).select(lambda c: {"n": f.count(c.o.o_orderkey), "total": f.sum_(c.o.o_totalprice)})
    df = src(c=t.customer).select(lambda r: {"c_custkey": r.c.c_custkey, "s": f.to_array(child(r))}).to_df()
    first = F.try_element_at("s", F.lit(1))
    return df.select("c_custkey", F.coalesce(first["n"], F.lit(0)).alias("n"), first["total"].alias("total"))


@query("include_topn", """SELECT c_custkey, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_totalprice DESC, o_orderkey), '') AS top FROM customer LEFT JOIN
  (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) ON o_custkey = c_custkey AND k <= 3 GROUP BY 1""")
def include_topn(t: Tables) -> DataFrame:
    child = lambda r: src(o=t.orders).where(lambda c: f.eq(c.o.o_custkey, r.c.c_custkey)).select(lambda c: c.o.o_orderkey).order_by(lambda c: c.o.o_totalprice, "desc").limit(3)
    return src(c=t.customer).select(lambda r: {"c_custkey": r.c.c_custkey, "top": f.to_array(child(r))}).to_df().select("c_custkey", F.array_join(F.col("top").cast("array<string>"), ",").alias("top"))


@query("include_nested", """SELECT r_name, string_agg(n_name || ':' || k, ',' ORDER BY n_name) AS tree FROM region JOIN
  (SELECT n_regionkey, n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 8000) AS k FROM nation) ON n_regionkey = r_regionkey GROUP BY 1""")
def include_nested(t: Tables) -> DataFrame:
    grand = lambda n: src(c=t.customer).where(lambda r: f.eq(r.c.c_nationkey, n.n.n_nationkey)).where(lambda r: f.gt(r.c.c_acctbal, 8000)).select(lambda r: r.c.c_custkey)
    child = lambda g: src(n=t.nation).where(lambda r: f.eq(r.n.n_regionkey, g.g.r_regionkey)).select(lambda r: {"name": r.n.n_name, "who": f.to_array(grand(r))}).order_by(lambda r: r.n.n_name)
    df = src(g=t.region).select(lambda r: {"r_name": r.g.r_name, "kids": f.to_array(child(r))}).to_df()
    return df.select("r_name", F.array_join(F.transform("kids", lambda k: F.concat(k["name"], F.lit(":"), F.size(k["who"]).cast("string"))), ",").alias("tree"))


@query("include_parent_filter", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 20 GROUP BY 1")
def include_parent_filter(t: Tables) -> DataFrame:
    child = lambda r: src(o=t.orders).where(lambda c: f.eq(c.o.o_custkey, r.c.c_custkey)).where(lambda c: f.gt(c.o.o_totalprice, f.multiply(r.c.c_acctbal, 20))).select(lambda c: c.o.o_orderkey)
    return src(c=t.customer).select(lambda r: {"c_custkey": r.c.c_custkey, "s": f.to_array(child(r))}).to_df().select("c_custkey", F.size("s").cast("long").alias("n"))


@query("include_turns", "SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY 1")
def include_turns(t: Tables) -> DataFrame:
    heads = src(h=t.conversations).select(lambda r: {"conv_id": r.h.conv_id}).distinct()
    child = lambda r: src(c=t.conversations).where(lambda k: f.eq(k.c.conv_id, r.x.conv_id)).select(lambda k: k.c.role).order_by(lambda k: k.c.turn)
    return src(x=heads).select(lambda r: {"conv_id": r.x.conv_id, "roles": f.to_array(child(r))}).to_df().select("conv_id", F.array_join("roles", ">").alias("roles"))


# Python functions of rows


@query("fn_where", "SELECT event_id, value FROM events WHERE value > 10 AND event_id % 3 = 0")
def fn_where(t: Tables) -> Query:
    keep = lambda p: (p["e"].str["value"] > 10) & (p["e"].str["event_id"] % 3 == 0)
    return src(e=t.events).fn_where(keep).select(lambda r: {"event_id": r.e.event_id, "value": r.e.value})


@query("fn_select", "SELECT event_id, value * 2 AS twice FROM events")
def fn_select(t: Tables) -> Query:
    import pandas as pd

    made = lambda p: pd.DataFrame({"event_id": p["e"].str["event_id"].astype("int64"), "twice": p["e"].str["value"].astype(float) * 2})
    return src(e=t.events).fn_select(made, "event_id long, twice double")


@query("fn_having", "SELECT event_type, count(*) AS n FROM events GROUP BY 1 HAVING count(*) % 2 = 0")
def fn_having(t: Tables) -> Query:
    return src(e=t.events).group_by(lambda r: r.e.event_type).select(lambda r: {"event_type": r.e.event_type, "n": f.count(r.e.event_id)}).fn_having(lambda p: p["n"] % 2 == 0)


# change feeds and maintained queries

_CHANGES = """SELECT event_id, user_id, ts, value, event_type, CASE WHEN event_type = 'purchase' AND value > 80 THEN 'delete' WHEN event_id % 4 = 0 THEN 'insert' ELSE 'update' END AS type FROM events"""


def _feed(t: Tables) -> DataFrame:
    kind = F.when((F.col("event_type") == "purchase") & (F.col("value") > 80), "delete").when(F.col("event_id") % 4 == 0, "insert").otherwise("update")
    return t.df("events").select("event_id", "user_id", "ts", "value", "event_type", kind.alias("type"))


@query("cdc_latest", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def cdc_latest(t: Tables) -> DataFrame:
    return cdc.latest(t.df("events").select("user_id", "event_id", "event_type", "value", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("cdc_apply_full", f"""WITH c AS ({_CHANGES}), last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM c) WHERE k = 1)
  SELECT c_custkey AS user_id, c_acctbal AS value, c_mktsegment AS event_type FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM last) UNION ALL
  SELECT user_id, value, event_type FROM last WHERE type <> 'delete'""")
def cdc_apply_full(t: Tables) -> DataFrame:
    base = t.df("customer").selectExpr("c_custkey as user_id", "c_acctbal as value", "c_mktsegment as event_type")
    return cdc.apply_changes(base, _feed(t), ["user_id"], ["ts", "event_id"])


@query("cdc_apply_partial", """WITH c AS (SELECT user_id, ts, event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value, CASE WHEN event_id % 2 = 0 THEN NULL ELSE event_type END AS event_type FROM events),
  m AS (SELECT user_id, max_by(value, (ts, event_id)) FILTER (value IS NOT NULL) AS v, max_by(event_type, (ts, event_id)) FILTER (event_type IS NOT NULL) AS e FROM c GROUP BY 1)
  SELECT coalesce(user_id, c_custkey) AS user_id, coalesce(v, c_acctbal) AS value, coalesce(e, c_mktsegment) AS event_type FROM customer FULL JOIN m ON c_custkey = user_id""")
def cdc_apply_partial(t: Tables) -> DataFrame:
    base = t.df("customer").selectExpr("c_custkey as user_id", "c_acctbal as value", "c_mktsegment as event_type")
    some = t.df("events").selectExpr("user_id", "ts", "event_id", "if(event_id % 3 = 0, null, value) as value", "if(event_id % 2 = 0, null, event_type) as event_type", "'update' as type")
    return cdc.apply_changes(base, some, ["user_id"], ["ts", "event_id"], mode="partial")


_STATES = """WITH b AS (SELECT user_id, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-10' AND event_type = 'click' GROUP BY 1),
  a AS (SELECT user_id, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-12' AND ts >= TIMESTAMP '2024-01-02' AND event_type = 'click' GROUP BY 1)"""


def _states(t: Tables) -> list[DataFrame]:
    e = t.df("events").where("event_type = 'click'")
    early, late = e.where(F.col("ts") < F.lit("2024-01-10").cast("timestamp")), e.where((F.col("ts") < F.lit("2024-01-12").cast("timestamp")) & (F.col("ts") >= F.lit("2024-01-02").cast("timestamp")))
    return [x.groupBy("user_id").agg(F.count("*").alias("n")) for x in (early, late)]


@query("effects_diff", f"""{_STATES} SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN b.user_id IS NULL THEN 'enter' WHEN a.user_id IS NULL THEN 'exit' ELSE 'update' END AS event,
  a.n AS now, b.n AS before FROM a FULL JOIN b ON a.user_id = b.user_id WHERE a.n IS DISTINCT FROM b.n""")
def effects_diff(t: Tables) -> DataFrame:
    return cdc.diff(*_states(t), ["user_id"]).select("user_id", "event", F.col("value.n").alias("now"), F.col("previous.n").alias("before"))


@query("subscription_move", """WITH c AS (SELECT event_id, value AS new, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM events)
  SELECT event_id, CASE WHEN old IS NULL THEN 'insert' WHEN new > 50 AND old > 50 THEN 'update' WHEN new > 50 THEN 'insert' ELSE 'delete' END AS type, CASE WHEN new > 50 THEN new ELSE old END AS value
  FROM c WHERE new > 50 OR old > 50""")
def subscription_move(t: Tables) -> DataFrame:
    old = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    feed = t.df("events").withColumn("old", old).select("event_id", F.when(F.col("old").isNull(), "insert").otherwise("update").alias("type"), F.struct(F.col("value").alias("v")).alias("value"), F.when(F.col("old").isNotNull(), F.struct(F.col("old").alias("v"))).alias("previous"))
    return cdc.filter_feed(feed, lambda c: c("v") > 50).select("event_id", "type", F.col("value.v").alias("value"))


@query("cdc_deltas", """WITH c AS (SELECT event_type, value AS new, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM events)
  SELECT value, sum(m)::BIGINT AS _mult FROM (SELECT new AS value, 1 AS m FROM c UNION ALL SELECT old, -1 FROM c WHERE old IS NOT NULL) GROUP BY 1 HAVING sum(m) <> 0""")
def cdc_deltas(t: Tables) -> DataFrame:
    old = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    feed = t.df("events").withColumn("old", old).select(F.when(F.col("old").isNull(), "insert").otherwise("update").alias("type"), F.struct("value").alias("value"), F.when(F.col("old").isNotNull(), F.struct(F.col("old").alias("value"))).alias("previous"))
    return bag.consolidate(cdc.to_deltas(feed))


@query("cdc_net", """SELECT user_id, CASE WHEN sum((event_id % 2)::INT) = 0 THEN 'insert' WHEN min(event_id % 2) = 1 THEN 'delete' ELSE 'update' END AS type,
  coalesce(max_by(value, event_id) FILTER (event_id % 2 = 0), max_by(value, event_id) FILTER (event_id % 2 = 1)) AS value FROM events GROUP BY 1""")
def cdc_net(t: Tables) -> DataFrame:
    deltas = t.df("events").select("user_id", "value", F.col("event_id").alias("seq"), F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1).cast("long").alias(bag.M))
    return cdc.net(deltas, ["user_id"], "seq").select("user_id", "type", F.col("value.value").alias("value"))


@query("snapshot_feed", "SELECT event_id, 'insert' AS type, value FROM events WHERE value > 90 ORDER BY value DESC, event_id LIMIT 50")
def snapshot_feed(t: Tables) -> DataFrame:
    out = cdc.snapshot(t.df("events").select("event_id", "value"), ["event_id"], F.col("value") > 90, [F.desc("value"), F.col("event_id")], 50)
    return out.select("event_id", "type", F.col("value.value").alias("value"))


@query("live_incremental_agg", "SELECT event_type, count(*) AS n, sum(value) AS total FROM events WHERE NOT (event_id % 10 = 3) GROUP BY 1")
def live_incremental_agg(t: Tables) -> DataFrame:
    """Four batches of inserts and one of deletes, each maintained for the affected keys only."""
    build = lambda b: src(e=b["e"]).group_by(lambda r: r.e.event_type).select(lambda r: {"event_type": r.e.event_type, "n": f.count(r.e.event_id), "total": f.sum_(r.e.value)})
    rows = t.df("events").select("event_id", "event_type", "value")
    path = f"{sources.shared_dir(t.spark)}/live-{uuid.uuid4().hex}"
    live = LiveQuery(t.spark, path, build, {"e": Table(rows.where("event_id % 4 = 0"), ("event_id",), "e")}, ["event_type"], {"e": {"event_type": "event_type"}})
    for k in (1, 2, 3):
        live.apply("e", rows.where(f"event_id % 4 = {k}").withColumn("seq", F.lit(k)).withColumn("type", F.lit("insert")), k)
    live.apply("e", rows.where("event_id % 10 = 3").withColumn("seq", F.lit(9)).withColumn("type", F.lit("delete")), 9)
    return live.df()


@query("tx_log_pull", "SELECT event_id, value FROM events WHERE event_id % 3 <> 0")
def tx_log_pull(t: Tables) -> DataFrame:
    log = sources.TxLog(t.spark, f"{sources.shared_dir(t.spark)}/log-{uuid.uuid4().hex}", ["event_id"])
    rows = t.df("events").select("event_id", "value").withColumn("type", F.lit("insert"))
    for part in range(3):
        log.append(rows.where(f"event_id % 3 = {part}"))
    return log.pull_since(1)[1].select("event_id", "value")


@query("subset_load", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_totalprice < 150000")
def subset_load(t: Tables) -> DataFrame:
    """Two overlapping loads and one that they cover; the last reads nothing from the source."""
    table = Table(t.df("orders").select("o_orderkey", "o_totalprice"), ("o_orderkey",), "orders")
    source = sources.SubsetSource(table, sources.VersionedTable(t.spark, f"{sources.shared_dir(t.spark)}/subset-{uuid.uuid4().hex}"))
    price = Ref("t", ("o_totalprice",))
    source.load(Subset(f.gt(price, 120000)))
    source.load(Subset(f.gt(price, 100000)))
    return source.load(Subset(f.and_(f.gt(price, 100000), f.lt(price, 150000))))


@query("live_stream_agg", "SELECT event_type, count(*) AS n, max(value) AS high FROM events GROUP BY 1")
def live_stream_agg(t: Tables) -> DataFrame:
    """The events table as a stream of inserts into a maintained query, one micro-batch after another until it is read."""
    build = lambda b: src(e=b["e"]).group_by(lambda r: r.e.event_type).select(lambda r: {"event_type": r.e.event_type, "n": f.count(r.e.event_id), "high": f.max_(r.e.value)})
    schema = t.df("events").schema
    path = f"{sources.shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    none = t.df("events").select("event_id", "event_type", "value").limit(0)
    live = LiveQuery(t.spark, f"{path}/live", build, {"e": Table(none, ("event_id",), "e")}, ["event_type"], {"e": {"event_type": "event_type"}})
    feed = t.spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{t.dir}/events.parquet*")
    feed = feed.select("event_id", "event_type", "value", F.col("event_id").alias("seq"), F.lit("insert").alias("type"))
    live.stream("e", feed, f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return live.df()


@query("effects_batches", """SELECT k AS batch, event, count(*) AS n FROM (
  SELECT 1 AS k, CASE WHEN b.user_id IS NULL THEN 'enter' WHEN a.user_id IS NULL THEN 'exit' ELSE 'update' END AS event
  FROM (SELECT user_id, sum(value) AS v FROM events WHERE event_id % 2 = 0 AND user_id % 3 <> 0 GROUP BY 1) b
  FULL JOIN (SELECT user_id, sum(value) AS v FROM events WHERE user_id % 3 <> 1 GROUP BY 1) a ON a.user_id = b.user_id
  WHERE a.v IS DISTINCT FROM b.v) GROUP BY 1, 2""")
def effects_batches(t: Tables) -> DataFrame:
    """An effect over two states of a result; what its handlers got is counted."""
    e, seen = t.df("events"), []
    states = [e.where(c).groupBy("user_id").agg(F.sum("value").alias("v")) for c in ("event_id % 2 = 0 and user_id % 3 <> 0", "user_id % 3 <> 1")]
    state = sources.VersionedTable(t.spark, f"{sources.shared_dir(t.spark)}/effect-{uuid.uuid4().hex}")
    effect = Effect(state, ["user_id"], *[seen.append] * 3, skip_initial=True)
    for n, now in enumerate(states):
        effect.run(now, n)
    return reduce(DataFrame.unionByName, seen).groupBy("event").agg(F.count("*").alias("n")).select(F.lit(state.batch).alias("batch"), "event", "n")


@query("include_conditional", """SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) END AS n FROM customer""")
def include_conditional(t: Tables) -> DataFrame:
    child = lambda r: src(o=t.orders).where(lambda c: f.eq(c.o.o_custkey, r.c.c_custkey)).select(lambda c: c.o.o_orderkey)
    q = src(c=t.customer).select(lambda r: {"c_custkey": r.c.c_custkey, "x": f.case_when(f.gt(r.c.c_acctbal, 5000), {"orders": f.to_array(child(r))})})
    return q.to_df().select("c_custkey", F.when(F.col("x").isNotNull(), F.size("x.orders")).cast("long").alias("n"))


@query("include_limit_offset", """SELECT n_nationkey, coalesce(string_agg(c_name, ',' ORDER BY c_name, c_custkey), '') AS names FROM nation LEFT JOIN
  (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name, c_custkey) AS k FROM customer) ON c_nationkey = n_nationkey AND k BETWEEN 3 AND 5 GROUP BY 1""")
def include_limit_offset(t: Tables) -> DataFrame:
    child = lambda r: src(c=t.customer).where(lambda k: f.eq(k.c.c_nationkey, r.n.n_nationkey)).select(lambda k: k.c.c_name).order_by(lambda k: k.c.c_name).offset(2).limit(3)
    return src(n=t.nation).select(lambda r: {"n_nationkey": r.n.n_nationkey, "names": f.to_array(child(r))}).to_df().select("n_nationkey", F.array_join("names", ",").alias("names"))


@query("include_grouped", """SELECT c_nationkey AS k, string_agg(seg || ':' || n, ',' ORDER BY seg) AS segs FROM (SELECT c_nationkey, c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY 1, 2) GROUP BY 1""")
def include_grouped(t: Tables) -> DataFrame:
    child = lambda r: (src(c=t.customer).where(lambda k: f.eq(k.c.c_nationkey, r.n.n_nationkey)).group_by(lambda k: k.c.c_mktsegment)
                       .select(lambda k: {"seg": k.c.c_mktsegment, "n": f.count(k.c.c_custkey)}).order_by(lambda k: k.selected.seg))
    df = src(n=t.nation).select(lambda r: {"k": r.n.n_nationkey, "s": f.to_array(child(r))}).to_df()
    return df.select("k", F.array_join(F.transform("s", lambda x: F.concat(x["seg"], F.lit(":"), x["n"].cast("string"))), ",").alias("segs"))


@query("union_then_group", "SELECT kind, count(*) AS n, sum(bal) AS total FROM (SELECT 'c' AS kind, c_acctbal AS bal FROM customer UNION ALL SELECT 's', s_acctbal FROM supplier) GROUP BY 1")
def union_then_group(t: Tables) -> Query:
    both = Query().union_all(src(c=t.customer).select(lambda r: {"kind": "c", "bal": r.c.c_acctbal}), src(s=t.supplier).select(lambda r: {"kind": "s", "bal": r.s.s_acctbal}))
    return src(u=both).group_by(lambda r: r.u.kind).select(lambda r: {"kind": r.u.kind, "n": f.count(r.u.kind), "total": f.sum_(r.u.bal)})


@query("order_with_index", "SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS place FROM part")
def order_with_index(t: Tables) -> DataFrame:
    return bag.top_k(t.df("part").select("p_partkey", "p_retailprice"), [F.desc("p_retailprice"), F.col("p_partkey")], index="place").drop("p_retailprice")


@query("page_after", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 20")
def page_after(t: Tables) -> DataFrame:
    """The second page, by the first one's cursor and not by counting rows."""
    pages = Pages(t.df("orders").select("o_orderkey", "o_totalprice"), [("o_totalprice", True, "last"), ("o_orderkey", False, "first")], 20)
    pages.fetch_next()
    return t.spark.createDataFrame(pages.fetch_next(), "o_orderkey long, o_totalprice double").drop("o_totalprice")


@query("upsert_merge", """SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT s_suppkey, s_acctbal + 1 FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 2 = 0
  UNION ALL SELECT s_suppkey + 1000000, 0 FROM supplier WHERE s_suppkey % 3 = 0""")
def upsert_merge(t: Tables) -> DataFrame:
    store = sources.VersionedTable(t.spark, f"{sources.shared_dir(t.spark)}/upsert-{uuid.uuid4().hex}")
    s = t.df("supplier").select("s_suppkey", "s_acctbal")
    store.publish(s)
    third = s.where("s_suppkey % 3 = 0")
    rows = third.selectExpr("s_suppkey", "s_acctbal + 1 as s_acctbal").unionByName(third.selectExpr("s_suppkey + 1000000 as s_suppkey", "0.0D as s_acctbal"))
    return sources.upsert(store, rows, ["s_suppkey"], (F.col("s_suppkey") < 1000000) & (F.col("s_suppkey") % 2 == 1))


# bags, one operator each


@query("bag_map", "SELECT o_custkey AS k, o_totalprice * 2 AS twice FROM orders")
def bag_map(t: Tables) -> DataFrame:
    return bag.expand(bag.map_(bag.lift(t.df("orders")), k=F.col("o_custkey"), twice=F.col("o_totalprice") * 2))


@query("bag_filter", "SELECT o_orderkey FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'F'")
def bag_filter(t: Tables) -> DataFrame:
    return bag.expand(bag.map_(bag.filter_(bag.lift(t.df("orders")), (F.col("o_totalprice") > 150000) & (F.col("o_orderstatus") == "F")), o_orderkey=F.col("o_orderkey")))


def _bag_join(how: str):
    def build(t: Tables) -> DataFrame:
        people = bag.lift(t.df("customer").where("c_acctbal > 2000").select(F.col("c_custkey").alias("k"), "c_name"))
        bought = bag.lift(t.df("orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k"), "o_orderkey"))
        return bag.expand(bag.join(people, bought, ["k"], how)).select("k", "c_name", "o_orderkey")

    return build


for _how in ("inner", "left", "right"):
    query(f"bag_join_{_how}", f"""SELECT coalesce(c_custkey, o_custkey) AS k, c_name, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 2000) c
      {_how.upper()} JOIN (SELECT * FROM orders WHERE o_orderstatus = 'O') o ON c_custkey = o_custkey""")(_bag_join(_how))


@query("bag_keys", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 7 = 3")
def bag_keys(t: Tables) -> DataFrame:
    """Keyed by customer, keyed anew by the remainder, filtered by that key and unkeyed."""
    keyed = bag.rekey(bag.key_by(t.df("orders").select("o_orderkey", "o_custkey"), F.col("o_custkey")), F.col("o_custkey") % 7)
    return bag.unkey(keyed.where("_key = 3"))


@query("bag_order_by", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5")
def bag_order_by(t: Tables) -> DataFrame:
    return bag.order_by(t.df("orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()], 25, 5)


@query("bag_pipe", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def bag_pipe(t: Tables) -> DataFrame:
    met = []
    out = bag.pipe(t.df("nation"), lambda df: bag.tap(df, met.append), lambda df: df.groupBy("n_regionkey").agg(F.count("*").alias("n")))
    return out if len(met) == 1 else out.limit(0)


@query("order_moves", """WITH a AS (SELECT o_custkey AS k, row_number() OVER (ORDER BY sum(o_totalprice) DESC, o_custkey) - 1 AS place FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1),
  b AS (SELECT o_custkey AS k, row_number() OVER (ORDER BY sum(o_totalprice) DESC, o_custkey) - 1 AS place FROM orders GROUP BY 1)
  SELECT k, a.place AS "from", b.place AS "to" FROM a JOIN b USING (k) WHERE a.place <> b.place""")
def order_moves(t: Tables) -> DataFrame:
    """Customers whose place by turnover changes as orders come in.

    Each total is added up in the order of its orders' keys.  Sums of doubles
    added in any order would differ in their last bits with the tables' files,
    and with them the places of customers whose totals are equal or nearly so.
    """
    places = []
    whole = Window.partitionBy("k").orderBy("o_orderkey", "o_totalprice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for c in ("o_orderkey % 5 <> 0", "true"):
        orders = t.df("orders").where(c).select(F.col("o_custkey").alias("k"), "o_orderkey", "o_totalprice")
        running = orders.select("k", F.sum("o_totalprice").over(whole).alias("sum"), F.row_number().over(whole).alias("n"))
        sums = running.groupBy("k").agg(F.max_by("sum", "n").alias("total"))
        places.append(bag.top_k(sums, [F.col("total").desc(), F.col("k").asc_nulls_last()], index="place").select("k", "place"))
    return cdc.moves(*places, ["k"], "place")


# unions of queries


def _both(t: Tables) -> Query:
    people = src(c=t.customer).select(lambda r: {"kind": "customer", "id": r.c.c_custkey, "nation": r.c.c_nationkey, "balance": r.c.c_acctbal})
    firms = src(s=t.supplier).select(lambda r: {"kind": "supplier", "id": r.s.s_suppkey, "nation": r.s.s_nationkey, "balance": r.s.s_acctbal})
    return Query().union_all(people, firms)


BOTH = """(SELECT 'customer' AS kind, c_custkey AS id, c_nationkey AS nation, c_acctbal AS balance FROM customer
  UNION ALL SELECT 'supplier', s_suppkey, s_nationkey, s_acctbal FROM supplier)"""


@query("union_where", f"SELECT kind, id FROM {BOTH} WHERE balance > 5000 AND nation <> 3")
def union_where(t: Tables) -> Query:
    return _both(t).where(lambda r: f.and_(f.gt(r.balance, 5000), f.not_(f.eq(r.nation, 3)))).select(lambda r: {"kind": r.kind, "id": r.id})


@query("union_branches_group", f"SELECT nation, count(kind) AS n, sum(balance) AS total FROM {BOTH} GROUP BY 1 HAVING count(kind) > 50")
def union_branches_group(t: Tables) -> Query:
    return (_both(t).group_by(lambda r: r.nation).select(lambda r: {"nation": r.nation, "n": f.count(r.kind), "total": f.sum_(r.balance)})
            .having(lambda r: f.gt(f.count(r.kind), 50)))


@query("union_join", f"SELECT kind, id, n_name FROM {BOTH} JOIN nation ON nation = n_nationkey WHERE n_regionkey = 1")
def union_join(t: Tables) -> Query:
    return (_both(t).join({"n": t.nation}, lambda r: f.eq(r.nation, r.n.n_nationkey), "inner").where(lambda r: f.eq(r.n.n_regionkey, 1))
            .select(lambda r: {"kind": r.kind, "id": r.id, "n_name": r.n.n_name}))


@query("union_order", f"SELECT kind, id, balance FROM {BOTH} ORDER BY balance DESC, kind, id LIMIT 40 OFFSET 10")
def union_order(t: Tables) -> Query:
    q = _both(t).select(lambda r: {"kind": r.kind, "id": r.id, "balance": r.balance})
    return q.order_by(lambda r: r.balance, "desc").order_by(lambda r: [r.kind, r.id]).offset(10).limit(40)


@query("union_include", """SELECT 'nation' AS kind, n_nationkey AS id, coalesce((SELECT string_agg(s_name, ',' ORDER BY s_name) FROM supplier WHERE s_nationkey = n_nationkey), '') AS names FROM nation
  UNION ALL SELECT 'region', r_regionkey, NULL FROM region""")
def union_include(t: Tables) -> DataFrame:
    """A branch with a nested query; the other branch lacks that field."""
    child = lambda r: src(s=t.supplier).where(lambda k: f.eq(k.s.s_nationkey, r.n.n_nationkey)).select(lambda k: k.s.s_name).order_by(lambda k: k.s.s_name)
    nations = src(n=t.nation).select(lambda r: {"kind": "nation", "id": r.n.n_nationkey, "names": f.to_array(child(r))})
    regions = src(g=t.region).select(lambda r: {"kind": "region", "id": r.g.r_regionkey})
    return Query().union_all(nations, regions).to_df().select("kind", "id", F.array_join("names", ",").alias("names"))


@query("include_through_subquery", """SELECT n_nationkey, coalesce((SELECT string_agg(c_name, ',' ORDER BY c_name) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 8000), '') AS rich
  FROM nation WHERE n_regionkey = 2""")
def include_through_subquery(t: Tables) -> DataFrame:
    child = lambda r: src(c=t.customer).where(lambda k: f.and_(f.eq(k.c.c_nationkey, r.n.n_nationkey), f.gt(k.c.c_acctbal, 8000))).select(lambda k: k.c.c_name).order_by(lambda k: k.c.c_name)
    inner = src(n=t.nation).select(lambda r: {"n_nationkey": r.n.n_nationkey, "region": r.n.n_regionkey, "rich": f.to_array(child(r))})
    return src(q=inner).where(lambda r: f.eq(r.q.region, 2)).to_df().select("n_nationkey", F.array_join("rich", ",").alias("rich"))


# Python functions with clauses behind them


def _doubled(t: Tables) -> Query:
    return src(o=t.orders).fn_select(lambda pdf: pdf["o"].apply(lambda o: {"k": o["o_custkey"] % 100, "half": o["o_totalprice"] / 2}).apply(pd.Series).astype({"k": "int64"}), "k long, half double")


@query("fn_select_order_limit", "SELECT o_custkey % 100 AS k, o_totalprice / 2 AS half FROM orders WHERE o_totalprice / 2 > 1000 ORDER BY half DESC, k LIMIT 15 OFFSET 3")
def fn_select_order_limit(t: Tables) -> Query:
    return _doubled(t).fn_having(lambda pdf: pdf["half"] > 1000).order_by(lambda r: r.selected.half, "desc").order_by(lambda r: r.selected.k).offset(3).limit(15)


@query("fn_select_distinct", "SELECT DISTINCT o_custkey % 100 AS k FROM orders")
def fn_select_distinct(t: Tables) -> Query:
    return src(o=t.orders).fn_select(lambda pdf: pd.DataFrame({"k": [o["o_custkey"] % 100 for o in pdf["o"]]}), "k long").distinct()


# values


@query("filter_is_null", "SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1")
def filter_is_null(t: Tables) -> Query:
    """A field that is null where its row is there; documents without a label have no row and don't count."""
    marked = Table(t.df("labels").select("doc_id", F.when(F.col("toxic") == 0, 0).alias("clean")), ("doc_id",))
    return src(d=t.documents).left_join({"l": marked}, lambda r: f.eq(r.d.doc_id, r.l.doc_id)).where(lambda r: f.is_null(r.l.clean)).select(lambda r: {"doc_id": r.d.doc_id})


def _null_keys(t: Tables, null_safe: bool) -> Query:
    keyed = t.df("orders").select("o_orderkey", F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")).alias("k"))
    names = t.df("customer").select("c_name", F.when(F.col("c_custkey") != 0, F.col("c_custkey")).alias("k"))
    return (src(o=Table(keyed, ("o_orderkey",))).join({"c": Table(names, ("c_name",))}, lambda r: f.eq(r.o.k, r.c.k), "inner", null_safe)
            .select(lambda r: {"o_orderkey": r.o.o_orderkey, "c_name": r.c.c_name}))


NULL_KEYS = """SELECT o_orderkey, c_name FROM (SELECT o_orderkey, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey END AS a FROM orders)
  JOIN (SELECT c_name, CASE WHEN c_custkey <> 0 THEN c_custkey END AS b FROM customer) ON """
query("join_null_keys", NULL_KEYS + "a = b")(lambda t: _null_keys(t, False))
query("join_null_safe", NULL_KEYS + "a IS NOT DISTINCT FROM b")(lambda t: _null_keys(t, True))


@query("agg_text_numbers", "SELECT o_orderstatus, CAST(sum(-o_orderkey) AS DOUBLE) AS total, avg(CAST(o_orderkey || 'e1' AS DOUBLE)) AS mean FROM orders GROUP BY 1")
def agg_text_numbers(t: Tables) -> Query:
    """Texts that write numbers with a sign or an exponent, and one that writes none and is 0."""
    text = t.df("orders").select("o_orderkey", "o_orderstatus", F.concat(F.lit("-"), F.col("o_orderkey").cast("string")).alias("a"), F.concat(F.col("o_orderkey").cast("string"), F.lit("e1")).alias("b"))
    return src(o=Table(text, ("o_orderkey",))).group_by(lambda r: r.o.o_orderstatus).select(lambda r: {"o_orderstatus": r.o.o_orderstatus, "total": f.sum_(r.o.a), "mean": f.avg(r.o.b)})


@query("fn_strftime", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS d FROM events WHERE ts >= TIMESTAMP '1900-01-01'")
def fn_strftime(t: Tables) -> Query:
    return src(e=t.events).where(lambda r: f.gte(r.e.ts, dt.datetime(1900, 1, 1, tzinfo=dt.UTC))).select(lambda r: {"event_id": r.e.event_id, "d": f.strftime("%Y-%m-%d", r.e.ts)})


# sources


def _round_trip(kind: str, **options):
    def build(t: Tables) -> DataFrame:
        rows = t.df("customer").select("c_custkey", "c_name", "c_acctbal")
        path = f"{sources.shared_dir(t.spark)}/{kind}-{uuid.uuid4().hex}"
        rows.write.format(kind).options(**options).save(path)
        schema = rows.schema if kind in ("json", "csv") else None
        return src(c=sources.read(t.spark, path, ("c_custkey",), kind, schema, **options)).where(lambda r: f.gt(r.c.c_acctbal, 0)).to_df()

    return build


for _kind, _options in (("json", {}), ("csv", {"header": "true"}), ("orc", {})):
    query(f"source_{_kind}", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 0")(_round_trip(_kind, **_options))


@query("source_text", "SELECT n_name AS value FROM nation")
def source_text(t: Tables) -> DataFrame:
    path = f"{sources.shared_dir(t.spark)}/text-{uuid.uuid4().hex}"
    t.df("nation").select("n_name").write.text(path)
    return src(x=sources.read(t.spark, path, format="text")).to_df()


@query("source_memory", "SELECT n_name, code FROM nation JOIN (VALUES (0, 'AL'), (1, 'AR'), (7, 'GE')) v(k, code) ON k = n_nationkey")
def source_memory(t: Tables) -> Query:
    rows = sources.in_memory(t.spark, [(0, "AL"), (1, "AR"), (7, "GE")], "k int, code string", ("k",))
    return src(n=t.nation).inner_join({"v": rows}, lambda r: f.eq(r.n.n_nationkey, r.v.k)).select(lambda r: {"n_name": r.n.n_name, "code": r.v.code})


@query("subset_window", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 15 OFFSET 30")
def subset_window(t: Tables) -> DataFrame:
    """A window of rows, and one inside it that reads nothing from the source."""
    table = Table(t.df("orders").select("o_orderkey", "o_totalprice"), ("o_orderkey",), "orders")
    source = sources.SubsetSource(table, sources.VersionedTable(t.spark, f"{sources.shared_dir(t.spark)}/subset-{uuid.uuid4().hex}"))
    order = (Order(Ref("t", ("o_totalprice",))),)
    source.load(Subset(f.gt(Ref("t", ("o_totalprice",)), 400000)))
    source.load(Subset(None, order, 40, 20))
    out = source.load(Subset(None, order, 15, 30))
    return out if source.requests == 2 else out.limit(0)


# feeds, overlays, effects


@query("feed_guard", """SELECT user_id, event_id AS seq, CASE WHEN k = 1 AND NOT seen THEN 'insert' WHEN k = 1 THEN NULL ELSE 'update' END AS type FROM (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, user_id % 2 = 0 AS seen, event_id % 2 = 0 AS fresh FROM events) WHERE (k = 1 AND NOT seen) OR (NOT fresh AND NOT (k = 1 AND NOT seen))
  """.replace("WHEN k = 1 THEN NULL ", ""))
def feed_guard(t: Tables) -> DataFrame:
    """Inserts and updates by turns; subscribers see users of even ids already."""
    feed = t.df("events").select("user_id", F.col("event_id").alias("seq"), F.when(F.col("event_id") % 2 == 0, "insert").otherwise("update").alias("type"))
    return cdc.guard_duplicates(feed, t.df("events").select("user_id").where("user_id % 2 = 0"), ["user_id"], "seq")


@query("overlay_view", """SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'RENAMED' ELSE n_name END AS n_name FROM nation WHERE n_nationkey <> 5 UNION ALL SELECT 900, 'NEW'""")
def overlay_view(t: Tables) -> DataFrame:
    """A completed transaction stays in view over a sync that doesn't have it yet."""
    base = t.df("nation").select("n_nationkey", "n_name")
    overlay = cdc.Overlay(base, ["n_nationkey"])
    tx = overlay.begin()
    tx.insert(900, n_name="NEW")
    tx.update(3, n_name="RENAMED")
    tx.delete(5)
    overlay.commit(tx, lambda mutations: None)
    overlay.sync(base)
    return overlay.view()


@query("live_set", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def live_set(t: Tables) -> DataFrame:
    """Two tables, the second computed from the first, brought up to date in order."""
    folder = f"{sources.shared_dir(t.spark)}/set-{uuid.uuid4().hex}"
    large, counts = (sources.VersionedTable(t.spark, f"{folder}/{n}") for n in ("large", "counts"))
    nodes = LiveSet()
    nodes.add("large", lambda: large.publish(t.df("orders").where("o_totalprice > 100000")))
    nodes.add("counts", lambda: counts.publish(large.read().groupBy("o_orderstatus").agg(F.count("*").alias("n"))), ("large",))
    nodes.touch("large")
    nodes.flush()
    return counts.read()


# maintained by changes


def _store(t: Tables, name: str) -> str:
    return f"{sources.shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("live_join", """SELECT c_custkey AS k, c_name, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 4 <> 2) ON o_custkey = c_custkey WHERE c_custkey % 9 <> 4""")
def live_join(t: Tables) -> DataFrame:
    """A left join of which both sides change; the second batch takes rows away from both."""
    people = bag.lift(t.df("customer").select(F.col("c_custkey").alias("k"), "c_name"))
    bought = bag.lift(t.df("orders").select(F.col("o_custkey").alias("k"), "o_orderkey"))
    live = maintained.join(t.spark, _store(t, "join"), people.where("k % 2 = 0"), bought.where("o_orderkey % 2 = 0"), ["k"], "left")
    live.apply(1, left=people.where("k % 2 = 1"), right=bought.where("o_orderkey % 2 = 1"))
    live.apply(2, left=bag.negate(people.where("k % 9 = 4")), right=bag.negate(bought.where("o_orderkey % 4 = 2")))
    return bag.expand(live.df())


@query("live_topk", """SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 5 <> 3 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 4)""")
def live_topk(t: Tables) -> DataFrame:
    """A window of the dearest orders while orders come and go, moved at the end; what moved in less what moved out is the window."""
    rows = bag.lift(t.df("orders").select("o_orderkey", "o_totalprice"))
    live = maintained.TopK(t.spark, _store(t, "topk"), rows.where("o_orderkey % 2 = 0"), ["o_orderkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()], 20)
    shown = bag.lift(live.df())
    for n, delta in enumerate([rows.where("o_orderkey % 2 = 1"), bag.negate(rows.where("o_orderkey % 5 = 3"))]):
        shown = t.spark.createDataFrame(bag.concat(shown, live.apply(delta, n)).collect(), shown.schema)  # the window's rows, a limit's worth
    shown = bag.concat(shown, live.move(4))
    return bag.expand(shown).select("o_orderkey", "o_totalprice")


@query("live_retraction", """SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS high, median(o_totalprice) AS mid FROM orders WHERE o_totalprice < 150000 GROUP BY 1""")
def live_retraction(t: Tables) -> DataFrame:
    """Aggregates whose largest values are taken away again."""
    rows = bag.lift(t.df("orders").select("o_orderkey", "o_orderstatus", "o_totalprice"))
    live = maintained.group_by(t.spark, _store(t, "groups"), rows, ["o_orderstatus"], n=("count", "o_orderkey"), high=("max", "o_totalprice"), mid=("median", "o_totalprice"))
    live.apply(1, rows=bag.negate(rows.where("o_totalprice >= 150000")))
    return bag.expand(live.df())


@query("live_totals", "SELECT l_returnflag, count(*) AS n, sum(l_linenumber) AS s, avg(l_linenumber) AS m FROM lineitem WHERE l_linenumber <> 2 GROUP BY 1")
def live_totals(t: Tables) -> DataFrame:
    """Sums by delta: no row is read again when others come or go."""
    rows = bag.lift(t.df("lineitem").select("l_returnflag", F.col("l_linenumber").cast("long").alias("l_linenumber")))
    live = maintained.Totals(t.spark, _store(t, "totals"), rows.where("l_linenumber < 3"), ["l_returnflag"], n=("count", "l_linenumber"), s=("sum", "l_linenumber"), m=("avg", "l_linenumber"))
    live.apply(rows.where("l_linenumber >= 3"), 1)
    live.apply(bag.negate(rows.where("l_linenumber = 2")), 2)
    return bag.expand(live.df()).selectExpr("l_returnflag", "n", "s", "m")


@query("live_distinct_chain", "SELECT count(DISTINCT user_id) AS users FROM events WHERE event_type <> 'purchase'")
def live_distinct_chain(t: Tables) -> DataFrame:
    """A maintained distinct whose changes feed a maintained count."""
    rows = bag.lift(t.df("events").select("event_id", "user_id", "event_type"))
    users = maintained.distinct(t.spark, _store(t, "users"), rows.where("event_id % 2 = 0").select("user_id", bag.M), ["user_id"])
    one = lambda df: df.withColumn("all", F.lit(1))
    total = maintained.Totals(t.spark, _store(t, "count"), one(users.df()), ["all"], users=("count", "user_id"))
    total.apply(one(users.apply(1, rows=rows.where("event_id % 2 = 1").select("user_id", bag.M))), 1)
    total.apply(one(users.apply(2, rows=bag.negate(rows.where("event_type = 'purchase'")).select("user_id", bag.M))), 2)
    return total.df().select("users")


@query("sync_truncate", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 901, 'LATE'")
def sync_truncate(t: Tables) -> DataFrame:
    """A transaction that empties the table and fills it anew, and one after it."""
    rows = t.df("nation").select("n_nationkey", "n_name", "n_regionkey")
    table = sources.VersionedTable(t.spark, _store(t, "sync"))
    table.publish(rows.where("n_regionkey < 2").select("n_nationkey", "n_name"))
    sync = cdc.Sync(table, ["n_nationkey"])
    feed = lambda df: df.withColumn("seq", F.lit(1)).withColumn("type", F.lit("insert"))
    sync.begin()
    sync.write(feed(rows.where("n_regionkey = 3").select("n_nationkey", "n_name")))
    sync.truncate()
    sync.write(feed(rows.where("n_regionkey = 2").select("n_nationkey", "n_name")))
    sync.commit()
    sync.begin()
    sync.write(feed(t.spark.range(1).select(F.lit(901).cast(rows.schema["n_nationkey"].dataType).alias("n_nationkey"), F.lit("LATE").alias("n_name"))))
    sync.commit()
    return table.read()


@query("tx_log_reload", "SELECT event_id, value FROM events WHERE event_id % 3 <> 1")
def tx_log_reload(t: Tables) -> DataFrame:
    """More changes than a reader wants to replay: it gets the whole state instead."""
    log = sources.TxLog(t.spark, _store(t, "log"), ["event_id"])
    rows = t.df("events").select("event_id", "value")
    log.append(rows.withColumn("type", F.lit("insert")))
    log.append(rows.where("event_id % 3 = 1").withColumn("type", F.lit("delete")))
    kind, state = log.pull_since(0, most=10)
    return state if kind == "reload" else state.limit(0).select("event_id", "value")
