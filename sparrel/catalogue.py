"""Models of the TPC-H-like tables, and the query set of the library over them, with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrel.functions.json import JsonInt
from sparrel.model import DateTime, ForeignKey, Integer, Json, Model, Real, Text
from sparrel.operators.expr import exists, not_exists, scalar
from sparrel.operators.query import Select, delete, insert, select, update
from sparrel.runtime import Database
from sparrel.schema import scaffold
from sparrel.sources.files import ParquetFolder
from sparrel.sources.scratch import scratch


class Region(Model):
    r_regionkey: Model.Col[int] = Integer(primary_key=True)
    r_name: Model.Col[str] = Text()


class Nation(Model):
    n_nationkey: Model.Col[int] = Integer(primary_key=True)
    n_name: Model.Col[str] = Text()
    n_regionkey: Model.FKCol[int] = ForeignKey(Region.r_regionkey)


class Customer(Model):
    c_custkey: Model.Col[int] = Integer(primary_key=True)
    c_name: Model.Col[str] = Text()
    c_nationkey: Model.FKCol[int] = ForeignKey(Nation.n_nationkey)
    c_acctbal: Model.Col[float] = Real()
    c_mktsegment: Model.Col[str] = Text()


class Supplier(Model):
    s_suppkey: Model.Col[int] = Integer(primary_key=True)
    s_name: Model.Col[str] = Text()
    s_nationkey: Model.FKCol[int] = ForeignKey(Nation.n_nationkey)
    s_acctbal: Model.Col[float] = Real()


class Part(Model):
    p_partkey: Model.Col[int] = Integer(primary_key=True)
    p_name: Model.Col[str] = Text()
    p_brand: Model.Col[str] = Text()
    p_type: Model.Col[str] = Text()
    p_size: Model.Col[int] = Integer()
    p_retailprice: Model.Col[float] = Real()


class Orders(Model):
    o_orderkey: Model.Col[int] = Integer(primary_key=True)
    o_custkey: Model.FKCol[int] = ForeignKey(Customer.c_custkey)
    o_orderstatus: Model.Col[str] = Text()
    o_totalprice: Model.Col[float] = Real()
    o_orderdate: Model.Col[datetime] = DateTime(zone=False)
    o_orderpriority: Model.Col[str] = Text()


class Lineitem(Model):
    l_orderkey: Model.FKCol[int] = ForeignKey(Orders.o_orderkey)
    l_partkey: Model.FKCol[int] = ForeignKey(Part.p_partkey)
    l_suppkey: Model.FKCol[int] = ForeignKey(Supplier.s_suppkey)
    l_linenumber: Model.Col[int] = Integer()
    l_quantity: Model.Col[float] = Real()
    l_extendedprice: Model.Col[float] = Real()
    l_discount: Model.Col[float] = Real()
    l_tax: Model.Col[float] = Real()
    l_returnflag: Model.Col[str] = Text()
    l_linestatus: Model.Col[str] = Text()
    l_shipdate: Model.Col[datetime] = DateTime(zone=False)


class Events(Model):
    event_id: Model.Col[int] = Integer(primary_key=True)
    ts: Model.Col[datetime] = DateTime(zone=False)
    user_id: Model.Col[int] = Integer()
    event_type: Model.Col[str] = Text()
    value: Model.Col[float] = Real()
    props: Model.Col[dict] = Json()


R, N, C, S, P, O, L, E = Region, Nation, Customer, Supplier, Part, Orders, Lineitem, Events  # noqa: E741
_OF_CUSTOMER = O.o_custkey.references(C.c_custkey)
_OF_ORDER = L.l_orderkey.references(O.o_orderkey)
_OF_NATION = C.c_nationkey.references(N.n_nationkey)


def _orders_over(price: float) -> Select:
    return select(O.o_custkey).where(O.o_totalprice.gt(price))


def _tops() -> Select:
    return select(O.o_totalprice.max()).where(O.o_custkey.eq_col(C.c_custkey))


def _line_numbers() -> Select:
    """Line numbers of all orders, null for those without."""
    return replace(select(O.o_orderkey).left_join(L, on=_OF_ORDER), fields=(L.l_linenumber,)).all()


#: name: (query, names of its columns or None, SQL)
SELECTS: dict[str, tuple[Select, tuple[str, ...] | None, str]] = {
    "scan_model": (select(N).all(), None, "select * from nation"),
    "scan_projection": (select(C.c_custkey, C.c_name, C.c_mktsegment).all(), None, "select c_custkey, c_name, c_mktsegment from customer"),
    "select_single_value": (select(O.o_orderkey).where(O.o_orderkey.lt(100)), None, "select o_orderkey from orders where o_orderkey < 100"),
    "select_distinct": (select(C.c_mktsegment).distinct().all(), None, "select distinct c_mktsegment from customer"),
    "select_distinct_multi": (select(L.l_returnflag, L.l_linestatus).distinct().all(), None, "select distinct l_returnflag, l_linestatus from lineitem"),
    "filter_eq": (select(C.c_custkey).where(C.c_mktsegment.eq("BUILDING")), None, "select c_custkey from customer where c_mktsegment = 'BUILDING'"),
    "filter_ne": (select(C.c_custkey).where(C.c_mktsegment.ne("BUILDING")), None, "select c_custkey from customer where c_mktsegment != 'BUILDING'"),
    "filter_is_null": (select(O.o_orderkey).left_join(L, on=_OF_ORDER).where(L.l_linenumber.is_null()), None, "select o_orderkey from orders left join lineitem on l_orderkey = o_orderkey where l_linenumber is null"),
    "filter_is_not_null": (select(C.c_custkey).where(C.c_name.is_not_null()), None, "select c_custkey from customer where c_name is not null"),
    "filter_in": (select(O.o_orderkey).where(O.o_orderstatus.in_("F", "P")), None, "select o_orderkey from orders where o_orderstatus in ('F', 'P')"),
    "filter_not_in": (select(O.o_orderkey).where(O.o_orderstatus.not_in("F", "P")), None, "select o_orderkey from orders where o_orderstatus not in ('F', 'P')"),
    "filter_ordered": (
        select(O.o_orderkey).where(O.o_totalprice.gt(1000.0), O.o_totalprice.lte(400000.0), O.o_orderkey.gte(10), O.o_orderkey.lt(5000)),
        None,
        "select o_orderkey from orders where o_totalprice > 1000 and o_totalprice <= 400000 and o_orderkey >= 10 and o_orderkey < 5000",
    ),
    "filter_between": (select(L.l_orderkey, L.l_linenumber).where(L.l_quantity.between(10.0, 20.0)), None, "select l_orderkey, l_linenumber from lineitem where l_quantity between 10 and 20"),
    "filter_like": (select(P.p_partkey, P.p_name).where(P.p_name.like("%widget")), None, "select p_partkey, p_name from part where p_name like '%widget'"),
    "filter_not_like": (select(P.p_partkey).where(P.p_type.not_like("STANDARD%")), None, "select p_partkey from part where p_type not like 'STANDARD%'"),
    "filter_boolean_algebra": (
        select(C.c_custkey).where((C.c_mktsegment.eq("BUILDING") | C.c_acctbal.gt(5000.0)) & ~C.c_nationkey.eq(3)),
        None,
        "select c_custkey from customer where (c_mktsegment = 'BUILDING' or c_acctbal > 5000) and not (c_nationkey = 3)",
    ),
    "filter_column_compare": (select(L.l_orderkey, L.l_linenumber).where(L.l_discount.gt_col(L.l_tax)), None, "select l_orderkey, l_linenumber from lineitem where l_discount > l_tax"),
    "filter_column_compare_all": (
        select(L.l_orderkey, L.l_linenumber).where(L.l_discount.gte_col(L.l_tax) & L.l_discount.ne_col(L.l_tax) | L.l_discount.lt_col(L.l_tax) & ~L.l_tax.eq_col(L.l_discount) & L.l_linenumber.lte_col(L.l_suppkey)),
        None,
        "select l_orderkey, l_linenumber from lineitem where l_discount >= l_tax and l_discount != l_tax or l_discount < l_tax and not l_tax = l_discount and l_linenumber <= l_suppkey",
    ),
    "join_inner": (select(O.o_orderkey, C.c_name).join(C, on=_OF_CUSTOMER).all(), None, "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey"),
    "join_left": (select(O.o_orderkey, L.l_linenumber).left_join(L, on=_OF_ORDER).all(), None, "select o_orderkey, l_linenumber from orders left join lineitem on l_orderkey = o_orderkey"),
    "join_chain": (
        select(S.s_name, N.n_name, R.r_name).join(N, on=S.s_nationkey.references(N.n_nationkey)).join(R, on=N.n_regionkey.references(R.r_regionkey)).all(),
        None,
        "select s_name, n_name, r_name from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey",
    ),
    "join_filter_unprojected": (select(C.c_name).join(O, on=_OF_CUSTOMER).where(O.o_totalprice.gt(450000.0)), None, "select c_name from customer join orders on o_custkey = c_custkey where o_totalprice > 450000"),
    "agg_count_all": (select(L.count_all()).all(), ("n",), "select count(*) as n from lineitem"),
    "agg_count_column": (select(O.o_orderkey.count()).all(), ("n",), "select count(o_orderkey) as n from orders"),
    "agg_sum_int": (select(L.l_linenumber.sum()).all(), ("s",), "select cast(sum(l_linenumber) as bigint) as s from lineitem"),
    "agg_sum_real": (select(L.l_extendedprice.sum()).all(), ("s~2",), "select round(sum(l_extendedprice), 2) as s from lineitem"),
    "agg_avg": (select(L.l_quantity.avg()).all(), ("a~6",), "select round(avg(l_quantity), 6) as a from lineitem"),
    "agg_min_max": (select(O.o_orderdate.min(), O.o_orderdate.max()).all(), ("lo", "hi"), "select min(o_orderdate) as lo, max(o_orderdate) as hi from orders"),
    "agg_empty_is_null": (
        select(O.o_orderkey.count(), O.o_totalprice.sum(), O.o_orderkey.max()).where(O.o_orderkey.lt(0)),
        ("n", "s~2", "m"),
        "select count(o_orderkey) as n, round(sum(o_totalprice), 2) as s, max(o_orderkey) as m from orders where o_orderkey < 0",
    ),
    "group_by": (select(C.c_mktsegment, C.c_custkey.count()).all().group_by(C.c_mktsegment), ("c_mktsegment", "n"), "select c_mktsegment, count(c_custkey) as n from customer group by c_mktsegment"),
    "group_by_multi": (
        select(L.l_returnflag, L.l_linestatus, L.l_quantity.sum()).all().group_by(L.l_returnflag, L.l_linestatus),
        ("l_returnflag", "l_linestatus", "q~2"),
        "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as q from lineitem group by l_returnflag, l_linestatus",
    ),
    "group_by_no_aggregate": (select(L.l_returnflag).all().group_by(L.l_returnflag), None, "select l_returnflag from lineitem group by l_returnflag"),
    "group_by_join": (
        select(N.n_name, C.c_custkey.count()).join(C, on=_OF_NATION).all().group_by(N.n_name),
        ("n_name", "n"),
        "select n_name, count(c_custkey) as n from nation join customer on c_nationkey = n_nationkey group by n_name",
    ),
    "having_aggregate": (
        select(O.o_custkey, O.o_orderkey.count()).all().group_by(O.o_custkey).having(O.o_orderkey.count().gt(12)),
        ("o_custkey", "n"),
        "select o_custkey, count(o_orderkey) as n from orders group by o_custkey having count(o_orderkey) > 12",
    ),
    "having_hidden_aggregate": (select(O.o_custkey).all().group_by(O.o_custkey).having(O.o_totalprice.sum().gt(3000000.0)), None, "select o_custkey from orders group by o_custkey having sum(o_totalprice) > 3000000"),
    "having_grouped_column": (
        select(C.c_mktsegment, C.c_custkey.count()).all().group_by(C.c_mktsegment).having(C.c_mktsegment.ne("BUILDING")),
        ("c_mktsegment", "n"),
        "select c_mktsegment, count(c_custkey) as n from customer group by c_mktsegment having c_mktsegment != 'BUILDING'",
    ),
    "order_by_aggregate_limit": (
        select(N.n_name, C.c_custkey.count()).join(C, on=_OF_NATION).all().group_by(N.n_name).order_by(C.c_custkey.count().desc(), N.n_name.asc()).limit(5),
        ("n_name", "n"),
        "select n_name, count(c_custkey) as n from nation join customer on c_nationkey = n_nationkey group by n_name order by count(c_custkey) desc, n_name asc limit 5",
    ),
    "top_k": (
        select(O.o_orderkey, O.o_totalprice).all().order_by(O.o_totalprice.desc(), O.o_orderkey.asc()).limit(10),
        None,
        "select o_orderkey, o_totalprice from orders order by o_totalprice desc nulls last, o_orderkey asc nulls first limit 10",
    ),
    "limit_offset": (select(O.o_orderkey).all().order_by(O.o_orderkey.asc()).limit(20).offset(30), None, "select o_orderkey from orders order by o_orderkey asc nulls first limit 20 offset 30"),
    "offset_only": (select(N.n_name).all().order_by(N.n_nationkey.asc()).offset(20), None, "select n_name from nation order by n_nationkey asc nulls first offset 20"),
    "in_subquery": (select(C.c_custkey).where(C.c_custkey.in_subquery(_orders_over(450000.0))), None, "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 450000)"),
    "not_in_subquery": (select(C.c_custkey).where(C.c_custkey.not_in_subquery(_orders_over(450000.0))), None, "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 450000)"),
    "not_in_subquery_with_null": (
        select(N.n_nationkey).where(N.n_nationkey.not_in_subquery(_line_numbers())),
        None,
        "select n_nationkey from nation where n_nationkey not in (select l_linenumber from orders left join lineitem on l_orderkey = o_orderkey)",
    ),
    "exists_correlated": (
        select(C.c_custkey).where(exists(select(O.o_orderkey).where(O.o_custkey.eq_col(C.c_custkey), O.o_totalprice.gt(450000.0)))),
        None,
        "select c_custkey from customer where exists (select o_orderkey from orders where o_custkey = c_custkey and o_totalprice > 450000)",
    ),
    "not_exists_correlated": (select(O.o_orderkey).where(not_exists(select(L.l_linenumber).where(L.l_orderkey.eq_col(O.o_orderkey)))), None, "select o_orderkey from orders where not exists (select l_linenumber from lineitem where l_orderkey = o_orderkey)"),
    "exists_under_or": (
        select(C.c_custkey).where(C.c_mktsegment.eq("BUILDING") | exists(select(O.o_orderkey).where(O.o_custkey.eq_col(C.c_custkey), O.o_totalprice.gt(490000.0)))),
        None,
        "select c_custkey from customer where c_mktsegment = 'BUILDING' or exists (select o_orderkey from orders where o_custkey = c_custkey and o_totalprice > 490000)",
    ),
    "scalar_projection": (select(C.c_custkey, scalar(_tops())).all(), ("c_custkey", "top"), "select c_custkey, (select max(o_totalprice) from orders where o_custkey = c_custkey) as top from customer"),
    "scalar_no_match_is_null": (
        select(R.r_regionkey, scalar(select(N.n_nationkey.max()).where(N.n_regionkey.eq_col(R.r_regionkey), N.n_nationkey.gt(22)))).all(),
        ("r_regionkey", "m"),
        "select r_regionkey, (select max(n_nationkey) from nation where n_regionkey = r_regionkey and n_nationkey > 22) as m from region",
    ),
    "scalar_operand": (select(O.o_orderkey).where(O.o_totalprice.gt_col(scalar(select(O.o_totalprice.avg()).all()))), None, "select o_orderkey from orders where o_totalprice > (select avg(o_totalprice) from orders)"),
    "correlated_range": (
        select(N.n_nationkey, scalar(select(R.r_regionkey.count()).where(R.r_regionkey.lt_col(N.n_nationkey)))).all(),
        ("n_nationkey", "below"),
        "select n_nationkey, (select count(r_regionkey) from region where r_regionkey < n_nationkey) as below from nation",
    ),
    "nested_two_level": (
        select(N.n_nationkey).where(exists(select(C.c_custkey).where(C.c_mktsegment.eq("BUILDING"), exists(select(O.o_orderkey).where(O.o_custkey.eq_col(C.c_custkey), O.o_orderkey.gt_col(N.n_nationkey), O.o_orderkey.lt(20)))))),
        None,
        "select n_nationkey from nation where exists (select c_custkey from customer where c_mktsegment = 'BUILDING' and exists (select o_orderkey from orders where o_custkey = c_custkey and o_orderkey > n_nationkey and o_orderkey < 20))",
    ),
    "nested_two_level_not_in": (
        select(N.n_nationkey).where(N.n_nationkey.not_in_subquery(select(C.c_nationkey).where(C.c_acctbal.gt(9000.0), exists(select(O.o_orderkey).where(O.o_custkey.eq_col(C.c_custkey), O.o_orderkey.gt_col(N.n_nationkey), O.o_orderkey.lt(2000)))))),
        None,
        "select n_nationkey from nation where n_nationkey not in (select c_nationkey from customer where c_acctbal > 9000 and exists (select o_orderkey from orders where o_custkey = c_custkey and o_orderkey > n_nationkey and o_orderkey < 2000))",
    ),
    "nested_two_level_scalar": (
        select(N.n_nationkey, scalar(select(C.c_custkey.count()).where(C.c_nationkey.eq_col(N.n_nationkey), exists(select(O.o_orderkey).where(O.o_custkey.eq_col(C.c_custkey), O.o_orderkey.lt_col(N.n_nationkey)))))).all(),
        ("n_nationkey", "n"),
        "select n_nationkey, (select count(c_custkey) from customer where c_nationkey = n_nationkey and exists (select o_orderkey from orders where o_custkey = c_custkey and o_orderkey < n_nationkey)) as n from nation",
    ),
    "nested_limit": (
        select(N.n_nationkey).where(exists(select(C.c_custkey).where(C.c_nationkey.eq_col(N.n_nationkey), C.c_custkey.in_subquery(select(O.o_custkey).where(O.o_orderkey.gt_col(N.n_nationkey)).order_by(O.o_orderkey.asc()).limit(40).offset(5))))),
        None,
        "select n_nationkey from nation where exists (select 1 from customer where c_nationkey = n_nationkey and c_custkey in"
        " (select o_custkey from (select o_custkey, n2.n_nationkey as k, row_number() over (partition by n2.n_nationkey order by o_orderkey) as place from orders, nation n2 where o_orderkey > n2.n_nationkey) where k = nation.n_nationkey and place between 6 and 45))",
    ),
    "grouped_limit_scalar": (
        select(C.c_custkey, scalar(select(O.o_orderstatus).where(O.o_custkey.eq_col(C.c_custkey)).group_by(O.o_orderstatus).order_by(O.o_orderkey.count().desc(), O.o_orderstatus.asc()).limit(1))).all(),
        ("c_custkey", "top"),
        "select c_custkey, top from customer left join (select o_custkey, o_orderstatus as top, row_number() over (partition by o_custkey order by count(o_orderkey) desc, o_orderstatus) as place from orders group by o_custkey, o_orderstatus) on o_custkey = c_custkey and place = 1",
    ),
    "correlated_limit_offset": (
        select(C.c_custkey, scalar(select(O.o_totalprice).where(O.o_custkey.eq_col(C.c_custkey)).order_by(O.o_totalprice.desc(), O.o_orderkey.asc()).limit(1).offset(1))).all(),
        ("c_custkey", "second"),
        "select c_custkey, second from customer left join (select o_custkey, o_totalprice as second, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as place from orders) on o_custkey = c_custkey and place = 2",
    ),
    "nested_three_level": (
        select(R.r_regionkey).where(exists(select(N.n_nationkey).where(N.n_regionkey.eq_col(R.r_regionkey), exists(select(C.c_custkey).where(C.c_nationkey.eq_col(N.n_nationkey), exists(select(O.o_orderkey).where(O.o_custkey.eq_col(C.c_custkey), O.o_orderkey.lt(400), O.o_orderkey.gt_col(R.r_regionkey)))))))),
        None,
        "select r_regionkey from region where exists (select 1 from nation where n_regionkey = r_regionkey and exists (select 1 from customer where c_nationkey = n_nationkey and exists (select 1 from orders where o_custkey = c_custkey and o_orderkey < 400 and o_orderkey > r_regionkey)))",
    ),
    "distinct_ordered": (select(L.l_returnflag, L.l_linestatus).distinct().all().order_by(L.l_returnflag.asc(), L.l_linestatus.desc()).limit(2), None, "select distinct l_returnflag, l_linestatus from lineitem order by l_returnflag asc nulls first, l_linestatus desc nulls last limit 2"),
    "group_by_hidden_order": (select(O.o_orderstatus).all().group_by(O.o_orderstatus).order_by(O.o_totalprice.sum().desc()).limit(2), None, "select o_orderstatus from orders group by o_orderstatus order by sum(o_totalprice) desc limit 2"),
    "subquery_having": (
        select(O.o_custkey, O.o_orderkey.count()).all().group_by(O.o_custkey).having(exists(select(R.r_regionkey).where(R.r_name.eq("ASIA")))),
        ("o_custkey", "n"),
        "select o_custkey, count(o_orderkey) as n from orders group by o_custkey having exists (select r_regionkey from region where r_name = 'ASIA')",
    ),
    "subquery_with_join_group": (
        select(N.n_name).where(N.n_nationkey.in_subquery(select(C.c_nationkey).join(O, on=_OF_CUSTOMER).all().group_by(C.c_nationkey).having(O.o_orderkey.count().gt(600)))),
        None,
        "select n_name from nation where n_nationkey in (select c_nationkey from customer join orders on o_custkey = c_custkey group by c_nationkey having count(o_orderkey) > 600)",
    ),
    "json_extract_int": (
        select(E.event_id, JsonInt(E.props, "$.k")).where(JsonInt(E.props, "$.k").gt(90)),
        ("event_id", "k"),
        "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events where cast(json_extract_string(props, '$.k') as bigint) > 90",
    ),
    "flagship": (
        select(C.c_mktsegment, O.o_orderkey.count(), O.o_totalprice.sum()).join(O, on=_OF_CUSTOMER).where(O.o_orderdate.gte(datetime(1996, 1, 1))).group_by(C.c_mktsegment).having(O.o_orderkey.count().gt(10)).order_by(C.c_mktsegment.asc()),
        ("c_mktsegment", "n", "revenue~2"),
        "select c_mktsegment, count(o_orderkey) as n, round(sum(o_totalprice), 2) as revenue from customer join orders on o_custkey = c_custkey where o_orderdate >= timestamp '1996-01-01' group by c_mktsegment having count(o_orderkey) > 10 order by c_mktsegment",
    ),
}


def _select(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        query, names, _ = SELECTS[name]
        df = query.to_df(ParquetFolder(spark, sf_dir))
        if names is None:
            return df
        # a name with ~n is rounded to n places
        cut = [n.split("~") for n in names]
        df = df.toDF(*(n[0] for n in cut))
        return df.select(*(F.round(n[0], int(n[1])).alias(n[0]) if n[1:] else F.col(n[0]) for n in cut))

    return run


def _database(spark: SparkSession, sf_dir: str, model: type[Model]) -> Database:
    """A scratch store with a copy of one table and of those that it refers to."""
    db = Database.initialize(spark, scratch(spark, "store"))
    models = _referred(model)
    db.migrate({"0001": scaffold(models)})
    with db.transaction() as tx:
        for m in reversed(models):
            tx.append(m, ParquetFolder(spark, sf_dir).table(m))
    return db


def _referred(model: type[Model]) -> list[type[Model]]:
    """The model, then those that it refers to."""
    models, todo = [], [model]
    while todo:
        m = todo.pop()
        if m not in models:
            models.append(m)
            todo += [a.target.model for a in m.columns.values() if a.target is not None]
    return models


def insert_returning_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _database(spark, sf_dir, Region)
    with db.transaction() as tx:
        assert tx.execute(insert(Region(r_regionkey=5, r_name="OCEANIA")).returning(Region.r_name)) == "OCEANIA"
    tx = db.transaction().__enter__()
    return tx.to_df(select(Region).all())


def update_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _database(spark, sf_dir, Customer)
    with db.transaction() as tx:
        tx.execute(update(C).set(C.c_mktsegment.to("DELINQUENT")).where(C.c_acctbal.lt(0.0)))
    tx = db.transaction().__enter__()
    return tx.to_df(select(C.c_custkey, C.c_mktsegment).all())


def update_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _database(spark, sf_dir, Customer)
    with db.transaction() as tx:
        return tx.execute_df(update(C).set(C.c_acctbal.to(0.0)).where(C.c_acctbal.lt(100.0)).returning(C.c_custkey))


def delete_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _database(spark, sf_dir, Orders)
    with db.transaction() as tx:
        tx.execute(delete(O).where(O.o_orderstatus.eq("F")))
    tx = db.transaction().__enter__()
    return tx.to_df(select(O.o_orderkey).all())


from sparrel import verbs as _verbs  # noqa: E402  (its queries use the models above)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{name: _select(name) for name in SELECTS},
    "insert_returning_state": insert_returning_state,
    "update_state": update_state,
    "update_returning": update_returning,
    "delete_state": delete_state,
    **_verbs.QUERIES,
}

SQL: dict[str, str] = {
    **{name: sql for name, (_, _, sql) in SELECTS.items()},
    "insert_returning_state": "select * from region union all select 5 as r_regionkey, 'OCEANIA' as r_name",
    "update_state": "select c_custkey, case when c_acctbal < 0 then 'DELINQUENT' else c_mktsegment end as c_mktsegment from customer",
    "update_returning": "select c_custkey from customer where c_acctbal < 100",
    "delete_state": "select o_orderkey from orders where not coalesce(o_orderstatus = 'F', false)",
    **_verbs.SQL,
}
