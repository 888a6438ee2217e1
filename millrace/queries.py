"""The queries that the driver runs: one or more for each operator, and DuckDB's SQL for the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators as op
from .engine import Engine
from .plans.parser import parse
from .plans.syntax import Aggregate
from .sources.files import shared_folder
from .types import fields_of

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: Queries in the dialect, and DuckDB's SQL where it differs from the text (aggregates need their names).
SQL: dict[str, tuple[str, str | None]] = {
    "scan_project": ("select r_regionkey, r_name from region", None),
    "project_subset": ("select c_mktsegment from customer", None),
    "filter_eq_int": ("select n_nationkey, n_name from nation where n_regionkey = 1", None),
    "filter_eq_str": ("select c_custkey, c_name from customer where c_mktsegment = 'BUILDING'", None),
    "filter_constant_left": ("select p_partkey from part where 10 > p_size", None),
    "filter_ne": ("select p_partkey, p_size from part where p_size <> 10", None),
    "filter_ne_bang": ("select p_partkey, p_size from part where p_size != 10", None),
    "filter_lt": ("select l_orderkey, l_linenumber from lineitem where l_linenumber < 3", None),
    "filter_le": ("select l_orderkey, l_linenumber from lineitem where l_linenumber <= 3", None),
    "filter_gt": ("select p_partkey, p_size from part where p_size > 40", None),
    "filter_ge": ("select p_partkey, p_size from part where p_size >= 40", None),
    "filter_conj": ("select l_orderkey, l_partkey, l_suppkey from lineitem where l_linenumber = 1 and l_partkey < 500 and l_returnflag = 'R'", None),
    "filter_field_field": ("select l_orderkey, l_partkey, l_suppkey from lineitem where l_partkey < l_suppkey", None),
    "filter_const_const": ("select r_name from region where 1 = 1", None),
    "filter_const_false": ("select r_name from region where 1 = 2", None),
    "filter_type_mismatch_eq": ("select n_name from nation where n_nationkey = 'abc'", "select n_name from nation where false"),
    "filter_type_mismatch_ne": ("select n_name from nation where n_nationkey <> 'abc'", "select n_name from nation"),
    "filter_type_mismatch_range": ("select n_name from nation where n_nationkey < 'abc'", "select n_name from nation where false"),
    "filter_date_range": ("select o_orderkey, o_orderdate from orders where o_orderdate >= 1995-06-01 and o_orderdate < 1996-01-01", "select o_orderkey, o_orderdate from orders where o_orderdate >= TIMESTAMP '1995-06-01' and o_orderdate < TIMESTAMP '1996-01-01'"),
    "filter_date_eq": ("select o_orderkey from orders where o_orderdate = 1995-06-01", "select o_orderkey from orders where o_orderdate = TIMESTAMP '1995-06-01'"),
    "filter_str_order": ("select p_partkey, p_name from part where p_name < 'm'", None),
    "product": ("select r_name, n_name from region, nation", None),
    "join_equi": ("select c_custkey, n_name from customer, nation where c_nationkey = n_nationkey", None),
    "join_equi_3way": ("select c_custkey, n_name, r_name from customer, nation, region where c_nationkey = n_nationkey and n_regionkey = r_regionkey", None),
    "join_equi_4way": ("select o_orderkey, c_name, n_name, r_name from orders, customer, nation, region where o_custkey = c_custkey and c_nationkey = n_nationkey and n_regionkey = r_regionkey and r_name = 'ASIA'", None),
    "join_large": ("select o_orderkey, l_linenumber from orders, lineitem where o_orderkey = l_orderkey and l_quantity > 45", None),
    "join_theta": ("select n_name, r_name from nation, region where n_regionkey < r_regionkey", None),
    "join_self": ("select n_name from nation, nation", "select a.n_name from nation a, nation b"),
    "group_max": ("select l_linenumber, max(l_partkey) from lineitem group by l_linenumber", 'select l_linenumber, max(l_partkey) as "maxOfl_partkey" from lineitem group by l_linenumber'),
    "group_min": ("select l_linenumber, min(l_suppkey) from lineitem group by l_linenumber", 'select l_linenumber, min(l_suppkey) as "minOfl_suppkey" from lineitem group by l_linenumber'),
    "group_min_max_str": ("select c_mktsegment, min(c_name), max(c_name) from customer group by c_mktsegment", 'select c_mktsegment, min(c_name) as "minOfc_name", max(c_name) as "maxOfc_name" from customer group by c_mktsegment'),
    "group_count": ("select c_nationkey, count(c_custkey) from customer group by c_nationkey", 'select c_nationkey, count(*) as "countOfc_custkey" from customer group by c_nationkey'),
    "group_sum": ("select l_returnflag, sum(l_partkey) from lineitem group by l_returnflag", 'select l_returnflag, cast(sum(l_partkey) as bigint) as "sumOfl_partkey" from lineitem group by l_returnflag'),
    "group_avg": ("select p_brand, avg(p_size) from part group by p_brand", 'select p_brand, cast(cast(sum(p_size) as bigint) // count(*) as bigint) as "avgOfp_size" from part group by p_brand'),
    "group_multi_key": ("select l_returnflag, l_linestatus, count(l_orderkey), max(l_linenumber) from lineitem group by l_returnflag, l_linestatus", 'select l_returnflag, l_linestatus, count(*) as "countOfl_orderkey", max(l_linenumber) as "maxOfl_linenumber" from lineitem group by l_returnflag, l_linestatus'),
    "group_no_agg": ("select n_regionkey from nation group by n_regionkey", "select distinct n_regionkey from nation"),
    "group_key_subset": ("select l_returnflag from lineitem group by l_returnflag, l_linestatus", "select l_returnflag from (select distinct l_returnflag, l_linestatus from lineitem)"),
    "group_join": ("select n_name, count(o_orderkey), sum(o_custkey) from orders, customer, nation where o_custkey = c_custkey and c_nationkey = n_nationkey group by n_name", 'select n_name, count(*) as "countOfo_orderkey", cast(sum(o_custkey) as bigint) as "sumOfo_custkey" from orders, customer, nation where o_custkey = c_custkey and c_nationkey = n_nationkey group by n_name'),
    "having_agg": ("select c_nationkey, count(c_custkey) from customer group by c_nationkey having count(c_custkey) > 50", 'select c_nationkey, count(*) as "countOfc_custkey" from customer group by c_nationkey having count(*) > 50'),
    "having_agg_eq": ("select c_nationkey, count(c_custkey) from customer group by c_nationkey having count(c_custkey) = 60", 'select c_nationkey, count(*) as "countOfc_custkey" from customer group by c_nationkey having count(*) = 60'),
    "having_hidden": ("select c_nationkey from customer group by c_nationkey having max(c_custkey) > 1400", "select c_nationkey from customer group by c_nationkey having max(c_custkey) > 1400"),
    "having_group_field": ("select n_regionkey, count(n_name) from nation group by n_regionkey having n_regionkey >= 2", 'select n_regionkey, count(*) as "countOfn_name" from nation group by n_regionkey having n_regionkey >= 2'),
    "global_agg_sql": ("select max(o_custkey), min(o_custkey), count(o_orderkey), sum(o_custkey), avg(o_custkey) from orders", 'select max(o_custkey) as "maxOfo_custkey", min(o_custkey) as "minOfo_custkey", count(*) as "countOfo_orderkey", cast(sum(o_custkey) as bigint) as "sumOfo_custkey", cast(cast(sum(o_custkey) as bigint) // count(*) as bigint) as "avgOfo_custkey" from orders'),
    "order_asc": ("select n_name, n_regionkey from nation where n_regionkey >= 2 order by n_name", "select n_name, n_regionkey from nation where n_regionkey >= 2"),
    "order_desc": ("select p_partkey, p_size from part order by p_size desc, p_partkey", "select p_partkey, p_size from part"),
    "order_by_agg": ("select c_nationkey, count(c_custkey) from customer group by c_nationkey order by count(c_custkey) desc, c_nationkey", 'select c_nationkey, count(*) as "countOfc_custkey" from customer group by c_nationkey'),
    "flagship": ("select n_name, count(c_custkey), max(c_custkey) from customer, nation where c_nationkey = n_nationkey group by n_name having count(c_custkey) > 1 order by n_name", 'select n_name, count(*) as "countOfc_custkey", max(c_custkey) as "maxOfc_custkey" from customer, nation where c_nationkey = n_nationkey group by n_name having count(*) > 1'),
}


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def engine_over(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine with the Parquet tables of a folder attached."""
    engine = Engine(spark, scratch(spark))
    for name in TABLES:
        engine.attach(name, f"{sf_dir}/{name}.parquet")
    return engine


_shared: dict[tuple[str, str], Engine] = {}


def reader(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine over a folder that no query changes, one a session and folder."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _shared:
        _shared[key] = engine_over(spark, sf_dir)
    return _shared[key]


def copied(engine: Engine, source: str, name: str) -> None:
    """A table of the engine with the rows of another."""
    rows = engine.table(source)
    engine.create_table(name, fields_of(rows.schema))
    engine.insert_rows(name, rows)


def sql_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: reader(spark, sf_dir).query(text)


def global_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reader(spark, sf_dir).table("lineitem")
    return op.group_by(rows, [], [Aggregate("max", "l_partkey"), Aggregate("count", "l_orderkey"), Aggregate("sum", "l_linenumber")])


def view_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_over(spark, sf_dir)
    engine.execute("create view big_parts as select p_partkey, p_size from part where p_size > 25")
    return engine.query("select p_partkey, p_size from big_parts")


def view_on_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_over(spark, sf_dir)
    engine.execute("create view asia as select n_nationkey, n_name from nation, region where n_regionkey = r_regionkey and r_name = 'ASIA'")
    engine.execute("create view asians as select c_custkey, n_name from customer, asia where c_nationkey = n_nationkey")
    return engine.query("select n_name, count(c_custkey) from asians group by n_name")


def view_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_over(spark, sf_dir)
    engine.execute("create view sizes as select p_brand, max(p_size) from part group by p_brand")
    return engine.query("select p_brand, maxOfp_size from sizes where max(p_size) >= 50")


def materialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.materialize(reader(spark, sf_dir).query("select o_orderkey, o_orderstatus from orders where o_custkey < 100"))


def _index(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = engine_over(spark, sf_dir)
        copied(engine, "customer", "clients")
        engine.execute("create index by_nation on clients (c_nationkey)")
        return engine.index_lookup("by_nation", 7, kind).select("c_custkey", "c_name", "c_nationkey")

    return run


def index_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.index_select(reader(spark, sf_dir).table("orders"), "o_custkey", 42).select("o_orderkey", "o_custkey")


def index_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = reader(spark, sf_dir)
    customer = engine.table("customer").select("c_custkey", "c_name")
    orders = engine.table("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return op.index_join(orders, customer, "c_custkey")


def dml_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_over(spark, sf_dir)
    copied(engine, "region", "zones")
    engine.execute("insert into zones (r_regionkey, r_name) values (5, 'ATLANTIS')")
    engine.execute("insert into zones (r_regionkey) values (6)")
    return engine.query("select r_regionkey, r_name from zones")


def dml_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_over(spark, sf_dir)
    copied(engine, "nation", "lands")
    engine.execute("update lands set n_name = 'FAR' where n_regionkey >= 3 and n_nationkey < 20")
    engine.execute("update lands set n_regionkey = n_nationkey where n_regionkey = 0")
    return engine.query("select n_nationkey, n_name, n_regionkey from lands")


def dml_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_over(spark, sf_dir)
    copied(engine, "nation", "lands")
    engine.execute("delete from lands where n_regionkey = 2")
    return engine.query("select n_nationkey, n_name from lands")


def rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_over(spark, sf_dir)
    copied(engine, "region", "zones")
    tx = engine.begin()
    engine.execute("delete from zones where r_regionkey < 3", tx)
    tx.rollback()
    tx = engine.begin()
    engine.execute("update zones set r_name = 'X' where r_regionkey = 4", tx)
    tx.commit()
    return engine.query("select r_regionkey, r_name from zones")


def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader(spark, sf_dir).query("select table_name, slot_size from table_catalog")


def catalog_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader(spark, sf_dir).query("select table_name, field_name, type, length, offset from field_catalog")


def ordered(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query of the dialect with ORDER BY, and the place of each row in its order."""
    return lambda spark, sf_dir: op.positions(reader(spark, sf_dir).query(SQL[name][0]))


def typed(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine with a table of all types that the dialect declares, a view and an index."""
    engine = engine_over(spark, sf_dir)
    engine.execute("create table flags (id int, name varchar(12), ok bool, day date)")
    for row in ("1, 'one', true, 2025-01-01", "2, 'two', false, 2025-01-02", "3, 'three', true, 2025-01-03", "4, '', false, 2025-01-03"):
        engine.execute(f"insert into flags (id, name, ok, day) values ({row})")
    engine.execute("create view good as select id, name from flags where ok = true")
    engine.execute("create index by_day on flags (day)")
    return engine


def typed_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: typed(spark, sf_dir).query(text)


def index_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups by an index on files that are attached; the second one reads the layout that the first has made."""
    engine = engine_over(spark, sf_dir)
    engine.execute("create index by_customer on orders (o_custkey)")
    return engine.index_lookup("by_customer", 42).select("o_orderkey").union(engine.index_lookup("by_customer", 43).select("o_orderkey"))


def positioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that a scan reads again by their saved ids."""
    rows = op.row_ids(reader(spark, sf_dir).table("region"))
    held = rows.where("r_regionkey >= 3").collect()
    found = [op.move_to(rows, r["_rid"]).select("r_regionkey", "r_name") for r in held]
    return found[0].union(found[1])


def cost_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that an equality, a join by fields and a product are estimated to give."""
    engine = reader(spark, sf_dir)
    texts = ("select n_name from nation where n_regionkey = 1", "select n_name from nation, region where n_regionkey = r_regionkey", "select n_name from nation, region")
    return spark.createDataFrame([tuple(engine.explain_cost(t)["records"] for t in texts)], "equality long, joined long, product long")


def sub_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of a predicate that each table can tell, applied before the product, and the rest after it."""
    engine = reader(spark, sf_dir)
    where = parse("select n_name from nation, region where n_regionkey = r_regionkey and n_nationkey < 10 and r_name = 'ASIA'").where
    left, right = engine.table("nation"), engine.table("region")
    names, others = set(left.columns), set(right.columns)
    product = op.cross_join(op.select(left, where.sub_predicate(names)), op.select(right, where.sub_predicate(others)))
    return op.select(product, where.join_predicate(names, others)).select("n_nationkey", "n_name", "r_name")


def stats_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reader(spark, sf_dir).statistics("nation")
    return spark.createDataFrame([(found.records, found.distinct["n_name"], found.distinct["n_regionkey"])], "records long, names long, regions long")


#: Queries through the API, and DuckDB's SQL; None where the result has no form there.
API: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "global_agg": (global_agg, 'select max(l_partkey) as "maxOfl_partkey", count(*) as "countOfl_orderkey", cast(sum(l_linenumber) as bigint) as "sumOfl_linenumber" from lineitem'),
    "view_simple": (view_simple, "select p_partkey, p_size from part where p_size > 25"),
    "view_on_view": (view_on_view, "select n_name, count(*) as \"countOfc_custkey\" from customer, nation, region where c_nationkey = n_nationkey and n_regionkey = r_regionkey and r_name = 'ASIA' group by n_name"),
    "view_filtered": (view_filtered, "select p_brand, max(p_size) as maxofp_size from part group by p_brand having max(p_size) >= 50"),
    "materialize": (materialize, "select o_orderkey, o_orderstatus from orders where o_custkey < 100"),
    "index_select": (index_select, "select o_orderkey, o_custkey from orders where o_custkey = 42"),
    "index_hash": (_index("hash"), "select c_custkey, c_name, c_nationkey from customer where c_nationkey = 7"),
    "index_btree": (_index("btree"), "select c_custkey, c_name, c_nationkey from customer where c_nationkey = 7"),
    "index_join": (index_join, "select o_orderkey, o_custkey as c_custkey, c_name from orders, customer where o_custkey = c_custkey"),
    "dml_insert": (dml_insert, "select r_regionkey, r_name from region union all select 5, 'ATLANTIS' union all select 6, ''"),
    "dml_update": (dml_update, "select n_nationkey, case when n_regionkey >= 3 and n_nationkey < 20 then 'FAR' else n_name end as n_name, case when n_regionkey = 0 then n_nationkey else n_regionkey end as n_regionkey from nation"),
    "dml_delete": (dml_delete, "select n_nationkey, n_name from nation where n_regionkey <> 2"),
    "tx_rollback_commit": (rollback, "select r_regionkey, case when r_regionkey = 4 then 'X' else r_name end as r_name from region"),
    "order_asc_position": (ordered("order_asc"), "select n_name, n_regionkey, row_number() over (order by n_name) - 1 as position from nation where n_regionkey >= 2"),
    "order_desc_position": (ordered("order_desc"), "select p_partkey, p_size, row_number() over (order by p_size desc, p_partkey) - 1 as position from part"),
    "order_by_agg_position": (ordered("order_by_agg"), 'select c_nationkey, count(*) as "countOfc_custkey", row_number() over (order by count(*) desc, c_nationkey) - 1 as position from customer group by c_nationkey'),
    "create_table_bool": (typed_query("select id, name, day from flags where ok = true"), "select * from (values (1::int, 'one', TIMESTAMP '2025-01-01'), (3, 'three', TIMESTAMP '2025-01-03')) t(id, name, day)"),
    "create_table_date": (typed_query("select id, ok from flags where day >= 2025-01-02 and name <> ''"), "select * from (values (2::int, false), (3, true)) t(id, ok)"),
    "catalog_typed_fields": (typed_query("select field_name, type, length from field_catalog where table_name = 'flags'"), "select * from (values ('id', 'int', 0::int), ('name', 'varchar', 12), ('ok', 'bool', 0), ('day', 'date', 0)) t(field_name, type, length)"),
    "catalog_typed_tables": (typed_query("select table_name from table_catalog where table_name >= 'e' and table_name < 'm'"), "select * from (values ('events'), ('flags'), ('lineitem')) t(table_name)"),
    "catalog_views": (typed_query("select view_name, view_definition from view_catalog"), "select 'good' as view_name, 'select id, name from flags where ok = true' as view_definition"),
    "catalog_indexes": (typed_query("select index_name, table_name, field_name from index_catalog"), "select 'by_day' as index_name, 'flags' as table_name, 'day' as field_name"),
    "index_attached": (index_attached, "select o_orderkey from orders where o_custkey in (42, 43)"),
    "positioned_read": (positioned, "select r_regionkey, r_name from region where r_regionkey >= 3"),
    "cost_estimates": (cost_estimates, "select (select count(*) // count(distinct n_regionkey) from nation) as equality, (select count(*) from nation) as joined, (select count(*) from nation, region) as product"),
    "sub_predicates": (sub_predicates, "select n_nationkey, n_name, r_name from nation, region where n_regionkey = r_regionkey and n_nationkey < 10 and r_name = 'ASIA'"),
    "catalog_tables": (catalog_tables, None),
    "catalog_fields": (catalog_fields, None),
    "stats_distinct": (stats_distinct, "select count(*) as records, count(distinct n_name) as names, count(distinct n_regionkey) as regions from nation"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: sql_query(text) for name, (text, _) in SQL.items()} | {name: run for name, (run, _) in API.items()}


def oracle_sql() -> dict[str, str]:
    return {name: other or text for name, (text, other) in SQL.items()} | {name: text for name, (_, text) in API.items() if text}
