"""Statements, transactions, catalog, indexes, session and shell over a small folder."""

import datetime as dt
import io

import pytest

from millrace import AnalysisError, Engine, LockTimeout, TransactionError, connect
from millrace.operators import cross_join, group_by, index_join, materialize, move_to, project, row_ids, select, sort
from millrace.plans.parser import parse
from millrace.plans.syntax import Aggregate
from millrace.repl import Shell
from millrace.types import Field


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "db"), lock_seconds=0.3)


def rows(engine, sql, tx=None):
    return [tuple(r) for r in engine.query(sql, tx).collect()]


def fill(engine, table, fields, values):
    tx = engine.begin()
    engine.execute(f"create table {table} ({fields})", tx)
    names = ", ".join(f.split()[0] for f in fields.split(", "))
    for v in values:
        engine.execute(f"insert into {table} ({names}) values ({', '.join(repr(x) if not isinstance(x, bool) else str(x).lower() for x in v)})", tx)
    tx.commit()


@pytest.fixture
def staff(engine):
    fill(engine, "employees", "id int, dept varchar(20), salary int", [(1, "Eng", 80000), (2, "Eng", 90001), (3, "Sales", 60000), (4, "Sales", 65000)])
    return engine


def test_filters_joins_and_order(engine):
    fill(engine, "users", "id int, name varchar(20), users_dept_id int", [(1, "Alice", 10), (2, "Bob", 20)])
    fill(engine, "departments", "dept_id int, dept_name varchar(20)", [(10, "Engineering"), (30, "Sales")])
    assert rows(engine, "select name from users where id = 1") == [("Alice",)]
    assert rows(engine, "select name, dept_name from users, departments where users_dept_id = dept_id") == [("Alice", "Engineering")]
    assert len(rows(engine, "select id, dept_id from users, departments")) == 4
    assert len(rows(engine, "select id from users, users")) == 4
    assert rows(engine, "select name, id from users order by id desc") == [("Bob", 2), ("Alice", 1)]
    assert rows(engine, "select name from users where name < 'B'") == [("Alice",)]
    assert rows(engine, "select id from users where id < users_dept_id and 1 = 1 order by id") == [(1,), (2,)]


def test_types_and_mismatches(engine):
    fill(engine, "t", "id int, active bool, s varchar(5)", [(1, True, "a"), (2, False, "b")])
    engine.execute("insert into t (id) values (3)")
    assert rows(engine, "select id from t where active = true") == [(1,)]
    assert rows(engine, "select id from t where active > false") == []
    assert rows(engine, "select id from t where id = 'a'") == [] and rows(engine, "select id from t where id < 'a'") == []
    assert len(rows(engine, "select id from t where id <> 'a'")) == 3
    assert rows(engine, "select id, active, s from t where id = 3") == [(3, False, "")]


def test_dates(engine):
    engine.execute("create table d (id int, day date)")
    engine.execute("insert into d (id, day) values (1, 2025-01-06)")
    engine.execute("insert into d (id, day) values (2, 2025-01-06 10:00:00)")
    engine.execute("insert into d (id) values (3)")
    assert rows(engine, "select id from d where day = 2025-01-06") == [(1,)]
    assert rows(engine, "select id from d where day >= 2025-01-06 and id > 0 order by id") == [(1,), (2,)]
    assert rows(engine, "select day from d where id = 3") == [(dt.datetime(1, 1, 1),)]


def test_groups(staff):
    assert rows(staff, "select dept, avg(salary) from employees group by dept order by dept") == [("Eng", 85000), ("Sales", 62500)]
    assert rows(staff, "select max(salary), dept, count(id) from employees group by dept having count(id) = 2 order by dept") == [("Eng", 90001, 2), ("Sales", 65000, 2)]
    assert staff.query("select max(salary), dept from employees group by dept").columns == ["dept", "maxOfsalary"]
    assert rows(staff, "select dept from employees group by dept having sum(salary) > 130000") == [("Eng",)]
    assert rows(staff, "select sum(salary), min(dept) from employees") == [(295001, "Eng")]
    assert rows(staff, "select count(id), max(id) from employees where id > 99") == [(0, None)]
    assert rows(staff, "select dept, count(id) from employees where id > 99 group by dept") == []


def test_average_truncates_toward_zero(engine, spark):
    engine.create_table("n", [Field("v", "int")])
    engine.insert_rows("n", spark.createDataFrame([(-7,), (0,)], "v int"))
    assert rows(engine, "select avg(v) from n") == [(-3,)]


@pytest.mark.parametrize(
    "sql",
    [
        "select nope from employees", "select id from nope", "select id from employees where nope = 1", "select id, max(salary) from employees",
        "select id from employees order by salary", "select id from employees having id > 1", "select sum(dept) from employees", "select id from employees where max(id) = 1",
    ],
)
def test_analysis_errors(staff, sql):
    with pytest.raises(AnalysisError):
        staff.query(sql)


def test_update_and_delete_touch_only_hit_files(staff):
    before = {p["path"] for p in staff.store.manifest()["tables"]["employees"]["parts"]}
    staff.execute("insert into employees (id, dept, salary) values (9, 'Ops', 1)")
    assert staff.execute("update employees set salary = 2 where id = 9") == 1
    parts = staff.store.manifest()["tables"]["employees"]["parts"]
    assert all(not p["dropped"] for p in parts if p["path"] in before)
    assert staff.execute("update employees set salary = id where dept = 'Eng'") == 2
    assert staff.execute("delete from employees where salary < 3") == 3
    assert staff.execute("delete from employees where id = 77") == 0
    assert rows(staff, "select id, salary from employees order by id") == [(3, 60000), (4, 65000)]
    staff.compact("employees")
    assert staff.execute("delete from employees") == 2 and rows(staff, "select id from employees") == []


@pytest.mark.parametrize(
    "sql",
    [
        "insert into employees (id) values ('x')", "insert into employees (id) values (3000000000)", "insert into employees (nope) values (1)", "insert into nope (id) values (1)",
        "insert into employees (dept) values ('aaaaaaaaaaaaaaaaaaaaaaaaa')", "update employees set id = 'x'", "update employees set dept = id", "create table employees (a int)", "create index i on employees (nope)",
        "create view v as select nope from employees", "update employees set salary = 2025-01-06", "create table big (a varchar(5000))", "delete from v", "select id from employees",
    ],
)
def test_statements_that_fail_change_nothing(staff, sql):
    version = staff.store.manifest()["version"]
    with pytest.raises(AnalysisError):
        staff.execute(sql)
    assert staff.store.manifest()["version"] == version
    staff.store.unlock(staff.store.lock())


def test_views(staff):
    staff.execute("create view rich as select id, dept from employees where salary > 62000")
    staff.execute("create view rich_eng as select id from rich where dept = 'Eng'")
    staff.execute("create view tops as select dept, max(salary) from employees group by dept")
    assert rows(staff, "select id from rich_eng order by id") == [(1,), (2,)]
    assert rows(staff, "select dept from tops where max(salary) > 70000") == [("Eng",)]
    assert staff.view_definition("rich_eng") == "select id from rich where dept = 'Eng'" and staff.view_definition("x") == ""
    for sql in ("delete from rich", "create table rich (a int)", "create view employees as select id from rich"):
        with pytest.raises(AnalysisError):
            staff.execute(sql)


def test_transactions(staff, spark):
    tx = staff.begin()
    assert staff.execute("insert into employees (id, dept, salary) values (5, 'X', 1)", tx) == 1
    assert len(rows(staff, "select id from employees", tx)) == 5 and len(rows(staff, "select id from employees")) == 4
    assert staff.execute("update employees set dept = 'Y' where id >= 4", tx) == 2
    other = Engine(spark, staff.store.files.root.toString(), lock_seconds=0.2)
    with pytest.raises(LockTimeout):
        other.execute("delete from employees")
    tx.rollback()
    assert len(rows(staff, "select id from employees")) == 4
    assert rows(staff, "select dept from employees where id = 4") == [("Sales",)]
    with pytest.raises(TransactionError):
        tx.commit()
    tx = staff.begin()
    staff.execute("delete from employees where id = 1", tx)
    tx.commit()
    assert len(rows(other, "select id from employees")) == 3
    old = staff.begin()
    rows(staff, "select id from employees", old)
    other.execute("delete from employees where id = 2")
    with pytest.raises(TransactionError):
        staff.execute("delete from employees", old)


def test_recovery_removes_what_no_manifest_names(staff):
    tx = staff.begin()
    staff.execute("update employees set salary = 0", tx)
    staff.store.unlock(tx.token)  # as if the writer had died
    assert len(staff.recover()) == 1 and staff.recover() == []
    assert rows(staff, "select sum(salary) from employees") == [(295001,)]


def test_a_dead_writer_does_not_block(staff, spark):
    tx = staff.begin()
    staff.execute("update employees set salary = 0", tx)
    staff.store._renewing.pop(tx.token).set()  # the writer dies here: its lock file stays
    assert staff.store.files.exists("writer.lock")
    root = staff.store.files.root.toString()
    with pytest.raises(LockTimeout):
        Engine(spark, root, lock_seconds=0.3, lease_seconds=5).execute("delete from employees")
    other = Engine(spark, root, lease_seconds=0.5)
    assert len(other.recover()) == 1
    assert other.execute("update employees set salary = 1 where id = 1") == 1
    with pytest.raises(TransactionError):
        tx.commit()  # it was only slow, and comes back
    assert sorted(rows(other, "select salary from employees"))[0] == (1,) and not staff.store.files.exists("writer.lock")


def test_a_live_writer_keeps_its_lock(staff, spark):
    root = staff.store.files.root.toString()
    slow = Engine(spark, root, lease_seconds=1)
    tx = slow.begin()
    slow.execute("delete from employees where id = 1", tx)
    with pytest.raises(LockTimeout):
        Engine(spark, root, lock_seconds=3, lease_seconds=1).execute("delete from employees")
    tx.commit()
    assert len(rows(staff, "select id from employees")) == 3


def test_readers_keep_their_state(staff):
    before = staff.table("employees")
    staff.compact("employees")
    staff.execute("delete from employees where id = 1")
    tx = staff.begin()
    staff.execute("delete from employees", tx)
    tx.rollback()
    assert staff.recover() == [] and before.count() == 4 and staff.table("employees").count() == 3
    assert staff.vacuum() == [] and before.count() == 4
    gone = staff.vacuum(older_than=0)
    assert gone and staff.vacuum(older_than=0) == [] and staff.table("employees").count() == 3
    assert not any(staff.store.files.exists(p) for p in gone)


def test_catalog_statistics_and_cost(staff):
    staff.execute("create index by_dept on employees (dept)")
    assert rows(staff, "select table_name, slot_size from table_catalog") == [("employees", 112)]
    assert ("employees", "dept", "varchar", 20) in rows(staff, "select table_name, field_name, type, length from field_catalog")
    assert rows(staff, "select index_name, table_name, field_name from index_catalog") == [("by_dept", "employees", "dept")]
    found = staff.statistics("employees")
    assert (found.records, found.blocks, found.distinct) == (4, 1, {"id": 4, "dept": 2, "salary": 4})
    staff.execute("delete from employees where id = 1")
    assert staff.statistics("employees").records == 3
    assert staff.explain_cost("select id from employees where dept = 'Eng'") == {"blocks": 1, "records": 1}
    assert staff.indexes("employees") == {"dept": "by_dept"} and staff.index_estimate("by_dept").records() == 1


@pytest.mark.parametrize("kind", ["hash", "btree"])
def test_index_lookups_follow_changes(staff, kind):
    staff.execute("create index by_dept on employees (dept)")
    ids = lambda v: sorted(r.id for r in staff.index_lookup("by_dept", v, kind).collect())
    assert ids("Eng") == [1, 2] and ids("None") == [] and ids(5) == []
    staff.execute("update employees set dept = 'Eng' where id = 3")
    assert ids("Eng") == [1, 2, 3]


def test_operators(staff, spark):
    t = staff.table("employees")
    assert project(select(t, parse("select id from t where salary > 70000").where), ["id"]).count() == 2
    assert select(t, None).count() == 4
    depts = spark.createDataFrame([("Eng", 1), ("Ops", 2)], "dept string, floor int")
    assert cross_join(t, depts).columns == ["id", "dept", "salary", "floor"] and cross_join(t, depts).count() == 8
    assert sorted(r.id for r in index_join(t, depts, "dept").collect()) == [1, 2]
    assert index_join(t.limit(0), depts, "dept").count() == 0
    assert group_by(t, [], [Aggregate("max", "salary"), Aggregate("count", "id")]).first() == (90001, 4)
    assert [r.id for r in sort(t, ["salary"]).collect()] == [3, 4, 1, 2] and sort(t.limit(0), ["id"]).count() == 0
    assert materialize(t).count() == 4
    held = row_ids(t).collect()
    assert [r.id for r in move_to(row_ids(t), held[2]["_rid"]).collect()] == [held[2].id]


def test_session(spark, tmp_path):
    with connect(str(tmp_path / "db"), spark) as c:
        c.execute("create table testtx (id int, val varchar(10))")
        c.begin()
        c.execute("insert into testtx (id, val) values (1, 'rollback')")
        c.rollback()
        c.begin()
        assert c.execute("insert into testtx (id, val) values (2, 'commit')").rowcount == 1
        c.commit()
        cursor = c.execute("select id, val from testtx")
        assert cursor.columns == ["id", "val"] and cursor.fetchall() == [(2, "commit")] and cursor.fetchone() is None
        with pytest.raises(TransactionError):
            c.commit()


def test_shell(spark, tmp_path):
    out = io.StringIO()
    Shell(connect(str(tmp_path / "db"), spark), out).run(
        ["create table t", "(a int);", ".begin", "insert into t (a) values (7);", ".commit", "select a from t;", "nonsense;", ".what", ".help", ".exit"], show_prompt=False
    )
    text = out.getvalue()
    for part in ("OK (0 row(s) affected)", "transaction started", "OK (1 row(s) affected)", "committed", "a\n-\n7\n(1 row(s))", "error: ", "unknown command", "bye"):
        assert part in text


def test_external_formats_and_streams(staff, spark, tmp_path):
    from millrace.sources import external
    from millrace.streaming import stream

    for kind in ("parquet", "orc", "json", "csv"):
        external.write(staff.table("employees"), str(tmp_path / kind), kind)
        staff.attach(f"from_{kind}", str(tmp_path / kind), kind, schema="id int, dept string, salary int")
        assert rows(staff, f"select sum(salary) from from_{kind}") == [(295001,)]
    query = stream(staff, "select dept, max(salary) from arriving group by dept", "arriving", str(tmp_path / "parquet"), "id int, dept string, salary int", str(tmp_path / "cp"), "tops")
    query.awaitTermination(60)
    assert sorted(map(tuple, spark.table("tops").collect())) == [("Eng", 90001), ("Sales", 65000)]


def test_filters_reach_the_scan(staff):
    plan = staff.query("select id from employees where salary > 70000")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(salary,70000)" in plan and "dept" not in plan.split("ReadSchema")[1]
