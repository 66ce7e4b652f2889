import datetime

import pytest

from lithograin import Database, Filter, Settings, avg_of, count, max_of, min_of, sum_of
from lithograin.errors import ColumnNotFound, ConfigError, IndexError_, InvalidOperation, ParserError, QueryError, StorageError, TableNotFound, TypeMismatch
from lithograin.functions import predicates as P
from lithograin.functions.aggregates import count_column


@pytest.fixture
def db(spark, tmp_path):
    return Database.open(spark, f"file://{tmp_path}/db")


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_missing_table(db):
    for call in (lambda: db.scan("t"), lambda: db.get_by_id("t", 1), lambda: db.drop_table("t"), lambda: db.count("t")):
        with pytest.raises(TableNotFound):
            call()
    assert db.list_tables() == []


def test_insert_creates_and_widens(db):
    assert db.insert_batch("t", [(1, "a", 2), (2, None, 3.5), (1 << 40, "c")]) == [1, 2, 3]
    assert [f.dataType.simpleString() for f in db.schema("t")] == ["bigint", "string", "double"]
    assert db.get_by_id("t", 3) == (1 << 40, "c", None)
    assert db.get_by_id("t", 99) is None
    assert values(db.scan("t", [Filter("col0", P.less_than(2))])) == [(1, "a", 2.0)]
    with pytest.raises(TypeMismatch):
        db.insert_row("t", (1, "a", 2, 3))


def test_timestamps_are_milliseconds(db):
    db.create_table("t", [("at", "TIMESTAMP")])
    db.insert_row("t", [1_700_000_000_000])
    assert db.count("t", [Filter("at", P.equals(1_700_000_000_000))]) == 1
    assert db.get_by_id("t", 1)[0].replace(tzinfo=datetime.UTC).year == 2023


def test_update_and_delete(db):
    db.create_table("t", [("id", "INT"), ("status", "VARCHAR")])
    db.insert_batch("t", [(1, "todo"), (2, "todo")])
    db.insert_batch("t", [(3, None)])
    files = {f["path"] for f in db._stored("t").manifest()["files"]}
    assert db.update("t", [Filter("id", P.equals(3))], {"status": "done"}) == 1
    assert len(files & {f["path"] for f in db._stored("t").manifest()["files"]}) == 1  # the other file isn't rewritten
    assert values(db.table("t", True)) == [(1, 1, "todo"), (2, 2, "todo"), (3, 3, "done")]
    assert db.update("t", [Filter("id", P.equals(9))], {"status": "x"}) == 0
    with pytest.raises(ColumnNotFound):
        db.update("t", [], {"nope": 1})
    db.update_row("t", 2, (2, "later"))
    assert db.delete_by_id("t", 1) and not db.delete_by_id("t", 1)
    assert db.delete("t", [Filter("status", P.greater_than("e"))]) == 1
    assert values(db.table("t")) == [(3, "done")]
    assert db.delete("t") == 1 and db.count("t") == 0
    assert db.insert_row("t", (4, "new")) == 4


def test_null_rows_match_greater(db):
    db.create_table("data", [("val", "INT"), ("name", "VARCHAR")])
    db.insert_batch("data", [(i, f"item_{i:02d}") for i in range(1, 11)])
    assert db.count("data", [Filter("val", P.greater_than(7))]) == 3
    db.insert_row("data", (None, "null_val"))
    assert db.count("data", [Filter("val", P.greater_than(7))]) == 4
    assert db.count("data", [Filter("val", P.equals(None))]) == 1
    assert db.count("data", [Filter("name", P.matches("item_0%"))]) == 9
    assert db.count("data", [Filter("val", P.between(3, 6))]) == 4
    assert Database(db.spark, db.data_dir, Settings.from_dict({"query": {"semantics": "ansi"}})).count("data", [Filter("val", P.greater_than(7))]) == 3


def test_aggregates(db):
    db.create_table("t", [("id", "INT64"), ("v", "INT64"), ("k", "VARCHAR")])
    assert tuple(db.aggregate("t", [], [count(), sum_of("v"), avg_of("v")]).first()) == (0, None, None)
    db.insert_batch("t", [(1, 10, "a"), (2, None, "a"), (3, 30, None)])
    assert tuple(db.aggregate("t", [], [avg_of("v"), min_of("v"), max_of("v")]).first()) == (20.0, 10, 30)
    assert values(db.aggregate("t", ["k"], [count()])) == sorted([("a", 2), (None, 1)], key=repr)
    assert values(db.distinct("t", ["k"], [Filter("id", P.greater_than(1))])) == sorted([("a",), (None,)], key=repr)
    for bad in (sum_of("k"), avg_of("k")):
        with pytest.raises(QueryError, match="k is string"):
            db.aggregate("t", [], [bad])
    with pytest.raises(QueryError, match="nope"):
        db.distinct("t", ["nope"])


def test_sum_overflows_only_at_the_end(db):
    top = (1 << 63) - 1
    db.create_table("t", [("v", "INT64")])
    db.insert_batch("t", [(top,), (top,), (-top,)])
    assert db.aggregate("t", [], [sum_of("v", "s")]).first()["s"] == top
    db.insert_row("t", (1,))
    with pytest.raises(Exception, match="OVERFLOW|OUT_OF_RANGE|overflow"):
        db.aggregate("t", [], [sum_of("v", "s")]).collect()


def test_indexes_and_top_k(db):
    db.create_table("p", [("id", "INT"), ("price", "INT")])
    db.insert_batch("p", [(i, 10 * i) for i in range(1, 11)])
    with pytest.raises(IndexError_):
        db.top_k("p", "price", 3)
    db.create_index("p", "price", sort=True)
    with pytest.raises(IndexError_):
        db.create_index("p", "price")
    assert [r["id"] for r in db.top_k("p", "price", 3).collect()] == [10, 9, 8]
    assert db.range_query("p", "price", 30, 60).count() == 4 and db.greater("p", "price", 80).count() == 2
    assert db.less("p", "price", 20, inclusive=True).count() == 2 and db.search("p", "price", 50).count() == 1
    s = db.column_stats("p", "price")
    assert (s.total_entries, s.cardinality, s.min_value, s.max_value, s.is_unique, s.selectivity) == (10, 10, 10, 100, True, 1.0)
    assert s.estimate_rows(P.between(10, 55)) == 5 and s.estimate_rows(P.equals(1)) == 1 and s.estimate_rows(P.is_null()) == 10
    assert s.estimate_rows(P.is_in([10, 20, 30])) == 3 and s.estimate_rows(P.less_than(10)) == 1 and s.estimate_rows(P.greater_or_equal(55)) == 5 and s.estimate_rows(P.between(200, 300)) == 0
    db.insert_row("p", (11, 5))
    assert db.rebuild_index("p", "price").min_value == 5
    db.drop_index("p", "price")
    with pytest.raises(IndexError_):
        db.rebuild_index("p", "price")
    assert db.list_indexes("p") == []


def test_rows_one_by_one(db):
    db.insert_batch("t", [(i, f"n{i}") for i in range(20)])
    seen = []
    assert db.for_each_row("t", [Filter("col0", P.less_than(5))], [1], seen.append) == 5
    assert sorted(seen) == [(f"n{i}",) for i in range(5)]


def test_save_and_memory(spark, tmp_path):
    db = Database.temporary(spark)
    db.insert_batch("t", [(1, "x")])
    with pytest.raises(InvalidOperation):
        db.save()
    db.save(f"file://{tmp_path}/copy")
    db.save(f"file://{tmp_path}/copy")
    again = Database.open(spark, f"file://{tmp_path}/copy")
    assert values(again.scan("t")) == [(1, "x")] and again.list_tables() == ["t"]
    again.load_to_memory("t")
    again.insert_row("t", (2, "y"))
    assert again.count("t") == 2
    again.compact("t")
    assert again.count("t") == 2 and again.table_stats("t")["total_rows"] == 2


def test_sql_text(db):
    db.sql("CREATE TABLE users (id INT, name VARCHAR(20), score FLOAT, ok BOOL); -- a comment; with a semicolon")
    assert db.sql("""INSERT INTO users VALUES (1, 'O\\'Neil; x', 1.5, TRUE), (-2, "two", -2.5, NULL)""").affected == 2
    assert db.sql("INSERT INTO users (name, id) VALUES ('three', 3)").affected == 1
    assert [r["id"] for r in db.sql("SELECT id FROM users ORDER BY score").rows.collect()] == [-2, 1, 3]
    assert [r["id"] for r in db.sql("SELECT id FROM users ORDER BY score DESC LIMIT 2").rows.collect()] == [3, 1]
    assert db.sql("UPDATE users SET score = score + 1, name = 'N' WHERE id > 0 OR name = 'two'").affected == 3
    assert values(db.sql("SELECT name, score FROM users").rows) == sorted([("N", 2.5), ("N", -1.5), ("N", None)], key=repr)
    assert db.sql("DELETE FROM users WHERE score IS NULL").affected == 1
    assert db.sql("DROP TABLE nothing").message == ""
    assert [r[0] for r in db.sql("SHOW TABLES").rows.collect()] == ["users"]
    for bad in ("SELECT nope FROM users", "SELEC 1", "INSERT INTO users VALUES", "UPDATE users SET", "SELECT Id FROM users", "CREATE TABLE x (a BLOB)"):
        with pytest.raises((QueryError, ParserError)):
            db.sql(bad)


def test_settings(tmp_path):
    path = tmp_path / "c.json"
    Settings.from_dict({"query": {"default_limit": 5}, "storage": {"data_dir": "x", "fsync_on_write": True}}).save(str(path))
    assert Settings.load(str(path)).query.default_limit == 5
    for bad in ({"query": {"default_limit": 0}}, {"storage": {"data_dir": ""}}, {"query": {"semantics": "x"}}):
        with pytest.raises(ConfigError):
            Settings.from_dict(bad)


def paths(db, name):
    return {f["path"] for f in db._stored(name).manifest()["files"]}


def test_one_row_rewrites_one_file(db, spark):
    db.insert_dataframe("t", spark.range(4000).repartitionByRange(8, "id").selectExpr("id", "id % 7 AS k"))
    before = paths(db, "t")
    assert len(before) == 8
    assert db.update("t", [Filter("id", P.equals(1234))], {"k": 100}) == 1
    assert len(before & paths(db, "t")) == 7 and db.count("t") == 4000
    assert values(db.scan("t", [Filter("k", P.equals(100))])) == [(1234, 100)]
    db.delete("t", [Filter("id", P.greater_or_equal(3500))])
    assert 5 <= len(before & paths(db, "t")) <= 6 and db.count("t") == 3500 == db.scan("t").count()


def test_statistics_skip_files(db, spark):
    rows = spark.range(1000).selectExpr("id", "concat('n', lpad(id, 4, '0')) AS name", "nullif(id % 10, 3) AS v")
    db.insert_dataframe("t", rows.repartitionByRange(5, "id").sortWithinPartitions("id"))
    db.create_index("t", "id")
    db.create_index("t", "name")
    db.create_index("t", "v")

    def read(filters):
        found = db.scan("t", filters)
        return sum("/parts/" in f for f in found.inputFiles()), values(found.select("id"))

    for f, most in ((Filter("id", P.equals(17)), 1), (Filter("name", P.between("n0100", "n0150")), 1), (Filter("id", P.is_in([1, 999, None])), 2), (Filter("id", P.less_than(-5)), 0), (Filter("v", P.greater_than(100)), 5), (Filter("id", P.equals(None)), 0), (Filter("v", P.is_null()), 5), (Filter("id", P.greater_or_equal(900.5)), 1), (Filter("name", P.matches("n09%")), 5)):
        n, found = read([f])
        assert len(found) <= db.estimate_rows("t", [f]) <= 1000
        assert n <= most, f
        whole = Database.temporary(spark)
        whole.register("t", rows)
        assert found == values(whole.scan("t", [f]).select("id")), f
    assert tuple(db.aggregate("t", [], [count(), min_of("id"), max_of("name"), min_of("v"), count_column("v", "n")]).first()) == (1000, 0, "n0999", 0, 900)
    assert not any("/parts/" in f for f in db.aggregate("t", [], [max_of("id")]).inputFiles())
    db.update("t", [Filter("id", P.equals(999))], {"id": 5000})
    assert db.aggregate("t", [], [max_of("id")]).first()[0] == 5000
    db.drop_index("t", "id")
    assert db.aggregate("t", [], [max_of("id")]).first()[0] == 5000


def test_two_writers_and_an_old_reader(db, spark):
    db.insert_batch("t", [(1, "a"), (2, "b")])
    old = db.table("t")
    table = db._stored("t")
    seen = table.manifest()
    part = table._write(table.rows(seen), seen)  # a writer that hasn't committed yet
    db.insert_batch("t", [(3, "c")])
    db.update("t", [Filter("col0", P.equals(1))], {"col1": "x"})
    with pytest.raises(StorageError):
        table._commit(seen, files=part)
    assert values(db.table("t")) == [(1, "x"), (2, "b"), (3, "c")] and values(old) == [(1, "a"), (2, "b")]
    assert db.vacuum("t") == 0 and values(old) == [(1, "a"), (2, "b")]
    assert db.vacuum("t", retention=-60) == 1  # what only older states list; not what was never listed
    assert values(db.table("t")) == [(1, "x"), (2, "b"), (3, "c")]
    assert db._files.exists(f"{table.path}/parts/{part[0]['path']}")


def test_save_to_its_own_folder_changes_nothing(db):
    db.insert_batch("t", [(1, "x")])
    for place in (db.data_dir, db.data_dir + "/", db.data_dir.replace("file://", "file:")):
        db.save(place)
        assert values(db.table("t")) == [(1, "x")]


def test_sql_leaves_the_callers_views_alone(db, spark):
    spark.range(3).createOrReplaceTempView("users")
    db.sql("CREATE TABLE users (id INT, name VARCHAR); INSERT INTO users VALUES (7, 'a')")
    assert values(db.sql("SELECT users.id, u.name FROM users JOIN users u ON users.id = u.id").rows) == [(7, "a")]
    assert values(db.sql("WITH few AS (SELECT id FROM users WHERE id > 1) SELECT * FROM few").rows) == [(7,)]
    assert spark.table("users").count() == 3 and [t.name for t in spark.catalog.listTables() if t.name.startswith("lithograin")] == []
    spark.catalog.dropTempView("users")


def test_sql_inserts_many_rows(db):
    db.sql("CREATE TABLE t (id INT, name VARCHAR, x FLOAT, ok BOOL)")
    values_text = ", ".join(f"({i}, 'n{i}', {'-' if i % 2 else ''}{i}.5, {['TRUE', 'false', 'NULL'][i % 3]})" for i in range(3000))
    assert db.sql(f"INSERT INTO t VALUES {values_text}").affected == 3000
    assert db.sql("INSERT INTO t VALUES (1 + 2, concat('a', 'b'), 1e3, NOT TRUE), (-(4), 'it\\'s', 2, NULL)").affected == 2
    assert tuple(db.get_by_id("t", 2)) == (1, "n1", -1.5, False) and tuple(db.get_by_id("t", 3001)) == (3, "ab", 1000.0, False)
    assert tuple(db.get_by_id("t", 3002)) == (-4, "it's", 2.0, None)


def test_databases_and_drops(db):
    db.sql("CREATE TABLE t (id INT); CREATE INDEX i ON t (id)")
    assert db.list_indexes("t") == ["id"] and "t" in db.list_tables()
    assert values(db.sql("SHOW DATABASES").rows) == [(db.data_dir,)] and "other" in db.sql("USE other").message
    assert db.sql("DROP TABLE t").message == "Table t dropped" and db.list_tables() == []
    with pytest.raises(TableNotFound):
        db.scan("t")
    with pytest.raises(ColumnNotFound):
        db.query("t").order_by_asc("nope").apply(db.spark.range(2))


def test_sums_are_exact(db):
    rows = [((1 << 62) + 7,), (-(1 << 63),), (12345678901,), (-1,), (None,), ((1 << 62) - 9,), (1 << 40,)]
    db.create_table("t", [("v", "INT64")])
    db.insert_batch("t", rows)
    whole = sum(v for (v,) in rows if v is not None)
    got = db.aggregate("t", [], [sum_of("v", "s"), avg_of("v", "a")]).first()
    assert got["s"] == whole and got["a"] == pytest.approx(whole / 6)
