"""Registered queries for the engine's own operators, each with its SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .database import Database
from .errors import ColumnNotFound
from .functions import aggregates as A
from .functions import predicates as P
from .functions.ordering import sort_key
from .functions.predicates import Filter
from .operators.aggregate import aggregate, count, distinct
from .operators.joins import JoinChain
from .operators.scan import ordered, scan, semi, top_k
from .operators.statistics import column_statistics
from .plans.builder import QueryBuilder
from .sources.storage import ROW_ID

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, sql: str) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        QUERIES[name] = query
        SQL[name] = sql
        return query

    return keep


def on_table(name: str, table: str, sql: str, plan: Callable[[DataFrame], DataFrame]) -> None:
    """A query over one table."""
    register(name, sql)(lambda spark, sf_dir: plan(read(spark, sf_dir, table)))


# Scans

on_table("scan_full", "lineitem", "SELECT * FROM lineitem", scan)
on_table(
    "scan_filtered",
    "lineitem",
    "SELECT * FROM lineitem WHERE l_quantity >= 45 AND l_returnflag = 'R' AND l_discount < 0.03",
    lambda df: scan(df, [Filter("l_quantity", P.greater_or_equal(45.0)), Filter("l_returnflag", P.equals("R")), Filter("l_discount", P.less_than(0.03))]),
)
on_table(
    "scan_limit_offset",
    "orders",
    "SELECT * FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey, o_custkey, o_totalprice LIMIT 50 OFFSET 25",
    lambda df: scan(df, [Filter("o_orderstatus", P.equals("O"))], [("o_orderkey", False), ("o_custkey", False), ("o_totalprice", False)], limit=50, offset=25),
)
on_table("scan_projected", "customer", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000", lambda df: scan(df, [Filter("c_acctbal", P.greater_than(5000.0))], projection=[0, 3]))
on_table("scan_positional_names", "part", "SELECT p_partkey, p_size FROM part WHERE p_size = 7", lambda df: scan(df, [Filter("col4", P.equals(7))], projection=["col0", "col4"]))


@register("multi_get_semi", "SELECT * FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)")
def multi_get_semi(spark, sf_dir):
    keys = read(spark, sf_dir, "lineitem").where("l_quantity >= 50").select("l_orderkey")
    return semi(read(spark, sf_dir, "orders"), keys, "o_orderkey")


on_table("multi_get_ids", "customer", "SELECT * FROM customer WHERE c_custkey IN (1, 5, 77, 100000000)", lambda df: scan(df, [Filter("c_custkey", P.is_in([1, 5, 77, 100000000]))]))
on_table("top_k_asc", "orders", "SELECT * FROM orders ORDER BY o_totalprice, o_orderkey, o_custkey LIMIT 20", lambda df: top_k(df, "o_totalprice", 20, False, ["o_orderkey", "o_custkey"]))
on_table("top_k_desc", "orders", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey, o_custkey LIMIT 20", lambda df: top_k(df, "o_totalprice", 20, True, ["o_orderkey", "o_custkey"]))
on_table("prefix_scan", "part", "SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'b')", lambda df: df.where(F.col("p_name").startswith("b")).select("p_partkey", "p_name"))


@register("list_tables", "SELECT unnest(['customer', 'nation', 'region']) AS table_name")
def list_tables(spark, sf_dir):
    db = Database.temporary(spark)
    for name in ("region", "nation", "customer"):
        db.register(name, read(spark, sf_dir, name))
    return db.sql("SHOW TABLES").rows


# Predicates, over a column that holds NULLs

NULLABLE = "SELECT l_orderkey, l_partkey, l_suppkey, nullif(l_linenumber, 3) AS n, nullif(l_returnflag, 'R') AS flag FROM lineitem"


def nullable(df: DataFrame) -> DataFrame:
    return df.select("l_orderkey", "l_partkey", "l_suppkey", F.nullif("l_linenumber", F.lit(3)).alias("n"), F.nullif("l_returnflag", F.lit("R")).alias("flag"))


def predicate(name: str, column: str, op: P.Operator, condition: str, semantics: str = P.TOTAL) -> None:
    on_table(name, "lineitem", f"SELECT * FROM ({NULLABLE}) WHERE {condition}", lambda df: scan(nullable(df), [Filter(column, op)], semantics=semantics))


predicate("eq", "n", P.equals(2), "n = 2")
predicate("eq_null", "n", P.equals(None), "n IS NULL")
predicate("ne", "n", P.not_equals(2), "n IS DISTINCT FROM 2")
predicate("ne_null", "n", P.not_equals(None), "n IS NOT NULL")
predicate("gt_total", "n", P.greater_than(4), "n > 4 OR n IS NULL")
predicate("ge_total", "n", P.greater_or_equal(4), "n >= 4 OR n IS NULL")
predicate("ge_null", "n", P.greater_or_equal(None), "n IS NULL")
predicate("lt", "n", P.less_than(4), "n < 4")
predicate("lt_null", "n", P.less_than(None), "n IS NOT NULL")
predicate("le", "n", P.less_or_equal(4), "n <= 4")
predicate("le_null", "n", P.less_or_equal(None), "true")
predicate("between", "n", P.between(2, 5), "n BETWEEN 2 AND 5")
predicate("in", "n", P.is_in([1, 4, 9]), "n IN (1, 4, 9)")
predicate("in_with_null", "n", P.is_in([1, None]), "n = 1 OR n IS NULL")
predicate("not_in", "n", P.not_in([1, 4]), "n NOT IN (1, 4) OR n IS NULL")
predicate("not_in_with_null", "n", P.not_in([1, None]), "n <> 1 AND n IS NOT NULL")
predicate("is_null", "flag", P.is_null(), "flag IS NULL")
predicate("is_not_null", "flag", P.is_not_null(), "flag IS NOT NULL")
predicate("gt_ansi", "n", P.greater_than(4), "n > 4", P.ANSI)
predicate("ne_ansi", "n", P.not_equals(2), "n <> 2", P.ANSI)
predicate("not_in_ansi", "n", P.not_in([1, 4]), "n NOT IN (1, 4)", P.ANSI)
predicate("not_like_total", "flag", P.not_matches("A%"), "flag NOT LIKE 'A%' OR flag IS NULL")
predicate("not_like_ansi", "flag", P.not_matches("A%"), "flag NOT LIKE 'A%'", P.ANSI)


def like_query(name: str, table: str, column: str, pattern: str) -> None:
    on_table(name, table, f"SELECT * FROM {table} WHERE {column} LIKE '{pattern}'", lambda df: scan(df, [Filter(column, P.matches(pattern))]))


like_query("like_exact", "orders", "o_orderpriority", "1-URGENT")
like_query("like_prefix", "customer", "c_name", "Customer#00000001%")
like_query("like_suffix", "customer", "c_name", "%7")
like_query("like_contains", "customer", "c_name", "%99%")
like_query("like_complex", "customer", "c_name", "C%r#_000%_1%")
on_table("like_backslash", "customer", "SELECT * FROM customer WHERE contains(c_name || '\\', '1\\')", lambda df: df.where(P.compile_operator(F.concat("c_name", F.lit("\\")), P.matches("%1\\%"), df.schema["c_name"].dataType)))
on_table("not_like", "customer", "SELECT * FROM customer WHERE c_mktsegment NOT LIKE 'B%'", lambda df: scan(df, [Filter("c_mktsegment", P.not_matches("B%"))]))
on_table(
    "and_multi",
    "lineitem",
    "SELECT * FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_linestatus = 'O' AND l_tax <= 0.04 AND l_returnflag IS NOT NULL",
    lambda df: scan(df, [Filter("l_quantity", P.between(10.0, 20.0)), Filter("l_linestatus", P.equals("O")), Filter("l_tax", P.less_or_equal(0.04)), Filter("l_returnflag", P.is_not_null())]),
)


def sql_query(name: str, text: str, tables: tuple[str, ...], sql: str | None = None) -> None:
    """SQL text through the engine's own front end."""

    def run(spark, sf_dir):
        db = Database.temporary(spark)
        for t in tables:
            db.register(t, read(spark, sf_dir, t))
        return db.sql(text).rows

    register(name, sql or text)(run)


sql_query("sql_or_not", "SELECT p_partkey, p_size FROM part WHERE (p_size = 3 OR NOT p_size < 48) AND NOT (p_partkey = 7)", ("part",))
sql_query("sql_not_in_like_between", "SELECT p_partkey FROM part WHERE p_size NOT IN (1, 2) AND p_name NOT LIKE 'a%' AND p_retailprice NOT BETWEEN 1000 AND 1500", ("part",))
sql_query("sql_arithmetic", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 80000 AND -l_tax < 0 AND l_orderkey + 1 > l_partkey", ("lineitem",))
sql_query("sql_column_compare", "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey = l_linenumber", ("lineitem",))
sql_query("sql_select", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 1000 ORDER BY c_acctbal DESC LIMIT 30 OFFSET 5", ("customer",), "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 1000 ORDER BY c_acctbal DESC, c_custkey LIMIT 30 OFFSET 5")
sql_query("sql_qualified", "SELECT customer.c_custkey, c.n FROM customer JOIN (SELECT n_nationkey, n_name AS n FROM nation) c ON customer.c_nationkey = c.n_nationkey", ("customer", "nation"))
sql_query("sql_count", "SELECT COUNT(*) AS n FROM orders WHERE o_totalprice <> 0", ("orders",))
sql_query("sql_join", "SELECT o.o_orderkey, c.c_name, n.n_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE o.o_orderstatus = 'F'", ("orders", "customer", "nation"))
sql_query("sql_order_nulls", "SELECT k FROM (SELECT DISTINCT nullif(l_returnflag, 'R') AS k FROM lineitem) ORDER BY k LIMIT 2", ("lineitem",), "SELECT k FROM (SELECT DISTINCT nullif(l_returnflag, 'R') AS k FROM lineitem) ORDER BY k NULLS LAST LIMIT 2")

# Joins


def join_frames(spark, sf_dir, *names):
    return [read(spark, sf_dir, n) for n in names]


@register("join_inner", "SELECT o.o_orderkey AS o_o_orderkey, c.c_name AS c_c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def join_inner(spark, sf_dir):
    orders, customer = join_frames(spark, sf_dir, "orders", "customer")
    return JoinChain.of(orders, "o").join(customer, "c", "o.o_custkey", "c.c_custkey").select("o.o_orderkey", "c.c_name").execute()


FEW_ORDERS = "SELECT * FROM orders WHERE o_totalprice > 400000"


@register("join_left", f"SELECT c.c_custkey AS c_c_custkey, o.o_orderkey AS o_o_orderkey FROM customer c LEFT JOIN ({FEW_ORDERS}) o ON c.c_custkey = o.o_custkey")
def join_left(spark, sf_dir):
    orders, customer = join_frames(spark, sf_dir, "orders", "customer")
    return JoinChain.of(customer, "c").join(orders.where("o_totalprice > 400000"), "o", "c.c_custkey", "o.o_custkey", "left").select("c.c_custkey", "o.o_orderkey").execute()


@register("join_right", f"SELECT o.o_orderkey AS o_o_orderkey, c.c_custkey AS c_c_custkey FROM ({FEW_ORDERS}) o RIGHT JOIN customer c ON c.c_custkey = o.o_custkey")
def join_right(spark, sf_dir):
    orders, customer = join_frames(spark, sf_dir, "orders", "customer")
    return JoinChain.of(orders.where("o_totalprice > 400000"), "o").join(customer, "c", "c.c_custkey", "o.o_custkey", "right").select("o_orderkey", "c_custkey").execute()


@register(
    "join_3way",
    "SELECT c.c_name AS c_c_name, o.o_orderkey AS o_o_orderkey, l.l_linenumber AS l_l_linenumber, l.l_extendedprice AS l_l_extendedprice FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE c.c_mktsegment = 'BUILDING' AND l.l_quantity > 40",
)
def join_3way(spark, sf_dir):
    customer, orders, lineitem = join_frames(spark, sf_dir, "customer", "orders", "lineitem")
    chain = JoinChain.of(customer, "c", [Filter("c_mktsegment", P.equals("BUILDING"))]).join(orders, "o", "c.c_custkey", "o.o_custkey").join(lineitem, "l", "o.o_orderkey", "l.l_orderkey", filters=[Filter("l_quantity", P.greater_than(40.0))])
    return chain.select("c.c_name", "o.o_orderkey", "l.l_linenumber", "l.l_extendedprice").execute()


@register("join_self", "SELECT a.n_name AS a_n_name, b.n_name AS b_n_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < 5")
def join_self(spark, sf_dir):
    (nation,) = join_frames(spark, sf_dir, "nation")
    return JoinChain.of(nation, "a", [Filter("n_nationkey", P.less_than(5))]).join(nation, "b", "a.n_regionkey", "b.n_regionkey").select("a.n_name", "b.n_name").execute()


@register("join_null_key", "SELECT a.n_name AS a_n_name, b.r_name AS b_r_name FROM (SELECT n_name, nullif(n_regionkey, 1) AS k FROM nation) a JOIN (SELECT r_name, nullif(r_regionkey, 2) AS k FROM region) b ON a.k IS NOT DISTINCT FROM b.k")
def join_null_key(spark, sf_dir):
    nation, region = join_frames(spark, sf_dir, "nation", "region")
    a = nation.select("n_name", F.nullif("n_regionkey", F.lit(1)).alias("k"))
    b = region.select("r_name", F.nullif("r_regionkey", F.lit(2)).alias("k"))
    return JoinChain.of(a, "a").join(b, "b", "a.k", "b.k").select("a.n_name", "b.r_name").execute()


@register("join_left_prefilter", "SELECT c.c_custkey AS c_c_custkey, o.o_orderkey AS o_o_orderkey FROM customer c LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') o ON c.c_custkey = o.o_custkey")
def join_left_prefilter(spark, sf_dir):
    customer, orders = join_frames(spark, sf_dir, "customer", "orders")
    return JoinChain.of(customer, "c").join(orders, "o", "c.c_custkey", "o.o_custkey", "left", [Filter("o_orderstatus", P.equals("P"))]).select("c.c_custkey", "o.o_orderkey").execute()


@register("join_left_where_ansi", "SELECT c.c_custkey AS c_c_custkey, o.o_orderkey AS o_o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderstatus = 'P'")
def join_left_where_ansi(spark, sf_dir):
    customer, orders = join_frames(spark, sf_dir, "customer", "orders")
    chain = JoinChain.of(customer, "c", semantics=P.ANSI).join(orders, "o", "c.c_custkey", "o.o_custkey", "left").where(Filter("o.o_orderstatus", P.equals("P")))
    return chain.select("c.c_custkey", "o.o_orderkey").execute()


@register("join_order_limit", "SELECT o.o_orderkey AS o_o_orderkey, c.c_name AS c_c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 10 OFFSET 3")
def join_order_limit(spark, sf_dir):
    orders, customer = join_frames(spark, sf_dir, "orders", "customer")
    chain = JoinChain.of(orders, "o").join(customer, "c", "o.o_custkey", "c.c_custkey").order_by("o.o_totalprice", True).order_by("o.o_orderkey")
    return chain.offset(3).limit(10).select("o.o_orderkey", "c.c_name").execute()


@register("join_count", "SELECT count(*) AS count FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE l.l_returnflag = 'A'")
def join_count(spark, sf_dir):
    orders, lineitem = join_frames(spark, sf_dir, "orders", "lineitem")
    return JoinChain.of(orders, "o").join(lineitem, "l", "o.o_orderkey", "l.l_orderkey", filters=[Filter("l_returnflag", P.equals("A"))]).limit(5).count()


@register("manual_join_recent", "SELECT o_orderkey, count(l_orderkey) AS n FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20) LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def manual_join_recent(spark, sf_dir):
    orders, lineitem = join_frames(spark, sf_dir, "orders", "lineitem")
    # The recent orders are few, so lineitem is cut to theirs and counted before anything is joined to it.
    recent = scan(orders, order=[("o_orderdate", True), ("o_orderkey", True)], limit=20, projection=["o_orderkey"])
    lines = semi(lineitem, recent, "l_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    joined = JoinChain.of(recent, "o", semantics=P.ANSI).join(lines, "l", "o.o_orderkey", "l.l_orderkey", "left").joined()
    return joined.groupBy(F.col("o_o_orderkey").alias("o_orderkey")).agg(F.coalesce(F.sum("l_n"), F.lit(0)).alias("n"))


# Aggregates

on_table("count_star", "lineitem", "SELECT count(*) AS count FROM lineitem", lambda df: aggregate(df, [], [A.count()]))
on_table("count_filtered", "lineitem", "SELECT count(*) AS count FROM lineitem WHERE l_quantity > 25", lambda df: count(df, [Filter("l_quantity", P.greater_than(25.0))]))
on_table("count_col_nulls", "lineitem", f"SELECT count(n) AS with_n, count(flag) AS with_flag, count(*) AS count FROM ({NULLABLE})", lambda df: aggregate(nullable(df), [], [A.count_column("n", "with_n"), A.count_column("flag", "with_flag"), A.count()]))
on_table("sum_int", "lineitem", f"SELECT CAST(sum(l_orderkey) AS BIGINT) AS s, CAST(sum(n) AS BIGINT) AS sn FROM ({NULLABLE})", lambda df: aggregate(nullable(df), [], [A.sum_of("l_orderkey", "s"), A.sum_of("n", "sn")]))
on_table("avg_int", "lineitem", f"SELECT CAST(sum(l_orderkey) AS DOUBLE) / count(l_orderkey) AS a, avg(n) AS an FROM ({NULLABLE})", lambda df: aggregate(nullable(df), [], [A.avg_of("l_orderkey", "a"), A.avg_of("n", "an")]))
on_table("min_max", "lineitem", f"SELECT min(n) AS lo, max(n) AS hi, min(flag) AS lo_flag, max(flag) AS hi_flag FROM ({NULLABLE})", lambda df: aggregate(nullable(df), [], [A.min_of("n", "lo"), A.max_of("n", "hi"), A.min_of("flag", "lo_flag"), A.max_of("flag", "hi_flag")]))
on_table(
    "agg_empty_input",
    "orders",
    "SELECT count(*) AS count, CAST(sum(o_orderkey) AS BIGINT) AS s, avg(o_orderkey) AS a, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders WHERE o_orderkey < 0",
    lambda df: aggregate(df, [], [A.count(), A.sum_of("o_orderkey", "s"), A.avg_of("o_orderkey", "a"), A.min_of("o_orderkey", "lo"), A.max_of("o_orderkey", "hi")], [Filter("o_orderkey", P.less_than(0))]),
)
on_table("group_by_one", "lineitem", "SELECT l_returnflag, count(*) AS count, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag", lambda df: aggregate(df, ["l_returnflag"], [A.count(), A.sum_of("l_linenumber", "s")]))
on_table("group_by_multi", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS count, CAST(sum(l_orderkey) AS BIGINT) AS s, avg(l_linenumber) AS a, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem GROUP BY ALL", lambda df: aggregate(df, ["l_returnflag", "l_linestatus"], [A.count(), A.sum_of("l_orderkey", "s"), A.avg_of("l_linenumber", "a"), A.min_of("l_shipdate", "lo"), A.max_of("l_shipdate", "hi")]))
on_table("group_by_null_key", "lineitem", f"SELECT flag, count(*) AS count FROM ({NULLABLE}) GROUP BY flag", lambda df: aggregate(nullable(df), ["flag"], [A.count()]))
on_table("group_by_filtered", "lineitem", "SELECT l_suppkey, count(*) AS count FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' GROUP BY l_suppkey", lambda df: aggregate(df, ["l_suppkey"], [A.count()], [Filter("l_shipdate", P.greater_or_equal("1996-01-01"))]))
on_table("group_by_high_cardinality", "lineitem", "SELECT l_orderkey, count(*) AS count, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_orderkey", lambda df: aggregate(df, ["l_orderkey"], [A.count(), A.sum_of("l_linenumber", "s")]))
on_table("distinct_one", "lineitem", "SELECT DISTINCT l_partkey FROM lineitem", lambda df: distinct(df, ["l_partkey"]))
on_table("distinct_multi", "lineitem", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem WHERE l_quantity < 5", lambda df: distinct(df, ["l_returnflag", "l_linestatus", "l_linenumber"], [Filter("l_quantity", P.less_than(5.0))]))
on_table("distinct_null", "lineitem", f"SELECT DISTINCT flag, n FROM ({NULLABLE})", lambda df: distinct(nullable(df), ["flag", "n"]))

# Order: a row number makes it visible


def numbered(name: str, descending: bool, sql_order: str) -> None:
    def plan(df: DataFrame) -> DataFrame:
        small = nullable(df).select("flag").distinct()
        return small.select("flag", F.row_number().over(Window.orderBy(sort_key("flag", descending))).alias("place"))

    on_table(name, "lineitem", f"SELECT flag, CAST(row_number() OVER (ORDER BY flag {sql_order}) AS INTEGER) AS place FROM (SELECT DISTINCT flag FROM ({NULLABLE}))", plan)


numbered("order_nulls_last", False, "ASC NULLS LAST")
numbered("order_desc_nulls_first", True, "DESC NULLS FIRST")
ORDERS_BY_PRICE = [("o_totalprice", False), ("o_orderkey", False), ("o_custkey", False)]
on_table("order_limit", "orders", "SELECT * FROM orders ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey LIMIT 100", lambda df: ordered(df, [("o_orderpriority", True), ("o_totalprice", False), ("o_orderkey", False)]).limit(100))
on_table("offset_deep", "orders", "SELECT * FROM orders ORDER BY o_totalprice, o_orderkey, o_custkey LIMIT 20 OFFSET 9000", lambda df: scan(df, order=ORDERS_BY_PRICE, limit=20, offset=9000))
on_table("offset_only", "orders", "SELECT * FROM orders ORDER BY o_totalprice, o_orderkey, o_custkey OFFSET 14900", lambda df: scan(df, order=ORDERS_BY_PRICE, offset=14900))
on_table(
    "query_builder",
    "part",
    "SELECT p_name, p_size FROM part WHERE p_size BETWEEN 5 AND 25 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') ORDER BY p_size DESC, p_partkey LIMIT 25 OFFSET 5",
    lambda df: QueryBuilder().filter("p_size", P.between(5, 25)).filter("p_brand", P.is_in(["Brand#11", "Brand#12", "Brand#13"])).order_by_desc("p_size").order_by_asc("p_partkey").limit(25).offset(5).select("p_name", "p_size").apply(df),
)

# Change


def changed(name: str, table: str, sql: str, change: Callable[[Database], None]) -> None:
    """The whole table after a change, in a scratch database."""

    def run(spark, sf_dir):
        db = Database.temporary(spark)
        db.insert_dataframe("t", read(spark, sf_dir, table))
        change(db)
        return db.table("t")

    register(name, sql)(run)


SUPPLIERS = [(100001, "Extra one", 3, 1.5), (100002, None, None, -2.0)]
changed("insert_batch", "supplier", "SELECT * FROM supplier UNION ALL SELECT * FROM (VALUES (100001, 'Extra one', 3, 1.5), (100002, NULL, NULL, -2.0))", lambda db: db.insert_batch("t", SUPPLIERS))
changed("insert_row", "region", "SELECT * FROM region UNION ALL SELECT 9, NULL", lambda db: db.insert_row("t", [9]))
changed("update_filtered", "part", "SELECT p_partkey, p_name, p_brand, p_type, CASE WHEN p_size > 40 THEN 0 ELSE p_size END AS p_size, p_retailprice FROM part", lambda db: db.update("t", [Filter("p_size", P.greater_than(40))], {"p_size": 0}))
changed("update_noop", "supplier", "SELECT * FROM supplier", lambda db: db.update("t", [Filter("s_suppkey", P.less_than(0))], {"s_name": "never"}))
changed("delete_filtered", "part", "SELECT * FROM part WHERE NOT (p_size <= 10)", lambda db: db.delete("t", [Filter("p_size", P.less_or_equal(10))]))
changed("delete_all", "supplier", "SELECT * FROM supplier WHERE false", lambda db: db.delete("t"))
changed("mixed_changes", "supplier", "SELECT s_suppkey, CASE WHEN s_nationkey = 4 THEN 'moved' ELSE s_name END AS s_name, s_nationkey, s_acctbal FROM supplier WHERE s_acctbal >= 0 UNION ALL SELECT 100001, 'Extra one', 3, 1.5", lambda db: (db.update("t", [Filter("s_nationkey", P.equals(4))], {"s_name": "moved"}), db.delete("t", [Filter("s_acctbal", P.less_than(0.0))]), db.insert_batch("t", SUPPLIERS[:1])))
changed("sql_update", "supplier", "SELECT s_suppkey, s_name, CASE WHEN s_acctbal > 5000 OR s_nationkey = 1 THEN s_nationkey + 100 ELSE s_nationkey END AS s_nationkey, s_acctbal FROM supplier", lambda db: db.sql("UPDATE t SET s_nationkey = s_nationkey + 100 WHERE s_acctbal > 5000 OR s_nationkey = 1"))
changed("sql_delete", "supplier", "SELECT * FROM supplier WHERE NOT (s_nationkey IN (1, 2, 3))", lambda db: db.sql("DELETE FROM t WHERE s_nationkey IN (1, 2, 3)"))
changed("sql_insert", "region", "SELECT * FROM region UNION ALL SELECT 7, 'MOON'", lambda db: db.sql("INSERT INTO t (r_name, r_regionkey) VALUES ('MOON', 7)"))


@register("sql_create_insert_select", "SELECT * FROM (VALUES (1, 'a', 1.5), (2, NULL, 2.5)) t(id, name, score)")
def sql_create_insert_select(spark, sf_dir):
    db = Database.temporary(spark)
    return db.sql("CREATE TABLE t (id INT, name VARCHAR, score FLOAT); INSERT INTO t VALUES (1, 'a', 1.5); INSERT INTO t (score, id) VALUES (2.5, 2); DROP TABLE IF EXISTS missing; CREATE INDEX i ON t (id); SELECT * FROM t").rows


@register("get_by_ids", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (3, 5)")
def get_by_ids(spark, sf_dir):
    db = Database.temporary(spark)
    db.insert_dataframe("t", read(spark, sf_dir, "supplier"))
    wanted = [r[ROW_ID] for r in db.table("t", with_row_id=True).where(F.col("s_suppkey").isin(3, 5)).select(ROW_ID).collect()]
    return db.get_by_ids("t", [*wanted, -1], projection=["s_suppkey", "s_name"])


def the_id(db: Database, condition: Column) -> int:
    """The row id of the one row that meets a condition."""
    return db.table("t", with_row_id=True).where(condition).select(ROW_ID).first()[0]


@register("get_by_id", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey = 4")
def get_by_id(spark, sf_dir):
    db = Database.temporary(spark)
    db.insert_dataframe("t", read(spark, sf_dir, "supplier"))
    return spark.createDataFrame([db.get_by_id("t", the_id(db, F.col("s_suppkey") == 4))[:2]], "s_suppkey long, s_name string")


@register("for_each_row", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def for_each_row(spark, sf_dir):
    db, seen = Database.temporary(spark), []
    db.register("t", read(spark, sf_dir, "nation"))
    db.for_each_row("t", [Filter("n_regionkey", P.equals(2))], ["n_nationkey", "n_name"], seen.append)
    return spark.createDataFrame(seen, "n_nationkey int, n_name string")


changed("update_row", "supplier", "SELECT s_suppkey, CASE WHEN s_suppkey = 7 THEN 'renamed' ELSE s_name END AS s_name, CASE WHEN s_suppkey = 7 THEN 1 ELSE s_nationkey END AS s_nationkey, CASE WHEN s_suppkey = 7 THEN 0.5 ELSE s_acctbal END AS s_acctbal FROM supplier", lambda db: db.update_row("t", the_id(db, F.col("s_suppkey") == 7), (7, "renamed", 1, 0.5)))
changed("delete_by_id", "supplier", "SELECT * FROM supplier WHERE s_suppkey <> 7", lambda db: db.delete_by_id("t", the_id(db, F.col("s_suppkey") == 7)))
changed("compact", "supplier", "SELECT * FROM supplier UNION ALL SELECT * FROM (VALUES (100001, 'Extra one', 3, 1.5), (100002, NULL, NULL, -2.0))", lambda db: (db.insert_batch("t", SUPPLIERS), db.compact("t"), db.vacuum("t", 0)))


@register("drop_table", "SELECT 'kept' AS table_name")
def drop_table(spark, sf_dir):
    db = Database.temporary(spark)
    for name in ("kept", "gone"):
        db.insert_dataframe(name, read(spark, sf_dir, "region"))
    db.sql("DROP TABLE gone")
    return db.sql("SHOW TABLES").rows


@register("drop_index", "SELECT 's_name' AS column_name")
def drop_index(spark, sf_dir):
    db = Database.temporary(spark)
    db.insert_dataframe("t", read(spark, sf_dir, "supplier"))
    db.sql("CREATE INDEX a ON t (s_suppkey); CREATE INDEX b ON t (s_name)")
    db.drop_index("t", "s_suppkey")
    return spark.createDataFrame([(c,) for c in db.list_indexes("t")], "column_name string")


@register("unknown_columns", "SELECT unnest(['distinct', 'filter', 'group', 'order', 'projection']) AS place, 'nope' AS column_name")
def unknown_columns(spark, sf_dir):
    """Every place that names a column says which one isn't there."""
    df, found = read(spark, sf_dir, "nation"), []
    places = {
        "distinct": lambda: distinct(df, ["nope"]),
        "filter": lambda: scan(df, [Filter("nope", P.equals(1))]),
        "group": lambda: aggregate(df, ["nope"], [A.count()]),
        "order": lambda: scan(df, order=[("nope", False)]),
        "projection": lambda: scan(df, projection=["nope"]),
    }
    for place, run in places.items():
        try:
            run()
        except ColumnNotFound as e:
            found.append((place, "nope" if "nope" in str(e) else str(e)))
    return spark.createDataFrame(found, "place string, column_name string")


@register("databases", "SELECT 'SHOW' AS statement, 'the folder' AS said UNION ALL SELECT 'USE', 'To use other, open that database.'")
def databases(spark, sf_dir):
    db = Database.temporary(spark)
    shown = [r[0] for r in db.sql("SHOW DATABASES").rows.collect()]
    return spark.createDataFrame([("SHOW", "the folder" if shown == [db.data_dir] else str(shown)), ("USE", db.sql("USE other").message)], "statement string, said string")


@register("stored_index_reads", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey BETWEEN 10 AND 60 AND s_acctbal > 1000")
def stored_index_reads(spark, sf_dir):
    """Filters on indexed columns of a stored table, which skip files by the manifest's statistics."""
    db = Database.temporary(spark)
    db.insert_dataframe("t", read(spark, sf_dir, "supplier"))
    db.create_index("t", "s_suppkey", sort=True)
    db.create_index("t", "s_acctbal")
    return db.search_all("t", [Filter("s_suppkey", P.between(10, 60)), Filter("s_acctbal", P.greater_than(1000.0))]).select("s_suppkey", "s_acctbal")


@register("stored_min_max", "SELECT count(*) AS count, min(s_suppkey) AS lo, max(s_suppkey) AS hi, min(s_name) AS first_name FROM supplier")
def stored_min_max(spark, sf_dir):
    """COUNT, MIN and MAX of indexed columns, from the manifest."""
    db = Database.temporary(spark)
    db.insert_dataframe("t", read(spark, sf_dir, "supplier"))
    db.create_index("t", "s_suppkey")
    db.create_index("t", "s_name")
    return db.aggregate("t", [], [A.count(), A.min_of("s_suppkey", "lo"), A.max_of("s_suppkey", "hi"), A.min_of("s_name", "first_name")])


def on_database(name: str, table: str, sql: str, plan: Callable[[Database], DataFrame]) -> None:
    """A query through the direct API, over a registered table ``t``."""

    def run(spark, sf_dir):
        db = Database.temporary(spark)
        db.register("t", read(spark, sf_dir, table))
        return plan(db)

    register(name, sql)(run)


on_database("index_equality", "orders", "SELECT * FROM orders WHERE o_custkey = 42", lambda db: db.search("t", "o_custkey", 42))
on_database("index_range", "orders", "SELECT * FROM orders WHERE o_orderkey BETWEEN 500 AND 700", lambda db: db.range_query("t", "o_orderkey", 500, 700))
on_database("index_greater", "orders", "SELECT * FROM orders WHERE o_totalprice >= 450000", lambda db: db.greater("t", "o_totalprice", 450000.0, inclusive=True))
on_database("index_less", "orders", "SELECT * FROM orders WHERE o_totalprice < 5000", lambda db: db.less("t", "o_totalprice", 5000.0))
on_database("index_prefix", "customer", "SELECT * FROM customer WHERE starts_with(c_name, 'Customer#00000012')", lambda db: db.prefix_search("t", "c_name", "Customer#00000012"))
on_database("index_in", "orders", "SELECT * FROM orders WHERE o_custkey IN (1, 3, 5)", lambda db: db.search_any("t", "o_custkey", [1, 3, 5]))
on_database("index_intersection", "orders", "SELECT * FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey < 100", lambda db: db.search_all("t", [Filter("o_orderpriority", P.equals("1-URGENT")), Filter("o_custkey", P.less_than(100))]))


@register("sorted_index_round_trip", "SELECT * FROM supplier WHERE s_acctbal BETWEEN 100 AND 5000")
def sorted_index_round_trip(spark, sf_dir):
    """Indexed, changed, rebuilt, saved, opened again and kept in memory."""
    db = Database.temporary(spark)
    db.insert_dataframe("t", read(spark, sf_dir, "supplier"))
    db.create_index("t", "s_acctbal", sort=True)
    db.insert_batch("t", SUPPLIERS)
    db.delete("t", [Filter("s_suppkey", P.greater_or_equal(100001))])
    db.rebuild_index("t", "s_acctbal")
    copy = Database.temporary(spark)
    db.save(copy.data_dir)
    copy.load_to_memory("t")
    return copy.range_query("t", "s_acctbal", 100.0, 5000.0)


on_table(
    "column_stats",
    "lineitem",
    f"SELECT count(*) AS total_entries, count(DISTINCT n) + max(CASE WHEN n IS NULL THEN 1 ELSE 0 END) AS cardinality, count(*) FILTER (WHERE n IS NULL) AS n_nulls, min(n) AS min_value, max(n) AS max_value FROM ({NULLABLE})",
    lambda df: column_statistics(nullable(df), "n"),
)


@register("revenue_by_segment", "SELECT c_mktsegment, count(*) AS count, CAST(sum(l_linenumber) AS BIGINT) AS lines, max(l_shipdate) AS last_ship FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE l_discount BETWEEN 0.02 AND 0.06 GROUP BY c_mktsegment")
def revenue_by_segment(spark, sf_dir):
    """The flagship: filters, a three-way join and grouping in one plan."""
    customer, orders, lineitem = join_frames(spark, sf_dir, "customer", "orders", "lineitem")
    chain = JoinChain.of(lineitem, "l", [Filter("l_discount", P.between(0.02, 0.06))], P.ANSI).join(orders, "o", "l.l_orderkey", "o.o_orderkey").join(customer, "c", "o.o_custkey", "c.c_custkey")
    grouped = aggregate(chain.joined(), ["c_c_mktsegment"], [A.count(), A.sum_of("l_l_linenumber", "lines"), A.max_of("l_l_shipdate", "last_ship")])
    return grouped.withColumnRenamed("c_c_mktsegment", "c_mktsegment")
