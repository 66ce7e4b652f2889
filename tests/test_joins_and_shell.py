import io

import pytest
from pyspark.sql import SparkSession

from lithograin import Database, Filter, JoinChain, Settings
from lithograin.errors import ColumnNotFound, QueryError
from lithograin.functions import predicates as P
from lithograin.plans.sql import is_complete, order_nulls_as_greatest, split_statements
from lithograin.repl import Shell, format_rows, main


@pytest.fixture(scope="module")
def frames(spark):
    users = spark.createDataFrame([(1, "Alice", 30), (2, "Bob", 25), (3, "Charlie", 35)], "id int, name string, age int")
    posts = spark.createDataFrame([(1, 1, "Post A"), (2, 1, "Post B"), (3, 2, "Post C")], "id int, author_id int, title string")
    comments = spark.createDataFrame([(1, 1, "Nice!"), (2, 1, "Great!"), (3, 3, "Cool!")], "id int, post_id int, text string")
    return users, posts, comments


def test_joins(frames):
    users, posts, comments = frames
    both = JoinChain.of(users, "u").join(posts, "p", "u.id", "p.author_id")
    assert both.execute().count() == 3
    assert JoinChain.of(users, "u").join(posts, "p", "p.author_id", "u.id", "left").execute().count() == 4
    assert JoinChain.of(users, "u").join(posts, "p", "u.id", "author_id", "right").execute().count() == 3
    assert both.join(comments, "c", "p.id", "c.post_id").execute().count() == 3
    older = JoinChain.of(users, "u", [Filter("age", P.greater_than(28))]).join(posts, "p", "u.id", "p.author_id")
    assert older.execute().count() == 2
    assert both.where(Filter("title", P.matches("%B"))).select("name", "u.id").execute().collect() == [("Alice", 1)]
    # A filter on the nullable side applies before the join, so Alice's and Charlie's rows stay unmatched.
    kept = JoinChain.of(users, "u").join(posts, "p", "u.id", "p.author_id", "left", [Filter("title", P.equals("Post C"))])
    assert kept.execute().count() == 3


def test_join_errors(frames):
    users, posts, _ = frames
    chain = JoinChain.of(users, "u").join(posts, "p", "u.id", "p.author_id")
    with pytest.raises(QueryError, match="ambiguous"):
        chain.select("id").execute()
    with pytest.raises(ColumnNotFound):
        chain.select("p.nope").execute()
    with pytest.raises(QueryError, match="taken"):
        chain.join(posts, "p", "u.id", "p.id")
    with pytest.raises(QueryError, match="one column"):
        JoinChain.of(users, "u").join(posts, "p", "u.id", "u.age").execute()


def test_alias_and_column_must_tell_outputs_apart(frames):
    users, posts, _ = frames
    one, two = users.withColumnRenamed("name", "b_c"), posts.withColumnRenamed("title", "c")
    with pytest.raises(QueryError, match="a_b_c"):
        JoinChain.of(one, "a").join(two, "a_b", "a.id", "a_b.author_id").execute()


def test_star_of_a_join_is_qualified(spark, frames):
    db = Database.temporary(spark)
    for name, df in zip(("users", "posts"), frames, strict=False):
        db.register(name, df)
    rows = db.sql("SELECT * FROM users u JOIN posts ON u.id = posts.author_id ORDER BY posts.id LIMIT 1").rows
    assert rows.columns == ["u_id", "u_name", "u_age", "posts_id", "posts_author_id", "posts_title"] and rows.first().posts_title == "Post A"
    assert db.sql("SELECT * FROM users WHERE id IN (SELECT p.author_id FROM posts p JOIN users v ON v.id = p.id)").rows.columns == ["id", "name", "age"]


def test_main_runs_a_script(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(SparkSession.Builder, "getOrCreate", lambda self: spark)
    script, config = tmp_path / "s.sql", tmp_path / "c.json"
    script.write_text("CREATE TABLE t (id INT);\nINSERT INTO t VALUES (1), (2), (3);\nSELECT * FROM t;\nSELECT * FROM t LIMIT 3;\n.save\n")
    config.write_text('{"query": {"default_limit": 2, "max_limit": 10}}')
    assert main([str(script), "--data-dir", f"file://{tmp_path}/db", "--config", str(config)]) == 0
    said = capsys.readouterr().out
    assert "first 2 rows" in said and "3 row(s)" in said and "saved" in said
    assert main([str(script), "--memory"]) == 0 and "needs a folder" in capsys.readouterr().out
    script.write_text("SELECT nope FROM t;")
    assert main([str(script), "--data-dir", f"file://{tmp_path}/db"]) == 1


def test_history_is_kept(spark, tmp_path):
    readline = pytest.importorskip("readline")
    settings = Settings.from_dict({"repl": {"history_file": str(tmp_path / "h"), "max_history_size": 2}})
    shell = Shell(Database(spark, ":memory:", settings), io.StringIO())
    readline.clear_history()

    def read(prompt, lines=iter(["SHOW TABLES;", ".tables", ".quit"])):
        line = next(lines)
        readline.add_history(line)
        return line

    shell.loop(read, remember=True)
    assert (tmp_path / "h").read_text().split("\n")[-3:] == [".tables", ".quit", ""]


def test_statements():
    assert split_statements("a 'x;y' ; /* ; */ b -- ;\n;") == ["a 'x;y'", "/* ; */ b -- ;"]
    assert is_complete("select 1;") and not is_complete("select ';") and not is_complete("select 1")
    assert order_nulls_as_greatest("select * from t order by a, f(b, c) desc limit 3") == "select * from t order by a NULLS LAST, f(b, c) desc NULLS FIRST limit 3"
    assert order_nulls_as_greatest("select x from t order by a nulls first") == "select x from t order by a nulls first"


def test_format():
    text = format_rows(["a", "b"], [(1, None), (2.345, "x" * 60)])
    assert "NULL" in text and "2.35" in text.replace("2.34", "2.35") and "x" * 47 + "..." in text


def test_shell(spark):
    out = io.StringIO()
    shell = Shell(Database.temporary(spark), out)
    assert shell.run_script("CREATE TABLE t (id INT, name VARCHAR);\nINSERT INTO t VALUES (1, 'a');\n.tables\n.schema t\n.stats t\nSELECT * FROM t;\n")
    assert not shell.run_statement("SELECT * FROM missing")
    lines = iter(["SELECT id", "FROM t;", ".bad", ".help", ".exit"])
    shell.loop(lambda prompt: next(lines))
    said = out.getvalue()
    assert "| 1  | a    |" in said and "| id " in said and "unknown command .bad" in said and "Error: " in said
