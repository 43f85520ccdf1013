"""Joins on groups where pairs would be far more than rows."""

from pyspark.sql import functions as F

from routeloom.operators import joins


def test_innermost_of_very_many_spans_around_every_point(spark):
    # 30,000 points and 30,000 spans, nearly half of the 900 M pairs meet.
    n = 30_000
    points = spark.range(n).select(F.lit(1).alias("g"), F.col("id"), (F.col("id") * 2).alias("at"))
    spans = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("a"), (2 * n - F.col("id")).alias("b"))
    got = joins.innermost(points, spans, ["g"], "at", "a", "b", 10 * n)
    assert got.where("a <=> least(at, 2 * 30000 - at, 29999) and b <=> 60000 - a").count() == n


def test_innermost_ties_edges_and_nulls(spark):
    points = spark.createDataFrame([("x", 1, 5), ("x", 2, 10), ("x", 3, 11), ("x", 4, 25), ("y", 5, 5), (None, 6, 5), ("x", 7, None), ("x", 7, 5)], "g string, id int, at int")
    spans = spark.createDataFrame([("x", 0, 30), ("x", 5, 10), ("x", 5, 7), ("x", 5, 7), ("x", 9, 8), ("x", 11, None), (None, 0, 9)], "g string, a int, b int")
    got = {(r.id, r.at, r.a, r.b) for r in joins.innermost(points, spans, ["g"], "at", "a", "b", 4).collect()}
    assert got == {(1, 5, 5, 7), (2, 10, 5, 10), (3, 11, 0, 30), (4, 25, 0, 30), (5, 5, None, None), (6, 5, None, None), (7, None, None, None), (7, 5, 5, 7)}


def test_pairs_of_any_of_several_equalities_are_not_gathered(spark):
    left = spark.createDataFrame([(1, 1, None), (2, 2, "k"), (3, None, "k"), (3, None, "k")], "c int, a int, d string")
    right = spark.createDataFrame([(1, 1, "k"), (2, 2, "k")], "s int, x int, z string")
    got = joins.any_of(left, right, [[("a", "x")], [("d", "z")]]).select("c", "s")
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 1), (2, 2), (3, 1), (3, 1), (3, 2), (3, 2)]
    assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_closure_rounds_hold_roots_by_the_word(spark):
    # 1024 roots on a circle of 5 nodes: 5120 pairs, of which 64 roots share a row.
    import glob

    from routeloom.operators.closure import shared_folder, transitive

    folder = shared_folder(spark).removeprefix("file://")
    before = set(glob.glob(f"{folder}/round-*"))
    roots = spark.range(1024).select(F.col("id").alias("root"), F.lit(0).cast("long").alias("node"))
    edges = spark.range(5).select(F.col("id").alias("src"), F.expr("(id + 1) % 5").alias("dst"))
    got = transitive(roots, edges)
    assert got.count() == 5120 and got.where("depth <> node").isEmpty()
    written = sum(spark.read.parquet(f"file://{p}").count() for p in set(glob.glob(f"{folder}/round-*")) - before)
    assert written < 2_000


def test_closure_of_null_roots_nodes_and_ends(spark):
    from routeloom.operators.closure import transitive

    roots = spark.createDataFrame([(None, "a"), (None, "a"), ("x", None), ("y", "c"), ("z", "lone")], "root string, node string")
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", None), ("c", None), (None, "never")], "src string, dst string")
    got = sorted(map(str, map(tuple, transitive(roots, edges).collect())))
    assert got == sorted(map(str, [(None, "a", 0), (None, "b", 1), (None, None, 2), ("x", None, 0), ("y", "c", 0), ("y", None, 1), ("z", "lone", 0)]))


def test_intersections_of_more_rows_take_more_tasks(spark):
    from routeloom.operators.votes import poisoned_intersection

    rows = spark.range(600).select((F.col("id") % 20).alias("k"), (F.col("id") % 3).alias("m"), F.when(F.col("id") != 7, (F.col("id") % 2).cast("string")).alias("v"))
    got = poisoned_intersection(rows, "k", "m", "v", rows_per_task=50)
    assert got.rdd.getNumPartitions() == 13
    assert {tuple(r) for r in got.collect()} == {(k, None if k == 7 else str(k % 2)) for k in range(20)}


def _most_rows(plan):
    """The most rows that an operator of a plan that has run put out."""
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return _most_rows(plan.executedPlan())
    below = [plan.plan()] if plan.getClass().getSimpleName().endswith("QueryStageExec") else [plan.children().apply(k) for k in range(plan.children().size())]
    out = plan.metrics().get("numOutputRows")
    return max([out.get().value() if out.isDefined() else 0, *map(_most_rows, below)])


def test_actions_of_a_base_controller_do_not_meet_all_classes_below_it(spark):
    from routeloom.plans.code_lane import rails

    n = 300
    texts = [("config/routes.rb", "Rails.application.routes.draw do\n" + "".join(f"  get '/{k}', to: 'n{k}#a{k}'\n" for k in range(n)) + "end\n")]
    texts += [("app/controllers/base_controller.rb", "class BaseController\n" + "".join(f"  def a{k}\n  end\n" for k in range(n)) + "end\n")]
    texts += [(f"app/controllers/n{k}_controller.rb", f"class N{k}Controller < BaseController\nend\n") for k in range(n)]
    found, _ = rails(spark.createDataFrame([("r", path, "ruby_on_rails", text) for path, text in texts], "repo string, rel_path string, language string, text string"))
    query = found._jdf.queryExecution()
    assert query.executedPlan().executeCollectPublic() is not None
    assert found.where("rel_path = 'app/controllers/base_controller.rb' and route = concat('/', regexp_extract(name, '[0-9]+$', 0))").count() == n
    assert _most_rows(query.executedPlan()) < 10 * n


def test_references_of_one_small_table_are_read_by_all_cores_and_met_over_rounds(spark, monkeypatch):
    from routeloom.plans import inlining

    tasks, settled = [], inlining.settled

    def counted(df):
        tasks.append(df.rdd.getNumPartitions() if not tasks else None)
        return settled(df)

    monkeypatch.setattr(inlining, "settled", counted)
    rows = [("r", "a", "1"), ("r", "b", '{"$ref": "a"}'), ("r", "c", '[{"$ref": "a"}, {"$ref": "b"}]'), ("r", "d", '[{"$ref": "a"}, {"$ref": "none"}]')]
    got = inlining.inline(spark.createDataFrame(rows, "repo string, key string, body string").coalesce(1)).select("key", "body", "level", "error")
    assert sorted(map(tuple, got.collect())) == [("a", "1", 0, None), ("b", "1", 1, None), ("c", "[1, 1]", 2, None), ("d", None, None, "unresolved")]
    assert tasks[0] == spark.sparkContext.defaultParallelism


def test_pairs_of_a_strongly_connected_graph_are_made_as_they_are_read(spark):
    # 2048 nodes, each of which reaches every other in 11 steps: 4.2 M pairs.
    import glob

    from routeloom.operators.closure import reachable, shared_folder

    folder = shared_folder(spark).removeprefix("file://")
    before = set(glob.glob(f"{folder}/round-*"))
    n = 2048
    ids = spark.range(n)
    edges = ids.select(F.col("id").alias("src"), F.explode(F.array(F.expr(f"2 * id % {n}"), F.expr(f"(2 * id + 1) % {n}"))).alias("dst"))
    got = reachable(ids.select(F.col("id").alias("root"), F.col("id").alias("node")), edges)
    assert got.count() == n * n and got.groupBy("root").agg(F.countDistinct("node").alias("k")).where(f"k <> {n}").isEmpty()
    assert sum(spark.read.parquet(f"file://{p}").count() for p in set(glob.glob(f"{folder}/round-*")) - before) < 60_000


def test_reachable_pairs_of_mixed_graphs(spark):
    """Two strongly connected parts, one leading to the other, tails, ends that are null, roots of several nodes and null: against a plain search."""
    import random

    from routeloom.operators import closure

    r = random.Random(4)
    edges = {(r.randrange(40), r.randrange(40)) for _ in range(90)} | {(r.randrange(100, 140), r.randrange(100, 140)) for _ in range(90)} | {(3, 104), (104, 300), (300, 301), (301, None), (None, 5), (200, 3), (400, 401)}
    edges |= {(500 + k, 501 + k) for k in range(3)}
    roots = [(x, x) for x in (*range(40), *range(100, 140), 200, 300, 400, 500, 502, 999)] + [(7000, 1), (7000, 300), (7000, 500), (None, 104), (8000, None)]
    want = set()
    for root in {a for a, _ in roots}:
        todo = seen = {b for a, b in roots if a == root}
        while todo:
            todo = {d for s, d in edges if s in todo and s is not None} - seen
            seen = seen | todo
        want |= {(root, x) for x in seen}
    roots, edges = spark.createDataFrame(roots, "root long, node long"), spark.createDataFrame(list(edges), "src long, dst long")
    got = [tuple(x) for x in closure.reachable(roots, edges).collect()]
    assert len(got) == len(want) and set(got) == want
