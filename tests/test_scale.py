"""Two-level group operators and spatial joins against brute force, with one group holding most rows."""
import random
import re

from pyspark.sql import Window, functions as F

from adlattice.operators import scale as S


def skewed(spark, n=600, seed=1):
    r = random.Random(seed)
    rows = [("hot" if r.random() < 0.6 else f"k{r.randrange(9)}", i * 3 + r.randrange(3), r.randrange(50)) for i in range(n)]
    return spark.createDataFrame(rows, "k string, o int, v int")


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_number_rows_equals_window(spark):
    df = skewed(spark)
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("o")))
    same(S.number_rows(df, ["k"], "o", "n", width=16).select("k", "o", "v", "n"), want)


def test_previous_row_equals_lag(spark):
    df = skewed(spark)
    want = df.withColumn("p", F.lag("v").over(Window.partitionBy("k").orderBy("o")))
    same(S.previous_row(df, ["k"], "o", ["v"], "p", width=16).select("k", "o", "v", F.col("p.v").alias("p")), want)


def test_running_max_equals_window(spark):
    df = skewed(spark)
    for current, end in ((False, -1), (True, 0)):
        w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, end)
        got = S.running_max(df, ["k"], "o", F.col("v"), "m", include_current=current, width=16)
        same(got.select("k", "o", "v", "m"), df.withColumn("m", F.max("v").over(w)))


def test_no_window_over_a_whole_group(spark):
    """Every ordered window below is over (key, chunk) rows or over one summary row per chunk."""
    plan = S.number_rows(skewed(spark), ["k"], "o", "n", width=16)._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window" in line and "row_number" in line:
            assert "__chunk" in line


def test_overlap_pairs_once_each(spark):
    r = random.Random(5)
    boxes = [(f"i{r.randrange(3)}", i, x, y, x + r.randrange(1, 300), y + r.randrange(1, 300)) for i in range(120) for x, y in [(r.randrange(-50, 600), r.randrange(-50, 600))]]
    left = spark.createDataFrame(boxes, "k string, a int, lx1 int, ly1 int, lx2 int, ly2 int")
    right = spark.createDataFrame(boxes, "k string, b int, rx1 int, ry1 int, rx2 int, ry2 int")
    got = S.overlap_pairs(left, right, ["k"], cell=64, self_order=("a", "b")).select("a", "b").collect()
    want = {(p[1], q[1]) for p in boxes for q in boxes if p[1] < q[1] and p[0] == q[0]
            and min(p[4], q[4]) > max(p[2], q[2]) and min(p[5], q[5]) > max(p[3], q[3])}
    assert len(got) == len(want) and {tuple(g) for g in got} == want


def test_overlap_join_has_an_equi_key(spark):
    b = spark.createDataFrame([("k", 1, 0, 0, 9, 9)], "k string, a int, lx1 int, ly1 int, lx2 int, ly2 int")
    c = b.selectExpr("k", "a AS b", "lx1 AS rx1", "ly1 AS ry1", "lx2 AS rx2", "ly2 AS ry2")
    plan = S.overlap_pairs(b, c, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_boxes_of_every_size_meet_in_few_cells(spark):
    r = random.Random(6)
    sizes = [3, 20, 64, 65, 256, 300, 1024, 1025, 5000, 60_000]
    boxes = [("a" if r.random() < 0.7 else "b", i, x, y, x + r.choice(sizes), y + r.choice(sizes)) for i in range(150) for x, y in [(r.randrange(-3000, 9000), r.randrange(-3000, 9000))]]
    boxes.append(("a", 999, 0, 0, 60_000, 60_000))
    left = spark.createDataFrame(boxes, "k string, a int, lx1 int, ly1 int, lx2 int, ly2 int")
    right = spark.createDataFrame(boxes, "k string, b int, rx1 int, ry1 int, rx2 int, ry2 int")
    got = S.overlap_pairs(left, right, ["k"], cell=64).select("a", "b").collect()
    want = {(p[1], q[1]) for p in boxes for q in boxes if p[0] == q[0] and min(p[4], q[4]) > max(p[2], q[2]) and min(p[5], q[5]) > max(p[3], q[3])}
    assert len(got) == len(want) and {tuple(g) for g in got} == want


def test_a_huge_box_makes_few_rows(spark):
    """Counted where the rows are made: the generators of the plan."""
    one = spark.createDataFrame([("k", 1, 7, 7, 60_007, 60_007)], "k string, a int, lx1 int, ly1 int, lx2 int, ly2 int")
    small = spark.createDataFrame([("k", i, i, i, i + 5, i + 5) for i in range(10)], "k string, b int, rx1 int, ry1 int, rx2 int, ry2 int")
    pairs = S.overlap_pairs(one, small, ["k"], cell=64)
    assert pairs.count() == 7
    made, todo = [], [pairs._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        node = node.executedPlan() if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else node.plan() if "QueryStage" in node.getClass().getSimpleName() else node
        if node.getClass().getSimpleName() == "GenerateExec":
            made.append(node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert sum(made) < 100


def test_pages_of_any_depth(spark):
    from adlattice.operators import jobs as J
    r = random.Random(7)
    rows = [(i if i < 380 else i - 20, r.choice(["a", "b", "", None, "zz", "é"]), i % 7) for i in range(400)]  # some ids twice
    jobs = spark.createDataFrame(rows, "job_id long, campaign string, n int").repartition(5)
    for descending in (True, False):
        want = sorted(((c or ""), i) for i, c, _ in rows)
        if descending:
            want.sort(key=lambda x: x[1])
            want.sort(key=lambda x: x[0], reverse=True)
        for number, size in ((1, 10), (3, 20), (20, 20), (21, 20), (2, 390), (1, 1000), (400, 1)):
            got = [(x.campaign or "", x.job_id) for x in J.page(jobs, "campaign", number, size, descending, at_once=30).collect()]
            assert got == want[(number - 1) * size:number * size]
    assert J.page(jobs.limit(0), "campaign", 1, 10).count() == 0


def test_a_deep_page_sorts_few_rows(spark):
    from adlattice.operators import jobs as J
    jobs = spark.range(20_000).selectExpr("id AS job_id", "CAST(id % 3 AS string) AS campaign")
    got = J.page(jobs, "campaign", 300, 50, False, at_once=500)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    offset = int(re.search(r"Offset (\d+)", plan)[1]) if "Offset" in plan else 0
    assert offset < 600 and [x.job_id for x in got.collect()] == [3 * (300 * 50 - 50 - 6667 - 6667 + k) + 2 for k in range(50)]


def test_shuffles_grow_with_the_table(spark, tmp_path):
    """A task's share of a table stays what it is, however large the table; finer settings of the user's stay as well."""
    from adlattice import session
    from adlattice.plans.fixtures import Tables
    spark.range(1_200_000).selectExpr("id AS l_orderkey", "xxhash64(id) AS l_partkey").coalesce(2).write.parquet(f"{tmp_path}/lineitem.parquet")
    mine = spark.newSession()
    mine.conf.set("spark.sql.shuffle.partitions", "2")
    size = sum(p.stat().st_size for p in (tmp_path / "lineitem.parquet").iterdir())
    least = size // session.SHARE_BYTES
    assert least > 2
    Tables(mine, str(tmp_path)).lineitem
    assert int(mine.conf.get("spark.sql.shuffle.partitions")) >= least
    assert [mine.conf.get(k) for k in session.TASK_BYTES] == [finer for _, finer in session.TASK_BYTES.values()]
    mine.conf.set("spark.sql.shuffle.partitions", "5000")
    mine.conf.set("spark.sql.files.maxPartitionBytes", "1MB")
    Tables(mine, str(tmp_path)).lineitem
    assert (mine.conf.get("spark.sql.shuffle.partitions"), mine.conf.get("spark.sql.files.maxPartitionBytes")) == ("5000", "1MB")
