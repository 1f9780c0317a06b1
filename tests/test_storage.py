"""Files, stores and streams."""

import json
import os

from pyspark.sql import functions as F
from trajgraph.operators.rollups import parse_progress, successful_tasks
from trajgraph.sources import episodes as EP
from trajgraph.sources import logs, samples, tables
from trajgraph.sources import trajectories as TR
from trajgraph.streaming import jobs as X


def put(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(data if isinstance(data, str) else json.dumps(data))


def test_trajectory_folders(spark, tmp_path, as_rows):
    root = tmp_path / "traj"
    step = lambda n: [{"step_no": i, "action": f"a{i}"} for i in range(n)]
    put(root / "pkg" / "T1" / "one.json", step(1))
    put(root / "pkg" / "T1" / "b" / "one.json", step(2))
    put(root / "pkg" / "T1" / "b" / "two.json", step(5))
    put(root / "pkg" / "T2" / "one.json", step(3))
    got = TR.read_trajectories(spark, str(root), "step_no int, action string")
    rows = as_rows(got.groupBy("package", "task", "branch_path", "depth", "is_leaf").count())
    assert rows == [("pkg", "T1", "", 0, False, 1), ("pkg", "T1", "b", 1, True, 2), ("pkg", "T2", "", 0, True, 3)]


def test_only_chosen_files_are_opened(spark, tmp_path, as_rows):
    root = tmp_path / "data"
    step = lambda n: [{"step_no": i} for i in range(n)]
    put(root / "pkg" / "T 1" / "first.json", step(1))
    put(root / "pkg" / "T 1" / "second.json", "x" * 100_000)
    put(root / "pkg" / "T[2]" / "a{b}.json", step(2))
    put(root / "pkg" / "T[2]" / "sub*" / "only.json", step(3))
    put(root / "other" / "T3" / "only.json", step(4))
    got = TR.read_trajectories(spark, str(root), "step_no int")
    assert as_rows(got.groupBy("task", "branch_path", "is_leaf").count()) == [
        ("T 1", "", True, 1), ("T3", "", True, 4), ("T[2]", "", False, 2), ("T[2]", "sub*", True, 3)
    ]
    read = TR.read_files(spark, TR.first_files(TR.listing(spark, str(root))))
    assert len(read.inputFiles()) == 4 and not any("second" in f for f in read.inputFiles())
    some = TR.read_trajectories(spark, str(root), "step_no int", where=(F.col("package") == "pkg") & F.col("is_leaf"))
    assert as_rows(some.groupBy("task", "branch_path").count()) == [("T 1", "", 1), ("T[2]", "sub*", 3)]
    assert TR.read_trajectories(spark, str(root), "step_no int", where=F.col("package") == "none").count() == 0


def test_progress_log(spark, tmp_path, as_rows):
    put(
        tmp_path / "suite.log",
        "[t] DONE  Task_A_0 | score=0.5 | x\n[t] DONE  Task_A_1 | score=1.0 | x\n[t] ERROR Task_B_0 | error=e\nother\n"
        "[t] DONE  Task_B_1 | score=0.0 | x\n[t] SKIP  Task_C_0 | reason: no\n",
    )
    parsed = logs.read_progress_log(spark, str(tmp_path / "suite.log"))
    assert parsed.count() == 5
    assert as_rows(successful_tasks(parsed)) == [("Task_A", True), ("Task_B", False)]


def test_token_log(spark, tmp_path):
    rows = spark.createDataFrame([("t", "p", "k", "s", 1, 2, 0.5)], logs.TOKEN_SCHEMA)
    for _ in range(2):
        logs.append_token_log(rows, str(tmp_path / "log"))
    assert logs.read_token_log(spark, str(tmp_path / "log")).count() == 2


def test_episode_store(spark, tmp_path, as_rows):
    path = str(tmp_path / "eps")
    save = lambda rows: EP.save_episodes(spark.createDataFrame(rows, "instance_name string, v int"), path)
    save([("T_10", 1), ("T_2", 1), ("A", 1)])
    save([("T_2", 9)])
    assert as_rows(EP.load_episodes(spark, path)) == [("A", 1), ("T_10", 1), ("T_2", 9)]
    ordered = EP.load_episodes(spark, path, ["instance_name"]).orderBy(*EP.natural_order("instance_name"))
    assert [r[0] for r in ordered.collect()] == ["A", "T_2", "T_10"]
    bucket = next(d for d in os.listdir(path) if d.startswith("bucket="))
    put(os.path.join(path, bucket, "part-broken.parquet"), "not parquet")
    assert EP.load_episodes(spark, path).count() == 3
    assert [r[0].rsplit("/", 1)[1] for r in EP.rejected_files(spark, path).collect()] == ["part-broken.parquet"]
    rows, counts = EP.load_counted(spark, path, ["v"])
    n_files = sum(f.endswith(".parquet") for _, _, names in os.walk(path) for f in names)
    assert sorted(r.v for r in rows.collect()) == [1, 1, 9] and [tuple(r) for r in counts.collect()] == [(n_files, 1)]


def test_gold_success_words(spark, tmp_path, as_rows):
    put(tmp_path / "gold.json", [{"task": str(i), "success": s} for i, s in enumerate([None, "Yes", " true ", "1", "no", "0", "1.0"])])
    kept = samples.read_gold(spark, str(tmp_path / "gold.json"), "task string, success string")
    assert [r[0] for r in as_rows(kept, "task")] == ["0", "1", "2", "3", "6"]


def test_insert_and_truncate(spark, tmp_path, as_rows):
    path = str(tmp_path / "table")
    schema = "id long, name string"
    tables.insert_rows(spark.createDataFrame([], schema), spark.createDataFrame([(-1, "b"), (-1, "a")], schema), "id", ["name"], path)
    tables.insert_rows(spark.read.parquet(path), spark.createDataFrame([(-1, "c")], schema), "id", ["name"], path)
    assert as_rows(tables.read_app_table(spark, path, schema)) == [(1, "a"), (2, "b"), (3, "c")]
    tables.truncate(spark.read.parquet(path), path)
    assert spark.read.parquet(path).count() == 0 and spark.read.parquet(path).columns == ["id", "name"]
    assert not tables.table_exists(spark, "no_such_table")


def stream_of(spark, tmp_path, batches, schema):
    """A file stream with one file, so one micro-batch, per element of ``batches``."""
    folder = tmp_path / "in"
    for i, rows in enumerate(batches):
        put(folder / f"{i:03d}.json", "\n".join(json.dumps(r) for r in rows))
        os.utime(folder / f"{i:03d}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def test_walk_carries_state_between_batches(spark, tmp_path, as_rows):
    row = lambda t, p: {"task": "t", "branch": "b", "ts": f"2024-01-01T00:{t:02d}:00Z", "page": p}
    stream = stream_of(
        spark, tmp_path, [[row(2, "b"), row(1, "a")], [row(3, "c"), row(0, "late")], [row(4, "d")]],
        "task string, branch string, ts timestamp, page string",
    )
    out = X.run_available(X.walk_sessions(stream), "walk-test")
    assert as_rows(out.filter("not late").select("step", "src", "tgt")) == [(0, "a", "b"), (1, "b", "c"), (2, "c", "d")]
    assert as_rows(out.filter("late").select("tgt")) == [("late",)]


def test_fold_is_idempotent(spark, tmp_path, as_rows):
    root = str(tmp_path / "graph")
    body = X.fold_tables(root, X.graph_shapes())
    shape = "task string, step long, src string, elem string, tgt string, goal string"
    batch = spark.createDataFrame([("t", 0, "a", "e", "b", "g"), ("t", 0, "a", "e", "b", "g"), ("t", 1, "b", "f", "c", "g")], shape)
    for i in (0, 0, 1):
        body(batch, i)
    body(spark.createDataFrame([("u", 0, "c", "h", "a", "k"), ("t", 0, "a", "e", "b", "g")], shape), 2)
    table = lambda name: as_rows(spark.read.parquet(f"{root}/{name}").drop("bucket"))
    assert table("edges") == [("a", "e", "b"), ("b", "f", "c"), ("c", "h", "a")]
    assert table("pages") == [("a",), ("b",), ("c",)]
    assert table("page_steps") == [("a", "t", 0), ("a", "u", 1), ("b", "t", 1), ("c", "t", 2), ("c", "u", 0)]
    assert table("page_goals") == [("a", "g"), ("a", "k"), ("b", "g"), ("c", "g"), ("c", "k")]


def test_stream_counters_equal_batch(spark, tmp_path, as_rows):
    lines = [[{"value": f"[t] DONE  T{i % 2}_{i} | score={i % 3 / 2} | x"}, {"value": f"[t] ERROR T0_{i} | x"}] for i in range(4)]
    stream = stream_of(spark, tmp_path, lines, "value string")
    got = as_rows(X.run_available(X.progress_counts(stream, ["task"]), "progress-test", mode="complete"))
    batch = spark.createDataFrame([(r["value"],) for b in lines for r in b], "value string")
    want = as_rows(X.progress_counts(batch, ["task"]))
    assert got == want and parse_progress(batch).count() == 8


def test_late_tokens_are_dropped(spark, tmp_path, as_rows):
    row = lambda h, n: {"package": "p", "ts": f"2024-01-01T{h:02d}:30:00Z", "prompt_tokens": n, "completion_tokens": 0}
    stream = stream_of(
        spark, tmp_path, [[row(1, 1)], [row(9, 2)], [row(12, 4)], [row(1, 100)], [row(20, 8)]],
        "package string, ts timestamp, prompt_tokens long, completion_tokens long",
    )
    out = X.run_available(X.token_windows(stream), "token-test").orderBy("start")
    assert [(r.start.hour, r.prompt_tokens) for r in out.collect()][:3] == [(1, 1), (9, 2), (12, 4)]


def test_repeated_episodes(spark, tmp_path, as_rows):
    row = lambda i, d, f=False: {"instance_name": i, "finish_dtime": f"2024-01-{d:02d}T00:00:00Z", "failed": f}
    # The first run of "a" failed, so the second one counts; "c" only failed.
    stream = stream_of(
        spark, tmp_path, [[row("a", 1, True), row("c", 1, True)], [row("a", 2), row("b", 2)], [row("a", 3), row("c", 3, True)]],
        "instance_name string, finish_dtime timestamp, failed boolean",
    )
    assert as_rows(X.run_available(X.first_episodes(stream), "episode-test").select("instance_name")) == [("a",), ("b",)]


def test_partitions_do_not_matter(spark, sf, as_rows):
    from trajgraph.operators import mining as M
    from trajgraph.plans import adapters as A

    chains = A.tokens(spark, sf)
    one = M.mine_sequences(chains.coalesce(1), 3, 2)[0]
    many = M.mine_sequences(chains.repartition(13, F.rand(1)), 3, 2)[0]
    assert as_rows(one) == as_rows(many)


def test_walk_keeps_one_state_for_the_trajectories_of_a_task(spark, tmp_path, as_rows):
    row = lambda task, b, at, p: {"task": task, "branch": b, "ts": f"2024-01-01T{at}:00Z", "page": p}
    stream = stream_of(
        spark, tmp_path,
        [[row("t", f"b{i}", f"00:{10 + i}", f"p{i}") for i in range(9)] + [row("u", "b0", "00:05", "q")],
         [row("t", "b0", "00:50", "x"), row("t", "b1", "00:01", "old"), row("u", "b0", "05:00", "r")],
         [row("u", "b0", "05:01", "s")],
         [row("t", "b2", "04:30", "y")],
         [row("t", "b2", "04:40", "z")]],
        "task string, branch string, ts timestamp, page string",
    )
    query = X.walk_sessions(stream).writeStream.format("memory").queryName("walks").outputMode("append")
    query = query.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = as_rows(spark.table("walks"), "task", "branch", "step", "src", "tgt", "late")
    assert ("t", "b0", 0, "p0", "x", False) in got and ("t", "b1", None, None, "old", True) in got
    # What was seen of b2 expired in the third batch, so its walk starts anew; u went on all the time.
    assert [r for r in got if r[1] == "b2"] == [("t", "b2", 0, "y", "z", False)]
    assert [r[2:5] for r in got if r[0] == "u"] == [(0, "q", "r"), (1, "r", "s")] and len(got) == 5
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) == 2
