"""Source and sink queries: rows go to storage and back, or scans run over listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.udfs import embed, phash, phash_image
from ..operators import gold as GP
from ..operators import screens as S
from ..plans import adapters as A
from ..plans.adapters import with_ctes
from ..plans.checkpoints import scratch
from ..sources import episodes as EP
from ..sources import samples as SM
from ..sources import tables as TB
from ..sources import trajectories as TR
from .registry import query
from .retrieval import EMBED, four_digits

LISTING = """
files AS (
  SELECT '/data/' || event_type || '/u' || user_id || CASE WHEN k % 10 = 0 THEN '' ELSE '/' || strftime(ts, '%Y-%m-%d') END AS folder,
         lpad(CAST(event_id AS VARCHAR), 9, '0') AS name FROM ev)"""


def _listing(spark, sf):
    ev = A._events(spark, sf)
    folder = F.concat(
        F.lit("/data/"), "event_type", F.lit("/u"), F.col("user_id").cast("string"),
        F.when(F.col("k") % 10 == 0, "").otherwise(F.concat(F.lit("/"), F.date_format("ts", "yyyy-MM-dd"))),
    )
    path = F.concat(folder, F.lit("/"), F.lpad(F.col("event_id").cast("string"), 9, "0"), F.lit(".json"))
    return ev.select(path.alias("path")).withColumn("folder", TR.folder_of(F.col("path")))


@query(
    "S01_trajectory_scan",
    with_ctes(
        "ev",
        """SELECT folder, folder || '/' || min(name) || '.json' AS path, string_split(folder, '/')[3] AS package,
                  string_split(folder, '/')[4] AS task, coalesce(string_split(folder, '/')[5], '') AS branch_path,
                  len(string_split(folder, '/')) - 4 AS depth FROM files GROUP BY folder""",
        extra=LISTING,
    ),
)
def _(spark, sf):
    out = TR.place(TR.first_files(_listing(spark, sf)), "data")
    return out.withColumn("depth", F.col("depth").cast("long"))


# Trajectories written as folders: a package per event type, ten tasks, a branch per month (nested below the
# first one), and a second file in each folder that must not be read.
SCAN = """
put AS (
  SELECT event_type AS package, 't' || (user_id % 10) AS task,
         CASE WHEN month(ts) % 3 = 0 THEN '' WHEN month(ts) % 3 = 1 THEN 'a' ELSE 'a/b' END AS branch_path, event_id, ts, k FROM ev),
filled AS (SELECT *, row_number() OVER (PARTITION BY package, task, branch_path ORDER BY ts, event_id) - 1 AS seq FROM put)"""


@query(
    "S01_trajectory_steps",
    with_ctes(
        "ev",
        """SELECT package, task, branch_path, CAST(seq AS INTEGER) AS seq, event_id, k,
                  CASE branch_path WHEN '' THEN 0 WHEN 'a' THEN 1 ELSE 2 END AS depth,
                  NOT EXISTS (SELECT 1 FROM put d WHERE d.package = f.package AND d.task = f.task
                              AND length(d.branch_path) > length(f.branch_path)) AS is_leaf
           FROM filled f""",
        extra=SCAN,
    ),
)
def _(spark, sf):
    month = F.month("ts") % 3
    branch = F.when(month == 0, "").when(month == 1, "a").otherwise("a/b")
    steps = A._events(spark, sf).select(
        F.col("event_type").alias("package"), F.concat(F.lit("t"), (F.col("user_id") % 10).cast("string")).alias("task"),
        branch.alias("branch"), "event_id", "ts", "k",
    )
    ordered = F.sort_array(F.collect_list(F.struct("ts", "event_id", "k")))
    files = steps.groupBy("package", "task", "branch").agg(
        F.to_json(F.transform(ordered, lambda s: F.struct(s["event_id"].alias("event_id"), s["k"].alias("k")))).alias("value")
    )
    root = scratch(spark, "trajectories")
    for part in ("", "a", "a/b"):
        folder = files.filter(F.col("branch") == part).select("package", "task", "value")
        levels = ["package", "task"]
        for name in part.split("/") if part else []:
            folder = folder.withColumn(f"l{name}", F.lit(name))
            levels.append(f"l{name}")
        folder.repartition("package", "task").write.mode("append").partitionBy(*levels).text(root)
    out = TR.read_trajectories(spark, root, "event_id long, k int", glob="*.txt")
    return out.select("package", "task", "branch_path", "seq", "event_id", "k", "depth", "is_leaf")


@query(
    "S02_leaf_folders",
    with_ctes(
        "ev",
        """SELECT DISTINCT folder FROM files f WHERE NOT EXISTS (
             SELECT 1 FROM files g WHERE regexp_replace(g.folder, '/[^/]*$', '') = f.folder)""",
        extra=LISTING,
    ),
)
def _(spark, sf):
    return TR.leaf_folders(_listing(spark, sf))


@query(
    "S19_flat_trajectory_scan",
    with_ctes(
        "ev",
        """SELECT folder, folder || '/' || min(name) || '.json' AS path FROM files
           WHERE len(string_split(folder, '/')) = 4 GROUP BY folder""",
        extra=LISTING,
    ),
)
def _(spark, sf):
    return TR.flat_tasks(TR.place(TR.first_files(_listing(spark, sf)), "data")).filter("is_leaf").select("folder", "path")


@query(
    "S06_gold_tasks_scan",
    "SELECT o_orderkey FROM orders WHERE o_orderpriority <> '5-LOW' AND NOT (o_orderpriority = '3-MEDIUM' AND o_orderstatus <> 'P')",
)
def _(spark, sf):
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    flag = (
        F.when(p == "1-URGENT", F.when(s == "F", " Yes").otherwise("TRUE")).when(p == "2-HIGH", F.when(s == "O", "1").otherwise("success"))
        .when((p == "3-MEDIUM") & (s != "P"), "false").when(p == "5-LOW", "0")
    )
    return A.table(spark, sf, "orders").filter(GP.is_success(flag)).select("o_orderkey")


@query(
    "S06_gold_files",
    "SELECT CAST(o_orderkey AS VARCHAR) AS task, o_orderstatus AS app FROM orders WHERE o_orderpriority <> '5-LOW' AND NOT (o_orderpriority = '3-MEDIUM' AND o_orderstatus <> 'P')",
)
def _(spark, sf):
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    flag = (
        F.when(p == "1-URGENT", F.when(s == "F", " Yes").otherwise("TRUE")).when(p == "2-HIGH", F.when(s == "O", "1").otherwise("success"))
        .when((p == "3-MEDIUM") & (s != "P"), "false").when(p == "5-LOW", "0")
    )
    # A file holds the entries of a thousand keys as one JSON array.
    part = F.floor(F.col("o_orderkey") / 1000).alias("part")
    entry = F.struct(F.col("o_orderkey").cast("string").alias("task"), s.alias("app"), flag.alias("success"))
    files = A.table(spark, sf, "orders").groupBy(part).agg(F.to_json(F.collect_list(entry)).alias("value"))
    folder = scratch(spark, "gold")
    files.repartition("part").write.partitionBy("part").text(folder)
    return SM.read_gold(spark, folder, "task string, app string, success string").select("task", "app")


@query(
    "S08_gold_export",
    with_ctes(
        "edges",
        "SELECT task || '#' || branch || '#' || step AS id, 1 AS n_steps, CAST(k % 2 = 0 AS INT) AS n_action_groups FROM edges",
    ),
)
def _(spark, sf):
    e = A.edges(spark, sf)
    kind = F.when(F.col("k") % 2 == 0, "Action_").otherwise("Element_")
    step = F.array("src", F.concat(F.lit("tap_$"), kind, F.sha2("elem", 256), F.lit("$")), "tgt")
    gold = e.select(F.concat_ws("#", "task", "branch", F.col("step").cast("string")).alias("id"), F.array(step).alias("path"))
    return GP.convert_entries(gold).select("id", "n_steps", "n_action_groups")


@query("S09_paths_json", with_ctes("edges", "SELECT count(*) AS total_chains, count(*) AS rows_read FROM edges"))
def _(spark, sf):
    chains = A.edges(spark, sf).select(F.array("src", "elem", "tgt").alias("chain"))
    folder = scratch(spark, "paths")
    SM.write_paths(chains, folder)
    read = spark.read.schema("chain array<string>").json(folder + "/chains").agg(F.count("chain").alias("rows_read"))
    return spark.read.schema("total_chains long").json(folder + "/total").join(read)


@query(
    "S10_jsonl_append_merge",
    "SELECT o_orderstatus AS status, count(*) AS n, round(avg(o_totalprice), 4) AS mean_label FROM orders GROUP BY 1",
)
def _(spark, sf):
    o = A.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("label"))
    folder = scratch(spark, "samples")
    # Rounds are separate folders, and a round is appended to.
    for status, part in (("F", "/round1"), ("O", "/round1"), ("P", "/round2")):
        SM.append_samples(o.filter(F.col("status") == status), folder + part)
    merged = SM.read_samples(spark, [folder + "/round1", folder + "/round2"], "status string, label double")
    return merged.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("label"), 4).alias("mean_label"))


@query(
    "S11_episode_store",
    with_ctes(
        "episodes",
        """SELECT instance_name, count(*) AS n FROM episodes WHERE exception_info IS NULL OR instance_name NOT IN (
             SELECT instance_name FROM episodes WHERE exception_info IS NULL) GROUP BY 1""",
    ),
)
def _(spark, sf):
    e = A.episodes(spark, sf).select("instance_name", "instance_id", "exception_info")
    folder = scratch(spark, "episodes")
    EP.save_episodes(e.filter("exception_info IS NOT NULL"), folder)
    EP.save_episodes(e.filter("exception_info IS NULL"), folder)
    return EP.load_episodes(spark, folder, ["instance_name"]).groupBy("instance_name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "S12_app_table_scan",
    "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
)
def _(spark, sf):
    folder = scratch(spark, "customer")
    c = A.table(spark, sf, "customer")
    c.write.option("header", "true").csv(folder)
    schema = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    return TB.read_app_table(spark, folder, schema, "csv", header="true")


@query(
    "S13_app_table_insert",
    """SELECT c_custkey AS id, c_name AS name FROM customer
       UNION ALL SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY s_name), s_name FROM supplier""",
)
def _(spark, sf):
    folder = scratch(spark, "insert")
    A.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).write.parquet(folder)
    new = A.table(spark, sf, "supplier").select(F.lit(-1).cast("long").alias("id"), F.col("s_name").alias("name"))
    TB.insert_rows(spark.read.parquet(folder), new, "id", ["name"], folder)
    return spark.read.parquet(folder)


@query("S14_table_truncate", "SELECT c_custkey, c_name FROM customer WHERE FALSE")
def _(spark, sf):
    folder = scratch(spark, "truncate")
    c = A.table(spark, sf, "customer").select("c_custkey", "c_name")
    c.write.parquet(folder)
    TB.truncate(spark.read.parquet(folder), folder)
    return spark.read.parquet(folder)


def _knowledge(spark, sf):
    folder = scratch(spark, "knowledge")
    rows = A.table(spark, sf, "documents").select(
        F.col("lang").alias("package"), F.col("doc_id").alias("idx"), F.create_map(F.lit("source"), "source").alias("attrib"),
        embed(F.col("text")).alias("vec"), F.col("text").alias("info"),
    )
    rows.write.partitionBy("package").parquet(folder)
    return folder


@query(
    "S17_knowledge_scan",
    "SELECT lang AS package, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents GROUP BY 1",
)
def _(spark, sf):
    fused = SM.read_knowledge(spark, _knowledge(spark, sf))
    return fused.groupBy("package").agg(F.count("vec").alias("n"), F.sum(F.length("info")).alias("n_chars"))


@query("S17_knowledge_package", "SELECT doc_id AS idx, source FROM documents WHERE lang = 'fr'")
def _(spark, sf):
    rows = SM.read_knowledge(spark, _knowledge(spark, sf), package="fr")
    return rows.select("idx", F.try_element_at("attrib", F.lit("source")).alias("source"))


@query(
    "S18_ir_task_scan",
    """SELECT 'Task' || o_orderkey AS name, o_custkey % 9 AS complexity, o_orderpriority AS field, 'equal_to' AS operation,
              o_orderstatus AS expected FROM orders""",
)
def _(spark, sf):
    o = A.table(spark, sf, "orders")
    condition = F.struct(F.lit("equal_to").alias("operation"), F.col("o_orderpriority").alias("field"), F.lit("x").alias("value"))
    expectation = F.struct(F.col("o_orderstatus").alias("expected_value"), F.lit("STRING_MATCH").alias("match_type"))
    folder = scratch(spark, "catalogue")
    o.select(
        F.concat(F.lit("Task"), F.col("o_orderkey").cast("string")).alias("name"), F.pmod("o_custkey", F.lit(9)).cast("int").alias("complexity"),
        F.struct(F.array(condition).alias("exclusion_conditions")).alias("relevant_state"),
        F.struct(F.array(expectation).alias("expectations")).alias("success_criteria"),
    ).write.json(folder)
    t = SM.read_ir_tasks(spark, folder)
    return t.select(
        "name", "complexity", F.col("relevant_state.exclusion_conditions")[0]["field"].alias("field"),
        F.col("relevant_state.exclusion_conditions")[0]["operation"].alias("operation"),
        F.col("success_criteria.expectations")[0]["expected_value"].alias("expected"),
    )


# -------------------------------------------------------------- UDF surface (Y)


def page_pixels(n):
    """The raw bytes of a page's digest chain, 32 from each digest, stand for its screenshot."""
    return F.unhex(F.concat(*[F.sha2(F.concat("html", F.lit(str(i))), 256) for i in range(n)]))


def cosine_hash(width: int, height: int, digests: int) -> str:
    """The hash in SQL: cosine sums over x, then over y, their median, and a hex digit for every four comparisons."""
    chain = " || ".join(f"sha256(html || '{i}')" for i in range(digests))
    return f"""
WITH px AS (
  SELECT page_id, i // {width} AS y, i % {width} AS x, CAST('0x' || substr(h, 2 * i + 1, 2) AS INT) AS b
  FROM (SELECT page_id, {chain} AS h FROM pages), (SELECT unnest(range(0, {width * height}))::INT AS i)),
freq AS (SELECT unnest(range(0, 16))::INT AS f),
across AS (SELECT page_id, y, f AS v, sum(b * cos(pi() / {width} * (x + 0.5) * f)) AS s FROM px, freq GROUP BY ALL),
low AS (SELECT page_id, f AS u, v, sum(s * cos(pi() / {height} * (y + 0.5) * f)) AS c FROM across, freq GROUP BY ALL),
bits AS (SELECT page_id, u * 16 + v AS k, c > median(c) OVER (PARTITION BY page_id) AS bit FROM low),
digits AS (SELECT page_id, k // 4 AS k, sum(CAST(bit AS INT) << (3 - k % 4))::INT AS d FROM bits GROUP BY page_id, k // 4)
SELECT page_id, string_agg(substr('0123456789ABCDEF', d + 1, 1), '' ORDER BY k) AS hash FROM digits GROUP BY page_id"""


@query("Y02_phash", cosine_hash(16, 16, 8))
def _(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", phash(page_pixels(8)).alias("hash"))


@query("Y02_phash_wide", cosine_hash(32, 16, 16))
def _(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", phash_image(page_pixels(16), F.lit(32), F.lit(16)).alias("hash"))


@query("Y04_embed", "WITH " + EMBED.strip() + " SELECT doc_id, array_to_string(v, ',') AS v FROM filled")
def _(spark, sf):
    docs = A.table(spark, sf, "documents").filter(F.trim("text") != "")
    return docs.select("doc_id", four_digits(embed(F.col("text"))).alias("v"))


@query(
    "Y08_ui_elements_udtf",
    "SELECT p_partkey, 0 AS idx, p_name AS text, p_size > 25 AS is_clickable FROM part",
)
def _(spark, sf):
    S.register_udtf(spark)
    xml = F.concat(
        F.lit('<hierarchy><node text="'), "p_name", F.lit('" clickable="'), (F.col("p_size") > 25).cast("string"), F.lit('"/></hierarchy>')
    )
    A.table(spark, sf, "part").select("p_partkey", xml.alias("xml")).createOrReplaceTempView("trajgraph_dumps")
    return spark.sql("SELECT d.p_partkey, u.idx, u.text, u.is_clickable FROM trajgraph_dumps d, LATERAL ui_elements(d.xml) u")
