"""Vector retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import cosine, keyword_overlap, l2_normalise
from ..operators import graph as G
from ..operators import vectors as V
from ..plans import adapters as A
from ..plans.adapters import with_ctes
from ..plans.checkpoints import kept
from .registry import query

CENTROIDS = """
centroids AS (
  SELECT namespace AS query_id, namespace, list(m ORDER BY i) AS "values" FROM (
    SELECT namespace, i, avg(v) AS m FROM (
      SELECT namespace, unnest("values"::DOUBLE[]) AS v, unnest(range(1, len("values") + 1)) AS i FROM vectors)
    GROUP BY namespace, i) GROUP BY namespace),
scored AS (
  SELECT c.query_id, v.id, list_cosine_similarity(c."values", v."values"::DOUBLE[]) AS sim
  FROM centroids c JOIN vectors v ON v.namespace = c.namespace)"""


EMBED = """
words AS (
  SELECT doc_id, CAST('0x' || substr(md5(unnest(regexp_extract_all(lower(text), '\\S+'))), 1, 8) AS BIGINT) % 64 AS i FROM documents),
counts AS (SELECT doc_id, i, count(*) AS n FROM words GROUP BY ALL),
filled AS (
  SELECT d.doc_id, list(floor(coalesce(n, 0) / sqrt(t.ss) * 10000 + 0.5)::BIGINT ORDER BY x.i) AS v
  FROM documents d JOIN (SELECT doc_id, sum(n * n) AS ss FROM counts GROUP BY 1) t ON t.doc_id = d.doc_id,
       (SELECT unnest(range(0, 64)) AS i) x LEFT JOIN counts c ON c.doc_id = d.doc_id AND c.i = x.i GROUP BY 1)"""


# The same vectors as the operators see them, in single precision; texts of white space only have none.
TEXT_VECTORS = EMBED + """,
emb AS (
  SELECT d.doc_id AS id, d.lang, d.source, list((coalesce(n, 0) / sqrt(t.ss))::FLOAT::DOUBLE ORDER BY x.i) AS "values"
  FROM documents d JOIN (SELECT doc_id, sum(n * n) AS ss FROM counts GROUP BY 1) t ON t.doc_id = d.doc_id,
       (SELECT unnest(range(0, 64)) AS i) x LEFT JOIN counts c ON c.doc_id = d.doc_id AND c.i = x.i GROUP BY ALL)"""


def text_vectors(spark, sf):
    """Every document with words: id, lang, source, text and the vector of its whole text."""
    from ..functions.udfs import embed

    docs = A.table(spark, sf, "documents").filter(F.trim("text") != "")
    return docs.select(F.col("doc_id").alias("id"), "lang", "source", "text", embed(F.col("text")).alias("values"))


def four_digits(values):
    """A vector as text, each component in whole ten-thousandths."""
    return F.array_join(F.transform(values, lambda x: F.floor(x.cast("double") * 10000 + 0.5).cast("string")), ",")


def centroids(vectors):
    """Mean vector per namespace: one query per namespace, from the whole table."""
    means = (
        vectors.select("namespace", F.posexplode("values").alias("i", "v"))
        .groupBy("namespace", "i")
        .agg(F.avg(F.col("v").cast("double")).alias("m"))
    )
    # Gathers one number per dimension, which is a fixed width.
    return means.groupBy("namespace").agg(
        F.array_sort(F.collect_list(F.struct("i", "m")))["m"].alias("values")
    ).select(F.col("namespace").alias("query_id"), "namespace", "values")


@query(
    "V01_vector_upsert",
    with_ctes(
        "vectors",
        """SELECT namespace, id, version, round(list_sum("values"::DOUBLE[]), 4) AS total FROM (
             SELECT namespace, id, arg_max(version, version) AS version, arg_max("values", version) AS "values"
             FROM (SELECT *, 1 AS version FROM vectors
                   UNION ALL SELECT id, namespace, list_reverse("values"), 2 FROM vectors WHERE "values"[1] > 0)
             GROUP BY namespace, id)""",
    ),
)
def _(spark, sf):
    v = A.vectors(spark, sf).withColumn("version", F.lit(1))
    new = v.filter(F.col("values")[0] > 0).select(
        "id", "namespace", F.reverse("values").alias("values"), F.lit(2).alias("version")
    )
    total = F.aggregate(F.col("values").cast("array<double>"), F.lit(0.0), lambda s, x: s + x)
    return V.upsert(v, new).select("namespace", "id", "version", F.round(total, 4).alias("total"))


TOPK = """SELECT query_id, id, round(sim, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM scored
  WHERE {where}) WHERE rank <= {k}"""


@query("V02_topk_cosine", with_ctes("vectors", TOPK.format(where="TRUE", k=5), extra=CENTROIDS))
def _(spark, sf):
    v = A.vectors(spark, sf)
    return V.topk(v, centroids(v), k=5).withColumn("score", F.round("score", 6))


@query(
    "V02_topk_no_match",
    with_ctes(
        "vectors",
        """SELECT c.query_id, coalesce(t.id, -1) AS id, coalesce(round(t.sim, 6), -1.0) AS score,
                  coalesce(t.rank, 1) AS rank
           FROM centroids c LEFT JOIN (
             SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM scored
             WHERE sim >= 0.45) t ON t.query_id = c.query_id AND t.rank <= 3""",
        extra=CENTROIDS,
    ),
)
def _(spark, sf):
    v = A.vectors(spark, sf)
    q = centroids(v)
    return V.topk_or_none(q, V.topk(v, q, k=3, threshold=0.45)).withColumn("score", F.round("score", 6))


@query("V04_threshold_search", with_ctes("vectors", TOPK.format(where="sim >= 0.2", k=10), extra=CENTROIDS))
def _(spark, sf):
    v = A.vectors(spark, sf)
    return V.topk(v, centroids(v), k=10, threshold=0.2).withColumn("score", F.round("score", 6))


@query(
    "V02_topk_blocked",
    with_ctes(
        "vectors",
        """SELECT query_id, id, round(sim, 6) AS score, rank FROM (
             SELECT q.id AS query_id, v.id, list_cosine_similarity(q."values"::DOUBLE[], v."values"::DOUBLE[]) AS sim,
                    row_number() OVER (PARTITION BY q.id ORDER BY
                      list_cosine_similarity(q."values"::DOUBLE[], v."values"::DOUBLE[]) DESC, v.id) AS rank
             FROM vectors q JOIN vectors v ON v.namespace = q.namespace) WHERE rank <= 3""",
    ),
)
def _(spark, sf):
    v = A.vectors(spark, sf)
    q = v.withColumnRenamed("id", "query_id")
    return V.topk(v, q, k=3, max_broadcast_bytes=0, block_rows=256).withColumn("score", F.round("score", 6))


@query(
    "V03_vector_stats",
    with_ctes("vectors", "SELECT namespace, count(*) AS n FROM vectors GROUP BY namespace"),
)
def _(spark, sf):
    return A.vectors(spark, sf).groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))


@query(
    "V03_vector_fetch",
    with_ctes("vectors", "SELECT id, namespace FROM vectors WHERE id IN (SELECT doc_id FROM labels)"),
)
def _(spark, sf):
    ids = A.table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return A.vectors(spark, sf).join(ids, "id", "left_semi").select("id", "namespace")


@query(
    "V03_vector_delete",
    with_ctes("vectors", "SELECT id, namespace FROM vectors WHERE id NOT IN (SELECT doc_id FROM labels)"),
)
def _(spark, sf):
    ids = A.table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return A.vectors(spark, sf).join(ids, "id", "left_anti").select("id", "namespace")


@query(
    "V05_knowledge_search",
    "WITH " + TEXT_VECTORS.strip() + """,
       vectors AS (SELECT id, lang AS namespace, "values" FROM emb),""" + CENTROIDS + """
       SELECT t.query_id, t.id, round(t.sim, 6) AS score, t.rank, d.text AS info FROM (
         SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 12) DESC, id) AS rank FROM scored WHERE sim >= 0.1) t
       JOIN documents d ON d.doc_id = t.id WHERE rank <= 5""",
)
def _(spark, sf):
    rows = kept(text_vectors(spark, sf), "text-vectors")
    store = rows.select("id", F.col("lang").alias("namespace"), "values", F.col("text").alias("info"))
    return V.knowledge_search(store, centroids(store), k=5, threshold=0.1).withColumn("score", F.round("score", 6))


@query(
    "V05b_knowledge_append",
    with_ctes(
        "vectors",
        """SELECT namespace, id, array_to_string([floor(x::DOUBLE * 10000 + 0.5)::BIGINT FOR x IN "values"], ',') AS v FROM vectors
           UNION ALL SELECT 'pkg_' || lang, doc_id, array_to_string(v, ',') FROM filled JOIN documents USING (doc_id)""",
        extra=EMBED,
    ),
)
def _(spark, sf):
    from ..functions.udfs import embed

    old = A.vectors(spark, sf).withColumn("version", F.lit(1))
    new = A.table(spark, sf, "documents").filter(F.trim("text") != "").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("pkg_"), "lang").alias("namespace"),
        embed(F.col("text")).alias("values"), F.lit(1).alias("version"),
    )
    return V.upsert(old, new).select("namespace", "id", four_digits(F.col("values")).alias("v"))


# Graded documents are the store; the others come in as items, a trajectory for each source. What is said about an item is its source and
# language.
MERGE = """WITH RECURSIVE """ + TEXT_VECTORS.strip() + """,
said_words AS (
  SELECT source, lang, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS i, count(*) AS n
  FROM (SELECT DISTINCT source, lang, unnest(string_split(source || ' ' || lang, ' ')) AS w FROM documents) GROUP BY ALL),
said AS (
  SELECT k.source, k.lang, list(coalesce(w.n, 0)::DOUBLE ORDER BY x.i) AS t
  FROM (SELECT DISTINCT source, lang FROM documents) k CROSS JOIN (SELECT unnest(range(0, 64)) AS i) x
  LEFT JOIN said_words w ON w.source = k.source AND w.lang = k.lang AND w.i = x.i GROUP BY k.source, k.lang),
both_sides AS (
  SELECT e.*, s.t, lang || '/' || lpad(id::VARCHAR, 20, '0') AS key, id IN (SELECT doc_id FROM labels) AS stored
  FROM emb e JOIN said s USING (source, lang)),
items AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY id) AS rn FROM both_sides WHERE NOT stored),
near AS (
  SELECT b.id, list(a.id) AS earlier FROM items a JOIN items b ON a.source = b.source AND a.id < b.id
  WHERE list_cosine_similarity(a."values", b."values") >= 0.99 GROUP BY b.id),
scan AS (
  SELECT DISTINCT source, 0::BIGINT AS rn, []::BIGINT[] AS taken FROM items
  UNION ALL
  SELECT s.source, i.rn, CASE WHEN list_has_any(coalesce(n.earlier, []), s.taken) THEN s.taken ELSE list_append(s.taken, i.id) END
  FROM scan s JOIN items i ON i.source = s.source AND i.rn = s.rn + 1 LEFT JOIN near n ON n.id = i.id),
taken AS (SELECT unnest(arg_max(taken, rn)) AS id FROM scan GROUP BY source),
hits AS (
  SELECT i.id, s.id AS stored_id, list_cosine_similarity(i.t, s.t) AS said,
    row_number() OVER (PARTITION BY i.id ORDER BY round(list_cosine_similarity(i."values", s."values"), 12) DESC, s.key) AS rank
  FROM items i JOIN taken USING (id) JOIN both_sides s ON s.stored AND list_cosine_similarity(i."values", s."values") >= 0.99)
SELECT i.id, stored_id, CASE WHEN stored_id IS NULL THEN 'new' WHEN said <= 0.1 THEN 'append' ELSE 'known' END AS outcome
FROM taken i LEFT JOIN hits h ON h.id = i.id AND h.rank = 1"""


@query("V06_knowledge_merge", MERGE)
def _(spark, sf):
    from ..functions.udfs import embed

    rows = text_vectors(spark, sf).withColumn("text_values", embed(F.concat_ws(" ", "source", "lang")))
    rows = kept(rows.withColumnRenamed("text", "info"), "text-vectors")
    graded = A.table(spark, sf, "labels").select(F.col("doc_id").alias("id")).distinct()
    stored = rows.join(graded, "id", "left_semi").withColumnRenamed("lang", "namespace")
    fresh = rows.join(graded, "id", "left_anti").withColumnRenamed("source", "trajectory")
    return V.knowledge_merge(fresh, stored).select("id", "stored_id", "outcome")


@query(
    "J16_document_pairs",
    "WITH " + TEXT_VECTORS.strip() + """
       SELECT a.id, b.id AS other, round(list_cosine_similarity(a."values", b."values"), 6) AS score
       FROM emb a JOIN emb b ON a.lang = b.lang AND a.id < b.id
       WHERE list_cosine_similarity(a."values", b."values") >= 0.95 AND a."values" <> b."values"
         AND a.id = (SELECT min(id) FROM emb c WHERE c.lang = a.lang AND c."values" = a."values")
         AND b.id = (SELECT min(id) FROM emb c WHERE c.lang = b.lang AND c."values" = b."values")""",
)
def _(spark, sf):
    items = text_vectors(spark, sf).select("id", "lang", "values")
    return V.near_pairs(items, 0.95, block_rows=256, group="lang", once=True).withColumn("score", F.round("score", 6))


@query(
    "V06_near_pairs",
    with_ctes(
        "vectors",
        """SELECT a.id, b.id AS other, round(list_cosine_similarity(a."values"::DOUBLE[], b."values"::DOUBLE[]), 6) AS score
           FROM vectors a JOIN vectors b ON a.namespace = b.namespace AND a.id < b.id
           WHERE list_cosine_similarity(a."values"::DOUBLE[], b."values"::DOUBLE[]) >= 0.25""",
    ),
)
def _(spark, sf):
    return V.near_pairs(A.vectors(spark, sf), 0.25, block_rows=64).withColumn("score", F.round("score", 6))


@query(
    "V07_cosine",
    with_ctes("vectors", "SELECT id, round(sim, 6) AS score FROM scored", extra=CENTROIDS),
)
def _(spark, sf):
    v = A.vectors(spark, sf)
    c = centroids(v).select("namespace", F.col("values").alias("mean"))
    return v.join(c, "namespace").select("id", F.round(cosine(F.col("values"), F.col("mean")), 6).alias("score"))


# The best assignment by trying every set of partners for the first element of the smaller page, the first two, and so on.
SCREENS = """
el AS (
  SELECT id // 8 AS page_id, id AS element_id, "values"::DOUBLE[] AS v, 0.1::DOUBLE * (id % 4) AS x0, 0.1::DOUBLE * (id % 3) AS y0,
         0.1::DOUBLE * (id % 4) + 0.2::DOUBLE AS x1, 0.1::DOUBLE * (id % 3) + 0.3::DOUBLE AS y1,
         row_number() OVER (PARTITION BY id // 8 ORDER BY id) AS i, count(*) OVER (PARTITION BY id // 8) AS n FROM vectors),
d AS (
  SELECT pair_id, i, j, n, 0.7 * (1 - list_cosine_similarity(v, w))
    + 0.3 * (sqrt(power((x0 + x1) / 2 - (u0 + u1) / 2, 2) + power((y0 + y1) / 2 - (z0 + z1) / 2, 2))
             + sqrt(power((x1 - x0) - (u1 - u0), 2) + power((y1 - y0) - (z1 - z0), 2))) / 4 AS dist
  FROM (
    SELECT a.page_id AS pair_id, a.i, b.i AS j, a.n, a.v, b.v AS w, a.x0, a.x1, a.y0, a.y1, b.x0 AS u0, b.x1 AS u1, b.y0 AS z0, b.y1 AS z1
    FROM el a JOIN el b ON b.page_id = a.page_id + 1 WHERE a.n <= b.n
    UNION ALL
    SELECT b.page_id, a.i, b.i, a.n, a.v, b.v, a.x0, a.x1, a.y0, a.y1, b.x0, b.x1, b.y0, b.y1
    FROM el a JOIN el b ON a.page_id = b.page_id + 1 WHERE a.n < b.n)),
m0 AS (SELECT DISTINCT pair_id, 0 AS mask, {'cost': 0.0::DOUBLE, 'good': 0, 'sum': 0.0::DOUBLE} AS s, n FROM d)""" + "".join(
    f""",
m{k} AS MATERIALIZED (
  SELECT m.pair_id, m.mask | (1 << (d.j - 1)) AS mask, any_value(m.n) AS n, arg_min({{'cost': m.s.cost + dist,
           'good': m.s.good + CAST(dist < 0.75 AS INT), 'sum': m.s.sum + CASE WHEN dist < 0.75 THEN 1 - dist ELSE 0 END}}, m.s.cost + dist) AS s
  FROM m{k - 1} m JOIN d ON d.pair_id = m.pair_id AND d.i = {k} AND (m.mask >> (d.j - 1)) & 1 = 0 GROUP BY 1, 2)"""
    for k in range(1, 9)
)


@query(
    "V08_element_match",
    with_ctes(
        "vectors",
        "SELECT pair_id, s.good AS matched, round(CASE WHEN s.good > 0 THEN s.sum / s.good ELSE 0 END, 6) AS score FROM ("
        + " UNION ALL ".join(f"SELECT pair_id, arg_min(s, s.cost) AS s FROM m{k} WHERE n = {k} GROUP BY 1" for k in range(1, 9))
        + ")",
        extra=SCREENS,
    ),
)
def _(spark, sf):
    # Eight consecutive vectors stand for one screen's elements.
    el = A.vectors(spark, sf).select(
        F.floor(F.col("id") / 8).alias("page_id"), F.col("id").alias("element_id"), "values",
        F.expr("array(0.1D * (id % 4), 0.1D * (id % 3), 0.1D * (id % 4) + 0.2D, 0.1D * (id % 3) + 0.3D)").alias("bbox"),
    )
    p = el.select("page_id").distinct()
    pairs = p.select(F.col("page_id").alias("pair_id"), F.col("page_id").alias("page_a"), (F.col("page_id") + 1).alias("page_b"))
    pairs = pairs.join(p.select(F.col("page_id").alias("page_b")), "page_b", "left_semi")
    return V.element_match(pairs, el, limit=0.75).withColumn("score", F.round("score", 6))


@query(
    "V09_page_then_elements",
    with_ctes(
        "vectors",
        """SELECT query_id, page_id, element_id, round(score, 6) AS score FROM (
             SELECT b.query_id, b.page_id, v.id AS element_id,
                    list_cosine_similarity(v."values"::DOUBLE[], c."values") AS score,
                    count(*) OVER (PARTITION BY b.query_id) AS n,
                    row_number() OVER (PARTITION BY b.query_id ORDER BY
                      list_cosine_similarity(v."values"::DOUBLE[], c."values") DESC, v.id DESC) AS rank
             FROM (SELECT query_id, arg_max(page_id, (sim, page_id)) AS page_id FROM (
                     SELECT query_id, id // 3 AS page_id, sim FROM scored WHERE sim > 0.2) GROUP BY 1) b
             JOIN vectors v ON v.id // 3 = b.page_id OR v.id // 3 = b.page_id + 1
             JOIN centroids c ON c.query_id = b.query_id)
           WHERE n <= 3 OR rank = 1""",
        extra=CENTROIDS,
    ),
)
def _(spark, sf):
    v = A.vectors(spark, sf)
    q = centroids(v)
    hits = V.topk(v, q, k=5, threshold=0.2).select("query_id", F.floor(F.col("id") / 3).alias("page_id"), "score")
    el = v.select(
        F.explode(F.array(F.floor(F.col("id") / 3), F.floor(F.col("id") / 3) - 1)).alias("page_id"),
        F.col("id").alias("element_id"), "values",
    )
    plan = q.select("query_id", F.col("values").alias("plan_values"))
    return V.page_then_elements(hits, el, plan, min_score=0.2).withColumn("score", F.round("score", 6))


@query(
    "V10_keyword_overlap_rank",
    """WITH words AS (
         SELECT conv_id, turn, list_filter(list_distinct(regexp_split_to_array(lower(text), '\\s+')), lambda w: w <> '') AS w
         FROM conversations),
       scored AS (
         SELECT a.conv_id, b.turn, len(list_intersect(a.w, b.w)) / greatest(len(a.w), len(b.w)) AS s
         FROM words a JOIN words b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn > 0
         WHERE len(a.w) > 0 AND len(b.w) > 0)
       SELECT conv_id, turn, round(s, 6) AS similarity FROM scored WHERE s >= 0.1""",
)
def _(spark, sf):
    c = A.table(spark, sf, "conversations")
    task = c.filter("turn = 0").select("conv_id", F.col("text").alias("task"))
    s = c.filter("turn > 0").join(task, "conv_id").select(
        "conv_id", "turn", keyword_overlap(F.col("task"), F.col("text")).alias("similarity")
    )
    return s.filter("similarity >= 0.1").withColumn("similarity", F.round("similarity", 6))


# Tasks of pages: a vector stands for a task, and pages hold from one task to many.
PAGE_TASKS = """
tasks AS (SELECT id, namespace || '/' || CAST(floor(sqrt(id % 400)) AS BIGINT) AS page_id, namespace, "values" FROM vectors),
sims AS (
  SELECT t.page_id AS query_id, t.id, list_cosine_similarity(c."values", t."values"::DOUBLE[]) AS sim,
         row_number() OVER (PARTITION BY t.page_id ORDER BY list_cosine_similarity(c."values", t."values"::DOUBLE[]) DESC, t.id) AS rank
  FROM tasks t JOIN centroids c ON c.namespace = t.namespace)"""


@query(
    "V11_task_similarity_topk",
    with_ctes(
        "vectors", "SELECT query_id, id, round(sim, 6) AS score, rank FROM sims WHERE rank <= 4", extra=CENTROIDS + "," + PAGE_TASKS
    ),
)
def _(spark, sf):
    v = A.vectors(spark, sf)
    page = F.concat("namespace", F.lit("/"), F.floor(F.sqrt(F.col("id") % 400)).cast("string"))
    tasks = v.select("id", page.alias("page_id"), "values", "namespace")
    asked = tasks.select("page_id", "namespace").distinct().join(centroids(v).select("namespace", "values"), "namespace")
    out = V.task_similarity(tasks.drop("namespace"), asked.select(F.col("page_id").alias("query_id"), "page_id", "values"), k=4)
    return out.withColumn("score", F.round("score", 6))


@query(
    "V06b_page_vector_write",
    "WITH " + EMBED.strip() + " SELECT 'pkg_' || lang AS namespace, doc_id AS id, array_to_string(v, ',') AS v FROM filled JOIN documents USING (doc_id)",
)
def _(spark, sf):
    from ..functions.udfs import embed

    new = A.table(spark, sf, "documents").filter(F.trim("text") != "").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("pkg_"), "lang").alias("namespace"), embed(F.col("text")).alias("values"),
        F.lit(1).alias("version"),
    )
    stored = V.upsert(A.vectors(spark, sf).withColumn("version", F.lit(0)), new).filter(F.startswith("namespace", F.lit("pkg_")))
    return stored.select("namespace", "id", four_digits(F.col("values")).alias("v"))


@query(
    "V12_l2_normalise",
    with_ctes(
        "vectors",
        """SELECT id, round("values"[1]::DOUBLE / sqrt(list_dot_product("values"::DOUBLE[], "values"::DOUBLE[])), 6) AS first,
                  1.0::DOUBLE AS length FROM vectors""",
    ),
)
def _(spark, sf):
    from ..functions.vectors import norm

    u = A.vectors(spark, sf).select("id", l2_normalise(F.col("values")).alias("u"))
    return u.select("id", F.round(F.col("u")[0], 6).alias("first"), F.round(norm(F.col("u")), 6).alias("length"))


@query(
    "G05_page_canonicalise",
    with_ctes(
        "vectors",
        """SELECT screen_id, arg_min(page_id, rank) AS page_id, round(arg_min(sim, rank), 6) AS score FROM (
             SELECT t.query_id AS screen_id, t.id AS page_id, t.sim, t.rank FROM (
               SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM scored) t
             WHERE t.rank <= 5 AND t.sim > 0.2
               AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = t.id AND l.quality = 1))
           GROUP BY screen_id""",
        extra=CENTROIDS,
    ),
)
def _(spark, sf):
    v = A.vectors(spark, sf)
    q = centroids(v)
    hits = V.topk(v, q, k=5).select(
        F.col("query_id").alias("screen_id"), F.col("query_id").alias("task"), F.col("id").alias("page_id"), "score"
    )
    good = A.table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    used = v.join(good, "id", "left_semi").select(F.col("namespace").alias("task"), F.col("id").alias("page_id"))
    return G.canonical_pages(hits, used, score=0.2).withColumn("score", F.round("score", 6))
