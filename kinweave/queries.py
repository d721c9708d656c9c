"""One query for each operator of the gallery over the driver's tables, and its SQL for DuckDB.

Stand-ins: a customer is a person, an order an asset or a sample of its customer, a line of an order a face on it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import capture_month, cosine_distance, file_name, is_live, nocase, person_label, set_key, stable_id, stem, strip, suffix
from .operators import assignment, gallery, neighbours, reconcile, relational, sessions, transitions
from .plans import exports
from .schemas import TABLES, violations
from .sources import files
from .sources.store import Store, shared_dir, stored
from .streaming import ingest

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
EPS = 0.8


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- stand-ins ----


def persons(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    named = F.col("c_acctbal") > 0
    return c.select(
        F.col("c_custkey").cast("string").alias("id"), F.when(named, F.col("c_name")).alias("display_name"), named.alias("is_named"),
        F.when(F.col("c_mktsegment") == "BUILDING", "inactive").otherwise("active").alias("status"), F.lit(0).cast("long").alias("write_revision"),
    )


def samples(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("face_id"), F.col("o_custkey").cast("string").alias("person_id"), (F.col("o_orderstatus") != "F").alias("active"))


def assets(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    name = F.format_string("IMG_%04d.jpg", F.col("o_orderkey") % 1000)
    return o.select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 5).alias("source_id"), name.alias("file_name"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.date_format("o_orderdate", "yyyy-MM")).alias("capture_month"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("/in/."), F.substring(name, 1, 8), F.lit(".MOV"))).alias("live_photo_mov_path"),
    )


def owned_faces(spark: SparkSession, d: str) -> DataFrame:
    """Lines as faces: owner by return flag, nobody for small discounts of N."""
    li = read(spark, d, "lineitem")
    who = F.when((F.col("l_returnflag") == "N") & (F.col("l_discount") < 0.02), None).otherwise(F.col("l_returnflag"))
    face = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return li.select(F.col("l_orderkey").alias("asset_id"), face.alias("face_id"), who.alias("person"), F.when(who.isNotNull(), face).alias("assignment_id"), F.col("l_extendedprice").alias("area"))


def chosen(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "person string")


_PREVIEW = """
WITH f AS (SELECT l_orderkey AS asset_id, l_orderkey * 8 + l_linenumber AS face_id,
             CASE WHEN l_returnflag = 'N' AND l_discount < 0.02 THEN NULL ELSE l_returnflag END AS person, l_extendedprice AS area FROM lineitem),
m AS (SELECT asset_id, person, max(area) AS top FROM f WHERE person IN ('A', 'R') GROUP BY 1, 2),
q AS (SELECT asset_id, min(top) / 4.0 AS thr FROM m GROUP BY 1 HAVING count(*) = 2),
b AS (SELECT q.asset_id, max(CASE WHEN f.area >= q.thr AND (f.person IS NULL OR f.person NOT IN ('A', 'R')) THEN 1 ELSE 0 END) AS g,
        min(CASE WHEN f.person = 'A' THEN f.face_id END) AS cover_id
      FROM q JOIN f ON f.asset_id = q.asset_id GROUP BY 1),
p AS (SELECT b.asset_id, CASE WHEN o.o_orderpriority = '1-URGENT' THEN 'unknown-date' ELSE strftime(o.o_orderdate, '%Y-%m') END AS month,
        CASE WHEN g = 1 THEN 'group' ELSE 'only' END AS bucket, 'IMG_' || lpad(CAST(o.o_orderkey % 1000 AS VARCHAR), 4, '0') || '.jpg' AS file_name, cover_id
      FROM b JOIN orders o ON o.o_orderkey = b.asset_id)
"""


def previewed(spark: SparkSession, d: str) -> DataFrame:
    return exports.preview(assets(spark, d), owned_faces(spark, d), chosen(spark, "A", "R"), 2)


@query(_PREVIEW + "SELECT month, count(*) AS total, CAST(sum(CASE WHEN bucket = 'only' THEN 1 ELSE 0 END) AS BIGINT) AS n_only, CAST(sum(CASE WHEN bucket = 'group' THEN 1 ELSE 0 END) AS BIGINT) AS n_group FROM p GROUP BY month")
def export_preview_buckets(spark: SparkSession, d: str) -> DataFrame:
    return exports.month_totals(previewed(spark, d))


@query(_PREVIEW + "SELECT asset_id, month, bucket, file_name, cover_id FROM p")
def export_preview_assets(spark: SparkSession, d: str) -> DataFrame:
    return previewed(spark, d)


@query(_PREVIEW + "SELECT month, bucket, row_number() OVER (PARTITION BY month, bucket ORDER BY file_name, asset_id) AS place, asset_id, file_name FROM p")
def export_month_listing(spark: SparkSession, d: str) -> DataFrame:
    return exports.month_listing(previewed(spark, d))


@query("SELECT l_orderkey AS asset_id FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 2")
def division_all_selected(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("asset_id"), F.col("l_returnflag").alias("person"))
    return relational.all_of(rows, chosen(spark, "A", "R"), "asset_id", "person", 2)


_PERSON = "(SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_acctbal > 0 THEN c_name END AS display_name, c_acctbal > 0 AS is_named, CASE WHEN c_mktsegment = 'BUILDING' THEN 'inactive' ELSE 'active' END AS status FROM customer)"
_SAMPLE = "(SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS person_id, o_orderstatus <> 'F' AS active FROM orders)"


@query(f"SELECT p.id, CASE WHEN is_named THEN display_name ELSE 'Person ' || substr(replace(p.id, '-', ''), 1, 8) END AS label, is_named, count(*) AS samples, min(a.id) AS cover_id FROM {_PERSON} p JOIN {_SAMPLE} a ON a.person_id = p.id AND a.active WHERE p.status = 'active' GROUP BY p.id, display_name, is_named")
def home_cards(spark: SparkSession, d: str) -> DataFrame:
    return gallery.home_cards(persons(spark, d), samples(spark, d))


@query(f"SELECT p.id, p.display_name, p.status, count(a.id) AS samples, CAST(ceil(count(a.id) / 4.0) AS BIGINT) AS pages FROM {_PERSON} p LEFT JOIN {_SAMPLE} a ON a.person_id = p.id AND a.active GROUP BY 1, 2, 3")
def person_headers(spark: SparkSession, d: str) -> DataFrame:
    return gallery.page_counts(gallery.person_headers(persons(spark, d), samples(spark, d)), 4)


@query(f"SELECT p.id, p.display_name, count(*) AS samples FROM {_PERSON} p JOIN {_SAMPLE} a ON a.person_id = p.id AND a.active WHERE p.status = 'active' AND is_named GROUP BY 1, 2")
def eligible_persons(spark: SparkSession, d: str) -> DataFrame:
    return gallery.eligible_for_templates(persons(spark, d), samples(spark, d))


@query(
    "SELECT o_orderkey AS assignment_id, o_orderkey AS face_id, o_custkey AS asset_id, c_name AS file_name, c_nationkey % 2 = 0 AS is_live FROM orders JOIN customer ON c_custkey = o_custkey "
    "WHERE o_orderstatus <> 'F' AND o_custkey % 7 = 3 ORDER BY 1 LIMIT 10 OFFSET 10"
)
def detail_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of ten of the person that owns a seventh of all orders, one face each, on its customer's photo."""
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    owned = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("face_id"), (F.col("o_custkey") % 7).cast("string").alias("person_id"), (F.col("o_orderstatus") != "F").alias("active"))
    mov = F.when(F.col("c_nationkey") % 2 == 0, "x.MOV").otherwise("")
    photos = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("file_name"), mov.alias("live_photo_mov_path"))
    return gallery.detail_page(owned, o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("asset_id")), photos, "3", 2, 10)


@query(f"SELECT a.id AS assignment_id, 'ctx/' || CAST(a.id AS VARCHAR) AS context_path FROM {_SAMPLE} a JOIN {_PERSON} p ON p.id = a.person_id WHERE a.active AND p.status = 'active'")
def context_paths(spark: SparkSession, d: str) -> DataFrame:
    faces = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("ctx/"), F.col("o_orderkey")).alias("context_path"))
    return gallery.context_paths(samples(spark, d), persons(spark, d), faces)


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def orphan_anti(spark: SparkSession, d: str) -> DataFrame:
    return relational.orphan_rows(read(spark, d, "documents").select("doc_id"), read(spark, d, "labels"), "doc_id")


@query("SELECT o_orderkey AS id FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linestatus = 'O')")
def exists_and_not_exists(spark: SparkSession, d: str) -> DataFrame:
    children = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linestatus")
    return relational.finished_parents(read(spark, d, "orders").select(F.col("o_orderkey").alias("id")), children, "id", F.col("l_linestatus") != "O")


@query("SELECT o_orderkey AS id, o_custkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linestatus = 'O') ORDER BY 1 DESC LIMIT 1")
def latest_open_parent(spark: SparkSession, d: str) -> DataFrame:
    children = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linestatus")
    return relational.latest_open_parent(read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey"), children, "id", F.col("l_linestatus") != "O")


@query("SELECT l_returnflag, count(*) AS n, min(l_orderkey) AS first_order FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)) GROUP BY 1")
def nested_in_semi(spark: SparkSession, d: str) -> DataFrame:
    chosen = read(spark, d, "customer").filter("c_nationkey = 7")
    rows = relational.in_nested(read(spark, d, "lineitem"), "l_orderkey", (read(spark, d, "orders"), "o_orderkey", "o_custkey"), (chosen, "c_custkey", None))
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_order"))


@query("SELECT s_suppkey AS id FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity > 49 AND l.l_returnflag = 'A')")
def not_exists_delete_set(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem").filter("l_quantity > 49 AND l_returnflag = 'A'").select(F.col("l_suppkey").alias("id"))
    return relational.orphan_rows(read(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), lines, "id")


@query("SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS n_high, CAST(sum(CASE WHEN value <= 50 THEN 1 ELSE 0 END) AS BIGINT) AS n_low FROM events GROUP BY 1")
def conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    return relational.counts_by(read(spark, d, "events"), ["event_type"], n_high=F.col("value") > 50, n_low=F.col("value") <= 50)


@query("SELECT l_suppkey % 10 AS session, count(*) AS n_items, CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS n_done, CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS n_failed, CAST(coalesce(sum(l_linenumber), 0) AS BIGINT) AS n_faces FROM lineitem GROUP BY 1")
def scan_progress(spark: SparkSession, d: str) -> DataFrame:
    items = read(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("session"), F.when(F.col("l_linestatus") == "F", "succeeded").otherwise("failed").alias("status"), F.col("l_linenumber").alias("face_count"))
    return ingest.progress(items, "session")


@query("SELECT o_orderkey AS id, CAST(coalesce(max(l_linenumber), -1) + 1 AS BIGINT) AS next_index FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def max_plus_one(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber")
    return relational.next_index(read(spark, d, "orders").select(F.col("o_orderkey").alias("id")), rows, "id", "l_linenumber")


@query(
    "WITH old AS (SELECT * FROM lineitem WHERE l_linestatus = 'F'), new AS (SELECT * FROM lineitem WHERE l_linestatus <> 'F') "
    "SELECT n.l_orderkey AS asset_id, n.l_linenumber AS was, coalesce((SELECT max(o.l_linenumber) FROM old o WHERE o.l_orderkey = n.l_orderkey), -1) + row_number() OVER (PARTITION BY n.l_orderkey ORDER BY n.l_linenumber) AS face_index FROM new n"
)
def continued_index(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("asset_id"), F.col("l_linenumber").cast("long").alias("was"), F.col("l_linenumber").cast("long").alias("face_index"), "l_linestatus")
    done = rows.filter("l_linestatus = 'F'")
    return relational.continued(rows.filter("l_linestatus <> 'F'").drop("l_linestatus"), done, "asset_id", "face_index", ["was"]).withColumn("was", F.col("was").cast("int"))


@query("SELECT o_orderkey AS id, coalesce((SELECT string_agg(DISTINCT l_shipmode, ',' ORDER BY l_shipmode) FROM (SELECT l_orderkey, l_returnflag || l_linestatus AS l_shipmode FROM lineitem WHERE l_quantity > 25) l WHERE l.l_orderkey = o_orderkey), '') AS excluded FROM orders")
def exclusion_sets(spark: SparkSession, d: str) -> DataFrame:
    members = read(spark, d, "lineitem").filter("l_quantity > 25").select(F.col("l_orderkey").alias("id"), F.concat("l_returnflag", "l_linestatus").alias("who"))
    found = relational.with_sets(read(spark, d, "orders").select(F.col("o_orderkey").alias("id")), members, "id", "who", "excluded")
    return found.withColumn("excluded", set_key(F.col("excluded")))


@query("SELECT l_orderkey AS id, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_returnflag, l_partkey, l_linenumber) AS members FROM lineitem GROUP BY 1")
def ordered_members(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").withColumnRenamed("l_orderkey", "id")
    return relational.ordered_members(rows, "id", [F.col("l_returnflag"), F.col("l_partkey"), F.col("l_linenumber")], F.col("l_partkey").cast("string"))


@query("SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 20 + 1 AS BIGINT) AS batch_index, CAST((row_number() OVER (ORDER BY doc_id) - 1) % 20 + 1 AS BIGINT) AS item_index FROM documents")
def batch_plan(spark: SparkSession, d: str) -> DataFrame:
    return relational.batches(read(spark, d, "documents").select("doc_id"), ["doc_id"], 20)


# ---- vectors ----

_PAIRS = f"WITH p AS (SELECT a.vec_id AS q, b.vec_id AS n, b.label AS label, a.label AS own, list_cosine_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d FROM embeddings a, embeddings b), e AS (SELECT * FROM p WHERE d <= {EPS})"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def four_digits(distance: Column) -> Column:
    """A distance to four digits; F.round makes a BigDecimal of each, which costs more than the distance."""
    return F.floor(distance * 1e4 + 0.5) / F.lit(1e4)


def near_pairs(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return neighbours.eps_pairs(v, v, EPS)


@query(_PAIRS + " SELECT q AS query, n AS neighbour, round(d, 4) AS distance FROM e")
def neighbours_eps(spark: SparkSession, d: str) -> DataFrame:
    return near_pairs(spark, d).withColumn("distance", four_digits(F.col("distance")))


@query(_PAIRS + " SELECT q AS query, n AS neighbour, round(d, 4) AS distance, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(d, 9), n) AS rank FROM e WHERE label <> (own + 1) % 10) WHERE rank <= 3")
def neighbours_topk(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest of each that have another label than the one after its own."""
    v = vectors(spark, d).withColumn("other", F.array(((F.col("label") + 1) % 10).cast("string")))
    found = neighbours.nearest(v, v, 3, EPS, excluded="other", owner="label")
    return found.select("query", "neighbour", F.round("distance", 4).alias("distance"), "rank")


@query(_PAIRS + " SELECT q AS query, person, round(d, 4) AS distance FROM (SELECT *, CAST(label AS VARCHAR) AS person, row_number() OVER (PARTITION BY q ORDER BY round(d, 9), n) AS rank FROM e WHERE n % 3 = 0) WHERE rank = 1")
def nearest_labelled(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d).withColumn("person", F.when(F.col("id") % 3 == 0, F.col("label").cast("string")))
    return neighbours.nearest(v, v, 1, EPS, owner="person", owned=True).select("query", F.col("owner").alias("person"), F.round("distance", 4).alias("distance"))


@query(_PAIRS + " SELECT q AS query, n AS neighbour, round(d, 4) AS distance FROM e WHERE q % 11 <> 7 AND n % 11 <> 7")
def neighbours_kept_up(spark: SparkSession, d: str) -> DataFrame:
    """The lists of neighbours_eps without every eleventh vector, kept up from lists of a table in which every ninth was
    missing, every thirteenth was another one, and those now deleted were still there."""
    v = vectors(spark, d).select("id", "vector")
    moved = F.when(F.col("id") % 13 == 5, F.reverse("vector")).otherwise(F.col("vector")).alias("vector")
    before = v.filter("id % 9 <> 2").select("id", moved)
    lists = neighbours.eps_pairs(before, before, EPS)  # read once, so not stored
    changed, deleted = v.filter("id % 9 = 2 OR id % 13 = 5"), v.filter("id % 11 = 7").select("id")
    return neighbours.kept_up(lists, before, changed, deleted, EPS).withColumn("distance", four_digits(F.col("distance")))


@query("SELECT a.vec_id AS id, round(list_cosine_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def adjacent_distance(spark: SparkSession, d: str) -> DataFrame:
    a, b = vectors(spark, d), vectors(spark, d).select((F.col("id") - 1).alias("id"), F.col("vector").alias("other"))
    return a.join(b, "id").select("id", F.round(cosine_distance(F.col("vector"), F.col("other")), 4).alias("distance"))


def assignable(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as faces: every fifth has the person of its label, every seventh excludes one."""
    v = vectors(spark, d)
    person = F.when(F.col("id") % 5 == 0, F.concat(F.lit("p"), F.col("label")))
    excluded = F.when(F.col("id") % 7 == 0, F.array(F.concat(F.lit("p"), F.col("label")))).otherwise(F.array().cast("array<string>"))
    return v.select("id", F.lpad(F.col("id").cast("string"), 12, "0").alias("sort_key"), person.alias("person"), excluded.alias("excluded"), "vector")


_ASSIGNED = """
WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, CASE WHEN vec_id % 5 = 0 THEN 'p' || label END AS p,
  CASE WHEN vec_id % 7 = 0 THEN 'p' || label END AS ban FROM embeddings),
x AS MATERIALIZED (SELECT a.i, list({'i': b.i, 'face': b.id, 'd': d, 'p': b.p} ORDER BY d, b.i) AS near FROM (SELECT a, b, list_cosine_distance(a.e, b.e) AS d FROM v a, v b) WHERE d <= 0.7 GROUP BY a.i),
c AS MATERIALIZED (SELECT row_number() OVER (ORDER BY v.i) AS k, v.i, id, ban, coalesce(near, []) AS near FROM v LEFT JOIN x ON x.i = v.i WHERE p IS NULL),
m AS MATERIALIZED (SELECT count(*) AS n FROM c),
s AS (
  SELECT CAST(0 AS BIGINT) AS k, list_resize(CAST([] AS VARCHAR[]), (SELECT count(*) FROM v)) AS owners, list_resize(CAST([] AS BOOLEAN[]), (SELECT n FROM m), false) AS later, CAST(NULL AS BIGINT) AS id,
    CAST(NULL AS VARCHAR) AS decision, CAST(NULL AS VARCHAR) AS person, false AS is_new, CAST(NULL AS VARCHAR) AS evidence
  UNION ALL
  SELECT k + 1, CASE WHEN person IS NULL THEN owners ELSE owners[:i - 1] || [person] || owners[i + 1:] END,
    CASE WHEN decision = 'deferred' THEN later[:ck - 1] || [true] || later[ck + 1:] ELSE later END, id, decision, person, is_new, evidence
  FROM (SELECT *, CASE WHEN decision = 'assigned' THEN coalesce(chosen, 'new:' || id) END AS person, decision = 'assigned' AND chosen IS NULL AS is_new,
      CAST(to_json(list_transform(allowed[:3], lambda z: {'face': z.face, 'distance': printf('%.6f', greatest(z.d, 0.0) + 0.0)})) AS VARCHAR) AS evidence
    FROM (SELECT *, CASE WHEN last AND NOT later[ck] THEN 'done' WHEN len(allowed) <= 1 THEN 'skipped' WHEN len(allowed) < 3 AND NOT last THEN 'deferred' WHEN chosen IS NOT NULL THEN 'assigned'
        WHEN ban IS NOT NULL THEN CASE WHEN last THEN 'skipped' ELSE 'deferred' END WHEN len(allowed) >= 3 THEN 'assigned' ELSE 'skipped' END AS decision
      FROM (SELECT *, list_filter(list_transform(allowed, lambda z: coalesce(z.p, owners[z.i])), lambda z: z IS NOT NULL)[1] AS chosen
        FROM (SELECT s.k, s.owners, s.later, c.k AS ck, c.i, c.id, c.ban, s.k >= m.n AS last,
            list_filter(c.near, lambda z: c.ban IS NULL OR coalesce(z.p, s.owners[z.i]) IS NULL OR coalesce(z.p, s.owners[z.i]) <> c.ban) AS allowed
          FROM s, m, c WHERE s.k < 2 * m.n AND c.k = s.k % m.n + 1))))
)
SELECT id, decision, CASE WHEN person LIKE 'new:%' THEN substr(sha256('run' || chr(1) || substr(person, 5)), 1, 32) ELSE person END AS person, is_new, k > n AS was_deferred, evidence
FROM s, m WHERE k > 0 AND decision NOT IN ('deferred', 'done')
"""


@query(_ASSIGNED)
def online_assignment(spark: SparkSession, d: str) -> DataFrame:
    faces = assignable(spark, d)
    return assignment.assign(faces.drop("vector"), stored(assignment.near_faces(faces, 0.7)))


# ---- boxes ----


def boxes(spark: SparkSession, d: str, new: bool) -> DataFrame:
    """Lines as boxes that lie side by side on an order's image; the new ones are moved a little, and some far away."""
    li = read(spark, d, "lineitem")
    k, q = F.col("l_linenumber").cast("double"), F.col("l_quantity")
    move = F.when(F.col("l_returnflag") == "A", F.lit(57.0)).otherwise(q / 10 + 0.013) if new else F.lit(0.0)
    columns = {"x1": 40 * k + move, "y1": q, "x2": 40 * k + move + 60, "y2": q + 100}
    own = F.col("l_linenumber").alias("face_index") if new else (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id")
    return li.select(F.col("l_orderkey").alias("asset_id"), own, *(c.alias(n) for n, c in columns.items()), F.lit(640).alias("image_width"), F.lit(480).alias("image_height"))


_BOXES = """
WITH b AS (SELECT l_orderkey AS asset_id, l_linenumber AS k, 40.0::DOUBLE * l_linenumber AS x, l_quantity AS y,
             CASE WHEN l_returnflag = 'A' THEN 57.0::DOUBLE ELSE l_quantity / 10 + 0.013::DOUBLE END AS m FROM lineitem),
p AS (SELECT o.asset_id, o.asset_id * 8 + o.k AS old_id, n.k AS new_index,
        greatest(0.0::DOUBLE, least((o.x + 60) / 640, (n.x + n.m + 60) / 640) - greatest(o.x / 640, (n.x + n.m) / 640))
        * greatest(0.0::DOUBLE, least((o.y + 100) / 480, (n.y + 100) / 480) - greatest(o.y / 480, n.y / 480)) AS i FROM b o JOIN b n USING (asset_id)),
r AS (SELECT *, i / greatest(2 * (60.0::DOUBLE / 640) * (100.0::DOUBLE / 480) - i, 1e-9) AS overlap FROM p)
"""


@query(_BOXES + "SELECT asset_id, old_id, new_index, round(overlap, 4) AS overlap FROM r WHERE overlap > 0.5")
def iou_theta(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.overlaps(boxes(spark, d, False), boxes(spark, d, True)).withColumn("overlap", F.round("overlap", 4))


_MATCHES = _BOXES.replace("WITH b AS", "WITH RECURSIVE b AS") + """
, l AS (SELECT asset_id, list({'n': new_index, 'o': old_id} ORDER BY new_index, old_id) AS ps FROM r WHERE overlap > 0.5 GROUP BY 1),
g AS (SELECT asset_id, ps, 0 AS i, ps[1:0] AS taken FROM l
      UNION ALL SELECT asset_id, ps, i + 1, CASE WHEN list_contains([t.n FOR t IN taken], ps[i + 1].n) OR list_contains([t.o FOR t IN taken], ps[i + 1].o) THEN taken ELSE list_append(taken, ps[i + 1]) END
      FROM g WHERE i < len(ps)),
m AS (SELECT asset_id, x.o AS old_id, x.n AS new_index FROM (SELECT asset_id, unnest(taken) AS x FROM g WHERE i = len(ps)))
"""


@query(_MATCHES + "SELECT asset_id, old_id, new_index FROM m")
def redetection_matches(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.matched(reconcile.overlaps(boxes(spark, d, False), boxes(spark, d, True)))


@query(
    _MATCHES + "SELECT asset_id, k AS face_index, 'added' AS class FROM b n WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.asset_id = n.asset_id AND m.new_index = n.k) "
    "UNION ALL SELECT asset_id, k, 'gone' FROM b o WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.asset_id = o.asset_id AND m.old_id = o.asset_id * 8 + o.k) "
    "UNION ALL SELECT m.asset_id, o.k, 'kept' FROM m JOIN b o ON o.asset_id = m.asset_id AND o.asset_id * 8 + o.k = m.old_id JOIN b n ON n.asset_id = m.asset_id AND n.k = m.new_index"
)
def redetection_classes(spark: SparkSession, d: str) -> DataFrame:
    old = boxes(spark, d, False).withColumn("face_index", (F.col("id") - F.col("asset_id") * 8).cast("int"))
    new = boxes(spark, d, True).withColumn("score", F.lit(0.9)).withColumn("crop_path", F.lit("c")).withColumn("context_path", F.lit("x"))
    kept, added, gone = reconcile.reconciled(old, new)
    part = lambda df, name: df.select("asset_id", "face_index", F.lit(name).alias("class"))
    return part(added, "added").unionByName(part(gone, "gone")).unionByName(part(kept, "kept"))


# ---- files, text ----


@query(
    "SELECT CAST(p_size AS VARCHAR) AS dir, p_partkey AS id, 'P' || CAST(p_partkey % 100 AS VARCHAR) AS stem, "
    "(SELECT min('.P' || CAST(q.p_partkey % 1000 AS VARCHAR) || '.MOV') FROM part q WHERE q.p_size = p.p_size "
    "AND starts_with('.P' || CAST(q.p_partkey % 1000 AS VARCHAR) || '.MOV', '.P' || CAST(p.p_partkey % 100 AS VARCHAR))) AS mov FROM part p"
)
def prefix_pair(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part")
    photos = part.select(F.col("p_size").cast("string").alias("dir"), F.col("p_partkey").alias("id"), F.concat(F.lit("P"), F.col("p_partkey") % 100).alias("stem"))
    movs = part.select(F.col("p_size").cast("string").alias("dir"), F.concat(F.lit(".P"), F.col("p_partkey") % 1000, F.lit(".MOV")).alias("name"))
    return relational.prefix_pairs(photos, movs)


@query(
    "SELECT c_custkey AS id, lower(c_name) AS folded, trim(c_name) AS stripped, CASE WHEN c_acctbal > 0 THEN c_name ELSE 'Person ' || substr(CAST(c_custkey AS VARCHAR), 1, 8) END AS label, "
    "c_name || '.v1' AS stem, '.jpg' AS suffix, c_mktsegment <> 'BUILDING' AS is_live, CASE WHEN c_nationkey % 2 = 0 THEN '2024-' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') ELSE '2020-03' END AS month FROM customer"
)
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    path = F.concat(F.lit("/in/a.b/"), "c_name", F.lit(".v1.jpg"))
    tag = F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("2024:"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit(":05 10:00:00"))).otherwise("none")
    return c.select(
        F.col("c_custkey").alias("id"), nocase(F.col("c_name")).alias("folded"), strip(F.concat(F.lit(" \t"), "c_name", F.lit("  "))).alias("stripped"),
        person_label(F.col("c_custkey").cast("string"), F.col("c_name"), F.col("c_acctbal") > 0).alias("label"), stem(file_name(path)).alias("stem"), suffix(file_name(path)).alias("suffix"),
        is_live(F.when(F.col("c_mktsegment") != "BUILDING", "x.MOV").otherwise("")).alias("is_live"), capture_month(tag, modified=F.lit("2020-03-04 05:06:07").cast("timestamp")).alias("month"),
    )


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS nth FROM orders) WHERE nth = 1")
def latest_row(spark: SparkSession, d: str) -> DataFrame:
    return relational.latest_per(read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")]).drop("o_orderdate")


# ---- changes ----


@query(
    f"WITH h AS (SELECT p.id, p.is_named, count(a.id) AS samples FROM {_PERSON} p LEFT JOIN {_SAMPLE} a ON a.person_id = p.id AND a.active GROUP BY 1, 2), "
    "t AS (SELECT id FROM h ORDER BY samples DESC, id LIMIT 2) SELECT id, is_named, samples, CAST(row_number() OVER (ORDER BY is_named DESC, samples DESC, id) AS INTEGER) AS rank FROM h WHERE id IN (SELECT id FROM t)"
)
def merge_winner(spark: SparkSession, d: str) -> DataFrame:
    p = persons(spark, d)
    headers = gallery.person_headers(p, samples(spark, d))
    two = [r["id"] for r in headers.orderBy(F.desc("samples"), "id").limit(2).collect()]
    return transitions.merge_winner(p, headers, two).select("id", "is_named", "samples", "rank")


@query("WITH a AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O') SELECT (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) AS only_a, (SELECT count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)) AS only_b")
def set_equality(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    of = lambda s: o.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return relational.set_differences(of("F"), of("O"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, d: str) -> DataFrame:
    return relational.repeated(read(spark, d, "orders"), ["o_custkey"])


_HALVES = "WITH old AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_custkey AS created FROM orders WHERE o_orderkey % 3 <> 0), new AS (SELECT o_orderkey AS id, lower(o_orderstatus) AS status, -o_custkey AS created FROM orders WHERE o_orderkey % 2 = 0)"


def two_slices(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = read(spark, d, "orders")
    old = o.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("created"))
    return old, o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.lower("o_orderstatus").alias("status"), (-F.col("o_custkey")).alias("created"))


@query(_HALVES + " SELECT coalesce(o.id, n.id) AS id, coalesce(n.status, o.status) AS status, coalesce(o.created, n.created) AS created FROM old o FULL JOIN new n ON o.id = n.id")
def upsert_assets(spark: SparkSession, d: str) -> DataFrame:
    return transitions.upsert(*two_slices(spark, d), "id", ["created"])


@query(_HALVES + " SELECT n.id, n.status, n.created FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.id = n.id)")
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    return transitions.insert_absent(*two_slices(spark, d), ["id"])


@query(_HALVES + " SELECT n.id, n.status, n.created FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.status = 'running')")
def guarded_insert(spark: SparkSession, d: str) -> DataFrame:
    old, new = two_slices(spark, d)
    return transitions.guarded_insert(old, new, F.col("status") == "running")


@query("SELECT s_suppkey AS id, CASE WHEN s_acctbal > 0 AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s_suppkey AND l.l_partkey % 50 = 0 AND l.l_quantity > 40) THEN 'invalid' WHEN s_acctbal > 0 THEN 'active' ELSE 'invalid' END AS status FROM supplier")
def invalidate_templates(spark: SparkSession, d: str) -> DataFrame:
    templates = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_acctbal") > 0, "active").otherwise("invalid").alias("status"))
    members = read(spark, d, "lineitem").filter("l_quantity > 40").select(F.col("l_suppkey").alias("template_id"), F.col("l_partkey").alias("person_id"))
    return transitions.invalidate_templates(templates, members, read(spark, d, "part").filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("id")))


@query(
    "WITH gone AS (SELECT o_orderkey AS id, o_custkey AS p FROM orders WHERE o_orderpriority = '1-URGENT'), kept AS (SELECT o_custkey AS p FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_orderstatus <> 'F') "
    "SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(CASE WHEN c_custkey IN (SELECT p FROM gone) THEN 1 ELSE 0 END AS BIGINT) AS write_revision FROM customer WHERE NOT (c_custkey IN (SELECT p FROM gone) AND c_custkey NOT IN (SELECT p FROM kept))"
)
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    faces = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority")
    gone = faces.filter("o_orderpriority = '1-URGENT'")
    return reconcile.delete_faces(gone, faces, faces.select(F.col("id").alias("face_id")), samples(spark, d), persons(spark, d))["persons"].select("id", "write_revision")


@query("SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS template_id, o_orderstatus AS status, CAST(count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS BIGINT) AS n_copied, CAST(count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS BIGINT) AS n_skipped, CAST(count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS BIGINT) AS n_failed FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3")
def run_history(spark: SparkSession, d: str) -> DataFrame:
    runs = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("template_id"), F.col("o_orderstatus").alias("status"))
    result = F.when(F.col("l_returnflag") == "A", "copied").when(F.col("l_returnflag") == "R", "skipped_exists").otherwise("failed")
    return exports.run_history(runs, read(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), result.alias("result")))


@query("SELECT n_nationkey AS id, CAST(n_regionkey AS INTEGER) AS created_at, count(c_custkey) AS n_members, coalesce(string_agg(c_name, ',' ORDER BY lower(c_name), c_custkey), '') AS names FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def template_list(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    templates = read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("created_at"))
    return gallery.template_list(templates, c.select(F.col("c_nationkey").alias("template_id"), F.col("c_custkey").alias("person_id")), c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("display_name")))


@query("SELECT d.doc_id, d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def remaining_items(spark: SparkSession, d: str) -> DataFrame:
    return ingest.remaining(read(spark, d, "documents").select("doc_id", "source"), read(spark, d, "labels").filter("quality = 1"), ["doc_id"])


@query("WITH f AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT o_custkey % 10 AS session_id, count(*) AS n_items, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS n_failed, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_faces, CAST(coalesce(sum(n), 0) * 2 AS BIGINT) AS n_files FROM orders LEFT JOIN f ON l_orderkey = o_orderkey GROUP BY 1")
def session_summary(spark: SparkSession, d: str) -> DataFrame:
    items = read(spark, d, "orders").select((F.col("o_custkey") % 10).alias("session_id"), F.col("o_orderkey").alias("asset_id"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("succeeded").alias("status"))
    return sessions.session_summary(items, read(spark, d, "lineitem").select(F.col("l_orderkey").alias("asset_id")))


@query("SELECT l_orderkey AS id, 'score out of range' AS error FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_discount > 0.085")
def result_errors(spark: SparkSession, d: str) -> DataFrame:
    """The lines of each order as what a worker found on it; large discounts give scores that cannot be."""
    li, o = read(spark, d, "lineitem"), read(spark, d, "orders")
    face = F.struct(F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.col("l_quantity").alias("x2"), F.col("l_extendedprice").alias("y2"), (F.col("l_discount") * 12).alias("score"), F.array(F.col("l_tax").cast("float")).alias("vector"))
    found = li.groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(face).alias("faces"))
    results = o.join(found, o["o_orderkey"] == found["k"], "left").select(F.col("o_orderkey").cast("string").alias("absolute_path"), F.lit("succeeded").alias("status"), "faces")
    path = f"{shared_dir(spark)}/results-{uuid.uuid4().hex}"
    results.write.json(path)
    bad = sessions.result_errors(o.select(F.col("o_orderkey").cast("string").alias("absolute_path")), sessions.read_results(spark, path))
    return bad.select(F.col("absolute_path").cast("long").alias("id"), "error")


@query(
    _PREVIEW.rstrip().replace("WITH", "WITH RECURSIVE", 1) + ", a AS (SELECT asset_id, p.month, bucket, file_name, o_orderkey, CASE WHEN o_custkey % 5 = 4 THEN 'unknown' ELSE 'Phone' || CAST(o_custkey % 5 % 3 AS VARCHAR) END AS label FROM p JOIN orders ON o_orderkey = asset_id), "
    "z AS MATERIALIZED (SELECT *, bucket || '/' || month AS f, substr(file_name, 1, 8) AS stem, row_number() OVER (PARTITION BY bucket, month, own ORDER BY asset_id % 2, asset_id) AS j, "
    "count(CASE WHEN asset_id % 2 = 0 OR own THEN 1 END) OVER (PARTITION BY bucket, month, file_name, label, own ORDER BY asset_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS seen FROM a, (VALUES (true), (false)) o(own) QUALIFY own = (asset_id % 2 = 1)), "
    "r AS (SELECT f, CAST(0 AS BIGINT) AS j, CAST([] AS VARCHAR[]) AS taken, CAST(NULL AS BIGINT) AS asset_id, CAST(NULL AS VARCHAR) AS name FROM (SELECT DISTINCT f FROM z) UNION ALL "
    "SELECT f, j + 1, list_append(taken, name), asset_id, name FROM (SELECT r.f, r.j, r.taken, z.asset_id, CASE WHEN NOT list_contains(taken, file_name) THEN file_name "
    "WHEN NOT seen AND NOT list_contains(taken, stem || '__' || label || '.jpg') THEN stem || '__' || label || '.jpg' "
    "ELSE stem || '__' || label || '-' || list_filter(range(2, len(taken) + 3), lambda n: NOT list_contains(r.taken, z.stem || '__' || z.label || '-' || n || '.jpg'))[1] || '.jpg' END AS name FROM r JOIN z ON z.f = r.f AND z.j = r.j + 1)) "
    "SELECT 't' AS template_id, asset_id, bucket, month, name AS file_name, CASE WHEN o_orderkey % 3 = 0 THEN '.' || substr(name, 1, len(name) - 4) || '.MOV' END AS mov_file_name, label AS source_label FROM r JOIN z USING (asset_id)"
)
def plan_names(spark: SparkSession, d: str) -> DataFrame:
    """The plan of a template after a first preview of half of the assets and a second one of all of them."""
    sources = phones(spark)
    found, own = stored(previewed(spark, d)), assets(spark, d)
    empty = spark.createDataFrame([], "template_id string, asset_id long, bucket string, month string, file_name string")
    first = exports.plan_additions(found.filter("asset_id % 2 = 0"), own, sources, empty, "t")
    first = stored(first)
    second = exports.plan_additions(found, own, sources, first, "t")
    return first.unionByName(second)


_TEMPLATES = "WITH t AS (SELECT p_partkey AS template_id, person FROM part, range(7) r(person) WHERE p_partkey % 128 >> person & 1 = 1), f AS (SELECT l_orderkey AS asset_id, CASE WHEN l_tax > 0 THEN l_suppkey % 7 END AS person, l_quantity AS area FROM lineitem), "


def many_templates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Parts as templates of the people whose bits their keys have, and lines as faces of one of seven people or nobody."""
    people = F.explode(F.filter(F.sequence(F.lit(0), F.lit(6)), lambda i: F.expr("p_partkey % 128").bitwiseAND(F.pow(F.lit(2), i).cast("long")) > 0))
    templates = read(spark, d, "part").select(F.col("p_partkey").alias("template_id"), people.alias("person"))
    return templates, read(spark, d, "lineitem").select(F.col("l_orderkey").alias("asset_id"), F.when(F.col("l_tax") > 0, F.col("l_suppkey") % 7).cast("int").alias("person"), F.col("l_quantity").alias("area"))


@query(
    _TEMPLATES + "s AS (SELECT template_id, count(*) AS n FROM t GROUP BY 1), h AS (SELECT template_id, asset_id FROM t JOIN (SELECT DISTINCT asset_id, person FROM f) USING (person) JOIN s USING (template_id) GROUP BY 1, 2, n HAVING count(*) = n), "
    "x AS (SELECT template_id, asset_id, max(CASE WHEN person IS NULL OR NOT EXISTS (SELECT 1 FROM t WHERE t.template_id = h.template_id AND t.person = f.person) THEN area END) AS other FROM h JOIN f USING (asset_id) GROUP BY 1, 2), "
    "y AS (SELECT template_id, asset_id, min(top) * 0.25 AS threshold FROM h JOIN (SELECT asset_id, person, max(area) AS top FROM f GROUP BY 1, 2) USING (asset_id) JOIN t USING (template_id, person) GROUP BY 1, 2) "
    "SELECT template_id, bucket, count(*) AS assets, sum(threshold) AS thresholds FROM (SELECT template_id, threshold, CASE WHEN other >= threshold THEN 'group' ELSE 'only' END AS bucket FROM x JOIN y USING (template_id, asset_id)) GROUP BY 1, 2"
)
def template_previews(spark: SparkSession, d: str) -> DataFrame:
    """Assets of each bucket for every template, templates of one to seven people."""
    templates, faces = many_templates(spark, d)
    return exports.totals_for_all(faces, templates)


@query(
    _PREVIEW.rstrip() + ", a AS (SELECT asset_id, p.month, bucket, file_name, o_orderkey, CASE WHEN o_custkey % 5 = 4 THEN 'unknown' ELSE 'Phone' || CAST(o_custkey % 5 % 3 AS VARCHAR) END AS label FROM p JOIN orders ON o_orderkey = asset_id), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY bucket, month, file_name ORDER BY asset_id) AS nth, row_number() OVER (PARTITION BY bucket, month, file_name, label ORDER BY asset_id) AS kth FROM a), "
    "w AS (SELECT *, substr(file_name, 1, 8) || CASE WHEN nth = 1 THEN '' WHEN kth = 1 THEN '__' || label ELSE '__' || label || '-' || CAST(kth AS VARCHAR) END AS stem FROM n) "
    "SELECT asset_id, bucket, month, stem || '.jpg' AS file_name, CASE WHEN o_orderkey % 3 = 0 THEN '.' || stem || '.MOV' END AS mov_file_name, label AS source_label FROM w"
)
def plan_first_names(spark: SparkSession, d: str) -> DataFrame:
    """The plan of a template after one preview, where the rule of names is one of ranks."""
    empty = spark.createDataFrame([], "template_id string, asset_id long, bucket string, month string, file_name string")
    return exports.plan_additions(previewed(spark, d), assets(spark, d), phones(spark), empty, "t").drop("template_id")


def phones(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, f"Phone{i % 3}") for i in range(4)], "id long, label string")


@query(
    "SELECT run_id, s_suppkey AS plan_id, CASE WHEN run_id = 2 AND s_nationkey % 5 <> 0 THEN 'skipped_exists' WHEN s_nationkey % 5 = 0 THEN 'failed' ELSE 'copied' END AS result, "
    "CASE WHEN run_id = 1 AND s_nationkey % 5 <> 0 AND s_suppkey % 3 = 0 THEN 'copied' ELSE 'not_applicable' END AS mov_result FROM supplier, (VALUES (1), (2)) r(run_id)"
)
def delivered_files(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' names as pictures, of which some are lost, delivered by two runs, the first of which is sent twice."""
    at = f"{shared_dir(spark).removeprefix('file://')}/delivery-{uuid.uuid4().hex}"
    s = read(spark, d, "supplier")
    made = sessions.write_artifacts(s.select(F.col("s_suppkey").alias("face_id"), "s_name"), lambda: lambda row: row["s_name"].encode(), f"{at}/made")
    lost = F.when(F.col("s_nationkey") % 5 == 0, F.lit(f"{at}/lost")).otherwise(F.col("path"))
    rows = s.join(made, s["s_suppkey"] == made["face_id"])
    own = rows.select(F.col("s_suppkey").alias("id"), lost.alias("absolute_path"), F.when(F.col("s_suppkey") % 3 == 0, F.col("path")).alias("live_photo_mov_path"))
    name = F.concat(F.lit("f"), F.col("s_suppkey"))
    plan = rows.select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("asset_id"), F.lit("only").alias("bucket"), F.col("s_nationkey").cast("string").alias("month"), F.concat(name, F.lit(".jpg")).alias("file_name"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(name, F.lit(".MOV"))).alias("mov_file_name"))
    first = exports.deliver(plan, own, f"{at}/out", 1)
    again = exports.deliver(plan, own, f"{at}/out", 1)
    second = exports.deliver(plan, own, f"{at}/out", 2)
    return first.intersectAll(again).unionByName(second).select("run_id", "plan_id", "result", "mov_result").withColumn("run_id", F.col("run_id").cast("int"))


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey % 5 = 4 THEN 'unknown' ELSE 'Phone' || CAST(o_custkey % 5 % 3 AS VARCHAR) END AS source_label FROM orders")
def labelled_assets(spark: SparkSession, d: str) -> DataFrame:
    return exports.labelled(assets(spark, d), phones(spark)).select("id", "source_label")


# ---- scans and runs ----

_PHOTO = "(SELECT c_custkey AS id, c_nationkey AS source_id, c_name AS absolute_path, CASE WHEN c_mktsegment = 'BUILDING' THEN 'failed' ELSE 'succeeded' END AS processing_status FROM customer)"


def order_faces(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Orders as faces on their customer's photo, vectors by number, and owners of those that are F."""
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    one = F.lit(0.0)
    return {
        "faces": o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("asset_id"), (F.col("o_orderkey") % 100).cast("int").alias("face_index"), one.alias("x1"), one.alias("y1"), F.col("o_totalprice").alias("x2"), F.lit(2.0).alias("y2"), F.lit(640).alias("image_width"), F.lit(480).alias("image_height")),
        "assets": c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("source_id"), F.col("c_name").alias("absolute_path"), F.lit(None).cast("string").alias("live_photo_mov_path"), F.when(F.col("c_mktsegment") == "BUILDING", "failed").otherwise("succeeded").alias("processing_status")),
        "sources": read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("path"), F.col("n_name").alias("label"), (F.col("n_regionkey") != 2).alias("active")),
        "embeddings": read(spark, d, "embeddings").select(F.col("vec_id").alias("face_id"), F.when(F.col("label") % 5 == 0, "other").otherwise("main").alias("variant"), F.size("embedding").alias("dimension"), F.col("embedding").alias("vector")),
        "assignments": o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("face_id"), (F.col("o_custkey") % 50).cast("string").alias("person_id"), (F.col("o_orderpriority") != "1-URGENT").alias("active")),
        "exclusions": read(spark, d, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("face_id"), F.col("l_linestatus").alias("person_id")),
    }


_OWNER = "CASE WHEN o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT' THEN CAST(o_custkey % 50 AS VARCHAR) END"


@query(
    f"SELECT o_orderkey AS id, n_name AS source_path, absolute_path, CAST(o_orderkey % 100 AS INTEGER) AS face_index, {_OWNER} AS person, coalesce((SELECT string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A'), '') AS excluded, "
    f"vec_id IS NOT NULL AS has_vector FROM orders JOIN {_PHOTO} a ON a.id = o_custkey JOIN nation ON n_nationkey = source_id LEFT JOIN embeddings ON vec_id = o_orderkey AND label % 5 <> 0 WHERE processing_status = 'succeeded'"
)
def assignment_input(spark: SparkSession, d: str) -> DataFrame:
    rows = assignment.face_input(**order_faces(spark, d))
    return rows.select("id", "sort_key.*", "person", set_key(F.col("excluded")).alias("excluded"), F.col("vector").isNotNull().alias("has_vector"))


@query(f"SELECT o_orderkey AS id, o_custkey AS asset_id, len(embedding) AS dimension, {_OWNER} AS person_id FROM orders LEFT JOIN embeddings ON vec_id = o_orderkey AND label % 5 <> 0 WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 9)")
def existing_face_state(spark: SparkSession, d: str) -> DataFrame:
    t = order_faces(spark, d)
    again = t["assets"].filter("source_id < 9").select(F.col("id").alias("asset_id"))
    return reconcile.face_state(again, t["faces"], t["embeddings"], t["assignments"]).select("id", "asset_id", F.col("dimension").cast("long").alias("dimension"), "person_id")


@query(f"SELECT o_custkey AS asset_id, o_orderkey AS face_id, {_OWNER} AS person, CASE WHEN {_OWNER} IS NOT NULL THEN o_orderkey END AS assignment_id, o_totalprice * 2 AS area FROM orders")
def face_owners(spark: SparkSession, d: str) -> DataFrame:
    t = order_faces(spark, d)
    return exports.face_rows(t["faces"], t["assignments"])


@query("SELECT o_orderkey AS id, c_name AS absolute_path FROM orders JOIN customer ON c_custkey = o_custkey")
def plan_with_paths(spark: SparkSession, d: str) -> DataFrame:
    plan = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("asset_id"))
    return exports.plan_sources(plan, order_faces(spark, d)["assets"]).select("id", "absolute_path")


@query("SELECT o_orderkey AS id, n_name AS source_path FROM orders JOIN nation ON n_nationkey = o_custkey % 30")
def batch_sources(spark: SparkSession, d: str) -> DataFrame:
    items = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 30).alias("source_id"))
    return sessions.with_batch_sources(items, order_faces(spark, d)["sources"]).select("id", "source_path")


@query("SELECT n_nationkey AS id, n_name AS path FROM nation WHERE n_regionkey <> 2 ORDER BY 1")
def active_sources(spark: SparkSession, d: str) -> DataFrame:
    return sessions.active_sources(order_faces(spark, d)["sources"], read(spark, d, "nation").select(F.col("n_name").alias("path"))).select("id", "path")


@query("SELECT n_nationkey AS id, n_name AS path, n_name AS label, n_regionkey <> 2 AS active FROM nation ORDER BY 1")
def all_sources(spark: SparkSession, d: str) -> DataFrame:
    return sessions.list_sources(order_faces(spark, d)["sources"])


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus IN ('O', 'F') THEN 'failed' ELSE 'completed' END AS status FROM orders")
def stale_runs(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "failed").otherwise("completed")
    return transitions.close_stale_runs(read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status")))


@query("SELECT o_orderkey AS id, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity = 50) THEN 'completed' ELSE o_orderstatus END AS status FROM orders")
def keyed_update(spark: SparkSession, d: str) -> DataFrame:
    batches = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    done = read(spark, d, "lineitem").filter("l_quantity = 50").select(F.col("l_orderkey").alias("id"))
    return transitions.set_where(transitions.flagged(batches, done, "id", "_done"), F.col("_done"), status=F.lit("completed")).select("id", "status")


@query(
    "SELECT s_suppkey AS id, CASE WHEN EXISTS (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_suppkey = s_suppkey AND l_quantity > 45 AND p_size = 7 AND (p_brand LIKE '%1' OR p_type LIKE '%S%')) THEN 'invalid' ELSE 'active' END AS status FROM supplier"
)
def invalidate_if_unfit(spark: SparkSession, d: str) -> DataFrame:
    templates = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("active").alias("status"))
    members = read(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_suppkey").alias("template_id"), F.col("l_partkey").alias("person_id"))
    part = read(spark, d, "part")
    people = part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_brand").endswith("1"), "inactive").otherwise("active").alias("status"), F.when(~F.col("p_type").contains("S"), F.col("p_name")).alias("display_name"))
    return transitions.invalidate_if_unfit(templates, members, people, part.filter("p_size = 7").select(F.col("p_partkey").alias("id")))


@query(
    "WITH p AS (SELECT CAST(c_custkey % 1000 AS VARCHAR) AS id, c_mktsegment || CAST(c_nationkey AS VARCHAR) AS name, c_acctbal > 0 AS named, CASE WHEN c_mktsegment = 'BUILDING' THEN 'odd' ELSE 'active' END AS status FROM customer) "
    "SELECT 'allowed status' AS rule, status AS detail, count(*) AS rows FROM p WHERE status = 'odd' GROUP BY 2 UNION ALL SELECT 'key id', id, count(*) FROM p GROUP BY 2 HAVING count(*) > 1 "
    "UNION ALL SELECT 'key display_name', name, count(*) FROM p WHERE status = 'active' AND named GROUP BY 2 HAVING count(*) > 1"
)
def broken_rules(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    rows = c.select((F.col("c_custkey") % 1000).cast("string").alias("id"), F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("display_name"), (F.col("c_acctbal") > 0).alias("is_named"), F.when(F.col("c_mktsegment") == "BUILDING", "odd").otherwise("active").alias("status"))
    return violations(rows, TABLES["persons"])


def decisions(spark: SparkSession, d: str) -> DataFrame:
    """Orders as decided faces: those that are O join a customer, those that are P a person of their own."""
    kind = F.col("o_orderstatus")
    person = F.when(kind == "O", F.col("o_custkey").cast("string")).when(kind == "P", F.concat(F.lit("new-"), F.col("o_orderkey")))
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(person.isNotNull(), "assigned").otherwise("skipped").alias("decision"), person.alias("person"), (kind == "P").alias("is_new"), (F.col("o_orderkey") % 4 == 0).alias("was_deferred"), F.lit("[]").alias("evidence"))


@query("SELECT count(*) AS candidates, count(CASE WHEN o_orderstatus <> 'F' THEN 1 END) AS assigned, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS new_persons, count(CASE WHEN o_orderkey % 4 = 0 THEN 1 END) AS deferred, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS skipped FROM orders")
def decision_counts(spark: SparkSession, d: str) -> DataFrame:
    return assignment.run_counts(decisions(spark, d))


def after_commit(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    given = spark.createDataFrame([], TABLES["assignments"].schema)
    return assignment.committed(decisions(spark, d), given, persons(spark, d).withColumn("created_at", F.current_timestamp()), 1)


@query("SELECT o_orderkey AS face_id, CASE WHEN o_orderstatus = 'O' THEN CAST(o_custkey AS VARCHAR) ELSE 'new-' || CAST(o_orderkey AS VARCHAR) END AS person_id, 'auto' AS source, true AS active, count(*) OVER () AS numbers FROM orders WHERE o_orderstatus <> 'F'")
def commit_assignments(spark: SparkSession, d: str) -> DataFrame:
    rows = after_commit(spark, d)[0]
    numbers = rows.agg(F.count_distinct("id").alias("numbers"))
    return rows.select("face_id", "person_id", "source", "active").crossJoin(numbers)  # one row


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS write_revision FROM customer UNION ALL SELECT 'new-' || CAST(o_orderkey AS VARCHAR), 1 FROM orders WHERE o_orderstatus = 'P'")
def commit_persons(spark: SparkSession, d: str) -> DataFrame:
    return after_commit(spark, d)[1].select("id", "write_revision")


@query("SELECT l_orderkey AS asset_id, l_linenumber AS was, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS face_index FROM lineitem")
def first_index(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("asset_id"), F.col("l_linenumber").alias("was"), F.lit(0).cast("long").alias("face_index"))
    return relational.continued(rows, rows.limit(0), "asset_id", "face_index", ["was"])


@query("SELECT doc_id, sha256(text) AS file_fingerprint FROM documents")
def content_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return files.fingerprints(rows).select("doc_id", "file_fingerprint")


@query(
    "SELECT file_name, path, row_number() OVER (ORDER BY lower(upper(path)), path) AS place FROM (SELECT path, substr(path, 5) AS file_name FROM (SELECT '/in/' || p_name || CAST(p_partkey AS VARCHAR) || CASE p_size % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.PNG' WHEN 2 THEN '.Heic' ELSE '.txt' END AS path FROM part)) WHERE NOT path LIKE '%.txt'"
)
def photos_in_order(spark: SparkSession, d: str) -> DataFrame:
    end = F.when(F.col("p_size") % 4 == 0, ".jpg").when(F.col("p_size") % 4 == 1, ".PNG").when(F.col("p_size") % 4 == 2, ".Heic").otherwise(".txt")
    found = files.photos(read(spark, d, "part").select(F.concat(F.lit("/in/"), "p_name", F.col("p_partkey").cast("string"), end).alias("path")))
    return relational.ranked(found, [files.folded(F.col("path")), F.col("path")], name="place").select("file_name", "path", "place")


@query("SELECT o_orderkey AS run_id, o_orderstatus AS status, c_name AS template_name, l_orderkey * 8 + l_linenumber AS delivery_id, CASE WHEN l_orderkey IS NOT NULL THEN CASE WHEN l_returnflag = 'A' THEN 'copied' ELSE 'failed' END END AS result FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey")
def run_details(spark: SparkSession, d: str) -> DataFrame:
    runs = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("template_id"), F.col("o_orderstatus").alias("status"))
    given = read(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("run_id"), F.lit("p").alias("target_path"), F.when(F.col("l_returnflag") == "A", "copied").otherwise("failed").alias("result"), F.lit("copied").alias("mov_result"))
    return exports.run_details(runs, given, read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))).drop("target_path", "mov_result")


@query("SELECT s_suppkey AS id, s_nationkey AS template_id, s_name AS status, n_name AS template_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n_members, coalesce((SELECT string_agg(c_name, ',' ORDER BY lower(c_name), c_custkey) FROM customer WHERE c_nationkey = n_nationkey), '') AS names FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def run_headers(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    runs = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("template_id"), F.col("s_name").alias("status"))
    templates = read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("created_at"))
    return gallery.run_headers(runs, templates, c.select(F.col("c_nationkey").alias("template_id"), F.col("c_custkey").alias("person_id")), c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("display_name")))


# ---- changes of persons ----


def person_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    empty = {n: spark.createDataFrame([], TABLES[n].schema) for n in ("merge_operations", "merge_members", "exclusions", "person_name_events")}
    members = read(spark, d, "customer").select((F.col("c_custkey") % 100).cast("string").alias("template_id"), F.col("c_custkey").cast("string").alias("person_id"))
    templates = members.select(F.col("template_id").alias("id")).distinct().withColumn("status", F.lit("active"))
    return empty | {"persons": persons(spark, d), "assignments": samples(spark, d), "templates": templates, "template_persons": members}


#: The two active persons of the most samples, the winner first.
_TWO = (
    f"h AS (SELECT p.id, p.is_named, count(a.id) AS samples FROM {_PERSON} p JOIN {_SAMPLE} a ON a.person_id = p.id AND a.active WHERE p.status = 'active' GROUP BY 1, 2), "
    "t AS (SELECT * FROM h ORDER BY samples DESC, id LIMIT 2), two AS (SELECT id, row_number() OVER (ORDER BY is_named DESC, samples DESC, id) AS rank FROM t)"
)


def top_two(t: dict[str, DataFrame]) -> tuple[DataFrame, list[str]]:
    headers = gallery.person_headers(t["persons"], t["assignments"])
    return headers, [r["id"] for r in headers.filter("status = 'active' AND samples > 0").orderBy(F.desc("samples"), "id").limit(2).collect()]


@query(f"WITH {_TWO} SELECT p.id, CASE WHEN rank = 2 THEN 'inactive' ELSE status END AS status, CAST(CASE WHEN rank IS NULL THEN 0 ELSE 1 END AS BIGINT) AS write_revision FROM {_PERSON} p LEFT JOIN two ON two.id = p.id")
def merged_persons(spark: SparkSession, d: str) -> DataFrame:
    t = person_tables(spark, d)
    headers, two = top_two(t)
    return transitions.merge(t, headers, two, 1)["persons"].select("id", "status", "write_revision")


@query(f"WITH {_TWO} SELECT a.id, CASE WHEN two.rank = 2 AND active THEN (SELECT id FROM two WHERE rank = 1) ELSE person_id END AS person_id, active FROM {_SAMPLE} a LEFT JOIN two ON two.id = a.person_id")
def merged_samples(spark: SparkSession, d: str) -> DataFrame:
    t = person_tables(spark, d)
    headers, two = top_two(t)
    return transitions.merge(t, headers, two, 1)["assignments"].select("id", "person_id", "active")


@query(f"WITH {_TWO} SELECT p.id, p.display_name, p.status, CAST(CASE WHEN rank IS NULL THEN 0 ELSE 2 END AS BIGINT) AS write_revision FROM {_PERSON} p LEFT JOIN two ON two.id = p.id")
def undone_persons(spark: SparkSession, d: str) -> DataFrame:
    t = person_tables(spark, d)
    headers, two = top_two(t)
    merged = {k: stored(v) for k, v in transitions.merge(t, headers, two, 1).items()}
    return transitions.undo_merge(merged)["persons"].select("id", "display_name", "status", "write_revision")


@query(f"WITH {_TWO} SELECT (SELECT id FROM two WHERE rank = 1) AS winner_id, (SELECT id FROM two WHERE rank = 2) AS loser_id, true AS can_undo")
def undo_flag(spark: SparkSession, d: str) -> DataFrame:
    t = person_tables(spark, d)
    headers, two = top_two(t)
    return transitions.undo_state({k: stored(v) for k, v in transitions.merge(t, headers, two, 1).items()}).select("winner_id", "loser_id", "can_undo")


@query(f"WITH {_TWO} SELECT a.id, a.person_id, a.active AND NOT (a.person_id = (SELECT id FROM two WHERE rank = 1) AND a.id IN (SELECT x.id FROM {_SAMPLE} x WHERE x.active AND x.person_id = (SELECT id FROM two WHERE rank = 1) ORDER BY x.id LIMIT 2)) AS active FROM {_SAMPLE} a")
def excluded_samples(spark: SparkSession, d: str) -> DataFrame:
    t = person_tables(spark, d)
    headers, two = top_two(t)
    first = transitions.merge_winner(t["persons"], headers, two).filter("rank = 1").first()["id"]
    own = [r["id"] for r in t["assignments"].filter(F.col("active") & (F.col("person_id") == first)).orderBy("id").limit(2).collect()]
    return transitions.exclude(t, first, own)["assignments"].select("id", "person_id", "active")


@query(f"SELECT id, CASE WHEN id = '1' THEN 'A new name' ELSE display_name END AS display_name, is_named OR id = '1' AS is_named, CAST(CASE WHEN id = '1' THEN 1 ELSE 0 END AS BIGINT) AS write_revision FROM (SELECT id, display_name, is_named, status FROM {_PERSON}) WHERE (SELECT status FROM {_PERSON} WHERE id = '1') = 'active' UNION ALL SELECT id, display_name, is_named, 0 FROM {_PERSON} WHERE (SELECT status FROM {_PERSON} WHERE id = '1') <> 'active'")
def named_persons(spark: SparkSession, d: str) -> DataFrame:
    return transitions.apply_name(person_tables(spark, d), "1", "  A new name ")["persons"].select("id", "display_name", "is_named", "write_revision")


@query(f"WITH {_TWO} SELECT 'one' AS request, 'two persons are needed' AS error UNION ALL SELECT 'twice', 'the same person twice' UNION ALL SELECT 'strange', 'no such person' UNION ALL SELECT 'good', NULL FROM two WHERE rank = 1 UNION ALL SELECT 'inactive', 'a person is inactive'")
def request_errors(spark: SparkSession, d: str) -> DataFrame:
    t = person_tables(spark, d)
    headers, two = top_two(t)
    out = t["persons"].filter("status = 'inactive'").orderBy("id").first()["id"]
    asked = {"one": two[:1], "twice": [two[0]] * 2, "strange": [two[0], "?"], "good": two, "inactive": [two[0], out]}
    found = [transitions.merge_error(t["persons"], headers, ids).select(F.lit(name).alias("request"), "error") for name, ids in asked.items()]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3]).unionByName(found[4])


# ---- sinks ----


@query(
    "SELECT event_type, count(*) AS n_items, CAST(count(CASE WHEN value > 50 THEN 1 END) AS BIGINT) AS n_done, CAST(count(CASE WHEN value <= 10 THEN 1 END) AS BIGINT) AS n_failed, CAST(sum(user_id) AS BIGINT) AS n_faces FROM events GROUP BY 1"
)
def streamed_progress(spark: SparkSession, d: str) -> DataFrame:
    """Events that arrive in several files, taken some at a time by a scan that is lost in its second batch after it wrote,
    started again, and goes on from its checkpoint; more files arrive then."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    status = F.when(F.col("value") > 50, "succeeded").when(F.col("value") <= 10, "failed").otherwise("pending")
    e = read(spark, d, "events").select("event_type", status.alias("status"), F.col("user_id").alias("face_count"), (F.col("event_id") % 3 == 0).alias("late"))
    early = e.filter("NOT late").drop("late")
    early.repartition(4).write.parquet(f"{at}/in")
    keep, lost = ingest.progress_once(f"{at}/progress", "event_type"), []

    def handle(rows: DataFrame, batch: int) -> None:
        keep(rows, batch)
        if batch == 1 and not lost:
            lost.append(batch)
            raise RuntimeError("lost")

    start = lambda: ingest.scan_new(spark, f"{at}/in", early.schema, f"{at}/checkpoint", handle, 2)
    ingest.resumed(start)
    e.filter("late").drop("late").repartition(3).write.mode("append").parquet(f"{at}/in")
    ingest.resumed(start)
    return ingest.total_progress(spark, f"{at}/progress", "event_type")


@query("SELECT event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM events GROUP BY 1")
def logged_events(spark: SparkSession, d: str) -> DataFrame:
    """Events as JSON lines in a log, appended in two writes and read back."""
    e, path = read(spark, d, "events").select("event_id", "event_type", "user_id"), f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    for rows in (e.filter("value > 50"), e.filter("value <= 50 OR value IS NULL")):
        ingest.append_log(rows, path)
    return spark.read.schema("event_id long, event_type string, user_id long").json(path).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("user_id").alias("users"))


@query("SELECT c_custkey AS id, c_name AS path, c_acctbal > 0 AS active FROM customer UNION ALL SELECT 1000000000 + s_suppkey, s_name, true FROM supplier")
def appended_rows(spark: SparkSession, d: str) -> DataFrame:
    """Customers as sources of a store, to which suppliers are appended."""
    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    c, s = read(spark, d, "customer"), read(spark, d, "supplier")
    named = lambda df: df.withColumn("label", F.col("path")).withColumn("created_at", F.current_timestamp())
    store.append({"sources": named(c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("path"), (F.col("c_acctbal") > 0).alias("active")))})
    store.append({"sources": named(s.select((F.lit(1_000_000_000) + F.col("s_suppkey")).cast("long").alias("id"), F.col("s_name").alias("path"), F.lit(True).alias("active")))})
    return store.read("sources").select("id", "path", "active")


@query("SELECT c_custkey AS id, substr(sha256(c_name || chr(1) || c_mktsegment), 1, 32) AS stable FROM customer")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), stable_id(F.col("c_name"), F.col("c_mktsegment")).alias("stable"))
