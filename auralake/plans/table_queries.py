"""Joins, sampling, reshaping, ordering and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auralake.functions import scalars as S
from auralake.operators import stats as X
from auralake.operators import tables as T
from auralake.plans.base import FACT, MANIFEST, NOMINAL, Tables, query
from auralake.plans.stats_queries import H, METRICS, U, r9

W = "WITH " + FACT


@query("SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(t: Tables) -> DataFrame:
    """Keys that a validated load refuses."""
    return T.repeated(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("""WITH meta AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN lang END AS lang, CASE WHEN doc_id % 4 > 0 THEN source END AS source FROM documents), idx AS (SELECT doc_id, upper(lang) AS lang, 'i:' || source AS source FROM documents WHERE doc_id % 5 > 0)
SELECT doc_id, coalesce(nullif(trim(m.lang), ''), nullif(trim(i.lang), '')) AS lang, coalesce(nullif(trim(m.source), ''), nullif(trim(i.source), '')) AS source FROM meta m LEFT JOIN idx i USING (doc_id)""")
def left_enrich(t: Tables) -> DataFrame:
    """Own values first; an index fills what is missing or blank."""
    d, id = t.documents, F.col("doc_id")
    meta = d.select("doc_id", F.when(id % 3 == 0, "").when(id % 3 == 1, F.col("lang")).alias("lang"), F.when(id % 4 > 0, F.col("source")).alias("source"))
    index = d.filter("doc_id % 5 > 0").select("doc_id", F.upper("lang").alias("lang"), F.concat(F.lit("i:"), "source").alias("source"))
    return T.enrich(meta, index, ["doc_id"], ["lang", "source"])


@query("""WITH e AS (SELECT event_id, user_id, event_type, epoch(ts) AS s FROM events) SELECT event_id, user_id FROM e a WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM e b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND abs(b.s - a.s) <= 21600)""")
def time_tolerance_join(t: Tables) -> DataFrame:
    """Clicks with a purchase of the same user at most six hours away."""
    e = t.events.select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).withColumn("s", F.col("us") / 1e6)
    return T.within(e.filter("event_type = 'click'"), e.filter("event_type = 'purchase'").select("user_id", "s"), ["user_id"], "s", 21600.0).select("event_id", "user_id")


@query(W + ", b AS (SELECT *, CASE WHEN snr_in < 0 THEN 'low' WHEN snr_in < 10 THEN 'mid' ELSE 'high' END AS band FROM fact) SELECT system, band, count(*) AS n, round(avg(snr_out), 6) AS snr_out FROM b GROUP BY ALL")
def snr_bands(t: Tables) -> DataFrame:
    bands = [(float("-inf"), 0.0, "low"), (0.0, 10.0, "mid"), (10.0, float("inf"), "high")]
    return t.fact.withColumn("band", T.banded("snr_in", bands)).groupBy("system", "band").agg(F.count(F.lit(1)).alias("n"), r9(F.avg("snr_out")).alias("snr_out"))


@query(W + "SELECT bucket, round(avg(CASE WHEN system = 'A' THEN snr_out END), 6) AS \"A\", round(avg(CASE WHEN system = 'N' THEN snr_out END), 6) AS \"N\", round(avg(CASE WHEN system = 'R' THEN snr_out END), 6) AS \"R\" FROM fact GROUP BY bucket")
def system_pivot(t: Tables) -> DataFrame:
    return t.fact.groupBy("bucket").pivot("system", ["A", "N", "R"]).agg(r9(F.avg("snr_out")))


@query(W + "SELECT bucket, id, max(CASE WHEN system = 'A' THEN snr_out END) AS \"A_snr\", max(CASE WHEN system = 'A' THEN stoi END) AS \"A_stoi\", max(CASE WHEN system = 'R' THEN snr_out END) AS \"R_snr\", max(CASE WHEN system = 'R' THEN stoi END) AS \"R_stoi\" FROM fact GROUP BY bucket, id")
def variant_pivot(t: Tables) -> DataFrame:
    """One row an item, a column each variant and metric."""
    return t.fact.groupBy("bucket", "id").pivot("system", ["A", "R"]).agg(F.max("snr_out").alias("snr"), F.max("stoi").alias("stoi"))


@query(W + "SELECT system, bucket, metric, round(avg(value), 6) AS mean, count(*) AS n FROM (SELECT system, bucket, unnest(['snr_out', 'stoi', 'pesq_wb']) AS metric, unnest([snr_out, stoi, pesq_wb]) AS value FROM fact) GROUP BY ALL")
def cells_unpivot(t: Tables) -> DataFrame:
    """Long cells: one row a metric."""
    long = t.fact.unpivot(["system", "bucket"], METRICS, "metric", "value")
    return long.groupBy("system", "bucket", "metric").agg(r9(F.avg("value")).alias("mean"), F.count(F.lit(1)).alias("n"))


@query(W + """SELECT system, n, row_number() OVER (ORDER BY CASE system WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 999 END, system)::BIGINT AS place FROM (SELECT system, count(*) AS n FROM fact GROUP BY system)""")
def declared_order(t: Tables) -> DataFrame:
    """Systems in a declared order, the others after them by name."""
    from pyspark.sql import Window

    rows = t.fact.groupBy("system").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*T.ordered_by_list("system", ["R", "A"]))).cast("long"))


@query("SELECT c_custkey, c_acctbal, (row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1) % 4 AS lane FROM customer WHERE c_mktsegment = 'BUILDING'")
def lane_assign(t: Tables) -> DataFrame:
    """Jobs dealt round robin by priority."""
    jobs = t.customer.filter("c_mktsegment = 'BUILDING'").select("c_custkey", "c_acctbal")
    return T.lanes(jobs, [F.desc("c_acctbal"), "c_custkey"], 4).withColumn("lane", F.col("lane").cast("long"))


@query(f"""WITH d AS (SELECT doc_id, {U.format("'11|' || doc_id")} AS u FROM documents) SELECT CASE WHEN u < 0.5 THEN 'patrol' WHEN u < 0.8 THEN 'convoy' ELSE 'post' END AS scene, count(*) AS n FROM d GROUP BY 1""")
def weighted_draw(t: Tables) -> DataFrame:
    rows = T.weighted_draw(t.documents, S.uniform(11, F.col("doc_id")), [("patrol", 5.0), ("convoy", 3.0), ("post", 2.0)], "scene")
    return rows.groupBy("scene").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH d AS (SELECT doc_id, {U.format("'u|' || doc_id")} AS u, {U.format("'v|' || doc_id")} AS v FROM documents)
SELECT doc_id, round(-5 + u * 20, 6) AS uniform, round(15 - 20 * sqrt(1 - u), 6) AS triangular, round(CASE WHEN u < 0.6 THEN -5 + v * 5 WHEN u < 0.9 THEN v * 5 ELSE 5 + v * 10 END, 6) AS stratified FROM d""")
def snr_sampling(t: Tables) -> DataFrame:
    u, v = S.uniform("u", F.col("doc_id")), S.uniform("v", F.col("doc_id"))
    return t.documents.select(
        "doc_id", r9(T.sampled_snr(u, v, "uniform", -5.0, 15.0)).alias("uniform"), r9(T.sampled_snr(u, v, "triangular_low", -5.0, 15.0)).alias("triangular"),
        r9(T.sampled_snr(u, v, "stratified", -5.0, 15.0, [-5.0, 0.0, 5.0, 15.0], [6.0, 3.0, 1.0])).alias("stratified"),
    )


@query("WITH " + MANIFEST + f""", pool AS (SELECT unnest(CASE noise_class WHEN 'stationary' THEN ['engine', 'vehicle'] WHEN 'changing' THEN ['babble'] ELSE ['general'] END) AS tag, group_id, source_id FROM manifest),
g AS (SELECT tag, group_id, row_number() OVER (PARTITION BY tag ORDER BY group_id) - 1 AS g, count(*) OVER (PARTITION BY tag) AS groups FROM (SELECT DISTINCT tag, group_id FROM pool)),
r AS (SELECT tag, group_id, source_id, row_number() OVER (PARTITION BY tag, group_id ORDER BY source_id) - 1 AS r, count(*) OVER (PARTITION BY tag, group_id) AS rows FROM pool),
q AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN ['engine', 'siren'] WHEN 1 THEN ['vehicle', 'babble'] ELSE ['general'] END AS tags FROM orders),
t AS (SELECT o_orderkey, list(tag ORDER BY p) AS tags FROM (SELECT o_orderkey, unnest(tags) AS tag, unnest(range(len(tags))) AS p FROM q) WHERE tag IN (SELECT tag FROM pool) GROUP BY 1),
c AS (SELECT o_orderkey, tags[({H.format("'5|tag|' || o_orderkey")} % len(tags)) + 1] AS tag FROM t),
d AS (SELECT c.o_orderkey, c.tag, g.group_id, g.g FROM c JOIN g ON g.tag = c.tag AND g.g = {H.format("'5|group|' || c.o_orderkey")} % g.groups)
SELECT d.o_orderkey, d.tag, r.source_id FROM d JOIN r ON r.tag = d.tag AND r.group_id = d.group_id AND r.r = {H.format("'5|row|' || d.o_orderkey")} % r.rows""")
def scene_pool_draw(t: Tables) -> DataFrame:
    """A row for each request: a tag among those with rows, then a group, then a row."""
    from auralake.operators import catalog as C

    pool = C.tagged(t.manifest, {"stationary": ["engine", "vehicle"], "changing": ["babble"]}, ["general"])
    k = F.col("o_orderkey")
    tags = F.when(k % 3 == 0, F.array(F.lit("engine"), F.lit("siren"))).when(k % 3 == 1, F.array(F.lit("vehicle"), F.lit("babble"))).otherwise(F.array(F.lit("general")))
    requests = t.orders.select("o_orderkey", tags.alias("tags"))
    return T.pool_draw(requests, T.pool_index(pool, "tags", "group_id", "source_id"), 5, "o_orderkey", "source_id")


@query("""SELECT r_name, c.category, s.snr, i.item, r_name || '_' || c.category || '_' || s.snr || '_' || i.item AS key FROM region, (VALUES ('gunshot'), ('patrol')) c(category), (VALUES (-5), (0), (5)) s(snr), range(3) i(item)""")
def work_grid(t: Tables) -> DataFrame:
    """Every category, SNR and item to render: fixed dimensions, crossed."""
    dims = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(s).alias("snr")) for c in ("gunshot", "patrol") for s in (-5, 0, 5)])
    rows = t.region.select("r_name", F.explode(dims).alias("d")).select("r_name", "d.*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("item"))
    return rows.select("r_name", "category", "snr", F.col("item").cast("long").alias("item"), F.concat_ws("_", "r_name", "category", "snr", "item").alias("key"))


@query("""WITH a AS (SELECT p_partkey, list_sort([p_brand, p_type, p_size::VARCHAR]) AS ids FROM part), b AS (SELECT list(DISTINCT p_brand) AS banned FROM part WHERE p_size = 7)
SELECT p_partkey, list_has_any(ids, banned) AS shared FROM a, b""")
def id_list_overlap(t: Tables) -> DataFrame:
    """Rows whose list of ids meets a list of banned ones."""
    banned = t.part.filter("p_size = 7").select(F.col("p_brand").alias("id")).distinct().withColumn("hit", F.lit(True))
    rows = t.part.select("p_partkey", F.explode(F.array("p_brand", "p_type", F.col("p_size").cast("string"))).alias("id")).join(banned, "id", "left")
    return rows.groupBy("p_partkey").agg(F.coalesce(F.max("hit"), F.lit(False)).alias("shared"))


@query("""WITH v AS (SELECT vec_id, label, sha1(array_to_string(list_transform(embedding[1:4], lambda x: round(x::DOUBLE, 1)::DECIMAL(9,1)::VARCHAR), '|')) AS h FROM embeddings)
SELECT a.label AS label_a, count(*) AS pairs FROM v a JOIN v b ON a.h = b.h AND a.vec_id < b.vec_id GROUP BY a.label""")
def parameter_overlap(t: Tables) -> DataFrame:
    """Pairs of items whose drawn parameters hash the same, counted from places in the order of hashes and ids, not by meeting."""
    text = F.array_join(F.transform(F.slice("embedding", 1, 4), lambda x: F.round(x.cast("double"), 1).cast("decimal(9,1)").cast("string")), "|")
    v = t.embeddings.select("vec_id", "label", F.sha1(text.cast("binary")).alias("h"))
    placed = T.ranked(v.filter("h is not null and vec_id is not null"), ["h", "vec_id"])
    ends = placed.groupBy("h", "vec_id").agg(F.max("rank").alias("own"))
    last = ends.groupBy("h").agg(F.max("own").alias("last"))
    # Partners of a row stand behind all rows of its own hash and id.
    partners = placed.join(ends, ["h", "vec_id"]).join(last, "h").withColumn("n", F.col("last") - F.col("own"))
    return partners.filter("n > 0").groupBy(F.col("label").alias("label_a")).agg(F.sum("n").alias("pairs"))


@query("""SELECT event_id, max((event_type = 'purchase')::INT) OVER (PARTITION BY user_id, date_trunc('day', ts)) = 1 AS day_has_purchase FROM events""")
def membership_flag(t: Tables) -> DataFrame:
    """Whether the group a row belongs to holds one of a kind."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", F.date_trunc("day", F.col("ts")))
    return t.events.select("event_id", (F.max((F.col("event_type") == "purchase").cast("int")).over(w) == 1).alias("day_has_purchase"))


@query(W + f""", m AS (SELECT system, unnest(['snr_out', 'stoi', 'pesq_wb']) AS metric, unnest([avg(snr_out), avg(stoi), avg(pesq_wb)]) AS mean FROM fact WHERE {NOMINAL} GROUP BY system),
r(metric, margin, up) AS (VALUES ('snr_out', 0.5::DOUBLE, true), ('stoi', 0.005::DOUBLE, true), ('pesq_wb', 0.05::DOUBLE, true)), d AS (SELECT b.system, metric, b.mean - a.mean AS d, margin FROM m b JOIN m a USING (metric) JOIN r USING (metric) WHERE a.system = 'A' AND b.system <> 'A')
SELECT system, metric, round(d, 6) AS d, CASE WHEN d - margin > 0 THEN 'superior' WHEN d - margin >= -margin THEN 'non_inferior' WHEN d + margin < -margin THEN 'inferior' ELSE 'inconclusive' END AS decision FROM d""")
def comparison_report(t: Tables) -> DataFrame:
    """Every metric of every system against the control, by a registry of margins."""
    registry = t.rows("metric string, margin double, up boolean", ("snr_out", 0.5, True), ("stoi", 0.005, True), ("pesq_wb", 0.05, True))
    m = t.fact.filter(X.nominal()).groupBy("system").agg(*[F.avg(c).alias(c) for c in METRICS]).unpivot("system", METRICS, "metric", "mean")
    base = m.filter("system = 'A'").select("metric", F.col("mean").alias("base"))
    d = m.filter("system <> 'A'").join(base, "metric").join(registry, "metric").withColumn("d", F.col("mean") - F.col("base"))
    return d.select("system", "metric", r9(F.col("d")).alias("d"), X.decide(F.col("d") - F.col("margin"), F.col("d") + F.col("margin"), F.col("margin"), F.col("up")).alias("decision"))


@query(W + """, g AS (SELECT system, bucket, bool_and(ok) AS all_ok FROM (SELECT system, bucket, noise_class, round(avg(stoi), 9) > 0.899 AS ok FROM fact GROUP BY ALL) GROUP BY ALL)
SELECT system, min(CASE WHEN all_ok THEN bucket END) AS first FROM g GROUP BY system""")
def freeze_variant(t: Tables) -> DataFrame:
    """The first variant of each family whose gates all hold."""
    ok = t.fact.groupBy("system", "bucket", "noise_class").agg((F.round(F.avg("stoi"), 9) > 0.899).alias("ok")).groupBy("system", "bucket").agg(F.every("ok").alias("all_ok"))
    return ok.groupBy("system").agg(F.min(F.when(F.col("all_ok"), F.col("bucket"))).alias("first"))


@query("""WITH a AS (SELECT 'f' || doc_id AS path, sha1(text) AS sha FROM documents), b AS (SELECT 'f' || doc_id AS path, CASE WHEN doc_id % 14 = 0 THEN sha1(text || 'x') ELSE sha1(text) END AS sha FROM documents WHERE doc_id % 10 > 0)
SELECT 'changed or gone' AS what, path FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'changed or new', path FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def protocol_check(t: Tables) -> DataFrame:
    """Files that differ from a frozen list, either way."""
    d = t.documents
    path, sha = F.concat(F.lit("f"), "doc_id").alias("path"), lambda c: F.sha1(c.cast("binary")).alias("sha")
    a = d.select(path, sha(F.col("text")))
    b = d.filter("doc_id % 10 > 0").select(path, sha(F.when(F.col("doc_id") % 14 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))))
    return a.exceptAll(b).select(F.lit("changed or gone").alias("what"), "path").union(b.exceptAll(a).select(F.lit("changed or new"), "path"))


@query("SELECT s_suppkey, n_name, row_number() OVER (PARTITION BY n_name ORDER BY " + H.format("'blind|' || s_suppkey") + ", s_suppkey)::BIGINT AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def blinded_key(t: Tables) -> DataFrame:
    """A hidden order of the versions of each clip."""
    from pyspark.sql import Window

    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    order = Window.partitionBy("n_name").orderBy(S.draw("blind", F.col("s_suppkey")), "s_suppkey")
    return rows.select("s_suppkey", "n_name", F.row_number().over(order).cast("long").alias("place"))


@query("""SELECT o_orderpriority, o_orderstatus, n, sum(n) OVER (ORDER BY o_orderpriority, o_orderstatus)::BIGINT AS upto, n >= 500 AND o_orderstatus <> 'P' AS ready FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)""")
def queue_state(t: Tables) -> DataFrame:
    """Jobs with what is ahead of them and whether they may start."""
    from pyspark.sql import Window

    jobs = t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy("o_orderpriority", "o_orderstatus"))
    return jobs.withColumn("upto", upto).withColumn("ready", (F.col("n") >= 500) & (F.col("o_orderstatus") != "P"))


@query("""SELECT conv_id, map_from_entries(list({'k': turn, 'v': role} ORDER BY turn))[2] AS second, count(*) AS turns FROM conversations GROUP BY conv_id""")
def config_map(t: Tables) -> DataFrame:
    """Rows of an item as a map, and one of its values."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("turn", "role"))))
    return t.conversations.groupBy("conv_id").agg(F.element_at(entries, F.lit(2).cast("long")).alias("second"), F.count(F.lit(1)).alias("turns"))
