"""Catalogue queries: manifests, splits, licences, held-out sets."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auralake.functions import scalars as S
from auralake.operators import catalog as C
from auralake.operators import digests as D
from auralake.operators import tables as T
from auralake.plans.base import HASH8, MANIFEST, Tables, query
from auralake.sources import scans

M = "WITH " + MANIFEST


@query(M + """SELECT source_id, corpus, kind, group_id, speaker_id, replace(path, '\\', '/') AS path, duration_s, licence, split, sha1, noise_class FROM manifest
QUALIFY sha1 = '' OR row_number() OVER (PARTITION BY sha1 ORDER BY pos) = 1""")
def manifest_write(t: Tables) -> DataFrame:
    """The manifest as it is written: one row a known content, forward slashes, fixed columns."""
    return C.read_manifest(C.keep_first(t.manifest, ["sha1"], ["pos"], blank_is_unique=True)).select(*C.MANIFEST_COLUMNS)


@query(M + "SELECT split, kind, count(*) AS n, count(DISTINCT group_id) AS groups FROM manifest GROUP BY ALL")
def split_assign(t: Tables) -> DataFrame:
    return t.manifest.groupBy("split", "kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("group_id").alias("groups"))


@query(f"SELECT doc_id, {HASH8.format('source')} AS h FROM documents WHERE {HASH8.format('source')} % 3 = 0")
def hash_holdout(t: Tables) -> DataFrame:
    """Groups held out by their hash."""
    return t.documents.select("doc_id", S.stable_hash("source").alias("h")).filter("h % 3 = 0")


@query(M + f"SELECT corpus, arg_min(speaker_id, {HASH8.format('speaker_id')}) AS speaker_id FROM manifest GROUP BY corpus")
def argmin_group(t: Tables) -> DataFrame:
    """Of each corpus the speaker with the smallest hash."""
    return t.manifest.groupBy("corpus").agg(F.min_by("speaker_id", S.stable_hash("speaker_id")).alias("speaker_id"))


@query(M + """SELECT corpus, kind, licence, count(*) AS clips, round(sum(duration_s) / 3600, 9) AS hours,
  CASE WHEN lower(licence) LIKE '%by-nc%' OR lower(licence) LIKE '%research only%' THEN 'no' WHEN lower(licence) LIKE '%cc by%' OR lower(licence) LIKE '%cc0%' OR lower(licence) LIKE '%mit%' THEN 'yes' ELSE 'unclear' END AS commercial,
  CASE WHEN lower(licence) LIKE '%by-nc%' THEN 'CC BY-NC' WHEN lower(licence) LIKE '%research only%' THEN 'research' WHEN lower(licence) LIKE '%cc by%' THEN 'CC BY' WHEN lower(licence) LIKE '%cc0%' THEN 'CC0' WHEN lower(licence) LIKE '%mit%' THEN 'MIT' ELSE licence END AS short
  FROM manifest GROUP BY corpus, kind, licence""")
def licence_rollup(t: Tables) -> DataFrame:
    return C.licence_rollup(t.manifest)


@query(M + """SELECT source_id, noise_class AS was, CASE WHEN corpus = 'src1' AND noise_class = 'impulsive' THEN 'changing' WHEN kind = 'speech' THEN '' ELSE noise_class END AS noise_class
  FROM manifest WHERE noise_class <> CASE WHEN corpus = 'src1' AND noise_class = 'impulsive' THEN 'changing' WHEN kind = 'speech' THEN '' ELSE noise_class END""")
def relabel_change(t: Tables) -> DataFrame:
    """Rows whose noise class a rule changes."""
    rules = [((F.col("corpus") == "src1") & (F.col("noise_class") == "impulsive"), "changing"), (F.col("kind") == "speech", "")]
    return C.relabel(t.manifest, "noise_class", rules).filter("was <> noise_class").select("source_id", "was", "noise_class")


@query(M + """SELECT source_id, round(speech_s / greatest(duration_s, 1e-6), 9) AS speech_frac, speech_s >= 0.5 AND speech_s / greatest(duration_s, 1e-6) >= 0.1 AS flagged
  FROM (SELECT *, duration_s * (pos % 10) / 20.0::DOUBLE AS speech_s FROM manifest)""")
def contamination_flag(t: Tables) -> DataFrame:
    rows = t.manifest.withColumn("speech_s", F.col("duration_s") * (F.col("pos") % 10) / 20.0)
    return rows.select("source_id", F.round(F.col("speech_s") / F.greatest("duration_s", F.lit(1e-6)), 9).alias("speech_frac"), C.contaminated("speech_s", "duration_s").alias("flagged"))


@query(M + f""", v AS (SELECT *, CASE WHEN pos % 4 > 0 THEN 'v' || (pos % 37) ELSE '' END AS vid FROM manifest),
w AS (SELECT source_id, CASE WHEN vid <> '' THEN 'video-' || vid ELSE group_id END AS group_id FROM v)
SELECT *, CASE WHEN {HASH8.format('group_id')} % 10 < 8 THEN 'train' WHEN {HASH8.format('group_id')} % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM w""")
def video_regroup(t: Tables) -> DataFrame:
    video = F.when(F.col("pos") % 4 > 0, F.concat(F.lit("v"), F.col("pos") % 37)).otherwise("")
    return C.regroup(t.manifest, video).select("source_id", "group_id", "split")


@query(M + """SELECT tag, count(*) AS n, count(DISTINCT group_id) AS groups FROM (SELECT group_id, unnest(CASE noise_class WHEN 'stationary' THEN ['engine', 'vehicle'] WHEN 'changing' THEN ['babble']
  WHEN 'impulsive' THEN ['gunshot', 'impulsive'] ELSE ['general'] END) AS tag FROM manifest) GROUP BY tag""")
def scene_tags(t: Tables) -> DataFrame:
    classes = {"stationary": ["engine", "vehicle"], "changing": ["babble"], "impulsive": ["gunshot", "impulsive"]}
    rows = C.tagged(t.manifest, classes, ["general"]).select("group_id", F.explode("tags").alias("tag"))
    return rows.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("group_id").alias("groups"))


@query(M + """, a AS (SELECT sha1, count(*) AS n_a FROM manifest WHERE corpus = 'src0' AND sha1 <> '' GROUP BY 1), b AS (SELECT sha1, count(*) AS n_b FROM manifest WHERE corpus <> 'src0' AND sha1 <> '' GROUP BY 1)
SELECT sha1, n_a, n_b FROM a JOIN b USING (sha1)""")
def heldout_overlap(t: Tables) -> DataFrame:
    """Contents that the held-out corpus shares with others."""
    m = t.manifest
    return C.overlap(m.filter("corpus = 'src0'"), m.filter("corpus <> 'src0'"), "sha1")


@query(M + """, held AS (SELECT source_id, speaker_id FROM manifest WHERE corpus = 'src2')
SELECT source_id, speaker_id, split FROM manifest WHERE speaker_id IN (SELECT speaker_id FROM held) AND source_id NOT IN (SELECT source_id FROM held) AND split <> 'test'""")
def sibling_semi(t: Tables) -> DataFrame:
    """Rows that share a speaker with the held-out corpus."""
    m = t.manifest
    return C.siblings(m, m.filter("corpus = 'src2'"), F.col("speaker_id"), "source_id").select("source_id", "speaker_id", "split")


@query(M + """, ids AS (SELECT group_id AS id FROM manifest WHERE corpus = 'src3' AND pos % 5 = 0 UNION SELECT speaker_id FROM manifest WHERE pos % 41 = 0)
SELECT source_id FROM manifest WHERE group_id NOT IN (SELECT id FROM ids) AND speaker_id NOT IN (SELECT id FROM ids) AND source_id NOT IN (SELECT id FROM ids)""")
def group_antijoin(t: Tables) -> DataFrame:
    m = t.manifest
    ids = m.filter("corpus = 'src3' AND pos % 5 = 0").select(F.col("group_id").alias("id")).union(m.filter("pos % 41 = 0").select("speaker_id"))
    return C.drop_groups(m, ids.distinct()).select("source_id")


@query(M + "SELECT DISTINCT speaker_id FROM manifest WHERE kind = 'noise' EXCEPT SELECT speaker_id FROM manifest WHERE corpus IN ('src0', 'src1', 'src2')")
def keyset_diff(t: Tables) -> DataFrame:
    m = t.manifest
    return m.filter("kind = 'noise'").select("speaker_id").subtract(m.filter(F.col("corpus").isin("src0", "src1", "src2")).select("speaker_id"))


@query(M + """, listed AS (SELECT source_id AS id FROM manifest WHERE pos % 9 = 0 UNION ALL SELECT 'gone:' || pos FROM manifest WHERE pos < 3)
SELECT count(*) AS listed, count(m.source_id) AS found, CASE WHEN count(m.source_id) = count(*) THEN 'ok' WHEN count(m.source_id) > 0 THEN 'WARN' ELSE 'FAIL' END AS verdict
FROM listed LEFT JOIN manifest m ON m.source_id = listed.id""")
def listed_ids_check(t: Tables) -> DataFrame:
    m = t.manifest
    listed = m.filter("pos % 9 = 0").select("source_id").union(m.filter("pos < 3").select(F.concat(F.lit("gone:"), "pos")))
    return C.listed_check(listed, m, "source_id")


@query(M + "SELECT corpus, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest, count(*) AS n FROM (SELECT corpus, source_id || ',' || sha1 || ',' || split AS line FROM manifest) GROUP BY corpus")
def content_digest(t: Tables) -> DataFrame:
    """A hash of each corpus' rows, in sorted order."""
    return C.content_digest(t.manifest, F.concat_ws(",", "source_id", "sha1", "split"), ["corpus"])


#: The tree of a CTE ``lines`` (corpus, key, line), as in the operator.
TREE = """leaves AS (SELECT corpus, substr(sha1(key), 1, 3) AS node, sha256(string_agg(sha256(line), chr(10) ORDER BY sha256(line))) AS digest, count(*) AS n FROM lines GROUP BY ALL),
l2 AS (SELECT corpus, substr(node, 1, 2) AS node, sha256(string_agg(node || ':' || digest, chr(10) ORDER BY node)) AS digest, sum(n) AS n FROM leaves GROUP BY corpus, substr(leaves.node, 1, 2)),
l1 AS (SELECT corpus, substr(node, 1, 1) AS node, sha256(string_agg(node || ':' || digest, chr(10) ORDER BY node)) AS digest, sum(n) AS n FROM l2 GROUP BY corpus, substr(l2.node, 1, 1)),
l0 AS (SELECT corpus, '' AS node, sha256(string_agg(node || ':' || digest, chr(10) ORDER BY node)) AS digest, sum(n) AS n FROM l1 GROUP BY corpus)"""


@query(M + f""", lines AS (SELECT corpus, source_id AS key, source_id || ',' || sha1 || ',' || split AS line FROM manifest), {TREE}
SELECT corpus, node, digest, n::BIGINT AS n FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM leaves)""")
def block_digests(t: Tables) -> DataFrame:
    """Each corpus' rows as a tree of digests over fixed blocks, its root first; no corpus is in one task."""
    return D.line_tree(t.manifest, F.concat_ws(",", "source_id", "sha1", "split"), F.col("source_id"), ["corpus"])


@query(M + """, a AS (SELECT corpus, source_id, source_id || ',' || sha1 || ',' || split AS line FROM manifest WHERE pos % 97 <> 5),
b AS (SELECT corpus, source_id, source_id || ',' || sha1 || ',' || CASE WHEN pos % 89 = 3 THEN 'held' ELSE split END AS line FROM manifest WHERE pos % 83 <> 7)
SELECT coalesce(a.corpus, b.corpus) AS corpus, coalesce(a.source_id, b.source_id) AS key, CASE WHEN a.line IS NULL THEN 'added' WHEN b.line IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b USING (corpus, source_id) WHERE a.line IS DISTINCT FROM b.line""")
def block_changes(t: Tables) -> DataFrame:
    """What differs between two versions of a manifest, found by descending from their digests."""
    m, line = t.manifest, F.concat_ws(",", "source_id", "sha1", "split")
    later = m.filter("pos % 83 <> 7").withColumn("split", F.when(F.col("pos") % 89 == 3, "held").otherwise(F.col("split")))
    return D.changed_lines(m.filter("pos % 97 <> 5"), later, line, F.col("source_id"), ["corpus"])


@query(M + """, s AS (SELECT *, sum(duration_s) OVER (PARTITION BY corpus ORDER BY source_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM manifest)
SELECT corpus, count(*) AS clips, round(sum(duration_s), 9) AS seconds FROM s WHERE coalesce(before, 0) < 2.0 GROUP BY corpus""")
def hours_cap(t: Tables) -> DataFrame:
    """Clips of each corpus, in order, until it has enough."""
    rows = C.running_total_below(t.manifest, ["corpus"], ["source_id"], "duration_s", 2.0)
    return rows.groupBy("corpus").agg(F.count(F.lit(1)).alias("clips"), F.round(F.sum("duration_s"), 9).alias("seconds"))


@query(M + """, f AS (SELECT corpus, path, min(pos) AS first, max((duration_s * 16000)::BIGINT) AS size FROM manifest GROUP BY ALL)
SELECT corpus, path, first, size, coalesce(sum(size) OVER (PARTITION BY corpus ORDER BY first, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM f""")
def pack_offsets(t: Tables) -> DataFrame:
    """Where each file starts in its corpus' pack."""
    return C.packed_offsets(t.manifest, ["corpus"], "path", "pos", F.round(F.col("duration_s") * 16000).cast("long"))


@query(M + """SELECT source_id FROM manifest WHERE NOT EXISTS (SELECT 1 FROM (SELECT source_id AS s, pos FROM manifest WHERE pos % 3 = 0) d WHERE d.s = manifest.source_id)""")
def resume_missing(t: Tables) -> DataFrame:
    """Work that has no finished row yet."""
    m = t.manifest.select("source_id", "pos")
    return C.pending(m, m.filter("pos % 3 = 0"), ["source_id"]).select("source_id")


@query("""WITH done AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) SELECT DISTINCT conv_id FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM done WHERE n >= 5)""")
def resume_complete(t: Tables) -> DataFrame:
    """Items that have fewer rows than a finished one needs."""
    c = t.conversations
    return C.pending(c.select("conv_id").distinct(), c, ["conv_id"], parts=5)


@query("""SELECT event_id, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY CASE event_type WHEN 'purchase' THEN 0 ELSE 1 END, value DESC, event_id) = 1""")
def priority_dedupe(t: Tables) -> DataFrame:
    """One row of each key, by priority and then order."""
    order = [F.when(F.col("event_type") == "purchase", 0).otherwise(1), F.desc("value"), F.col("event_id")]
    return C.keep_first(t.events, ["user_id", "event_type"], order).select("event_id", "user_id", "event_type", "value")


@query(M + """, base AS (SELECT source_id, source_id LIKE 'doc:%' AS a, duration_s > 0.01 AS b, kind IN ('speech', 'noise') AS c, sha1 <> '' OR noise_class <> '' AS d FROM manifest)
SELECT source_id AS key, 'duration' AS rule FROM base WHERE NOT b UNION ALL SELECT source_id, 'kind' FROM base WHERE NOT c UNION ALL SELECT source_id, 'content' FROM base WHERE NOT d""")
def registry_violations(t: Tables) -> DataFrame:
    """Rules that rows break, all in one pass."""
    rules = {"duration": F.col("duration_s") > 0.01, "kind": F.col("kind").isin("speech", "noise"), "content": (F.col("sha1") != "") | (F.col("noise_class") != "")}
    return T.violations(t.manifest, F.col("source_id"), rules)


@query(M + """SELECT name, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN split = 'train' AND kind = 'noise' THEN 'train_noise' END, CASE WHEN split = 'train' AND noise_class = 'impulsive' THEN 'train_impulsive' END,
  CASE WHEN split <> 'train' THEN 'held' END, CASE WHEN corpus = 'src5' THEN 'src5' END], lambda x: x IS NOT NULL)) AS name FROM manifest) GROUP BY name""")
def named_pools(t: Tables) -> DataFrame:
    """Overlapping pools of a manifest and their sizes."""
    train = F.col("split") == "train"
    pools = {"train_noise": train & (F.col("kind") == "noise"), "train_impulsive": train & (F.col("noise_class") == "impulsive"), "held": ~train, "src5": F.col("corpus") == "src5"}
    return T.labelled(t.manifest, pools, "name").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query(M + """, r AS (SELECT *, ('0x' || substr(sha1('7|' || source_id), 1, 8))::BIGINT AS h FROM manifest), o AS (SELECT group_id, arg_min({'h': h, 's': source_id}, {'h': h, 's': source_id}) AS r FROM r GROUP BY 1)
SELECT r.s AS source_id, group_id FROM o ORDER BY r.h, r.s LIMIT 25""")
def one_per_group_sample(t: Tables) -> DataFrame:
    return T.one_per_group(t.manifest, "group_id", "source_id", 7, 25).select("source_id", "group_id")


@query(M + "SELECT corpus, source_id FROM manifest QUALIFY row_number() OVER (PARTITION BY corpus ORDER BY path) <= 3")
def first_k_per_bucket(t: Tables) -> DataFrame:
    return T.first_k(t.manifest, ["corpus"], ["path"], 3).select("corpus", "source_id")


@query("SELECT coalesce(a.source, b.source) AS source, a.n AS n_a, b.n AS n_b FROM (SELECT source, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY 1) a FULL JOIN (SELECT source, count(*) AS n FROM documents WHERE n_chars > 8000 AND lang <> 'en' GROUP BY 1) b USING (source) WHERE a.source IS NULL OR b.source IS NULL")
def symmetric_difference(t: Tables) -> DataFrame:
    """Keys that only one of two sets holds."""
    a = t.documents.filter("lang = 'en'").groupBy("source").agg(F.count(F.lit(1)).alias("n_a"))
    b = t.documents.filter("n_chars > 8000 AND lang <> 'en'").groupBy("source").agg(F.count(F.lit(1)).alias("n_b"))
    return a.join(b, "source", "full").filter("n_a IS NULL OR n_b IS NULL")


@query("SELECT text FROM (SELECT DISTINCT sha1(text) AS text FROM documents WHERE source = 'src0') INTERSECT SELECT sha1(text) FROM documents WHERE source <> 'src0'")
def hash_intersection(t: Tables) -> DataFrame:
    h = t.documents.select("source", F.sha1(F.col("text").cast("binary")).alias("text"))
    return h.filter("source = 'src0'").select("text").intersect(h.filter("source <> 'src0'").select("text"))


@query("SELECT d.doc_id, quality, toxic, coalesce(quality, -1) AS quality_or FROM documents d LEFT JOIN labels l USING (doc_id)")
def annotation_join(t: Tables) -> DataFrame:
    """Documents with their labels where they have some; labels that name a document twice would fail the job."""
    return T.many_to_one(t.documents.select("doc_id"), t.labels, ["doc_id"]).withColumn("quality_or", F.coalesce("quality", F.lit(-1)))


@query("""WITH a AS (SELECT source, regexp_extract(text, '^(\\S+ \\S+)', 1) AS head FROM documents),
c AS (SELECT head, source, count(*) AS rows FROM a WHERE head <> '' AND source IS NOT NULL GROUP BY ALL)
SELECT x.head, x.source, x.rows, coalesce(sum(y.rows), 0)::BIGINT AS partners, (x.rows * coalesce(sum(y.rows), 0))::BIGINT AS pairs
FROM c x LEFT JOIN c y ON x.head = y.head AND x.source < y.source GROUP BY x.head, x.source, x.rows""")
def theta_pairs(t: Tables) -> DataFrame:
    """How many pairs rows with one key make whose sources are in order: by classes of rows, as a hot key has too many pairs."""
    a = t.documents.select("source", F.regexp_extract("text", r"^(\S+ \S+)", 1).alias("head")).filter("head <> '' AND source IS NOT NULL")
    later = Window.partitionBy("head").orderBy(F.desc("source")).rowsBetween(Window.unboundedPreceding, -1)
    classes = a.groupBy("head", "source").agg(F.count(F.lit(1)).alias("rows")).withColumn("partners", F.coalesce(F.sum("rows").over(later), F.lit(0)))
    return classes.withColumn("pairs", F.col("rows") * F.col("partners"))


SCANNED = """l AS (SELECT 'data/' || source || '/' || lang || '/s' || (doc_id % 13) || '_' || doc_id || '.wav' AS path, lang, source, 's' || (doc_id % 13) || '_' || doc_id AS name, 's' || (doc_id % 13) AS speaker, n_chars / 16000.0::DOUBLE AS duration_s FROM documents)"""


def scanned_files(t: Tables) -> DataFrame:
    name = F.concat(F.lit("s"), F.col("doc_id") % 13, F.lit("_"), "doc_id")
    path = F.concat_ws("/", F.lit("data"), "source", "lang", F.concat(name, F.lit(".wav")))
    return t.documents.select(path.alias("path"), (F.col("n_chars") / 16000.0).alias("duration_s"), F.lit("").alias("sha1"), F.lit(35.0).alias("snr_db"))


@query("WITH " + SCANNED + f""" SELECT 'dns:' || name AS source_id, 'dns' AS corpus, 'speech' AS kind, 'dns-' || speaker AS group_id, speaker AS speaker_id, path, duration_s, 'CC BY 4.0' AS licence,
  CASE WHEN {HASH8.format("'dns-' || speaker")} % 10 < 8 THEN 'train' WHEN {HASH8.format("'dns-' || speaker")} % 10 = 8 THEN 'val' ELSE 'test' END AS split, '' AS sha1, '' AS noise_class FROM l""")
def scan_speech(t: Tables) -> DataFrame:
    """A speech corpus whose files begin with their speaker."""
    return scans.scan(scanned_files(t), scans.SCANS["dns_speech"]())


@query("WITH " + SCANNED + f""", k AS (SELECT *, CASE lang WHEN 'de' THEN 'stationary' WHEN 'fr' THEN 'changing' END AS cls, regexp_replace(name, '_[0-9]+_?$', '') AS g FROM l) SELECT 'langs:' || lang || '/' || name AS source_id, 'langs-' || g AS group_id, cls AS noise_class, 'test' AS split FROM k WHERE cls IS NOT NULL""")
def scan_noise(t: Tables) -> DataFrame:
    """A noise corpus whose folders name its classes, held out whole."""
    rows = scans.scan(scanned_files(t), scans.noise_by_folder("langs", "CC BY 4.0", {"de": "stationary", "fr": "changing"}, split="test"))
    return rows.select("source_id", "group_id", "noise_class", "split")


@query("WITH " + SCANNED + ", k AS (SELECT speaker FROM l WHERE lang = 'en' AND source = 'src1' EXCEPT SELECT speaker FROM l WHERE lang = 'es' AND source = 'src2') SELECT path FROM l WHERE lang = 'en' AND source = 'src1' AND speaker IN (SELECT speaker FROM k)")
def scan_only_in(t: Tables) -> DataFrame:
    """Recordings whose key only one device has."""
    files = scanned_files(t).filter(F.col("path").rlike("/src1/en/|/src2/es/"))
    return scans.only_in(files, F.split(scans.name_of(), "_")[0], F.col("path").contains("/src1/en/")).select("path")


#: A listing with the annotations that scans read, from documents: names and folders in the shapes of several corpora.
ANNOTATED = """f AS (SELECT doc_id, n_chars / 16000.0::DOUBLE AS duration_s, 'data/' || (['RIR', 'noise', 'speech'])[doc_id % 3 + 1] || '/r' || (doc_id % 7) || '/' || (['tr', 'tt', 'silence', 'p1'])[doc_id % 4 + 1] || '/' AS dir,
  (['tr', 'tt', 'silence', 'p1'])[doc_id % 4 + 1] AS up1, 'r' || (doc_id % 7) AS up2, (['RIR', 'noise', 'speech'])[doc_id % 3 + 1] AS up3,
  CASE doc_id % 5 WHEN 0 THEN 'ch01' WHEN 1 THEN 's' || doc_id % 9 || '_l_' || doc_id WHEN 2 THEN 'Nonverbal_' || doc_id WHEN 3 THEN 'clip_' || doc_id || '_3' ELSE 'a' || doc_id || '_x_y' END AS name,
  (['dog', 'sneezing', 'footsteps', 'rain'])[doc_id % 4 + 1] AS category, CASE WHEN doc_id % 3 > 0 THEN (['Gunshot_and_gunfire', 'Wind', 'Guitar'])[doc_id % 6 // 2 + 1] END AS label, 'src' || (doc_id % 11) AS src_file,
  (['http://creativecommons.org/licenses/by/3.0/', 'http://creativecommons.org/licenses/by-nc/3.0/', 'http://creativecommons.org/publicdomain/zero/1.0/', NULL])[doc_id % 4 + 1] AS file_licence,
  CASE WHEN doc_id % 2 = 0 THEN 'up' || (doc_id % 13) END AS uploader, CASE WHEN doc_id % 2 = 0 THEN 'stationary' ELSE 'changing' END AS measured_class, sha1('c' || (doc_id % 17)) AS client_id, 25.0 + doc_id % 10 AS snr_db, (doc_id % 12)::DOUBLE AS cutoff_ratio FROM documents)"""

# (scan, corpus, kind, licence, group, item, speaker, class, where) in SQL.
SCAN_SQL = (
    ("librispeech", "ls", "speech", "'CC BY 4.0'", "up2", "name", "up2", "''", "true"),
    ("ears", "ears", "speech", "'CC BY-NC 4.0'", "up1", "up1 || '/' || name", "up1", "''", "NOT regexp_matches(lower(name), '^(nonverbal|vegetative|interjection)')"),
    ("commonvoice_hi", "cv-hi", "speech", "'CC0 1.0'", "substr(client_id, 1, 16)", "name", "substr(client_id, 1, 16)", "''", "snr_db >= 30"),
    ("lombard_grid", "lg", "speech", "'CC BY 4.0'", "split_part(name, '_', 1)", "name", "split_part(name, '_', 1)", "''", "regexp_matches(name, '^s[0-9]+_[lp]_')"),
    ("dns_noise", "dns_noise", "noise", "'CC BY 4.0'", "regexp_replace(name, '_[0-9]+_?$', '')", "name", "''", "measured_class", "true"),
    ("wham", "wham", "noise", "'CC BY-NC 4.0'", "split_part(name, '_', 1)", "'tr:' || name", "''", "measured_class", "up1 = 'tr'"),
    ("demand", "demand", "noise", "'CC BY 4.0'", "up1", "up1 || '/' || name", "''", "measured_class", "name IN ('ch01', 'ch05')"),
    ("musan", "musan", "noise", "coalesce(file_licence, 'public domain')", "name", "name", "''", "measured_class", "up2 = 'noise'"),
    ("esc50", "esc50", "noise", "'CC BY-NC 3.0'", "src_file", "category || '/' || name", "''", "CASE WHEN category = 'footsteps' THEN 'impulsive' ELSE measured_class END", "category <> 'sneezing'"),
    ("fsd50k", "fsd50k", "noise", "file_licence", "coalesce(uploader, 'clip' || name)", "label || '/' || name", "''", "CASE WHEN label = 'Gunshot_and_gunfire' THEN 'impulsive' ELSE measured_class END", "label IN ('Gunshot_and_gunfire', 'Wind') AND doc_id % 4 IN (0, 2)"),
    ("noisex92", "noisex92", "noise", "'research only'", "name", "name", "''", "measured_class", "cutoff_ratio < 6"),
    ("gunshots", "gunshots", "impulse", "'CC BY 4.0'", "split_part(name, '_', 1)", "name", "''", "'impulsive'", "true"),
    ("cadre", "cadre", "impulse", "'public domain'", "name", "name", "''", "'impulsive'", "up1 NOT IN ('readme', 'silence')"),
    ("c3gd", "c3gd", "impulse", "'CC BY 4.0'", "regexp_extract(name, '^(.*?)_[^_]+$', 1)", "name", "''", "'impulsive'", "true"),
    ("but_reverbdb", "but", "rir", "'CC BY 4.0'", "up3", "up3 || '/' || up2 || '/' || name", "''", "''", "up3 = 'RIR'"),
)
ONE_SCAN = "SELECT '{1}:' || {5} AS source_id, '{1}' AS corpus, '{2}' AS kind, '{1}-' || {4} AS group_id, {6} AS speaker_id, dir || name || '.wav' AS path, duration_s, {3} AS licence, {7} AS noise_class FROM f WHERE {8}"


@query("WITH " + ANNOTATED + ", m AS (" + " UNION ALL ".join(ONE_SCAN.format(*row) for row in SCAN_SQL) + f"""), h AS (SELECT *, {HASH8.format("group_id")} % 10 AS part FROM m)
SELECT * EXCLUDE (part), CASE WHEN part < 8 THEN 'train' WHEN part = 8 THEN 'val' ELSE 'test' END AS split FROM h""")
def scan_corpora(t: Tables) -> DataFrame:
    """Fifteen scans of one annotated listing, each by its corpus' own grammar, as one manifest."""
    id = F.col("doc_id")
    one_of = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    up1, up3 = one_of(("tr", "tt", "silence", "p1"), id % 4), one_of(("RIR", "noise", "speech"), id % 3)
    name = F.when(id % 5 == 0, "ch01").when(id % 5 == 1, F.concat(F.lit("s"), id % 9, F.lit("_l_"), id)).when(id % 5 == 2, F.concat(F.lit("Nonverbal_"), id)).when(id % 5 == 3, F.concat(F.lit("clip_"), id, F.lit("_3"))).otherwise(F.concat(F.lit("a"), id, F.lit("_x_y")))
    address = "http://creativecommons.org/"
    files = t.documents.select(
        F.concat_ws("/", F.lit("data"), up3, F.concat(F.lit("r"), id % 7), up1, F.concat(name, F.lit(".wav"))).alias("path"), (F.col("n_chars") / 16000.0).alias("duration_s"), F.lit("").alias("sha1"),
        one_of(("dog", "sneezing", "footsteps", "rain"), id % 4).alias("category"), F.when(id % 3 > 0, one_of(("Gunshot_and_gunfire", "Wind", "Guitar"), F.floor(id % 6 / 2))).alias("label"), F.concat(F.lit("src"), id % 11).alias("src_file"),
        one_of((f"{address}licenses/by/3.0/", f"{address}licenses/by-nc/3.0/", f"{address}publicdomain/zero/1.0/", None), id % 4).alias("file_licence"), F.when(id % 2 == 0, F.concat(F.lit("up"), id % 13)).alias("uploader"),
        F.when(id % 2 == 0, "stationary").otherwise("changing").alias("measured_class"), F.sha1(F.concat(F.lit("c"), id % 17).cast("binary")).alias("client_id"), (25.0 + id % 10).alias("snr_db"), (id % 12).cast("double").alias("cutoff_ratio"),
    )
    found = [scans.scan(files, scans.SCANS[row[0]]()) for row in SCAN_SQL]
    return functools.reduce(DataFrame.unionByName, found).drop("sha1")
