"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auralake.llm import embeddings, fingerprints, simhash, token_files, tokens, toxicity, warc
from auralake.llm.filter_audit import filter_audit
from auralake.llm.licenses import COVERED, NEIGHBOURS, NOTICES, PHRASES, STRETCH, findings, license_scan
from auralake.llm.mixing import poisson_mix, tempered_targets
from auralake.llm.packing import pack
from auralake.llm.sharding import extendible_shards
from auralake.llm.spelling import spelling_variants
from auralake.llm.token_counts import prefix_counts
from auralake.session import shared_path

#: Bytes of text that a shard holds at most.
SHARD_LIMIT = 1 << 20
#: Tokens beyond which a document is over the limit.
TOKEN_LIMIT = 1024
#: Score from which a document counts as toxic.
TOXIC_FROM = 0.3
MIX_SEED, MIX_TEMPERATURE = 42, 2.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_multi_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 256, 512 and 1024 ids."""
    packed = pack(table(spark, sf_dir, "documents"), tokens.tokenizer_file("byte_bpe_50k.json"), end_id=0)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "padded_length", "step_group")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_dedup(table(spark, sf_dir, "documents"), width=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op3_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written as ORC, then read back."""
    path = shared_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, tokens.tokenizer_file("word_bpe_49k.json"), end_id=2)
    return token_files.digests(token_files.read_token_files(spark, path))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as a WARC archive, then read back."""
    path = shared_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    read = warc.read_warc(spark, path)
    return read.select(warc.page_id_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_id_of("refers_to").alias("refers_to"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the training fold's toxic ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= TOXIC_FROM).cast("int").alias("predicted")
    )


def op6_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed towards the square roots of the sources' sizes."""
    docs = table(spark, sf_dir, "documents")
    return poisson_mix(docs, tempered_targets(docs, MIX_TEMPERATURE), MIX_SEED)


def op7_improbable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document and of its edited text, and their likeness."""
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op8_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return extendible_shards(docs, SHARD_LIMIT).drop("text")


def op9_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of all documents, from the counts at all prefixes."""
    counted = prefix_counts(table(spark, sf_dir, "documents"), tokens.tokenizer_file("byte_bpe_50k.json"), TOKEN_LIMIT, TOKEN_LIMIT, prefixes=False)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), "tokens_before", "chars_within")


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return embeddings.near_dedup(table(spark, sf_dir, "embeddings"), least=0.93)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, forms and roots of all words of the documents."""
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from the documents of each language, in all orders."""
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every document."""
    return findings(license_scan(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_multi_length_packing": op1_multi_length_packing,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_token_orc": op3_token_orc,
    "op4_warc": op4_warc,
    "op5_toxicity": op5_toxicity,
    "op6_poisson_mixing": op6_poisson_mixing,
    "op7_improbable_features": op7_improbable_features,
    "op8_extendible_sharding": op8_extendible_sharding,
    "op9_prefix_token_counts": op9_prefix_token_counts,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_filter_audit": op12_filter_audit,
    "op13_license_scan": op13_license_scan,
}

ORACLE_SQL = {
    "op4_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS first FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111',
      4 * (strpos('0123456789abcdef', substr(hex, i, 1)) - 1) + 1, 4)), '') AS bits FROM d)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + list_sum(list_transform(range(1, 6), lambda k: (ascii(substr(bits, 5 * i + k, 1)) - 48) * (1 << (5 - k))))::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to FROM b
""",
    "op6_poisson_mixing": f"""
WITH counts AS (SELECT source, count(*) AS n, pow(count(*), {1 / MIX_TEMPERATURE}) AS weight FROM documents GROUP BY source),
rates AS (SELECT source, weight / sum(weight) OVER () * sum(n) OVER () / n AS rate FROM counts),
terms AS (SELECT source, k, rate, sum(CASE WHEN k = 0 THEN -rate ELSE ln(rate) - ln(k) END) OVER (PARTITION BY source ORDER BY k) AS lp
          FROM rates, generate_series(0, (SELECT ceil(max(rate) + 12 * sqrt(max(rate)) + 20)::BIGINT FROM rates)) g(k)),
cdf AS (SELECT source, k, sum(exp(lp)) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
drawn AS (SELECT *, ('0x' || substr(sha1('{MIX_SEED}|draw|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / pow(16, 13) AS u FROM documents),
counted AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, count(*) AS n
            FROM drawn d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source AND cdf.c <= d.u GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy,
       ('0x' || substr(sha1('{MIX_SEED}|place|' || coalesce(doc_id::VARCHAR, '') || '|' || copy), 1, 13))::BIGINT / pow(16, 13) AS shuffle_key
FROM (SELECT *, unnest(range(0, n)) AS copy FROM counted)
""",
    "op8_extendible_sharding": f"""
WITH hashed AS (SELECT doc_id, source, coalesce(strlen(text), 0) AS bytes,
                       ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM documents),
levels AS (SELECT depth, h >> (32 - depth)::INTEGER AS prefix, sum(bytes) AS shard_bytes
           FROM hashed, generate_series(0, 32) g(depth) GROUP BY ALL),
fits AS (SELECT * FROM levels WHERE shard_bytes <= {SHARD_LIMIT} OR depth = 32),
best AS (SELECT doc_id, source, min(f.depth) AS depth, arg_min(f.prefix, f.depth) AS prefix, arg_min(f.shard_bytes, f.depth) AS shard_bytes
         FROM hashed JOIN fits f ON f.prefix = h >> (32 - f.depth)::INTEGER GROUP BY doc_id, source, h)
SELECT doc_id, source, CASE WHEN depth = 0 THEN '' ELSE lpad(right(bin(prefix), depth::INTEGER), depth::INTEGER, '0') END AS shard,
       depth::INTEGER AS depth, shard_bytes::BIGINT AS shard_bytes FROM best
""",
    "op11_spelling_variants": """
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00c0-\u00ff]+')) AS run FROM documents),
lowered AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM lowered),
bits AS (SELECT run, n, list_transform(range(0, length(x) // 2), lambda k: ('0x' || substr(x, 2 * k + 1, 2))::BIGINT) AS b FROM bytes),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], b), lambda c, d:
             list_reduce([xor(c, d), 0, 0, 0, 0, 0, 0, 0, 0], lambda e, i: xor(e >> 1, 3988292384 * (e & 1))))) AS h FROM bits),
slips AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM slips WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
          UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
          UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min({'o': -near_n, 'near': near}) AS b FROM pairs GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.o >= 2 * w.n THEN b.near END AS form, CASE WHEN -b.o >= 2 * w.n THEN -b.o END AS form_n
          FROM words w LEFT JOIN best USING (word)),
ways AS (SELECT word, word AS reached, 0 AS steps FROM forms UNION ALL SELECT ways.word, f.form, steps + 1 FROM ways JOIN forms f ON ways.reached = f.word WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM forms f JOIN (SELECT word, arg_max(reached, steps) AS root FROM ways GROUP BY word) USING (word)
""",
    "op12_filter_audit": """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
failed AS (SELECT part, (len(words) < 200)::INT AS a, (100 * len(list_distinct(words)) < 50 * len(words))::INT AS b,
             (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT AS c, regexp_matches(t, '[#$%&*|]')::INT AS d,
             coalesce(least < w.doc_id, false)::INT AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN known USING (doc_id)),
vectors AS (SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (SELECT p.l || q.l || r.l || s.l || t.l AS filter_order FROM letters p, letters q, letters r, letters s, letters t
           WHERE len(list_distinct([p.l, q.l, r.l, s.l, t.l])) = 5),
steps AS (SELECT filter_order, step::INT AS step, (1 << (ascii(substr(filter_order, step, 1)) - 65))::INT AS own,
            list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(substr(filter_order, k, 1)) - 65)))::INT AS before
          FROM orders, (SELECT unnest(range(1, 6))::INT AS step)),
told AS (SELECT part, filter_order, step, own,
           sum(CASE WHEN mask & (own | coalesce(before, 0)) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
           sum(CASE WHEN mask & own > 0 AND mask & coalesce(before, 0) = 0 THEN n ELSE 0 END)::BIGINT AS removed,
           sum(CASE WHEN mask & own > 0 AND mask & coalesce(before, 0) > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
           sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
           sum(CASE WHEN mask & own > 0 AND mask & coalesce(before, 0) = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
           sum(CASE WHEN mask & own > 0 AND mask & coalesce(before, 0) = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
         FROM vectors, steps GROUP BY ALL)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM told
""",
    "op13_license_scan": f"""
WITH templates(template, label, exact, t) AS (VALUES {", ".join(f"({i}, '{label}', {i < len(PHRASES)}, string_split('{text}', ' '))" for i, (label, text) in enumerate([*PHRASES, *NOTICES]))}),
runs AS (SELECT template, label, exact, len(t) AS length, i AS place_at, t[i + 1] AS g0, t[i + 2] AS g1, t[i + 3] AS g2
         FROM (SELECT *, unnest(range(0, len(t) - 2)) AS i FROM templates)),
d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
w AS (SELECT id, p, words[p + 1] AS g0, words[p + 2] AS g1, words[p + 3] AS g2 FROM (SELECT id, words, unnest(range(0, len(words) - 2)) AS p FROM d)),
lines AS (SELECT id, template, label, exact, length, p - place_at AS diagonal, list(place_at) AS ats, min(p) AS least, max(p) AS most
          FROM w JOIN runs USING (g0, g1, g2) GROUP BY ALL),
opens AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY id, template ORDER BY diagonal) <= CASE WHEN exact THEN 0 ELSE {NEIGHBOURS} END THEN 0 ELSE 1 END AS o FROM lines),
numbered AS (SELECT *, sum(o) OVER (PARTITION BY id, template ORDER BY diagonal) AS span FROM opens),
spans AS (SELECT id, template, label, exact, length, span, min(least) AS first_word, max(most) + 3 AS end_word, flatten(list(ats)) AS ats FROM numbered GROUP BY ALL),
shares AS (SELECT *, len(list_distinct(flatten(list_transform(ats, lambda i: range(i, i + 3))))) / length AS share FROM spans),
judged AS (SELECT *, CASE WHEN exact THEN share = 1 ELSE share >= {COVERED} AND end_word - first_word <= {STRETCH} * length END AS found FROM shares),
told AS (SELECT id, count(*) FILTER (exact AND found) AS n_base, min(first_word) FILTER (exact AND found) AS first_word, max(first_word) FILTER (exact AND found) AS last_word,
           list(DISTINCT label) FILTER (exact AND found) AS base_labels, list(DISTINCT label) FILTER (found) AS labels, max(share) AS score FROM judged GROUP BY id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(base_labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(labels), ','), '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM d LEFT JOIN told USING (id)
""",
}
