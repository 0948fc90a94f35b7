"""Registered queries of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm import (
    bpe,
    embedding_dedup,
    html_text,
    line_dedup,
    mixing,
    phrases,
    quality,
    secrets,
    sharding,
    simhash,
    token_alignment,
    token_output,
    topk,
)
from skyframe.llm.common import table
from skyframe.session import new_folder

#: The tokenizer of the queries. Its file is found by the installed package.
TOKENIZER = "word_bpe_49k.json"

Run = Callable[[SparkSession, str], DataFrame]


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.train(docs, table(spark, folder, "labels")))
    good = (F.col("score") >= quality.THRESHOLD).cast("int")
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", good.alias("predicted"))


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, folder, "documents"))
    return groups.select("doc_id", "fingerprint", "component_id")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    sharded = sharding.shard_records(table(spark, folder, "documents").select("doc_id", "text"), shards=8)
    return sharded.select(
        "doc_id",
        sharding.row_size().alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(table(spark, folder, "embeddings"))


EMBEDDING_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::double[] AS e, coalesce(len(embedding) > 0 AND list_bool_and(list_transform(embedding,
    lambda x: coalesce(isfinite(x), false))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0)), false) AS fit
  FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.fit AND b.fit AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reached(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links,
  least(vec_id, coalesce((SELECT min(b) FROM reached WHERE a = vec_id), vec_id)) AS component_id,
  vec_id <= coalesce((SELECT min(b) FROM reached WHERE a = vec_id), vec_id) AS kept
FROM v
"""


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    return mixing.mix(docs).select(*columns, F.round("first_position", 9).alias("first_position"))


MIXING_SQL = """
WITH words AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
         md5(coalesce(doc_id::varchar, '')) AS k, md5(text) AS tk FROM documents),
sources AS (SELECT source, sum(size)::bigint AS source_size FROM words GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM sources),
weighed AS (SELECT *, [3.0, 1.0, 2.0][(r - 1) % 3 + 1]::double AS w, 2.0::double * source_size AS most FROM ranked),
levels AS (
  SELECT *, (1.5::double * sum(source_size) OVER () - coalesce(sum(most) OVER before, 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY most / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, r,
    least(most, coalesce(w * (SELECT min_by(level, (most / w, r)) FROM levels WHERE most / w > level), most)) AS target
  FROM levels),
placed AS (
  SELECT doc_id, size, source_size, target, r, floor(target + 0.5) AS wanted,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, tk NULLS FIRST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
  FROM words d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
takes AS (
  SELECT *, greatest(0, least(size, wanted - begins)) AS first_take, greatest(0, least(size, wanted - begins - source_size)) AS second_take,
    [1.5, 1.0, 0.5][(r - 1) % 3 + 1]::double AS a, [0.5, 1.0, 1.5][(r - 1) % 3 + 1]::double AS b FROM placed)
SELECT doc_id, size::bigint AS size, source_size, target, (first_take + second_take)::bigint AS taken,
  CASE WHEN first_take > 0 THEN round(CASE WHEN a = b THEN (begins + first_take / 2) / wanted
    ELSE (sqrt(a * a + 2 * (b - a) * (begins + first_take / 2) / wanted * (a + b) / 2) - a) / (b - a) END, 9) END AS first_position
FROM takes
"""


def op4_html_text(spark: SparkSession, folder: str) -> DataFrame:
    found = html_text.extract_text(table(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: The given pages mark their article; markup is taken out and character references of the
#: tables are decoded by plain replacements.
HTML_SQL = """
WITH inner_html AS (
  SELECT page_id, url, coalesce(regexp_extract(html, '<article>(.*?)(</article>|$)', 1, 's'), '') AS t FROM pages),
plain AS (
  SELECT page_id, url, replace(replace(replace(replace(regexp_replace(regexp_replace(t, '</?(p|h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS t FROM inner_html),
joined AS (SELECT page_id, url, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS text FROM plain)
SELECT page_id, url, text, length(text) AS n_chars FROM joined
"""


def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = bpe.encode_documents(docs, tokenizer_path(), decoded=True)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), every=100)


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) AS e, row_number() OVER () AS mark
  FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
scored AS (
  SELECT q.vec_id AS query_id, q.mark, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.mark <> c.mark),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, mark ORDER BY score DESC, vec_id)::int AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def op9_token_output(spark: SparkSession, folder: str) -> DataFrame:
    files = new_folder(spark, "tokens")
    token_output.write_token_shards(table(spark, folder, "documents"), files, tokenizer_path())
    found = token_output.read_token_shards(spark, files)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, folder, "documents").select("doc_id", "text"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"] != "random")
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, F.lit(k).__eq__)).cast("long").alias(f"n_{k}") for k in secrets.KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op11_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = line_dedup.drop_common_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


LINE_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
e AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
m AS (SELECT r, doc_id, line, pos, key IN (SELECT key FROM c) AS gone FROM k)
SELECT any_value(doc_id) AS doc_id, count(*)::bigint AS n_lines, count(*) FILTER (gone)::bigint AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""


def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    aligned = token_alignment.align_documents(table(spark, folder, "documents").select("doc_id", "text"), *paths)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    weighed = token_alignment.weigh_links(aligned.withColumn("groups_sha256", digest).drop("groups"), *paths)
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return weighed.select(F.col("id").alias("doc_id"), *columns)


def op13_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents").select("lang", "text"))


PHRASE_SQL = """
WITH RECURSIVE pieces AS (
  SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
grams AS (
  SELECT lang, s, array_to_string(w[i:i + s - 1], ' ') AS phrase FROM places, (SELECT unnest([1, 2, 3, 4]) AS s) WHERE i + s - 1 <= len(w)),
n AS (SELECT lang, sum(len(w))::bigint AS n FROM pieces GROUP BY lang),
f AS (SELECT lang, s, phrase, count(*)::bigint AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
cand AS (SELECT lang, s, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE s > 1),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, (2000000::hugeint * c.a // (x.f + y.f))::bigint AS score
  FROM (SELECT *, unnest(range(1, s)) AS k FROM cand) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (
  SELECT lang, array_to_string(w[i:i + t - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, s - t + 2)) AS i FROM (SELECT *, unnest(range(2, s)) AS t FROM cand)) GROUP BY ALL),
stay AS (
  SELECT o.* FROM lowest o LEFT JOIN inner_parts q ON o.lang = q.lang AND o.phrase = q.phrase
  WHERE q.longer IS NULL OR 100 * q.longer < 80 * o.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM stay)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


QUERIES: dict[str, Run] = {
    "op1_sharding": op1_sharding,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_mixing": op3_mixing,
    "op4_html_text": op4_html_text,
    "op5_bpe": op5_bpe,
    "op6_quality": op6_quality,
    "op7_simhash": op7_simhash,
    "op8_topk": op8_topk,
    "op9_token_output": op9_token_output,
    "op10_secrets": op10_secrets,
    "op11_line_dedup": op11_line_dedup,
    "op12_token_alignment": op12_token_alignment,
    "op13_phrases": op13_phrases,
}
ORACLES: dict[str, str] = {
    "op2_embedding_dedup": EMBEDDING_SQL,
    "op3_mixing": MIXING_SQL,
    "op4_html_text": HTML_SQL,
    "op8_topk": TOPK_SQL,
    "op11_line_dedup": LINE_SQL,
    "op13_phrases": PHRASE_SQL,
}
