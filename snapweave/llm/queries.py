"""The queries opN_<name> over the tables of a folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, mixing, near_dedup, packing, secrets, sharding, tokens, toxicity, vectors
from .common import fill

SHARDS = [f"shard-{k:03d}" for k in range(64)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str = "doc_id"):
    """Rows that no classifier may learn from; a null id counts as the empty text."""
    return F.crc32(fill(F.col(id_col).cast("string")).cast("binary")) % 4 == 2


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~held_out())
    out = docs.select("doc_id", toxicity.score_of(model, "text").alias("score"))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.section_counts(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(table(spark, sf_dir, "documents"), repo_col=F.struct("source", "lang"), owner_col="source")
    base = F.filter("spans", lambda s: s["rank"] < 3)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda name, value: F.size(F.filter("spans", lambda s: s[name] == value)).cast("long")
    return found.select(
        "doc_id",
        *[count("kind", k).alias(f"n_{k}") for k in secrets.KINDS[:3]],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        *[count("class", k).alias(f"n_{k}") for k in ("live", "reused", "shared", "copied")],
    )


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, "doc_id", SHARDS)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).drop("row")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{tricky}'), (-7L, 1L, 'assistant', '{tricky}') AS t(conv_id, turn, role, text)")
    w = chat.windows(turns.union(extra))
    new = F.filter(chat.read_back("formatted"), lambda t: t["new"])
    told = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    w = w.withColumn("turns", new).select(
        "conv_id",
        F.struct("window", F.size("turns").alias("n"), F.array_join(told, "").alias("told"), chat.masked_text("formatted", "loss").alias("learnt"), F.char_length("formatted").alias("chars")).alias("w"),
    )
    whole = w.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"))
    sha = lambda part: F.sha2(F.array_join(f"w.{part}", "").cast("binary"), 256)
    total = lambda part: F.aggregate(f"w.{part}", F.lit(0).cast("long"), lambda acc, x: acc + x)
    return whole.select(
        "conv_id",
        total("n").alias("n_turns"),
        sha("told").alias("turns_sha256"),
        F.char_length(F.array_join("w.learnt", "")).cast("long").alias("loss_chars"),
        sha("learnt").alias("loss_sha256"),
        total("chars").alias("formatted_chars"),
        F.size("w").cast("long").alias("n_windows"),
    )


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_embedding_dedup, op3_token_counts, op4_secret_scan, op5_minhash, op6_mixing, op7_exact_dedup, op8_sharding, op9_packing, op10_chat)}


def _found(kind: str, rank: int, pattern: str, keep: str) -> str:
    """SQL: the matches of a pattern that pass ``keep`` and their places, which follow from what lies between matches."""
    return f"""
{kind}_cut AS (SELECT row, text, regexp_extract_all(text, {pattern}) AS hit, string_split_regex(text, {pattern}) AS gap FROM d),
{kind}_found AS (
  SELECT row, {rank} AS rank, '{kind}' AS kind, list_sum(list_transform(gap[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(hit[1:i - 1], lambda x: length(x))), 0)::BIGINT AS start, hit[i] AS hit
  FROM (SELECT *, unnest(range(1, len(hit) + 1)) AS i FROM {kind}_cut)
  WHERE {keep})"""


_NAME = "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
_BEFORE = _NAME + """[\"'']?\\x20*[:=]\\x20*[\"'']?"""
_SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, source AS owner, [source, lang] AS repo FROM documents),
{_found("assign", 0, f"'{_BEFORE}[A-Za-z0-9+/_.=-]+'", f"length(regexp_replace(hit[i], '^{_BEFORE}', '')) >= 6")},
{_found("access", 1, "'AKIA[A-Z0-9]+'", "length(hit[i]) >= 20")},
{_found("hex", 2, "'[0-9a-f]+'", "length(hit[i]) >= 24")},
{_found("token", 3, "'[A-Za-z0-9+/_=-]+'", "length(hit[i]) >= 24 AND regexp_matches(hit[i], '[a-z]') AND regexp_matches(hit[i], '[A-Z]') AND regexp_matches(hit[i], '[0-9]') AND list_aggregate(string_split(hit[i], ''), 'entropy') >= 3.5")},
f AS (
  SELECT row, rank, kind, start, start + length(hit) AS stop, CASE WHEN rank = 0 THEN regexp_replace(hit, '^{_BEFORE}', '') ELSE hit END AS value
  FROM (SELECT * FROM assign_found UNION ALL SELECT * FROM access_found UNION ALL SELECT * FROM hex_found UNION ALL SELECT * FROM token_found)),
held AS (SELECT value, count(DISTINCT repo) AS n_repos, count(DISTINCT [owner]) AS n_owners FROM f JOIN d USING (row) GROUP BY value),
told AS (
  SELECT *, concat_ws(':', kind, start, stop) AS span, CASE WHEN n_owners >= 3 THEN 'copied' WHEN n_owners > 1 THEN 'shared' WHEN n_repos > 1 THEN 'reused' ELSE 'live' END AS class
  FROM f JOIN held USING (value) WHERE rank < 3 OR n_owners = 1)
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY start, rank), '') AS spans,
       count(*) FILTER (class = 'live') AS n_live, count(*) FILTER (class = 'reused') AS n_reused, count(*) FILTER (class = 'shared') AS n_shared, count(*) FILTER (class = 'copied') AS n_copied
FROM d LEFT JOIN told USING (row) GROUP BY row, doc_id"""

#: The table of slots as a text of three digits each.
_SHARDS = f"""
SELECT doc_id, slot, 'shard-' || substr('{"".join(f"{k:03d}" for k in sharding.fill_table(SHARDS))}', 3 * slot + 1, 3) AS shard
FROM (SELECT doc_id, (('0x' || substr(md5(coalesce('=' || doc_id, '')), 1, 13))::BIGINT % {sharding.TABLE_SIZE})::INTEGER AS slot FROM documents)"""

ORACLE_SQL = {
    "op2_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND isfinite(list_min(embedding)) AND isfinite(list_max(embedding)) AND (list_min(embedding) < 0 OR list_max(embedding) > 0)),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
root AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN root USING (vec_id) LEFT JOIN n USING (vec_id)""",
    "op10_chat": r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i, len(regexp_extract_all(text, '\w+|[^\w\s]')) + 4 AS tokens,
         8 + length(replace(replace(replace(replace(role, '\', '\e'), '<', '\l'), '[', '\b'), chr(10), '\n')) + 1 + length(replace(replace(replace(text, '\', '\e'), '<', '\l'), '[', '\b')) + 7 AS chars
  FROM raw),
s AS (
  SELECT conv_id, coalesce(max(tokens) FILTER (role = 'system' AND tokens <= 512), 0) AS kept, coalesce(max(chars) FILTER (role = 'system' AND tokens <= 512), 0) AS kept_chars, count(*) FILTER (role = 'system') AS has
  FROM t WHERE i = 0 GROUP BY conv_id),
w(conv_id, i, w, used) AS (
  SELECT conv_id, i, 0, tokens FROM t WHERE i = 0
  UNION ALL
  SELECT t.conv_id, t.i, CASE WHEN goes THEN w.w + 1 ELSE w.w END, CASE WHEN goes THEN t.tokens ELSE w.used + t.tokens END
  FROM (SELECT w.*, t.tokens, w.used > 0 AND w.used + t.tokens > CASE WHEN w.w = 0 THEN 1024 ELSE 1024 - 192 - s.kept END AS goes FROM w JOIN t ON t.conv_id = w.conv_id AND t.i = w.i + 1 JOIN s ON s.conv_id = w.conv_id) w
  JOIN t ON t.conv_id = w.conv_id AND t.i = w.i + 1),
starts AS (
  SELECT w.conv_id, w, min(w.i) AS start, sum(tokens) AS fresh, kept + sum(tokens) <= 1024 AS led, least(192, 1024 - sum(tokens) - CASE WHEN kept + sum(tokens) <= 1024 THEN kept ELSE 0 END) AS room, has, kept_chars
  FROM w JOIN t ON t.conv_id = w.conv_id AND t.i = w.i JOIN s ON s.conv_id = w.conv_id WHERE w > 0 GROUP BY w.conv_id, w, kept, has, kept_chars),
held AS (
  SELECT x.conv_id, x.w, x.room, t.chars, sum(t.tokens) OVER (PARTITION BY x.conv_id, x.w ORDER BY t.i DESC) AS upto
  FROM starts x JOIN t ON t.conv_id = x.conv_id AND t.i < x.start AND t.i >= greatest(x.start - 4, x.has)),
again AS (
  SELECT x.conv_id, sum(CASE WHEN led THEN kept_chars ELSE 0 END + coalesce((SELECT sum(chars) FROM held h WHERE h.conv_id = x.conv_id AND h.w = x.w AND h.upto <= h.room), 0)) AS chars FROM starts x GROUP BY x.conv_id)
SELECT t.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(t.chars) + coalesce(max(a.chars), 0))::BIGINT AS formatted_chars, 1 + coalesce(max(n.n), 0) AS n_windows
FROM t LEFT JOIN again a ON a.conv_id = t.conv_id LEFT JOIN (SELECT conv_id, count(*) AS n FROM starts GROUP BY conv_id) n ON n.conv_id = t.conv_id GROUP BY t.conv_id""",
    "op7_exact_dedup": """
WITH n AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM n""",
    "op4_secret_scan": _SECRETS,
    "op8_sharding": _SHARDS,
    "op6_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
keyed AS (
  SELECT doc_id, source, size,
         -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|7'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
         / (1.0 + CASE WHEN size >= 20 THEN 1.0 ELSE 0.0 END
                + CASE WHEN length(coalesce(text, '')) / greatest(size, 1)::DOUBLE BETWEEN 4 AND 13 THEN 1.0 ELSE 0.0 END) AS key
  FROM sized),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM keyed GROUP BY source),
f AS (
  SELECT *, 3.0 * source_size AS cap, (sum(source_size) OVER ())::DOUBLE
           - coalesce(sum(3.0 * source_size) OVER (ORDER BY 3.0 * source_size / w, w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS rest_of_all,
         sum(w) OVER (ORDER BY 3.0 * source_size / w, w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavy
  FROM s),
t AS (
  SELECT source, source_size,
         coalesce(least(cap::DOUBLE, w * max(CASE WHEN cap * heavy > w * rest_of_all THEN rest_of_all / heavy END) OVER ()), cap::DOUBLE) AS target
  FROM f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
r AS (SELECT *, floor(target - epochs * source_size)::BIGINT AS rest FROM e),
p AS (
  SELECT k.doc_id, k.size, r.source_size, r.target, r.epochs, r.rest,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed k JOIN r ON k.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken
FROM p""",
}
