"""Registered queries of this subpackage, with their SQL where SQL can express them."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import chat, decontam, licenses, line_dedup, mixing, neardup, quality, rules, secrets, shard


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"), F.concat_ws(",", F.col("removed_lines").cast("array<string>")).alias("removed_lines"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = secrets.scan(_table(spark, sf_dir, "documents"))
    line = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))))
    base = F.filter("secrets", lambda s: s["rank"] < len(secrets.BASE))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return got.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("secrets")).alias("spans"))


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), n=4)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return shard.shard(_table(spark, sf_dir, "documents"), 24).select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return rules.apply_rules(docs, rules.fit(docs, _table(spark, sf_dir, "labels")))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = quality.score(docs.select("doc_id", "text"), quality.fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    nodes = rows.unionByName(probe).withColumn("node", F.row_number().over(order)).select("conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
    got = chat.format_trees(nodes, branches=1).withColumn("turns", chat.read_back(F.col("formatted")))
    whole = F.concat_ws("", F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))))
    loss = F.concat_ws("", F.transform(chat.cut_spans(F.col("formatted"), F.col("loss_spans")), chat.unescape))
    return got.select(F.col("conv").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_secret_scan, op3_minhash_neardup, op4_license_scan, op5_decontamination, op6_sharding, op7_mixing, op8_quality_rules, op9_quality_classifier, op10_chat_format)}
_WORDS = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _secret_sql(rank: int, rule: secrets.Rule) -> str:
    """(row, kind, rank, i, gaps, got, kept): a row for each match of a rule, with the texts between and of all matches."""
    p = "'" + rule.pattern.replace("'", "''") + "'"
    found = f"SELECT row, string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}) AS got, regexp_extract_all(t, {p}, {rule.group}) AS kept FROM one WHERE regexp_matches(t, {p})"
    return f"SELECT row, '{rule.kind}' AS kind, {rank} AS rank, unnest(range(1, len(got) + 1)) AS i, {rule.least} AS least, gaps, got, kept FROM ({found})"


SQL: dict[str, str] = {
    "op1_line_dedup": rf"""
WITH line AS (
  SELECT doc_id, generate_subscripts(l, 1) - 1 AS no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
), sets AS (
  SELECT doc_id, no, list_sort(list_distinct(regexp_extract_all(line, '{_WORDS}'))) AS w FROM line
), one AS (
  SELECT w, len(w) AS n, min(doc_id * 1000000 + no) AS p0, row_number() OVER () AS id FROM sets WHERE len(w) > 0 GROUP BY w
), token AS (
  SELECT id, n, p0, unnest(w) AS t FROM one WHERE n >= 4
), ranked AS (
  SELECT id, n, p0, t, row_number() OVER (PARTITION BY id ORDER BY df, t) AS i FROM token JOIN (SELECT t, count(*) AS df FROM token GROUP BY t) USING (t)
), prefix AS (
  SELECT * FROM ranked WHERE i <= n - (4 * n + 4) // 5 + 1
), pair AS (
  SELECT DISTINCT a.id AS a, b.id AS b FROM prefix a JOIN prefix b ON a.t = b.t AND a.p0 < b.p0 AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
), gone AS (
  SELECT DISTINCT b AS id FROM pair JOIN one x ON x.id = a JOIN one y ON y.id = b
  WHERE 100 * len(list_intersect(x.w, y.w)) >= 80 * (x.n + y.n - len(list_intersect(x.w, y.w)))
), removed AS (
  SELECT doc_id, no FROM sets JOIN one USING (w) WHERE doc_id * 1000000 + no <> p0 OR id IN (SELECT id FROM gone)
)
SELECT d.doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(k, 0) AS BIGINT) AS n_removed, coalesce(nos, '') AS removed_lines
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS k, string_agg(no, ',' ORDER BY no) AS nos FROM removed GROUP BY doc_id) r ON r.doc_id = d.doc_id""",
    "op2_secret_scan": f"""
WITH one AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS row FROM documents
), met AS (
  {" UNION ALL ".join(_secret_sql(k, r) for k, r in enumerate(secrets.BASE + secrets.MORE))}
), span AS (
  SELECT row, kind, rank, length(array_to_string(gaps[1:i], '')) + length(array_to_string(got[1:i - 1], '')) AS a, length(got[i]) AS n FROM met WHERE length(kept[i]) >= least
), line AS (
  SELECT row, kind, rank, a, a + n AS b, kind || ':' || a || ':' || (a + n) AS x FROM span
)
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(x, ',' ORDER BY a, rank, b) FILTER (rank < {len(secrets.BASE)}), '')) AS base_sha256, coalesce(string_agg(x, ',' ORDER BY a, rank, b), '') AS spans
FROM one LEFT JOIN line USING (row) GROUP BY row, doc_id""",
    "op3_minhash_neardup": rf"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORDS}') AS w FROM documents
), word AS (
  SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM doc WHERE len(w) >= 4
), gram AS (
  SELECT doc_id, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o AS g FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM doc WHERE len(w) BETWEEN 1 AND 3
), sets AS (
  SELECT doc_id, list_sort(list(DISTINCT g)) AS s FROM gram WHERE g IS NOT NULL GROUP BY doc_id
), one AS (
  SELECT s, len(s) AS n, min(doc_id) AS id FROM sets GROUP BY s
), token AS (
  SELECT id, n, unnest(s) AS t FROM one
), ranked AS (
  SELECT id, n, t, row_number() OVER (PARTITION BY id ORDER BY df, t) AS i FROM token JOIN (SELECT t, count(*) AS df FROM token GROUP BY t) USING (t)
), prefix AS (
  SELECT * FROM ranked WHERE i <= n - (4 * n + 4) // 5 + 1
), pair AS (
  SELECT DISTINCT a.id AS a, b.id AS b FROM prefix a JOIN prefix b ON a.t = b.t AND a.id < b.id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
), link AS (
  SELECT a, b FROM pair JOIN one x ON x.id = a JOIN one y ON y.id = b WHERE 100 * len(list_intersect(x.s, y.s)) >= 80 * (x.n + y.n - len(list_intersect(x.s, y.s)))
), edge AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT id AS node, id AS r FROM one UNION SELECT node, b FROM reach JOIN edge ON a = r
), class AS (
  SELECT s, n, c FROM one JOIN (SELECT node, min(r) AS c FROM reach GROUP BY node) ON node = id
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sets ON sets.doc_id = d.doc_id LEFT JOIN class ON class.s = sets.s""",
    "op10_chat_format": r"""
WITH rows AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
), escaped AS (
  SELECT *, regexp_replace(replace(text, '\', '\\'), '(<)(\|(?:im_start|im_end|endoftext|system|user|assistant)\|>|s>|/s>|<SYS>>|</SYS>>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g') AS e FROM rows
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(e) + length('<|im_start|>') + length('<|im_end|>') + 2) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id""",
}
