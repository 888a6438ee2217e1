"""The queries of this subpackage's operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, classifier, html_extract, line_dedup, mixing, quality_rules, quotes, simhash, suffix_dedup
from .common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = """
WITH sized AS (
  SELECT doc_id, source, md5(concat_ws(':', '42', coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))))) AS key,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents),
sources AS (
  SELECT source, sum(size)::HUGEINT AS ss, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][place % 3 + 1]::HUGEINT AS w, 3 * ss AS cap FROM sources),
-- a source is clamped if, with all of lower cap a weight clamped, its share is above its cap
levels AS (
  SELECT *, sum(ss) OVER () AS total, sum(w) OVER () AS all_w,
         coalesce(sum(cap) OVER before, 0) AS cap_before, coalesce(sum(w) OVER before, 0) AS w_before
  FROM weighed WINDOW before AS (ORDER BY cap * 10 // w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
clamped AS (SELECT *, cap * (all_w - w_before) < w * (total - cap_before) AS is_full FROM levels),
rest AS (
  SELECT *, total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER () AS r,
         all_w - sum(CASE WHEN is_full THEN w ELSE 0 END) OVER () AS ow
  FROM clamped),
targets AS (
  SELECT source, ss, CASE WHEN is_full THEN cap::DOUBLE ELSE (w * r)::DOUBLE / ow::DOUBLE END AS target,
         CASE WHEN is_full THEN cap ELSE w * r // ow END AS words
  FROM rest),
placed AS (
  SELECT d.*, t.ss, t.target, t.words // greatest(t.ss, 1) AS epochs, t.words % greatest(t.ss, 1) AS part,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS start
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, ss::BIGINT AS source_size, target,
       ((epochs + CASE WHEN 2 * start + size <= 2 * part THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM placed
"""


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_rules.quality_rules(docs, quality_rules.trusted_ids(labels))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), kept=False, digest=True)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(table(spark, sf_dir, "conversations"))


OP6_SQL = r"""
WITH RECURSIVE base AS (
  SELECT row_number() OVER () AS rid, conv_id, turn, role, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS t FROM conversations),
lines AS (
  SELECT rid, conv_id, turn, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS pos FROM base),
marked AS (SELECT *, regexp_extract(line, '^[ \t]*(>[ \t>]*)', 1) AS p FROM lines),
named AS (
  SELECT *, len(p) - len(replace(p, '>', '')) AS level,
         trim(regexp_replace(lower(regexp_replace(line, '^[ \t]*(>[ \t>]*)', '')), '\s+', ' ', 'g')) AS name
  FROM marked),
breaks AS (
  SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) OVER w OR lag(name) OVER w = '' THEN 1 ELSE 0 END AS is_new
  FROM named WINDOW w AS (PARTITION BY rid ORDER BY pos)),
runs AS (SELECT *, sum(is_new) OVER (PARTITION BY rid ORDER BY pos) AS run FROM breaks),
units AS (
  SELECT DISTINCT conv_id, turn, level, 0 AS kind, name FROM named WHERE name <> ''
  UNION
  SELECT conv_id, turn, level, 1, string_agg(name, ' ' ORDER BY pos) FROM runs WHERE name <> '' GROUP BY rid, conv_id, turn, level, run),
latest AS (
  SELECT q.conv_id, q.turn, q.level, q.kind, q.name, max(o.turn) AS source
  FROM units q JOIN units o ON q.conv_id = o.conv_id AND q.kind = o.kind AND q.name = o.name AND o.turn < q.turn
  WHERE q.level > 0 AND o.level = 0 GROUP BY ALL),
votes AS (SELECT conv_id, turn, level, kind, source, count(*) AS n FROM latest GROUP BY ALL),
parents AS (
  SELECT conv_id, turn, source AS reply_to FROM votes
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, kind DESC, n DESC, source DESC) = 1),
chain AS (
  SELECT conv_id, turn, reply_to AS thread, 1 AS depth FROM parents
  UNION ALL
  SELECT c.conv_id, c.turn, p.reply_to, c.depth + 1 FROM chain c JOIN parents p ON p.conv_id = c.conv_id AND p.turn = c.thread),
roots AS (SELECT conv_id, turn, arg_max(thread, depth) AS thread, max(depth) AS depth FROM chain GROUP BY conv_id, turn),
counts AS (SELECT rid, count(*) AS n_quoted FROM named WHERE level > 0 AND name <> '' GROUP BY rid),
followed AS (
  SELECT *, first_value(CASE WHEN regexp_matches(line, '\S') THEN line END IGNORE NULLS)
              OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_line
  FROM named),
said AS (
  SELECT rid, string_agg(line, chr(10) ORDER BY pos) AS t FROM followed
  WHERE level = 0 AND NOT (
    regexp_matches(line, '(?i)^[ \t]*(on\b.{0,200}\bwrote|am\b.{0,200}\bschrieb\b.{0,80}|le\b.{0,200}a écrit|el\b.{0,200}escribió)[ \t]*:[ \t]*$')
    AND coalesce(regexp_matches(next_line, '^\s*>'), false))
  GROUP BY rid)
SELECT b.conv_id, b.turn, b.role, coalesce(rtrim(regexp_replace(s.t, '^([ \t]*\n)+', ''), ' ' || chr(9) || chr(10)), '') AS text,
       p.reply_to, coalesce(r.thread, b.turn) AS thread, coalesce(r.depth, 0)::BIGINT AS depth,
       CASE WHEN b.conv_id IS NULL OR b.turn IS NULL THEN 0
            ELSE dense_rank() OVER (PARTITION BY b.conv_id, coalesce(r.thread, b.turn) ORDER BY b.turn) - 1 END::BIGINT AS position,
       coalesce(c.n_quoted, 0)::BIGINT AS n_quoted
FROM base b LEFT JOIN said s USING (rid) LEFT JOIN counts c USING (rid)
LEFT JOIN parents p ON p.conv_id = b.conv_id AND p.turn = b.turn
LEFT JOIN roots r ON r.conv_id = b.conv_id AND r.turn = b.turn
"""


def op7_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed_lines", "text")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), bpe.ranks_path(), ids=False, digests=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix_sources, op2_html_extract, op3_quality_rules, op4_suffix_dedup, op5_simhash, op6_quotation_linking, op7_ivf_pq, op8_line_dedup, op9_quality_classifier, op10_byte_bpe)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1_SQL, "op6_quotation_linking": OP6_SQL}
