"""The queries of this subpackage, ``(spark, sf_dir) -> DataFrame``, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm import chat_format, decontaminate, embedding_dup, language, mixing, near_dup, paragraph_dup, quality, substrings, url_filter
from sigloom.llm import pipeline as stages

HARD_CHAT = r"\### Assistant: </turn> ok"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame(
        [(-7, 0, "user", HARD_CHAT), (-7, 1, "assistant", HARD_CHAT)], "conv_id long, turn long, role string, text string"
    )
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat_format.read_back(chat_format.format_turns(turns))


OP1_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), drawn AS (
  SELECT *, length('### ' || replace(replace(replace(role, '\', '\\'), chr(10), '\n'), ':', '\c') || ': ' || ' </turn>' || chr(10))
            + length(regexp_replace(text, '(\\*)(### |</turn>)', '\1\\\2', 'g')) AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM drawn GROUP BY conv_id
"""


def op2_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
coded AS (SELECT doc_id, hash(s) AS h FROM shingles),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM coded x JOIN coded y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
), ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM ends UNION SELECT r.a, l.b FROM reach r JOIN ends l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(m, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.doc_id = d.doc_id
"""


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(_table(spark, sf_dir, "documents"))


#: Every 200-byte string of every text, in hexadecimal so that bytes are cut and not characters.
OP3_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (SELECT r, i, md5_number(substr(h, 2 * i + 1, 400)) AS f FROM (SELECT r, h, unnest(range(0, greatest(len(h) // 2 - 199, 0))) AS i FROM texts)),
again AS (SELECT f FROM strings GROUP BY f HAVING count(*) > 1),
starts AS (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 200, true) AS new FROM strings WHERE f IN (FROM again)),
spans AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM (SELECT *, sum(new::INT) OVER (PARTITION BY r ORDER BY i) AS g FROM starts) GROUP BY r, g),
before AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS e FROM spans),
kept AS (
  SELECT r, count(*) AS n, sum(b - a) AS cut, max(b) AS last, string_agg(substr(h, 2 * e + 1, 2 * (a - e)), '' ORDER BY a) AS front FROM before JOIN texts USING (r) GROUP BY r
)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(cut, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN n IS NULL THEN h ELSE front || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM texts LEFT JOIN kept USING (r)
"""


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    held_out = F.coalesce(quality.fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return quality.classify(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(quality.fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return language.identify(docs, language.fit(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(text, '')) AS digest,
         row_number() OVER (PARTITION BY source, doc_id, md5(coalesce(text, ''))) - 1 AS number
  FROM documents
), drawn AS (
  SELECT *, (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '/' || digest || '/' || number), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0 AS u FROM sized
), totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM drawn GROUP BY source),
ranked AS (
  SELECT *, CAST([5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight, 3.0::DOUBLE * source_size AS cap FROM totals
), filled AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM ranked WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), leveled AS (SELECT *, max(CASE WHEN cap > level * weight THEN level END) OVER () AS final FROM filled),
targets AS (
  SELECT source, source_size, CASE WHEN cap <= level * weight OR final IS NULL THEN cap ELSE final * weight END AS target FROM leveled
), planned AS (
  SELECT *, target - certain * source_size AS extra FROM (
    SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS certain FROM targets)
), kinds AS (
  SELECT source, size, extra, count(*) AS n FROM drawn s JOIN planned t USING (source) WHERE size > 0 GROUP BY ALL
  UNION ALL SELECT s.source, size, extra, count(*) FROM drawn s JOIN planned t ON s.source IS NULL AND t.source IS NULL WHERE size > 0 GROUP BY ALL
), tried AS (
  SELECT source, size, (extra - CAST(coalesce(sum(n * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / CAST(sum(n * size * size) OVER (PARTITION BY source ORDER BY size ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS scale FROM kinds
), scales AS (SELECT source, greatest(arg_max(scale, size), 0) AS scale FROM tried WHERE scale * size < 1 GROUP BY source),
chances AS (
  SELECT d.*, source_size, target, certain, extra, least(1, size * coalesce(scale, 0)) AS p
  FROM drawn d JOIN planned t ON t.source IS NOT DISTINCT FROM d.source LEFT JOIN scales c ON c.source IS NOT DISTINCT FROM d.source
), placed AS (SELECT *, CASE WHEN p >= 1 THEN 0 WHEN p <= 0 THEN 'inf'::DOUBLE ELSE u / (1 - u) / (p / (1 - p)) END AS place FROM chances),
runs AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, digest, number ROWS UNBOUNDED PRECEDING) AS run FROM placed
), gaps AS (SELECT *, extra - coalesce(max(CASE WHEN run <= extra THEN run END) OVER (PARTITION BY source), 0) AS gap FROM runs),
last AS (
  SELECT *, row_number() OVER (PARTITION BY source, NOT (run > extra AND size > 0 AND abs(size - gap) < gap) ORDER BY abs(size - gap), place, doc_id, digest, number) AS turn FROM gaps
)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
       CAST(size * least(certain + CASE WHEN run <= extra OR (size > 0 AND abs(size - gap) < gap AND turn = 1) THEN 1 ELSE 0 END, 3) AS BIGINT) AS taken
FROM last
"""


def op7_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dup.near_duplicates(_table(spark, sf_dir, "embeddings"))


OP7_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS vec_id, min(b) AS m FROM reach GROUP BY a), counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(v.vec_id, coalesce(m, v.vec_id)) AS component_id, v.vec_id <= coalesce(m, v.vec_id) AS kept
FROM v LEFT JOIN counts c ON c.vec_id = v.vec_id LEFT JOIN least l ON l.vec_id = v.vec_id
"""


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")


def op9_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dup.repeated_paragraphs(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_format": op1_chat_format,
        "op2_minhash_near_dup": op2_minhash_near_dup,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_quality": op4_quality,
        "op5_language": op5_language,
        "op6_mixing": op6_mixing,
        "op7_embedding_near_dup": op7_embedding_near_dup,
        "op8_url_filter": op8_url_filter,
        "op9_paragraph_dedup": op9_paragraph_dedup,
        "op10_decontamination": op10_decontamination,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": OP1_SQL, "op2_minhash_near_dup": OP2_SQL, "op3_suffix_dedup": OP3_SQL, "op6_mixing": OP6_SQL, "op7_embedding_near_dup": OP7_SQL}
