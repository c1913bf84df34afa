"""DuckDB twins of the fixtures: CTEs prepended to every oracle query.

DuckDB inlines CTEs, so only the fixtures a query uses are computed.
"""

from __future__ import annotations

import re

from topicspark.plans.fixtures import EUROVOC_MT, N_TOPICS, THEMES, THESAURUS_ROWS, VOCAB_MIN_COUNT


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_THES_VALUES = ", ".join(f"({p}, {_q(ph)}, {_q(lb)})" for p, ph, lb in THESAURUS_ROWS)
_MT_CASE = "CASE " + " ".join(f"WHEN p_type = {_q(t)} AND p_size <= {m} THEN {_q(lb)}" for t, m, lb in EUROVOC_MT) + " END"
_THEME_VALUES = ", ".join(f"({_q(t)}, {_q(k)})" for t, ks in THEMES.items() for k in ks)

FIXTURE_CTES = rf"""
fx_corpus AS (
  SELECT doc_id, text, lang, source,
         CAST(1997 + doc_id % 23 + CASE WHEN doc_id % 23 >= 1 THEN 1 ELSE 0 END AS INTEGER) AS step
  FROM documents),
fx_tokens AS (
  SELECT doc_id, lang, source, step, CAST(unnest(range(len(arr))) AS INTEGER) AS pos, unnest(arr) AS w
  FROM (SELECT doc_id, lang, source, step,
               list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}]+'), lambda x: x <> '') AS arr
        FROM fx_corpus)),
fx_vocab AS (
  SELECT CAST(row_number() OVER (ORDER BY cnt DESC, w ASC) - 1 AS BIGINT) AS word_id, w AS word, cnt
  FROM (SELECT w, count(*) AS cnt FROM fx_tokens GROUP BY w HAVING count(*) > {VOCAB_MIN_COUNT})),
fx_doc_topic AS (
  SELECT doc_id, step, CAST(t.topic AS INTEGER) AS topic,
         CAST((doc_id * 31 + t.topic * 17) % 97 + 1 AS DOUBLE) / 10.0 AS weight
  FROM fx_corpus, range({N_TOPICS}) t(topic)),
fx_topic_term AS (
  SELECT c.topic, c.step, v.word_id, v.word, c.c / sum(c.c) OVER (PARTITION BY c.topic, c.step) AS prob
  FROM (SELECT CAST(CAST(substr(source, 4) AS INTEGER) % {N_TOPICS} AS INTEGER) AS topic, step, w, count(*) AS c
        FROM fx_tokens GROUP BY ALL) c
  JOIN fx_vocab v ON v.word = c.w),
fx_model AS (
  SELECT c.model, c.topic, v.word_id, v.word, c.c / sum(c.c) OVER (PARTITION BY c.model, c.topic) AS prob
  FROM (SELECT CAST(floor(doc_id / 20) % 2 AS INTEGER) AS model,
               CAST(CAST(substr(source, 4) AS INTEGER) % {N_TOPICS} AS INTEGER) AS topic, w, count(*) AS c
        FROM fx_tokens GROUP BY ALL) c
  JOIN fx_vocab v ON v.word = c.w),
fx_word_vec AS (
  SELECT v.word, e.embedding AS vec FROM fx_vocab v JOIN embeddings e ON v.word_id % (SELECT count(*) FROM embeddings) = e.vec_id),
fx_vec_phrases AS (
  SELECT CAST(vec_id AS VARCHAR) AS phrase, 'L' || CAST(label AS VARCHAR) AS label, embedding AS vec FROM embeddings),
fx_thesaurus AS (
  SELECT CAST(pos AS BIGINT) AS pos, phrase, label FROM (VALUES {_THES_VALUES}) t(pos, phrase, label)),
fx_themes AS (
  SELECT * FROM (VALUES {_THEME_VALUES}) t(theme, keyword)),
fx_part_thesaurus AS (
  SELECT p_name AS phrase, min(p_type) AS label FROM part GROUP BY p_name),
fx_null_text AS (
  SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE text END AS text, lang, source, n_chars FROM documents),
fx_eurovoc AS (
  SELECT p_partkey AS pos, p_name AS phrase, {_MT_CASE} AS MT,
         CASE WHEN p_size % 2 = 0 THEN '2026 Consumption' ELSE '6606 Energy policy' END AS domain FROM part),
fx_model3 AS (
  SELECT c.model, c.topic, v.word_id, v.word, c.c / sum(c.c) OVER (PARTITION BY c.model, c.topic) AS prob
  FROM (SELECT CAST(floor(doc_id / 20) % 3 AS INTEGER) AS model,
               CAST(CAST(substr(source, 4) AS INTEGER) % {N_TOPICS} AS INTEGER) AS topic, w, count(*) AS c
        FROM fx_tokens GROUP BY ALL) c
  JOIN fx_vocab v ON v.word = c.w),
fx_share AS (
  SELECT step, topic, w / sum(w) OVER (PARTITION BY step) AS share
  FROM (SELECT step, topic, sum(weight) AS w FROM fx_doc_topic GROUP BY step, topic))"""


def with_fixtures(sql: str) -> str:
    """``sql`` is either ``<ctes> SELECT ...`` starting with a CTE list after
    a leading comma-free marker, or a plain SELECT."""
    body = sql.strip()
    if re.match(r"(?i)^WITH\s+RECURSIVE\s", body):
        rest = re.sub(r"(?i)^WITH\s+RECURSIVE\s", "", body)
        return "WITH RECURSIVE " + FIXTURE_CTES + ",\n" + rest
    if re.match(r"(?i)^WITH\s", body):
        return "WITH " + FIXTURE_CTES + ",\n" + body[5:]
    return "WITH " + FIXTURE_CTES + "\n" + body
