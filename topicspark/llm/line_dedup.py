"""Line dedup with DataFrame functions only.

Lines are exploded once, as two 64-bit hashes of their key instead of the key
itself. Distinct documents per hash come from the smallest and the largest id
that hold it, which combine before the shuffle, so a line that a third of all
rows share arrives as one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicspark.llm.common import written

_BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_az(c: Column) -> Column:
    """A-Z in lower case, nothing else; plain ASCII takes the quick function."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _LOWER))


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """<doc_id, text_hash, pos, h1, h2> of the lines whose key has at least ``min_chars`` code points."""
    lines = docs.select("doc_id", "text_hash", F.posexplode(F.split(lower_az(F.col("text")), "\n", -1)).alias("pos", "line"))
    key = F.btrim("line", F.lit(_BLANKS))
    return (lines.select("doc_id", "text_hash", "pos", key.alias("key"))
            .where(F.char_length("key") >= min_chars)
            .select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")))


def repeated_keys(keys: DataFrame, min_docs: int) -> DataFrame:
    """<h1, h2, first_id> of the keys found in at least ``min_docs`` documents."""
    lo, hi = F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")
    if min_docs <= 2:
        held = keys.groupBy("h1", "h2").agg(lo, hi)
        return (held.where("first_id < last_id") if min_docs == 2 else held).select("h1", "h2", "first_id")
    each = keys.select("h1", "h2", "doc_id").distinct()
    return each.groupBy("h1", "h2").agg(lo, F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("h1", "h2", "first_id")


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """One row per row of ``docs`` <doc_id, text>: doc_id, n_lines, n_dropped, kept_text.

    Texts are split at newlines (null or empty: one empty line). A line's key is
    the line without the six blanks at both ends and with A-Z in lower case. A
    key of at least ``min_chars`` code points found in at least ``min_docs``
    documents keeps its lines, all of them, in the smallest doc_id holding it
    and loses them elsewhere. Rows that repeat a doc_id count as one document;
    rows without doc_id lose nothing. Other columns are not read.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("text_hash", F.xxhash64("text"))
    keys = written(line_keys(base, min_chars), "lines")
    # written, so that the join below has plain exchanges on both sides and a very common line can be split
    repeated = written(repeated_keys(keys, min_docs), "repeated")
    lost = (keys.join(repeated, ["h1", "h2"])
            .where(F.col("doc_id") > F.col("first_id"))
            .groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("gone")))
    both = (base.join(lost, ["doc_id", "text_hash"], "left")
            .withColumn("lines", F.split("text", "\n", -1))
            .withColumn("gone", F.coalesce("gone", F.array().cast("array<int>"))))
    # the stretches between dropped positions, each cut out once
    at = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size("lines")))
    both = both.withColumn("at", at)
    kept = F.flatten(F.transform(F.sequence(F.lit(1), F.size("gone") + 1), lambda i: F.slice(
        F.col("lines"), F.element_at("at", i) + 2, F.element_at("at", i + 1) - F.element_at("at", i) - 1)))
    return both.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"),
                       F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, u.pos, u.line, translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(list_zip(range(len(s)), s)) AS z FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)) q,
       LATERAL (SELECT z[1] AS pos, z[2] AS line) u
), k AS (
  SELECT key, min(doc_id) AS first_id FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), m AS (
  SELECT l.doc_id, l.pos, l.line, k.key IS NOT NULL AND l.doc_id <> k.first_id AS gone FROM l LEFT JOIN k USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
