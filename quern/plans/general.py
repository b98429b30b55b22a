"""Queries of the general data-preparation problems, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.packed_values import explode_packed
from quern.operators.snapshots import removed_counts, snapshot_changes
from quern.sources.tables import table


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return snapshot_changes(table(spark, base, "chunk_snapshot"), table(spark, base, "generation_manifest"))


def p4_removed_counts(spark: SparkSession, base: str) -> DataFrame:
    return removed_counts(table(spark, base, "chunk_snapshot"), table(spark, base, "generation_manifest"))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    parts = [
        explode_packed(table(spark, base, name), "rec_no", column).select(F.lit(name).alias("table_name"), "rec_no", "item_pos", "item_value")
        for name, column in (("dosje", "burimet"), ("lidhje", "burimi"))
    ]
    return parts[0].unionByName(parts[1])


_P4 = """
WITH good AS (
  SELECT collection_id, generation_id, row_number() OVER (PARTITION BY collection_id ORDER BY created_at NULLS FIRST, generation_id) AS o
  FROM generation_manifest WHERE status IN ('active', 'superseded')),
best AS (
  SELECT g.collection_id, g.o, s.chunk_id, regexp_replace(lower(trim(s.content_hash)), '^sha256:', '') AS h,
    row_number() OVER (PARTITION BY g.generation_id, s.chunk_id ORDER BY s.delivered_at DESC, s.content_hash DESC) AS rn
  FROM chunk_snapshot s JOIN good g ON s.generation_id = g.generation_id WHERE s.chunk_id IS NOT NULL),
cur AS (SELECT * FROM best WHERE rn = 1),
changes AS (
  SELECT g.generation_id, c.chunk_id, CASE WHEN p.chunk_id IS NULL THEN 'added' ELSE 'changed' END AS change
  FROM cur c JOIN good g ON g.collection_id = c.collection_id AND g.o = c.o
  LEFT JOIN cur p ON p.collection_id = c.collection_id AND p.chunk_id = c.chunk_id AND p.o = c.o - 1
  WHERE c.o > 1 AND (p.chunk_id IS NULL OR c.h IS DISTINCT FROM p.h)
  UNION ALL
  SELECT g.generation_id, p.chunk_id, 'removed' AS change
  FROM cur p JOIN good g ON g.collection_id = p.collection_id AND g.o = p.o + 1
  LEFT JOIN cur c ON p.collection_id = c.collection_id AND p.chunk_id = c.chunk_id AND c.o = p.o + 1
  WHERE c.chunk_id IS NULL)
"""

QUERIES = {"p4_found": p4_found, "p4_removed_counts": p4_removed_counts, "p5_found": p5_found}

def _p5_sql() -> str:
    """Fields cut into literals and the rest; delimiters inside literals and addresses stand as private characters while the
    field is split. An address is extended over one comma or semicolon at a time."""
    inside, outside = ",;|" + "\t\r\n\x0b\x0c\x85\u2028\u2029", "".join(map(chr, range(0xE000, 0xE00B)))
    codes = lambda t: " || ".join(f"chr({ord(c)})" for c in t)
    hide, show = (lambda e: f"translate({e}, {codes(inside)}, {codes(outside)})"), (lambda e: f"translate({e}, {codes(outside)}, {codes(inside)})")
    body = "regexp_replace(s, '([,;])((?i:https?)://)', '\\1 \\2', 'g')"
    for _ in range(8):
        body = f"regexp_replace(regexp_replace({body}, '((?i:https?)://[^\\s,;|]*),([\\p{{L}}\\p{{N}}])', '\\1' || chr(57344) || '\\2', 'g'), '((?i:https?)://[^\\s,;|]*);([\\p{{L}}\\p{{N}}])', '\\1' || chr(57345) || '\\2', 'g')"
    blanks = " || ".join(f"chr({c})" for c in (*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))
    literal = hide("""replace(regexp_replace(regexp_replace(s, '^"', ''), '"$', ''), '""', '"')""")
    curly = hide("regexp_replace(regexp_replace(s, '^“', ''), '”$', '')")
    return f"""WITH f AS (SELECT 'dosje' AS table_name, rec_no, burimet AS x FROM dosje UNION ALL SELECT 'lidhje', rec_no, burimi FROM lidhje),
s AS (SELECT table_name, rec_no, array_to_string(list_transform(regexp_extract_all(x, '"(?:[^"]|"")*"?|“[^”]*”?|[^"“]+'), lambda s: CASE WHEN s[1] = '"' THEN {literal} WHEN s[1] = '“' THEN {curly} ELSE {body} END), '') AS x
  FROM f WHERE x IS NOT NULL AND lower(trim(x, {blanks})) NOT IN ('', '-', 'n/a')),
v AS (SELECT table_name, rec_no, list_filter(list_transform(string_split_regex(x, '[,;|\\t\\r\\n\\x0b\\x0c\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda i: trim({show("i")}, {blanks})), lambda i: i <> '') AS l FROM s)
SELECT table_name, rec_no, CAST(p AS INTEGER) AS item_pos, l[p] AS item_value FROM v, unnest(range(1, len(l) + 1)) AS r(p)"""


_P5 = _p5_sql()

SQL = {
    "p4_found": _P4 + "SELECT generation_id, chunk_id, change FROM changes",
    "p4_removed_counts": _P4
    + """, n AS (SELECT generation_id, count(*) AS n FROM changes WHERE change = 'removed' GROUP BY 1),
    o AS (SELECT m.generation_id, CAST(m.removed_chunk_count AS BIGINT) AS stated_removed,
      CASE WHEN m.status IN ('active', 'superseded') THEN CAST(coalesce(n.n, 0) AS BIGINT) END AS derived_removed
    FROM generation_manifest m LEFT JOIN n ON n.generation_id = m.generation_id)
    SELECT generation_id, stated_removed, derived_removed, stated_removed IS NOT DISTINCT FROM derived_removed AS agrees FROM o""",
    "p5_found": _P5,
}
