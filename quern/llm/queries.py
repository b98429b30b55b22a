"""Queries of the text and vector preparation problems, with the SQL they are checked against where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.leaks import leaked_items, reparameterised_items
from quern.llm.lookalikes import consistent, look_alike_classes, look_alike_pairs
from quern.llm.neighbours import similar_pairs
from quern.llm.pieces import split_oversized
from quern.llm.shared_spans import shared_share, shared_spans
from quern.llm.tokenize import encode_ids
from quern.sources.tables import table


def p1_pieces(spark: SparkSession, base: str) -> DataFrame:
    return split_oversized(table(spark, base, "source_document"), ["load_no", "document_id"])


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return p1_pieces(spark, base).where(F.col("chunk_index") == 0).select("document_id", "cut_at").distinct()


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return similar_pairs(table(spark, base, "chunk_record"))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return look_alike_pairs(table(spark, base, "source_document"))


def p3_classes(spark: SparkSession, base: str) -> DataFrame:
    return look_alike_classes(table(spark, base, "source_document"))


def p3_normalised(spark: SparkSession, base: str) -> DataFrame:
    return consistent(table(spark, base, "source_document").select("load_no", "title", "text"), ["title", "text"])


def p6_ids(spark: SparkSession, base: str) -> DataFrame:
    return encode_ids(table(spark, base, "documents"), "doc_id", "text")


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    return leaked_items(table(spark, base, "documents"), table(spark, base, "eval_item"))


def p7_reparameterised(spark: SparkSession, base: str) -> DataFrame:
    return reparameterised_items(table(spark, base, "documents"), table(spark, base, "eval_item"))


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    return shared_spans(table(spark, base, "documents"))


def p8_shared_share(spark: SparkSession, base: str) -> DataFrame:
    return shared_share(table(spark, base, "documents"))


QUERIES = {q.__name__: q for q in (p1_found, p1_pieces, p2_found, p3_found, p3_classes, p3_normalised, p6_ids, p7_found, p7_reparameterised, p8_found, p8_shared_share)}

_WS = r"[\s\x0b\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# The forms of problem 3 as its statement lists them, one character at a time and by code points, for the SQL alone.
_SEEN = {
    "а": "a", "е": "e", "ё": "ë", "ѕ": "s", "і": "i", "ї": "ï", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "к": "k", "А": "A", "В": "B", "Е": "E", "Ё": "Ë", "Ѕ": "S", "І": "I",
    "Ї": "Ï", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "α": "a", "ι": "i", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st",
}
_UNSEEN = "173, 8203, 8204, 8205, 8206, 8207, 8288, 65039, 65279"
_CHARACTER = (
    "CASE WHEN unicode(c) BETWEEN 65281 AND 65374 THEN chr(unicode(c) - 65248) WHEN unicode(c) IN (160, 12288, 8239, 8287) OR unicode(c) BETWEEN 8192 AND 8202 THEN ' '"
    + f" WHEN unicode(c) IN ({_UNSEEN}) THEN '' "
    + " ".join(f"WHEN c = '{a}' THEN '{b}'" for a, b in _SEEN.items())
    + " ELSE c END"
)


def _consistent(column: str) -> str:
    return f"nfc_normalize(array_to_string(list_transform(regexp_extract_all({column}, '(?s).'), lambda c: {_CHARACTER}), ''))"


_FORMS = f"""
forms AS (
  SELECT DISTINCT 'title' AS field_name, title AS raw, {_consistent("title")} AS form, document_id AS id FROM source_document
  UNION SELECT DISTINCT 'text', text, {_consistent("text")}, document_id FROM source_document),
f AS (SELECT * FROM forms WHERE raw IS NOT NULL AND id IS NOT NULL)"""

SQL: dict[str, str] = {
    "p1_found": rf"""
WITH t AS (SELECT DISTINCT document_id, text FROM source_document WHERE strlen(text) > 2380),
u AS (
  SELECT document_id,
    regexp_replace(text, '\n{_WS}*\n', chr(1), 'g') AS p
  FROM t),
v AS (SELECT *, regexp_replace(p, '([.!?]){_WS}+([\p{{Lu}}\p{{Nd}}])', '\1' || chr(1) || '\2', 'g') AS s FROM u),
w AS (
  SELECT document_id,
    list_max(list_transform(string_split(p, chr(1)), lambda x: strlen(regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')))) AS para,
    list_max(list_transform(string_split(s, chr(1)), lambda x: strlen(regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')))) AS sent,
    list_max(list_transform(string_split_regex(s, '{_WS}+|' || chr(1)), lambda x: strlen(x))) AS word
  FROM v)
SELECT DISTINCT document_id, CASE WHEN para <= 2108 THEN 'paragraph' WHEN sent <= 2108 THEN 'sentence' WHEN word <= 2108 THEN 'word' ELSE 'character' END AS cut_at FROM w""",
    "p2_found": """
WITH v AS (SELECT DISTINCT chunk_id, CAST(embedding AS DOUBLE[]) AS e FROM chunk_record
  WHERE chunk_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT a.chunk_id AS a, b.chunk_id AS b, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.chunk_id <> b.chunk_id),
t AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(c, 9) DESC, b) AS r FROM s)
SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM t WHERE r <= 5 AND c >= 0.9""",
    "p7_found": r"""
WITH d AS (SELECT doc_id AS id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id AS id, regexp_extract_all(strip_accents(lower(t)), '[\p{L}\p{N}]+') AS w FROM (SELECT item_id, question AS t FROM eval_item UNION ALL SELECT item_id, passage FROM eval_item) WHERE t IS NOT NULL),
dw AS (SELECT DISTINCT id, array_to_string(w[k:k + 12], ' ') AS x FROM d, unnest(range(1, len(w) - 11)) AS r(k)),
iw AS (SELECT DISTINCT id, array_to_string(w[k:k + 12], ' ') AS x FROM i, unnest(range(1, len(w) - 11)) AS r(k))
SELECT DISTINCT dw.id AS doc_id, iw.id AS item_id FROM dw JOIN iw USING (x)""".replace("\\\\", "\\"),
    "p8_found": """
WITH w AS (SELECT doc_id, k, md5(substr(text, k + 1, 360)) AS h FROM documents, unnest(range(0, length(text) - 359)) AS r(k) WHERE length(text) >= 360),
s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)),
m AS (SELECT DISTINCT doc_id, k FROM w SEMI JOIN s USING (h)),
n AS (SELECT *, CASE WHEN k > lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 360 THEN 1 ELSE 0 END AS fresh FROM m),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM n)
SELECT doc_id, CAST(min(k) AS INTEGER) AS span_start, CAST(max(k) + 360 AS INTEGER) AS span_end FROM g GROUP BY doc_id, run""",
    "p8_shared_share": """
WITH w AS (SELECT doc_id, k, md5(substr(text, k + 1, 360)) AS h FROM documents, unnest(range(0, length(text) - 359)) AS r(k) WHERE length(text) >= 360),
s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)),
m AS (SELECT DISTINCT doc_id, k FROM w SEMI JOIN s USING (h)),
c AS (SELECT doc_id, count(DISTINCT x) AS shared FROM m, unnest(range(k, k + 360)) AS r(x) GROUP BY doc_id)
SELECT doc_id, length(text) AS n_chars, coalesce(shared, 0) AS shared_chars, CASE WHEN length(text) > 0 THEN round(coalesce(shared, 0) / length(text), 6) ELSE 0 END AS shared_part
FROM documents LEFT JOIN c USING (doc_id)""",
    "p3_found": f"""WITH {_FORMS}
SELECT DISTINCT x.field_name, x.id AS document_id_a, y.id AS document_id_b FROM f x JOIN f y USING (field_name, form) WHERE x.id < y.id AND x.raw <> y.raw""",
    "p3_classes": f"""WITH {_FORMS},
g AS (SELECT field_name, form, min(id) AS class_id, count(DISTINCT raw) AS stored_forms, count(DISTINCT id) AS keys FROM f GROUP BY ALL)
SELECT DISTINCT field_name, f.id AS document_id, class_id, stored_forms, keys FROM f JOIN g USING (field_name, form) WHERE stored_forms > 1 AND keys > 1""",
    "p3_normalised": f"SELECT load_no, {_consistent('title')} AS title, {_consistent('text')} AS text FROM source_document",
}
