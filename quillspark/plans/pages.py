"""Chunking and page quality queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import DOCUMENT_TYPES
from ..functions.text import first_match, first_match_sql, page_class, page_confidence
from ..operators import chunk, quality
from ..sources.pages import parse
from ..sources.tables import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as the pages of documents."""
    return table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page"), "text")


def token_windows_600_80(spark: SparkSession, d: str) -> DataFrame:
    return chunk.token_windows(_docs(spark, d), most=None)


def chunk_ids_and_spans(spark: SparkSession, d: str) -> DataFrame:
    return chunk.chunks(_docs(spark, d)).select("doc_id", "idx", "start", "end", "chunk_id")


def chunk_context_sentence(spark: SparkSession, d: str) -> DataFrame:
    noted = F.concat(F.col("text"), F.lit(" See Page "), (F.col("doc_id") % 9).cast("string"), F.when(F.col("doc_id") % 2 == 0, " of Schedule B.").otherwise("."))
    return table(spark, d, "documents").select("doc_id", chunk.context_sentence(F.col("doc_id"), F.col("lang"), noted).alias("context"))


def chunks_per_doc_cap(spark: SparkSession, d: str) -> DataFrame:
    return chunk.token_windows(_docs(spark, d), 20, 5, 400).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max("end").alias("last_token"))


def page_quality_confidence(spark: SparkSession, d: str) -> DataFrame:
    c = F.round(page_confidence(F.col("text")) + quality.TIE, 6)
    return _docs(spark, d).select("doc_id", c.alias("confidence"), page_class(c).alias("classification"))


def page_classification_counts(spark: SparkSession, d: str) -> DataFrame:
    return quality.scored(_pages(spark, d)).groupBy("classification").agg(F.count("*").alias("n"), F.sum(F.col("sparse").cast("long")).alias("n_sparse"))


def sparse_page_rescue_gate(spark: SparkSession, d: str) -> DataFrame:
    return quality.rescue_gate(_pages(spark, d))


def rescued_pages(spark: SparkSession, d: str) -> DataFrame:
    """The second parser here doubles every other page's text."""
    pages = _pages(spark, d)
    other = pages.where("page % 2 = 0").withColumn("text", F.concat("text", F.lit(" "), "text"))
    return quality.rescued(pages, other).select("doc_id", "page", "rescued", F.length("text").alias("n_chars"))


def page_routing(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d).withColumn("name", F.when(F.col("doc_id") % 5 == 0, "handwritten").otherwise("typed"))
    return quality.routed(pages, pages.where("page % 2 = 1")).select("doc_id", "page", "parser", "confidence", "classification", F.size("warnings").alias("n_warnings"))


def doc_type_inference(spark: SparkSession, d: str) -> DataFrame:
    head = F.concat(F.col("url"), F.lit("\n"), F.substring("html", 1, 3000))
    return table(spark, d, "pages").select("page_id", first_match(head, DOCUMENT_TYPES, "other").alias("doc_type"))


def last_page_marker_before_offset(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("Page 1 "), F.substring("text", 1, 40), F.lit(" Page 2 "), F.substring("text", 41, 40), F.lit(" Page 3 "), F.col("text"))
    at = (F.col("doc_id") * 7919 % (F.length(text) + 1)).cast("int")
    return _docs(spark, d).select("doc_id", at.alias("upto"), chunk.last_page_before(text, at).alias("page"))


def content_length(spark: SparkSession, d: str) -> DataFrame:
    marked = F.concat(F.lit("<!-- image -->"), F.col("text"), F.lit("[illegible]"))
    return _docs(spark, d).select("doc_id", quality.content_length(marked).alias("n_chars"))


def document_assembly(spark: SparkSession, d: str) -> DataFrame:
    """A document's markdown: its pages in order under headings."""
    block = F.concat(F.lit("## Page "), F.col("page").cast("string"), F.lit("\n\n"), F.btrim("text"))
    listed = F.array_sort(F.collect_list(F.struct("page", block.alias("block"))))
    return _pages(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.sha2(F.array_join(F.transform(listed, lambda x: x["block"]), "\n\n"), 256).alias("markdown_sha256"))


def _text_layer(content: bytes) -> list[str]:
    """A stand-in: pages of 300 characters. Some documents can't be read, some have no text layer, and some pages of others are pictures."""
    text = content.decode()
    if len(text) % 7 == 0:
        raise ValueError("no pages")
    cut = [text[a : a + 300] for a in range(0, len(text), 300)]
    return ["" if len(text) % 11 == 0 else p[:20] if len(text) % 2 == 0 and i % 3 == 0 else p for i, p in enumerate(cut)]


def _ocr(content: bytes) -> list[str]:
    text = content.decode()
    if len(text) % 13 == 0:
        raise ValueError("no pages")
    return [text[a : a + 300] for a in range(0, len(text), 300)]


def document_intake(spark: SparkSession, d: str) -> DataFrame:
    """Documents from their files: text layer first, the second parser where it's needed, transcripts of what is handwritten."""
    files = _docs(spark, d).select(F.col("doc_id").cast("string").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"))
    names = files.select("doc_id", F.when(F.col("doc_id").endswith("5"), F.concat("doc_id", F.lit("-handwritten"))).otherwise(F.col("doc_id")).alias("name"))
    first = parse(files, lambda: _text_layer, "text_layer")
    transcripts = names.where("name <> doc_id").select("doc_id", F.lit(1).alias("page"), F.concat(F.lit("transcript of "), "doc_id").alias("text"))
    out = quality.intake(names, first, lambda asked: parse(files, lambda: _ocr, "ocr", asked), transcripts)
    lowest = F.array_min(F.transform("pages", lambda p: p["confidence"]))
    by = F.array_join(F.transform("pages", lambda p: F.concat(p["parser"], F.lit(":"), p["classification"])), " ")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.size("pages").alias("n_pages"), F.array_join("parsers", " ").alias("parsers"), F.size("warnings").alias("n_warnings"), F.round(lowest, 6).alias("lowest"), F.sha2(by, 256).alias("pages_sha256"), F.sha2("markdown", 256).alias("markdown_sha256"))


_N = r"len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))"


def _windows(size: int, step: int, most: int | None) -> str:
    cap = f" WHERE idx < {most}" if most else ""
    return f"""SELECT doc_id, idx::INT AS idx, (idx * {step})::INT AS first, least(idx * {step} + {size}, n)::INT AS "end"
FROM (SELECT doc_id, n, unnest(generate_series(0, greatest(0, ceil((n - {size}) / {step}))::BIGINT)) AS idx FROM (SELECT doc_id, {_N} AS n FROM documents) WHERE n > 0){cap}"""


_SPANS = r"""
p AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+')) AS piece, generate_subscripts(regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+'), 1) - 1 AS tok FROM documents),
s AS (SELECT doc_id, tok, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY tok) AS stop, stop - length(regexp_replace(piece, '^[\x20\x09-\x0D]+', '')) AS start FROM p)
"""
_TRIMMED = r"regexp_replace({}, '^[\x09-\x0D\x1C-\x20\x{{85}}\p{{Z}}]+|[\x09-\x0D\x1C-\x20\x{{85}}\p{{Z}}]+$', '', 'g')"
_CONF = r"""CASE WHEN t = '' THEN 0.0 ELSE greatest(0.1, least(0.98, 0.45 + 0.35 * length(regexp_replace(t, '[^\p{L}\p{N}]', '', 'g')) / greatest(length(regexp_replace(t, '[\p{C}\p{Z}]', '', 'g')), 1) + 0.2 * least(length(t) / 800.0::DOUBLE, 1.0))) END"""
_CLASS = "CASE WHEN {0} < 0.45 THEN 'mixed_low_quality' WHEN {0} < 0.8 THEN 'scanned_typed' ELSE 'clean_text' END"
_P = "SELECT conv_id AS doc_id, turn + 1 AS page, text FROM conversations"
_SPARSE = "length(trim(text)) < 60"
_SCORED = f"SELECT *, {_CLASS.format('c')} AS classification FROM (SELECT doc_id, page, text, round({_CONF} + 1e-12, 6) AS c FROM (SELECT *, {_TRIMMED.format('text')} AS t FROM ({_P})))"

QUERIES = {
    f.__name__: f
    for f in (token_windows_600_80, chunk_ids_and_spans, chunk_context_sentence, chunks_per_doc_cap, page_quality_confidence, page_classification_counts, sparse_page_rescue_gate, rescued_pages, page_routing, doc_type_inference, last_page_marker_before_offset, content_length, document_assembly, document_intake)
}
SQL = {
    "token_windows_600_80": _windows(600, 520, None),
    "chunk_ids_and_spans": f"""WITH {_SPANS}, w AS ({_windows(600, 520, 400)}),
c AS (SELECT w.doc_id, w.idx, a.start::INT AS start, b.stop::INT AS "end" FROM w JOIN s a ON a.doc_id = w.doc_id AND a.tok = w.first JOIN s b ON b.doc_id = w.doc_id AND b.tok + 1 = w."end")
SELECT c.doc_id, idx, start, "end", c.doc_id || ':chunk:' || lpad(idx::VARCHAR, 4, '0') || ':' || substr(sha1(substr(text, start + 1, "end" - start)), 1, 10) AS chunk_id FROM c JOIN documents d USING (doc_id)""",
    "chunk_context_sentence": r"""SELECT doc_id, 'This chunk comes from ' || CASE WHEN s <> '' THEN s || ' of ' WHEN p <> '' THEN p || ' of ' ELSE '' END || doc_id || ', a ' || lang || '.' AS context
FROM (SELECT doc_id, lang, replace(regexp_extract(t, '(?i)\b(Schedule\s+[A-Z](?:[-\s]+Section\s+[IVX]+)?)\b', 1), chr(10), ' ') AS s, regexp_extract(t, '(?i)\b(Page\s+[0-9]+)\b', 1) AS p
  FROM (SELECT doc_id, lang, text || ' See Page ' || (doc_id % 9) || CASE WHEN doc_id % 2 = 0 THEN ' of Schedule B.' ELSE '.' END AS t FROM documents))""",
    "chunks_per_doc_cap": f'SELECT doc_id, count(*) AS n_chunks, max("end") AS last_token FROM ({_windows(20, 15, 400)}) GROUP BY doc_id',
    "page_quality_confidence": f"SELECT doc_id, c AS confidence, {_CLASS.format('c')} AS classification FROM (SELECT doc_id, round({_CONF} + 1e-12, 6) AS c FROM (SELECT doc_id, {_TRIMMED.format('text')} AS t FROM documents))",
    "page_classification_counts": f"SELECT classification, count(*) AS n, sum(({_SPARSE})::INT)::BIGINT AS n_sparse FROM ({_SCORED}) GROUP BY classification",
    "sparse_page_rescue_gate": f"SELECT *, n_sparse > 0 AND (n_sparse / n_pages >= 0.30 OR n_pages <= 3) AS rescue FROM (SELECT doc_id, count(*) AS n_pages, sum(({_SPARSE})::INT)::BIGINT AS n_sparse FROM ({_P}) WHERE page <= 500 GROUP BY doc_id)",
    "rescued_pages": f"SELECT doc_id, page, page % 2 = 0 AND length(text || ' ' || text) > length(text) AS rescued, length(CASE WHEN page % 2 = 0 THEN text || ' ' || text ELSE text END)::INT AS n_chars FROM ({_P})",
    "page_routing": f"""SELECT doc_id, page, CASE WHEN h AND page % 2 = 1 THEN 'transcript' ELSE 'text_layer' END AS parser, CASE WHEN h AND page % 2 = 1 THEN 0.95 WHEN h THEN least(0.4, c) ELSE c END AS confidence,
  CASE WHEN h THEN 'handwritten' ELSE classification END AS classification, CASE WHEN h AND page % 2 = 0 THEN 1 ELSE 0 END AS n_warnings FROM (SELECT *, doc_id % 5 = 0 OR (contains(lower(text), 'probate court') AND contains(lower(text), 'made this') AND length(text) < 2500) AS h FROM ({_SCORED}))""",
    "doc_type_inference": f"SELECT page_id, {first_match_sql('h', DOCUMENT_TYPES, 'other')} AS doc_type FROM (SELECT page_id, url || chr(10) || substr(html, 1, 3000) AS h FROM pages)",
    "last_page_marker_before_offset": r"""SELECT doc_id, upto, coalesce(list_last(regexp_extract_all(substr(t, 1, upto), '\b[Pp]age ([0-9]+)', 1))::INT, 1) AS page
FROM (SELECT *, (doc_id * 7919 % (length(t) + 1))::INT AS upto FROM (SELECT doc_id, 'Page 1 ' || substr(text, 1, 40) || ' Page 2 ' || substr(text, 41, 40) || ' Page 3 ' || text AS t FROM documents))""",
    "content_length": "SELECT doc_id, length(trim(replace(replace(replace(replace('<!-- image -->' || text || '[illegible]', '<!-- image -->', ''), '[illegible]', ''), '[blank page]', ''), '---', '')))::INT AS n_chars FROM documents",
    "document_assembly": "SELECT conv_id AS doc_id, count(*) AS n_pages, sha256(string_agg('## Page ' || (turn + 1) || chr(10) || chr(10) || trim(text), chr(10) || chr(10) ORDER BY turn, text)) AS markdown_sha256 FROM conversations GROUP BY conv_id",
    "document_intake": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS whole, length(whole) AS len, doc_id % 10 = 5 AS hand FROM documents),
pg AS (SELECT *, unnest(generate_series(1, ceil(len / 300.0)::BIGINT)) AS page, substr(whole, (page - 1) * 300 + 1, 300) AS full_page, CASE WHEN len % 11 = 0 THEN '' WHEN len % 2 = 0 AND page % 3 = 1 THEN substr(full_page, 1, 20) ELSE full_page END AS layer FROM d),
per AS (SELECT d.doc_id, d.len, count(page) AS n, coalesce(sum(length(layer)), 0) AS chars, count(page) FILTER (length(trim(layer)) < 60) AS few FROM d LEFT JOIN pg ON pg.doc_id = d.doc_id AND d.len % 7 <> 0 GROUP BY ALL),
st AS (SELECT *, chars < 60 AS none, NOT none AND few > 0 AND (few / n >= 0.30 OR n <= 3) AS rescue, NOT none AND few > 0 AND NOT rescue AS passed, len % 13 <> 0 AND len > 0 AND (none OR rescue) AS second, none AND second AS replaced FROM per),
ch AS (SELECT pg.doc_id, pg.page, hand, replaced OR (second AND length(trim(layer)) < 60 AND length(trim(full_page)) > length(trim(layer))) AS ocr, CASE WHEN ocr THEN full_page ELSE layer END AS own FROM pg JOIN st USING (doc_id) WHERE replaced OR pg.len % 7 <> 0),
hd AS (SELECT *, hand OR (contains(lower(own), 'probate court') AND contains(lower(own), 'made this')) AS h, hand AND page = 1 AS script, {_TRIMMED.format('own')} AS t FROM ch),
sc AS (SELECT *, round({_CONF} + 1e-12, 6) AS c FROM hd),
pp AS (SELECT doc_id, page, h, script, CASE WHEN script THEN 'transcript of ' || doc_id ELSE own END AS text, CASE WHEN script THEN 0.95 WHEN h THEN least(0.4, c) ELSE c END AS confidence, CASE WHEN script THEN 'transcript' WHEN ocr THEN 'ocr' ELSE 'text_layer' END || ':' || CASE WHEN h THEN 'handwritten' ELSE {_CLASS.format('c')} END AS how FROM sc),
ag AS (SELECT doc_id, count(*) AS n_pages, count(*) FILTER (h AND NOT script) AS lost, bool_or(script) AS script, min(confidence) AS lowest, string_agg(how, ' ' ORDER BY page) AS hows, string_agg('## Page ' || page || chr(10) || chr(10) || trim(text), chr(10) || chr(10) ORDER BY page) AS md FROM pp GROUP BY doc_id)
SELECT doc_id, coalesce(n_pages, 0)::INT AS n_pages, concat_ws(' ', CASE WHEN NOT replaced THEN 'text_layer' END, CASE WHEN second THEN 'ocr' END, CASE WHEN script THEN 'transcript' END) AS parsers,
  ((len % 7 = 0)::INT + (len % 13 = 0 AND (none OR rescue))::INT + passed::INT + coalesce(lost, 0))::INT AS n_warnings, round(lowest, 6)::DOUBLE AS lowest, sha256(coalesce(hows, '')) AS pages_sha256, sha256(coalesce(md, '')) AS markdown_sha256 FROM st LEFT JOIN ag USING (doc_id)""",
}
