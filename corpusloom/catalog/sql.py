"""Shared SQL fragments: the derived corpus entities as common table expressions for DuckDB."""

from __future__ import annotations

BASES = """
knowledge_bases AS (
  SELECT DISTINCT source AS kb_id, source NOT IN ('src7', 'src13') AS enabled,
         CAST(substr(source, 4) AS INTEGER) % 2 = 0 AS wiki_enabled
  FROM documents)"""

DIM = """
documents_dim AS (
  SELECT d.doc_id, d.source AS kb_id, d.lang, 'doc-' || d.doc_id AS title,
         'doc-' || d.doc_id || '.txt' AS filename, coalesce(l.toxic = 1, false) AS deleted,
         CASE WHEN d.doc_id % 17 = 0 THEN 'failed' ELSE 'ready' END AS status,
         CASE WHEN d.doc_id % 17 = 0 THEN NULL
              WHEN d.doc_id % 13 = 0 THEN d.doc_id || '-v2' ELSE d.doc_id || '-v1' END
           AS active_version_id
  FROM documents d LEFT JOIN labels l USING (doc_id))"""

VERSIONS = """
version_texts AS (
  SELECT doc_id, source AS kb_id, lang, 1 AS version_no, doc_id || '-v1' AS version_id,
         CASE WHEN doc_id % 17 = 0 AND doc_id % 13 <> 0 THEN 'failed' ELSE 'ready' END AS version_status,
         CASE WHEN doc_id % 13 = 0 THEN substr(text, 1, length(text) // 2) ELSE text END AS text
  FROM documents
  UNION ALL
  SELECT doc_id, source, lang, 2, doc_id || '-v2',
         CASE WHEN doc_id % 17 = 0 THEN 'failed' ELSE 'ready' END, text
  FROM documents WHERE doc_id % 13 = 0)"""

CHUNKS = (
    VERSIONS
    + """,
version_lines AS (
  SELECT * EXCLUDE (text), unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS line_no
  FROM version_texts),
sections AS (
  SELECT * EXCLUDE (line, line_no), trim(line) AS text,
         row_number() OVER (PARTITION BY version_id ORDER BY line_no) - 1 AS section_no
  FROM version_lines WHERE trim(line) <> ''),
pieces AS (
  SELECT *, 0 AS child_no, text AS content FROM sections
  UNION ALL
  SELECT *, substr(text, (child_no - 1) * 200 + 1, 200) AS content
  FROM (SELECT *, unnest(range(1, (length(text) + 199) // 200 + 1)) AS child_no FROM sections)),
chunks AS (
  SELECT *, substr(sha256(version_id || '|' || kind || '|' || ordinal), 1, 32) AS chunk_id,
         CASE WHEN child_no > 0
              THEN substr(sha256(version_id || '|parent|' || (ordinal - child_no)), 1, 32) END
           AS parent_chunk_id
  FROM (SELECT *, row_number() OVER (PARTITION BY version_id ORDER BY section_no, child_no) - 1
                    AS ordinal,
               CASE WHEN child_no > 0 THEN 'child' ELSE 'parent' END AS kind
        FROM pieces)),
children AS (SELECT * FROM chunks WHERE kind = 'child' AND version_status = 'ready')"""
)

FOLD = "replace(lower({0}), 'ß', 'ss')"
TERMS = "regexp_extract_all(" + FOLD + ", '[a-z0-9]+|[㐀-鿿]')"

QUERIES = "queries AS (SELECT item_id AS query_id, text FROM benchmark)"

KEYWORD = (
    """
index_terms AS (SELECT chunk_id, doc_id, kb_id, version_id, """
    + TERMS.format("content")
    + """ AS terms FROM children),
index_stats AS (SELECT count(*) AS n_chunks, avg(len(terms)) AS avg_length FROM index_terms),
posting_terms AS (SELECT chunk_id, kb_id, len(terms) AS length, unnest(terms) AS term FROM index_terms),
postings AS (SELECT chunk_id, kb_id, length, term, count(*) AS tf FROM posting_terms GROUP BY ALL),
query_terms AS (SELECT DISTINCT query_id, unnest("""
    + TERMS.format("text")
    + """) AS term FROM queries),
term_df AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
keyword_scores AS (
  SELECT q.query_id, p.chunk_id,
         round(sum(ln(1 + (s.n_chunks - d.df + 0.5) / (d.df + 0.5))
               * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.length / s.avg_length))), 6) AS score
  FROM query_terms q JOIN postings p USING (term) JOIN term_df d USING (term)
       JOIN knowledge_bases b ON b.kb_id = p.kb_id AND b.enabled, index_stats s
  GROUP BY q.query_id, p.chunk_id),
keyword_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS position
  FROM keyword_scores)"""
)

DENSE = """
document_vectors AS (
  SELECT c.chunk_id, c.kb_id, CAST(e.embedding AS DOUBLE[]) AS vector
  FROM children c JOIN documents_dim d ON d.active_version_id = c.version_id
       JOIN embeddings e ON e.vec_id = c.doc_id
  WHERE c.ordinal = 1),
query_vectors AS (
  SELECT b.item_id AS query_id, CAST(e.embedding AS DOUBLE[]) AS vector
  FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id),
dense_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS position
  FROM (SELECT q.query_id, v.chunk_id, round(list_cosine_similarity(q.vector, v.vector), 6) AS score
        FROM query_vectors q, document_vectors v JOIN knowledge_bases b ON b.kb_id = v.kb_id AND b.enabled))"""

HYBRID = """
channels AS (
  SELECT query_id, 1 AS channel, chunk_id, position FROM dense_ranked WHERE position <= 30
  UNION ALL
  SELECT query_id, 2, chunk_id, position FROM keyword_ranked WHERE position <= 30),
fused AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_seen, chunk_id) AS rank
  FROM (SELECT query_id, chunk_id, round(sum(1.0 / (60 + position)), 8) AS score,
               min(channel * 1000 + position) AS first_seen
        FROM channels GROUP BY query_id, chunk_id))"""


def sql(*parts: str, select: str, recursive: bool = False) -> str:
    """A statement from common table expressions and a final select."""
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(part.strip() for part in parts) + "\n" + select.strip()
