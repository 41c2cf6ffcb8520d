"""Queries over an index of chunks: full text, vectors and both fused, with scope and citation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents, embeddings, fulltext, retrieve
from ..sources.shared import new_folder
from .registry import query, table

SIZE, TOP = 200, 8
QUESTION, NEAR = 'er tion -eding or "les ou"', "the ering of reing"


def _chunks(spark, sf_dir):
    return documents.word_chunks(table(spark, sf_dir, "documents"), SIZE, keep=["source"])


def _path(spark):
    return new_folder(spark, "index")


_C = f"""c AS (SELECT doc_id, source, CAST(k AS INTEGER) AS chunk, array_to_string(w[k * {SIZE} + 1:(k + 1) * {SIZE}], ' ') AS text FROM (
  SELECT *, unnest(range(0, (len(w) - 1) // {SIZE} + 1)) AS k FROM (
    SELECT doc_id, source, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) > 0)),
x AS (SELECT doc_id, source, chunk, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (
  SELECT doc_id, source, chunk, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM c))"""
_ONE = """CASE WHEN regexp_matches(word, '(sses|ies)$') THEN left(word, length(word) - 2)
WHEN regexp_matches(word, 's$') AND NOT regexp_matches(word, '(ss|us|is)$') THEN left(word, length(word) - 1) ELSE word END"""
_BARE = """CASE WHEN regexp_matches(one, '[aeiouy].*ing$') THEN left(one, length(one) - 3) WHEN regexp_matches(one, '[aeiouy].*ed$') THEN left(one, length(one) - 2) END"""
_WHOLE = """CASE WHEN regexp_matches(bare, '(at|bl|iz)$') THEN bare || 'e' WHEN regexp_matches(bare, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(bare, length(bare) - 1) ELSE bare END"""
_TERMS = f"""s AS (SELECT doc_id, source, chunk, pos, CASE WHEN length(word) <= 3 OR NOT regexp_matches(word, '(s|ed|ing|y)$') THEN word
  WHEN regexp_matches(two, '[aeiouy].*y$') THEN left(two, length(two) - 1) || 'i' ELSE two END AS term FROM (
  SELECT *, coalesce({_WHOLE}, one) AS two FROM (SELECT *, {_BARE} AS bare FROM (SELECT *, {_ONE} AS one FROM x WHERE word NOT IN {fulltext.STOP!r})))),
n AS (SELECT doc_id, chunk, count(*) AS n_terms FROM s GROUP BY ALL),
f AS (SELECT (SELECT count(*) FROM c) AS chunks, (SELECT count(*) FROM s) / (SELECT count(*) FROM c) AS mean),
t AS (SELECT doc_id, source, chunk, term, count(*) AS tf FROM s GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM t GROUP BY ALL)"""


def _scored(terms: str) -> str:
    return f"""SELECT doc_id, source, chunk, round(sum(ln(1 + (chunks - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_terms / mean))), 6) AS score
FROM t JOIN d USING (term) JOIN n USING (doc_id, chunk), f WHERE term IN ({terms}) GROUP BY ALL"""


@query(f"""WITH {_C}, {_TERMS}, m AS (
  SELECT doc_id, chunk FROM t GROUP BY ALL HAVING bool_or(term = 'er') AND bool_or(term = 'tion') AND NOT bool_or(term = 'ed')
  UNION SELECT a.doc_id, a.chunk FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.chunk = b.chunk AND a.term = 'les' AND b.term = 'ou' AND b.pos = a.pos + 1)
SELECT doc_id, chunk, score FROM ({_scored("'er', 'tion', 'les', 'ou'")}) JOIN m USING (doc_id, chunk)""")
def search_fulltext(spark, sf_dir):
    """All chunks that answer a question with and, or, not and a phrase, by BM25."""
    index = fulltext.build(_chunks(spark, sf_dir), _path(spark))
    return fulltext.search(spark, index, QUESTION).withColumn("score", F.round("score", 6))


_BUCKET = "CAST(('0x' || substr(md5({w}), 1, 8)) AS BIGINT) % 256"
_SIGN = "1 - 2 * ((instr('0123456789abcdef', substr(md5({w}), 9, 1)) - 1) % 2)"
_VECTORS = f"v AS (SELECT doc_id, source, chunk, {_BUCKET.format(w='word')} AS b, sum({_SIGN.format(w='word')}) AS x FROM x GROUP BY ALL)"


@query(f"""WITH {_C}, {_VECTORS} SELECT doc_id, chunk, md5(string_agg(CAST(coalesce(v.x, 0) AS BIGINT), ',' ORDER BY r.b)) AS digest
FROM c CROSS JOIN (SELECT unnest(range(256)) AS b) r LEFT JOIN v USING (doc_id, chunk, b) GROUP BY doc_id, chunk""")
def embed_chunks(spark, sf_dir):
    """A vector of every chunk, 64 texts a call; shown by a digest of its components."""
    rows = embeddings.embedded(_chunks(spark, sf_dir))
    return rows.select("doc_id", "chunk", F.md5(F.concat_ws(",", F.transform("embedding", lambda x: x.cast("long").cast("string")))).alias("digest"))


_SCOPE = "source IN ('src1', 'src2', 'src3')"
_PLACE = "CAST(row_number() OVER (ORDER BY score DESC, chunk, doc_id) AS INTEGER)"


@query(f"""WITH {_C}, {_TERMS}, {_VECTORS},
qv AS (SELECT {_BUCKET.format(w='w')} AS b, sum({_SIGN.format(w='w')}) AS x FROM (SELECT unnest(string_split('{NEAR}', ' ')) AS w) GROUP BY ALL),
lex AS (SELECT *, {_PLACE} AS rank FROM ({_scored("'er', 're'")}) JOIN (SELECT doc_id, chunk FROM t GROUP BY ALL HAVING bool_or(term = 'er') AND bool_or(term = 're')) USING (doc_id, chunk) WHERE {_SCOPE} QUALIFY rank <= {4 * TOP}),
vec AS (SELECT *, {_PLACE} AS rank FROM (SELECT doc_id, source, chunk, round(sum(v.x * coalesce(qv.x, 0)) / (sqrt(sum(v.x * v.x)) * (SELECT sqrt(sum(x * x)) FROM qv)), 6) AS score
  FROM v LEFT JOIN qv USING (b) GROUP BY ALL HAVING sum(v.x * v.x) > 0) WHERE {_SCOPE} QUALIFY rank <= {4 * TOP}),
r AS (SELECT doc_id, chunk, round(sum(1 / (60 + rank)), 8) AS score FROM (SELECT doc_id, chunk, rank FROM lex UNION ALL SELECT doc_id, chunk, rank FROM vec) GROUP BY ALL)
SELECT doc_id, chunk, r.score, source || ', section ' || chunk AS citation FROM r JOIN c USING (doc_id, chunk) ORDER BY r.score DESC, chunk, doc_id LIMIT {TOP}""")
def search_hybrid_chunks(spark, sf_dir):
    """The best chunks of three sources by words and by vectors, four times as many from either list, with citations."""
    index = retrieve.index_chunks(_chunks(spark, sf_dir), _path(spark), scope=["source"])
    hits = retrieve.hybrid(spark, index, NEAR, TOP, within=F.expr(_SCOPE))
    return hits.select("doc_id", "chunk", F.round("score", 8).alias("score"), retrieve.citation(F.col("source"), F.lit(None), F.col("chunk"), F.lit(None)).alias("citation"))
