"""The queries ``opN_<name>`` over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, divergence, fingerprints, html_text, jaccard, licenses, quality, quality_rules, sharding, toxicity, vector_codes, warc
from .shared import table

SHARD_BYTES = 1 << 20


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_components(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_likeness(table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_decontaminate, op2_sharding, op3_bpe, op4_jaccard_join, op5_quality, op6_fingerprints, op7_licenses, op8_warc, op9_html_text, op10_toxicity,
        op11_quality_rules, op12_divergence, op13_vector_codes,
    )
    return {f.__name__: f for f in found}


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, size, array_to_string(w[o:o + size - 1], ' ') AS phrase
       FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS o FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, o, size, array_to_string(w[o:o + size - 1], ' ') AS phrase
       FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS o FROM d, (SELECT DISTINCT size FROM iw) s WHERE len(w) >= size)),
m AS (SELECT doc_id, item_id, o, size FROM dw JOIN iw USING (size, phrase)),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(o, o + size)) AS pos FROM m) GROUP BY doc_id),
f AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(f.n_items, 0) AS n_items,
       sha256(coalesce(f.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN f USING (doc_id)
"""

#: The bucket of a row is its shortest hash prefix whose rows fit the limit (unless a row is alone).
SHARDING_SQL = f"""
WITH h AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
         lpad(bin(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT), 60, '0') AS bits
  FROM documents),
p AS (SELECT doc_id, n_bytes, d.depth, substr(bits, 1, d.depth) AS shard FROM h, (SELECT unnest(range(0, 21)) AS depth) d),
t AS (SELECT shard, depth, count(*) AS shard_rows, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes FROM p GROUP BY ALL),
f AS (SELECT p.doc_id, min(p.depth) AS depth FROM p JOIN t USING (shard, depth)
      WHERE shard_bytes <= {SHARD_BYTES} OR shard_rows = 1 GROUP BY p.doc_id)
SELECT p.doc_id, p.n_bytes, p.shard, CAST(p.depth AS INTEGER) AS depth, t.shard_rows, t.shard_bytes
FROM f JOIN p USING (doc_id, depth) JOIN t USING (shard, depth)
"""


def licenses_sql() -> str:
    """The scan in SQL: candidates join the known sentences, and each rule is one step over the sequences."""
    known = ", ".join(f"('{text}', '{name}')" for text, name in licenses.KNOWN.items())
    steps, last = [], "s"
    for n, (_, sequence) in enumerate(licenses.RULES):
        pattern = "".join(f"<{i}>" for i in sequence)
        steps.append(f"r{n} AS (SELECT *, contains(q{n}, '{pattern}') AS m{n}, replace(q{n}, '{pattern}', '-') AS q{n + 1} FROM {last})")
        last = f"r{n}"
    found = ", ".join(f"CASE WHEN m{n} THEN '{licence}' END" for n, (licence, _) in enumerate(licenses.RULES))
    clean = f"trim(regexp_replace(lower(x), '{licenses.NOT_WORD}', ' ', 'g'))"
    return f"""
WITH known(sentence, name) AS (VALUES {known}),
d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT rn, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS k FROM (
  SELECT rn, string_split(regexp_replace(text, '{licenses.SENTENCE_END}', '\\1' || chr(1), 'g'), chr(1)) AS pieces FROM d)),
l AS (SELECT rn, k, list_filter(list_transform(string_split(piece, chr(10)), lambda x: {clean}), lambda x: x <> '') AS lines FROM p),
c AS (SELECT rn, k, lines, unnest(range(1, len(lines) + 1)) AS i FROM l),
m AS (SELECT rn, k, i, coalesce(w.name, o.name) AS name
      FROM (SELECT *, CASE WHEN len(lines) - i < {licenses.MAX_WORDS} THEN array_to_string(lines[i:], ' ') END AS rest, lines[i] AS line FROM c)
      LEFT JOIN known w ON rest = w.sentence LEFT JOIN known o ON line = o.sentence),
s AS (SELECT rn, count(*) AS n_known, string_agg(name, ',' ORDER BY k, i) AS ids, string_agg('<' || name || '>', '' ORDER BY k, i) AS q0
      FROM m WHERE name IS NOT NULL GROUP BY rn),
{", ".join(steps)}
SELECT d.doc_id, coalesce(n_known, 0) AS n_known, coalesce(ids, '') AS sentence_ids,
       coalesce(array_to_string(list_sort(list_distinct(list_filter([{found}], lambda x: x IS NOT NULL))), ','), '') AS licenses,
       coalesce(array_to_string(regexp_extract_all(q{len(licenses.RULES)}, '<([^<>]+)>', 1), ','), '') AS unmatched
FROM d LEFT JOIN {last} USING (rn)
"""


LICENSES_SQL = licenses_sql()


DIVERGENCE_SQL = r"""
WITH t AS (SELECT rn, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (
  SELECT row_number() OVER () AS rn, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT rn) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY ALL),
o AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
g AS (SELECT o.lang, o.source, coalesce(sum(n), 0) AS total FROM o LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 1) // (total + v) AS p
      FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (sum(n) + 1) // (sum(sum(n)) OVER (PARTITION BY lang) + any_value(v)) AS q
      FROM c JOIN v USING (lang) GROUP BY lang, term),
d AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
      FROM o a JOIN o b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r
QUALIFY part = 'pair' OR rank <= 200
"""


def vector_codes_sql() -> str:
    """Each round in two steps: the nearest entry of every part (ties to the lower one), then the entries' means."""
    steps = []
    for r in range(vector_codes.ROUNDS + 1):
        steps.append(f"""d{r} AS (SELECT x.rn, x.part, b.entry, CAST(sum((x.x - b.c) * (x.x - b.c)) AS BIGINT) AS d
      FROM x JOIN b{r} b USING (part, place) GROUP BY ALL),
a{r} AS (SELECT rn, part, min(d) AS d, arg_min(entry, (d, entry)) AS entry FROM d{r} GROUP BY ALL)""")
        if r < vector_codes.ROUNDS:
            steps.append(f"""b{r + 1} AS (SELECT b.part, b.entry, b.place, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN (
      SELECT part, entry, place, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS c FROM x JOIN a{r} USING (rn, part) GROUP BY ALL) m
      USING (part, entry, place))""")
    last, k = vector_codes.ROUNDS, vector_codes.PARTS
    return f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS rn, vec_id, label, len(embedding) // {k} AS width,
      list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {vector_codes.SCALE}) AS BIGINT)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT rn, (i - 1) // width AS part, (i - 1) % width AS place, v[i] AS x FROM (SELECT rn, width, v, unnest(range(1, len(v) + 1)) AS i FROM kept)),
b0 AS (SELECT part, rn AS entry, place, x AS c FROM x WHERE rn < {vector_codes.ENTRIES}),
{", ".join(steps)},
e AS (SELECT rn, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{last} GROUP BY rn),
s AS (SELECT sha256(string_agg(c, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM b{last})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN e USING (rn), s
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": DECONTAMINATE_SQL,
        "op2_sharding": SHARDING_SQL,
        "op7_licenses": LICENSES_SQL,
        "op12_divergence": DIVERGENCE_SQL,
        "op13_vector_codes": vector_codes_sql(),
    }
