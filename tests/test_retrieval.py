"""Chunks, the full-text index, embeddings and hybrid retrieval, on fixtures and against brute force."""

import re

import pytest
from pyspark.sql import functions as F

from lodemap.operators import documents, embeddings, fulltext, retrieve
from lodemap.plans.registry import table
from tests.conftest import TINY

AGREEMENT = """# Agreement

## Payment Terms

Section 4 Fees

4.1 The buyer shall pay the invoice amount within thirty days of receiving the invoice.
The amount due includes all taxes and charges described in this document.

4.2 Late fees apply when payment is not received by the due date stated above."""


def test_headings_sections_and_clauses():
    found = documents.chunk_pages([(1, AGREEMENT, False)], "Contract.pdf", tiny=1)
    clause = next(c for c in found if c.clause == "4.1")
    assert (clause.section, clause.path) == ("4", ("Agreement", "Payment Terms", "Section 4: Fees"))
    assert clause.text.startswith("Context: Contract.pdf > Agreement > Payment Terms > Section 4: Fees\n\n4.1 The buyer")
    assert AGREEMENT[clause.start : clause.end].startswith("4.1") and [c.clause for c in found] == [None, None, None, "4.1", "4.2"]


def test_pages_and_tiny_chunks():
    pages = [(2, "4.2 Late fees.", True), (1, "# A\n\nSection 4 Fees\n\n4.1 Pay.", False), (3, None, False), (4, "# B\n\nrest", True)]
    found = documents.chunk_pages(pages, "f")
    assert [(c.page, c.unsure, c.path, c.clause) for c in found] == [(1, False, ("A", "Section 4: Fees"), "4.1"), (2, True, ("A", "Section 4: Fees"), "4.2"), (4, True, ("B",), None)]
    assert found[0].text == "Context: f > A\n\n# A\n\nContext: f > A > Section 4: Fees\n\nSection 4 Fees\n\nContext: f > A > Section 4: Fees\n\n4.1 Pay."


def test_long_blocks_are_cut_at_blanks_and_lose_nothing():
    text = "start\n\n" + "word " * 900 + "\n\n" + "x" * 5000 + "\n\nend"
    found = documents.chunk_pages([(1, text, False)], size=1800, tiny=1)
    assert all(c.end - c.start <= 1800 for c in found)
    assert re.sub(r"\s", "", "".join(c.text for c in found)) == re.sub(r"\s", "", text)
    assert all(a.end <= b.start for a, b in zip(found, found[1:]))


def test_page_chunks_of_a_table(spark):
    rows = [("d", 2, "4.2 Late fees.", True, "C.pdf"), ("d", 1, AGREEMENT, False, "C.pdf"), ("e", 1, "", None, None), (None, 1, "plain", None, None)]
    df = spark.createDataFrame(rows, "doc string, page_number long, markdown string, low boolean, file string")
    found = documents.page_chunks(df, "doc", "page_number", "markdown", "low", "file").orderBy("doc", "chunk").collect()
    assert [(r["doc"], r["page"], r["low_confidence"]) for r in found if r["doc"] != "d"] == [(None, 1, False)]
    last = found[-1]
    assert (last["page"], last["clause"], last["section"], last["low_confidence"]) == (2, "4.2", "4", True)


def test_chunks_of_all_documents_hold_their_blocks(spark):
    """Every block of every document is in its chunks, in order, once."""
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, TINY, "documents").collect()}
    parts = {}
    for r in documents.chunks(table(spark, TINY, "documents")).orderBy("doc_id", "chunk").collect():
        parts.setdefault(r["doc_id"], []).append((r["start_char"], r["end_char"]))
    for i, text in texts.items():
        spans = parts.get(i, [])
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        assert re.sub(r"\s", "", "".join(text[a:b] for a, b in spans)) == re.sub(r"\s", "", text)


def test_stems(spark):
    words = ["caresses", "ponies", "ties", "cats", "focus", "this", "agreed", "plastered", "motoring", "sing", "conflated", "hopping", "falling", "happy", "sky", "fees", "is"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(fulltext.stem(F.col("w")).alias("s")).collect()
    assert [r["s"] for r in got] == ["caress", "poni", "ti", "cat", "focus", "this", "agre", "plaster", "motor", "sing", "conflate", "hop", "fall", "happi", "sky", "fee", "is"]


def test_questions():
    assert fulltext.parsed('late fees or "due date" -tax') == [[(False, ["late"]), (False, ["fees"])], [(False, ["due", "date"]), (True, ["tax"])]]
    assert fulltext.parsed('-"a b" or or  !') == [[(True, ["a", "b"])]]
    assert fulltext.parsed(' "open quote') == [[(False, ["open", "quote"])]]
    assert fulltext.parsed("") == []


CHUNKS = [
    ("a", 0, "s1", "Late fees apply when the payment is late"),
    ("a", 1, "s1", "Payment of fees: the due date"),
    ("b", 0, "s2", "A fee for late delivery, date due"),
    ("b", 1, "s2", None),
    ("c", 0, "s1", "nothing of the kind"),
]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    df = spark.createDataFrame(CHUNKS, "doc_id string, chunk int, session string, text string")
    return retrieve.index_chunks(df, f"file://{tmp_path_factory.mktemp('index')}/i", scope=["session"], dimension=64)


@pytest.mark.parametrize(
    ("question", "wanted"),
    [
        ("fees", {("a", 0), ("a", 1), ("b", 0)}),
        ("late fee", {("a", 0), ("b", 0)}),
        ('"due date"', {("a", 1)}),
        ('"fees of the due"', set()),
        ('"payment of fees"', {("a", 1)}),
        ('"fees the due date"', {("a", 1)}),
        ("fee -late", {("a", 1)}),
        ("-fee", {("b", 1), ("c", 0)}),
        ("delivery or kind", {("b", 0), ("c", 0)}),
        ("fee -late or kind", {("a", 1), ("c", 0)}),
        ("the of", set()),
        ("unheard", set()),
    ],
)
def test_answers(spark, index, question, wanted):
    assert {(r["doc_id"], r["chunk"]) for r in fulltext.search(spark, index, question).collect()} == wanted


def test_scope_order_and_rerank(spark, index):
    hits = retrieve.hybrid(spark, index, "late fees", 5, within=F.col("session") == "s1", dimension=64).collect()
    assert (hits[0]["doc_id"], hits[0]["chunk"]) == ("a", 0) and {r["session"] for r in hits} == {"s1"}
    assert retrieve.hybrid(spark, index, "  ", dimension=64).count() == 0
    turned = retrieve.hybrid(spark, index, "late fees", 2, rerank=lambda q, h: h.orderBy("score"), dimension=64).collect()
    assert len(turned) == 2 and turned[0]["score"] <= turned[1]["score"]
    assert [retrieve.wanted(n) for n in (0, 5, 99)] == [1, 5, 10]


def test_a_term_reads_its_own_row_groups(spark, index):
    plan = index.read(spark, "postings").where(F.col("term").isin("fee"))._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[.*term", plan)


def test_citation(spark):
    rows = spark.createDataFrame([("C.pdf", 3, "4", "4.1"), ("C.pdf", 1, None, "")], "n string, p int, s string, c string")
    got = [r[0] for r in rows.select(retrieve.citation(F.col("n"), F.col("p"), F.col("s"), F.col("c"))).collect()]
    assert got == ["C.pdf, page 3, section 4, clause 4.1", "C.pdf, page 1"]


def test_vectors_equal_brute_force_and_are_checked(spark):
    df = spark.createDataFrame([(i, f"Word{i % 7} and word_{i} é", 0) for i in range(200)] + [(300, None, 0)], "i long, text string, n int").repartition(2)
    made = embeddings.feature_hash(32)
    for r in embeddings.embedded(df, dimension=32, batch=7).collect():
        assert r["embedding"] == made([r["text"] or ""])[0]
    calls = []
    embeddings.register("short", lambda d: lambda texts: [[1.0] * (d - 1) for _ in texts])
    embeddings.register("few", lambda d: lambda texts: calls.append(1) or [[1.0] * d])
    with pytest.raises(embeddings.DimensionMismatch):
        embeddings.embedded_query("x", " Short ", 4)
    with pytest.raises(Exception, match="vectors for"):
        embeddings.embedded(df, "few", 4).collect()
    with pytest.raises(KeyError):
        embeddings.provider("unheard of")


def test_an_index_shuffles_chunks_only(spark, tmp_path):
    """Postings are sorted where they are made: no exchange, no words found twice, and texts without words are chunks."""
    df = spark.createDataFrame([("a", 0, "Cats and things"), ("b", 0, "the"), ("c", 0, "")], "doc_id string, chunk int, text string")
    index = fulltext.build(df, f"file://{tmp_path}/i")
    rows = {(r["doc_id"], r["term"], r["pos"], r["n_terms"]) for r in index.read(spark, "postings").collect()}
    assert rows == {("a", "cat", 0, 2), ("a", "thing", 2, 2)}
    assert index.read(spark, "facts").first().asDict() == {"chunks": 3, "terms": 2}
    assert {r["doc_id"] for r in fulltext.search(spark, index, "-cat").collect()} == {"b", "c"}
    plan = index.read(spark, "postings").where(F.col("place") == F.xxhash64(F.lit("cat")))._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[.*place", plan)


def test_hits_without_a_score_have_no_rank(spark):
    """They are left out after the best were taken: a filter before makes every score twice."""
    scores = spark.createDataFrame([("a", 0, None), ("b", 0, 0.5)], "doc_id string, chunk int, score double")
    assert [tuple(r) for r in retrieve.ranked(scores, ["doc_id", "chunk"], 2).collect()] == [("b", 0, 1)]
