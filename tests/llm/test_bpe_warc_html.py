"""BPE against the library, WARC round trips, and main text of pages."""

import base64
import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodemap.llm import bpe, html_text, queries, warc
from lodemap.llm.shared import table
from tests.conftest import SMALL, TINY

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(VOCABULARY)
    t.no_truncation()
    t.no_padding()
    return t


def check_against(library, rows, texts):
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        back = library.decode(ids, skip_special_tokens=False)
        assert r["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()


def test_bpe_equals_the_library(spark, library):
    texts = {r["doc_id"]: r["text"] for r in table(spark, TINY, "documents").collect()}
    rows = queries.op3_bpe(spark, TINY).collect()
    assert len(rows) == len(texts)
    check_against(library, rows, texts)


def test_bpe_of_odd_texts(spark, library):
    odd = [
        None, "", " ", "\n\n  x", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "I'll we've 'S", "　日本語テキスト 🙂🙂🏽", "é ﬁ Ⅷ ²",
        "a" * 5000, "ab" * 3000, "\x00\x07", "x�y", "١٢٣ ४५", "​  z", "ǅ ᾳ 𝒜𝒷 \U00020000",
    ]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(odd)], "doc_id long, text string, ids int")
    check_against(library, bpe.encode_decode(docs, VOCABULARY).collect(), dict(enumerate(odd)))
    full = {r["doc_id"]: r for r in bpe.encode_decode(docs, VOCABULARY).collect()}
    assert full[10]["decoded"] == "a" * 5000 and len(full[10]["ids"]) == full[10]["n_tokens"]
    assert bpe.encode_decode(docs.limit(0), VOCABULARY).count() == 0


def test_long_words_take_the_same_merges():
    pairs = bpe.vocabulary(VOCABULARY)
    for word in (b"a" * 190, b"the" * 60, b"ratatatatat" * 17):
        assert pairs._long(word) == pairs.word(word)


def brute_records(pages, least=0):
    first = {}
    for page_id, html in pages:
        data = (html or "").encode()
        if len(data) >= least:
            first[data] = min(first.get(data, page_id), page_id)
    out = []
    for page_id, html in pages:
        data = (html or "").encode()
        refers = first.get(data)
        refers = None if refers is None or refers == page_id else refers
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page_id, len(data), digest, "response" if refers is None else "revisit", refers))
    return sorted(out)


def test_warc_round_trip(spark):
    pages = [(r["page_id"], r["html"]) for r in table(spark, SMALL, "pages").collect()]
    assert sorted(tuple(r) for r in queries.op8_warc(spark, SMALL).collect()) == brute_records(pages)


def test_warc_payloads_dictionary_and_odd_rows(spark):
    rows = [(1, "http://a/\r\nX", None), (2, None, ""), (3, "http://b", "x" * 300_000)] + [(10 + i, f"http://c/{i}", f"<p>page {i % 5} with the same words around</p>" * 20) for i in range(60)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, file string")
    manifest = warc.write_archives(pages, min_revisit_bytes=100)
    got = {r["page_id"]: r for r in warc.read_archives(manifest, with_payload=True).collect()}
    assert sorted((k, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for k, r in got.items()) == brute_records([(a, c) for a, _, c in rows], 100)
    assert bytes(got[3]["payload"]).decode() == "x" * 300_000
    assert got[1]["url"] == "http://a/%0D%0AX" and got[2]["url"] is None
    fs, path = warc.file_system(manifest.first()["file"])
    with fs.open_input_stream(path) as stream:
        head = stream.read(4)
    assert int.from_bytes(head, "little") == warc.DICTIONARY_MAGIC
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def text_of(spark, *pages):
    df = spark.createDataFrame([(i, f"http://h/{i}", p, "n") for i, p in enumerate(pages)], "page_id long, url string, html string, host string")
    return {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}


def test_html_roles_entities_and_blocks(spark):
    page = (
        "<html><head><title>T</title><script>if (a<b) x()</script></head><body><nav>Menu</nav><header>Top</header>"
        "<article><h1>A &amp;\n B</h1><p>One<br>two &lt;3</p><ul><li>x<li>y</ul><form>send</form></article>"
        "<div class='comments'><p>first!</p></div><footer>(c)</footer></body></html>"
    )
    got = text_of(spark, page, None, "", "plain &eacute; text", "<p>unclosed <b>bold")
    assert got == {0: "A & B\nOne two <3\nx\ny", 1: "", 2: "", 3: "plain é text", 4: "unclosed bold"}


def test_style_tree_drops_what_repeats_on_a_host(spark):
    pages = [f"<body><div class='top'><p>Same words on top</p></div><div class='text'><p>Own words {i} of this page</p></div></body>" for i in range(8)]
    got = text_of(spark, *pages)
    assert got == {i: f"Own words {i} of this page" for i in range(8)}


def test_style_tree_judges_lines_inside_articles(spark):
    pages = [f"<body><article><h1>Title {i}</h1><div class='x'><p>Read our paper</p></div><p>Own words {i} of this page</p><p>Buy <b>now</b></p></article></body>" for i in range(40)]
    pages[7] = pages[7].replace("Read our paper", "Only this page says so")
    pages[8] = "<body><article><p>Read our paper</p></article></body>"
    got = text_of(spark, *pages)
    assert got.pop(7) == "Title 7\nOnly this page says so\nOwn words 7 of this page" and got.pop(8) == "Read our paper"
    assert got == {i: f"Title {i}\nOwn words {i} of this page" for i in got}


def test_html_counts_only_articles_of_the_page_itself(spark):
    body = "<div class='text'><p>The text</p></div>"
    pages = [
        f"<body>{body}<aside><article>Teaser</article></aside></body>",
        f"<body>{body}<ol><li><article class='comment-body'>first!</article></ol></body>",
        f"<body><script>s = '<article>';</script>{body}</body>",
        "<body><div>Site</div><div class='with sidebar'><article><p>The text</p><div class='share'>Share</div></article></div></body>",
        "<body><div class='has-comments'><article><p>The text</p></article></div></body>",
        f"<body><article> </article>{body}</body>",
        f"<body><main>{body}<div class='related'><article>Teaser</article></div></main></body>",
    ]
    for i, page in enumerate(pages):
        assert html_text.blocks(page, frozenset()) == ["The text"] or i == 4
    assert text_of(spark, *pages[:5])[4] == "The text"


def test_style_tree_has_no_depth_at_which_branches_merge(spark):
    def under(levels, text):
        return "<div>" * levels + text + "</div>" * levels

    def page(i):
        top = under(150, "<p>Same words below</p>")
        own = under(150, f"<p>Own words {i} below</p>")
        near = under(70, f"<div class='a'><p>Same words beside</p></div><div class='b'><p>Own words {i} beside</p></div>")
        return f"<body><div class='top'>{top}</div><div class='own'>{own}</div>{near}</body>"

    got = text_of(spark, *[page(i) for i in range(8)])
    assert got == {i: f"Own words {i} below\nOwn words {i} beside" for i in range(8)}
    node = html_text.ROOT
    for _ in range(20_000):
        node = html_text.opened("div", "", node)
    assert len(node.path) < 64 * 4 + 22 and len(node.hangs) == 312


def test_html_query_gives_every_page(spark):
    pages = {r["page_id"]: r for r in table(spark, SMALL, "pages").collect()}
    rows = queries.op9_html_text(spark, SMALL).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]
        assert "<script" not in r["text"] and "  " not in r["text"]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_warc_of_null_and_text_ids(spark, kind):
    name = (lambda i: i) if kind == "long" else (lambda i: None if i is None else f"p>{i}\n/ä" if i else "")
    rows = [(name(3), "u", "same"), (name(0), None, "same"), (None, "u", "same"), (name(5), "u", "other"), (None, "u", "lone"), (None, "v", "lone"), (name(9), "w", None)]
    pages = spark.createDataFrame(rows, f"page_id {kind}, url string, html string")
    back = warc.read_archives(warc.write_archives(pages), id_type=kind).collect()
    got = sorted((repr(r["page_id"]), r["record_type"], r["refers_to"]) for r in back)
    first = name(0)
    assert got == sorted([(repr(name(3)), "revisit", first), (repr(first), "response", None), ("None", "revisit", first), (repr(name(5)), "response", None), ("None", "response", None),
                          ("None", "response", None), (repr(name(9)), "response", None)])


def test_compound_class_names_do_not_mark_parts_of_an_article(spark):
    page = (
        "<html><body><div class='site-nav'>menu</div><article><h1>Head</h1><p>First.</p><div class='ad-hoc'>One</div><section id='reply-to-critics'>Two</section>"
        "<p class='share-price'>Three</p><div class='social-history'>Four</div><div class='box share'>Share</div><div class='comments'>Said</div></article></body></html>"
    )
    rows = [(1, None, page), (2, "http://h/x", page), (2, "http://h/x", page), (3, "http://h/y", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract(df).collect())
    text = "Head\nFirst.\nOne\nTwo\nThree\nFour"
    assert got == [(1, text, len(text)), (2, text, len(text)), (2, text, len(text)), (3, "", 0)]
    assert html_text.extract(df.limit(0)).count() == 0


def test_records_are_read_without_their_payloads(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "x" * 50_000 + str(i % 7)) for i in range(300)], "page_id long, url string, html string")
    manifest = warc.write_archives(pages)
    whole = warc.read_archives(manifest, with_payload=True)
    bare = warc.read_archives(manifest)
    assert "payload" not in bare.columns and sorted(map(tuple, bare.collect())) == sorted(tuple(r)[:-1] for r in whole.collect())
    assert {bytes(r["payload"]).decode() for r in whole.where("record_type = 'response'").collect()} == {"x" * 50_000 + str(k) for k in range(7)}
