"""Decontamination, sharding and fingerprints against brute force and SQL, and their odd rows."""

import hashlib
import re
import struct
from collections import Counter

import pytest
import xxhash

from lodemap.llm import decontaminate, fingerprints, queries, sharding
from lodemap.llm.shared import table
from tests.compare import assert_same
from tests.conftest import TINY

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [(1, None), (2, ""), (3, "  \n"), (4, "one two"), (4, "one two"), (None, "three"), (5, "x" * 70_000), (6, "word " * 30_000)]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute_hits(docs, items, window=10):
    asked = {}
    for item_id, text in items:
        w = WORD.findall(lower(text or ""))
        size = min(window, len(w))
        for o in range(len(w) - size + 1 if size else 0):
            asked.setdefault(size, {}).setdefault(tuple(w[o : o + size]), set()).add(str(item_id))
    out = []
    for doc_id, text in docs:
        words, hit, found = WORD.findall(lower(text or "")), set(), set()
        for size, windows in asked.items():
            for s in range(len(words) - size + 1):
                if there := windows.get(tuple(words[s : s + size])):
                    hit.update(range(s, s + size))
                    found |= there
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


def test_decontaminate_matches_sql(spark):
    assert assert_same(queries.op1_decontaminate(spark, TINY), queries.DECONTAMINATE_SQL, TINY)


def test_decontaminate_matches_brute_force_on_odd_rows(spark):
    passage = "The quick Brown fox jumps over the lazy dog while Ärger ruft laut"
    items = [(1, passage), (2, "short item here"), (3, None), (4, ""), (5, "word word word word word word word word word word word"), (2, "short item here")]
    docs = [
        (1, f"before {passage.upper().replace('Ä', 'Ä').replace('RGER', 'rger')} after"),
        (2, f"x, {passage}; {passage}!"),
        (3, "a short ITEM here."),
        (4, None),
        (5, ""),
        (6, "...!"),
        (7, "word " * 40),
        (7, "word " * 40),
        (None, passage),
        (8, " ".join(passage.split()[:9])),
    ]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in decontaminate.decontaminate(d, b).collect()), key=repr)
    assert got == brute_hits(docs, items)


@pytest.mark.parametrize("empty", ["docs", "items", "both"])
def test_decontaminate_empty_tables(spark, empty):
    d = spark.createDataFrame([] if empty != "items" else [(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([] if empty != "docs" else [(1, "a b")], "item_id long, text string")
    assert decontaminate.decontaminate(d, b).count() == d.count()


def test_proximity_finds_terms_within_the_width(spark):
    d = spark.createDataFrame([(1, "red x x green y blue"), (2, "red x x x x x x green blue"), (3, "green blue")], "doc_id long, text string")
    terms = decontaminate.item_terms(spark.createDataFrame([(9, "blue red green")], "item_id long, text string"), "item_id", "text")
    index = decontaminate.build_index(d, terms)
    rows = decontaminate.proximity(index, terms, 6).join(index.docs(), "row").collect()
    assert {(r["id"], r["start"]) for r in rows} == {(1, 0)}


def test_sharding_matches_sql(spark):
    assert assert_same(queries.op2_sharding(spark, TINY), queries.SHARDING_SQL, TINY)


def test_sharding_splits_only_what_is_too_large(spark):
    rows = [(i, "a" * (i % 7 + 1)) for i in range(300)] + [(7, "hot " * 10)] * 200 + [(None, None), (None, "b"), (1000, "c" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(docs, 400).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    for shard, members in by.items():
        size = sum(m["n_bytes"] for m in members)
        assert {(m["shard_rows"], m["shard_bytes"]) for m in members} == {(len(members), size)}
        assert size <= 400 or len(members) == 1
        assert len(shard) == members[0]["depth"]
        # The parent was over the limit, else it would not have been split.
        inside = [r for r in got if r["shard"].startswith(shard[:-1])]
        assert not shard or sum(r["n_bytes"] for r in inside) > 400
    assert not any(a != b and b.startswith(a) for a in by for b in by)


def test_sharding_of_nothing_and_of_one_bucket(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string"), 10).count() == 0
    one = sharding.shard(spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string"), 10).collect()
    assert {(r["shard"], r["shard_bytes"], r["shard_rows"]) for r in one} == {("", 2, 2)}


def test_shards_are_written_whole(spark, tmp_path):
    rows = [(None, "null key", 0), (7, "twice", 1), (7, "twice", 2), (7, None, 3), *((i, "x" * i, i) for i in range(10, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `shard.x` int")
    directory = sharding.write_shards(docs, f"file://{tmp_path}/out", 200)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted(map(repr, back.drop("_shard").collect())) == sorted(map(repr, docs.collect()))
    found = {r["_shard"]: r["count"] for r in back.groupBy("_shard").count().collect()}
    assert found == {"s" + r["shard"]: r["shard_rows"] for r in directory.collect()} and len(found) > 5


def brute_edits(docs):
    ordered = sorted(docs, key=lambda d: -d[0])
    out = {}
    for n, (doc_id, text) in enumerate(ordered):
        text, after = text or "", ordered[(n + 1) % len(ordered)][1] or ""
        cut = len(text) // 3
        out[doc_id] = (len(text), hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest())
    return out


def test_fingerprints_edit_every_text(spark):
    docs = table(spark, TINY, "documents")
    rows = queries.op6_fingerprints(spark, TINY).collect()
    source = {r["doc_id"]: r["text"] for r in docs.collect()}
    wanted = brute_edits(list(source.items()))
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in rows} == wanted
    by_text = {}
    for r in rows:
        by_text.setdefault(source[r["doc_id"]] or "", set()).add(r["fingerprint"])
    assert all(len(prints) == 1 for prints in by_text.values())
    near = sorted(r["near_edited"] for r in rows)
    other = sorted(r["near_next"] for r in rows)
    assert near[len(near) // 2] > 0.4 > 0.2 > other[len(other) // 2]
    assert all(0 <= x <= 1 for x in near + other)


def test_fingerprints_of_odd_rows(spark):
    docs = spark.createDataFrame([(*r, "t") for r in ODD], "doc_id long, text string, term string")
    rows = fingerprints.edit_likeness(docs).collect()
    assert len(rows) == len(ODD)
    assert len({r["fingerprint"] for r in rows if r["doc_id"] == 4}) == 1
    assert all(r["fingerprint"] and r["edited_fingerprint"] for r in rows)
    assert fingerprints.edit_likeness(docs.limit(0)).count() == 0
    lone = fingerprints.edit_likeness(docs.where("doc_id = 6")).collect()
    assert len(lone) == 1 and lone[0]["near_next"] == 1.0


def test_fingerprints_of_a_hot_group_of_long_near_copies(spark):
    hot = [f"hot{i}" for i in range(150)]
    rows = []
    for i in range(300):
        words = [f"w{i * 37 % 300 + k}" for k in range(120)]
        if i % 3 == 0 or i < 60:  # a run, so that next documents are of the group too
            words = list(hot)
            for k in range(3):
                words[(i * 7 + k * 31) % 150] = f"edit{(i + k) % 40}"
        rows.append((i, " ".join(words)))
    rows += [(400 + i, "".join(f"これは{i // 2}の{k}行です\n" for k in range(90)) + f"終わり{i}") for i in range(4)]
    got = {r["doc_id"]: r for r in fingerprints.edit_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = sorted(got[i]["near_next"] for i in range(1, 60))
    assert near[len(near) // 2] > 0.5 and near[0] > 0.1
    assert min(got[i]["near_edited"] for i in range(300)) > 0
    assert got[403]["near_next"] > 0.7 > 0.1 > got[402]["near_next"] and got[401]["near_next"] > 0.7
    other = sorted(got[i]["near_next"] for i in range(61, 300, 3))  # after these comes one of the group
    assert other[len(other) // 2] < 0.2


def hashed(*values):
    """Spark's 64-bit hash of values in a row, each the seed of the next; ints are (value,)."""
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<i", *v) if isinstance(v, tuple) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def brute_prints(texts):
    def slot(x):
        return f"{x & (1 << 64) - 1:x}"[:12].rjust(12, "0")

    terms = [set(re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())) - {""} for t in texts]
    df = Counter(x for own in terms for x in own)
    band = {x for x, n in df.items() if max(2, 0.001 * len(texts)) <= n <= max(2, 0.1 * len(texts))}
    out = []
    for text, own in zip(texts, terms):
        if not own:
            out.append(slot(hashed(text)) * 17)
            continue
        main, xor = own & band or own, 0
        for x in main:
            xor ^= hashed(x)
        parts = [slot(hashed(len(main), xor))]
        for r in range(16):
            ranks = [(hashed(hashed(x), (r,)) & (1 << 62) - 1) >> (2 if x in band else 0) for x in own]
            parts.append(slot(hashed(min(ranks))))
        out.append("".join(parts))
    return out


def test_fingerprints_equal_brute_force(spark):
    docs = table(spark, TINY, "documents").select("doc_id", "text").collect()
    texts = [d["text"] or "" for d in docs]
    wanted = {d["doc_id"]: p for d, p in zip(docs, brute_prints(texts))}
    order = sorted(wanted, reverse=True)
    after = dict(zip(order, order[1:] + order[:1]))
    for r in queries.op6_fingerprints(spark, TINY).collect():
        own, other = wanted[r["doc_id"]], wanted[after[r["doc_id"]]]
        assert r["fingerprint"] == own
        for print_, like in ((other, r["near_next"]), (r["edited_fingerprint"], r["near_edited"])):
            same = sum(own[12 * k : 12 * k + 12] == print_[12 * k : 12 * k + 12] for k in range(1, 17)) / 16
            assert like == (1.0 if own == print_ else same)


def test_fingerprints_take_ids_of_any_kind(spark, monkeypatch):
    """Many blocks or one, ids that are numbers or texts of the same order: the same rows; and no id at all."""
    docs = spark.range(200).selectExpr("id as doc_id", "concat('word', id % 7, ' other', id, ' and more of it ', id % 3) as text")
    named = docs.selectExpr("lpad(cast(doc_id as string), 5, '0') as doc_id", "text")
    one = sorted(tuple(r)[1:] for r in fingerprints.edit_likeness(docs).collect())
    monkeypatch.setattr(fingerprints, "BLOCK_ROWS", 30)
    for df in (docs, named, named.selectExpr("date_add(date'2024-01-01', cast(doc_id as int)) as doc_id", "text")):
        assert sorted(tuple(r)[1:] for r in fingerprints.edit_likeness(df).collect()) == one
    for kind in ("long", "string"):
        assert fingerprints.edit_likeness(docs.selectExpr(f"cast(null as {kind}) as doc_id", "text")).count() == 200
