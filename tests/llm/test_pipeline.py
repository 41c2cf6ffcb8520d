"""The pipeline against its operators one by one, and brute force where there is one."""

import hashlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lodemap.llm import quality, toxicity
from lodemap.llm.shared import stored, table
from tests.conftest import TINY
from tests.llm.test_models import brute_components
from tests.llm.test_native_operators import brute_hits


def test_every_stage_takes_effect(spark):
    docs = table(spark, TINY, "documents")
    labels = table(spark, TINY, "labels")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == docs.count()
    good = {r["doc_id"] for r in quality.classify(docs, labels).where("keep").collect()}
    clean = toxicity.classify(docs.where(docs.doc_id.isin(*good)), labels)
    kept = sorted(r["doc_id"] for r in clean.where("predicted = 0").collect())
    first = sorted(doc_id for doc_id, _, component in brute_components([(i, rows[i]) for i in kept], 5, 80) if doc_id == component)
    items = [(r["item_id"], r["text"]) for r in table(spark, TINY, "benchmark").collect()]
    # Brute force is for texts that share a word sequence at all; the rest can't be hit.
    last = [r[0] for r in brute_hits([(i, rows[i]) for i in first], items) if not r[5]]
    result = stored(corpus_pipeline.run(spark, TINY), "pipeline-result")
    got = {r["doc_id"]: r for r in result.collect()}
    assert sorted(got) == sorted(last) and 0 < len(last) < len(first) < len(kept) < len(rows)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for doc_id, r in got.items():
        ids = library.encode(rows[doc_id] or "", add_special_tokens=False).ids
        assert list(r["ids"]) == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_stages_pass_on_all_columns(spark):
    docs = table(spark, TINY, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, TINY), "stage")
        assert docs.columns == table(spark, TINY, "documents").columns
    assert [stage(spark, docs.limit(0), TINY).count() for _, stage in corpus_pipeline.STAGES] == [0] * 5


def test_batches_of_texts_are_small(spark):
    docs = table(spark, TINY, "documents")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], ["bytes"])

    for _, stage in corpus_pipeline.STAGES:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        stage(spark, docs.limit(0), TINY)
        many = docs.withColumn("text", F.repeat("text", F.lit(50))).coalesce(1)
        longest = many.agg(F.max(F.octet_length("text"))).first()[0]
        assert max(r["bytes"] for r in many.mapInArrow(sizes, "bytes long").collect()) < 2 * corpus_pipeline.BATCH_BYTES + longest
