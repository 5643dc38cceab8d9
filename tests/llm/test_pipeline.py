"""The pipeline on the smallest tables, stage by stage against plain versions of its operators' results."""

import hashlib
import os
import random
import string
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_operators import brute_groups

FOLDER = "/root/testdata/sf0.001"
#: A row that no model learns from, with letters at random.
HELD = next(i for i in range(-4, -100, -1) if zlib.crc32(str(i).encode()) % 5 == 0)
JUNK = "".join(random.Random(1).choices(string.ascii_lowercase, k=600))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = [(-1, None, "en", "s", 0), (-2, "12 34", "en", "s", 5), (-3, "", None, None, 0), (HELD, JUNK, "en", "s", 600)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    items = [x.text for x in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {x.doc_id: x.text for x in docs.collect()}
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        kept = {x.doc_id for x in after.collect()}
        assert kept <= set(before)
        if name != "bpe":
            assert after.columns == docs.columns
        if name == "toxicity":
            labels = spark.read.parquet(f"{FOLDER}/labels.parquet").join(docs, "doc_id")
            gone = {x.doc_id: x.toxic for x in labels.where(~F.col("doc_id").isin(list(kept))).collect()}
            assert sum(gone.values()) >= 0.8 * len(gone) and {-1, -2, -3} <= kept
            toxic = {x.doc_id for x in labels.where("toxic = 1").collect()}
            assert len(toxic - kept) >= 0.7 * len(toxic) and toxic
        if name == "language_id":
            assert {-1, -2, -3, HELD} & kept == set()  # without a letter, or letters at random
            assert all(i == HELD or not any(c.isalpha() for c in before[i] or "") for i in set(before) - kept)
        if name == "near_dedup":
            ids = sorted(before)
            _, root = brute_groups([before[i] for i in ids])
            assert kept == {ids[r] for r in root}
        if name == "decontamination":
            holds = lambda t: any(" ".join(x.split()) in " ".join(t.split()) for x in items)
            assert not any(holds(before[i]) for i in kept) and len(kept) > 0.8 * len(before)
        if name == "bpe":
            lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            for x in after.collect():
                ids = lib.encode(before[x.doc_id], add_special_tokens=False).ids
                assert (x.n_tokens, x.ids_sha256, x.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))
            assert kept == set(before)
        docs = after


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
def test_stages_of_odd_rows(spark, tmp_path):
    """Empty tables, repeated rows, clashing columns and a very long text go through every stage."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    some = docs.where("doc_id < 60")
    long = some.where("length(text) > 200").orderBy("doc_id").limit(1).select(F.lit(1000).cast("long").alias("doc_id"), F.repeat("text", 300).alias("text"), "lang", "source", "n_chars")
    twice = some.unionByName(some.where("doc_id < 10")).unionByName(long)
    odd = twice.withColumns({c: F.lit(1) for c in ("score", "toxic_score", "lang_fits", "kept", "component_id", "n_tokens", "h", "k", "item_id")})
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, odd, FOLDER)
        got = [x.doc_id for x in found.collect()]
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
        if name == "bpe":
            assert sorted(got) == sorted(x.doc_id for x in odd.collect())
            continue
        assert found.columns == odd.columns and 1000 in got or name == "near_dedup"
        assert all(got.count(i) in (0, 2) for i in range(10))
