"""The pipeline against brute force, stage by stage."""

import hashlib
import os

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

import public_tokenizers
from test_quality_rules import slow as slow_counts
from test_simhash import near_slow
from tokenizers import Tokenizer

import corpus_pipeline
from meterbook.llm import latent_decontamination, quality_rules
from meterbook.llm.common import table

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(FOLDER), reason="test tables are not there")
def test_stages_match_brute_force(spark):
    docs = table(spark, FOLDER, "documents")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "dedup", "decontaminate", "pseudonymise", "encode"]
    seen, kept = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        kept = spark.createDataFrame(stage(spark, kept, FOLDER).collect(), stage(spark, kept, FOLDER).schema)
        seen[name] = {r.doc_id: r for r in kept.collect()}
        assert len(seen[name]) == kept.count()
        if name != "encode":
            assert kept.columns == columns
    # rules: base rules by hand, the cutoffs as the operator (which SQL checks) has them
    judged = {r.doc_id: r for r in quality_rules.quality(docs).collect()}
    for i, r in rows.items():
        n, *_, repeated = slow_counts(r.text)
        base = n < 50 or 100 * repeated > 50 * n
        assert judged[i].base_failed == base and (i in seen["quality"]) == judged[i].kept and not (base and judged[i].kept)
    # one of each group
    assert set(seen["dedup"]) == {min(g) for g in near_slow([(i, r.text) for i, r in seen["quality"].items()])}
    # every hit of an exhaustive search is gone, nothing else
    bench = [(r.item_id, r.text) for r in table(spark, FOLDER, "benchmark").collect()]
    items = latent_decontamination.Items.of(bench)
    checker, hit = latent_decontamination.Checker(items), set()
    for i, r in seen["dedup"].items():
        codes = latent_decontamination.code_texts([r.text.encode()], items.vocabulary)[0]
        if any(checker.check(k, codes, 0, len(codes)) for k in range(len(items.ids))):
            hit.add(i)
    assert hit and set(seen["decontaminate"]) == set(seen["dedup"]) - hit
    assert set(seen["pseudonymise"]) == set(seen["decontaminate"])
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, r in seen["encode"].items():
        ids = library.encode(seen["pseudonymise"][i].text, add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        assert bytes(r.ids) == raw and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(raw).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    whole = corpus_pipeline.run(spark, FOLDER)
    assert sorted((r.doc_id, r.ids_sha256) for r in whole.collect()) == sorted((i, r.ids_sha256) for i, r in seen["encode"].items())


def test_empty_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
