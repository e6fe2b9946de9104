import hashlib

import pytest

pytest.importorskip("public_tokenizers")


def test_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    seen = [len(before)]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "encode":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), docs.schema)
            seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] < seen[0]
    rows = out.collect()
    assert len(rows) == seen[-1] and all(r.n_tokens == len(r.ids) for r in rows)
    assert all(len(r.decoded_sha256) == len(hashlib.sha256(b"").hexdigest()) for r in rows)


def test_run(spark, sf_dir):
    """The registered query gives what its last stage gives, and leaves only that stage's table."""
    import os
    import re

    import corpus_pipeline
    from inkmeter.session import shared_dir

    out = corpus_pipeline.run(spark, sf_dir)
    rows = out.collect()
    assert rows and set(out.columns) >= {"doc_id", "n_tokens", "ids"} and all(r.n_tokens == len(r.ids) for r in rows)
    left = [x for x in os.listdir(re.sub("^file:/*", "/", shared_dir(spark))) if x.startswith("pipeline-")]
    assert [x.split("-")[1] for x in left] == ["4"]
