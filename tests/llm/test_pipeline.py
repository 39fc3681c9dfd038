"""The pipeline against a brute-force version of each stage on its own input."""

import numpy as np
import pandas as pd
import tokenizers

import corpus_pipeline
from cascata.llm import decontaminate as dc
from cascata.llm.queries import tokenizer_path

from .helpers import docs_frame, odd_rows
from .test_decontaminate import brute as brute_items
from .test_similar import brute as brute_classes
from .test_substrings import brute_words


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    labels = pd.read_parquet(f"{sf_dir}/labels.parquet").set_index("doc_id")["quality"]
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, sf_dir)
        if k < 4:
            assert out.columns == columns
            docs = spark.createDataFrame(out.toPandas(), schema=docs.schema)
            after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if k == 0:
            own = {i: y for i, y in labels.items() if i in before}
            assert np.mean([(i in after) == (y == 1) for i, y in own.items()]) > 0.95
        elif k == 1:
            heads = {}
            for i, x in zip(before, brute_classes(list(before.items()))):
                heads[x] = min(heads.get(x, i), i)
            assert set(after) == set(heads.values())
        elif k == 2:
            left = {i: n - gone for i, n, gone, _ in brute_words(list(before.items()))}
            assert {i: len(t.encode().split()) for i, t in after.items()} == left
        elif k == 3:
            bad = {i for i, *_ in brute_items(list(before.items()), items)}
            assert bad and after == {i: t for i, t in before.items() if i not in bad}
        else:
            library = tokenizers.Tokenizer.from_file(tokenizer_path())
            rows = out.collect()
            assert {r["doc_id"] for r in rows} == set(before)
            for r in rows:
                assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode(before[r["doc_id"]], add_special_tokens=False).ids
                assert r["decoded"] == before[r["doc_id"]] and r["n_tokens"] * 4 == len(r["ids"])
    assert dc.THRESHOLD == 0.8
    final = {(r["doc_id"], bytes(r["ids"])) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert final == {(r["doc_id"], bytes(r["ids"])) for r in rows}


def test_run_on_odd_rows_and_empty_tables(spark, tmp_path):
    """Without labels and items nothing but copies and repeated passages goes."""
    odd = [r for r in odd_rows() if r[0] is not None]
    for name, rows in (("odd", odd), ("none", [])):
        folder = f"{tmp_path}/{name}"
        docs_frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        heads = {}
        for (i, _), x in zip(rows, brute_classes(rows)):
            heads[x] = min(heads.get(x, i), i)
        assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()) == sorted(heads.values())
