import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

from cascata.llm import bpe  # noqa: E402
from cascata.llm.common import whole_groups  # noqa: E402
from cascata.llm.queries import op5_bpe, tokenizer_path  # noqa: E402

from .helpers import docs_frame, odd_rows  # noqa: E402

OWN = bpe.Bpe(bpe.definition_of(tokenizer_path()))
THEIRS = tokenizers.Tokenizer.from_file(tokenizer_path())


def ids(text):
    return np.frombuffer(OWN.encode(text), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"abcthe inou's'é1日<|>\n\t \x1c🎉", "<|endoftext|>", "  "]), max_size=60).map("".join))
def test_ids_equal_the_library(text):
    theirs = THEIRS.encode(text, add_special_tokens=False).ids
    assert ids(text) == theirs
    assert OWN.decode(OWN.encode(text)).decode() == THEIRS.decode(theirs, skip_special_tokens=False)


def test_long_runs_and_every_token():
    for text in ("a" * 30000, "ab" * 9000, " " * 5000, "\n" * 3000 + "x", "é" * 4000, "'s" * 2000):
        assert ids(text) == THEIRS.encode(text, add_special_tokens=False).ids
    assert all(OWN.encode_bytes(word) == [i] for word, i in list(OWN.id_of.items())[::37])


def test_query_and_odd_rows(spark, sf_dir):
    for frame, found in ((None, op5_bpe(spark, sf_dir)), (odd_rows(), bpe.encode_digests(docs_frame(spark, odd_rows()), tokenizer_path()))):
        texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] if frame is None else frame
        expected = []
        for i, t in texts:
            own = THEIRS.encode(t or "", add_special_tokens=False).ids
            back = THEIRS.decode(own, skip_special_tokens=False)
            expected.append((i, len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
        assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)
    assert bpe.encode_documents(docs_frame(spark, []), tokenizer_path()).count() == 0


def test_a_worker_gives_up_the_vocabulary_for_other_kernels(spark):
    """Workers are used again; a kernel of whole groups in the same worker finds the room free."""

    def run(batches):
        bpe._loaded(definition)
        had = bpe._loaded.cache_info().currsize
        list(whole_groups(batches, ("id",)))
        yield pa.record_batch([pa.array([had]), pa.array([bpe._loaded.cache_info().currsize])], names=["had", "left"])

    definition = bpe.definition_of(tokenizer_path())
    assert [tuple(r) for r in spark.range(3).coalesce(1).mapInArrow(run, "had long, left long").collect()] == [(1, 0)]
