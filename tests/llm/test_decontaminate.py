import math
import random

from cascata.llm import decontaminate as dc

from .helpers import docs_frame, odd_rows, words


def brute(docs, items):
    out = set()
    for i, t in docs:
        w = dc.words_of((t or "").encode())
        for j, b in items:
            x = dc.words_of((b or "").encode())
            if not x:
                continue
            width = min(5, len(x))
            own = dc.shingles_of(x, width)
            shared = len(own & dc.shingles_of(w, width))
            if shared >= max(1, math.ceil(0.8 * len(own) - 1e-9)):
                out.add((i, j, shared, len(own), shared / len(own)))
    return out


def cases():
    rng = random.Random(9)
    items = [(k, words(rng, rng.randrange(1, 60))) for k in range(40)] + [(90, None), (91, ""), (92, "!!! ..."), (None, words(rng, 20)), (93, items_text := words(rng, 25)), (93, items_text)]
    docs = odd_rows()
    for k, (_, t) in enumerate(items):
        own = (t or "x").split()
        if len(own) > 12:
            own[6] = "CHANGED"
        docs.append((200 + k, f"{words(rng, rng.randrange(400))} {(t or '').upper()}, {words(rng, 20)}"))
        docs.append((300 + k, f"{words(rng, 20)} {' '.join(own)} {words(rng, 3000 if k % 9 == 0 else 30)}"))
    return docs, items


def test_search_against_brute_force(spark):
    docs, items = cases()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = brute(docs, items)
    assert len(expected) > 40
    for block in (dc.BLOCK_BYTES, 2000):
        got = dc.contaminated(docs_frame(spark, docs), benchmark, block).collect()
        assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_keep_clean(spark):
    docs, items = cases()
    frame, benchmark = docs_frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    bad = {i for i, *_ in brute(docs, items)}
    for block in (dc.BLOCK_BYTES, 2000):
        kept = dc.keep_clean(frame, benchmark, block)
        assert kept.columns == frame.columns
        assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((i for i, _ in docs if i not in bad), key=str)
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.keep_clean(frame, none).count() == len(docs)
    assert dc.contaminated(docs_frame(spark, []), benchmark).count() == dc.contaminated(frame, none).count() == 0
