import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cascata.llm import chat
from cascata.llm.queries import CONTROL

TEXTS = st.lists(st.sampled_from(["<", "|", "\\", ">", "<|im_end|>", "<|im_start|>", "<|nl|>", "a", "\n", "é", "🎉", "<|image|>"]), max_size=25).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(TEXTS, TEXTS), max_size=5))
def test_round_trip(turns):
    formatted = "".join(chat.render(role, [{"type": "text", "text": text}])[0] for role, text in turns)
    assert chat.read(formatted) == turns


def test_typed_parts(spark):
    parts = [
        {"type": "text", "text": "see <", "ref": None, "units": None},
        {"type": "text", "text": "|x", "ref": None, "units": None},
        {"type": "image", "text": None, "ref": "a.png", "units": 2},
        {"type": "audio", "text": None, "ref": "b.wav", "units": 10},
        {"type": None, "text": None, "ref": None, "units": None},
        {"type": "document", "text": None, "ref": "c.pdf", "units": None},
    ]
    table = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, content {chat.PART_TYPE}")
    one, two = chat.format_turns(table, parts="content").orderBy("position").collect()
    assert one["segment"] == "<|im_start|>user\nsee <\\|x<|image|><|audio|><|document|><|im_end|>\n"
    assert [(a["type"], a["ref"], a["tokens"]) for a in one["attachments"]] == [("image", "a.png", 512), ("audio", "b.wav", 250), ("document", "c.pdf", 512)]
    assert all(one["segment"][a["offset"] :].startswith(chat.PLACEHOLDER[a["type"]]) for a in one["attachments"])
    assert two["segment"] == "<|im_start|>assistant\n<|im_end|>\n" and two["in_loss"] and not one["in_loss"]


def test_unknown_and_null_parts():
    segment, _, _, found = chat.render("user", [{"type": "text", "text": "a"}, None, {"type": "video", "ref": "v", "units": 3}, {"type": "text", "text": "b"}])
    assert segment == "<|im_start|>user\na<|other|>b<|im_end|>\n" and [(a["type"], a["ref"], a["tokens"]) for a in found] == [("video", "v", 0)]


def test_turns_out_of_order_raise(spark):
    table = spark.createDataFrame([(1, k, "user", "x") for k in range(3)], "conv_id long, turn long, role string, text string")
    shuffled = chat.format_turns(table).coalesce(1).orderBy("position", ascending=False)
    with pytest.raises(Exception, match="out of order"):
        chat.read_back(shuffled).collect()


def test_odd_rows(spark):
    rows = [(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL), (1, 1, "assistant", "b"), (1, 0, None, None), (1, None, "system", ""), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (None, 0, "assistant", "<\\|"), (3, 0, "a\nb", "long " * 50000)]
    full = [(*r, 1, "clash") for r in rows]
    table = spark.createDataFrame(full, "conv_id long, turn long, role string, text string, position long, parts string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(table)).collect()}
    by = {}
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        digest = hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        loss = "".join(b for a, b in turns if a == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_turns(table.limit(0))).count() == 0
