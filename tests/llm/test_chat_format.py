import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textroute.llm import chat_format as cf

ROWS = "conv_id long, turn int, role string, text string, formatted string, begin string"
odd = st.lists(st.sampled_from(["<", "|", "\\", "<|im_end|>", "<|im_start|>", "assistant", "\n", "x", "é", "😀", "n", "<\\|"]), max_size=12).map("".join)


@given(st.lists(st.tuples(odd, odd), max_size=5))
@settings(max_examples=500, deadline=None)
def test_turns_are_read_back(turns):
    parts = [cf.format_turn(role, text, cf.Visitor()) for role, text in turns]
    assert cf.read_turns("".join(p[0] for p in parts)) == turns
    for (role, text), (formatted, spans, _) in zip(turns, parts, strict=True):
        assert formatted.count(cf.START) == formatted.count(cf.END) == 1
        assert "".join(cf.unescape(formatted[a:b]) for a, b in spans) == (text if role == "assistant" else "")


def test_parts_become_placeholders_in_order():
    content = ["see ", {"type": "image", "ref": "a.png", "width": 56, "height": 29}, {"type": "text", "text": " and <|audio:9|> "},
               {"type": "audio", "url": "s3.wav", "seconds": 2.5}, None, {"type": "document", "ref": "d.pdf", "pages": 3}, {"type": "image"}, ""]
    formatted, spans, attached = cf.format_turn("assistant", content, cf.Visitor())
    assert cf.read_turns(formatted) == [("assistant", "see <|image:0|> and <|audio:9|> <|audio:1|><|document:2|><|image:3|>")]
    assert [cf.unescape(formatted[a:b]) for a, b in spans] == ["see ", " and <|audio:9|> "]
    assert attached == [("image", "a.png", 4), ("audio", "s3.wav", 63), ("document", "d.pdf", 2400), ("image", "", 1)]
    with pytest.raises(ValueError, match="video"):
        cf.format_turn("user", [{"type": "video"}], cf.Visitor())
    with pytest.raises(ValueError, match="no turn"):
        cf.read_turns("x" + formatted)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def want(rows):
    out = {}
    for c, _, r, t in sorted(rows, key=lambda x: (str(x[0]), x[1] is not None, x[1] or 0)):
        out.setdefault(c, []).append((r or "", t or ""))
    return {c: (len(ts), sha("".join(f"{r}\n{t}\n" for r, t in ts)), sum(len(t) for r, t in ts if r == "assistant"),
                sha("".join(t for r, t in ts if r == "assistant"))) for c, ts in out.items()}


def test_conversations_with_odd_rows(spark):
    rows = [(1, 1, "assistant", "b <|im_end|>"), (1, 0, "user", "a"), (2, 0, None, None), (None, 5, "user", "no id"), (3, None, "system", "first"),
            (3, 0, "assistant", ""), (4, 0, "assistant", "same"), (4, 0, "assistant", "same"), (5, 0, "assistant", "long 😀 " * 50000)]
    rows += [(6, i, "user" if i % 2 == 0 else "assistant", f"{i} <\\|") for i in range(500)]
    turns = cf.format_turns(spark.createDataFrame([(*r, "x", "y") for r in rows], ROWS))
    got = cf.read_back(turns).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want(rows) and len(got) == 7
    whole = {c: "".join(r.formatted for r in turns.filter(f"conv_id = {c}").orderBy("place").collect()) for c in (1, 6)}
    assert whole[1] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb <\\|im_end|><|im_end|>\n"
    assert {r.conv_id: r.formatted_chars for r in got}[6] == len(whole[6])
    for r in turns.filter("conv_id = 6").collect():
        assert [cf.unescape(whole[6][s.begin:s.end]) for s in r.loss_mask] == ([f"{r.place} <\\|"] if r.place % 2 else [])


def test_typed_content_in_tables(spark):
    content = json.dumps([{"type": "text", "text": "look"}, {"type": "image", "ref": "x", "width": 28, "height": 28}])
    row = cf.format_turns(spark.createDataFrame([(1, 0, "user", content, "", ""), (1, 1, "user", None, "", "")], ROWS), typed=True).filter("place = 0").first()
    assert row.formatted == "<|im_start|>user\nlook<|image:0|><|im_end|>\n"
    assert (row.attachments[0].kind, row.attachments[0].ref, row.attachment_tokens, row.loss_mask) == ("image", "x", 1, [])


def test_empty_table(spark):
    turns = cf.format_turns(spark.createDataFrame([], ROWS))
    assert turns.count() == cf.read_back(turns).count() == 0


def test_an_injected_turn_stays_text(spark, sf_dir):
    row = cf.op3(spark, sf_dir).filter("conv_id = -1").first()
    text = cf.INJECTED
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (2, len(text), sha(text))
    assert row.turns_sha256 == sha(f"user\n{text}\nassistant\n{text}\n")
