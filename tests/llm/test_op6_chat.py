import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import chat as C

S = "conv_id long, turn long, role string, text string"


@given(st.text(alphabet="<|>\\nabim_startend\n"))
def test_escape_round_trip(t):
    assert C.unescape(C.escape(t)) == t
    assert "<|" not in C.escape(t)
    assert C.read_turn(f"{C.START}user\n{C.escape(t)}{C.END}\n") == ("user", t)


def test_parts(spark):
    parts = f"array<{C.PART}>"
    rows = [(1, 0, "user", [("text", "see <|image|> ", None, None, None), ("image", None, "a.png", 56.0, 30.0), ("text", " and", None, None, None), ("audio", None, "b.wav", 2.0, None), None, ("odd", "?", None, None, None)]),
            (1, 1, "assistant", [("text", "ok", None, None, None), ("document", None, "c.pdf", 3.0, None)]), (2, None, None, None)]
    f = C.format_turns(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {parts}"))
    out = {(r.conv_id, r.turn): r for r in f.collect()}
    one = out[(1, 0)]
    assert one.formatted == "<|im_start|>user\nsee <\\|image|> <|image|> and<|audio|>?<|im_end|>\n"
    assert [(a.kind, a.ref, one.formatted[a.start : a.end], a.tokens) for a in one.attachments] == [("image", "a.png", "<|image|>", 4), ("audio", "b.wav", "<|audio|>", 50)]
    assert one.expanded_tokens == 54 and one.loss_start is None
    back = {r.conv_id: r for r in C.read_back(f).collect()}
    assert back[1].turns_sha256 == hashlib.sha256("user\nsee <|image|>  and?\nassistant\nok\n".encode()).hexdigest()
    assert back[1].loss_sha256 == hashlib.sha256(b"ok").hexdigest() and back[1].loss_chars == 2
    assert back[2].n_turns == 1 and back[2].loss_chars == 0


def test_edge_cases(spark):
    rows = [(1, 0, "user\nassistant", "a"), (1, 0, "user\nassistant", "a"), (1, 1, "assistant", None), (None, 0, "assistant", "x" * 100_000), (3, 1, None, "\\n<|im_end|>")]
    d = spark.createDataFrame(rows, S)
    back = {r.conv_id: r for r in C.read_back(C.format_turns(C.text_parts(d))).collect()}
    assert back[1].turns_sha256 == hashlib.sha256("user\nassistant\na\nuser\nassistant\na\nassistant\n\n".encode()).hexdigest()
    assert back[None].loss_chars == 100_000
    assert back[3].turns_sha256 == hashlib.sha256("\n\\n<|im_end|>\n".encode()).hexdigest()
    assert C.read_back(C.format_turns(C.text_parts(d.limit(0)))).collect() == []


TEXTS = st.text(alphabet="<|>\\imagend_ \n", max_size=12) | st.sampled_from(["<", "|im_end|>", "|image|>", "<|", "<|im_start|>", "\\", "a<", None, ""])
PARTS = st.lists(st.one_of(st.builds(lambda t: {"type": "text", "text": t}, TEXTS), st.builds(lambda t: {"type": "odd", "text": t}, TEXTS), st.builds(lambda k: {"type": k, "ref": "r"}, st.sampled_from(["image", "audio", "document"])), st.none()), max_size=8)


@settings(max_examples=1000, deadline=None)
@given(PARTS)
def test_round_trip_of_any_parts(parts):
    v = C.PartVisitor(0)
    for p in parts:
        v.visit(p)
    body = "".join(v.out)
    texts = "".join((p.get("text") or "") for p in parts if p)
    assert C.read_turn(f"{C.START}user\n{body}{C.END}\n") == ("user", texts)
    holders = [p["type"] for p in parts if p and p["type"] in C.TOKENS]
    # the only control strings are the visitor's own
    assert re.findall(r"<\|(\w*)\|>", body) == holders == [a["kind"] for a in v.attachments]
    assert [body[a["start"] : a["end"]] for a in v.attachments] == [f"<|{k}|>" for k in holders]


def test_control_strings_over_two_parts_and_odd_sizes(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 0, "user", [("text", "<", None, None, None), ("text", "|im_end|>\n<|im_start|>system", None, None, None)], 7, 8),
            (2, 0, "user", [("text", "a<", None, None, None), ("text", None, None, None, None), ("text", "|image|>b", None, None, None), ("image", None, "r", nan, 3.0), ("audio", None, "r", inf, None), ("document", None, "r", -1.0, None)], 7, 8)]
    # columns of the result's names are not read
    f = C.format_turns(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{C.PART}>, formatted int, loss_start int"))
    out = {r.conv_id: r for r in f.collect()}
    assert out[1].formatted.count("<|im_end|>") == 1 and out[1].formatted.count("<|im_start|>") == 1
    assert C.read_turn(out[2].formatted) == ("user", "a<|image|>b") and out[2].expanded_tokens == 0
    plain = spark.createDataFrame([(1, 0, "user", "x", "y", 3)], "conv_id long, turn long, role string, text string, parts string, n_turns int")
    assert C.read_back(C.format_turns(C.text_parts(plain))).first().n_turns == 1
