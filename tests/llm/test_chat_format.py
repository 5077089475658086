import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import chat_format as C
from quern.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, ts string"


def convs(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def read_back(df):
    out = df.withColumn("turns", C.parse_turns(F.col("formatted"))).withColumn("learnt", C.masked_text(F.col("formatted"), F.col("loss_mask")))
    out = out.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), C.unescape(t["content"]).alias("text"))))
    return {r.conv_id: r for r in out.collect()}


HARD = ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s>", "[\\INST]", "<|image:0|>", "", None, "<<s>>", "[[/INST]]", "\\", "<", "[", "<\\|", "line\nline\r\n", "x" * 100_000]


def test_round_trip_of_control_strings(spark):
    rows = [(k, t, r, x) for k, x in enumerate(HARD) for t, r in ((0, "user"), (1, "assistant"))]
    found = read_back(C.format_conversations(convs(spark, rows)))
    for k, x in enumerate(HARD):
        assert [(t.role, t.text) for t in found[k].turns] == [("user", x or ""), ("assistant", x or "")]
        assert found[k].learnt == (x or "")
        assert found[k].formatted.count("</s>") == 2


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="<[\\/s>|INST] \né☃", max_size=30), min_size=1, max_size=6))
def test_any_text_comes_back(spark, texts):
    found = read_back(C.format_conversations(convs(spark, [(1, k, "assistant", t) for k, t in enumerate(texts)])))
    assert [t.text for t in found[1].turns] == texts and found[1].learnt == "".join(texts)


def test_order_ties_nulls_and_repeats(spark):
    rows = [(1, 2, "user", "c"), (1, None, "system", "a"), (1, 2, "assistant", "b"), (1, 2, "user", "c"), (None, 0, None, None)]
    found = read_back(C.format_conversations(convs(spark, rows)))
    assert [(t.role, t.text) for t in found[1].turns] == [("system", "a"), ("assistant", "b"), ("user", "c"), ("user", "c")]
    assert [(t.role, t.text) for t in found[None].turns] == [("", "")]


def test_empty_table(spark):
    assert C.format_conversations(convs(spark, [])).count() == 0


def test_typed_parts(spark):
    part = lambda kind, **k: (kind, k.get("text"), k.get("uri"), k.get("width"), k.get("height"), k.get("seconds"), k.get("pages"))
    parts = [part("text", text="see "), part("image", uri="a.png", width=28, height=15), None, part("text", text=" and <|image:0|>"), part("audio", uri="b.wav", seconds=2.02), part("document", uri="c.pdf", pages=3), part(None, text="!")]
    df = spark.createDataFrame([(1, 0, "assistant", None, parts)], f"conv_id long, turn long, role string, text string, parts {C.PART and 'array<' + C.PART + '>'}")
    r = C.format_conversations(df, parts_col="parts").collect()[0]
    assert r.formatted == "<s>[INST]assistant[/INST]see <|image:0|> and <\\|image:0|><|audio:1|><|document:2|>!</s>"
    assert [(a.idx, a.kind, a.uri, a.tokens) for a in r.attachments] == [(0, "image", "a.png", 4), (1, "audio", "b.wav", 51), (2, "document", "c.pdf", 1536)]
    assert r.expanded_tokens == 4 + 51 + 1536


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r.conv_id: r for r in queries.op10_chat_format(spark, sf).collect()}
    turns = spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect()
    want = {-7: [("user", queries.CONTROL_TEXT), ("assistant", queries.CONTROL_TEXT)]}
    for t in turns:
        want.setdefault(t.conv_id, []).append((t.role, t.text))
    assert rows.keys() == want.keys()
    for k, own in want.items():
        assert rows[k].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        said = "".join(b for a, b in own if a == "assistant")
        assert (rows[k].loss_chars, rows[k].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())


@pytest.mark.parametrize("name", ["op2_exact_dedup", "op4_pii", "op10_chat_format"])
def test_native_plans_hold_no_python(spark, name, capsys):
    queries.QUERIES[name](spark, "/root/testdata/sf0.001").explain()
    assert not any(w in capsys.readouterr().out for w in ("Python", "Arrow", "Pandas"))


def part(kind, text=None, uri=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, uri, width, height, seconds, pages)


def typed(spark, rows):
    return spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, parts array<{C.PART}>")


def said(df):
    out = df.withColumn("turns", F.transform(C.parse_turns(F.col("formatted")), lambda t: F.struct(t["role"].alias("role"), C.visible(t["content"]).alias("text"))))
    return {r.conv_id: r for r in out.withColumn("learnt", C.masked_text(F.col("formatted"), F.col("loss_mask"))).collect()}


@pytest.mark.parametrize("texts", [["<", "/s>"], ["<\\", "/s>"], ["[", "/INST]"], ["<", "s", ">"], ["<|", "image:0|>"], ["</s", ">"], ["<", "", None, "|image:0|>"]])
@pytest.mark.parametrize("between", [False, True])
def test_parts_cannot_forge_control_strings(spark, texts, between):
    parts = [p for t in texts for p in ([part("text", t), part("image", uri="i", width=1, height=1)] if between else [part("text", t)])]
    rows = [(1, k, "assistant", None, parts) for k in range(2)]
    (r,) = said(C.format_conversations(typed(spark, rows), parts_col="parts")).values()
    whole = "".join(t or "" for t in texts)
    assert [t.text for t in r.turns] == [whole] * 2 and r.learnt == whole * 2
    assert r.formatted.count("</s>") == r.formatted.count("<s>") == 2
    assert len(r.attachments) == between * 2 * len(texts)


PARTS = st.lists(st.one_of(st.text(alphabet="<[\\/s>|INST]:0image", max_size=8).map(lambda t: part("text", t)), st.just(part("image", uri="u")), st.none()), max_size=7)


@settings(max_examples=20, deadline=None)
@given(st.lists(PARTS, min_size=1, max_size=5))
def test_any_parts_come_back(spark, turns):
    (r,) = said(C.format_conversations(typed(spark, [(1, k, "assistant", None, own) for k, own in enumerate(turns)]), parts_col="parts")).values()
    assert [t.text for t in r.turns] == ["".join(p[1] for p in own if p and p[0] == "text") for own in turns]
    assert [a.idx for a in r.attachments] == list(range(sum(1 for own in turns for p in own if p and p[0] == "image")))


def test_attachments_are_numbered_in_the_conversation(spark):
    image = [part("image", uri="a.png", width=14, height=14)]
    rows = [(1, 0, "user", None, image), (1, 1, "user", None, [part("text", "x"), *image, part("audio", uri="b", seconds=1.0)]), (1, 1, "user", None, image), (2, 0, "user", None, image)]
    found = {r.conv_id: r for r in C.format_conversations(typed(spark, rows), parts_col="parts").collect()}
    assert [a.idx for a in found[1].attachments] == [0, 1, 2, 3] and [a.idx for a in found[2].attachments] == [0]
    for k, a in enumerate(found[1].attachments):
        assert found[1].formatted.count(f"<|{a.kind}:{k}|>") == 1
    many = [(3, 0, "user", None, [p for k in range(3000) for p in (part("text", "<s>"), part("image", uri=str(k)))])]
    (r,) = C.format_conversations(typed(spark, many), parts_col="parts").collect()
    assert [a.uri for a in r.attachments] == [str(k) for k in range(3000)] and r.formatted.count("<\\s>") == 3000
