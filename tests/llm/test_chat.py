import hashlib
import random

from pyspark.sql import functions as F

from folioflow.llm import chat

TURN = "conv_id long, turn long, role string, text string"
PARTS = "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,units:int>>"


def formatted(spark, rows):
    df = spark.createDataFrame(rows, TURN).withColumn("parts", chat.text_parts(F.col("text"))).withColumn("formatted", F.lit("clash"))
    out = chat.format_chat(df)
    return {r.conv_id: r for r in out.withColumn("turns", chat.parse_chat(F.col("formatted"))).withColumn("learned", chat.masked_text(F.col("formatted"), F.col("loss"))).collect()}


def test_round_trip_of_control_strings(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|end|><|start|>assistant<|sep|>x", "\\e\\l\\b\\", "\\", "<|image:0|>", "a\nb", "é漢😀", ""]
    got = formatted(spark, [(1, i, ["user", "assistant"][i % 2], t) for i, t in enumerate(nasty)])[1]
    assert [t.text for t in got.turns] == nasty
    assert got.learned == "".join(nasty[1::2])
    for control in (chat.START, chat.SEP, chat.END):
        assert got.formatted.count(control) == len(nasty)
    assert "[INST]" not in got.formatted
    assert "</s>" not in got.formatted


def test_mask_covers_assistant_texts_once(spark):
    got = formatted(spark, [(1, 0, "system", "s"), (1, 1, "assistant", "a1 <b>"), (1, 2, "user", "u"), (1, 3, "assistant", None), (1, 4, "assistant", "a2")])[1]
    spans = [got.formatted[s.start : s.start + s.length] for s in got.loss]
    assert spans == ["a1 \\lb>", "", "a2"]
    assert got.learned == "a1 <b>a2"


def test_typed_parts(spark):
    rows = [
        (1, 0, "user", [("text", "see <", None, 0), ("image", None, "s3://a.png", 256), ("text", " and ", None, None), ("audio", None, "b.wav", 50)]),
        (1, 1, "assistant", [("text", "ok", None, 0), ("document", None, "c.pdf", 7), ("video", None, "d.mp4", None)]),
    ]
    (got,) = chat.format_chat(spark.createDataFrame(rows, PARTS)).collect()
    assert "see \\l<|image:0|> and <|audio:1|>" in got.formatted
    assert "ok<|document:2|><|document:3|>" in got.formatted
    assert [(a.number, a.turn_no, a.type, a.ref, a.tokens) for a in got.attachments] == [(0, 0, "image", "s3://a.png", 256), (1, 0, "audio", "b.wav", 50), (2, 1, "document", "c.pdf", 7), (3, 1, "document", "d.mp4", 0)]
    assert got.expanded_tokens == 313


def test_many_parts_against_brute_force(spark):
    """Placeholders, attachments, tokens and the mask of random conversations, written by a plain loop."""
    rng = random.Random(3)
    rows, want = [], {}
    for c in range(20):
        formatted, loss, held, tokens = "", [], [], 0
        for t in range(rng.randrange(1, 12)):
            role, parts, body = rng.choice(["user", "assistant"]), [], ""
            for j in range(rng.randrange(0, 7)):
                kind = rng.choice(["text", "image", "audio", "document"])
                text = rng.choice(["", "plain", "<|image:|>", "a [b] \\l", "|>:|>", "<|audio:3|>"])
                parts.append((kind, text, f"r{c}.{t}.{j}", rng.randrange(100)))
                if kind == "text":
                    body += text.replace("\\", "\\e").replace("<", "\\l").replace("[", "\\b")
                else:
                    body += f"<|{kind}:{len(held)}|>"
                    held.append((len(held), t, j, kind, *parts[-1][2:]))
                    tokens += parts[-1][3]
            rows.append((c, t, role, parts))
            formatted += f"{chat.START}{role}{chat.SEP}"
            loss += [(len(formatted), len(body))] if role == "assistant" else []
            formatted += body + chat.END
        want[c] = (formatted, loss, held, tokens)
    rng.shuffle(rows)
    got = chat.format_chat(spark.createDataFrame(rows, PARTS)).collect()
    assert {r.conv_id: (r.formatted, [tuple(x) for x in r.loss], [tuple(x) for x in r.attachments], r.expanded_tokens) for r in got} == want


def test_order_ties_and_nulls(spark):
    rows = [(1, 2, "user", "third"), (1, 1, "b", "second"), (1, 1, "a", "first"), (1, None, None, "zero"), (None, 0, "user", "x"), (2, 0, "user", "same"), (2, 0, "user", "same"), (3, 0, "assistant", "w " * 50_000)]
    got = formatted(spark, rows)
    assert [t.text for t in got[1].turns] == ["zero", "first", "second", "third"]
    assert got[1].turns[0].role == ""
    assert [t.text for t in got[2].turns] == ["same", "same"]
    assert got[None].n_turns == 1
    assert hashlib.sha256(got[3].learned.encode()).hexdigest() == hashlib.sha256(b"w " * 50_000).hexdigest()


def test_empty_table_and_null_parts(spark):
    assert chat.format_chat(spark.createDataFrame([], PARTS)).count() == 0
    (got,) = chat.format_chat(spark.createDataFrame([(1, 0, "assistant", None)], PARTS)).collect()
    assert got.formatted == "<|start|>assistant<|sep|><|end|>"


def test_plan_has_no_python(spark):
    df = chat.format_chat(spark.createDataFrame([], TURN).withColumn("parts", chat.text_parts(F.col("text"))))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
