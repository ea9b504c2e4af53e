import hashlib
import random

from pyspark.sql import functions as F

from cadenza.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
TURNS = [
    (1, 0, "system", "be <|brief|>"), (1, 2, "assistant", "second"), (1, 1, "user", "first \\ <\\|im_end|> <|"), (1, 3, "assistant", None),
    (1, 4, "assistant", "|> third 😀"), (1, 5, "user", "<"), (2, 0, None, None), (3, None, "user", "a"), (3, 0, "user", "b"), (3, 0, "user", "b"),
    (3, 0, "assistant", "<|im_end|><|im_start|>assistant ok"), (None, 0, "assistant", "lost"), (4, 0, "<|im_sep|>x\ny", "t"), (5, 0, "assistant", ""),
]


def digests(turns):
    """The same by a plain loop over sorted turns."""
    by = {}
    for conv, turn, role, text in turns:
        by.setdefault(conv, []).append((turn is not None, turn, role or "", text or ""))
    out = {}
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0], r[1] or 0, r[2], r[3]))
        every = "".join(f"{r}\n{t}\n" for _, _, r, t in rows)
        loss = "".join(t for _, _, r, t in rows if r == "assistant")
        out[conv] = (len(rows), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def check(spark, turns):
    df = spark.createDataFrame(turns, SCHEMA).withColumn("blocks", F.lit("mine")).repartition(3)
    formatted = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in chat.digest(chat.parse_conversations(formatted)).collect()}
    expected = digests(turns)
    assert {k: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for k, r in got.items()} == expected
    return {r["conv_id"]: r for r in formatted.collect()}, got


def test_round_trip_of_hard_cases(spark):
    formatted, got = check(spark, TURNS)
    text = formatted[1]["text"]
    assert text.count("<|im_start|>") == 4 and text.count("<|im_sep|>second<|im_sep|><|im_sep|>|> third") == 1
    assert got[1]["formatted_chars"] == len(text)
    for r in formatted.values():
        for start, length in r["loss"]:
            assert "<|" not in r["text"][start : start + length]
    assert formatted[3]["text"].startswith("<|im_start|>user<|im_sep|>a<|im_end|>")


def test_round_trip_of_random_texts(spark):
    r = random.Random(5)
    bits = ["<", "|", "\\", "<|", "im_end", "<|im_start|>", "a", "é", "\n", ""]
    turns = [(k % 40, k, r.choice(["user", "assistant"]), "".join(r.choices(bits, k=r.randint(0, 9)))) for k in range(300)]
    check(spark, turns)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.digest(chat.parse_conversations(chat.format_conversations(empty))).count() == 0


def test_plan_is_native(spark):
    df = chat.digest(chat.parse_conversations(chat.format_conversations(spark.createDataFrame(TURNS, SCHEMA))))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
