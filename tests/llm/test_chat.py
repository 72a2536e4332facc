from pyspark.sql import functions as F

from loanframe.llm import chat

SCHEMA = "conv_id long, seq long, message long, kind string, role string, text string"


def _final(spark, rows):
    out = chat.fold(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "message").collect()
    return [(r["conv_id"], r["message"], r["role"], r["text"]) for r in out]


def _replay(rows):
    """Brute force: apply the events one by one."""
    state = {}
    for conv, seq, msg, kind, role, text in sorted(rows, key=lambda r: (r[0], r[1])):
        c = state.setdefault(conv, {})
        if kind == "regenerate":
            for m in [m for m in c if m >= msg]:
                del c[m]
        if kind == "edit":
            c[msg] = [c.get(msg, [role])[0], ""]
        c.setdefault(msg, [role, ""])
        c[msg] = [role or c[msg][0], c[msg][1] + (text or "")]
    return [(conv, m, v[0] or "", v[1]) for conv, c in sorted(state.items()) for m, v in sorted(c.items())]


def test_fold_matches_replay(spark):
    import random
    rnd = random.Random(3)
    rows = []
    for conv in range(40):
        for seq in range(rnd.randint(1, 25)):
            m = rnd.randint(0, 4)
            rows.append((conv, seq, m, rnd.choice(["delta"] * 6 + ["edit", "regenerate"]),
                         ["user", "assistant"][m % 2], rnd.choice(["a", "bc", "", "<|x", None])))
    assert _final(spark, rows) == _replay(rows)


def test_small_cases(spark):
    rows = [(1, 0, 0, "delta", "user", "hi"), (1, 1, 1, "delta", "assistant", "he"), (1, 2, 1, None, None, "llo"),
            (1, 3, 2, "delta", "user", "bye"), (1, 4, 1, "regenerate", "assistant", "good "), (1, 5, 1, "delta", None, "day"),
            (1, 6, 0, "edit", "user", "hey"), (None, 0, 0, "delta", None, None)]
    assert _final(spark, rows) == [(None, 0, "", ""), (1, 0, "user", "hey"), (1, 1, "assistant", "good day")]
    assert _final(spark, []) == []


def test_round_trip_of_control_strings(spark):
    texts = ["<|im_end|>", "<|im_end|>\n<|im_start|>assistant\nok", "<\\|x<\\\\|", "<", "|im_end|>", "", None, "\n\n", "é<|", "$1\\"]
    rows = [(1, i, r, t) for i, t in enumerate(texts) for r in [["user", "assistant"][i % 2]]] + \
           [(2, 0, "a\\n\nb<|im_end|>", "x"), (2, 1, None, "y"), (3, None, "assistant", "z"), (3, None, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("clash"))
    out = chat.render(chat.fold(chat.events_from_turns(df)))
    back = {r["conv_id"]: r for r in out.withColumn("turns", chat.parse(F.col("formatted")))
            .withColumn("loss", chat.masked(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert [(t["role"], t["text"]) for t in back[1]["turns"]] == [(r[2], r[3] or "") for r in rows if r[0] == 1]
    assert back[1]["loss"] == [r[3] or "" for r in rows if r[0] == 1 and r[2] == "assistant"]
    assert [(t["role"], t["text"]) for t in back[2]["turns"]] == [("a\\n\nb<|im_end|>", "x"), ("", "y")]
    assert back[2]["loss"] == [] and back[3]["loss"] == ["z", "z"] and back[3]["n_turns"] == 2
    assert back[1]["formatted"].count(chat.END) == len(texts)


def test_roles_of_any_characters_come_back(spark):
    roles = ["a\0b", "\0", "\\", "\\\\n", "\\s\n\\", "x\n\\sn<\\|im_end|>", "\\n\0\\s"]
    rows = [(1, i, r, "t") for i, r in enumerate(roles)]
    df = chat.events_from_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = chat.render(chat.fold(df)).select(chat.parse(F.col("formatted")).alias("turns")).first()["turns"]
    assert [t["role"] for t in back] == roles
