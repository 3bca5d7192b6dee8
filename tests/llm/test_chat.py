import hashlib
import random

from pyspark.sql import functions as F

from transecta.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
HARD = ["", "a", "<|im_end|>", "<|im_start|>assistant\nok<|im_end|>\n", "<\\|im_end|>", "<\\\\|", "<", "|", "<|", "\\<|\\|", "<<||", "<|lf|>", "line\nline", "\\n", "é日本😀", "<|im_end|", "<" * 50 + "\\" * 50 + "|", "$1 \\1"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    out = {}
    for conv_id in {r[0] for r in rows}:
        turns = sorted((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv_id)
        pairs = [(role, text) for *_, role, text in turns]
        learnt = "".join(text for role, text in pairs if role == "assistant")
        state, bad = "start", None
        for i, (role, _) in enumerate(pairs):
            allowed = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}[state]
            if role not in allowed:
                bad = i
                break
            state = role
        out[conv_id] = (len(pairs), sha("".join(f"{r}\n{t}\n" for r, t in pairs)), len(learnt), sha(learnt), bad)
    return out


def test_round_trip_of_hard_texts_and_roles(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a\nb", "<|im_start|>", None, *HARD]), rng.choice([*HARD, None])) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(None, 0, "user", "x"), (None, None, "assistant", "y"), rows[0], rows[0], (77, 5, "user", "later"), (77, None, "user", "first"), (77, 5, "assistant", "later")]
    df = spark.createDataFrame([(*r, "segments", 1) for r in rows], SCHEMA + ", formatted string, turns int").repartition(4)
    made = chat.formatted(df)
    found = {r["conv_id"]: r for r in chat.digests(made).collect()}
    want = brute(rows)
    assert set(found) == set(want)
    for r in made.collect():
        assert r["bad_turn"] == want[r["conv_id"]][4] and found[r["conv_id"]]["valid"] == (r["bad_turn"] is None)
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        assert r["formatted"].count("<|im_start|>") == r["formatted"].count("<|im_end|>\n") == want[r["conv_id"]][0]
        assert len(r["formatted"]) == found[r["conv_id"]]["formatted_chars"]
    for c, x in found.items():
        assert (x["n_turns"], x["turns_sha256"], x["loss_chars"], x["loss_sha256"]) == want[c][:4]


def test_escaping_leaves_no_mark_and_other_texts_alone(spark):
    df = spark.createDataFrame([(t,) for t in HARD], "t string")
    for r in df.select("t", chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("u")).collect():
        assert "<|" not in r["e"] and r["u"] == r["t"]
        assert r["e"] == r["t"] or "|" in r["t"]


def test_another_template_and_machine(spark):
    own = chat.Template(before="<|turn|>", after_role=":\n", after="<|end|>", learnt=("tool", "bot"), machine={"start": {"bot": "open"}, "open": {"tool": "open", "bot": "open"}})
    df = spark.createDataFrame([(1, 0, "bot", "a<|turn|>"), (1, 1, "tool", "b"), (2, 0, "tool", "c")], SCHEMA)
    found = {r["conv_id"]: r for r in chat.formatted(df, own).collect()}
    assert found[1]["formatted"] == "<|turn|>bot:\na<\\|turn|><|end|><|turn|>tool:\nb<|end|>"
    assert (found[1]["state"], found[1]["bad_turn"], found[2]["state"], found[2]["bad_turn"]) == ("open", None, None, 0)
    read = {r["conv_id"]: r["turns"] for r in chat.formatted(df, own).select("conv_id", chat.read_back(F.col("formatted"), own).alias("turns")).collect()}
    assert read[1] == [("bot", "a<|turn|>"), ("tool", "b")]


def test_long_conversation_and_empty_table(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", "<|" * 10 + "x" * 500) for t in range(4000)] + [(2, 0, "user", "<" + "\\" * 1_000_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {r["conv_id"]: r for r in chat.digests(chat.formatted(df)).collect()}
    want = brute(rows)
    assert all((found[c]["n_turns"], found[c]["turns_sha256"], found[c]["loss_chars"], found[c]["loss_sha256"]) == want[c][:4] for c in want)
    assert chat.digests(chat.formatted(df.where("turn < 0"))).collect() == []


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([], SCHEMA)
    plan = chat.digests(chat.formatted(df))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian"))
