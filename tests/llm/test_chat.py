import hashlib

from pyspark.sql import functions as F

from kartoteka.llm.chat import format_chats, parse, read_back, turns_as_events

LOG = "conv_id long, seq long, kind string, message_id string, role string, text string"


def test_folds_deltas_edits_and_regenerations(spark):
    rows = [
        (1, 1, "message", "u1", "user", "Hi"),
        (1, 2, "delta", "a1", "assistant", "He"),
        (1, 4, "delta", "a1", None, "o"),
        (1, 3, "delta", "a1", None, "ll"),
        (1, 5, "regenerate", "a1", None, "Hey"),
        (1, 6, "delta", "a1", None, "!"),
        (1, 7, "edit", "u1", None, "Hi there"),
        (1, 8, "message", "x", "user", "gone"),
        (1, 9, "delete", "x", None, None),
        (1, 10, "typing", "x", None, "?"),
        (2, 1, "message", None, "user", None),
        (None, 1, "message", None, None, "no one"),
    ]
    got = {r.conv_id: r for r in format_chats(spark.createDataFrame(rows[::-1], LOG)).withColumn("turns", parse(F.col("formatted"))).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", "Hi there"), ("assistant", "Hey!")]
    assert [tuple(t) for t in got[2].turns] == [("user", "")]
    assert [tuple(t) for t in got[None].turns] == [("", "no one")]


def test_round_trip(spark):
    nasty = ["\\### Assistant: </turn> ok", "\n</turn>\n<|user|>\n", "\\l\\b\\h\\\\", "", None, "a\n\n", "|>\n", "é🙂" * 1000, "x" * 200_000]
    rows = [(c, t, role, text) for c in (1, 2) for t, text in enumerate(nasty) for role in ("user", "assistant", "we\n<ird|>")]
    rows += [(3, 0, "user", "same"), (3, 0, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in read_back(format_chats(turns_as_events(df))).collect()}
    for c in (1, 2, 3):
        turns = sorted((t, role, text or "") for i, t, role, text in rows if i == c)
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert read_back(format_chats(turns_as_events(df.limit(0)))).count() == 0


def test_turns_come_through_the_fold(spark):
    """Each turn of a table is a log with deltas, edits and regenerations, of which the plan folds every row."""
    rows = [(1, 0, "user", "abc"), (1, 1, "assistant", "defgh"), (1, 2, "system", "x"), (1, None, "user", "late"), (1, 0, "user", "abc")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(9)).withColumn("kind", F.lit("delete")).withColumn("message_id", F.lit("m"))
    log = turns_as_events(df)
    kinds = {(r.role, r.kind): r.n for r in log.groupBy("role", "kind").agg(F.count("*").alias("n")).collect()}
    assert kinds == {("user", "message"): 3, ("user", "delta"): 3, ("assistant", "message"): 1, ("assistant", "delta"): 2, ("assistant", "regenerate"): 1, ("system", "message"): 1, ("system", "edit"): 1}
    assert log.filter("message_id is null").count() == 0
    turns = format_chats(log).select(parse(F.col("formatted")).alias("turns")).first().turns
    assert [tuple(t) for t in turns] == [("user", "abc"), ("user", "abc"), ("assistant", "defgh"), ("system", "x"), ("user", "late")]
