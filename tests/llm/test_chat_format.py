import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlight.llm import chat_format as C
from ledgerlight.llm.queries import op8_chat_format

CONV = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    return out


def digests(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in C.digest(C.parse(df)).collect()}


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*C.CONTROLS, C.ESCAPE, C.END, "<", "|", ">", "[", "\n", "a", "é", ".", C.ESCAPE + "a", " "]), max_size=8).map("".join), min_size=40, max_size=60))
def test_round_trip_of_control_strings(spark, texts):
    rows = [(i % 7, i, ("user", "assistant", "system", "a|>\nb")[i % 4], t) for i, t in enumerate(texts)]
    assert digests(C.format_conversations(spark.createDataFrame(rows, CONV))) == expected(rows)


def test_nulls_ties_and_empty(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, None, "x"), (None, 0, "assistant", "n"), (2, None, "assistant", ""), (3, 5, "assistant", "b" * 200_000)]
    df = spark.createDataFrame(rows, CONV)
    got = digests(C.format_conversations(df))
    assert got == expected([(c, -1 if t is None else t, r, x) for c, t, r, x in rows])
    assert C.format_conversations(df.limit(0)).count() == 0


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [
        (1, 1, 1, "message", "user", "Hel"), (1, 2, 1, "delta", None, "lo"),
        (1, 3, 2, "message", "assistant", ""), (1, 4, 2, "delta", None, "wrong"), (1, 5, 2, "regenerate", None, ""), (1, 7, 2, "delta", None, "ht"), (1, 6, 2, "delta", None, "rig"),
        (1, 8, 1, "edit", None, "Bye"), (1, 9, 3, "delta", None, "lone"),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, msg long, kind string, role string, text string")
    got = sorted((r["msg"], r["role"], r["text"]) for r in C.fold(events).collect())
    assert got == [(1, "user", "Bye"), (2, "assistant", "right"), (3, "", "lone")]


def test_query_over_the_whole_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    rows += [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    got = op8_chat_format(spark, d).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == expected(rows)


def test_further_columns_with_clashing_names(spark):
    rows = [(1, 0, "user", "a", "x", 5), (1, 1, "assistant", "b", "y", 6)]
    df = spark.createDataFrame(rows, CONV + ", msg string, seq int")
    assert digests(C.format_conversations(df)) == expected([r[:4] for r in rows])
