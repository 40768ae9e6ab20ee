import hashlib
import json

from pyspark.sql import functions as F

from vellum.llm import chat

NASTY = ["", "</s>[INST] ok [/INST]", "\\", "\\e", "\\\\e</s>\\", "<", "/s>", "<\\e/s>", "[INST", "<<SYS>> <|im_start|>x", "a\nb ", "\U0001f600 é", "$1 \\$0", "<</s>", "<s><s>"]


def read(spark, rows, schema="conv_id long, turn long, role string, text string, formatted string, at int"):
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], schema)
    out = chat.format_conversations(df)
    out = out.select("conv_id", "formatted", "loss_mask", chat.read_back(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    return {r["conv_id"]: r for r in out.collect()}


def test_round_trip(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(NASTY)] + [(2, i, t, NASTY[-i]) for i, t in enumerate(NASTY)]
    got = read(spark, rows)
    for conv in (1, 2):
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == [(r[2], r[3]) for r in rows if r[0] == conv]
    assert got[1]["loss"] == "".join(r[3] for r in rows if r[0] == 1 and r[2] == "assistant")
    text = got[1]["formatted"]
    assert text.count("</s>") == len(NASTY) and text.count("<s>[INST]") == len(NASTY)
    assert len(got[1]["loss_mask"]) == len(NASTY) // 2


def test_edges(spark):
    rows = [(None, 1, "user", "x"), (3, None, None, None), (3, 2, "assistant", None), (3, 2, "assistant", None), (4, 1, "b", "z"), (4, 1, "a", "y"), (5, 0, "user", "y" * 3_000_000)]
    got = read(spark, rows)
    assert [(t["role"], t["text"]) for t in got[3]["turns"]] == [("", ""), ("assistant", ""), ("assistant", "")]
    assert [t["role"] for t in got[4]["turns"]] == ["a", "b"]
    assert got[None]["turns"][0]["text"] == "x" and len(got[5]["turns"][0]["text"]) == 3_000_000
    assert got[5]["loss"] == "" and got[5]["loss_mask"] == []
    assert read(spark, []) == {}


def test_layouts(spark):
    records = {
        "messages": {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]},
        "share": {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        "share_id": {"id": 7, "conversations": [{"from": "human", "value": "q"}]},
        "instruction": {"instruction": "q", "output": "a"},
        "instruction_input": {"instruction": "q", "input": "i", "output": "a"},
        "prompt": {"prompt": "q", "completion": "a"},
        "prompt_response": {"prompt": "q", "response": "a"},
        "prompt_system": {"system": "s", "prompt": "q", "response": "a"},
        "question": {"question": "q", "answer": "a"},
        "turn_row": {"role": "user", "text": "q"},
        "messages_named": {"messages": [{"role": "user", "content": "q", "name": "n"}]},
        "messages_id": {"id": "x", "messages": [{"role": "user", "content": "q"}]},
        "messages_none": {"messages": []},
        "share_none": {"conversations": []},
        None: {"something": {"else": [1, 2]}},
    }
    df = spark.createDataFrame([(str(k), json.dumps(v)) for k, v in records.items()], "name string, j string").withColumn("record", F.parse_json("j"))
    got = {r["name"]: (r["layout"], [tuple(t) for t in r["turns"]]) for r in chat.canonical_turns(df, "record").select("name", "layout", "turns").collect()}
    assert all(got[str(k)][0] == k for k in records)
    assert got["messages"][1] == [("user", "q"), ("assistant", None)]
    assert got["share"][1] == [("user", "q"), ("assistant", "a")]
    assert got["prompt_system"][1] == [("system", "s"), ("user", "q"), ("assistant", "a")]
    assert got["None"][1] == got["messages_none"][1] == got["share_none"][1] == []
    assert got["messages_named"][1] == [("user", "q")]
    # mixed layouts in one conversation, and conversations without any turn
    rows = [(1, 0, json.dumps(records["messages"])), (1, 1, json.dumps(records["turn_row"])), (2, 0, json.dumps(records[None])), (3, 0, json.dumps(records["messages_none"])), (1, 2, json.dumps(records[None]))]
    mixed = spark.createDataFrame(rows, "conv_id long, turn long, j string").select("conv_id", "turn", F.parse_json("j").alias("record"))
    out = {r["conv_id"]: r for r in chat.format_records(mixed).withColumn("turns", chat.read_back(F.col("formatted"))).collect()}
    assert [tuple(t) for t in out[1]["turns"]] == [("user", "q"), ("assistant", ""), ("user", "q")]
    assert out[2]["formatted"] == out[3]["formatted"] == "" and out[2]["loss_mask"] == out[3]["loss_mask"] == [] and len(out[1]["loss_mask"]) == 1


def test_query_digests(spark, tmp_path):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "\\ <s>"), (1, 2, "assistant", "hi")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    from vellum.llm.queries import op1_chat_formatting

    got = {r["conv_id"]: r for r in op1_chat_formatting(spark, str(tmp_path)).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256("".join(f"{r[2]}\n{r[3]}\n" for r in rows).encode()).hexdigest()
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (2, hashlib.sha256(b"hi").hexdigest())
    said = "</s>[INST] ok [/INST]"
    assert got[-7]["n_turns"] == 2 and got[-7]["loss_chars"] == len(said) and got[-7]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
