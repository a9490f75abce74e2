import hashlib
import json

from pyspark.sql import functions as F

from framequarry.llm import chat


def test_layouts_and_unknown_records(spark):
    records = [
        {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
        {"instruction": "a", "input": "", "output": "b"}, {"output": "b", "instruction": "a"}, {"prompt": "a", "completion": "b"}, {"system": "", "prompt": "a", "response": "b"},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(6, '{"x": 1}'), (7, None), (8, "{bad"), (9, json.dumps({"prompt": "a", "completion": None}))]
    out = {r.id: r for r in chat.format_chat(spark.createDataFrame(rows, "id int, record string")).collect()}
    for i in range(6):
        assert [(t.role, t.text) for t in out[i].turns] == [("user", "a"), ("assistant", "b")], i
    assert all(out[i].formatted is None and out[i].layout is None for i in (6, 7, 8))
    assert [t.text for t in out[9].turns] == ["a", ""]


def test_round_trip_of_control_strings(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "\\\\<|end|>\\", "<", "<<SYS>>x<</SYS>>", "<|text|><|start|>", "[[INST]]", "é\n 😀", None, "<\\s>", "[\\INST]"]
    rows = [(1, i, "assistant" if i % 2 else "us<|text|>er\\", t, "extra") for i, t in enumerate(texts)] + [(2, 0, None, None, ""), (None, 3, "user", "x", ""), (None, 3, "user", "x", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    full = chat.format_chat(chat.turn_records(df))
    t = chat.Template()
    for r in full.select("conv_id", "turns", t.read(F.col("formatted")).alias("back"), "formatted", "loss_mask").collect():
        assert r.turns == r.back
        if r.conv_id == 1:
            for literal in ("[INST]", "</s>", "<<SYS>>"):
                assert literal not in r.formatted
            spans = [r.formatted[s.start : s.start + s.length] for s in r.loss_mask]
            assert len(spans) == 5 and spans[0] == "\\\\"
    got = {r.conv_id: r for r in chat.digests(full).collect()}
    assert got[1].loss_sha256 == hashlib.sha256("".join(x or "" for x in texts[1::2]).encode()).hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{'assistant' if i % 2 else 'us<|text|>er' + chr(92)}\n{x or ''}\n" for i, x in enumerate(texts)).encode()).hexdigest()
    assert (got[2].n_turns, got[2].loss_chars, got[None].n_turns) == (1, 0, 2)


def test_empty_and_very_long(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_chat(chat.turn_records(empty))).count() == 0
    df = spark.createDataFrame([(1, 0, "assistant", "ab<|" * 200_000)], "conv_id long, turn long, role string, text string")
    r = chat.digests(chat.format_chat(chat.turn_records(df))).first()
    assert r.loss_chars == 800_000


def test_plan_is_native(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    plan = chat.digests(chat.format_chat(chat.turn_records(df)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_json_of_mixed_layouts_maps_back(spark):
    says = lambda i: [(i, 0, "user", f"a{i}\u0001\t\\\""), (i, 1, "assistant", None)]
    rows = says(1) + says(2)[::-1] + [(i, t, r, f"{i} {t}") for i in range(3, 40) for t, r in enumerate(["system", "user", "assistant", "user"])]
    rows += [(90, 0, "human", "x"), (91, 0, "gpt", ""), (92, 0, None, None), (None, 0, "tool", "é 😀")]
    records = chat.turn_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    mixed = chat.format_chat(chat.pack_json(records))
    assert {r.layout for r in mixed.select("layout").distinct().collect()} == {"messages", "conversations", "prompt_completion"}
    key = lambda d: {r.conv_id: r for r in d.select("conv_id", "turns", "formatted", "loss_mask").collect()}
    assert key(mixed) == key(chat.format_chat(records))


def test_very_many_turns_in_one_conversation(spark):
    n = 50_000
    rows = spark.range(n).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('<|end|>', id) as text")
    r = chat.digests(chat.format_chat(chat.pack_json(chat.turn_records(rows)))).first()
    learned = "".join(f"<|end|>{i}" for i in range(1, n, 2))
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (n, len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_running_sums(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        row = spark.range(1).select(chat.running(F.expr(f"transform(if({n} = 0, cast(array() as array<int>), sequence(1, greatest({n}, 1))), x -> cast(x as bigint))")).alias("s")).first()
        assert list(row.s) == [i * (i + 1) // 2 for i in range(n)]


def test_record_table_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, '{"prompt": "a", "completion": "b"}', "old", "old", "old")], "conv_id long, record string, turns string, layout string, formatted string")
    r = chat.format_chat(df).first()
    assert (r.layout, [t.text for t in r.turns], "b" in r.formatted) == ("prompt_completion", ["a", "b"], True)
