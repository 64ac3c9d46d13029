import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import chat

ODD = "\\### user: </turn> \\h \\e \\\\ ####</turn>\n</turn>\n"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="#\\</turn>: \nhec", max_size=40), st.text(alphabet="#\\</turn>: \nhec", max_size=10))
def test_turns_round_trip(text, role):
    whole, start, length = chat.written(role, text)
    found = chat._TURN.findall(whole * 2)
    assert [(chat.unescape(a), chat.unescape(b)) for a, b in found] == [(role, text)] * 2
    assert chat.unescape(whole[start : start + length]) == text


def expected(rows):
    out, convs = [], {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs.setdefault(conv, []).append((role or "", text or ""))
    for conv, turns in convs.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        out.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()))
    return sorted(out, key=str)


def records(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit("p"))
    return df.select("conv_id", F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"}).alias("record"))


def test_whole_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", chat.PROBE), (-7, 1, "assistant", chat.PROBE)]
    assert sorted((tuple(r)[:5] for r in chat.query(spark, data).collect()), key=str) == expected(rows)


def test_odd_rows(spark):
    rows = [(1, 1, "assistant", ODD), (1, 0, "user", None), (1, 0, "user", None), (1, None, None, "x"), (None, 5, "assistant", ""), (2, 3, "a: b", "é漢😀" * 2000), (2, 3, "assistant", "é漢😀")]
    got = chat.digest(chat.format_records(records(spark, rows))).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == expected(rows)
    assert chat.digest(chat.format_records(records(spark, rows).limit(0))).count() == 0


def test_layouts_become_the_same_turns(spark):
    layouts = [
        {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"system": "s", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": "x"},
        {"system": "s", "instruction": "q", "output": "a", "input": ""},
        {"prompt": "q", "completion": "a", "system": "s"},
        {"prompt": {"text": "q", "system": "s"}, "response": {"text": "a"}},
        {"context": "s", "question": "q", "answer": "a", "id": 4},
    ]
    strange = [{"foo": 1}, {}, [1], "x"]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(layouts + strange)] + [(90, None), (91, "{")], "conv_id long, record string")
    found = {}
    for r in chat.turns(df).collect():
        found.setdefault(r.conv_id, []).append((r.place, r.role, r.text))
    turns = [(0, "system", "s"), (1, "user", "q"), (2, "assistant", "a")]
    assert found == {i: turns for i in range(len(layouts))}
    assert sorted(r.conv_id for r in chat.unmapped(df).collect()) == [6, 7, 8, 9, 90, 91]


def test_no_conversation_is_lost(spark):
    call = {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a", "tool_calls": [{"id": 3}]}]}
    df = spark.createDataFrame([(1, json.dumps(call)), (2, '{"foo": 1}'), (3, None), (4, "{")], "conv_id long, record string").withColumn("text", F.lit(0)).withColumn("place", F.lit(0))
    found = sorted((r.conv_id, r.place, r.role, r.text) for r in chat.turns(df).collect())
    assert found == [(1, 0, "user", "q"), (1, 1, "assistant", "a")] and sorted(r.conv_id for r in chat.unmapped(df).collect()) == [2, 3, 4]
    kept = {r.conv_id: r for r in chat.digest(chat.format_records(df)).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in kept.items()} == {1: (2, 1), 2: (1, 0), 3: (1, 0), 4: (1, 0)}
    assert kept[2].turns_sha256 == hashlib.sha256(b'unmapped\n{"foo": 1}\n').hexdigest()


def test_fingerprint_ignores_order_and_values():
    assert chat.fingerprint(chat.paths({"a": 1, "b": [{"c": 2}, {"d": 3}]})) == chat.fingerprint(chat.paths({"b": [{"d": None, "c": "x"}], "a": {}}))
    assert chat.paths({"a": [], "b": {}}) == {"a[]", "b"}
