"""Chats with texts that are no UTF-8, no JSON or of another type must not stop the job."""

import json

from tempora.llm import chat, queries_text

ODD = [
    (1, 1, "assistant", '{"tool_calls":[{"id":{"z":1,"a":"\\ud800"},"name":"f","arguments":{"x":"\\udfff"}}]}'),
    (1, 2, "tool", '{"tool_call_id":{"a":"\\ud800","z":1},"content":"\\ud800 done"}'),
    (2, 1, "assistant", '{"tool_calls":[{"id":"n","name":"f","arguments":{"x":NaN,"y":{"$ref":"q"}}},{"id":7,"name":["g"],"arguments":"{\\"x\\": 1e999}"}]}'),
    (2, 2, "tool", '{"tool_call_id":7,"content":[Infinity]}'),
    (2, 3, "tool", '{"tool_call_id":null,"content":{"b":1,"a":2}}'),
    (3, 1, "assistant", '{"content":{"k":"\\ud83d"},"tool_calls":["no call"]}'),
    (4, 1, "user", "\U0001f600 plain"), (4, 2, None, None), (None, None, "assistant", "{" * 5000), (None, None, "assistant", "{" * 5000),
]


def test_events_of_odd_messages():
    first = chat.events(*ODD[0][2:])[0]
    assert first[1] == chat.events(*ODD[1][2:])[0][1] == '{"a":"?","z":1}' and first[3] == '{"x":"?"}'
    assert chat.events(*ODD[1][2:])[0][4] == "? done"
    nan, big = chat.events(*ODD[2][2:])
    assert (nan[1], nan[3], nan[5]) == ("n", "null", []) and (big[1], big[2], big[3]) == ("7", '["g"]', "null")
    assert chat.events(*ODD[3][2:])[0][4] == "null" and chat.events(*ODD[4][2:])[0][4] == '{"a":2,"b":1}'
    assert [e[0] for e in chat.events(*ODD[5][2:])] == ["message", "call"]


def test_every_line_is_strict_json(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string, name string, kind int"
    spark.createDataFrame([(*r, "x", 1) for r in ODD], schema).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries_text.op7_chat(spark, str(tmp_path))
    line = next(c for c in got.columns if c in ("line", "json"))
    for r in got.collect():
        json.loads(r[line], parse_constant=lambda x: 1 / 0)
    assert got.count() == sum(len(chat.events(*r[2:])) for r in ODD)
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert queries_text.op7_chat(spark, f"{tmp_path}/none").count() == 0
