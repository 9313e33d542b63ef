import json
from collections import Counter

from callweave.llm import tool_calls


def test_braced_turns_without_calls_are_exchanges(spark):
    call = json.dumps({"tool_calls": [{"id": "a", "name": "reply", "arguments": {"prompt": "x", "words": 1}}]})
    turns = [(1, 0, "user", '{"ask": 1}'), (1, 1, "assistant", '{"answer": 2}'), (1, 2, "user", "{not json"), (1, 3, "assistant", "yes")]
    turns += [(2, 0, "assistant", "\n\t " + call), (2, 1, "tool", '\n{"tool_call_id": "a", "content": 3}'), (3, 0, "user", "a"), (3, 0, "user", "a b"), (3, 0, "user", None), (3, 1, "assistant", "{}"), (3, 2, "user", "next")]
    got = tool_calls.linked(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert Counter((x.conv_id, x.id, x.depth, x.status) for x in got) == Counter([(1, "turn-0", 0, "answered"), (1, "turn-2", 1, "answered"), (2, "a", 0, "answered"), (3, "turn-0", 0, "answered"), (3, "turn-0", None, "repeated"), (3, "turn-0", None, "repeated"), (3, "turn-2", 1, "unanswered")])
    first = next(json.loads(x.json) for x in got if (x.conv_id, x.id, x.status) == (3, "turn-0", "answered"))
    assert first["arguments"] == {"prompt": "a", "words": 1} and first["result"] == {"text": "{}"}
    assert next(json.loads(x.json) for x in got if (x.conv_id, x.id) == (1, "turn-0"))["arguments"]["prompt"] == '{"ask": 1}'
