import json
import random

from callweave.llm import tool_calls

TURNS = "conv_id long, turn long, role string, text string"


def call(*calls):
    return json.dumps({"tool_calls": [dict(zip(("id", "name", "arguments", "after"), x)) for x in calls]})


def longest_chains(needs):
    """id -> ids it needs; depth by repeated relaxation, None on and behind cycles."""
    depth = {}
    while True:
        new = {k: 1 + max([depth[n] for n in v], default=-1) for k, v in needs.items() if k not in depth and all(n in depth for n in v)}
        if not new:
            return {k: depth.get(k) for k in needs}
        depth |= new


def test_depths_equal_brute_force(spark):
    r = random.Random(4)
    turns, want = [], {}
    for conv in range(12):
        ids, needs = [f"c{k}" for k in range(r.randint(1, 25))], {}
        for k, i in enumerate(ids):
            needs[i] = sorted({r.choice(ids if conv % 4 == 3 else ids[:k] or [i + "?"]) for _ in range(r.choice([0, 1, 1, 1, 2, 3]))})
            turns.append((conv, k, "assistant", call((i, "reply", {}, needs[i] if r.random() < 0.8 or len(needs[i]) != 1 else needs[i][0]))))
        want |= {(conv, k): v for k, v in longest_chains({i: [n for n in v if n in needs] for i, v in needs.items()}).items()}
    got = {(x.conv_id, x.id): x.depth for x in tool_calls.linked(spark.createDataFrame(turns, TURNS)).collect()}
    assert got == want and None in want.values() and max(v or 0 for v in want.values()) > 3


def test_hard_json_is_text_or_canonical(spark):
    deep = '{"a":' * 200_000 + "1" + "}" * 200_000
    texts = [deep, '{"tool_calls": [{"id": "x", "name": "reply", "arguments": {"words": NaN}}]}', '{"tool_calls": [{"id": "x", "name": "reply", "arguments": {"words": 1e999}}]}', "{" * 5, "[1]"]
    texts += ['{"tool_calls": [{"id": "\\ud800", "name": "reply", "arguments": "{\\"prompt\\": \\"\\ud801\\", \\"words\\": 2}"}]}', '{"tool_call_id": "\\ud800", "content": "\\udfff"}']
    got = tool_calls.linked(spark.createDataFrame([(k, 0, "user", t) for k, t in enumerate(texts[:5])] + [(9, k, "x", t) for k, t in enumerate(texts[5:])], TURNS)).collect()
    assert sorted((x.conv_id, x.id, x.status) for x in got) == [(k, "turn-0", "unanswered") for k in range(5)] + [(9, "\\ud800", "answered")]
    assert all(json.loads(x.json) for x in got) and not any(s in x.json for x in got for s in ('":NaN', '":Infinity'))
    linked = next(x for x in got if x.conv_id == 9)
    assert json.loads(linked.json)["arguments"] == {"prompt": "\ud801", "words": 2} and linked.errors == []


def test_schema_keywords():
    schema = {"type": "object", "required": ["kind"], "properties": {"kind": {"enum": ["a", 1]}, "rows": {"type": "array", "minItems": 1, "items": {"type": ["integer", "null"], "maximum": 5}}, "inner": {"type": "object", "properties": {"x": {"type": "string", "maxLength": 2}}, "required": ["x"]}}, "additionalProperties": {"type": "boolean"}}
    check = lambda v: tool_calls.errors_of("t", v, {"t": schema})
    assert check({"kind": "a", "rows": [1, None, 5.0], "inner": {"x": "ab", "y": 3}, "flag": True}) == []
    assert check([]) == ["arguments: not object"] and check({}) == ["kind: missing"]
    assert check({"kind": True, "rows": [], "inner": {}, "flag": 0}) == ["flag: not boolean", "inner.x: missing", "kind: not in enum", "rows: size out of bounds"]
    assert check({"kind": 1, "rows": [1.5, 6, "x"], "inner": {"x": "abc"}}) == ["inner.x: size out of bounds", "rows[0]: not integer or null", "rows[1]: out of bounds", "rows[2]: not integer or null"]
