"""Tool calls: one form of numbers, nested schemas."""

import json
import random
from decimal import Decimal

CALLS = "conv_id int, turn int, call_id string, name string, arguments string, after array<string>"
RESULTS = "conv_id int, turn int, call_id string, content string"


def linked(spark, texts, schema):
    from tablekit.llm.chat import link_tool_calls
    calls = spark.createDataFrame([(1, k, f"c{k}", "t", t, None) for k, t in enumerate(texts)], CALLS)
    results = spark.createDataFrame([(1, k, f"c{k}", "ok") for k in range(len(texts))], RESULTS)
    rows = link_tool_calls(calls, results, {"t": schema}).collect()
    return {r.turn: r for r in rows}


def test_numbers_have_one_form_and_lose_nothing(spark):
    same = [("100", "1e2", "1E+2", "100.0", "1000e-1", "100"), ("0.001", "1e-3", "0.0010", "10E-4"), ("-0", "0", "0.0", "0e5", "-0.00"),
            ("12345678901234567890123456789012345678", "1234567890123456789012345678901234567.8e1"), ("-1.5", "-15e-1", "-1.50")]
    texts = [f'{{"n": {n}}}' for forms in same for n in forms]
    rows = linked(spark, texts, {"n": ("number", True)})
    at = 0
    for forms in same:
        found = {rows[at + k].json for k in range(len(forms))}
        at += len(forms)
        # the same but for turn and identifier
        numbers = {f.split('"n":')[1].split("}")[0] for f in found}
        assert len(numbers) == 1 and Decimal(numbers.pop()) == Decimal(forms[0])
    assert all(r.status == "linked" and not r.faults for r in rows.values())


def test_numbers_without_a_form_are_faults(spark):
    odd = ["1E400", "1e99999999999999999999", "1" * 50, "0." + "1" * 45, "1e-400"]
    rows = linked(spark, [f'{{"n": {n}, "s": "a\\"1e5\\\\"}}' for n in odd], {"n": ("number", True), "s": ("string", True)})
    for k, n in enumerate(odd):
        assert rows[k].status == "invalid" and f"number out of range: {n}" in rows[k].faults
        assert json.loads(rows[k].json)["arguments"] == {"n": n, "s": 'a"1e5\\'}


def test_numbers_against_python(spark):
    rng = random.Random(5)
    number = lambda: rng.choice(["", "-"]) + rng.choice(["0", str(rng.randint(1, 10 ** rng.randint(1, 20)))]) + rng.choice(
        ["", f".{rng.randint(0, 10 ** rng.randint(1, 9))}", ".000"]) + rng.choice(["", f"e{rng.randint(-15, 15)}", f"E+{rng.randint(0, 9)}"])
    value = lambda: rng.choice([number(), number(), json.dumps(rng.choice(['1e5', 'a"b\\', "0.10", "é\n", "\\\"-0"]), ensure_ascii=False),
                                "true", "null", f"[{number()}, {{\"k\": {number()}}}]"])
    texts = ["{" + ", ".join(f'"f{k}": {value()}' for k in range(rng.randint(0, 4))) + "}" for _ in range(300)]
    rows = linked(spark, texts, {})
    for k, t in enumerate(texts):
        got = json.loads(rows[k].json, parse_float=Decimal, parse_int=Decimal)["arguments"]
        assert got == json.loads(t, parse_float=Decimal, parse_int=Decimal), t
        assert not any("out of range" in f for f in rows[k].faults)
        assert "E" not in rows[k].json.split('"arguments":')[1].replace("true", "").split('"call_id"')[0] or '"' in t


def test_nested_schemas(spark):
    schema = {"user": ({"name": ("string", True), "age": ("integer", False)}, True), "tags": ([("a", "b")], False),
              "points": ([{"x": ("number", True)}], False), "mode": (("fast", "slow", 3), False)}
    texts = ['{"user": {"name": "n", "age": 1e1}, "tags": ["a", "b"], "points": [{"x": 1.5}], "mode": 3}',
             '{"user": {"age": 1.5, "other": null}, "tags": ["a", "c", 1], "points": [{"x": 1}, {}, 5], "mode": "no"}',
             '{"user": [], "tags": "a", "points": {}}', '{"user": {"name": "n"}, "mode": "slow"}', "{}", "[]", None, "{"]
    rows = linked(spark, texts, schema)
    want = [[], ["mode: not allowed", "points[1].x: missing", "points[2]: not object", "tags[1]: not allowed", "tags[2]: not allowed",
                 "user.age: not integer", "user.name: missing", "user.other: unknown field"],
            ["points: not array", "tags: not array", "user: not object"], [], ["user: missing"], ["no object"], ["no object"], ["no object"]]
    assert [rows[k].faults for k in range(len(texts))] == want
