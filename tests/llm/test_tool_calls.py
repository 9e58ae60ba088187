import json
import random

from labelspark.llm import tool_calls
from labelspark.llm.queries import QUERIES

SCHEMAS = {"f": {"s": ("string", True), "n": ("number", False), "i": ("integer", False), "o": ("object", False), "l": ("array", False),
                 "b": ("boolean", False)}, "g": {}}


def linked(spark, calls, results):
    c = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string").selectExpr("*", "1 AS level", "2 AS row")
    r = spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string").selectExpr("*", "1 AS position", "2 AS errors")
    return tool_calls.link_tool_calls(c, r, SCHEMAS).collect()


def test_links_levels_and_positions(spark):
    calls = [(1, 1, "a", "f", '{"s": "x"}'), (1, 2, "b", "f", '{"s": {"$ref": "a"}, "o": {"$ref":"a"}}'), (1, 3, "c", "g", '{}'),
             (1, 4, "a", "f", '{"s": "second of the id"}'), (1, 5, "d", "g", '{"x": {"$ref": "b"}, "y": {"$ref": "c"}}'),
             (1, 6, "e", "g", '{"x": {"$ref": "none"}}'), (1, 7, "h", "g", '{"x": {"$ref": "k"}}'), (1, 8, "k", "g", '{"x": {"$ref": "h"}}'),
             (None, 1, "a", "g", "{}"), (2, 1, None, "g", "{}"), (2, 2, None, None, None)]
    results = [(1, 9, "a", "two"), (1, 3, "a", "one"), (1, 9, "b", None), (1, 9, "zz", "lost"), (None, 2, "a", "n"), (2, 5, None, "no id")]
    rows = linked(spark, calls, results)
    by = {(r.conv_id, r.call_turn, r.call_id): r for r in rows}
    assert len(rows) == len(calls) + 2
    assert (by[1, 1, "a"].result_turn, by[1, 4, "a"].result_turn) == (3, 9)
    assert by[None, 1, "a"].status == "linked" and by[2, 1, None].status == "unanswered" and by[1, 3, "c"].status == "unanswered"
    assert [r.status for r in rows if r.call_turn is None] == ["orphan"] * 2
    assert [by[1, t, i].level for t, i in ((1, "a"), (2, "b"), (3, "c"), (5, "d"), (6, "e"), (7, "h"))] == [0, 1, 0, 2, None, None]
    assert "reference is missing or circular" in by[1, 6, "e"].errors and "reference is missing or circular" in by[1, 8, "k"].errors
    order = [r.call_turn for r in sorted((r for r in rows if r.conv_id == 1), key=lambda r: r.position)]
    assert order == [1, 3, 4, 2, 5, 6, 7, 8, None]
    for conv in (1, 2, None):
        assert sorted(r.position for r in rows if r.conv_id == conv) == list(range(sum(r.conv_id == conv for r in rows)))


ERRORS = [
    ("f", '{"s":"x","n":1.5,"i":3,"o":{},"l":[],"b":true}', []),
    ("f", '{}', ["s is missing"]),
    ("f", '{"s":null}', ["s is no string"]),
    ("f", '{"s":"x","i":1.5}', ["i is no integer"]),
    ("f", '{"s":"x","i":"1","l":{},"o":[],"b":0,"n":"y"}', ["n is no number", "i is no integer", "o is no object", "l is no array", "b is no boolean"]),
    ("g", '{"s":"x"}', ["unknown parameter"]),
    ("h", '{}', ["unknown tool"]), (None, '{}', ["unknown tool"]),
    ("g", 'no json', ["arguments are no object"]), ("g", None, ["arguments are no object"]), ("g", '[1]', ["arguments are no object"]),
    ("g", '{"a":1,"a":2}', ["arguments are no object", "unknown parameter"]),
]


def test_errors(spark):
    rows = linked(spark, [(i, 1, "a", name, arguments) for i, (name, arguments, _) in enumerate(ERRORS)], [])
    got = {r.conv_id: r.errors for r in rows}
    for i, (_, arguments, errors) in enumerate(ERRORS):
        assert got[i] == errors or (arguments == '{"a":1,"a":2}' and got[i][0] == errors[0])


FORMS = [
    ("1000", "1000"), ("1e3", "1000"), ("1.0E+3", "1000"), ("1.0", "1"), ("-0", "0"), ("-0.0e5", "0"), ("0.1e-7", "0.00000001"), ("1.50", "1.5"),
    ("123456789012345678901234567890", "123456789012345678901234567890"), ("-12.5e1", "-125"), ("0.10", "0.1"), ("1e39", "1" + "0" * 39), ("1e40", "1e40"),
    ("1e41", "1e41"), ("12e400", "1.2e401"), ("1.25e-60", "1.25e-60"), ("1" * 60, "1." + "1" * 59 + "e59"), ("100e-2", "1"), ("5E-1", "0.5"),
    ("1e99999999999999999999", "1e99999999999999999999"),
]


def test_one_form_for_numbers(spark):
    rows = linked(spark, [(i, 1, "a", "g", f'{{"x": {w}, "y": [{w}], "z": "{w}"}}') for i, (w, _) in enumerate(FORMS)], [])
    got = {r.conv_id: r.record for r in rows}
    for i, (written, form) in enumerate(FORMS):
        assert got[i] == f'{{"arguments":{{"x":{form},"y":[{form}],"z":"{written}"}},"id":"a","name":"g","result":null}}'


def test_integers(spark):
    values = [("3", True), ("1.0", True), ("1e3", True), ("9" * 30, True), ("9" * 60, True), ("1e500", True), ("1.5", False), ("1e-1", False),
              ('"3"', False), ('"\\u0001#3"', False), ("true", False), ("null", False)]
    rows = linked(spark, [(i, 1, "a", "f", f'{{"s": "x", "i": {v}}}') for i, (v, _) in enumerate(values)], [])
    assert {r.conv_id: r.errors for r in rows} == {i: [] if whole else ["i is no integer"] for i, (_, whole) in enumerate(values)}


def test_no_object(spark):
    texts = ['{1: 2}', '{"a": 01}', '{"a": 1.}', '{"a": -}', '{"a": +1}', '{"a": 1 2}', '{"a": .5}', '{"a": 1e}', "1", '"x"', "[1]", "{", '{"a": "\n"}']
    rows = linked(spark, [(i, 1, "a", "g", t) for i, t in enumerate(texts)], [])
    assert all(r.errors[0] == "arguments are no object" for r in rows) and len(rows) == len(texts)


def test_strings_that_look_like_marks(spark):
    arguments = {"\x01#5": "\x01#5", "a": '"\x01#7"', "b": "\x01", "c": '\\"\x01#8" 12', "d": 12, "e\x01#": ["\x01\x01#9", 3.5]}
    (row,) = linked(spark, [(1, 1, "a", "g", json.dumps(arguments))], [(1, 2, "a", "\x01#6")])
    got = json.loads(row.record)
    assert got["arguments"] == arguments and got["result"] == "\x01#6"


def test_identifiers_of_any_characters(spark):
    names = ['c\\d', 'a"b', "tab\t", "line\n", "\x01#1", "\x1f", "ü😀", "{x}", '","$ref":"', "a/b", " ", "\u2028"]
    calls = [(1, i, n, "g", "{}") for i, n in enumerate(names)]
    calls += [(1, 100 + i, f"r{i}", "g", json.dumps({"x": {"$ref": n}, "note": json.dumps({"$ref": "none"})}, ensure_ascii=i % 2 == 0)) for i, n in enumerate(names)]
    calls += [(1, 200, "n", "g", '{"x": {"$ref": 5}, "y": {"$ref": "a", "z": 1}}')]
    rows = {r.call_turn: r for r in linked(spark, calls, [])}
    assert all(rows[100 + i].level == 1 and "reference is missing or circular" not in rows[100 + i].errors for i in range(len(names)))
    assert rows[200].level == 0


def test_canonical_record(spark):
    arguments = ' {"z": [1, {"b": "ü\\n", "a": null}],  "a": {"d": 1.50, "c": true}} '
    (row,) = linked(spark, [(1, 1, "id", "g", arguments)], [(1, 2, "id", 'say "hi"')])
    assert json.loads(row.record) == {"arguments": json.loads(arguments), "id": "id", "name": "g", "result": 'say "hi"'}
    assert row.record == json.dumps(json.loads(row.record), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    long = json.dumps({"s": "x" * 300_000})
    (row,) = linked(spark, [(1, 1, "id", "f", long)], [])
    assert json.loads(row.record)["arguments"] == json.loads(long) and json.loads(row.record)["result"] is None


def test_repeated_rows_and_empty_tables(spark):
    rows = linked(spark, [(1, 1, "a", "g", "{}")] * 3, [(1, 2, "a", "r")] * 2)
    assert sorted((r.occurrence, r.status) for r in rows) == [(0, "linked"), (1, "linked"), (2, "unanswered")]
    assert linked(spark, [], []) == [] and [r.status for r in linked(spark, [], [(1, 1, "a", "r")])] == ["orphan"]


def test_query_equals_a_plain_reading(spark):
    folder = "/root/testdata/sf0.001"
    turns = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    calls = {(c, t): text for c, t, role, text in turns if role == "user" and text is not None}
    answers = {(c, t - 1): text for c, t, role, text in turns if role == "assistant"}
    rows = QUERIES["op4_tool_calls"](spark, folder).collect()
    assert len(rows) == len(calls.keys() | answers.keys())

    def level(c, t):
        if t <= 1:
            return 0
        below = level(c, t - 2) if (c, t - 2) in calls else None
        return None if below is None else below + 1

    for r in rows:
        c, t = r.conv_id, int(r.call_id.split("-")[1])
        assert r.status == ("linked" if (c, t) in calls and (c, t) in answers else "unanswered" if (c, t) in calls else "orphan")
        if (c, t) in calls:
            text = calls[c, t]
            tool = ["search", "fetch", "note"][len(text) % 3]
            want = {"query": text, "limit": str(len(text)) if len(text) % 11 == 0 else len(text)}
            if t > 1:
                want["after"] = {"$ref": f"c{c}-{t - 2}"}
            whole = {"arguments": want, "id": r.call_id, "name": tool, "result": answers.get((c, t))}
            assert r.record == json.dumps(whole, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            assert r.level == level(c, t)
            assert ("unknown parameter" in r.errors) == (tool == "note")
            assert ("limit is no integer" in r.errors) == (tool != "note" and len(text) % 11 == 0)


def test_query_keeps_turns_without_text_and_long_conversations(spark, tmp_path):
    turns = [(1, t, "user" if t % 2 == 0 else "assistant", None if t in (4, 5) else f"text {t}") for t in range(60)]
    turns += [(2, 0, "user", None), (2, 1, "assistant", "an answer")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    rows = {(r.conv_id, r.call_turn): r for r in QUERIES["op4_tool_calls"](spark, str(tmp_path)).collect()}
    assert sorted(rows) == [(1, t) for t in range(0, 60, 2)] + [(2, 0)]
    assert all(r.status == "linked" and r.result_turn == r.call_turn + 1 for r in rows.values())
    assert [rows[1, t].level for t in range(0, 60, 2)] == list(range(30)) == [rows[1, t].position for t in range(0, 60, 2)]
    assert json.loads(rows[1, 4].record) == {
        "arguments": {"query": None, "limit": None, "after": {"$ref": "c1-2"}}, "id": "c1-4", "name": None, "result": None}
    assert rows[1, 4].errors == rows[2, 0].errors == "unknown tool" and rows[2, 0].name is None


def test_levels_of_chains_and_branches_equal_a_plain_walk(spark):
    rng, n = random.Random(4), 160
    refs = {i: [] if i % 23 == 0 else [i - 1] if i % 7 else sorted({i - 1, rng.randrange(i), rng.randrange(i)}) for i in range(n)}
    refs |= {200: [201], 201: [202], 202: [200], 203: [202], 204: [204], 205: [150, 203], 206: [999], 207: [206], 208: [207, 3]}
    want = {}
    for _ in range(n):
        for i, of in refs.items():
            if all(want.get(x) is not None for x in of):
                want[i] = 1 + max((want[x] for x in of), default=-1)
    calls = [(1, i, f"c{i}", "g", json.dumps({f"p{k}": {"$ref": f"c{x}"} for k, x in enumerate(of)})) for i, of in refs.items()]
    assert {r.call_turn: r.level for r in linked(spark, calls, [])} == {i: want.get(i) for i in refs}


def test_long_chains_take_few_rounds(spark, monkeypatch):
    written = []
    write = tool_calls.write_table
    monkeypatch.setattr(tool_calls, "write_table", lambda df, name: written.append(name) or write(df, name))
    calls = [(1, i, f"c{i}", "g", json.dumps({"p": {"$ref": f"c{i - 1}"}} if i else {})) for i in range(300)]
    assert [r.level for r in sorted(linked(spark, calls, []), key=lambda r: r.call_turn)] == list(range(300))
    assert len(written) < 25
