from __future__ import annotations

import json

import numpy as np

from scriptorium.llm import ann, chat_format
from scriptorium.llm.components import components


def test_components(spark):
    chain = [(k, k + 1) for k in range(30)] + [(100, 102), (102, 101), (7, 7)] + [(200, k) for k in range(201, 260)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert all(got[k] == 0 for k in range(31)) and all(got[k] == 100 for k in (100, 101, 102)) and all(got[k] == 200 for k in range(200, 260))
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 16))
    x[100:140] = x[100]  # copies: ties go to the smaller id
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(1000, None, 1), (1020, [0.0] * 16, 1), (1040, [float("nan")] * 16, 1), (1060, [None] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got: dict[int, list] = {}
    for r in sorted(ann.nearest_neighbours(df, 20, 20).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 600, 20))
    hit = 0
    for q, found in got.items():
        score = (x * x[q]).sum(1)
        others = np.array([i for i in range(600) if i != q])
        want = others[np.lexsort((others, -score[others]))[:20]]
        hit += len({f[0] for f in found} & set(want.tolist()))
        assert all(s == score[v] for v, s in found) and found == sorted(found, key=lambda f: (-f[1], f[0])) and len(found) == 20
    assert hit >= 0.9 * 20 * len(got)
    assert ann.nearest_neighbours(df.limit(0)).count() == 0
    assert ann.nearest_neighbours(df.filter("vec_id in (0, 1)")).count() == 1


def test_neighbours_on_full_blocks_without_clusters(spark):
    rng = np.random.default_rng(1)
    for spread in (0.0, 1.0):  # equal and mixed norms
        x = rng.standard_normal((8200, 64))
        x *= rng.lognormal(0, spread, (len(x), 1)) / np.sqrt((x * x).sum(1, keepdims=True))
        x[7] *= 20
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got: dict[int, list] = {}
        for r in sorted(ann.nearest_neighbours(df, 20, 200).collect(), key=lambda r: (r.query_id, r["rank"])):
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert sorted(got) == list(range(0, len(x), 200))
        for q, found in got.items():
            score = (x * x[q]).sum(1)
            score[q] = -np.inf
            assert found == np.lexsort((np.arange(len(x)), -score))[:20].tolist()


def test_chats(spark):
    calls = [{"id": "a", "name": "search", "arguments": {"query": "x", "limit": 3}}, {"id": "b", "name": "search", "arguments": {"z": 1, "limit": "no"}}, {"id": "c", "name": "nope", "arguments": {}}]
    rows = [
        (1, 0, "User ", "hi"), (1, 1, "assistant", json.dumps({"content": "let me", "tool_calls": calls})), (1, 0, "tool", json.dumps({"tool_call_id": "a", "content": "found"})),
        (1, 3, "tool", json.dumps({"tool_call_id": "zz", "content": "orphan"})), (2, 0, None, None), (None, 1, "tool", '{"tool_call_id":"a"}'), (3, 0, "assistant", "{bad json"),
    ]
    got = {(r.conv_id, r.turn, r.role): r for r in chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert len(got) == len(rows)
    caller, result = got[1, 1, "assistant"], got[1, 0, "tool"]
    assert (caller.n_calls, caller.n_linked, caller.n_invalid) == (3, 1, 2)
    assert caller.problems == "b=missing:query,type:limit,unknown:z;c=unknown tool"
    assert (result.order_turn, result.order_step, result.linked) == (1, 1, True) and not got[1, 3, "tool"].linked and not got[None, 1, "tool"].linked
    assert json.loads(caller.json)["tool_calls"][1]["arguments"] == {"limit": "no", "z": 1} and '"arguments":{"limit":3,"query":"x"}' in caller.json
    assert got[3, 0, "assistant"].kind == "message" and got[2, 0, "unknown"].json == '{"content":"","role":"unknown"}'
    assert chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


def test_problems_of_calls_without_an_identifier(spark):
    calls = [{"id": None, "name": "nope", "arguments": {}}, {"name": "search", "arguments": {}}, {"id": "a=b", "name": "lookup", "arguments": {"key": "x"}}]
    df = spark.createDataFrame([(1, 0, "assistant", json.dumps({"tool_calls": calls}))], "conv_id long, turn int, role string, text string")
    got = chat_format.format_chats(df).first()
    assert (got.n_calls, got.n_invalid, got.problems) == (3, 2, "unknown tool;missing:query")


def test_windows_alone_find_nine_in_ten(spark):
    rng = np.random.default_rng(3)
    for n, spread in ((10_000, 0.0), (10_000, 1.0)):
        x = rng.standard_normal((n, 64))
        x *= rng.lognormal(0, spread, (n, 1)) / np.sqrt((x * x).sum(1, keepdims=True))
        block, asked = ann.Block(np.arange(n), x), np.arange(0, n, 250)
        hit = 0
        for q, (ids, _, _) in zip(asked, block.nearest(asked, x[asked], 20, check=False), strict=True):
            score = x @ x[q]
            score[q] = -np.inf
            hit += len(set(ids.tolist()) & set(np.argsort(-score)[:20].tolist()))
        assert hit >= 0.9 * 20 * len(asked)


def test_neighbours_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((60, 8))
    x[5] *= 1e200
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(20, x[20].tolist())] * 3 + [(100, [1.0] * 9), (None, [1.0] * 8), (120, [])] + [(7, x[7].tolist())] * 5000
    df = spark.createDataFrame([(*r, 0, 1.0) for r in rows], "vec_id long, embedding array<double>, query_id int, score double")
    got = ann.nearest_neighbours(df, 20, 20).collect()
    assert {r.query_id for r in got} == {0, 20, 40} and all(np.isfinite(r.score) or abs(r.score) == np.inf for r in got)
    assert sorted(r["rank"] for r in got if r.query_id == 0) == list(range(1, 21))
    # equal rows are candidates each; four rows of one key ask each for itself
    assert len([r for r in got if r.query_id == 20]) == 80 and not any(r.vec_id == r.query_id for r in got)
    nearest = {r.vec_id for r in got if r.query_id == 0}
    best = max((float((x[0] * x[i]).sum()), i) for i in range(1, 60))[1]
    assert best in nearest


def test_calls_of_either_form_keep_all_keys(spark):
    calls = [{"id": 7, "type": "function", "function": {"name": "search", "arguments": "{\"query\": \"x\", \"limit\": 2}", "strict": True}}, {"id": "b", "name": "search", "arguments": "no json", "extra": [1]}]
    rows = [
        (1, 0, "assistant", json.dumps({"tool_calls": calls, "content": None, "model": "m"}), 1, "z"), (1, 1, "tool", json.dumps({"tool_call_id": 7, "content": {"a": [1, None]}, "name": "search"}), 1, "z"),
        (1, 1, "tool", json.dumps({"tool_call_id": 7, "content": {"a": [1, None]}, "name": "search"}), 1, "z"), (2, 0, "user", "x" * 300_000, 1, "z"), (2, 1, " ", '{"no": "calls"}', 1, "z"),
    ]
    got = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, kind int, json string")).collect()
    assert len(got) == 5
    caller = next(r for r in got if r.kind == "call")
    assert (caller.n_calls, caller.n_linked, caller.problems) == (2, 1, "b=missing:query")
    told = json.loads(caller.json)
    assert told == {"content": None, "model": "m", "role": "assistant", "tool_calls": [{"arguments": {"limit": 2, "query": "x"}, "id": 7, "name": "search", "strict": True, "type": "function"}, {"arguments": "no json", "extra": [1], "id": "b", "name": "search"}]}
    assert list(told) == sorted(told) and caller.json.index('"limit"') < caller.json.index('"query"')
    results = [r for r in got if r.kind == "result"]
    assert len(results) == 2 and all(r.linked and json.loads(r.json) == {"content": {"a": [1, None]}, "name": "search", "role": "tool", "tool_call_id": 7} for r in results)
    assert {r.role: r.json for r in got if r.turn == 1 and r.conv_id == 2} == {"unknown": '{"content":"{\\"no\\": \\"calls\\"}","role":"unknown"}'}


def test_random_chats_are_linked_as_by_hand(spark):
    rng = np.random.default_rng(8)
    rows, calls, results = [], {}, {}
    for conv in range(40):
        for turn in range(12):
            way, name = rng.integers(3), f"c{rng.integers(8)}"
            if way == 0:
                rows.append((conv, turn, "assistant", json.dumps({"tool_calls": [{"id": name, "name": "calculate", "arguments": {"expression": "1"}}]})))
                calls.setdefault((conv, name), turn)
            elif way == 1:
                rows.append((conv, turn, "tool", json.dumps({"tool_call_id": name, "content": "x"})))
                results.setdefault((conv, name), turn)
            else:
                rows.append((conv, turn, "user", "hello"))
    got = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.kind == "result":
            first = calls.get((r.conv_id, r.call_id))
            assert r.linked == (first is not None) and r.order_turn == max(r.turn, first if first is not None else r.turn) and r.order_step == 1
        if r.kind == "call":
            name = json.loads(r.json)["tool_calls"][0]["id"]
            assert r.n_linked == int((r.conv_id, name) in results and calls[r.conv_id, name] == r.turn) and r.n_invalid == 0
