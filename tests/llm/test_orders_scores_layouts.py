"""Orders of linked messages, exact scores at any size, and layouts of pages, against plain Python."""

import json
import random

import numpy as np
import pytest

from windrow.llm import chat, html_text, topk

CHAT = "conv_id long, turn long, role string, text string"


def test_messages_in_topological_order(spark):
    """Chains, trees and rings of messages that both answer and call, some before their calls, against a walk along the links."""
    rng = random.Random(3)
    rows = []
    for conv in range(40):
        n = rng.randrange(2, 14)
        for i in range(n):
            answers = rng.choice([None, None, *range(n)]) if conv % 4 else (i + 1) % n  # every fourth conversation is one ring
            body = {"content": f"{conv} {i}", "tool_calls": [{"id": f"m{i}", "name": "f", "arguments": {}}]}
            rows.append((conv, rng.choice([i, i, 3, None]), rng.choice(["assistant", "tool"]), json.dumps(body if answers is None else body | {"tool_call_id": f"m{answers}"})))
    rows += [(100, i, "tool", json.dumps({"content": "", "tool_call_id": f"c{i + 1}", "tool_calls": [{"id": f"c{i}", "name": "f"}]})) for i in range(60)]  # a chain that runs backwards
    rng.shuffle(rows)
    got = chat.format_chats(spark.createDataFrame(rows + rows[:5], CHAT)).collect()
    assert len(got) == len(rows) + 5
    for conv in {r[0] for r in rows}:
        own = sorted({r for r in rows if r[0] == conv}, key=lambda r: (r[1] is not None, r[1] or 0, r[2], json.loads(r[3])["content"], r[3]))
        body = [json.loads(r[3]) for r in own]
        makes = {c["id"]: i for i, b in enumerate(body) for c in b["tool_calls"]}
        up = [makes.get(b.get("tool_call_id")) for b in body]

        def ring(i, up=up):
            at = up[i]
            for _ in up:
                if at is None or at == i:
                    break
                at = up[at]
            return at == i

        up = [None if ring(i) else u for i, u in enumerate(up)]

        def key(i, up=up):
            line, at = [], i
            while at is not None:
                line.append(at)
                at = up[at]
            return max(line), line.index(max(line)), i

        want = [body[i]["content"] + str(body[i].get("tool_call_id")) for i in sorted(range(len(own)), key=key)]
        placed = sorted((r for r in got if r["conv_id"] == conv), key=lambda r: r["position"])
        assert [r["position"] for r in placed] == list(range(len(placed)))
        mine = [json.loads(r["json"]) for r in placed]
        names = list(dict.fromkeys(m["content"] + str(m.get("tool_call_id")) for m in mine))
        if conv != 100:  # there all contents are empty
            assert len(names) == len(set(want)) and [x for x in dict.fromkeys(want)] == names
        else:
            assert list(dict.fromkeys(m["tool_calls"][0]["id"] for m in mine)) == [f"c{i}" for i in reversed(range(60))]


def test_tools_without_parameters_and_numbers_beyond_a_double(spark):
    rows = [(1, 0, "assistant", '{"tool_calls":[{"id":"a","name":"now","arguments":{}},{"id":"b","name":"at","arguments":{"t":1e400,"u":"Infinity"}},{"id":"c","name":"at","arguments":{"u":"Infinity"}}]}')]
    df = spark.createDataFrame(rows, CHAT)
    (out,) = chat.format_chats(df, chat.inferred_schemas(df)).collect()
    assert out["problems"] == "a number is beyond a double"
    assert {c["id"]: c["arguments"] for c in json.loads(out["json"])["tool_calls"]}["a"] == {}
    rows = [(1, 0, "assistant", '{"tool_calls":[{"id":"a","name":"now","arguments":{}},{"id":"c","name":"at","arguments":{"u":"Infinity"}}]}')]
    df = spark.createDataFrame(rows, CHAT)
    assert chat.format_chats(df, chat.inferred_schemas(df)).first()["problems"] == ""


def brute(vectors, queries, k):
    whole = {i: [int(c) for c in v] for i, v in vectors}
    width = max(map(len, whole.values()))
    whole = {i: v + [0] * (width - len(v)) for i, v in whole.items()}
    return {(q, r, j, s) for q in queries for r, (s, j) in enumerate([(-s, j) for s, j in sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), j) for j, v in whole.items() if j != q)][:k], 1)}


@pytest.mark.parametrize("size", [1.0, 1e6, 4e6])
def test_products_are_exact_at_any_size(spark, size):
    rng = np.random.default_rng(8)
    x = np.floor(rng.uniform(-1, 1, (400, 5)) * size * 256)
    x[100:180] = x[100]  # copies
    x[200:203] += np.eye(5)[:3]
    vectors = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, []), (1001, [7.0])]
    df = spark.createDataFrame(vectors + vectors[:9], "id long, v array<double>")
    got = topk.top_k(df, df.where("id % 50 = 0"), k=4, page=16)
    assert {tuple(r) for r in got.collect()} == brute(vectors, [i for i, _ in vectors if i % 50 == 0], 4)


def test_scores_beyond_64_bits_few_candidates_and_extra_columns(spark):
    raw = spark.createDataFrame([(1, [1e6 + 1 / 256], "x"), (2, [1e6 + 1 / 256], "y"), (3, None, "z")], "vec_id long, embedding array<double>, score string")
    v = topk.integer_vectors(raw)
    assert sorted(map(tuple, topk.top_k(v, v).collect())) == [(1, 1, 2, 256000001**2), (2, 1, 1, 256000001**2)]
    v = topk.integer_vectors(spark.createDataFrame([(1, [1e17]), (2, [1e17])], "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="too large"):
        topk.top_k(v, v).collect()


def test_bounds_skip_most_products(spark):
    """40 clusters far apart: a query compares little beyond its own."""
    rng = np.random.default_rng(1)
    x = np.repeat(rng.standard_normal((40, 8)) * 3000, 100, axis=0) + rng.standard_normal((4000, 8)) * 10
    df = spark.createDataFrame([(i, np.floor(v).tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    counted = spark.sparkContext.accumulator(0)
    got = topk.top_k(df, df.where("id % 50 = 0"), page=64, counted=counted)
    assert {tuple(r) for r in got.collect()} == brute([(i, np.floor(v)) for i, v in enumerate(x)], range(0, 4000, 50), 5)
    assert 0 < counted.value < 0.35 * 80 * 4000


# pages

PARA = "<p>" + "A sentence of the article, with commas, that goes on for quite a while so that it scores. " * 3 + "</p>"
FOOT = '<footer><a href="/">Home</a> <a href="/a">About</a> copyright</footer>'
NAV = '<nav><a href="/">Home</a><a href="/x">News</a><a href="/y">Sport</a></nav>'


@pytest.mark.parametrize(
    "page, has, lacks",
    [
        (f"<body>{NAV}<form id='aspnetForm'><div><h1>Title</h1>{PARA * 4}</div></form>{FOOT}</body>", ["Title", "sentence"], ["Home", "copyright"]),
        (f"<body>{NAV}<div class='widget'><h1>Title</h1>{PARA * 2}</div><div class='widget'>{PARA * 2}</div>{FOOT}</body>", ["Title", "sentence"], ["Home"]),
        (f"<body>{NAV}<aside>{PARA * 4}</aside>{FOOT}</body>", ["sentence"], ["Home", "copyright"]),
        (f"<body>{NAV}<div class='legal'>{PARA * 4}</div><div>Short line at the foot of the page, all rights reserved.</div></body>", ["sentence"], ["News"]),
        (f"<body>{NAV}<h1>Title</h1><div class='content'>{PARA * 4}</div>{FOOT}</body>", ["Title", "sentence"], ["Home"]),
        (f"<body>{NAV}<div id='main'>{PARA * 3}<p><a href='/1'>first source</a>, <a href='/2'>second source</a>, <a href='/3'>third source</a></p>{PARA}</div>{FOOT}</body>", ["second source"], ["Home"]),
        (f"<body>{NAV}<div role='dialog'>{PARA * 5}</div>{FOOT}</body>", ["sentence"], ["Home"]),
        # what is beside an article still goes
        (f"<body>{NAV}<article><h1>Title</h1>{PARA * 4}</article><aside>{PARA.replace('sentence', 'teaser')}</aside><form><p>Send us your mail, please, today.</p></form>{FOOT}</body>", ["Title", "sentence"], ["teaser", "mail", "Home"]),
        (f"<body><h2>Related</h2><ul><li><a href='/1'>one</a></li><li><a href='/2'>two</a></li></ul><div class='content'>{PARA * 4}</div></body>", ["sentence"], ["one", "two"]),
    ],
)
def test_layouts_keep_the_article(page, has, lacks):
    text = html_text.extract(page)
    assert all(x in text for x in has), text
    assert not any(x in text for x in lacks), text
