import pytest

from keystrata.llm import chat


def run(spark, rows, template=chat.TEMPLATE):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment int")
    out = {}
    for x in sorted(chat.segments(df, template).collect(), key=lambda x: (x["conv_id"], x["segment"])):
        out.setdefault(x["conv_id"], []).append((x["text"], x["loss"], x["error"]))
    return out


def test_all_cases(spark):
    good = [(1, 5, "assistant", "hi", 0), (1, 1, "system", "be", 0), (1, 3, "user", "", 0)]
    cases = {
        2: [("user", "a")], 3: [("assistant", "a")], 4: [("user", "a"), ("user", "b"), ("assistant", "c")], 5: [("user", "a"), ("tool", "b")],
        6: [("user", None), ("assistant", "c")], 7: [("user", "a"), ("system", "b"), ("assistant", "c")], 8: [(None, "a")],
    }
    rows = good + [(c, i, r, t, 0) for c, turns in cases.items() for i, (r, t) in enumerate(turns)]
    rows += [(9, 1, "user", "a", 0), (9, 1, "user", "a", 0), (10, None, "user", "a", 0), (10, 1, "assistant", "b", 0), (None, 1, "user", "x", 0)]
    got = run(spark, rows)
    assert got.pop(1) == [("<|system|>\n", False, None), ("be<|end|>\n", False, None), ("<|user|>\n", False, None), ("<|end|>\n", False, None), ("<|assistant|>\n", False, None), ("hi<|end|>\n", True, None)]
    assert {c: [x[2] for x in v] for c, v in got.items()} == {
        2: ["unfinished"], 3: ["out of order"], 4: ["out of order"], 5: ["unknown role"], 6: ["null text"], 7: ["out of order"], 8: ["unknown role"], 9: ["repeated turn"], 10: ["null turn"],
    }
    assert run(spark, []) == {}


def test_another_template(spark):
    t = {"start": "q", "ends": ["q"], "moves": {"q": {"ask": "a"}, "a": {"tool": "a", "reply": "q"}}, "roles": {r: {"open": f"[{r}]", "close": "", "loss": r == "reply"} for r in ("ask", "tool", "reply")}}
    got = run(spark, [(1, 1, "ask", "x", 0), (1, 2, "tool", "y", 0), (1, 3, "tool", "y", 0), (1, 4, "reply", "z", 0), (2, 1, "reply", "z", 0)], t)
    assert "".join(x[0] for x in got[1]) == "[ask]x[tool]y[tool]y[reply]z" and got[2][0][2] == "out of order"


def test_templates_are_checked():
    with pytest.raises(ValueError):
        chat.validated(chat.TEMPLATE | {"ends": ["nowhere"]})
    with pytest.raises(ValueError):
        chat.validated(chat.TEMPLATE | {"roles": {}})


def test_long_texts_and_clashing_names(spark):
    df = spark.createDataFrame([("c", 1, "user", "x" * 3_000_000, "q"), ("c", 2, "assistant", "", "q")], "conv_id string, turn int, role string, text string, ROLE string")
    out = sorted(chat.segments(df).collect(), key=lambda x: x["segment"])
    assert [len(x["text"]) for x in out] == [9, 3_000_000 + 8, 14, 8] and {x["conv_id"] for x in out} == {"c"}
