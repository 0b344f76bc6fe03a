from collections import deque

import pytest

from lumenfold.operators import history
from lumenfold.plans import agent
from lumenfold.plans.engine import Engine

FILES = [("core.py", "import os\n\n\ndef helper():\n    return 1\n\n\ndef compute(x):\n    return helper() + eval(x)\n")]


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark, spark.createDataFrame(FILES, "file_path string, content string"))
    yield e
    e.close()


def test_reasoner(engine):
    bot = agent.Scripted(deque(["see [1]", '```json\n{"issues": [], "summary": "fine"}\n```', '{"refactored_code": "x"}', "no json", '{"action": "search", "input": "helper"}', '{"action": "symbol", "input": "compute"}', '{"action": "conclude", "input": "done"}']))
    r = agent.Reasoner(engine, bot)
    assert r.ask("what does helper return?", mode="keyword") == "see [1]" and "helper" in bot.sent[0][1]["content"]
    assert r.review("core.py") == {"issues": [], "summary": "fine", "unsafe": [(9, 3)]}
    assert r.refactor("core.py") == {"refactored_code": "x"} and r.suggest("compute") == {"text": "no json"}
    said, steps = r.investigate("why?")
    assert said == "done" and [s[0] for s in steps] == ["search", "symbol"] and "core.py" in steps[0][2] and steps[1][2].startswith("Function `compute(x)`")
    assert [e["kind"] for e in r.stream("helper")] == ["start", "token", "done"]
    with pytest.raises(KeyError):
        r.review("none.py")


def test_cached_and_limited_provider(spark, tmp_path):
    now = [0.0]
    bot, limit = agent.Scripted(deque(["one", "two", "three"])), agent.Limiter(rpm=2, clock=lambda: now[0])
    ask = agent.cached(bot, history.AnswerCache(spark, str(tmp_path)), limit, clock=lambda: now[0])
    msg = lambda x: [{"role": "user", "content": x}]
    assert [ask(msg("a")), ask(msg("a")), ask(msg("b"))] == ["one", "one", "two"] and limit.stats() == {"rpm": 2, "tpm": 2, "rejected": 0}
    with pytest.raises(agent.LimitExceeded):
        ask(msg("c"))
    now[0] = 60.0
    assert ask(msg("c")) == "three" and limit.stats()["rejected"] == 1
    assert agent.budget_left(1, 10, 0.0, 2, 20, 5.0, 4.0) and not agent.budget_left(2, 10, 0.0, 2, 20, 5.0, 4.0)


def test_rerank_with_a_model(spark):
    hits = spark.createDataFrame([("a", "long text", 0.9), ("b", "x", 0.1)], "key string, content string, score double")
    assert [r.key for r in agent.rerank_with(hits, "q", lambda q, ts: [-len(t) for t in ts]).collect()] == ["b", "a"]
