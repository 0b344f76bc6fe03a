"""The chat layer: providers, cached and limited calls, questions over retrieved context. A provider is a function from messages to text."""

from __future__ import annotations

import json
import time
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators import history, inference, quality
from lumenfold.plans.engine import Engine

Messages = list[dict[str, str]]
Provider = Callable[[Messages], str]
# How much of a file or snippet is sent, and how many steps an investigation takes.
FILE_CHARS, STEPS = 8000, 6


class LimitExceeded(Exception):
    def __init__(self, retry_after: float):
        super().__init__(f"rate limit exceeded, retry after {retry_after:.1f} s")
        self.retry_after = retry_after


@dataclass
class Scripted:
    """A provider for tests: gives its replies in order, then repeats a plain one; keeps what it was sent."""

    replies: deque[str] = field(default_factory=deque)
    plain: str = "ok"
    sent: list[Messages] = field(default_factory=list)

    def __call__(self, messages: Messages) -> str:
        self.sent.append(messages)
        return self.replies.popleft() if self.replies else self.plain


@dataclass
class Limiter:
    """Admits calls by history.admit; blocking waits, otherwise a call too many raises."""

    rpm: int = 0
    tpm: int = 0
    blocking: bool = False
    clock: Callable[[], float] = time.monotonic
    held: list[tuple[float, int]] = field(default_factory=list)
    rejected: int = 0

    def acquire(self, tokens: int = 0) -> None:
        while True:
            got, self.held = history.admit([self.clock()], [tokens], self.rpm, self.tpm, held=self.held)
            if got[0][0]:
                return
            if not self.blocking:
                self.rejected += 1
                raise LimitExceeded(got[0][1])
            time.sleep(min(got[0][1], 1.0))

    def record_usage(self, tokens: int) -> None:
        """The last call's estimate becomes what it used."""
        if self.held:
            self.held[-1] = (self.held[-1][0], tokens)

    def stats(self) -> dict[str, int]:
        now = self.clock()
        live = [x for x in self.held if x[0] > now - history.LIMIT_SECONDS]
        return {"rpm": len(live), "tpm": sum(x[1] for x in live), "rejected": self.rejected}


def cached(provider: Provider, cache: history.AnswerCache | None = None, limiter: Limiter | None = None, clock: Callable[[], float] = time.time) -> Provider:
    """A provider that first looks for the same request in the cache, then asks for a place in the limit."""

    def call(messages: Messages) -> str:
        key = sha256("\n".join(f"{m['role']}:{m['content']}" for m in messages).encode()).hexdigest()
        found = cache.get(key, clock()) if cache is not None else None
        if found is not None:
            return found
        if limiter is not None:
            limiter.acquire(sum(max(1, len(m["content"]) // 4) for m in messages))
        out = provider(messages)
        if limiter is not None:
            limiter.record_usage(max(1, len(out) // 4))
        if cache is not None:
            cache.put(key, out, clock())
        return out

    return call


def rerank_with(hits: DataFrame, query: str, score: Callable[[str, list[str]], list[float]], most: int = 100, chars: int = 500) -> DataFrame:
    """The `most` best of ranked hits (key, content, score) scored anew on their first characters, in the tasks that hold them."""

    def load():
        return lambda queries, texts: score(queries[0], texts)

    rows = hits.orderBy(F.desc("score"), "key").limit(most).withColumns({"_query": F.lit(query), "_text": F.substring("content", 1, chars)})
    return inference.scored(rows, ["_query", "_text"], load, "_new").withColumn("score", F.col("_new")).drop("_new", "_query", "_text").orderBy(F.desc_nulls_last("score"), "key")


def parsed(reply: str) -> dict:
    """A reply's JSON object, fenced or not; as text where it has none."""
    a, b = reply.find("{"), reply.rfind("}")
    try:
        return json.loads(reply[a : b + 1]) if 0 <= a < b else {"text": reply}
    except json.JSONDecodeError:
        return {"text": reply}


@dataclass
class Reasoner:
    """Questions about an engine's corpus, answered by a provider from retrieved context."""

    engine: Engine
    provider: Provider

    def _chat(self, system: str, user: str) -> str:
        return self.provider([{"role": "system", "content": system}, {"role": "user", "content": user}])

    def _file(self, path: str) -> str:
        row = self.engine.files.where(F.col("file_path") == path).select(F.substring("content", 1, FILE_CHARS).alias("c")).first()
        if row is None:
            raise KeyError(f"no file {path}")
        return row.c

    def ask(self, question: str, k: int = 5, mode: str = "hybrid") -> str:
        head, *rest = self.engine.prompt(question, "answer", k=k, mode=mode).split("\n\n", 1)
        return self._chat(head, "".join(rest))

    def review(self, path: str) -> dict:
        """The provider's findings, with the unsafe lines that the patterns find."""
        unsafe = quality.unsafe_lines(self.engine.files.where(F.col("file_path") == path)).select("line_number", "pattern").collect()
        reply = parsed(self._chat("Review this file. Reply as JSON with issues and summary.", self._file(path)))
        return reply | {"unsafe": [(r.line_number, r.pattern) for r in unsafe]}

    def refactor(self, path: str, instruction: str = "Improve quality, readability and speed.") -> dict:
        return parsed(self._chat(f"{instruction} Reply as JSON with refactored_code and explanation.", self._file(path)))

    def suggest(self, target: str, k: int = 5) -> dict:
        found = self.engine.explain(target).limit(k).collect()
        context = "\n".join(r.summary for r in found) or self.engine.prompt(target, "answer", k=k, mode="keyword")
        return parsed(self._chat("Suggest improvements. Reply as JSON with suggestions.", context))

    def generate(self, request: str, k: int = 5) -> str:
        return self._chat("Write code for the request in the style of the context.", self.engine.prompt(request, "answer", k=k))

    def investigate(self, question: str, steps: int = STEPS) -> tuple[str, list[tuple[str, str, str]]]:
        """(conclusion, steps): the provider chooses an action (search, symbol, dependencies, conclude) until it concludes or the steps run out."""
        done: list[tuple[str, str, str]] = []
        for _ in range(steps):
            log = "\n".join(f"{a}({x}): {o}" for a, x, o in done)
            reply = parsed(self._chat("Choose the next step. Reply as JSON with action (search, symbol, dependencies, conclude) and input.", f"{question}\n{log}"))
            action, what = reply.get("action", "conclude"), str(reply.get("input", reply.get("text", "")))
            if action == "conclude":
                return what, done
            done.append((action, what, self._act(action, what)))
        log = "\n".join(o for _, _, o in done)
        return self._chat("Conclude from these findings.", f"{question}\n{log}"), done

    def _act(self, action: str, what: str) -> str:
        if action == "search":
            rows = self.engine.keyword_search(what, 5).select("file_path", "start_line").collect()
            return "; ".join(f"{r.file_path}:{r.start_line}" for r in rows)
        if action == "symbol":
            return "; ".join(r.summary for r in self.engine.explain(what).limit(5).collect())
        if action == "dependencies":
            return "; ".join(r.import_text for r in self.engine.dependencies(what).limit(20).collect())
        return f"unknown action {action}"

    def stream(self, question: str, words: Callable[[str], str] | None = None) -> Iterator[dict[str, str]]:
        """start, one event a word, done; words may change each of them on its way."""
        yield {"kind": "start", "content": ""}
        text = self.ask(question, mode="keyword")
        for i, w in enumerate(text.split(" ")):
            token = (" " if i else "") + w
            yield {"kind": "token", "content": words(token) if words else token}
        yield {"kind": "done", "content": text}


def budget_left(iterations: int, tokens: int, began: float, most_iterations: int, most_tokens: int, most_seconds: float, now: float | None = None) -> bool:
    """Whether a loop may go on."""
    return iterations < most_iterations and tokens < most_tokens and (time.time() if now is None else now) - began < most_seconds
