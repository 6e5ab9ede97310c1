"""Clients of language models, and what stands around them: retries, limits, fallbacks, clusters, observers. They run in the tasks."""

from __future__ import annotations

import hashlib
import json
import random
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from typing import Any, Protocol

Messages = list[dict[str, str]]

#: Where servers of this interface are found by default.
PRESETS = {"openai": "https://api.openai.com/v1", "vllm": "http://localhost:8000/v1", "bailian": "https://dashscope.aliyuncs.com/compatible-mode/v1"}


class Client(Protocol):
    def generate(self, messages: Messages, **options: object) -> str: ...


def as_messages(prompt: str | Messages) -> Messages:
    return [{"role": "user", "content": prompt}] if isinstance(prompt, str) else prompt


class EchoClient:
    """Answers the same to the same messages, with no network: for tests and dry runs."""

    def __init__(self, answer: Callable[[Messages], str] | None = None, fail_every: int = 0) -> None:
        self.answer, self.fail_every, self.calls = answer, fail_every, 0
        self.lock = threading.Lock()

    def generate(self, messages: str | Messages, **options: object) -> str:
        messages = as_messages(messages)
        with self.lock:
            self.calls += 1
            fails = self.fail_every and self.calls % self.fail_every == 0
        if fails:
            raise RuntimeError("asked to fail")
        last = messages[-1]["content"]
        return self.answer(messages) if self.answer else f"[{hashlib.md5(last.encode()).hexdigest()[:8]}] {last}"


class HashEmbedder:
    """Embeddings without a model or network: each word adds to one of `size` places that its hash names, up or down."""

    def __init__(self, size: int = 64) -> None:
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.size
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % self.size] += 1.0 if h >> 63 else -1.0
            out.append(v)
        return out


class HttpError(RuntimeError):
    """status: of HTTP; retry_after: seconds that the server asks for, or None."""

    def __init__(self, status: int, text: str, retry_after: float | None = None) -> None:
        super().__init__(f"HTTP {status}: {text[:200]}")
        self.status, self.retry_after = status, retry_after


class HttpClient:
    """A server with the chat-completions and embeddings interface, by its base URL or a name among PRESETS. usage: the last call's token counts."""

    def __init__(self, model: str, base_url: str = "openai", api_key: str | None = None, timeout: float = 60.0, **defaults: object) -> None:
        self.model, self.url, self.key, self.timeout, self.defaults = model, PRESETS.get(base_url, base_url).rstrip("/"), api_key, timeout, defaults
        self.usage: dict[str, int] = {}

    def _post(self, path: str, body: dict[str, Any]) -> dict[str, Any]:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(self.url + path, json.dumps(body).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as r:
                return json.load(r)
        except urllib.error.HTTPError as e:
            after = e.headers.get("Retry-After") if e.headers else None
            raise HttpError(e.code, e.read().decode("utf-8", "replace"), float(after) if after and after.replace(".", "", 1).isdigit() else None) from e

    def generate(self, messages: str | Messages, **options: object) -> str:
        out = self._post("/chat/completions", {"model": self.model, "messages": as_messages(messages)} | self.defaults | options)
        self.usage = out.get("usage") or {}
        return out["choices"][0]["message"].get("content") or ""

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = self._post("/embeddings", {"model": self.model, "input": texts})
        return [x["embedding"] for x in sorted(out["data"], key=lambda x: x["index"])]


class Observed:
    """Tells `on_event` of every call: kind (started, completed, failed), seconds, error, tokens of the prompt and of the answer."""

    def __init__(self, client: Client, on_event: Callable[[dict[str, object]], None]) -> None:
        self.client, self.on_event = client, on_event

    def generate(self, messages: str | Messages, **options: object) -> str:
        began = time.monotonic()
        self.on_event({"kind": "started"})
        try:
            out = self.client.generate(messages, **options)
        except Exception as e:
            self.on_event({"kind": "failed", "seconds": time.monotonic() - began, "error": f"{type(e).__name__}: {e}"})
            raise
        usage = getattr(self.client, "usage", {})
        self.on_event({"kind": "completed", "seconds": time.monotonic() - began, "prompt_tokens": usage.get("prompt_tokens"), "completion_tokens": usage.get("completion_tokens")})
        return out


class Fallback:
    """A second client takes over for a call that fails, and for all after `failures` in a row, until `recovery` calls later."""

    def __init__(self, primary: Client, second: Client, failures: int = 3, recovery: int = 10) -> None:
        self.primary, self.second, self.failures, self.recovery = primary, second, failures, recovery
        self.bad = self.good = 0

    def generate(self, messages: str | Messages, **options: object) -> str:
        if self.bad < self.failures or self.good >= self.recovery:
            try:
                out = self.primary.generate(messages, **options)
                self.bad = self.good = 0
                return out
            except Exception:
                self.bad, self.good = self.bad + 1, 0
        out = self.second.generate(messages, **options)
        self.good += 1
        return out


class Cluster:
    """Several servers of one model: messages with a common beginning go to the same one, and on to the next when it fails."""

    def __init__(self, clients: list[Client], prefix: int = 96, spread: int = 1) -> None:
        """spread: how many servers share the load of one beginning, in turn."""
        if not clients:
            raise ValueError("a cluster needs a client")
        self.clients, self.prefix, self.spread, self.calls = clients, prefix, max(1, spread), 0

    def home(self, messages: str | Messages) -> int:
        head = "".join(m["content"] for m in as_messages(messages))[: self.prefix]
        return int.from_bytes(hashlib.blake2b(head.encode(), digest_size=8).digest(), "big") % len(self.clients)

    def generate(self, messages: str | Messages, **options: object) -> str:
        at, self.calls = self.home(messages) + self.calls % self.spread, self.calls + 1
        for k in range(len(self.clients)):
            try:
                return self.clients[(at + k) % len(self.clients)].generate(messages, **options)
            except Exception:
                if k == len(self.clients) - 1:
                    raise
        raise AssertionError


class Bucket:
    """Two limits, requests and tokens a minute, that refill steadily; wait() sleeps until both allow a request."""

    def __init__(self, rpm: float, tpm: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.rate = (rpm / 60, tpm / 60)
        self.most, self.have = [rpm, tpm], [rpm, tpm]
        self.clock, self.sleep, self.at = clock, sleep, clock()
        self.lock = threading.Lock()

    def wait(self, tokens: int) -> None:
        if tokens > self.most[1]:
            raise ValueError("one request of more tokens than the limit of a minute")
        while True:
            with self.lock:
                now = self.clock()
                self.have = [min(m, h + (now - self.at) * r) for m, h, r in zip(self.most, self.have, self.rate)]
                self.at = now
                lack = max((1 - self.have[0]) / self.rate[0], (tokens - self.have[1]) / self.rate[1])
                if lack <= 0:
                    self.have = [self.have[0] - 1, self.have[1] - tokens]
                    return
            self.sleep(lack)


class Window:
    """How many requests may be open: it grows by one while they are quick and shrinks by three tenths when they are slow."""

    def __init__(self, start: int = 10, least: int = 1, most: int = 200, calibrate: int = 20) -> None:
        self.size, self.least, self.most, self.calibrate = start, least, most, calibrate
        self.seen: list[float] = []
        self.target = 0.0

    def report(self, seconds: float) -> None:
        self.seen.append(seconds)
        if not self.target:
            if len(self.seen) >= self.calibrate:
                self.target, self.seen = sorted(self.seen)[len(self.seen) // 2], []
        elif len(self.seen) >= 5:
            middle, self.seen = sorted(self.seen)[2], []
            if middle < 1.5 * self.target:
                self.size = min(self.most, self.size + 1)
            elif middle > 2.5 * self.target:
                self.size = max(self.least, int(self.size * 0.7))


def gather(call: Callable[[Any], Any], items: Iterable[Any], window: Window) -> list[Any]:
    """call of each item, in order; as many at a time as the window has open."""
    items = list(items)
    out: list[Any] = [None] * len(items)

    def timed(x: Any) -> tuple[Any, float]:
        began = time.monotonic()
        return call(x), time.monotonic() - began

    running, at = {}, 0
    with ThreadPoolExecutor(max(1, min(window.most, len(items)))) as pool:
        while at < len(items) or running:
            while at < len(items) and len(running) < window.size:
                running[pool.submit(timed, items[at])] = at
                at += 1
            for f in wait(running, return_when=FIRST_COMPLETED).done:
                out[running.pop(f)], seconds = f.result()
                window.report(seconds)
    return out


def with_retries(call: Callable[[], Any], retries: int = 3, base: float = 1.0, most: float = 60.0, jitter: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> tuple[Any, str | None]:
    """(answer, None), or (None, error) after retries + 1 failures. Waits double from `base` on, or are what the server asks for."""
    error = None
    for k in range(retries + 1):
        try:
            return call(), None
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
            if isinstance(e, HttpError) and e.status < 500 and e.status not in (408, 409, 429):
                break  # asking again does not help
            if k < retries:
                after = getattr(e, "retry_after", None)
                sleep(min(most, base * 2**k if after is None else after) + random.uniform(0, jitter))
    return None, error
