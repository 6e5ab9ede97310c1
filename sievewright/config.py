"""Run, assessment and benchmark configurations: YAML or JSON, checked before anything is read."""

from __future__ import annotations

import inspect
import json
import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from . import registry
from .operators import clients

FORMATS = ("jsonl", "csv", "parquet")
#: Kinds of clients, by the name that a configuration gives.
CLIENTS = ("echo", "http", "fallback", "cluster")


def expand(value: Any) -> Any:
    """${NAME} in strings, at any depth, becomes the variable's value; unknown ones stay."""
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)\}", lambda m: os.environ.get(m.group(1), m.group(0)), value)
    if isinstance(value, dict):
        return {k: expand(v) for k, v in value.items()}
    return [expand(v) for v in value] if isinstance(value, list) else value


def read_env(path: str = ".env") -> None:
    """NAME=value lines become variables of the environment, unless they are set; quotes around a value go."""
    p = Path(path)
    for line in p.read_text(encoding="utf-8").splitlines() if p.is_file() else []:
        name, sign, value = line.removeprefix("export ").partition("=")
        if sign and re.fullmatch(r"\w+", name.strip()) and not line.lstrip().startswith("#"):
            os.environ.setdefault(name.strip(), value.strip().strip("\"'"))


def client(options: dict[str, Any] | None) -> Callable[[], Any]:
    """What makes a client in a task: {"kind": "echo"}, {"kind": "http", "model": ..., "base_url": ...}, or fallback and cluster of others under "clients"."""
    options = dict(options or {"kind": "echo"})
    kind = options.pop("kind", "http")
    if kind not in CLIENTS:
        raise ValueError(f"a client's kind must be one of {CLIENTS}")
    if kind == "echo":
        return clients.EchoClient
    if kind == "http":
        if "model" not in options:
            raise ValueError("a client needs a model")
        return lambda: clients.HttpClient(**options)
    others = [client(o) for o in options.pop("clients", [])]
    if kind == "fallback":
        if len(others) != 2:
            raise ValueError("a fallback needs two clients")
        return lambda: clients.Fallback(others[0](), others[1](), **options)
    return lambda: clients.Cluster([o() for o in others], **options)


def embedder(options: dict[str, Any] | None) -> Callable[[], Any]:
    """What makes an embedder in a task: {"kind": "hash", "size": 64} or one over HTTP."""
    options = dict(options or {"kind": "hash"})
    kind = options.pop("kind", "http")
    return (lambda: clients.HashEmbedder(**options)) if kind == "hash" else (lambda: clients.HttpClient(**options))


@dataclass
class Config:
    source: dict[str, str]
    sink: dict[str, str]
    generate: dict[str, Any] = field(default_factory=dict)
    evaluators: list[dict[str, Any]] = field(default_factory=list)
    candidate: dict[str, Any] | None = None
    judge: dict[str, Any] | None = None
    embedding: dict[str, Any] | None = None
    reference: dict[str, Any] | None = None
    suite: str | None = None

    def __post_init__(self) -> None:
        for part in (self.source, self.sink):
            if "path" not in part:
                raise ValueError("source and sink need a path")
            if part.setdefault("format", "jsonl") not in FORMATS:
                raise ValueError(f"format must be one of {FORMATS}")
        if int(self.generate.get("depth", 1)) < 1:
            raise ValueError("depth must be 1 or more")
        if (name := self.generate.get("strategy", "evol-instruct")) not in registry.names("strategy"):
            raise ValueError(f"unknown strategy {name!r}")
        if self.suite and self.suite not in registry.names("suite"):
            raise ValueError(f"unknown suite {self.suite!r}")
        for e in self.evaluators:
            if e.get("name") not in registry.names("evaluator"):
                raise ValueError(f"an evaluator needs a name of {registry.names('evaluator')}")
            for p in e.get("patterns", []):
                re.compile(p)
            if e["name"] in ("llm-judge", "multi-criteria") and not 1 <= float(e.get("threshold", 1)) <= 5:
                raise ValueError("a judge's threshold must be from 1 to 5")
            if e["name"] == "dedup" and not 0 < float(e.get("threshold", 1)) <= 1:
                raise ValueError("a similarity's threshold must be above 0, up to 1")
            f = registry.get("evaluator", e["name"])
            known = inspect.signature(f).parameters
            if not any(p.kind is p.VAR_KEYWORD for p in known.values()) and (unknown := set(e) - {"name"} - set(known)):
                raise ValueError(f"{e['name']} knows no {sorted(unknown)}")
        client(self.candidate), client(self.judge), embedder(self.embedding)


@dataclass
class BenchmarkConfig:
    name: str
    sink: dict[str, str]
    tasks: list[dict[str, Any]]
    candidate: dict[str, Any] | None = None
    judge: dict[str, Any] | None = None

    def __post_init__(self) -> None:
        if not self.tasks:
            raise ValueError("a benchmark needs a task")
        for t in self.tasks:
            if t.get("name") not in registry.names("benchmark"):
                raise ValueError(f"a task needs a name of {registry.names('benchmark')}")
            if float(t.get("weight") or 0) < 0:
                raise ValueError("weights must not be negative")
        client(self.candidate), client(self.judge)


def load(path: str, kind: type = Config):  # noqa: ANN201
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        data = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML needs the yaml library; JSON does not") from e
        data = yaml.safe_load(text)
    if unknown := set(data) - set(kind.__dataclass_fields__):
        raise ValueError(f"unknown keys: {sorted(unknown)}")
    return kind(**expand(data))
