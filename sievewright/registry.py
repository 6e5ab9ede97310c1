"""Plug-ins by name: strategies, evaluators, suites, benchmarks."""

from __future__ import annotations

import warnings
from collections.abc import Callable

_FOUND: dict[str, dict[str, Callable]] = {k: {} for k in ("strategy", "evaluator", "suite", "benchmark")}


def register(kind: str, name: str) -> Callable[[Callable], Callable]:
    def put(f: Callable) -> Callable:
        if name in _FOUND[kind]:
            warnings.warn(f"{kind} {name!r} is replaced", stacklevel=2)
        _FOUND[kind][name] = f
        return f

    return put


def get(kind: str, name: str) -> Callable:
    if name not in _FOUND[kind]:
        raise KeyError(f"no {kind} {name!r}; there are {sorted(_FOUND[kind])}")
    return _FOUND[kind][name]


def names(kind: str) -> list[str]:
    return sorted(_FOUND[kind])


def _built_in() -> None:
    from .operators import assessment, benchmark
    from .operators import evaluators as E
    from .operators import strategies as S

    for name, f in {
        "completeness": E.simple(E.completeness, True), "length-filter": E.simple(E.length_filter), "length-window": E.simple(E.length_window, True), "regex-filter": E.simple(E.regex_filter),
        "similarity": E.by_similarity, "llm-judge": E.by_judge, "multi-criteria": E.by_criteria, "dedup": E.by_dedup,
    }.items():
        register("evaluator", name)(f)
    for name, f in {"evol-instruct": S.evolve, "paraphrase": S.paraphrase, "seed-to-qa": S.question_answers, "self-play": S.self_play, "answers": S.answer_all}.items():
        register("strategy", name)(f)
    register("suite", "sft_readiness_v1")(assessment.SFT_READINESS)
    for name, task in benchmark.TASKS.items():
        register("benchmark", name)(task)


_built_in()
