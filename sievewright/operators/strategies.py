"""Strategies: prompts are built in the JVM, answers come from a client inside Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import json_part, reasoning, variants
from ..functions.text import strip
from .clients import Bucket, Client, EchoClient, Fallback, Window, as_messages, gather, with_retries  # noqa: F401

MUTATIONS = {
    "constraints": "Add one more requirement to this task, so that it becomes harder to meet:\n{instruction}",
    "deepen": "Rewrite this task so that it asks for more depth:\n{instruction}",
    "concretize": "Rewrite this task with a concrete case in place of what is general:\n{instruction}",
}
#: The same as system messages, so that requests of one kind begin alike.
SYSTEMS = {
    "constraints": "You make tasks harder to meet by one more requirement. Give the new task only.",
    "deepen": "You rewrite tasks so that they ask for more depth. Give the new task only.",
    "concretize": "You rewrite tasks with a concrete case in place of what is general. Give the new task only.",
}
THINK = "\n\nThink first, between <think> and </think>, then answer."
AS_JSON = "\n\nAnswer with JSON only."
TEMPLATES = {
    "llama3": ("<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n\n", "<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n", "<|eot_id|>"),
    "chatml": ("<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n", "<|im_end|>"),
}


def repaired(client: Client, text: str, read: Callable[[str], object], repairs: int = 2) -> object:
    """What `read` makes of a text; where it finds no JSON, the client is asked to mend the text, so many times. ValueError after that."""
    for k in range(repairs + 1):
        try:
            return read(text)
        except ValueError as e:
            if k == repairs:
                raise ValueError(f"no JSON after {repairs} repairs") from e
            text = client.generate(as_messages(f"This should be JSON, but is not ({e}). Give the corrected JSON only.\n---\n{text}\n---"))
    raise AssertionError


def ask(df: DataFrame, messages: str, client: Callable[[], Client], out: str = "answer", error: str = "error", retries: int = 0, rpm: float | None = None, tpm: float = 1e5, concurrency: int = 8, base: float = 1.0, then: Callable[[Client, str], str] | None = None) -> DataFrame:
    """The frame with the client's answers to a column of array<struct<role,content>>; failures leave a null and the error.

    One client for each task, which has up to `concurrency` requests open, fewer when they become slow. Failed
    requests are asked again after waits that double from `base` seconds on. The limits hold for each task: divide
    the whole by the number of tasks. then: what the text kept is made from the answer with further requests. Null
    messages are not asked and give an error. Write the result before it is used twice, or the model is asked twice.
    """

    @F.pandas_udf("struct<answer: string, error: string>")
    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c, bucket = client(), Bucket(rpm, tpm) if rpm else None
        window = Window(min(10, concurrency), most=concurrency)

        def one(m: list | None) -> tuple[str | None, str | None]:
            if m is None:
                return None, "ValueError: no messages"
            m = [dict(x) for x in m]

            def call() -> str:
                if bucket:
                    bucket.wait(max(1, sum(len(x["content"]) for x in m) // 5))
                text = c.generate(m)
                return then(c, text) if then else text

            return with_retries(call, retries, base)

        for s in batches:
            yield pd.DataFrame(gather(one, s, window), columns=["answer", "error"])

    tmp = "sievewright_answer"
    made = df.withColumn(tmp, answers.asNondeterministic()(F.col(messages)))
    return made.withColumn(out, F.col(tmp + ".answer")).withColumn(error, F.col(tmp + ".error")).drop(tmp)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def next_mutation(index: Column, kinds: list[str], schedule: str = "round_robin", batch_size: int = 50, seed: int = 0) -> Column:
    """The mutation of the row with this number."""
    k = {"round_robin": index, "batch": F.floor(index / batch_size), "random": F.xxhash64(F.lit(seed), index)}[schedule]
    return F.element_at(F.array(*[F.lit(x) for x in kinds]), (F.pmod(k, F.lit(len(kinds))) + 1).cast("int"))


def evolve_prompt(instruction: Column, mutation: Column) -> Column:
    parts = F.lit(None).cast("string")
    for kind, template in MUTATIONS.items():
        parts = F.when(mutation == kind, F.replace(F.lit(template), F.lit("{instruction}"), instruction)).otherwise(parts)
    return parts


def evolve_messages(instruction: Column, mutation: Column, system: bool = False) -> Column:
    """The messages of one round: the prompt, or a system message of the mutation and the bare instruction."""
    if not system:
        return F.array(message("user", evolve_prompt(instruction, mutation)))
    text = F.element_at(F.create_map(*[F.lit(x) for kv in SYSTEMS.items() for x in kv]), mutation)
    return F.array(message("system", text), message("user", instruction))


def evolve(df: DataFrame, client: Callable[[], Client], instruction: str = "instruction", index: str = "index", depth: int = 3, schedule: str = "random", kinds: list[str] | None = None, retries: int = 0, batch_size: int = 50, system: bool = False, require_reasoning: bool = False, require_json: bool = False, repairs: int = 2, **how: object) -> DataFrame:
    """Rounds of rewriting: column `evolved`, and `error` of what failed first. Round r of row i is number i x depth + r of the schedule.

    require_reasoning: the evolved task is answered too, `response` and `reasoning` hold the parts. require_json: it is
    answered with JSON, which `response` holds as text; an answer that is none is mended, `repairs` times, then an error.
    """
    kinds = kinds or list(MUTATIONS)
    if unknown := set(kinds) - set(MUTATIONS):
        raise ValueError(f"unknown mutations: {sorted(unknown)}")
    out = df.withColumn("evolved", F.col(instruction)).withColumn("error", F.lit(None).cast("string"))

    def step(d: DataFrame, messages: Column, name: str, then: Callable[[Client, str], str] | None = None) -> DataFrame:
        d = ask(d.withColumn("messages", F.when(F.col("error").isNull(), messages)), "messages", client, name, "error_", retries, then=then, **how)
        return d.withColumn("error", F.coalesce("error", "error_")).drop("error_", "messages")

    for r in range(depth):
        kind = next_mutation(F.col(index) * depth + r, kinds, schedule, batch_size)
        out = step(out, evolve_messages(F.col("evolved"), kind, system), "evolved").withColumn("evolved", strip(F.col("evolved")))
    if require_reasoning:
        out = step(out, F.array(message("user", F.concat("evolved", F.lit(THINK)))), "raw")
        both = reasoning(F.col("raw"))
        out = out.withColumn("response", both["answer"]).withColumn("reasoning", both["reasoning"]).drop("raw")
    elif require_json:
        out = step(out, F.array(message("user", F.concat("evolved", F.lit(AS_JSON)))), "response", lambda c, t: json.dumps(repaired(c, t, lambda x: json.loads(json_part(x)), repairs), ensure_ascii=False))
    return out


def answer_all(df: DataFrame, client: Callable[[], Client], instruction: str = "instruction", system: str | None = None, **how: object) -> DataFrame:
    """Column `response`: an answer to each instruction; rows that have one keep it and are not asked."""
    have = F.col("response") if "response" in df.columns else F.lit(None).cast("string")
    said = [message("system", F.lit(system))] if system else []
    todo = F.coalesce(strip(have), F.lit("")) == ""
    out = ask(df.withColumn("messages", F.when(todo & F.col(instruction).isNotNull(), F.array(*said, message("user", F.col(instruction))))), "messages", client, "made", "error", **how)
    return out.withColumn("response", F.when(todo, strip(F.col("made"))).otherwise(have)).withColumn("error", F.when(todo, F.col("error"))).drop("messages", "made")


def paraphrase(df: DataFrame, client: Callable[[], Client], field: str = "instruction", n: int = 1, retries: int = 0, **how: object) -> DataFrame:
    """Column `variants`: n rewordings; a missing or empty field is an error."""
    text = F.when(F.coalesce(F.col(field), F.lit("")) != "", F.concat(F.lit(f"Reword the following in {n} way(s), one on each line, numbered:\n"), F.col(field)))
    split = lambda c, t: json.dumps(variants(t, n))
    out = ask(df.withColumn("messages", F.when(text.isNotNull(), F.array(message("user", text)))), "messages", client, "raw", "error", retries, then=split, **how)
    return out.withColumn("variants", F.from_json("raw", "array<string>")).drop("messages", "raw")


def read_pairs(text: str) -> list[dict[str, str]]:
    """Objects with question and answer of a JSON list in a text; ValueError if there is none."""
    part = json_part(text)
    lo, hi = part.find("["), part.rfind("]")
    data = json.loads(part[lo : hi + 1] if -1 < lo < hi else part)
    if not isinstance(data, list):
        raise ValueError("no list")
    return [{k: str(x.get(k, "")) for k in ("question", "answer", "difficulty")} for x in data if isinstance(x, dict)]


def question_answers(df: DataFrame, client: Callable[[], Client], field: str = "passage", n: int = 3, levels: tuple[str, ...] = ("easy", "medium", "hard"), retries: int = 0, repairs: int = 2, **how: object) -> DataFrame:
    """Column `qa_pairs`, array of (question, answer, difficulty), as read from the answer's JSON, which is mended `repairs` times; null and an error if there is none."""
    text = F.concat(F.lit(f"Write {n} questions with answers, of difficulty {', '.join(levels)}, as a JSON list of objects with question, answer and difficulty, from this passage:\n"), F.col(field))
    out = ask(df.withColumn("messages", F.when(F.col(field).isNotNull(), F.array(message("user", text)))), "messages", client, "raw", "error", retries, then=lambda c, t: json.dumps(repaired(c, t, read_pairs, repairs)), **how)
    return out.withColumn("qa_pairs", F.from_json("raw", "array<struct<question: string, answer: string, difficulty: string>>")).drop("messages", "raw")


def self_play(df: DataFrame, client: Callable[[], Client], topic: str = "topic", turns: int = 3, roles: tuple[str, str] = ("Interviewer", "Interviewee"), systems: tuple[str | None, str | None] = (None, None), second: Callable[[], Client] | None = None, retries: int = 0, concurrency: int = 8, base: float = 1.0) -> DataFrame:
    """Columns `conversation`, `num_turns`, `error`: the first role opens on the topic, then both take turns, 2 x turns messages in all.

    Each role sees its own messages as the assistant's. `second` answers for the second role, if given. A call that
    fails after its retries leaves the row without a conversation and with the error.
    """
    if turns < 1:
        raise ValueError("turns must be 1 or more")

    @F.pandas_udf("struct<talk: string, error: string>")
    def play(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        a = client()
        clients, window = (a, second() if second else a), Window(min(10, concurrency), most=concurrency)

        def one(t: str | None) -> tuple[str | None, str | None]:
            if t is None:
                return None, "ValueError: no topic"
            told = [x or f"You are {me!r} and talk with {other!r} about: {t}" for x, me, other in zip(systems, roles, roles[::-1])]
            talk: list[dict[str, str]] = []
            for k in range(2 * turns):
                me = roles[k % 2]
                seen = [{"role": "assistant" if i % 2 == k % 2 else "user", "content": m["content"]} for i, m in enumerate(talk)]
                asked = [{"role": "system", "content": told[k % 2]}, *seen] if talk else as_messages(f"You are {me!r}. Open a conversation with a question or a statement about: {t}")
                text, error = with_retries(lambda: clients[k % 2].generate(asked), retries, base)  # noqa: B023
                if text is None:
                    return None, error
                talk.append({"role": me, "content": text.strip()})
            return json.dumps(talk), None

        for s in batches:
            yield pd.DataFrame(gather(one, s, window), columns=["talk", "error"])

    out = df.withColumn("sievewright_play", play.asNondeterministic()(F.col(topic).cast("string")))
    out = out.withColumn("conversation", F.from_json("sievewright_play.talk", "array<struct<role: string, content: string>>")).withColumn("error", F.col("sievewright_play.error")).drop("sievewright_play")
    return out.withColumn("num_turns", F.when(F.col("conversation").isNotNull(), F.size("conversation")))


def embed(df: DataFrame, text: str, embedder: Callable[[], object], out: str = "embedding", batch: int = 64) -> DataFrame:
    """Column `out`: the embedder's vector of each text that is not blank, null for the others."""

    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = embedder()
        for s in batches:
            at = [k for k, t in enumerate(s) if t and t.strip()]
            found: list[list[float] | None] = [None] * len(s)
            for lo in range(0, len(at), batch):
                some = at[lo : lo + batch]
                for k, v in zip(some, e.embed([s.iloc[i] for i in some])):
                    found[k] = [float(x) for x in v]
            yield pd.Series(found, dtype=object)

    return df.withColumn(out, vectors.asNondeterministic()(F.col(text).cast("string")))


def chat_text(instruction: Column, response: Column, model: str = "chatml") -> Column:
    a, b, c = TEMPLATES[model]
    return F.concat(F.lit(a), instruction, F.lit(b), response, F.lit(c))
