"""Operators over a language model that is passed in: a function from prompts to answers (None where it fails)."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Provider = Callable[[list[str]], list[str | None]]


def chain(providers: Sequence[Provider]) -> Provider:
    """The first provider that answers, prompt by prompt."""

    def run(prompts: list[str]) -> list[str | None]:
        out: list[str | None] = [None] * len(prompts)
        for p in providers:
            left = [i for i, x in enumerate(out) if x is None]
            if not left:
                break
            for i, answer in zip(left, p([prompts[i] for i in left])):
                out[i] = answer
        return out

    return run


def without_thinking(text: str) -> str:
    return re.sub(r"(?is)<think(?:ing)?>.*?(?:</think(?:ing)?>|\Z)", "", text).strip()


def parse_answer(text: str | None) -> object:
    """The JSON of an answer; ValueError without one."""
    if text is None:
        raise ValueError("no answer")
    bare = re.sub(r"(?m)^```\w*[ \t]*$", "", without_thinking(text))
    m = re.search(r"[\[{].*[\]}]", bare, re.S)
    if not m:
        raise ValueError("no JSON in the answer")
    return json.loads(m.group(0))


def violation(value: object, schema: dict, path: str = "$") -> str | None:
    """Where a value breaks a schema (type, enum, required, properties, items), as path and keyword; None if it doesn't."""
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "integer": int, "number": (int, float), "null": type(None)}
    want = schema.get("type")
    names = want if isinstance(want, list) else [want] if want else []
    if names and not any(isinstance(value, kinds[n]) and (n in ("boolean",) or not isinstance(value, bool)) for n in names):
        return f"{path}: type"
    if "enum" in schema and value not in schema["enum"]:
        return f"{path}: enum"
    if isinstance(value, dict):
        for name in schema.get("required", []):
            if name not in value:
                return f"{path}.{name}: required"
        for name, part in schema.get("properties", {}).items():
            if name in value and (found := violation(value[name], part, f"{path}.{name}")):
                return found
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            if found := violation(x, schema["items"], f"{path}[{i}]"):
                return found
    return None


def _ask(df: DataFrame, key: str, text: str, work: Callable[[list[str | None]], pd.DataFrame], fields: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield work(pdf["t"].tolist()).assign(k=pdf["k"].to_numpy())

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"{fields}, k {kind}").withColumnRenamed("k", key)


def extract_json(df: DataFrame, key: str, text: str, schema: dict, provider: Provider) -> DataFrame:
    """Rows (key, data JSON string, error): one answer that fits the schema; a faulty one is asked again once, naming what was wrong."""

    def judge(answer: str | None) -> tuple[str | None, str | None]:
        try:
            value = parse_answer(answer)
        except ValueError as e:
            return None, str(e)[:200]
        fault = violation(value, schema)
        return (None, fault[:200]) if fault else (json.dumps(value, ensure_ascii=False), None)

    def work(texts: list[str | None]) -> pd.DataFrame:
        ask = [f"Return JSON that fits this schema:\n{json.dumps(schema)}\n\nContent:\n{t or ''}" for t in texts]
        got = [judge(a) for a in provider(ask)]
        again = [i for i, (_, e) in enumerate(got) if e]
        for i, a in zip(again, provider([f"{ask[i]}\n\nThe last answer was wrong: {got[i][1]}" for i in again]) if again else []):
            got[i] = judge(a)
        return pd.DataFrame(got, columns=["data", "error"])

    return _ask(df, key, text, work, "data string, error string")


def extract_with_prompt(df: DataFrame, key: str, text: str, prompt: str, provider: Provider) -> DataFrame:
    """Rows (key, data JSON string, error): the JSON that an answer to a free prompt holds; there is no schema and no second try."""

    def judge(answer: str | None) -> tuple[str | None, str | None]:
        try:
            return json.dumps(parse_answer(answer), ensure_ascii=False), None
        except ValueError as e:
            return None, str(e)[:200]

    def work(texts: list[str | None]) -> pd.DataFrame:
        return pd.DataFrame([judge(a) for a in provider([f"{prompt}\nReturn JSON only.\n\nContent:\n{t or ''}" for t in texts])], columns=["data", "error"])

    return _ask(df, key, text, work, "data string, error string")


def summarize(df: DataFrame, key: str, text: str, provider: Provider, sentences: int = 3) -> DataFrame:
    """Rows (key, summary); null where no provider answers."""

    def work(texts: list[str | None]) -> pd.DataFrame:
        answers = provider([f"Summarize in {sentences} sentences:\n{t or ''}" for t in texts])
        return pd.DataFrame({"summary": [None if a is None else without_thinking(a) for a in answers]})

    return _ask(df, key, text, work, "summary string")
