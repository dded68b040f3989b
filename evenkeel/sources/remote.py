"""Rows proposed by a text model: prompts, calls with retries on the executors, parsed answers.

The model is any function from a prompt to text.  It is called in tasks, once for each
request row, so requests are spread over executors and a lost one is only asked again.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import plain_number
from .parsing import parse_csv_text

_WAIT = re.compile(r"(?:try again|retry) (?:in|after) ([0-9.]+)\s*s", re.I)


class Busy(Exception):
    """The model asks to wait; its text may say how long."""


def ask(complete: Callable[[str], str], prompt: str, retries: int = 5, pause: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """The answer, after waiting as asked or twice as long each time; other errors are raised at once."""
    for k in range(retries + 1):
        try:
            return complete(prompt)
        except (Busy, TimeoutError) as e:
            if k == retries:
                raise
            found = _WAIT.search(str(e))
            sleep(float(found[1]) if found else pause * 2**k)
    raise AssertionError


@dataclass(frozen=True)
class Endpoint:
    """A model behind the common chat-completions protocol; calling it sends a prompt and returns the text.

    Plain data, so that it travels to the executors.  429 and 503 mean busy (with the
    server's Retry-After, if it gives one); other errors are raised.
    """

    url: str
    model: str
    key: str | None = None
    temperature: float = 0.7
    top_p: float = 0.9
    timeout: float = 120.0

    def __call__(self, prompt: str) -> str:
        body = {"model": self.model, "temperature": self.temperature, "top_p": self.top_p, "messages": [{"role": "user", "content": prompt}]}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(self.url.rstrip("/") + "/chat/completions", json.dumps(body).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return json.load(answer)["choices"][0]["message"]["content"] or ""
        except urllib.error.HTTPError as e:
            if e.code not in (429, 503):
                raise
            wait = e.headers.get("Retry-After") or ""
            raise Busy(f"retry after {wait}s" if re.fullmatch(r"[0-9.]+", wait) else str(e)) from e


def resolve(name: str, presets: Mapping[str, Mapping], environment: Mapping[str, str], **changes) -> Endpoint:
    """The endpoint of a preset: its fields, with ``key_variable`` looked up in the environment, and the changes that are not None."""
    if name not in presets:
        raise ValueError(f"unknown preset {name!r}; known: {', '.join(sorted(presets))}")
    fields = dict(presets[name])
    variable = fields.pop("key_variable", None)
    if variable and not environment.get(variable):
        raise ValueError(f"preset {name!r} needs {variable}")
    return Endpoint(**fields | ({"key": environment[variable]} if variable else {}) | {k: v for k, v in changes.items() if v is not None})


def constraints(statistics: DataFrame) -> str:
    """Lines of a prompt that tell a class's ranges, from rows of ``profile.class_statistics``: one row per column."""
    rows = statistics.orderBy("column").collect()
    number = lambda x: f"{x:.0f}" if abs(x) >= 100 else f"{x:.1f}" if abs(x) >= 10 else f"{x:.2f}"
    return "\n".join(
        f"{r.column}: {number(r['min'])} to {number(r['max'])}, half of the values from {number(r.p25)} to {number(r.p75)}, middle {number(r.median)}" for r in rows if r["min"] is not None
    )


def call_statistics(replies: DataFrame, characters_per_token: float = 4.0) -> DataFrame:
    """One row over (id, prompt, text): calls, empty answers, and estimated tokens asked, answered and per call."""
    size = lambda c: F.coalesce(F.sum(F.ceil(F.length(c) / characters_per_token)), F.lit(0))
    out = replies.agg(F.count("*").alias("n_calls"), F.count(F.when(F.coalesce(F.trim("text"), F.lit("")) == "", 1)).alias("n_empty"), size("prompt").alias("prompt_tokens"), size("text").alias("answer_tokens"))
    return out.withColumn("tokens_per_call", F.coalesce(F.try_divide(F.col("prompt_tokens") + F.col("answer_tokens"), F.col("n_calls")), F.lit(0.0)))


def prompts(anchors: DataFrame, columns: Sequence[str], kinds: Mapping[str, str], per_anchor: int) -> DataFrame:
    """(id, prompt): one request per anchor, its values in the columns' order."""
    cells = [plain_number(F.col(c)) if kinds[c] == "double" else F.col(c).cast("string") for c in columns]
    head = ",".join(columns)
    text = F.concat(
        F.lit(f"Write {per_anchor} rows as CSV with the header {head}. Change one or two values of this row a little, keep the rest.\n"), F.lit(head + "\n"), F.concat_ws(",", *cells)
    )
    return anchors.select("id", text.alias("prompt"))


def answers(requests: DataFrame, complete: Callable[[str], str], retries: int = 5) -> DataFrame:
    """(id, text) from (id, prompt)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "text": [ask(complete, p, retries) for p in pdf["prompt"]]})

    return requests.select("id", "prompt").mapInPandas(run, f"id {dict(requests.dtypes)['id']}, text string")


def propose(anchors: DataFrame, fields: Mapping[str, str], complete: Callable[[str], str], per_anchor: int = 2) -> DataFrame:
    """(id, line_no, fields...): what the model wrote for each anchor, malformed lines left out."""
    asked = prompts(anchors, list(fields), fields, per_anchor)
    return parse_csv_text(answers(asked, complete), "text", fields)
