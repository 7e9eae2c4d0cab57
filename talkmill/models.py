"""What answers the prompts: recorded answers, deterministic heuristics, or an endpoint reached over HTTP.

A client is called with the system text, the user text and the JSON schema of the answer and returns the answer as
a dict. Heuristic answers are for tests and offline runs; they aren't those of a language model.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import urllib.request
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyarrow import fs


class AnswerError(Exception):
    """An answer that is missing, cut off or of the wrong form."""


class ModelClient(Protocol):
    name: str

    def complete(self, system: str, user: str, schema: dict, max_tokens: int) -> dict: ...


def prompt_key(*parts: str) -> str:
    return hashlib.sha256("|".join(parts).encode()).hexdigest()


@dataclass
class Recorded:
    """Answers by prompt key; an unknown prompt is an error."""

    answers: dict[str, dict]
    name: str = "recorded"

    def complete(self, system: str, user: str, schema: dict, max_tokens: int) -> dict:
        try:
            return self.answers[prompt_key(system, user)]
        except KeyError:
            raise AnswerError("no recorded answer") from None


@dataclass
class Heuristic:
    """Answers from word overlap with the definitions in the system text; boundaries where the words of blocks change most."""

    name: str = "heuristic"
    min_seconds: int = 60

    def complete(self, system: str, user: str, schema: dict, max_tokens: int) -> dict:
        return self._segments(json.loads(user)) if "segments" in schema["properties"] else self._classes(system, user, schema)

    def _segments(self, chunk: dict) -> dict:
        blocks, a, b = chunk["blocks"], chunk["chunk_start_ms"], chunk["chunk_end_ms"]
        words = [set(re.findall(r"\w{4,}", x["text"].lower())) for x in blocks]
        gap = lambda i: len(set().union(*words[max(0, i - 4) : i]) & set().union(*words[i : i + 4])) / (1 + min(len(set().union(*words[max(0, i - 4) : i])), len(set().union(*words[i : i + 4]))))
        cuts, last = [], a
        ranked = sorted(range(1, len(blocks)), key=lambda i: (gap(i), i))
        for i in sorted(ranked[: max(1, (b - a) // 240_000)]):
            at = blocks[i]["start_ms"]
            if at - last >= self.min_seconds * 1000 and b - at >= self.min_seconds * 1000:
                cuts.append(at)
                last = at
        edges = [a, *cuts, b]
        return {"segments": [{"timecode_in_ms": x, "timecode_out_ms": y} for x, y in zip(edges, edges[1:])]}

    def _classes(self, system: str, user: str, schema: dict) -> dict:
        item = schema["properties"]["classifications"]["items"]["properties"]
        topics = {m[1]: set(re.findall(r"[a-z]{4,}", m[0].lower())) for m in re.finditer(r"(?m)^- ([^:\n]+)(?::.*)?$", system)}
        out = []
        for m in re.finditer(r"(?ms)^\[(\d+)\] (.*?)(?=^\[\d+\] |\Z)", user):
            said = set(re.findall(r"[a-z]{4,}", m[2].lower()))
            hits = {t: len(said & words) for t, words in topics.items()}
            if "label" in item:
                best = max(item["label"]["enum"], key=lambda x: hits.get(x, 0))
                out.append({"index": int(m[1]), "label": best if hits.get(best) else next((x for x in item["label"]["enum"] if x.lower().startswith("other")), item["label"]["enum"][-1])})
            else:
                out.append({"index": int(m[1])} | {s: "neutral" if hits.get(s, 0) > 1 else "not_discussed" for s in item if s != "index"})
        return {"classifications": out}


@dataclass
class Http:
    """A chat endpoint with JSON schema answers. The key is given at run time and never enters a plan or a log."""

    base_url: str
    name: str
    key: Callable[[], str] = field(repr=False)
    timeout_s: float = 90.0

    def complete(self, system: str, user: str, schema: dict, max_tokens: int) -> dict:
        body = {"model": self.name, "max_tokens": max_tokens, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}], "response_format": {"type": "json_schema", "json_schema": {"name": "answer", "strict": True, "schema": schema}}}
        req = urllib.request.Request(f"{self.base_url.rstrip('/')}/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key()}"})
        with urllib.request.urlopen(req, timeout=self.timeout_s) as r:
            choice = json.load(r)["choices"][0]
        if choice.get("finish_reason") == "length":
            raise AnswerError("the answer was cut off")
        return json.loads(choice["message"]["content"])


@dataclass
class Cached:
    """Answers of ``client``, kept a file a prompt in ``folder``, which all executors must share; failures aren't kept.

    ``folder`` may be an address (hdfs://, s3://, gs://, file://) or a path of a file system that is mounted everywhere. A
    file appears whole or not at all, so tasks that run twice, or at once, do no harm; one that isn't there or is no
    JSON is asked for again, while a folder that can't be reached is an error.
    """

    client: ModelClient
    folder: str

    @property
    def name(self) -> str:
        return self.client.name

    def _at(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), os.path.abspath(self.folder))

    def complete(self, system: str, user: str, schema: dict, max_tokens: int) -> dict:
        store, folder = self._at()
        path = f"{folder}/{prompt_key(self.client.name, system, user)}.json"
        if store.get_file_info(path).type == fs.FileType.File:
            with store.open_input_stream(path) as f:
                try:
                    return json.loads(f.read().decode())
                except ValueError:
                    pass
        answer = self.client.complete(system, user, schema, max_tokens)
        store.create_dir(folder, recursive=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with store.open_output_stream(part) as f:
            f.write(json.dumps(answer, ensure_ascii=False).encode())
        store.move(part, path)
        return answer


@dataclass(frozen=True)
class Retry:
    """How often a call is tried, how long between tries, and whether the answer may be longer each time."""

    attempts: int = 4
    tokens: int = 3000
    double: bool = True
    first_wait_s: float = 1.5

    def call(self, client: ModelClient, system: str, user: str, schema: dict, sleep: Callable[[float], Any] = time.sleep) -> dict:
        error: Exception | None = None
        for k in range(self.attempts):
            try:
                return client.complete(system, user, schema, self.tokens * 2**k if self.double else self.tokens)
            except Exception as e:  # noqa: BLE001 - whatever the endpoint raises counts as a failed try
                error = e
                if k + 1 < self.attempts:
                    sleep(self.first_wait_s * 2**k)
        raise AnswerError(str(error)) from error


#: Fixed values of the three stages.
BOUNDARY_RETRY = Retry(attempts=3, tokens=1024, double=False)
CLASS_RETRY = Retry()
