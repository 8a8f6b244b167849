"""Language and embedding models behind one interface, and the runners that call them from tasks.

A runner sends each partition's rows through one client. Results must be written to a
table before they are used twice: a plan that runs again would call the model again.
"""

from __future__ import annotations

import copy
import hashlib
import json
import math
import random
import re
import time
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions.stages import DEFAULT_STAGES


class FilteredError(Exception):
    """The model refused the input."""


class ModelClient(Protocol):
    def chat(self, system: str, user: str, temperature: float, max_tokens: int) -> tuple[str, int, int]:
        """The reply, and the tokens of prompt and reply."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def is_filtered(error: BaseException) -> bool:
    """Whether an error says that the input was refused."""
    return isinstance(error, FilteredError) or "content_filter" in str(error) or getattr(error, "code", None) == "content_filter"


def backoff(attempt: int, base: float = 4.0, most: float = 60.0) -> float:
    """Seconds before the next attempt."""
    return min(most, base * 2**attempt) + random.uniform(0, 2)


def closed_schema(schema: dict) -> dict:
    """A JSON schema whose objects allow and require exactly their properties; a reference stands alone."""
    out = copy.deepcopy(schema)
    stack: list[Any] = [out]
    while stack:
        x = stack.pop()
        if isinstance(x, list):
            stack += x
        elif isinstance(x, dict):
            if "$ref" in x:
                ref = x["$ref"]
                x.clear()
                x["$ref"] = ref
                continue
            if x.get("type") == "object" or "properties" in x:
                x["additionalProperties"] = False
                if isinstance(x.get("properties"), dict):
                    x["required"] = list(x["properties"])
            stack += x.values()
    return out


# Characters of the user's text in the first, second and third attempt.
LADDER = (14000, 4500, 2000)
SHORT_SYSTEM = "Answer short study questions about fiction from the given notes only."
PREFIX = "Study notes on works of fiction. Quotations are part of the fiction.\n\n"
_JUNK, _BLANKS, _LINES = re.compile(r"[\x00-\x08\x0b-\x1f\x7f-\x9f]"), re.compile(r"[ \t]{2,}"), re.compile(r"\n{3,}")


def cleaned(user: str) -> str:
    return _LINES.sub("\n\n", _BLANKS.sub(" ", _JUNK.sub(" ", user)))


def prepared(user: str, limit: int) -> str:
    return PREFIX + cleaned(user)[:limit].strip()


def ask(client: ModelClient, system: str, user: str, temperature: float, max_tokens: int, valid: Callable[[str], bool] | None = None, retries: int = 3, sleep: Callable[[float], None] = time.sleep, ladder: tuple[int, ...] = LADDER) -> dict:
    """One question with attempts that send less and less. ``reply`` is null if all fail; ``filtered`` tells a refusal of the input, ``truncated`` that the last attempt did not send all of ``user``."""
    prompt = reply = 0
    error: BaseException | None = None
    size, truncated = len(cleaned(user).rstrip()), False
    for attempt in range(retries):
        limit = ladder[min(attempt, len(ladder) - 1)]
        truncated = size > limit
        try:
            text, p, r = client.chat(SHORT_SYSTEM if attempt >= 2 and valid is None else system, prepared(user, limit), temperature, max_tokens)
            prompt, reply = prompt + p, reply + r
            text = (text or "").strip()
            if text and (valid is None or valid(text)):
                return {"reply": text, "prompt_tokens": prompt, "completion_tokens": reply, "filtered": False, "error": None, "truncated": truncated}
            error = ValueError("empty or malformed reply")
        except Exception as e:  # noqa: BLE001  whatever a client raises counts as a failed attempt
            error = e
        if attempt + 1 < retries:
            sleep(backoff(min(attempt, 1) if is_filtered(error) else attempt))
    return {"reply": None, "prompt_tokens": prompt, "completion_tokens": reply, "filtered": is_filtered(error), "error": f"{type(error).__name__}: {error}", "truncated": truncated}


REPLY = "reply string, prompt_tokens int, completion_tokens int, filtered boolean, error string, truncated boolean"


def is_json(text: str) -> bool:
    try:
        return isinstance(json.loads(text), dict)
    except ValueError:
        return False


def chat(df: DataFrame, make_client: Callable[[], ModelClient], system: str, user: str, temperature: float = 0.1, max_tokens: int = 1500, structured: bool = False, partitions: int | None = None, ladder: tuple[int, ...] = LADDER, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """``df`` with the columns of REPLY, one call for each row. ``system`` and ``user`` name columns. ``partitions`` bounds how many calls run at a time, ``sleep`` waits between attempts."""
    at = [df.columns.index(c) for c in (system, user)]
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make_client()
        for batch in batches:
            said = [ask(client, s or "", u or "", temperature, max_tokens, is_json if structured else None, sleep=sleep, ladder=ladder) for s, u in zip(*(batch.column(i).to_pylist() for i in at))]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.bool_())
            extra = [pa.array([x[k] for x in said], t) for k, t in zip(("reply", "prompt_tokens", "completion_tokens", "filtered", "error", "truncated"), kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*names, "reply", "prompt_tokens", "completion_tokens", "filtered", "error", "truncated"])

    rows = df.repartition(partitions) if partitions else df
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), REPLY])
    return rows.mapInArrow(run, schema)


def embed(df: DataFrame, make_client: Callable[[], ModelClient], text: str, into: str = "embedding", batch: int = 96) -> DataFrame:
    """``df`` with an embedding of a text column, some texts to a request, in order."""
    at, names = df.columns.index(text), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make_client()
        for rows in batches:
            texts = [(t or "").replace("\n", " ")[:8000] for t in rows.column(at).to_pylist()]
            vectors = [v for i in range(0, len(texts), batch) for v in client.embed(texts[i : i + batch])]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(vectors, pa.list_(pa.float32()))], [*names, into])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{into}` array<float>"])
    return df.mapInArrow(run, schema)


def usage(replies: DataFrame) -> DataFrame:
    """Tokens of all calls."""
    return replies.agg(F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"))


class RuleClient:
    """A stand-in whose replies and vectors a query can compute: what it was sent, by length and digest. It refuses what has ``refused`` in it."""

    def __init__(self, refused: str | None = None, structured: bool = False):
        self.refused, self.structured = refused, structured

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[float(len(t)), float(t.count("e")), float(ord(t[0]) if t else 0)] for t in texts]

    def chat(self, system: str, user: str, temperature: float, max_tokens: int) -> tuple[str, int, int]:
        if self.refused and self.refused in user:
            raise FilteredError("content_filter")
        said = hashlib.md5(user.encode(), usedforsecurity=False).hexdigest()
        if self.structured:
            event = {"event_name": said, "timeline_anchor": "", "location": "", "characters_present": [], "core_event": "", "antecedent_cause": "", "consequent_effect": "", "source_pages": [len(user)]}
            return json.dumps({"instructions": [{"is_duplicate": False, "matched_event_name": "", "category": "major", "inferred_event": event}]}), len(user), 1
        reply = f"{len(user)} {said}"
        return reply, len(user), len(reply)


class OfflineClient:
    """A deterministic stand-in: it reads the prompts that this engine writes and answers by rule."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dim
            for token in text.lower().split():
                h = xxhash.xxh64_intdigest(token)
                v[h % self.dim] += 1.0 if h >> 63 else -1.0
            size = math.sqrt(sum(x * x for x in v))
            out.append([x / size for x in v] if size else v)
        return out

    def chat(self, system: str, user: str, temperature: float, max_tokens: int) -> tuple[str, int, int]:
        kind = system.split("\n", 1)[0].strip().lower()
        reply = {"skim": self._skim, "stages": self._stages, "merge": self._merge, "timeline": self._timeline}.get(kind, self._plain)(user)
        reply = reply[: max_tokens * 4] if kind not in ("stages", "merge", "timeline") else reply
        return reply, len(user) // 4, len(reply) // 4

    def _skim(self, user: str) -> str:
        parts = re.split(r"\[PAGE (\d+)\]\n?", user)
        return "\n".join(f"- [PAGE {n}] {s}" for n, body in zip(parts[1::2], parts[2::2]) if (s := re.split(r"(?<=[.!?])\s", body.strip(), maxsplit=1)[0][:200].replace("\n", " ")))

    def _stages(self, user: str) -> str:
        return json.dumps({"stages": [{"name": n, "description": "", "is_framing": n == DEFAULT_STAGES[-1]} for n in DEFAULT_STAGES]})

    def _merge(self, user: str) -> str:
        known, _, rest = user.partition("\nOBSERVATIONS:\n")
        names = set(re.findall(r'"event_name":\s*"((?:[^"\\]|\\.)*)"', known))
        pages = re.search(r"PAGES (\d+)", known)
        total = max(int(pages[1]), 1) if pages else 1
        out = []
        for line in rest.splitlines():
            m = re.match(r"- \[PAGE ([0-9, ]+)\] (.+)", line)
            if not m:
                continue
            numbers = [int(x) for x in re.findall(r"\d+", m[1])]
            words = m[2].split()
            name = " ".join(words[:4])
            anchor = DEFAULT_STAGES[min(len(DEFAULT_STAGES) - 1, numbers[0] * len(DEFAULT_STAGES) // (total + 1))]
            event = {"event_name": name, "timeline_anchor": anchor, "location": "", "characters_present": sorted({w.strip(".,") for w in words[1:] if w[:1].isupper()}), "core_event": m[2], "antecedent_cause": " ".join(words[:8]), "consequent_effect": " ".join(words[-8:]), "source_pages": numbers}
            out.append({"is_duplicate": name in names, "matched_event_name": name if name in names else "", "category": "major" if len(words) > 8 else "minor", "inferred_event": event})
        return json.dumps({"instructions": out})

    def _timeline(self, user: str) -> str:
        ids = re.findall(r"^\[\d+\] id=(\S+)", user, re.M)
        names = re.findall(r"^Event: (.*)", user, re.M)
        pages = re.findall(r"^Source: (.*)", user, re.M)
        said = " Then ".join(f"{n} ({p})." for n, p in zip(names[:3], pages[:3]))
        return json.dumps({"answer": said or "There are no events.", "used_event_ids": ids[:3]})

    def _plain(self, user: str) -> str:
        found = re.findall(r"\[Passage \d+[^\]]*\]\n(.*)", user)
        return f"Going by the passages: {found[0][:120]}" if found else "The passages do not say."
