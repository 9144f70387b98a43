"""The language-model stage: a pluggable client per partition, retries, and the way down to raw text."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import pii
from folio.functions.urls import checked_local_url, checked_url
from folio.model.repair import PARTIAL, answer

#: Images a request may carry, by kind of client; None: all, 0: none.
IMAGE_LIMITS = {"groq": 5, "nvidia": 1, "gemini": None, "ollama": None, "mlx": 0}
KEY_VARIABLES = {"gemini": "GEMINI_API_KEY", "groq": "GROQ_API_KEY", "nvidia": "NVIDIA_API_KEY"}
DEFAULTS = {
    "gemini": {"model": "gemini-2.5-pro"},
    "groq": {"model": "meta-llama/llama-4-scout-17b-16e-instruct", "base_url": "https://api.groq.com/openai/v1", "timeout": 120},
    "nvidia": {"model": "meta/llama-3.2-90b-vision-instruct", "base_url": "https://integrate.api.nvidia.com/v1", "timeout": 180},
    "ollama": {"model": "qwen3.5:9b", "base_url": "http://localhost:11434"},
    "mlx": {"model": "mlx-community/Qwen3-4B-4bit", "max_tokens": 4096},
}


class Client(Protocol):
    def call(self, prompt: str, images: Sequence[bytes] | None, text: str) -> str: ...


class ConfigError(ValueError):
    """A setting that can't work: the run ends with exit code 2."""


def request(prompt: str, text: str) -> str:
    return f"{prompt}\n\n--- TEXT CONTENT ---\n{text}"


class ChatClient:
    """An OpenAI-style chat endpoint over urllib: temperature 0.2, 16384 tokens at most."""

    def __init__(self, base_url: str, model: str, key: str, timeout: float, images: int | None) -> None:
        self.base_url, self.model, self.key, self.timeout, self.images = base_url, model, key, timeout, images

    def call(self, prompt: str, images: Sequence[bytes] | None, text: str) -> str:
        import base64
        import json
        from urllib.request import Request, urlopen

        content: list[dict] = [{"type": "text", "text": request(prompt, text)}]
        for image in list(images or ())[: self.images]:
            content.append({"type": "image_url", "image_url": {"url": "data:image/png;base64," + base64.b64encode(image).decode()}})
        body = {"model": self.model, "messages": [{"role": "user", "content": content}], "temperature": 0.2, "max_tokens": 16384}
        sent = Request(f"{self.base_url}/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        with urlopen(sent, timeout=self.timeout) as reply:
            return json.load(reply)["choices"][0]["message"]["content"]


class LibraryClient:
    """Clients that need a library of their own; it is imported in the worker."""

    def __init__(self, kind: str, settings: dict, key: str | None) -> None:
        self.kind, self.settings, self.key = kind, settings, key

    def call(self, prompt: str, images: Sequence[bytes] | None, text: str) -> str:
        if self.kind == "gemini":
            from google import genai

            parts = [request(prompt, text), *(genai.types.Part.from_bytes(data=i, mime_type="image/png") for i in images or ())]
            return genai.Client(api_key=self.key).models.generate_content(model=self.settings["model"], contents=parts).text
        if self.kind == "ollama":
            import ollama

            message = {"role": "user", "content": request(prompt, text), "images": list(images or ())}
            return ollama.Client(host=self.settings["base_url"]).chat(model=self.settings["model"], messages=[message])["message"]["content"]
        import mlx_lm

        model, tokens = mlx_lm.load(self.settings["model"])
        return mlx_lm.generate(model, tokens, prompt=request(prompt, text), max_tokens=self.settings["max_tokens"])


def client_factory(kind: str, settings: dict | None = None, environment: dict[str, str] | None = None) -> Callable[[], Client] | None:
    """A function that makes the client in each partition; None for 'none'. A missing key or an unknown kind is a ``ConfigError``."""
    import os

    if kind == "none":
        return None
    if kind not in DEFAULTS:
        raise ConfigError(f"unknown model client: {kind}")
    own = DEFAULTS[kind] | (settings or {})
    known = os.environ if environment is None else environment
    key = known.get(KEY_VARIABLES[kind]) if kind in KEY_VARIABLES else None
    if kind in KEY_VARIABLES and not key:
        raise ConfigError(f"{KEY_VARIABLES[kind]} isn't set")
    if kind in ("groq", "nvidia"):
        url = checked_url(own["base_url"])
        return lambda: ChatClient(url, own["model"], key, own["timeout"], IMAGE_LIMITS[kind])
    if kind == "ollama":
        checked_local_url(own["base_url"])
    return lambda: LibraryClient(kind, own, key)


def ask(client: Client, prompt: str, images: Sequence[bytes] | None, text: str, retries: int, wait: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None]:
    """Answer and error after up to ``1 + retries`` calls, with 1, 2, 4, ... seconds between them."""
    error = None
    for attempt in range(1 + retries):
        try:
            return client.call(prompt, images, text), None
        except Exception as e:  # noqa: BLE001 - any failure of a client is retried and then reported in its row
            error = f"{type(e).__name__}: {e}"
            if attempt < retries:
                wait(2.0**attempt)
    return None, error


def with_answers(df: DataFrame, factory: Callable[[], Client], prompt: str, *, text: str = "text", images: str | None = None, retries: int = 1) -> DataFrame:
    """Adds ``raw_answer`` and ``model_error``; a partition makes one client and rows are sent one by one."""
    position, pictures = df.columns.index(text), df.columns.index(images) if images else None
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = None
        for batch in batches:
            client = client or factory()
            texts = batch.column(position).to_pylist()
            shown = batch.column(pictures).to_pylist() if pictures is not None else [None] * len(texts)
            found = [ask(client, prompt, i, t or "", retries) for t, i in zip(texts, shown)]
            columns = [*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "raw_answer", "model_error"])

    return df.mapInArrow(run, f"{kinds}, raw_answer string, model_error string")


def settled(df: DataFrame, *, text: str = "text", names: Sequence[str] | None = None, mask: bool = False) -> DataFrame:
    """Adds ``answer`` (null: render the raw text) and ``status``.

    A row without an answer falls back to its text, or is an error without
    one; an answer that was only partly recovered falls back where there is
    text. Where ``mask`` is set, the answer's summary and body are masked.
    """
    has_text = F.coalesce(F.length(text), F.lit(0)) > 0
    parsed = df.withColumn("answer", answer(F.col("raw_answer")))
    broken = F.col("raw_answer").isNull() | (F.col("answer.status") == "error") | ((F.col("answer.status") == PARTIAL) & has_text)
    broken = F.coalesce(broken, F.lit(False))
    failed = (F.col("raw_answer").isNull() & ~has_text) | F.coalesce(F.col("answer.status") == "error", F.lit(False))
    own: Column = F.col("answer")
    if mask:
        for field in ("refined_markdown", "summary"):
            own = own.withField(field, pii.redact(F.col(f"answer.{field}"), names))
    return parsed.withColumns({"answer": F.when(~broken, own), "status": F.when(failed, "error").otherwise("ok")})
