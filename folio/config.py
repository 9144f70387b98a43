"""Settings of a conversion run: read once on the driver, checked before anything runs."""

from __future__ import annotations

import json
import logging
import os
import re
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from folio.functions.noise import java_pattern
from folio.model.stage import ConfigError

log = logging.getLogger(__name__)

EXTENSIONS = (".pdf", ".docx", ".doc", ".xlsx", ".xls", ".csv", ".txt", ".md", ".pptx", ".ppt", ".dxf", ".jsonl", ".numbers", ".pages", ".key", ".epub")
MAX_FILES = 1000
MAX_PASSWORD = 1024
EXIT_OK, EXIT_PARTIAL, EXIT_NOTHING = 0, 1, 2
PROMPT = "Structure the document and answer with one JSON object: title, summary, refined_markdown, tags."
SECRETS = {("ai", "gemini", "api_key"): "GEMINI_API_KEY", ("ai", "groq", "api_key"): "GROQ_API_KEY", ("ai", "nvidia", "api_key"): "NVIDIA_API_KEY", ("ai", "ollama", "api_key"): "OLLAMA_API_KEY", ("ai", "openai", "api_key"): "OPENAI_API_KEY", ("pdf", "password"): "PDF_PASSWORD"}


@dataclass(frozen=True)
class Config:
    """Frozen, so that tasks get exactly what the driver checked."""

    backend: str = "gemini"
    model: Mapping[str, Any] = field(default_factory=dict)
    prompt: str = PROMPT
    max_retries: int = 1
    mask: bool = False
    mask_names: tuple[str, ...] | None = None
    tails: tuple[str, ...] | None = None
    paragraphs: tuple[str, ...] = ()
    urls: bool = True
    frontmatter: bool = True
    language: str = "zh-TW"
    pdf_password: str | None = None
    pdf_dpi: int = 200
    pdf_max_pages: int = 15
    pdf_decrypt_dir: str | None = None


def read_json(path: str | None) -> dict[str, Any]:
    """A JSON file's object; none, or no such file: empty."""
    if not path or not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def at(tree: Any, *keys: str) -> Any:
    for key in keys:
        tree = tree.get(key) if isinstance(tree, Mapping) else None
    return tree


def leaked_secrets(settings: Mapping[str, Any]) -> list[str]:
    """Names of the environment variables that secrets found in ``settings`` belong into; each is logged."""
    found = [variable for keys, variable in SECRETS.items() if isinstance(at(settings, *keys), str) and at(settings, *keys)]
    for variable in found:
        log.warning("a secret stands in the settings file; it belongs into %s", variable)
    return found


def check_patterns(spark: SparkSession | None, settings: Mapping[str, Any]) -> None:
    """Patterns must work in Python's and, with a session, in Java's dialect."""
    for name in ("ad_truncation_patterns", "ad_strip_patterns"):
        for pattern in settings.get(name) or ():
            try:
                re.compile(pattern)
                if spark is not None:
                    spark.sparkContext._jvm.java.util.regex.Pattern.compile(java_pattern(pattern))
            except Exception as e:
                raise ConfigError(f"{name}: {pattern!r} is no pattern: {e}") from e


def find_prompt(settings: Mapping[str, Any], folder: str | None) -> str:
    """The template file that the settings name (beside them or absolute), else the default."""
    name = at(settings, "ai", "prompt_template")
    if not name:
        return PROMPT
    for place in [name] if os.path.isabs(name) else [os.path.join(folder or ".", name), str(Path(__file__).parent / name)]:
        if os.path.exists(place):
            return Path(place).read_text(encoding="utf-8")
    log.warning("no prompt template %s; the default is used", name)
    return PROMPT


def load(path: str | None = None, *, spark: SparkSession | None = None, backend: str | None = None, password: str | None = None, environment: Mapping[str, str] | None = None) -> Config:
    """The checked configuration. Arguments beat the file; the file's password beats the environment's."""
    settings, known = read_json(path), os.environ if environment is None else environment
    leaked_secrets(settings)
    check_patterns(spark, settings)
    if password and len(password) > MAX_PASSWORD:
        raise ConfigError(f"a password may have {MAX_PASSWORD} characters")
    own = backend or at(settings, "ai", "backend") or "gemini"
    tails, names = settings.get("ad_truncation_patterns"), at(settings, "pii", "patterns")
    given = {
        "max_retries": at(settings, "ai", "max_retries"), "mask": at(settings, "pii", "enabled"), "urls": settings.get("strip_urls"), "frontmatter": at(settings, "output", "frontmatter"),
        "language": at(settings, "output", "epub_language"), "pdf_dpi": at(settings, "pdf", "dpi"), "pdf_max_pages": at(settings, "pdf", "max_pages"), "pdf_decrypt_dir": at(settings, "pdf", "decrypt_dir")}
    base = Config(backend=own, model=at(settings, "ai", own) or {}, prompt=find_prompt(settings, os.path.dirname(path) if path else None), tails=tuple(tails) if tails else None, paragraphs=tuple(settings.get("ad_strip_patterns") or ()), mask_names=None if names is None else tuple(names), pdf_password=password or at(settings, "pdf", "password") or known.get("PDF_PASSWORD"))
    return replace(base, **{k: v for k, v in given.items() if v is not None})


#: Settings of an interactive front end: default and test of each key.
USER_SETTINGS: dict[str, tuple[Any, Any]] = {
    "version": (1, lambda v: isinstance(v, int)),
    "output_mode": ("sibling", lambda v: isinstance(v, str) and v in {"sibling", "desktop", "custom"}),
    "custom_output_dir": (None, lambda v: v is None or isinstance(v, str)),
    "last_input_dir": (None, lambda v: v is None or isinstance(v, str)),
    "output_format": ("md", lambda v: isinstance(v, str) and v in {"md", "epub", "both"}),
    "lang": (None, lambda v: v is None or isinstance(v, str) and v in {"zh", "en"}),
}


def user_settings(path: str) -> dict[str, Any]:
    """Known keys with valid stored values, defaults for the rest; never raises."""
    try:
        stored = read_json(path)
    except (OSError, ValueError):
        stored = {}
    stored = stored if isinstance(stored, dict) else {}
    return {k: stored[k] if k in stored and valid(stored[k]) else default for k, (default, valid) in USER_SETTINGS.items()}


def version_of(text: str, *keys: str) -> str:
    """A version in TOML at ``keys``, else the first ``version = "..."`` line, else 'unknown'."""
    try:
        found = at(tomllib.loads(text), *keys)
    except tomllib.TOMLDecodeError:
        found = None
    line = re.search(r'^\s*version\s*=\s*"([^"]+)"', text, re.M)
    return found if isinstance(found, str) else line[1] if line else "unknown"


def interface_language(locale: str | None) -> str:
    return "zh" if (locale or "").lower().startswith(("zh", "chinese")) else "en"
