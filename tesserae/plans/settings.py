"""Settings by name, from an environment and the lines of a file: of the embedding service, the parser and the chat model."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from tesserae.operators import embed
from tesserae.sources.parser import ParserService

_TRUE = ("1", "true", "yes", "y", "on")


def environment(lines: str, given: Mapping[str, str]) -> dict[str, str]:
    """``NAME=value`` lines under what is ``given``, which counts first. Empty lines, comments and lines without "=" are left out, quotes around
    a value too."""
    found: dict[str, str] = {}
    for line in map(str.strip, lines.splitlines()):
        name, equals, value = line.partition("=")
        if equals and not line.startswith("#") and name.strip():
            found.setdefault(name.strip(), value.strip().strip('"').strip("'"))
    return found | dict(given)


def flag(given: Mapping[str, str], name: str, default: bool) -> bool:
    return given[name].strip().lower() in _TRUE if name in given else default


def _or_none(given: Mapping[str, str], name: str) -> str | None:
    return given.get(name) or None


@dataclass(frozen=True)
class EmbeddingSettings:
    kind: str = "openai_compatible"
    model: str = "BAAI/bge-m3"
    base: str | None = None
    url: str | None = None
    key: str | None = field(default=None, repr=False)
    batch: int = embed.BATCH
    timeout: float = 60.0
    normalise: bool = True
    device: str = "cpu"

    @classmethod
    def from_environment(cls, given: Mapping[str, str]) -> EmbeddingSettings:
        name = lambda part: f"EMBEDDING_{part}"
        return cls(
            given.get(name("PROVIDER"), cls.kind), given.get(name("MODEL"), cls.model), _or_none(given, name("API_BASE")), _or_none(given, name("API_URL")), _or_none(given, name("API_KEY")),
            int(given.get(name("BATCH_SIZE"), cls.batch)), float(given.get(name("TIMEOUT_SECONDS"), cls.timeout)), flag(given, name("NORMALIZE"), True), given.get(name("DEVICE"), cls.device),
        )

    def provider(self, post: Callable[..., Any] | None = None, local: Any = None) -> Any:
        """What embeds: the service that ``post`` sends to, or the ``local`` model."""
        return embed.provider(self.kind, model=self.model if local is None else local, post=post, url=self.url or "", base=self.base or "", timeout=self.timeout, key=self.key, normalise=self.normalise)


@dataclass(frozen=True)
class ParserSettings:
    """``options`` go with each job."""

    root: str = "https://mineru.net/api/v4"
    token: str = field(default="", repr=False)
    options: dict[str, Any] = field(default_factory=dict)
    interval: float = 2.0
    timeout: float = 300.0
    folder: str = "files/mineru_outputs"

    @classmethod
    def from_environment(cls, given: Mapping[str, str]) -> ParserSettings:
        name = lambda part: f"MINERU_{part}"
        if given.get(name("PROVIDER"), "precision") != "precision":
            raise ValueError("the parser's provider must be precision")
        options: dict[str, Any] = {
            "model_version": given.get(name("MODEL_VERSION"), "vlm"), "language": given.get(name("LANGUAGE"), "ch"), "enable_table": flag(given, name("ENABLE_TABLE"), True), "enable_formula": flag(given, name("ENABLE_FORMULA"), True),
            "is_ocr": flag(given, name("IS_OCR"), False), "extra_formats": [x.strip() for x in given.get(name("EXTRA_FORMATS"), "docx,html").split(",") if x.strip()], "no_cache": flag(given, name("NO_CACHE"), False),
            "cache_tolerance": int(given.get(name("CACHE_TOLERANCE_SECONDS"), "900")),
        }
        if pages := given.get(name("PAGE_RANGES")):
            options["page_ranges"] = pages
        return cls(
            given.get(name("PRECISION_BASE_URL"), cls.root).rstrip("/"), given.get(name("TOKEN"), ""), options, float(given.get(name("POLL_INTERVAL_SECONDS"), cls.interval)), float(given.get(name("TIMEOUT_SECONDS"), cls.timeout)), given.get(name("OUTPUT_DIR"), cls.folder),
        )

    def service(self, send: Callable[..., Any], **more: Any) -> ParserService:
        if not self.token:
            raise ValueError("the parser's token must be given")
        return ParserService(send, self.root, self.token, dict(self.options), timeout=self.timeout, interval=self.interval, **more)


@dataclass(frozen=True)
class ChatSettings:
    kind: str = "openai_compatible"
    model: str | None = None
    base: str | None = None
    key: str | None = field(default=None, repr=False)
    temperature: float = 0.2
    timeout: float = 60.0

    @classmethod
    def from_environment(cls, given: Mapping[str, str]) -> ChatSettings:
        name = lambda part: f"CHAT_MODEL_{part}"
        return cls(given.get(name("PROVIDER"), cls.kind), _or_none(given, name("NAME")), _or_none(given, name("API_BASE")), _or_none(given, name("API_KEY")), float(given.get(name("TEMPERATURE"), cls.temperature)), float(given.get(name("TIMEOUT_SECONDS"), cls.timeout)))
