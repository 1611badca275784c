"""Settings, presets and errors."""

from __future__ import annotations

import json
import logging
import os
import time
import tomllib
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field, fields, replace

from .operators.ingest import ChunkLimits
from .operators.retrieval import Limits

# ---- Fixed values: error, status, code ------------------------------------------------------
ERRORS = (
    ("BadRequest", 400, "bad_request"),
    ("Unauthorized", 401, "unauthorized"),
    ("Forbidden", 403, "forbidden"),
    ("NotFound", 404, "not_found"),
    ("PayloadTooLarge", 413, "payload_too_large"),
    ("UnsupportedMedia", 415, "unsupported_media_type"),
    ("GuardrailBlocked", 422, "guardrail_blocked"),
    ("Ingest", 422, "ingest_failed"),
    ("Ocr", 422, "ocr_failed"),
    ("RateLimited", 429, "rate_limited"),
    ("Embedding", 500, "embedding_failed"),
    ("Storage", 500, "storage_failed"),
    ("Llm", 500, "llm_failed"),
    ("Config", 500, "config_error"),
    ("Internal", 500, "internal_error"),
)
# ---------------------------------------------------------------------------------------------
_BY_NAME = {name: (status, code) for name, status, code in ERRORS}


class LodestoneError(Exception):
    """An error of one of the kinds above."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind
        self.status, self.code = _BY_NAME.get(kind, _BY_NAME["Internal"])

    @property
    def public_message(self) -> str:
        """What users may read: nothing of what went wrong inside."""
        return str(self) if self.status < 500 else "An unexpected error occurred. Please tell the administrator the request's id."


@dataclass(frozen=True)
class Settings:
    """All that operators take as parameters; the defaults are the library's."""

    ingest: ChunkLimits = field(default_factory=ChunkLimits)
    retrieval: Limits = field(default_factory=Limits)
    max_file_bytes: int = 50 * 1024 * 1024
    max_pages: int = 500
    ocr_below: int = 120
    neighbours: int = 2
    context_budget: int = 4000
    mmr_lambda: float = 0.5
    cache_ttl: int = 3600
    cache_near: float = 0.96
    cache_size: int = 512
    requests_per_minute: int = 60
    max_steps: int = 1

    def __post_init__(self):
        checks = (
            (self.ingest.budget > self.ingest.overlap, "the overlap must be under the chunk's budget"),
            (self.ingest.least <= self.ingest.budget, "the least chunk must fit the budget"),
            (self.retrieval.final >= 1, "at least one result is needed"),
            (0 <= self.mmr_lambda <= 1, "mmr_lambda is between 0 and 1"),
            (0 < self.cache_near <= 1, "cache_near is above 0 and at most 1"),
            (self.max_steps >= 1, "at least one step is needed"),
        )
        for ok, message in checks:
            if not ok:
                raise LodestoneError("Config", message)


#: Small chunks and a short funnel, for machines with little memory.
SMALL = Settings(ingest=ChunkLimits(budget=128, overlap=16, least=32), retrieval=Limits(dense=10, sparse=10, candidates=2, final=2, min_score=-0.1), neighbours=0, context_budget=1200, mmr_lambda=0.2)
PRESETS: Mapping[str, Settings] = {"default": Settings(), "small": SMALL}


def _merged(base, given: Mapping):
    """``base`` with the values of a table; unknown names are errors."""
    known = {f.name for f in fields(base)}
    if unknown := sorted(set(given) - known):
        raise LodestoneError("Config", f"unknown settings: {', '.join(unknown)}")
    return replace(base, **{k: _merged(getattr(base, k), v) if isinstance(v, Mapping) else type(getattr(base, k))(v) for k, v in given.items()})


def load(path: str | None = None, preset: str = "default", env: Mapping[str, str] = os.environ, prefix: str = "LODESTONE_") -> Settings:
    """A preset, changed by a TOML file and then by variables (``LODESTONE_MAX_PAGES``, or
    ``LODESTONE_RETRIEVAL__FINAL`` for one within a table)."""
    out = PRESETS[preset]
    if path is not None:
        with open(path, "rb") as f:
            out = _merged(out, tomllib.load(f))
    for name, value in env.items():
        if name.startswith(prefix):
            *tables, key = name.removeprefix(prefix).lower().split("__")
            given = {key: value}
            for t in reversed(tables):
                given = {t: given}
            out = _merged(out, given)
    return out


class JsonLines(logging.Formatter):
    """Log records as JSON lines."""

    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"at": round(record.created, 3), "level": record.levelname.lower(), "logger": record.name, "message": record.getMessage(), **getattr(record, "fields", {})}, ensure_ascii=False)


@contextmanager
def timed(logger: logging.Logger, what: str) -> Iterator[None]:
    """Logs how long a block took."""
    start = time.perf_counter()
    try:
        yield
    finally:
        logger.info(what, extra={"fields": {"ms": round((time.perf_counter() - start) * 1000)}})
