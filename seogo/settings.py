"""Settings of a knowledge base, from arguments or environment variables named SEOGO_*."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from pathlib import Path

_TRUE, _OFF = ("1", "true", "yes", "on"), ("", "off", "none", "false", "0")


def _read(name: str, default, kind=str):  # noqa: ANN001, ANN202
    """A setting from the environment; values that cannot be read fall back to the default."""

    def get():  # noqa: ANN202
        raw = os.environ.get(f"SEOGO_{name}")
        if raw is None:
            return default() if callable(default) else default
        if kind is bool:
            return raw.strip().lower() in _TRUE
        if kind is list:
            return [x.strip().lower() for x in raw.split(",") if x.strip()]
        try:
            return kind(raw)
        except ValueError:
            return default
    return field(default_factory=get)


@dataclass
class Settings:
    """``data_dir`` null keeps a knowledge base in the session only. ``synonyms``: path, null for the built-in
    groups, or one of ``off none false 0`` and the empty string for none. ``whole_chunks`` keeps the ends of long code
    lines, table rows, headings and section paths, which chunks of the usual form leave out."""

    data_dir: str | None = _read("DATA_DIR", "./data/seogo")
    embedding: str = _read("EMBEDDING", "hash")
    chunk_size: int = _read("CHUNK_SIZE", 900, int)
    chunk_overlap: int = _read("CHUNK_OVERLAP", 150, int)
    whole_chunks: bool = _read("WHOLE_CHUNKS", False, bool)
    max_file_mb: int = _read("MAX_FILE_MB", 50, int)
    min_relevance: float = _read("MIN_RELEVANCE", 0.4, float)
    synonyms: str | None = _read("SYNONYMS", None)
    http_timeout: int = _read("HTTP_TIMEOUT", 20, int)
    verify_ssl: bool = _read("VERIFY_SSL", True, bool)
    allowed_hosts: list[str] = _read("ALLOWED_HOSTS", list, list)
    allow_loopback: bool = _read("ALLOW_LOOPBACK", False, bool)
    confluence_base_url: str = _read("CONFLUENCE_BASE_URL", "")
    confluence_email: str = _read("CONFLUENCE_EMAIL", "")
    confluence_api_token: str = _read("CONFLUENCE_API_TOKEN", "")
    confluence_pat: str = _read("CONFLUENCE_PAT", "")
    nanumi_base_url: str = _read("NANUMI_BASE_URL", "")
    nanumi_cookie: str = _read("NANUMI_COOKIE", "")
    nanumi_auth_header: str = _read("NANUMI_AUTH_HEADER", "")

    @classmethod
    def in_session(cls, **changes) -> Settings:  # noqa: ANN003
        return cls(**{"data_dir": None, **changes})

    def synonym_groups(self):  # noqa: ANN201
        from .operators.synonyms import DEFAULT_GROUPS, Synonyms

        if self.synonyms is None:
            return Synonyms(DEFAULT_GROUPS)
        return Synonyms() if self.synonyms.strip().lower() in _OFF else Synonyms.load(Path(self.synonyms))
