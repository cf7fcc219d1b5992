"""Settings from environment variables, each with a default."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    embedding_provider: str = "sentence"
    embedding_model: str = "all-MiniLM-L6-v2"
    index_dir: str = ".corvane/indexes"
    state_dir: str = ".corvane/state"
    llm_provider: str = "groq"
    llm_model: str = "llama-3.1-8b-instant"
    llm_temperature: float = 0.2
    api_key: str | None = None
    auth_enabled: bool = False
    allowed_origins: tuple[str, ...] = ("http://localhost:3000", "http://localhost:3001")


def settings(env: Mapping[str, str] | None = None, prefix: str = "CORVANE_") -> Settings:
    """Every field whose variable (prefix and name in capitals) is set; an empty list of origins keeps the default."""
    env = os.environ if env is None else env
    got: dict = {f: env[prefix + f.upper()] for f in Settings.__dataclass_fields__ if prefix + f.upper() in env}
    if "llm_temperature" in got:
        got["llm_temperature"] = float(got["llm_temperature"])
    if "auth_enabled" in got:
        got["auth_enabled"] = got["auth_enabled"].lower() == "true"
    origins = got.pop("allowed_origins", "")
    if origins:
        got["allowed_origins"] = tuple(x.strip() for x in origins.split(",") if x.strip())
    return Settings(**got)
