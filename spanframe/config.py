"""Settings from the environment: SPANFRAME_SEED, SPANFRAME_DATA_DIR, SPANFRAME_API_KEY."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    seed: int = field(default_factory=lambda: int(os.environ.get("SPANFRAME_SEED", "42")))
    data_dir: Path = field(default_factory=lambda: Path(os.environ.get("SPANFRAME_DATA_DIR", "data")))
    api_key: str | None = field(default_factory=lambda: os.environ.get("SPANFRAME_API_KEY"), repr=False)
