"""Settings from the environment; blank counts as unset."""

from __future__ import annotations

import os
from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    canon_root: str = "canon"
    tiles_dir: str = "tiles"

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Config:
        env = dict(os.environ) if env is None else env
        found = {"canon_root": env.get("STARLOOM_CANON", "").strip(), "tiles_dir": env.get("STARLOOM_TILES", "").strip()}
        return cls(**{k: v for k, v in found.items() if v})
