"""Settings by name: the environment, then a JSON file, then a default; an empty value counts as unset."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from typing import Any


class Settings:
    """Read once; a file that is missing or broken has no values."""

    def __init__(self, path: str | None = None, environment: Mapping[str, str] = os.environ):
        self.environment = environment
        self.values: dict[str, Any] = {}
        if path:
            try:
                with open(path, encoding="utf-8") as f:
                    found = json.load(f)
                self.values = found if isinstance(found, dict) else {}
            except (OSError, ValueError):
                pass

    def get(self, name: str, default: Any = None) -> Any:
        for source in (self.environment, self.values):
            if source.get(name) not in (None, ""):
                return source[name]
        return default
