"""Settings: defaults, overridden by a JSON file and then by the session's ``massloom.*`` properties."""

from __future__ import annotations

import json
import os

from pyspark.sql import SparkSession

DEFAULTS: dict[str, object] = {"instrument": "qtof", "separation": "uplc", "tokenizers": "/opt/tokenizers", "gather": 256, "progress": False}


def load(spark: SparkSession | None = None, path: str | None = None) -> dict[str, object]:
    """All settings. A value of a property takes the default's type; unknown names raise ValueError."""
    out = dict(DEFAULTS)
    if path is not None:
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        if unknown := set(own) - set(DEFAULTS):
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        out |= own
    if spark is not None:
        for name, value in DEFAULTS.items():
            given = spark.conf.get(f"massloom.{name}", None)
            if given is not None:
                out[name] = given.lower() == "true" if isinstance(value, bool) else type(value)(given)
    return out


def save(settings: dict[str, object], path: str) -> None:
    """Writes what differs from the defaults."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump({k: v for k, v in settings.items() if v != DEFAULTS.get(k)}, f, indent=1, sort_keys=True)


def in_notebook() -> bool:
    """Whether this runs in a notebook kernel."""
    try:
        from IPython import get_ipython
    except ImportError:
        return False
    shell = get_ipython()
    return shell is not None and type(shell).__name__ == "ZMQInteractiveShell"
