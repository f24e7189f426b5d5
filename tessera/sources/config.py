"""Settings: YAML over defaults, merged key by key."""

from __future__ import annotations

import copy
from pathlib import Path

DEFAULTS = {
    "root": "",
    "target": "target",
    "id": ["row_id"],
    "features": [],
    "model": {"name": "lightgbm", "parameters": {}},
    "validation": {"name": "kfold", "folds": 5, "seed": 0},
    "sampling": {"name": "none"},
    "target_encoding": {"columns": [], "smooth": 0.3},
    "selection": {"top": None, "correlation": 0.9, "drift_p": None},
    "stacking": {"do": False, "runs": [], "keep_features": True},
    "seed": 0,
}


def merge(base: dict, over: dict) -> dict:
    """``base`` with the values of ``over``; nested settings merge, new keys are added."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def load(path: str | None = None, **over) -> dict:
    import yaml

    settings = yaml.safe_load(Path(path).read_text()) if path else {}
    return merge(merge(DEFAULTS, settings or {}), over)


def seed_settings(settings: dict, seeds: int) -> list[dict]:
    """One copy of the settings a seed, with its own output name."""
    return [merge(settings, {"seed": s, "validation": {"seed": s}, "output": f"{settings.get('output', 'output')}-seed{s}"}) for s in range(seeds)]
