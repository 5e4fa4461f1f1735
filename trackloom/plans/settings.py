"""Settings of a scene: defaults, files, overrides, checks."""

from __future__ import annotations

import copy
import json
from pathlib import Path
from typing import Any

#: The classes that scenes name.
CLASS_MAP = {"person": 0, "bicycle": 1, "car": 2, "bus": 5, "truck": 7, "traffic_light": 9}
DEFAULTS: dict[str, Any] = {
    "dataset": {"name": "sample", "fps": 15, "data_dir": "data", "cluster": {"min_samples": 30, "xi": 0.05, "max_eps": float("inf")}, "class_map": CLASS_MAP},
    "detect": {"conf": 0.3, "device": "auto", "imgsz": None, "classes": None},
    "tracker": {"name": "bytetrack"},
    "features": {"preset": "ReVeRs"},
    "clf": {"name": "mlp"},
}


def merged(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) and k != "class_map" else copy.deepcopy(v)
    return out


def read_file(path: str | Path) -> dict[str, Any]:
    """A JSON or (if the library is there) YAML file."""
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML files need a YAML library; use JSON") from e
    return yaml.safe_load(text) or {}


def resolved(source: dict[str, Any] | str | Path | None = None, overrides: dict[str, Any] | None = None) -> dict[str, Any]:
    """Defaults under a scene's settings under overrides with dotted keys; settings without a ``dataset`` are the dataset's own."""
    given = source if isinstance(source, dict) else read_file(source) if source else {}
    if given and "dataset" not in given and not set(given) & set(DEFAULTS):
        given = {"dataset": given}
    out = merged(DEFAULTS, given)
    for key, value in (overrides or {}).items():
        at = out
        *path, last = key.split(".")
        for k in path:
            at = at.setdefault(k, {})
        at[last] = value
    if "size" in out["detect"]:
        out["detect"]["imgsz"] = out["detect"].pop("size")
    return out


def chosen_source(settings: dict[str, Any], given: str | None, key: str = "video") -> str:
    """What the caller names, else what the dataset names, else an error."""
    found = given or settings["dataset"].get(key)
    if not found:
        raise ValueError(f"no source: name one, or set dataset.{key}")
    return found


def class_map(settings: dict[str, Any]) -> dict[str, int]:
    """The top level's, else the dataset's."""
    return settings.get("class_map") or settings["dataset"].get("class_map") or {}


def palette(settings: dict[str, Any]) -> dict[int, tuple[int, int, int]]:
    """Colours by class, for drawing: both maps are needed, with the same labels."""
    colours, classes = settings["dataset"].get("colors"), class_map(settings)
    if not colours or not classes:
        raise RuntimeError("drawing needs colors and class_map")
    if set(colours) != set(classes):
        raise RuntimeError(f"colors and class_map differ in {sorted(set(colours) ^ set(classes))}")
    return {classes[k]: tuple(v) for k, v in colours.items()}
