"""Options of a comparison: defaults, a YAML file over them, explicit values over both."""

from __future__ import annotations

from pathlib import Path

# Every option and its default.
DEFAULTS: dict = {
    "common": {"classpath": {"pom": None, "jars": []}, "excludes": {"names": [], "annotations": []}},
    "v1": {"location": None, "classpath": {"pom": None, "jars": []}, "excludes": {"names": [], "annotations": []}, "apiReport": None},
    "v2": {"location": None, "classpath": {"pom": None, "jars": []}, "excludes": {"names": [], "annotations": []}, "apiReport": None},
    "diff": {"ignore": None, "sourceOnly": None, "binaryOnly": None},
    "reports": [],
}


def overlay(over: dict | None, base: dict) -> dict:
    """``base`` with what ``over`` says; null and empty collections say nothing."""
    out = dict(base)
    for k, v in (over or {}).items():
        if isinstance(v, dict) and isinstance(base.get(k), dict):
            out[k] = overlay(v, base[k])
        elif v is not None and v != [] and v != {}:
            out[k] = v
    return out


def load(path: str) -> dict:
    """Options of a YAML file over the defaults."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML options needs the yaml package") from e
    return overlay(yaml.safe_load(Path(path).read_text(encoding="utf-8")), DEFAULTS)


def effective(options: dict, side: str) -> dict:
    """The options of one side: its own over the common ones."""
    return overlay(options[side], options["common"] | {k: v for k, v in options[side].items() if k not in options["common"]})


def coordinates(text: str) -> dict[str, str]:
    """``group:artifact:version[:extension[:classifier]]`` by part."""
    parts = text.split(":")
    if not 3 <= len(parts) <= 5 or not all(parts):
        raise ValueError(f"not coordinates: {text}")
    return dict(zip(("group", "artifact", "version", "extension", "classifier"), [*parts, "jar"] if len(parts) == 3 else parts))
