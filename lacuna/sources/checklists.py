"""Checklists and lexicons as files: YAML where PyYAML is installed, JSON always. Both are a few rows and stay on the driver."""

from __future__ import annotations

import json
import os

from lacuna.functions.triggers import Lexicon
from lacuna.plans.pack import Field


def _load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return json.load(f)
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError(f"{path}: YAML needs PyYAML; JSON of the same form needs nothing") from e
        return yaml.safe_load(f)


def _field(row: dict) -> Field:
    low, high = (float(x) for x in row["plausible_range"]) if row.get("plausible_range") else (None, None)
    listed = lambda key: tuple(row.get(key) or ())
    return Field(
        row["field_id"], row["type"], row.get("dimension"), low, high, listed("enum_values"), listed("applies_when"), listed("applies_when_any"), row.get("sensitivity", "HIGH"),
        row.get("canonical_unit"), tuple(tuple(p.items()) for p in row.get("provenance") or ()), row.get("sensitivity_source", "default"), row.get("description") or "",
    )


def read_checklist(path: str) -> tuple[str, tuple[Field, ...]]:
    """(version, fields in the file's order) of a file with version and fields; missing entries of a field have Field's defaults."""
    found = _load(path)
    return str(found["version"]), tuple(map(_field, found["fields"]))


def read_lexicon(path: str) -> Lexicon:
    """The two lists of vague terms; other entries of the file aren't read."""
    found = _load(path)
    return Lexicon(tuple(found.get("qualitative_quantity") or ()), tuple(found.get("relative_condition") or ()))


def read_settings(path: str) -> list[str]:
    """Sets KEY=VALUE lines (export, quotes, comments and a byte order mark allowed) in the environment where they are unset; the names found."""
    names = []
    if not os.path.exists(path):
        return names
    with open(path, encoding="utf-8-sig") as f:
        for line in map(str.strip, f):
            key, sign, value = line.removeprefix("export ").partition("=")
            if sign and not line.startswith("#"):
                os.environ.setdefault(key.strip(), value.strip().strip("\"'"))
                names.append(key.strip())
    return names
