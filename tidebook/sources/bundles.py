"""Model bundles: sufficient statistics as JSON with a hash that must hold on loading."""

from __future__ import annotations

import json
from pathlib import Path

from tidebook.operators.provenance import stable_hash

SCHEMA = 1
KINDS = ("regression", "variance", "regime")


def dump(kind: str, parameters: dict) -> str:
    if kind not in KINDS:
        raise ValueError(f"unknown kind of model {kind!r}")
    # numbers keep all their digits; the hash is of their canonical form
    return json.dumps({"schema": SCHEMA, "kind": kind, "parameters": parameters, "params_hash": stable_hash(parameters)}, sort_keys=True)


def load(text: str) -> tuple[str, dict]:
    """Kind and parameters; another schema, a missing field or a hash that does not hold is an error."""
    held = json.loads(text)
    for name in ("schema", "kind", "parameters", "params_hash"):
        if name not in held:
            raise ValueError(f"a model bundle needs {name}")
    if held["schema"] != SCHEMA:
        raise ValueError(f"a bundle of schema {held['schema']} cannot be read, only {SCHEMA}")
    if held["kind"] not in KINDS:
        raise ValueError(f"unknown kind of model {held['kind']!r}")
    if stable_hash(held["parameters"]) != held["params_hash"]:
        raise ValueError("the bundle's parameters do not match their hash")
    return held["kind"], held["parameters"]


def save_model(path: str, kind: str, parameters: dict) -> None:
    Path(path).write_text(dump(kind, parameters), encoding="utf-8")


def load_model(path: str) -> tuple[str, dict]:
    return load(Path(path).read_text(encoding="utf-8"))
