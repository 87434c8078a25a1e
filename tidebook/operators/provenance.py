"""Canonical JSON, hashes of it, and run manifests."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, is_dataclass
from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 12


def _plain(value):
    if is_dataclass(value):
        return _plain(asdict(value))
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return value
    if isinstance(value, float):
        if not math.isfinite(value):
            return str(value)
        rounded = round(value, DIGITS)
        return 0.0 if rounded == 0 else rounded
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in sorted(value.items(), key=lambda kv: str(kv[0]))}
    if isinstance(value, (set, frozenset)):
        return sorted((_plain(v) for v in value), key=str)
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return str(value)


def canonical(value) -> str:
    """JSON with sorted keys and floats at twelve decimals, the same for equal values."""
    return json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def stable_hash(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()[:32]


def run_manifest(created_at: str, **payload) -> dict:
    """A manifest whose run_id depends on all but the time of creation."""
    return {"run_id": stable_hash(payload), "created_at": created_at, **payload}


def row_hash(*columns: Column) -> Column:
    """sha-256 of the JSON of some columns, doubles at twelve decimals by the caller."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 32)
