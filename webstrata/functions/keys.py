"""Stable keys: hash fractions, fingerprints, run ids."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_fraction(key: Column) -> Column:
    """A value in [0, 1) that depends on the key alone and is the same in any engine."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def fingerprint(*names: str) -> Column:
    """First 12 hex digits of SHA-256 over the JSON of the columns, sorted by name, NULLs kept."""
    row = F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"})
    return F.substring(F.sha2(row, 256), 1, 12)


def config_key(config: dict[str, Any]) -> str:
    """The same for a configuration: SHA-256 of its JSON with sorted keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:12]


def run_id(key: str) -> Column:
    """``yyyyMMdd_HHmmss`` of now (session time zone UTC) and the first 7 key digits."""
    stamp = F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")
    return F.concat(stamp, F.lit("_" + key[:7]))


def percent(share: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f%%", share * 100)
