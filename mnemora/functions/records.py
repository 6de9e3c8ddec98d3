"""Byte-exact formats that no built-in expression gives: Arrow batches, one small helper a row."""

from __future__ import annotations

import hashlib
import json
import os
import time

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType


def _no_repeats(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("repeated key")
    return out


def _no_constant(name):
    raise ValueError(f"not finite: {name}")


def _finite(text):
    x = float(text)
    if x in (float("inf"), float("-inf")):
        raise ValueError("number out of range")
    return x


def strict_load(data: bytes | str | None, most: int = 16 << 20):
    """JSON in strict UTF-8 of at most `most` bytes, without repeated keys or non-finite numbers."""
    raw = data.encode("utf-8") if isinstance(data, str) else bytes(data)
    if len(raw) > most:
        raise ValueError("too long")
    value = json.loads(raw.decode("utf-8"), object_pairs_hook=_no_repeats, parse_constant=_no_constant, parse_float=_finite)
    canonical(value)  # a lone surrogate has no UTF-8
    return value


def canonical(value) -> bytes:
    """Keys sorted, no spaces, no ASCII escapes."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False).encode("utf-8")


def _or_none(f, x):
    try:
        return None if x is None else f(x)
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """Canonical JSON of a JSON text; null where it is not strict JSON."""
    return text.map(lambda x: _or_none(lambda t: canonical(strict_load(t)).decode(), x))


@F.pandas_udf(StringType())
def number_of(text: pd.Series) -> pd.Series:
    """The `number` of a JSON object as it is written in decimal: 1.0 stays 1.0, a whole number has no point; null where there is none."""

    def one(t):
        value = strict_load(t)
        n = value.get("number") if isinstance(value, dict) else None
        return None if n is None or isinstance(n, bool) or not isinstance(n, (int, float)) else str(n)

    return text.map(lambda x: _or_none(one, x))


def _integrity(text) -> str:
    record = strict_load(text)
    return "sha256:" + hashlib.sha256(canonical({k: v for k, v in record.items() if k != "integrity"})).hexdigest()


@F.pandas_udf(StringType())
def integrity_of(text: pd.Series) -> pd.Series:
    """The seal of a record's JSON, without its own `integrity`; null where it is no strict JSON object."""
    return text.map(lambda x: _or_none(lambda t: _integrity(t) if isinstance(strict_load(t), dict) else None, x))


def uuid7(at_ms: int | None = None) -> str:
    """A time-ordered identifier."""
    n = (at_ms if at_ms is not None else time.time_ns() // 1_000_000) & (1 << 48) - 1
    r = int.from_bytes(os.urandom(10), "big")
    x = n << 80 | 7 << 76 | (r >> 62 & 0xFFF) << 64 | 2 << 62 | r & (1 << 62) - 1
    h = f"{x:032x}"
    return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))


@F.pandas_udf(StringType())
def text_prefix(data: pd.Series, most: pd.Series) -> pd.Series:
    """Strict UTF-8 of the first `most` bytes; a character cut at the end is left out, anything else invalid gives null."""

    def one(raw, n):
        if raw is None:
            return None
        raw, cut = bytes(raw), len(raw) > n
        raw = raw[: int(n)]
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError as e:
            return raw[: e.start].decode("utf-8") if cut and e.reason == "unexpected end of data" and e.end == len(raw) else None

    return pd.Series([one(r, n) for r, n in zip(data, most)])


@F.pandas_udf(StructType([StructField("chars", LongType()), StructField("bad_at", LongType())]))
def utf8_facts(data: pd.Series) -> pd.DataFrame:
    """The characters of strict UTF-8 before the first byte that is none, and where that byte stands (null in valid text)."""

    def one(raw):
        if raw is None:
            return 0, None
        try:
            return len(bytes(raw).decode("utf-8")), None
        except UnicodeDecodeError as e:
            return len(bytes(raw)[: e.start].decode("utf-8")), e.start

    return pd.DataFrame([one(x) for x in data], columns=["chars", "bad_at"]).astype({"bad_at": "Int64"})
