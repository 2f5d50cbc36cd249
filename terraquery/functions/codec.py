"""Payload codec: base64 of zlib of little-endian float32.

Spark has base64 but no inflate; the zlib step is the one Arrow-batched UDF.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def decode_one(payload: str | None, cells: int | None = None) -> np.ndarray | None:
    """Floats of one payload, or None where it is broken, cut short or of another length."""
    if payload is None:
        return None
    try:
        inflate = zlib.decompressobj()
        raw = inflate.decompress(base64.b64decode(payload, validate=True))
    except (ValueError, zlib.error):
        return None
    if not inflate.eof or len(raw) % 4 or cells is not None and len(raw) != cells * 4:
        return None
    return np.frombuffer(raw, "<f4")


def encode_one(values) -> str | None:
    return None if values is None else base64.b64encode(zlib.compress(np.asarray(values, "<f4").tobytes(), 1)).decode("ascii")


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_payload(payload: pd.Series, cells: pd.Series) -> pd.Series:
    """Null for a payload that is null, broken or not of ``cells`` floats."""
    return pd.Series([decode_one(p, None if pd.isna(n) else int(n)) for p, n in zip(payload, cells)])


@F.pandas_udf(T.StringType())
def encode_payload(values: pd.Series) -> pd.Series:
    return pd.Series([encode_one(v) for v in values])
