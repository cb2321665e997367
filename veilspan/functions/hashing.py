"""Keyed hashing in built-in functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Lower-case hex of HMAC-SHA-256.  The key's pads become plan literals: for synthetic keys only."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def framed(*parts: Column) -> Column:
    """Parts with their UTF-8 lengths before them, so that no two lists of parts give one text."""
    return F.concat(*(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts))
