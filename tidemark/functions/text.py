"""String helpers: pseudonyms, links, addresses and time zones."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.functions.numeric import col

_BLOCK = 64


def hmac_sha256(message, key: bytes) -> Column:
    """Keyed digest built from the engine's own SHA-256; only the pads come from the driver."""
    import hashlib

    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    padded = key.ljust(_BLOCK, b"\0")
    inner_pad = F.lit(bytearray(b ^ 0x36 for b in padded))
    outer_pad = F.lit(bytearray(b ^ 0x5C for b in padded))
    inner = F.sha2(F.concat(inner_pad, F.encode(col(message), "utf-8")), 256)
    return F.sha2(F.concat(outer_pad, F.unhex(inner)), 256)


def pseudonym(identifier, key: bytes) -> Column:
    """Same identifier up to case and outer blanks, same digest."""
    return hmac_sha256(F.lower(F.trim(col(identifier))), key)


def safe_link(link) -> Column:
    """Only absolute http and https addresses survive."""
    c = col(link)
    return F.when(c.rlike(r"(?i)^\s*https?:/*[^\s/?#]"), c)


def wall_time(text) -> Column:
    """Drop the zone suffix and keep the wall clock."""
    return F.to_timestamp_ntz(F.regexp_replace(col(text), r"(Z|[+-]\d\d:?\d\d)$", ""))
