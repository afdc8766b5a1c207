"""Pseudonymisation (P10) and deterministic sampling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 224          # SHA-224: 56 hex characters
HIDDEN_MIN_LENGTH = 56   # handles are at most 15 characters; hashes are 56+


def pseudonym(handle: Column, bits: int = HASH_BITS) -> Column:
    return F.sha2(handle, bits)


def protected_handle(handle: Column, is_verified: Column, is_given: Column,
                     mode: str = "valid", bits: int = HASH_BITS) -> Column:
    """P10: keep the handle or replace it by its SHA hex digest.

    ``none`` keeps everyone, ``full`` hides all but the given account,
    ``valid`` hides all but verified accounts and the given one.
    """
    if mode == "none":
        return handle
    if mode == "full":
        keep = is_given
    elif mode == "valid":
        keep = is_given | F.coalesce(is_verified, F.lit(False))
    else:
        raise ValueError(f"unknown pseudonymisation mode {mode!r}")
    return F.when(keep, handle).otherwise(pseudonym(handle, bits))


def is_hidden(display_handle: Column) -> Column:
    """a displayed handle is a pseudonym when it is hash-long."""
    return F.length(display_handle) >= HIDDEN_MIN_LENGTH


def uniform_hash(seed: str, key: Column) -> Column:
    """F13 helper: a reproducible U[0,1) draw per key (first 32 bits of MD5)."""
    digest = F.md5(F.concat(F.lit(seed), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
