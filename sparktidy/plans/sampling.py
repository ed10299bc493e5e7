"""Seeded samples and draws by hash of a row's key."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

BITS = 52


def key_bits(keys: list[Column], *salt) -> Column:
    """52 bits of the MD5 of the keys and the salt, joined as text by ``|``.
    Any engine can repeat it, and so can a retried task."""
    text = F.concat_ws("|", *[k.cast("string") for k in keys], *[F.lit(str(s)) for s in salt])
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def hash_limit(rows: int, wanted: int) -> int:
    """A value of ``key_bits`` below which at least ``wanted`` of ``rows``
    distinct keys lie (beyond reasonable doubt: ten standard deviations), and
    few more. The smallest can then be ordered without moving the other rows."""
    share = (wanted + 10 * math.sqrt(wanted) + 20) / max(rows, 1)
    return 2**BITS if share >= 1 else int(share * 2**BITS)
