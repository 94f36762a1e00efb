"""Order keys for sampling that depend on the row only, never on its partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

KEY_BITS = 60


def sample_key(cols: Sequence[str] | str, seed: int = 42, portable: bool = False) -> Column:
    """A 60-bit non-negative pseudo-random key of the identifying columns.

    ``portable=True`` derives it from MD5, so another SQL engine can repeat the
    draw; the default uses the cheaper xxHash.
    """
    names = [cols] if isinstance(cols, str) else list(cols)
    if portable:
        text = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in names])
        return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
    hashed = F.xxhash64(*[F.col(c) for c in names], F.lit(seed))
    return hashed.bitwiseAND(F.lit((1 << KEY_BITS) - 1))
