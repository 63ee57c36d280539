"""Small pure functions of the data model: Python values on the driver, or Column builders where rows need them."""

from __future__ import annotations

import hashlib
import hmac
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.vectors import col

#: Subspace counts that are tried, largest first.
SUBSPACES = (16, 12, 10, 8, 6, 5, 4, 3, 2)
#: Hundredths of the memory budget at which ingest slows down and stops, and the delays between.
SOFT, HARD, LEAST_DELAY_MS, MOST_DELAY_MS = 70, 85, 1, 20
#: Roles, each with what the ones before it may do.
ROLES = ("query", "ingest", "admin")


def choose_subspaces(dim: int) -> int:
    return next((n for n in SUBSPACES if dim % n == 0), 1)


def choose_subspaces_col(dim: str | Column) -> Column:
    out = F.lit(1)
    for n in reversed(SUBSPACES):
        out = F.when(col(dim) % n == 0, n).otherwise(out)
    return out.cast("int")


def shard_ef(ef: int, k: int, shards: int) -> int:
    """Beam of one shard so that all together look at about ``ef`` candidates."""
    return max(k, math.ceil(max(ef, k, 1) / math.sqrt(max(shards, 1))))


def shard_ef_col(ef: str | Column, k: str | Column, shards: str | Column) -> Column:
    wide = F.greatest(col(ef), col(k), F.lit(1)) / F.sqrt(F.greatest(col(shards), F.lit(1)).cast("double"))
    return F.greatest(col(k).cast("long"), F.ceil(wide))


def backpressure_ms(projected: str | Column, budget: int) -> Column:
    """Delay for bytes in use and a budget (0: none): 0, linear from over the soft limit to the hard one, -1 (reject) beyond."""
    if budget == 0:
        return F.lit(0).cast("long")
    p, soft, hard = col(projected).cast("long"), budget * SOFT // 100, budget * HARD // 100
    steps = F.floor((p - soft) * (MOST_DELAY_MS - LEAST_DELAY_MS) / max(hard - soft, 1))
    slope = F.least(F.lit(MOST_DELAY_MS), F.greatest(F.lit(LEAST_DELAY_MS), LEAST_DELAY_MS + steps))
    return F.when(p > hard, F.lit(-1)).when(p > soft, slope).otherwise(F.lit(0)).cast("long")


def gain(score: str | Column) -> Column:
    """Playback gain of a similarity."""
    return F.greatest(F.lit(0.35), F.least(F.lit(1.0), 0.35 + 0.65 * col(score)))


def crossfade(position: str | Column, length: int) -> Column:
    """Linear ramp from 0 to 1 over ``length`` samples."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), col(position).cast("double") / max(length, 1)))


def hz_to_mel(hz: str | Column) -> Column:
    return 2595.0 * F.log10(1.0 + col(hz) / 700.0)


def mel_to_hz(mel: str | Column) -> Column:
    return 700.0 * (F.pow(F.lit(10.0), col(mel) / 2595.0) - 1.0)


def layer_of(uniform: str | Column, m: int) -> Column:
    """Layer of a node of a small-world graph from a uniform draw in (0, 1]."""
    return F.floor(-F.log(col(uniform)) / math.log(m)).cast("int")


def allows(role: str, needed: str) -> bool:
    return role in ROLES and needed in ROLES and ROLES.index(role) >= ROLES.index(needed)


def roles_of(text: str) -> list[str]:
    """Known roles of a comma-separated list, in order."""
    return [r for r in (x.strip().lower() for x in text.split(",")) if r in ROLES]


def bearer(header: str | None) -> tuple[str, str] | None:
    """(key id, secret) of an Authorization header: the scheme, and one token of both parts with a dot between."""
    parts = (header or "").split()
    if len(parts) != 2 or parts[0].lower() != "bearer":
        return None
    key, _, secret = parts[1].partition(".")
    return (key, secret) if key and secret else None


def token_hash(token: str, pepper: str = "") -> str:
    return hashlib.sha256((pepper + token).encode()).hexdigest()


def same_secret(a: str, b: str) -> bool:
    return hmac.compare_digest(a.encode(), b.encode())
