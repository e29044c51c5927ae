"""Track the caches an operator leaves behind so the caller can release them
once the result is materialised (checkpointed or written)."""

from __future__ import annotations

from pyspark.sql import DataFrame

_ATTR = "_tabml_cached"


def remember(out: DataFrame, *cached: DataFrame) -> DataFrame:
    held = list(getattr(out, _ATTR, []))
    for c in cached:
        held += [c] + list(getattr(c, _ATTR, []))
    setattr(out, _ATTR, held)
    return out


def held(df: DataFrame) -> list:
    return list(getattr(df, _ATTR, []))


def release(*frames: DataFrame) -> None:
    """Unpersist every cache recorded on ``frames`` (and the frames)."""
    seen = set()
    for f in frames:
        for c in [f] + held(f):
            if id(c) not in seen:
                seen.add(id(c))
                c.unpersist()
