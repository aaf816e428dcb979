"""Own columns beside those of the documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def apart(docs: DataFrame, prefix: str, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """run(docs), which returns rows with the columns of docs and has own columns named ``prefix``...; columns of docs
    that are named so too are called otherwise meanwhile."""
    names = docs.columns
    own = [c.lower().startswith(prefix) for c in names]
    if not any(own):
        return run(docs)
    return run(docs.toDF(*[f"__clash{i}" if x else c for i, (c, x) in enumerate(zip(names, own))])).toDF(*names)
