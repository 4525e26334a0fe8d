"""What a block of pairwise comparisons tells of its members: rows in proportion to them, not to their pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

LINKS = "node binary, n bigint, hangs_on binary"
SCHEMA = pa.schema([("node", pa.binary()), ("n", pa.int64()), ("hangs_on", pa.binary())])


def linked(keys: list[bytes], weight: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[dict]:
    """For each member of a linked pair, the weight linked to it and the least member that it reaches here."""
    n = np.bincount(left, weight[right], len(keys)) + np.bincount(right, weight[left], len(keys))
    rank = np.empty(len(keys), dtype=np.int64)
    rank[sorted(range(len(keys)), key=keys.__getitem__)] = np.arange(len(keys))
    least = rank.copy()
    while True:
        was = least.copy()
        np.minimum.at(least, left, was[right])
        np.minimum.at(least, right, was[left])
        if (least == was).all():
            break
    by_rank = np.argsort(rank)
    return [{"node": keys[u], "n": int(n[u]), "hangs_on": keys[by_rank[least[u]]]} for u in np.flatnonzero(n).tolist()]
