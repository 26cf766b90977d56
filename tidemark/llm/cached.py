"""Token ids of many texts through a cache of their parts, for tokenizers whose parts cannot influence one another."""

from __future__ import annotations

from collections.abc import Callable, Iterable

MOST_CACHED = 700_000


class PartCache:
    """Ids of parts as little-endian unsigned 32-bit bytes. Python workers outlive tasks, and so does the cache."""

    def __init__(self, encode: Callable[[list[bytes]], Iterable[bytes]], most: int = MOST_CACHED):
        self.encode, self.most, self.known = encode, most, {}

    def joined(self, texts: list[list[bytes]]) -> list[bytes]:
        """Ids of texts given as lists of parts; parts not seen before are encoded in one batch."""
        if len(self.known) > self.most:
            self.known = {}
        new = list(set().union(*texts).difference(self.known))
        self.known.update(zip(new, self.encode(new), strict=True))
        ids = self.known.__getitem__
        return [b"".join(map(ids, parts)) for parts in texts]

    def each(self, parts: list[bytes]) -> list[bytes]:
        """Ids of each of these distinct parts; those not seen before are encoded in one batch."""
        if len(self.known) > self.most:
            self.known = {}
        found = list(map(self.known.get, parts))
        new = [k for k, ids in enumerate(found) if ids is None]
        for k, ids in zip(new, self.encode([parts[k] for k in new]), strict=True):
            found[k] = self.known[parts[k]] = ids
        return found
