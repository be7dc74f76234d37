"""A minimal perfect hash over a fixed set of byte strings."""

from __future__ import annotations

import xxhash

_LOW = 0xFFFFFFFF


class PerfectHash:
    """Maps each key of a fixed set to its own slot of ``0..n-1`` (hash and displace).

    Buckets are placed largest first; a bucket of several keys stores the displacement that sends
    all of them to free slots, a bucket of one key stores its slot itself (as ``-slot - 1``).
    ``get`` verifies the key, so strings outside the set give ``None``.
    """

    def __init__(self, keys: list[bytes], values: list[int]):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 2)
        groups: dict[int, list[tuple[int, int, int]]] = {}
        for i, k in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(k)
            groups.setdefault(h % self.buckets, []).append(((h >> 20) & _LOW, (h >> 32) | 1, i))
        self.shift = [0] * self.buckets
        slots: list[int] = [-1] * n
        free = bytearray(b"\1") * n
        for b, members in sorted(groups.items(), key=lambda g: -len(g[1])):
            if len(members) == 1:
                continue
            d = 1
            while True:
                at = {(a + d * s) % n for a, s, _ in members}
                if len(at) == len(members) and all(free[x] for x in at):
                    break
                d += 1
            self.shift[b] = d
            for a, s, i in members:
                x = (a + d * s) % n
                slots[x], free[x] = i, 0
        empty = iter([x for x in range(n) if free[x]])
        for b, members in groups.items():
            if len(members) == 1:
                x = next(empty)
                self.shift[b], slots[x] = -x - 1, members[0][2]
        self.keys = [keys[i] for i in slots]
        self.values = [values[i] for i in slots]

    def get(self, key: bytes) -> int | None:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        x = -d - 1 if d < 0 else (((h >> 20) & _LOW) + d * ((h >> 32) | 1)) % self.n
        return self.values[x] if self.keys[x] == key else None
