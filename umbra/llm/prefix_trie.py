"""Radix tries of byte strings in preorder, with counters in their leaves.

A trie is its leaves in byte order, each as the number of bytes it shares with the leaf
before and the bytes of its own: the branches of a radix trie, written as they are
walked.  So a trie is built, walked, cut by prefix and merged in one pass without
recursion, however long its keys are.  A leaf counts documents, and occurrences for
each source that has any.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

_WIDTHS = (1, 2, 4, 8)


def common(a: bytes, b: bytes) -> int:
    """Bytes that two keys start with in common."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 16:  # halve while it pays
        mid = (low + n) // 2
        low, n = (mid, n) if a[low:mid] == b[low:mid] else (low, mid)
    while a[low] == b[low]:
        low += 1
    return low


@dataclass
class Trie:
    keys: list[bytes]  # in byte order
    docs: Any  # int64 for each key
    at: Any  # where each key's counters begin, and the end
    source: Any  # number of a source
    count: Any  # its occurrences

    @classmethod
    def counted(cls, docs: dict[bytes, int], by_source: list[dict[bytes, int]]) -> Trie:
        """Of documents by key, and of occurrences by key for each source, numbered from 0."""
        import numpy as np

        keys = sorted(docs)
        place = {k: i for i, k in enumerate(keys)}
        sizes = [len(c) for c in by_source]
        total = sum(sizes)
        which = np.fromiter((place[k] for c in by_source for k in c), dtype=np.int64, count=total)
        count = np.fromiter((n for c in by_source for n in c.values()), dtype=np.int64, count=total)
        source = np.repeat(np.arange(len(by_source)), sizes)
        order = np.argsort(which, kind="stable")
        at = np.searchsorted(which[order], np.arange(len(keys) + 1))
        return cls(keys, np.fromiter((docs[k] for k in keys), dtype=np.int64, count=len(keys)), at, source[order], count[order])

    @classmethod
    def merged(cls, tries: list[Trie], sources: int, least_docs: int = 0) -> Trie:
        """One trie with the sums of all counters; keys of fewer documents than ``least_docs`` go."""
        import numpy as np

        keys = [k for t in tries for k in t.keys]
        order = sorted(range(len(keys)), key=keys.__getitem__)  # runs of sorted keys: a merge
        ranked = [keys[i] for i in order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = [a != b for a, b in zip(ranked, ranked[1:])]
        group = np.empty(len(keys), dtype=np.int64)
        group[order] = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        docs = np.concatenate([t.docs for t in tries])
        total = np.add.reduceat(docs[order], starts) if len(starts) else docs
        owner = group[np.repeat(np.arange(len(keys)), np.concatenate([np.diff(t.at) for t in tries]))]
        entry = owner * sources + np.concatenate([t.source for t in tries])
        count = np.concatenate([t.count for t in tries])
        by_entry = np.argsort(entry, kind="stable")
        entry, count = entry[by_entry], count[by_entry]
        first = np.flatnonzero(np.diff(entry, prepend=-1))
        entry, count = entry[first], (np.add.reduceat(count, first) if len(first) else count)
        kept = np.flatnonzero(total >= least_docs)
        number = np.full(len(total), -1)
        number[kept] = np.arange(len(kept))
        which = number[entry // sources]
        entry, count, which = entry[which >= 0], count[which >= 0], which[which >= 0]
        at = np.searchsorted(which, np.arange(len(kept) + 1))
        return cls([ranked[starts[i]] for i in kept], total[kept], at, entry % sources, count)

    def subtrees(self, depth: int):
        """(stem, first, end) for each run of leaves with the same first ``depth`` bytes; a shorter key is its own stem."""
        first = 0
        for i in range(1, len(self.keys) + 1):
            if i == len(self.keys) or self.keys[i][:depth] != self.keys[first][:depth]:
                yield self.keys[first][:depth], first, i
                first = i

    def packed(self, first: int, end: int) -> tuple[bytes, Any]:
        """The leaves from ``first`` to ``end``, compressed, and the sources that they count, which are numbered anew.

        Keys are lengths and bytes, counters whole numbers in as few bytes as hold them.
        """
        import zlib

        import numpy as np

        keys = self.keys[first:end]
        shared = [0, *(common(a, b) for a, b in zip(keys, keys[1:]))]
        own = [k[s:] for k, s in zip(keys, shared)]
        a, b = self.at[first], self.at[end]
        used, local = np.unique(self.source[a:b], return_inverse=True)
        parts, head = [], []
        for numbers in (shared, [len(x) for x in own], self.docs[first:end], np.diff(self.at[first : end + 1]), local, self.count[a:b]):
            numbers = np.asarray(numbers, dtype=np.int64)
            most = int(numbers.max(initial=0))
            width = next(w for w in _WIDTHS if most < 1 << (8 * w - 1))
            head += [width, len(numbers)]
            parts.append(numbers.astype(f"<i{width}").tobytes())
        return zlib.compress(np.array(head, dtype="<i8").tobytes() + b"".join([*parts, *own]), 1), used

    @classmethod
    def unpacked(cls, data: bytes) -> Trie:
        import zlib

        import numpy as np

        data = zlib.decompress(data)
        head = np.frombuffer(data[:96], dtype="<i8").tolist()
        place, numbers = 96, []
        for width, n in zip(head[::2], head[1::2]):
            numbers.append(np.frombuffer(data, dtype=f"<i{width}", count=n, offset=place).astype(np.int64))
            place += width * n
        shared, sizes, docs, each, source, count = numbers
        keys, key = [], b""
        for s, size in zip(shared.tolist(), sizes.tolist()):
            key = key[:s] + data[place : place + size]
            keys.append(key)
            place += size
        return cls(keys, docs, np.concatenate([[0], np.cumsum(each)]).astype(np.int64), source, count)
