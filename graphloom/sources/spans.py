"""Innermost-span lookup within one file."""

from __future__ import annotations

import bisect


class Nest:
    """Spans that lie within or apart from one another, with their ids; of equal spans the first given counts."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        seen: dict[tuple[int, int], int] = {}
        for a, b, i in spans:
            seen.setdefault((a, b), i)
        self.spans = sorted(seen, key=lambda s: (s[0], -s[1]))
        self.ids = [seen[s] for s in self.spans]
        self.starts = [s[0] for s in self.spans]
        self.parent, stack = [], []
        for k, (_, b) in enumerate(self.spans):
            while stack and self.spans[stack[-1]][1] < b:
                stack.pop()
            self.parent.append(stack[-1] if stack else -1)
            stack.append(k)

    def innermost(self, start: int, end: int) -> int | None:
        k = bisect.bisect_right(self.starts, start) - 1
        while k >= 0 and self.spans[k][1] < end:
            k = self.parent[k]
        return self.ids[k] if k >= 0 else None
