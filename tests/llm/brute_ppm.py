"""A plain trie PPM, symbol by symbol, against which the joins of lm_score are tested."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

from orbweave.llm.lm_score import SYMBOLS


def line_of(text: str | None) -> bytes:
    return b" ".join((text or "").encode().lower().split()) + b"\n"


class BrutePpm:
    """Learns from lines; ``order`` zero bytes stand before each."""

    def __init__(self, lines: list[bytes], order: int):
        self.order = order
        self.memo: dict[bytes, float] = {}
        self.tables: dict[bytes, Counter] = defaultdict(Counter)
        for line in lines:
            for gram in self.grams(line):
                self.tables[gram[:-1]][gram[-1]] += 1
        for k in range(order, 0, -1):
            for ctx in [x for x in self.tables if len(x) == k]:
                self.tables[ctx[1:]].update(list(self.tables[ctx]))

    def grams(self, line: bytes) -> list[bytes]:
        padded = bytes(self.order) + line
        return [padded[j - self.order : j + 1] for j in range(self.order, len(padded))]

    def text(self, line: bytes) -> float:
        total = 0.0
        for gram in self.grams(line):
            if gram not in self.memo:
                self.memo[gram] = self.symbol(gram[:-1], gram[-1])
            total += self.memo[gram]
        return total

    def symbol(self, ctx: bytes, s: int) -> float:
        lp, excluded = 0.0, set()
        while True:
            seen = {k: v for k, v in self.tables.get(ctx, {}).items() if k not in excluded}
            t, d = sum(seen.values()), len(seen)
            if s in seen:
                return lp + math.log10(seen[s] / (t + d))
            if d:
                lp += math.log10(d / (t + d))
            excluded |= set(seen)
            if not ctx:
                return lp - math.log10(max(1, SYMBOLS - len(excluded)))
            ctx = ctx[1:]
