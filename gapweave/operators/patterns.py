"""Many patterns at once in many texts: one automaton, walked once over each text."""
from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame

MOST_PATTERNS = 200_000


class Automaton:
    """Goto, failure and output links over characters; occurrences may overlap."""

    def __init__(self, patterns: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        for i, p in enumerate(patterns):
            if not p:
                raise ValueError("an empty pattern occurs everywhere")
            at = 0
            for c in p:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                at = self.next[at][c]
            self.ends[at].append(i)
        self.fail, self.out = [0] * len(self.next), [-1] * len(self.next)
        queue = deque(self.next[0].values())
        while queue:
            at = queue.popleft()
            for c, to in self.next[at].items():
                f = self.fail[at]
                while f and c not in self.next[f]:
                    f = self.fail[f]
                self.fail[to] = self.next[f].get(c, 0)
                queue.append(to)
            f = self.fail[at]
            self.out[at] = f if self.ends[f] else self.out[f]

    def occurrences(self, text: str) -> Iterator[tuple[int, int]]:
        """Pattern and end of each occurrence, by end."""
        at, goto, fail = 0, self.next, self.fail
        for i, c in enumerate(text, 1):
            while at and c not in goto[at]:
                at = fail[at]
            at = goto[at].get(c, 0)
            hit = at if self.ends[at] else self.out[at]
            while hit > 0:
                for p in self.ends[hit]:
                    yield p, i
                hit = self.out[hit]


def occurrences(texts: DataFrame, key: str, text: str, patterns: list[str]) -> DataFrame:
    """key, pattern, start (from 1) of every occurrence of every pattern; null texts have none, a pattern given twice counts twice."""
    if len(patterns) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns")
    schema = f"{key} {texts.schema[key].dataType.simpleString()}, pattern string, start int"

    def go(frames: Iterator) -> Iterator:
        import pyarrow as pa

        automaton = Automaton(patterns)
        for f in frames:
            for row in range(0, f.num_rows, 64):
                part = f.slice(row, 64)
                keys, found, starts = [], [], []
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for p, end in automaton.occurrences(t or ""):
                        keys.append(k)
                        found.append(patterns[p])
                        starts.append(end - len(patterns[p]) + 1)
                yield pa.RecordBatch.from_arrays([pa.array(keys, part.column(0).type), pa.array(found, pa.string()), pa.array(starts, pa.int32())], names=[key, "pattern", "start"])

    return texts.select(key, text).mapInArrow(go, schema)
