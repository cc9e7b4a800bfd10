"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may appear with up to ``k = m * rate`` edits. Split into k + 1 pieces, one
of them must appear unchanged; the pieces of all items are found in one Aho-Corasick pass. The
pieces are the leaves of a binary tree whose nodes have an error budget of their own (halves of a
node with budget k get budgets that add up to k - 1), so a hit is verified from leaf to root with
Myers' bit-parallel distance and given up at the first node that exceeds its budget. Every match
survives on at least one path, which makes the search exact.

Both sides are compared as words: case is folded, and each run of other characters is one space.

In an item of fewer than ``min_chars`` characters an edit makes another item of it: such items are
found where they are whole words without any edit.

The distinct item texts are broadcast in blocks of about ``block_chars`` characters, one pass over
the documents for each; ids are joined to what was found.

Defined results: null or empty texts and items match nothing; repeated items and documents are each
reported; of equally good places the first is reported; texts of any length are searched whole; a
null doc_id or item_id is reported as null; empty tables give an empty result; only the named
columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.textblocks import lean

_WORD = re.compile(r"\w+")
MATCHES = "doc_id long, item_id long, distance int, start long, end long, places int"


def fold(text: str) -> str:
    """Lower case, one character for one."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def normalized(text: str | None) -> str:
    return " ".join(_WORD.findall(fold(text))) if text else ""


def myers(pattern: str, text: str, most: int) -> tuple[int, int]:
    """(distance, end) of the best occurrence of ``pattern`` in ``text``, (most + 1, -1) if none.

    The earliest end wins a tie.
    """
    m = len(pattern)
    eq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        eq[c] = eq.get(c, 0) | 1 << i
    return _scan(eq, m, text, most)


def _scan(eq: dict[str, int], m: int, text: str, most: int) -> tuple[int, int]:
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = most + 1, -1
    for j, c in enumerate(text):
        e = eq.get(c, 0)
        v = e | down
        h = (((e & up) + up) ^ up) | e
        p = down | (full & ~(h | up))
        n = up & h
        if p & high:
            score += 1
        elif n & high:
            score -= 1
        p = p << 1 & full
        n = n << 1 & full
        up = n | (full & ~(v | p))
        down = p & v
        if score < best:
            best, end = score, j + 1
    return best, end


class Item:
    """One item's tree of pieces."""

    def __init__(self, number: int, text: str, rate: float, min_chars: int = 0) -> None:
        self.number, self.text = number, text
        #: found as whole words only
        self.short = len(text) < min_chars
        #: first, last, budget, parent, and bits of each character for Myers
        self.nodes: list[tuple[int, int, int, int, dict[str, int]]] = []
        self.leaves: list[int] = []
        self._grow(0, len(text), 0 if self.short else int(len(text) * rate), -1)

    def _grow(self, first: int, last: int, budget: int, parent: int) -> None:
        eq: dict[str, int] = {}
        for i, c in enumerate(self.text[first:last]):
            eq[c] = eq.get(c, 0) | 1 << i
        me = len(self.nodes)
        self.nodes.append((first, last, budget, parent, eq))
        if budget == 0:
            self.leaves.append(me)
            return
        left = (budget - 1) // 2
        cut = first + (last - first) * (left + 1) // (budget + 1)
        self._grow(first, cut, left, me)
        self._grow(cut, last, budget - 1 - left, me)

    def verify(self, leaf: int, at: int, text: str) -> tuple[int, int] | None:
        """(distance, end in ``text``) of the item around its leaf found at ``at``."""
        first, _, _, node, _ = self.nodes[leaf]
        end = at + len(self.text)
        if self.short and (text[at - 1 : at].strip() or text[end : end + 1].strip()):
            return None
        found = (0, end) if node < 0 else None
        while node >= 0:
            lo, hi, budget, parent, eq = self.nodes[node]
            begin = max(0, at - (first - lo) - budget)
            distance, end = _scan(eq, hi - lo, text[begin : at - first + hi + budget], budget)
            if distance > budget:
                return None
            found, node = (distance, begin + end), parent
        return found


class Matcher:
    """All items of a block and the automaton of their pieces."""

    def __init__(self, items: list[tuple[int, str]], rate: float, min_chars: int = 0) -> None:
        import ahocorasick

        self.ids = [i for i, _ in items]
        self.items = [Item(n, t, rate, min_chars) for n, (_, t) in enumerate(items)]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item in self.items:
            for leaf in item.leaves:
                first, last = item.nodes[leaf][:2]
                pieces.setdefault(item.text[first:last], []).append((item.number, leaf))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if pieces:
            self.automaton.make_automaton()

    def matches(self, raw: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item number, distance, start, end, places): each item's best place in the raw text."""
        text = normalized(raw)
        if not text or not self.items:
            return []
        best: dict[int, list[int]] = {}
        for last, (size, owners) in self.automaton.iter(text):
            at = last - size + 1
            for number, leaf in owners:
                item = self.items[number]
                seen = best.get(number)
                # another piece of a place that is already found without an edit
                if seen and seen[0] == 0 and seen[1] - len(item.text) <= at < seen[1]:
                    continue
                found = item.verify(leaf, at, text)
                if found is None:
                    continue
                if seen is None:
                    best[number] = [*found, found[1], 1]
                    continue
                if abs(found[1] - seen[2]) > len(item.text) // 2:
                    seen[2], seen[3] = found[1], seen[3] + 1
                if (found[0], found[1]) < (seen[0], seen[1]):
                    seen[0], seen[1] = found
        if not best:
            return []
        spans, at = [], 0
        for m in _WORD.finditer(fold(raw)):
            spans.append((at, m.start(), m.end()))
            at += m.end() - m.start() + 1
        out = []
        for number, (distance, end, _, places) in sorted(best.items()):
            item = self.items[number]
            m = len(item.text)
            back = text[max(0, end - m - distance) : end][::-1]
            eq: dict[str, int] = {}
            for i, c in enumerate(item.text[::-1]):
                eq[c] = eq.get(c, 0) | 1 << i
            start = end - max(_anchored(eq, m, back, distance), 1)
            out.append((number, distance, _raw(spans, start, False), _raw(spans, end, True), places))
        return out


def _anchored(eq: dict[str, int], m: int, text: str, distance: int) -> int:
    """Characters of ``text``, from its start, at which the whole pattern has ``distance``."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    for j, c in enumerate(text):
        e = eq.get(c, 0)
        v = e | down
        h = (((e & up) + up) ^ up) | e
        p = down | (full & ~(h | up))
        n = up & h
        if p & high:
            score += 1
        elif n & high:
            score -= 1
        p = (p << 1 | 1) & full
        n = n << 1 & full
        up = n | (full & ~(v | p))
        down = p & v
        if score <= distance:
            return j + 1
    return len(text)


def _raw(spans: list[tuple[int, int, int]], at: int, end: bool) -> int:
    """The place in the raw text of a place in the normalized one."""
    from bisect import bisect_left, bisect_right

    k = (bisect_left(spans, (at,)) if end else bisect_right(spans, (at, 1 << 62, 0))) - 1
    where, first, last = spans[max(k, 0)]
    return min(first + at - where, last)


def find_leaks(docs: DataFrame, items: DataFrame, rate: float = 0.1, min_chars: int = 20, block_chars: int = 500_000) -> DataFrame:
    """``MATCHES``: a row for every document and item that it holds within the error budget.

    ``start`` and ``end`` are places in the document's text, ``places`` counts the spots.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = reduce(DataFrame.unionByName, [own.mapInArrow(lean(_matching(block, rate, min_chars)), MATCHES.replace("item_id", "key")) for block in _item_blocks(items, block_chars)])
    ids = items.filter("text IS NOT NULL").select(F.xxhash64("text").alias("key"), F.col("item_id").cast("long").alias("item_id"))
    return found.join(ids, "key").select(*[x.split()[0] for x in MATCHES.split(", ")])


def without_leaks(docs: DataFrame, items: DataFrame, rate: float = 0.1, min_chars: int = 20, block_chars: int = 500_000) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item: a filter without a join."""
    names = docs.columns
    text = names.index("text")
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])  # whatever the columns are called
    schema = plain.schema
    for block in _item_blocks(items, block_chars):
        plain = plain.mapInArrow(lean(_clean(block, rate, min_chars, text)), schema)
    return plain.toDF(*names)


def _item_blocks(items: DataFrame, block_chars: int) -> Iterator:
    """Broadcasts of (hash of a text, the text normalized), each of about ``block_chars`` characters."""
    spark = items.sparkSession
    texts = items.filter("text IS NOT NULL").groupBy(F.xxhash64("text").alias("key")).agg(F.first("text").alias("text"))
    total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = -(-total // block_chars) or 1
    for k in range(n_blocks):
        rows = texts.filter(F.pmod("key", F.lit(n_blocks)) == k).collect()
        yield spark.sparkContext.broadcast(sorted((r.key, t) for r in rows if (t := normalized(r.text))))


def _clean(shared, rate: float, min_chars: int, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value, rate, min_chars)
        for batch in batches:
            yield batch.filter(pa.array([not matcher.matches(t.as_py()) for t in batch.column(text)], pa.bool_()))

    return run


def _matching(shared, rate: float, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value, rate, min_chars)
        names = [x.split()[0] for x in MATCHES.replace("item_id", "key").split(", ")]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
        for batch in batches:
            rows = [
                (doc, matcher.ids[m[0]], *m[1:])
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True)
                for m in matcher.matches(text.as_py())
            ]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return run
