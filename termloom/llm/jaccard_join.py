"""N-gram Jaccard join: size-aware, heavy and light.

A document is the set of its distinct 5-word shingles. Two sets link at 100 * |intersection| >=
80 * |union|, that is with an overlap of at least ``ceil(80 (a + b) / 180)``.

* Equal sets are one class at once; only one of them goes on.
* Light pairs, whose smaller set has at most ``boundary`` shingles: every set that can be in such a
  pair enumerates its subsets of each overlap size that some partner size asks for. A common subset
  is the overlap itself.
* Heavy pairs: inverted lists over each set's prefix, its ``n - ceil(0.8 n) + 1`` first shingles in
  one global order. Linked sets share a prefix shingle. Shingles seen in many documents come last
  in that order, so that common passages make no lists.
* The boundary is the one whose subsets and list pairs, counted over all sets, cost least.

Members of a subset list whose sizes ask for no larger overlap than the list's subset has are all
linked: each is paired with one such member, and one member of each size with one of each other.

Short lists of shingles give all pairs that size and position allow. In a long list the members are compared
with ``PIVOTS`` of them, then linked classes are found, and only lists whose members still are in
different classes are scanned again, with other pivots or, when few pairs are left, all of them
across classes. What is returned are classes: no link that joins two classes is lost, and a group
of g near copies costs a multiple of g instead of its square.

Candidates are first held against the parities of their sets: a bit for each of about n buckets of
shingle hashes says whether the set has an odd number there. The bits in which two sets differ are
at most the shingles that only one of them has, so pairs with more than the sizes allow go before a
set is moved. All others are verified on the whole sets. 64-bit hashes stand for shingles; within
one pair a collision is out of reach, and between pairs it only adds a candidate.

Defined results: null or empty texts, and texts of white space, have no shingles and link with
nothing; a null doc_id links with nothing and has a null class; rows that share a doc_id share a
class; texts of any length are one set (prefixes and sets are arrays of their shingles); ties do not
occur, as a class is named by its least doc_id; an empty table gives an empty result; only doc_id
and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.components import connected_components
from termloom.llm.skew import join_unique
from termloom.llm.staging import stage
from termloom.llm.textblocks import blocks, lean, mix, shingles, words

NUM, DEN = 80, 100
#: Longest list that gives all its pairs at once, and pivots of a longer one.
SHORT, PIVOTS = 32, 4
#: Largest boundary considered: C(20, 18) subsets and the like are still few.
MOST_LIGHT = 20
#: A shingle found in more than one in so many documents, or in more than so many, comes last.
COMMON, LONGEST = 1000, 2_000_000
#: Part number of subset lists.
SUBSET = -1
#: Lists of common shingles are dealt into parts of about so many documents.
PART = 20_000
#: Members of a list that meet one part of it when all of it is compared across classes.
MEET = 1024
#: Largest bit map of documents that is broadcast; more of them are looked up by a join.
MARK_BITS = 1 << 28


def overlap(a: int, b: int) -> int:
    """Least |intersection| at which sets of these sizes link."""
    return -(-NUM * (a + b) // (NUM + DEN))


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1 if n else 0


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    for _, _, body, at in blocks(column):
        h, first = words(body, at)
        s, begin = shingles(h, first)
        for k in range(len(begin) - 1):
            yield np.unique(s[begin[k] : begin[k + 1]])


def _bit(ids: np.ndarray, bits: int) -> np.ndarray:
    return mix(ids.astype(np.int64).view(np.uint64)) & np.uint64(bits - 1)


def _marked(ids: DataFrame, bits: int) -> np.ndarray:
    """A bit map of ``bits`` with the bit of every doc_id of ``ids`` set."""

    def run(batches):
        for batch in batches:
            where = np.unique(_bit(np.asarray(batch.column(0)), bits))
            yield pa.RecordBatch.from_arrays([pa.array((where >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (where & np.uint64(63))).view(np.int64))], ["word", "mask"])

    got = ids.mapInArrow(lean(run), "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[np.asarray(got.column("word"))] = np.asarray(got.column("mask")).astype(np.int64).view(np.uint64)
    return out


def shingle_sets(docs: DataFrame, needed: DataFrame, most_bits: int = MARK_BITS) -> DataFrame:
    """(doc_id, shingles): the sorted shingle hashes of the documents in ``needed`` (doc_id).

    A broadcast bit map spares the join of whole texts with ids, as long as it has 8 bits at least
    for each of them; a few documents too many go with the later join.
    """
    bits = 1 << max(16, (8 * needed.count() - 1).bit_length())
    if bits > most_bits:
        docs, spread = docs.join(needed, "doc_id", "left_semi"), None
    else:
        spread = docs.sparkSession.sparkContext.broadcast(_marked(needed, bits))

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            if spread is not None:
                bit = _bit(np.asarray(ids.fill_null(0)), 64 * len(spread.value))
                batch = batch.filter(pa.array((spread.value[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)))
            ids = batch.column("doc_id")
            at, part, held = 0, [], 0
            for u in _sets(batch.column("text")):
                part.append(u.view(np.int64))
                held += len(u)
                if held > 1 << 19:
                    yield _listed(ids.slice(at, len(part)), part, "shingles")
                    at, part, held = at + len(part), [], 0
            if part:
                yield _listed(ids.slice(at, len(part)), part, "shingles")

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, shingles array<long>")


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    at = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def _listed(ids: pa.Array, parts: list[np.ndarray], name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, _lists(parts)], ["doc_id", name])


def _common(docs: DataFrame) -> np.ndarray:
    """Shingles in more than one of ``COMMON`` documents or in more than ``LONGEST``, as far as each
    batch's share shows.

    Only the order of prefixes depends on it, never a result. At most ``COMMON`` times the mean set
    size can qualify up to ``COMMON * LONGEST`` documents, and beyond that one in ``LONGEST`` of all.
    """

    def run(batches):
        for batch in batches:
            # counts by the hash's last bits first, so that few shingles have to be told apart
            parts, rough = [], np.zeros(1 << 22, np.int32)
            for s in _sets(batch.column("text")):
                rough[(s & np.uint64(len(rough) - 1)).astype(np.int64)] += 1
                parts.append(s)
            if not parts:
                continue
            least = max(3, len(parts) // COMMON)
            some = [s[rough[(s & np.uint64(len(rough) - 1)).astype(np.int64)] >= least] for s in parts]
            u, n = np.unique(np.concatenate(some), return_counts=True)
            often = n >= least
            yield pa.RecordBatch.from_arrays([pa.array(u[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["s", "n"])

    total = docs.count()
    found = docs.select("text").mapInArrow(lean(run), "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).filter(F.col("n") > min(total // COMMON, LONGEST)).select("s")
    return np.sort(np.asarray(found.toArrow().column(0)).astype(np.int64).view(np.uint64))


def _sketches(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """(doc_id, n, sig1, sig2, early, prefix, parity): a set's size, its identity, its prefix in
    order, where in it the common shingles begin, and its parities."""
    spread = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        last = spread.value
        for batch in batches:
            ids, n, s1, s2, early, prefixes, odd = batch.column("doc_id"), [], [], [], [], [], []
            for u in _sets(batch.column("text")):
                n.append(len(u))
                odd.append(parities(u))
                s1.append(int(mix(u).sum() & np.uint64(0xFFFFFFFFFFFFFFFF)) if len(u) else 0)
                s2.append(int(np.bitwise_xor.reduce(mix(u ^ np.uint64(0xA5A5A5A5A5A5A5A5)))) if len(u) else 0)
                if len(last) and len(u):
                    late = last[np.minimum(np.searchsorted(last, u), len(last) - 1)] == u
                    early.append(int((~late).sum()))
                    u = np.concatenate([u[~late], u[late]])
                else:
                    early.append(len(u))
                whole = len(u) <= MOST_LIGHT * DEN // NUM  # a light set is kept whole
                prefixes.append(u[: len(u) if whole else prefix_length(len(u))].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(np.array(s1, np.uint64).view(np.int64)), pa.array(np.array(s2, np.uint64).view(np.int64)), pa.array(early, pa.int64()), _lists(prefixes), _lists(odd)],
                ["doc_id", "n", "sig1", "sig2", "early", "prefix", "parity"],
            )

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n long, sig1 long, sig2 long, early long, prefix array<long>, parity array<long>")


def parities(u: np.ndarray) -> np.ndarray:
    """Whether each bucket of the set has an odd number, in 64-bit words: a power of two of them, with
    at least as many bits as the set has shingles. The words of half as many are the halves' xor."""
    size = 1 << max(0, (len(u) - 1).bit_length() - 6)
    out = np.zeros(size, np.uint64)
    np.bitwise_xor.at(out, ((u >> np.uint64(6)) & np.uint64(size - 1)).astype(np.int64), np.uint64(1) << (u & np.uint64(63)))
    return out.view(np.int64)


def _parities_allow(x: str, y: str, xn: str, yn: str) -> str:
    """SQL: sets with the parities ``x`` and ``y`` may have the overlap that their sizes ask for."""

    def folded(a: str, b: str) -> str:  # linked sizes differ by a quarter at most, so one halving is enough
        return f"if(size({a}) > size({b}), zip_with(slice({a}, 1, size({b})), slice({a}, size({b}) + 1, size({b})), (p, q) -> p ^ q), {a})"

    differ = f"aggregate(zip_with({folded(x, y)}, {folded(y, x)}, (p, q) -> bit_count(p ^ q)), 0, (s, c) -> s + c)"
    return f"{differ} <= {xn} + {yn} - 2 * ceil(({xn} + {yn}) * {NUM} / {NUM + DEN})"


def subset_sizes(n: int, boundary: int) -> list[int]:
    """Overlaps that some pair of a set of ``n`` with smaller set of at most ``boundary`` asks for."""
    return sorted({overlap(n, m) for m in range(max(1, -(-NUM * n // DEN)), n * DEN // NUM + 1) if min(n, m) <= boundary})


def n_subsets(n: int, boundary: int) -> int:
    return sum(comb(n, c) for c in subset_sizes(n, boundary))


def choose_boundary(reps: DataFrame, most: int = MOST_LIGHT) -> int:
    """The boundary of least cost: subsets of small sets against pairs in lists of the others.

    A list entry costs as many comparisons as its list has entries, ``SHORT`` at most.
    """
    entries = reps.filter(F.col("n") <= most * DEN // NUM).select("n", F.posexplode("prefix").alias("p", "t")).filter(F.col("p") <= F.col("n") - F.ceil(F.col("n") * NUM / DEN))
    lists = entries.groupBy("t").agg(F.count("*").alias("l"))
    work = {r.n: (r.sets, r.cost) for r in entries.join(lists, "t").groupBy("n").agg(F.sum(F.when(F.col("p") == 0, 1).otherwise(0)).alias("sets"), F.sum(F.least(F.col("l"), F.lit(SHORT))).alias("cost")).collect()}

    def cost(x: int) -> float:
        light = sum(sets * n_subsets(n, x) for n, (sets, _) in work.items() if n <= x * DEN // NUM)
        heavy = sum(c for n, (_, c) in work.items() if n > x)
        return light + heavy

    return min(range(most + 1), key=lambda x: (cost(x), x))


def _subsets(reps: DataFrame, boundary: int) -> DataFrame:
    """(t, s, p, doc_id, n) of the light sets: a subset's hash and size in place of a shingle and its place."""
    ask = {n: subset_sizes(n, boundary) for n in range(1, boundary * DEN // NUM + 1)}

    def run(batches):
        for batch in batches:
            t, c_of, ids, size = [], [], [], []
            for doc, n, prefix in zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), batch.column("prefix"), strict=True):
                u = np.sort(np.asarray(prefix.values).astype(np.int64).view(np.uint64))
                for c in ask.get(n, []):
                    # a subset is what a few left-out shingles leave of the whole
                    left = np.array(list(combinations(range(n), n - c)), np.int64).reshape(comb(n, c), n - c)
                    sums = mix(u).sum() - mix(u)[left].sum(axis=1)
                    t.append(mix(sums + np.uint64(c * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)))
                    c_of += [c] * len(left)
                    ids += [doc] * len(left)
                    size += [n] * len(left)
            flat = np.concatenate(t).view(np.int64) if t else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(c_of, pa.int32()), pa.array(ids, pa.int64()), pa.array(size, pa.int64())], ["t", "p", "doc_id", "n"])

    light = reps.filter((F.col("n") > 0) & (F.col("n") <= boundary * DEN // NUM)).select("doc_id", "n", "prefix")
    return light.mapInArrow(lean(run), "t long, p int, doc_id long, n long").select("t", F.lit(SUBSET).alias("s"), "p", "doc_id", "n")


def common_in_prefixes(a_n, b_n):
    """Shingles that the prefixes of linked sets of these sizes have in common at least.

    At most ``n - overlap`` shingles of a set are not common, so that is how far in front the j-th
    common one is, plus j - 1: the first of them are inside both prefixes.
    """
    top = np.maximum(a_n, b_n)
    return -(-NUM * (a_n + b_n) // (NUM + DEN)) - -(-NUM * top // DEN) + 1


def _allowed(a_n, b_n, a_p, b_p):
    """Sizes can link, and this can be one of the shingles that ``common_in_prefixes`` counts."""
    need = -(-NUM * (a_n + b_n) // (NUM + DEN)) - common_in_prefixes(a_n, b_n) + 1
    rest = np.minimum(a_n - a_p, b_n - b_p)
    return (np.minimum(a_n, b_n) * DEN >= np.maximum(a_n, b_n) * NUM) & (rest >= need)


def _subset_pairs(t: np.ndarray, c: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs that join what subset lists join, whatever their length.

    Two members of a list have its ``c`` shingles in common, which links them if their sizes ask for
    no more. All members of a size are paired with the first of the smallest size that links with
    theirs, and the firsts of every two sizes that link are paired.
    """
    order = np.lexsort((n, t))
    ts, ns = t[order], n[order]
    edge = np.flatnonzero(np.r_[True, (ts[1:] != ts[:-1]) | (ns[1:] != ns[:-1])])  # a group is the members of one size in a list
    count = np.diff(np.r_[edge, len(ts)])
    first, gt, gn, gc = order[edge], ts[edge], ns[edge], c[order[edge]]
    partner = np.full(len(edge), -1)
    x, y = [], []
    for step in range(len(edge)):
        g = np.arange(len(edge) - step)
        g = g[gt[g] == gt[g + step]]
        if not len(g):
            break
        g = g[-(-NUM * (gn[g] + gn[g + step]) // (NUM + DEN)) <= gc[g]]
        # larger steps reach smaller sizes, so the last one to be written is the smallest
        partner[g + step] = first[g]
        if step:
            x.append(first[g])
            y.append(first[g + step])
            none = g[partner[g] < 0]
            partner[none] = first[none + step]
    with_ = np.repeat(partner, count)
    x.append(order[with_ >= 0])
    y.append(with_[with_ >= 0])
    x, y = np.concatenate(x), np.concatenate(y)
    return x[x != y], y[x != y]


def _scan_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted list entries to candidate pairs (a < b); entries of long lists also come back whole.

    A pair comes with its sizes, the number of short lists that gave it, and ``open``: 1 if it is
    from a long list, 2 if from one of subsets. A list in parts counts as long.
    """

    def out(a, b, an, bn, open_, t, p, doc, n):
        swap = a > b
        rows = np.stack([np.where(swap, b, a), np.where(swap, a, b), np.where(swap, bn, an), np.where(swap, an, bn)], 1)
        rows = np.concatenate([rows, open_[:, None]], 1)[a != b]
        rows, times = np.unique(rows, axis=0, return_counts=True)
        size, extra = len(rows), len(doc)
        none, is_pair = np.zeros(size, np.int64), np.arange(size + extra) < size
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([rows[:, 0], doc])), pa.array(np.concatenate([rows[:, 1], doc])),
                pa.array(np.concatenate([rows[:, 2], n])), pa.array(np.concatenate([rows[:, 3], n])),
                pa.array(np.concatenate([np.where(rows[:, 4] == 0, times, 0), np.zeros(extra, np.int64)])), pa.array(np.concatenate([rows[:, 4], np.zeros(extra, np.int64)])),
                pa.array(np.concatenate([none, t]), mask=is_pair), pa.array(np.concatenate([none, p]), mask=is_pair),
            ],
            ["a", "b", "an", "bn", "times", "open", "t", "p"],
        )

    def work(t, p, doc, n, part):
        pairs, longer = [], [np.zeros(0, np.int64)]
        sub = part == SUBSET
        if sub.any():
            x, y = _subset_pairs(t[sub], p[sub], n[sub])
            pairs.append((doc[sub][x], doc[sub][y], n[sub][x], n[sub][y], np.full(len(x), 2)))
            t, p, doc, n, part = t[~sub], p[~sub], doc[~sub], n[~sub], part[~sub]
        edge = np.flatnonzero(np.r_[np.full(min(1, len(t)), True), (t[1:] != t[:-1]) | (part[1:] != part[:-1])])
        length = np.diff(np.r_[edge, len(t)])
        for size in np.unique(length[length > 1]):
            starts = edge[length == size]
            if size <= SHORT:
                i, j = np.triu_indices(int(size), 1)
            else:
                i, j = np.repeat(np.arange(PIVOTS), size), np.tile(np.arange(size), PIVOTS)
                longer.append((starts[:, None] + np.arange(size)).ravel())
            for some in np.array_split(starts, max(1, len(starts) * len(i) // 1_000_000)):
                x, y = (some[:, None] + i).ravel(), (some[:, None] + j).ravel()
                ok = _allowed(n[x], n[y], p[x], p[y])
                x, y = x[ok], y[ok]
                pairs.append((doc[x], doc[y], n[x], n[y], np.where((size > SHORT) | (part[x] != 0), 1, 0)))
        at = np.unique(np.concatenate([np.concatenate(longer), np.flatnonzero(part > 0)]))
        cols = [np.concatenate([q[k] for q in pairs]) if pairs else np.zeros(0, np.int64) for k in range(5)]
        return out(*cols, t[at], p[at], doc[at], n[at])

    kept: list[list[np.ndarray]] = []  # entries of the list that may go on in the next batch

    def joined(rows: list[list[np.ndarray]]) -> list[np.ndarray]:
        return [np.concatenate(c) for c in zip(*rows, strict=True)]

    for batch in batches:
        cols = [np.asarray(batch.column(c)).astype(np.int64) for c in ("t", "p", "doc_id", "n", "s")]
        t, part = cols[0], cols[4]
        if not len(t):
            continue
        cut = int(np.searchsorted(t, t[-1]))
        cut += int(np.searchsorted(part[cut:], part[-1]))
        if kept and (cut or (kept[-1][0][-1], kept[-1][4][-1]) != (t[0], part[0])):
            yield work(*joined([*kept, [c[:cut] for c in cols]]))
            kept = []
        elif cut:
            yield work(*[c[:cut] for c in cols])
        kept.append([c[cut:] for c in cols])
    if kept:
        yield work(*joined(kept))


_CANDIDATE = "a long, b long, an long, bn long, times long, open long, t long, p long"


def _scan(entries: DataFrame) -> DataFrame:
    """All lists of ``entries``; the order within a list makes its pivots the same in every list."""
    return entries.repartition("t", "s").sortWithinPartitions("t", "s", F.xxhash64("doc_id"), "doc_id").mapInArrow(lean(_scan_lists), _CANDIDATE)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose whole sets overlap enough."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    linked = both * (NUM + DEN) >= (F.size("sa") + F.size("sb")) * NUM
    return pairs.join(left, "a").join(right, "b").filter(linked).select("a", "b")


def _sets_of(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sets of the documents in ``pairs``, computed again from their texts."""
    needed = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    return shingle_sets(docs.select("doc_id", "text"), needed)


def _plausible(pairs: DataFrame, odd: DataFrame) -> DataFrame:
    """Pairs (a, b, an, bn) that their parities allow."""
    for d in ("a", "b"):
        pairs = pairs.join(odd.select(F.col("doc_id").alias(d), F.col("n").alias(f"{d}n"), F.col("parity").alias(f"{d}o")), [d, f"{d}n"])
    return pairs.filter(_parities_allow("ao", "bo", "an", "bn")).select("a", "b").distinct()


def _closed(entries: DataFrame, links: DataFrame, odd: DataFrame, docs: DataFrame, turns: int = 3) -> DataFrame:
    """All links: those given, and those still missing between classes that meet in long lists.

    ``entries`` are (t, doc_id, n, f, ts): ts are a document's shingles with long lists in the order
    of its prefix, and f is where they begin there. Pairs that met in no short list have their first
    common shingle there or later, so at most n - f shingles in common, and all that their prefixes
    have in common is in ts. They are looked at in the list of the first common shingle only. Pairs
    that did meet in a short list are verified already, or ruled out by their number of lists.
    """
    for turn in range(turns + 1):
        classes = stage(connected_components(links), "classes").select(F.col("node").alias("doc_id"), F.col("component_id").alias("cls"))
        members = stage(entries.join(classes, "doc_id", "left").withColumn("cls", F.coalesce("cls", "doc_id")), "members")
        per = members.groupBy("t", "cls").agg(F.count("*").alias("m"))
        mixed = per.groupBy("t").agg(F.max_by("cls", F.struct("m", "cls")).alias("main"), F.max("m").alias("m"), F.count("*").alias("k"), F.ceil(F.sum("m") / MEET).alias("deal")).filter("k > 1").select("t", "main", "m", "deal")
        mixed = stage(mixed, "mixed")
        if mixed.isEmpty():
            break
        within = members.join(mixed, "t").select("t", "doc_id", "n", "f", "cls", "main", "m", "deal", "ts", F.slice("ts", 1, F.array_position("ts", F.col("t")).cast("int") - 1).alias("earlier"))
        x = within.select("t", F.col("doc_id").alias("xd"), F.col("n").alias("xn"), F.col("f").alias("xf"), F.col("cls").alias("xc"), F.col("ts").alias("xt"), F.col("earlier").alias("xe"), "main", "m", F.pmod(F.xxhash64("doc_id"), "deal").alias("dealt"))
        y = within.select("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deal") - 1)).alias("dealt"), F.col("doc_id").alias("yd"), F.col("n").alias("yn"), F.col("f").alias("yf"), F.col("cls").alias("yc"), F.col("ts").alias("yt"), F.col("earlier").alias("ye"))

        def met(x: DataFrame, once: str) -> DataFrame:
            room = f"least(xn - xf, yn - yf) >= ceil((xn + yn) * {NUM} / {NUM + DEN})"
            sizes = f"least(xn, yn) * {DEN} >= greatest(xn, yn) * {NUM}"
            enough = f"size(array_intersect(xt, yt)) >= ceil((xn + yn) * {NUM} / {NUM + DEN}) - ceil(greatest(xn, yn) * {NUM} / {DEN}) + 1"
            return x.select("t", "dealt", "xd", "xn", "xf", "xc", "xt", "xe").join(y, ["t", "dealt"]).filter(f"xc <> yc AND {sizes} AND {room} AND {once} AND {enough}").select("xd", "yd", "xn", "yn")  # noqa: B023

        others = met(x.filter("xc <> main"), "NOT arrays_overlap(xe, ye)")
        few = turn == turns or turn > 0 and others.count() <= 2 * members.count() + 1000
        if not few:  # some members of each list's main class, others in each list and turn
            others = met(x.filter("xc = main").filter(F.pmod(F.xxhash64("xd", "t", F.lit(turn)), F.col("m")) < PIVOTS), "true")
        sized = [F.when(F.col("xd") < F.col("yd"), F.col(p)).otherwise(F.col(q)) for p, q in (("xn", "yn"), ("yn", "xn"))]
        pairs = others.select(F.least("xd", "yd").alias("a"), F.greatest("xd", "yd").alias("b"), sized[0].alias("an"), sized[1].alias("bn")).distinct()
        pairs = stage(_plausible(pairs, odd), "cross")
        links = links.unionByName(stage(_verified(pairs, _sets_of(docs, pairs)), "links"))
        if few:
            break
    return links


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text)."""
    spark: SparkSession = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    common = _common(docs)
    sketches = stage(_sketches(docs, common), "sketches")
    parts = -(-sketches.count() // PART)
    usable = sketches.filter("n > 0 AND doc_id IS NOT NULL")
    same = ["sig1", "sig2", "n"]
    reps = usable.groupBy(*same).agg(F.min_by(F.struct("doc_id", "early", "prefix"), "doc_id").alias("r")).select("n", "r.doc_id", "r.early", "r.prefix")
    odd = usable.select("doc_id", "n", "parity")
    boundary = choose_boundary(reps)

    dealt = f"1 + pmod(xxhash64(doc_id, 1), {parts})" if parts > 1 else "0"
    part = F.expr(f"if(p >= early, {dealt}, 0)").cast("int").alias("s")
    lists = reps.filter(F.col("n") > boundary).select(F.posexplode("prefix").alias("p", "t"), "doc_id", "n", "early").filter(F.expr(f"p <= n - ceil(n * {NUM} / {DEN})")).select("t", part, "p", "doc_id", "n")
    if boundary:
        lists = lists.unionByName(_subsets(reps, boundary))
    found = stage(_scan(lists), "found")
    met = found.filter("t IS NULL").groupBy("a", "b", "an", "bn").agg(F.sum("times").alias("times"), F.max("open").alias("open"))
    entries = found.filter("t IS NOT NULL").select("t", F.col("a").alias("doc_id"), F.col("an").alias("n"), "p")
    of_doc = entries.groupBy("doc_id").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("p", "t"))), lambda e: e["t"])).alias("ts"), F.min("p").alias("f"))
    of_doc = stage(of_doc, "long")
    # shingles that both prefixes have: those of the short lists that gave the pair, and of long lists
    least = F.ceil((F.col("an") + F.col("bn")) * NUM / (NUM + DEN)) - F.ceil(F.greatest("an", "bn") * NUM / DEN) + 1
    for d in ("a", "b"):
        met = met.join(of_doc.select(F.col("doc_id").alias(d), F.col("ts").alias(f"{d}t")), d, "left")
    long_common = F.coalesce(F.size(F.array_intersect("at", "bt")), F.lit(0))
    enough = met.filter((F.col("open") == 2) | (F.col("times") + F.greatest(long_common, F.lit(0)) >= least)).select("a", "b", "an", "bn")
    pairs = stage(_plausible(enough, odd), "pairs")
    links = stage(_verified(pairs, _sets_of(docs, pairs)), "links")
    links = _closed(entries.drop("p").join(of_doc.select("doc_id", "f", "ts"), "doc_id"), links, odd, docs)
    firsts = stage(usable.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")), "sets")
    total = firsts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    # rows of one doc_id with different sets belong together as well
    several = usable.groupBy("doc_id").agg(F.min("sig1").alias("x"), F.max("sig1").alias("y")).filter("x <> y").select("doc_id")
    own = usable.select("doc_id", *same)
    if not several.isEmpty():
        again = join_unique(own.join(several, "doc_id", "left_semi"), firsts, same, "rows", total)
        links = links.unionByName(again.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    classes = stage(connected_components(links), "classes").select(F.col("node").alias("rep"), "component_id")
    of_set = stage(firsts.join(classes, "rep", "left").select(*same, F.coalesce("component_id", "rep").alias("cls"), "rows"), "of_set")
    alone = sketches.filter("n = 0 OR doc_id IS NULL").select("doc_id", *same, F.col("doc_id").alias("cls"))
    out = join_unique(own, of_set, same, "rows", total).unionByName(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("cls")).alias("component_id"))
