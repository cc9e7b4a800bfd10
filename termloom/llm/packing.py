"""Best-fit packing of tokenized documents by a grouping genetic algorithm on islands.

Documents become runs of token ids; runs over the capacity are cut. Every piece has a number of its
own, whose hash deals it into a shard of about ``SHARD`` pieces, so equal rows spread like others.
Each shard is bred on ``ISLANDS`` islands for ``EPOCHS`` epochs: an individual is a list of bins,
crossover injects whole well-filled bins of one parent into another, bins that hold a document
twice are dissolved and their documents put back by best fit. After an epoch the best individual
of each island migrates to the next one. A shard whose best fit already meets the bound of no
packing with fewer bins is left as it is.

Bins that are short of full are dissolved, and their pieces go into the shards of the next level,
until one shard holds all that is left. What counts as full is a free space, the same for all bins
of a level; it doubles when a level fills hardly any bin, as sizes may leave nothing better.

Island epochs are tasks over (shard, island) rows that carry sizes, not tokens; a lost executor
costs the epochs of its shards.

Defined results: a null text is an empty text and yields its end id alone; every row is a document
of its own, also if its doc_id is null or repeated; texts of any length are cut into pieces; pieces
of one length are interchangeable, ties go by their numbers; an empty table gives no pieces; only
doc_id and text are read.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.staging import stage
from termloom.llm.textblocks import blocks, distinct, lean, located_words

CAPACITY = 4096
SHARD = 4096
ISLANDS, EPOCHS = 4, 3
#: Free space of a full bin, as a part of the capacity; it doubles after a level that leaves more
#: than this share of its pieces in bins short of full.
FREE, MOST_LEFT = 16, 0.75
#: Bytes of text that are tokenized at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 19
#: Entries that a worker remembers of the words it has tokenized, some 40 bytes each.
REMEMBERED = 400_000
#: Entries that it keeps for its next partition.
KEPT = 50_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, uid long"


class ChunkTokenizer:
    """Ids of whole texts by way of remembered chunks.

    The vocabulary's rules drop white space and never reach across it, so a text's ids are those
    of its chunks between ASCII white space, one after the other. Chunks are looked up by a 64-bit
    hash of their bytes with A-Z lower-cased. Where the tokenizer's own order of normalization
    could notice that (combining marks, special tokens), the whole text goes through it instead.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: ids of the punctuation marks that, behind a letter or digit, are words of their own
        self.tail_ids = np.zeros(256, np.int64)
        for b in np.flatnonzero(_TAIL):
            (self.tail_ids[b],) = self.tokenizer.encode(chr(b), add_special_tokens=False).ids
        self._forget()

    def _forget(self, keep: np.ndarray | None = None) -> None:
        """Forget all chunks, or all but those at the places ``keep``.

        Chunks lie in the order of their hashes; their ids lie one after the other in ``flat``.
        """
        if keep is not None and len(keep):
            self.hashes, first, self.size = self.hashes[keep], self.first[keep], self.size[keep]
            ends = np.cumsum(self.size, dtype=np.int32)
            self.flat = self.flat[np.repeat(first - ends + self.size, self.size) + np.arange(ends[-1], dtype=np.int32)]
            self.first, self.used = ends - self.size, int(ends[-1])
        else:
            self.hashes, self.flat, self.used = np.zeros(0, np.uint64), np.zeros(1 << 16, "<u4"), 0
            self.first, self.size = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.met = np.zeros(len(self.hashes), np.int32)

    def shrink(self, most: int) -> None:
        """Keep the chunks that were met in more than one block, ``most`` at most, and no other."""
        often = np.flatnonzero(self.met > 1)
        if len(often) > most:
            often = np.sort(often[np.argsort(-self.met[often], kind="stable")[:most]])
        self._forget(often)

    def _learn(self, hashes: np.ndarray, chunks: list[str]) -> None:
        """Many chunks go in one text with a space between; offsets tell whose an id is.

        ``hashes`` are sorted and not known yet.
        """
        ids, sizes = [], []
        lists = [chunks[k : k + 64] for k in range(0, len(chunks), 64)]
        for some, e in zip(lists, self.tokenizer.encode_batch([" ".join(x) for x in lists], add_special_tokens=False), strict=True):
            begin = np.cumsum([0, *(len(c) + 1 for c in some)])
            offsets = np.array(e.offsets, np.int64).reshape(-1, 2)[:, 0]
            sizes.append(np.bincount(np.searchsorted(begin, offsets, "right") - 1, minlength=len(some)))
            ids.append(np.array(e.ids, "<u4"))
        size, new = np.concatenate(sizes), np.concatenate(ids)
        at = self.used
        while at + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[at : at + len(new)] = new
        self.used += len(new)
        at_hash = np.searchsorted(self.hashes, hashes)
        first = (at + np.cumsum(size) - size).astype(np.int32)
        self.hashes = np.insert(self.hashes, at_hash, hashes)
        self.first = np.insert(self.first, at_hash, first)
        self.size = np.insert(self.size, at_hash, size.astype(np.int32))
        self.met = np.insert(self.met, at_hash, 0)

    def block(self, body: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
        """Ids of every text of a block."""
        h, begin, starts, ends = located_words(body, at, tails=_TAIL)
        where, seen, there = distinct(h)
        if len(self.hashes) > REMEMBERED:
            self.shrink(REMEMBERED // 2)
        number = np.searchsorted(self.hashes, seen)
        known = np.zeros(len(seen), bool)
        inside = number < len(self.hashes)
        known[inside] = self.hashes[number[inside]] == seen[inside]
        miss = np.flatnonzero(~known)
        if len(miss):
            raw, of = body.tobytes(), there[miss]
            self._learn(seen[miss], [raw[a:b].lower().decode("utf-8", "replace") for a, b in zip(starts[of].tolist(), ends[of].tolist(), strict=True)])
            number = np.searchsorted(self.hashes, seen)
        self.met[number] += 1
        number = number[where] if len(h) else np.zeros(0, np.int64)
        # a tail that was split off is one id more
        last = np.zeros(len(h), np.int64)
        inside = ends < len(body)
        last[inside] = self.tail_ids[body[ends[inside]]]
        last[np.isin(ends, at[1:], assume_unique=False)] = 0
        size = self.size[number] + (last > 0)
        before = np.zeros(len(h) + 1, np.int32)
        np.cumsum(size, out=before[1:])
        index = np.repeat(self.first[number] - before[:-1], size) + np.arange(before[-1], dtype=np.int32)
        ids = self.flat[np.minimum(index, len(self.flat) - 1)]
        tailed = last > 0
        ids[before[1:][tailed] - 1] = last[tailed]
        odd = _ODD_BYTES[body]
        for d in range(len(at) - 1):
            if odd[at[d] : at[d + 1]].any():
                text = body[at[d] : at[d + 1]].tobytes()
                if b"\xcc" in text or b"\xcd" in text or b"<|" in text:
                    yield np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4")
                    continue
            yield ids[before[begin[d]] : before[begin[d + 1]]]


_TAIL = np.zeros(256, bool)
_TAIL[[ord(c) for c in ".,;:!?"]] = True
_ODD_BYTES = np.zeros(256, bool)
_ODD_BYTES[[0xCC, 0xCD, ord("|")]] = True

_tokenizers: dict[str, ChunkTokenizer] = {}


def _tokenizer(path: str) -> ChunkTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokenizer(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every document's pieces: at most ``capacity`` ids each, the last one may be shorter.

    ``uid`` numbers the pieces of a table that is written: partition and place. ``with_ids`` adds the ids themselves, as little-endian unsigned 32-bit bytes.
    """
    end = np.array([end_id], "<u4")
    schema = PIECES + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = _tokenizer(tokenizer_path), TaskContext.get().partitionId() << 40
        for batch in batches:
            rows, docs = [], batch.column("doc_id").to_pylist()
            for first, _, body, at in blocks(batch.column("text"), BLOCK_BYTES):
                for doc, ids in zip(docs[first:], own.block(body, at), strict=False):
                    data = np.concatenate([ids, end]).tobytes()
                    for p, where in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[where : where + 4 * capacity]
                        rows.append((doc, p, where // 4, len(part) // 4, zlib.crc32(part), number, *[part] * with_ids))
                        number += 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * with_ids]
            cols = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in schema.split(", ")])
        own.shrink(KEPT)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), schema)


class Bins:
    """Bins of one capacity with the fullest fitting bin found in a bit set of free spaces."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.free, self.mask = capacity, [[] for _ in range(capacity + 1)], 0
        self.bins: list[list[int]] = []
        self.room: list[int] = []

    def _list(self, b: int) -> None:
        r = self.room[b]
        self.free[r].append(b)
        self.mask |= 1 << r

    def add_bin(self, items: list[int], used: int) -> None:
        self.bins.append(items)
        self.room.append(self.capacity - used)
        self._list(len(self.bins) - 1)

    def best_fit(self, item: int, size: int) -> None:
        fits = self.mask >> size
        if not fits:
            self.add_bin([item], size)
            return
        r = size + (fits & -fits).bit_length() - 1
        b = self.free[r].pop()
        if not self.free[r]:
            self.mask &= ~(1 << r)
        self.bins[b].append(item)
        self.room[b] = r - size
        self._list(b)


def _best_fit_decreasing(sizes: list[int], order: list[int], capacity: int, start: list[list[int]] = ()) -> list[list[int]]:
    out = Bins(capacity)
    for items in start:
        out.add_bin(items, sum(sizes[i] for i in items))
    for i in order:
        out.best_fit(i, sizes[i])
    return out.bins


def _fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones."""
    return -len(bins), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins)


def crossover(a: list[list[int]], b: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Inject whole well-filled bins of ``b`` into ``a``; what that displaces is put back by best fit."""
    filled = [x for x in b if sum(sizes[i] for i in x) >= 0.97 * capacity]
    injected = [list(x) for x in filled if rng.random() < 0.5]
    inside = {i for x in injected for i in x}
    kept, displaced = [], []
    for x in a:
        if any(i in inside for i in x):
            displaced += [i for i in x if i not in inside]
        else:
            kept.append(list(x))
    # the emptiest bins are dissolved too, so that their documents can fill gaps
    kept.sort(key=lambda x: sum(sizes[i] for i in x))
    cut = max(1, len(kept) // 20)
    displaced += [i for x in kept[:cut] for i in x]
    displaced.sort(key=lambda i: -sizes[i])
    return _best_fit_decreasing(sizes, displaced, capacity, injected + kept[cut:])


def fewest_bins(sizes: list[int], capacity: int) -> int:
    """A number of bins that no packing goes below, by sizes above and below half of a bin.

    For a smallest size a that still counts: sizes over half a bin have a bin each, and those of at
    least a and at most half go into what the bins of sizes up to capacity - a leave free, or more bins.
    """
    s = np.sort(np.asarray(sizes, np.int64))
    total = np.concatenate([[0], np.cumsum(s)])
    half = int(np.searchsorted(s, capacity // 2, "right"))
    a = np.concatenate([[0], np.unique(s[:half])])
    at, top = np.searchsorted(s, a), np.maximum(np.searchsorted(s, capacity - a, "right"), half)
    spare = (top - half) * capacity - (total[top] - total[half])
    more = -(-np.maximum(total[half] - total[np.minimum(at, half)] - spare, 0) // capacity)
    return int((len(s) - half + more).max()) if len(s) else 0


def breed(sizes: list[int], capacity: int, seed: int, start: list[list[list[int]]], population: int = 6, rounds: int = 12) -> list[list[int]]:
    """One island's epoch: the best individual found. Stops at the bound that no packing beats."""
    rng = random.Random(seed)
    least = fewest_bins(sizes, capacity)
    pool = [p for p in start if p]
    by_size = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    if not pool:
        pool.append(_best_fit_decreasing(sizes, by_size, capacity))
    score = [_fitness(p, sizes, capacity) for p in pool]
    if -max(score)[0] > least:
        while len(pool) < population:
            order = sorted(range(len(sizes)), key=lambda i: -sizes[i] * rng.uniform(0.8, 1.25))
            pool.append(_best_fit_decreasing(sizes, order, capacity))
            score.append(_fitness(pool[-1], sizes, capacity))
        for _ in range(rounds):
            if -max(score)[0] <= least:
                break
            x, y = rng.sample(range(len(pool)), 2)
            child = crossover(pool[x], pool[y], sizes, capacity, rng)
            got = _fitness(child, sizes, capacity)
            worst = min(range(len(pool)), key=score.__getitem__)
            if got > score[worst]:
                pool[worst], score[worst] = child, got
    return pool[max(range(len(pool)), key=score.__getitem__)]


def _epoch(capacity: int, epoch: int):
    """A (shard, island) row's epoch; the individual is the bin of each piece."""

    def bins_of(places: np.ndarray) -> list[list[int]]:
        order = np.argsort(places, kind="stable")
        return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(places[order])) + 1)] if len(order) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                sizes = row["sizes"]
                start = [bins_of(np.frombuffer(p, "<i4")) for p in row["start"] or []]
                best = breed(sizes, capacity, (row["shard"] * ISLANDS + row["island"]) * EPOCHS + epoch, start)
                places = np.empty(len(sizes), "<i4")
                for b, items in enumerate(best):
                    places[items] = b
                fit = _fitness(best, sizes, capacity)
                out.append((row["shard"], row["island"], row["sizes"], [places.tobytes()], float(fit[0]) * 1e6 + fit[1]))
            cols = list(zip(*out, strict=True)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["shard", "island", "sizes", "start", "fit"])

    return run


_ISLAND = "shard long, island int, sizes array<int>, start array<binary>, fit double"


def _dealt(rows: DataFrame, shards: int, level: int) -> DataFrame:
    """Pieces in shards of about ``SHARD``, one row each, in an order that a rerun repeats."""
    spread = F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(shards)).alias("shard")
    item = F.struct("length", "uid", "piece", "start", "doc_id", "ids_crc32")
    return rows.groupBy(spread).agg(F.sort_array(F.collect_list(item), asc=False).alias("items"))


def _breed_shards(dealt: DataFrame, capacity: int) -> DataFrame:
    """(shard, places): the best packing of each shard over all islands."""
    sizes = F.transform("items", lambda i: i["length"].cast("int")).alias("sizes")
    now = dealt.select("shard", F.explode(F.array(*[F.lit(k) for k in range(ISLANDS)])).alias("island"), sizes, F.lit(None).cast("array<binary>").alias("start"))
    for epoch in range(EPOCHS):
        bred = now.mapInArrow(_epoch(capacity, epoch), _ISLAND)
        # an island goes on with its own best and the elite of the one before it
        came = bred.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"), F.col("start").alias("elite"))
        now = bred.join(came, ["shard", "island"]).select("shard", "island", "sizes", F.concat("start", "elite").alias("start"))
    return bred.groupBy("shard").agg(F.max_by("start", F.struct("fit", "island"))[0].alias("places"))


def _placed(capacity: int, level: int, free: int):
    """Pieces with sequence_id and offset, and whether their bin is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "uid", "sequence_id", "offset", "full"]
        for batch in batches:
            for shard, items, places in zip(batch.column("shard").to_pylist(), batch.column("items"), batch.column("places"), strict=True):
                flat = items.values
                cols = {n: flat.field(n) for n in names[:6]}
                size = np.asarray(cols["length"])
                place = np.frombuffer(places.as_py(), "<i4").astype(np.int64)
                order = np.argsort(place, kind="stable")
                p, s = place[order], size[order]
                new = np.ones(len(p), bool)
                new[1:] = p[1:] != p[:-1]
                before = np.cumsum(s) - s
                offset = before - np.maximum.accumulate(np.where(new, before, 0))
                full = np.bincount(place, size) >= capacity - free
                # 2^20 bins a shard, 2^36 shards a level
                seq = (np.int64(level) << np.int64(56)) + (np.int64(shard) << np.int64(20)) + p
                index = pa.array(order)
                yield pa.RecordBatch.from_arrays([*[cols[n].take(index) for n in names[:6]], pa.array(seq), pa.array(offset), pa.array(full[p])], names)

    return run


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``PIECES`` rows with sequence_id and offset; ``uid`` must tell all rows apart."""
    done, level, free = None, 0, capacity // FREE
    rows = stage(rows, "pieces")
    n = rows.count()
    while True:
        shards = max(1, -(-n // SHARD))
        dealt = stage(_dealt(rows, shards, level), "shards")
        packed = dealt.join(_breed_shards(dealt, capacity), "shard").mapInArrow(_placed(capacity, level, free), PIECES + ", sequence_id long, offset long, full boolean")
        packed = stage(packed, "packed")
        left = packed.filter("NOT full").count()
        last = shards == 1 or left == 0
        fixed = (packed if last else packed.filter("full")).drop("full")
        done = fixed if done is None else done.unionByName(fixed)
        if last:
            return done
        free = max(1, 2 * free) if left > MOST_LEFT * n else free
        rows, n, level = packed.filter("NOT full").drop("sequence_id", "offset", "full"), left, level + 1


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    return pack(pieces(docs, tokenizer_path, end_id, capacity), capacity).drop("uid")


def sequences(docs: DataFrame, packed: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, ids): the sequences that ``pack_documents`` planned, as bytes of their ids."""
    same = ["doc_id", "piece", "ids_crc32"]
    texts = pieces(docs, tokenizer_path, end_id, capacity, with_ids=True).select(*same, "ids").dropDuplicates(same).alias("t")
    plan = packed.alias("p")
    on = F.expr("t.doc_id <=> p.doc_id AND t.piece = p.piece AND t.ids_crc32 = p.ids_crc32")
    parts = F.array_sort(F.collect_list(F.struct("p.offset", "t.ids")))
    whole = F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return plan.join(texts, on).groupBy("p.sequence_id").agg(whole.alias("ids"))
