"""Brown class-based n-gram scoring: exchange clustering, class transitions, word emissions.

Texts are written once as blocks: a block's distinct words as 64-bit hashes, and each token as its
number among them. What the corpus teaches is gathered from all training blocks:

* counts of every word: blocks hand the slices of their vocabularies to buckets, ranges of hashes,
  which know every word once and hand counts and classes back in the order of the slices;
* classes, by exchange of every training word: each round sums, over all tokens, the classes to the
  left and right of a quarter of the words, and moves each of them to the class that gives its tokens
  the highest likelihood. Blocks send these counts to the buckets and get one byte a word back, so
  neither the class map nor a matrix of all words is ever in one place. Words that no training text
  has take the class of their hash. With ``top``, only the most frequent words are moved as words,
  and all others share ``COHORTS`` slots by hash;
* class bigrams, counted over all training tokens under the final classes.

log10 P(text) sums log10 P(class | class before) + log10 P(word | class); a text begins after an
end and ends with one, which has a class of its own. Transitions are smoothed towards class
frequency, emissions by one for every word of the class and one for its unseen words, so both sum
to one.

Defined results: a null or empty text has the end as its only token; a null doc_id is never held
out; every row is scored and learned from as a text of its own; texts of any length are scored
whole; words of equal count are in order of hash; an empty table gives an empty result; with no training rows all counts are 0; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.staging import discard, fresh, mark, new_path, stage
from termloom.llm.textblocks import blocks, distinct, lean, words

#: Bytes of text in a block; slots of cohorts; classes, the end's not counted (64 at most: a byte holds class and quarter).
BLOCK_BYTES, COHORTS, CLASSES = 4 << 20, 4096, 48
ROUNDS, QUARTERS = 8, 4
#: Buckets of words at least, words of blocks in a bucket, and words whose contexts are a matrix at once.
BUCKETS, BUCKET_WORDS, AT_ONCE = 64, 1 << 19, 1 << 13
#: Weight of class frequency in a transition, in tokens.
PRIOR = 20.0

_BLOCKS = "block long, ids array<long>, out array<boolean>, begin binary, tokens binary, vocab binary, n_vocab long"


def held_out(fold: int = 2, folds: int = 7):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def _squeeze(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(x.tobytes(), 3)


def _open(data: bytes, kind: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(data, max_output_size=1 << 31), kind)


def encode(docs: DataFrame) -> DataFrame:
    """``_BLOCKS`` of docs (doc_id, text, held_out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for first, last, body, at in blocks(batch.column("text"), BLOCK_BYTES):
                # hashed in small runs, to keep the arrays of single bytes small
                parts, begins, base = [], [np.zeros(1, np.int64)], 0
                for a, b, some, where in _runs(body, at):
                    h, begin = words(some, where)
                    parts.append(h)
                    begins.append(begin[1:] + base)
                    base += len(h)
                h = np.concatenate(parts)
                token, vocab, _ = distinct(h)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number]), pa.array([batch.column("doc_id")[first:last].to_pylist()], pa.list_(pa.int64())),
                        pa.array([batch.column("held_out")[first:last].to_pylist()], pa.list_(pa.bool_())),
                        pa.array([_squeeze(np.concatenate(begins))], pa.binary()), pa.array([_squeeze(token.astype(np.int32))], pa.binary()),
                        pa.array([vocab.astype(np.uint64).tobytes()], pa.binary()), pa.array([len(vocab)], pa.int64()),
                    ],
                    [x.split()[0] for x in _BLOCKS.split(", ")],
                )
                number += 1

    return docs.select("doc_id", "text", "held_out").mapInArrow(lean(run), _BLOCKS)


def _runs(body: np.ndarray, at: np.ndarray, size: int = 1 << 19):
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        yield first, last, body[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(len(batch)):
        yield {n: c[k].as_py() for n, c in zip(batch.schema.names, batch.columns, strict=True)}


def _training(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of training texts, where each text begins, hashes of the block's words)."""
    begin, tokens = _open(row["begin"], "<i8"), _open(row["tokens"], "<i4")
    learn = ~np.array(row["out"], bool)
    size = np.diff(begin)
    kept = np.repeat(learn, size)
    at = np.zeros(int(learn.sum()) + 1, np.int64)
    np.cumsum(size[learn], out=at[1:])
    return tokens[kept], at, np.frombuffer(row["vocab"], "<u8")


def word_counts(coded: DataFrame) -> DataFrame:
    """(h, c): every training word's count."""

    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                tokens, _, vocab = _training(row)
                c = np.bincount(tokens, minlength=len(vocab))
                some = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array(vocab[some].view(np.int64)), pa.array(c[some].astype(np.int64))], ["h", "c"])

    return coded.select("out", "begin", "tokens", "vocab").mapInArrow(lean(run), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class Slots:
    """The slot of every word: its own if it is among the most frequent, else its cohort's."""

    def __init__(self, top: np.ndarray) -> None:
        self.top = np.sort(top)
        self.number = len(self.top) + COHORTS

    def of(self, h: np.ndarray) -> np.ndarray:
        cohort = len(self.top) + (h % np.uint64(COHORTS)).astype(np.int64)
        if not len(self.top):
            return cohort
        at = np.minimum(np.searchsorted(self.top, h), len(self.top) - 1)
        return np.where(self.top[at] == h, at, cohort)


def _summed(rows: DataFrame, tasks: int) -> np.ndarray | None:
    """Sum of the arrays of all rows (id, data) by a tree whose nodes have 64 children at most."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(_open(d.as_py(), "<i8") for d in table.column("data"))
        return pa.table({"id": table.column("id")[:1], "data": pa.array([_squeeze(total)], pa.binary())})

    while tasks > 8:
        tasks = ceil(tasks / 64)
        rows = rows.withColumn("id", F.pmod("id", F.lit(tasks))).groupBy("id").applyInArrow(add, "id long, data binary")
    got = rows.collect()
    return sum(_open(r.data, "<i8") for r in got) if got else None


def context_counts(coded: DataFrame, slots: Slots, classes: np.ndarray, quarter: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class bigrams, and the left and right class counts of the slots of one quarter."""
    k = CLASSES + 1  # the last class is the end's
    mine = np.arange(slots.number) % QUARTERS == quarter
    local = np.cumsum(mine) - 1
    n_local = int(mine.sum())
    shared = coded.sparkSession.sparkContext.broadcast((slots, classes, mine, local))

    def run(batches):
        slots, classes, mine, local = shared.value
        sums = np.zeros(k * k + 2 * n_local * k, np.int64)
        for batch in batches:
            for row in _rows(batch):
                tokens, at, vocab = _training(row)
                slot = slots.of(vocab)
                # each text between two ends
                size = np.diff(at)
                where = np.arange(len(tokens)) + np.repeat(np.arange(len(size)), size) + 1
                chain = np.full(len(tokens) + len(size) + 1, CLASSES, np.int32)
                cls = classes[slot].astype(np.int32)
                chain[where] = cls[tokens]
                if len(size):
                    sums[: k * k] += np.bincount(chain[:-1] * k + chain[1:], minlength=k * k)
                if n_local:
                    act = mine[slot][tokens]
                    w, own = where[act], local[slot].astype(np.int32)[tokens[act]]
                    sums[k * k : k * k + n_local * k] += np.bincount(own * k + chain[w - 1], minlength=n_local * k)
                    sums[k * k + n_local * k :] += np.bincount(own * k + chain[w + 1], minlength=n_local * k)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([_squeeze(sums)], pa.binary())], ["id", "data"])

    rows = coded.select("out", "begin", "tokens", "vocab")
    total = _summed(rows.mapInArrow(lean(run), "id long, data binary"), rows.rdd.getNumPartitions())
    if total is None:
        total = np.zeros(k * k + 2 * n_local * k, np.int64)
    a, b = k * k, k * k + n_local * k
    return total[:a].reshape(k, k), total[a:b].reshape(n_local, k), total[b:].reshape(n_local, k)


def _first_class(slot: np.ndarray) -> np.ndarray:
    return (slot * 2654435761 % (1 << 32) % CLASSES).astype(np.int64)


def exchange(bigrams: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The class of highest likelihood for each slot, given the classes around its tokens."""
    n = bigrams.astype(float) + 0.5
    of = n.sum(0)
    into = np.log(n / n.sum(1, keepdims=True))[:, :CLASSES]  # P(b | c)
    onto = np.log(n / n.sum(1, keepdims=True))[:CLASSES].T  # P(c | b), by c and b
    score = left @ into + right @ onto - left.sum(1, keepdims=True) * np.log(of[:CLASSES])
    return score.round(6).argmax(1)  # equal up to rounding: the first class, however many words are judged at once


def cluster(coded: DataFrame, slots: Slots, rounds: int = ROUNDS) -> np.ndarray:
    """The class of every slot."""
    classes = _first_class(np.arange(slots.number))
    for r in range(rounds):
        quarter = r % QUARTERS
        bigrams, left, right = context_counts(coded, slots, classes, quarter)
        mine = np.flatnonzero(np.arange(slots.number) % QUARTERS == quarter)
        seen = left.sum(1) > 0
        classes[mine[seen]] = exchange(bigrams, left[seen], right[seen])
    return classes


def _dealt(df: DataFrame, column: str, n: int, name: str) -> DataFrame:
    """``df`` written in ``n`` parts by a hash of the column: joins on it need not shuffle it again."""
    spark, path, known = df.sparkSession, new_path(df.sparkSession, name), f"termloom_{name}_{fresh()}"
    df.write.bucketBy(n, column).option("path", path).format("parquet").saveAsTable(known)
    out = spark.table(known)
    spark.sql(f"DROP TABLE {known}")  # the files stay until they are released
    return out


def _index(coded: DataFrame, buckets: int) -> DataFrame:
    """Per bucket: its words' hashes and training counts, and which of them the slices of blocks hold."""
    shift = np.uint64(64 - (buckets - 1).bit_length())

    def sliced(batches):
        for batch in batches:
            for row in _rows(batch):
                tokens, _, vocab = _training(row)
                c = np.bincount(tokens, minlength=len(vocab)).astype(np.int64)
                edges = np.searchsorted(vocab >> shift, np.arange(buckets + 1, dtype=np.uint64))
                some = np.flatnonzero(np.diff(edges))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(some, pa.int64()), pa.array(np.full(len(some), row["block"]), pa.int64()),
                        pa.array([vocab[edges[k] : edges[k + 1]].tobytes() for k in some], pa.binary()), pa.array([_squeeze(c[edges[k] : edges[k + 1]]) for k in some], pa.binary()),
                    ],
                    ["bucket", "block", "h", "c"],
                )

    def gathered(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_py(), "<u8") for x in table.column("h")]
        word, h, _ = distinct(np.concatenate(parts))
        c = np.bincount(word, np.concatenate([_open(x.as_py(), "<i8") for x in table.column("c")]), len(h)).astype(np.int64)
        return pa.table(
            {
                "bucket": table.column("bucket")[:1], "blocks": pa.array([table.column("block").to_pylist()], pa.list_(pa.int64())),
                "sizes": pa.array([[len(x) for x in parts]], pa.list_(pa.int64())), "word": pa.array([_squeeze(word.astype(np.int32))], pa.binary()),
                "h": pa.array([h.tobytes()], pa.binary()), "c": pa.array([_squeeze(c)], pa.binary()),
                "n": pa.array([int((c > 0).sum())], pa.int64()), "t": pa.array([int(c.sum())], pa.int64()),
            }
        )

    rows = coded.select("block", "out", "begin", "tokens", "vocab").mapInArrow(lean(sliced), "bucket long, block long, h binary, c binary")
    return rows.groupBy("bucket").applyInArrow(gathered, "bucket long, blocks array<long>, sizes array<long>, word binary, h binary, c binary, n long, t long")


#: Bytes of class and quarter: of a bucket's words (block -1), or of a block's words in a bucket, with their counts at the end.
_CLASSES = "bucket long, block long, data binary, c binary"


def _handed(bucket: int, state: np.ndarray, row: dict, counted: bool = False) -> pa.RecordBatch:
    """``_CLASSES`` of a bucket and of the slices of blocks in it."""
    edges, word = np.cumsum([0, *row["sizes"]]), _open(row["word"], "<i4")
    data, c = state[word], _open(row["c"], "<i8")[word] if counted else None
    cuts = list(zip(edges[:-1], edges[1:], strict=True))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(cuts) + 1, bucket), pa.int64()), pa.array([-1, *row["blocks"]], pa.int64()), pa.array([state.tobytes(), *(data[a:b].tobytes() for a, b in cuts)], pa.binary()),
            pa.array([None, *(_squeeze(c[a:b]) if counted else None for a, b in cuts)], pa.binary()),
        ],
        ["bucket", "block", "data", "c"],
    )


def _with_classes(coded: DataFrame, classes: DataFrame) -> DataFrame:
    """The blocks with ``parts``, the slices of all buckets."""
    parts = classes.filter("block >= 0").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "data", "c"))).alias("parts"))
    return coded.join(parts.hint("shuffle_hash"), "block", "left")


def _contexts(blocks: DataFrame, quarter: int | None) -> DataFrame:
    """(bucket, block, data): counts of the classes beside a quarter's words; as bucket -1 class bigrams."""
    k = CLASSES + 1

    def run(batches):
        sums, told = np.zeros(k * k, np.int64), [("bucket", pa.int64()), ("block", pa.int64()), ("data", pa.binary())]
        for batch in batches:
            for row in _rows(batch):
                begin, tokens = _open(row["begin"], "<i8"), _open(row["tokens"], "<i4")
                learn, size = ~np.array(row["out"], bool), np.diff(begin)
                tokens, size = tokens[np.repeat(learn, size)], size[learn]
                parts = row["parts"] or []
                packed = np.frombuffer(b"".join(p["data"] for p in parts), np.uint8)
                where = np.arange(len(tokens)) + np.repeat(np.arange(len(size)), size) + 1
                chain = np.full(len(tokens) + len(size) + 1, CLASSES, np.int32)
                chain[where] = (packed & 63)[tokens]
                if len(size):
                    sums += np.bincount(chain[:-1] * k + chain[1:], minlength=k * k)
                if quarter is None:
                    continue
                act = np.flatnonzero((packed >> 6 == quarter)[tokens])
                own, w = tokens[act].astype(np.int64) * (2 * k), where[act]
                keys = np.sort(np.concatenate([own + chain[w - 1], own + k + chain[w + 1]]))
                first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
                n = np.diff(np.append(first, len(keys))).astype(np.int32)
                word, code = np.divmod(keys[first], 2 * k)
                edges = np.cumsum([0, *(len(p["data"]) for p in parts)])
                cuts = np.searchsorted(word, edges)
                rows = []
                for p, a, b, edge in zip(parts, cuts[:-1], cuts[1:], edges[:-1], strict=True):
                    if b > a:
                        data = (word[a:b] - edge).astype(np.int32).tobytes() + n[a:b].tobytes() + code[a:b].astype(np.uint8).tobytes()
                        rows.append((p["bucket"], row["block"], _squeeze(np.frombuffer(data, np.uint8))))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(told)], [x for x, _ in told])
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, (_, t) in zip((-1, TaskContext.get().partitionId(), _squeeze(sums)), told, strict=True)], [x for x, _ in told])

    return blocks.select("block", "out", "begin", "tokens", "parts").mapInArrow(lean(run), "bucket long, block long, data binary")


def _bigrams(contexts: DataFrame, tasks: int) -> np.ndarray:
    total = _summed(contexts.filter("bucket = -1").select(F.col("block").alias("id"), "data"), tasks)
    return (np.zeros((CLASSES + 1) ** 2, np.int64) if total is None else total).reshape(CLASSES + 1, CLASSES + 1)


def _moved(index: DataFrame, classes: DataFrame, contexts: DataFrame, bigrams: np.ndarray) -> DataFrame:
    """``_CLASSES`` after the words with contexts have gone to their best classes."""
    k = CLASSES + 1

    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                state, edges, word = np.frombuffer(row["data"], np.uint8).copy(), np.cumsum([0, *row["sizes"]]), _open(row["word"], "<i4")
                at = dict(zip(row["blocks"], edges, strict=False))
                own, n, code = [], [], []
                for part in row["said"] or []:
                    data = _open(part["data"], np.uint8).tobytes()
                    size = len(data) // 9
                    own.append(word[np.frombuffer(data, "<i4", size) + at[part["block"]]])
                    n.append(np.frombuffer(data, "<i4", size, 4 * size))
                    code.append(np.frombuffer(data, np.uint8, size, 8 * size))
                if own:
                    own, n, code = np.concatenate(own), np.concatenate(n), np.concatenate(code)
                    order = np.argsort(own, kind="stable")
                    own, n, code = own[order], n[order], code[order]
                    new = np.append(True, own[1:] != own[:-1])
                    words, which = own[new], np.cumsum(new) - 1
                    for first in range(0, len(words), AT_ONCE):
                        some = words[first : first + AT_ONCE]
                        a, b = np.searchsorted(which, [first, first + len(some)])
                        around = np.bincount((which[a:b] - first) * (2 * k) + code[a:b], n[a:b], len(some) * 2 * k).reshape(len(some), 2 * k)
                        state[some] = state[some] & 192 | exchange(bigrams, around[:, :k], around[:, k:]).astype(np.uint8)
                yield _handed(row["bucket"], state, row)

    said = contexts.filter("bucket >= 0").groupBy("bucket").agg(F.collect_list(F.struct("block", "data")).alias("said"))
    now = classes.filter("block = -1").select("bucket", "data")
    rows = index.join(now.hint("shuffle_hash"), "bucket").join(said.hint("shuffle_hash"), "bucket", "left")
    return rows.select("bucket", "blocks", "sizes", "word", "c", "data", "said").mapInArrow(lean(run), _CLASSES)


def score_documents(docs: DataFrame, rounds: int = ROUNDS, top: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Every training word is clustered as a word, as ``cluster`` does with slots for all of them. With
    ``top`` it is that many words, and the others by ``COHORTS``.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out())
    began = mark()
    plain = stage(encode(docs), "blocks")
    n_blocks, n_vocab = plain.agg(F.count("*"), F.coalesce(F.sum("n_vocab"), F.lit(0))).first()
    tasks, buckets = max(1, min(ceil(n_blocks / 2), 100_000)), max(BUCKETS, 1 << (n_vocab // BUCKET_WORDS).bit_length())
    coded = _dealt(plain, "block", tasks, "dealt")
    index = _dealt(_index(coded, buckets), "bucket", max(1, min(n_blocks, buckets // 2)), "index")
    n_texts, n_out = docs.agg(F.count("*"), F.count_if("held_out")).first()
    n_ends = n_texts - n_out
    found = {r.bucket: (r.n, r.t) for r in index.select("bucket", "n", "t").collect()}
    n_words, n_tokens = (sum(x) for x in zip((0, 0), *found.values(), strict=True))
    total, distinct_words = n_tokens + n_ends, n_words + (n_ends > 0)
    before = np.cumsum([0, *(found.get(k, (0, 0))[0] for k in range(buckets))])
    discard(spark, began, began + 1)
    chosen = None
    if top is not None:
        own = word_counts(coded).orderBy(F.desc("c"), "h").limit(top).select("h").toArrow()
        slots = Slots(np.asarray(own.column(0)).astype(np.int64).view(np.uint64))
        chosen = spark.sparkContext.broadcast((slots, cluster(coded, slots, rounds)))

    def begun(batches):
        for batch in batches:
            for row in _rows(batch):
                h, known = np.frombuffer(row["h"], "<u8"), _open(row["c"], "<i8") > 0
                if chosen is None:
                    slot = np.where(known, before[row["bucket"]] + np.cumsum(known) - 1, n_words + (h % np.uint64(COHORTS)).astype(np.int64))
                    state = _first_class(slot) | slot % QUARTERS << 6
                else:
                    slots, classes = chosen.value
                    state = classes[slots.of(h)]
                yield _handed(row["bucket"], state.astype(np.uint8), row)

    at = mark()
    classes = stage(index.select("bucket", "blocks", "sizes", "word", "h", "c").mapInArrow(lean(begun), _CLASSES), "classes")
    for r in range(rounds if top is None else 0):
        contexts = stage(_contexts(_with_classes(coded, classes), r % QUARTERS), "contexts")
        now = mark()
        classes = stage(_moved(index, classes, contexts, _bigrams(contexts, tasks)), "classes")
        discard(spark, at, now)
        at = now
    bigrams = _bigrams(_contexts(_with_classes(coded, classes), None), tasks)

    def told(batches):
        for batch in batches:
            for row in _rows(batch):
                yield _handed(row["bucket"], np.frombuffer(row["data"], np.uint8), row, True)

    def per_class(batches):
        sums = np.zeros((2, CLASSES), np.int64)
        for batch in batches:
            for row in _rows(batch):
                cls, c = np.frombuffer(row["data"], np.uint8) & 63, _open(row["c"], "<i8")
                sums[0] += np.bincount(cls, c, CLASSES).astype(np.int64)
                sums[1] += np.bincount(cls[c > 0], minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(sums[0]), pa.array(sums[1])], ["k", "n", "v"])

    settled = index.join(classes.filter("block = -1").select("bucket", "data").hint("shuffle_hash"), "bucket")
    mass = settled.select("data", "c").mapInArrow(per_class, "k long, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    ended = stage(settled.select("bucket", "blocks", "sizes", "word", "c", "data").mapInArrow(lean(told), _CLASSES), "counts")
    in_class = np.ones(CLASSES)
    for r in mass:
        in_class[r.k] = r.n + r.v + 1
    share = (bigrams.sum(0) + 1) / (bigrams.sum() + CLASSES + 1)
    transition = np.log10((bigrams + PRIOR * share) / (bigrams.sum(1, keepdims=True) + PRIOR))
    emission = np.log10(in_class)
    model = spark.sparkContext.broadcast((transition, emission))
    base_all = log(total + distinct_words + 1, 10)
    end_base = log(n_ends + 1, 10) - base_all

    result = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def scored(batches):
        transition, emission = model.value
        for batch in batches:
            for row in _rows(batch):  # one block's bytes are out of Arrow at a time
                begin, tokens, parts = _open(row["begin"], "<i8"), _open(row["tokens"], "<i4"), row["parts"] or []
                cls = (np.frombuffer(b"".join(p["data"] for p in parts), np.uint8) & 63).astype(np.int32)
                c = np.concatenate([np.zeros(0, np.int64), *(_open(p["c"], "<i8") for p in parts)])
                log_c = np.log10(c + 1.0)
                size = np.diff(begin)
                n = len(size)
                word = (log_c - emission[cls])[tokens]
                chain = np.full(len(tokens) + n + 1, CLASSES, np.int32)
                chain[np.arange(len(tokens)) + np.repeat(np.arange(n), size) + 1] = cls[tokens]
                step = transition[chain[:-1], chain[1:]]
                first = begin[:-1] + np.arange(n)
                own = _sums(step, first, begin[1:] + np.arange(n) + 1) + _sums(word, begin[:-1], begin[1:])
                base = _sums((log_c - base_all)[tokens], begin[:-1], begin[1:]) + end_base
                seen = _sums((c > 0)[tokens].astype(np.int64), begin[:-1], begin[1:]) + (n_ends > 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["ids"], pa.int64()), pa.array(row["out"], pa.bool_()), pa.array(size + 1, pa.int64()), pa.array(seen.astype(np.int64)),
                        pa.array(np.full(n, total, np.int64)), pa.array(base), pa.array(own),
                    ],
                    [x.split()[0] for x in result.split(", ")],
                )

    return _with_classes(coded, ended).select("ids", "out", "begin", "tokens", "parts").mapInArrow(lean(scored), result)


def _sums(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sum of each run of ``x``; runs follow one another and may be empty."""
    if not len(first):
        return np.zeros(0, x.dtype)
    out = np.add.reduceat(np.append(x, x.dtype.type(0)), first)
    return np.where(last > first, out, x.dtype.type(0))
