"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each character; the dynamic
program carries nothing but the best score and its number of pieces. Ties are those of the
unigram tokenizer: of equal scores the piece that begins first (the longest) stays. A character
without a piece of its own may be covered by the unknown piece, ten below the lowest score, and is
then written as its UTF-8 bytes.

The vocabulary is that of a SentencePiece file: its ordinary pieces with their scores. Spaces are
written as ``▁`` with one more in front of a text. No piece has ``▁`` after another
character, and none has a line feed, so no best path crosses a word's beginning or a line break and
a text's count is the sum over its words: words are counted once and remembered. Texts with a
``▁`` of their own, or other white space that a piece holds, are counted whole.

Defined results: null and empty texts have 0 tokens; a null doc_id stays null; every row, repeated
or not, has its own result; texts of any length are counted whole, in memory of a multiple of the
longest piece besides the text; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.textblocks import blocks, lean, located_words

SPACE = "▁"
#: Entries that a worker remembers.
REMEMBERED = 400_000
UNKNOWN_BELOW = 10.0
#: A text of more bytes is counted in one run instead of word by word, without arrays of its bytes.
LONG = 16 << 20


def vocabulary(model_path: str) -> list[tuple[str, float]]:
    """Ordinary pieces and scores of a SentencePiece file."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_path)
    special = lambda i: m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)
    return [(m.id_to_piece(i), float(m.get_score(i))) for i in range(m.get_piece_size()) if not special(i)]


class UnigramCounter:
    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        controls: set[str] = set()
        for piece, score in pieces:
            if SPACE in piece.lstrip(SPACE) or "\n" in piece or " " in piece:
                raise ValueError(f"the piece {piece!r} reaches across words")
            controls |= set(piece) & set("\t\x0b\x0c\r")
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        #: white space that pieces can hold, and what in UTF-8 may begin a SPACE of the text's own
        self.controls = "".join(sorted(controls)) + SPACE
        self.sticky = np.zeros(256, bool)
        self.sticky[[c.encode()[0] for c in self.controls]] = True
        self.unknown = min(s for _, s in pieces) - UNKNOWN_BELOW
        self.longest = max(len(p) for p, _ in pieces)
        self.known: dict[tuple[int, int], int] = {}

    def count(self, s: str) -> int:
        """Pieces on the best path through ``s``, in which spaces are already ``SPACE``."""
        n = len(s)
        if n == 0:
            return 0
        # rings over the last places that a piece can begin at: memory does not grow with the text
        ring = self.longest + 1
        score, pieces = [0.0] * ring, [0] * ring
        found = self.automaton.iter(s)
        last, match = next(found, (n, None))
        for end in range(1, n + 1):
            here = []
            while last == end - 1:
                here.append(match)
                last, match = next(found, (n, None))
            best, at, single = None, 0, False
            for size, own in sorted(here, reverse=True):
                got = score[(end - size) % ring] + own
                if best is None or got > best:
                    best, at = got, pieces[(end - size) % ring] + 1
                single |= size == 1
            if not single:
                got = score[(end - 1) % ring] + self.unknown
                if best is None or got > best:
                    best, at = got, pieces[(end - 1) % ring] + len(s[end - 1].encode("utf-8", "surrogatepass"))
            score[end % ring], pieces[end % ring] = best, at
        return pieces[n % ring]

    def text(self, text: str) -> int:
        """The count without any decomposition."""
        return self.count(SPACE + text.replace(" ", SPACE)) if text else 0

    def block(self, body: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Counts of a block of texts."""
        import pandas as pd

        n_texts = len(at) - 1
        h, begin, starts, ends = located_words(body, at, fold=False)
        space = body == 32
        # spaces right in front of a place, with the one that every text begins with
        place = np.arange(len(body) + 1)
        other = np.zeros(len(body) + 1, np.int64)
        other[1:][~space] = place[1:][~space]
        np.maximum.accumulate(other, out=other)
        first_of = np.repeat(at[:-1], np.diff(at))

        def spaces_before(where: np.ndarray, first: np.ndarray) -> np.ndarray:
            last = np.maximum(other[where], first)
            return where - last + (last == first)

        lead = spaces_before(starts, first_of[starts])
        where, _ = pd.factorize(h ^ (lead.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        one = np.zeros(where.max() + 1 if len(where) else 0, np.int64)
        one[where[::-1]] = np.arange(len(h))[::-1]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        raw = body.tobytes()
        counts = np.zeros(len(one), np.int64)
        for k, w in enumerate(one.tolist()):
            key = (int(h[w]), int(lead[w]))
            n = self.known.get(key)
            if n is None:
                n = self.known[key] = self.count(SPACE * key[1] + raw[starts[w] : ends[w]].decode("utf-8", "replace"))
            counts[k] = n
        total = np.zeros(len(h) + 1, np.int64)
        np.cumsum(counts[where], out=total[1:])
        out = total[begin[1:]] - total[begin[:-1]]
        # breaks other than spaces are a byte each; spaces in front of them, or of the end, a word of their own
        breaks = np.flatnonzero((body >= 9) & (body <= 13))
        owner = np.searchsorted(at, breaks, "right") - 1
        out += np.bincount(owner, minlength=n_texts)
        full = np.flatnonzero(np.diff(at) > 0)
        stops, owners = np.concatenate([breaks, at[full + 1]]), np.concatenate([owner, full])
        run = spaces_before(stops, at[owners])
        for r in np.unique(run[run > 0]).tolist():
            out += np.bincount(owners[run == r], minlength=n_texts) * self.count(SPACE * r)
        sticky = np.cumsum(np.append(0, self.sticky[body]))
        for d in np.flatnonzero(sticky[at[1:]] > sticky[at[:-1]]):
            text = raw[at[d] : at[d + 1]].decode("utf-8", "replace")
            if any(c in text for c in self.controls):  # these may stick to a word
                out[d] = self.text(text)
        return out


_counters: dict[str, UnigramCounter] = {}


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id and n_tokens of every row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_path not in _counters:
            _counters[model_path] = UnigramCounter(vocabulary(model_path))
        counter = _counters[model_path]
        for batch in batches:
            parts = [
                counter.block(body, at) if len(body) <= LONG else np.array([counter.text(body.tobytes().decode("utf-8", "replace"))])
                for _, _, body, at in blocks(batch.column("text"), 3 << 20)
            ]
            n = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64))], ["doc_id", "n_tokens"])
        counter.known.clear()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, n_tokens long")
