"""Operators over texts against brute force, with nulls, empty and long texts, ties and repeats."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termloom.llm import class_lm, decontaminate, jaccard_join, language_id, line_dedup, packing, textblocks, token_counts
from termloom.llm.queries import tokenizer_path

WORDS = ["the", "of", "and", "ing", "éa", "tion", "Thé", "Ou", "x", "nd,", "la."]
EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))


def some_texts(seed, n, longest=60):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(longest))) for _ in range(n)]


def table(spark, rows, extra=True):
    """Documents with columns whose names clash with those of the operators."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"component_id": F.lit(1), "key": F.lit("k"), "n": F.lit(2), "a.b": F.lit(0), "s": F.lit(0)}) if extra else df


# ---- words and shingles ----


def test_words_and_shingles():
    texts = some_texts(1, 300) + [None, "", "  \n\t", "a", "A b", "a b c d e", "\x0bx\x0c y"]
    seen, back = {}, {}
    for first, last, body, at in textblocks.blocks(pa.array(texts), 500):
        h, begin = textblocks.words(body, at)
        s, sb = textblocks.shingles(h, begin)
        for d in range(first, last):
            w = words(texts[d])
            k = d - first
            assert begin[k + 1] - begin[k] == len(w)
            want = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] * bool(w)
            got = s[sb[k] : sb[k + 1]].tolist()
            assert len(got) == len(want)
            for x, y in zip(want, got, strict=True):
                assert seen.setdefault(x, y) == y and back.setdefault(y, x) == x


# ---- 3: lines ----


def lines_by_force(rows, min_chars=20, min_docs=3):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({k: k + 32 for k in range(65, 91)})
    docs = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= min_chars:
                docs.setdefault(key(x), set()).add(d)
    out = []
    for d, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if d is None or len(docs.get(key(x), ())) < min_docs or max(docs[key(x)]) == d]
        out.append((d, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup(spark, seed):
    rng = random.Random(seed)
    pool = ["A common line of twenty chars", "a COMMON line of twenty chars  ", "Éa common line of twenty", "short", "", "another line that is rather long", "\tanother line that is rather long\r"] + some_texts(seed, 6, 8)
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randrange(6)))) for k in range(60)] + [(7, "x\n" + pool[0]), (None, pool[0]), (None, pool[0]), (61, None), (62, ""), (63, "\n".join([pool[0]] * 500)), (63, "\n".join([pool[0]] * 500))]
    got = line_dedup.line_dedup(table(spark, rows)).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256)).collect()
    assert sorted(map(tuple, got), key=repr) == lines_by_force(rows)


def test_line_dedup_stays_in_the_jvm(spark):
    plan = line_dedup.line_dedup(table(spark, [(1, "x" * 30)]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_line_dedup_splits_heavy_and_light(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "most_heavy", lambda df: 4)
    rows = [(k, "a line that everyone has got\n" + f"a line that {k % 4} shares with few\nown {k} line of this document") for k in range(20)]
    got = line_dedup.line_dedup(table(spark, rows)).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256)).collect()
    assert sorted(map(tuple, got), key=repr) == lines_by_force(rows)


# ---- 5: near copies ----


def classes_by_force(rows):
    sets, parent = [], {}
    for d, t in rows:
        w = words(t)
        sets.append((d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
        if d is not None:
            parent[d] = d

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    return sorted(((d, len(x), None if d is None else find(d)) for d, x in sets), key=repr)


def copies(seed, groups, size, length, edits):
    rng = random.Random(seed)
    fresh = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    out = []
    for _ in range(groups):
        base = [fresh() for _ in range(length)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(edits + 1)):
                own[rng.randrange(length)] = fresh()
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_copies(spark, seed):
    rng = random.Random(seed)
    texts = copies(seed, 4, 8, 60, 3) + copies(seed + 9, 12, 5, 8, 1) + copies(seed + 20, 10, 4, 14, 1) + copies(seed + 30, 10, 3, 3, 1) + some_texts(seed, 30, 12)
    texts += [texts[0], texts[0], texts[40].upper(), None, "", " \n", "one"]
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(3, texts[5]), (None, texts[0]), (None, None)]
    got = jaccard_join.jaccard_classes(table(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == classes_by_force(rows)


def test_near_copies_in_long_lists(spark):
    rows = list(enumerate(copies(5, 1, 150, 80, 4) + copies(6, 1, 60, 30, 2)))
    got = jaccard_join.jaccard_classes(table(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == classes_by_force(rows)


def test_near_copies_with_lists_in_parts(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PART", 40)
    passage = copies(7, 1, 1, 30, 0)[0]
    rows = list(enumerate([f"{passage} {x}" for x in copies(8, 90, 1, 6, 0)] + copies(9, 1, 60, 40, 2)))
    got = jaccard_join.jaccard_classes(table(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == classes_by_force(rows)


def test_near_copies_of_a_hub_in_long_subset_lists(spark, monkeypatch):
    chosen, choose = [], jaccard_join.choose_boundary
    monkeypatch.setattr(jaccard_join, "choose_boundary", lambda reps: chosen.append(choose(reps)) or chosen[-1])
    texts = []
    for seed, (length, more) in enumerate([(8, 1), (9, 1), (11, 1), (12, 2)]):
        hub = copies(40 + seed, 1, 1, length, 0)[0]
        texts += [hub] + [f"{hub} {x}" for x in copies(50 + seed, 40, 1, more, 0)]
    random.Random(4).shuffle(texts)
    rows = list(enumerate(texts))
    got = jaccard_join.jaccard_classes(table(spark, rows)).collect()
    assert chosen[0] > 0
    assert len({r.component_id for r in got}) == 4
    assert sorted(map(tuple, got), key=repr) == classes_by_force(rows)


def test_subset_pairs_join_what_lists_join():
    rng = np.random.default_rng(1)
    t = np.repeat(np.arange(300), rng.integers(1, 50, 300))
    c = (3 + t % 9).astype(np.int64)
    n = c + rng.integers(0, 4, len(t))
    x, y = jaccard_join._subset_pairs(t, c, n)
    assert len(x) < 3 * len(t)
    need = lambda i, j: jaccard_join.overlap(int(n[i]), int(n[j])) <= c[i]
    given = {k: [] for k in range(300)}
    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        assert t[i] == t[j] and need(i, j)
        given[t[i]].append((i, j))

    def joined(members, pairs):
        low = {i: i for i in members}
        for _ in members:
            for i, j in pairs:
                low[i] = low[j] = min(low[i], low[j])
        return low

    for k in range(300):
        members = np.flatnonzero(t == k).tolist()
        assert joined(members, given[k]) == joined(members, [(i, j) for i, j in itertools.combinations(members, 2) if need(i, j)])


def test_parities_never_rule_out_a_link(spark):
    """The bits that differ are at most the shingles that only one set has, also for unlike sizes."""
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(200):
        n = int(rng.integers(1, 400))
        u = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        v = np.unique(np.concatenate([rng.permutation(u)[: int(len(u) * rng.uniform(0.7, 1))], rng.integers(0, 1 << 63, int(rng.integers(0, n // 4 + 2))).astype(np.uint64)]))
        if len(v) and min(len(u), len(v)) * 100 >= 80 * max(len(u), len(v)):
            linked = 100 * len(np.intersect1d(u, v)) >= 80 * len(np.union1d(u, v))
            rows.append((jaccard_join.parities(u).tolist(), jaccard_join.parities(v).tolist(), len(u), len(v), bool(linked)))
    df = spark.createDataFrame(rows, "x array<long>, y array<long>, xn long, yn long, linked boolean")
    got = df.selectExpr("linked", f"{jaccard_join._parities_allow('x', 'y', 'xn', 'yn')} AS allowed").collect()
    assert all(r.allowed for r in got if r.linked) and sum(r.linked for r in got) > 20 and not all(r.allowed for r in got)


def test_sets_by_marks_and_by_join(spark):
    docs = table(spark, list(enumerate(some_texts(3, 60))), extra=False)
    needed = spark.createDataFrame([(k,) for k in range(0, 60, 7)], "doc_id long")
    by_join = {r.doc_id: r.shingles for r in jaccard_join.shingle_sets(docs, needed, most_bits=1).collect()}
    by_marks = {r.doc_id: r.shingles for r in jaccard_join.shingle_sets(docs, needed).collect()}
    assert set(by_join) == set(range(0, 60, 7)) and all(by_marks[k] == v for k, v in by_join.items())


def test_large_groups_of_exact_and_near_copies(spark, monkeypatch):
    """Most rows are one text or near it, and the heavy sets go by the broadcast side."""
    from termloom.llm import skew

    monkeypatch.setattr(skew, "most_heavy", lambda df: 4)
    near = copies(7, 1, 300, 60, 2)
    others = copies(8, 20, 1, 30, 0)
    texts = [near[0]] * 1500 + near + others + [""] * 200 + [others[0]] * 3
    rows = [(k, t) for k, t in enumerate(texts)]
    got = jaccard_join.jaccard_classes(table(spark, rows)).collect()
    distinct = list(dict.fromkeys(texts))
    of = {t: c for (t, _), c in zip([(t, 0) for t in distinct], [c for _, _, c in sorted(classes_by_force([(texts.index(t), t) for t in distinct]))], strict=True)}
    assert sorted((r.doc_id, r.component_id) for r in got) == [(k, of[t] if t else k) for k, t in rows]


def test_overlap_bounds():
    for a in range(1, 60):
        for b in range(max(1, -(-80 * a // 100)), a * 100 // 80 + 1):
            need = jaccard_join.overlap(a, b)
            assert 180 * need >= 80 * (a + b) > 180 * (need - 1)
            assert jaccard_join.common_in_prefixes(np.int64(a), np.int64(b)) >= 1


# ---- 1: leaks ----


def distance_by_force(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        before, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (c != t))
    return min(row)


def test_myers():
    rng = random.Random(4)
    for _ in range(200):
        p = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 90)))
        t = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 120)))
        got, end = decontaminate.myers(p, t, len(p))
        assert got == distance_by_force(p, t) and (end == -1 or 0 <= end <= len(t))


def test_leaks(spark):
    rng = random.Random(6)
    items = [(k, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(rng.choice([4, 15, 40])))) for k in range(25)] + [(90, None), (91, ""), (92, "short"), (0, "a repeated number of an item here")]
    rows = []
    for k in range(120):
        text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(20))
        if k % 2:
            item = list(rng.choice(items[:25])[1])
            for _ in range(rng.randrange(len(item) // 6 + 1)):
                at = rng.randrange(len(item))
                item[at : at + rng.randrange(2)] = rng.choice(["", "z", "q"])
            text += " -- " + "".join(item).upper().replace(" ", "\n") + "! " + text[::-1]
        rows.append((k, text))
    rows += [(200, None), (201, ""), (None, items[3][1]), (3, rows[3][1]), (202, "Short."), (203, "in short, no"), (204, "shorter shor t ashort")]
    rows += [(205, "x" * 3_000 + " " + items[5][1] + " " + "y z " * 500)]
    want = []
    for d, t in rows:
        n = decontaminate.normalized(t)
        for i, x in items:
            m = decontaminate.normalized(x)
            if len(m) >= 20 and n and (e := distance_by_force(m, n)) <= int(len(m) * 0.1):
                want.append((d, i, e))
            elif 0 < len(m) < 20 and f" {m} " in f" {n} ":  # short items: as whole words, without an edit
                want.append((d, i, 0))
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_leaks(table(spark, rows), frame).collect()
    assert sorted(((r.doc_id, r.item_id, r.distance) for r in got), key=repr) == sorted(want, key=repr) and len(want) > 20
    split = decontaminate.find_leaks(table(spark, rows), frame, block_chars=300).collect()
    assert sorted(map(tuple, split), key=repr) == sorted(map(tuple, got), key=repr)
    texts = dict((d, t) for d, t in rows)
    for r in got:
        if r.distance == 0:
            own = decontaminate.normalized(texts[r.doc_id][r.start : r.end])
            assert own in {decontaminate.normalized(x) for i, x in items if i == r.item_id}
    leaking = {(d, t) for d, t in rows if any(d == w[0] for w in want)}
    clean = decontaminate.without_leaks(table(spark, rows), frame).select("doc_id", "text").collect()
    assert sorted(map(tuple, clean), key=repr) == sorted((r for r in rows if r not in leaking), key=repr)


# ---- 6: token counts ----


def test_token_counts(spark):
    from tokenizers import Tokenizer, models

    vocab = token_counts.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    low = min(s for _, s in vocab) * 1000
    tokenizer = Tokenizer(models.Unigram([("\U0010ffff\U0010ffff", low), *[(f"<0x{b:02X}>", low) for b in range(256)], *vocab], unk_id=0, byte_fallback=True))
    rng = random.Random(5)
    bits = ["the", "ing", "a", "é", " ", "  ", "\n", "▁", "🙂", "X", "ß", "\t", "日", ";\r", "\x0c"]
    rows = list(enumerate(["", None, " ", "a ", "\n", " a  b\n\nc \t d   ", "<0x41> <s>", "x" * 5000] + ["".join(rng.choice(bits) for _ in range(rng.randrange(50))) for _ in range(400)])) + [(None, "a b"), (2, "again")]
    got = token_counts.token_counts(table(spark, rows), tokenizer_path("piece_bpe_32k.model")).collect()
    want = [(d, len(tokenizer.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids) if t else 0) for d, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_token_counts_of_long_words(spark):
    """A word of any length costs memory for its longest piece; rings give what whole arrays give."""
    pieces = [("▁", -2.0), ("a", -3.0), ("ab", -3.5), ("abab", -5.0), ("b", -4.0), ("▁ab", -4.0)]
    counter = token_counts.UnigramCounter(pieces)
    rng = random.Random(2)

    def whole(s):
        best = [(0.0, 0)] + [None] * len(s)
        for end in range(1, len(s) + 1):
            options = [(best[end - len(p)][0] + x, len(p), best[end - len(p)][1] + 1) for p, x in pieces if end >= len(p) and s[end - len(p) : end] == p]
            if not any(size == 1 for _, size, _ in options):
                options.append((best[end - 1][0] + counter.unknown, 0, best[end - 1][1] + len(s[end - 1].encode())))
            top = max(options, key=lambda o: (o[0], o[1]))
            best[end] = (top[0], top[2])
        return best[-1][1]

    for _ in range(60):
        s = "▁" + "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 40)))
        assert counter.count(s) == whole(s)
    import tracemalloc

    long = "ab" * 400_000
    tracemalloc.start()
    counter.count(long)
    assert tracemalloc.get_traced_memory()[1] < 4_000_000
    tracemalloc.stop()


def test_token_ties():
    # of equal scores the piece that begins first stays
    c = token_counts.UnigramCounter([("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aba", -3.0)])
    assert [c.count("ab"), c.count("aba"), c.count("abc")] == [1, 1, 2]


# ---- 7: language ----


def test_language_id(spark):
    rng = random.Random(3)
    kinds = {"en": ["the", "ing", "tion", "whst"], "fr": ["eaux", "éa", "que", "ière"], "de": ["sch", "und", "ver", "ü"]}
    text = lambda k, n: " ".join("".join(rng.choice(kinds[k]) for _ in range(3)) for _ in range(n))
    rows = [(k, text(lang, rng.randrange(2, 30)), lang) for k, lang in enumerate(list(kinds) * 200)]
    docs = spark.createDataFrame([*rows, (900, None, "en"), (901, "", "fr"), (902, "12 !?", "en"), (903, "a", None), (904, "中文", None), (None, "the thing", "en")], "doc_id long, text string, lang string")
    model = language_id.learn(docs.filter(~language_id.held_out()))
    out = {r.doc_id: r for r in language_id.predict(docs.select("doc_id", "text"), model).withColumn("out", language_id.held_out()).collect()}
    held = [(d, lang) for d, _, lang in rows if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(out[d].out for d, _ in held)
    assert sum(out[d].tl_lang == lang for d, lang in held) >= 0.98 * len(held)
    assert [out[k].tl_lang for k in (900, 901, 902)] == ["und"] * 3 and out[903].tl_lang in kinds and out[904].tl_lang in kinds
    assert all(0 <= r.tl_score <= 1 for r in out.values())
    nothing = language_id.learn(docs.filter("lang = 'none'"))
    assert {r.tl_lang for r in language_id.predict(docs.select("doc_id", "text"), nothing).collect()} == {"und"}


def test_language_is_not_seen(spark):
    docs = spark.createDataFrame([(1, "the thing", "en"), (2, "que eaux", "fr")], "doc_id long, text string, lang string")
    model = language_id.learn(docs, min_count=1)
    swapped = docs.withColumn("lang", F.lit("xx"))
    assert [r.tl_lang for r in language_id.predict(docs, model).orderBy("doc_id").collect()] == [r.tl_lang for r in language_id.predict(swapped, model).orderBy("doc_id").collect()] == ["en", "fr"]


def test_language_against_exact_sets(spark):
    """Predictions and scores are those of exact 4-gram sets, but for the filters' false positives."""
    rng = random.Random(9)
    kinds = {"en": ["the", "ing", "tion", "whst"], "fr": ["eaux", "éa", "que", "ière"], "de": ["sch", "und", "ver", "ü"]}
    text = lambda lang, n: " ".join("".join(rng.choice(kinds[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(k, text(lang, rng.randrange(1, 20)) + rng.choice(["", " 12", "\n\n", " " + text("fr", 3)]), lang) for k, lang in enumerate(list(kinds) * 60)]
    rows += [(7, rows[7][1], "de"), (8, "The the  THE", "en"), (300, text("de", 60_000), "de"), (301, "a", None), (302, "é", "fr")]

    def grams(t):
        low = re.sub(rb"[^a-z\x80-\xff]+", b" ", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()))
        return [low[i : i + 4] for i in range(len(low) - 3)] or [(low + b"    ")[:4]]

    counts = {}
    for d, t, lang in rows:
        if lang is not None and zlib.crc32(str(d).encode()) % 4 != 2:
            for g in grams(t):
                counts.setdefault(lang, {}).setdefault(g, 0)
                counts[lang][g] += 1
    rate = {x: {g: n / sum(own.values()) for g, n in own.items()} for x, own in counts.items()}
    sets = {x: {g for g, n in own.items() if n >= 3 and rate[x][g] >= 0.25 * max(r.get(g, 0) for r in rate.values())} for x, own in counts.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"tl_lang": F.lit("?"), "c0": F.lit(1)})
    model = language_id.learn(docs.filter(~language_id.held_out()))
    got = language_id.predict(docs.select("doc_id", "text"), model).collect()
    shares = sorted((d, t, {x: sum(g in s for g in grams(t)) / len(grams(t)) for x, s in sets.items()}) for d, t, _ in rows)
    assert len(got) == len(rows)
    for r, (d, t, share) in zip(sorted(got, key=lambda r: (r.doc_id, r.text)), shares, strict=True):
        order = sorted(share, key=lambda x: (-share[x], x))
        assert (r.doc_id, r.text) == (d, t) and abs(r.tl_score - share[order[0]]) <= 0.1
        assert r.tl_lang == order[0] or share[order[0]] - share[r.tl_lang] <= 0.1
    wide = language_id.predict(docs, model)
    assert wide.columns == [*docs.columns, "tl_lang", "tl_score"] and wide.count() == len(rows)


def test_many_languages(spark):
    names = [f"l{k:03}" for k in range(300)]
    words_of = {x: " ".join(f"{chr(97 + k // 26)}{chr(97 + k % 26)}{a}{a}q" for a in "bcdfg") for k, x in enumerate(names)}
    docs = spark.createDataFrame([(k, t, x) for k, (x, t) in enumerate(words_of.items())], "doc_id long, text string, lang string")
    model = language_id.learn(docs, min_count=1)
    assert model.table.shape[1] == 5 and max(model.false) < 0.05
    assert [r.tl_lang for r in language_id.predict(docs, model).orderBy("doc_id").collect()] == names


# ---- 9: class scores ----


def test_class_scores(spark):
    rng = random.Random(8)
    kinds = [["the", "of", "and", "thing", "was"], ["la", "que", "des", "eaux", "est"]]
    rows = [(k, " ".join(rng.choice(kinds[k % 2]) for _ in range(rng.randrange(3, 40)))) for k in range(300)] + [(400, None), (401, ""), (402, "unseen words only"), (None, "the of"), (5, "THE the")]
    got = class_lm.score_documents(table(spark, rows)).collect()
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    counts, ends = {}, 0
    for d, t in rows:
        if not out(d):
            ends += 1
            for w in words(t):
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    want = []
    for d, t in rows:
        c = [counts.get(w, 0) for w in words(t)] + [ends]
        want.append((d, out(d), len(c), sum(x > 0 for x in c), n, round(float(sum(np.log10((x + 1) / (n + v + 1)) for x in c)), 6)))
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == sorted(want, key=repr)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("top", [3, None])
def test_class_scores_by_force(spark, top):
    """The score of every text from counts over plain word lists, given the classes found."""
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(["the", "of", "La", "que", "des", "eaux", "est"]) for _ in range(rng.randrange(0, 20)))) for k in range(60)]
    rows += [(60, None), (None, "the of"), (5, "the THE"), (61, "never seen"), (62, "la " * 30_000)]
    docs = table(spark, rows).select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", class_lm.held_out())
    coded = class_lm.stage(class_lm.encode(docs), "blocks")
    counts = class_lm.word_counts(coded)
    own = (counts if top is None else counts.orderBy(F.desc("c"), "h").limit(top)).select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64)
    slots = class_lm.Slots(own)
    classes = class_lm.cluster(coded, slots)

    def cls(w):
        body = np.frombuffer(w.encode(), np.uint8)
        return int(classes[slots.of(textblocks.words(body, np.array([0, len(body)]))[0])[0]])

    end, learn = class_lm.CLASSES, [t for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 7 != 2]
    steps, freq, words_in, seen = {}, {}, {}, {}
    chain = [end]
    for t in learn:
        for w in words(t):
            seen[w] = seen.get(w, 0) + 1
            chain.append(cls(w))
        chain.append(end)
    for a, b in itertools.pairwise(chain):
        steps[a, b] = steps.get((a, b), 0) + 1
        freq[b] = freq.get(b, 0) + 1
    for w in seen:
        words_in.setdefault(cls(w), []).append(w)
    n = len(chain) - 1

    def step(a, b):
        share = (freq.get(b, 0) + 1) / (n + end + 1)
        return (steps.get((a, b), 0) + class_lm.PRIOR * share) / (sum(c for (x, _), c in steps.items() if x == a) + class_lm.PRIOR)

    def emit(w):
        same = words_in.get(cls(w), [])
        return (seen.get(w, 0) + 1) / (sum(seen[x] for x in same) + len(same) + 1)

    assert all(abs(sum(step(a, b) for b in range(end + 1)) - 1) < 1e-9 for a in (0, 1, end))
    want = []
    for d, t in rows:
        path = [end, *map(cls, words(t)), end]
        moves, said = Counter(itertools.pairwise(path)), Counter(words(t))
        want.append((d, round(sum(c * math.log10(step(*m)) for m, c in moves.items()) + sum(c * math.log10(emit(w)) for w, c in said.items()), 4)))
    got = class_lm.score_documents(table(spark, rows), top=top).collect()
    assert sorted(((r.doc_id, round(r.score, 4)) for r in got), key=repr) == sorted(want, key=repr)


def _many_words():
    """14,000 words of two kinds in turn, more than were once clustered as words."""
    rng = random.Random(11)
    kinds = [[f"{x}{k}" for k in range(7000)] * 3 for x in "ab"]
    for own in kinds:
        rng.shuffle(own)
    turns = [w for pair in zip(*kinds, strict=True) for w in pair]
    return [(k, " ".join(turns[k * 100 : k * 100 + 100])) for k in range(420)] + [(1000, "a1 b1 unseen"), (1001, None)]


def test_every_word_is_clustered(spark, monkeypatch):
    """The same scores as with the classes that ``cluster`` finds on slots for all words, over several blocks and buckets."""
    docs = table(spark, _many_words())
    want = {r.doc_id: r for r in class_lm.score_documents(docs, top=50_000).collect()}
    few = class_lm.score_documents(docs, top=12_288).agg(F.sum("score")).first()[0]
    for name, size in (("BUCKETS", 2), ("BUCKET_WORDS", 10_000), ("AT_ONCE", 500), ("BLOCK_BYTES", 60_000)):
        monkeypatch.setattr(class_lm, name, size)
    got = class_lm.score_documents(docs).collect()
    assert len(got) == len(want) == 422
    for r in got:
        w = want[r.doc_id]
        assert r[:5] == w[:5] and abs(r.base_score - w.base_score) < 1e-6 and abs(r.score - w.score) < 1e-6
    assert sum(r.score for r in got) > few + 100


def test_class_model_sums_to_one(spark, monkeypatch):
    """Probabilities of all words after any word, and of an unseen one per class, sum to one."""
    rows = [(k, "a b a c" if k % 2 else "x y x z") for k in range(40)]
    known = ["a", "b", "c", "x", "y", "z"]
    fold = [d for d in range(10_000, 20_000) if zlib.crc32(str(d).encode()) % 7 == 2]
    probe = [(fold[k], w) for k, w in enumerate(["", *known])]
    got = {r.doc_id: r for r in class_lm.score_documents(table(spark, rows + probe)).collect()}
    # a text of one word is P(word | end) P(end | word); all are probabilities
    total = 10 ** got[fold[0]].score + sum(10 ** got[fold[k + 1]].score for k in range(len(known)))
    assert 0 < total <= 1


def test_exchange_finds_alternation():
    k = class_lm.CLASSES + 1
    bigrams = np.zeros((k, k))
    bigrams[0, 1] = bigrams[1, 0] = 1000
    left, right = np.zeros((2, k)), np.zeros((2, k))
    left[0, 0] = right[0, 0] = 50  # between words of class 0: class 1
    left[1, 1] = right[1, 1] = 50
    assert class_lm.exchange(bigrams, left, right).tolist() == [1, 0]


# ---- 10: packing ----


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rng = random.Random(2)
    odd = ["", None, "<|endoftext|> a", "Å J̌ x", "don't DON'T it'll. 12, 3.5! x).. y;", "日本語。", "é. ñ, ÷! a\x0bb\x85c"]
    texts = odd + ["".join(rng.choice("aBé.,;!' \n\t9ñ)<|>") for _ in range(rng.randrange(80))) for _ in range(200)] + [" ".join(rng.choice(WORDS) for _ in range(rng.choice([10, 700, 3000, 9000]))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(None, "null id"), (3, "again"), (3, "again")]
    got = packing.pack_documents(table(spark, rows), tokenizer_path("word_bpe_49k.json")).collect()
    want = []
    for d, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for p, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want.append((d, p, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    least = -(-sum(w[3] for w in want) // 4096)
    assert len(sequences) <= least + 1
    plan = packing.pack_documents(table(spark, rows), tokenizer_path("word_bpe_49k.json"))
    made = {r.sequence_id: bytes(r.ids) for r in packing.sequences(table(spark, rows), plan, tokenizer_path("word_bpe_49k.json")).collect()}
    assert {k: len(v) // 4 for k, v in made.items()} == {k: sum(n for _, n in v) for k, v in sequences.items()}
    for r in got:
        assert zlib.crc32(made[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)]) == r.ids_crc32


def test_packing_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 64)
    rng = random.Random(4)
    sizes = [rng.choice([4096, 3000, 1100, 900, 500, 70, 5]) for _ in range(900)]
    rows = spark.createDataFrame([(k, 0, 0, s, k, k) for k, s in enumerate(sizes)], packing.PIECES)
    got = packing.pack(rows).collect()
    assert sorted(r.length for r in got) == sorted(sizes)
    used = {}
    for r in got:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 4096 and len(used) <= 1.02 * -(-sum(sizes) // 4096) + 1


def test_packing_of_many_equal_rows(spark):
    alike = spark.range(150_000).selectExpr("7L AS doc_id", "0 AS piece", "0L AS start", "40L AS length", "5L AS ids_crc32", "id AS uid")
    others = spark.range(30_000).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "2500L + id % 1500 AS length", "6L AS ids_crc32", "id + 150000 AS uid")
    got = packing.pack(alike.union(others)).select("sequence_id", "offset", "length").toPandas().sort_values(["sequence_id", "offset"])
    assert len(got) == 180_000
    ends = got.groupby("sequence_id")["length"].cumsum()
    assert ((ends - got["length"]) == got["offset"]).all() and ends.max() <= 4096
    lengths = [40] * 150_000 + [2500 + k % 1500 for k in range(30_000)]
    assert got["sequence_id"].nunique() <= 1.002 * packing.fewest_bins(lengths, 4096) + 1


def triplets(seed, n=20, capacity=100):
    """Sizes of which three fill a bin: best fit in order of size misses most of these."""
    rng, sizes = random.Random(seed), []
    for _ in range(n):
        a = rng.randint(26, 49)
        b = min(rng.randint(26, capacity - a - 1), capacity - a - 20)
        sizes += [a, b, capacity - a - b]
    return sizes


def test_breeding_beats_best_fit(spark):
    fewer = 0
    for seed in range(12):
        sizes = triplets(seed)
        first = packing._best_fit_decreasing(sizes, sorted(range(len(sizes)), key=lambda i: -sizes[i]), 100)
        alone, bred = packing.breed(sizes, 100, seed, [], 6, 0), packing.breed(sizes, 100, seed, [], 6, 60)
        assert 20 == packing.fewest_bins(sizes, 100) <= len(bred) <= len(alone) <= len(first)
        assert sorted(i for b in bred for i in b) == list(range(60)) and all(sum(sizes[i] for i in b) <= 100 for b in bred)
        fewer += len(bred) < len(alone)  # by crossover, not by another start
    assert fewer >= 3
    sizes = triplets(13)
    rows = spark.createDataFrame([(k, 0, 0, n, k, k) for k, n in enumerate(sizes)], packing.PIECES)
    used = packing.pack(rows, 100).select("sequence_id").distinct().count()
    assert used < len(packing._best_fit_decreasing(sizes, sorted(range(60), key=lambda i: -sizes[i]), 100)) == 22


def test_fewest_bins_is_a_bound():
    rng = random.Random(3)
    for _ in range(60):
        sizes = [rng.randint(1, 10) for _ in range(rng.randint(0, 8))]
        best = len(sizes)

        def place(k, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if k == len(sizes):
                best = len(bins)
                return
            for b in range(len(bins)):
                if bins[b] + sizes[k] <= 10:
                    place(k + 1, [*bins[:b], bins[b] + sizes[k], *bins[b + 1 :]])
            place(k + 1, [*bins, sizes[k]])

        place(0, [])
        assert -(-sum(sizes) // 10) <= packing.fewest_bins(sizes, 10) <= best


def test_crossover_keeps_every_document_once():
    rng = random.Random(1)
    sizes = [rng.randrange(1, 60) for _ in range(80)]
    a = packing._best_fit_decreasing(sizes, list(range(80)), 100)
    b = packing._best_fit_decreasing(sizes, list(range(79, -1, -1)), 100)
    for _ in range(20):
        child = packing.crossover(a, b, sizes, 100, rng)
        assert sorted(i for x in child for i in x) == list(range(80)) and max(sum(sizes[i] for i in x) for x in child) <= 100


# ---- all of them on nothing ----


@pytest.mark.parametrize(
    "operator",
    [
        line_dedup.line_dedup, jaccard_join.jaccard_classes, class_lm.score_documents,
        lambda d: packing.pack_documents(d, tokenizer_path("word_bpe_49k.json")),
        lambda d: token_counts.token_counts(d, tokenizer_path("piece_bpe_32k.model")),
        lambda d: decontaminate.find_leaks(d, d.selectExpr("doc_id AS item_id", "text")),
        lambda d: language_id.predict(d, language_id.learn(d)),
    ],
)
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], EMPTY)).collect() == []
