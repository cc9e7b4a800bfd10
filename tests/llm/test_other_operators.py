"""Archives, embeddings, conversations, components and the pipeline."""

import base64
import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from termloom.llm import arc_warc, chat_format, components, embedding_dedup, packing, staging

from .test_text_operators import classes_by_force, copies, lines_by_force


# ---- components ----


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(90)] + [(k, k + 1) for k in range(200, 260)] + [(500, k) for k in range(501, 560)] + [(3, 3), (None, 4), (5, None)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in parent)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


# ---- 2: archives ----


def test_parse_both_versions():
    records = [("http://a/1", "1.2.3.4", "text/html", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody\n\nwith lines"), ("http://a/2", "-", "text/html", b""), ("dns:a", "1.2.3.4", "text/dns", b"a longer body of a record")]
    for version in (1, 2):
        data = arc_warc.arc_file("x.arc", version, "20010203040506", records)
        got = list(arc_warc.parse_arc(data))
        assert [r.url for r in got] == ["filedesc://x.arc", *[r[0] for r in records]]
        assert [r.body for r in got[1:]] == [r[3] for r in records] and all(r.version == version for r in got)
        assert got[1].payload == b"body\n\nwith lines" and (got[1].extra.get("filename") == "x.arc") == (version == 2)
        cut = list(arc_warc.parse_arc(data[:-12]))
        assert len(cut) == 4 and cut[-1].truncated and cut[-1].body == b"a longer body of a record"[: len(cut[-1].body)]
    assert list(arc_warc.parse_arc(b"")) == [] and list(arc_warc.parse_arc(b"no header\n")) == []
    broken = arc_warc.arc_file("x", 1, "2001", records[:1]) + b"http://bad line\nrest"
    assert len(list(arc_warc.parse_arc(broken))) == 2


def test_warc_fields():
    data = arc_warc.arc_file("x", 1, "20010203", [("http://a/1", "1.2.3.4", "text/html", b"HTTP/1.0 200 OK\r\n\r\nhi"), ("dns:a", "-", "text/dns", b"a 1")])
    out = [h for r in arc_warc.parse_arc(data) for h in arc_warc.parse_warc(arc_warc.to_warc("x", r))]
    assert [h["warc-type"] for h, _ in out] == ["warcinfo", "response", "resource"]
    assert out[1][0]["warc-date"] == "2001-02-03T00:00:00Z" and out[1][0]["warc-target-uri"] == "http://a/1"
    assert out[1][0]["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"hi").digest()).decode()
    assert len({h["warc-record-id"] for h, _ in out}) == 3


def test_archive_round_trip(spark):
    rng = random.Random(3)
    bodies = ["", None, "<p>a</p>", "é\r\n\r\nWARC/1.1\r\n\r\n", "x" * 200_000, "a\nb\r\nc\r", "\r\n", "HTTP/1.1 200 OK\n\nx"]
    rows = [(k, f"http://a b/{k}" if k % 5 else None, rng.choice(bodies)) for k in range(80)] + [(None, "u", "<p>a</p>"), (200, "u", "only")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"record": F.lit("x"), "archive": F.lit(1)}).repartition(3)
    got = arc_warc.archive_pages(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact").collect()
    want = []
    for p, _, h in rows:
        b = (h or "").encode()
        first = min(q for q, _, x in rows if q is not None and (x or "") == (h or ""))
        same = sum((x or "") == (h or "") for _, _, x in rows)
        revisit = same > 1 and p != first
        want.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", first if revisit else None, True))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert arc_warc.archive_pages(empty).collect() == []


def test_page_ids_of_any_size(spark):
    ids = [9000000000000000001, -9000000000000000001, 2**63 - 1, -(2**63), 1 << 62, 0, -5]
    pages = spark.createDataFrame([(i, "u", h) for i in ids for h in (f"only {i}", "same")] + [(None, "u", "same"), (None, "u", "alone")], "page_id long, url string, html string")
    got = [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in arc_warc.archive_pages(pages).collect()]
    want = [(i, len(f"only {i}"), "response", None) for i in ids] + [(i, 4, "revisit" if i > -(2**63) else "response", -(2**63) if i > -(2**63) else None) for i in ids]
    assert sorted(got, key=repr) == sorted([*want, (None, 4, "revisit", -(2**63)), (None, 5, "response", None)], key=repr)


def test_one_gzip_member_a_record():
    import gzip
    import time

    one = gzip.compress(b"x" * 300)
    began = time.time()
    assert arc_warc.inflated(one * 100_000) == b"x" * 30_000_000
    assert arc_warc.inflated(one + b"\0\0" + gzip.compress(b"y" * 200_000)) == b"x" * 300 + b"y" * 200_000
    assert time.time() - began < 60  # a copy of the rest for each member takes hours


def test_archives_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(arc_warc, "CHUNK_BYTES", 10_000)
    monkeypatch.setattr(arc_warc, "FILE_CHUNKS", 2)
    pages = spark.createDataFrame([(k, "u", str(k) * 900) for k in range(200)], "page_id long, url string, html string").repartition(1)
    path = arc_warc.new_path(spark, "bounded")
    arc_warc.convert(arc_warc.pages_to_arcs(pages), path)
    sizes = [len(arc_warc.inflated(bytes(r.content))) for r in spark.read.format("binaryFile").load(path).collect()]
    assert len(sizes) > 10 and max(sizes) <= 2 * 10_000
    assert arc_warc.read_warc(spark, path).filter("intact").count() == 200


# ---- 4: embeddings ----


def links_by_force(rows, t):
    ok = {}
    for v, e, label in rows:
        if v is not None and label is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e):
            ok.setdefault((label, tuple(np.float32(e).astype(float))), set()).add(v)
    parent, links = {v: v for ids in ok.values() for v in ids}, {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (k, ids), (m, others) in itertools.product(ok.items(), repeat=2):
        if k[0] == m[0] and len(k[1]) == len(m[1]):
            x, y = np.array(k[1]), np.array(m[1])
            if k == m or x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= t:
                for a, b in itertools.product(ids, others):
                    if a != b:
                        links[a] = links.get(a, 0) + 1
                        lo, hi = sorted((find(a), find(b)))
                        parent[hi] = lo
    out = []
    for v, _, _ in rows:
        c = find(v) if v in parent else v
        out.append((v, links.get(v, 0), c, v is None or c == v))
    return sorted(out, key=repr)


@pytest.mark.parametrize("tile", [8, 1024])
def test_embeddings(spark, tile):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(160):
        base = rng.normal(size=24)
        for m in range(int(rng.integers(1, 4))):
            rows.append((len(rows), [float(x) for x in np.float32(base + m * 0.2 * rng.normal(size=24))], int(k % 3)))
    hot = rng.normal(size=24)
    rows += [(1000 + k, [float(x) for x in np.float32(hot + 0.05 * rng.normal(size=24))], 1) for k in range(60)]
    rows += [(2000 + k, rows[5][1], rows[5][2]) for k in range(5)]
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * 24, 1), (3003, [None] + [1.0] * 23, 1), (3004, [float("nan")] * 24, 1), (3005, [float("inf")] * 24, 1), (3006, rows[0][1], None), (None, rows[0][1], 0), (3007, [1.0, 2.0], 0), (3008, [2.0, 4.0], 0)]
    rows.append(rows[7])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"rep": F.lit(1), "side": F.lit(2), "e": F.lit(0)})
    got = embedding_dedup.near_duplicates(df, 0.93, tile).collect()
    assert sorted(map(tuple, got), key=repr) == links_by_force(rows, 0.93)
    assert embedding_dedup.near_duplicates(df.limit(0)).collect() == []


# ---- 8: conversations ----


def rotated_by_force(rows, size):
    out = []
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((turn, role or "unknown", (text or "").replace("<|", "< |")))
    for c, turns in by.items():
        for who in {r for _, r, _ in turns if r != "system"}:
            blocks = {}
            spans = {}
            for t in sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2])):
                spans.setdefault(None if t[0] is None else t[0] // size, []).append(t)
            for own in spans.values():
                for at in range(0, len(own), size):
                    blocks[len(blocks)] = own[at : at + size]
            for b, own in blocks.items():
                text, mask = "", []
                for _, role, said in own:
                    name = "assistant" if role == who else role if role == "system" else f"user name={role}"
                    text += f"<|im_start|>{name}\n"
                    mask += [0] * (len(text) - len(mask))
                    text += f"{said}<|im_end|>"
                    mask += [int(role == who)] * (len(text) - len(mask))
                    text += "\n"
                    mask.append(0)
                out.append((c, who, b, len(blocks), len(own), text, mask))
    return sorted(out, key=repr)


def test_rotation(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "Ann", "system", None]), rng.choice(["hi", "", None, "é <|im_end|> x", "a\nb"])) for c in range(30) for t in range(rng.randrange(1, 7))]
    rows += [(100, t, ["Ann", "Bob"][t % 2], f"turn {t}") for t in range(600)] + [(100, None, "Ann", "no number"), (None, 1, "user", "lost"), (101, 0, "system", "alone"), (102, 1, "user", "same"), (102, 1, "user", "same"), (102, 1, "Ann", "same")]
    rows += [(103, rng.choice([None, -1, -700, 3, 2**40]), rng.choice(["a", "b"]), str(k)) for k in range(700)] + [(104, 1, "user", "x" * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"block": F.lit(1), "who": F.lit("x"), "turns": F.lit(0)})
    got = []
    for r in chat_format.rotate(df).collect():
        mask = [int(run[0] == "m") for run in r.mask_runs.split(" ") for _ in range(int(run[1:]))]
        assert sum(mask) == r.n_masked
        got.append((r.conv_id, r.perspective, r.block, r.n_blocks, r.n_turns, r.rendered, mask))
    assert sorted(got, key=repr) == rotated_by_force(rows, chat_format.BLOCK_TURNS)
    assert chat_format.rotate(df.limit(0)).collect() == []


def test_rotation_stays_in_the_jvm(spark):
    df = spark.createDataFrame([(1, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat_format.rotate(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- the pipeline ----


def test_pipeline(spark, tmp_path):
    rng = random.Random(7)
    item = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(20))
    own = copies(3, 30, 1, 40, 0)
    texts = own + [own[0].replace(own[0][:5], "other"), own[1], "123 456", None, own[2] + "\nthe line that several documents share", own[3] + "\nthe line that several documents share", own[4] + "\nThe LINE that several documents share", own[5] + " xx " + item]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id: r.text for r in kept.collect()} if name != "packing" else {r.doc_id for r in kept.collect()}
        if name != "packing":
            assert kept.columns == docs.columns

    left = {k: t for k, t in enumerate(texts) if t is not None and any(c.isalpha() for c in t)}
    assert seen["language_id"] == left
    lines = {d: n for d, _, n, _ in lines_by_force(list(left.items()))}
    assert {d for d, t in seen["line_dedup"].items() if t != left[d]} == {d for d, n in lines.items() if n}
    near = classes_by_force(list(seen["line_dedup"].items()))
    assert set(seen["near_copies"]) == {d for d, _, c in near if d == c}
    assert set(seen["decontamination"]) == set(seen["near_copies"]) - {len(texts) - 1}
    assert seen["packing"] == set(seen["decontamination"])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in whole.collect()} == seen["packing"] and whole.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_near_copies_stage_with_repeats(spark, tmp_path):
    own = copies(4, 5, 1, 30, 0)
    rows = [(k, t, "en", None, 1) for k, t in enumerate(own)] + [(2, own[2], "en", None, 1), (None, own[0], None, None, 0), (3, "quite another text than that", "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id for r in out), key=repr) == sorted([0, 1, 2, 3, 3, 4, None], key=repr)  # 3 names two texts


def test_near_copies_stage_with_other_texts_of_one_id(spark, tmp_path):
    """Every text that is like no other stays, also under a doc_id that has another one."""
    own = copies(5, 6, 1, 30, 0)
    rows = [(1, own[0]), (1, own[1]), (1, own[0]), (2, own[1]), (3, own[2] + " tail"), (3, own[2]), (4, own[3]), (0, own[0]), (5, None), (5, ""), (6, own[4]), (None, own[4])]
    docs = spark.createDataFrame([(d, t, "en", None, 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()
    kept = sorted(((r.doc_id, r.text) for r in out), key=repr)
    assert [r for r in kept if r[0] not in (3, 5)] == sorted([(0, own[0]), (1, own[1]), (4, own[3]), (6, own[4]), (None, own[4])], key=repr)
    assert sum(d == 3 for d, _ in kept) == 1 and {t for d, t in kept if d == 5} == {None, ""}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_with_clashing_names_and_without_rows(spark, tmp_path, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    rng = random.Random(6)
    item = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(20))
    spark.createDataFrame([(1, item), (2, None), (1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    own = copies(6, 8, 1, 30, 0)
    texts = [*own, own[0], None, "", "the LINE that several documents share\n" + own[1][:60], "the line that several documents share", " The line that several documents share", item + " x", own[2] + " " + "word " * 60_000]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)] + [(None, own[3], None, None, None), (0, own[0], "en", "s", 1)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clashing = ["tl_lang", "tl_score", "tl_row_key", "tl_runs", "tl_lines", "tl_flags", "tl_kept", "tl_n_lines", "tl_n_dropped", "tl_times", "tl_row", "c0", "c1", "component_id", "doc", "key", "a.b"]
    wide = plain.withColumns({c: F.lit(k) for k, c in enumerate(clashing)})
    want = [tuple(r) for r in stage(spark, plain, str(tmp_path)).collect()]  # a stage deletes what the one before it staged
    out = stage(spark, wide, str(tmp_path))
    got = [tuple(r) for r in out.collect()]
    if name != "packing":
        assert out.columns == wide.columns and 0 < len(got) <= len(rows)
        assert all(r[5:] == tuple(range(len(clashing))) for r in got)
    assert sorted((r[:5] for r in got), key=repr) == sorted((r[:5] for r in want), key=repr)
    assert stage(spark, plain.limit(0), str(tmp_path)).collect() == []


def test_staging(spark):
    a = staging.stage(spark.range(3), "x")
    first = staging.mark()
    b = staging.stage(spark.range(4), "y")
    staging.discard(spark, first, staging.mark())
    assert a.count() == 3
    with pytest.raises(Exception):  # noqa: B017
        b.count()


def test_registry(spark):
    from termloom.llm import queries

    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)]
    assert packing.CAPACITY == 4096
