import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from tilewright.llm import quality, warc
from tilewright.llm.vector_topk import vector_topk


def brute_topk(rows, is_query, k):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in usable:
        if is_query(i):
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in usable if j != i and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def test_topk(table):
    rnd = random.Random(1)
    vec = lambda scale=1.0: [rnd.gauss(0, scale) for _ in range(16)]
    same = vec()
    rows = [(k, same if k % 4 == 0 else vec(10.0 ** rnd.randint(-2, 1)), "x", 1) for k in range(400)]
    rows += [(401, None, "x", 1), (402, [None] * 16, "x", 1), (403, [float("nan")] + same[1:], "x", 1), (404, [float("inf")] + same[1:], "x", 1), (None, same, None, None), (450, same[:8], "x", 1), (500, same[:8], "x", 2), (550, [], "x", 1)]
    rows.append((600, [1e7] * 16, "big", 3))
    df = table(rows, "vec_id long, embedding array<double>, rank string, score long")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in vector_topk(df, "vec_id % 50 = 0").collect())
    assert got == brute_topk(rows, lambda i: i % 50 == 0, 5)
    assert vector_topk(df.limit(0), "true").count() == 0
    few = table(rows[:3], "vec_id long, embedding array<double>, rank string, score long")
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in vector_topk(few, "true").collect()) == brute_topk(rows[:3], lambda i: True, 5)


def test_topk_reads_few_exact_vectors(table, monkeypatch):
    """Cells alone rule out nearly all candidates, copies count as their few smallest ids, and a huge component disturbs its own row only."""
    from tilewright.llm import vector_topk as v

    monkeypatch.setattr(v, "BLOCK", 256)
    kept, plain = {}, v.cut
    monkeypatch.setattr(v, "cut", lambda df, label: kept.setdefault(label, []).append(plain(df, label)) or kept[label][-1])
    rnd = random.Random(4)
    vec = lambda: [rnd.gauss(0, 1) for _ in range(12)]
    copy = vec()
    rows = [(k, copy if k % 3 == 0 else vec()) for k in range(6000)]
    rows += [(6050, [1e30] * 12), (6051, [-3e30] + [1.0] * 11), (6052, [1e9] * 12), (6100, [1e300] * 12), (6101, [1.7e308] * 12)]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in vector_topk(table(rows, "vec_id long, embedding array<double>"), "vec_id % 250 = 0 or vec_id > 6049").collect())
    clamp = lambda s: max(-(1 << 63), min(s, (1 << 63) - 1))
    flat = lambda s: max(-(10**38) + 1, min(s, 10**38 - 1))
    usable = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if i != 6101]
    want = []
    for i, q in usable:
        if i % 250 == 0 or i > 6049:
            best = sorted((-flat(sum(a * b for a, b in zip(q, e))), j) for j, e in usable if j != i)[:5]
            want += [(i, r + 1, j, clamp(-s)) for r, (s, j) in enumerate(best)]
    assert got == sorted(want)
    assert kept["topk-exact"][0].count() <= 4000 + 6 + 5
    read = sum(t.count() for t in kept["topk-read"])
    assert read < 0.1 * 29 * 4000  # most of them by the query whose scores are all beyond 38 digits
    assert "cells" in kept["topk-cells"][0].columns and "v" not in kept["topk-cells"][0].columns


PAGES = "page_id long, url string, html string, bundle string, offset long"


def test_warc_round_trip(table, tmp_path, spark):
    rnd = random.Random(2)
    body = lambda n: "<p>" + "".join(rnd.choice("abcé \r\n") for _ in range(n))
    shared, tiny = body(500), "short"
    rows = [(k, f"http://a/{k}\r\nx", shared if k % 5 == 0 else tiny if k % 5 == 1 else body(rnd.randint(0, 3000)), "b", 1) for k in range(200, 0, -1)]
    rows += [(300, None, None, None, None), (301, "", "", None, None), (None, "u", shared, None, None), (302, "u", body(300_000), None, None)]
    df = table(rows, PAGES)
    folder = f"file://{tmp_path}/warc"
    index = warc.write_archives(df, folder, frame_bytes=4000, bundle_bytes=50_000)
    got = warc.read_archives(index, folder).collect()
    first = min(k for k, _, h, *_ in rows if h == shared and k is not None)
    want = []
    for k, _, h, *_ in rows:
        raw = (h or "").encode()
        again = h == shared and k != first
        want.append((k or -1, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None, None if again else raw))
    key = lambda r: (r[0], r[1])
    assert sorted(((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got), key=key) == sorted(want, key=key)
    assert index.select("bundle").distinct().count() > 3 and index.where("frame > 0").count() > 0
    some = index.where("page_id in (3, 7, 302)")
    assert {(r.page_id, r.payload_bytes) for r in warc.fetch_records(some, folder).collect()} == {(w[0], w[1]) for w in want if w[0] in (3, 7, 302)}
    empty = warc.write_archives(df.limit(0), folder)
    assert empty.count() == 0 and warc.read_archives(empty, folder).count() == 0


def test_bundle_is_plain_zstandard():
    import io

    import zstandard

    b = warc.Bundle(100)
    data = [bytes([65 + k]) * 60 for k in range(5)]
    places = [b.add(d) for d in data]
    raw = b.finish()
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read() == b"".join(data)
    table = warc.seek_table(io.BytesIO(raw))
    for d, (frame, at, offset) in zip(data, places):
        assert table[frame][0] == at
        assert zstandard.ZstdDecompressor().decompress(raw[at : at + table[frame][1]])[offset : offset + 60] == d


def good(rnd):
    return ". ".join(" ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "word", "other", "more"]) + str(rnd.randrange(90)) for _ in range(12)) for _ in range(6)) + "."


def bad(rnd):
    return rnd.choice([lambda: "BUY!! NOW!! " * 40, lambda: "a | b | c | d\n" * 20, lambda: "x$$$ y### z%%% " * 30])()


def test_classifier_on_held_out_rows(table):
    rnd = random.Random(9)
    rows = [(k, good(rnd) if k % 4 else bad(rnd), "s") for k in range(1200)] + [(5000, None, None), (5001, "", "s"), (None, good(rnd), "s")]
    docs = table(rows, "doc_id long, text string, score string")
    labels = table([(k, int(k % 4 != 0), 0) for k in range(0, 1200)] + [(None, 1, 0), (7, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in got if r.held_out and r.doc_id < 1200]
    assert sum(r.predicted == int(r.doc_id % 4 != 0) for r in held) >= 0.97 * len(held)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)


def test_labels_of_held_out_rows_are_not_learnt(table):
    rnd = random.Random(8)
    rows = [(k, good(rnd) if k % 4 else bad(rnd)) for k in range(400)]
    docs = table(rows, "doc_id long, text string")
    label = lambda k, flip: int((k % 4 != 0) != (flip and zlib.crc32(str(k).encode()) % 5 == 0))
    a, b = (quality.classify(docs, table([(k, label(k, f)) for k in range(400)], "doc_id long, quality int")).orderBy("doc_id").select("score").collect() for f in (False, True))
    assert a == b


def test_no_labels_and_no_rows(docs, no_docs, table):
    none = table([], "doc_id long, quality int", 1)
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}
    assert quality.classify(no_docs, none).count() == 0


def test_compiled_rules_equal_the_model(spark):
    rng = np.random.default_rng(3)
    x = rng.random((300, len(quality.STATISTICS)))
    y = ((x[:, 3] > 0.4) & (x[:, 5] <= 0.7)).astype(float)
    model = quality.fit_rules(x, y)
    assert model.rules and ((model.scores(x) >= 0.5) == (y > 0)).mean() > 0.97
    df = spark.createDataFrame(x.tolist(), ", ".join(f"{s} double" for s in quality.STATISTICS))
    got = np.array([r.s for r in model.apply(df, "s").collect()])
    assert len(model.rules) <= quality.MAX_RULES
    assert np.abs(got - model.scores(x)).max() < 1e-12


def test_lasso_is_sparse():
    rng = np.random.default_rng(1)
    z = rng.normal(size=(500, 30))
    y = (z[:, 0] - z[:, 1] > 0).astype(float)
    w, _ = quality.lasso_logistic(z, y, 0.05)
    assert (np.abs(w) > 0).sum() < 10 and w[0] > 0 > w[1]


@pytest.mark.parametrize("text", ["", "   ", "\n", "é", "A" * 100_000])
def test_statistics_of_odd_texts(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    assert np.isfinite(quality.statistics(raw, np.array([0, len(raw)]))).all()
