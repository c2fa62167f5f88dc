import hashlib
import random
import re

import numpy as np
import pytest

from tilewright.llm.components import components
from tilewright.llm.minhash import _signature, drop_near_copies, near_duplicates
from tilewright.llm.rindex import RunIndex, late_spans
from tilewright.llm.runindex import remove_repeats
from tilewright.llm.shingles import shingle_sets, word_hashes

WORDS = re.compile("[^\x20\x09-\x0d]+")


def word_list(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text, n):
    w = word_list(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[find(i)] = find(j)
    out = []
    for i, a in enumerate(sets):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None] if a else [rows[i][0]]
        out.append((rows[i][0] if rows[i][0] is not None else -1, len(a), min(ids) if ids and ids[0] is not None else -1))
    return sorted(out)


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(docs, corpus, n):
    rows = [(r[0], r[1]) for r in corpus]
    got = near_duplicates(docs, words=n, percent=80).collect()
    as_id = lambda v: -1 if v is None else v
    assert sorted((as_id(r.doc_id), r.n_shingles, as_id(r.component_id)) for r in got) == brute_components(rows, n, 80)
    with_set = [r for r in got if r.n_shingles]
    kept = [r.component_id for r in with_set if r.kept]
    assert len(kept) == len(set(kept)) == len({r.component_id for r in with_set})
    assert all(r.kept for r in got if not r.n_shingles)


def test_large_group_of_near_copies(table):
    """A base with many edited copies, most of which are only linked through it, and chains of edits."""
    rnd = random.Random(4)
    base = [f"w{k}" for k in range(140)]
    rows = []
    for i in range(300):
        t = list(base)
        for k in rnd.sample(range(140), rnd.randint(0, 14)):
            t[k] = f"x{rnd.randrange(10**6)}"
        rows.append((i + 5, " ".join(t)))
    chain = [f"c{k}" for k in range(100)]
    for i in range(12):
        chain[i * 8 : i * 8 + 3] = [f"d{i}{k}" for k in range(3)]
        rows.append((1000 - i, " ".join(chain)))
    df = table(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df, words=2, percent=80).collect())
    assert got == brute_components(rows, 2, 80)


def test_near_duplicates_of_every_table(table):
    """Buckets whose leader is linked to nobody: a pair that shares any table is found, not only one on the diagonal."""
    rnd, bands, width = random.Random(6), 2, 2
    rows = []
    for g in range(60):
        base = [f"g{g}w{k}" for k in range(60)]
        for i in range(8):
            t = list(base)
            for k in rnd.sample(range(60), 3 if i < 2 else 8):
                t[k] = f"x{rnd.randrange(10**6)}"
            rows.append((g * 8 + i, " ".join(t)))
    text = [t.encode() for _, t in rows]
    sets = shingle_sets(np.frombuffer(b"".join(text), np.uint8), np.cumsum([0] + [len(t) for t in text]), 1)
    seeds = np.random.default_rng(7).integers(1, 1 << 63, 2 * bands * width, dtype=np.uint64)
    keys = [_signature(u, seeds, width).tolist() for u in sets]
    up = list(range(len(rows)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(len(rows)):
        for j in range(i // 8 * 8, i):
            shared = [x == y for x, y in zip(keys[i], keys[j])]
            common = len(np.intersect1d(sets[i], sets[j]))
            if any(shared[:bands]) and any(shared[bands:]) and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    got = near_duplicates(table(rows, "doc_id long, text string"), words=1, percent=80, bands=bands, width=width).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in range(len(rows))}


def test_near_duplicates_of_nothing(no_docs, docs):
    assert near_duplicates(no_docs).count() == 0
    assert drop_near_copies(docs).columns == docs.columns


def test_word_hashes_of_long_text(monkeypatch):
    from tilewright.llm import shingles as s

    text = ("lorem ipsum dolor " * 300 + "z" * 3000 + "\n") * 3
    raw, at = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])
    whole = word_hashes(raw, at)
    monkeypatch.setattr(s, "STRETCH", 1000)
    cut = word_hashes(raw, at)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all() and len(whole[0]) == len(text.split())
    assert len(shingle_sets(raw, at, 5)[0]) == len(shingles(text, 5))


def test_components(spark):
    edges = [(k + 1, k) for k in range(40)] + [(100, 101), (101, 102), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("alphabet", [b"ab", b"abcdefgh", bytes([0, 1, 254 - 10]), b"a"])
def test_matching_statistics(alphabet):
    rnd = random.Random(2)
    piece = lambda: bytes(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) * rnd.randint(1, 3)
    held, parts = [piece() for _ in range(30)], np.array([rnd.randrange(3) for _ in range(30)])
    asked = [piece() + held[rnd.randrange(30)][5:] + piece() for _ in range(20)] + [b"zz" + held[3], b""]
    own = np.array([rnd.randrange(4) for _ in asked])
    index = RunIndex(held, parts)
    n = len(index.text)
    assert all(len(x) == len(index.start) <= n for x in (index.head, index.first, index.last, index.leads_to, index.last_row, index.by_head))
    lengths, positions, starts, ends = index.matching_statistics(asked, own)
    for s, part, a, e in zip(asked, own, starts, ends):
        assert e - a == len(s)
        for i in range(len(s)):
            n = lengths[a + i]
            texts = [h for h, p in zip(held, parts) if p == part]
            assert all(s[i : i + n + 1] not in h for h in texts) if i + n < len(s) else True
            assert n == 0 or any(s[i : i + n] in h for h in texts)
            if n:  # the position is that of such a match
                at = positions[a + i]
                assert bytes(index.text[at : at + n] - np.uint8(1)) == s[i : i + n]


def test_repetitive_text_has_few_runs():
    rnd = random.Random(3)
    base = bytes(rnd.choice(b"abcdefgh") for _ in range(150))
    copies = [base[: 20 + k] + b"x" + base[21 + k :] for k in range(100)]
    index = RunIndex(copies, np.zeros(100, np.int64))
    assert len(index.start) < len(index.text) / 10


def test_late_spans():
    rnd = random.Random(4)
    strings, groups = [], []
    for g in range(40):
        base = [bytes(rnd.choice(b"abcdefgh") for _ in range(60)) for _ in range(2)]
        for _ in range(rnd.choice([1, 2, 3, 9, 33])):
            t = bytearray(rnd.choice(base))
            if rnd.random() < 0.7:
                t[rnd.randrange(60)] = 120
            strings.append(bytes(t[rnd.randint(0, 8) : 60 - rnd.randint(0, 8)]))
            groups.append(g)
    got = np.zeros((len(strings), 60), bool)
    for i, s, e in zip(*late_spans(strings, np.array(groups), 20)):
        assert not got[i, s:e].any()
        got[i, s:e] = True
    seen = set()
    for i, (g, t) in enumerate(zip(groups, strings)):
        want = np.zeros(60, bool)
        for k in range(len(t) - 19):
            if (g, t[k : k + 20]) in seen:
                want[k : k + 20] = True
        seen |= {(g, t[k : k + 20]) for k in range(len(t) - 19)}
        assert (got[i] == want).all()
    assert not len(late_spans([], np.zeros(0, np.int64), 20)[0])


def brute_repeats(rows, length):
    seen, out = set(), []
    for k, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((-1 if k is None else k, len(b), hashlib.sha256(kept).hexdigest(), len(re.findall(b"\1+", bytes(gone)))))
    return sorted(out)


def found_repeats(df, **options):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, hashlib.sha256(bytes(r.kept)).hexdigest(), len(r.spans)) for r in remove_repeats(df, **options).collect())


@pytest.mark.parametrize("options", [{}, {"hot_count": 2, "hot_share": 0.0}, {"hot_count": 1, "hot_share": 0.0, "slice_bytes": 2000}, {"slice_bytes": 400}, {"settle": False}, {"settle": False, "hot_count": 3, "hot_share": 0.0}, {"big": 1, "slice_bytes": 3000}])
def test_repeats(table, options):
    rnd = random.Random(5)
    piece = lambda n, a="ab \n": "".join(rnd.choice(a) for _ in range(n))
    shared = [piece(n, "abcdefghij é") for n in (99, 100, 101, 130, 160, 300, 700)]
    rows = []
    for i in range(150):
        parts = [rnd.choice([piece(rnd.randint(0, 200), "abcdefgh é"), rnd.choice(shared), rnd.choice(shared)[rnd.randint(0, 40) :], "x" * rnd.randint(0, 260), "ab" * rnd.randint(0, 120)]) for _ in range(rnd.randint(0, 4))]
        rows.append((i, "".join(parts)))
    rows += [(300 + i, rows[rnd.randrange(150)][1]) for i in range(40)] + [(400, None), (401, ""), (402, "y" * 5000), (403, "xyz" * 3000), (None, shared[-1])]
    rnd.shuffle(rows)
    df = table(rows, "doc_id long, text string", 4)
    assert found_repeats(df, **options) == brute_repeats(rows, 100)


def test_repeats_in_a_text_longer_than_a_stretch(table):
    rnd = random.Random(6)
    block = "".join(rnd.choice("abcdefgh") for _ in range(1 << 20))
    rows = [(1, block + "-" + block[:700_000] + "+" + block), (2, block[1000:3000])]
    df = table(rows, "doc_id long, text string", 1)
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in remove_repeats(df).select("doc_id", "spans").collect()}
    n = len(block)
    assert got == {1: [(n + 1, n + 1 + 700_000), (n + 700_002, 2 * n + 700_002)], 2: [(0, 2000)]}


def test_repeats_of_nothing(no_docs):
    assert remove_repeats(no_docs).count() == 0
