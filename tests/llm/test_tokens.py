import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

public = pytest.importorskip("public_tokenizers")

from tilewright.llm import packing, token_counts, tokens  # noqa: E402

BYTE, WORD = public.path("byte_bpe_50k.json"), public.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def samples():
    rnd = random.Random(1)
    chars = [chr(c) for c in range(tokens.LIMIT)]
    out = [a + c + b for c in chars for a in ("a", "1", " ", "'", "\n") for b in ("a", "1", " ", "s", "\n ")]
    out += ["".join(rnd.choice(chars + [" "] * 200 + list("'stremdl \n\n") * 10) for _ in range(rnd.randint(1, 40))) for _ in range(5000)]
    far = list("“”’—…漢字абвΣςİȺ\u0301\u0327\u180e\u2003\u2028\u200b\u200d\u3000\ufeff😀가각\u11a8")
    out += [a + c + b + d for c in far for a in ("a", "1 ", "  ", "'", "\n") for b in ("", " ", "a", "  \n", "\u2003", "İ") for d in ("b", " 's", "\u0301", " \u3000x", "")]
    out += ["".join(rnd.choice(far + list("aSe1'., \n\t") * 6 + [" "] * 40) for _ in range(rnd.randint(1, 60))) for _ in range(8000)]
    return [*out, "", "<|endoftext|>", " a<|endoftext|>b  <|endoftext|>", "<|endoftext|", "x <|startoftext|>y", "漢字 and text", "emoji 😀", "Σας ΣΑΣ", "e\u0301"]


def test_counts_equal_the_library(samples):
    lib = tokens.library(BYTE)
    count = token_counts._counter(BYTE, token_counts.whole_tokens(BYTE))
    assert count(samples) == [len(e.ids) for e in lib.encode_batch(samples, add_special_tokens=False)]


def test_ids_equal_the_library(samples):
    lib = tokens.library(WORD)
    want = [np.array(e.ids, "<u4").tobytes() for e in lib.encode_batch(samples, add_special_tokens=False)]
    assert packing._encoder(WORD)(samples) == want


@pytest.mark.parametrize("path", [BYTE, WORD, public.path("piece_bpe_32k.model")])
def test_any_file(path, samples, tmp_path):
    """Counts and ids are the library's for every kind of file, and for one whose splitting is not proven."""
    import json

    some = [s.replace("\0", "") for s in samples[::7] + samples[-9:]]
    paths = [path]
    if path == BYTE:
        said = json.load(open(BYTE))
        said["normalizer"] = {"type": "Lowercase"}
        paths.append(str(tmp_path / "own.json"))
        json.dump(said, open(paths[1], "w"))
    for p in paths:
        want = tokens.whole_ids(p)(some)
        assert token_counts._counter(p, token_counts.whole_tokens(p))(some) == [len(x) for x in want]
        assert packing._encoder(p)(some) == [np.array(x, "<u4").tobytes() for x in want]
    assert [tokens.kind_of(p) for p in paths] == {BYTE: ["byte", None], WORD: ["word"]}.get(path, [None])


def test_whole_tokens_are_proven():
    lib = tokens.library(BYTE)
    singles = token_counts.whole_tokens(BYTE)
    assert len(singles) > 40_000 and all(len(lib.encode(s, add_special_tokens=False).ids) == 1 for s in singles[::500])


def test_cache_stays_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 50)
    monkeypatch.setattr(token_counts, "_worker", {})
    singles = token_counts.whole_tokens(BYTE)
    count = token_counts._counter(BYTE, singles)
    lib = tokens.library(BYTE)
    for k in range(5):
        text = " ".join(f"qx{k}zz{j}w" for j in range(100))
        assert count([text]) == [len(lib.encode(text, add_special_tokens=False).ids)]
        assert len(token_counts._worker[BYTE]) <= 50 + len(singles)


def test_count_tokens(docs, corpus, no_docs):
    lib = tokens.library(BYTE)
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, BYTE).collect())
    assert got == sorted((r[0] or -1, len((r[1] or "").encode()), len(lib.encode(r[1] or "", add_special_tokens=False).ids)) for r in corpus)
    assert token_counts.count_tokens(no_docs, BYTE).count() == 0


def test_pieces():
    for n in range(1, 5000):
        sizes = packing.piece_lengths(n, 2048)
        assert sum(sizes) == n and sizes == sorted(sizes, reverse=True) and all(s & (s - 1) == 0 and s <= 2048 for s in sizes)


def test_packing(docs, corpus, no_docs, tmp_path):
    lib = tokens.library(WORD)
    out = packing.decompose(docs, WORD).cache()
    pieces, seen = defaultdict(list), set()
    for r in out.collect():
        assert r.offset == 0 and len(r.ids) == 4 * r.length and r.sequence_id not in seen
        seen.add(r.sequence_id)
        pieces[r.doc_id].append(r)
    for doc_id in {r[0] for r in corpus}:
        rows = [r for r in corpus if r[0] == doc_id]
        ids = [*lib.encode(rows[0][1] or "", add_special_tokens=False).ids, 1]
        found = sorted(pieces[doc_id], key=lambda r: r.start)
        assert {r.doc_tokens for r in found} == {len(ids)}
        at = 0
        for r in found[:: len(rows)]:  # a repeated row gives equal pieces
            assert r.start == at and zlib.crc32(bytes(r.ids)) == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids) and len(found) % len(rows) == 0
    packed = packing.pack_documents(docs, WORD, folder=str(tmp_path / "buckets"))
    assert packed.schema.names == out.schema.names and sorted(map(str, packed.collect())) == sorted(map(str, out.collect()))
    folders = {int(f.name.removeprefix("length=")) for f in (tmp_path / "buckets").glob("length=*")}
    assert folders == {r.length for r in out.collect()}
    assert packed.where("length = 2048").select("ids").rdd.map(lambda r: len(r.ids)).distinct().collect() in ([8192], [])
    assert packing.pack_documents(no_docs, WORD).count() == 0
    with pytest.raises(ValueError):
        packing.decompose(docs, WORD, longest=1000)


def test_only_stretches_are_left_to_the_library(monkeypatch):
    """One far character does not send its whole text past the shortcut."""
    text = "plain words, and " * 500 + "a “quoted” one — then more plain words" + " again" * 500
    pieces = tokens.splitter(BYTE)(text)
    assert "".join(pieces) == text and [p for p in pieces if tokens.beyond(p)] == [" “quoted”", " —"]
    assert [p for p in tokens.splitter(WORD)(text) if tokens.beyond(p)] == [" “quoted”", " —"]
