import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_a_fixture(spark, tmp_path, docs, table):
    """Each stage keeps the columns; what goes, stays and repeats agrees with brute force on the stage's own input."""
    from tests.llm.test_exact_and_rules import BLANKS
    from tests.llm.test_near_and_repeats import brute_components
    from tests.llm.test_vectors_pages_quality import bad, good
    from tilewright.llm import mixing, queries, tokens

    rnd = random.Random(5)
    texts = [(k, good(rnd) if k % 3 else bad(rnd), "en", f"src{k % 2}", 1) for k in range(3000, 3600)]
    here = docs.select(*COLUMNS).union(table(texts, "doc_id long, text string, lang string, source string, n_chars long"))
    here.write.parquet(str(tmp_path / "documents"))
    here = spark.read.parquet(str(tmp_path / "documents"))
    labels = table([(k, int(k % 3 != 0), 0) for k in range(3000, 3600)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "in" / "labels.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, here, str(tmp_path / "in"))
        path = str(tmp_path / f"s{k}")
        out.write.parquet(path)
        out = spark.read.parquet(path)
        before, after = here.collect(), out.collect()
        if k < 4:
            assert out.columns == here.columns
            assert k == 3 or not Counter(map(str, after)) - Counter(map(str, before))
        if k == 0:
            stays = {r.doc_id for r in after}
            wrong = [i for i in range(3000, 3600) if (i in stays) != (i % 3 != 0)]
            assert len(wrong) <= 6 and len(after) < len(before)
        if k == 1:
            assert sorted(BLANKS.sub("", r.text or "") for r in after) == sorted({BLANKS.sub("", r.text or "") for r in before})
        if k == 2:
            rows = [(r.doc_id, r.text) for r in before]
            classes = {i: c for i, n, c in brute_components(rows, 5, 80) if n}
            assert sorted(classes[r.doc_id] for r in after if r.doc_id in classes) == sorted(set(classes.values()))
            assert sum(r.doc_id not in classes for r in after) == sum(r.doc_id not in classes for r in before)
        if k == 3:
            rates = mixing.repetition_rates(here, queries.SOURCE_WEIGHTS, rest_weight=1.0)
            want = Counter()
            for r in before:
                u = int(hashlib.md5(f"{queries.MIX_SEED}:{'-' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
                first, cdf = mixing.poisson_cdf(rates[r.source if r.source in queries.SOURCE_WEIGHTS else None])
                want[str(r)] += first + sum(c <= u for c in cdf)
            assert Counter(map(str, after)) == +want
        if k == 4:
            lib = tokens.library(queries.tokenizer_path("word_bpe_49k.json"))
            want = Counter()
            for r in before:
                ids = np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
                at = 0
                for size in [2048] * (len(ids) // 2048) + [1 << b for b in reversed(range(11)) if len(ids) % 2048 >> b & 1]:
                    want[r.doc_id, at, size, zlib.crc32(ids[at : at + size].tobytes()), len(ids)] += 1
                    at += size
            assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in after) == want
            assert len({r.sequence_id for r in after}) == len(after) and {r.offset for r in after} == {0}
        here = out
    assert len(corpus_pipeline.STAGES) == 5


def test_run_of_nothing(spark, tmp_path, no_docs, table):
    no_docs.select(*COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    table([], "doc_id long, quality int, toxic int", 1).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
