import random

from pyspark.sql import functions as F

from tests.llm.test_near_and_repeats import test_near_duplicates_of_every_table as every_table
from tilewright.llm import minhash


def _counting(percent):
    import pyarrow as pa

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([-1], pa.int64())], names=["u", "v"])

    return run


def test_members_go_to_the_exact_search_once_a_leader(table, monkeypatch):
    """A group whose members share buckets of many tables but few links: not one copy of a member a table."""
    rnd, n = random.Random(8), 60
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(n):
        t = list(base)
        for k in rnd.sample(range(60), 8):
            t[k] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    sent, cut = [], minhash.cut

    def watched(df, label):
        out = cut(df, label)
        if label != "near-late":
            return out
        sent.append(out.agg(F.sum("u")).first()[0])
        return out.where("v >= 0")

    monkeypatch.setattr(minhash, "cut", watched)
    monkeypatch.setattr(minhash, "_residual", _counting)
    assert minhash.near_duplicates(table(rows, "doc_id long, text string"), words=1, percent=80).count() == n
    assert 0 < sent[0] <= 20 * n


def test_blocks_of_a_group(table, monkeypatch):
    """Groups that fill several blocks give the same classes."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    every_table(table)
