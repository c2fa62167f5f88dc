import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, row_tag string, `__id` string, kept string, copies string"


@pytest.fixture
def corpus():
    """Rows of documents: nulls in every column, empty, blank, very long, tied and repeated rows, near copies."""
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(1, 8))) for _ in range(400)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    rows = []
    base = [text(n) for n in (3, 12, 60, 200, 200)]
    for i in range(120):
        t = base[i % 5] if i % 3 == 0 else text(rnd.randint(1, 150))
        if i % 6 == 0:
            parts = t.split(" ")
            parts[rnd.randrange(len(parts))] = "other"
            t = " ".join(parts)
        if i % 9 == 0:
            t = t.replace(" ", "  \n").upper()
        rows.append((1000 - i, t, "en", f"src{i % 3}", len(t), "k", "r", "i", "x", "y"))
    rows.append((2000, None, None, None, None, None, None, None, None, None))
    rows.append((None, base[1], None, None, None, None, None, None, None, None))
    rows.append((2001, "", "en", "src0", 0, None, None, None, None, None))
    rows.append((2002, " \n\t ", "en", "src0", 4, None, None, None, None, None))
    rows.append((2003, "x", "en", "src1", 1, None, None, None, None, None))
    rows.append((2004, text(40_000), "en", "src1", 1, None, None, None, None, None))
    rows += [rows[7], rows[7]]
    rnd.shuffle(rows)
    return rows


@pytest.fixture
def docs(table, corpus):
    return table(corpus, DOCS)


@pytest.fixture
def no_docs(table):
    return table([], DOCS, 1)
