import hashlib
import re
from collections import Counter, defaultdict

from tilewright.llm.exact_dedup import drop_copies, exact_dedup
from tilewright.llm.mixing import mix_sources, poisson_cdf, repetition_rates
from tilewright.llm.url_filter import bloom_filter, judge_urls, rule_table

BLANKS = re.compile("[\x20\x09-\x0d]")


def groups_of(corpus):
    groups = defaultdict(list)
    for r in corpus:
        groups[BLANKS.sub("", r[1] or "")].append(r)
    return groups


def test_exact_dedup(docs, corpus):
    for options in ({}, {"length_slots": 4, "prefix_slots": 4, "prefix_chars": 2}):
        got = exact_dedup(docs, hash_all=True, **options).collect()
        assert len(got) == len(corpus)
        by_hash = {hashlib.sha256(k.encode()).hexdigest(): g for k, g in groups_of(corpus).items()}
        kept = Counter()
        for r in got:
            g = by_hash[r.full_hash]
            best = min(g, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))
            assert r.group_size == len(g) and r.keep_id == best[0]
            kept[r.full_hash] += r.kept
        assert set(kept.values()) == {1}


def test_drop_copies_keeps_columns(docs, corpus, no_docs):
    out = drop_copies(docs)
    assert out.columns == docs.columns and out.count() == len(groups_of(corpus))
    assert drop_copies(no_docs).count() == 0 and exact_dedup(no_docs).count() == 0


RULES = [("com/en/", "block"), ("Example.com/en/7", "allow"), ("net/", "block"), ("org", "block"), ("com/en/8/", "allow")]


def expected(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = re.match("[^/?#]*([^?#]*)", rest)[1]
    best = None
    for rule, verdict in RULES:
        h, slash, p = rule.partition("/")
        h, p = h.lower(), slash + p
        if host and (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (0,), (len(h + p), len(h), h + p, verdict))
    return host, path, best[2] if best else None, best[3] if best else "allow"


def test_url_rules(spark, table):
    urls = [None, "", "no scheme", "://", "http://", "http://com/en/", "HTTP://A.COM/en/x?y", "http://example.com/en/70#f", "http://x.example.com/en/7", "http://net/", "ftp://a.net", "http://b.net/q", "http://xnet/", "http://org?x", "http://a.org#y", "http://example.com/en/8/a://b", "http://é.com/en/\n1", "http://a.com:80/en/"]
    rows = [(k % 9, u, "h", "r") for k, u in enumerate(urls * 3)]
    pages = table(rows, "page_id long, url string, host string, rule string")
    got = sorted((r.page_id, r.url or "", r.host, r.path, r.rule or "", r.verdict) for r in judge_urls(pages, rule_table(spark, RULES)).collect())
    want = sorted((p, u or "", e[0], e[1], e[2] or "", e[3]) for p, u, *_ in rows for e in [expected(u)])
    assert got == want
    assert judge_urls(pages, rule_table(spark, [])).where("verdict = 'allow' and rule is null").count() == len(rows)
    assert judge_urls(pages.limit(0), rule_table(spark, RULES)).count() == 0


def test_url_rules_of_many_shapes(spark, table, monkeypatch):
    """More label counts and path lengths than are listed, and columns with the names of inner ones."""
    from tilewright.llm import url_filter

    rules = [(f"{'a.' * (n % 5)}b.c/{'x' * n}", "block" if n % 2 else "allow") for n in range(12)]
    rows = [(k, f"http://{'a.' * (k % 7)}b.c/{'x' * (k % 13)}", 1, 2, 3, 4) for k in range(91)]
    pages = table(rows, "page_id long, url string, __url long, __best long, `__key` long, h long")
    judged = {}
    for most in (4096, 2):
        monkeypatch.setattr(url_filter, "MAX_LISTED", most)
        out = judge_urls(pages, rule_table(spark, rules))
        assert out.columns == [*pages.columns, "host", "path", "rule", "verdict"]
        judged[most] = sorted(tuple(r) for r in out.collect())
    want = []
    for k, url, *rest in rows:
        host, path = url[7:].split("/", 1)
        fits = [(len(r), r, v) for r, v in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r.split("/")[1])]
        best = max(fits, default=(0, None, "allow"))
        want.append((k, url, *rest, host, "/" + path, best[1], best[2]))
    assert judged[4096] == judged[2] and [r[:8] for r in judged[2]] == [w[:8] for w in sorted(want)]
    assert [len(r[8] or "") for r in judged[2]] == [len(w[8] or "") for w in sorted(want)]


def test_bloom_filter_misses_nothing(spark):
    from pyspark.sql import functions as F

    from tilewright.llm.url_filter import _block, _mask

    keys = spark.range(500).select(F.col("id").cast("string").alias("k"))
    words = bloom_filter(keys, "k", 64)
    probe = spark.range(5000).select(F.col("id").cast("string").alias("k")).withColumn("__block", _block(F.col("k"), 64))
    hit = probe.join(words, "__block").where(_mask(F.col("k")).bitwiseAND(F.col("__word")) == _mask(F.col("k")))
    found = {int(r.k) for r in hit.collect()}
    assert set(range(500)) <= found and len(found) < 2500


def test_poisson_cdf():
    for rate in (0.1, 1.0, 7.5, 900.0, 1e5, 1e7):
        first, cdf = poisson_cdf(rate)
        assert all(a <= b for a, b in zip(cdf, cdf[1:])) and 1 - cdf[-1] < 1e-9 and len(cdf) < 25 * rate**0.5 + 90
        mean = first + sum(1 - x for x in cdf)
        assert abs(mean - rate) < 1e-6 * max(1, rate)
        if rate < 1000:
            at = next(k for k, c in enumerate(cdf, first) if c >= 0.5)
            assert abs(at - rate) <= 1
    assert poisson_cdf(0) == (0, [1.0])


def test_mixing_of_a_rare_source(table):
    """A source of one row with a rate of thousands: its copies leave in chunks, each once."""
    rows = [(k, "big" if k else "rare", "a", "b", "c", "d") for k in range(3000)]
    docs = table(rows, "doc_id long, source string, `__mixname` string, __s string, __cdf string, __u string")
    out = mix_sources(docs, {"big": 1.0, "rare": 3.0}, seed=3)
    assert out.columns == [*docs.columns, "copies", "copy_no", "shuffle_key"]
    rare = out.where("source = 'rare'").collect()
    u = int(hashlib.md5(b"3:0").hexdigest()[:13], 16) / 2**52
    first, cdf = poisson_cdf(3000 * 0.75)
    n = first + sum(c <= u for c in cdf)
    assert n > 2000 and sorted(r.copy_no for r in rare) == list(range(1, n + 1))
    assert {(r.copies, r["__s"], r["__cdf"], r["__u"], r["__mixname"]) for r in rare} == {(n, "b", "c", "d", "a")}


def test_mixing(docs, corpus, no_docs):
    weights = {"src0": 3.0, "src1": 1.0, "absent": 5.0}
    rates = repetition_rates(docs, weights, rest_weight=1.0, epochs=4.0)
    sizes = Counter(r[3] if r[3] in weights else None for r in corpus)
    total = sum(sizes.values())
    for s, n in sizes.items():
        assert abs(rates[s] * n - 4 * total * {"src0": 3, "src1": 1, None: 1}[s] / 5) < 1e-9
    out = mix_sources(docs, weights, rest_weight=1.0, epochs=4.0, seed=5)
    rows = out.collect()
    u = lambda i: int(hashlib.md5(f"5:{'-' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
    want = Counter()
    for r in corpus:
        first, cdf = poisson_cdf(rates[r[3] if r[3] in weights else None])
        want[r[0], r[1]] += first + sum(x <= u(r[0]) for x in cdf)
    assert Counter((r.doc_id, r.text) for r in rows) == +want
    keys = [r.shuffle_key for r in rows]
    assert keys == sorted(keys) and set(docs.columns) - {"copies"} <= set(out.columns)
    assert mix_sources(docs, {}, rest_weight=0.0).count() == 0 and mix_sources(no_docs, weights).count() == 0
