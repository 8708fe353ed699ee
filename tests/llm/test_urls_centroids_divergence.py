"""URL filters, centroid clustering and the divergence audit: brute force and defined results of edge rows."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recollect.llm import centroids, common, divergence, urls

SF = "/root/testdata/sf0.001"

# --- op11 ------------------------------------------------------------------------------------------------------------


def pages_of(spark, found):
    return spark.createDataFrame([(i, u, "kept", 7) for i, u in enumerate(found)], "page_id long, url string, html string, url_host int")


def plain_verdict(url, rules=urls.RULES, vocabulary=urls.VOCABULARY, limit=urls.LIMIT):
    """By patterns, one term at a time."""
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    low = lambda t: re.sub("[A-Z]", lambda x: x[0].lower(), t)
    host = low(host)
    fit = [(len(h + p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    weight = sum(w for t, w in vocabulary.items() if re.search(rf"(?<![0-9a-z\x80-\U0010ffff]){re.escape(t)}(?![0-9a-z\x80-\U0010ffff])", low(host + path)))
    rule = max(fit, default=None)
    return host, path, rule and rule[2], rule[3] if rule else "block" if weight >= limit else "allow", weight


ODD = [
    None, "", "no scheme.com/porn", "http://", "http://a.net", "HTTP://WWW.Example.ORG/es/X", "https://example.org/es", "https://example.org/en/1", "https://notexample.org/en/12",
    "https://sub.example.org/en/2?x=porn", "https://x.com/de/a", "https://x.com/fr/porn", "https://com/fr/", "http://com.net/porn", "http://a.net:80/Free-PILLS#x", "http://a.net/free-free",
    "http://a.net/pornography", "http://a.net/épornx", "http://a.net/éporn", "http://a.net/porn1", "http://a.net/-porn", "http://free.net/a?bet", "http://u@free-bet.net", "http://a.net/a://b.org/es/",
    "http://casino.net/" + "a" * 200_000, "http://a.net/" + "free/" * 50_000 + "bet", "http://a.net/\nporn\n", "x://org/",
]


def test_urls_against_patterns(spark):
    parts = ["free", "Bet", "porn", "news", "x", "sex", "adultery", "1", "é"]
    r = random.Random(3)
    found = ODD + [f"http{'s' * (i % 2)}://{'.'.join(r.choices(parts, k=2))}.{r.choice(['org', 'com', 'net', 'example.org'])}/{r.choice(['de', 'fr', 'es', 'en', ''])}/{r.choice('-_/').join(r.choices(parts, k=3))}?free-bet" for i in range(400)]
    df = pages_of(spark, found)
    got = {r.page_id: r for r in urls.judge(df.union(df.limit(5))).collect()}
    assert len(got) == len(found)
    for i, u in enumerate(found):
        assert (got[i].url_host, got[i].url_path, got[i].url_rule, got[i].url_verdict, got[i].url_weight) == plain_verdict(u), u
        for hit in got[i].url_hits:  # offsets are those of the original
            assert u[hit.start : hit.start + len(hit.term)].lower() == hit.term
    kept = urls.allowed(df)
    assert kept.columns == df.columns and {r.url_host for r in kept.collect()} == {7}
    assert {r.page_id for r in kept.collect()} == {i for i, u in enumerate(found) if plain_verdict(u)[3] == "allow"}


def test_rules_and_bounds(spark):
    rules = (("a.b", "/", "allow"), ("b", "/xy", "allow"), ("b", "/xy", "block"), ("a.b", "/xy/z", "allow"))
    df = pages_of(spark, ["s://a.b/x", "s://b/xyz", "s://c.a.b/xy/z", "s://a.b/xyz", "s://ab/xy"])
    assert [r.url_rule for r in urls.judge(df, rules, {}).orderBy("page_id").collect()] == ["a.b/", "b/xy", "a.b/xy/z", "b/xy", None]
    assert [r.url_verdict for r in urls.judge(df, rules, {}).orderBy("page_id").collect()] == ["allow", "block", "allow", "block", "allow"]
    with pytest.raises(ValueError):
        urls.judge(df, rules * 50_000)
    with pytest.raises(ValueError):
        urls.judge(df, rules, {"Upper": 1})
    assert urls.judge(df.limit(0)).count() == 0


# --- op12 ------------------------------------------------------------------------------------------------------------


def lloyd(rows, k=16, rounds=3, dim=64):
    """(id, vector) rows by whole numbers of Python, all distances in full."""
    held = [(i, [math.floor(64 * x) if abs(x) < 1e15 else int(x) * 64 for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    starts = sorted(held, key=lambda r: (hashlib.sha256(f"1:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [v for _, v in starts]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), n) for n, x in enumerate(c))

    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in held:
            groups[near(v)[1]].append(v)
        c = [[sum(col) // len(groups[n]) for col in zip(*groups[n], strict=True)] if n in groups else x for n, x in enumerate(c)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in held), key=repr), c


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, distance int")


def test_centroids_against_full_distances(spark):
    r = np.random.default_rng(5)
    rows = [(i, (r.normal(size=64) + 3 * (i % 5)).tolist()) for i in range(300)]
    rows += [(7, rows[7][1]), (None, [0.0] * 64), (None, rows[3][1]), (900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [None] + [1.0] * 63), (905, [math.nan] + [1.0] * 63), (906, [math.inf] * 64)]
    rows += [(1000 + i, [0.5] * 64) for i in range(40)]  # ties and repeated vectors
    got, c = centroids.cluster(vectors_of(spark, rows).repartition(7))
    want, expected = lloyd(rows)
    assert sorted((tuple(x) for x in got.collect()), key=repr) == want and c.tolist() == expected


def test_few_equal_and_huge_vectors(spark):
    for rows in ([(i, [0.25] * 64) for i in range(5)], [(1, [-1.5] * 64)], [(i, [(-1) ** i * 10.0 ** (i % 9 * 4)] * 64) for i in range(60)]):
        got, c = centroids.cluster(vectors_of(spark, rows))
        want, expected = lloyd(rows)
        cut = [(i, n, d if d < 1 << 63 else None) for i, n, d in want]
        assert sorted((tuple(x) for x in got.collect()), key=repr) == sorted(cut, key=repr) and c.tolist() == expected
    assert centroids.cluster(vectors_of(spark, []))[0].count() == 0


def test_partial_distances_abandon_only_above():
    r = np.random.default_rng(2)
    x, c = r.integers(-3, 4, (500, 64)), r.integers(-3, 4, (16, 64))
    c[9] = c[4]
    full = ((x[:, None] - c[None]) ** 2).sum(2)
    for order in (np.arange(64), r.permutation(64)):
        number, distance = centroids.nearest(x, c, order)
        assert (number == full.argmin(1)).all() and (distance == full.min(1)).all() and 9 not in number
    for v in (0, 5, -5, 1 << 30, -(1 << 30), 12345678901234567890123, -98765432109876543210):
        assert sum(d << (30 * j) for j, d in enumerate(centroids.digits(v))) == v and all(abs(d) <= 1 << 30 for d in centroids.digits(v))


def test_op12_inertia(spark, tmp_path):
    rows = [(i, [float((i * j) % 7) for j in range(64)]) for i in range(50)]
    vectors_of(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = centroids.op12_centroids(spark, str(tmp_path)).collect()
    per = collections.Counter()
    for x in got:
        per[x.cluster] += x.distance
    assert len(got) == 50 and all(x.cluster_inertia == per[x.cluster] and x.inertia == sum(per.values()) for x in got)


# --- op13 ------------------------------------------------------------------------------------------------------------


def plain_audit(docs, least=10, top=10):
    """By dictionaries over all terms."""
    lists = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in docs]
    out = []
    for lang in {x[0] for x in lists}:
        df = collections.Counter(t for a, _, ws in lists if a == lang for t in set(ws))
        kept = sorted(t for t, n in df.items() if n >= least)
        counts = {s: collections.Counter() for a, s, _ in lists if a == lang}
        for a, s, ws in lists:
            if a == lang:
                counts[s].update(w for w in ws if df[w] >= least)
        whole = sum(counts.values(), collections.Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, c in counts.items():
            mine = {t: p(c, t) for t in kept}
            pairs = sorted((-sum(f(mine[t], p(o, t)) for t in kept), i.encode()) for i, o in counts.items() if i != s)
            terms = sorted((-f(mine[t], p(whole, t)), t.encode()) for t in kept if c[t] and mine[t] > p(whole, t))[:top]
            out += [(lang, s, part, i.decode(), -v, rank) for part, rows in (("pair", pairs), ("term", terms)) for rank, (v, i) in enumerate(rows, 1)]
    return sorted(out)


def audited(docs, **options):
    pairs, terms = divergence.audit(docs, **options)
    return sorted(tuple(r) for r in divergence.ranked(pairs, "pair").unionByName(divergence.ranked(terms, "term", F.lit(divergence.TOP))).collect())


def corpus(n=400, seed=1):
    r = random.Random(seed)
    names = [f"{a}{b}" for a in ("Wort", "émile", "x_y", "日本", "z") for b in "abcdefgh"]
    docs = [(" ".join(r.choices(names[i % 3 * 5 :], k=r.randrange(30))), r.choice(["en", "en", "de", None, ""]), r.choice(["a", "b", "B", "é", None])) for i in range(n)]
    docs += [(None, "fr", "only"), ("one two", "it", "x"), ("", "it", "y"), ("12 .,-", "it", None), ("lonely", "pt", "z"), ("same " * 30_000, "en", "a")]
    return docs + docs[:20]


def docs_of(spark, docs):
    return spark.createDataFrame([(1, *d, "c", "b", 5) for d in docs], "doc_id int, text string, lang string, source string, term string, block string, n int")


def test_divergence_against_dictionaries(spark):
    docs = corpus()
    assert audited(docs_of(spark, docs).repartition(6)) == plain_audit(docs)
    assert audited(docs_of(spark, docs).limit(0)) == []


def test_small_buffers_and_blocks_change_nothing(spark, monkeypatch):
    docs = corpus(150, 2)
    df = docs_of(spark, docs)
    want = plain_audit(docs)
    runs = divergence.partial_runs(df, held=3)
    assert runs.count() > 300
    monkeypatch.setattr(divergence, "partial_runs", lambda d, f=divergence.partial_runs: f(d, 3))
    monkeypatch.setattr(common, "SMALL_BYTES", 0)  # sizes of langs joined by a shuffle
    assert audited(df, block=2) == want


def test_runs_that_cross_batches():
    rows = [("en", t, s, 1, 2) for t in "abc" for s in ("x", "x", "x", "y", "z", "z")]
    names = ["lang", "term", "source", "df", "n"]
    for size in (1, 2, 4, 5, 18):
        batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) | {"document": 0, "task": 0} for r in rows[i : i + size]]) for i in range(0, 18, size)]
        got = [r for t in divergence.whole_runs(iter(batches)) for r in t.to_pylist()]
        assert [(r["term"], r["source"], r["df"], r["n"]) for r in got] == [(t, s, k, 2 * k) for t in "abc" for s, k in (("x", 3), ("y", 1), ("z", 2))]


def test_terms_of_long_texts_and_large_counts(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 7)
    for text in ("Ab cd-ef gh1ij", "a" * 40, "x " + "b" * 30 + " y", "", "       " * 3, "Größe übermäßig ß"):
        assert [w.decode() for part in divergence.terms_of(text.encode()) for w in part] == re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    counts, totals = np.array([0, 10**13, 5]), np.array([10**14, 10**14, 7])
    assert divergence.shares(counts, totals, 9).tolist() == [1 + 10**9 * (int(c) + 2) // (int(n) + 18) for c, n in zip(counts, totals, strict=True)]
