"""The training-data operators on small fixtures: brute force, edge rows, held-out accuracy."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from recollect.llm import ann, common, decontaminate, html, jaccard, links, mixing, paragraphs, pii, quality, suffix, toxicity
from recollect.llm import queries as q

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, node int"


def rows(spark, texts, source="s"):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", source, len(t or ""), "x", 1) for i, t in enumerate(texts)], SCHEMA)


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


EDGES = [None, "", " \n ", "one", "one two three four", "Ä ö ü", "a" * 150, None, ""]


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * k >= 75 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return root, [len(s) for s in sets]


def near_copies():
    texts = list(EDGES)
    for base in range(6):
        w = words(120, base)
        for k in range(8):
            v = list(w)
            for at in random.Random(100 * base + k).sample(range(120), k):
                v[at] = f"x{k}{at}"
            texts.append(" ".join(v))
        texts += [" ".join(w)] * 3
    return texts + [" ".join(words(60, 900 + i)) + " " + " ".join(words(50, 77)) for i in range(30)]


def test_jaccard_by_brute_force(spark):
    texts = near_copies()
    root, n = brute_components(texts)
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in jaccard.classes(rows(spark, texts)).collect()}
    assert got == {i: (root[i], n[i]) for i in range(len(texts))}
    kept = [r.doc_id for r in jaccard.one_of_each(rows(spark, texts)).select("doc_id").collect()]
    assert sorted(kept) == sorted(set(root))


def test_one_of_each_with_null_and_repeated_ids(spark):
    a, b, c, d, e, f = (" ".join(words(60, 50 + k)) for k in range(6))
    near = " ".join([*d.split()[:-1], "end"])
    docs = [(None, a), (None, b), (None, a), (None, None), (None, ""), (5, c), (5, near), (1, d), (7, e), (7, e), (8, None), (8, None), (9, f), (10, f), (None, f)]
    got = jaccard.one_of_each(spark.createDataFrame([(i, t, "en", "s", 0, "x", 1) for i, t in docs], SCHEMA))
    assert got.columns == SCHEMA.replace(",", "").split()[::2]
    want = [(None, a), (None, b), (None, None), (None, ""), (5, c), (1, d), (7, e), (8, None), (9, f)]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(repr, want))


def test_tree_join_by_sets():
    r = np.random.default_rng(1)
    base = np.unique(r.integers(0, 1 << 60, 300, dtype=np.uint64))
    others = [np.unique(np.concatenate((base[r.random(len(base)) > k / 20], r.integers(0, 1 << 60, 10 * k, dtype=np.uint64)))) for k in range(9)]
    for got, y in zip(links.tree_join(base, others), others, strict=True):
        k = len(set(base) & set(y))
        assert got == (k if 100 * k >= 75 * (len(base) + len(y) - k) else 0)


def brute_spans(texts):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(b[i : i + 100])
        out.append(gone)
    return out


def test_suffix_dedup_by_brute_force(spark, monkeypatch):
    passage = " ".join(words(60, 5))
    texts = [*EDGES, "ab" * 400, *(" ".join(words(40, 50 + i)) + passage[i % 7 :] + " ".join(words(30, 80 + i)) for i in range(25)), passage, passage]
    want = brute_spans(texts)
    for hot in (20_000, 3):  # gathered contexts, and fingerprints of single strings
        monkeypatch.setattr(suffix, "HOT", hot)
        got = suffix.sp.digests(suffix.sp.with_spans(rows(spark, texts).select("doc_id", "text"), suffix.repeated_spans(rows(spark, texts)))).collect()
        for r in got:
            b = np.frombuffer((texts[r.doc_id] or "").encode(), np.uint8)
            assert (r.n_removed, r.kept_sha256) == (int(want[r.doc_id].sum()), hashlib.sha256(b[~want[r.doc_id]].tobytes()).hexdigest()), r.doc_id


def test_maximal_repeats_by_brute_force():
    texts = [b"xabcabcy", b"zabcq", b"abc"]
    got = suffix.maximal_repeats(texts, 2)
    places = collections.defaultdict(set)
    for i, t in enumerate(texts):
        for a in range(len(t)):
            for b in range(a + 2, len(t) + 1):
                places[t[a:b]].add((i, a))
    want = []
    for s, at in places.items():
        left = {texts[i][a - 1] if a else -1 - i for i, a in at}
        right = {texts[i][a + len(s)] if a + len(s) < len(texts[i]) else -1 - i for i, a in at}
        if len(at) > 1 and (len(left) > 1 or min(left) < 0) and (len(right) > 1 or min(right) < 0):
            want.append((len(s), sorted(at)))
    assert sorted(got) == sorted(want)


def test_paragraphs(spark):
    p = [" ".join(words(60, i)) for i in range(4)]
    near = p[0].split()
    near[30] = "changed"
    texts = [*EDGES, f"{p[0]}\n{p[1]}\nshort", f"{p[2]}\n{' '.join(near)}\nshort", p[1], f"{p[3]}\n{p[3]}"]
    got = [r.text for r in paragraphs.remove(rows(spark, texts)).orderBy("doc_id").collect()]
    n = len(EDGES)
    assert got[:n] == EDGES
    assert got[n:] == [texts[n], f"{p[2]}\nshort", "", f"{p[3]}\n"]


def test_short_paragraphs(spark, monkeypatch):
    """Lines of 2 to 9 words go as well: equal ones of few shingles, near ones of 7 words or more; also by the hot lines' way."""
    a, b, c = (words(n, 70 + n) for n in (2, 6, 9))
    line = " ".join
    texts = [f"{line(a)}\n{line(b)}\n{line(c)}\nend", f"{line(b)}\nown\n{line(a).upper()}\n{line(c[:8])}\n\nend", f"{line(b[:5])}\n{line(a)}"]
    for hot in (1000, 2):
        monkeypatch.setattr(paragraphs, "HOT", hot, raising=False)
        got = [r.text for r in paragraphs.remove(rows(spark, texts)).orderBy("doc_id").collect()]
        assert got == [texts[0], "own\n\nend", f"{line(b[:5])}\n"]
    wrapped = "\n".join(line(words(6, k)) for k in range(10))  # a passage of 60 words in short lines
    assert [r.text for r in paragraphs.remove(rows(spark, [wrapped, wrapped])).orderBy("doc_id").collect()] == [wrapped, ""]


def test_pii_by_plain_patterns(spark):
    base = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m)
    good = {"email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")), "card": lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m)), "phone": lambda m: 9 <= len(digits(m)) <= 15}
    r = random.Random(4)
    texts = [*EDGES, "é a.b@c.d-e@f.g x@y.z@q.r", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255", "4111 1111-1111 1111 0 +1 (255) 555-8013 +12", "GB82WEST12345698765432 iban", "1 " * 9000]
    texts += ["".join(r.choice("1234.@+- ab(") for _ in range(300)) for _ in range(60)]
    got = {x.doc_id: x.pii_spans for x in pii.detect(rows(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = sorted((m.start(), k, m.end()) for k, (n, p) in enumerate(base.items()) for m in re.finditer(p, t or "") if good[n](m[0]))
        assert [(s.start, s.rank, s.end) for s in got[i] if s.rank < 4] == want, t
    assert any(s.kind == "iban" for s in got[len(EDGES) + 3])
    assert "[EMAIL]" in pii.redact(rows(spark, ["mail a@b.cd now"])).first().text


def test_mixing(spark):
    texts = [" ".join(words(20 + i % 7, i)) for i in range(3000)]
    docs = rows(spark, texts, "a").union(rows(spark, texts[:300], "b")).union(rows(spark, [None, ""], None))
    got = mixing.mix(docs).collect()
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        target, taken = own[0].mix_target, sum(r.mix_copies * r.mix_size for r in own)
        assert target <= 2 * own[0].mix_source_size and abs(taken - target) <= 0.1 * target
        assert all(r.mix_copies <= 2 for r in own)
    assert mixing.emit(docs).columns == docs.columns and mixing.mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op4_mixing", "op7_decontamination", "op8_ngram_jaccard"])
def test_sql(spark, name):
    c = duckdb.connect()
    for n in ("documents", "benchmark"):
        c.execute(f"create view {n} as select * from read_parquet('{SF}/{n}.parquet')")
    got = q.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = c.execute(f"select {', '.join(columns)} from ({q.SQL[name]}) t").fetchall()
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want))


def test_decontamination_shards_agree(spark):
    docs, bench = common.table(spark, SF, "documents"), common.table(spark, SF, "benchmark")
    a, b = (sorted(map(str, decontaminate.scan(docs, bench, max_bytes=n).collect())) for n in (16_000_000, 2_000))
    assert a == b
    empty = decontaminate.scan(rows(spark, EDGES), bench.limit(0)).collect()
    assert len(empty) == len(EDGES) and not any(r.dc_hits for r in empty)


def test_ann_recall_and_edges(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(1500, 16))
    bad = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0]), (5004, [])]
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9000 + i, x[3].tolist()) for i in range(40)] + bad, "vec_id long, embedding array<double>")
    got = ann.search(base, base.filter("vec_id % 20 = 0"), "vec_id", "embedding").toPandas()
    ids = np.concatenate((np.arange(1500), np.arange(9000, 9040)))
    y = np.concatenate((x, np.repeat(x[3:4], 40, 0)))
    hits = total = 0
    for k in ids[ids % 20 == 0]:
        s = y @ y[np.flatnonzero(ids == k)[0]]
        s[ids == k] = -np.inf
        best = ids[np.lexsort((ids, -np.round(s, 9)))[:20]]
        mine = got[got.query_id == k].sort_values("rank")
        assert len(mine) == 20 and k not in set(mine.id)
        hits, total = hits + len(set(best) & set(mine.id)), total + 20
    assert hits / total >= 0.9
    assert ann.search(base.limit(0), base, "vec_id", "embedding").count() == 0


def test_html():
    page = "<html><head><title>t</title></head><body><nav>n</nav><div class='ad'>a</div><div class=post><h1>H &amp; h</h1><p>One  <b>t</b>wo<p>three</div><div id=comments><p>long long comment here</p></div><footer>f</footer></body>"
    p = html.Page(page)
    assert p.along(None) == "H & h One two three"
    assert html.Page("").along(None) == "" and html.Page("<p>cut <b").along("nowhere") == "cut"


def test_html_keeps_every_page(spark):
    got = html.op3_html(spark, SF).collect()
    assert len(got) == common.table(spark, SF, "pages").count() and all(len(r.text) == r.n_chars for r in got)


@pytest.mark.parametrize("module,label,folds,held", [(toxicity, "toxic", 4, 2), (quality, "quality", 5, 0)])
def test_classifiers_held_out(spark, module, label, folds, held):
    sf = "/root/testdata/sf0.1"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    model = module.train(docs, labels, limit=1500)
    test = docs.join(labels, "doc_id").filter(f"length(text) < 4000").limit(4000)
    scored = module.score(test.select("doc_id", "text", label), model).collect()
    scored = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % folds == held]
    right = sum((r[f"{label if label == 'quality' else 'toxic'}_score"] >= 0.3) == (r[label] == 1) for r in scored)
    assert right / len(scored) > 0.94
    edges = module.score(rows(spark, EDGES).drop("spans"), model).collect()
    assert len(edges) == len(EDGES)


def test_messages_by_enumeration():
    rng = np.random.default_rng(2)
    trans = rng.normal(size=(2, 2))
    seqs = [rng.normal(size=n) for n in (5, 1, 3, 0)]
    for e, got in zip(seqs, toxicity.messages(seqs, trans), strict=True):
        n = len(e)
        mass = np.zeros((n, 2))
        for code in range(2**n):
            y = [(code >> k) & 1 for k in range(n)]
            w = np.exp(sum(e[k] * y[k] for k in range(n)) + sum(trans[y[k - 1], y[k]] for k in range(1, n)))
            for k in range(n):
                mass[k, y[k]] += w
        assert np.allclose(got, np.log(mass[:, 1] / mass[:, 0])) if n else len(got) == 0


def test_pipeline_stages(spark):
    docs = common.table(spark, SF, "documents")
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema) if k < 4 else stage(spark, docs, SF)
        assert docs.columns == names
    assert docs.count() > 0
