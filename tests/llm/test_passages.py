"""Passages of op10 and the heaps of links: what goes in long lines, what stays in clean texts, and rows that grow with nodes."""

import collections
import random

import numpy as np

from recollect.llm import common, links, paragraphs
from test_edges import brute_labels
from test_llm import rows, words


def test_passages_inside_lines(spark):
    """A passage of over 50 words goes from the middle of longer lines and over line ends; shorter repeats stay."""
    line = " ".join
    passage, short = words(60, 900), line(words(13, 901))
    own = [line(words(80, 910 + i)) for i in range(8)]
    wrapped = "\n".join(line(passage[i : i + 9]) for i in range(0, 60, 9))
    texts = [
        f"{own[0]} {line(passage)} {own[1]}",
        f"{own[2]} {line(passage).upper()} {own[3]}\n{short}",
        f"{own[4]}\n{wrapped}\nend",
        f"{short}\n{own[5]} {line(passage[:50])} x {line(passage[50:])}",
        f"{own[6]}\n{short}\n{own[7]}\nend",
        None,
    ]
    got = [r.text for r in paragraphs.remove(rows(spark, texts), passage=50).orderBy("doc_id").collect()]
    assert got == [texts[0], f"{own[2]} {own[3]}\n{short}", f"{own[4]}\nend", texts[3], texts[4], None]


def test_passages_of_lines_in_a_row(spark):
    """Near copies of short lines go where they hold over 50 words in a row, blank lines aside; equal ids are one document."""
    line = " ".join
    part = [words(20, 930 + i) for i in range(3)]
    near = [[*p[:19], f"other{i}"] for i, p in enumerate(part)]
    first = "\n".join(map(line, part))
    texts = [f"head\n{first}\ntail", "\n\n".join(map(line, near)), f"{line(near[0])}\nown words here\n{line(near[1])}\n{line(near[2])}"]
    docs = rows(spark, texts)
    docs = docs.union(docs.filter("doc_id = 1"))
    got = [r.text for r in paragraphs.remove(docs, passage=50).orderBy("doc_id").collect()]
    assert got == [texts[0], "\n\n", "\n\n", texts[2]]
    told = {r.sp_id: (r.n_paragraphs, r.n_removed_paragraphs) for r in paragraphs.removed_passages(docs).collect()}
    assert told == {0: (3, 0), 1: (3, 3), 2: (4, 0)}


def test_runs_share_a_minhash():
    """Whatever stands around it, a run's MinHash is the same; a text of so many words has no run."""
    h = np.random.default_rng(1).integers(1, 1 << 63, 300).astype(np.uint64)
    for passage in (1, 2, 7, 50):
        at, low = paragraphs.runs(h, np.repeat([0, 1, 2], [100, passage, 200 - passage]), passage)
        assert at.tolist() == [*range(100 - passage), *range(100 + passage, 300 - passage)]
        for i in (0, 100 + passage):
            alone = paragraphs.runs(h[i : i + passage + 1], np.zeros(passage + 1, int), passage)
            assert alone[0].tolist() == [0] and alone[1][0] == low[at.tolist().index(i)]


def test_heaps_grow_with_nodes(spark, monkeypatch):
    """Nodes that all pass the bounds are no pairs but one heap, a row a node, by whatever keys they meet."""
    monkeypatch.setattr(links, "HELD_PAIRS", 100)
    n = 60
    listed = spark.createDataFrame([(k, v, 40) for k in range(5) for v in range(n - k)], "k long, v long, n int")
    nodes = spark.createDataFrame([(v, 40, [0, 0, 0, 0]) for v in range(n)], "node long, n int, sig array<long>")
    edges, labels = spark.createDataFrame([], "a long, b long, d long"), spark.createDataFrame([], "node long, comp long")
    pairs, heaps = links.across(listed, nodes, edges, labels)
    assert pairs.isEmpty()
    sizes = collections.Counter(r.heap for r in heaps.collect())
    assert max(sizes.values()) == n and sum(sizes.values()) <= 5 * n


def test_heaps_join_components(spark):
    """A heap's links join what all its pairs of the similarity join, with no link inside a component."""
    r = random.Random(4)
    sets = {}
    for group in range(6):
        base = r.sample(range(group * 1000, group * 1000 + 900), 40)
        for i in range(12):
            sets[group * 100 + i] = np.sort(np.array([x if r.random() > 0.1 else 10_000 + r.randrange(10**6) for x in base], np.uint64))
    similar = [(a, b) for a in sets for b in sets if a < b and 7 * len(np.intersect1d(sets[a], sets[b])) >= 3 * (len(sets[a]) + len(sets[b]))]
    want = brute_labels([*similar, *((x, x) for x in sets)])
    known = {0: 0, 1: 0}
    fetch = lambda wanted: wanted.join(spark.createDataFrame([(k, s.tobytes()) for k, s in sets.items()], "node long, toks binary"), "node")
    heaps = spark.createDataFrame([(7, k) for k in sets], "heap long, node long")
    got = [(x.a, x.b) for x in links.joining(heaps, spark.createDataFrame(list(known.items()), "node long, comp long"), fetch).collect()]
    assert set(got) <= set(similar) | {(b, a) for a, b in similar} and (0, 1) not in got
    assert brute_labels([(0, 1), *got, *((x, x) for x in sets)]) == brute_labels([(0, 1), *similar, *((x, x) for x in sets)])
    assert len(got) == len(sets) - 1 - len(brute_labels([(0, 1), *similar, *((x, x) for x in sets)])) and len(want) > 6


def test_many_sets_at_once():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(1, 1 << 63, n).astype(np.uint64)) for n in (1, 2, 128, 129, 3, 700)]
    assert common.set_ids(sets) == [common.set_id(s) for s in sets] and common.set_ids([]) == common.signatures([], 4) == []
    assert all((a == common.signature(s, 4)).all() for a, s in zip(common.signatures(sets, 4), sets, strict=True))
