"""Operator 7: benchmark decontamination with one Aho-Corasick automaton.

The words of the normalised benchmark texts are numbered, and their windows of 10 consecutive words are the automaton's
keys, a number a step. Each document's text is scanned once: where its neighbouring words stand side by side in the
benchmark too, over as many words as the shortest window has, the automaton tells the windows that occur; their ends are
mapped back to words and, in spans, to code points of the original.

Bound: a worker holds the automaton of at most MAX_WORDS words of the benchmark (or of one item), measured at 413 MB for
8 100 000 nodes. A larger benchmark is split into such shards; each scans in a pass of its own, whose marks are written
before the next begins, so that workers never hold two. The marks are united, so the result is the same. The driver reads
the benchmark through an iterator and holds a shard's texts at a time. Defined results: null or wordless text has no
words and no hits; an item without words matches nothing; an item with a null id hits words but isn't counted; ids of
items are kept as strings, of any type; repeated rows repeat results; an empty benchmark or documents table gives no hits
or no rows; extra columns pass through ``clean`` and ``matches``, but for one named dc_spans, which ``matches`` replaces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_prefix, pieces, saved, table, without

WIDTH = 10
MAX_BYTES, MAX_WORDS = 16_000_000, 1_000_000
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def normal_words(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a UTF-8 text with A-Z lower-cased."""
    return text.translate(_NORMAL).split()


def places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Each word's start and end in the text's bytes."""
    solid = np.frombuffer(text.translate(_NORMAL), np.uint8) != 32
    edge = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    return edge[::2], edge[1::2]


class Windows:
    """The automaton of some items' windows, over numbers of words."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int = WIDTH):
        self.numbers: dict[bytes, int] = {}
        self.names = [item_id for item_id, _ in items]
        self.size: list[int] = []  # words of each window
        self.owner: list[int] = []  # the first item that has it, and the others
        self.others: dict[int, set[int]] = {}
        self.keys = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        pairs = []
        for k, (_, text) in enumerate(items):
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in normal_words((text or "").encode())]
            pairs.append(np.array(ids, np.int64))
            n = min(width, len(ids))
            for i in range(len(ids) - n + 1) if n else ():
                key = tuple(ids[i : i + n])
                window = self.keys.get(key, len(self.size))
                if window == len(self.size):
                    self.keys.add_word(key, window)
                    self.size.append(n)
                    self.owner.append(k)
                elif self.owner[window] != k:
                    self.others.setdefault(window, set()).add(k)
        self.least = min(self.size, default=0)
        self.base = len(self.numbers) + 1
        # words that stand side by side somewhere in the benchmark
        self.pairs = np.unique(np.concatenate([x[:-1] * self.base + x[1:] for x in pairs])) if self.size else np.zeros(0, np.int64)
        if self.size:
            self.keys.make_automaton()

    def runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of a document's words in which a window may stand."""
        if self.least == 1:
            inside = ids > 0
        elif not len(self.pairs) or len(ids) < self.least:
            return []
        else:
            both = ids[:-1] * self.base + ids[1:]
            inside = self.pairs[np.minimum(np.searchsorted(self.pairs, both), len(self.pairs) - 1)] == both
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        more = int(self.least > 1)
        return [(a, b + more) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b + more - a >= self.least]

    def found(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(last word, window) of each occurrence among a document's words."""
        if not self.size or not words:
            return []
        number = self.numbers.get
        ids = np.array([number(w, 0) for w in words], np.int64)
        return [(a + at, window) for a, b in self.runs(ids) for at, window in self.keys.iter(tuple(ids[a:b].tolist()))]

    def items_of(self, windows: set[int]) -> set[str]:
        known = {self.owner[w] for w in windows}.union(*(self.others.get(w, ()) for w in windows))
        return {self.names[k] for k in known} - {None}


def shards(benchmark: DataFrame, max_bytes: int = MAX_BYTES) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items in order of id, read through an iterator, in lists of at most max_bytes of text and MAX_WORDS words (one item at least)."""
    part, total, n_words = [], 0, 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").orderBy("item_id", "text").toLocalIterator():
        size, more = len((row[1] or "").encode()), len(normal_words((row[1] or "").encode()))
        if part and (total + size > max_bytes or n_words + more > MAX_WORDS):
            yield part
            part, total, n_words = [], 0, 0
        part.append((row[0], row[1]))
        total, n_words = total + size, n_words + more
    yield part


_built: dict[str, Windows] = {}


def marked(text: bytes, windows: Windows, old: np.ndarray) -> tuple[int, np.ndarray, set, list[tuple[int, int]]]:
    """Words of a text, numbers of those hit (also before), items with a window in it, and the runs of hit words in code points."""
    words = normal_words(text)
    marks, ids = np.zeros(0, np.int64), set()
    if found := windows.found(words):
        last = np.array([at for at, _ in found])
        delta = np.zeros(len(words) + 1, np.int64)
        np.add.at(delta, last - np.array([windows.size[w] for _, w in found]) + 1, 1)
        np.add.at(delta, last + 1, -1)
        marks = np.flatnonzero(np.cumsum(delta[:-1]))
        ids = windows.items_of({w for _, w in found})
    marks = np.union1d(marks, old) if len(old) else marks
    if not len(marks):
        return len(words), marks, ids, []
    start, end = places(text)
    first = np.concatenate(([True], np.diff(marks) > 1))
    final = np.concatenate((first[1:], [True]))
    points = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return len(words), marks, ids, list(zip(points[start[marks[first]]].tolist(), points[end[marks[final]]].tolist(), strict=True))


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, max_bytes: int = MAX_BYTES, keep: bool = False, own: str = "dc_") -> DataFrame:
    """doc_id, dc_words (their number), dc_hits (marked word numbers), dc_items (ids with an occurring window), dc_spans
    (runs of hit words, array<struct<start:int,end:int>> in code points); with keep also the columns of docs. own: the prefix."""
    spark = docs.sparkSession
    kept = [f"`{f}`" for f in docs.columns if keep or f == "doc_id"]
    none = {"words": "bigint", "hits": "array<int>", "items": "array<string>", "spans": "array<struct<start:int,end:int>>"}
    out = docs.select(*kept, *([] if keep else ["text"]), *[(F.lit(0) if n == "words" else F.array()).cast(kind).alias(own + n) for n, kind in none.items()])
    schema = out.schema
    for k, items in enumerate(shards(benchmark, max_bytes)):
        out = saved(out) if k else out  # a pass ends before the next one's automaton is built
        sent = spark.sparkContext.broadcast((width, items))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            width, items = sent.value
            name = hashlib.sha256(repr((width, items)).encode()).hexdigest()
            if name not in _built:
                _built.clear()
                _built[name] = Windows(items, width)
            a = _built[name]
            for batch in pieces(batches):
                old_hits, old_items = (batch.column(own + n).to_pylist() for n in ("hits", "items"))
                got = [marked((t or "").encode(), a, np.array(h, np.int64)) for t, h in zip(batch.column("text").to_pylist(), old_hits, strict=True)]
                new = {
                    own + "words": pa.array([g[0] for g in got], pa.int64()),
                    own + "hits": pa.array([g[1].astype(np.int32) for g in got], pa.list_(pa.int32())),
                    own + "items": pa.array([sorted(g[2].union(i)) for g, i in zip(got, old_items, strict=True)], pa.list_(pa.string())),
                    own + "spans": pa.array([[{"start": x, "end": y} for x, y in g[3]] for g in got], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                }
                yield pa.RecordBatch.from_arrays([new.get(n, batch.column(i)) for i, n in enumerate(batch.schema.names)], names=batch.schema.names)

        out = out.mapInArrow(run, schema)
    return out if keep else out.drop("text")


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents without a hit, with their own columns."""
    own = free_prefix(docs, "dc_")
    return scan(docs, benchmark, width, keep=True, own=own).filter(F.size(own + "hits") == 0).select(*[f"`{c}`" for c in docs.columns])


def matches(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents with a hit, with dc_spans: the runs of hit words in code points of the text, end exclusive."""
    docs = without(docs, "dc_spans")
    own = free_prefix(docs, "dc_")
    found = scan(docs, benchmark, width, keep=True, own=own).filter(F.size(own + "hits") > 0)
    return found.select(*[f"`{c}`" for c in docs.columns], F.col(own + "spans").alias("dc_spans"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort("dc_items"), ",")
    return found.select("doc_id", F.col("dc_words").alias("n_words"), F.size("dc_hits").cast("long").alias("n_hit"), F.size("dc_items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.size("dc_hits") > 0).alias("contaminated"))


#: Windows of the benchmark are joined to those of the documents: the same rows by another way.
DECONTAMINATION_SQL = r"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i + 1 : i + least(len(ws), 10)], ' ') AS win FROM (SELECT *, unnest(range(0, greatest(len(ws) - 10, 0) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i + 1 : i + n], ' ') AS win FROM (SELECT doc_id, ws, n, unnest(range(0, len(ws) - n + 1)) AS i FROM w CROSS JOIN sizes WHERE len(ws) >= n)),
m AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, n, i FROM m)) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""

QUERIES = {"op7_decontamination": op7_decontamination}
SQL = {"op7_decontamination": DECONTAMINATION_SQL}
