"""Operator 10: near-duplicate paragraphs by MinHash banding, exact verification and components.

A paragraph is a line (between \\n) of at least MIN_WORDS words (a parameter); its set holds its distinct 5-word shingles, or the line as
a whole if it has fewer words. Sets of fewer than LINKED members are similar only if equal, so their identity tells all. The
others get BANDS bands of ROWS minima, tuned for recall: a pair of similarity 0.75 shares a band with probability
1 - (1 - 0.75^3)^12 = 0.9986.
Colliding paragraphs are verified by the exact Jaccard similarity of their whole sets (links.py); of each component the
first paragraph (smallest doc_id, then place) stays and the others are removed with the line end after them.

Asked for passages of over so many words (the query asks for PASSAGE), lines in a row that near-copies precede go only if
they hold more words together: a short line that many documents have is no passage, but one wrapped in short lines is. And
every run of passage + 1 words, wherever its lines end, goes if a document of smaller doc_id has it too. Such a run's MinHash
(one function) is the least of its grams of half its words, so equal runs share it; those whose gram stands in one document
alone are left out, and the others are compared as wholes. Copies of a run inside one document stay, unless their lines go.

Defined results: null texts have no paragraphs; blank lines are never removed, nor are shorter lines than asked for (by default those of one word); rows with a null doc_id take no part;
repeated rows (equal doc_id) are one document: both keep or lose the same lines; an empty table gives no rows; extra
columns pass through ``remove``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans as sp
from .common import by_bucket, mix, pieces, release, saved, set_ids, shingle_sets, signatures, small, table, text_bytes, unpacked, whole_id, words
from .links import link, sets_sent

MIN_WORDS = 2
LINKED = 3
#: A paragraph with so many copies meets them by a broadcast, so that its rows don't gather in one task.
HOT = 1000
SPANS_PER_BUCKET = 100_000
BANDS, ROWS = 12, 3
SIGNATURE = 4
#: Words that a passage of the query has more than.
PASSAGE = 50
BYTES_PER_BUCKET = 5_000_000
_A = np.random.default_rng(1010).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.random.default_rng(2020).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """[set, band] keys."""
    flat, first = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    low = np.stack([np.minimum.reduceat((flat ^ b) * a, first) for a, b in zip(_A, _B, strict=True)], 1).reshape(len(sets), BANDS, ROWS)
    keys = np.zeros((len(sets), BANDS), np.uint64)
    for r in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + low[:, :, r])
    return mix(keys + np.arange(BANDS, dtype=np.uint64)[None, :])


def line_edges(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.unique(np.concatenate((off, np.flatnonzero(data == 10) + 1))).astype(np.int64)


def lines(batch: pa.RecordBatch, least_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """(text, start, end, words) of each line, bytes in its text, and (line, set) of the lines long enough."""
    data, off = text_bytes(batch.column("text"))
    edges = line_edges(data, off)
    start, end = edges[:-1], edges[1:]
    text = np.searchsorted(off, start, "right") - 1
    h, unit, _ = words(data, edges)
    count = np.bincount(unit, minlength=len(start)) if len(unit) else np.zeros(len(start), int)
    enough = count >= max(1, least_words)
    keep = enough[unit] if len(unit) else np.zeros(0, bool)
    number = np.cumsum(enough) - 1
    sets = [(int(i), s) for i, s in zip(np.flatnonzero(enough), (s for _, s in shingle_sets(h[keep], number[unit[keep]], int(enough.sum()))), strict=True)]
    return text, start - off[text], end - off[text], count, sets


def keyed(docs: DataFrame, least_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, start, end, words, node, n, sig, keys of each paragraph; sig and keys null where a node repeats nearby or has no near copies but equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            text, start, end, count, sets = lines(batch, least_words)
            if not sets:
                continue
            at = np.array([i for i, _ in sets])
            nodes = set_ids([s for _, s in sets])
            fresh = {k: i for i, k in reversed(list(enumerate(nodes)))}
            one = sorted(i for i in fresh.values() if len(sets[i][1]) >= LINKED)
            keys = band_keys([sets[i][1] for i in one]) if one else []
            sig, blob = [None] * len(sets), [None] * len(sets)
            for row, (i, bits) in enumerate(zip(one, signatures([sets[i][1] for i in one], SIGNATURE), strict=True)):
                sig[i], blob[i] = bits, keys[row].tobytes()
            ids = batch.column("doc_id").to_numpy()[text[at]]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(start[at]), pa.array(end[at]), pa.array(count[at], pa.int32()), pa.array(nodes, pa.int64()), pa.array([len(s) for _, s in sets], pa.int32()), pa.array(sig, pa.list_(pa.int64())), pa.array(blob, pa.binary())], names=["doc_id", "start", "end", "words", "node", "n", "sig", "keys"])

    return docs.mapInArrow(run, "doc_id long, start long, end long, words int, node long, n int, sig array<long>, keys binary")


def packed_rows(bucket: np.ndarray, buckets: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Packed columns, a row for each bucket; bucket: what tells it, hashed here."""
    rows = list(by_bucket((mix(bucket.view(np.uint64)) % np.uint64(buckets)).astype(np.int32), list(columns.values()))) if len(bucket) else []
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[1][k] for r in rows], pa.binary()) for k in range(len(columns)))], names=["bucket", *columns])


def judged_lines(docs: DataFrame, least_words: int = MIN_WORDS) -> DataFrame:
    """Paragraphs (doc_id, start, end, words, node, gone): gone where a near-copy precedes."""
    found = saved(keyed(docs, least_words))
    places = found.select("doc_id", "start", "end", "words", "node")
    first = saved(places.groupBy("node").agg(F.min(F.struct("doc_id", "start")).alias("at"), F.count("*").alias("copies")))
    where = first.select("node", F.xxhash64("at.doc_id").alias("lk"))

    def named_sets(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
        text, *_, sets = lines(batch, least_words)
        return ((int(text[i]), node, s) for (i, s), node in zip(sets, set_ids([s for _, s in sets]), strict=True))

    fetch = lambda wanted: sets_sent(docs, wanted, where, named_sets)
    labels = link(found.filter("keys is not null").select("node", "n", "sig", "keys"), fetch, heaped=True)
    linked = first.join(labels, "node")
    least = linked.groupBy("comp").agg(F.min("at").alias("least"))
    stays = first.join(linked.select("node", "comp").join(least, "comp").select("node", "least"), "node", "left").select("node", F.coalesce("least", "at").alias("stays"), "copies")
    hot = small(saved(stays.filter(F.col("copies") >= HOT)))
    met = places.join(hot, "node").union(places.join(hot.select("node"), "node", "left_anti").join(stays.filter(F.col("copies") < HOT), "node"))
    return saved(met.select("doc_id", "start", "end", "words", "node", (F.struct("doc_id", "start") != F.col("stays")).alias("gone")))


def with_text(docs: DataFrame) -> DataFrame:
    return docs.select(whole_id(docs).alias("doc_id"), "text").filter("doc_id is not null and text is not null")


def dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows of long columns, doc_id the first, packed by bucket of doc_id."""
    names = rows.columns

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield packed_rows(b.column(0).to_numpy(), buckets, {c: b.column(c).to_numpy() for c in names})

    return rows.mapInArrow(deal, ", ".join(["bucket int", *(f"{c} binary" for c in names)]))


def removed_lines(docs: DataFrame, least_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """Paragraphs (doc_id, start, end, words, node, gone), and (sp_id, sp_spans) of the removed ones."""
    told = judged_lines(with_text(docs), least_words)
    buckets = int(max(64, told.count() // SPANS_PER_BUCKET))
    return told, sp.per_document(dealt(told.filter("gone").select("doc_id", "start", "end"), buckets).withColumnRenamed("doc_id", "doc"))


# --- passages: runs of words, wherever lines end ---------------------------------------------------------------------

_C = np.random.default_rng(3030).integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of so many words, by first word."""
    total = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for j in range(width):
        total += h[j : j + len(total)] * _C[j]
    return mix(total)


def runs(h: np.ndarray, text: np.ndarray, passage: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, MinHash) of each run of passage + 1 words inside one text."""
    if len(h) <= passage:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    width = passage // 2 + 1
    low, have, want = rolled(h, width), 1, passage + 2 - width
    while have < want:
        step = min(have, want - have)
        low, have = np.minimum(low[:-step], low[step:]), have + step
    at = np.flatnonzero(text[: len(low)] == text[passage:])
    return at, low[at]


def repeated_runs(docs: DataFrame, passage: int, deal_to: int) -> DataFrame:
    """Packed spans (bucket, doc_id, start, end, words -1) of the runs of passage + 1 words that a smaller doc_id has too."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(64, total // BYTES_PER_BUCKET))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, off = text_bytes(batch.column("text"))
            h, text, _ = words(data, off)
            at, low = runs(h, text, passage)
            if len(at):
                text = text[at]
                fresh = np.concatenate(([True], (low[1:] != low[:-1]) | (text[1:] != text[:-1])))
                yield packed_rows(low[fresh], buckets, {"low": low[fresh], "doc_id": batch.column("doc_id").to_numpy()[text[fresh]]})

    def in_several(group: pa.Table) -> pa.Table:
        release()
        low, doc = unpacked(group, "low"), unpacked(group, "doc_id")
        order = np.lexsort((doc, low))
        low, doc = low[order], doc[order]
        fresh = np.concatenate(([True], (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])))
        low, doc = low[fresh], doc[fresh]
        first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        size = np.diff(np.concatenate((first, [len(low)])))
        several = np.repeat(size > 1, size)
        return pa.Table.from_batches([packed_rows(doc[several], deal_to, {"doc_id": doc[several], "low": low[several]})])

    def by_document(group: pa.Table) -> pa.Table:
        doc, low = unpacked(group, "doc_id"), unpacked(group, "low")
        order = np.lexsort((low, doc))
        ids, first = np.unique(doc[order], return_index=True)
        low = low[order]
        return pa.table({"pr_id": pa.array(ids, pa.int64()), "pr_low": pa.array([low[i:j].tobytes() for i, j in zip(first, [*first[1:], len(low)], strict=True)], pa.binary())})

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, off = text_bytes(batch.column("text"))
            edges = line_edges(data, off)
            h, line, start = words(data, edges)
            text = np.searchsorted(off, start, "right") - 1
            at, low = runs(h, text, passage)
            cut = np.searchsorted(text[at], np.arange(batch.num_rows + 1))
            asked = [np.frombuffer(x, np.uint64) for x in batch.column("pr_low").to_pylist()]
            hit = np.concatenate([np.isin(low[i:j], x) for i, j, x in zip(cut[:-1], cut[1:], asked, strict=True)])
            at, low = at[hit], low[hit]
            if not len(at):
                continue
            opens = np.concatenate(([True], line[1:] != line[:-1]))  # words that begin their line
            begin = np.where(opens, edges[line], start)
            close = edges[line + 1]
            newline = (data[close - 1] == 10).astype(np.int64)
            last = at + passage
            after = np.concatenate((start[1:], [0]))[last]
            whole_line = np.flatnonzero(opens)[np.cumsum(opens) - 1][last] >= at
            ends = np.concatenate((opens[1:], [True]))[last]
            end = np.where(ends, np.where(whole_line, close[last], close[last] - newline[last]), after)
            base = off[text[at]]
            yield packed_rows(low, buckets, {"key": rolled(h, passage + 1)[at], "doc_id": batch.column("doc_id").to_numpy()[text[at]], "start": (begin[at] - base).astype(np.int32), "end": (end - base).astype(np.int32)})

    def later(group: pa.Table) -> pa.Table:
        release()
        key, doc = unpacked(group, "key"), unpacked(group, "doc_id")
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        fresh = np.concatenate(([True], key[1:] != key[:-1]))[: len(key)]
        gone = doc != doc[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        doc, start, end = sp.merged(doc[gone], *(unpacked(group, c, np.int32)[order][gone].astype(np.int64) for c in ("start", "end")))
        return pa.Table.from_batches([packed_rows(doc, deal_to, {"doc_id": doc, "start": start, "end": end, "words": np.full(len(doc), -1)})])

    known = docs.mapInArrow(grams, "bucket int, low binary, doc_id binary").groupBy("bucket").applyInArrow(in_several, "bucket int, doc_id binary, low binary")
    known = saved(known.groupBy("bucket").applyInArrow(by_document, "pr_id long, pr_low binary"))
    asked = docs.join(small(known, F.octet_length("pr_low") + 24), docs["doc_id"] == known["pr_id"]).select("doc_id", "text", "pr_low")
    found = asked.mapInArrow(whole, "bucket int, key binary, doc_id binary, start binary, end binary")
    return found.groupBy("bucket").applyInArrow(later, "bucket int, doc_id binary, start binary, end binary, words binary")


def removed_passages(docs: DataFrame, least_words: int = MIN_WORDS, passage: int = PASSAGE) -> DataFrame:
    """(sp_id, sp_spans, n_paragraphs, n_removed_paragraphs) of each document with paragraphs or spans that go; see the module."""
    if not 0 < passage < len(_C):
        raise ValueError(f"passages have more words than 1 to {len(_C) - 1}")
    docs = with_text(docs)
    told = judged_lines(docs, least_words)
    buckets = int(max(64, told.count() // SPANS_PER_BUCKET))
    rows = dealt(told.select("doc_id", "start", "end", F.when(F.col("gone"), F.col("words")).otherwise(0).cast("long").alias("words")), buckets)

    def judge(group: pa.Table) -> pa.Table:
        release()
        columns = [unpacked(group, c) for c in ("doc_id", "start", "end", "words")]
        inner = columns[3] < 0
        doc, start, end, size = (c[~inner] for c in columns)
        order = np.lexsort((start, doc))
        doc, start, end, size = doc[order], start[order], end[order], size[order]
        fresh = np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1])))[: len(doc)]  # repeated rows are one document
        doc, start, end, size = doc[fresh], start[fresh], end[fresh], size[fresh]
        row = np.cumsum(np.concatenate(([True], (doc[1:] != doc[:-1]) | ((size[1:] > 0) != (size[:-1] > 0))))[: len(doc)]) - 1
        gone = np.bincount(row, size)[row] > passage if len(row) else np.zeros(0, bool)
        ids, at = np.unique(np.concatenate((doc, columns[0][inner])), return_inverse=True)
        n, n_gone = (np.bincount(at[: len(doc)][keep], minlength=len(ids)) for keep in (np.ones(len(doc), bool), gone))
        d, a, b = sp.merged(*(np.concatenate((x[gone], y[inner])) for x, y in zip((doc, start, end), columns, strict=False)))
        cut = np.searchsorted(d, ids), np.searchsorted(d, ids, "right")
        both = np.stack((a, b), 1)
        return pa.table({"sp_id": pa.array(ids, pa.int64()), "sp_spans": pa.array([both[i:j].tobytes() or None for i, j in zip(*cut, strict=True)], pa.binary()), "n_paragraphs": pa.array(n, pa.int64()), "n_removed_paragraphs": pa.array(n_gone, pa.int64())})

    rows = rows.union(repeated_runs(docs, passage, buckets))
    return saved(rows.groupBy("bucket").applyInArrow(judge, "sp_id long, sp_spans binary, n_paragraphs long, n_removed_paragraphs long"))


def remove(docs: DataFrame, least_words: int = MIN_WORDS, passage: int = 0) -> DataFrame:
    """The documents with their texts less the paragraphs (lines of least_words words and more) that near-copies precede; with a passage, less passages of over so many words only."""
    spans = removed_passages(docs, least_words, passage).filter("sp_spans is not null") if passage else removed_lines(docs, least_words)[1]
    return sp.removed(docs, spans)


def op10_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    told = removed_passages(docs)
    counts = told.select(F.col("sp_id").alias("pd_id"), "n_paragraphs", "n_removed_paragraphs")
    out = sp.digests(sp.with_spans(docs, told.filter("sp_spans is not null")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.join(counts, out["doc_id"] == counts["pd_id"], "left").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", zero("n_paragraphs"), zero("n_removed_paragraphs"))


QUERIES = {"op10_paragraph_dedup": op10_paragraph_dedup}
SQL: dict[str, str] = {}
