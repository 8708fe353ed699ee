"""Removal of byte spans from documents, shared by the operators that delete repeated text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_prefix, saved, small, text_bytes, unpacked, whole_id

def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans united where they overlap or touch, by document and start."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    # ends run on within a document only: a document's own offset keeps them apart
    new_doc = np.concatenate(([True], doc[1:] != doc[:-1]))
    shift = np.cumsum(new_doc) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + shift)
    fresh = np.concatenate(([True], start[1:] + shift[1:] > reach[:-1]))
    first = np.flatnonzero(fresh)
    last = np.concatenate((first[1:], [len(doc)])) - 1
    return doc[first], start[first], (reach - shift)[last]


def per_document(packed: DataFrame) -> DataFrame:
    """(sp_id, sp_spans): merged packed spans of each document, from rows (bucket, doc, start, end) of packed columns; bucket is by document."""

    def run(group: pa.Table) -> pa.Table:
        doc, start, end = merged(*(unpacked(group, c) for c in ("doc", "start", "end")))
        ids, first = np.unique(doc, return_index=True)
        cuts = [*first[1:], len(doc)]
        both = np.stack((start, end), 1)
        return pa.table({"sp_id": pa.array(ids, pa.int64()), "sp_spans": pa.array([both[i:j].tobytes() for i, j in zip(first, cuts, strict=True)], pa.binary())})

    return packed.groupBy("bucket").applyInArrow(run, "sp_id long, sp_spans binary")


def with_spans(docs: DataFrame, spans: DataFrame, own: str = "sp_") -> DataFrame:
    """docs with the column sp_spans (null without any; own: its prefix): broadcast if the spans' bytes are few (counted), else by a shuffle."""
    spans = small(saved(spans.select(F.col("sp_id").alias(own + "id"), F.col("sp_spans").alias(own + "spans"))), F.octet_length(own + "spans") + 24)
    return docs.join(spans, whole_id(docs) == spans[own + "id"], "left").drop(own + "id")


def kept_parts(data: bytes, packed: bytes | None) -> tuple[list[bytes], int, int]:
    """What stays of a text's bytes, how many bytes go, and in how many runs."""
    if not packed:
        return [data], 0, 0
    at, parts, gone, runs = 0, [], 0, 0
    for a, b in np.frombuffer(packed, np.int64).reshape(-1, 2):
        a, b = max(0, int(a)), min(int(b), len(data))
        if a < b:
            parts.append(data[at:a])
            gone, runs, at = gone + b - a, runs + 1, b
    return [*parts, data[at:]], gone, runs


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of documents with spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_bytes(batch.column("text"))
            rows = []
            for i, packed in enumerate(batch.column("sp_spans").to_pylist()):
                parts, gone, runs = kept_parts(data[off[i] : off[i + 1]].tobytes(), packed)
                h = hashlib.sha256()
                for p in parts:
                    h.update(p)
                rows.append((int(off[i + 1] - off[i]), gone, runs, h.hexdigest()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text", "sp_spans").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def removed(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The documents, their texts without the spans (a character cut in two loses its rest)."""
    own = free_prefix(docs, "sp_")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(own + "spans").to_pylist()
            new = [None if t is None else t if not s else b"".join(kept_parts(t.encode(), s)[0]).decode("utf-8", "ignore") for t, s in zip(batch.column("text").to_pylist(), held, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == "text" else batch.column(i) for i, c in enumerate(names)], names=names)

    return with_spans(docs, spans, own).mapInArrow(run, docs.schema)
