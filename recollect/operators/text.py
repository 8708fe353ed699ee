"""Text: chunking, lexical recall, redaction of answers."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as sc
from ..functions.porter import english_terms


_WORD = re.compile(r"[^ \t\n\r]+")


def word_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the white-space tokens of a text, in code points."""
    spans = np.array([m.span() for m in _WORD.finditer(text)], np.int64).reshape(-1, 2)
    return spans[:, 0], spans[:, 1]


def byte_pair_spans(path: str, pattern: str) -> Callable[[str], tuple[np.ndarray, np.ndarray]]:
    """The same for the byte pairs of a vocabulary file (a token in base64 and its rank a line), split by a pattern first.

    A token that begins inside a code point begins with the code point, so that windows cover the text without gaps."""

    def spans(text: str) -> tuple[np.ndarray, np.ndarray]:
        if path not in _vocabularies:
            import tiktoken

            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in open(path, "rb") if line.strip())}
            _vocabularies[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        encoding = _vocabularies[path]
        sizes = [len(encoding.decode_single_token_bytes(t)) for t in encoding.encode_ordinary(text)]
        at = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        leads = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)  # code points begun up to each byte
        begun = np.concatenate(([0], leads))
        starts = np.where(at < len(leads), leads[np.minimum(at, max(len(leads) - 1, 0))] - 1, begun[-1]) if len(leads) else at
        return starts[:-1], np.maximum(begun[at[1:]], starts[:-1])

    return spans


_vocabularies: dict = {}


def token_windows(docs: DataFrame, size: int = 1024, overlap: int = 128, spans: Callable[[str], tuple[np.ndarray, np.ndarray]] = word_spans) -> DataFrame:
    """id, chunk_index, n_tokens, char_start, char_end, chunk: windows of tokens as they stand in the text, text[start:end].

    The last window reaches the last token; blank texts have none. spans tells the tokens of a text. Offsets alone come from
    Python, a list a text; the windows are cut from the text in the JVM."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap in [0, size)")
    step = size - overlap

    @F.arrow_udf("array<struct<chunk_index:int,n_tokens:int,char_start:int,char_end:int>>")
    def windows(texts: pa.Array) -> pa.Array:
        parts, counts = [], []
        for text in texts.to_pylist():
            start, end = spans(text) if text and text.strip() else (np.zeros(0, np.int64),) * 2
            n = len(start)
            first = np.arange(0, max(1, n - overlap), step) if n else np.zeros(0, np.int64)
            last = np.minimum(first + size, n)
            parts.append((np.arange(len(first)), last - first, start[first], end[last - 1]))
            counts.append(len(first))
        columns = [pa.array(np.concatenate(c) if parts else [], pa.int32()) for c in zip(*parts, strict=True)] if parts else [pa.array([], pa.int32())] * 4
        rows = pa.StructArray.from_arrays(columns, ["chunk_index", "n_tokens", "char_start", "char_end"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), rows)

    t = docs.select("id", "text", F.explode(windows("text")).alias("w"))
    return t.select("id", "w.*", F.substring("text", F.col("w.char_start") + 1, F.col("w.char_end") - F.col("w.char_start")).alias("chunk"))


def token_chunks(docs: DataFrame, size: int = 1024, overlap: int = 128) -> DataFrame:
    """id, chunk_index, n_tokens, chunk of windows of white-space tokens, joined by one space; the last window reaches the end."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap in [0, size)")
    step = size - overlap
    t = docs.withColumn("tokens", F.filter(F.split("text", r"[ \t\n\r]+"), lambda x: x != ""))
    n = F.greatest(F.lit(1), F.ceil((F.size("tokens") - overlap) / step))
    # chunks are cut inside the row, so that a row of the result holds its chunk alone and not all tokens
    cut = F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.struct(i.alias("chunk_index"), F.slice("tokens", i * step + 1, size).alias("part")))
    t = t.filter(F.size("tokens") > 0).select("id", F.explode(cut).alias("c"))
    return t.select("id", "c.chunk_index", F.size("c.part").alias("n_tokens"), F.array_join("c.part", " ").alias("chunk"))


def pack_paragraphs(text: str, most: int = 2000) -> list[tuple[int, int]]:
    """(start, end) spans of paragraphs packed up to so many characters; an oversize paragraph is alone."""
    spans, at = [], 0
    for m in re.finditer(r"\n\s*\n", text):
        spans.append((at, m.start()))
        at = m.end()
    spans.append((at, len(text)))
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if not text[a:b].strip():
            continue
        if out and b - out[-1][0] <= most:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def paragraph_chunks(docs: DataFrame, most: int = 2000) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, k, a, b, max(1, (b - a) // 4)) for i, t in zip(f["id"], f["text"], strict=True) for k, (a, b) in enumerate(pack_paragraphs(t or "", most))]
            yield pd.DataFrame(rows, columns=["id", "chunk_index", "char_start", "char_end", "token_count"])

    return docs.select("id", "text").mapInPandas(run, "id long, chunk_index int, char_start int, char_end int, token_count int")


def terms(text: Column) -> Column:
    """Lower-cased letter runs of three or more."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda t: F.length(t) >= 3)


def lexical_recall(m: DataFrame, query: str, now: Column, k: int = 10, k1: float = 1.2, b: float = 0.75, english: bool = True) -> DataFrame:
    """Memories with all terms of the query, by BM25 mapped to [0, 1]; fused .70 lexical, .20 importance, .10 recency.

    english: terms are Porter stems of words and numbers without stop words, else plain letter runs of three or more."""
    if english:
        stop = frozenset(StopWordsRemover.loadDefaultStopWords("english"))
        asked = sorted(set(english_terms(query, stop)))
        split = F.udf(lambda t: english_terms(t, stop), "array<string>")
    else:
        asked, split = sorted({t for t in re.split(r"[^\w]+", query.lower()) if len(t) >= 3}), terms
    if not asked:
        return m.limit(0).withColumn("lexical", F.lit(0.0)).withColumn("relevance_score", F.lit(0.0))
    x = m.withColumn("terms", split(F.col("content"))).withColumn("length", F.size("terms"))
    occurs = lambda q: F.size(F.filter("terms", lambda t: t == q))
    count = [occurs(q) for q in asked]
    x = x.withColumns({f"tf{i}": c for i, c in enumerate(count)})
    stats = x.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(asked))])
    x = x.filter(" and ".join(f"tf{i} > 0" for i in range(len(asked)))).crossJoin(F.broadcast(stats))  # one row
    idf = lambda i: F.log(1 + (F.col("docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
    part = [idf(i) * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("length") / F.col("mean"))) for i in range(len(asked))]
    raw = sum(part[1:], part[0])
    x = x.withColumn("lexical", raw / (1 + raw)).withColumn("relevance_score", 0.7 * F.col("lexical") + 0.2 * F.col("importance_score") + 0.1 * sc.recency(now, F.col("created_at")))
    return x.select(*m.columns, "lexical", "relevance_score").orderBy(F.col("lexical").desc(), F.col("created_at").desc(), "id").limit(k)
