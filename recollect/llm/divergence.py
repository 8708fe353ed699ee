"""Operator 13: source divergence audit by sorted runs.

Documents are read once: each task counts terms over a bounded number of distinct (lang, source, term) and hands on
partial runs. They are dealt by (lang, term), sorted by (lang, term, source, document) within their partitions, and
scanned as a stream: runs of equal (lang, term, source) add up to counts, runs of (lang, term) to document frequencies,
which decide what is kept. Kept runs are dealt again in blocks of about BLOCK terms of one lang, each beside its
lang's sources; a block emits partial sums for each pair of sources and the best terms of each source, however many
terms a lang has. A document stands in one row and so in one task, which makes frequencies of partial runs add up.

All arithmetic is in whole numbers. Defined results: null text, lang and source count as ''; a repeated row is a document
of its own; a text without terms still makes its source occur; a lang without kept terms has pairs of value 0; a lang of
one source has no pairs; ties of value go to the smaller item by UTF-8; an empty table gives no rows; other columns are
not read, so their names and doc_id's values don't matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, small, table

MIN_DOCS, TOP, UNIT = 10, 10, 1_000_000_000
#: Distinct (lang, source, term) that a task holds before it hands its counts on.
HELD = 400_000
#: Terms of a block (about), and cells (terms by sources) that are computed at a time.
BLOCK, CELLS = 5_000, 2_000_000
#: Bytes of a text that are split at a time.
PIECE = 8_000_000
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms [^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+ with A-Z lower-cased, piece by piece of a long text."""
    at = 0
    while len(text) - at > PIECE:
        part = text[at : at + PIECE].translate(_TERMS)
        cut = part.rfind(b" ") + 1
        if not cut:  # a term longer than a piece goes on to its end
            size = PIECE
            while at + size < len(text) and (cut := text[at + size : at + size + PIECE].translate(_TERMS).find(b" ")) < 0:
                size += PIECE
            cut = min(size + max(cut, 0), len(text) - at)
            part = text[at : at + cut].translate(_TERMS)
        yield part[:cut].split()
        at += cut
    yield text[at:].translate(_TERMS).split()


def partial_runs(docs: DataFrame, held: int = HELD) -> DataFrame:
    """lang, term, source, document (number of the first one), df, n: counts of a part of a task's documents."""
    plain = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("document"))
    kinds = {"lang": pa.string(), "term": pa.string(), "source": pa.string(), "document": pa.int64(), "df": pa.int64(), "n": pa.int64()}

    def handed(counts: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (first, df, n) in counts.items():
            if n:
                k = len(n)
                term = pa.array(list(n), pa.binary()).cast(pa.string())
                columns = [pa.array([lang] * k, pa.string()), term, pa.array([source] * k, pa.string()), pa.array(np.full(k, first)), pa.array([df[t] for t in n], pa.int64()), pa.array(list(n.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[int, Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for lang, source, text, document in zip(*(batch.column(c) for c in ("lang", "source", "text", "document")), strict=True):
                _, df, n = counts.setdefault((lang.as_py(), source.as_py()), (document.as_py(), Counter(), Counter()))
                before, seen = len(n), set()
                for terms in terms_of(memoryview(text.as_buffer()).tobytes()):
                    n.update(terms)
                    seen.update(terms)
                df.update(seen)
                size += len(n) - before + 1
                if size > held:
                    yield from handed(counts)
                    counts, size = {}, 0
        yield from handed(counts)

    return plain.mapInArrow(run, "lang string, term string, source string, document long, df long, n long")


def _starts(t: pa.Table, columns: list[str]) -> np.ndarray:
    """Row numbers at which a run of equal values begins."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for c in columns:
        column = t.column(c)
        new[1:] |= pc.not_equal(column.slice(1), column.slice(0, t.num_rows - 1)).to_numpy()
    return np.flatnonzero(new)


def kept_runs(runs: DataFrame, least: int = MIN_DOCS) -> DataFrame:
    """lang, term, sources, counts: one row for each term in at least so many documents of its lang."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches):
            first = _starts(t, ["lang", "term"])
            often = np.add.reduceat(t.column("df").to_numpy(), first) >= least
            last = np.append(first[1:], t.num_rows)
            size = (last - first)[often]
            if not len(size):
                continue
            take = pa.array(np.concatenate([np.arange(a, b) for a, b in zip(first[often], last[often], strict=True)]))
            lang, term = (t.column(c).take(pa.array(first[often])).combine_chunks() for c in ("lang", "term"))
            offsets = pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, t.column(c).take(take).combine_chunks()) for c in ("source", "n")]
            yield pa.RecordBatch.from_arrays([lang, term, *lists], names=["lang", "term", "sources", "counts"])

    dealt = runs.repartition("lang", "term").sortWithinPartitions("lang", "term", "source", "document")
    return dealt.mapInArrow(scan, "lang string, term string, sources array<string>, counts array<long>")


def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows, those of equal (lang, term, source) added up, cut between terms: a term's run is in one table."""
    open_run = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch]).drop_columns(["document"])
        t = t if open_run is None else pa.concat_tables([open_run, t])
        first = _starts(t, ["lang", "term", "source"])
        sums = {c: pa.chunked_array([np.add.reduceat(t.column(c).to_numpy(), first)]) for c in ("df", "n")}
        t = t.take(pa.array(first)).combine_chunks()
        for c, values in sums.items():
            t = t.set_column(t.schema.get_field_index(c), c, values)
        cut = int(_starts(t, ["lang", "term"])[-1])
        open_run = t.slice(cut)
        if cut:
            yield t.slice(0, cut)
    if open_run is not None:
        yield open_run


def share(count: int, total: int, terms: int) -> int:
    """p of a term: its smoothed share in units of 10^-9."""
    return 1 + UNIT * (count + 2) // (total + 2 * terms)


def shares(counts: np.ndarray, totals: np.ndarray, terms: int) -> np.ndarray:
    if counts.max(initial=0) < 9_000_000_000:
        return 1 + UNIT * (counts + 2) // (totals + 2 * terms)
    return np.array([share(c, n, terms) for c, n in zip(counts.tolist(), totals.tolist(), strict=True)], np.int64)


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); shares are at most 10^9 + 1, so 64 bits are enough."""
    return (p - q) ** 2 // (p + q)


def of_block(runs: pa.Table, groups: pa.Table, top: int = TOP) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Sums over a block's terms for each pair of sources (square, symmetric), and (source, row, value) of each source's best terms.

    groups: source, total, terms of the lang; the terms' runs hold the sources with occurrences alone."""
    totals, terms = groups.column("total").to_numpy(), int(groups.column("terms")[0].as_py())
    s = len(totals)
    none = np.array([share(0, n, terms) for n in totals.tolist()], np.int64)
    lists, counted = runs.column("sources").combine_chunks(), runs.column("counts").combine_chunks()
    size = pc.list_value_length(lists).to_numpy()
    row = np.repeat(np.arange(len(size)), size)
    source = pc.index_in(lists.flatten(), groups.column("source").combine_chunks()).to_numpy()
    count = counted.flatten().to_numpy()
    p = shares(count, totals[source], terms)
    # against the lang as a whole
    in_lang = np.add.reduceat(count, np.cumsum(size) - size)
    whole = shares(in_lang, np.full(len(in_lang), totals.sum()), terms)[row]
    value = apart(p, whole)
    by_term = np.argsort(pc.array_sort_indices(runs.column("term").cast(pa.binary()).combine_chunks()).to_numpy())  # rank of each row's term
    above = np.flatnonzero(p > whole)
    order = above[np.lexsort((by_term[row[above]], -value[above], source[above]))]
    place = np.arange(len(order)) - np.searchsorted(source[order], source[order])
    best = [(int(source[i]), int(row[i]), int(value[i])) for i in order[place < top]]
    # every pair: as if no source had any of the terms, then what each occurrence changes
    base = apart(none[:, None], none[None, :])
    change = np.zeros((s, s), np.int64)
    number = np.arange(s)
    ends, per = np.cumsum(size), max(1, CELLS // s)
    for a in range(0, len(size), per):
        b = min(a + per, len(size))
        at = slice(int(ends[a] - size[a]), int(ends[b - 1]))
        dense, occurs = np.tile(none, (b - a, 1)), np.zeros((b - a, s), bool)
        dense[row[at] - a, source[at]] = p[at]
        occurs[row[at] - a, source[at]] = True
        for i in np.unique(source[at]):
            mine = np.flatnonzero(occurs[:, i])
            moved = apart(dense[mine, i][:, None], dense[mine]) - base[i]
            change[i] += np.where(occurs[mine] & (number < i), 0, moved).sum(0)  # a pair of two occurrences counts once
    return base * len(size) + change + change.T, best


def audit(docs: DataFrame, least: int = MIN_DOCS, top: int = TOP, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(lang, source, item, value) of each pair of sources of a lang, and of each source's best terms (more than top a source, unranked)."""
    runs = saved(kept_runs(partial_runs(docs), least))
    groups = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).distinct()
    totals = runs.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("total"))
    sizes = runs.groupBy("lang").agg(F.count("*").alias("terms"))
    groups = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = saved(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms")))
    # a lang's terms in as many blocks as their number asks for, each beside all its sources
    number = F.ceil(F.col("terms") / block)
    sizes = small(saved(sizes.select("lang", number.alias("blocks"))), 64 + F.octet_length("lang"))
    runs = runs.join(sizes, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks"))).drop("blocks")
    beside = groups.filter("terms > 0").withColumn("of_block", F.explode(F.sequence(F.lit(0).cast("long"), number - 1))).withColumnRenamed("lang", "of_lang")

    none = pa.table({n: pa.array([], pa.int64() if n == "value" else pa.string()) for n in ("lang", "source", "part", "item", "value")})

    def emitted(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return none
        pairs, best = of_block(left, right, top)
        a, b = np.nonzero(~np.eye(len(pairs), dtype=bool))
        names = right.column("source").combine_chunks()
        source = pa.concat_arrays([names.take(pa.array(a)), names.take(pa.array([x[0] for x in best], pa.int64()))])
        item = pa.concat_arrays([names.take(pa.array(b)), left.column("term").combine_chunks().take(pa.array([x[1] for x in best], pa.int64()))])
        value = pa.array(np.concatenate([pairs[a, b], np.array([x[2] for x in best], np.int64)]))
        part = pa.array(["pair"] * len(a) + ["term"] * len(best), pa.string())
        return pa.table([pa.array([key[0].as_py()] * len(value), pa.string()), source, part, item, value], names=["lang", "source", "part", "item", "value"])

    out = saved(runs.groupBy("lang", "block").cogroup(beside.groupBy("of_lang", "of_block")).applyInArrow(emitted, "lang string, source string, part string, item string, value long"))
    pairs = out.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    bare = groups.filter("terms = 0").select("lang", "source")
    zeros = bare.join(bare.withColumnRenamed("source", "item"), "lang").filter("source <> item").withColumn("value", F.lit(0).cast("long"))
    return pairs.unionByName(zeros), out.filter("part = 'term'").drop("part")


def ranked(rows: DataFrame, part: str, most: Column | None = None) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    out = rows.withColumn("rank", rank)
    return (out if most is None else out.filter(F.col("rank") <= most)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, terms = audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))
    return ranked(pairs, "pair").unionByName(ranked(terms, "term", F.lit(TOP)))


DIVERGENCE_SQL = rf"""WITH t AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT d, lang, source, unnest(ws) AS term FROM t),
k AS (SELECT lang, term FROM w GROUP BY 1, 2 HAVING count(DISTINCT d) >= {MIN_DOCS}),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY 1),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM w JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT lang, source, coalesce(sum(c), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM t) LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 2)) // (n + 2 * v) AS p FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (c + 2)) // (n + 2 * v) AS q FROM (SELECT lang, term, sum(c) AS c FROM c GROUP BY 1, 2) JOIN (SELECT lang, sum(n) AS n FROM g GROUP BY 1) USING (lang) JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
 UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r) WHERE part = 'pair' OR rank <= {TOP}"""

QUERIES = {"op13_divergence": op13_divergence}
SQL = {"op13_divergence": DIVERGENCE_SQL}
