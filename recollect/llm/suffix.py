"""Operator 9: exact removal of repeated byte strings by common-prefix interval trees of enhanced suffix arrays.

Any LEAST-byte string holds an anchor: a GRAM-byte substring whose hash is least among those that start in the string's
first half, chosen by content alone. Equal strings so meet at equal anchors, and every such string through an anchor lies
in its context, the SIDE bytes before and the LEAST bytes from the anchor on. Contexts are dealt by the anchor's hash, so
that the corpus' suffix array falls into independent parts: the contexts of an anchor make an enhanced suffix array (the
suffixes from the anchor, their common prefixes, and the reversed texts before them), and a stack scan of its common
prefixes gives its interval tree.

The trees grow bottom up. Their deepest nodes, contexts that are equal throughout, need no bytes: an array sorted by
fingerprint has a full common prefix between equal neighbours and none between others. They are scanned first inside a
batch and then for each anchor (``deepest``); all their occurrences but the first are removed and the first goes on,
so that a frequent passage never meets in one task. Inner nodes come from the bytes of what went on: inside an
interval, a scan of the left sides tells the groups that share a left extension no byte longer, and a group that lies in
several children can't be extended to the right either (``repeat_groups``). Together these are the maximal repeat groups
of LEAST bytes and more; ``repeats`` returns them with all their occurrences, clipped to the context of their anchor.

An anchor with more than HOT different contexts isn't gathered in one task: its LEAST-byte strings are dealt one by one
and scanned as deepest nodes instead (exact too). Strings are told equal by fingerprints of 128 bits, or byte by byte in
inner nodes.

Defined results: null counts as empty; rows whose doc_id is null, or a text that is no whole number, lose and cause nothing;
rows with equal doc_id are one document for the order, so equal starts in them aren't earlier than each other; an empty
table gives no rows; extra columns pass through ``remove``. A long text is taken slice by slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans as sp
from .common import Rolling, by_bucket, mix, pieces, saved, table, text_bytes, unpacked, whole_id

LEAST, GRAM = 100, 50
SIDE = LEAST - GRAM
HOT = 20_000
SLICE = 4_000_000
COMBINE_BYTES = 6_000_000
BUCKET_BYTES = 6_000_000
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Bytes under other names, so that a second hash weighs them in its own way.
_OTHER = np.random.default_rng(9).permutation(256).astype(np.uint8)


# --- enhanced suffix array of texts at hand --------------------------------------------------------------------------


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of an integer sequence, by prefix doubling."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        second = np.full(n, -1, np.int64)
        second[: n - k] = rank[k:] if k < n else 0
        order = np.lexsort((second, rank))
        a, b = rank[order], second[order]
        new = np.zeros(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        rank = new
        if n < 2 or rank.max() == n - 1:
            return order
        k *= 2


def common_prefixes(s: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Longest common prefix of each suffix in the array with the one before it (first: 0)."""
    n = len(s)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    out, h = np.zeros(n, np.int64), 0
    for i in range(n):
        if r := rank[i]:
            j = order[r - 1]
            while i + h < n and j + h < n and s[i + h] == s[j + h]:
                h += 1
            out[r] = h
            h = max(0, h - 1)
        else:
            h = 0
    return out


def prefix_intervals(lcp: list[int] | np.ndarray, least: int = 1) -> list[tuple[int, int, int]]:
    """(first, last, depth) of the common-prefix interval tree's nodes of depth least or more, by a stack scan."""
    out, stack = [], [(0, 0)]  # (depth, first)
    for i in range(1, len(lcp) + 1):
        depth, first = int(lcp[i]) if i < len(lcp) else -1, i - 1
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            if d >= least and i - 1 > first:
                out.append((first, i - 1, d))
        if not stack or stack[-1][0] < depth:
            stack.append((depth, first))
    return out


def maximal_repeats(texts: list[bytes], least: int = LEAST) -> list[tuple[int, list[tuple[int, int]]]]:
    """(length, occurrences as (text, start)) of the groups of equal strings that no byte to either side extends."""
    parts, owner, start = [], [], []
    for i, t in enumerate(texts):
        parts.append(np.concatenate((np.frombuffer(t, np.uint8).astype(np.int64), [256 + i])))  # ends match nothing
        owner.append(np.full(len(t) + 1, i))
        start.append(np.arange(len(t) + 1))
    if not parts:
        return []
    s, owner, start = np.concatenate(parts), np.concatenate(owner), np.concatenate(start)
    order = suffix_array(s)
    out = []
    for lo, hi, depth in prefix_intervals(common_prefixes(s, order), least):
        at = order[lo : hi + 1]
        left = {int(s[i - 1]) if start[i] else -1 - int(owner[i]) for i in at}
        if len(left) > 1 or min(left) < 0:
            out.append((depth, sorted((int(owner[i]), int(start[i])) for i in at)))
    return out


# --- anchors ---------------------------------------------------------------------------------------------------------


def _slide(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of each run of width values."""
    op, done = (np.minimum if least else np.maximum), 1
    while done * 2 <= width:
        x = op(x[:-done], x[done:])
        done *= 2
    return op(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def anchors(data: np.ndarray, off: np.ndarray, roll: Rolling) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, text, hash) of the anchors of all texts."""
    none = np.zeros(0, np.int64)
    if len(data) < LEAST:
        return none, none, none.astype(np.uint64)
    grams = roll.grams(GRAM)
    low = _slide(grams, SIDE + 1, True)  # of the strings that start at each position
    n = len(data) - LEAST + 1
    low = low[:n].copy()
    # strings that cross the end of a text are none
    for e in off[1:-1]:
        low[max(0, e - LEAST + 1) : e] = 0
    high = _slide(np.concatenate((np.zeros(SIDE, np.uint64), low, np.zeros(SIDE, np.uint64))), SIDE + 1, False)
    p = np.flatnonzero(grams[: len(high)] == high)
    p = p[grams[p] != 0]
    return p, np.searchsorted(off, p, "right") - 1, grams[p]


def sliced(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, start, data, offsets): all texts at once, or a single long one slice by slice with what its anchors need on both sides."""
    if len(off) != 2 or len(data) <= 2 * SLICE:
        yield 0, 0, data, off
        return
    for a in range(0, len(data), SLICE):
        lo, hi = max(0, a - 2 * LEAST), min(len(data), a + SLICE + 3 * LEAST)
        yield a, lo, data[lo:hi], np.array([0, hi - lo])


def substring_hashes(data: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the substrings of a size at ascending starts, with prefix hashes of a slice at a time."""
    out, first = np.zeros(len(start), np.uint64), 0
    while first < len(start):
        a = int(start[first])
        last = int(np.searchsorted(start, a + SLICE))
        part = start[first:last] - a
        out[first:last] = Rolling(data[a : a + SLICE + size]).of(part, part + size)
        first = last
    return out


def fingerprints(data: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """128-bit hashes (two columns) of the substrings of a size at ascending starts."""
    return np.stack((substring_hashes(data, start, size), substring_hashes(_OTHER[data], start, size)), 1)


def deepest(h: np.ndarray, c: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (h, c, doc, pos), and for each in it whether it stands after the first of a deepest node, rows equal to that left out.

    c: 128-bit fingerprints (two columns) of the contexts of anchors h. Equal neighbours share a whole context as their
    common prefix; what different ones share is left to the inner nodes."""
    order = np.lexsort((pos, doc, c[:, 1], c[:, 0], h))
    h, c, doc, pos = h[order], c[order], doc[order], pos[order]
    first = np.arange(len(h))
    same = (h[1:] == h[:-1]) & (c[1:] == c[:-1]).all(1)
    nodes = np.array(prefix_intervals([0, *np.where(same, LEAST, 0).tolist()] if len(h) else [], LEAST), np.int64).reshape(-1, 3)
    size = nodes[:, 1] - nodes[:, 0] + 1
    head = np.repeat(nodes[:, 0], size)
    inside = np.arange(len(head)) - np.repeat(np.cumsum(size) - size, size)
    first[head + inside] = head
    return order, (doc != doc[first]) | (pos != pos[first])


def _span_rows(doc: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> list[tuple[int, list[bytes]]]:
    doc, start, end = sp.merged(doc, start, end)
    return list(by_bucket((mix(doc.view(np.uint64)) % np.uint64(n)).astype(np.int32), [doc, start, end])) if len(doc) else []


_OUT = "kind int, bucket int, a binary, b binary, c binary, d binary"
_NAMES = ["kind", "bucket", "a", "b", "c", "d"]
SPANS, ANCHORS, ASKED, CONTEXTS = 0, 1, 2, 3


def _rows(rows: list[tuple[int, int, list[bytes]]]) -> list[pa.Array]:
    cols = [[r[2][k] if k < len(r[2]) else None for r in rows] for k in range(4)]
    return [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), *(pa.array(c, pa.binary()) for c in cols)]


def _deal(docs: DataFrame, n: int, every: bool = False) -> DataFrame:
    """Anchors dealt by hash; the deepest nodes of a batch are told at once (rows of spans), unless every context is wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def told() -> pa.RecordBatch:
            h, c, doc, pos = (np.concatenate([x[k] for x in held]) for k in range(4))
            order, gone = deepest(h, c, doc, pos)
            h, c, doc, pos = h[order], c[order], doc[order], pos[order]
            gone &= not every
            rows = [(SPANS, b, cols) for b, cols in _span_rows(doc[gone], np.maximum(pos[gone] - SIDE, 0), pos[gone] + LEAST, n)]
            rows += [(ANCHORS, b, cols) for b, cols in by_bucket((h[~gone] % np.uint64(n)).astype(np.int32), [h[~gone], c[~gone], doc[~gone], pos[~gone].astype(np.int32)])]
            return pa.RecordBatch.from_arrays(_rows(rows), names=_NAMES)

        for batch in pieces(batches):
            whole, bounds = text_bytes(batch.column("text"))
            for a, at, data, off in sliced(whole, bounds):
                roll = Rolling(data)
                p, text, h = anchors(data, off, roll)
                if len(data) < len(whole):  # a slice: its own anchors, without those of its margins
                    own = (p + at >= a) & (p + at < a + SLICE)
                    p, text, h = p[own], text[own], h[own]
                if len(p):
                    lo, hi = np.maximum(p - SIDE, off[text]), np.minimum(p + LEAST, off[text + 1])
                    reach = mix((p - lo).astype(np.uint64) * np.uint64(1009) + (hi - p).astype(np.uint64))
                    c = np.stack((roll.of(lo, hi) ^ reach, Rolling(_OTHER[data]).of(lo, hi)), 1)
                    held.append((h, c, batch.column("doc_id").to_numpy()[text], p - off[text] + at))
                size += len(data)
                if size > COMBINE_BYTES and held:
                    yield told()
                    held, size = [], 0
        if held:
            yield told()

    return docs.mapInArrow(run, _OUT)


def _meet(n: int, every: bool = False):
    def run(group: pa.Table) -> pa.Table:
        kinds = group.column("kind").to_numpy()
        rows = [(SPANS, r["bucket"], [r["a"], r["b"], r["c"]]) for r in group.filter(pa.array(kinds == SPANS)).to_pylist()]
        of = group.filter(pa.array(kinds == ANCHORS))
        h, c = unpacked(of, "a", np.uint64), unpacked(of, "b", np.uint64).reshape(-1, 2)
        doc, pos = unpacked(of, "c"), unpacked(of, "d", np.int32).astype(np.int64)
        if len(h):
            order = np.argsort(h)
            s = h[order]
            twice = np.zeros(len(s), bool)
            same = s[1:] == s[:-1]
            twice[1:] |= same
            twice[:-1] |= same
            pick = order[twice]
            h, c, doc, pos = h[pick], c[pick], doc[pick], pos[pick]
            order, gone = deepest(h, c, doc, pos)
            h, c, doc, pos = h[order], c[order], doc[order], pos[order]
            gone &= not every
            rows += [(SPANS, b, cols) for b, cols in _span_rows(doc[gone], np.maximum(pos[gone] - SIDE, 0), pos[gone] + LEAST, n)]
            if len(h):
                # the first of each context, where an anchor has several
                first = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1]).any(1))) | every
                h, doc, pos = h[first], doc[first], pos[first]
                start = np.concatenate(([True], h[1:] != h[:-1]))
                count = np.diff(np.concatenate((np.flatnonzero(start), [len(h)])))[np.cumsum(start) - 1]
                several = count > 1
                doc, pos, count = doc[several], pos[several], count[several]
                if len(doc):
                    flagged = np.where(count > HOT, -1 - pos, pos).astype(np.int32)
                    rows += [(ASKED, b, cols) for b, cols in by_bucket((mix(doc.view(np.uint64)) % np.uint64(n)).astype(np.int32), [doc, flagged])]
        return pa.Table.from_arrays(_rows(rows), names=_NAMES)

    return run


def _asked(met: DataFrame) -> DataFrame:
    """(sp_id, sp_spans): each document's packed positions of anchors whose contexts are asked for; those of hot anchors are -1 - position."""

    def run(group: pa.Table) -> pa.Table:
        doc, p = unpacked(group, "a"), unpacked(group, "b", np.int32)
        order = np.lexsort((p, doc))
        doc, p = doc[order], p[order]
        ids, first = np.unique(doc, return_index=True)
        return pa.table({"sp_id": pa.array(ids, pa.int64()), "sp_spans": pa.array([p[i:j].tobytes() for i, j in zip(first, [*first[1:], len(doc)], strict=True)], pa.binary())})

    return met.filter(F.col("kind") == ASKED).groupBy("bucket").applyInArrow(run, "sp_id long, sp_spans binary")


def _contexts(docs: DataFrame, n: int, every: bool = False) -> DataFrame:
    """The asked contexts dealt by anchor; of hot anchors the strings through them, dealt by their fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, off = text_bytes(batch.column("text"))
            wide = np.concatenate((np.zeros(SIDE, np.uint8), data, np.zeros(LEAST, np.uint8)))
            h, doc, pos, left, right, bytes_ = [], [], [], [], [], []
            wh, wd, wp = [], [], []
            ids = batch.column("doc_id").to_numpy()
            for i, packed in enumerate(batch.column("sp_spans").to_pylist()):
                p = np.frombuffer(packed, np.int32).astype(np.int64)
                hot, size = p < 0, off[i + 1] - off[i]
                if hot.any():
                    s = np.unique((-1 - p[hot][:, None] - np.arange(SIDE + 1)[None, :]).ravel())
                    s = s[(s >= 0) & (s + LEAST <= size)]
                    wh.append(fingerprints(data[off[i] : off[i + 1]], s, LEAST))
                    wd.append(np.full(len(s), ids[i]))
                    wp.append(s)
                p = p[~hot]
                h.append(substring_hashes(data[off[i] : off[i + 1]], p, GRAM).view(np.int64))
                doc.append(np.full(len(p), ids[i]))
                pos.append(p)
                left.append(np.minimum(p, SIDE).astype(np.uint8))
                right.append(np.minimum(size - p, LEAST).astype(np.uint8))
                bytes_.append(np.lib.stride_tricks.sliding_window_view(wide, SIDE + LEAST)[off[i] + p])
            rows = []
            if h and len(all_h := np.concatenate(h)):
                lr = np.stack((np.concatenate(left), np.concatenate(right)), 1)
                block = np.concatenate((lr, np.concatenate(bytes_)), 1)
                rows += [(CONTEXTS, b, cols) for b, cols in by_bucket((mix(all_h.view(np.uint64)) % np.uint64(n)).astype(np.int32), [all_h, np.concatenate(doc), np.concatenate(pos), block])]
            if wh:
                k, d, s = np.concatenate(wh), np.concatenate(wd), np.concatenate(wp)
                order, gone = deepest(k[:, 0], k, d, s)
                k, d, s = k[order], d[order], s[order]
                gone &= not every
                rows += [(SPANS, b, cols) for b, cols in _span_rows(d[gone], s[gone], s[gone] + LEAST, n)]
                rows += [(ANCHORS, b, cols) for b, cols in by_bucket((k[~gone, 0] % np.uint64(n)).astype(np.int32), [k[~gone], d[~gone], s[~gone]])]
            yield pa.RecordBatch.from_arrays(_rows(rows), names=_NAMES)

    return docs.mapInArrow(run, _OUT)


def repeat_groups(h: np.ndarray, block: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(left, right, members): the maximal repeat groups of LEAST bytes and more through anchors h; members are row numbers.

    block: the bytes there are before (at most SIDE) and from the anchor on (at most LEAST), then the SIDE bytes before
    and the LEAST bytes from it on. A group's strings reach left bytes before the anchor and right bytes from it on."""
    n = len(h)
    have_left, have_right = block[:, 0].astype(np.int64), block[:, 1].astype(np.int64)
    before, after = block[:, 2 : 2 + SIDE][:, ::-1], block[:, 2 + SIDE :]
    key = np.ascontiguousarray(h.astype(">i8")).view(np.uint8).reshape(n, 8)

    def array_of(text: np.ndarray, have: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix array, by anchor, and each suffix's common prefix with the one before it (other anchor: -1)."""
        rows = np.ascontiguousarray(np.concatenate((key, text, (have + 1).astype(np.uint8)[:, None]), 1))
        by = np.argsort(rows.view(f"S{rows.shape[1]}").ravel(), kind="stable")
        differ = text[by][1:] != text[by][:-1]
        lcp = np.where(differ.any(1), differ.argmax(1), text.shape[1])
        lcp = np.minimum(lcp, np.minimum(have[by][1:], have[by][:-1]))
        return by, np.concatenate(([-1], np.where(h[by][1:] == h[by][:-1], lcp, -1)))

    right, lcp_right = array_of(after, have_right)
    left, lcp_left = array_of(before, have_left)
    rank_left = np.empty(n, np.int64)
    rank_left[left] = np.arange(n)
    first = np.flatnonzero(lcp_right < 0)
    for s, e in zip(first.tolist(), [*first[1:].tolist(), n], strict=True):
        if e - s < 2:
            continue
        for i, j, r in prefix_intervals([0, *lcp_right[s + 1 : e].tolist()], SIDE):
            ranks = np.sort(rank_left[right[s + i : s + j + 1]])
            # the least common extension between neighbours in the order of the left sides
            shared = np.minimum.reduceat(lcp_left[: ranks[-1] + 1], ranks[:-1] + 1)
            child = {int(m): c for m, c in zip(right[s + i : s + j + 1], np.cumsum(np.concatenate(([0], lcp_right[s + i + 1 : s + j + 1] == r))), strict=True)}
            for a, b, l in prefix_intervals([0, *shared.tolist()], LEAST - r):
                members = left[ranks[a : b + 1]]
                if len({child[int(m)] for m in members}) > 1:  # else a deeper interval has the same group
                    yield l, r, members


def recurring(h: np.ndarray, doc: np.ndarray, pos: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (doc, start, end) of all occurrences of the maximal repeat groups but the first of each."""
    order = np.lexsort((pos, doc))
    h, doc, pos, block = h[order], doc[order], pos[order], block[order]
    at, far, near = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for l, r, members in repeat_groups(h, block):
        head = members.min()
        late = members[(doc[members] != doc[head]) | (pos[members] != pos[head])]
        at.append(late)
        far.append(np.full(len(late), l))
        near.append(np.full(len(late), r))
    at, far, near = (np.concatenate(x) for x in (at, far, near))
    return doc[at], pos[at] - far, pos[at] + near


def _resolve(n: int):
    def run(group: pa.Table) -> pa.Table:
        kinds = group.column("kind").to_numpy()
        rows = [(SPANS, r["bucket"], [r["a"], r["b"], r["c"]]) for r in group.filter(pa.array(kinds == SPANS)).to_pylist()]
        of = group.filter(pa.array(kinds == CONTEXTS))
        h = unpacked(of, "a")
        if len(h):
            block = unpacked(of, "d", np.uint8).reshape(len(h), -1)
            rows += [(SPANS, b, cols) for b, cols in _span_rows(*recurring(h, unpacked(of, "b"), unpacked(of, "c"), block), n)]
        of = group.filter(pa.array(kinds == ANCHORS))
        k, d, s = unpacked(of, "a", np.uint64).reshape(-1, 2), unpacked(of, "b"), unpacked(of, "c")
        if len(k):
            order, gone = deepest(k[:, 0], k, d, s)
            rows += [(SPANS, b, cols) for b, cols in _span_rows(d[order][gone], s[order][gone], s[order][gone] + LEAST, n)]
        return pa.Table.from_arrays(_rows(rows), names=_NAMES)

    return run


def _groups(group: pa.Table) -> pa.Table:
    """Occurrences of the maximal repeat groups of a bucket."""
    kinds = group.column("kind").to_numpy()
    of = group.filter(pa.array(kinds == CONTEXTS))
    h, doc, pos = (unpacked(of, c) for c in "abc")
    out = [np.zeros((0, 4), np.int64)]
    for l, r, members in repeat_groups(h, unpacked(of, "d", np.uint8).reshape(len(h), -1)) if len(h) else ():
        same = np.full(len(members), int(h[members[0]]) ^ (l << 8) ^ r ^ int(members.min()) << 20)
        out.append(np.stack((same, np.full(len(members), l + r), doc[members], pos[members] - l), 1))
    of = group.filter(pa.array(kinds == ANCHORS))
    k, d, s = unpacked(of, "a").reshape(-1, 2), unpacked(of, "b"), unpacked(of, "c")
    if len(k):
        _, where, count = np.unique(k, axis=0, return_inverse=True, return_counts=True)
        twice = count[where.ravel()] > 1
        out.append(np.stack((k[twice, 0], np.full(twice.sum(), LEAST), d[twice], s[twice]), 1))
    rows = np.concatenate(out)
    return pa.table({name: pa.array(rows[:, c]) for c, name in enumerate(("repeat", "length", "doc_id", "start"))})


def _met(docs: DataFrame, every: bool) -> tuple[DataFrame, DataFrame, int]:
    """What the anchors tell, the contexts that are asked for, and the number of buckets."""
    docs = docs.select(whole_id(docs).alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = int(max(64, total // BUCKET_BYTES))
    met = saved(_deal(docs, n, every).groupBy("bucket").applyInArrow(_meet(n, every), _OUT))
    asked = sp.with_spans(docs, _asked(met)).filter("sp_spans is not null")
    return met, _contexts(asked, n, every), n


def repeats(docs: DataFrame) -> DataFrame:
    """repeat, length, doc_id, start (bytes): the maximal repeat groups of LEAST bytes and more, with all occurrences.

    A group is told by the anchor that it goes through and reaches at most SIDE bytes before and LEAST bytes from it on;
    longer repeats show as groups of each of their anchors. Groups of hot anchors are those of single LEAST-byte strings."""
    contexts = _met(docs, True)[1]
    return contexts.groupBy("bucket").applyInArrow(_groups, "repeat long, length long, doc_id long, start long")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(sp_id, sp_spans): merged byte spans that LEAST-byte strings cover which also start earlier."""
    met, contexts, n = _met(docs, False)
    span = lambda df: df.filter(F.col("kind") == SPANS).select("bucket", F.col("a").alias("doc"), F.col("b").alias("start"), F.col("c").alias("end"))
    solved = contexts.groupBy("bucket").applyInArrow(_resolve(n), _OUT)
    return sp.per_document(span(met).union(span(solved)))


def remove(docs: DataFrame) -> DataFrame:
    """The documents with their texts less the repeated bytes."""
    return sp.removed(docs, repeated_spans(docs))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sp.digests(sp.with_spans(docs, repeated_spans(docs)))


QUERIES = {"op9_suffix_dedup": op9_suffix_dedup}
SQL: dict[str, str] = {}
