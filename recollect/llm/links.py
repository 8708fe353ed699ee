"""Links between sets: candidate lists by shared keys, signature bounds, prefix-tree verification, components.

A node is a distinct set (its 64-bit identity), so copies are one node. Nodes that share a key are candidates. In a first
round each node is tried with the smallest node of like size in its keys' lists. A second round tries another node of each
list with those of other components. The links make stars, a node and those linked to it. In the last round the stars that
share a key but stand in different components are compared by what bounds all their pairs (the symmetric difference is a
metric, and a star's is small), and the pairs of those that stay are tried too; so no link is lost, though neither copies
nor near copies are expanded into all pairs. Nodes without a star, of which such pairs may be many, go on as heaps (what
their pairs connect) instead of pairs, and a heap tells only links that join components. Pairs are dropped by bounds (sizes,
parity signatures) that no pair above the similarity fails; the rest are verified by walking prefix trees of the whole sets,
heaps by counting what their sets share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bucket, forget, mix, pieces, release, saved, small, unpack_rows, unpacked

#: Jaccard similarity of a link, as a fraction.
SIMILAR = (3, 4)
KEYS_PER_BUCKET = 300_000
SPLIT = 256
STARS_PER_BUCKET = 10_000
CONTRACT_ROWS = 2_000_000
#: A node joins a star whose center differs from it in at most 1 / TIGHT of its size.
TIGHT = 14
#: Pairs of nodes without a star that a task holds before it cuts them down to what they connect.
HELD_PAIRS = 1_000_000


def n_buckets(keys: int) -> int:
    return int(max(64, keys // KEYS_PER_BUCKET))


def lists_of(keyed: DataFrame) -> DataFrame:
    """Packed star pairs (a, b) of like sizes and packed lists of two nodes or more (k, v, n), from rows (node, n, keys)."""
    total = keyed.agg(F.sum(F.octet_length("keys"))).first()[0] or 0
    buckets = n_buckets(total // 8)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            nodes, sizes = batch.column("node").to_numpy(), batch.column("n").to_numpy()
            _, one = np.unique(nodes, return_index=True)
            blobs = batch.column("keys").to_pylist()
            one = [i for i in one if blobs[i]]
            if not one:
                continue
            parts = [np.frombuffer(blobs[i], np.int64) for i in one]
            long = [len(p) for p in parts]
            k, v, n = np.concatenate(parts), np.repeat(nodes[one], long), np.repeat(sizes[one], long)
            rows = list(by_bucket(((k.view(np.uint64) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32), [k, v, n]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[1][c] for r in rows], pa.binary()) for c in range(3))], names=["bucket", "k", "v", "n"])

    def meet(group: pa.Table) -> pa.Table:
        release()
        k, v, n = unpacked(group, "k"), unpacked(group, "v"), unpacked(group, "n", np.int32)
        order = np.lexsort((v, k))
        k, v, n = k[order], v[order], n[order]
        fresh = np.concatenate(([True], (k[1:] != k[:-1]) | (v[1:] != v[:-1])))
        k, v, n = k[fresh], v[fresh], n[fresh]
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        size = np.diff(np.concatenate((first, [len(k)])))
        long = np.repeat(size >= 2, size)
        k, v, n = k[long], v[long], n[long]
        # each list's nodes meet the smallest node of their class of sizes, inside which all sizes allow a link
        kind = (np.log(np.maximum(n, 1)) / np.log(SIMILAR[1] / SIMILAR[0])).astype(np.int64)
        order = np.lexsort((v, kind, k))
        a, b = _stars(k[order], kind[order], v[order])
        return pa.table({name: pa.array([c.tobytes()], pa.binary()) for name, c in (("a", a), ("b", b), ("k", k), ("v", v), ("n", n))})

    dealt = keyed.select("node", "n", "keys").mapInArrow(deal, "bucket int, k binary, v binary, n binary")
    return saved(dealt.groupBy("bucket").applyInArrow(meet, "a binary, b binary, k binary, v binary, n binary"))


def _stars(k: np.ndarray, kind: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of the first v of each run of equal (k, kind) and the others of the run."""
    if not len(k):
        return k, k
    head = np.concatenate(([True], (k[1:] != k[:-1]) | (kind[1:] != kind[:-1])))
    a, b = v[np.flatnonzero(head)[np.cumsum(head) - 1]], v
    a, b = a[~head], b[~head]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    fresh = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(a)]
    return a[fresh], b[fresh]


def differing(x: str, y: str) -> Column:
    """Bits that differ in two signatures, of equal length or one of twice the other's."""
    xor = lambda a, b: a.bitwiseXOR(b)
    half = lambda c: (F.size(c) / 2).cast("int")
    folded = lambda c: F.zip_with(F.slice(c, 1, half(c)), F.slice(c, half(c) + 1, half(c)), xor)
    fit = lambda c, d: F.when(F.size(c) > F.size(d), folded(c)).otherwise(c)
    a, b = fit(F.col(x), F.col(y)), fit(F.col(y), F.col(x))
    bits = F.aggregate(F.zip_with(a, b, lambda c, d: F.bit_count(c.bitwiseXOR(d))), F.lit(0), lambda t, c: t + c)
    return F.when(F.size(a) == F.size(b), bits).otherwise(F.lit(0))  # lengths further apart tell nothing


def folded_to(sig: str, words: int) -> Column:
    """A signature at the length of so many words, a power of two no longer than its own."""
    runs = F.sequence(F.lit(0), F.expr(f"size({sig}) div {words} - 1").cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda i: F.aggregate(runs, F.lit(0).cast("long"), lambda t, c: t.bitwiseXOR(F.get(F.col(sig), i + c * words))))


def possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that sizes and signatures allow; nodes: (node, n, sig)."""
    p, q = SIMILAR
    left, right = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}")) for x in "ab")
    fit = pairs.join(left, "a").join(right, "b").filter(q * F.least("na", "nb") >= p * F.greatest("na", "nb"))
    total = F.col("na") + F.col("nb")
    most = total - 2 * F.ceil(F.lit(p) * total / F.lit(p + q))
    return fit.filter(differing("sa", "sb") <= most).select(*pairs.columns)


def tree_join(x: np.ndarray, others: list[np.ndarray]) -> list[int]:
    """The overlaps of the sets that have the similarity with x, 0 of the rest; sets are sorted arrays of one global order.

    The others, sorted, form a prefix tree: what two neighbours share as prefix is counted once, and a subtree is left
    as soon as the overlap so far and the remaining lengths can't reach the overlap that the sizes ask for."""
    p, q = SIMILAR
    order = sorted(range(len(others)), key=lambda i: others[i].astype(">u8").tobytes())
    out = [0] * len(others)
    before, counted = np.zeros(0, np.uint64), np.zeros(1, np.int64)  # the path, and overlaps by depth as far as counted
    for i in order:
        y = others[i]
        need = -(-p * (len(x) + len(y)) // (p + q))
        m = min(len(before), len(y), len(counted) - 1)
        differs = np.flatnonzero(before[:m] != y[:m])
        shared = int(differs[0]) if len(differs) else m
        counts = [counted[: shared + 1]]
        depth, overlap = shared, int(counted[shared])
        alive = True
        while depth < len(y):
            rest = len(x) - int(np.searchsorted(x, y[depth - 1], "right")) if depth else len(x)
            if overlap + min(rest, len(y) - depth) < need:
                alive = False
                break
            part = y[depth : depth + 64]
            at = np.searchsorted(x, part)
            more = overlap + np.cumsum(x[np.minimum(at, len(x) - 1)] == part)
            counts.append(more)
            depth, overlap = depth + len(part), int(more[-1])
        before, counted = y, np.concatenate(counts)
        out[i] = overlap if alive and overlap >= need else 0
    return out


def verified(pairs: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The pairs (a, b, d) that have the similarity, by their whole sets, and the size of their symmetric difference. A node with many partners is split over groups of about SPLIT.

    The sets go straight from the documents to the groups that need them: a group holds one node and its partners."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("parts"))
    sent = pairs.join(parts, "a").select(F.col("b").alias("node"), "a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    own = parts.select(F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def check(group: pa.Table) -> pa.Table:
        a = group.column("a")[0].as_py()
        nodes = group.column("node").to_numpy()
        sets = [np.frombuffer(t, np.uint64) for t in group.column("toks").to_pylist()]
        center = next((s for n, s in zip(nodes, sets, strict=True) if n == a), None)
        others = [i for i, n in enumerate(nodes) if n != a]
        overlaps = tree_join(center, [sets[i] for i in others]) if center is not None else []
        links = [(nodes[i], len(center) + len(sets[i]) - 2 * k) for i, k in zip(others, overlaps, strict=False) if k]
        return pa.table({"a": pa.array([a] * len(links), pa.int64()), "b": pa.array([x[0] for x in links], pa.int64()), "d": pa.array([x[1] for x in links], pa.int64())})

    return saved(fetch(sent.union(own)).groupBy("a", "part").applyInArrow(check, "a long, b long, d long"))


def local_roots(a: np.ndarray, b: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, root, rank): each node of the edges at hand with the least ranked node that they reach; ranks are hashes by seed."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    rank = mix(nodes.view(np.uint64) ^ mix(np.array([seed], np.uint64))).view(np.int64)
    order = np.argsort(rank, kind="stable")
    place = np.empty(len(nodes), np.int64)
    place[order] = np.arange(len(nodes))
    x, y = place[at[: len(a)]], place[at[len(a) :]]
    parent = np.arange(len(nodes))
    while True:
        px, py = parent[x], parent[y]
        apart = px != py
        if not apart.any():
            break
        x, y, px, py = x[apart], y[apart], px[apart], py[apart]
        np.minimum.at(parent, np.maximum(px, py), np.minimum(px, py))
        while (parent != (up := parent[parent])).any():
            parent = up
    root = order[parent[place]]
    return nodes, nodes[root], rank[root]


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of each node with an edge (a, b); comp is one of the nodes that it reaches, the same for all of them.

    Each level joins up the edges of every partition by themselves; nodes with several roots then tell which roots are
    one, and these few are the next level's edges. Ranks are drawn anew, so paths shrink by a share at each level."""
    levels = []
    while True:
        seed = len(levels)

        def contract(batches: Iterator[pa.RecordBatch], seed: int = seed) -> Iterator[pa.RecordBatch]:
            held, size = [], 0

            def told() -> pa.RecordBatch:
                found = local_roots(*(np.concatenate([h[c] for h in held]) for c in range(2)), seed)
                return pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["node", "root", "rank"])

            for batch in batches:
                held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
                size += batch.num_rows
                if size > CONTRACT_ROWS:
                    yield told()
                    held, size = [], 0
            if size:
                yield told()

        pairs = saved(edges.select("a", "b").mapInArrow(contract, "node long, root long, rank long"))
        best = saved(pairs.groupBy("node").agg(F.min(F.struct("rank", "root")).alias("m"), F.count("*").alias("n")).select("node", F.col("m.root").alias("best"), "n"))
        levels.append(best)
        several = best.filter("n > 1").select("node", "best")
        again = saved(pairs.join(several, "node").filter("root <> best").select(F.col("root").alias("a"), F.col("best").alias("b")).distinct())
        forget(pairs, *([edges] if seed else []))
        edges = again
        if edges.isEmpty():
            break
    labels = levels.pop().select("node", F.col("best").alias("comp"))
    while levels:
        top = labels.select(F.col("node").alias("best"), F.col("comp").alias("top"))
        labels = levels.pop().join(top, "best", "left").select("node", F.coalesce("top", "best").alias("comp"))
    return saved(labels)


def link(keyed: DataFrame, fetch: Callable[[DataFrame], DataFrame], heaped: bool = False) -> DataFrame:
    """(node, comp) of nodes that have a link.

    keyed: rows (node, n, sig array<long>, keys packed), a node may repeat; fetch: rows (node, a, part) to (a, part, node, toks packed).
    heaped: sets are short, so nodes without a star go on as heaps; long ones are worth the second look at whole signatures that only pairs get."""
    lists = lists_of(keyed)
    listed = saved(unpack_rows(lists, k=np.int64, v=np.int64, n=np.int32))
    nodes = saved(keyed.groupBy("node").agg(F.first("n").alias("n"), F.first("sig").alias("sig")).join(listed.select(F.col("v").alias("node")).distinct(), "node", "left_semi"))
    first = saved(possible(unpack_rows(lists, a=np.int64, b=np.int64).distinct(), nodes))
    forget(lists)
    edges = verified(first, fetch)
    labels = components(edges)
    fresh = saved(scattered(listed, nodes, edges, labels).join(first, ["a", "b"], "left_anti"))
    if not fresh.isEmpty():
        more = verified(fresh, fetch)
        first, edges = first.union(fresh), edges.union(more)
        if not more.isEmpty():
            labels = joined(labels, more)
    pairs, heaps = across(listed, nodes, edges, labels, heaped)
    fresh = saved(pairs.join(first, ["a", "b"], "left_anti"))
    found = [] if fresh.isEmpty() else [verified(fresh, fetch)]
    if not heaps.isEmpty():
        found.append(joining(heaps, labels, fetch))
    for more in found:
        if not more.isEmpty():
            labels = joined(labels, more)
    return labels


def joined(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Labels (node, comp) after further edges: only the components that these touch are joined up."""
    a, b = (labels.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab")
    ends = more.join(a, "a", "left").join(b, "b", "left")
    between = saved(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).distinct())
    tops = components(between).select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    old = labels.join(tops, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
    fresh = more.select(F.col("a").alias("node")).union(more.select(F.col("b").alias("node"))).distinct().join(labels, "node", "left_anti")
    fresh = fresh.join(tops, fresh["node"] == tops["comp"]).select("node", F.col("top").alias("comp"))
    return saved(old.union(fresh))


def scattered(listed: DataFrame, nodes: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of a node of each list, another one for each key by hash, with those of other components."""
    at = saved(listed.join(labels.withColumnRenamed("node", "v"), "v", "left").select("k", "v", "n", F.coalesce("comp", "v").alias("comp")))
    center = at.groupBy("k").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.struct(F.xxhash64("k", "v").alias("h"), "v", "n", "comp")).alias("c")).filter("lo < hi")
    pairs = at.join(center.select("k", F.col("c.v").alias("cv"), F.col("c.n").alias("cn"), F.col("c.comp").alias("cc")), "k")
    p, q = SIMILAR
    pairs = pairs.filter((F.col("comp") != F.col("cc")) & (q * F.least("n", "cn") >= p * F.greatest("n", "cn")))
    return possible(pairs.select(F.least("v", "cv").alias("a"), F.greatest("v", "cv").alias("b")).distinct(), nodes)


def _gap(n):
    """The symmetric difference that a link between sets whose sizes sum to n allows."""
    p, q = SIMILAR
    return n * (q - p) // (q + p)


def _folded(sigs: list[list[int]]) -> np.ndarray:
    """Signatures of one length, the shortest there is: longer ones are folded, which keeps the bound."""
    short = min(len(x) for x in sigs)
    return np.stack([np.bitwise_xor.reduce(np.array(x, np.int64).reshape(-1, short), axis=0) for x in sigs]).view(np.uint64)


def _apart(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    return np.bitwise_count(one[None, :] ^ many).sum(1, dtype=np.int64)


def joining(heaps: DataFrame, labels: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (a, b) of heaps (heap, node), no more than join up the components of a heap's nodes."""
    p, q = SIMILAR
    comps = heaps.join(labels, "node", "left").select(F.col("heap").alias("a"), "node", F.coalesce("comp", "node").alias("comp"))
    sets = fetch(heaps.select("node", F.col("heap").alias("a"), F.lit(0).alias("part")))

    def check(group: pa.Table) -> pa.Table:
        release()
        nodes, comp = group.column("node").to_numpy(), group.column("comp").to_numpy().copy()
        sets = [np.frombuffer(t, np.uint64) for t in group.column("toks").to_pylist()]
        n = np.array([len(x) for x in sets])
        at = np.cumsum(n) - n
        _, token, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), n)[np.argsort(token, kind="stable")]  # the sets that have a token, token by token
        first = np.cumsum(often) - often
        links = []
        for i in range(len(sets) - 1):
            own = token[at[i] : at[i] + n[i]]
            long = often[own]
            with_it = owner[np.repeat(first[own] - (np.cumsum(long) - long), long) + np.arange(long.sum())]
            shared = np.bincount(with_it, minlength=len(sets))
            for j in np.flatnonzero((shared * (p + q) >= p * (n + n[i])) & (comp != comp[i])):
                if comp[j] != comp[i]:
                    links.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
                    comp[comp == comp[j]] = comp[i]
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    return saved(sets.join(comps, ["a", "node"]).groupBy("a").applyInArrow(check, "a long, b long"))


def across(listed: DataFrame, nodes: DataFrame, edges: DataFrame, labels: DataFrame, heaped: bool = True) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b), a < b, of different components out of stars that share a key, as far as bounds allow them, and heaps.

    Stars, and then the members of near ones, are compared inside their groups; only what the bounds leave is a row. Stars of
    one node are no pairs but heaps (heap, node): those that their pairs connect in a group, so a node is a row once a group."""
    p, q = SIMILAR
    star = edges.groupBy(F.col("b").alias("node")).agg(F.min(F.struct("d", "a")).alias("near"))
    member = nodes.join(star, "node", "left").join(labels, "node", "left")
    close = F.col("near.d") * TIGHT <= F.col("n")  # narrow stars bound more; the others stand alone
    member = saved(member.select("node", "n", "sig", F.when(close, F.col("near.a")).otherwise(F.col("node")).alias("star"), F.when(close, F.col("near.d")).otherwise(0).cast("long").alias("d"), F.coalesce("comp", "node").alias("comp")))
    stars = member.groupBy("star").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.first("comp").alias("comp"), F.max("d").alias("radius"))
    words = nodes.agg(F.min(F.size("sig"))).first()[0] or 1  # the length that groups of many stars come down to
    stars = stars.join(nodes.select(F.col("node").alias("star"), folded_to("sig", words).alias("sig")), "star")
    shared = saved(listed.join(member.select(F.col("node").alias("v"), "star", "comp"), "v").groupBy("k", "star").agg(F.first("comp").alias("comp")))
    # keys of one and the same set of stars tell the same pairs, so one of them is enough
    told = shared.groupBy("k").agg(F.min("comp").alias("c_lo"), F.max("comp").alias("c_hi"), F.count("*").alias("size"), F.bit_xor(F.xxhash64("star")).alias("x"), F.bit_xor(F.xxhash64("star", F.lit(1))).alias("y"))
    mixed = told.filter("c_lo < c_hi").groupBy("size", "x", "y").agg(F.min("k").alias("k")).select("k")
    shared = saved(shared.join(mixed, "k"))
    buckets = int(max(64, shared.count() // STARS_PER_BUCKET))
    shared = shared.groupBy(F.pmod(F.xxhash64("k"), F.lit(buckets)).cast("int").alias("bucket"), "star").agg(F.collect_list("k").alias("ks"))
    shared = shared.join(stars, "star").select("bucket", "star", "ks", "lo", "hi", "comp", "radius", "sig")

    def meet(group: pa.Table) -> pa.Table:
        release()
        ids, comp, lo, hi, radius = (group.column(c).to_numpy().astype(np.int64) for c in ("star", "comp", "lo", "hi", "radius"))
        sig = _folded(group.column("sig").to_pylist())
        lists: dict[int, list[int]] = {}
        for i, ks in enumerate(group.column("ks").to_pylist()):
            for k in ks:
                lists.setdefault(k, []).append(i)
        seen: set[bytes] = set()
        out = [np.zeros((0, 3), np.int64)]
        alone, held = [], 0
        for rows in lists.values():
            at = np.array(rows)
            if (name := at.tobytes()) in seen:
                continue
            seen.add(name)
            for k in range(len(at) - 1):
                i, j = at[k], at[k + 1 :]
                j = j[(comp[j] != comp[i]) & (q * hi[i] >= p * lo[j]) & (q * hi[j] >= p * lo[i])]
                if len(j):
                    far = _apart(sig[i], sig[j])
                    ok = far <= radius[i] + radius[j] + _gap(hi[i] + hi[j])
                    single = ok & (radius[i] + radius[j] == 0) & heaped
                    if single.any():
                        alone.append((np.full(single.sum(), ids[i]), ids[j[single]]))
                        held += len(alone[-1][0])
                    ok &= ~single
                    out.append(np.stack((np.minimum(ids[i], ids[j[ok]]), np.maximum(ids[i], ids[j[ok]]), far[ok]), 1))
                if held > HELD_PAIRS:
                    node, root, _ = local_roots(*(np.concatenate([x[c] for x in alone]) for c in range(2)), 0)
                    alone, held = [(node, root)], 0
            if len(out) > 5000:
                out = [np.unique(np.concatenate(out), axis=0)]
        pairs = np.unique(np.concatenate(out), axis=0)
        heap = node = np.zeros(0, np.int64)
        if alone:
            node, root, _ = local_roots(*(np.concatenate([x[c] for x in alone]) for c in range(2)), 0)
            _, at = np.unique(root, return_inverse=True)
            name = np.zeros(at.max() + 1, np.uint64)
            np.add.at(name, at, mix(node.view(np.uint64)))
            heap = mix(name)[at].view(np.int64)  # by its nodes, so that groups that find the same heap name it alike
        return pa.table({"s": pa.array(np.concatenate((pairs[:, 0], heap))), "t": pa.array(np.concatenate((pairs[:, 1], node))), "apart": pa.array([*pairs[:, 2].tolist(), *[None] * len(node)], pa.int64())})

    met = saved(shared.groupBy("bucket").applyInArrow(meet, "s long, t long, apart long"))  # apart is null where s is a heap of t
    heaps = saved(met.filter("apart is null").select(F.col("s").alias("heap"), F.col("t").alias("node")).distinct())
    near = met.filter("apart is not null").groupBy("s", "t").agg(F.max("apart").alias("apart"))
    one = member.select(F.col("node").alias("m"), F.col("n").alias("m_n"), F.col("star").alias("m_s"), F.col("d").alias("m_d"), F.col("sig").alias("m_sig"))
    near = saved(near)
    reach = member.groupBy(F.col("star").alias("r_star")).agg(F.max("d").alias("r"), F.max("n").alias("r_hi"))
    near = near.join(reach, F.col("t") == F.col("r_star"))
    gap = lambda n: F.floor(n * (q - p) / (q + p))
    left = near.join(one, (F.col("s") == F.col("m_s")) & (F.col("apart") <= F.col("m_d") + F.col("r") + gap(F.col("m_n") + F.col("r_hi")))).select("t", "m", "m_n", "m_sig")
    right = member.select(F.col("star").alias("o_star"), F.col("node").alias("o"), F.col("n").alias("o_n"), F.col("sig").alias("o_sig"))

    def pair(these: pa.Table, those: pa.Table) -> pa.Table:
        out = [np.zeros((0, 2), np.int64)]
        if these.num_rows and those.num_rows:
            sig = _folded(these.column("m_sig").to_pylist() + those.column("o_sig").to_pylist())
            m, m_n, o, o_n = (t.column(c).to_numpy().astype(np.int64) for t, c in ((these, "m"), (these, "m_n"), (those, "o"), (those, "o_n")))
            for i in range(len(m)):
                ok = (q * np.minimum(o_n, m_n[i]) >= p * np.maximum(o_n, m_n[i])) & (_apart(sig[i], sig[len(m) :]) <= _gap(o_n + m_n[i]))
                out.append(np.stack((np.minimum(m[i], o[ok]), np.maximum(m[i], o[ok])), 1))
        pairs = np.unique(np.concatenate(out), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    pairs = left.groupBy("t").cogroup(right.groupBy("o_star")).applyInArrow(pair, "a long, b long").distinct()
    return possible(pairs, nodes), heaps


def row_key(docs: DataFrame) -> Column:
    """What tells a row's text: its id, or the text itself where the id is null."""
    return F.when(docs["doc_id"].isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))


def wanted_in(docs: DataFrame, wanted: DataFrame, where: DataFrame) -> DataFrame:
    """text, lk_wanted of the documents that hold wanted nodes: where has (node, lk), one row a node; joined by a checked broadcast or a shuffle."""
    ids = saved(where.join(wanted, "node").groupBy(F.col("lk").alias("lk_id")).agg(F.collect_list(F.struct("node", "a", "part")).alias("lk_wanted")))
    docs = docs.withColumn("lk", row_key(docs))
    return docs.join(small(ids, 48 + 24 * F.size("lk_wanted")), docs["lk"] == F.col("lk_id")).select("text", "lk_wanted")


def sets_sent(docs: DataFrame, wanted: DataFrame, where: DataFrame, sets_of: Callable[[pa.RecordBatch], Iterator[tuple[int, int, np.ndarray]]]) -> DataFrame:
    """(a, part, node, toks): the wanted sets, out of the documents; sets_of gives (row, node, set) of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            asked: list[dict[int, list]] = []
            for row in batch.column("lk_wanted").to_pylist():
                asked.append({})
                for w in row:
                    asked[-1].setdefault(w["node"], []).append((w["a"], w["part"]))
            # a node may stand in a row several times (equal lines): it is sent once
            got = [(a, part, node, s) for i, node, s in sets_of(batch) for a, part in asked[i].pop(node, ())]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int64()), pa.array([g[3].tobytes() for g in got], pa.binary())], names=["a", "part", "node", "toks"])

    return wanted_in(docs, wanted, where).mapInArrow(run, "a long, part int, node long, toks binary")
