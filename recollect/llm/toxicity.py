"""Operator 5: toxic spans by a linear-chain conditional random field.

Token labels come from the labelled documents: a token is labelled toxic in a toxic document if its word or one of its
affixes is tied to toxic documents beyond chance (G test). The chain's emission weights and label-pair potentials are
fitted on segments of these tokens by gradient ascent on the conditional likelihood; forward-backward marginals give token
probabilities, whose soft maximum, calibrated on the learning documents, is the document's score; spans are the runs of
tokens with a marginal of 1/2 or more.

Bounds of learning, documented parameters: SAMPLE labelled rows, texts of at most SAMPLE_BYTES, SEGMENTS segments; the
model's size is bounded by those. Scoring reads every text whole; the chain of a text over LONG characters is cut between
words about every LONG of them, so that its memory is bounded. Defined results: null or wordless text gets the score of a
text without evidence; repeated rows repeat results; without labels of both kinds every score is 0; an empty table gives no
rows; a null doc_id learns nothing and is scored; extra columns pass through ``score``, but for ones named like its own
(toxic_score and toxic_spans), which it replaces.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, table, without
from .labelled import fitted, fold, sample

SAMPLE, SAMPLE_BYTES = 4000, 6_000
SEGMENTS, SEGMENT = 6_000, 48
G_LEAST, SHARP = 25.0, 2.0
THRESHOLD = 0.3
CACHE = 100_000
LONG = 1_000_000
_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    """Lower-case words of a text; where lower case has other offsets, the words are those of the text itself."""
    lowered = text.lower()
    return _WORD.findall(lowered) if len(lowered) == len(text) else [w.lower() for w in _WORD.findall(text)]


def stretches(text: str) -> list[tuple[int, str]]:
    """(start, part) of a text, cut between words about every LONG characters."""
    out, at = [], 0
    while len(text) - at > LONG:
        gap = re.compile(r"\W").search(text, at + LONG)
        end = gap.end() if gap else len(text)
        out.append((at, text[at:end]))
        at = end
    return [*out, (at, text[at:])] if at < len(text) else out


def features(word: str) -> list[str]:
    """The word, its first four and five letters, and its last three; a part that is the whole word isn't listed again."""
    n = len(word)
    return ["w" + word, *(["4" + word[:4]] if n > 4 else ()), *(["5" + word[:5]] if n > 5 else ()), *(["-" + word[-3:]] if n > 3 else ())]


class Scores(dict):
    """Emission score of each word, worked out when first met."""

    def __init__(self, weights: dict[str, float], bias: float):
        super().__init__()
        part = lambda kind: {f[1:]: v for f, v in weights.items() if f[0] == kind}.get
        self.whole, self.four, self.five, self.last, self.bias = part("w"), part("4"), part("5"), part("-"), bias

    def __missing__(self, word: str) -> float:
        if len(self) > CACHE:
            self.clear()
        n = len(word)
        value = self.bias + self.whole(word, 0.0)
        if n > 3:
            value += self.last(word[-3:], 0.0)
            if n > 4:
                value += self.four(word[:4], 0.0)
                if n > 5:
                    value += self.five(word[:5], 0.0)
        self[word] = value
        return value


def messages(emissions: list[np.ndarray], trans: np.ndarray) -> list[np.ndarray]:
    """Logit of each token's marginal, by forward and backward log-ratios."""
    forward, back = passes(emissions, trans)
    return [f + b for f, b in zip(forward, back, strict=True)]


def passes(emissions: list[np.ndarray], trans: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Forward and backward log-ratios of each token, over all sequences side by side; trans: log-potentials of label pairs, [from, to]."""
    lengths = np.array([len(e) for e in emissions])
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths[order[0]]) if len(order) else 0
    if not longest:
        return [e.copy() for e in emissions], [e.copy() for e in emissions]
    live = np.searchsorted(-lengths[order], -np.arange(longest), "left")  # sequences longer than t
    starts = np.concatenate(([0], np.cumsum(live)))
    flat = np.empty(starts[-1])
    place = [starts[: lengths[k]] + r for r, k in enumerate(order)]
    for p, k in zip(place, order, strict=True):
        flat[p] = emissions[k]
    t = np.exp(trans)
    forward, back = np.empty_like(flat), np.zeros_like(flat)
    forward[: live[0]] = flat[: live[0]]
    for i in range(1, longest):
        n, a = live[i], starts[i]
        x = np.exp(np.minimum(forward[starts[i - 1] : starts[i - 1] + n], 500))
        forward[a : a + n] = flat[a : a + n] + np.log((t[0, 1] + t[1, 1] * x) / (t[0, 0] + t[1, 0] * x))
    for i in range(longest - 2, -1, -1):
        n, a = live[i + 1], starts[i + 1]
        x = np.exp(np.minimum(flat[a : a + n] + back[a : a + n], 500))
        back[starts[i] : starts[i] + n] = np.log((t[1, 0] + t[1, 1] * x) / (t[0, 0] + t[0, 1] * x))
    out: list[list[np.ndarray]] = [[np.zeros(0)] * len(emissions) for _ in range(2)]
    for p, k in zip(place, order, strict=True):
        out[0][k], out[1][k] = forward[p], back[p]
    return out[0], out[1]


def pair_marginals(forward: np.ndarray, after: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Probability of each label pair, [from, to, place]: forward ratios of the first tokens, emission and backward ratios of the second."""
    u, v = np.stack((np.zeros_like(forward), forward)), np.stack((np.zeros_like(after), after))
    x = u[:, None, :] + trans[:, :, None] + v[None, :, :]
    x = np.exp(x - x.max((0, 1)))
    return x / x.sum((0, 1))


def evidence(logits: np.ndarray) -> float:
    """Soft maximum of the tokens' marginal logits: near the largest, raised by further ones of its size; of parts' own soft maxima, that of the whole."""
    if not len(logits):
        return -30.0
    top = logits.max()
    return float(top + np.log(np.exp(SHARP * (logits - top)).sum()) / SHARP)


class Model:
    def __init__(self, weights: dict[str, float], bias: float, trans: np.ndarray, scale: tuple[float, float]):
        self.weights, self.bias, self.trans, self.scale = weights, bias, trans, scale

    def probability(self, e: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale[0] * e + self.scale[1], -500, 500))))


def numbered(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The words, the texts' words by number one after another, and the texts' offsets."""
    number: dict[str, int] = {}
    parts = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int32) for t in texts]
    return list(number), np.concatenate([np.zeros(0, np.int32), *parts]), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)


def token_labels(listed: list[list[str]], flat: np.ndarray, off: np.ndarray, y: np.ndarray) -> set[str]:
    """Features tied to toxic documents: G at least G_LEAST and a much higher rate there; listed: the features of each word.

    A word counts once for each word before it, so that copies of a document don't count again."""
    before = np.concatenate(([len(listed)], flat[:-1])).astype(np.int64)
    before[off[:-1][np.diff(off) > 0]] = len(listed)
    label = np.repeat(y > 0, np.diff(off))
    counts = []
    for kind in (False, True):
        pairs = np.unique(before[label == kind] * (len(listed) + 1) + flat[label == kind])
        of, total = np.bincount(pairs % (len(listed) + 1), minlength=len(listed)), Counter()
        for w in np.flatnonzero(of):
            for f in listed[w]:
                total[f] += int(of[w])
        counts.append((max(1, len(pairs)), total))
    (n0, without), (n1, with_) = counts
    out = set()
    for f, a in with_.items():
        b = without.get(f, 0)
        if a < 5 or a / n1 < 8 * (b + 0.5) / n0:
            continue
        rate = (a + b) / (n1 + n0)
        g = 2 * (a * np.log(a / (n1 * rate)) + (b * np.log(b / (n0 * rate)) if b else 0))
        if g >= G_LEAST:
            out.add(f)
    return out


def fit(texts: list[str], y: np.ndarray) -> Model | None:
    """None if there aren't labels of both kinds, or no words."""
    vocabulary, tokens, off = numbered(texts)
    if not len(tokens) or y.min() == y.max():
        return None
    parts = [features(w) for w in vocabulary]
    tied = token_labels(parts, tokens, off, y)
    toxic_word = np.array([not tied.isdisjoint(f) for f in parts])
    marks = toxic_word[tokens] & np.repeat(y > 0, np.diff(off))
    rng = np.random.default_rng(3)
    with_, neutral = [], []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        for i in range(a, b, SEGMENT):
            (with_ if marks[i : min(i + SEGMENT, b)].any() else neutral).append((i, min(i + SEGMENT, b)))
    if len(neutral) > SEGMENTS - min(len(with_), SEGMENTS // 2):
        neutral = [neutral[i] for i in rng.choice(len(neutral), SEGMENTS - min(len(with_), SEGMENTS // 2), replace=False)]
    if len(with_) > SEGMENTS // 2:
        with_ = [with_[i] for i in rng.choice(len(with_), SEGMENTS // 2, replace=False)]
    segments = with_ + neutral
    seqs = [tokens[a:b] for a, b in segments]
    df = Counter()
    for s in seqs:
        for w in np.unique(s):
            df.update(parts[w])
    used, flat = np.unique(np.concatenate(seqs), return_inverse=True)
    ids: dict[str, int] = {}
    listed = [[ids.setdefault(f, len(ids)) for f in parts[w] if df[f] >= 3] for w in used]
    word_of = np.repeat(np.arange(len(listed)), [len(x) for x in listed])
    feature_of = np.array([f for x in listed for f in x], np.int64)
    gold = np.concatenate([marks[a:b] for a, b in segments]).astype(float)
    cuts = np.cumsum([len(s) for s in seqs])[:-1]
    inner = np.ones(len(flat), bool)
    inner[np.concatenate(([0], cuts))] = False  # tokens with one before them
    pair = lambda p: np.array([[((1 - p[:-1]) * (1 - p[1:]))[inner[1:]].sum(), ((1 - p[:-1]) * p[1:])[inner[1:]].sum()], [(p[:-1] * (1 - p[1:]))[inner[1:]].sum(), (p[:-1] * p[1:])[inner[1:]].sum()]])
    counts = pair(gold)
    trans = np.log((counts + 1) / (counts + 1).sum(1, keepdims=True))  # the observed transitions are the start
    trans = trans - trans[0, 0]  # only differences count
    w, bias, g2, gb2, gt2 = np.zeros(len(ids)), -3.0, np.full(len(ids), 1e-6), 1e-6, np.full((2, 2), 1e-6)
    for _ in range(30):
        per_word = bias + np.bincount(word_of, w[feature_of], len(listed))
        e = per_word[flat]
        forward, back = (np.concatenate(x) for x in passes(np.split(e, cuts), trans))
        p = 1 / (1 + np.exp(-np.clip(forward + back, -500, 500)))
        slope = np.bincount(flat, gold - p, len(listed))
        grad = np.bincount(feature_of, slope[word_of], len(ids)) - 0.5 * w
        g2 += grad * grad
        w += 0.5 * grad / np.sqrt(g2)
        gb = slope.sum()
        gb2 += gb * gb
        bias += 0.3 * gb / np.sqrt(gb2)
        second = np.flatnonzero(inner)
        gt = counts - pair_marginals(forward[second - 1], (e + back)[second], trans).sum(2) - 0.5 * trans
        gt[0, 0] = 0
        gt2 += gt * gt
        trans = trans + 0.1 * gt / np.sqrt(gt2)
    model = Model({f: float(w[i]) for f, i in ids.items() if abs(w[i]) > 1e-3}, float(bias), trans, (1.0, 0.0))
    scores = Scores(model.weights, model.bias)
    emission = np.array([scores[w] for w in vocabulary])
    x = np.zeros(len(y))
    by_length = np.argsort(np.diff(off), kind="stable")
    for k in range(0, len(y), 500):
        part = by_length[k : k + 500]
        x[part] = [evidence(m) for m in messages([emission[tokens[off[i] : off[i + 1]]] for i in part], trans)]
    a, b = 1.0, 0.0
    for _ in range(200):  # calibration: Newton steps of a ridge logistic regression on one number
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        r, v = y - p, p * (1 - p) + 1e-9
        h = np.array([[(v * x * x).sum() + 0.1, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, np.array([(r * x).sum() - 0.1 * a, r.sum()]))
        a, b = a + np.clip(step[0], -1, 1), b + np.clip(step[1], -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    model.scale = (float(max(a, 1e-3)), float(b))
    return model


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Model | None:
    return fitted(sample(docs, labels, "toxic", 4, 2, limit, SAMPLE_BYTES), fit)


def read(text: str | None, model: Model, table_of: Scores, spans: bool) -> tuple[float, list[dict]]:
    """Evidence and spans of one text, stretch by stretch."""
    tops, found = [], []
    for at, part in stretches(text or ""):
        logits = messages([np.fromiter(map(table_of.__getitem__, words_of(part)), float)], model.trans)[0]
        if len(logits):
            tops.append(evidence(logits))
            found += _spans(part, logits, at) if spans and logits.max() >= 0 else []
    return evidence(np.array(tops)), found


def score(docs: DataFrame, model: Model | None, spans: bool = True) -> DataFrame:
    """docs with toxic_score and (offsets in code points) toxic_spans array<struct<start:int,end:int,p:double>>."""
    docs = without(docs, "toxic_score", "toxic_spans")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    added = "toxic_score double" + (", toxic_spans array<struct<start:int,end:int,p:double>>" if spans else "")
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(added).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        table_of = Scores(model.weights, model.bias) if model else None
        for batch in pieces(batches, "text", 2_000_000):
            if model is None:
                values, found = [0.0] * batch.num_rows, [[]] * batch.num_rows
            else:
                texts = batch.column("text").to_pylist()
                if any(t and len(t) > LONG for t in texts):
                    got = [read(t, model, table_of, spans) for t in texts]
                    values, found = [model.probability(e) for e, _ in got], [f for _, f in got]
                else:
                    of = table_of.__getitem__
                    logits = messages([np.fromiter(map(of, words_of(t)), float) if t else np.zeros(0) for t in texts], model.trans)
                    values = [model.probability(evidence(x)) for x in logits]
                    found = [_spans(t, x) if spans and len(x) and x.max() >= 0 else [] for t, x in zip(texts, logits, strict=True)]
            cols = [*batch.columns, pa.array(values, pa.float64())]
            if spans:
                cols.append(pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    return docs.mapInArrow(run, schema)


def _spans(text: str, logits: np.ndarray, shift: int = 0) -> list[dict]:
    """Runs of tokens whose marginal is 1/2 or more."""
    lowered = text.lower()
    at = list(_WORD.finditer(lowered if len(lowered) == len(text) else text))
    out: list[dict] = []
    before = -2
    for i in np.flatnonzero(logits >= 0):
        p = float(1 / (1 + np.exp(-logits[i])))
        if out and i == before + 1:
            out[-1]["end"], out[-1]["p"] = at[i].end() + shift, max(out[-1]["p"], p)
        else:
            out.append({"start": at[i].start() + shift, "end": at[i].end() + shift, "p": p})
        before = i
    return out


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    got = score(docs, model)
    n = F.size("toxic_spans").cast("long").alias("n_spans")
    at = F.array_join(F.transform("toxic_spans", lambda x: F.concat(x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",").alias("spans")
    return got.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"), n, at)


QUERIES = {"op5_toxicity": op5_toxicity}
SQL: dict[str, str] = {}
