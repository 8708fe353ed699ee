"""Operator 11: URL filters by a weighted vocabulary, overruled by allow and block rules of hosts and paths.

One Aho-Corasick automaton over the vocabulary scans host and path once. A term counts where neither neighbour is a
letter, a digit or beyond ASCII, once however often it stands there. A strict term weighs as much as the limit, a soft
one less, so a URL is rejected on one strict term or on several distinct soft ones. A rule (host, path, verdict) fits
its host and all subdomains if the URL's path starts with its own; the longest fitting rule decides.

Bounds: rules and vocabulary are parameters that every task holds, of MAX_ENTRIES each at most (else ValueError).
Defined results: a null URL, or one without '://', has an empty host and path, no rule and no term, and is allowed;
hosts keep ports and user names as written; an empty path fits no rule whose path is '/'; of rules of equal length a block wins;
repeated rows repeat their verdicts; an empty table gives no rows; other columns pass through ``judge`` unread, but for
ones named like its own (url_host, url_path, url_rule, url_verdict, url_weight, url_hits), which it replaces.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, without

RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
LIMIT = 2
MAX_ENTRIES = 100_000
#: One of these is enough.
STRICT = (
    "porn", "porno", "pornstar", "xxx", "hentai", "milf", "camgirl", "camgirls", "hardcore", "nsfw", "escort", "escorts", "casino", "casinos",
    "jackpot", "viagra", "cialis", "tramadol", "warez", "keygen", "crackz", "malware", "phishing", "spam", "spamming",
)
#: Two different ones of these are needed.
SOFT = (
    "adult", "adults", "sex", "sexy", "nude", "naked", "erotic", "fetish", "webcam", "dating", "hot", "x", "bet", "bets", "betting", "poker", "slots",
    "roulette", "gambling", "lottery", "win", "winner", "bonus", "free", "cheap", "discount", "pills", "pill", "pharmacy", "drugs", "meds", "loan",
    "loans", "payday", "crack", "torrent", "hack", "cheats", "ads", "adserver", "banner", "track", "tracker", "tracking", "click", "clicks", "popup",
    "farm", "seo", "backlinks", "replica", "followers",
)
VOCABULARY = {**dict.fromkeys(SOFT, 1), **dict.fromkeys(STRICT, LIMIT)}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without '://'."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


@lru_cache(8)
def _automaton(vocabulary: tuple[tuple[str, int], ...]):
    a = ahocorasick.Automaton()
    for term, weight in vocabulary:
        a.add_word(term, (term, weight))
    if vocabulary:
        a.make_automaton()
    return a


def _inner(c: str) -> bool:
    return c >= "\x80" or "a" <= c <= "z" or "0" <= c <= "9"


def hits(text: str, vocabulary: tuple[tuple[str, int], ...]) -> list[tuple[str, int, int]]:
    """(term, weight, start) of each bounded term in a lower-cased text, in order of end."""
    a, out = _automaton(vocabulary), []
    if not len(a):
        return out
    for end, (term, weight) in a.iter(text):
        start = end - len(term) + 1
        if not (start and _inner(text[start - 1])) and not (end + 1 < len(text) and _inner(text[end + 1])):
            out.append((term, weight, start))
    return out


@lru_cache(8)
def _by_host(rules: tuple[tuple[str, str, str], ...]) -> dict[str, list[tuple[str, str]]]:
    """Paths and verdicts of each host, longest path first."""
    held: dict[str, dict[str, str]] = {}
    for host, path, verdict in rules:
        paths = held.setdefault(host, {})
        paths[path] = "block" if "block" in (verdict, paths.get(path)) else verdict
    return {host: sorted(paths.items(), key=lambda x: (-len(x[0]), x[0])) for host, paths in held.items()}


def ruled(host: str, path: str, rules: tuple[tuple[str, str, str], ...]) -> tuple[str, str] | None:
    """The longest fitting rule (as host and path in one) and its verdict."""
    by_host, best = _by_host(rules), None
    while host:
        fits = next(((host + p, verdict) for p, verdict in by_host.get(host, ()) if path.startswith(p)), None)
        if fits and (best is None or (len(fits[0]), fits[1] == "block") > (len(best[0]), best[1] == "block")):
            best = fits
        host = host.partition(".")[2]
    return best


_ANSWER = pa.struct([("rule", pa.string()), ("verdict", pa.string()), ("weight", pa.int64()), ("hits", pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32())])))])


def judge(pages: DataFrame, rules: tuple = RULES, vocabulary: dict[str, int] = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """pages with url_host, url_path, url_rule (null: none fits), url_verdict, url_weight (of the distinct terms) and url_hits
    (term and start, in code points of the URL). Only host and path go to Python."""
    if len(rules) > MAX_ENTRIES or len(vocabulary) > MAX_ENTRIES:
        raise ValueError(f"at most {MAX_ENTRIES} rules and terms")
    if any(set(term) & set(_UPPER) or not term for term in vocabulary):
        raise ValueError("terms are lower-case and not empty")
    rules, terms = tuple(tuple(r) for r in rules), tuple(sorted(vocabulary.items()))

    @F.arrow_udf("rule string, verdict string, weight long, hits array<struct<term:string,start:int>>")
    def answer(host: pa.Array, path: pa.Array, lowered: pa.Array) -> pa.Array:
        out = []
        for h, p, low in zip(host.to_pylist(), path.to_pylist(), lowered.to_pylist(), strict=True):
            rule, found = ruled(h, p, rules), hits(h + low, terms)
            weight = sum({term: w for term, w, _ in found}.values())
            verdict = rule[1] if rule else "block" if weight >= limit else "allow"
            out.append({"rule": rule and rule[0], "verdict": verdict, "weight": weight, "hits": [{"term": term, "start": at} for term, _, at in found]})
        return pa.array(out, _ANSWER)

    own = ("url_host", "url_path", "url_rule", "url_verdict", "url_weight", "url_hits")
    kept = without(pages, *own)
    host, path = parts(F.coalesce(F.col("url"), F.lit("")))
    held = kept.withColumn("url_host", host).withColumn("url_path", path)
    held = held.withColumn("url_hits", answer("url_host", "url_path", lower_ascii(F.col("url_path"))))
    answered, begins = F.col("url_hits"), F.locate("://", F.col("url")) + 2  # code points before the host
    return held.select(
        *[f"`{c}`" for c in kept.columns], "url_host", "url_path", answered["rule"].alias("url_rule"), answered["verdict"].alias("url_verdict"), answered["weight"].alias("url_weight"),
        F.transform(answered["hits"], lambda h: F.struct(h["term"].alias("term"), (h["start"] + begins).alias("start"))).alias("url_hits"),
    )


def allowed(pages: DataFrame, **options) -> DataFrame:
    """The pages whose URL is allowed, with their own columns; other columns of the same names are kept as they are."""
    own = {c: f"`{c}`" for c in pages.columns}
    verdict = judge(pages.select(F.col("url"), F.struct(*own.values()).alias("row")), **options).filter("url_verdict = 'allow'")
    return verdict.select(*[F.col("row")[c].alias(c) for c in own])


def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("url_rule").alias("rule"), F.col("url_verdict").alias("verdict"))


def _url_sql() -> str:
    """DuckDB SQL: one pattern a term instead of the automaton."""
    terms = "[" + ", ".join(f"{{'term': '{t}', 'weight': {w}}}" for t, w in VOCABULARY.items()) + "]"
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    longest = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    rule, verdict = ("CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{out(h, p, v)}'" for h, p, v in longest) + " END" for out in (lambda h, p, v: h + p, lambda h, p, v: v))
    low = f"translate(host || path, '{_UPPER}', '{_LOWER}')"
    inner = r"0-9a-z\x{80}-\x{10FFFF}"
    bounded = f"regexp_matches({low}, '(^|[^{inner}])' || t.term || '([^{inner}]|$)')"
    return f"""WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
w AS (SELECT *, coalesce(list_sum(list_transform({terms}, lambda t: CASE WHEN {bounded} THEN t.weight ELSE 0 END)), 0) AS weight FROM p)
SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN weight >= {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict FROM w"""


QUERIES = {"op11_urls": op11_urls}
SQL = {"op11_urls": _url_sql()}
