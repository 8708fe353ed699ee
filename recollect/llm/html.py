"""Operator 3: main text of web pages by consensus paths of their hosts.

Each page's containers are scored by their text less that of links; the best one and those beside it that score a share of
it vote for their generalised tag-class paths, which Spark sums by host; each page is then extracted again along its
host's winning paths (its own best containers where those have no text on the page). Names of classes drop containers
of boilerplate by their last word but for words like `wrapper`, so `post-comments-wrapper` goes and `legal-analysis` stays;
headings stay whatever they are named, and a name that articles have too (`market-share`, a section whose id is
`discussion`) drops its container only where that holds little text or mostly links. A host's winning paths hold on a page
where what they give is worth a share of the page's own best.

Defined results: null or empty html gives an empty text; repeated rows repeat results; a null or odd url belongs to the
host ''; an empty table gives no rows; an end tag of head may be missing, a `<` that begins no tag is text, and markup that
is broken or cut off is read as far as it goes; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, saved, small, table

_REST = r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*)"
#: Comments, elements whose content is no markup (to their end tag or the page's end), tags, declarations.
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|iframe|xmp|noembed|noframes)(?=[\s/>]){_REST}>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*){_REST}>|<[!?][^>]*>", re.S | re.I)
#: What is left of a tag where the page is cut off.
_UNFINISHED = re.compile(r"<(?:/?[a-zA-Z][^<]*|[!?][^<]*|/?)\Z", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style|itemprop)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEAD = frozenset("title meta link base script style noscript template".split())
_DROP = frozenset("nav header footer aside form button select option dialog menu canvas object audio video label input head noscript template svg math".split())
#: What goes where a page has no text without the others, such as one that stands inside a form.
_UNSEEN = _DROP - frozenset("header aside form dialog label".split())
_INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd mark q s samp small span strike strong sub sup time tt u var wbr ins del img big acronym".split())
_HOLD = frozenset("article main section div td body center".split())
#: A class or id whose last word, words for a box left out, is one of these names boilerplate.
_BAD = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense advertising sponsor sponsors sponsored banner banners sidebar siderail rail menu menus nav navbar navigation footer footnav masthead topbar header "
    "cookie cookies consent gdpr notice notices alert alerts comment comments commentlist commentform disqus respond reply replies responses reactions discussion share sharing sharebar social related recommended recommendations "
    "promo promos promotion promotions newsletter subscribe subscription signup login popup modal overlay breadcrumb breadcrumbs pagination pager toolbar copyright disclaimer skip commentsection adslot adbox adunit adsbygoogle "
    "hidden outbrain taboola teaser teasers search searchbox searchform".split()
)
_BOX = frozenset(
    "container wrapper wrap box block blocks content contents inner outer list lists item items section sections area body text slot unit units panel panels bar group row col column columns left right top bottom "
    "links link buttons button posts articles stories form forms main holder region zone space card cards icons icon title heading thread count entry post message module frame label image img label toggle".split()
)
#: Words that name it wherever a name begins with them, and whole names.
_STRONG = frozenset("cookie cookies gdpr newsletter breadcrumb breadcrumbs navbar sidebar footer advert advertisement advertisements sponsored taboola outbrain disqus".split())
_WHOLE = frozenset("widget widgets widget-area".split())
_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Words that also name what articles are about, at the end of a longer name or as the id of a section.
_DOUBTFUL = frozenset("discussion search related share sharing social".split())
_DOUBTFUL_ID = _DOUBTFUL | frozenset("reply notice notices alert alerts promotion subscription".split())
#: What a header belongs to that is part of the text.
_OWN_HEADER = frozenset("article post entry story chapter".split())
_HEADING = re.compile(r"h[1-6]")
#: A container of a doubtful name stays with so many characters and less than this share of them in links.
STAYS, LINKED = 200, 0.3
#: Winning paths hold where their text has this share of the length of the page's own.
HOLDS = 0.02
#: A container beside the best one belongs to the text if it scores this share of it.
SIBLING = 0.2
#: A path wins beside its host's first if it has this share of its votes.
ALSO = 0.5


def named(value: str, tag: str = "", key: str = "class") -> int:
    """2 if a class or id attribute names boilerplate: by the first word of one of its names, or by the last that isn't one for
    a box; 1 if it may as well name what an article is about; else 0."""
    worst = 0
    for name in value.split():
        words = [w for w in _SPLIT.split(_CAMEL.sub("-", name).lower()) if w]
        if not words:
            continue
        if words[0] in _STRONG or name.lower() in _WHOLE:
            return 2
        while len(words) > 1 and words[-1] in _BOX and words[-1] not in _BAD:
            del words[-1]
        if words[-1] not in _BAD or (words[-1] == "header" and len(words) == 2 and words[0] in _OWN_HEADER):
            continue
        doubtful = words[-1] in _DOUBTFUL if len(words) > 1 else key == "id" and tag == "section" and words[-1] in _DOUBTFUL_ID
        if not doubtful:
            return 2
        worst = 1
    return worst


def boilerplate(value: str) -> bool:
    return named(value) == 2


class Page:
    """Containers of a page: path, score, and the text pieces inside, boilerplate left out."""

    def __init__(self, html: str, lenient: bool = False):
        self.html, self.lenient = html, lenient
        self.parts: list[tuple[str, int]] = []  # text or block break (''), innermost container
        self.parent: list[int] = [-1]
        self.path: list[str] = [""]
        self.tag: list[str] = [""]
        self.score: list[float] = [0.0]
        self.own: list[float] = [0.0]  # what its blocks give it, without those of containers inside
        self.chars: list[list[int]] = [[0, 0]]  # of text, and of links in it
        self.doubtful: list[int] = []
        self.cut: set[int] = set()
        self._read(html)
        self._weigh()

    def _read(self, html: str) -> None:
        stack: list[tuple[str, bool, int]] = []  # tag, dropped, container
        dropped, holder, at, links = False, 0, 0, 0
        parts, score = self.parts, self.score
        block = [0, 0]  # characters of the open block, and of links in it

        def close() -> None:
            if block[0]:
                worth = max(0.0, block[0] - 2.0 * block[1])
                score[holder] += worth
                self.own[holder] += worth
                if (up := self.parent[holder]) > 0:
                    score[up] += worth / 2
            block[0] = block[1] = 0

        for m in _TOKEN.finditer(html):
            if m.start() > at and not dropped:
                parts.append((html[at : m.start()], holder))
                n = m.start() - at
                block[0] += n
                block[1] += n * bool(links)
                self.chars[holder][0] += n
                self.chars[holder][1] += n * bool(links)
            at = m.end()
            tag = m.group(4)
            if tag is None:
                continue
            tag = tag.lower()
            inline = tag in _INLINE
            if not inline and not dropped:
                close()
                parts.append(("", holder))
            if m.group(3):  # end tag
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        if inline and any(x[0] not in _INLINE for x in stack[i + 1 :]):
                            break
                        links -= sum(x[0] == "a" for x in stack[i:])
                        del stack[i:]
                        dropped, holder = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
                        break
                continue
            if stack and stack[-1][0] == "head" and tag not in _HEAD:  # its end tag may be left out
                del stack[-1]
                dropped, holder = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
            rest = m.group(5)
            if tag in _VOID or (rest.endswith("/") and tag in ("svg", "math", "path", "use")):
                continue
            if not inline:  # an open paragraph ends where a block begins; an item ends where the next begins
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p" or (tag == "li" and stack[i][0] == "li"):
                        links -= sum(x[0] == "a" for x in stack[i:])
                        del stack[i:]
                        dropped, holder = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
                        break
                    if stack[i][0] in _HOLD or stack[i][0] in ("ul", "ol", "table", "blockquote"):
                        break
            names, bad, doubt = "", tag in (_UNSEEN if self.lenient else _DROP), False
            if rest and not rest.isspace():
                for a in _ATTRIBUTE.finditer(rest):
                    key, value = a.group(1).lower(), a.group(2) or a.group(3) or a.group(4) or ""
                    if key in ("class", "id"):
                        if key == "class":
                            names = ".".join([w for w in _SPLIT.split(_CAMEL.sub("-", value).lower()) if w][:3])
                        kind = 0 if self.lenient or tag in ("body", "html", "article", "main") or _HEADING.fullmatch(tag) else named(value, tag, key)
                        bad, doubt = bad or kind == 2 or (kind == 1 and tag not in _HOLD), doubt or kind == 1
                    elif key == "role":
                        bad = bad or value.lower() in _ROLE
                    elif key == "hidden":
                        bad = bad or value.lower() != "until-found"
                    elif key == "aria-hidden":
                        bad = bad or value.lower() == "true"
                    elif key == "style":
                        bad = bad or "display:none" in value.replace(" ", "").lower()
            inside = holder
            if not dropped and not bad and tag in _HOLD:
                self.parent.append(holder)
                self.path.append(f"{self.path[holder]}>{tag}" + (f".{names}" if names else ""))
                self.tag.append(tag)
                score.append(0.0)
                self.own.append(0.0)
                self.chars.append([0, 0])
                inside = len(score) - 1
                if doubt:
                    self.doubtful.append(inside)
            stack.append((tag, dropped or bad, inside))
            dropped, holder = dropped or bad, inside
            links += tag == "a"
        if at < len(html) and not dropped and (tail := _UNFINISHED.sub("", html[at:])):
            parts.append((tail, holder))
            block[0] += len(tail)
            self.chars[holder][0] += len(tail)
        close()

    def _weigh(self) -> None:
        """Leaves out containers of doubtful names that hold little text or mostly links."""
        if not self.doubtful:
            return
        whole = [list(c) for c in self.chars]
        for i in range(len(whole) - 1, 0, -1):
            whole[self.parent[i]][0] += whole[i][0]
            whole[self.parent[i]][1] += whole[i][1]
        for i in self.doubtful:
            if whole[i][0] < STAYS or whole[i][1] >= LINKED * whole[i][0]:
                self.cut.add(i)
                if (up := self.parent[i]) > 0:
                    self.score[up] -= self.own[i] / 2
        gone = [False] * len(self.parent)
        for i in range(1, len(gone)):
            gone[i] = i in self.cut or gone[self.parent[i]]
            if gone[i]:
                self.score[i] = 0.0

    def best(self) -> int:
        """The container with the highest score, or its article or main; 0 (the page) if none has text."""
        s = self.score
        top = max(range(len(s)), key=lambda i: (s[i] * (1.5 if self.tag[i] in ("article", "main") else 1.0), -i))
        if s[top] <= 0:
            return 0
        for wanted in ("article", "main"):
            i, found = top, 0
            while i > 0:
                if self.tag[i] == wanted:
                    found = i
                i = self.parent[i]
            if found:
                return found
        return top

    def roots(self) -> set[int]:
        """The best container and the ones beside it that score a share of it or stand on its path."""
        top = self.best()
        if not top:
            return {0}
        least = SIBLING * self.score[top]
        beside = (i for i in range(1, len(self.score)) if self.parent[i] == self.parent[top] and self.score[i] > 0)
        return {top} | {i for i in beside if self.score[i] >= least or self.path[i] == self.path[top]}

    def text(self, roots: set[int]) -> str:
        inside = [False] * len(self.parent)
        for i in range(len(inside)):
            inside[i] = i not in self.cut and (i in roots or (i > 0 and inside[self.parent[i]]))
        raw = "".join(t or " " for t, c in self.parts if inside[c])
        return " ".join(unescape(raw).split()) if "&" in raw else " ".join(raw.split())

    def along(self, paths: list[str] | None) -> str:
        """Text of the containers on the paths, or of the page's own best ones where those have none or next to none."""
        own = self.text(self.roots())
        if paths and (roots := {i for i, p in enumerate(self.path) if p in paths}) and (found := self.text(roots)) and len(found) >= HOLDS * len(own):
            return found
        return own or ("" if self.lenient else Page(self.html, True).along(None))


def votes(pages: DataFrame) -> DataFrame:
    """host, path, n, weight: each page's best containers, summed by host and generalised path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html", 8_000_000):
            total: dict[tuple[str, str], list[float]] = defaultdict(lambda: [0, 0.0])
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                page = Page(html or "")
                by_path: dict[str, float] = defaultdict(float)
                for k in page.roots() - {0}:
                    by_path[page.path[k]] += page.score[k]
                for path, worth in by_path.items():
                    t = total[host, path]
                    t[0] += 1
                    t[1] += worth**0.5
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.string()), pa.array([v[0] for v in total.values()], pa.int64()), pa.array([v[1] for v in total.values()], pa.float64())], names=["host", "path", "n", "weight"])

    found = pages.select("host", "html").mapInArrow(run, "host string, path string, n long, weight double")
    return found.groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"))


def winning(found: DataFrame) -> DataFrame:
    """host, paths: the path of most votes, and those that have a share of them."""
    # weights are rounded, so that the order of summing can't turn a tie
    found = found.withColumn("rank", F.struct("n", F.round("weight", 3).alias("w"), "path"))
    top = found.groupBy(F.col("host").alias("v_host")).agg(F.max("rank").alias("top"))
    also = found.join(top, F.col("host") == F.col("v_host")).filter(F.col("n") >= F.lit(ALSO) * F.col("top.n"))
    return also.groupBy("host").agg(F.array_sort(F.collect_list("path")).alias("paths"))  # at most 1 / ALSO times a page's roots


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of each page."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/?#:]*)", 1)), F.lit(""))
    pages = pages.select("page_id", "url", "html", host.alias("host"))
    winners = saved(winning(saved(votes(pages))))
    winners = small(winners, 64 + F.octet_length("host") + F.octet_length(F.array_join("paths", " ")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html", 8_000_000):
            texts = [Page(h).along(p) if h else "" for h, p in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kinds = dict(pages.dtypes)
    return pages.join(winners, "host", "left").select("page_id", "url", "html", "paths").mapInArrow(run, f"page_id {kinds['page_id']}, url string, text string")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op3_html": op3_html}
SQL: dict[str, str] = {}
