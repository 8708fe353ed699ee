"""RDF sources: Turtle files, a file a row, and the labels of what they describe.

Prefixes hold from where they stand to a file's end, so a file is parsed in one piece by a small reader; everything
after that (labels, their order, labels that are things of their own) is joined and grouped by Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import local_name
from ..operators.cuts import dealt, kept

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
#: Predicates that name a thing, the preferred ones first, and those that lead to a label with a literal form.
LABELS = ("http://www.w3.org/2004/02/skos/core#prefLabel", "http://www.w3.org/2000/01/rdf-schema#label", "http://www.w3.org/2004/02/skos/core#altLabel", "http://www.w3.org/2008/05/skos-xl#literalForm")
XL_LABELS = ("http://www.w3.org/2008/05/skos-xl#prefLabel", "http://www.w3.org/2008/05/skos-xl#altLabel")
XL_FORM = LABELS[3]

_TOKEN = re.compile(
    r"(?P<skip>(?:\s+|#[^\n]*)+)"
    r"|<(?P<iri>[^<>\"{}|^`\\\x00-\x20]*(?:\\u[0-9A-Fa-f]{4}[^<>\"{}|^`\\\x00-\x20]*)*)>"
    r"|(?P<text>\"\"\"(?:\"{0,2}(?:\\[\s\S]|[^\"\\]))*\"\"\"|'''(?:'{0,2}(?:\\[\s\S]|[^'\\]))*'''|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')"
    r"|@(?P<at>[A-Za-z]+(?:-[A-Za-z0-9]+)*)|\^\^|(?P<blank>_:[\w.-]*\w)"
    r"|(?P<name>(?:\w[\w-]*(?:\.[\w-]+)*)?:(?:[\w:%-]|\\[^\s]|\.(?=[\w:%\\.-]))*)"
    r"|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?<!\.))"
    r"|(?P<word>[A-Za-z]+)|(?P<sign>[\[\]();,.])|(?P<other>[\s\S])"
)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|([\s\S]))")
#: Triples of a batch, of many small files or a part of a large one.
BATCH = 10_000
_SHORT = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}


class TurtleError(ValueError):
    """A source that isn't Turtle."""


def unescaped(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _SHORT.get(m[3], m[3]), text) if "\\" in text else text


class Turtle:
    """The triples (subject, predicate, object, whether it is a literal) of one source; scope keeps blank nodes of files apart."""

    def __init__(self, text: str, scope: str = "", base: str = ""):
        self.tokens = list(self._split(text))
        self.i, self.scope, self.base, self.prefixes, self.made = 0, scope, base, {}, 0
        self.out: list[tuple[str, str, str, bool]] = []
        while self.i < len(self.tokens):
            self._statement()

    @staticmethod
    def _split(text: str) -> Iterator[tuple[str, str]]:
        for m in _TOKEN.finditer(text):  # every character is in a match
            kind = m.lastgroup
            if kind == "other":
                raise TurtleError(f"not understood at {m.start()}: {text[m.start() : m.start() + 20]!r}")
            if kind != "skip":
                yield (kind, m[kind]) if kind else ("sign", m[0])

    def _peek(self) -> tuple[str, str]:
        if self.i >= len(self.tokens):
            raise TurtleError("the source ends inside a statement")
        return self.tokens[self.i]

    def _next(self) -> tuple[str, str]:
        token = self._peek()
        self.i += 1
        return token

    def _expect(self, sign: str) -> None:
        if self._next() != ("sign", sign):
            raise TurtleError(f"{sign!r} expected")

    def _statement(self) -> None:
        kind, value = self._peek()
        named = value.lower() if kind in ("at", "word") else ""
        if named in ("prefix", "base"):
            self.i += 1
            prefix = self._next()[1] if named == "prefix" else None
            if self._peek()[0] != "iri" or (prefix is not None and not prefix.endswith(":")):
                raise TurtleError(f"a {named} needs an IRI")
            iri = self._node()
            if prefix is None:
                self.base = iri
            else:
                self.prefixes[prefix[:-1]] = iri
            if kind == "at":
                self._expect(".")
            return
        bracket = self._peek() == ("sign", "[")
        subject = self._node()
        if not (bracket and self._peek() == ("sign", ".")):
            self._predicates(subject)
        self._expect(".")

    def _blank(self) -> str:
        self.made += 1
        return f"_:{self.scope}b{self.made}"

    def _predicates(self, subject: str) -> None:
        while True:
            kind, value = self._peek()
            if (kind, value) == ("word", "a"):
                self.i += 1
                predicate = RDF + "type"
            else:
                predicate = self._node()
            while True:
                self._object(subject, predicate)
                if self._peek() != ("sign", ","):
                    break
                self.i += 1
            while self._peek() == ("sign", ";"):
                self.i += 1
                if self._peek() in (("sign", "."), ("sign", "]")):
                    return
                if self._peek() != ("sign", ";"):
                    break
            else:
                return

    def _node(self) -> str:
        kind, value = self._next()
        if kind == "iri":
            return urljoin(self.base, unescaped(value)) if self.base else unescaped(value)
        if kind == "name":
            prefix, _, local = value.partition(":")
            if prefix not in self.prefixes:
                raise TurtleError(f"unknown prefix {prefix!r}")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        if kind == "blank":
            return f"_:{self.scope}n{value[2:]}"
        if (kind, value) == ("sign", "["):
            own = self._blank()
            if self._peek() != ("sign", "]"):
                self._predicates(own)
            self._expect("]")
            return own
        if (kind, value) == ("sign", "("):
            return self._list()
        raise TurtleError(f"a node expected, not {value!r}")

    def _list(self) -> str:
        head = last = None
        while self._peek() != ("sign", ")"):
            own = self._blank()
            self._object(own, RDF + "first")
            if last is not None:
                self.out.append((last, RDF + "rest", own, False))
            head, last = head or own, own
        self.i += 1
        if last is not None:
            self.out.append((last, RDF + "rest", RDF + "nil", False))
        return head or RDF + "nil"

    def _object(self, subject: str, predicate: str) -> None:
        kind, value = self._peek()
        if kind == "text":
            self.i += 1
            width = 3 if len(value) >= 6 and value[:3] in ('"""', "'''") else 1
            self.out.append((subject, predicate, unescaped(value[width:-width]), True))
            if self._peek()[0] == "at":
                self.i += 1
            elif self._peek() == ("sign", "^^"):
                self.i += 1
                self._node()
        elif kind == "number" or (kind == "word" and value in ("true", "false")):
            self.i += 1
            self.out.append((subject, predicate, value, True))
        else:
            at = len(self.out)
            node = self._node()
            self.out.insert(at, (subject, predicate, node, False))


def triples(files: DataFrame) -> DataFrame:
    """(path, pos, s, p, o, literal, error) of Turtle files (path, text); a file that can't be read has one row with its error."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "pos", "s", "p", "o", "literal", "error"])

    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                try:
                    rows += [(path, i, *t, None) for i, t in enumerate(Turtle(text or "", f"{path}#").out)]
                except TurtleError as e:
                    rows.append((path, 0, None, None, None, None, str(e)[:2000]))
                if len(rows) >= BATCH:
                    yield from (batch_of(rows[a : a + BATCH]) for a in range(0, len(rows), BATCH))
                    rows = []
        if rows:
            yield batch_of(rows)

    return dealt(files.select("path", "text"), "path").mapInArrow(run, "path string, pos int, s string, p string, o string, literal boolean, error string")


def labelled(found: DataFrame) -> DataFrame:
    """(uri, primary, aliases, type_hint) of the subjects of triples (s, p, o, literal).

    Preferred labels come first, then plain and alternative ones, each in order of text; a label that is a thing of its own
    gives its literal form to what it labels, and is named by it itself. Without a label: the local name. The type hint is
    the local name of the first type. Blank nodes are left out."""
    told = (F.col("literal") & F.col("p").isin(*LABELS)) | (~F.col("literal") & F.col("p").isin(*XL_LABELS, RDF + "type"))
    found = kept(found.filter(told).select("s", "p", "o", "literal"))  # read four times, parsed once
    own = found.filter("literal")
    rank = lambda p: F.array_position(F.array(*[F.lit(x) for x in LABELS]), p)
    direct = own.filter(F.col("p").isin(*LABELS)).select("s", rank(F.col("p")).alias("rank"), F.col("o").alias("label"))
    forms = own.filter(F.col("p") == XL_FORM).select(F.col("s").alias("f_s"), F.col("o").alias("label"))
    leads = found.filter(~F.col("literal") & F.col("p").isin(*XL_LABELS)).select("s", F.when(F.col("p") == XL_LABELS[0], 1).otherwise(3).cast("long").alias("rank"), "o")
    labels = direct.unionByName(leads.join(forms, leads["o"] == forms["f_s"]).select("s", "rank", "label"))
    labels = labels.groupBy("s", "label").agg(F.min("rank").alias("rank"))  # a label once
    named = labels.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("rank", "label"))).alias("labels"))
    types = found.filter(~F.col("literal") & (F.col("p") == RDF + "type")).groupBy("s").agg(F.min(local_name(F.col("o"))).alias("type_hint"))
    x = named.join(types, "s", "full").filter(~F.col("s").startswith("_:"))
    names = F.transform("labels", lambda s: s["label"])
    rest = F.slice(names, F.lit(2), F.greatest(F.size("labels") - 1, F.lit(0)))
    return x.select(F.col("s").alias("uri"), F.coalesce(F.get(names, F.lit(0)), local_name(F.col("s"))).alias("primary"), F.coalesce(rest, F.array().cast("array<string>")).alias("aliases"), "type_hint")
