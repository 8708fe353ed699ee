"""Symbols of TypeScript, Go and Rust sources by one pass over their tokens with a stack of braces: a helper of code graphs.

What stands in braces after a definition belongs to it; comments, strings and type arguments don't count. Calls go by the
last name before the parenthesis, in the innermost named function; functions without a name belong to what is around them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_STRINGS = {
    "typescript": r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`",
    "go": r"\"(?:\\.|[^\"\\\n])*\"|`[^`]*`|'(?:\\.[^']*|[^'\\\n])'",
    "rust": r"b?r(?P<h>#*)\"[\s\S]*?\"(?P=h)|b?\"(?:\\.|[^\"\\])*\"|b?'(?:\\.[^'\n]*|[^'\\\n])'|'\w+",
}
_TOKENS = {
    name: re.compile(rf"(?P<skip>\s+|//[^\n]*|/\*[\s\S]*?(?:\*/|$))|(?P<string>{strings})|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<sign>=>|->|::|[\s\S])")
    for name, strings in _STRINGS.items()
}
EXTENSIONS = {"ts": "typescript", "tsx": "typescript", "go": "go", "rs": "rust"}
#: Words before a parenthesis that call nothing.
_NO_CALL = {
    "typescript": frozenset("if for while switch catch return function typeof in of await yield throw case else do new delete void super async constructor import as".split()),
    "go": frozenset("if for switch return func go defer range select case chan map struct interface else import var const type".split()),
    "rust": frozenset("if while match return fn loop unsafe in else where as dyn impl for let move pub crate await".split()),
}


@dataclass
class _Scope:
    kind: str  # MODULE, CLASS, FUNCTION or "" for other braces
    name: str
    opened: int = 0  # depth of parentheses when it began


@dataclass
class Reader:
    """The state of one pass."""

    language: str
    module: str
    tokens: list[tuple[str, str]]
    nodes: list = field(default_factory=list)
    edges: list = field(default_factory=list)
    scopes: list = field(default_factory=list)
    pending: _Scope | None = None
    depth: int = 0

    def at(self, i: int) -> str:
        return self.tokens[i][1] if 0 <= i < len(self.tokens) else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i][0] == "name"

    def owner(self, *kinds: str) -> _Scope:
        return next(s for s in reversed(self.scopes) if s.kind in (*kinds, "MODULE"))

    def define(self, kind: str, name: str) -> None:
        above = self.owner("CLASS", "FUNCTION")
        full = f"{above.name}.{name}"
        if not any(n[0] == kind and n[1] == full for n in self.nodes):
            self.nodes.append((kind, full, name))
        self.edges.append(("DEFINES", above.name, full))
        self.pending = _Scope(kind, full, self.depth)

    def imported(self, what: str) -> None:
        self.nodes.append(("IMPORT", f"{self.module}:{what}", what))
        self.edges.append(("IMPORTS", self.module, what))

    def skip_angles(self, i: int) -> int:
        """Past type arguments that begin at i."""
        if self.at(i) != "<":
            return i
        deep, k = 0, i
        while k < len(self.tokens) and self.at(k) not in (";", "{"):
            deep += {"<": 1, ">": -1}.get(self.at(k), 0)
            k += 1
            if not deep:
                return k
        return i

    def bases(self, i: int, ends: tuple[str, ...], but: tuple[str, ...] = ()) -> None:
        """INHERITS edges to the names from i on, up to an end."""
        while i < len(self.tokens) and self.at(i) not in ends:
            if self.at(i) == "<" and (past := self.skip_angles(i)) > i:
                i = past
                continue
            last = self.at(i + 1) not in (".", "::")
            if self.is_name(i) and last and self.at(i) not in but:
                self.edges.append(("INHERITS", self.pending.name, self.at(i)))
            i += 1


def _typescript(r: Reader, i: int) -> None:
    word, before = r.at(i), r.at(i - 1)
    if word in ("class", "interface") and r.is_name(i + 1) and before != ".":
        r.define("CLASS", r.at(i + 1))
        r.bases(r.skip_angles(i + 2), ("{", ";"), ("extends", "implements"))
    elif word == "function":
        k = i + 1 + (r.at(i + 1) == "*")
        if r.is_name(k):
            r.define("FUNCTION", r.at(k))
    elif word in ("const", "let", "var") and r.is_name(i + 1):
        k = i + 2
        while k < len(r.tokens) and r.at(k) not in ("=", ";", "=>", "\n") and k < i + 40:
            k += 1
        k += 1 + (r.at(k + 1) == "async")
        if r.at(k - 1) in ("=", "async") and _arrow(r, k):
            r.define("FUNCTION", r.at(i + 1))
    elif word == "import" and before != "." and r.at(i + 1) != "(":
        k = i + 1
        while k < len(r.tokens) and r.tokens[k][0] != "string" and r.at(k) != ";":
            k += 1
        if k < len(r.tokens) and r.tokens[k][0] == "string":
            r.imported(r.at(k)[1:-1])
    elif r.scopes[-1].kind == "CLASS" and r.depth == r.scopes[-1].opened and r.pending is None and before not in (".", "new", "@", "=") and r.at(r.skip_angles(i + 1)) == "(" and word not in ("if", "for", "while", "switch", "catch"):
        r.define("FUNCTION", word)


def _arrow(r: Reader, k: int) -> bool:
    """Whether an arrow function begins at k."""
    if r.is_name(k):
        return r.at(k + 1) == "=>"
    k, deep = r.skip_angles(k), 0
    if r.at(k) != "(":
        return False
    while k < len(r.tokens):
        deep += {"(": 1, ")": -1}.get(r.at(k), 0)
        k += 1
        if not deep:
            break
    while k < len(r.tokens) and r.at(k) not in ("=>", "{", ";", ")", ","):
        k += 1
    return r.at(k) == "=>"


def _go(r: Reader, i: int) -> None:
    word = r.at(i)
    if word == "type" and r.scopes[-1].kind != "CLASS":
        if r.is_name(i + 1):
            r.define("CLASS", r.at(i + 1))
        elif r.at(i + 1) == "(":  # a group: a name begins each of its lines, outside braces
            k, deep, fresh = i + 2, 0, True
            while k < len(r.tokens) and not (deep == 0 and r.at(k) == ")"):
                deep += {"{": 1, "(": 1, "[": 1, "}": -1, ")": -1, "]": -1}.get(r.at(k), 0)
                if deep == 0 and fresh and r.is_name(k):
                    r.define("CLASS", r.at(k))
                    r.pending = None
                    fresh = False
                fresh = fresh or (deep == 0 and (r.at(k) == "}" or (r.is_name(k) and not r.is_name(k - 1) and r.at(k - 1) != "(")))
                k += 1
    elif word == "func":
        k = i + 1
        if r.at(k) == "(" and r.owner("CLASS", "FUNCTION").kind == "MODULE" and r.pending is None:  # a receiver
            while k < len(r.tokens) and r.at(k) != ")":
                k += 1
            k += 1
        if r.is_name(k):
            r.define("FUNCTION", r.at(k))
    elif word == "import" and r.owner("CLASS", "FUNCTION").kind == "MODULE":
        group, k = r.at(i + 1) == "(", i + 1
        while k < len(r.tokens) and r.at(k) != ")":
            if r.tokens[k][0] == "string":
                r.imported(r.at(k)[1:-1])
                if not group:
                    return
            k += 1


def _rust(r: Reader, i: int) -> None:
    word = r.at(i)
    if word in ("struct", "enum", "trait") and r.is_name(i + 1):
        r.define("CLASS", r.at(i + 1))
        k = r.skip_angles(i + 2)
        if word == "trait" and r.at(k) == ":":
            r.bases(k + 1, ("{", ";", "where"))
    elif word == "impl" and r.scopes[-1].kind != "FUNCTION" and r.depth == r.scopes[-1].opened:
        k, names = r.skip_angles(i + 1), []
        while k < len(r.tokens) and r.at(k) not in ("{", ";", "where"):
            past = r.skip_angles(k)
            if past > k:
                k = past
                continue
            if r.is_name(k) and r.at(k + 1) != "::":
                names.append(r.at(k))
            k += 1
        trait, _, kind = " ".join(names).rpartition(" for ")
        if own := kind.split():
            r.define("CLASS", own[-1])
            if trait:
                r.edges.append(("INHERITS", r.pending.name, trait.split()[-1]))
    elif word == "fn" and r.is_name(i + 1):
        r.define("FUNCTION", r.at(i + 1))
    elif word == "use":
        k = i + 1
        while k < len(r.tokens) and r.at(k) != ";":
            k += 1
        r.imported("".join(f" {t} " if t == "as" else t for _, t in r.tokens[i + 1 : k]))


_LANGUAGES = {"typescript": _typescript, "go": _go, "rust": _rust}


def symbols(language: str, module: str, source: str) -> tuple[list[tuple[str, str, str]], list[tuple[str, str, str]]]:
    """(kind, qualified name, name) of a source's symbols, and (kind, from, to) edges; names outside it are bare."""
    tokens = [(m.lastgroup if m.lastgroup != "h" else "string", m[0]) for m in _TOKENS[language].finditer(source) if m.lastgroup != "skip"]
    r = Reader(language, module, tokens, [("MODULE", module, re.split(r"[./]", module)[-1])], [], [_Scope("MODULE", module)])
    step = _LANGUAGES[language]
    for i, (kind, text) in enumerate(tokens):
        if kind == "name":
            begun = len(r.nodes), len(r.edges)
            step(r, i)
            after = r.at(i + 1)
            if after == "!" and language == "rust" and r.at(i + 2) in ("(", "[", "{"):
                after = "("
            elif language == "rust" and after == "::" and r.at(i + 2) == "<":
                after = r.at(r.skip_angles(i + 2))
            elif language == "typescript" and after == "<":
                after = r.at(r.skip_angles(i + 1))
            called = after == "(" or (r.at(i - 1) == "new" and language == "typescript" and after != ".")
            caller = r.owner("FUNCTION")
            if r.pending is not None and r.pending.kind == "FUNCTION" and language == "typescript" and r.depth == r.pending.opened and begun[0] == len(r.nodes):
                caller = r.pending if r.at(i - 1) != "function" else caller  # the body of an arrow function without braces
            fresh = begun == (len(r.nodes), len(r.edges)) and r.at(i - 1) not in ("function", "func", "fn") and not (r.at(i - 1) == "*" and r.at(i - 2) == "function") and not (r.pending is not None and language != "typescript" and r.pending.kind == "FUNCTION")
            if called and fresh and text not in _NO_CALL[language] and caller.kind == "FUNCTION" and not (r.pending is caller and caller.name.endswith("." + text) and r.at(i - 1) != "."):
                r.edges.append(("CALLS", caller.name, text))
        elif text in "([":
            r.depth += 1
        elif text in ")]":
            r.depth -= 1
        elif text == "{":
            bare = r.at(i - 1) in ("interface", "struct") and r.pending is not None and r.pending.kind == "FUNCTION"
            mine = r.pending is not None and r.pending.opened == r.depth and not bare and not (language == "typescript" and r.at(i - 1) == ":")
            r.scopes.append(_Scope(r.pending.kind, r.pending.name, r.depth) if mine else _Scope("", "", r.depth))
            r.pending = None if mine else r.pending
        elif text == "}" and len(r.scopes) > 1:
            r.depth = r.scopes.pop().opened
        elif text == ";" and r.pending is not None and r.depth == r.pending.opened:
            r.pending = None
    return r.nodes, list(dict.fromkeys(e for e in r.edges if e[1] != e[2]))
