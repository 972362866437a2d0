"""Boolean trigram queries that every match of a regular expression must satisfy.

A query is a conjunction of clauses, each a set of alternatives, each
alternative a set of trigrams that must all occur: a tuple of tuples of
frozensets. The empty conjunction says nothing, so its rule scans fully.
Trigrams are lower-cased in ASCII, and so must be the text they are sought in.
"""

from __future__ import annotations

import re

Query = tuple[tuple[frozenset[str], ...], ...]

#: literal sets with more strings than this are cut
MOST = 64
# Fixed value: space and the letters of English, roughly from common to rare.
COMMON_FIRST = " etaoinshrdlucmfwypvbgkjqxz"


def _fold(text: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in text)


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


class _Run:
    """The strings that the current stretch of the expression can spell out, and clauses found so far."""

    def __init__(self) -> None:
        self.texts: set[str] = {""}
        self.clauses: set[tuple[frozenset[str], ...]] = set()
        self.broken = False

    def close(self) -> None:
        """The stretch ends: its strings become a clause if each has a trigram."""
        grams = {_grams(t) for t in self.texts}
        if all(grams):
            least = [g for g in grams if not any(o < g for o in grams)]
            self.clauses.add(tuple(sorted(least, key=sorted)))
        self.texts, self.broken = {""}, True

    def extend(self, more: set[str]) -> None:
        if len(self.texts) * len(more) > MOST:
            self.close()
        if len(more) > MOST:
            self.close()
            return
        self.texts = {a + b for a in self.texts for b in more}


class _Unknown(Exception):
    """Syntax that this reader does not know."""


# Nodes: ("char", set of folded characters, None for many), ("gap",) for text that says nothing, ("none",) for
# what takes no text, ("seq", nodes), ("any", branches), ("repeat", least, most, node).
_NAMED = {"n": "\n", "t": "\t", "r": "\r", "f": "\f"}
_OPEN = ("?:", "?>", "?i:", "?-i:", "?s:", "?m:")
_LOOK = ("?=", "?!", "?<=", "?<!")


class _Reader:
    """Reads the syntax that Java's and Python's expressions share."""

    def __init__(self, pattern: str) -> None:
        self.text, self.at = pattern, 0

    def peek(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def take(self, n: int = 1) -> str:
        got = self.peek(n)
        if len(got) < n:
            raise _Unknown
        self.at += n
        return got

    def branches(self) -> tuple:
        found = [self.sequence()]
        while self.peek() == "|":
            self.take()
            found.append(self.sequence())
        return found[0] if len(found) == 1 else ("any", found)

    def sequence(self) -> tuple:
        found = []
        while self.peek() not in ("", "|", ")"):
            found.append(self.repeats(self.item()))
        return ("seq", found)

    def repeats(self, node: tuple) -> tuple:
        while True:
            c = self.peek()
            if c in ("*", "+", "?") and c:
                least, most = (1 if c == "+" else 0), (1 if c == "?" else None)
                self.take()
            elif c == "{" and (end := self.text.find("}", self.at)) > 0 and re.fullmatch(r"\d+(,\d*)?", self.text[self.at + 1 : end]):
                low, comma, high = self.text[self.at + 1 : end].partition(",")
                least, most = int(low), int(high) if high else None if comma else int(low)
                self.at = end + 1
            else:
                return node
            if self.peek() in ("?", "+") and self.peek():
                self.take()  # lazy or possessive
            node = ("repeat", least, most, node)

    def item(self) -> tuple:
        c = self.take()
        if c == "(":
            return self.group()
        if c == "[":
            return ("char", self.members())
        if c == "\\":
            return self.escape()
        if c == ".":
            return ("char", None)
        return ("none",) if c in "^$" else ("char", _one(c))

    def group(self) -> tuple:
        look = next((x for x in sorted(_LOOK, key=len, reverse=True) if self.text.startswith(x, self.at)), None)
        opened = next((x for x in _OPEN if self.text.startswith(x, self.at)), None)
        if look or opened:
            self.take(len(look or opened))
        elif self.text.startswith("?i)", self.at):
            self.take(3)
            return ("none",)
        elif named := re.match(r"\?P?<[A-Za-z]\w*>", self.text[self.at :]):
            self.take(named.end())
        elif self.peek() == "?":
            raise _Unknown
        node = self.branches()
        if self.take() != ")":
            raise _Unknown
        return ("none",) if look else node

    def escape(self) -> tuple:
        c = self.take()
        if c in "xu":
            return ("char", _one(chr(int(self.take(2 if c == "x" else 4), 16))))
        if c in _NAMED:
            return ("char", _one(_NAMED[c]))
        if c in "bBAZzG":
            return ("none",)
        if c in "dDwWsShHvV":
            return ("char", None)
        return ("gap",) if c.isalnum() else ("char", _one(c))

    def members(self) -> set[str] | None:
        """The folded members of a class, None for more than four or a negated class."""
        out: set[str] | None = set()
        if self.peek() == "^":
            self.take()
            out = None
        first = True
        while self.peek() != "]" or first:
            first = False
            if self.peek() == "[" or self.peek(2) == "&&":
                raise _Unknown
            one = self.member()
            if self.peek() == "-" and self.peek(2) != "-]":
                self.take()
                other = self.member()
                if not one or not other:
                    raise _Unknown
                span = range(ord(one), ord(other) + 1)
                one = None if len(span) > 4 else "".join(map(chr, span))
            if out is not None:
                folded = [_one(c) for c in one] if one else [None]
                out = None if None in folded else out.union(*folded)
        self.take()
        return out if out is not None and 0 < len(out) <= 4 else None

    def member(self) -> str | None:
        c = self.take()
        if c != "\\":
            return c
        c = self.take()
        if c in "xu":
            return chr(int(self.take(2 if c == "x" else 4), 16))
        if c in _NAMED:
            return _NAMED[c]
        return None if c.isalnum() else c


def _one(c: str) -> set[str] | None:
    """A folded character; other scripts' letters fold in other ways, so they say nothing."""
    return {_fold(c)} if c.isascii() else None


def _walk(node: tuple, run: _Run) -> None:
    kind = node[0]
    if kind == "char" and node[1]:
        run.extend(node[1])
    elif kind in ("char", "gap"):
        run.close()
    elif kind == "seq":
        for part in node[1]:
            _walk(part, run)
    elif kind == "any":
        _walk_any(node[1], run)
    elif kind == "repeat":
        _, low, high, body = node
        if low == 0 and high == 1:
            sub = _Run()
            _walk(body, sub)
            if not sub.broken and len(run.texts) * (len(sub.texts) + 1) <= MOST:
                run.extend(sub.texts | {""})
            else:
                run.close()
        elif low == 0:
            run.close()
        else:
            for _ in range(min(low, 8)):
                _walk(body, run)
            if high != low or low > 8:
                run.close()


def _walk_any(branches: list, run: _Run) -> None:
    inner = []
    for branch in branches:
        sub = _Run()
        _walk(branch, sub)
        inner.append(sub)
    texts = {t for sub in inner for t in sub.texts}
    if not any(sub.broken for sub in inner) and len(run.texts) * len(texts) <= MOST:
        run.extend(texts)
        return
    run.close()
    joined: list[frozenset[str]] = []
    for sub in inner:
        sub.close()
        if not sub.clauses:
            return
        # one alternative of each branch: the clause with the fewest ways
        joined += min(sub.clauses, key=lambda c: (len(c), sorted(map(sorted, c))))
    run.clauses.add(tuple(sorted(set(joined), key=sorted)))


def query_of(pattern: str) -> Query:
    """The trigram query of a pattern in the syntax that Java and Python share; the empty one where it is not known."""
    reader, run = _Reader(pattern), _Run()
    try:
        tree = reader.branches()
    except _Unknown:
        return ()
    if reader.at < len(pattern):
        return ()
    _walk(tree, run)
    run.close()
    return tuple(sorted(run.clauses, key=lambda c: [sorted(a) for a in c]))


def rare(query: Query, most: int = 2) -> Query:
    """The same clauses with the ``most`` rarest trigrams of each alternative: fewer postings, and still true of every match."""

    def cost(gram: str) -> tuple[int, str]:
        return -sum(COMMON_FIRST.index(c) if c in COMMON_FIRST else len(COMMON_FIRST) for c in gram), gram

    return tuple(tuple(frozenset(sorted(way, key=cost)[:most]) for way in clause) for clause in query)


def scanner(grams: list[str]) -> str:
    """An expression that matches, without taking text, where one of the trigrams stands, which is its group 1.

    Three classes of characters turn most places away before a trie is tried.
    """

    def quoted(c: str) -> str:
        return c if c.isalnum() else f"\\x{ord(c):02x}"

    def trie(words: set[str]) -> str:
        by: dict[str, set[str]] = {}
        for w in words:
            by.setdefault(w[0], set()).add(w[1:])
        rests: dict[frozenset[str], list[str]] = {}
        for c, rest in by.items():
            rests.setdefault(frozenset(rest), []).append(c)
        ways = sorted("[" + "".join(map(quoted, sorted(cs))) + "]" + (trie(set(rest)) if rest != {""} else "") for rest, cs in rests.items())
        return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"

    gate = "".join("[" + "".join(sorted({quoted(g[k]) for g in grams})) + "]" for k in range(3))
    return f"(?={gate})(?=({trie(set(grams))}))"


def satisfied(query: Query, text: str) -> bool:
    """Whether a text satisfies a query; the plain form, for tests."""
    text = _fold(text)
    return all(any(all(t in text for t in way) for way in clause) for clause in query)
