"""Boolean queries: tokens, a tree, checks, and the tree as one Column.

Grammar: expr = seq ('|' seq)*, seq = factor+ (all of them), factor = '-' factor | '(' expr ')'
| word | "phrase". A minus negates only at the start of a token; inner hyphens stay.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""\s*(?:([()|])|(-)|"([^"]*)(?:"|\Z)|([^\s()|"]+))""")
#: Nodes of the shared-prefix tree of all branches above which a query is refused.
MAX_NODES = 128
#: Different branches that may be met on the way there.
MOST_BRANCHES = 1 << 14


class QueryParseError(ValueError):
    pass


@dataclasses.dataclass(frozen=True)
class Term:
    text: str
    phrase: bool = False
    negated: bool = False

    @property
    def words(self) -> tuple[str, ...]:
        return tuple(self.text.split()) if self.phrase else (self.text,)


@dataclasses.dataclass(frozen=True)
class Node:
    kind: str  # and, or
    children: tuple


def tokenize(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        at = m.end()
        mark, minus, phrase, word = m.groups()
        out.append((mark, mark) if mark else ("-", "-") if minus else ("phrase", phrase) if phrase is not None else ("word", word))
    return out


def negate(n):
    """De Morgan down to the leaves."""
    if isinstance(n, Term):
        return dataclasses.replace(n, negated=not n.negated)
    return Node("or" if n.kind == "and" else "and", tuple(negate(c) for c in n.children))


def parse(text: str):
    """The query's tree, or None for an empty one. Raises QueryParseError."""
    toks = tokenize(text)
    at = 0

    def peek() -> str:
        return toks[at][0] if at < len(toks) else ""

    def factor():
        nonlocal at
        kind = peek()
        if kind in ("-", "(", "word", "phrase"):
            value = toks[at][1]
            at += 1
            if kind == "-":
                return negate(factor())
            if kind == "(":
                inner = expr()
                if peek() != ")":
                    raise QueryParseError("a parenthesis isn't closed")
                at += 1
                return inner
            return Term(value, kind == "phrase")
        raise QueryParseError(f"unexpected {kind or 'end'}")

    def seq():
        found = []
        while peek() not in ("", "|", ")"):
            found.append(factor())
        if not found:
            raise QueryParseError("nothing to match")
        return found[0] if len(found) == 1 else Node("and", tuple(found))

    def expr():
        nonlocal at
        found = [seq()]
        while peek() == "|":
            at += 1
            found.append(seq())
        return found[0] if len(found) == 1 else Node("or", tuple(found))

    if not toks:
        return None
    tree = expr()
    if at < len(toks):
        raise QueryParseError("text behind the query's end")
    check(tree)
    return tree


def branches(n) -> list[tuple[Term, ...]]:
    """Disjunctive normal form; of branches with the same terms the first."""
    if isinstance(n, Term):
        return [(n,)]
    parts = [branches(c) for c in n.children]
    if n.kind == "or":
        return _distinct(b for p in parts for b in p)
    out: list[tuple[Term, ...]] = [()]
    for p in parts:
        out = _distinct(tuple(dict.fromkeys(a + b)) for a in out for b in p)
    return out


def _distinct(found: Iterable[tuple[Term, ...]]) -> list[tuple[Term, ...]]:
    """Branches, one of each set of terms. The last ones of a query are nodes of its prefix tree each; so many that
    no rest of a query could merge them to MAX_NODES are refused at once."""
    seen: dict[frozenset[Term], tuple[Term, ...]] = {}
    for b in found:
        seen.setdefault(frozenset(b), b)
        if len(seen) > MOST_BRANCHES:
            raise QueryParseError("the query has too many branches")
    return list(seen.values())


def prefix_tree(n) -> list[tuple[Term, ...]]:
    """Distinct prefixes of all branches, each branch's terms ordered by how many branches have them."""
    found = branches(n)
    count: dict[Term, int] = {}
    for b in found:
        for t in dict.fromkeys(b):
            count[t] = count.get(t, 0) + 1
    rank = {t: i for i, t in enumerate(count)}
    ordered = [sorted(dict.fromkeys(b), key=lambda t: (-count[t], rank[t])) for b in found]
    return list(dict.fromkeys(tuple(b[:k]) for b in ordered for k in range(1, len(b) + 1)))


def check(n) -> None:
    if any(all(t.negated for t in b) for b in branches(n)):
        raise QueryParseError("a branch has only negated terms")
    if len(prefix_tree(n)) > MAX_NODES:
        raise QueryParseError("the query is too large")


def leaves(n) -> list[Term]:
    return [n] if isinstance(n, Term) else [t for c in n.children for t in leaves(c)]


def positive_words(n) -> list[str]:
    """Distinct words of terms that aren't negated, in tree order, phrases' words last."""
    found = [t for t in leaves(n) if not t.negated]
    return list(dict.fromkeys([w for t in found if not t.phrase for w in t.words] + [w for t in found if t.phrase for w in t.words]))


def all_words(n) -> list[str]:
    return list(dict.fromkeys(w for t in leaves(n) for w in t.words))


def drivable(n) -> bool:
    """Whether some positive term leads to every match."""
    if isinstance(n, Term):
        return not n.negated
    return (any if n.kind == "and" else all)(drivable(c) for c in n.children)


def as_column(n, present: Callable[[Term], Column]) -> Column:
    """One boolean Column; present gives that of a leaf, negation aside."""
    if isinstance(n, Term):
        return ~present(n) if n.negated else present(n)
    return reduce((lambda a, b: a & b) if n.kind == "and" else (lambda a, b: a | b), (as_column(c, present) for c in n.children))


def matches(n, words: set[str]) -> bool:
    """Whether a document with these words matches, phrases as single words."""
    if isinstance(n, Term):
        return (n.text in words) != n.negated
    return (all if n.kind == "and" else any)(matches(c, words) for c in n.children)


def map_has(pos: Column) -> Callable[[Term], Column]:
    """present() over a map from word to its ascending places."""

    def present(t: Term) -> Column:
        w = t.words
        if not w:
            return F.lit(False)
        first = F.coalesce(pos[w[0]], F.array().cast("array<int>"))
        if len(w) == 1:
            return F.size(first) > 0
        rest = [(i, F.coalesce(pos[x], F.array().cast("array<int>"))) for i, x in enumerate(w) if i]
        # places of the first word from which every other one follows in step
        steps = reduce(lambda a, b: F.array_intersect(a, F.transform(b[1], lambda p: p - b[0])), rest, first)
        return F.size(steps) > 0

    return present
