"""Query trees: literals with wildcards, grams, and boolean nodes."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

#: Index types in the order of their numbers: the numbers are part of printed plans.
TYPES = ("gram3", "text4", "hash4", "wide8")
NUMBER = {name: k + 1 for k, name in enumerate(TYPES)}

#: One position of a literal: the byte values that it allows.
Token = frozenset
ANY = frozenset(range(256))


@dataclass(frozen=True)
class Literal:
    tokens: tuple[Token, ...]

    @staticmethod
    def plain(data: bytes) -> Literal:
        return Literal(tuple(frozenset([b]) for b in data))

    def exact(self) -> bytes:
        """The bytes of a literal without alternatives; ValueError if it has some."""
        if any(len(t) != 1 for t in self.tokens):
            raise ValueError("a plain string is needed here, without wildcards or alternatives")
        return bytes(next(iter(t)) for t in self.tokens)

    def __str__(self) -> str:
        return "{" + " ".join("%02x" % min(t) if len(t) == 1 else "??" if t == ANY else "(" + "|".join("%02x" % b for b in sorted(t)) + ")" for t in self.tokens) + "}"


@dataclass(frozen=True, order=True)
class Gram:
    """A look-up: files that hold the gram ``id`` in the index ``number``."""

    number: int
    id: int

    @property
    def type(self) -> str:
        return TYPES[self.number - 1]

    def __str__(self) -> str:
        return f"{self.number}_{self.id:06x}"


@dataclass(frozen=True)
class And:
    args: tuple

    def __str__(self) -> str:
        return "and(" + ", ".join(map(str, self.args)) + ")"


@dataclass(frozen=True)
class Or:
    args: tuple

    def __str__(self) -> str:
        return "or(" + ", ".join(map(str, self.args)) + ")"


@dataclass(frozen=True)
class AtLeast:
    """At least ``n`` of ``args`` hold; equal arguments count each for itself."""

    n: int
    args: tuple

    def __str__(self) -> str:
        return f"min_of({self.n}, " + ", ".join(map(str, self.args)) + ")"


Node = Literal | Gram | And | Or | AtLeast
#: Holds for every file.
EVERYTHING = And(())
NOTHING = Or(())


def grams_in(node: Node) -> set[Gram]:
    if isinstance(node, Gram):
        return {node}
    if isinstance(node, Literal):
        return set()
    return set().union(*map(grams_in, node.args)) if node.args else set()


def holds(node: Node, present: Iterable[Gram]) -> bool:
    """Whether a file with exactly these grams satisfies a planned tree."""
    present = present if isinstance(present, (set, frozenset)) else set(present)
    if isinstance(node, Gram):
        return node in present
    if isinstance(node, And):
        return all(holds(a, present) for a in node.args)
    if isinstance(node, Or):
        return any(holds(a, present) for a in node.args)
    if isinstance(node, AtLeast):
        return sum(holds(a, present) for a in node.args) >= node.n
    raise TypeError("plan literals first")
