"""The atom selection language: parsed to a tree, compiled to column predicates or semi joins.

  or: and ("or" and)* ; and: not ("and" not)* ; not: "not" not | primary
  primary: "(" or ")" | "byres" primary | "within" NUMBER "of" primary | test

What looks at one atom becomes a predicate that reaches the scan; only ``byres``
and ``within`` make joins.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandex.operators import residues, roles, spatial

DEPTH = 128
_TOKEN = re.compile(r"\s*(?:(?P<op><=|>=|==|<|>|=)|(?P<paren>[()])|(?P<word>[0-9A-Za-z'*.+-]+))")
CLASSES = ("protein", "nucleic", "water", "metal", "hetatm", "ligand")
LISTS = ("chain", "resn", "name", "element")
KEYWORDS = frozenset(("all", "none", "not", "and", "or", "byres", "within", "of", "resi", "model", "ss", "bfactor", "plddt", *CLASSES, *LISTS))


class SelectionError(ValueError):
    """The query can't be parsed, or selects nothing."""


@dataclass(frozen=True)
class Node:
    op: str
    args: tuple = ()


class _Parser:
    def __init__(self, query: str):
        self.query, self.at, self.depth = query, 0, 0
        self.tokens: list[str] = []
        at = 0
        while query[at:].strip():
            m = _TOKEN.match(query, at)
            if not m:
                self.fail(f"unexpected {query[at:].strip()[0]!r}")
            self.tokens.append(m.group(m.lastgroup))
            at = m.end()

    def fail(self, what: str):
        raise SelectionError(f"{what} in selection {self.query!r}")

    def peek(self) -> str | None:
        return self.tokens[self.at].lower() if self.at < len(self.tokens) else None

    def take(self, what: str | None = None) -> str:
        if self.at == len(self.tokens) or what is not None and self.peek() != what:
            self.fail(f"expected {what or 'more'}, found {self.peek() or 'the end'}")
        self.at += 1
        return self.tokens[self.at - 1]

    def parse(self) -> Node:
        tree = self.either()
        if self.peek() is not None:
            self.fail(f"unexpected {self.peek()!r}")
        return tree

    def either(self) -> Node:
        tree = self.both()
        while self.peek() == "or":
            self.take()
            tree = Node("or", (tree, self.both()))
        return tree

    def both(self) -> Node:
        tree = self.negation()
        while self.peek() == "and":
            self.take()
            tree = Node("and", (tree, self.negation()))
        return tree

    def negation(self) -> Node:
        self.depth += 1
        if self.depth > DEPTH:
            self.fail("too deep")
        try:
            if self.peek() == "not":
                self.take()
                return Node("not", (self.negation(),))
            return self.primary()
        finally:
            self.depth -= 1

    def primary(self) -> Node:
        self.depth += 1
        if self.depth > DEPTH:
            self.fail("too deep")
        try:
            word = self.take().lower()
            if word == "(":
                tree = self.either()
                self.take(")")
                return tree
            if word == "byres":
                return Node("byres", (self.primary(),))
            if word == "within":
                far = self.number()
                if not (math.isfinite(far) and far >= 0):
                    self.fail("a distance must be finite and not negative")
                self.take("of")
                return Node("within", (far, self.primary()))
            return self.test(word)
        finally:
            self.depth -= 1

    def number(self) -> float:
        word = self.take()
        try:
            return float(word)
        except ValueError:
            self.fail(f"{word!r} is no number")

    def test(self, word: str) -> Node:
        if word in ("all", "none", *CLASSES):
            return Node(word)
        if word in LISTS:
            return Node(word, tuple(self.values()))
        if word == "resi":
            spans = []
            for v in self.values():
                m = re.fullmatch(r"(\d+)(?:-(\d+))?", v)
                if not m:
                    self.fail(f"{v!r} is no residue number or range")
                spans.append((int(m[1]), int(m[2] or m[1])))
            return Node("resi", tuple(spans))
        if word == "model":
            v = self.take()
            if not v.isdigit():
                self.fail(f"{v!r} is no model")
            return Node("model", (int(v),))
        if word == "ss":
            v = self.take().upper()
            if v not in ("H", "E", "T", "C"):
                self.fail(f"{v!r} is no secondary structure")
            return Node("ss", (v,))
        if word in ("bfactor", "plddt"):
            op = self.take()
            if op not in ("<", "<=", ">", ">=", "=", "=="):
                self.fail(f"{op!r} is no comparison")
            return Node("bfactor", (op, self.number()))
        self.fail(f"unexpected {word!r}")

    def values(self) -> list[str]:
        out = []
        while (p := self.peek()) is not None and p not in KEYWORDS and p not in "()" and not _is_operator(p):
            out.append(self.take())
        if not out:
            self.fail("expected a value")
        return out


def _is_operator(word: str) -> bool:
    return word in ("<", "<=", ">", ">=", "=", "==")


def parse(query: str) -> Node:
    return _Parser(query).parse()


def is_local(tree: Node) -> bool:
    """Whether an atom's own row decides."""
    return tree.op not in ("byres", "within") and all(is_local(x) for x in tree.args if isinstance(x, Node))


def predicate(tree: Node) -> Column:
    """A row-local tree as a boolean column that is never null."""
    if tree.op in ("and", "or"):
        a, b = map(predicate, tree.args)
        return a & b if tree.op == "and" else a | b
    if tree.op == "not":
        return ~predicate(tree.args[0])
    return F.coalesce(_test(tree), F.lit(False))


def _test(tree: Node) -> Column:
    op, args = tree.op, tree.args
    if op in ("all", "none"):
        return F.lit(op == "all")
    if op == "chain":
        return F.col("chain").isin(*args)
    if op in ("resn", "name", "element"):
        return F.upper(op).isin(*(x.upper() for x in args))
    if op == "resi":
        found = F.lit(False)
        for lo, hi in args:
            found = found | F.col("resi").between(lo, hi)
        return found
    if op == "model":
        return F.col("model") == args[0]
    if op == "ss":
        return F.col("ss") == args[0]
    if op == "bfactor":
        sign, v = args
        c = F.col("b_factor")
        return {"<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v, "=": c == v, "==": c == v}[sign]
    return {"protein": roles.standard, "nucleic": roles.nucleic, "water": roles.water, "metal": roles.metal, "hetatm": lambda: F.col("is_hetatm"), "ligand": roles.ligand}[op]()


def compile_rows(tree: Node, atoms: DataFrame, scale: float = 1.0) -> DataFrame:
    """The selected rows of ``atoms`` (sid and atom_idx are the key)."""
    if is_local(tree):
        return atoms.where(predicate(tree))
    op, args = tree.op, tree.args
    if op == "and":
        first, second = sorted(args, key=lambda x: not is_local(x))  # cheap tests first
        return compile_rows(first, atoms, scale).join(compile_rows(second, atoms, scale).select("sid", "atom_idx"), ["sid", "atom_idx"], "left_semi")
    if op == "or":
        keys = compile_rows(args[0], atoms, scale).select("sid", "atom_idx").union(compile_rows(args[1], atoms, scale).select("sid", "atom_idx")).distinct()
        return atoms.join(keys, ["sid", "atom_idx"], "left_semi")
    if op == "not":
        return atoms.join(compile_rows(args[0], atoms, scale).select("sid", "atom_idx"), ["sid", "atom_idx"], "left_anti")
    if op == "byres":
        seed = compile_rows(args[0], atoms, scale)
        keys = seed.select(F.col("sid").alias("r_sid"), *(F.col(c).alias(f"r_{c}") for c in residues.KEY)).distinct()
        return residues.key_join(atoms, keys, "left_semi")
    far, seed = args
    return spatial.radius_semi_join(atoms, compile_rows(seed, atoms, scale), far, scale)


def select(query: str, atoms: DataFrame, scale: float = 1.0) -> DataFrame:
    return compile_rows(parse(query), atoms, scale)


def select_some(query: str, atoms: DataFrame, scale: float = 1.0) -> DataFrame:
    """``select``, but selecting nothing is an error."""
    found = select(query, atoms, scale)
    if found.isEmpty():
        raise SelectionError(f"selection {query!r} has no atoms")
    return found


def ligand_query(code: str) -> str:
    return f"resn {code}"
