"""Regular expressions compiled to one minimal deterministic automaton over bytes, held as transition arrays."""

from __future__ import annotations

import re._parser as parser
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np

Moves = list[tuple[frozenset[int], int]]


class Automaton(NamedTuple):
    """next[state, byte]; accepts[state, rule]; state 0 starts, `dead` (or -1) is the state that accepts nothing."""

    next: np.ndarray
    accepts: np.ndarray
    dead: int


class _Nfa:
    """Thompson construction from Python's parsed patterns: literals, classes, groups, alternatives, greedy repeats."""

    def __init__(self) -> None:
        self.moves: list[Moves] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def step(self, at: int, bytes_: frozenset[int]) -> int:
        out = self.state()
        self.moves[at].append((bytes_, out))
        return out

    def add(self, tree, at: int) -> int:
        for op, value in tree:
            at = self.node(str(op), value, at)
        return at

    def node(self, op: str, value, at: int) -> int:
        if op == "LITERAL":
            return self.step(at, frozenset([value]))
        if op == "IN":
            return self.step(at, _members(value))
        if op == "ANY":
            return self.step(at, frozenset(range(256)))
        if op == "SUBPATTERN":
            return self.add(value[3], at)
        if op == "BRANCH":
            out = self.state()
            for arm in value[1]:
                start = self.state()
                self.free[at].append(start)
                self.free[self.add(arm, start)].append(out)
            return out
        if op == "MAX_REPEAT":
            least, most, tree = value
            for _ in range(least):
                at = self.add(tree, at)
            out = self.state()
            if most is parser.MAXREPEAT:
                loop = self.state()
                self.free[at].append(loop)
                self.free[self.add(tree, loop)].append(loop)
                self.free[loop].append(out)
                return out
            for _ in range(most - least):
                self.free[at].append(out)
                at = self.add(tree, at)
            self.free[at].append(out)
            return out
        raise ValueError(f"unsupported in a rule: {op}")


def _members(items) -> frozenset[int]:
    found: set[int] = set()
    negated = False
    for op, value in items:
        if str(op) == "NEGATE":
            negated = True
        elif str(op) == "LITERAL":
            found.add(value)
        elif str(op) == "RANGE":
            found.update(range(value[0], value[1] + 1))
        else:
            raise ValueError(f"unsupported in a class: {op}")
    return frozenset(range(256)) - found if negated else frozenset(found)


def compile_rules(patterns: Sequence[str], anywhere: bool = False) -> Automaton:
    """One automaton for all rules. `anywhere` also follows matches that start later, so it finds where matches end."""
    nfa = _Nfa()
    start = nfa.state()
    if anywhere:
        nfa.moves[start].append((frozenset(range(256)), start))
    final = {}
    for rule, pattern in enumerate(patterns):
        own = nfa.state()
        nfa.free[start].append(own)
        final[nfa.add(parser.parse(pattern.encode("latin-1")), own)] = rule

    def closed(states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in nfa.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    first = closed({start})
    number, rows, todo = {first: 0}, [], [first]
    for subset in todo:  # grows while it is read
        goes: list[set[int]] = [set() for _ in range(256)]
        for s in subset:
            for members, to in nfa.moves[s]:
                for b in members:
                    goes[b].add(to)
        row, known = np.zeros(256, np.int64), {}
        for b, states in enumerate(goes):
            key = frozenset(states)
            if key not in known:
                known[key] = closed(states)
                if known[key] not in number:
                    number[known[key]] = len(number)
                    todo.append(known[key])
            row[b] = number[known[key]]
        rows.append(row)
    accepts = np.zeros((len(rows), len(patterns)), bool)
    for subset, i in number.items():
        for s in subset & final.keys():
            accepts[i, final[s]] = True
    return _minimal(np.stack(rows), accepts)


def _minimal(moves: np.ndarray, accepts: np.ndarray) -> Automaton:
    """Moore's partition refinement: states stay together while their rules and all their moves agree."""
    block = np.unique(accepts, axis=0, return_inverse=True)[1].ravel()
    while True:
        finer = np.unique(np.column_stack([block, block[moves]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    order = np.full(block.max() + 1, -1)
    for b in block:  # state 0 first
        if order[b] < 0:
            order[b] = order.max() + 1
    block = order[block]
    one = np.zeros(block.max() + 1, np.int64)
    one[block] = np.arange(len(block))
    table, accepting = block[moves[one]].astype(np.int32), accepts[one]
    dead = np.flatnonzero((table == np.arange(len(table))[:, None]).all(1) & ~accepting.any(1))
    return Automaton(table, accepting, int(dead[0]) if len(dead) else -1)
