"""Byte automata: regular expressions by subset construction and minimisation into transition arrays."""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as op
from re import _parser

import numpy as np

#: bytes scanned side by side in one array step
LANES = 2048


class _Nfa:
    """Thompson construction; ``edges[s]`` holds (set of bytes, target), ``free[s]`` the moves without input."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.free) - 1

    def add(self, tree, at: int, fold: bool = False) -> int:
        """Append the language of a parse tree after state ``at`` and return the state behind it."""
        for kind, arg in tree:
            if kind is op.LITERAL:
                for byte in chr(arg).encode():
                    at = self._step(at, self._cases({byte}, fold))
            elif kind is op.IN:
                at = self._step(at, self._cases(self._members(arg), fold))
            elif kind is op.BRANCH:
                out = self.state()
                for branch in arg[1]:
                    self.free[self.add(branch, at, fold)].append(out)
                at = out
            elif kind is op.SUBPATTERN:
                flags = arg[1]
                at = self.add(arg[3], at, fold or bool(flags & _parser.SRE_FLAG_IGNORECASE))
            elif kind is op.MAX_REPEAT:
                least, most, body = arg
                for _ in range(least):
                    at = self.add(body, at, fold)
                if most == op.MAXREPEAT:
                    loop, out = self.state(), self.state()
                    self.free[at].append(loop)
                    self.free[self.add(body, loop, fold)].append(loop)
                    self.free[loop].append(out)
                    at = out
                else:
                    out = self.state()
                    for _ in range(most - least):
                        self.free[at].append(out)
                        at = self.add(body, at, fold)
                    self.free[at].append(out)
                    at = out
            else:
                raise ValueError(f"a rule may not hold {kind}")
        return at

    def _step(self, at: int, members: frozenset[int]) -> int:
        out = self.state()
        self.edges[at].append((members, out))
        return out

    @staticmethod
    def _members(items) -> set[int]:
        found, negate = set(), False
        for kind, arg in items:
            if kind is op.NEGATE:
                negate = True
            elif kind is op.LITERAL:
                found.add(arg)
            elif kind is op.RANGE:
                found |= set(range(arg[0], arg[1] + 1))
            else:
                raise ValueError(f"a class of a rule may not hold {kind}")
        if negate or max(found) > 127:
            raise ValueError("a class of a rule lists ASCII characters")
        return found

    @staticmethod
    def _cases(members: set[int], fold: bool) -> frozenset[int]:
        """ASCII letters in either case where the rule says so; no other case folding."""
        if fold:
            members = members | {b ^ 32 for b in members if 65 <= b & ~32 <= 90}
        return frozenset(members)

    def reach(self, states) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


@dataclass
class Automaton:
    """``table[state * classes + byte_class[b]]`` is the next state, already times ``classes``; ``accepts`` by state."""

    table: np.ndarray
    byte_class: np.ndarray
    classes: int
    accepts: np.ndarray
    dead: int

    def longest(self, data: bytes, at: int, stop: int, step: int = 1) -> int | None:
        """Furthest position at which a run from ``at`` towards ``stop`` is accepted."""
        state, best = 0, at if self.accepts[0] else None
        table, kinds, n = self.table, self.byte_class, self.classes
        while at != stop:
            state = int(table[state + kinds[data[at if step > 0 else at - 1]]])
            if state == self.dead:
                break
            at += step
            if self.accepts[state // n]:
                best = at
        return best

    def states(self, symbols: np.ndarray) -> np.ndarray:
        """State after every symbol (byte classes), computed in lanes that are mended where they join.

        The result has the lanes as columns, each a stretch of the input, padded with the reset symbol.
        """
        steps = -(-len(symbols) // LANES)
        padded = np.full(steps * LANES, self.classes - 1, np.int32)
        padded[:len(symbols)] = symbols
        grid = np.ascontiguousarray(padded.reshape(LANES, steps).T)
        out = np.empty((steps, LANES), np.int32)
        state = np.zeros(LANES, np.int32)
        for i in range(steps):
            state = self.table[state + grid[i]]
            out[i] = state
        lanes = np.flatnonzero(out[-1, :-1]) + 1 if steps else np.zeros(0, int)
        while len(lanes):
            state, active, ends = out[-1, lanes - 1].copy(), lanes, []
            for i in range(steps):
                state = self.table[state + grid[i, active]]
                differs = state != out[i, active]
                if not differs.all():
                    active, state = active[differs], state[differs]
                    if not len(active):
                        break
                out[i, active] = state
            else:
                ends = active
            lanes = np.array([x + 1 for x in ends if x + 1 < LANES], int)
        return out


def compile_rules(patterns: list[str], search: bool = False, backwards: bool = False) -> Automaton:
    """Minimal automaton of the union of ``patterns``; ``accepts`` holds a bit for each pattern.

    ``search`` lets a match begin anywhere and adds a reset symbol (the last class) that leads to the start.
    ``backwards`` reads the text from the end of a match to its beginning.
    """
    nfa, starts, finals = _Nfa(), [], {}
    for k, pattern in enumerate(patterns):
        begin = nfa.state()
        end = nfa.add(_parser.parse(pattern), begin)
        starts.append(begin)
        finals[end] = k
    if backwards:
        nfa, starts, finals = _reversed(nfa, starts, finals)
    sets = {m for edges in nfa.edges for m, _ in edges}
    mark = [tuple(b in m for m in sets) for b in range(256)]
    groups = {g: i for i, g in enumerate(dict.fromkeys(mark))}
    byte_class = np.array([groups[m] for m in mark], np.int32)
    sample = [mark.index(g) for g in groups]
    begin = nfa.reach(starts)
    number, order, rows = {begin: 0}, [begin], []
    for current in order:
        row = []
        for byte in sample:
            after = {t for s in current for m, t in nfa.edges[s] if byte in m}
            target = nfa.reach(after) | (begin if search else frozenset())
            if target not in number:
                number[target] = len(order)
                order.append(target)
            row.append(number[target])
        rows.append(row + [0] * search)
    accepts = np.array([sum({1 << finals[s] for s in states if s in finals}) for states in order], np.int64)
    return _minimised(np.array(rows, np.int64), accepts, byte_class)


def _reversed(nfa: _Nfa, starts: list[int], finals: dict[int, int]) -> tuple[_Nfa, list[int], dict[int, int]]:
    back = _Nfa()
    for _ in nfa.free:
        back.state()
    for s, edges in enumerate(nfa.edges):
        for members, t in edges:
            back.edges[t].append((members, s))
        for t in nfa.free[s]:
            back.free[t].append(s)
    return back, list(finals), {s: k for k, s in enumerate(starts)}


def _minimised(table: np.ndarray, accepts: np.ndarray, byte_class: np.ndarray) -> Automaton:
    """Merge states that no input tells apart, by refining the partition until it stands."""
    block = np.unique(accepts, return_inverse=True)[1]
    while True:
        signature = np.column_stack([block, block[table]])
        finer = np.unique(signature, axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    first = np.full(block.max() + 1, -1)
    for s in range(len(block) - 1, -1, -1):
        first[block[s]] = s
    # the start state is number 0
    names = np.argsort(np.argsort(np.where(np.arange(len(first)) == block[0], -1, first), kind="stable"), kind="stable")
    rows = np.empty((len(first), table.shape[1]), np.int32)
    kept = np.empty(len(first), np.int64)
    for b, s in enumerate(first):
        rows[names[b]] = names[block[table[s]]]
        kept[names[b]] = accepts[s]
    n = table.shape[1]
    sinks = [s for s in range(len(rows)) if not kept[s] and (rows[s] == s).all()]
    return Automaton((rows * n).ravel().astype(np.int32), byte_class, n, kept, sinks[0] * n if sinks else -1)
