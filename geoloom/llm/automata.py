"""Probabilistic automata of string formats, by merging compatible prefix-tree states."""

from __future__ import annotations

import math
from dataclasses import dataclass, field


@dataclass
class State:
    """passes: strings that reach the state; ends: those that stop there; next: symbol to (state, strings)."""

    passes: int = 0
    ends: int = 0
    next: dict[str, list] = field(default_factory=dict)


@dataclass
class Automaton:
    """A deterministic probabilistic automaton; state 0 is the start.  ``typical`` is the low end of its own strings' scores."""

    states: list[State]
    symbols: int
    typical: float = 0.0

    def score(self, text: str) -> float:
        """Mean log-likelihood of a character, over that of an even choice of ``symbols``; unseen steps are smoothed and restart."""
        if not text:
            return -math.inf
        total, at, even = 0.0, 0, math.log(self.symbols)
        for c in text:
            s = self.states[at]
            arc = s.next.get(c)
            total += math.log(((arc[1] if arc else 0) + 0.5) / (s.passes + 0.5 * (self.symbols + 1))) + even
            at = arc[0] if arc else 0
        return total / len(text)


def prefix_tree(samples: list[str]) -> list[State]:
    """The tree of all prefixes, with how often each is passed and ended."""
    states = [State()]
    for text in samples:
        at = 0
        states[0].passes += 1
        for c in text:
            arc = states[at].next.get(c)
            if arc is None:
                states.append(State())
                arc = states[at].next[c] = [len(states) - 1, 0]
            arc[1] += 1
            at = arc[0]
            states[at].passes += 1
        states[at].ends += 1
    return states


def differ(f1: int, n1: int, f2: int, n2: int, alpha: float) -> bool:
    """Hoeffding's test: the two frequencies can hardly come from one probability."""
    if not n1 or not n2:
        return False
    return abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))


def compatible(states: list[State], a: int, b: int, alpha: float) -> bool:
    """Whether two states may be one: their ends and steps, and those of the states behind, don't differ."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        x, y = states[a], states[b]
        if differ(x.ends, x.passes, y.ends, y.passes, alpha):
            return False
        for c in x.next.keys() | y.next.keys():
            p, q = x.next.get(c), y.next.get(c)
            if differ(p[1] if p else 0, x.passes, q[1] if q else 0, y.passes, alpha):
                return False
            if p and q:
                todo.append((p[0], q[0]))
    return True


def fold(states: list[State], red: int, blue: int) -> None:
    """Add the tree below ``blue`` to ``red``."""
    todo = [(red, blue)]
    while todo:
        a, b = todo.pop()
        x, y = states[a], states[b]
        x.passes, x.ends = x.passes + y.passes, x.ends + y.ends
        for c, (to, n) in y.next.items():
            if c in x.next:
                x.next[c][1] += n
                todo.append((x.next[c][0], to))
            else:
                x.next[c] = [to, n]


def infer(samples: list[str], alpha: float = 0.05, symbols: int = 66) -> Automaton:
    """The automaton of labelled strings (Carrasco and Oncina's ALERGIA, 1994): merge each frontier state with the first compatible settled one, else settle it."""
    states = prefix_tree(samples)
    red = [0]
    while True:
        settled = set(red)
        frontier = [(states[to].passes, -r, c, r, to) for r in red for c, (to, _) in states[r].next.items() if to not in settled]
        if not frontier:
            break
        _, _, c, r, blue = max(frontier)
        for target in red:
            if compatible(states, target, blue, alpha):
                states[r].next[c][0] = target
                fold(states, target, blue)
                break
        else:
            red.append(blue)
    number = {s: k for k, s in enumerate(red)}
    kept = [State(states[s].passes, states[s].ends, {c: [number[to], n] for c, (to, n) in states[s].next.items()}) for s in red]
    found = Automaton(kept, symbols)
    own = sorted(found.score(s) for s in samples)
    found.typical = own[len(own) // 50] if own else 0.0
    return found
