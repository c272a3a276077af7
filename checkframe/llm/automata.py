"""Probabilistic automata of credential formats, inferred by merging states.

The labelled texts of a format form a prefix tree with counts.  States are visited from
the root; a state is merged into one that was kept before if the two are statistically
compatible: the shares in which texts end or go on with each character differ by no more
than Hoeffding's bound allows, and so for every state below them.  What is merged is
folded, so the automaton stays deterministic.  States that are compatible with none are
kept as their own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

#: Characters that a format may hold; each state also keeps a little room for those it has not seen.
SYMBOLS = 96
#: Chance of calling two alike states different.
ALPHA = 0.05
#: Weight of the unseen in each state, in texts.
UNSEEN = 0.5


@dataclass
class _State:
    total: int = 0
    ends: int = 0
    next: dict[str, _State] = field(default_factory=dict)
    #: texts that went on with each character
    went: dict[str, int] = field(default_factory=dict)


def _prefix_tree(texts: list[str]) -> _State:
    root = _State()
    for text in texts:
        at = root
        at.total += 1
        for c in text:
            at.went[c] = at.went.get(c, 0) + 1
            at = at.next.setdefault(c, _State())
            at.total += 1
        at.ends += 1
    return root


def _differ(f1: int, n1: int, f2: int, n2: int, bound: float) -> bool:
    return abs(f1 / n1 - f2 / n2) > bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))


def compatible(a: _State, b: _State, alpha: float = ALPHA) -> bool:
    """Whether the two states, and all below them, may be one."""
    bound = math.sqrt(0.5 * math.log(2 / alpha))
    open_ = [(a, b)]
    while open_:
        a, b = open_.pop()
        if bound * (1 / math.sqrt(a.total) + 1 / math.sqrt(b.total)) >= 1:
            continue  # no difference would count, here or below
        if _differ(a.ends, a.total, b.ends, b.total, bound):
            return False
        for c in a.went.keys() | b.went.keys():
            if _differ(a.went.get(c, 0), a.total, b.went.get(c, 0), b.total, bound):
                return False
            if c in a.next and c in b.next:
                open_.append((a.next[c], b.next[c]))
    return True


def _likelihood(known: _State, state: _State) -> float:
    """Log-likelihood of what ``state`` saw next, as ``known`` has seen it."""
    room, share = known.total + UNSEEN, UNSEEN / (SYMBOLS + 1)
    return sum(n * math.log((known.went.get(c, 0) + share) / room) for c, n in state.went.items()) + state.ends * math.log((known.ends + share) / room)


def _fold(into: _State, tree: _State) -> None:
    """Adds a tree's counts to the state; the tree is used up."""
    open_ = [(into, tree)]
    while open_:
        a, b = open_.pop()
        a.total += b.total
        a.ends += b.ends
        for c, n in b.went.items():
            a.went[c] = a.went.get(c, 0) + n
        for c, below in b.next.items():
            if c in a.next:
                open_.append((a.next[c], below))
            else:
                a.next[c] = below


@dataclass(frozen=True)
class Automaton:
    """States by number, the first being the start; state -1 has seen nothing."""

    #: for each state, the log-probability and target of each character
    steps: tuple[dict[str, tuple[float, int]], ...]
    end: tuple[float, ...]
    #: log-probability of a character that a state has not seen
    unseen: tuple[float, ...]

    def log_probability(self, text: str) -> float:
        """Natural log of the probability that the automaton writes ``text``."""
        flat = -math.log(SYMBOLS + 1)
        if not self.steps:
            return flat * (len(text) + 1)
        at, out = 0, 0.0
        for k, c in enumerate(text):
            step = self.steps[at].get(c)
            if step is None:
                return out + self.unseen[at] + flat * (len(text) - k)
            out += step[0]
            at = step[1]
        return out + self.end[at]


def infer(texts: list[str], alpha: float = ALPHA) -> Automaton:
    """The automaton of the given texts, the same for any order of them; with none, every character is as likely."""
    root = _prefix_tree(sorted(texts))
    if not root.total:
        return Automaton((), (), ())
    kept: list[_State] = [root]
    at = {id(root): 0}
    # edges out of kept states whose targets are not settled, by depth, then by path
    open_ = [(0, c) for c in sorted(root.next)]
    while open_:
        later: list[tuple[int, str]] = []
        for source, c in open_:
            state = kept[source].next[c]
            if id(state) in at:
                continue
            alike = [k for k in kept if compatible(k, state, alpha)]
            if alike:
                known = max(alike, key=lambda k: _likelihood(k, state))
                before = {id(s): set(s.next) for s in kept}
                kept[source].next[c] = known
                _fold(known, state)
                later += [(at[id(s)], x) for s in kept for x in sorted(set(s.next) - before[id(s)])]
            else:
                at[id(state)] = len(kept)
                kept.append(state)
                later += [(len(kept) - 1, x) for x in sorted(state.next)]
        open_ = later
    steps, end, unseen = [], [], []
    for s in kept:
        room = s.total + UNSEEN
        share = UNSEEN / (SYMBOLS + 1)
        steps.append({c: (math.log((n + share) / room), at[id(s.next[c])]) for c, n in s.went.items()})
        end.append(math.log((s.ends + share) / room))
        unseen.append(math.log(share / room))
    return Automaton(tuple(steps), tuple(end), tuple(unseen))
