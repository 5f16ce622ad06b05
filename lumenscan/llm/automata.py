"""Minimised acceptors of finite word sets, and their composition with a transducer of one edit.

States are numbered as they are found to be new, so the targets of a state's arcs have smaller
numbers than itself; whatever is computed for targets first needs no recursion, however long the
words are.
"""

from __future__ import annotations

from collections.abc import Iterable

Pairs = list[tuple[int, int]]


class Acceptor:
    """The smallest acyclic automaton of one or several sorted word lists.

    Equal right languages share a state, over all lists. ``arcs`` has the label, target and rank
    of each arc of a state: the rank is the number of words from that state that come before those
    behind the arc, so the ranks along a path add up to the word's place in its list.
    """

    def __init__(self) -> None:
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.size: list[int] = []
        self._known: dict[tuple, int] = {}

    def _state(self, final: bool, arcs: list[tuple[str, int]]) -> int:
        key = (final, *arcs)
        found = self._known.get(key)
        if found is None:
            found = self._known[key] = len(self.arcs)
            rank, ranked = int(final), {}
            for label, target in arcs:
                ranked[label] = (target, rank)
                rank += self.size[target]
            self.arcs.append(ranked)
            self.final.append(final)
            self.size.append(rank)
        return found

    def start(self, words: Iterable[str]) -> int:
        """The initial state of ``words``, which are sorted and distinct."""
        path: list[tuple[bool, list[tuple[str, int]]]] = [(False, [])]  # states that may still get arcs
        last = ""
        for word in words:
            shared = 0
            while shared < min(len(word), len(last)) and word[shared] == last[shared]:
                shared += 1
            self._settle(path, last, shared)
            path += [(False, []) for _ in word[shared:]]
            path[-1] = (True, path[-1][1])
            last = word
        self._settle(path, last, 0)
        return self._state(*path[0])

    def _settle(self, path: list, last: str, upto: int) -> None:
        while len(path) > upto + 1:
            state = self._state(*path.pop())
            path[-1][1].append((last[len(path) - 1], state))


def _agreeing(acceptor: Acceptor, asked: Iterable[tuple[int, int]]) -> dict[tuple[int, int], Pairs]:
    """Of every two states ``asked`` and all they lead to, the ranks of the words that both accept; none is left out."""
    arcs, final = acceptor.arcs, acceptor.final
    todo, seen = list(asked), set()
    while todo:
        pair = todo.pop()
        if pair in seen or pair[0] == pair[1]:
            continue
        seen.add(pair)
        one, other = arcs[pair[0]], arcs[pair[1]]
        todo += [(one[a][0], other[a][0]) for a in one.keys() & other.keys()]
    out: dict[tuple[int, int], Pairs] = {}
    for pair in sorted(seen):  # targets first
        one, other = arcs[pair[0]], arcs[pair[1]]
        found: Pairs = [(0, 0)] if final[pair[0]] and final[pair[1]] else []
        for a in one.keys() & other.keys():
            (x, i), (y, j) = one[a], other[a]
            if x == y:
                found += [(i + r, j + r) for r in range(acceptor.size[x])]
            else:
                found += [(i + p, j + q) for p, q in out.get((x, y), ())]
        if found:
            out[pair] = found
    return out


def one_edit_pairs(acceptor: Acceptor) -> list[Pairs]:
    """For every state, the ranks (i, j) of the words from it that are one edit apart, each two words once.

    This is the composition of the acceptor, a transducer that changes, inserts or deletes one
    symbol, and the acceptor again. The transducer is deterministic: it copies as long as both
    words agree and edits where they first differ, so each pair has one path. Before the edit both
    words are in the same state, so the composed machine has a state (q, q) for each q there; behind
    it the words must agree to the end, from two states that ``_agreeing`` follows once, however
    many prefixes and lists lead to them. Deleting is inserting seen from the other word.
    """
    arcs, final = acceptor.arcs, acceptor.final
    edits: list[list[tuple[int, int, int, int]]] = []
    for q, leaving in enumerate(arcs):
        here = list(leaving.items())
        mine = []
        for nth, (a, (x, i)) in enumerate(here):
            mine += [(x, y, i, j) for _, (y, j) in here[nth + 1 :]]  # a is changed to a later label
            for b, (y, j) in arcs[x].items():  # a is inserted: the word without it goes on with b
                if b != a and b in leaving:
                    mine.append((leaving[b][0], y, leaving[b][1], i + j))
        edits.append(mine)
    agreeing = _agreeing(acceptor, ((x, y) for mine in edits for x, y, _, _ in mine))
    out: list[Pairs] = []
    for q, mine in enumerate(edits):
        found: Pairs = []
        for x, y, i, j in mine:
            if x == y:
                found += [(i + r, j + r) for r in range(acceptor.size[x])]
            else:
                found += [(i + p, j + r) for p, r in agreeing.get((x, y), ())]
        for x, i in arcs[q].values():
            if final[q] and final[x]:  # inserted at the end
                found.append((0, i))
            found += [(i + p, i + r) for p, r in out[x]]
        out.append(found)
    return out
