"""Weighted acyclic automata that map sequences of words to counts.

A path's weights and the weight of the state where it ends add up to its count. Automata are built
from sorted sequences: a state is closed once no later sequence can pass it, its least weight moves
to the arc that leads to it, and a state that equals a closed one is that one. So automata are
deterministic and minimal, and sequences share beginnings and endings.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np

Key = tuple[bytes, ...]
NOT_FINAL = -1
#: the state where sequences end and none goes on
ENDING = (0, (), (), ())


class Automaton:
    """States (final weight or -1, labels, weights, targets) with arcs in the order of their labels."""

    def __init__(self, states: list[tuple[int, tuple, tuple, tuple]], root: int, initial: int):
        self.states, self.root, self.initial = states, root, initial

    def items(self) -> Iterator[tuple[Key, int]]:
        """All sequences in order with their counts."""

        def walk(state: int, key: Key, weight: int) -> Iterator[tuple[Key, int]]:
            final, labels, weights, targets = self.states[state]
            if final != NOT_FINAL:
                yield key, weight + final
            for label, more, target in zip(labels, weights, targets):
                yield from walk(target, (*key, label), weight + more)

        yield from walk(self.root, (), self.initial)

    def add_to(self, total: dict[Key, int]) -> None:
        """Add the counts of all sequences, in any order."""
        left = [(self.root, (), self.initial)]
        while left:
            state, key, weight = left.pop()
            final, labels, weights, targets = self.states[state]
            if final != NOT_FINAL:
                total[key] = total.get(key, 0) + weight + final
            for label, more, target in zip(labels, weights, targets):
                longer = (*key, label)
                if self.states[target] == ENDING:
                    total[longer] = total.get(longer, 0) + weight + more
                else:
                    left.append((target, longer, weight + more))

    def compose(self, asked: Automaton) -> Iterator[tuple[Key, int]]:
        """The sequences of ``asked`` that this automaton holds, with its counts: both are walked at once."""
        arcs: dict[int, dict] = {}

        def walk(state: int, other: int, key: Key, weight: int) -> Iterator[tuple[Key, int]]:
            final, labels, weights, targets = self.states[state]
            if final != NOT_FINAL and asked.states[other][0] != NOT_FINAL:
                yield key, weight + final
            if state not in arcs:
                arcs[state] = dict(zip(labels, zip(weights, targets)))
            for label, target in zip(asked.states[other][1], asked.states[other][3]):
                if label in arcs[state]:
                    more, here = arcs[state][label]
                    yield from walk(here, target, (*key, label), weight + more)

        yield from walk(self.root, asked.root, (), self.initial)

    def to_bytes(self) -> bytes:
        words: dict[bytes, int] = {}
        labels = [words.setdefault(label, len(words)) for state in self.states for label in state[1]]
        parts = [
            np.array([state[0] for state in self.states], dtype="<i8"),
            np.array([len(state[1]) for state in self.states], dtype="<i4"),
            np.array(labels, dtype="<i4"),
            np.array([weight for state in self.states for weight in state[2]], dtype="<i8"),
            np.array([target for state in self.states for target in state[3]], dtype="<i4"),
            np.array([len(word) for word in words], dtype="<i4"),
        ]
        head = struct.pack("<qqqqq", len(self.states), len(labels), len(words), self.root, self.initial)
        return b"".join([head, *(part.tobytes() for part in parts), *words])

    @classmethod
    def from_bytes(cls, blob: bytes) -> Automaton:
        n_states, n_arcs, n_words, root, initial = struct.unpack_from("<qqqqq", blob)
        at, columns = 40, []
        for kind, size in (("<i8", n_states), ("<i4", n_states), ("<i4", n_arcs), ("<i8", n_arcs), ("<i4", n_arcs), ("<i4", n_words)):
            columns.append(np.frombuffer(blob, dtype=kind, count=size, offset=at))
            at += columns[-1].nbytes
        final, arcs, labels, weights, targets, lengths = columns
        ends = (at + np.cumsum(lengths, dtype=np.int64)).tolist()
        words = [bytes(blob[end - size : end]) for end, size in zip(ends, lengths.tolist())]
        labels, weights, targets = [words[i] for i in labels.tolist()], weights.tolist(), targets.tolist()
        states, place = [], 0
        for weight, size in zip(final.tolist(), arcs.tolist()):
            arc = slice(place, place + size)
            states.append((weight, tuple(labels[arc]), tuple(weights[arc]), tuple(targets[arc])))
            place += size
        return cls(states, root, initial)


def build(items: Iterable[tuple[Key, int]]) -> Automaton:
    """The automaton of distinct sequences in ascending order, with counts of 0 or more."""
    states: list[tuple] = []
    known: dict[tuple, int] = {}
    # the states on the way to the last label of the sequence before, whose count waits: most sequences end without arcs
    path: list[list] = [[NOT_FINAL, [], [], []]]
    before: Key = ()
    waiting = ending = NOT_FINAL

    def close(node: list) -> tuple[int, int]:
        final, labels, weights, targets = node
        least = min(weights) if weights else final
        if final != NOT_FINAL:
            least = min(least, final)
            final -= least
        state = (final, tuple(labels), tuple([w - least for w in weights]), tuple(targets))
        number = known.get(state)
        if number is None:
            number = known[state] = len(states)
            states.append(state)
        return number, least

    def shorten(depth: int) -> None:
        """End the sequence before where nothing goes on and close the states that no later one can pass."""
        nonlocal ending
        if ending == NOT_FINAL:
            ending = len(states)
            states.append(ENDING)
        path[-1][2].append(waiting)
        path[-1][3].append(ending)
        while len(path) > depth + 1:
            number, least = close(path.pop())
            path[-1][2].append(least)
            path[-1][3].append(number)

    for key, weight in items:
        if not key:
            path[0][0] = weight
            continue
        shared = 0
        for a, b in zip(key, before):
            if a != b:
                break
            shared += 1
        if shared < len(before):
            shorten(shared)
        elif before:
            path.append([waiting, [], [], []])
        for label in key[shared:-1]:
            path[-1][1].append(label)
            path.append([NOT_FINAL, [], [], []])
        path[-1][1].append(key[-1])
        waiting, before = weight, key
    if before:
        shorten(0)
    if path[0][0] == NOT_FINAL and not path[0][1]:
        return Automaton([(NOT_FINAL, (), (), ())], 0, 0)
    root, initial = close(path[0])
    return Automaton(states, root, initial)


def union(automata: Iterable[Automaton], least: int = 0, order: Callable[[Key], bytes] | None = None) -> Automaton:
    """Counts of a sequence in all automata added up; those below ``least`` left out.

    The automata are taken one by one. ``order`` may give a key that sorts as the sequences do and is quicker to
    compare. Callers bound what one holds.
    """
    total: dict[Key, int] = {}
    for automaton in automata:
        automaton.add_to(total)
    return build((key, total[key]) for key in sorted((k for k, n in total.items() if n >= least), key=order))
