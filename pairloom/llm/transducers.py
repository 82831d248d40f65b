"""Weighted finite-state transducers over the tropical semiring: path weights add up, the least one counts.

A machine has a start state; arcs(state, label) - tuples (output labels, weight, next state) for an input label, or for
EPSILON without reading one; final(state) - the weight of ending there, or None; and moves(labels, at, state) - tuples
(place after, output labels, weight, next state): its composition with an input, as far as one move goes, those that read most first. An acceptor whose state is the label it
read last may have weigh(state, label) for the weight of its only arc. Machines are
written out (Table, Lexicon) or compute arcs as they are asked for, and a composition is only explored where a shortest
path goes.
"""

from __future__ import annotations

from heapq import heappop, heappush
from itertools import chain

EPSILON = None
#: The input label of an arc for every label that has no arc of its own there; as an output label, the label read.
REST = object()


class Machine:
    start = 0

    def arcs(self, state, label):
        raise NotImplementedError

    def final(self, state) -> float | None:
        return 0.0

    def moves(self, labels, at: int, state):
        out = [(at, *arc) for arc in self.arcs(state, EPSILON)]
        return out + [(at + 1, *arc) for arc in self.arcs(state, labels[at])] if at < len(labels) else out


class Table(Machine):
    """A machine whose arcs are written out."""

    def __init__(self, start: int = 0):
        self.start, self.rows, self.ends = start, {}, {}

    def arc(self, state: int, label, outputs: tuple, weight: float, to: int) -> None:
        self.rows.setdefault(state, {}).setdefault(label, []).append((outputs, weight, to))

    def end(self, state: int, weight: float = 0.0) -> None:
        self.ends[state] = weight

    def arcs(self, state, label):
        own = self.rows.get(state, {})
        if label in own or label is EPSILON:
            return own.get(label, [])
        return [(tuple(label if o is REST else o for o in outputs), weight, to) for outputs, weight, to in own.get(REST, [])]

    def final(self, state):
        return self.ends.get(state)


class Lexicon(Machine):
    """Sequences of pieces: reads their labels along a trie and writes a piece at its end. A label that is no piece is
    written by `fallback` (label to outputs and weight).

    State 0 lies between pieces, BEGIN before any. A move reads a whole piece: the trie's inner states have no arc
    but to their own next labels, so the epsilon arcs that write pieces are removed.
    """

    BEGIN = 1

    def __init__(self, pieces: dict[str, tuple[int, float]], fallback):
        self.start, self.fallback, self.lead = self.BEGIN, fallback, ""
        self.next: list[dict[str, int]] = [{}]
        self.piece: list[tuple | None] = [None]
        for text, (number, weight) in pieces.items():
            at = 0
            for c in text:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.piece.append(None)
                at = to
            self.piece[at] = ((number,), weight, 0)

    def after(self, first: Table) -> Lexicon:
        """The composition of a machine with this one, written out.

        The machine may write one label before it reads, and then stays in a state that writes one label for each.
        """
        (lead, weight, inside), *others = first.arcs(first.start, EPSILON)
        row = first.rows[inside]
        if others or weight or len(lead) > 1 or any(len(o) != 1 or w or to != inside for arcs in row.values() for o, w, to in arcs) or any(len(arcs) != 1 for arcs in row.values()):
            raise ValueError("the machine to compose with may only rewrite label by label")
        written = {x: arcs[0][0][0] for x, arcs in row.items() if x is not REST}
        out = Lexicon({}, lambda label: self.fallback(written.get(label, label)))
        out.piece, out.lead = self.piece, "".join(lead)
        out.next = [{**{y: to for y, to in own.items() if y not in written}, **{x: own[y] for x, y in written.items() if y in own}} for own in self.next]
        # the lead is written, not read: no rewriting applies to it
        out._lead = self
        return out

    def arcs(self, state, label):
        raise NotImplementedError("a lexicon moves by whole pieces")

    def moves(self, labels, at, state):
        nexts, piece, n = self.next, self.piece, len(labels)
        out, node, i = [], 0, at
        if state:
            return self._begin(labels)
        while i < n:
            node = nexts[node].get(labels[i])
            if node is None:
                break
            i += 1
            found = piece[node]
            if found is not None:
                out.append((i, *found))
        single = bool(out) and out[0][0] == at + 1
        if not single and at < n:
            out.insert(0, (at + 1, *self.fallback(labels[at]), 0))
        out.reverse()
        return out

    def _begin(self, labels):
        """Moves over the lead and what follows it."""
        if not self.lead:
            return self.moves(labels, 0, 0)
        held, lead = [], self.lead
        for _, outputs, weight, _ in self._lead.moves(lead, 0, 0):
            held.append((0, outputs, weight, 0))
        node = 0
        for c in lead:
            node = self._lead.next[node].get(c)
            if node is None:
                return held
        for i, c in enumerate(labels):
            node = self.next[node].get(c)
            if node is None:
                break
            if self.piece[node] is not None:
                held.append((i + 1, *self.piece[node]))
        held.reverse()
        return held

    def final(self, state):
        return None if state else 0.0


class Composed(Machine):
    """The relation of two machines, one after the other: the first one's outputs are the second one's input."""

    def __init__(self, first, second):
        self.first, self.second, self.start = first, second, (first.start, second.start)

    def arcs(self, state, label):
        a, b = state
        out = [(o, weight + w, (to, end)) for outputs, weight, to in self.first.arcs(a, label) for o, w, end in self._fed(b, outputs)]
        return out + [(o, w, (a, end)) for o, w, end in self.second.arcs(b, EPSILON)] if label is EPSILON else out

    def moves(self, labels, at, state):
        a, b = state
        second = self.second
        weigh = getattr(second, "weigh", None)
        for place, outputs, weight, to in self.first.moves(labels, at, a):
            if weigh is not None and len(outputs) == 1:
                yield place, outputs, weight + weigh(b, outputs[0]), (to, outputs[0])
            else:
                for o, w, end in self._fed(b, outputs):
                    yield place, o, weight + w, (to, end)
        for o, w, end in second.arcs(b, EPSILON):
            yield at, o, w, (a, end)

    def _fed(self, state, labels: tuple):
        """All ways of the second machine through several labels, with its own epsilon arcs between them."""
        held = [((), 0.0, state)]
        for k, label in enumerate(labels):
            if k:
                at = 0
                while at < len(held):
                    o, w, s = held[at]
                    held += [(o + o2, w + w2, s2) for o2, w2, s2 in self.second.arcs(s, EPSILON)]
                    at += 1
            held = [(o + o2, w + w2, s2) for o, w, s in held for o2, w2, s2 in self.second.arcs(s, label)]
        return held

    def final(self, state):
        a, b = self.first.final(state[0]), self.second.final(state[1])
        return None if a is None or b is None else a + b


def shortest_path(machine: Machine, labels, start=None) -> tuple[tuple, float] | None:
    """Outputs and weight of the lightest path that reads all labels; None without one. Weights must not be negative.

    The lightest place goes on first, of equally light ones that which has read most. A place's moves are made one at a
    time, so arcs behind a path without weight are never weighed.
    """
    n = len(labels)
    weight, place, moves, count = 0.0, (0, machine.start if start is None else start), None, 0
    best, came, heap, end = {place: 0.0}, {}, [], (n + 1, None)
    while True:
        if place == end:
            out = []
            while place in came:
                place, outputs = came[place]
                out.append(outputs)
            return tuple([x for outputs in reversed(out) for x in outputs]), weight
        at, state = place
        if moves is None:
            moves = iter(machine.moves(labels, at, state))
            if at == n and (last := machine.final(state)) is not None:
                moves = chain(((n + 1, (), last, None),), moves)
        for to, outputs, more, after in moves:
            new, total = (to, after), weight + more
            old = best.get(new)
            if old is not None and (old < total or old == total and not (new in came and at < came[new][0][0])):
                continue
            came[new] = (place, outputs)
            if old == total:
                continue
            best[new] = total
            count += 1
            if not more:
                # no place is lighter: it goes on now, and the other moves wait
                heappush(heap, (weight, n - at, count, place, moves))
                place, moves = new, None
                break
            heappush(heap, (total, n - to, count, new, None))
        else:
            while heap:
                weight, _, _, place, moves = heappop(heap)
                if weight <= best[place]:
                    break
            else:
                return None
