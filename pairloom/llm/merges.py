"""Byte-pair merges as an automaton over prefixes.

A sequence of pieces is what merging yields exactly if each piece yields itself and each two neighbours, merged on
their own, yield the two again: merges inside a span follow the same order whether or not its surroundings are
there, as long as none of them crosses its ends. So every prefix of a text has one valid last piece, and it is the
piece that is compatible with the valid last piece of the prefix before it. Going through the prefixes once gives
the pieces, and the number of pieces, of all of them.
"""

from __future__ import annotations

from collections.abc import Callable

#: Stands behind the last unit of a word where pieces tell word ends apart.
END = "\U0010ffff"


class Kept(dict):
    """Answers by question, at most about `most` of them: when half are new, those unused since the last time go."""

    def __init__(self, answer: Callable, most: int):
        super().__init__()
        self.answer, self.half, self.old = answer, max(1, most // 2), {}

    def __missing__(self, question):
        found = self.old.pop(question, None)
        if found is None:
            found = self.answer(question)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[question] = found
        return found


class Merges:
    """pieces: text to id (a text may end with END); rank(a, b): the smaller, the earlier two texts merge; None: never."""

    def __init__(self, pieces: dict[str, int], rank: Callable[[str, str], int | None], most_pairs: int = 2_000_000):
        self.rank, self.most_pairs = rank, most_pairs
        self.texts = {i: t for t, i in pieces.items()}
        self.table: dict[str, tuple[int, int]] = {}
        for text, i in pieces.items():
            plain, end = text.removesuffix(END), text.endswith(END)
            for k in range(1, len(plain)):
                self.table.setdefault(plain[:k], (-1, -1))
            old = self.table.get(plain, (-1, -1))
            self.table[plain] = (old[0], i) if end else (i, old[1])
        self.longest = max(map(len, self.table), default=0)
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}

    def merged(self, units: list[str]) -> list[str]:
        """The merges one by one: the earliest rank first, of equal ones the leftmost."""
        parts, rank = list(units), self.rank
        ranks = [rank(a, b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            best, at = None, -1
            for i, r in enumerate(ranks):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank(parts[at - 1], parts[at])
            if at < len(ranks):
                ranks[at] = rank(parts[at], parts[at + 1])

    @staticmethod
    def units(text: str) -> list[str]:
        return [*text[:-2], text[-2:]] if text.endswith(END) else list(text)

    def stands(self, piece: int) -> bool:
        """Whether merging a piece's own units yields the piece."""
        found = self.alone.get(piece)
        if found is None:
            text = self.texts[piece]
            found = self.alone[piece] = self.merged(self.units(text)) == [text]
        return found

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the units of a and b yields a and b."""
        key = a << 20 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= self.most_pairs:
                self.pairs.clear()
            x, y = self.texts[a], self.texts[b]
            found = self.pairs[key] = self.merged([*x, *self.units(y)]) == [x, y]
        return found

    def walk(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """For every prefix its last piece, its number of pieces, and the number if the prefix were a whole word.

        A prefix that no pieces make up has -1, 0 and 0.
        """
        n, table, pairs = len(text), self.table, self.pairs
        last, count, whole = [-1] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        for i in range(n):
            a = last[i]
            if i and a < 0:
                continue
            c = count[i] + 1
            for j in range(i + 1, min(n, i + self.longest) + 1):
                found = table.get(text[i:j])
                if found is None:
                    break
                b, e = found
                if b >= 0 and last[j] < 0:
                    ok = pairs.get(a << 20 | b) if i else self.stands(b)
                    if self.fits(a, b) if ok is None else ok:
                        last[j], count[j] = b, c
                if e >= 0 and not whole[j]:
                    ok = pairs.get(a << 20 | e) if i else self.stands(e)
                    if self.fits(a, e) if ok is None else ok:
                        whole[j] = c
        return last, count, whole
