"""The semi-Markov conditional random field of personal.py: features of whole segments, training and decoding.

A region of text is cut into atoms (runs of letters, runs of digits, single other characters). A segmentation covers
it with segments of a kind and single atoms outside of any; its score is the sum of the weights of its segments'
features, atoms outside count 0. The weights make the true segmentations of written sentences likeliest (exact
forward-backward sums over all segmentations, a Gaussian prior); Viterbi finds the best segmentation.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Bounds of a segment: atoms, and digits of a number. The longest spelled-out address of twelve parts has 60 atoms.
MOST_ATOMS, LEAST_DIGITS, MOST_DIGITS = 64, 7, 19

ATOMS = re.compile(r"[0-9]+|[^\W\d_]+|.", re.S)
NOT_DIGIT = re.compile(r"[^0-9]+")
#: An at sign or a dot that is spelled out: in brackets, or as a word.
CONNECTOR = re.compile(r"[\[({<]\s?(?:at|dot|@|\.)\s?[\])}>]|(?<![^\W_])(?:at|dot)(?![^\W_])|@", re.I)
AT = re.compile(r"[\[({<]\s?(?:at|@)\s?[\])}>]|(?<![^\W_])at(?![^\W_])|@", re.I)
DOT = re.compile(r"[\[({<]\s?(?:dot|\.)\s?[\])}>]|(?<![^\W_])dot(?![^\W_])", re.I)
#: A further part of an address behind a segment, or before it.
GOES_ON = re.compile(r"\s?(?:[\[({<]\s?(?:at|dot|\.)\s?[\])}>]|(?<![^\W_])dot(?![^\W_])|\.)\s?[A-Za-z0-9]", re.I)
CAME_ON = re.compile(r"(?:[\[({<]\s?(?:at|dot)\s?[\])}>]|(?<![^\W_])dot|[A-Za-z0-9]\.)\s?$", re.I)
#: Words that tell what a number beside them is; fixed values.
CUES = {
    "phone": "tel telephone phone call fax mobile cell ring dial whatsapp sms text reach hotline téléphone telefon teléfono tél móvil handy rufnummer anruf llamar appelez".split(),
    "card": "card visa mastercard amex credit debit karte tarjeta carte kreditkarte".split(),
    "code": "isbn issn order version token no id ref reference invoice ticket serial tracking sku part article batch lot case file account item code number nr bestellung rechnung pedido commande build release key hash uuid model licence license".split(),
    "sum": "sum total eur usd price cost amount population year years date on from between score".split(),
}
_CUE = {w: k for k, words in CUES.items() for w in words}
WORD_BEFORE = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def side(c: str) -> str:
    return "none" if not c else "word" if c.isalnum() else "space" if c.isspace() else "stop" if c in ".,;:!?)]}\"'" else "mark"


def cue(text: str, a: int) -> str:
    """What the last two words before a place, in its line, speak of."""
    before = text[max(text.rfind("\n", 0, a) + 1, a - 48) : a].lower()
    for word in reversed(WORD_BEFORE.findall(before)[-2:]):
        if word in _CUE:
            return _CUE[word]
    return "none"


def segment_features(text: str, a: int, b: int) -> tuple[str, ...] | None:
    """The features of text[a:b] as one segment; None for what no kind can be."""
    s = text[a:b]
    if not (s[0].isalnum() or s[0] in "(+") or not s[-1].isalnum():
        return None
    digits = NOT_DIGIT.sub("", s)
    ats = AT.findall(s)
    if not ats and not LEAST_DIGITS <= len(digits) <= MOST_DIGITS:
        return None
    sides = (f"left={side(text[a - 1 : a])}", f"right={side(text[b : b + 1])}")
    if ats:
        local, _, domain = AT.sub("\0", s, count=1).partition("\0")
        local, domain = DOT.sub(".", local).strip(), DOT.sub(".", domain).strip()
        plain = lambda x: re.sub(r"\s*\.\s*", ".", x)
        ending = re.search(r"\.([A-Za-z]{2,6})$", plain(domain))
        return ("mail", f"mail ats={min(3, len(ats))}", f"mail at={'word' if ats[0].lower() == 'at' else 'sign' if ats[0] == '@' else 'bracket'}", f"mail local={bool(re.fullmatch(r'[A-Za-z0-9._%+-]+', plain(local)))}", f"mail domain={bool(re.fullmatch(r'[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', plain(domain)))}", f"mail ending={bool(ending)}", f"mail dots={'spelled' if DOT.search(s) else 'plain'}", f"mail goes on={bool(GOES_ON.match(text, b))}", f"mail came on={bool(CAME_ON.search(text, max(0, a - 12), a))}", *("mail " + x for x in sides))
    shape = re.sub(r"[0-9]+", lambda m: str(min(9, len(m.group()))), re.sub(r"[^\W\d_]+", "a", s))
    known = cue(text, a)
    marks = "".join(sorted(set(re.sub(r"[0-9]", "", shape))))
    groups = tuple(min(9, len(x)) for x in re.findall(r"[0-9]+", s))
    start = "0" if s.lstrip("(")[:1] == "0" else "+" if s[0] == "+" else "1-9"
    sum_ = len(digits) >= 13 and 'a' not in shape and luhn(digits)
    return ("number", f"digits={len(digits)}", f"shape={shape if len(shape) < 16 else 'long'}", f"groups={groups if len(groups) < 7 else 'many'}", f"marks={marks}", f"start={start}", f"start={start} digits={len(digits)}", f"luhn={sum_}", f"luhn={sum_} digits={len(digits)}", f"letters={'a' in shape}", f"cue={known}", f"cue={known} digits={len(digits)}", f"cue={known} bare={not marks}", f"cue={known} start={start}", f"cue={known} groups={groups if len(groups) < 7 else 'many'}", *sides)


def atoms_of(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [m.span() for m in ATOMS.finditer(text, start, end)]


def candidates(text: str, atoms: list[tuple[int, int]], closed: list[tuple[int, int]]) -> list[tuple[int, int, tuple[str, ...]]]:
    """(first atom, atom after the last, features) of every possible segment outside closed spans."""
    out = []
    for i, (a, _) in enumerate(atoms):
        if not (text[a].isalnum() or text[a] in "(+"):
            continue
        digits, mail = 0, False
        for j in range(i + 1, min(len(atoms), i + MOST_ATOMS) + 1):
            x, b = atoms[j - 1]
            c = text[x]
            digits += b - x if c.isdecimal() and c.isascii() else 0
            mail |= c == "@" or text[x:b].lower() == "at"
            if (digits > MOST_DIGITS and not mail) or any(s < b and a < e for s, e in closed):
                break
            if (mail or digits >= LEAST_DIGITS) and (f := segment_features(text, a, b)):
                out.append((i, j, f))
    return out


# --- sums over segmentations ----------------------------------------------------------------------------------------


def marginals(n: np.ndarray, owner: np.ndarray, i: np.ndarray, j: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each segment, log of the sum over all segmentations of each region).

    Region k has n[k] atoms; segment e of region owner[e] goes from atom i[e] to j[e] and may be taken with its score.
    """
    width = int(n.max(initial=0)) + 1
    ahead = np.full((len(n), width), -np.inf)
    ahead[:, 0] = 0.0
    by_end = [np.flatnonzero(j == k) for k in range(width)]
    for k in range(1, width):
        ahead[:, k] = ahead[:, k - 1]
        e = by_end[k]
        np.logaddexp.at(ahead[:, k], owner[e], ahead[owner[e], i[e]] + score[e])
    back = np.full((len(n), width), -np.inf)
    back[np.arange(len(n)), n] = 0.0
    by_start = [np.flatnonzero(i == k) for k in range(width)]
    for k in range(width - 2, -1, -1):
        inside = k < n
        back[inside, k] = back[inside, k + 1]
        e = by_start[k]
        np.logaddexp.at(back[:, k], owner[e], score[e] + back[owner[e], j[e]])
    total = ahead[np.arange(len(n)), n]
    return np.exp(np.minimum(0.0, ahead[owner, i] + score + back[owner, j] - total[owner])), total


def best_segments(n: int, segments: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """The segments (first atom, atom after the last, kind) of the best segmentation of n atoms; of equal ones the one with fewer."""
    by_end: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]
    for i, j, kind, score in segments:
        by_end[j].append((i, kind, score))
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for i, kind, score in by_end[j]:
            if best[i] + score > best[j]:
                best[j], back[j] = best[i] + score, (i, kind)
    out, j = [], n
    while j:
        if back[j] is None:
            j -= 1
        else:
            i, kind = back[j]
            out.append((i, j, kind))
            j = i
    return out[::-1]


# --- written sentences ----------------------------------------------------------------------------------------------


def sentences(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Sentences with their spans (kind, start, end), written from forms of numbers and addresses in many contexts."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    lead = lambda k: r.choice("23456789") + digits(k - 1)
    word = lambda: "".join(r.choice("abcdefghilmnoprstuvz") for _ in range(r.randint(2, 9)))
    words = lambda k: " ".join(word() for _ in range(k))
    tld = lambda: r.choice("com org net edu de fr es it co info io gov uk ch eu".split())

    def with_sum(body: str, good: bool) -> str:
        return next(x for x in (body + c for c in r.sample("0123456789", 10)) if luhn(x) == good)

    def fours(full: str, mark: str) -> str:
        return mark.join(full[i : i + 4] for i in range(0, len(full), 4))

    def cut(*sizes: int, marks: str, zero: bool = False) -> str:
        mark = r.choice(marks)
        return mark.join(("0" + digits(k - 1) if zero and not at else lead(k)) for at, k in enumerate(sizes))

    # numbers that look like phones by themselves, and those that only a word before tells
    clear = (
        lambda: f"({lead(3)}) {digits(3)}-{digits(4)}",
        lambda: f"({lead(3)}){digits(3)}-{digits(4)}",
        lambda: f"{lead(3)}-{digits(3)}-{digits(4)}",
        lambda: f"1-{lead(3)}-{digits(3)}-{digits(4)}",
        lambda: f"1 ({lead(3)}) {digits(3)}-{digits(4)}",
        lambda: f"(0{digits(2)}) {digits(r.randint(5, 8))}",
        lambda: f"(0{digits(3)}) {digits(r.randint(5, 7))}",
        lambda: f"00{lead(2)} {digits(2)} {digits(r.randint(6, 8))}",
    )
    told = (
        lambda: cut(3, 3, 4, marks=". /"),
        lambda: cut(3, 4, 4, marks=" -.", zero=True),
        lambda: cut(4, 3, 4, marks=" -", zero=True),
        lambda: cut(5, 3, 3, marks=" -", zero=True),
        lambda: cut(5, 6, marks=" -/", zero=True),
        lambda: cut(3, r.randint(6, 8), marks=" /-", zero=True),
        lambda: cut(4, r.randint(6, 7), marks=" /-", zero=True),
        lambda: cut(2, 2, 2, 2, 2, marks=" .-", zero=True),
        lambda: cut(3, 3, 3, marks=" .-"),
        lambda: cut(2, 3, 2, 2, marks=" -"),
        lambda: cut(3, 4, marks="-. "),
        lambda: "0" + digits(r.randint(8, 10)),
        lambda: lead(r.randint(9, 10)),
        lambda: f"{lead(3)} {digits(3)}-{digits(4)}",
    )
    amex = lambda: with_sum("3" + r.choice("47") + digits(12), True)
    cards = (
        lambda: fours(with_sum(r.choice("456") + digits(14), True), r.choice("./_·")),
        lambda: fours(with_sum(r.choice("456") + digits(14), True), "  "),
        lambda: (lambda x: f"{x[:4]}{(m := r.choice(' -'))}{x[4:10]}{m}{x[10:]}")(amex()),
    )
    name = lambda: r.choice((word(), f"{word()}.{word()}", f"{word()}_{word()}", f"{word()}{digits(2)}", f"{word()}-{word()}"))
    host = lambda dot: dot.join([word() for _ in range(r.choice((1, 1, 1, 2, 3)))] + [tld()])
    mails = (
        lambda: f"{name()} {r.choice(('(at)', '[at]', '{at}', '(AT)', '[AT]', '<at>'))} {host('.')}",
        lambda: f"{name()}{r.choice(('(at)', '[at]', '{at}', '[AT]', '(@)', '[@]'))}{host('.')}",
        lambda: f"{name()} {r.choice(('(at)', '[at]'))} {host(r.choice((' dot ', ' (dot) ', '[dot]', ' [dot] ', '(dot)')))}",
        lambda: f"{name()}{r.choice(('(at)', '[at]'))}{host(r.choice(('[dot]', '(dot)')))}",
        lambda: f"{word()} at {host(' dot ')}",
        lambda: f"{word()} dot {word()} at {host(' dot ')}",
        lambda: f"{name()} @ {host('.')}",
        lambda: f"{name()}@{host(' dot ')}",
        lambda: f"{name()} AT {host(' DOT ')}",
    )
    other = (
        lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02} {r.randint(0, 23):02}:{r.randint(0, 59):02}",
        lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}",
        lambda: f"{r.randint(1, 28):02}{(m := r.choice('/.-'))}{r.randint(1, 12):02}{m}{r.randint(1900, 2030)}",
        lambda: fours(with_sum(r.choice("123456789") + digits(14), False), r.choice((" ", "-", ".", "/", ""))),
        lambda: fours(with_sum(r.choice("12789") + digits(14), True), r.choice("+,")),
        lambda: digits(r.randint(7, 19)),
        lambda: ".".join(str(r.randint(0, 30)) for _ in range(r.randint(5, 8))),
        lambda: f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}",
        lambda: f"97{r.choice('89')} {digits(1)} {digits(4)} {digits(4)} {digits(1)}",
        lambda: f"{digits(2)} {r.choice('+-')} {digits(3)} {r.choice('+-')} {digits(4)} ({digits(2)})",
        lambda: " ".join(str(r.randint(1900, 2030)) for _ in range(r.randint(2, 4))),
        lambda: "-".join(str(r.randint(1900, 2030)) for _ in range(2)),
        lambda: f"{digits(1)}.{digits(3)}.{digits(3)}",
        lambda: f"{lead(1)} {digits(3)} {digits(3)}",
        lambda: f"{digits(3)}.{digits(3)}.{digits(4)}.{digits(2)}.{digits(3)}",
        lambda: f"{word()[:2]}{digits(3)}-{digits(3)}-{digits(4)}",
        lambda: f"{digits(7)}{word()[:3]}{digits(4)}{word()[:1]}{digits(8)}",
        lambda: f"{digits(1)}{word()[:3]}{digits(9)}{word()[:2]}{digits(2)}",
        lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice((24, 32, 40)))),
        lambda: f"{digits(1)}.{digits(9)}",
        lambda: " ".join(digits(r.randint(1, 3)) for _ in range(r.randint(4, 7))),
        lambda: f"{word()} {r.choice(('(at)', '[at]', 'at', '@', 'AT'))} {word()}",
        lambda: f"{word()} at {word()} {word()}.",
        lambda: f"{word()} dot {word()}",
        lambda: f"{word()} at {word()}. {word()} {word()}",
        lambda: f"@{word()} {word()}.",
        lambda: f"{word()} @{word()}",
        lambda: f"{word()} at the {word()} dot {words(2)}",
    )

    def told_as(kind: str) -> str:
        c = r.choice(CUES[kind])
        c = r.choice((c, c, c.capitalize(), c.upper()))
        return c + r.choice((" ", " ", ": ", ". ", " is ", " number ", " no. ", " at ", "=", " (")) if kind == "phone" else c + r.choice((" ", ": ", " #", " no. ", " number ", " = ", " "))

    out = []
    for k in range(n):
        pick, before, kind, close = k % 8, "", None, ""
        if pick == 0:
            kind, s = PHONE, r.choice(clear)()
            before = told_as("phone") if r.random() < 0.6 else ""
            if r.random() < 0.15:  # a number behind it takes it away from the base pattern
                s, close = r.choice(("+1 ({}) {}-{}", "+1 {}-{}-{}", "+44 {} {} {}")).format(lead(3), digits(3), digits(4)), " " + r.choice((".".join(str(r.randint(10, 255)) for _ in range(4)), digits(8)))
        elif pick in (1, 2):
            kind, s, before = PHONE, r.choice(told)(), told_as("phone")
        elif pick == 3:
            # the same forms, but a word says that it is something else, or none says anything
            s, before = (r.choice(told)(), told_as("code") if r.random() < 0.6 else told_as("sum") if r.random() < 0.5 else "") if r.random() < 0.7 else (r.choice(clear)(), told_as("code"))
        elif pick == 4:
            kind, s = CARD, r.choice(cards)()
            before = told_as("card") if r.random() < 0.6 else ""
        elif pick == 5:
            kind, s = EMAIL, r.choice(mails)()
            before = r.choice(("", "mail ", "email: ", "write to ", "e-mail is ", "contact "))
        else:
            s = r.choice(other)()
            before = told_as("code") if r.random() < 0.2 else told_as("sum") if r.random() < 0.2 else told_as("phone") if r.random() < 0.05 else ""
        head = words(r.randint(1, 4)) + r.choice((" ", ", ", ": ", "; ", " - ")) if r.random() < 0.85 else ""
        if not before and head and r.random() < 0.1 and kind != EMAIL:
            head = head.rstrip() + " ("
        tail = r.choice((" ", ". ", ", ", ") ", "! ", "; ", "\n")) + words(r.randint(1, 4)) if r.random() < 0.85 else r.choice(("", ".", ")"))
        a = len(head) + len(before)
        out.append((head + before + s + close + tail, [] if kind is None else [(kind, a, a + len(s))]))
    return out


def problems(examples, regions: Callable, base: Callable):
    """For each region of the examples: atoms, and segments with their features and whether they are true."""
    for text, spans in examples:
        found, runs = base(text)
        closed = sorted((s, e) for _, s, e in found)
        for a, b in regions(text, found, runs):
            atoms = atoms_of(text, a, b)
            yield len(atoms), [(i, j, f, [(k, atoms[i][0], atoms[j - 1][1]) in spans for k in range(len(KINDS))]) for i, j, f in candidates(text, atoms, closed)]


@lru_cache(maxsize=1)
def fitted(regions: Callable, base: Callable, n: int = 4000, seed: int = 11, steps: int = 120, ridge: float = 0.01) -> dict[tuple[int, str], float]:
    """The weights of (kind, feature) that make the written sentences' segmentations likeliest."""
    index: dict[tuple[int, str], int] = {}
    size, owner, first, last, true, flat, each = [], [], [], [], [], [], []
    for n_atoms, segments in problems(sentences(n, seed), regions, base):
        if not segments:
            continue
        for i, j, f, right in segments:
            for kind in range(len(KINDS)):
                owner.append(len(size))
                first.append(i)
                last.append(j)
                true.append(right[kind])
                flat += [index.setdefault((kind, x), len(index)) for x in f]
                each.append(len(f))
        size.append(n_atoms)
    size, owner, first, last, true, flat, each = map(np.array, (size, owner, first, last, true, flat, each))
    starts = np.cumsum(each) - each
    w, square = np.zeros(len(index)), np.full(len(index), 1e-8)
    for _ in range(steps):
        p, _ = marginals(size, owner, first, last, np.add.reduceat(w[flat], starts))
        g = np.bincount(flat, np.repeat(true - p, each), len(w)) - ridge * w
        square += g * g
        w += 0.5 * g / np.sqrt(square)
    return {k: float(w[v]) for k, v in index.items()}


def decode(text: str, start: int, end: int, closed: list[tuple[int, int]], weights: dict[tuple[int, str], float]) -> list[tuple[int, int, int]]:
    """The best segmentation of text[start:end]: (kind, start, end) of its segments. Features never seen weigh nothing."""
    atoms = atoms_of(text, start, end)
    found = candidates(text, atoms, [(s, e) for s, e in closed if s < end and start < e])
    segments = [(i, j, kind, sum(weights.get((kind, x), 0.0) for x in f)) for i, j, f in found for kind in range(len(KINDS))]
    return [(kind, atoms[i][0], atoms[j - 1][1]) for i, j, kind in best_segments(len(atoms), segments)]
