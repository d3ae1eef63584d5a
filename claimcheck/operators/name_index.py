"""An index over column names that finds them, exactly or nearly, in texts.

A part of a text is near a name of n characters if few edits, k at most, lead from one to the other. Cut into
k + 1 pieces, the name then keeps one piece whole: an automaton of all pieces of all names reads the text
once, and only parts around a piece that it meets are compared with the name. Two similarities are known:
Levenshtein's distance, and the longest common subsequence (where u characters of the name are left over,
as many of the text are, so that k = 2 u).
"""

from __future__ import annotations

from collections import defaultdict

LEVENSHTEIN, INDEL = "levenshtein", "indel"


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table at a time as the bits of one number."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    whole = (1 << len(a)) - 1
    row = whole
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & whole
    return len(a) - row.bit_count()


def distance(a: str, b: str) -> int:
    """Levenshtein's distance, a column of the table at a time."""
    row = list(range(len(a) + 1))
    for j, c in enumerate(b, 1):
        left, row[0] = row[0], j
        for i, d in enumerate(a, 1):
            left, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, left + (c != d))
    return row[-1]


def score(a: str, b: str, kind: str) -> float:
    """Similarity (0 to 100) of two strings of one length."""
    if not a:
        return 0.0
    return float(round(100 * common_subsequence(a, b) / len(a))) if kind == INDEL else 100.0 * (len(a) - distance(a, b)) / len(a)


def most_edits(size: int, least: float, kind: str) -> int:
    """Edits that may lead from a string of ``size`` characters to one of at least ``least`` similarity; -1 if none is as similar."""
    if kind == INDEL:
        return max((2 * u for u in range(size + 1) if round(100 * (size - u) / size) >= least), default=-1)
    return max((d for d in range(size + 1) if 100.0 * (size - d) / size >= least), default=-1)


def pieces(name: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` pieces of the name with their places, as even as can be."""
    n = edits + 1
    cuts = [len(name) * i // n for i in range(n + 1)]
    return [(a, name[a:b]) for a, b in zip(cuts, cuts[1:])]


class NameIndex:
    """Finds which of ``names`` (compared in small letters) a text holds, or nearly holds (``kind`` None: exactly only)."""

    def __init__(self, names: list[str], kind: str | None, least: float):
        import ahocorasick

        self.names, self.kind, self.least = [n.lower() for n in names], kind, least
        self.everywhere = [i for i, n in enumerate(self.names) if not n]
        self.loose: list[tuple[int, int]] = []  # names that have pieces of no length: so many edits are allowed
        self.edits: dict[int, int] = {}
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, name in enumerate(self.names):
            edits = max(0, most_edits(len(name), least, kind)) if kind and name else 0
            if edits >= len(name) > 0:
                self.loose.append((i, edits))
            elif name:
                self.edits[i] = edits
                for at, piece in pieces(name, edits):
                    found[piece].append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if found:
            self.automaton.make_automaton()
        self.sizes = [len(n) for n in self.names]
        self.longest = max(self.sizes, default=0)
        self.windows = 0  # compared so far

    def find(self, low: str) -> list[tuple[int, float, bool]]:
        """(name, score, whether the text holds it) of the names in ``low``, a text in small letters, by name."""
        starts: dict[int, set[int]] = defaultdict(set)
        for end, (size, uses) in self.automaton.iter(low) if len(self.automaton) else ():
            for i, at in uses:
                first, edits = end - size + 1 - at, self.edits[i]
                starts[i].update(range(max(0, first - edits), min(len(low) - self.sizes[i], first + edits) + 1))
        found = {i: (100.0, True) for i in self.everywhere}
        for i, edits in self.loose:
            starts[i] = set(range(len(low) - self.sizes[i] + 1))
        for i, places in starts.items():
            name = self.names[i]
            if name in low:
                found[i] = 100.0, True
            elif self.kind and places:
                self.windows += len(places)
                best = max(score(name, part, self.kind) for part in {low[p : p + len(name)] for p in places})
                if best >= self.least:
                    found[i] = best, False
        if self.kind and 0 < len(low) < self.longest:
            for i in self._longer(low):
                name = self.names[i]
                best = max(score(low, name[p : p + len(low)], self.kind) for p in range(len(name) - len(low) + 1))
                if best >= self.least:
                    found[i] = best, False
        return [(i, *found[i]) for i in sorted(found)]

    def _longer(self, low: str) -> list[int]:
        """Names longer than the text that share a piece of it."""
        edits = max(0, most_edits(len(low), self.least, self.kind))
        own = [piece for _, piece in pieces(low, edits)]
        return [i for i, name in enumerate(self.names) if len(name) > len(low) and any(p in name for p in own)]
