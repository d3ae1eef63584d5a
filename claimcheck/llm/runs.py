"""Periodic runs of words, found on a grammar of the text.

A run is a stretch of words that repeats a shorter stretch, its period, at least four times, and that no
neighbouring word continues. Texts are compressed by Re-Pair first, many small ones together: in each round
all neighbouring symbols that occur twice or more are ranked by their count, and every pair that ranks above
those it overlaps becomes a symbol of its own. Each symbol is then looked at once, however often it stands:

* A run lies in the expansion of one lowest symbol, and so across the border of its two halves; or it lies
  across a border between symbols that remain. Only such runs are kept where they are found (``across``).
* Runs of a symbol hold wherever it is derived: they are handed up from rule to rule and put into the
  documents (``Grammar.derived``), and merged where neighbouring words continue them (``merged``).

A document that became one symbol, as copies do, isn't looked at again.

To find the runs of a stretch, blocks of 1, 2, 4, ... words get names, made from two names of half the
length. A block of l words in a run of period l/2 < q <= l comes again q words further and not before; so
places in a row whose block comes again at one and the same distance are a run. Blocks that don't come again
in the stretch are left out of all longer ones, so that ordinary text is done after blocks of a few words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimcheck.llm.shared import free_name, texts_of

#: A run has this many periods, and this many words, at least.
PERIODS, WORDS = 4, 6
#: Bytes of texts that share a grammar (a longer text has its own), and of the parts in which a long text is split.
TOGETHER, PART = 1 << 19, 1 << 22
#: Rounds of Re-Pair; what could still be paired then remains as it is.
ROUNDS = 64

#: (start, end, period)
Run = tuple[int, int, int]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def by_key(left: np.ndarray, right: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places ordered by their key, or pair of keys, and then by place; whether each begins another key). Keys aren't negative."""
    if not len(left):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
    place, low = (len(left) - 1).bit_length(), int(right.max()).bit_length() if right is not None else 0
    key = left if right is None else (left << low) | right
    if int(left.max()).bit_length() + low + place < 63:
        both = np.sort((key << place) | np.arange(len(left)))  # several times as fast as argsort
        order, key = both & ((1 << place) - 1), both >> place
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    return order, np.append(True, key[1:] != key[:-1])


def stretches(words: np.ndarray) -> Iterator[Run]:
    """All runs between the separators (negative numbers) of ``words``."""
    n = len(words)
    part = np.cumsum(words < 0)
    longest = np.bincount(part, minlength=1) // PERIODS  # one too many words, for the separator, does no harm
    names, active, size = words.copy(), np.flatnonzero(words >= 0), 1
    left, right = names[active], None
    while len(active) and size < 2 * longest.max():
        order, first = by_key(left, right)
        at = active[order]
        names[at] = np.cumsum(first) - 1
        here, there = at[:-1], at[1:]
        far = there - here
        again = ~first[1:] & (part[here] == part[there]) & (far <= longest[part[here]])
        here, there, far = here[again], there[again], far[again]
        own = (2 * far > size) & (far <= size)
        place, period = here[own], far[own]
        order = np.argsort(place)
        place, period = place[order], period[order]
        if len(place):
            begins = np.flatnonzero(np.append(True, (place[1:] != place[:-1] + 1) | (period[1:] != period[:-1])))
            ends = np.append(begins[1:], len(place)) - 1
            start, end, q = place[begins], place[ends] + size + period[ends], period[begins]
            kept = end - start >= np.maximum(WORDS, PERIODS * q)
            yield from zip(start[kept].tolist(), end[kept].tolist(), q[kept].tolist())
        comes = np.zeros(n + size + 1, dtype=bool)
        comes[here] = comes[there] = True
        active = np.flatnonzero(comes[:n])
        active = active[comes[active + size]]
        left, right = names[active], names[active + size]
        size *= 2


def across(words: np.ndarray, borders: np.ndarray) -> list[Run]:
    """The runs of ``words`` that hold a border, that is, words on either side of it. A border is the place of the word after it."""
    marks = np.zeros(len(words) + 1, dtype=np.int64)
    marks[borders] = 1
    before = np.cumsum(marks)
    return [(s, e, q) for s, e, q in stretches(words) if before[e - 1] > before[s]]


def merged(runs: list[Run]) -> list[Run]:
    """Maximal runs, by start and period: runs of one period that share a period's words are parts of one."""
    found: list[Run] = []
    for start, end, period in sorted(runs, key=lambda r: (r[2], r[0])):
        if found and found[-1][2] == period and start <= found[-1][1] - period:
            found[-1] = found[-1][0], max(end, found[-1][1]), period
        else:
            found.append((start, end, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


class Grammar:
    """The rules that Re-Pair makes of words, and the sequence that remains. Separators (negative numbers) are in no rule."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.first = int(words.max(initial=-1)) + 1  # symbols from here on have rules
        self.left, self.right = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.place = np.zeros(0, dtype=np.int64)  # of each rule one place in the words that it derives
        self.length, self.middle = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        sequence, at = words, np.arange(len(words))
        alone = np.zeros(len(words), dtype=bool)  # pairs known to occur once
        for _ in range(ROUNDS):
            a, b = sequence[:-1], sequence[1:]
            live = np.flatnonzero((a >= 0) & (b >= 0) & ~alone[:-1])
            order, first = by_key(a[live], b[live])
            starts = np.flatnonzero(first)
            counts = np.diff(np.append(starts, len(live)))
            often = np.flatnonzero(counts > 1)
            if not len(often):
                break
            # Ranks by count; pairs of equal count in an order that has nothing to do with their places.
            rank_of = np.zeros(len(counts), dtype=np.int64)
            rank_of[often[np.lexsort((_mixed(often), counts[often]))]] = np.arange(1, len(often) + 1)
            rank = np.zeros(len(a) + 2, dtype=np.int64)
            rank[1 + live[order]] = np.repeat(rank_of, counts)
            alone = np.append(rank[1:-1] == 0, True)
            own = rank[1:-1]
            best = (own > 0) & (own >= rank[:-2]) & (own >= rank[2:])
            # Neighbours that are both best are one pair, as in a a a: every second one is taken.
            places = np.flatnonzero(best)
            group = np.append(True, np.diff(places) > 1)
            begin = places[np.maximum.accumulate(np.where(group, np.arange(len(places)), 0))]
            places = places[(places - begin) % 2 == 0]
            order, first = by_key(a[places], b[places])
            starts = np.flatnonzero(first)
            uses = np.diff(np.append(starts, len(places)))
            which = np.empty(len(places), dtype=np.int64)
            which[order] = np.repeat(np.where(uses > 1, np.cumsum(uses > 1) - 1, -1), uses)
            places, which = places[which >= 0], which[which >= 0]
            if not len(places):
                break
            _, one = np.unique(which, return_index=True)
            fresh = self.first + len(self.left)
            one = places[one]
            lengths = np.diff(np.append(at, len(words)))
            self.left, self.right = np.append(self.left, a[one]), np.append(self.right, b[one])
            self.place, self.middle = np.append(self.place, at[one]), np.append(self.middle, lengths[one])
            self.length = np.append(self.length, lengths[one] + lengths[one + 1])
            sequence = sequence.copy()
            sequence[places] = fresh + which
            alone[places] = alone[places - 1] = False  # a pair before the first word is none
            kept = np.ones(len(sequence), dtype=bool)
            kept[places + 1] = False
            sequence, at, alone = sequence[kept], at[kept], alone[kept]
        self.sequence, self.at = sequence, at

    def of_rules(self) -> dict[int, list[Run]]:
        """For each rule (by number) with runs, those of its expansion that hold its border or come from its halves."""
        found: dict[int, list[Run]] = {}
        rules = np.flatnonzero(self.length >= WORDS)
        sizes = np.cumsum(self.length[rules] + 1)
        for some in np.split(rules, np.flatnonzero(np.diff(sizes // (1 << 20))) + 1):
            if not len(some):
                continue
            starts = np.cumsum(self.length[some] + 1) - self.length[some] - 1
            words = np.full(int((self.length[some] + 1).sum()), -1, dtype=np.int64)
            inner = np.arange(len(words)) - np.repeat(starts, self.length[some] + 1)
            own = inner < np.repeat(self.length[some], self.length[some] + 1)
            words[own] = self.words[(np.repeat(self.place[some], self.length[some] + 1) + inner)[own]]
            for s, e, q in across(words, starts + self.middle[some]):
                k = int(np.searchsorted(starts, s, side="right")) - 1
                found.setdefault(int(some[k]), []).append((s - int(starts[k]), e - int(starts[k]), q))
        return self._handed_up(found)

    def _handed_up(self, own: dict[int, list[Run]]) -> dict[int, list[Run]]:
        """Rules come after those in them, and so their runs can be handed up in one go."""
        has = np.zeros(len(self.left) + 1, dtype=bool)
        has[list(own)] = True
        sides = [np.where(x >= self.first, x - self.first, len(self.left)) for x in (self.left, self.right)]
        while True:  # which rules have runs below them: a round for each step of the deepest derivation
            more = has.copy()
            more[:-1] |= has[sides[0]] | has[sides[1]]
            if (more == has).all():
                break
            has = more
        found: dict[int, list[Run]] = {}
        for rule in np.flatnonzero(has).tolist():
            runs = list(own.get(rule, []))
            for side, shift in ((int(sides[0][rule]), 0), (int(sides[1][rule]), int(self.middle[rule]))):
                runs += [(s + shift, e + shift, q) for s, e, q in found.get(side, [])]
            found[rule] = merged(runs)
        return found

    def derived(self) -> list[Run]:
        """The maximal runs of all words."""
        of = self.of_rules()
        runs: list[Run] = []
        has = np.zeros(len(self.left), dtype=bool)
        has[list(of)] = True
        rule = np.where(self.sequence >= self.first, self.sequence - self.first, 0)
        for i in np.flatnonzero((self.sequence >= self.first) & (has[rule] if len(has) else False)).tolist():
            shift = int(self.at[i])
            runs += [(s + shift, e + shift, q) for s, e, q in of[int(rule[i])]]
        # Parts of one symbol have no border and are left out.
        part = np.cumsum(self.sequence < 0)
        several = np.bincount(part[self.sequence >= 0], minlength=int(part[-1]) + 1 if len(part) else 1) > 1
        shown = np.repeat(several[part] | (self.sequence < 0), np.diff(np.append(self.at, len(self.words)))) if len(part) else np.zeros(0, dtype=bool)
        runs += across(np.where(shown, self.words, -1), self.at)
        return merged(runs)


def _mixed(numbers: np.ndarray) -> np.ndarray:
    x = numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)


def _parts(text: bytes) -> Iterator[bytes]:
    """The text in parts that end at white space."""
    start = 0
    while len(text) - start > PART:
        cut = max(text.rfind(c, start, start + PART) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut < 0:  # one word is longer than a part
            ends = [x for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (x := text.find(c, start + PART)) >= 0]
            cut = min(ends, default=len(text))
        yield text[start:cut]
        start = cut
    yield text[start:]


def runs_of_texts(texts: list[bytes]) -> Iterator[tuple[int, list[Run], bytes]]:
    """(words, runs, the text without repetitions) of each text; all share a grammar."""
    split = [[x.split() for x in _parts(t)] if len(t) <= PART else None for t in texts]
    numbers, pieces, sizes = _Numbers(), [], []
    for text, lists in zip(texts, split):
        own = [np.fromiter(map(numbers.__getitem__, x), np.int64, len(x)) for x in (lists or (x.split() for x in _parts(text)))]
        sizes.append(sum(map(len, own)))
        pieces += [*own, np.array([-1])]
    runs = iter(Grammar(np.concatenate(pieces)).derived()) if pieces else iter(())
    run, start = next(runs, None), 0
    for text, lists, size in zip(texts, split, sizes):
        found = []
        while run and run[0] < start + size:
            found.append((run[0] - start, run[1] - start, run[2]))
            run = next(runs, None)
        steps = np.zeros(size + 1, dtype=np.int64)
        for s, e, q in found:
            steps[s + q] += 1
            steps[e] -= 1
        kept, at, out = np.cumsum(steps[:size]) == 0, 0, []
        for x in lists or (x.split() for x in _parts(text)):
            out.append(b" ".join(x if not found else [w for w, k in zip(x, kept[at : at + len(x)].tolist()) if k]))
            at += len(x)
        yield size, found, b" ".join(x for x in out if x)
        start += size + 1


def together(texts: Iterator[bytes], limit: int = TOGETHER) -> Iterator[list[bytes]]:
    run: list[bytes] = []
    size = 0
    for text in texts:
        if run and size + len(text) > limit:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def find_runs(docs: DataFrame, text: str = "text", names: tuple[str, str, str] = ("n_words", "runs", "collapsed")) -> DataFrame:
    """``docs`` with the number of words, the runs (start, length, period; by start, then period) and the collapsed text, under ``names``.

    Words are what stands between ASCII white space, numbered from 0. A run's period is the smallest number q
    such that words q apart are the same; it has 4 q words, and 6, at least. The collapsed text has the words
    that no run holds after its first q words, with one space between them. A null text has no words; each
    row is its own document, and a text of any length is taken whole. Columns named like the new ones give
    way. There is no shuffle; a task holds ``TOGETHER`` bytes of texts, or one longer text.
    """

    @F.arrow_udf("struct<n_words: bigint, runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: string>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            n, ends, runs, texts = [], [0], [], []
            for some in together(x for run in texts_of(batch.cast(pa.binary())) for x in run):
                for words, own, collapsed in runs_of_texts(some):
                    n.append(words)
                    runs += own
                    ends.append(len(runs))
                    texts.append(collapsed)
            columns = list(zip(*runs)) or [(), (), ()]
            starts, lengths, periods = (pa.array(x, pa.int64()) for x in (columns[0], [e - s for s, e, _ in runs], columns[2]))
            of = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([starts, lengths, periods], ["start", "length", "period"]))
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), of, pa.array(texts, pa.binary()).cast(pa.string())], ["n_words", "runs", "collapsed"])

    taken, new = {n.lower() for n in names}, free_name(docs, "_found")
    rows = docs.select(*[docs[c] for c in docs.columns if c.lower() not in taken], found(F.coalesce(docs[text], F.lit(""))).alias(new))
    return rows.select(*rows.drop(new).columns, *[F.col(f"{new}.{field}").alias(name) for field, name in zip(("n_words", "runs", "collapsed"), names)])
