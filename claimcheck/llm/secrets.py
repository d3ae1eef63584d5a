"""Secrets in texts: plain patterns, and weak candidates confirmed by their complementary parts.

A password-like word, a user name or a host address proves nothing alone. Together they are a credential:
weak candidates are reported only where a complementary part stands in the same scope, a paragraph. Scopes and
parts are intervals of the text, both sorted, and an interval join gives each scope the parts that overlap it
(``joined``): one sweep over both, in which a part that lies across two scopes belongs to both. Within a scope
a secret needs an identifier or an endpoint, and these need a secret, within it or around it or at any
distance; the distance to the nearest is reported. A text without a blank line is one scope however long it
is, where a distant part confirms as well as a near one: there the distance, or ``reach``, tells more.

A window of ``reach`` code points is an option: the join then looks, for each part, at the nearest apart from
it on either side (``linked``).
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimcheck.llm.shared import free_name, texts_of

#: The base patterns with the least length of what counts, in the order of their listing.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of HEX that are long enough
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
#: Weak candidates.
IDENTIFIER = re.compile(r"""\b(?:user(?:_?name)?|login|account(?:_?id)?|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9][A-Za-z0-9@._+-]{2,}""", re.ASCII | re.IGNORECASE)
SHORT_SECRET = re.compile(r"""\b(?:pass(?:word|wd|phrase)?|pwd|secret(?:_?key)?|token|private_?key|credential)["']?\x20*[:=]\x20*["']?([^\s"'<>,;]{4,})""", re.ASCII | re.IGNORECASE)
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"""\b(?:(?:https?|ftp|jdbc:[a-z0-9]+|mongodb|postgres(?:ql)?|mysql|redis|amqp|s3)://[^\s"'<>]+|(?:host|endpoint|server|url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9][^\s"'<>,;]{2,})""", re.ASCII | re.IGNORECASE)
PARAGRAPH = re.compile(r"\n[^\S\n]*\n")
#: Kinds in the order of listing.
KINDS = ("assign", "access", "hex", "identifier", "weak_secret", "endpoint")
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "identifier": "identifier", "weak_secret": "secret", "endpoint": "endpoint"}
REACH = 300
#: Bits a character that a random-looking word has at least.
LEAST_ENTROPY = 3.5

SPANS = "array<struct<start: bigint, kind: int, end: bigint>>"


def entropy(word: str) -> float:
    return -sum(n / len(word) * math.log2(n / len(word)) for n in Counter(word).values())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, by start and kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(found)


def weak_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of weak candidates that no base span touches."""
    starts = [s for s, _, _ in base]
    ends = [0]
    for _, _, end in base:
        ends.append(max(ends[-1], end))

    def free(start: int, end: int) -> bool:
        return ends[bisect.bisect_left(starts, end)] <= start

    found = [(m.start(), 3, m.end()) for m in IDENTIFIER.finditer(text)]
    found += [(m.start(), 4, m.end()) for m in SHORT_SECRET.finditer(text)]
    found += [
        (m.start(), 4, m.end())
        for m in RANDOM.finditer(text)
        if any(c.isdigit() for c in m[0]) and any(c.isupper() for c in m[0]) and any(c.islower() for c in m[0]) and entropy(m[0]) >= LEAST_ENTROPY
    ]
    found += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    return sorted({x for x in found if free(x[0], x[2])})


def linked(base: list[tuple[int, int, int]], weak: list[tuple[int, int, int]], breaks: list[int], reach: int = REACH) -> list[tuple[int, int, int]]:
    """The weak spans with a complementary part in their scope, between the same ``breaks``, within ``reach``.

    A secret needs an identifier or an endpoint, and these need a secret. A part is in reach if the nearest
    one of its role is: by start after the span, by end before it. So each join is a search in two sorted
    lists for each span, and no pairs are made.
    """
    sides: dict[tuple[str, int], tuple[list[int], list[int]]] = {}
    for start, kind, end in sorted(base + weak):
        starts, ends = sides.setdefault((ROLES[KINDS[kind]], bisect.bisect_right(breaks, start)), ([], []))
        starts.append(start)
        ends.append(end)
    for _, ends in sides.values():
        ends.sort()

    def near(role: str, scope: int, start: int, end: int) -> bool:
        starts, ends = sides.get((role, scope), ([], []))
        after, before = bisect.bisect_left(starts, end), bisect.bisect_right(ends, start) - 1
        return (after < len(starts) and starts[after] - end <= reach) or (before >= 0 and start - ends[before] <= reach)

    found = []
    for start, kind, end in weak:
        scope = bisect.bisect_right(breaks, start)
        wanted = ("identifier", "endpoint") if ROLES[KINDS[kind]] == "secret" else ("secret",)
        if any(near(role, scope, start, end) for role in wanted):
            found.append((start, kind, end))
    return found


def scopes_of(text: str) -> list[tuple[int, int]]:
    """The text's paragraphs as intervals."""
    cuts = [x for m in PARAGRAPH.finditer(text) for x in (m.start(), m.end())]
    return list(zip([0, *cuts[1::2]], [*cuts[::2], len(text)]))


def overlapping(scopes: list[tuple[int, int]], parts: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """The interval join: for each scope the parts (start, kind, end) that overlap it. Both are sorted by start; scopes are apart."""
    open_: list[tuple[int, int, int]] = []
    at = 0
    for start, end in scopes:
        open_ = [p for p in open_ if p[2] > start]
        while at < len(parts) and parts[at][0] < end:
            if parts[at][2] > start:
                open_.append(parts[at])
            at += 1
        yield list(open_)


def joined(base: list[tuple[int, int, int]], weak: list[tuple[int, int, int]], scopes: list[tuple[int, int]]) -> dict[tuple[int, int, int], int]:
    """The weak spans with a complementary part in a scope of theirs, and the code points to the nearest one (0: they overlap)."""
    candidates, found = set(weak), {}
    for parts in overlapping(scopes, sorted(base + weak)):
        own = [p for p in parts if p in candidates]
        if not own:
            continue
        sides: dict[str, tuple[list[int], list[int]]] = {}
        for start, kind, end in parts:
            starts, ends = sides.setdefault(ROLES[KINDS[kind]], ([], []))
            starts.append(start)
            ends.append(end)
        for starts, ends in sides.values():
            ends.sort()
        for span in own:
            for role in ("identifier", "endpoint") if ROLES[KINDS[span[1]]] == "secret" else ("secret",):
                if role in sides:
                    found[span] = min(found.get(span, 1 << 62), _distance(span, *sides[role]))
    return found


def _distance(span: tuple[int, int, int], starts: list[int], ends: list[int]) -> int:
    """Code points between a span and the nearest of the intervals with these (sorted) starts and ends."""
    start, _, end = span
    after, before = bisect.bisect_left(starts, end), bisect.bisect_right(ends, start)
    if after > before:  # some begin before the span's end, and don't end before its start
        return 0
    return min([x - end for x in starts[after : after + 1]] + [start - x for x in ends[max(0, before - 1) : before]])


def spans_of(text: str, reach: int | None = REACH) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and linked weak spans of a text, each as (start, kind, end); without ``reach`` the scope alone decides."""
    base, found = distances_of(text, reach)
    return base, sorted(found)


def distances_of(text: str, reach: int | None = None) -> tuple[list[tuple[int, int, int]], dict[tuple[int, int, int], int]]:
    """Base spans, and the linked weak spans with the distance to the part that confirms them (-1 with ``reach``, which bounds it)."""
    base = base_spans(text)
    weak = weak_spans(text, base)
    if not weak or len(base) + len(weak) < 2:
        return base, {}
    if reach is None:
        return base, joined(base, weak, scopes_of(text))
    return base, dict.fromkeys(linked(base, weak, [m.start() for m in PARAGRAPH.finditer(text)], reach), -1)


def scan(docs: DataFrame, text: str = "text", reach: int | None = None, names: tuple[str, str] = ("base", "linked"), distances: str | None = None) -> DataFrame:
    """``docs`` with the arrays of base and of linked spans under ``names`` (existing columns of these are replaced).

    Spans are struct<start, kind, end> in code points, end exclusive, by start and then by the order of
    KINDS. Weak parts are linked by their scope, unless ``reach`` is given; a scope is a paragraph, so that a
    text without a blank line is one scope of any length. ``distances`` names an array more: for each linked
    span the code points to the nearest complementary part. Null and empty texts have no spans; repeated rows
    and rows with null keys stay, each with its own; whole texts are searched. A text's parts never leave its
    row, so that nothing is shuffled.
    """
    spans = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))

    @F.arrow_udf(f"base {SPANS}, linked {SPANS}, distances array<bigint>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [(base, sorted(links), links) for run in texts_of(batch) for base, links in (distances_of(t, reach) for t in run)]
            both = [pa.array([[dict(zip(("start", "kind", "end"), x)) for x in row[i]] for row in rows], spans) for i in range(2)]
            far = pa.array([[links[x] for x in ordered] for _, ordered, links in rows], pa.list_(pa.int64()))
            yield pa.StructArray.from_arrays([*both, far], names=["base", "linked", "distances"])

    held = free_name(docs, "_spans")
    new = dict(zip(("base", "linked", "distances"), (*names, *[distances] * (distances is not None))))
    kept = [docs[c] for c in docs.columns if c.lower() not in {n.lower() for n in new.values()}]
    rows = docs.select(*kept, found(F.coalesce(docs[text], F.lit(""))).alias(held))
    return rows.select("*", *[F.col(held)[part].alias(name) for part, name in new.items()]).drop(held)


def as_text(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x.kind + 1), x.start.cast("string"), x.end.cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each of the spans (sorted, possibly overlapping) replaced by ``mark``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def rest(at: Column, size: Column) -> Column:
        return F.substring(text, (at + 1).cast("int"), size.cast("int"))

    def step(done: Column, span: Column) -> Column:
        new = F.struct(F.concat(done["out"], rest(done["at"], span["start"] - done["at"]), F.lit(mark)).alias("out"), span["end"].alias("at"))
        inside = F.struct(done["out"].alias("out"), F.greatest(done["at"], span["end"]).alias("at"))
        return F.when(span["start"] >= done["at"], new).otherwise(inside)

    return F.aggregate(spans, start, step, lambda done: F.concat(done["out"], rest(done["at"], F.char_length(text))))
