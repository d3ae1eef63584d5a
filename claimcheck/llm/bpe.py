"""Byte-pair encoding in linear time by backtracking, and decoding through an offset table.

Merging pairs by rank gives the only sequence of tokens whose neighbours are all *compatible*: merging
the bytes of the two tokens alone gives the same two tokens. The encoder takes the longest token at each
place (found for all places by one Aho-Corasick pass), checks it against the token before, falls back to
the next shorter token, and steps back where none is left. Each place is given up at most once.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimcheck.llm.shared import only, texts_of
from claimcheck.llm.tokens import byte_letters

#: Fixed value: how the byte-level vocabulary cuts text into words (white space as Unicode defines it).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


_CUT = re.compile(r"(?= \S)")
#: Pieces longer than this are rare words, numbers or text without spaces: not worth keeping.
KEPT_CHARS = 48


#: Pairs of tokens whose compatibility a worker keeps.
PAIRS = 300_000


def safe_pieces(text: str) -> list[str]:
    """``text`` cut before each space that a non-space follows; the pieces joined are the text."""
    return _CUT.split(text)


class PieceCache:
    """Ids of words as little-endian unsigned 32-bit bytes, and of texts by looking up their words.

    ``encode_many`` encodes texts. A word stands for a space and itself. A full stop or comma after a
    letter is always a word of its own, so that words are encoded without it. Holds two generations of
    about ``limit`` words each: a full one becomes the old one, and what is used again moves to the new one.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], specials: list[str], limit: int = 150_000):
        self.encode_many, self.specials, self.limit = encode_many, specials, limit
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}  # texts as they are: first words, and words amid odd white space

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.limit:
            self.known, self.old = {}, self.known
        if len(self.pieces) > self.limit // 4:
            self.pieces = {}
        known, rows, heads, odd = self.known, [], [], {}
        for i, text in enumerate(texts):
            # White space before a special token ends a segment there, so such a text stays whole.
            special = any(s in text for s in self.specials)
            row = [] if special else text.split(" ")
            if special:
                odd[i] = [text]
            heads.append("" if special else row.pop(0))
            rows.append(row)
        fresh = set(chain.from_iterable(rows)).difference(known)
        # Such words are never known: the space before them belongs to the white space that follows.
        spaced = {w for w in fresh if not w or w[0].isspace()}
        if spaced:
            fresh -= spaced
            odd |= {i: safe_pieces(texts[i]) for i, row in enumerate(rows) if not spaced.isdisjoint(row)}
        self._learn_pieces({*heads, *chain.from_iterable(odd.values()), ".", ","})
        self._learn_words(fresh)
        pieces, word = self.pieces, known.__getitem__
        found = [b"".join(pieces[x] for x in odd[i]) if i in odd else pieces[heads[i]] + b"".join(map(word, row)) for i, row in enumerate(rows)]
        for x in fresh:
            if len(x) > KEPT_CHARS:
                del known[x]
        return found

    def _learn_pieces(self, pieces: set[str]) -> None:
        new = list(pieces.difference(self.pieces))
        self.pieces.update(zip(new, self.encode_many(new)))

    def _learn_words(self, fresh: set[str]) -> None:
        known, old = self.known, self.old
        if old:
            again = {w: old[w] for w in fresh if w in old}
            known.update(again)
            fresh = fresh.difference(again)
        ended = {w for w in fresh if w[-1:] in (".", ",") and w[-2:-1].isalpha()}
        bare = list({w[:-1] for w in ended}.difference(known) | (fresh - ended))
        known.update(zip(bare, self.encode_many([" " + w for w in bare])))
        for w in ended:
            known[w] = known[w[:-1]] + self.pieces[w[-1]]


class Vocabulary:
    """Token bytes, the two halves of each merged token, and the tables that encoding needs.

    Tokens are numbered by rank here: single bytes first, then merges in order.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, ids = byte_letters(), spec["model"]["vocab"]
        singles = [t for t in ids if len(t) == 1 and t in letters]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        names = singles + [a + b for a, b in merges]
        rank = {name: r for r, name in enumerate(names)}
        self.ids = [ids[name] for name in names]
        self.raw = [bytes(letters[c] for c in name) for name in names]
        self.merged = {(rank[a], rank[b]): len(singles) + i for i, (a, b) in enumerate(merges)}
        self.halves = [(r, r) for r in range(len(singles))] + [(rank[a], rank[b]) for a, b in merges]
        by_bytes_ = {raw: r for r, raw in enumerate(self.raw)}
        self.shorter = [next((by_bytes_[raw[:n]] for n in range(len(raw) - 1, 0, -1) if raw[:n] in by_bytes_), -1) for raw in self.raw]
        self.finder = ahocorasick.Automaton()
        for r, raw in enumerate(self.raw):
            self.finder.add_word(raw.decode("latin-1"), (r, len(raw)))
        self.finder.make_automaton()
        self.compatible: dict[int, bool] = {}  # pairs met so far, up to a bound
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.packed = [np.array([i], dtype="<u4").tobytes() for i in self.ids]
        # decoding: all token bytes in a row, and where each id's bytes begin and end
        texts = dict(zip(self.ids, self.raw)) | {i: name.encode() for name, i in self.specials.items()}
        ordered = [texts.get(i, b"") for i in range(max(texts) + 1)]
        self.blob = np.frombuffer(b"".join(ordered), dtype=np.uint8)
        self.sizes = np.array([len(x) for x in ordered], dtype=np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when their bytes are merged by rank.

        They don't if some merge across their border comes before the merges that close it. Undo the last
        merges on either side, latest first, and look for a merge of the two parts at the border that is
        earlier than all that were undone.
        """
        pair = left << 32 | right
        found = self.compatible.get(pair)
        if found is None:
            a, b, before = left, right, 1 << 60
            found = True
            while True:
                if self.merged.get((a, b), before) < before:
                    found = False
                    break
                (_, tail), (head, _) = self.halves[a], self.halves[b]
                if a > b:
                    # at equal rank the left merge is done first, so that a may only fall to what precedes it
                    if tail != a:
                        a, before = tail, a
                    elif head != b:
                        b, before = head, b + 1
                    else:
                        break
                elif head != b:
                    b, before = head, b + 1
                elif tail != a:
                    a, before = tail, a
                else:
                    break
            if len(self.compatible) >= PAIRS:
                self.compatible.clear()
            self.compatible[pair] = found
        return found

    def encode_word(self, word: bytes) -> list[int]:
        """Ranks of the tokens of one word."""
        size = len(word)
        longest = [0] * size
        for end, (r, n) in self.finder.iter(word.decode("latin-1")):
            longest[end - n + 1] = r  # ends ascend, so the last one for a start is the longest
        if len(self.raw[longest[0]]) == size:
            return [longest[0]]
        raw, shorter, fits = self.raw, self.shorter, self.fits
        open_ = [True] * (size + 1)  # whether a place may still be the border of tokens
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + len(raw[token])
            if open_[end] and (not out or fits(out[-1], token)):
                out.append(token)
                at = end
                if at == size:
                    return out
                token = longest[at]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                # nothing fits here: give the place up and shorten the token before
                open_[at] = False
                token = out.pop()
                at -= len(raw[token])

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        found = []
        for piece in pieces:
            ids: list[bytes] = []
            for k, part in enumerate(self._by_special.split(piece) if any(s in piece for s in self.specials) else [piece]):
                if k % 2:
                    ids.append(np.array([self.specials[part]], dtype="<u4").tobytes())
                else:
                    for word in self._words.findall(part):
                        ids += [self.packed[r] for r in self.encode_word(word.encode())]
            found.append(b"".join(ids))
        return found

    @functools.cached_property
    def _words(self):
        return regex.compile(WORDS)

    @functools.cached_property
    def _by_special(self):
        return regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")")

    def decode(self, ids: bytes) -> str:
        """Bytes of all ids gathered through the offset table, read as UTF-8 (invalid ones as U+FFFD)."""
        tokens = np.frombuffer(ids, dtype="<u4")
        sizes = self.sizes[tokens]
        ends = np.cumsum(sizes)
        where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begins[tokens] - (ends - sizes), sizes)
        return self.blob[where].tobytes().decode("utf-8", "replace")


def encoder(path: str) -> tuple[Vocabulary, PieceCache]:
    def make() -> tuple[Vocabulary, PieceCache]:
        v = Vocabulary(path)
        return v, PieceCache(v.encode_pieces, list(v.specials))

    return only(f"merges of {path}", make)


def encode(text: Column, path: str) -> Column:
    """Binary column: token ids of ``text`` (null: empty) as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("binary")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        _, cache = encoder(path)
        for batch in batches:
            yield pa.chunked_array([pa.array(cache.encode(run), pa.binary()) for run in texts_of(batch)], pa.binary()).combine_chunks()

    return ids(F.coalesce(text, F.lit("")))


def decode(ids: Column, path: str) -> Column:
    """String column: the text of the ids that ``encode`` gives (null: empty)."""

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v, _ = encoder(path)
        for batch in batches:
            yield pa.chunked_array([pa.array([v.decode(x) for x in run], pa.string()) for run in texts_of(batch)], pa.string()).combine_chunks()

    return text(F.coalesce(ids, F.lit(b"")))


def encode_documents(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the binary column ``ids`` (an existing one is replaced).

    Every row is kept; null texts count as empty and give no ids; texts are encoded whole.
    """
    return docs.withColumn(ids, encode(docs[text], path))


def decode_documents(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the string column ``text`` decoded from ``ids`` (an existing one is replaced)."""
    return docs.withColumn(text, decode(docs[ids], path))
