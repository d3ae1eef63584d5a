"""Token counts and token ids of whole texts, encoded in Arrow functions.

Vocabulary files of two kinds are encoded by rank: those of byte-level words with a space before them, and
those of lower-case words with an end mark. The rank encoder merges the neighbours whose joint bytes rank
first; the library behind the files merges listed pairs. The two agree if no token has a second split into
tokens that the listed pairs would leave apart, which is looked up for every token when a file is loaded
(``same_as_merges``); other files, and characters that need Unicode's normal forms, go to the library.

Texts are encoded whole, many in one call: a batch has texts of about a megabyte together, so that calls are
of like size whatever the texts' lengths. Long texts are cut before a space that a letter or digit follows,
where both kinds end a word anyway, so that encoding the parts gives the ids of the whole. A part that has no
such place for long (a run of a million spaces, say) goes to the library, whose patterns don't backtrack.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimcheck.llm.shared import by_bytes, only, texts_of

#: How the two kinds of vocabulary cut a text into words.
SPACED_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ENDED_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters that normal forms don't change and that every Unicode version in use classes alike: Latin,
#: basic Cyrillic, punctuation, currency, common ideographs and syllables. Not the end mark, and not the
#: separators that Python alone takes for white space.
PLAIN = "\x01-\x1b\x20-ɏА-я‐-‧‰-⁞₠-₿、-〃〈-】一-龥가-힣"
_ODD = re.compile(f"[^{PLAIN}]")
_CUT = re.compile(r"(?= [A-Za-z0-9])")
END, BETWEEN = "\x00", "\x1f"  # neither is plain
#: Stands between the texts of a batch; two code points that are no characters. Texts that hold it are encoded alone.
BREAK = "\ufdd0\ufdd1"
#: Characters of a part of a long text.
PART = 1 << 16
#: Words whose ids a worker keeps, and characters of a word that is worth keeping.
KEPT, KEPT_CHARS = 300_000, 40


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files of this kind."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def library_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def safe_parts(text: str, size: int = PART) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters, each cut before a space that a letter or digit follows."""
    start = 0
    while len(text) - start > size and (cut := _CUT.search(text, start + size)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def same_as_merges(ranks: dict[bytes, int], merges: dict[tuple[bytes, bytes], int]) -> bool:
    """Whether merging by the rank of the joint bytes gives what merging the listed pairs gives, for any text.

    If the two part, it is at some pair of neighbours whose joint bytes are a token, but not by this pair:
    then the listed pairs, applied to these bytes alone, end with the pair as well.
    """
    halves = {a + b: (a, b) for a, b in merges}

    def apart(a: bytes, b: bytes) -> bool:
        # Undo merges on either side of the border, latest first; one across the border must not come before them.
        undone = len(merges) + 1
        while merges.get((a, b), undone) >= undone:
            left, right = (merges.get(halves.get(x), -1) for x in (a, b))
            if left < 0 and right < 0:
                return True
            if left > right:
                a, undone = halves[a][1], left
            else:
                b, undone = halves[b][0], right + 1  # at equal rank the left one is merged first
        return False

    for token, own in halves.items():
        for at in range(1, len(token)):
            pair = token[:at], token[at:]
            if pair != own and pair[0] in ranks and pair[1] in ranks and apart(*pair):
                return False
    return True


class RankEncoder:
    """Ids of texts by a vocabulary file of one of the two kinds; ``of`` gives None for files of another kind."""

    def __init__(self, path: str, spec: dict, ended: bool):
        import tiktoken

        letters, suffix, self.ended = byte_letters(), spec["model"]["end_of_word_suffix"] or "", ended

        def raw(name: str) -> bytes:
            if suffix and name.endswith(suffix):
                return bytes(letters[c] for c in name.removesuffix(suffix)) + END.encode()
            return bytes(letters[c] for c in name)

        # An end mark belongs to the character before it, so that it is merged before all else.
        singles = [bytes([b]) for b in range(256)]
        pairs = [(x, END.encode()) for x in singles if ended] + [tuple(map(raw, m.split(" ") if isinstance(m, str) else m)) for m in spec["model"]["merges"]]
        ranks = {x: i for i, x in enumerate(dict.fromkeys([*singles, *(a + b for a, b in pairs)]))}
        ids = {raw(name): i for name, i in spec["model"]["vocab"].items()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        marks = {} if ended else {s: len(ranks) + i for i, s in enumerate(self.specials)}
        self.table = np.array([*(ids.get(x, 0) for x in ranks), *(self.specials[s] for s in marks), 0], dtype="<u4")
        self.cut = len(self.table) - 1
        self.sound = ids.keys() <= ranks.keys() and same_as_merges(ranks, {p: i for i, p in enumerate(pairs)})
        self.core = tiktoken.Encoding(path, pat_str=f"[^{END}]+{END}" if ended else SPACED_WORDS, mergeable_ranks=ranks, special_tokens=marks | {BREAK: self.cut})._core_bpe
        self.marks, self.words, self.path = set(marks), regex.compile(ENDED_WORDS), path
        self.special = re.compile("|".join(map(re.escape, self.specials)) or r"(?!)")
        self._library = None
        self._kept: dict[str, bytes] = {}
        self._between = ranks.get((BETWEEN + END).encode(), -1)

    @classmethod
    def of(cls, path: str) -> RankEncoder | None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut, normal = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        odd = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")) or model["type"] != "BPE"
        odd = odd or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or t["content"][:1].isalnum() for t in spec["added_tokens"])
        spaced = not normal and not model["end_of_word_suffix"] and cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"]
        steps = cut.get("pretokenizers", [])
        ended = (
            bool(model["end_of_word_suffix"]) and [n["type"] for n in (normal or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [s["type"] for s in steps] == ["Split", "ByteLevel"]
            and steps[0]["pattern"] == {"Regex": ENDED_WORDS} and steps[0]["invert"] and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"]
        )
        found = cls(path, spec, ended) if (spaced or ended) and not odd else None
        return found if found and found.sound else None

    def encode(self, text: str) -> bytes:
        return b"".join(map(self._part, safe_parts(text))) if len(text) > PART else self._part(text)

    def _joined(self, texts: list[str]) -> tuple[np.ndarray, list[int]] | None:
        """Ranks of the texts in one call, and where each ends; None if they can't be told apart or are long."""
        joined = BREAK.join(texts)
        if self.ended or max(map(len, texts)) > PART or joined.count(BREAK) != len(texts) - 1:
            return None
        ranks = np.frombuffer(self.core.encode_to_tiktoken_buffer(joined, self.marks | {BREAK}), dtype="<u4")
        return ranks, [*np.flatnonzero(ranks == self.cut).tolist(), len(ranks)]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        if not texts or not (found := self._joined(texts)):
            return [self.encode(x) for x in texts]
        raw, ends = self.table[found[0]].tobytes(), found[1]
        return [raw[4 * a : 4 * b] for a, b in zip([0, *(e + 1 for e in ends)], ends)]

    def lengths(self, texts: list[str]) -> list[int]:
        if not texts or not (found := self._joined(texts)):
            return [len(self.encode(x)) // 4 for x in texts]
        return [b - a for a, b in zip([0, *(e + 1 for e in found[1])], found[1])]

    def _ranked(self, text: str) -> bytes:
        if len(text) > 2 * PART or BREAK in text:
            return self._by_library(text)
        return self.table[np.frombuffer(self.core.encode_to_tiktoken_buffer(text, self.marks), dtype="<u4")].tobytes()

    def _part(self, text: str) -> bytes:
        if not self.ended:
            return self._ranked(text)
        if "<" in text and self.special.search(text):
            return self._by_library(text)
        if _ODD.search(text):
            return b"".join(self._by_library(x) if _ODD.search(x) else self._ended(x) for x in safe_parts(text, 500))
        return self._ended(text)

    def _ended(self, text: str) -> bytes:
        """Ids of a text by its words, which end at white space and can so be kept; unknown ones are encoded in one call."""
        known, words = self._kept, text.lower().split()
        if new := list(set(words).difference(known)):
            runs = self.words.findall(f" {BETWEEN} ".join(new))
            ranks = np.frombuffer(self.core.encode_to_tiktoken_buffer(END.join([*runs, ""]), set()), dtype="<u4")
            raw, ends = self.table[ranks].tobytes(), [4 * i for i in np.flatnonzero(ranks == self._between).tolist()]
            known.update(zip(new, (raw[a:b] for a, b in zip([0, *(e + 4 for e in ends)], [*ends, len(raw)]))))
        found = b"".join(map(known.__getitem__, words))
        if len(known) > KEPT:
            known.clear()
        for word in new:
            if len(word) > KEPT_CHARS:
                known.pop(word, None)
        return found

    def _by_library(self, text: str) -> bytes:
        self._library = self._library or library_tokenizer(self.path)
        return np.array(self._library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


class LibraryEncoder:
    """Ids of texts by the library of the vocabulary file, a batch in one call."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._ids = lambda texts: model.encode(texts, num_threads=1)
        else:
            tokenizer = library_tokenizer(path)
            self._ids = lambda texts: [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        return [np.array(ids, dtype="<u4").tobytes() for ids in self._ids(texts)]

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self._ids(texts)]


def encoder(path: str) -> RankEncoder | LibraryEncoder:
    return only(f"encoder of {path}", lambda: (None if path.endswith(".model") else RankEncoder.of(path)) or LibraryEncoder(path))


def vocabulary_size(path: str) -> int:
    """One more than the largest id of a vocabulary file."""
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path).vocab_size()
    return max(library_tokenizer(path).get_vocab(with_added_tokens=True).values()) + 1


def encoded(texts: list[str], path: str) -> Iterator[bytes]:
    """Ids of each text as the library of the vocabulary file gives them, without added tokens."""
    encode_all = encoder(path).encode_all
    for run in by_bytes(texts):
        yield from encode_all(run)


def lengths(texts: list[str], path: str) -> Iterator[int]:
    """Numbers of tokens of each text; no ids are made."""
    of = encoder(path).lengths
    for run in by_bytes(texts):
        yield from of(run)


def token_ids(text: Column, path: str) -> Column:
    """Binary column: the ids of ``text`` (null: empty) as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("binary")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.chunked_array([pa.array(encoded(run, path), pa.binary()) for run in texts_of(batch)], pa.binary()).combine_chunks()

    return ids(F.coalesce(text, F.lit("")))


def token_count(text: Column, path: str) -> Column:
    """Long column: the number of tokens of ``text`` (null: empty); only lengths leave the function."""

    @F.arrow_udf("bigint")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array((n for run in texts_of(batch) for n in lengths(run, path)), pa.int64())

    return count(F.coalesce(text, F.lit("")))


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 512, names: tuple[str, str, str] = ("n_bytes", "n_tokens", "over_limit")) -> DataFrame:
    """``docs`` with UTF-8 bytes, tokens and whether these exceed ``limit``, under ``names``.

    Every row is kept: repeated rows are counted each, a null text is empty (0 bytes, 0 tokens), texts of
    any length are counted whole. An existing column of one of ``names`` is replaced; all others stay.
    The scan isn't shuffled, and the text doesn't come back from Python.
    """
    n_bytes, n_tokens, over = names
    content = docs[text]
    return (
        docs.select(*[docs[c] for c in docs.columns if c.lower() not in {n.lower() for n in names}], F.octet_length(F.coalesce(content, F.lit(""))).cast("long").alias(n_bytes), token_count(content, path).alias(n_tokens))
        .withColumn(over, F.col(n_tokens) > limit)
    )
