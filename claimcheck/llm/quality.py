"""Quality rules: text statistics, and how much likelier a text is in trusted texts than in the corpus.

Texts are bags of hashed one- and two-token features. Two multinomials over the buckets are counted: one
on trusted texts (labelled as good, a bounded sample), one on every text of the corpus. A document's score
is the log-likelihood ratio of its features by the number of features, and documents below a fixed
threshold are rejected, each on its own, so that the verdict doesn't depend on chance or on other batches.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimcheck.llm.shared import only, texts_of

#: Words of the base rules, tokens of the features, symbols.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"\w+|[^\w\s]+")
SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\x0b\x0c\r"

BUCKETS = 10_000
#: Rows of the labelled table that the trusted counts are taken from, at most: those with the smallest hash.
TRUSTED_ROWS = 20_000
#: Nats a feature. Texts of the trusted kind score about zero; a text of which a fifth is foreign scores below.
THRESHOLD = -0.5


class _Hashes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) > 150_000:
            self.clear()
        self[token] = found = xxhash.xxh64_intdigest(token.encode(), 1)
        return found


def _hashes() -> _Hashes:
    return only("hashes", _Hashes)


def features(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the tokens of a text and of its pairs of neighbouring tokens, in lower case."""
    tokens = TOKEN.findall(text.lower())
    one = np.fromiter(map(_hashes().__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (one[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    both = np.concatenate([one, two ^ (two >> np.uint64(29))])
    return (both % np.uint64(buckets)).astype(np.int64)


def feature_counts(docs: DataFrame, text: str, trusted: str, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, corpus, trusted): features of all texts and of those where ``trusted`` is true, added up in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            contents = (x for run in texts_of(batch.column(0)) for x in run)
            for content, is_good in zip(contents, batch.column(1).to_pylist()):
                found = np.bincount(features(content or "", buckets), minlength=buckets)
                corpus += found
                if is_good:
                    good += found
        used = np.flatnonzero(corpus)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(corpus[used]), pa.array(good[used])], names=["bucket", "corpus", "trusted"])

    partial = docs.select(F.col(text), F.col(trusted)).mapInArrow(count, "bucket int, corpus long, trusted long")
    return partial.groupBy("bucket").agg(F.sum("corpus").alias("corpus"), F.sum("trusted").alias("trusted"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log P(bucket | trusted) - log P(bucket | corpus), both with one added to each count; zero without trusted texts."""
    corpus, good = np.zeros(buckets), np.zeros(buckets)
    for row in counts.collect():  # `buckets` rows at most
        corpus[row.bucket], good[row.bucket] = row.corpus, row.trusted
    if not good.any():
        return np.zeros(buckets)
    return np.log((good + 1) / (good.sum() + buckets)) - np.log((corpus + 1) / (corpus.sum() + buckets))


def trusted_ids(labels: DataFrame, key: str = "doc_id", rows: int = TRUSTED_ROWS) -> DataFrame:
    """Keys labelled as good (``quality`` 1), each once: the ``rows`` ones with the smallest hash."""
    good = labels.where("quality = 1").select(key).where(F.col(key).isNotNull()).distinct()
    return good.orderBy(F.xxhash64(key), key).limit(rows)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, rows: int = TRUSTED_ROWS) -> np.ndarray:
    """The log ratios of all buckets, from one pass over all texts.

    The trusted keys are a broadcast of ``rows`` rows at most; texts aren't shuffled.
    """
    good = F.broadcast(trusted_ids(labels, key, rows).select(F.col(key).alias("_key"), F.lit(True).alias("_trusted")))
    marked = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(good, "_key", "left")
    return log_ratios(feature_counts(marked, "_text", "_trusted", buckets), buckets)


def statistics(text: str) -> dict[str, int]:
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if line.strip(BLANK)]
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        times, until = Counter(windows), 0
        for at, window in enumerate(windows):
            if times[window] > 1:
                repeated += at + 5 - max(until, at)
                until = at + 5
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(map(text.count, SYMBOLS)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeated,
    }


def _assessed(text: Column, ratios: np.ndarray) -> Column:
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    @F.arrow_udf(", ".join(f"{n} long" for n in names) + ", score double")
    def assess(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for content in (x or "" for run in texts_of(batch) for x in run):
                found = features(content, len(ratios))
                rows.append(statistics(content) | {"score": float(ratios[found].mean()) if len(found) else 0.0})
            yield pa.array(rows, pa.struct([*((n, pa.int64()) for n in names), ("score", pa.float64())]))

    return assess(text)


def assess(docs: DataFrame, ratios: np.ndarray, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed and kept.

    Every row gets a verdict of its own and stays; null and empty texts have no word and fail the base
    rules; existing columns of these names are replaced. ``kept`` is false where the base rules fail
    (under 10 words, or over a fifth of them in repeated windows of five), or the score is below ``threshold``.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept"]
    held = "_assessed"
    while held in docs.columns:
        held = "_" + held
    found = docs.select("*", _assessed(docs[text], ratios).alias(held))
    found = found.select(*[c for c in docs.columns if c.lower() not in new], F.col(f"{held}.*"))
    found = found.withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
