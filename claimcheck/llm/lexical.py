"""Ranked lexical search by a scan of the documents with an automaton of the terms that items ask for.

There is no index of documents. An Aho-Corasick automaton of the items' terms, each between two guards,
reads every text once and counts how often each term occurs; its outputs are numbers of terms, which a
table maps to the items that hold them. A text is read as UTF-8 bytes in which every byte that belongs to
no term is a guard, so that a guarded term matches whole words only.

The scan keeps what the automaton found: for each document its number of terms and the matched terms with
their counts. Document frequencies follow from that; then the documents are scored against the items, each
partition keeps its best ones, and these are merged.

Items are dealt into blocks of bounded size, each with its own automaton and scan, so that what is sent to
the tasks doesn't grow with the items.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimcheck.llm.shared import Scratch, only, saved, texts_of

#: Most items of a block, and most (item, term) pairs, if it has several items.
ITEMS, PAIRS = 2_000, 500_000
#: Bytes beyond which a term is replaced by its digest, in texts and items alike: no term of a block is longer.
LONG = 128
#: Documents that are scored at a time.
ROWS = 512
#: Bytes of a term stay, A-Z become small, all others become guards.
_FOLDED = bytes(b if b >= 128 or 48 <= b < 58 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order: runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in small letters."""
    terms = (text or "").encode().translate(_FOLDED).split()
    return [hashlib.sha256(t).hexdigest().encode() if len(t) > LONG else t for t in terms] if max(map(len, terms), default=0) > LONG else terms


def guarded(terms: list[bytes]) -> str:
    """The terms between guards, a byte a character."""
    return f" {b' '.join(terms).decode('latin-1')} "


def item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """(row, item, term, times): the terms of each item with their counts. Rows equal in both columns are one item, ``row`` names it."""

    @F.arrow_udf("array<struct<term: binary, times: bigint>>")
    def counted(texts: pa.Array) -> pa.Array:
        return pa.array([list(map(dict, (zip(("term", "times"), x) for x in Counter(terms_of(t.as_py())).items()))) for t in texts], pa.list_(pa.struct([("term", pa.binary()), ("times", pa.int64())])))

    rows = items.select(items[item].alias("item"), items[text].alias("text")).where("text IS NOT NULL").distinct()
    return rows.select(F.sha2(F.to_json(F.struct("item", "text")), 256).alias("row"), "item", F.inline(counted("text")))


def _dealt(wanted: DataFrame) -> list[DataFrame]:
    """``wanted`` by blocks, as many as keep each within its bounds, or as it takes to have one item in it."""
    n = 1
    while True:
        block = F.pmod(F.xxhash64("row"), F.lit(n))
        over = wanted.groupBy(block.alias("b")).agg(F.count("*").alias("pairs"), F.approx_count_distinct("row").alias("items"), F.min("row").alias("a"), F.max("row").alias("z"))
        worst = over.where("a <> z").agg(F.max("pairs"), F.max("items")).first()
        excess = max((worst[0] or 0) / PAIRS, (worst[1] or 0) / ITEMS)
        if excess <= 1:
            return [wanted.where(block == b) for b in range(n)]
        n = max(n + 1, math.ceil(n * excess * 1.2))


def _automaton(terms: list[bytes]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for number, term in enumerate(terms):
        made.add_word(guarded([term]), number)
    made.make_automaton()
    return made


def scanned(docs: DataFrame, document: str, text: str, terms: Broadcast) -> DataFrame:
    """(document, n, terms, counts): for each row its number of terms, and the numbers of those of ``terms`` (sorted) that occur with their counts."""
    name = f"automaton {uuid.uuid4().hex}"

    @F.arrow_udf("struct<n: bigint, terms: array<int>, counts: array<bigint>>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = only(name, lambda: _automaton(terms.value))
        for batch in batches:
            n, ends, numbers, counts = [], [0], [], []
            for run in texts_of(batch):
                for x in run:
                    words = terms_of(x)
                    # Matches overlap: the guard that ends a word begins the next.
                    found = Counter(number for _, number in automaton.iter(guarded(words))) if words else {}
                    n.append(len(words))
                    numbers += found.keys()
                    counts += found.values()
                    ends.append(len(numbers))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((numbers, pa.int32()), (counts, pa.int64()))]
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), *lists], ["n", "terms", "counts"])

    found = docs.select(docs[document].alias("document"), scan(F.coalesce(docs[text], F.lit(""))).alias("found"))
    return found.select("document", "found.*")


class Best:
    """The best documents of each item among those seen. Of equal scores the smaller document is better, null last."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.scores, self.documents = np.zeros((items, 0), dtype=np.int64), np.zeros((items, 0), dtype=np.int64)
        self.nameless = np.zeros((items, 0), dtype=bool)

    def add(self, scores: np.ndarray, documents: np.ndarray, nameless: np.ndarray) -> None:
        """``scores``: items by documents; ``nameless``: whether a document is null."""
        all_of = [np.concatenate([old, np.broadcast_to(new, scores.shape)], axis=1) for old, new in ((self.scores, scores), (self.documents, documents), (self.nameless, nameless))]
        order = np.lexsort((all_of[1], all_of[2], -all_of[0]), axis=1)[:, : self.top]
        self.scores, self.documents, self.nameless = (np.take_along_axis(x, order, 1) for x in all_of)


def _scored(found: DataFrame, block: Broadcast, total: int, length: int, top: int) -> DataFrame:
    """(at, document, score): for each item of the block, by its number, the best documents of each partition."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, starts, items, times, n_items = block.value
        best = Best(n_items, top)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                rows = whole.slice(at, ROWS)
                # In Python's own integers, which don't overflow before the division.
                m = np.array([75 + 25 * n * total // max(1, length) for n in rows.column("n").to_pylist()], dtype=np.int64)
                terms, tf = rows.column("terms"), rows.column("counts").flatten().to_numpy()
                row, term = np.repeat(np.arange(len(m)), np.diff(terms.offsets.to_numpy())), terms.flatten().to_numpy()
                part = weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[row]))
                # Each (document, term) counts for all items that hold the term.
                many = starts[term + 1] - starts[term]
                pair = np.arange(many.sum()) + np.repeat(starts[term] - np.cumsum(many) + many, many)
                scores = np.zeros((n_items, len(m)), dtype=np.int64)
                np.add.at(scores, (items[pair], np.repeat(row, many)), np.repeat(part, many) * times[pair])
                ids = rows.column("document")
                best.add(scores, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
        at = np.nonzero(best.scores > 0)
        yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(best.documents[at], mask=best.nameless[at]), pa.array(best.scores[at])], ["at", "document", "score"])

    return found.mapInArrow(score, "at bigint, document bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, document: str = "doc_id", item: str = "item_id", text: str = "text", top: int = 20) -> DataFrame:
    """For each item the ``top`` documents of highest score above 0: (item, rank from 1, document, score).

    ``document`` must be of integers. N is the number of documents with a term, L that of all their terms, n
    that of one document, df the documents with a term, tf its occurrences in a document. A term weighs
    w = floor(1000 * ln((2 N + 2) / (2 df + 1))); with m = 75 + (25 n N) div L a document's score is the sum of
    w * (1000000000 tf div (1000 tf + 12 m)) over the item's terms, repeats included. Equal scores come by
    ascending document, null last.

    Null texts have no terms. Repeated documents are ranked each; items equal in id and text are answered
    once, items of one id with different texts each with ranks of their own. Empty tables give no rows.
    Terms over ``LONG`` bytes are compared by their SHA-256.
    """
    spark = docs.sparkSession
    kind = dict(items.dtypes)[item]
    docs = docs.select(docs[document].cast("long").alias("document"), docs[text].alias("text"))
    ranked = []
    total = length = None
    with Scratch(spark) as scratch:
        wanted = scratch.saved(item_terms(items, item, text), "item-terms")
        for block in _dealt(wanted):
            terms = sorted(bytes(t) for (t,) in block.select("term").distinct().collect())
            names = [tuple(x) for x in block.select("row").distinct().sort("row").collect()]
            if not terms:
                continue
            with Scratch(spark) as step:
                found = step.saved(scanned(docs, "document", "text", spark.sparkContext.broadcast(terms)), "matches")
                if total is None:
                    total, length = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
                df = dict(map(tuple, found.select(F.explode("terms").alias("term")).groupBy("term").count().collect()))
                weights = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(terms))], dtype=np.int64)
                number, place = {t: i for i, t in enumerate(terms)}, {row: i for i, (row,) in enumerate(names)}
                pairs = np.array(sorted((number[bytes(t)], place[row], times) for row, t, times in block.select("row", "term", "times").collect()), dtype=np.int64)
                starts = np.searchsorted(pairs[:, 0], np.arange(len(terms) + 1))
                best = _scored(found, spark.sparkContext.broadcast((weights, starts, pairs[:, 1], pairs[:, 2], len(names))), total, length, top)
                of = spark.createDataFrame([(i, row) for row, i in place.items()], "at long, row string").join(block.select("row", "item").distinct(), "row")
                ranked.append(saved(best.join(F.broadcast(of), "at").select("row", "item", "document", "score"), "best"))  # at most ITEMS rows, or one
    if not ranked:
        return spark.createDataFrame([], f"`{item}` {kind}, rank int, `{document}` long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("document"))
    found = reduce(DataFrame.union, ranked).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return found.select(F.col("item").alias(item), "rank", F.col("document").alias(document), "score")
