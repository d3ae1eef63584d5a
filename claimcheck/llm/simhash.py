"""Near-duplicate documents by SimHash, with Golay-code fuzzy hashing for the candidate search.

A fingerprint holds one bit for each bit of a 64-bit shingle hash: set if set in over half of the shingles.
Wide fingerprints use several such words, from hashes derived from the first one.

Candidates come from the perfect binary Golay code (23 bits, 12 of them information, radius 3). A 23-bit
segment is decoded to every codeword within distance 4: one if it lies within 2 of a codeword, otherwise
six. Two segments that differ in two bits or fewer always share a codeword (decode the word half-way
between them). A key is a pair of segments with one codeword index of each.

* Exact search (``links``): the 64 bits are cut into segments of 22, 21 and 21 bits. Of four differing
  bits, some two segments hold two at most, so that the pair shares a key in one of the three tables; no
  pair within four bits is missed.
* Search for similar sets (``similar``): each word has a table of its own, of two 23-bit segments, and there
  are as many words as a wanted recall asks for. Candidates are decided on their whole sets of shingles.

Rows with one key meet by a sort on the key. Pairs are verified there, and a key with many rows yields the
edges of a spanning forest of its verified links, not the links: their components are the same. A task holds
at most ``BLOCK`` rows of a key: those of a larger key pass through it as they are, and are then dealt into
blocks, each pair of which is a group of its own.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimcheck.llm.shared import Scratch, saved, texts_of

#: The generator polynomial of the Golay code, and the seed of the shingle hash.
GENERATOR = 0b101011100011
SEED = 42
#: Most rows of a key that a task compares at once (memory only: results are the same for any value).
BLOCK = 1 << 14


# --- fingerprints ---------------------------------------------------------------------------------


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of all shingles of a text, repeats included; A-Z count as a-z; fewer words are one shingle."""
    found = text.encode().translate(_LOWER).split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    spans = zip(starts, ends[words - 1 :].tolist())
    return np.array([digest(joined[a:b], SEED) for a, b in spans], dtype=np.uint64)


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _derived(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash of the same shingles (the 0-th is the hash itself), by a 64-bit finaliser."""
    if not k:
        return hashes
    x = hashes + np.uint64((k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(hashes: np.ndarray, count: int = 1) -> list[int]:
    """``count`` signed 64-bit words of the fingerprint of shingle hashes (none: all zero)."""
    if not len(hashes):
        return [0] * count
    found = []
    for k in range(count):
        ones = np.zeros(64, dtype=np.int64)
        for i in range(0, len(hashes), 1 << 14):
            part = _derived(hashes[i : i + (1 << 14)], k).astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        found.append(int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0]))
    return found


def fingerprints(text: Column, words: int = 4) -> Column:
    """The fingerprint of each text (null: empty), an array of one long."""

    @F.arrow_udf("array<bigint>")
    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([fingerprint(shingle_hashes(t or "", words)) for run in texts_of(batch) for t in run], pa.list_(pa.int64()))

    return prints(text)


# --- Golay keys -----------------------------------------------------------------------------------


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where((rest >> bit) & 1 == 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


@functools.lru_cache(maxsize=1)
def error_patterns() -> np.ndarray:
    """For each syndrome the errors of four bits or fewer that have it: one, or six; -1 fills the row."""
    patterns = np.array([sum(1 << b for b in bits) for n in range(5) for bits in combinations(range(23), n)])
    table = np.full((2048, 6), -1)
    taken = [0] * 2048
    for s, pattern in zip(syndrome(patterns).tolist(), patterns.tolist()):  # lighter ones first
        if taken[s] == 0 or table[s, 0].item().bit_count() == 3:
            table[s, taken[s]] = pattern
            taken[s] += 1
    return table


def codewords(segments: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords within distance 4 of each segment; -1 fills the six columns."""
    patterns = error_patterns()[syndrome(segments)]
    return np.where(patterns < 0, -1, (segments[:, None] ^ patterns) >> 11)


def exact_tables(prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of segments of one-word fingerprints such that four differing bits leave two at most in some pair."""
    word = prints[:, 0].view(np.uint64)
    cut = [(word & np.uint64((1 << 22) - 1)), (word >> np.uint64(22)) & np.uint64((1 << 21) - 1), word >> np.uint64(43)]
    parts = [x.astype(np.int64) for x in cut]
    yield from combinations(parts, 2)


def wide_tables(prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Two segments of each word."""
    for k in range(prints.shape[1]):
        word = prints[:, k].view(np.uint64)
        yield tuple(((word >> np.uint64(shift)) & np.uint64((1 << 23) - 1)).astype(np.int64) for shift in (0, 23))


def keys(prints: np.ndarray, tables: Callable[[np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for all keys of all fingerprints."""
    rows, found = [], []
    for number, (left, right) in enumerate(tables(prints)):
        a, b = codewords(left), codewords(right)
        key = (a[:, :, None] << 12 | b[:, None, :]) + (number << 24)
        row, i, j = np.nonzero((a[:, :, None] >= 0) & (b[:, None, :] >= 0))
        rows.append(row)
        found.append(key[row, i, j])
    return np.concatenate(rows), np.concatenate(found)


# --- links ----------------------------------------------------------------------------------------


def forest(prints: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges (row, row) of a spanning forest of the pairs of (unsigned) fingerprints that differ in ``most`` bits or fewer."""
    left, rest = np.arange(len(prints)), prints
    edges: list[tuple[int, int]] = []
    while len(left) > 1:
        waiting, left, rest = [int(left[0])], left[1:], rest[1:]
        while waiting and len(left):
            node = waiting.pop()
            apart = np.bitwise_count(rest ^ prints[node])
            near = (apart[:, 0] if apart.shape[1] == 1 else apart.sum(axis=1)) <= most
            if near.any():
                reached = left[near]
                edges += [(node, int(x)) for x in reached]
                waiting += reached.tolist()
                left, rest = left[~near], rest[~near]
    return edges


def _edges_of_runs(nodes: np.ndarray, keyed: np.ndarray, prints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of all keys of rows sorted by key."""
    begins = np.flatnonzero(np.r_[True, keyed[1:] != keyed[:-1]])
    sizes = np.diff(np.r_[begins, len(keyed)])
    pairs = begins[sizes == 2]
    near = np.bitwise_count(prints[pairs] ^ prints[pairs + 1]).sum(axis=1) <= most
    left, right = [pairs[near]], [pairs[near] + 1]
    for at, size in zip(begins[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        if edges := forest(prints[at : at + size], most):
            a, b = np.array(edges).T
            left.append(a + at)
            right.append(b + at)
    a, b = nodes[np.concatenate(left)], nodes[np.concatenate(right)]
    return np.minimum(a, b), np.maximum(a, b)


def whole_runs(batches: Iterator[pa.RecordBatch], key: Callable[[list[np.ndarray]], np.ndarray], most: int | None = None) -> Iterator[tuple[bool, list[np.ndarray]]]:
    """(whole, columns) of sorted batches, dealt anew so that the rows of a key stay together.

    Batches of one key that goes on are set aside and joined once, when it ends. Rows of a key of more than
    ``most`` rows come in parts, as they arrive, and aren't ``whole``.
    """
    held: list[list[np.ndarray]] = []
    size, passing = 0, False  # of the key held; whether its rows are passed on as they come

    def joined(*more: list[np.ndarray]) -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*held, *more)]

    for batch in batches:
        if not batch.num_rows:
            continue
        now = [c.to_numpy() for c in batch.columns]
        keyed = key(now)
        if (held or passing) and keyed[0] == current:
            end = int(np.searchsorted(keyed, current, side="right"))
            held.append([c[:end] for c in now])
            size += end
            passing = passing or (most is not None and size > most)
            if passing:
                yield False, joined()
                held = []
            now, keyed = [c[end:] for c in now], keyed[end:]
            if not len(keyed):
                continue
        if held:
            yield True, joined()
        held, passing = [], False
        begins = np.flatnonzero(np.r_[True, keyed[1:] != keyed[:-1]])
        ends = np.r_[begins[1:], len(keyed)]
        large = ends - begins > (most if most is not None else len(keyed))
        last = int(begins[-1])  # the last key may go on in the next batch
        few = np.repeat(~large, ends - begins)
        few[last:] = False
        if few.any():
            yield True, [c[few] for c in now]
        for at, end in zip(begins[large].tolist(), ends[large].tolist()):
            yield False, [c[at:end] for c in now]
        current, size, passing = keyed[-1], len(keyed) - last, bool(large[-1])
        if not passing:
            held = [[c[last:] for c in now]]
    if held:
        yield True, joined()


#: Bits for a pair of blocks beside the key (tables have 29 bits of key at most).
PAIR = 34


def in_blocks(rows: DataFrame, key: Column) -> DataFrame:
    """``rows`` (node, ...) of large keys with a group for each pair of blocks of a key, sorted by group, and ``own``, the row's block.

    A key of n rows has n / ``BLOCK`` blocks by a hash of the node, and each row goes to the groups of its
    block with every block: each pair of rows meets, in a group of about 2 * ``BLOCK`` rows (of larger ones
    where a key has over 2^31 rows). The upper bits of the group are the key.
    """
    names, rows = rows.columns, rows.withColumn("_key", key)
    blocks = rows.groupBy("_key").agg(F.least(F.ceil(F.count("*") / BLOCK), F.lit(1 << PAIR // 2)).alias("_blocks"))
    dealt = rows.join(blocks, "_key").withColumn("own", F.pmod(F.xxhash64("node"), "_blocks")).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    pair = F.least("own", "_other") * F.col("_blocks") + F.greatest("own", "_other")
    shards = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.select(*names, "own", (F.shiftleft("_key", PAIR) + pair).alias("group")).repartition(shards, "group").sortWithinPartitions("group")


def links(prints: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """(low, high): edges among the rows (node long, words array<long>) of ``prints``, whose nodes are unique.

    Two nodes are connected by edges if a chain of links connects them: pairs of one-word fingerprints that
    differ in ``most`` bits (4 at most) or fewer. ``scratch`` holds the edges while they are read.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                words = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                row, key = keys(words, exact_tables)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(batch.column(0).to_numpy()[row]), pa.array(words[row, 0])], names=["key", "node", "word"])

    def edges(node: np.ndarray, run: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # of signed numbers, numpy counts the bits of the absolute value
        return _edges_of_runs(node, run, word[:, None].view(np.uint64), most)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, (key, node, word) in whole_runs(batches, lambda c: c[0], BLOCK):
            low, high = edges(node, key, word) if whole else (node, node)
            late = pa.nulls(len(low), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), *((late, late) if whole else (pa.array(key), pa.array(word)))], names=["low", "high", "late", "word"])

    def sweep_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (node, word, group) in whole_runs(batches, lambda c: c[2]):
            low, high = edges(node, group, word)
            yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], names=["low", "high"])

    shards = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = prints.select("node", "words").mapInArrow(spread, "key long, node long, word long")
    found = keyed.repartition(shards, "key").sortWithinPartitions("key").mapInArrow(sweep, "low long, high long, late long, word long")
    found = scratch.saved(found, "links")
    late = in_blocks(found.where("late IS NOT NULL").select(F.col("low").alias("node"), "word", "late"), F.col("late")).select("node", "word", "group")
    return found.where("late IS NULL").select("low", "high").union(late.mapInArrow(sweep_blocks, "low long, high long")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of the connected component of each node of the edges (low, high).

    Alternates large-star and small-star steps until nothing changes; each step writes its edges to the
    shared folder. The number of steps grows with the logarithm of the number of nodes.
    """

    def told(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.hash("low", "high")), F.bit_xor(F.xxhash64("low", "high"))).first()

    with Scratch(edges.sparkSession) as scratch:
        now = scratch.saved(edges.select("low", "high").where("low < high").distinct(), "edges")
        state, before = told(now), None
        while state != before and state[0]:
            # Both sides of each join are tables at rest, so that Spark can split the partition of a node with many edges.
            both = now.union(now.select("high", "low")).toDF("node", "other")
            least = scratch.saved(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("least")), "least")
            large = both.join(least, "node").where("other > node").select(F.col("least").alias("low"), F.col("other").alias("high")).distinct()
            large = scratch.saved(large, "edges")
            least = scratch.saved(large.groupBy("high").agg(F.min("low").alias("least")), "least")
            small = large.join(least, "high")
            small = small.select("least", "high").union(small.where("low > least").select("least", "low")).toDF("low", "high").distinct()
            now = scratch.saved(small, "edges")
            scratch.clear(last=1)
            state, before = told(now), state
        return saved(now.select(F.col("high").alias("node"), F.col("low").alias("component")).union(now.select("low", "low").distinct()), "components")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, most: int = 4, names: tuple[str, str] = ("fingerprint", "component_id")) -> DataFrame:
    """One row for each row of ``docs``: its ``key``, fingerprint (array of one long) and component.

    The component is the smallest ``key`` (of any type that has an order) reachable by links, the row's own
    included. Rows link if their fingerprints differ in ``most`` (4 at most) bits or fewer; none is missed.

    Null and empty texts have fingerprint zero and link like others. Rows with equal fingerprints always
    link and count once in the search, so that a large group of copies costs no more than one of them.
    A null ``key`` takes part but names a component only where all its keys are null. Repeated rows stay,
    other columns don't matter, and an empty table gives an empty one.
    """
    if most > 4:
        raise ValueError("the tables find links of 4 bits at most")
    fp, component = names
    own = saved(docs.select(F.col(key).alias("key"), fingerprints(docs[text], words).alias("words")), "fingerprints")
    with Scratch(docs.sparkSession) as scratch:
        group = scratch.saved(own.groupBy("words").agg(F.min("key").alias("least")).withColumn("node", F.monotonically_increasing_id()), "groups")
        smallest = labels(group, links(group, most, scratch)).select("words", "smallest")
    return own.join(smallest, "words").select(F.col("key").alias(key), F.col("words").alias(fp), F.col("smallest").alias(component))


def labels(group: DataFrame, edges: DataFrame) -> DataFrame:
    """``group`` (node, least, ...) with ``smallest``, the smallest ``least`` of the nodes that edges connect."""
    with Scratch(group.sparkSession) as scratch:
        found = components(edges)
        linked = scratch.saved(group.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "groups")
        smallest = scratch.saved(linked.groupBy("component").agg(F.min("least").alias("smallest")), "smallest")
        return saved(linked.join(smallest, "component").drop("component"), "labelled")


# --- similar sets ---------------------------------------------------------------------------------

#: How often two 23-bit words that differ in 0 to 8 bits share a codeword within distance 4.
SHARED = (1.0, 1.0, 1.0, 0.593, 0.59, 0.186, 0.191, 0.034, 0.033)
#: Wanted share of the pairs at the least similarity.
RECALL = 0.99
#: Bits of another word that travel with a key; rows of a key that are compared all at once, and pairs that it proposes all.
CARRIED, FEW = 34, 32
#: Sets of so few shingles have twice the tables (with few votes a bit changes more often), and sets of so few
#: are decided without a look at their whole fingerprints.
SMALL, SHORT = 24, 64
#: Words of a set's parities, and those that travel with a key (the others folded onto them).
PARITIES, FOLDED = 8, 4
#: A task holds so many times ``BLOCK`` rows of a first segment's codeword, as it opens them to keys itself.
OPENED = 4


def differing(least: float) -> float:
    """The share of bits that differ, on average, between fingerprints of sets of similarity ``least`` (equally large ones)."""
    return math.acos(2 * least / (1 + least)) / math.pi


def tables_wanted(least: float, recall: float = RECALL) -> int:
    """Tables of two segments in one of which a pair of similarity ``least`` shares a key with probability ``recall``."""
    p = differing(least)
    segment = sum(math.comb(23, d) * p**d * (1 - p) ** (23 - d) * share for d, share in enumerate(SHARED))
    return math.ceil(math.log(1 - recall) / math.log(1 - segment**2))


def most_bits(least: float, bits: int, off: float) -> int:
    """Bits of ``bits`` that differ between such sets, and ``off`` standard deviations more."""
    p = differing(least)
    return int(bits * p + off * math.sqrt(bits * p * (1 - p)))


def parities(hashes: np.ndarray) -> list[int]:
    """For each of ``PARITIES`` * 64 classes of hashes (by their lowest bits) whether a set has an odd number of them, as signed words.

    Sets that differ in n hashes differ in n of these bits or fewer, so that what the bits rule out is no guess.
    """
    odd = np.bincount((hashes & np.uint64(64 * PARITIES - 1)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def sketches(text: Column, words: int, count: int) -> Column:
    """For each text (null: empty) a digest of its set of shingle hashes, the set's size, its fingerprint and parities."""

    @F.arrow_udf("digest binary, size int, words array<bigint>, odd array<bigint>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for own in (np.unique(shingle_hashes(t or "", words)) for run in texts_of(batch) for t in run):
                rows.append((xxhash.xxh3_128_digest(own.tobytes()), len(own), fingerprint(own, 2 * count if len(own) <= SMALL else count), parities(own)))
            parts = [pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())))]
            yield pa.StructArray.from_arrays(parts, names=["digest", "size", "words", "odd"])

    return found(text)


def shingle_sets(text: Column, words: int) -> Column:
    """For each text (null: empty) its set of shingle hashes and the set's digest."""

    @F.arrow_udf("digest binary, hashes array<bigint>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t or "", words)) for run in texts_of(batch) for t in run]
            ends = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
            hashes = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.StructArray.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), hashes], names=["digest", "hashes"])

    return found(text)


def verified(pairs: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """The pairs (low, high) whose sets (node, hashes) have a Jaccard similarity of ``least`` or more."""
    a, b = sets.toDF("low", "low_set"), sets.toDF("high", "high_set")
    both = F.size("low_set") + F.size("high_set")
    common = F.size(F.array_intersect("low_set", "high_set"))  # of both - common
    near = common * (least.numerator + least.denominator) >= both * least.numerator
    return pairs.join(a, "low").join(b, "high").where(near).select("low", "high")


def _first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest codeword index that two segments share, for each pair of segments; 4096 if none."""
    own, other = codewords(a), codewords(b)
    shared = ((own[:, :, None] == other[:, None, :]) & (own[:, :, None] >= 0)).any(axis=2)
    return np.where(shared, own, 4096).min(axis=1)


def _meet_first(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the key is the first one of its table that the two words (of two segments each) share."""
    mask = (1 << 23) - 1
    return (_first_common(a & mask, b & mask) == (key >> 12) & 4095) & (_first_common(a >> 23, b >> 23) == key & 4095)


def _apart(bits: np.ndarray, word: np.ndarray, a, b) -> np.ndarray:
    """Differing bits of rows a and b: those carried, and the 46 of the table."""
    return np.bitwise_count(bits[a] ^ bits[b]).astype(np.int64) + np.bitwise_count(word[a] ^ word[b])


def _folded(prints: DataFrame, *more: str) -> DataFrame:
    """(node, words, ..., size, odd0, ...): with the parities folded to ``FOLDED`` words, of which the same holds."""
    folds = [functools.reduce(lambda x, y: x.bitwiseXOR(y), [F.get("odd", F.lit(i)) for i in range(k, PARITIES, FOLDED)]) for k in range(FOLDED)]
    return prints.select("node", "words", *more, F.col("size").cast("long"), *(x.alias(f"odd{k}") for k, x in enumerate(folds)))


def _allowed(size: np.ndarray, odd: np.ndarray, a, b, share: Fraction) -> np.ndarray:
    """Whether the parities of rows a and b leave room for a Jaccard similarity of ``share``."""
    unlike = np.bitwise_count(odd[a] ^ odd[b]).sum(axis=1, dtype=np.int64)
    return unlike * (share.denominator + share.numerator) <= (size[a] + size[b]) * (share.denominator - share.numerator)


def _spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b) join what no pair before them has joined."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    kept = np.zeros(len(a), dtype=bool)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = find(x), find(y)
        if x != y:
            root[y] = x
            kept[i] = True
    return kept


def _forest_here(bits: np.ndarray, word: np.ndarray, size: np.ndarray, odd: np.ndarray, key: int, most: int, share: Fraction) -> list[tuple[int, int]]:
    """Edges (row, row) of a spanning forest of the pairs of rows that are near, that their parities allow and that meet first under ``key``."""
    parts = [(codewords(x), index) for x, index in ((word & ((1 << 23) - 1), (key >> 12) & 4095), (word >> 23, key & 4095))]
    left = np.arange(len(bits))
    edges: list[tuple[int, int]] = []
    while len(left) > 1:
        waiting, left = [int(left[0])], left[1:]
        while waiting and len(left):
            row = waiting.pop()
            near = _apart(bits, word, left, row) <= most
            near[near] = _allowed(size, odd, left[near], np.array([row]), share)
            for own, index in parts:
                at = np.flatnonzero(near)
                other = own[left[at]]
                shared = (other[:, :, None] == own[row][own[row] >= 0]).any(axis=2)
                near[at] = np.where(shared, other, 4096).min(axis=1) == index
            if near.any():
                reached = left[near]
                edges += [(row, int(x)) for x in reached]
                waiting += reached.tolist()
                left = left[~near]
    return edges


def _keyed(prints: DataFrame, whole: bool = True) -> DataFrame:
    """(packed, node, word, ...): for each key of each row, the key and bits of another word, the table's own bits, and the columns after (node, words), sorted by key.

    If not ``whole``, a row for the codewords of the first segment only, a fifth as many: ``_opened`` makes the keys of them.
    """
    names = [c for c in prints.columns if c not in ("node", "words")]
    mask = np.uint64((1 << CARRIED) - 1)

    def halves(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, found = [], []
        for number, (left, _) in enumerate(wide_tables(words)):
            own = codewords(left)
            row, i = np.nonzero(own >= 0)
            rows.append(row)
            found.append(own[row, i] + (number << 12))
        return np.concatenate(rows), np.concatenate(found)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for all_rows in batches:
            for at in range(0, all_rows.num_rows, 512):
                batch = all_rows.slice(at, 512)
                lengths = batch.column(1).value_lengths().to_numpy()
                for count in np.unique(lengths):
                    some = batch.filter(pa.array(lengths == count))
                    words = some.column(1).flatten().to_numpy().reshape(-1, count)
                    row, key = keys(words, wide_tables) if whole else halves(words)
                    table = key >> (24 if whole else 12)
                    other = np.roll(words.view(np.uint64), -1, axis=1)[row, table] & mask
                    columns = [pa.array((key << CARRIED) | other.view(np.int64)), some.column(0).take(pa.array(row)), pa.array(words[row, table] & ((1 << 46) - 1))]
                    yield pa.RecordBatch.from_arrays([*columns, *(c.take(pa.array(row)) for c in some.columns[2:])], names=["packed", "node", "word", *names])

    shards = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = prints.select("node", "words", *names).mapInArrow(spread, ", ".join(f"{n} long" for n in ("packed", "node", "word", *names)))
    return keyed.repartition(shards, F.shiftright("packed", CARRIED)).sortWithinPartitions("packed")


def _opened(group: np.ndarray, packed: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, packed, row): rows of first segments' codewords as rows of whole keys, sorted by group and key; the numbers of their runs, and the rows that they come from."""
    right = codewords(word >> 23)
    row, j = np.nonzero(right >= 0)
    packed = (((packed[row] >> CARRIED) << 12 | right[row, j]) << CARRIED) | (packed[row] & ((1 << CARRIED) - 1))
    order = np.lexsort((packed, group[row]))
    row, packed = row[order], packed[order]
    group, key = group[row], packed >> CARRIED
    run = np.cumsum(np.r_[False, (group[1:] != group[:-1]) | (key[1:] != key[:-1])])
    return run, packed, row


def _proposed(node: np.ndarray, a: np.ndarray, b: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
    """The pairs of the nodes of rows a and b, each once."""
    a, b = node[a], node[b]
    low, high, many = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), many.astype(np.int64)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.array(many.astype(bool))], names=["low", "high", "many"])


def _swept(keyed: DataFrame, propose: Callable[..., pa.RecordBatch | None], scratch: Scratch, most: int) -> DataFrame:
    """(low, high, many): what ``propose(run, own, packed, node, word, ...)`` gives for the runs of the keys of ``keyed``.

    ``own`` is the block of each row of a pair of blocks, and None where the run is a whole key. Keys of over
    ``most`` rows go into blocks.
    """
    more = keyed.columns[2:]
    kinds = "low long, high long, many boolean, packed long, " + ", ".join(f"{c} long" for c in more)
    names = ["low", "high", "many", "packed", *more]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, (packed, node, *rest) in whole_runs(batches, lambda c: c[0] >> CARRIED, most):
            if not whole:
                none = pa.nulls(len(node), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node), none, pa.array(packed), *map(pa.array, rest)], names=names)
            elif pairs := propose(packed >> CARRIED, None, packed, node, *rest):
                none = [pa.nulls(pairs.num_rows, pa.int64())] * (len(names) - 3)
                yield pa.RecordBatch.from_arrays([*pairs.columns, *none], names=names)

    def sweep_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (group, own, *columns) in whole_runs(batches, lambda c: c[0]):
            if pairs := propose(group, own, *columns):
                yield pairs

    found = scratch.saved(keyed.mapInArrow(sweep, kinds), "swept")
    late = in_blocks(found.where("packed IS NOT NULL").select("packed", F.col("low").alias("node"), *more), F.shiftright("packed", CARRIED))
    return found.where("packed IS NULL").select("low", "high", "many").union(late.select("group", "own", "packed", "node", *more).mapInArrow(sweep_blocks, "low long, high long, many boolean"))


def candidates(prints: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """(low, high, many): pairs of the rows (node, words, size, odd) of ``prints`` that may be of similarity ``least``.

    They share a Golay key, agree on most bits of its word and some of another, and have parities that allow
    the similarity. A pair counts under the first key of a table that it shares only, so that a family of
    copies, which shares all keys, costs its pairs once a table. Of more than ``FEW`` pairs of a key come the edges of a spanning forest, so that each
    row with a pair has an edge; ``many`` marks those of a key that had more pairs. Of the edges so marked
    those stay that join what no other of the same batch (whole codewords of the first segment) has joined.
    Keys of few rows are compared by one shift after the other, all at once.
    """
    most, mask, share = most_bits(least, CARRIED + 46, 3.2), np.uint64((1 << CARRIED) - 1), Fraction(least).limit_denominator(1000)

    def propose(group: np.ndarray, own: np.ndarray | None, packed: np.ndarray, node: np.ndarray, word: np.ndarray, size: np.ndarray, *odd: np.ndarray) -> pa.RecordBatch | None:
        run, packed, of_row = _opened(group, packed, word)
        odds = np.stack([x.view(np.uint64) for x in odd], axis=1)  # not repeated for each key
        key, bits, node, word = packed >> CARRIED, packed.view(np.uint64) & mask, node[of_row], word[of_row]
        begins = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        sizes = np.diff(np.r_[begins, len(run)])
        few = np.repeat(sizes <= FEW, sizes)
        left, right, many = [], [], []
        for step in range(1, int(sizes[sizes <= FEW].max(initial=1))):
            at = np.flatnonzero((run[step:] == run[:-step]) & few[step:])
            at = at[_apart(bits, word, at, at + step) <= most]
            at = at[_allowed(size, odds, of_row[at], of_row[at + step], share)]
            left, right = [*left, at], [*right, at + step]
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            first = _meet_first(key[a], word[a], word[b])
            a, b = a[first], b[first]
            of = np.searchsorted(begins, a, side="right") - 1
            more = np.bincount(of, minlength=len(begins))[of] > FEW
            kept = ~more
            kept[more] = _spanning(a[more], b[more])
            lost = np.bincount(of[~kept], minlength=len(begins)) > 0
            left, right, many = [a[kept]], [b[kept]], [lost[of[kept]]]
        for at, rows in zip(begins[sizes > FEW].tolist(), sizes[sizes > FEW].tolist()):
            order = at + np.argsort(node[at : at + rows], kind="stable")  # all keys begin with the same rows
            if edges := _forest_here(bits[order], word[order], size[of_row[order]], odds[of_row[order]], int(key[at]), most, share):
                a, b = np.array(edges).T
                left, right, many = [*left, order[a]], [*right, order[b]], [*many, np.ones(len(a), dtype=bool)]
        if not left:
            return None
        a, b, many = map(np.concatenate, (left, right, many))
        kept = ~many
        kept[many] = _spanning(node[a[many]], node[b[many]])
        return _proposed(node, a[kept], b[kept], many[kept])

    return _swept(_keyed(_folded(prints), whole=False), propose, scratch, OPENED * BLOCK)


def crossing(prints: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """(low, high, many): like ``candidates``, all pairs of rows (node, words, class, size, odd) of different classes whose parities allow it.

    A forest wouldn't do here: its edges may fail the exact test where others between the classes pass it.
    The parities leave few of the pairs of a family whose texts are alike but not similar.
    """
    most, mask, share = most_bits(least, CARRIED + 46, 3.2), np.uint64((1 << CARRIED) - 1), Fraction(least).limit_denominator(1000)

    def propose(run: np.ndarray, own: np.ndarray | None, packed: np.ndarray, node: np.ndarray, word: np.ndarray, group: np.ndarray, size: np.ndarray, *odd: np.ndarray) -> pa.RecordBatch | None:
        bits, odds = packed.view(np.uint64) & mask, np.stack([x.view(np.uint64) for x in odd], axis=1)
        begins = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        ends = np.r_[begins[1:], len(run)]
        mixed = np.minimum.reduceat(group, begins) != np.maximum.reduceat(group, begins)
        left, right = [], []
        for at, end in zip(begins[mixed].tolist(), ends[mixed].tolist()):
            _, place, sizes = np.unique(group[at:end], return_inverse=True, return_counts=True)
            # Each row outside the largest class looks at all rows; of two such rows the first looks.
            largest, key = place == sizes.argmax(), int(packed[at] >> CARRIED)
            two = own is not None and own[at:end].min() != own[at:end].max()  # rows of one block meet in the group of that block
            for row in np.flatnonzero(~largest).tolist():
                there = (place != place[row]) & (largest | (np.arange(end - at) > row))
                b = at + np.flatnonzero(there & (own[at:end] != own[at + row]) if two else there)
                b = b[_apart(bits, word, b, at + row) <= most]
                b = b[_allowed(size, odds, b, np.array([at + row]), share)]
                b = b[_meet_first(np.full(len(b), key), word[b], np.full(len(b), word[at + row]))]
                left, right = [*left, np.full(len(b), at + row)], [*right, b]
        if not left:
            return None
        a, b = np.concatenate(left), np.concatenate(right)
        return _proposed(node, a, b, np.ones(len(a), dtype=bool))

    dealt = _folded(prints, "class").repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return _swept(_keyed(dealt), propose, scratch, BLOCK)


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, least: float = 0.8, recall: float = RECALL, name: str = "component_id") -> DataFrame:
    """One row for each row of ``docs``: its ``key`` and component.

    The component is the smallest ``key`` (of any type that has an order) reachable by links, the row's own
    included. Rows link if the Jaccard similarity of their sets of shingles of ``words`` words is ``least``
    or more; texts of fewer words are one shingle. Golay keys propose pairs: of those at exactly ``least``
    the share ``recall``, of more similar ones more. Each proposed pair is decided on its two whole sets.

    A key of many similar rows costs two rounds instead of all its pairs: the edges of a spanning forest are
    decided first, and then only those pairs are left whose rows no chain of links connects yet.

    Null texts, and those without words, have the empty set and link with each other only. Rows with equal
    sets count once in the search. A null ``key`` takes part but names a component only where all its keys
    are null. Repeated rows stay, other columns don't matter, and an empty table gives an empty one.
    """
    count, share = tables_wanted(least, recall), Fraction(least).limit_denominator(1000)
    if count > 16:  # numbers of tables have five bits
        raise ValueError("such a similarity and recall take over 16 tables")
    texts = docs.select(F.col(key).alias("key"), docs[text].alias("text"))
    own = saved(texts.select("key", sketches(F.col("text"), words, count).alias("sketch")).select("key", "sketch.*"), "sketches")
    with Scratch(docs.sparkSession) as scratch:
        group = own.groupBy("digest", "size", "words", "odd").agg(F.min("key").alias("least"))
        group = scratch.saved(group.withColumn("node", F.monotonically_increasing_id()), "groups")
        found = scratch.saved(candidates(group.where("size > 0"), least, scratch), "candidates")

        def near(pairs: DataFrame) -> DataFrame:
            """The distinct pairs whose sizes, parities and whole fingerprints allow the similarity."""
            a, b = (group.select(*[F.col(c).alias(f"{c}_{side}") for c in ("node", "size", "words", "odd")]) for side in "ab")
            both = pairs.select("low", "high").distinct().join(a, F.col("low") == F.col("node_a")).join(b, F.col("high") == F.col("node_b"))
            sized = F.least("size_a", "size_b") * share.denominator >= F.greatest("size_a", "size_b") * share.numerator
            apart, unlike = (F.aggregate(F.zip_with(f"{c}_a", f"{c}_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y) for c in ("words", "odd"))
            allowed = unlike * (share.denominator + share.numerator) <= (F.col("size_a") + F.col("size_b")) * (share.denominator - share.numerator)
            short = F.least("size_a", "size_b") <= SHORT
            return both.where(sized & allowed & (short | (apart <= most_bits(least, 64 * count, 4)))).select("low", "high")

        pairs = scratch.saved(near(found), "pairs")
        held = found.where("many").select(F.explode(F.array("low", "high")).alias("node")).distinct()
        held = scratch.saved(group.join(held, "node").select("node", "words", "size", "odd"), "held")
        wanted = pairs.select(F.col("low").alias("node")).union(pairs.select("high")).union(held.select("node")).distinct()
        wanted = scratch.saved(group.join(wanted, "node").select("node", "digest", "least"), "wanted")
        # Only the sets of candidates are made again from their texts and kept: those of all texts would be as large as the texts.
        chosen = wanted.select(F.col("least").alias("chosen")).distinct()
        sets = texts.join(chosen, texts["key"].eqNullSafe(chosen["chosen"]), "left_semi").select("key", shingle_sets(F.col("text"), words).alias("set")).select("key", "set.*")
        sets = sets.join(wanted.withColumnRenamed("digest", "of"), F.col("key").eqNullSafe(F.col("least")) & (F.col("digest") == F.col("of")))
        sets = scratch.saved(sets.groupBy("node").agg(F.first("hashes").alias("hashes")), "sets")  # repeated rows have one set
        # One pair of each row is decided first, then those pairs whose rows no chain of links connects yet.
        edges = scratch.saved(verified(pairs.groupBy("high").agg(F.min("low").alias("low")), sets, share), "edges")
        known = components(edges)
        for side in ("low", "high"):
            labelled = known.select(F.col("node").alias(side), F.col("component").alias(f"{side}_class"))
            pairs = pairs.join(labelled, side, "left").withColumn(f"{side}_class", F.coalesce(f"{side}_class", side))
        pairs = scratch.saved(pairs.where("low_class <> high_class").select("low", "high"), "pairs")
        edges = scratch.saved(edges.union(verified(pairs, sets, share)), "edges")

        # The same for the pairs of keys that had more of them than their forest.
        held = held.join(components(edges), "node", "left").select("node", "words", "size", "odd", F.coalesce("component", "node").alias("class"))
        pairs = scratch.saved(near(crossing(scratch.saved(held, "held"), least, scratch)), "pairs")
        edges = edges.union(scratch.saved(verified(pairs, sets, share), "edges"))
        smallest = labels(group, edges).select("digest", "smallest")
    return own.select("key", "digest").join(smallest, "digest").select(F.col("key").alias(key), F.col("smallest").alias(name))
