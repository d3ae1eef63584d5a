"""Best-fit packing of documents into sequences, after a dominance reduction.

Lengths are whole numbers up to the capacity, so the whole instance is a table of at most ``capacity``
counts, whatever the corpus. The plan is made on that table: Martello and Toth's dominance rules fix
sequences that some optimal packing holds, many equal ones at a time, and best-fit decreasing packs what
is left, again by counts. The plan says, for each length, which ranks among the pieces of that length go
to which sequences; pieces get their ranks in Spark and look their place up.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimcheck.llm.shared import free_name, saved
from claimcheck.llm.tokens import token_ids


def _fixed(counts: list[int], lengths: list[int], longest: int, capacity: int) -> tuple[int, ...] | None:
    """A set for a piece of length ``longest`` that dominates all other sets with it, or None.

    ``lengths`` are the lengths that are left, descending. A set dominates another if its pieces can each
    stand for one or more of the other's, of no greater total; then some optimal packing holds it.
    """
    room = capacity - longest

    def have(n: int, taken: tuple[int, ...] = ()) -> bool:
        return counts[n] - (n == longest) - taken.count(n) > 0

    fitting = [n for n in lengths if n <= room and have(n)]
    if not fitting:
        return (longest,)
    first = fitting[0]
    smallest: list[int] = []
    for n in reversed(fitting):
        smallest += [n] * min(3, counts[n] - (n == longest))
        if len(smallest) >= 3:
            break
    if first == room or len(smallest) < 2 or smallest[0] + smallest[1] > room:
        return (longest, first)  # nothing fits better than one more piece, and this is the largest
    second = next((n for n in fitting if n <= room - first and have(n, (first,))), 0)
    if len(smallest) > 2 and sum(smallest[:3]) <= room:
        # Sets of three more pieces are possible; one piece that is as large as any two or more is still best.
        return None
    best_pair = _largest_pair(fitting, room, have)
    if first >= sum(best_pair):
        return (longest, first)
    # At most two more fit. {first, second} dominates {x, y} if x <= first and y <= second, or x + y <= first.
    if second and all(sum(pair) <= first or min(pair) <= second for pair in _pairs_by_least(fitting, room, have)):
        return (longest, first, second)
    return None


def _largest_pair(fitting: list[int], room: int, have) -> tuple[int, int]:
    best, high, low = (0, 0), 0, len(fitting) - 1
    while high <= low:
        pair = (fitting[high], fitting[low])
        if sum(pair) > room:
            high += 1
        else:
            if sum(pair) > sum(best) and (high < low or have(pair[0], (pair[0],))):
                best = pair
            low -= 1
    return best


def _pairs_by_least(fitting: list[int], room: int, have):
    """For each shorter piece of a pair the longest partner that fits with it."""
    for i in range(len(fitting) - 1, -1, -1):
        shorter = fitting[i]
        longer = next((n for n in fitting[: i + 1] if n + shorter <= room and (n != shorter or have(n, (n,)))), None)
        if longer is not None:
            yield longer, shorter


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of the pieces of a sequence, number of such sequences) for all pieces of the histogram."""
    if any(not 0 < n <= capacity for n in histogram):
        raise ValueError(f"lengths must be between 1 and {capacity}")
    counts = [0] * (capacity + 1)
    for n, count in histogram.items():
        counts[n] = count
    patterns: list[tuple[tuple[int, ...], int]] = []
    lengths = [n for n in range(capacity, 0, -1) if counts[n]]
    shrunk = True
    while shrunk:
        shrunk = False
        for n in list(lengths):
            while counts[n] and (pattern := _fixed(counts, lengths, n, capacity)):
                times = _times(counts, pattern, capacity)
                patterns.append((pattern, times))
                for m, k in Counter(pattern).items():
                    counts[m] -= k * times
                lengths = [m for m in lengths if counts[m]]
                shrunk = True
    return patterns + _best_fit(counts, lengths, capacity)


def _times(counts: list[int], pattern: tuple[int, ...], capacity: int) -> int:
    """How many such sets the rule fixes in a row.

    A full set of different lengths stays dominant while there is one of each. Otherwise the rule looks at
    which lengths are left, and at up to three pieces of one: it holds while four of each are left.
    """
    uses = Counter(pattern)
    if sum(pattern) == capacity and len(uses) == len(pattern):
        return min(counts[n] for n in uses)
    return max(1, min((counts[n] - 4) // k for n, k in uses.items()))


def _best_fit(counts: list[int], lengths: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: each piece goes to the fullest open sequence that takes it."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # room left: sequences
    done: list[tuple[tuple[int, ...], int]] = []

    def put(room: int, pattern: tuple[int, ...], times: int) -> None:
        (open_.setdefault(room, []) if room else done).append((pattern, times))

    for n in lengths:
        left = counts[n]
        for room in sorted(r for r in open_ if r >= n):
            # Once a sequence has taken a piece it is the fullest that takes the next one.
            each = room // n
            for pattern, times in open_.pop(room) if left else []:
                full = min(times, left // each)
                if full:
                    put(room - each * n, pattern + (n,) * each, full)
                    left -= full * each
                rest = times - full
                if rest and left:
                    put(room - left * n, pattern + (n,) * left, 1)
                    rest, left = rest - 1, 0
                if rest:
                    put(room, pattern, rest)
            if not left:
                break
        each = capacity // n
        if left // each:
            put(capacity - each * n, (n,) * each, left // each)
        if left % each:
            put(capacity - (left % each) * n, (n,) * (left % each), 1)
    return done + [x for group in open_.values() for x in group]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, pieces a sequence, offset) for each length of each pattern."""
    rows, ranks, sequence = [], Counter(), 0
    for pattern, times in patterns:
        offset = 0
        for n, k in Counter(pattern).items():
            rows.append((n, ranks[n], k * times, sequence, k, offset))
            ranks[n] += k * times
            offset += n * k
        sequence += times
    return rows


def cut(docs: DataFrame, path: str, end_id: int, capacity: int = 1024, text: str = "text") -> DataFrame:
    """The pieces of all documents: ``docs`` without ``text``, with piece, start, length and ids (binary).

    A document's ids are those of its text (null: empty) and ``end_id``, so that no document is empty.
    A document longer than ``capacity`` is cut into pieces of exactly ``capacity``, but for the first one,
    which takes the rest. Repeated rows are documents of their own. Columns named like the new ones give way.
    """
    new = ("piece", "start", "length", "ids")
    kept = [c for c in docs.columns if c != text and c.lower() not in new]
    whole, total, first = free_name(docs, "_ids"), free_name(docs, "_total"), free_name(docs, "_first")
    end = F.lit(bytes(end_id.to_bytes(4, "little")))
    return (
        docs.select(*kept, F.concat(token_ids(docs[text], path), end).alias(whole))
        .withColumn(total, (F.octet_length(whole) / 4).cast("long"))
        .withColumn(first, F.when(F.col(total) <= capacity, F.col(total)).otherwise((F.col(total) - 1) % capacity + 1))
        .withColumn("piece", F.explode(F.sequence(F.lit(0), ((F.col(total) - F.col(first)) / capacity).cast("int"))))
        .withColumn("start", F.when(F.col("piece") == 0, F.lit(0).cast("long")).otherwise(F.col(first) + (F.col("piece") - 1) * F.lit(capacity).cast("long")))
        .withColumn("length", F.when(F.col("piece") == 0, F.col(first)).otherwise(F.lit(capacity).cast("long")))
        .withColumn("ids", F.substring(F.col(whole), (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int")))
        .drop(whole, total, first)
    )


def pack(pieces: DataFrame, capacity: int = 1024, length: str = "length") -> DataFrame:
    """``pieces`` with sequence_id and offset (existing ones are replaced), in as few sequences as the plan takes.

    Lengths must be between 1 and ``capacity``. Which of several pieces of one length goes where is
    arbitrary; equal rows are packed each. An empty table gives an empty table.

    The driver holds at most ``capacity`` counts and the plan, whose size follows from the number of
    different lengths and not from that of the pieces. Pieces are ranked within their length by way of
    random buckets, several for each shuffle partition, so that a frequent length is spread over all tasks.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    bucket, rank, before = (free_name(pieces, n) for n in ("_bucket", "_rank", "_before"))
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = saved(pieces.withColumn(bucket, (F.rand(7) * buckets).cast("int")), "pieces")
    sums = pieces.groupBy(length, bucket).agg(F.count("*").alias(before))
    sums = saved(sums, "lengths")
    histogram = {int(n): int(k) for n, k in sums.groupBy(length).agg(F.sum(before)).collect()}
    table = places(plan(histogram, capacity))
    starts = sums.withColumn(before, F.sum(before).over(Window.partitionBy(length).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)))
    ranked = (
        pieces.withColumn(rank, F.row_number().over(Window.partitionBy(length, bucket).orderBy(F.lit(0))) - 1)
        .join(starts, [length, bucket])
        .withColumn(rank, F.col(rank) + F.coalesce(before, F.lit(0)))
    )
    # For each length its places in order of rank: a piece looks up the last one that begins at its rank or before.
    by_length: dict[int, list[tuple[int, int, int, int]]] = {}
    for n, low, _, sequence, each, offset in table:
        by_length.setdefault(n, []).append((low, sequence, each, offset))
    schema = f"`{length}` bigint, _places array<struct<low: bigint, sequence: bigint, each: bigint, offset: bigint>>"
    looked_up = free_name(ranked, "_places")
    places_of = spark.createDataFrame([(n, x) for n, x in by_length.items()], schema).withColumnRenamed("_places", looked_up)
    place = free_name(ranked, "_place")
    return (
        ranked.withColumn(length, F.col(length).cast("long"))
        .join(F.broadcast(places_of), length)  # at most `capacity` rows
        .withColumn(place, F.element_at(F.filter(looked_up, lambda x: x.low <= F.col(rank)), -1))
        .withColumn("sequence_id", F.col(place).sequence + F.floor((F.col(rank) - F.col(place).low) / F.col(place).each).cast("long"))
        .withColumn("offset", F.col(place).offset + (F.col(rank) - F.col(place).low) % F.col(place).each * F.col(length))
        .select(*pieces.drop(bucket).columns, "sequence_id", "offset")
    )
