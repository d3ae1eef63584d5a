import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from claimcheck.llm import online, queries, tokens

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def squares(counts, capacity):
    return sum(c * c for c in counts[1:capacity])


def test_the_move_has_the_smallest_sum_of_squares():
    draw, capacity = random.Random(2), 24
    windows = online.Windows(capacity)
    for document in range(400):
        length = draw.randint(1, capacity - 1)
        before = windows.counts.copy()

        def after(level):
            counts = before.copy()
            counts[level] -= level > 0
            counts[level + length] += level + length < capacity
            return squares(counts, capacity)

        possible = {level: after(level) for level in range(capacity - length + 1) if not level or before[level]}
        chosen = windows.best(length)
        assert possible[chosen] == min(possible.values()) and chosen == max(k for k, v in possible.items() if v == possible[chosen])
        windows.add(document, length)
        assert windows.counts.sum() == windows.n_open == sum(map(len, windows.levels.values()))


def test_closing_cuts_and_loses_nothing():
    for seed in range(60):
        draw = random.Random(seed)
        capacity = draw.choice([1, 2, 7, 16, 100])
        windows = online.Windows(capacity, most_open=draw.choice([1, 3, 50]))
        lengths = [draw.choice([1, draw.randint(1, capacity), draw.randint(1, 5 * capacity)]) for _ in range(draw.randint(0, 80))]
        for document, length in enumerate(lengths):
            windows.add(document, length)
        windows.close()
        assert windows.n_open == 0 and not windows.counts.any()
        fills = [sum(p[2] for p in parts) for parts in windows.done]
        assert all(f == capacity or f & (f - 1) == 0 for f in fills) and max(fills, default=0) <= capacity
        seen = sorted((d, i) for parts in windows.done for d, start, n in parts for i in range(start, start + n))
        assert seen == [(d, i) for d, n in enumerate(lengths) for i in range(n)]


def checked(pieces, wanted, capacity):
    """Whether the pieces hold the ids of each document once, and sequences are gapless, full or of a power of two."""
    assert pieces.groupby(pieces.doc_id.fillna(-1))["length"].sum().to_dict() == {k: len(v) for k, v in wanted.items()}
    for key, own in pieces.groupby(pieces.doc_id.fillna(-1)):
        own, at = own.sort_values("start"), 0
        for row in own.itertuples():
            ids = np.array(wanted[key][row.start : row.start + row.length], dtype="<u4").tobytes()
            assert row.start == at and row.length > 0 and row.doc_tokens == len(wanted[key]) and row.ids_crc32 == zlib.crc32(ids)
            at += row.length
    for _, own in pieces.sort_values("offset").groupby("sequence_id"):
        ends = own["length"].cumsum()
        assert own.offset.tolist() == [0, *ends.tolist()[:-1]]
        assert ends.iloc[-1] == capacity or ends.iloc[-1] & (ends.iloc[-1] - 1) == 0


def test_documents(spark):
    texts = [None, "", " ", "same words", "same words", "a b c " * 3000, " " * 5000, "日本 <|endoftext|> x"] + [f"word {i} " * (i % 40) for i in range(300)]
    rows = [(i, t, "kept", i, [i]) for i, t in enumerate(texts)] + [(None, "no id", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, START string, _document long, more array<int>").repartition(3)
    found = online.pack_online(docs, BYTE, end_id=1, capacity=256, with_ids=True)
    assert found.columns == ["doc_id", "_document", "more", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    library = tokens.library_tokenizer(BYTE)
    wanted = {-1 if i is None else i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t, *_ in rows}
    pieces = found.toPandas()
    checked(pieces, wanted, 256)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in pieces.itertuples())
    named = pieces.dropna(subset=["doc_id"])
    assert [int(x[0]) for x in named.more] == named.doc_id.astype(int).tolist() == named._document.astype(int).tolist()


def test_empty_table_and_nulls_only(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert online.pack_online(docs, BYTE, end_id=1).count() == 0
    one = online.pack_online(spark.createDataFrame([(None, None)], "doc_id long, text string"), BYTE, end_id=1).collect()
    assert [(r.doc_id, r.start, r.length, r.doc_tokens, r.offset) for r in one] == [(None, 0, 1, 1, 0)]
    assert online.pack_online(docs.select("text"), BYTE, end_id=1).columns[0] == "start"


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    library = tokens.library_tokenizer(BYTE)
    wanted = {r.doc_id: [*library.encode(r.text, add_special_tokens=False).ids, 1] for r in docs}
    checked(queries.op12_online_packing(spark, folder).toPandas(), wanted, 2048)
