import functools
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from claimcheck.llm import bpe, packing, queries, records, tokens
from claimcheck.llm.packing import plan

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "  a  b", "a \n b\t c  ", "x<|endoftext|> y", "a  <|endoftext|>  b", "<|startoftext|>", "don't 's  're'll", "日本語 テスト.", "é ́x", "\x1c a \x1cb", "a\x00b \x85c  \x85 d",
    "İ I ſ K ΑΣ", "١٢٣ ½ ² x².", "one, two. three.,", "a" * 3000, "word. " * 2000, "same", "same",
]


def generated(count=300, seed=1):
    draw = random.Random(seed)
    parts = list(" \n\t 'a b1é日!.,<|") + ["<|endoftext|>", "ing", " the", "'s", "\x1c", " "]
    return ["".join(draw.choice(parts) for _ in range(draw.randint(0, 60))) for _ in range(count)]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, t, "x", i) for i, t in enumerate(ODD + generated())] + [(None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, N_TOKENS string, _ids long")


library = functools.lru_cache(tokens.library_tokenizer)


def ids_of(text, path=BYTE):
    return library(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_are_the_librarys(path):
    sample = [t or "" for t in ODD] + generated(2000, 7)
    for text, ids in zip(sample, tokens.encoded(sample, path)):
        assert np.frombuffer(ids, "<u4").tolist() == ids_of(text, path), repr(text)


def test_plain_characters_are_the_librarys():
    assert all(isinstance(tokens.encoder(path), tokens.RankEncoder) for path in (BYTE, WORD))
    plain = [c for c in map(chr, range(1, 0xE000 - 0x800)) if not tokens._ODD.match(c)]
    sample = [f"a{c}1{c}{c}!{c} {c}b {c}" for c in plain]
    for path in (BYTE, WORD):
        wanted = library(path).encode_batch_fast(sample, add_special_tokens=False)
        assert all(np.frombuffer(ids, "<u4").tolist() == want.ids for ids, want in zip(tokens.encoded(sample, path), wanted))


def test_rank_and_merge_encoders_part_where_a_token_has_two_splits():
    ranks = {x: i for i, x in enumerate([b"a", b"b", b"c", b"bc", b"aa", b"aab", b"aabc"])}
    listed = {(b"b", b"c"): 0, (b"a", b"a"): 1, (b"aa", b"b"): 2, (b"aab", b"c"): 3}
    assert not tokens.same_as_merges(ranks, listed)  # a a b c: aa, bc is left by the list, but aabc is a token
    assert tokens.same_as_merges(ranks, {(b"b", b"c"): 0, (b"a", b"a"): 1, (b"aa", b"b"): 2, (b"aa", b"bc"): 3})


def test_long_texts_are_cut_where_words_end():
    text = "".join(generated(4000, 11)) + " word. tail" * 9000 + "x" * 200_000 + " end"
    parts = list(tokens.safe_parts(text, 1000))
    assert "".join(parts) == text and len(parts) > 50
    for path in (BYTE, WORD):
        assert np.frombuffer(tokens.encoder(path).encode(text), "<u4").tolist() == ids_of(text, path)


def test_counts_query(spark):
    rows = queries.op3_token_counts(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        n = len(ids_of(docs[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 512)


def test_cache_keeps_ids_across_generations():
    small = bpe.PieceCache(lambda xs: [x.encode() for x in xs], [], limit=5)
    sample = [f"w{i % 13}. a{i % 7} {'z' * (i % 60)}, b" for i in range(200)]
    assert [x.decode() for text in sample for x in small.encode([text])] == sample


def test_sentencepiece_vocabulary():
    path = public_tokenizers.path("piece_bpe_32k.model")
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.encoded(["a b", "", "é"], path)] == [model.encode(t) for t in ("a b", "", "é")]


def test_counts(spark, texts):
    found = tokens.count_tokens(texts, BYTE)
    assert set(found.columns) == {"doc_id", "text", "_ids", "n_bytes", "n_tokens", "over_limit"}
    rows = found.collect()
    assert len(rows) == texts.count()
    for r in rows:
        assert r.n_tokens == len(ids_of(r.text)) and r.n_bytes == len((r.text or "").encode()) and r.over_limit == (r.n_tokens > 512)
    assert tokens.count_tokens(texts.where("false"), BYTE).isEmpty()


def test_own_encoder_is_exact():
    _, cache = bpe.encoder(BYTE)
    sample = [t or "" for t in ODD] + generated(3000, 3)
    for text, ids in zip(sample, cache.encode(sample)):
        assert np.frombuffer(ids, "<u4").tolist() == ids_of(text), repr(text)


def test_compatible_pairs_are_what_merging_keeps():
    v, _ = bpe.encoder(BYTE)
    draw = random.Random(5)

    def merged(raw):
        parts = [v.encode_word(bytes([b]))[0] for b in raw]
        while True:
            best = min((v.merged[p] for p in zip(parts, parts[1:]) if p in v.merged), default=None)
            if best is None:
                return parts
            i = next(i for i, p in enumerate(zip(parts, parts[1:])) if v.merged.get(p) == best)
            parts[i : i + 2] = [best]

    for _ in range(1500):
        a, b = draw.randrange(len(v.raw)), draw.randrange(len(v.raw))
        assert v.fits(a, b) == (merged(v.raw[a] + v.raw[b]) == [a, b])


def test_decoding(spark, texts):
    v, _ = bpe.encoder(BYTE)
    for seed in range(300):
        ids = np.random.default_rng(seed).integers(0, 50257, 30)
        assert v.decode(ids.astype("<u4").tobytes()) == library(BYTE).decode(ids.tolist(), skip_special_tokens=False)
    there_and_back = bpe.decode_documents(bpe.encode_documents(texts, BYTE), BYTE)
    assert all(r.decoded == (r.text or "") for r in there_and_back.collect())
    assert bpe.decode_documents(bpe.encode_documents(texts.where("false"), BYTE), BYTE).isEmpty()


def test_records(spark, texts, tmp_path):
    folder = f"file://{tmp_path}/records"
    index = records.write_records(texts, folder, WORD, end_id=1)
    rows = records.read_shards(index, folder).orderBy("start").collect()
    assert len(rows) == texts.count() and [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
    given = {r.doc_id: r.text for r in texts.collect()}
    given[-(1 << 63)] = given.pop(None)
    start = 0
    for r in rows:
        want = np.array([*ids_of(given[r.doc_id], WORD), 1], "<u4").tobytes()
        assert (r.start, r.n_tokens, bytes(r.ids)) == (start, len(want) // 4, want)
        start += r.n_tokens
    some = records.read_at(index.where("doc_id % 7 = 3").orderBy(F.rand(1)), folder).collect()
    assert len(some) > 10 and all(bytes(r.ids) == np.array([*ids_of(given[r.doc_id], WORD), 1], "<u4").tobytes() for r in some)
    none = records.write_records(texts.where("false"), folder, WORD, end_id=1)
    assert none.isEmpty() and records.read_shards(none, folder).isEmpty()


def test_damaged_records_are_found(tmp_path):
    payload = records.payload_of(7, np.array([1, 2, 70000], "<u4"), 4)
    raw = records.frame(payload)
    (tmp_path / "f").write_bytes(raw)
    with open(tmp_path / "f", "rb") as f:
        assert records.from_payload(records.read_frame(f), 4) == (7, np.array([1, 2, 70000], "<u4").tobytes()) and records.read_frame(f) is None
    for damaged in (raw[:-1], raw[:5], bytes([raw[0] ^ 1]) + raw[1:], raw[:14] + bytes([raw[14] ^ 1]) + raw[15:]):
        (tmp_path / "f").write_bytes(damaged)
        with open(tmp_path / "f", "rb") as f, pytest.raises(ValueError):
            records.read_frame(f)


def fewest(items, capacity):
    best, bins = [len(items)], []
    items = sorted(items, reverse=True)

    def place(i):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in {*bins}:
            if room >= items[i]:
                k = bins.index(room)
                bins[k] -= items[i]
                place(i + 1)
                bins[k] += items[i]
        bins.append(capacity - items[i])
        place(i + 1)
        bins.pop()

    place(0)
    return best[0]


def test_plans_hold_all_pieces_and_the_reduction_keeps_the_optimum(monkeypatch):
    from collections import Counter

    draw = random.Random(3)
    for _ in range(400):
        capacity = draw.choice([10, 20, 37])
        items = [draw.randint(1, capacity) for _ in range(draw.randint(1, 10))]
        found = plan(Counter(items), capacity)
        assert all(sum(p) <= capacity and n > 0 for p, n in found)
        assert sum((Counter({x: k * n for x, k in Counter(p).items()}) for p, n in found), Counter()) == Counter(items)
        left = {}
        with monkeypatch.context() as m:
            m.setattr(packing, "_best_fit", lambda counts, lengths, _: left.update({x: counts[x] for x in lengths}) or [])
            fixed = plan(Counter(items), capacity)
        rest = [x for x, n in left.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + (fewest(rest, capacity) if rest else 0) == fewest(items, capacity)
    with pytest.raises(ValueError):
        plan({11: 1}, 10)


def test_packing(spark, texts):
    pieces = packing.cut(texts, BYTE, end_id=2, capacity=64)
    rows = packing.pack(pieces, 64).collect()
    assert len(rows) == pieces.count()
    given, by_doc, by_sequence = {r.doc_id: r.text for r in texts.collect()}, {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for key, parts in by_doc.items():
        parts.sort(key=lambda r: r.piece)
        assert b"".join(bytes(r.ids) for r in parts) == np.array([*ids_of(given[key]), 2], "<u4").tobytes()
        assert [r.start for r in parts] == np.cumsum([0, *[r.length for r in parts]])[:-1].tolist() and all(r.length == 64 for r in parts[1:])
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == np.cumsum([0, *[r.length for r in parts]])[:-1].tolist() and sum(r.length for r in parts) <= 64
    assert packing.pack(pieces.where("false"), 64).isEmpty()


def test_queries_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    given = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in queries.op9_bpe(spark, folder).collect()}
    assert set(rows) == set(given)
    for key, text in given.items():
        raw = np.array(ids_of(text), "<u4").tobytes()
        assert (rows[key].n_tokens, rows[key].ids_sha256, rows[key].decoded_sha256) == (len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    start = 0
    for r in sorted(queries.op7_records(spark, folder).collect(), key=lambda r: r.doc_id):
        raw = np.array([*ids_of(given[r.doc_id], WORD), 1], "<u4").tobytes()
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(raw) // 4, zlib.crc32(raw))
        start += r.n_tokens
    packed = queries.op5_packing(spark, folder).collect()
    total = sum(len(ids_of(t)) + 1 for t in given.values())
    assert sum(r.length for r in packed) == total and len({r.sequence_id for r in packed}) <= -(-total // 1024) + 3


def test_record_ids_that_do_not_fit_are_an_error_and_wide_ones_take_four_bytes(spark, tmp_path):
    with pytest.raises(ValueError):
        records.payload_of(1, np.array([70_000], "<u4"), 2)
    assert np.frombuffer(records.from_payload(records.payload_of(1, np.array([70_000], "<u4"), 4), 4)[1], "<u4").tolist() == [70_000]
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    folder = f"file://{tmp_path}/wide"
    index = records.write_records(docs, folder, WORD, end_id=70_000)
    assert {r.width for r in index.collect()} == {4}
    found = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in records.read_shards(index, folder).collect()}
    assert found == {1: [*ids_of("a b", WORD), 70_000], 2: [*ids_of("c", WORD), 70_000]}


def test_records_folder_is_a_full_uri_without_a_scheme_in_the_setting(spark):
    assert "://" not in spark.conf.get("spark.checkpoint.dir")
    assert records.records_folder(spark).startswith("file:///")


def test_records_of_one_id_fill_many_shards(spark, tmp_path):
    docs = spark.range(900).selectExpr("if(id % 3 = 0, null, id) doc_id", "if(id % 2 = 0, 'same', concat('t', id)) text")
    folder = f"file://{tmp_path}/hot"
    index = records.write_records(docs, folder, WORD, end_id=1)
    sizes = [r["count"] for r in index.groupBy("shard").count().collect()]
    assert sum(sizes) == 900 and max(sizes) < 400
    rows = records.read_shards(index, folder).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows) and len(rows) == 900


@pytest.mark.parametrize("space", [" ", "\t", "\n", "x"])
def test_long_runs_of_one_character(spark, space):
    text = space * 3_000_000 + "end"
    want = np.array(ids_of(text), dtype="<u4").tobytes()
    assert list(tokens.encoded([text, "a"], BYTE))[0] == want and list(tokens.lengths(["a", text], BYTE)) == [1, len(want) // 4]
    if space == " ":
        docs = spark.createDataFrame([(1, text), (2, "a b")], "doc_id long, text string")
        assert [r.n_tokens for r in tokens.count_tokens(docs, BYTE).sort("doc_id").collect()] == [len(want) // 4, 2]
        pieces = packing.pack(packing.cut(docs, BYTE, end_id=2))
        assert pieces.groupBy("doc_id").agg(F.sum("length").alias("n")).sort("doc_id").collect() == [(1, len(want) // 4 + 1), (2, 3)]


def test_a_batch_is_encoded_like_its_texts():
    encoder = tokens.encoder(BYTE)
    sample = [t or "" for t in ODD] + generated(500, 3)
    for texts in ([], [""], ["", ""], sample, [*sample, tokens.BREAK], [tokens.BREAK * 2, "a"], [tokens.BREAK[0], tokens.BREAK[1]]):
        want = [np.array(ids_of(t), dtype="<u4").tobytes() for t in texts]
        assert encoder.encode_all(texts) == want and encoder.lengths(texts) == [len(x) // 4 for x in want]
