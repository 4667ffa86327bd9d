"""Packing and its tokenizer: exact ids, every id in one piece, little padding; on small tables and on the hard rows."""

import random
import unicodedata
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from sparkwarden.llm import packing, queries
from sparkwarden.llm.word_tokens import WordTokenizer

SMALL = "/root/testdata/sf0.001"


def library():
    known = Tokenizer.from_file(queries.words_path())
    known.encode_special_tokens = True
    return known


def test_word_tokenizer_equals_the_library():
    rng = random.Random(8)
    known, own = library(), WordTokenizer(queries.words_path())
    texts = ["", None, " \n ", "Don't WE'LL 'S it's 12a _x_ ''s", "<|endoftext|> x<|startoftext|>", "ΟΔΟΣ Σ ΑΣ. İI J̌ á ́b x ́y"]
    texts += ["a\x1cb\x1d c\x85d\xa0e f", "\U0001f600\U0001f600a \U00010400bc", "가각 가 漢字かなカナ゙", "w" * 5000, "word " * 90_000 + "end", "x" * 600_000]
    signs = [c for c in map(chr, range(0x3000)) if unicodedata.category(c) != "Cs"] + list("漢字가\U0001f600ﬁᲉ")
    texts += ["".join(rng.choices(signs, k=rng.randint(1, 60))) for _ in range(800)]
    texts += ["".join(rng.choices("abÉ'st123 \n,.́", k=rng.randint(1, 200))) for _ in range(800)]
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == known.encode(text or "", add_special_tokens=False).ids, text


def histograms():
    rng = random.Random(4)
    yield from ((c, {}) for c in (1, 8))
    for context in (2, 8, 64):
        for n in (1, 2, 5, 50, 500):
            found = {}
            for _ in range(n):
                length = rng.randrange(1, context)
                found[length] = found.get(length, 0) + 1
            yield context, found
    yield 8, {5: 1000}
    yield 4096, {2049: 3000, 2050: 1}
    yield 4096, {1: 9000}
    yield 4096, {length: rng.randrange(1, 9) for length in range(1, 4096)}


@pytest.mark.parametrize("context, histogram", list(histograms()))
def test_plan_places_every_id_once_with_little_padding(context, histogram):
    plan, used = packing.Plan(histogram, context), {}
    for length, docs in histogram.items():
        for rank in range(docs):
            at = 0
            for start, size, sequence, offset in plan.pieces(length, rank):
                assert start == at and size > 0
                at += size
                used.setdefault(sequence, []).append((offset, size))
            assert at == length
    assert sorted(used) == list(range(plan.sequences))
    lost = 0
    for pieces in used.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at <= context
        lost += (context - at) if at & (at - 1) else 0
    assert lost <= packing.PADDING * sum(length * docs for length, docs in histogram.items())


def test_plan_cuts_nothing_where_packs_fit():
    plan = packing.Plan({4000: 100, 96: 100, 2048: 7, 1024: 14}, 4096)
    assert all(len(plan.pieces(length, rank)) == 1 for length, docs in ((4000, 100), (96, 100), (2048, 7), (1024, 14)) for rank in range(docs))


def test_plan_size_does_not_grow_with_the_documents():
    sizes = [sum(map(len, packing.Plan({length: n * 10**9 // length for length in range(1, 4096)}).places.values())) for n in (1, 1000)]
    assert max(sizes) < 120_000


def check_pieces(rows, expected, context):
    """``rows``: (doc_id, start, length, ids, doc_tokens, sequence_id, offset); ``expected``: doc_id -> the ids of its rows."""
    sequences, spans = {}, {}
    for doc_id, start, length, ids, doc_tokens, sequence, offset in rows:
        sequences.setdefault(sequence, []).append((offset, length))
        spans.setdefault(doc_id, []).append((start, length, bytes(ids), doc_tokens))
    total = lost = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= context
        total, lost = total + at, lost + ((context - at) if at & (at - 1) else 0)
    assert lost <= packing.PADDING * total
    assert spans.keys() == expected.keys()
    for doc_id, docs in expected.items():
        cut = sorted(spans[doc_id])
        assert {n for *_, n in cut} == {len(d) for d in docs}
        if len(docs) == 1:
            assert b"".join(ids for _, _, ids, _ in cut) == np.array(docs[0], "<u4").tobytes()
            assert [s for s, *_ in cut] == [sum(n for _, n, *_ in cut[:i]) for i in range(len(cut))]
        assert sum(n for _, n, *_ in cut) == sum(map(len, docs))


def test_packing_of_hard_rows(spark):
    rng = random.Random(6)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma's", "12", "é!"]) for _ in range(n))
    rows = [(i, words(rng.choice([1, 5, 40, 200, 1500]))) for i in range(300)] + [(1000 + i, "the same text here") for i in range(400)]
    rows += [(2000, None), (2001, ""), (2002, "word " * 120_000), (None, "no id"), (5, rows[5][1]), (6, "another text"), (2003, "w" * 100_000)]
    known, expected = library(), {}
    for doc_id, text in rows:
        expected.setdefault(doc_id, []).append([*known.encode(text or "", add_special_tokens=False).ids, 2])
    table = spark.createDataFrame([(i, t, 1, 2, "x", 4) for i, t in rows], "doc_id long, text string, n long, rest long, ids string, rank long")
    for context in (4096, 100):
        pieces = packing.pack_documents(table, queries.words_path(), context)
        check_pieces([tuple(r) for r in pieces.collect()], expected, context)
    joined = {r["sequence_id"]: r for r in packing.sequences(pieces, 100, 7).collect()}
    for r in joined.values():
        size = len(r["ids"]) // 4
        assert size == 100 or size & (size - 1) == 0
        assert r["ends"][-1] <= size and len(r["doc_ids"]) == len(r["ends"])
        assert np.frombuffer(bytes(r["ids"]), "<u4")[r["ends"][-1] :].tolist() == [7] * (size - r["ends"][-1])


def test_packing_of_nothing(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), queries.words_path()).count() == 0


def test_packing_query_over_the_small_table(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    known = library()
    ids = {i: np.array([*known.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in docs.items()}
    rows = queries.op13_packing(spark, SMALL).collect()
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
    whole = [(*r[:3], ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes(), *r[4:]) for r in rows]
    check_pieces(whole, {i: [x] for i, x in ids.items()}, 4096)
