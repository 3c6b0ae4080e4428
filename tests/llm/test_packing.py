import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


TOKENIZER = tokenizer()


def ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aZé'sT<|>endoftx09_-.,²½ \n\t\x1c\x85\xa0\xadÀÿΣςİǅ"), st.characters(exclude_categories=["Cs"])), max_size=30))
def test_word_ids_are_the_tokenizers(text):
    [(_, got)] = packing.encode_documents([text.encode()], packing.tokenizer_path())
    assert got.tolist() == ids(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aZé÷ß.,<| \n\t½…"), max_size=12)), max_size=6))
def test_texts_together(texts):
    got = list(packing.encode_documents([t if t is None else t.encode() for t in texts], packing.tokenizer_path()))
    assert [(i, x.tolist()) for i, x in got] == [(i, ids(t)) for i, t in enumerate(texts)]


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 40)
    monkeypatch.setattr(packing, "KEPT_WORDS", 10)
    monkeypatch.setattr(packing, "SLICE_BYTES", 50)
    packing._encoders.clear()
    texts = [" ".join(f"w{chr(97 + (i * k) % 26)}x{chr(97 + i % 26)}" for i in range(25)) for k in range(1, 40)]
    for _ in range(2):
        got = list(packing.encode_documents([t.encode() for t in texts], packing.tokenizer_path()))
        assert [x.tolist() for _, x in got] == [ids(t) for t in texts]
        packing.encoder(packing.tokenizer_path()).trim()
        assert len(packing.encoder(packing.tokenizer_path()).words) <= 10
    packing._encoders.clear()


def test_special_token_text_is_kept(spark):
    text = "say <|ENDOFTEXT|> and <|endoftext|> o'clock I'll don't"
    [(_, got)] = packing.encode_documents([text.encode()], packing.tokenizer_path())
    assert got.tolist() == ids(text)


def test_knapsack_and_cutting_stock():
    value, pattern = packing.knapsack(np.array([0.1, 0.25, 0.3, 0.6, 0.0, 0.0, 0.0]), 7)
    assert abs(value - 0.95) < 1e-9 and (pattern * np.arange(1, 8)).sum() <= 7
    rng = np.random.default_rng(1)
    for n, m in ((64, 40), (64, 100_000), (256, 500)):
        demand = np.bincount(np.minimum(rng.geometric(0.05, m), n) - 1, minlength=n)
        plan = packing.cutting_stock(demand)
        assert (sum(p * t for p, t in plan) == demand).all()
        assert all((p * np.arange(1, n + 1)).sum() <= n for p, _ in plan)
        lower = (demand * np.arange(1, n + 1)).sum() / n
        assert sum(t for _, t in plan) <= lower * 1.01 + 4
    assert packing.cutting_stock(np.zeros(8, int)) == []


def verify(rows, docs, capacity=packing.CAPACITY):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(docs)
    for i, text in docs.items():
        want, at = np.array([*ids(text), 2], "<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want)
            assert zlib.crc32(want[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(want)
    for group in by_sequence.values():
        at = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence), sum(r.length for r in rows)


def test_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = {r.doc_id: r.text for r in table.collect()}
    sequences, total = verify(packing.pack(table).collect(), docs)
    assert sequences <= total / packing.CAPACITY * 1.02 + 2


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "word " * 5000), (4, "x"), (None, "y z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS class", "2 AS length", "3 AS id")
    verify(packing.pack(frame).collect(), dict(rows))
    got = packing.pack(frame, keep_ids=True).where("doc_id = 3").orderBy("start").collect()
    assert [i for r in got for i in r.ids] == [*ids("word " * 5000), 2]
    twice = packing.pack(frame.union(frame))
    assert twice.count() == 2 * packing.pack(frame).count()
    assert packing.pack(frame.limit(0)).collect() == []


def test_short_and_equal_pieces_fill_their_sequences(spark):
    """Thousands of empty, equal and very short texts: gapless from 0, full but for the last sequences."""
    rows = [(None, None)] * 9000 + [(7, "same words here")] * 9000 + [(i, "word " * (i % 23)) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = packing.pack(docs).collect()
    assert len(got) == len(rows)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in got)
    assert total / (4096 * len(sequences)) > 0.95
    assert sorted(sequences) == list(range(len(sequences)))
