from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, normalizers

from tessera.llm import tokencount

PIECES = tokencount.load_pieces(tokencount.vocabulary_path())


def reference(pieces, byte_fallback):
    t = Tokenizer(models.Unigram(pieces, 0, byte_fallback))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


WHOLE = tokencount.counter(tokencount.vocabulary_path())
REFERENCE = reference(PIECES, True)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from("the tion ing é ß ▁ \n\t  <0x0A>"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_counts_are_the_tokenizers(text):
    assert WHOLE.count(text)[1] == REFERENCE(text)


TIED = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("bb", -1.0), ("▁", -1.0), ("▁a", -2.0), ("a▁b", -3.0)]


@settings(max_examples=400, deadline=None)
@given(st.text("abc ", max_size=14))
def test_ties_and_unknown_runs(text):
    assert tokencount.Counter(TIED).count(text)[1] == reference(TIED, False)(text)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in tokencount.token_counts(docs).collect()}
    assert got == {r.doc_id: REFERENCE(r.text) for r in docs.collect()}


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " "), (3, " "), (None, "a  b\n\n c"), (4, "word " * 20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_tokens")
    got = sorted((r.doc_id or 0, r.n_tokens) for r in tokencount.token_counts(docs).collect())
    assert got == sorted((i or 0, REFERENCE(t or "")) for i, t in rows)
    assert tokencount.token_counts(docs.limit(0)).collect() == []
