import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rolloom.llm import token_output as T
from rolloom.llm.queries import TOKENIZER


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab é\n\t.'  ñs1"), max_size=40))
def test_cut_words_have_the_ids_of_the_text(text):
    assert T.Encoder(TOKENIZER.path)(text) == T._encoding(TOKENIZER.path).encode_ordinary(text)


@pytest.mark.parametrize("size", [1, 2, 3, 17, 1000, 4097])
def test_permutation(size):
    numbers = np.arange(size)
    slots = T.permute(numbers, size, 5)
    assert sorted(slots.tolist()) == numbers.tolist()
    assert T.permute(slots, size, 5, inverse=True).tolist() == numbers.tolist()
    if size > 100:
        assert (slots != T.permute(numbers, size, 6)).mean() > 0.9
        assert abs(np.corrcoef(slots, numbers)[0, 1]) < 0.2


def stream(layout):
    """All ids in sequence order, read back from the files."""
    order = T.permute(np.arange(layout.sequences), layout.sequences, layout.key)
    return T.read_slots(layout, 0, layout.sequences)[order].ravel() if layout.sequences else np.empty(0, int)


def test_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    result, layout = T.write_training_order(docs, "doc_id", "text", TOKENIZER, length=64, per_shard=100)
    rows = result.collect()
    assert sorted(r.slot for r in rows) == list(range(layout.sequences))
    assert all(r.shard == r.slot // 100 and r.byte_offset == r.slot % 100 * 128 for r in rows)
    encoding = T._encoding(TOKENIZER.path)
    ids = stream(layout)
    ends = np.nonzero(ids == TOKENIZER.end)[0]
    texts, begin = [], 0
    for end in ends.tolist():
        texts.append(encoding.decode(ids[begin:end].tolist()))
        begin = end + 1
    padding = texts.count("")
    assert sorted(t for t in texts if t) == sorted(r.text for r in docs.collect())
    assert padding < 64
    some = T.read_slots(layout, 137, 250)
    assert (some == T.read_slots(layout, 0, layout.sequences)[137:387]).all()
    again = {r.slot: r.crc32 for r in result.collect()}
    assert again == {r.slot: r.crc32 for r in rows}


def test_edges(rows):
    data = [(1, None, 3), (2, "", 3), (None, "word " * 500, 3), (4, "same", 3), (4, "same", 3)]
    df = rows("doc_id long, text string, slot int", data)
    result, layout = T.write_training_order(df, "doc_id", "text", TOKENIZER, length=16, per_shard=3)
    assert result.count() == layout.sequences
    assert (stream(layout) == TOKENIZER.end).sum() >= 3
    result, layout = T.write_training_order(rows("doc_id long, text string", []), "doc_id", "text", TOKENIZER)
    assert result.collect() == [] and layout.sequences == 0
