"""Batches are worked through in pieces of bounded text."""

import pyarrow as pa

from millrace.llm import quality, tokens


def test_pieces_hold_a_slice_at_most(monkeypatch):
    monkeypatch.setattr(tokens, "SLICE_BYTES", 10)
    texts = ["abcd", None, "efghij", "k", "a text above the limit", "", "l", None]
    batch = pa.record_batch({"doc_id": list(range(8)), "text": texts})
    got = [x.column(1).to_pylist() for x in tokens.pieces(iter([batch, batch.slice(0, 0)]), 1)]
    assert sum(got, []) == texts and all(len(x) == 1 or sum(len(t or "") for t in x) <= 10 for x in got)


def test_quality_answers_in_pieces(monkeypatch):
    monkeypatch.setattr(tokens, "SLICE_BYTES", 10)
    batch = pa.record_batch({"doc_id": list(range(5)), "text": ["one two three"] * 5})
    got = list(quality._judge(quality.Bands())(iter([batch])))
    assert [x.num_rows for x in got] == [1] * 5 and [x.column(0).to_pylist()[0] for x in got] == list(range(5))
