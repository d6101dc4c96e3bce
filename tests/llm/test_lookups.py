"""Look-ups in a model of many shards: many tokens at a time, and arrays that stay mapped without open files."""

import os

import numpy as np

from millrace.llm import kneser_ney as K
from millrace.llm.tokens import SLICE_BYTES, slices


def test_slices_are_looked_up_together(monkeypatch):
    texts = ["", *(f"w{i} A " * 20_000 for i in range(8)), None, "b"]
    parts = list(slices(texts, K.LOWER))
    assert sum(len(t or "") for t in texts) > 3 * SLICE_BYTES and len(parts) > 3
    (at, n, hashes, doc), *more = K.streams(texts)
    assert (at, n, more) == (0, len(texts), []) and len(hashes) == len(doc) == 8 * 40_000 + 1 + len(texts)
    assert (np.bincount(doc, minlength=n) == [1, *[40_001] * 8, 1, 2]).all() and (hashes[np.cumsum(np.bincount(doc)) - 1] == K.END).all()
    monkeypatch.setattr(K, "STEP_TOKENS", 50_000)
    steps = list(K.streams(texts))
    assert len(steps) > 2 and [s[0] for s in steps] == np.cumsum([0, *(s[1] for s in steps)])[:-1].tolist()
    assert (np.concatenate([s[2] for s in steps]) == hashes).all() and (np.concatenate([s[3] + s[0] for s in steps]) == doc).all()
    assert list(K.streams([])) == []


def test_arrays_stay_mapped_without_open_files(tmp_path):
    arrays = {str(tmp_path / f"{i}.npy"): np.arange(i, dtype=dtype) for i, dtype in enumerate([np.uint8, np.uint64, np.int64, np.uint16] * 10)}
    for path, a in arrays.items():
        K.save(path, a)
    before = len(os.listdir("/proc/self/fd"))
    kept = {path: K.mapped(path) for path in arrays}
    assert len(os.listdir("/proc/self/fd")) == before
    assert all((kept[p] == a).all() and kept[p] is K.mapped(p) for p, a in arrays.items()) and K.mapped(str(tmp_path / "none.npy")) is None
    assert K.mapped.cache_info().maxsize >= 10 * 256  # the shards of 6 GB
