"""Memory of the steps of katz_pairs, a token."""

import tracemalloc

import numpy as np
import pyarrow as pa

from snapfold.llm import katz_pairs


def test_steps_hold_few_bytes_a_token(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{i}" for i in rng.zipf(1.3, 300).clip(0, 50000)) for _ in range(500)]
    batch = katz_pairs.Batch(pa.record_batch({"doc_id": pa.array(range(500)), "held_out": pa.array([False] * 500), "text": pa.array(texts)}))
    monkeypatch.setattr(katz_pairs, "_batches", lambda _: iter([(0, batch)]))
    hot = np.zeros(0, np.uint64)
    for step, most in ((lambda: list(katz_pairs._messages(iter([]), hot, 12)), 70), (lambda: list(katz_pairs._asks(iter([]), hot, 12)), 35), (lambda: list(katz_pairs._word_counts(iter([]))), 35)):
        tracemalloc.start()
        step()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak <= most * len(batch.word)


def test_distinct_is_unique():
    for values in (np.zeros(0, np.uint64), np.array([7, 7, 2**64 - 1, 0, 7], np.uint64), np.random.default_rng(2).integers(0, 50, 1000)):
        kinds, of = katz_pairs._distinct(values)
        want, places = np.unique(values, return_inverse=True)
        assert (kinds == want).all() and (of == places).all()
