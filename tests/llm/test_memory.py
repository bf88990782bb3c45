"""What a scoring process holds is bounded, and bounds leave scores as they are."""

import numpy as np

from ledgerlens.llm.textcnn import Ensemble, TextCNN


def test_word_vectors_take_little_more_room_than_words():
    net = TextCNN(seed=1)
    net._start(np.random.default_rng(1))
    net.p["E"] = np.vstack([net.p["E"], np.zeros((1, net.dim), np.float32)])
    texts = [" ".join(f"word{i}" for i in range(lo, lo + 60)) for lo in range(0, 30_000, 50)]
    whole, parts = Ensemble([net]), Ensemble([net])
    a, b = whole.logits(texts, most=1_000_000), parts.logits(texts, most=700)
    assert np.allclose(a, b, atol=1e-5)
    assert len(parts.tables[0]) <= 1.3 * len(parts.rows)
