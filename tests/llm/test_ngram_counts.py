import numpy as np

from cadenza.llm import ngram_counts as n


def test_packed_values_come_back():
    rng = np.random.default_rng(1)
    for size, top in ((1, 5), (2, 1 << 63), (3000, 1 << 53), (40_000, 1 << 64), (20_000, 30_000)):
        v = np.unique(rng.integers(0, top - 1, size, dtype=np.uint64, endpoint=True))
        assert (n.unpack(n.pack(v)) == v).all()
    v = np.array([0, (1 << 64) - 1], np.uint64)
    assert (n.unpack(n.pack(v)) == v).all()


def test_squeezed_values_come_back():
    for v in ([], [0], [0, 255, 256, 1 << 40], list(range(1000))):
        assert n.unsqueeze(n.squeeze(np.array(v, np.int64))).tolist() == v
