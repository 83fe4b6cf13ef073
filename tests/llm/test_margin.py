"""The margin of signatures against their measured deviation."""

import numpy as np

from tagloom.llm import minhash as H


def test_margin_is_five_deviations_of_small_sets():
    p, rng, off = H.MinHashParams(), np.random.default_rng(1), []
    for _ in range(1000):
        x = rng.integers(0, 2**64, 10, dtype=np.uint64)
        a, b = np.sort(x[:9]), np.sort(np.r_[x[:8], x[9:]])  # 8 of 10 in common
        bins = [H._mixed(H.signature(s, p)).astype(np.uint8) for s in (a, b)]
        off.append((bins[0] == bins[1]).mean() - 0.8)
    print("deviation", np.std(off), "least", min(off))
    assert p.margin >= 5 * np.std(off)
