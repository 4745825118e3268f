import tracemalloc

import numpy as np
from foliant.llm import minhash


def test_a_pair_of_blocks_holds_no_wide_number_for_every_pair():
    r = np.random.default_rng(0)
    base, rows = r.integers(0, 1 << 63, (301, 1000), dtype=np.uint64), []
    for i in range(2 * minhash.BLOCK):
        s, n = base[i % 301].copy(), int(r.integers(0, 160))
        s[:n] = r.integers(0, 1 << 63, n, dtype=np.uint64)
        s = np.unique(s)
        rows.append((1, 0, 1, i % 2, i, i, minhash.signature(s), s))
    tracemalloc.start()
    links = minhash._links(rows, 80)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert links.num_rows == 364 and peak < 75e6
