"""What the classifier's training holds on the driver."""

import tracemalloc

import numpy as np

from trailframe.llm import quality_knn


def test_weighing_holds_the_result_and_a_block():
    counts = np.random.default_rng(0).integers(0, 3, (2000, quality_knn.TERMS)).astype(np.float32)
    model = quality_knn.Model(counts[:50], np.arange(50) % 2, 4, 3)
    tracemalloc.start()
    out = model._weigh(counts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.7 * out.nbytes
    assert (out[700] == model._weigh(counts[700:701])[0]).all()
