import random

import numpy as np
from test_packing import best_possible

from threshfold.llm import packing as K


def test_goes_back_over_containers():
    # 11+9, 11+5+4, 10+7+3, 7+7+6; completion alone keeps best-fit's 5
    assert len(K.pack(np.array([11, 11, 10, 9, 7, 7, 7, 6, 5, 4, 3]), 20)) == 4


def test_small_packings_are_the_best():
    rnd = random.Random(5)
    for _ in range(300):
        sizes = [rnd.randint(1, 20) for _ in range(rnd.randint(1, 10))]
        bins = K.pack(np.array(sizes), 20)
        assert sorted(x for b in bins for x in b) == sorted(sizes) and all(sum(b) <= 20 for b in bins)
        assert len(bins) == best_possible(sizes, 20), sizes
