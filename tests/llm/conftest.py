import random

import pytest

WORDS = "river stone cloud paper garden window silver market morning letter forest candle bridge winter pocket harbor signal meadow copper lantern thunder basket violet engine cabin mirror desert planet saddle ribbon".split()


@pytest.fixture
def prose():
    """Random sentences, the same for a seed."""

    def make(seed, words, vocabulary=None):
        rng = random.Random(seed)
        pick = vocabulary or [a + b for a in WORDS for b in WORDS]
        return " ".join(rng.choice(pick) for _ in range(words))

    return make
