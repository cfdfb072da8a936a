"""Made-up prose."""

import numpy as np


def vocabulary(n, seed=1):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 8))) + str(i % 7) for i in range(n)]


WORDS = vocabulary(400)


def prose(seed, n, words=WORDS):
    rng = np.random.default_rng(seed)
    return [words[i] for i in rng.integers(0, len(words), n)]
