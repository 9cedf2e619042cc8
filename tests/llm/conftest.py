import random

import pytest


@pytest.fixture
def words():
    """A function that draws n words of an invented vocabulary."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    return lambda n: [rng.choice(vocabulary) for _ in range(n)]
