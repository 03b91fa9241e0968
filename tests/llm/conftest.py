import pytest


@pytest.fixture(scope="module")
def words():
    import random

    rng = random.Random(11)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]
