import random

import pytest


@pytest.fixture(scope="session")
def prose():
    """Makes texts of invented words."""
    rng = random.Random(8)
    words = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(900)]

    def make(n: int) -> str:
        return " ".join(rng.choice(words) for _ in range(n))

    return make
