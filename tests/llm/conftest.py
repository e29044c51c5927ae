import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_helpers import prose  # noqa: E402


@pytest.fixture(scope="session")
def corpus():
    """Texts with exact and near copies, shared passages, repetition, edge cases."""
    rng = random.Random(5)
    texts = [None, "", "   \n", "one", "one", "Two words", "a b c d", "A B C D", "É ü ß 漢字 été", "x" * 5000]
    passage = " ".join(prose(rng, 60))
    for n in (3, 4, 5, 8, 12, 30, 80, 200, 700):
        for _ in range(4):
            base = prose(rng, n)
            texts.append(" ".join(base))
            for edits in (0, 1, 3):
                other = list(base)
                for _ in range(edits):
                    other[rng.randrange(n)] = f"e{rng.randrange(9)}"
                texts.append(" ".join(other))
            if n >= 80:
                texts.append(" ".join([*base[:5], passage, *base[40:70], passage, *prose(rng, 20)]))
    texts.append("Und " * 300)
    texts.append("Und " * 290)
    texts.append(" ".join(prose(rng, 20_000, 50)))
    return texts
