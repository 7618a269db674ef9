"""What the fits of quality and toxicity hold at once."""

import tracemalloc

import numpy as np

from featurekit.llm import quality, toxicity


def test_contexts_take_one_text_at_a_time():
    """Words of a text are let go once they are numbered: sequences may come from a generator, and no more is held."""
    rng = np.random.default_rng(5)
    codes = [rng.integers(0, 20_000, 300) for _ in range(300)]
    tracemalloc.start()
    ids, made = quality.contexts([f"word{i}" for i in c.tolist()] for c in codes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made.shape == (len(ids) + 1, quality.DIMENSIONS)
    assert not made[0].any()
    assert peak < 3 * made.nbytes + 12e6


def test_a_stem_is_hashed_once(monkeypatch):
    index = toxicity.build([(i, i % 2, {"alpha": 1, f"w{i}": 2}) for i in range(40)], {}, 40)
    asked = []
    monkeypatch.setattr(toxicity, "hashed", lambda found, f=toxicity.hashed: asked.extend(found := list(found)) or f(found))
    scorer = toxicity.Scorer(index, (1.0, 0.0, 0.1))
    scorer(["alphabet alphabets alphabetic alpha w3"])
    assert asked.count("alpha-") == 1
