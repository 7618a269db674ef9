"""How the search for the nearest examples lays them out, and that it stays exact."""

import numpy as np
import pytest

from featurekit.llm import toxicity


def test_examples_of_one_vocabulary_lie_together():
    """Whatever their labels: a text opens no group of examples that share no word with it."""
    rng = np.random.default_rng(3)
    n = 2 * 512
    examples = [(i, int(rng.random() < 0.3), {f"{'ab'[i % 2]}{k}": int(rng.integers(1, 3)) for k in rng.choice(60, 25, replace=False)}) for i in range(n)]
    place = toxicity.build(examples, {}, n).lists.place
    assert len(set(place[::2] // 512)) == len(set(place[1::2] // 512)) == 1


def test_terms_are_numbered_from_the_commonest_on():
    index = toxicity.build([(i, i % 2, {"often": 1, f"w{i % 20}": 2, f"x{i}": 1}) for i in range(40)], {}, 40)
    assert index.ids["often"] == 0 and index.ids["nowhere"] is None
    df = np.bincount(index.terms)
    assert (np.diff(df) <= 0).all()


@pytest.mark.parametrize("held", [64, 1 << 15])
def test_common_and_listed_terms_add_up(monkeypatch, held):
    """Weights of groups, and runs of lists with terms that occur several times, against all cosines."""
    for name, value in {"GROUP": 2, "DENSE": 50, "SHARED": 12, "HELD": held, "ABREAST": 3, "BATCH": 100}.items():
        monkeypatch.setattr(toxicity, name, value)
    rng = np.random.default_rng(4)
    often = rng.random(300) ** 4
    examples = [(i, int(rng.random() < 0.4), {f"t{k}": int(rng.integers(1, 6)) for k in np.flatnonzero(rng.random(300) < often)}) for i in range(1000)]
    index = toxicity.build(examples, {}, 1000)
    assert any(len(t) for t in index.lists.terms) and len(index.lists.listed) > 1000
    dense = np.zeros((1000, 300))
    for e in range(1000):
        t, w = index.example(e)
        dense[e, t] = w
    numbers = list(range(0, 1000, 25))
    for without in (None, numbers):
        got = index.search([index.example(e) for e in numbers], without)
        for e, (cosine, best, shares) in zip(numbers, got, strict=True):
            every = (dense @ dense[e]).round(9)
            want = sorted((-s, i) for i, s in enumerate(every) if s > 0 and not (without and i == e))[: toxicity.NEIGHBOURS]
            assert best.tolist() == [i for _, i in want]
            assert cosine == pytest.approx([-s for s, _ in want])
            t, w = index.example(e)
            assert shares == pytest.approx((1 / (1.05 - cosine)) @ dense[best][:, t] * w)


def test_words_are_those_of_the_pattern():
    for text in ("".join(map(chr, range(256))), "It's n°5, ½ naïve_x2 ÀÉß\u0085ª", "İstanbul ΣΑΣ “straße” x", "", None):
        assert toxicity.words(text) == toxicity._WORDS((text or "").lower())


def test_examples_without_words():
    index = toxicity.build([(i, i % 2, {}) for i in range(4)], {}, 4)
    assert toxicity.Scorer(index, (1.0, 0.0, 0.25))(["any word", "", None]) == [(0.25, [], [])] * 3
    assert index.own_votes([0, 3]) == [None, None]
