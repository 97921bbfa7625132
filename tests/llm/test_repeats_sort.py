"""op7: the suffix array, sorted from several letters at once."""

import random

import numpy as np

from clickwise.llm import repeats as R


def test_suffixes_are_in_order(monkeypatch):
    plain, sorts = np.argsort, []
    monkeypatch.setattr(R.np, "argsort", lambda *a, **k: sorts.append(k) or plain(*a, **k))
    rng = random.Random(7)
    for _ in range(300):
        s = np.array([*rng.choices(range(3, 3 + rng.choice([1, 2, 40])), k=rng.randint(0, 30)), 0, *rng.choices((3, 4), k=rng.randint(0, 30)), 1])
        assert R._suffixes(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    sorts.clear()
    R._suffixes(np.array([*range(20, 60), *range(20, 60), 0]))
    # 40 equal letters are told apart in three doublings of ten.
    assert len(sorts) <= 4 and not any(k.get("kind") == "stable" for k in sorts)
