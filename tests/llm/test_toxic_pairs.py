"""Words that tell nothing alone still take part in pairs."""

import numpy as np

from plumbline.llm import toxicity


def test_pairs_without_marginal_effect():
    """Toxic if exactly one of two words is there: each word is as common in clean texts as in toxic ones."""
    rng = np.random.default_rng(0)
    texts, labels = [], []
    for a, b in [(0, 0), (0, 1), (1, 0), (1, 1)] * 300:
        filler = " ".join(rng.choice(["tree", "house", "river", "stone", "cloud"], 6))
        texts.append(f"{filler} {'wordx ' if a else ''}{'groupx' if b else ''}")
        labels.append(int(a != b))
    fm = toxicity.fit(texts, labels, epochs=20)
    got = [fm.score(f"tree river {x}") for x in ("wordx", "groupx", "wordx groupx", "")]
    assert min(got[0], got[1]) > 0.8 and max(got[2], got[3]) < 0.3


def test_no_screen_and_no_cap():
    words = [f"{a}{b}{c}" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst" for c in "abcdefghijklmnopqrst"]
    texts = [" ".join(words)] * 6
    fm = toxicity.fit(texts, [0, 1] * 3, epochs=1)
    assert all(fm.slot[toxicity.word_terms(w)[0]] for w in words)
