"""Features of toxicity against plain counting, and the greedy cover against trying every term."""

from __future__ import annotations

import math
import random
import re

from weftline.llm import toxicity


def plain_features(text: str, weights: dict[str, float]) -> dict[str, float]:
    """The features by regular expressions over words, for texts of ASCII letters without masked words."""
    words = re.findall(r"[a-z]+", text.lower())
    hits = [t for w in words for t in weights if (w == t.strip() if t.endswith(" ") else w.startswith(t))]
    letters = [c for c in text if c.isalpha()]
    n = max(1, len(text.split()))
    return {
        "hits_per_word": len(hits) / n, "log_hits": math.log1p(len(hits)), "distinct_terms": len({t.strip() for t in hits}), "hidden_hits_per_word": 0.0,
        "strongest": max((weights[t] for t in hits), default=0.0), "second_person_density": sum(w in toxicity.SECOND_PERSON for w in words) / n,
        "capitals": sum(c.isupper() for c in letters) / max(1, len(letters)), "punctuation": sum(not c.isalnum() and not c.isspace() for c in text) / max(1, len(text)),
        "exclamations": text.count("!") / n, "digits": sum(c.isdigit() for c in text) / max(1, len(text)), "log_words": math.log1p(len(text.split())),
    }


def test_features_against_plain_counting():
    rng = random.Random(4)
    weights = {"rude ": 3.0, "vile": 2.5, "nasty ": 1.0}
    lexicon = toxicity.Lexicon(weights)
    pool = ["you", "Your", "rude", "rudeness", "vile", "VILEST", "evilex", "nasty", "house", "tree,", "walks!", "42", "end."]
    for text in ["", "   ", "!", *(" ".join(rng.choices(pool, k=rng.randint(1, 40))) for _ in range(200))]:
        made = dict(zip(toxicity.FEATURES, lexicon.features(text)))
        for name, value in plain_features(text, weights).items():
            assert math.isclose(made[name], value, abs_tol=1e-12), (name, text)


def test_near_second_person_and_masked_words_of_any_length():
    lexicon = toxicity.Lexicon({"rude ": 3.0})
    near = dict(zip(toxicity.FEATURES, lexicon.features("you are so rude")))["second_person_near"]
    assert near == 1 / (1 + 11 / 10)
    masked = "r-u-d-e" + "." * 60
    assert dict(zip(toxicity.FEATURES, lexicon.features(f"so {masked} he is")))["hidden_hits_per_word"] == 1 / 4


def test_cover_takes_the_best_next_term():
    rng = random.Random(2)
    for _ in range(20):
        documents = [set(rng.sample(range(40), rng.randint(1, 15))) for _ in range(25)]
        candidates = [("t" * rng.randint(1, 5), len(d), rng.randint(0, 2)) for d in documents]
        left, expected = set(range(40)), []
        while True:
            best = min(range(25), key=lambda i: (-len(documents[i] & left), candidates[i][2], -len(candidates[i][0]), i))
            if len(documents[best] & left) < 3:
                break
            expected.append(best)
            left -= documents[best]
        assert toxicity.cover(candidates, documents, 3) == expected
