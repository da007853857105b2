"""The character lattice decoder against every reading of short words, and on long words."""

from __future__ import annotations

import random
import time

import pytest

from affinity.llm import toxicity
from affinity.llm.toxicity import END, Decoder, letter_class


def decoder(seed: int) -> Decoder:
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 6))) for _ in range(200)]
    grams: dict[str, int] = {}
    for word in words:
        t = f"{END}{END}{word}{END}"
        for i in range(len(t) - 2):
            grams[t[i:i + 3]] = grams.get(t[i:i + 3], 0) + rnd.randint(1, 9)
    return Decoder(grams, set(words[:20]))


def every_reading(d: Decoder, text: str) -> float:
    """The least cost over all readings, each kept with its whole text."""
    readings = [(0.0, END + END, "")]
    for i in range(len(text)):
        following = []
        for cost, before, done in readings:
            word = done.rsplit(" ", 1)[-1]
            for c, extra in d.options(text, i):
                if c == "" or c == END and not word:
                    following.append((cost + extra, before, done))
                elif c == END:
                    following.append((cost + extra + d.ended(before, word), END + END, done + " "))
                else:
                    k = letter_class(c)
                    following.append((cost + extra + d.cost(before, k), before[1] + k, done + c))
                    if c == done[-1:]:
                        following.append((cost + 1.0, before, done))
        readings = list(set(following))
    return min(cost + d.ended(before, done.rsplit(" ", 1)[-1]) for cost, before, done in readings)


@pytest.mark.parametrize("nodes", [4096, 2])
def test_no_reading_is_lost(monkeypatch, nodes):
    monkeypatch.setattr(toxicity, "NODES", nodes)
    rnd = random.Random(5)
    for seed in range(3):
        d = decoder(seed)
        hidden = [w.replace("o", "0").replace("e", "3")[:7] for w in sorted(d.toxic_words)]
        drawn = ["".join(rnd.choice("etaoinsh0134@$!|+. _-é日") for _ in range(rnd.randint(1, 7))) for _ in range(150)]
        for text in hidden + drawn + ["n*t", "a#?e", ".", "  ", "eeee", "e.e.e"]:
            cost, got = d.decode(text)
            assert cost == pytest.approx(every_reading(d, text), abs=1e-9), (text, got)


def test_long_words():
    """Time follows the length; all of a long word is read."""
    d = decoder(1)
    rnd = random.Random(2)
    text = "".join(rnd.choice("abcdefgh0134ijkl") for _ in range(200_000))
    start = time.time()
    got = d.decode(text)[1]
    assert time.time() - start < 60
    assert 150_000 < len(got) <= 200_000 and not set(got) & set("0134")
    assert d.decode("") == (0.0, "")
