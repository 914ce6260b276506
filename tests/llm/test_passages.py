"""Passages inside other texts, and texts that tempt a pattern to look back."""

from __future__ import annotations

import time

import numpy as np
import pytest

from hypso.llm import repeats


def prose(rng, n: int) -> list[str]:
    return ["".join(rng.choice(list("abcdefghijklmnoprstuvw"), rng.integers(2, 9))) for _ in range(n)]


def left_of(texts: list[str]) -> list[str]:
    """What a plain loop leaves of texts in order."""
    seen, out = set(), []
    for text in texts:
        units, runs = repeats.sentence_spans(text)
        gone, own = set(), set()
        for run in runs:
            if run.hash in seen or run.again:
                gone.update(range(run.first, run.end))
            own.add(run.hash)
        seen |= own
        out.append("".join(u for k, u in enumerate(units) if k not in gone))
    return out


def sentence(rng, n: int) -> str:
    return " ".join(prose(rng, n)).capitalize() + "."


def test_whole_sentences_of_a_passage_go_wherever_it_was_put():
    """A passage in the midst of another sentence: its first sentence stays, as it is joined to that one."""
    rng = np.random.default_rng(3)
    for _ in range(100):
        passage = [sentence(rng, int(n)) for n in rng.integers(4, 20, 5)]
        texts = [" ".join([sentence(rng, 20), *prose(rng, 5), *passage, sentence(rng, 9)]) for _ in range(2)]
        left = left_of(texts)
        assert left[0] == texts[0]
        assert left[1] == texts[1].replace(" ".join(passage[1:]) + " ", "")


def test_texts_of_their_own_stay():
    rng = np.random.default_rng(4)
    texts = [" ".join(sentence(rng, int(n)) for n in rng.integers(1, 30, 30)) for _ in range(50)]
    assert left_of(texts) == texts


@pytest.mark.parametrize("text", ["." * 200_000, " " * 200_000, "a. " * 60_000, "\n" * 200_000, '.")' * 60_000, '."' + ")" * 200_000, "a" * 200_000, "a\n" * 100_000, "  x "])
def test_work_is_linear(text):
    began = time.thread_time()
    repeats.sentence_spans(text)
    repeats.line_prints(text)
    assert time.thread_time() - began < 5 and "".join(repeats.sentences(text)) == text
