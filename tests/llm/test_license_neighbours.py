"""Licenses that differ from a listed one in a word or a clause."""

import pytest

from millrace.llm import licenses
from millrace.llm.tokens import slices

PREPARED = [(n, w, licenses.places(w.tolist(), n)) for n, w in ((n, licenses.template_words(t)) for n, t in licenses.TEMPLATES)]
NOTICES = {n: t for n, t in licenses._gnu()}


def found(text):
    part = next(iter(slices([text], fold=licenses._FOLD)))
    return [m["license"] for m in licenses.matches(part, PREPARED, licenses.COVERAGE)[0]]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Licensed under the BSD License.", []),
        ("Licensed under the MIT License.", ["MIT"]),
        ("Licensed under CC BY 3.0.", ["CC-BY-3.0"]),
        ("Licensed under CC BY-ND 4.0.", ["CC-BY-ND-4.0"]),
        ("Licensed under CC BY-XX 4.0.", []),
        ("Licensed under CC BY 9.0.", []),
        ("Licensed under the Apache License, Version 1.1.", []),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"]),
        ("This work is licensed under the GNU Odd General Public License, version 3.", []),
    ],
)
def test_neighbouring_notices(text, want):
    assert found("some words. " + text + " other words") == want


@pytest.mark.parametrize("name", sorted(NOTICES))
def test_gnu_notices(name):
    assert found("start " + NOTICES[name] + " end") == [name]


@pytest.mark.parametrize("name", sorted(licenses._TEXTS))
def test_whole_texts(name):
    words = licenses._TEXTS[name].split()
    for i in range(50, len(words), 97):
        words[i] = "edited" if words[i].isalpha() and words[i].islower() else words[i]
    assert found("before " + " ".join(words) + " after") == [name]
