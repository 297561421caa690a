"""License scans against alignment at every position."""

import numpy as np

from sparkdoc.llm import licenses

MIT = licenses.TEMPLATES["mit-line"]


def everywhere(scanner, text, template):
    """The most words that an alignment in any window matches."""
    words, width = licenses.words_of(text), len(template) + 2 * (len(template) // 4)
    return max((len(licenses.patience(words[a : a + n], template)) for a in range(len(words)) for n in (len(template), width)), default=0)


def test_neighbouring_words_hide_no_license():
    scanner = licenses.Scanner({"mit-line": MIT})
    for before, at in (("Under the license, ", 3), ("the license ", 2), ("license under the the license under ", 6)):
        assert scanner.scan(before + MIT) == [("mit-line", 1.0, 5, at, at + 5)]
    twice = scanner.scan(f"the license {MIT} under the {MIT} the MIT")
    assert [x[1:] for x in twice] == [(1.0, 5, 2, 7), (1.0, 5, 9, 14)]


def test_long_template_after_its_own_words():
    mit = licenses.TEMPLATES["mit"]
    n, rng = len(licenses.words_of(mit)), np.random.default_rng(4)
    for k in range(6):
        prose = " ".join(rng.choice(licenses.words_of(mit), 60 + 35 * k))
        found = licenses.Scanner({"mit": mit}).scan(f"{prose} {mit} {prose} {mit}")
        assert [x[1] for x in found] == [1.0, 1.0]
        assert [(x[3], x[4]) for x in found] == [(p, p + n) for p in (60 + 35 * k, 2 * (60 + 35 * k) + n)]


def test_against_every_position():
    rng, template = np.random.default_rng(8), licenses.words_of(MIT)
    scanner = licenses.Scanner({"mit-line": MIT})
    found = 0
    for _ in range(1500):
        text = " ".join(rng.choice([*template, "x", "y"], int(rng.integers(1, 25))))
        most, got = everywhere(scanner, text, template), scanner.scan(text)
        assert bool(got) == (most >= 4), text
        assert max((x[2] for x in got), default=most) == most
        assert all(a[4] <= b[3] for a, b in zip(got, got[1:], strict=False))
        found += bool(got)
    assert found > 100
