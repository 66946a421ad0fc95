"""N-best segmentations against all segmentations."""

import itertools
import math
import random
from array import array

import pytest
from corpus_audit.llm import piece_nbest as N

import public_tokenizers

FILE = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lattice():
    return N.PieceLattice(FILE, n_best=6)


def every_path(lattice, unit):
    """Score and ids of each way through a unit, by trying all pieces at each place."""
    if not unit:
        return [(0, ())]
    out = []
    for end in range(1, len(unit) + 1):
        entry = lattice.table.get(unit[:end])
        if entry:
            out += [(entry[1] + s, (entry[0], *ids)) for s, ids in every_path(lattice, unit[end:])]
    if not lattice.table.get(unit[0]):
        score, ids = lattice._unknown(unit[0])
        out += [(score + s, (*ids, *rest)) for s, rest in every_path(lattice, unit[1:])]
    return out


def ranked(lattice, unit):
    return sorted(every_path(lattice, unit), key=lambda p: (-p[0], p[1][::-1]))


UNITS = ["▁", "▁a", "▁the", "▁these", "▁aaaaaa", "▁▁▁▁", "▁abcabc", "▁été", "▁日本語", "▁x🎉y", "▁\n\n", "▁tion,", "▁hello.", "\x00"]


@pytest.mark.parametrize("unit", UNITS)
def test_units(lattice, unit):
    want = ranked(lattice, unit)
    for n in (1, 3, 6, 10**5):
        assert lattice.paths(unit, n) == want[:n]
    [(_, (ids, score, loss))] = lattice._best_and_loss([unit])
    assert (score, tuple(array("i", ids))) == want[0]
    assert loss == (want[0][0] - want[1][0] if len(want) > 1 else math.inf)
    lattice._know([unit])
    assert lattice.young[unit] == (ids, score, loss)


def test_random_units(lattice):
    rng = random.Random(1)
    units = {"▁" + "".join(rng.choices("aenti,é\n▁", k=rng.randrange(0, 7))) for _ in range(300)}
    lattice._know(sorted(units))
    shared = dict(lattice._best_and_loss(units))
    for unit in units:
        want = ranked(lattice, unit)
        assert lattice.paths(unit, 6) == want[:6]
        loss = want[0][0] - want[1][0] if len(want) > 1 else math.inf
        for ids, score, lost in (shared[unit], lattice.young[unit]):
            assert (score, tuple(array("i", ids)), lost) == (*want[0], loss)


def test_forgetting_changes_nothing():
    texts = ["the cat, sat on. it", "été\nà x", "the dog, sat", "zzz " * 30] * 3
    small = N.PieceLattice(FILE, 3, cached=3)
    whole = N.PieceLattice(FILE, 3)
    for t in texts:
        assert small.n_best_of(t) == whole.n_best_of(t)


@pytest.mark.parametrize("text", ["a", "the cat", " two  blanks ", "ab ab ab", "to be or", "is\nit", "né à"])
def test_texts(lattice, text):
    units = lattice.units_of(text)
    assert "".join(units) == lattice.model.normalize(text)
    options = [ranked(lattice, u)[:20] for u in units]
    want = sorted(
        (-sum(o[r][0] for o, r in zip(options, ranks)), ranks) for ranks in itertools.product(*(range(len(o)) for o in options))
    )[:6]
    found = lattice.n_best_of(text)
    assert [(s, tuple(array("i", ids))) for s, ids in found] == [
        (-score, tuple(itertools.chain(*(o[r][1] for o, r in zip(options, ranks))))) for score, ranks in want
    ]
    assert lattice.decode(found[0][1]) == text


def test_long_unit_is_bounded(lattice):
    found = lattice.paths("▁" + "ab" * 4000, 3)
    assert len(found) == 3 and found[0][0] >= found[1][0] >= found[2][0]


@pytest.mark.parametrize("unit", ["▁" + "aaa-" * 1500, "eee/" * 1500, "#" * 5000, "▁" + "=-" * 300 + "aaa" * 700])
def test_long_tied_unit(lattice, unit):
    found = lattice.paths(unit, 6)
    assert len(found) == 6 and found == sorted(found, key=lambda p: (-p[0], p[1][::-1])) and len({ids for _, ids in found}) == 6
    for score, ids in found:
        assert "".join(lattice.pieces[i] for i in ids) == unit
        assert score == sum(lattice.table[lattice.pieces[i]][1] for i in ids)
    assert len(lattice.n_best_of(unit)) == 6


def test_ties_of_any_length_go_by_ids(lattice):
    # All paths by brute force per prefix length, kept whole: the order must not depend on the length.
    def slow(unit, n):
        best = [[(0, ())]]
        for end in range(1, len(unit) + 1):
            made = []
            for start in range(max(0, end - 20), end):
                entry = lattice.table.get(unit[start:end])
                made += [(s - entry[1], (entry[0], *back)) for s, back in best[start]] if entry else []
            best.append(sorted(made)[:n])
        return [(-s, back[::-1]) for s, back in best[-1]]

    for unit in ("aaa-" * 4, "aaa-" * 120, "aaa-" * 140, "#" * 505, "#" * 515, "▁" + "ab" * 300):
        assert lattice.paths(unit, 6) == slow(unit, 6)


def test_awkward_rows(spark, awkward):
    df = awkward(long_words=2000)
    made = N.segment(df, FILE, 3)
    assert made.columns == [*df.columns, "segmentations", "decoded"]
    rows = made.collect()
    assert len(rows) == df.count()
    for r in rows:
        assert r["decoded"] == (r["text"] or "")
        if not r["text"]:
            assert [(s["score"], s["n_pieces"], bytes(s["ids"])) for s in r["segmentations"]] == [(0.0, 0, b"")]
    assert N.segment(df.limit(0), FILE).count() == 0
