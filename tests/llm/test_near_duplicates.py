"""Near-duplicates against all pairs, and components against union-find."""

import random
import re

import pytest

from lumenfold.llm.components import components
from lumenfold.llm.near_duplicates import near_duplicates

from .data import SCHEMA, documents


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def roots(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in nodes}


def plain(rows, width=5):
    sets = {}
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(r[1]))
        if r[0] is not None:
            sets[r[0]] = {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = roots(ids, links)
    return sorted((r[0], len(sets[r[0]]), root[r[0]], root[r[0]] == r[0]) for r in rows if r[0] is not None)


def family(rng, n, words=120):
    """Copies of one text with a few words changed in each, at other places: most are near the text, few near each other."""
    base = [f"b{rng.randrange(10**6)}" for _ in range(words)]
    for _ in range(n):
        text = list(base)
        for at in rng.sample(range(words), 3):
            text[at] = f"e{rng.random()}"
        yield " ".join(text)


@pytest.mark.parametrize("seed,part", [(1, 4096), (2, 7), (3, 2)])
def test_near_duplicates(spark, seed, part):
    rng = random.Random(seed)
    rows = documents(seed, 40, 400)
    rows += [(1000 + i, t, None, None, None, None) for i, t in enumerate([*family(rng, 12), *family(rng, 5), "A b", "a B", "a b c"])]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), part=part)
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_recall_at_the_threshold(spark):
    """Pairs of similarity 0.75 to 0.8 and just below: all of the first are linked, none of the second."""
    rng = random.Random(11)
    rows, want = [], {}
    for i in range(1500):
        words = [f"c{rng.randrange(10**7)}" for _ in range(104)]
        other, gone = list(words), rng.randrange(11, 16)  # the last words differ: 100 shingles, 100 - gone shared
        other[-gone:] = [f"d{rng.randrange(10**7)}" for _ in range(gone)]
        rows += [(2 * i, " ".join(words), None, None, None, None), (2 * i + 1, " ".join(other), None, None, None, None)]
        want[2 * i + 1] = 2 * i if 100 * (100 - gone) >= 75 * (100 + gone) else 2 * i + 1
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(set(want.values()) - {w for w in want if want[w] == w}) > 500
    assert all(got[k] == v for k, v in want.items())


def test_near_duplicates_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(30)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(7, 7)]
    nodes = {x for a, b in links if a != b for x in (a, b)}
    got = components(spark.createDataFrame(links, "a long, b long"))
    assert {r.doc_id: r.root for r in got.collect()} == roots(nodes, [x for x in links if x[0] != x[1]])
