"""Each stage of the pipeline against plain Python over what the stage before kept."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lumenfold.llm import pipeline
from lumenfold.llm.common import settle, table

from .test_documents import plain_hits, plain_targets, spoken
from .test_near_duplicates import plain
from .test_tokens import WORDS, ids

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """The rows of documents, then of each stage."""
    docs = table(spark, SF, "documents")
    found = {"documents": [tuple(r) for r in docs.collect()]}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, SF), name)
        found[name] = [tuple(r) for r in docs.collect()]
        assert docs.columns == columns or name == "tokens"
    return found


def test_language_rejects_texts_without_letters(kept):
    """The others stay; what has no lang gets the one that most of its words' neighbours in text have, others keep theirs."""
    want = [r for r in kept["documents"] if r[1] and any(c.isalpha() for c in r[1])]
    assert Counter((r[0], r[1], *r[3:]) for r in kept["language"]) == Counter((r[0], r[1], *r[3:]) for r in want)
    told = {r[0]: r[2] for r in want}
    assert all(r[2] == told[r[0]] if told[r[0]] else r[2] in {"de", "en", "es", "fr", *told.values()} for r in kept["language"])
    assert None not in {r[2] for r in kept["language"]}


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_empty_table(spark, name, stage):
    out = stage(spark, spark.createDataFrame([], COLUMNS), SF)
    assert out.collect() == [] and (name == "tokens" or out.columns == ["doc_id", "text", "lang", "source", "n_chars"])


def test_unnamed_languages_are_named(spark):
    rows, _ = spoken(n=200)
    docs = spark.createDataFrame([(r[0], r[1], None if i % 9 == 0 else r[2], r[3], r[4]) for i, r in enumerate(rows)], COLUMNS)
    got = {r.doc_id: r.lang for r in pipeline.language(spark, docs, SF).collect()}
    true = {r[0]: r[2] for i, r in enumerate(rows) if r[2] and i % 9 == 0 and r[1] and any(c.isalpha() for c in r[1])}
    assert true and sum(got[k] == v for k, v in true.items()) >= 0.95 * len(true)


def test_one_of_each_group_stays(kept):
    root = {r[0]: r[3] for r in plain(kept["language"])}
    want = [r for r in kept["language"] if root.get(r[0], True)]
    assert len(want) < len(kept["language"])
    assert Counter(kept["near_dedup"]) == Counter(want)


def test_documents_with_benchmark_windows_go(spark, kept):
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    hit = {w[0] for w in plain_hits(kept["near_dedup"], items) if w[5]}
    assert hit
    assert Counter(kept["decontamination"]) == Counter(r for r in kept["near_dedup"] if r[0] not in hit)


def test_sources_come_near_their_targets(kept):
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1]))
    before, after = Counter(), Counter()
    for r in kept["decontamination"]:
        before[r[3]] += size(r)
    for r in kept["mixing"]:
        after[r[3]] += size(r)
    assert set(kept["mixing"]) <= set(kept["decontamination"])
    assert max(Counter(kept["mixing"]).values()) <= 3
    longest = max(size(r) for r in kept["decontamination"])
    for source, target in plain_targets(before).items():
        assert abs(after[source] - target) <= longest


def mixed_ids(n=240):
    """Rows of several sources without doc_id, or with a few that repeat across sources."""
    rng = random.Random(8)
    text = lambda: " ".join(f"t{rng.randrange(10**6)}" for _ in range(rng.choice([20, 40, 80])))
    return [(None if i % 3 == 0 else i % 11, text(), "en", "aabbbbbc"[i % 8], i) for i in range(n)]


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_rows_without_own_id_are_deduplicated(spark):
    rows = mixed_ids()
    near = rows[3][1] + " more"
    copies = [rows[0], rows[1], (None, rows[1][1], "en", "z", 9), (5, near, "en", "z", 9), (None, None, "en", "z", 9), (None, None, "en", "z", 9)]
    got = Counter(map(tuple, pipeline.near_dedup(spark, spark.createDataFrame(rows + copies, COLUMNS), SF).collect()))
    assert got == Counter([r for r in rows if r != rows[3]] + [copies[3], copies[4], copies[5]])


def test_marks_tell_rows_apart(spark):
    """Equal rows share marks, also with nulls; a null is neither empty nor a value moved to another column."""
    rows = [(1, "a", None, "s", 1), (1, None, "a", "s", 1), (1, "a", "", "s", 1), (1, "", "a", "s", 1), (None, "a", None, "s", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows * 2, COLUMNS)
    got = Counter(map(tuple, docs.select(*pipeline.marks(docs)).collect()))
    assert len(got) == len(rows) and set(got.values()) == {2}
    assert len({m1 for m1, _ in got}) == len({m2 for _, m2 in got}) == len(rows)


def test_each_row_has_its_own_copies(spark):
    rows = mixed_ids()
    got, again = (Counter(map(tuple, pipeline.mixture(spark, spark.createDataFrame(rows, COLUMNS).repartition(n), SF).collect())) for n in (1, 5))
    size = lambda r: len(r[1].split())
    before, after = Counter(), Counter()
    for r in rows:
        before[r[3]] += size(r)
    for r, n in got.items():
        after[r[3]] += n * size(r)
    assert got == again and set(got) <= set(rows)
    for source, target in plain_targets(before).items():
        assert abs(after[source] - target) <= 80
        for n in (20, 40, 80):  # expected copies are those of a source's size class, so whole copies differ by one within it
            own = {got[r] for r in rows if r[3] == source and size(r) == n}
            assert max(own) - min(own) <= 1


def test_tokens_are_the_librarys(kept):
    start, want = 0, []
    for r in sorted(kept["mixing"], key=lambda r: (r[0], r[1])):
        own = [*ids(r[1], WORDS), 1]
        want.append((r[0], start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    assert sorted(kept["tokens"]) == sorted(want)


def test_run_is_its_stages(spark, kept):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(kept["tokens"])


def test_language_tasks_give_memory_back(spark, monkeypatch):
    """Predictions go through map_arrow, as processes stay for later stages with what they have not given back."""
    from lumenfold.llm import common, language_id

    seen = []
    monkeypatch.setattr(language_id, "map_arrow", lambda df, each, schema: seen.append(schema) or common.map_arrow(df, each, schema))
    docs = spark.createDataFrame([(1, "ab cd"), (2, None)], "doc_id long, text string")
    found = language_id.predict(docs, language_id.fit(docs.selectExpr("text", "'xx' as lang")))
    assert {r.doc_id: r.lang_pred for r in found.collect()} == {1: "xx", 2: "und"} and len(seen) == 2
