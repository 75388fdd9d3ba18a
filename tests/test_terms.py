"""Terms are counted where their text is."""

from collections import Counter
from math import sqrt

import pytest

from folio.operators import description, narrative

ROWS = [(1, 0, "red fox red fox"), (1, 1, "red hen the fox"), (2, 0, None), (3, 0, "!"), (4, 0, "red fox"), (4, 0, "fox hen"), (None, 0, "hen"), (None, None, "hen hen")]


def _counts(*texts):
    c = Counter()
    for x in texts:
        w = [y for y in x.split() if y != "the"]
        c.update(w + [" ".join(p) for p in zip(w, w[1:], strict=False)])
    return c


def _df(spark):
    return spark.createDataFrame(ROWS, "doc_id long, chunk_index int, content string")


def test_chunk_terms(spark):
    got = {}
    for r in description.chunk_terms(_df(spark), stop_words=["the"], top=3).collect():
        got.setdefault(r.doc_id, []).append((r["rank"], r.term, round(r.score, 9), r.terms))
    # rows of one chunk are counted together, and no pair goes from one row into the next
    units = {1: [_counts(ROWS[0][2]), _counts(ROWS[1][2])], 4: [_counts("red fox", "fox hen")], None: [_counts("hen"), _counts("hen hen")]}
    assert set(got) == set(units)
    for key, each in units.items():
        scores = Counter()
        for c in each:
            for term, n in c.items():
                scores[term] += n / sqrt(sum(x * x for x in c.values()))
        best = sorted(((-round(s, 9), x) for x, s in scores.items()))[:3]
        assert sorted(got[key]) == [(i + 1, x, -s, len(scores)) for i, (s, x) in enumerate(best)]


def test_top_terms(spark):
    got = sorted((r["rank"], r.term, round(r.score, 9)) for r in narrative.top_terms(_df(spark), text="content", stop_words=["the"], features=4, top=2).where("doc_id = 1").collect())
    best = sorted(_counts(ROWS[0][2], ROWS[1][2]).items(), key=lambda x: (-x[1], x[0]))[:4]
    norm = sqrt(sum(n * n for _, n in best))
    assert got == [(i + 1, x, round(n / norm, 9)) for i, (x, n) in enumerate(best[:2])]


@pytest.mark.parametrize("made", [lambda d: description.chunk_terms(d), lambda d: narrative.top_terms(d, text="content")])
def test_texts_are_exchanged_and_no_terms(spark, made):
    plan = made(_df(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
