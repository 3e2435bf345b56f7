"""Confidence folds in segments against a fold of one event after another."""

import math
import random

import pytest

from formlode.operators import learning as le


def walked(signs, start):
    conf, seen = start, []
    for positive in signs:
        conf = min(conf * le.BOOST, le.TOP) if positive else max(conf * le.DECAY, le.BOTTOM)
        conf = math.floor(conf * 1e6 + 0.5) / 1e6
        seen.append(conf)
    return seen


@pytest.mark.parametrize("segment", [100, 4096])
def test_segments_fold_as_one(spark, monkeypatch, segment):
    monkeypatch.setattr(le, "SEGMENT", segment)
    draw = random.Random(5)
    vectors = {1: [draw.random() < 0.5 for _ in range(700)], 2: [i % 2 == 0 for i in range(20)], 3: [True], 4: [i < 30 for i in range(60)]}
    rows = [(v, i // 2, i, s) for v, signs in vectors.items() for i, s in enumerate(signs)] + [(None, 0, 0, True)]
    draw.shuffle(rows)
    events = spark.createDataFrame(rows, "vector_id long, ts long, event_id long, positive boolean").repartition(7)
    for start in (le.START, 0.3):
        got = {r.vector_id: r for r in le.confidence_fold(events, start).collect()}
        assert got.keys() == vectors.keys()
        for v, signs in vectors.items():
            seen = walked(signs, start)
            assert (got[v].confidence, got[v].steps) == (seen[-1], len(seen))
            assert abs(got[v].total - start - sum(seen)) < 1e-9
    history = {(r.vector_id, r.event_id): r.confidence for r in le.confidence_history(events).collect()}
    assert history == {(v, i): c for v, signs in vectors.items() for i, c in enumerate(walked(signs, le.START))}
    assert le.confidence_fold(events.limit(0)).count() == 0
