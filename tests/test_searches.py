"""Screening nine models with the top three tuned, and successive halving over nested samples."""

import __spark_entry__ as entry
from tests.conftest import SF_SMALL

Q = entry.queries()


def test_screen_then_tune(spark):
    rows = Q["screen_then_tune"](spark, SF_SMALL).collect()
    screen = {r.model: r.cv_accuracy for r in rows if r.stage == "screen"}
    tuned = {r.model: r for r in rows if r.stage == "tuned"}
    final = {r.model: r for r in rows if r.stage == "final"}
    assert len(screen) == 9 and set(final) == set(screen)
    top = sorted(screen, key=lambda m: (-screen[m], m))[:3]
    assert set(tuned) == set(top) - {"gaussian_nb"} and all(r.params for r in tuned.values())
    for m, r in final.items():
        better = m in tuned and tuned[m].cv_accuracy > screen[m]
        assert r.cv_accuracy == (tuned[m].cv_accuracy if better else screen[m])


def test_halving_search(spark):
    rows = Q["halving_search"](spark, SF_SMALL).collect()
    by = {}
    for r in rows:
        by.setdefault(r.rung, []).append(r)
    assert [len(by[i]) for i in range(4)] == [50, 17, 6, 2]
    assert [round(by[i][0].share, 6) for i in range(4)] == [0.037037, 0.111111, 0.333333, 1.0]
    assert len({r.params for r in by[0]}) == 50
    for i in range(3):
        kept = {r.params for r in by[i + 1]}
        cut = max(r.cv_accuracy for r in by[i] if r.params not in kept)
        assert all(r.cv_accuracy >= cut for r in by[i] if r.params in kept)
