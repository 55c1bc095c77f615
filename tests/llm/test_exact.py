import hashlib
import re
import uuid

import pytest

import __spark_entry__ as entry
from assay.llm import exact
from assay.llm.common import scratch
from tests.conftest import SF_SMALL
from tests.llm.conftest import NASTY, frame


@pytest.fixture
def index(spark):
    name = f"digests_{uuid.uuid4().hex}"
    return exact.open_index(spark, name, 8, scratch(spark, name))


def _sha(text):
    return hashlib.sha256((text or "").encode()).digest()


def _brute(rows, seen=()):
    """Verdicts of a batch against ``seen``: digest -> keep_id."""
    groups = {}
    for k, t in rows:
        groups.setdefault(_sha(t), []).append(k)
    out = []
    for k, t in rows:
        d = _sha(t)
        best = max(groups[d], key=lambda x: float("-inf") if x is None else x)
        known = d in seen
        keep = seen[d] if known else best
        out.append((k, d, keep, len(groups[d]), known, not known and k == keep))
    return out


def _rows(df):
    return sorted(((r.doc_id, bytes(r.digest), r.keep_id, r.group_size, r.known, r.kept) for r in df.collect()), key=repr)


def test_equals_brute_force_with_a_hot_text(spark, index, monkeypatch):
    monkeypatch.setattr(exact, "HEAVY_PARTS", 10)
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 400}" if i % 2 else "warm" if i % 8 == 0 else f"T{i}") for i in range(3000)]
    out = exact.deduplicate(frame(spark, [(*r, "en") for r in rows]), index, "a")
    assert _rows(out) == sorted(_brute(rows), key=repr)


def test_batches_append_and_rerun(spark, index):
    first = [(1, "a"), (5, "a"), (2, "b"), (3, None), (4, "")]
    second = [(9, "a"), (8, "c"), (7, "c"), (6, ""), (10, "A"), (11, "a ")]
    one = exact.deduplicate(frame(spark, [(*r, "en") for r in first]), index, "one")
    assert _rows(one) == sorted(_brute(first), key=repr)
    seen = {_sha("a"): 5, _sha("b"): 2, _sha(""): 4}
    for _ in range(2):  # the same batch again, as after a failure: same verdicts, nothing appended twice
        two = exact.deduplicate(frame(spark, [(*r, "en") for r in second]), index, "two")
        assert _rows(two) == sorted(_brute(second, seen), key=repr)
        stored = {bytes(r.digest): (r.keep_id, r.n, r.batch) for r in spark.table(index).collect()}
        assert spark.table(index).count() == len(stored) == 6
        assert stored[_sha("c")] == (8, 2, "two") and stored[_sha("a")] == (5, 2, "one")


def test_half_written_batch_is_completed(spark, index):
    rows = [(1, "a"), (2, "a"), (3, "b")]
    spark.createDataFrame([(_sha("a"), 2, 2, "x")], exact.INDEX_COLUMNS).write.insertInto(index)
    out = exact.deduplicate(frame(spark, [(*r, "en") for r in rows]), index, "x")
    assert _rows(out) == sorted(_brute(rows), key=repr)
    assert sorted((bytes(r.digest), r.keep_id) for r in spark.table(index).collect()) == sorted([(_sha("a"), 2), (_sha("b"), 3)])


def test_index_outlives_its_declaration(spark):
    name = f"digests_{uuid.uuid4().hex}"
    path = scratch(spark, name)
    exact.deduplicate(frame(spark, [(1, "a", "en")]), exact.open_index(spark, name, 4, path), "one").count()
    spark.sql(f"DROP TABLE {name}")  # files of a table with its own location stay
    again = exact.open_index(spark, name + "_again", 4, path)
    out = exact.deduplicate(frame(spark, [(2, "a", "en"), (3, "b", "en")]), again, "two").collect()
    assert sorted((r.doc_id, r.known, r.kept, r.keep_id) for r in out) == [(2, True, False, 1), (3, False, True, 3)]


def test_edges(spark, nasty, empty, index):
    rows = [(k, t) for k, t, _ in NASTY]
    assert _rows(exact.deduplicate(nasty, index, "nasty")) == sorted(_brute(rows), key=repr)
    before = spark.table(index).count()
    assert exact.deduplicate(empty, index, "none").count() == 0
    assert spark.table(index).count() == before


def test_plan_is_native_and_leaves_the_index_unshuffled(spark, index):
    plan = entry.queries()["op12_exact_dedup"](spark, SF_SMALL)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))
    exact.deduplicate(frame(spark, [(i, str(i), "en") for i in range(100)]), index, "a").count()
    groups = spark.range(10).selectExpr("unhex(sha2(cast(id as string), 256)) as digest")
    fresh = groups.hint("merge").join(spark.table(index).select("digest"), "digest", "left_anti")
    text = fresh._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and len(re.findall(r"Exchange hashpartitioning", text)) == 1
    assert "Bucketed: true" in text
