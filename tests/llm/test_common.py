import re

import numpy as np
import pyarrow as pa

from assay.llm.common import HEAVY_PARTS, hash_of, join_spread, settle, words_of
from tests.llm.conftest import LONG, NASTY, PROSE


def _lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def test_word_hashes_name_words_one_to_one_and_keep_rows_apart():
    texts = [t for _, t, _ in NASTY] + ["Ab cd", "abcd", "ab  CD\n", "é É"]
    seen, rows = {}, 0
    for lo, hi, w in words_of(pa.array(texts), max_bytes=300):
        rows += hi - lo
        for r in range(hi - lo):
            want = re.findall(r"[^\x20\x09-\x0D]+", _lower(texts[lo + r] or ""))
            got = w.hash[w.first[r]: w.first[r + 1]].tolist()
            assert len(want) == len(got)
            for a, b in zip(want, got):
                assert seen.setdefault(b, a) == a
    assert rows == len(texts) and len(set(seen.values())) == len(seen)


def test_chunks_and_slices_do_not_change_hashes():
    arr = pa.array([PROSE, None, "", LONG[:5000], PROSE])
    whole = np.concatenate([w.hash for _, _, w in words_of(arr)])
    parts = np.concatenate([w.hash for _, _, w in words_of(arr, max_bytes=10)])
    tail = np.concatenate([w.hash for _, _, w in words_of(arr.slice(3))])
    assert (whole == parts).all() and (whole[-len(tail):] == tail).all()
    assert hash_of(["fox"])[0] in whole


def test_ngrams_stay_inside_rows():
    (_, _, w), = words_of(pa.array(["a b c", "a", "a b"]))
    h, row = w.ngrams(2)
    assert row.tolist() == [0, 0, 2] and h[0] == h[2]
    assert len(w.ngrams(4)[0]) == 0


def test_join_spread_keeps_every_row_and_shuffles_no_heavy_key(spark):
    n = 4 * HEAVY_PARTS
    # a third of the rows share one key, a third have none, the others are nearly alone; one key has no name
    rows = spark.range(3 * n).selectExpr("id", "case when id % 3 = 0 then 'hot' when id % 3 = 1 then concat('k', id) end as k")
    named = settle(rows.where("k is not null and k <> 'k1'").groupBy("k").count().selectExpr(
        "k", "upper(k) as name", "count as copies"), "named")
    out = join_spread(rows, named, "k", "copies")
    assert out.columns == ["k", "id", "name"] and out.count() == 3 * n
    assert out.where("k <> 'k1' and not (name <=> upper(k))").count() == 0
    assert out.where("k is null or k = 'k1'").where("name is not null").count() == 0
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = join_spread(rows, named, "k", "copies")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("BroadcastHashJoin") == 2 and plan.count("SortMergeJoin") == 1
    assert join_spread(rows.limit(0), settle(named.limit(0), "none"), "k", "copies").count() == 0
