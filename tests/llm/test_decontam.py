import random
import re

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from assay.llm import decontam
from tests.conftest import SF_CHECK
from tests.llm.conftest import frame


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs_equals_dynamic_programming():
    rng = random.Random(0)
    for _ in range(200):
        a = [rng.randrange(8) for _ in range(rng.randrange(1, 70))]
        b = [rng.randrange(-1, 8) for _ in range(rng.randrange(0, 90))]
        assert decontam.lcs_length(a, np.array(b)) == _lcs(a, b)


def test_windows_cover_every_word():
    first = np.cumsum([0, 0, 1, 23, 24, 25, 36, 37, 100])
    row, start, end = decontam.windows(first)
    for r, n in enumerate(np.diff(first)):
        own = [(a, b) for i, a, b in zip(row, start, end) if i == r]
        assert sorted({w for a, b in own for w in range(a, b)}) == list(range(first[r], first[r + 1]))
        assert all(b - a == min(n, decontam.WINDOW) or b == first[r + 1] for a, b in own)


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())


def test_query_finds_the_leaks_that_word_runs_show(spark):
    items = {r.item_id: _words(r.text) for r in spark.read.parquet(f"{SF_CHECK}/benchmark.parquet").collect()}
    runs = {}
    for i, w in items.items():
        for k in range(len(w) - 7):
            runs.setdefault(tuple(w[k: k + 8]), set()).add((i, k))
    held = {}
    for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").collect():
        w = _words(r.text)
        for k in range(len(w) - 7):
            for i, p in runs.get(tuple(w[k: k + 8]), ()):
                held.setdefault((r.doc_id, i), set()).update(range(p, p + 8))
    want = {p for p, c in held.items() if len(c) >= 0.6 * len(items[p[1]])}
    got = {(r.doc_id, r.item_id) for r in entry.queries()["op9_decontam"](spark, SF_CHECK).collect()}
    assert len(want) > 20 and got == want


def _corpus(rng):
    vocabulary = [f"w{i}" for i in range(4000)] + ["the", "of", "and", "is"] * 300

    def prose(n):
        return [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(prose(rng.randrange(15, 60))) + ". " + " ".join(prose(6)) + ".") for i in range(30)]
    return prose, items


def test_verbatim_partial_and_paraphrased_leaks(spark):
    rng = random.Random(4)
    prose, items = _corpus(rng)
    rows, want = [], set()
    for k in range(300):
        words = prose(rng.randrange(40, 400))
        at = rng.randrange(len(words))
        if k < 60:  # whole items
            own = items[k % 30][1].split()
            want.add((k, k % 30))
        elif k < 120:  # one word in five replaced, the answer kept
            own = items[k % 30][1].split()
            own = [f"q{rng.randrange(999)}" if i % 5 == 2 and i < len(own) - 6 else w for i, w in enumerate(own)]
            want.add((k, k % 30))
        else:
            own = []
        rows.append((k, " ".join(words[:at] + own + words[at:]), "en"))
    docs, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench).collect()}
    assert len(want - got) <= 2 and not got - want
    blocks = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench, block_items=7).collect()}
    assert len(want - blocks) <= 2 and not blocks - want


def test_paraphrase_without_the_answer_is_no_leak(spark):
    rng = random.Random(6)
    prose, items = _corpus(rng)
    question = items[0][1].split()
    other = [f"q{i}" if i % 3 == 1 else w for i, w in enumerate(question[:-6])] + [f"r{i}" for i in range(6)]
    rows = [(0, " ".join(prose(50) + other + prose(50)), "en")] + [(k, " ".join(prose(100)), "en") for k in range(1, 50)]
    bench = spark.createDataFrame(items[:1], "item_id long, text string")
    assert decontam.find_leaks(frame(spark, rows), bench).count() == 0


def test_edges(spark, nasty, empty):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "the quick brown fox jumps over the lazy dog"), (3, " \n"),
                                   (None, "a text without a key"), (4, "the quick brown fox jumps over the lazy dog")],
                                  "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(nasty, bench).collect()}
    assert {(1, 3), (2, 3), (12, 3), (1, 4), (None, None)} <= got and not {k for k, _ in got} & {3, 4, 5, 6, 7}
    assert decontam.find_leaks(empty, bench).count() == 0
    for none in (bench.limit(0), bench.where("item_id < 3")):
        out = decontam.find_leaks(nasty, none)
        assert out.count() == 0 and out.columns == ["doc_id", "item_id", "cosine", "lcs", "answer", "first_word", "last_word"]
    far = spark.createDataFrame([(1, "nothing shared hereabouts")], "item_id long, text string")
    assert decontam.find_leaks(nasty, far).count() == 0
    twice = nasty.unionByName(nasty)
    assert decontam.find_leaks(twice, bench).where(F.col("doc_id") == 1).count() == 2 * decontam.find_leaks(
        nasty, bench).where(F.col("doc_id") == 1).count()


def test_sums_over_passages_and_words_equal_plain_loops():
    rng = np.random.default_rng(0)
    size = rng.integers(0, 9, 200)
    code = np.minimum(rng.geometric(0.15, size.sum()), 30) - 1
    vectors = rng.normal(size=(30, 4)).astype(np.float32)
    passage = np.repeat(np.arange(200), size)
    y = decontam._sum_words(vectors, code, size)
    want = np.zeros((200, 4))
    np.add.at(want, passage, vectors[code])
    assert np.allclose(y, want, atol=1e-5)
    total, want = np.zeros((30, 4)), np.zeros((30, 4))
    decontam._add_passages(total, y, code, passage)
    np.add.at(want, code, y[passage])
    assert np.allclose(total, want, atol=1e-4)


def test_copies_of_an_item_alone_or_nearly_alone_are_found(spark):
    item = "which river flows through the old town and past the mill. it is the white river."
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    copies = [(k, item, "en") for k in range(3)]
    assert {r.doc_id for r in decontam.find_leaks(frame(spark, copies), bench).collect()} == {0, 1, 2}
    other = [(9, "a text of quite another kind about the weather in the mountains", "en")]
    assert {r.doc_id for r in decontam.find_leaks(frame(spark, copies + other), bench).collect()} == {0, 1, 2}
    # a slice whose documents all hold the words of the items, in another order
    words = item.replace(".", "").split()
    mixed = [(20 + k, " ".join(random.Random(k).sample(words, len(words))), "en") for k in range(30)]
    got = {r.doc_id for r in decontam.find_leaks(frame(spark, copies + mixed), bench).collect()}
    assert {0, 1, 2} <= got and len(got) <= 5


def test_sketches_of_many_tasks_are_added_in_levels(spark):
    tasks, slabs = 5000, 2
    rng = np.random.default_rng(1)
    x = rng.integers(0, 9, (tasks, slabs, 3)).astype(np.float32)
    partial = spark.createDataFrame([(s, t, bytearray(x[t, s].tobytes())) for t in range(tasks) for s in range(slabs)],
                                    "slab int, part long, sums binary")
    added = decontam.add_sketches(partial, tasks)
    assert {r.slab: np.frombuffer(r.sums, np.float32).tolist() for r in added.collect()} == {
        s: x[:, s].sum(0).tolist() for s in range(slabs)}
    plan = added._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 3  # 5000 -> 79 -> 2 -> 1, at most 64 sketches a task


def test_short_items_in_ordinary_documents(spark):
    """Verbatim items and paraphrases (one word in four replaced, the answer kept) of 6 to 14 words, against the LCS."""
    rng = random.Random(12)
    vocabulary = sorted({w for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").where("lang = 'en'").limit(300).collect()
                         for w in _words(r.text) if w.isalpha()})
    docs = [r.text for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").where(
        "lang = 'en' and length(text) > 300").orderBy("doc_id").limit(240).collect()]
    items, rows, verbatim, loose = [], [], set(), set()
    for k, text in enumerate(docs):
        n = (6, 8, 10, 12, 14)[k % 5]
        question, answer = rng.sample(vocabulary, n - 2), rng.sample(vocabulary, 2)
        items.append((k, " ".join(question) + ". " + " ".join(answer) + "."))
        own = items[-1][1].split()
        if k % 2:
            own = [f"q{rng.randrange(999)}" if i % 4 == 1 and i < n - 2 else w for i, w in enumerate(own)]
            loose.add((k, k))
        else:
            verbatim.add((k, k))
        words = text.split()
        at = rng.randrange(len(words))
        rows.append((k, " ".join(words[:at] + own + words[at:]), "en"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(frame(spark, rows), bench).collect()}
    assert len(verbatim & got) >= 0.95 * len(verbatim)
    assert len(loose & got) >= 0.9 * len(loose)
    # whatever else is found holds the item's words in order, as the brute-force LCS says
    for d, i in got - verbatim - loose:
        own = _words(items[i][1])
        assert _lcs(own, _words(rows[d][1])) >= 0.55 * len(own)
