import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from assay.llm import packing
from tests.conftest import SF_SMALL


def _brute(lengths, cap):
    """The rule, recomputing the sum of squares for every choice."""
    fill = []
    for s in lengths:
        fits = [b for b in range(len(fill)) if fill[b] + s <= cap]
        if not fits:
            fill.append(s)
            continue

        def after(b):
            n = np.bincount([f + (s if i == b else 0) for i, f in enumerate(fill)], minlength=cap + 1)
            return (n[1:cap] ** 2).sum(), fill[b]
        fill[min(fits, key=after)] += s
    return sorted(fill)


def test_rule_equals_brute_force():
    rng = np.random.default_rng(0)
    for cap in (10, 23, 64):
        for _ in range(20):
            x = rng.integers(1, cap + 1, 60)
            bins, offsets = packing.sum_of_squares(x, cap)
            assert sorted(np.bincount(bins, x).astype(int).tolist()) == _brute(x.tolist(), cap)


def _valid(out, cap):
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= cap


def test_query_ids_places_and_sequences(spark):
    out = entry.queries()["op2_pack"](spark, SF_SMALL).toPandas()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").toPandas()
    for k, text in zip(docs["doc_id"], docs["text"]):
        ids = np.array(tok.encode(text, add_special_tokens=False).ids + [0], "<u4")
        g = out[out["doc_id"] == k].sort_values("piece")
        assert g["piece"].tolist() == list(range(len(g))) and g["length"].sum() == len(ids)
        assert all(n == 2048 for n in g["length"][1:]) and g["start"].tolist() == [0, *g["length"].cumsum()[:-1]]
        for r in g.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start: r.start + r.length].tobytes())
    _valid(out, 2048)
    assert out["sequence_id"].nunique() <= 1.01 * -(-out["length"].sum() // 2048) + 1


def test_many_shards_lose_few_sequences(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"key": np.arange(4000), "piece": np.int32(0), "start": 0, "length": rng.integers(1, 101, 4000),
                        "ids_crc32": 0})
    pieces = spark.createDataFrame(pdf, packing.PIECES)
    # shards of 1000 pieces, a fiftieth of the production size, may lose one sequence in a hundred
    out = packing.pack_pieces(pieces, 100, per_shard=1000).toPandas()
    assert sorted(out["key"]) == list(range(4000))
    _valid(out, 100)
    whole = packing.pack_pieces(pieces, 100, per_shard=5000).toPandas()
    _valid(whole, 100)
    assert out["sequence_id"].nunique() <= 1.01 * whole["sequence_id"].nunique() <= 1.03 * pdf["length"].sum() / 100


def test_edges_and_round_trip(spark, nasty, empty):
    out = packing.pack_documents(nasty, capacity=512, per_shard=10).toPandas()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = nasty.select("doc_id", "text").toPandas()
    assert out["length"].sum() == sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for t in rows["text"])
    _valid(out, 512)
    assert packing.pack_documents(empty).count() == 0
    some = nasty.where("doc_id in (1, 3, 4, 6, 9)")
    packed = packing.pack_documents(some, capacity=512)
    seqs = {r.sequence_id: r.ids for r in packing.assemble(some, packed, capacity=512).collect()}
    assert all(1 <= len(x) <= 512 for x in seqs.values())
    for k, t in [(1, rows.loc[0, "text"]), (3, "")]:
        ids = tok.encode(t, add_special_tokens=False).ids + [0]
        p = packed.where(f"doc_id = {k}").first()
        assert seqs[p.sequence_id][p.offset: p.offset + p.length] == ids


def test_unknown_tokenizer_fails(nasty):
    with pytest.raises(Exception):
        packing.pack_documents(nasty, "absent.json").count()


def test_null_and_repeated_keys_spread_over_shards(spark, monkeypatch):
    rows = [(None if i % 2 else 7, 0, 0, 1 + i % 60, i % 3) for i in range(3000)]
    pieces = spark.createDataFrame(rows, packing.PIECES).repartition(4)
    sizes = []
    settle = packing.settle
    monkeypatch.setattr(packing, "settle", lambda df, name: (lambda t: sizes.append(
        [r["count"] for r in t.groupBy("shard").count().collect()]) or t if name == "packed" else t)(settle(df, name)))
    out = packing.pack_pieces(pieces, 100, per_shard=300)
    assert out.count() == 3000
    assert len(sizes[0]) == 10 and max(sizes[0]) < 450
