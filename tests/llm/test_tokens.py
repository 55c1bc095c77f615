import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

import __spark_entry__ as entry
from assay.llm import bpe, tokens
from assay.llm.common import scratch
from tests.conftest import SF_SMALL
from tests.llm.conftest import LONG, NASTY, PROSE


def _want(rows, count):
    return sorted(((k, len((t or "").encode()), count(t or ""), count(t or "") > 512) for k, t, *_ in rows), key=repr)


def _got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in df.collect()), key=repr)


def test_rank_engine_gives_the_files_ids():
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, tok = bpe.Encoder(path), Tokenizer.from_file(path)
    assert enc.fast is not None
    for t in [PROSE, LONG[:20_000], "", "<|endoftext|>a<|endoftext|> b", " \n\t  x\r\n", "é🙂\u0000​'ll 12three", "don't!!! "]:
        assert enc.ids(t).tolist() == tok.encode(t, add_special_tokens=False).ids


def test_query_counts_equal_the_library(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = entry.queries()["op5_token_counts"](spark, SF_SMALL)
    assert _got(got) == _want(rows, lambda t: len(tok.encode(t, add_special_tokens=False).ids))


def test_other_tokenizers(spark, nasty):
    lower = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = tokens.token_counts(nasty, tokenizer="word_bpe_49k.json")
    assert _got(got) == _want(NASTY, lambda t: len(lower.encode(t, add_special_tokens=False).ids))
    got = tokens.token_counts(nasty, tokenizer="piece_bpe_32k.model")
    assert _got(got) == _want(NASTY, lambda t: len(pieces.encode(t)))


def test_only_distinct_misses_are_encoded_and_versions_kept_apart(spark, nasty, empty):
    cache = scratch(spark, "test-cache")
    first = _got(tokens.count_tokens(nasty, cache))
    texts = {t or "" for _, t, *_ in NASTY}
    assert spark.read.parquet(cache).count() == len(texts)
    # a stored count is used as it is: nothing is encoded again
    assert _got(tokens.count_tokens(nasty, cache)) == first
    assert spark.read.parquet(cache).count() == len(texts)
    tokens.count_tokens(nasty.limit(1), cache, tokenizer="word_bpe_49k.json")
    assert spark.read.parquet(cache).count() == len(texts) + 1
    assert tokens.count_tokens(empty, cache).count() == 0
    # the same digests twice, as two runs at a time may leave them
    spark.read.parquet(cache).write.mode("append").parquet(cache + "-twice")
    spark.read.parquet(cache).write.mode("append").parquet(cache + "-twice")
    assert _got(tokens.count_tokens(nasty, cache + "-twice")) == first
