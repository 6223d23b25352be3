import random

import pytest
from pyspark.sql import functions as F

from massloom.llm import tokens

TEXTS = [
    None, "", "   ", "\t\n", "Hello world", "<|endoftext|> is plain text", "naïve café 12345 mz=180.0634", "日本語のテキスト。", "a" * 4000, " " * 700 + "x", "x\r\n\r\ny", "emoji 🧪🧪 and ß", "don't I'll we've", "\u0000 odd \u200b\u00a0 spaces",
]


def reference(text):
    tiktoken = pytest.importorskip("tiktoken")
    e = tiktoken.Encoding("own", pat_str=tokens.pattern(), mergeable_ranks=tokens.load_ranks(tokens.vocabulary_path()), special_tokens={})
    return e.encode_ordinary(text)


def test_equals_the_public_tokenizer(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode_texts(df).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == (reference(t) if t else []), t


def test_random_words_and_a_small_trie():
    ranks = tokens.load_ranks(tokens.vocabulary_path())
    rng = random.Random(5)
    enc = tokens.TrieEncoder(ranks, most_nodes=50)
    for _ in range(40):
        words = {"".join(rng.choice("abcdeéß漢 123") for _ in range(rng.randrange(1, 40))).encode() for _ in range(10)}
        for w, ids in enc.encode_words(list(words)).items():
            assert ids == [ranks[t] for t in enc.merged(w)]


def test_counts_and_empty_table(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "two words")], "doc_id long, text string")
    assert [r["tokens"] for r in tokens.count_tokens(df).orderBy("doc_id").collect()] == [0, 0, 2]
    assert tokens.encode_texts(df.limit(0)).count() == 0
    assert tokens.encode_texts(df.filter(F.lit(False))).columns == ["doc_id", "text", "ids"]
