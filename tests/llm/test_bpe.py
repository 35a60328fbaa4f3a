import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mnemosia.llm import bpe


@pytest.fixture(scope="module")
def path():
    return public_tokenizers.path(bpe.TOKENIZER)


@pytest.fixture(scope="module")
def codec(path):
    return bpe.Codec(open(path, encoding="utf-8").read())


def plain(path, text):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    ids = t.encode(text or "", add_special_tokens=False).ids
    return len(ids), " ".join(map(str, ids)), t.decode(ids, skip_special_tokens=False)


ODD = [
    None, "", " ", "it's  We'LL don't!!'s", "é İSTANBUL ΣΣ", "a<|endoftext|>b <|startoftext|>", "x\x1cy\x1f z",
    "中文　文字 123 4½", "\U0001f600\U0001f600 ***&&&", " a b\x85c", "e ́x",
]


def test_equals_the_library(spark, path):
    rng = random.Random(1)
    long = ["".join(rng.choices("abcdehnorst", k=5000)), "ab " * 3000, "".join(rng.choices("aeé中½'!", k=4000)), "x" * 3000 + "<|endoftext|>" + "y" * 3000, "aaaa" * 900 + " tail"]
    texts = ODD + long + [long[0], "same", "same"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in bpe.encode(docs, leaf=128).collect())
    assert got == sorted((i, *plain(path, t)) for i, t in enumerate(texts))


def test_tree_joins_are_exact(codec):
    rng = random.Random(2)
    for k in range(60):
        word = "".join(rng.choices(["abc", "tion", "th", "e", "aa", "zq", "ing", "xyxy"][: 2 + k % 7], k=rng.randrange(1, 120)))
        cut = bpe.halves(word, 1 + k % 9)
        parts = [codec.leaf(p, i + 1 == len(cut)) for i, p in enumerate(cut)]
        assert codec.tree(parts) == [t.id for t in codec.whole.tokenize(word)], word


def test_empty_table_and_other_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, ids string, n_tokens int")
    assert bpe.encode(docs).collect() == []
    docs = spark.createDataFrame([(None, "a b", "q", 1), (None, "a b", "q", 1)], docs.schema)
    assert [r.n_tokens for r in bpe.encode(docs).collect()] == [2, 2]


def test_halves_anywhere(spark, path, codec):
    """Trees within a task and dealt ones, cut in words, special tokens and combined characters."""
    rng = random.Random(3)
    bits = ["the ", "It's ", "náve", "<|endoftext|>", " ", "\n", "中文 ", "ing", "123", "don't", "é", "́", "\x1c", "…", "　", "xy" * 20]
    texts = ["".join(rng.choices(bits, k=rng.randrange(1, 900))) for _ in range(60)] + [" " * 700, "a " * 600, ("word " * 30 + "z" * 90) * 9, None, ""]
    texts += texts[:2]
    for t in texts:
        if t:
            for leaf in (1, 3, 17):
                found = bpe.halved(codec, t, leaf)
                assert " ".join(found.ids).split() == plain(path, t)[1].split()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for leaf, dealt in ((100, 300), (40, 100)):
        got = sorted(tuple(r) for r in bpe.encode(docs, leaf=leaf, dealt=dealt).collect())
        assert got == sorted((i, *plain(path, t)) for i, t in enumerate(texts))
