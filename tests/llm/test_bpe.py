"""Operator 12 against the tokenizers library, and its merges against a plain search for the best pair."""

import hashlib
import random

import numpy as np
import pandas as pd
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.test_operators import DOCS, SMALL, docs_of, odd_docs
from trailspark.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " \n\t", "a\x1cb", "<|endoftext|> x<|startoftext|>y <|endoftext", "x y\u0085z w", "É́ İI ΑΣ. Σ ﬁ", "x" * 300 + " y", "it's. It's, 'tis. can't've", "Ünï. — a—. b2. 1234567 ..",
    "THE the The. the,", "日本語 のテキスト 🙂🙂", "a" * 5001, "ab" * 2000 + "!" * 777, "é e ́x", "ẞ İ̇",
]


def merged_by_force(ids, ranks):
    ids = list(ids)
    while pairs := [(ranks[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks]:
        _, i = min(pairs)
        ids[i : i + 2] = [ranks[ids[i], ids[i + 1]][1]]
    return ids


def test_the_tree_merges_as_a_search_for_the_best_pair_does():
    rng = random.Random(12)
    for _ in range(100):
        n = rng.randrange(2, 6)
        ranks, new = {}, n
        for rank in range(rng.randrange(1, 12)):
            ranks.setdefault((rng.randrange(new), rng.randrange(new)), (rank, new))
            new += 1
        words = [[rng.randrange(n) for _ in range(rng.choice([1, 1, 2, 3, 4, 5, 7, 8, 9, 17, 40, 64, 65, 66, 200]))] for _ in range(20)]
        want = [merged_by_force(ids, ranks) for ids in words]
        assert [bpe.merge(ids, ranks) for ids in words] == want
        got, count = bpe.Merger(ranks).merge(np.array(sum(words, [])), np.cumsum([len(w) for w in words]))
        assert (got.tolist(), count.tolist()) == (sum(want, []), [len(w) for w in want])


def test_ids_and_texts_equal_the_library(spark):
    tokenizer = Tokenizer.from_file(PATH)
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    texts = [*TEXTS, *docs["text"]]
    got = bpe.decode(bpe.encode(docs_of(spark, texts), PATH), PATH).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["ids"], r["decoded"]) == (ids, tokenizer.decode(ids, skip_special_tokens=False))


def test_long_texts_are_cut_where_no_word_is(monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 50)
    rng = random.Random(5)
    texts = ["".join(rng.choice(["word ", "Don't ", "é", "\n", "<|endoftext|>", "x" * 60, " ", " ", "1, 2"]) for _ in range(80)) for _ in range(40)]
    tokenizer = Tokenizer.from_file(PATH)
    got = bpe.TreeEncoder(PATH, 100).encode(texts)
    for text, ids in zip(texts, got):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert [int.from_bytes(ids[k : k + 4], "little") for k in range(0, len(ids), 4)] == want


def test_digests_of_the_query(spark):
    tokenizer = Tokenizer.from_file(PATH)
    docs = pd.read_parquet(f"{SMALL}/documents.parquet").set_index("doc_id")["text"]
    got = queries.op12_tree_bpe(spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs.index)
    for r in got:
        ids = tokenizer.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_odd_rows_and_ids(spark):
    assert bpe.encode(odd_docs(spark), PATH).count() == 10
    assert bpe.decode(bpe.encode(odd_docs(spark).limit(0), PATH), PATH).columns == ["doc_id", "ids", "decoded"]
    ids = spark.createDataFrame([(1, None), (2, []), (3, [-1, 320, 99_999_999, 49407])], "k int, ids array<int>")
    assert [(r["k"], r["decoded"]) for r in bpe.decode(ids, PATH).orderBy("k").collect()] == [(1, ""), (2, ""), (3, "a</w> <|endoftext|>")]
    assert DOCS.startswith("doc_id")
