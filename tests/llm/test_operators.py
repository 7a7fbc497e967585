"""The ten operators against brute force, exact round trips or held-out documents, and on odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trailspark.llm import bitsliced, decontaminate, jaccard, langid, linededup, lm, packing, queries, rangecoder, toxicity, urlfilter
from trailspark.llm.common import table
from trailspark.llm.tokens import CachedEncoder

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, label string, _text string, h int"


def docs_of(spark, texts, lang="en"):
    """Rows with ids from 0; the further columns clash with names that operators use inside."""
    return spark.createDataFrame([(i, t, lang, None, None, "x", "y", i) for i, t in enumerate(texts)], DOCS)


def odd_docs(spark):
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "short one"), (5, long), (5, long), (None, "no id"), (None, None), (6, "...!!!"), (7, "A\nb\nA\nb\n")]
    return spark.createDataFrame([(i, t, None, None, None, None, None, None) for i, t in rows], DOCS)


# 1 exact top-k


def best_by_force(rows, asked, k):
    known = {i: [math.floor(256 * x) for x in v] for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in known:
        if asked(q):
            score = {i: sum(a * b for a, b in zip(known[q], v)) for i, v in known.items() if i != q}
            out += [(q, r + 1, i, score[i]) for r, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:k])]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-0.5, 0.25, 1.0, rng.gauss(0, 1)]) for _ in range(8)]) for i in range(400)]
    rows += [(400, rows[7][1]), (401, rows[7][1]), (402, None), (403, []), (404, [float("nan")] * 8), (405, [None] + [1.0] * 7), (406, [float("inf")] * 8), (410, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = bitsliced.top_k(df, F.col("vec_id") % 10 == 0, k=5, block_rows=100, block_queries=16)
    assert sorted(map(tuple, got.collect())) == best_by_force(rows, lambda q: q % 10 == 0, 5)


def test_top_k_keeps_repeated_rows_and_refuses_overflow(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.9, 0.9]), (1, [0.9, 0.9]), (2, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [tuple(r) for r in bitsliced.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1, 58880), (0, 2, 1, 58880), (0, 3, 1, 32768), (0, 4, 2, 0)]
    assert bitsliced.top_k(df, F.col("vec_id") == 1).count() == 4  # two distinct vectors, two candidates each
    with pytest.raises(Exception, match="too large"):
        bitsliced.top_k(df.unionByName(spark.createDataFrame([(3, [1e30, 0.0])], df.schema)), F.col("vec_id") == 0).collect()


def test_top_k_of_nothing(spark):
    assert bitsliced.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") == 0).count() == 0


# 2 toxicity


def test_toxicity_of_held_out_documents(spark):
    got = queries.op2_toxicity(spark, MORE).toPandas().merge(pd.read_parquet(f"{MORE}/labels.parquet"), on="doc_id")
    got = got[got["held_out"] & got["toxic"].notna()]
    toxic, said = got["toxic"] == 1, got["predicted"] == 1
    assert said[toxic].mean() >= 0.5 and said[~toxic].mean() <= 0.03  # neither holds for a constant answer


def test_toxicity_without_labels_and_of_odd_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(odd_docs(spark), labels)
    got = toxicity.score(odd_docs(spark), model).collect()
    assert len(got) == 10 and len({r["score"] for r in got}) == 1
    assert toxicity.score(odd_docs(spark).limit(0), model).count() == 0


def test_copies_of_a_voter_weigh_as_one():
    one = toxicity.label_model(np.array([0.5]), np.array([0.01]), np.eye(1), 0.1)
    three = toxicity.label_model(np.full(3, 0.5), np.full(3, 0.01), np.ones((3, 3)), 0.1)
    assert three.weight.sum() == pytest.approx(one.weight.sum())


# 3 benchmark decontamination


def test_decontamination_finds_copies_and_paraphrases_only(spark):
    rng = random.Random(3)
    noise = lambda n: " ".join(rng.choice("abcdefghij") + rng.choice("klmnopqrst") + str(rng.randrange(400)) for _ in range(n))
    item = "the quick engineer measured seventeen copper pipes before lunch and reported that the total length was ninety four metres exactly"
    near = item.replace("quick", "tired").replace("before lunch", "at noon")
    texts = [noise(200), f"{noise(90)} {item} {noise(90)}", f"{noise(40)} {near} {noise(300)}", item.upper(), None, "", noise(5000) + " the total length was"]
    bench = spark.createDataFrame([(1, item, "z"), (2, None, "z"), (2, "", "z"), (None, item, "z"), (3, "?!", "z")], "item_id long, text string, matches string")
    got = {r["doc_id"]: [m["item_id"] for m in r["matches"]] for r in decontaminate.find(docs_of(spark, texts), bench).collect()}
    assert got == {0: [], 1: [1, None], 2: [1, None], 3: [1, None], 4: [], 5: [], 6: []}
    again = decontaminate.find(docs_of(spark, texts), bench, block=1)
    assert {r["doc_id"]: sorted((m["item_id"] for m in r["matches"]), key=lambda i: i or 9) for r in again.collect()} == got


def test_retrieval_misses_few_paraphrases(spark):
    """Recall of the candidate search against the same check on every window, on planted copies and paraphrases."""
    rng = random.Random(33)
    items = [r["text"] for r in table(spark, MORE, "benchmark").collect()]
    texts = [r["text"] for r in table(spark, MORE, "documents").where("n_chars < 8000").limit(300).collect()]
    pool = [w for t in texts[:50] for w in t.split()]
    planted = []
    for j, item in enumerate(items):
        for rate in (0, 0.15, 0.3, 0.4):
            words, at = rng.choice(texts).split(), rng.randrange(40)
            planted.append((j, " ".join([*words[:at], *(w if rng.random() >= rate else rng.choice(pool) for w in item.split()), *words[at:]])))
    ix, rules = decontaminate.index(table(spark, MORE, "documents"), [t.encode() for t in items]), decontaminate.Rules()
    words = decontaminate.Vocabulary(ix.codes)
    rows = [words.ids(c) for c in decontaminate.terms([t.encode() for _, t in planted])]
    for x, near in zip(rows, decontaminate.all_candidates(rows, ix, rules, 3000)):
        alone = decontaminate.candidates(x, ix, rules)
        assert all({w[1:] for w in some} <= {w[1:] for w in near[item]} for item, some in alone.items())
    true = found = 0
    for (j, _), code in zip(planted, decontaminate.terms([t.encode() for _, t in planted])):
        ids = words.ids(code)
        every = {j: [(0.0, a, min(len(ids), a + 64)) for a in range(0, len(ids), 16)]}
        if any(m[0] == j for m in decontaminate.matches(ids, ix, rules, every)):
            true += 1
            found += any(m[0] == j for m in decontaminate.matches(ids, ix, rules, decontaminate.candidates(ids, ix, rules)))
    assert true > 100 and found >= 0.95 * true


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find(odd_docs(spark), none).where("size(matches) > 0").count() == 0
    some = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    assert decontaminate.find(odd_docs(spark).limit(0), some).count() == 0
    assert decontaminate.find(odd_docs(spark), some).count() == 10


def test_common_subsequence():
    assert decontaminate.common_subsequence([1, 2, 3, 4], [9, 1, 3, 9, 4, 9])[0] == 3


# 4 URL filter


def test_globs_equal_a_regex_for_each():
    rng = random.Random(4)
    globs = ["*", "", "a*b", "*ab?c*", "\\**", "?", "*" + "abc" * 30 + "*", "a?*?b", "*ba"]
    texts = ["".join(rng.choice("abc*") for _ in range(rng.randrange(12))).encode() for _ in range(500)] + [b"", b"x" + b"abc" * 40]
    hit = urlfilter.Automaton(globs).match(texts)
    for g, column in zip(globs, hit.T):
        parts = re.findall(r"\\.|.", g)
        regex = re.compile("".join(".*" if p == "*" else "." if p == "?" else re.escape(p[-1]) for p in parts).encode(), re.S)
        assert column.tolist() == [bool(regex.fullmatch(t)) for t in texts], g


def test_url_verdicts(spark):
    urls = ["http://a.ORG/x", "https://example.org/es/1?q", "https://sub.example.org/en/12", "http://x.com/fr/", "http://x.com/de/#a", "http://x.com", None, "nothing", "http://", "ftp://notorg/x", "http://x.com/shop/free-casino", "http://win-casino.net/a"]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(pages, queries.URL_RULES, queries.BLOCK_GLOBS).collect()}
    assert got[0] == ("a.org", "/x", "org/", "allow")
    assert got[1][2:] == ("example.org/es/", "block") and got[2][2:] == ("example.org/en/1", "block")
    assert got[3][2:] == ("com/fr/", "allow") and got[4] == ("x.com", "/de/", "com/de/", "block")
    assert got[5] == ("x.com", "", None, "allow") and got[6] == got[7] == got[8] == ("", "", None, "allow")
    assert got[9][2] is None and got[11][3] == "block"
    assert urlfilter.judge(pages.limit(0), queries.URL_RULES, queries.BLOCK_GLOBS).count() == 0


# 5 language ID


def test_language_of_held_out_documents(spark):
    got = queries.op5_language_id(spark, MORE).toPandas().merge(pd.read_parquet(f"{MORE}/documents.parquet"), on="doc_id")
    got = got[got["held_out"] & got["lang"].notna() & (got["lang_pred"] != "und")]
    assert (got["lang"] == got["lang_pred"]).mean() >= 0.95


def test_language_of_odd_rows(spark):
    model = langid.fit(docs_of(spark, ["the cat and the dog"] * 3).unionByName(docs_of(spark, ["le chat et le chien"] * 3, "fr")))
    got = {r["text"]: r for r in langid.predict(odd_docs(spark), model).collect()}
    assert got[None]["lang_pred"] == got[""]["lang_pred"] == got["...!!!"]["lang_pred"] == "und"
    assert got["short one"]["lang_pred"] in ("en", "fr")
    assert langid.fit(odd_docs(spark)) is None
    assert {r["lang_pred"] for r in langid.predict(odd_docs(spark), None).collect()} == {"und"}


def test_language_model_counts_every_distinct_text_once(spark):
    texts = [f"word{i} some more of it" for i in range(1700)]  # more than a sample of 1,500 would hold
    once = langid.fit(docs_of(spark, texts), 100_000, 1)
    train = pd.concat([f for f in langid._counted(iter([pd.DataFrame({"lang": "en", "text": texts})]))])
    want = langid.frozen(train, 100_000, 1)
    again = langid.fit(docs_of(spark, texts + texts[:40] * 3), 100_000, 1)
    for got in (once, again):
        assert np.array_equal(got.row, want.row) and np.array_equal(got.bits, want.bits)


def test_code_lengths_equal_the_recursion():
    """Escape probabilities, written out for one language without pruning."""
    train = [b"abracadabra abracadabra", b"abba"]
    rows = [f for f in langid._counted(iter([pd.DataFrame({"lang": "x", "text": [t.decode() for t in train]})]))]
    model = langid.frozen(pd.concat(rows), 10_000, 1)
    seen = [Counter() for _ in range(langid.ORDER + 1)]
    for t in train:
        t = b"\n" * langid.ORDER + t
        for i in range(langid.ORDER, len(t)):
            for k in range(langid.ORDER + 1):
                seen[k][t[i - k : i], t[i]] += 1

    def p(context, c, k):
        if k < 0:
            return 1 / 256
        some = {x: n for (ctx, x), n in seen[k].items() if ctx == context[langid.ORDER - k :]}
        below = p(context, c, k - 1)
        return (some.get(c, 0) + len(some) * below) / (sum(some.values()) + len(some)) if some else below

    text = b"cadabra bab!"
    padded = b"\n" * langid.ORDER + text
    want = sum(-math.log2(p(padded[i - langid.ORDER : i], padded[i], langid.ORDER)) for i in range(langid.ORDER, len(padded)))
    assert langid.code_lengths(model, [text])[0, 0] == pytest.approx(want, rel=1e-5)


# 6 language-model scores


def test_marginal_sums_all_segmentations():
    logs = {" ": -1.0, "a": -1.2, "b": -0.9, "ab": -0.7, " a": -0.8, "ba": -1.5, " ab": -2.0}

    def force(text):
        return 1.0 if not text else sum(10**v * force(text[len(p) :]) for p, v in logs.items() if text.startswith(p))

    for word in ("a", "ab", "abba", "babab"):
        assert lm.Lattice(logs).marginal(word.encode()) == pytest.approx(math.log10(force(" " + word)))


def test_base_scores_equal_the_formula(spark):
    texts = ["A b b c", "b c d\x0bd", None, "", "z z z rare", "a " * 3000]
    df = docs_of(spark, texts).withColumn("train", F.col("doc_id") < 4)
    for head in (300_000, 2):
        got = {r["doc_id"]: r for r in lm.score(df, "train", public_tokenizers.path("piece_bpe_32k.model"), head=head).collect()}
        words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + [None] for t in texts]
        count = Counter(w for ws in words[:4] for w in ws)
        n, v = sum(count.values()), len(count)
        for i, ws in enumerate(words):
            assert got[i]["n_tokens"] == len(ws) and got[i]["n_known"] == sum(count[w] > 0 for w in ws) and got[i]["train_tokens"] == n
            assert got[i]["base_score"] == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
            assert -math.inf < got[i]["score"] < 0
    assert lm.score(df.limit(0), "train", public_tokenizers.path("piece_bpe_32k.model")).count() == 0


# 7 token files


def test_range_coder_round_trip_and_corruption():
    rng = np.random.default_rng(7)
    for ids in (np.zeros(0, int), np.array([65535]), np.array([(1 << 32) - 1, 0, 7]), np.full(10_000, 3), rng.integers(0, 65_536, 9_001), rng.integers(0, 1 << 32, 5_000), rng.zipf(1.3, 20_000) % 49_408):
        packed = rangecoder.compress(ids)
        assert rangecoder.decompress(packed).tolist() == ids.tolist()
        for k in (0, len(packed) // 2, len(packed) - 1):
            bad = bytearray(packed)
            bad[k] ^= 0x55
            with pytest.raises(rangecoder.Corrupt):
                rangecoder.decompress(bytes(bad))
        with pytest.raises(rangecoder.Corrupt):
            rangecoder.decompress(packed[:-1])


def test_mixed_orders_beat_order_nought():
    """Ids that repeat in pairs cost less than their entropy one by one, and unlike blocks don't lean on each other."""
    rng = np.random.default_rng(8)
    follows = rng.integers(0, 1000, 1000)
    ids = [0]
    for _ in range(60_000):
        ids.append(int(follows[ids[-1]]) if rng.random() < 0.7 else int(rng.integers(0, 1000)))
    share = np.bincount(ids)[np.bincount(ids) > 0] / len(ids)
    assert 8 * len(rangecoder.compress(np.array(ids))) < 0.9 * len(ids) * -(share * np.log2(share)).sum()


def test_plain_words_go_to_the_model():
    """Plain words and the marks behind them have the library's ids without passing its normaliser; others go to it whole."""
    encoder = CachedEncoder(public_tokenizers.path("word_bpe_49k.json"), 10)
    plain = ["house", "Haus", "\xc4pfel", "stra\xdfe", "\xf1and\xfa!!", "x<|", "a" * 300, "it&&&"]
    others = ["it's", "don't.", "\u0130x", "\xaa", "a1", "\xd7", "e\u0301", "<|endoftext|>", "x<|endoftext|>", "\u0153uf", "...a"]
    want = encoder._direct(plain + others)
    encoder._direct, given = None, []
    joined = encoder._joined
    encoder._joined = lambda parts: given.extend(parts) or CachedEncoder._direct(encoder, parts)
    assert encoder._separate(plain + others) == want and given == others
    encoder._joined = joined
    assert not CachedEncoder(public_tokenizers.path("byte_bpe_50k.json"), 10).plain


def test_encoder_gives_what_the_library_gives():
    texts = ["a\x1cb", "<|endoftext|> x <|endoftext|>", " x y\u0085z", " lead", "trail ", "É́ İI ΑΣ. Σ", "", "x" * 300 + " y", "it's. It's, 'tis.", "a.b. c.\n\n d,e, f", "Ünï. — a—. b2. ..", "x" * 5000 + ".", "\t tab\tbed", "THE the The. the,"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        encoder = CachedEncoder(public_tokenizers.path(name), 10)
        for _ in range(2):
            assert encoder.encode(texts) == [encoder._direct([t])[0] for t in texts]


def test_token_files_hold_what_the_library_gives(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    texts, start = {r["doc_id"]: r["text"] for r in table(spark, SMALL, "documents").collect()}, 0
    got = {r["doc_id"]: r for r in queries.op7_range_coder(spark, SMALL).collect()}
    for i in sorted(texts):
        ids = [*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 1]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_of_odd_rows(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    rangecoder.write(odd_docs(spark), str(tmp_path / "odd"), path)
    assert rangecoder.read(spark, str(tmp_path / "odd")).count() == 10
    rangecoder.write(odd_docs(spark).limit(0), str(tmp_path / "none"), path)
    assert rangecoder.read(spark, str(tmp_path / "none")).count() == 0


# 8 line dedup


def test_line_dedup_equals_its_sql(spark):
    rng = random.Random(8)
    passage = [f"shared line {i}" for i in range(12)]
    texts = ["\n".join([f"own {i} {j}" for j in range(rng.randrange(6))] + passage[rng.randrange(3) :] + [f"tail {i} {j}" for j in range(rng.randrange(6))]) for i in range(40)]
    texts += [None, "", "\n\n\n", "one line", "\n".join(passage * 3), texts[0]]
    df = docs_of(spark, texts).select("doc_id", "text")
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = con.execute(linededup.SQL.format(docs="documents")).fetchall()
    got = linededup.dedup(df).select("doc_id", "text", "n_lines", "n_removed").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert sum(r["n_removed"] for r in got) > 200


def test_line_dedup_of_odd_rows(spark):
    given = odd_docs(spark).withColumn("n_lines", F.lit("old")).withColumn("_gone", F.lit("old")).withColumn("_k", F.col("doc_id") + 1)
    got = linededup.dedup(given)
    assert got.count() == 10 and got.columns == [*(c for c in given.columns if c != "n_lines"), "n_lines", "n_removed"]
    assert all(r["_gone"] == "old" and (r["doc_id"] is None or r["_k"] == r["doc_id"] + 1) for r in got.collect())
    assert {r["text"] for r in got.where("doc_id in (2, 4, 6)").collect()} == {"", "short one", "...!!!"}
    assert linededup.dedup(odd_docs(spark).limit(0)).count() == 0


def test_planted_passages_go_whole(spark):
    import corpus_pipeline

    rng = random.Random(18)
    passages = [[f"planted {p} line {j}" for j in range(rng.randrange(2, 7))] for p in range(40)]
    held = [(rng.sample(passages, 2), i) for i in range(120)]
    texts = ["\n".join([f"own {i}", *a, f"between {i}", *b, f"tail {i}"]) for (a, b), i in held]
    texts += ["x\nx\nx", "y\ny\ny\ny\ny", None, "", "one line", "own 0\nplanted", texts[3]]
    df = docs_of(spark, texts).select("doc_id", "text")
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = con.execute(linededup.PASSAGE_SQL.format(docs="documents")).fetchall()
    got = linededup.dedup_passages(df).select("doc_id", "text", "n_lines", "n_removed").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    text, seen = {r["doc_id"]: r["text"] for r in got}, set()
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.remove_repeated_lines(spark, df, SMALL).collect()} == text
    for two, i in held:
        left = [f"own {i}", *(() if two[0][0] in seen else two[0]), f"between {i}", *(() if two[1][0] in seen else two[1]), f"tail {i}"]
        assert text[i] == "\n".join(left)
        seen |= {p[0] for p in two}
    assert [text[i] for i in range(120, 127)] == ["x\nx\nx", "y\ny", None, "", "one line", "own 0\nplanted", ""]


def test_passages_of_odd_rows(spark):
    rows = [(None, "a\nb\nc"), (None, "b\nc\nd"), (1, "p\nq"), (1, "p\nq\nr"), (2, "p\nq\nr")]
    got = linededup.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["n_removed"] for r in got) == [0, 0, 2, 2, 3]
    assert linededup.dedup_passages(odd_docs(spark).withColumn("_gone", F.lit("old"))).count() == 10
    assert linededup.dedup_passages(odd_docs(spark).limit(0)).count() == 0


# 9 packing


@pytest.mark.parametrize("kind", ["table", "odd"])
def test_pieces_hold_each_id_once(spark, kind):
    docs = table(spark, SMALL, "documents") if kind == "table" else odd_docs(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    got = packing.pack(docs, path).toPandas()
    for r in docs.collect():
        want = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        mine = got[got["doc_id"] == r["doc_id"]].sort_values("start")
        assert b"".join(map(bytes, mine["ids"])) == want
        assert mine["start"].tolist() == (mine["length"].cumsum() - mine["length"]).tolist() and set(mine["doc_tokens"]) == {len(want) // 4}
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == (s["length"].cumsum() - s["length"]).tolist() and s["length"].sum() <= 2048
    padded = got.groupby("sequence_id")["sequence_length"].first().sum()
    assert padded <= 1.001 * got["length"].sum()


def test_packing_of_nothing(spark):
    assert packing.pack(odd_docs(spark).limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_fill_equals_brute_force():
    rng = random.Random(9)
    for _ in range(200):
        lengths, room = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 8))], rng.randrange(1, 60)
        count, sums = Counter(lengths), {0}
        for x in lengths:
            sums |= {s + x for s in sums}
        used = packing.fill(sorted(count), count.__getitem__, room)
        assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= room)
        assert all(n <= count[k] for k, n in used.items())


# 10 Jaccard join


def classes_by_force(texts, k, num, den):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("k, num, den", [(4, 85, 100), (5, 80, 100)])
def test_components_equal_brute_force(spark, monkeypatch, k, num, den):
    rng = random.Random(k)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([1, 3, 5, 12, 60, 150]))]
        for _ in range(rng.choice([1, 2, 5, 30])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10_000)}"
            texts.append(" ".join(words))
    passage = " ".join(f"p{i}" for i in range(55))
    texts += [f"{passage} {' '.join(f'q{rng.randrange(50)}' for _ in range(n))}" for n in (3, 4, 5, 6, 8, 10, 12, 40, 200)]
    texts += [None, "", " \t ", texts[0].upper(), texts[0], "one", "ONE", "one two"]
    for sets in (400, 3):
        monkeypatch.setattr(jaccard, "_BLOCK_SETS", sets)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(docs_of(spark, texts), k, num, den).collect()}
        assert got == classes_by_force(texts, k, num, den)


def test_components_of_odd_rows(spark):
    got = jaccard.join(odd_docs(spark)).collect()
    assert len(got) == 10 and all(r["component_id"] == r["doc_id"] for r in got)
    assert jaccard.join(odd_docs(spark).limit(0)).count() == 0


def test_words_of_one_pattern_keep_apart(spark):
    thue = "".join("ab"[bin(i).count("1") & 1] for i in range(4096))
    texts = [t for n in (1024, 2048, 4096) for t in (thue[:n], thue[:n].translate({97: "b", 98: "a"}))] + ["a" * 5000, "A" * 5000, "a" * 5001]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(docs_of(spark, texts)).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8}


def test_jaccard_pairs_leave_out_what_all_share(spark):
    """Sets of many homes share three tokens and all but two nothing else: no row for each pair of them."""
    rows = [(token, i, 40, i % 50, i) for i in range(200) for token in (1, 2, 3, 1000 + i)]
    rows += [(4, i, 40, i % 50, i) for i in (10, 11)]
    left = spark.createDataFrame(rows, "token long, set_id long, n int, home long, label long")
    left = jaccard._across(left, 80, 100)
    assert {r["set_id"] for r in left.collect()} == {10, 11}
    left = spark.createDataFrame(rows + [(5 + i // 2, i, 40, i % 50, i) for i in range(200)], "token long, set_id long, n int, home long, label long")
    left = jaccard._across(left, 80, 100)
    rare = jaccard._rare(left, 80, 100)
    assert max(r["count"] for r in rare.groupBy("token").count().collect()) <= 2
    assert {(r["hub"], r["member"]) for r in jaccard._pairs(left, 80, 100).collect()} == {(i, i + 1) for i in range(0, 200, 2)}


def test_jaccard_sizes_that_fit(spark):
    """Sets stay in a home if another one's size allows a link, by the exact ratio too."""
    homes = spark.createDataFrame([(1, 80, 7), (2, 100, 7), (3, 200, 7), (4, 100, 8), (5, 300, 8), (6, 1, 9), (7, 1, 9)], "set_id long, n long, home long")
    assert {r["set_id"] for r in jaccard._fitting(homes, 80, 100).collect()} == {1, 2, 6, 7}


def test_prefix_tree_equals_brute_force():
    rng = np.random.default_rng(10)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30))).astype(np.uint64) for _ in range(300)]
    tree = jaccard.PrefixTree(sets)
    for probe in sets[:60]:
        for wanted in (None, rng.random(300) < 0.4):
            want = [i for i, x in enumerate(tree.sets) if 100 * len(np.intersect1d(x, probe)) >= 60 * len(np.union1d(x, probe)) and (wanted is None or wanted[i])]
            assert tree.linked(probe, 60, 100, wanted) == want


# the pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = table(spark, SMALL, "documents")
    columns, rows = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)  # as written and read again
        assert 0 < docs.count() <= rows
        rows = docs.count()
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()} == {r["doc_id"] for r in docs.collect()}


def test_near_duplicates_go_by_text_not_by_id(spark):
    import corpus_pipeline

    words = lambda name, n=60: " ".join(f"{name}{j}" for j in range(n))
    rows = [(None, words("a")), (None, words("b")), (None, words("b") + " more"), (None, words("c")), (7, words("d")), (7, words("e")), (3, words("f")), (7, words("f")), (9, words("g")), (None, words("g"))]
    rows += [(5, words("h")), (5, words("h")), (1, "..."), (1, "!"), (1, "!"), (None, ""), (None, ""), (None, None)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, _key int")
    left = corpus_pipeline.remove_near_duplicates(spark, docs, SMALL)
    assert left.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in left.collect())
    b = [(i, t) for i, t in got if t and t.startswith("b0 ")]
    assert len(b) == 1 and b[0] in rows
    want = [(None, words("a")), b[0], (None, words("c")), (7, words("d")), (7, words("e")), (3, words("f")), (9, words("g")), (5, words("h")), (1, "..."), (1, "!"), (None, ""), (None, None)]
    assert got == Counter(want)


def test_pipeline_of_odd_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    for name, docs in (("odd", odd_docs(spark)), ("none", odd_docs(spark).limit(0))):
        docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / name / "documents.parquet"))
        table(spark, SMALL, "benchmark").write.parquet(str(tmp_path / name / "benchmark.parquet"))
        assert corpus_pipeline.run(spark, str(tmp_path / name)).columns[0] == "doc_id"
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_every_query_runs_on_the_smallest_tables(spark):
    for name, query in queries.QUERIES.items():
        assert query(spark, SMALL).count() > 0, name
