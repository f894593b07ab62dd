"""The training-data operators against brute force, round trips and held-out labels."""

import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from dialoglens.llm import queries
from dialoglens.llm.compact_windows import repeated_passages
from dialoglens.llm.compression_rules import quality_rules
from dialoglens.llm.jaccard_join import jaccard_join
from dialoglens.llm.kmeans_tree import nearest
from dialoglens.llm.mixing import Targets, mixed_sample, raked
from dialoglens.llm.packing import pack, patterns
from dialoglens.llm.quality_classifier import quality_scores
from dialoglens.llm.token_counts import Trie, token_counts
from dialoglens.llm.toxicity import BlockMaxIndex, toxicity_scores
from dialoglens.llm.url_filters import shared_urls, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))


def table(spark, *texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.0) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, short, very long and repeated texts, a null id, a column named as a result is."""
    rows = table(spark, None, "", " \n ", "one two", LONG, "a b c d e f g", "a b c d e f g")
    return rows.unionByName(spark.createDataFrame([(None, "no id", None, None, None, None)], DOCS)).unionByName(rows.where("doc_id = 3"))


def spec():
    return queries.vocabulary("word_bpe_49k.json").decode()


def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (5, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "quality": lambda s, d: quality_scores(d, labels(s)),
    "mixing": lambda s, d: mixed_sample(d),
    "toxicity": lambda s, d: toxicity_scores(d, labels(s)),
    "rules": lambda s, d: quality_rules(d),
    "windows": lambda s, d: repeated_passages(d),
    "tokens": lambda s, d: token_counts(d, queries.vocabulary("piece_bpe_32k.model")),
    "packing": lambda s, d: pack(d, spec()),
    "jaccard": lambda s, d: jaccard_join(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_and_empty_tables(spark, odd, name):
    got = OPERATORS[name](spark, odd).collect()
    if name == "windows":
        assert got == []
    elif name == "packing":
        assert len({r["doc_id"] for r in got}) == 8
    else:
        assert len(got) == odd.count()
    assert OPERATORS[name](spark, odd.limit(0)).collect() == []


def test_rules(spark):
    dup = "same line here\n" * 3 + "other words follow now and again until there are twenty of them in this text all told ok"
    r = quality_rules(table(spark, dup, "# one", "x y " * 40)).orderBy("doc_id").collect()
    assert r[0]["n_dup_lines"] == 2 and r[1]["n_symbols"] == 1 and r[1]["base_failed"] and not r[1]["kept"]
    assert r[2]["n_repeat_words"] == 80 and r[2]["base_failed"] and r[0]["word_chars"] == sum(map(len, dup.split()))


def test_compression_bands_against_plain_python(spark):
    import base64
    import math

    import zstandard

    from dialoglens.llm.compression_rules import Bands

    rng = random.Random(8)
    letters = "etaoinshrdlu"
    lexicon = ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    prose = [" ".join(rng.choice(lexicon) for _ in range(rng.randrange(180, 300))) for _ in range(120)]
    noise = [" ".join(base64.b64encode(rng.randbytes(45)).decode() for _ in range(25)) for _ in range(4)]
    few = [" ".join(rng.choice(lexicon[:2]) + "!" for _ in range(300)) for _ in range(4)]
    half = [" ".join(rng.choice(lexicon) for _ in range(200)) + " " + "ab " * 1500 for _ in range(4)]
    texts = prose + noise + few + half
    got = {r["doc_id"]: r for r in quality_rules(table(spark, *texts)).collect()}
    assert all(got[i]["verdict"] == "kept" for i in range(len(prose)))
    assert [got[i]["verdict"] for i in range(len(prose), len(prose) + 4)] == ["incompressible"] * 4
    assert all(got[i]["verdict"] in ("repetitive", "base") for i in range(len(prose) + 4, len(texts)))
    press, bands = zstandard.ZstdCompressor(level=3), Bands()
    ratio = [len(press.compress(t.encode())) / len(t.encode()) for t in texts]
    kind = [len(t).bit_length() - 1 for t in texts]
    for i, t in enumerate(texts):
        assert got[i]["ratio"] == ratio[i]
        own = sorted(math.log(r) for r, k in zip(ratio, kind) if k == kind[i])
        low, high = (own[math.ceil(p * len(own)) - 1] for p in (0.25, 0.75))
        far = bands.fence * max(high - low, bands.spread)
        out = "repetitive" if math.log(ratio[i]) < low - far else "incompressible" if math.log(ratio[i]) > high + far else None
        if not got[i]["base_failed"]:
            assert (got[i]["verdict"] if got[i]["verdict"] in ("repetitive", "incompressible") else None) == out


def sets_of(texts):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def family_texts(seed=1):
    rng = random.Random(seed)
    texts = []
    for _ in range(12):
        base = [rng.choice("abcdefghij") + str(rng.randrange(400)) for _ in range(rng.randrange(6, 160))]
        for _ in range(rng.randrange(1, 7)):
            t = list(base)
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(len(t))] = f"z{rng.randrange(9999)}"
            texts.append(" ".join(t))
    return [*texts, "", None, "two words", "Two Words"]


def test_jaccard_join_is_exact(spark):
    texts = family_texts()
    sets = sets_of(texts)
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join(table(spark, *texts)).collect()}
    assert got == {i: (len(sets[i]), root[i]) for i in range(len(texts))}


def test_repeated_passages_are_found(spark):
    rng = random.Random(3)

    def fresh(n):
        return [f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(n)]

    shared = fresh(70)
    near = list(shared)
    near[35] = "changed"
    texts = [fresh(40) + shared + fresh(30), fresh(90) + shared, near + fresh(200), fresh(200), fresh(30) + shared[:40]]
    got = repeated_passages(table(spark, *(" ".join(t) for t in texts))).collect()
    # each repeat is reported against the smallest document and may be against others before it
    assert {(1, 0), (2, 0)} <= {(r["doc_id"], r["source_doc_id"]) for r in got} <= {(1, 0), (2, 0), (2, 1)}
    one = next(r for r in got if r["doc_id"] == 1)
    assert (one["start_word"], one["n_words"], one["source_start"]) == (90, 70, 40)


def test_near_passage_beside_a_shared_line():
    from dialoglens.llm.compact_windows import Settings, passages
    from dialoglens.llm.textops import shingles, word_memo, words_of

    def verified(own, source):
        return passages(*(shingles(words_of(" ".join(t)), word_memo()) for t in (own, source)), Settings())

    near, line, other = ([f"{c}{i}" for i in range(60)] for c in "plo")
    changed = [*near[:30], "changed", *near[31:]]
    # a line that the source holds elsewhere stands six words behind the passage
    got = verified(changed + other[:6] + line[:12], line[:12] + other[20:50] + near)
    assert [(a, n, c, m) for a, n, c, m, _ in got] == [(0, 56, 42, 56)] and got[0][4] == 51 / 61
    # two near passages side by side that lie apart in the source
    second = [f"q{i}" for i in range(60)]
    got = verified(changed + [*second[:25], "new", *second[26:]], second + other[:40] + near)
    assert [(a, n) for a, n, *_ in got] == [(0, 56), (60, 56)]


def template_texts(n):
    """Texts of one template of 120 words with six slots, in words of their own: only some of any two match."""
    rng = random.Random(11)
    base = [f"t{rng.randrange(10**6)}" for _ in range(120)]
    out = []
    for i in range(n):
        t = list(base)
        for slot in (8, 28, 48, 68, 88, 108):
            t[slot] = f"s{slot}v{rng.randrange(20)}"
        out.append(" ".join([f"a{i}x{k}" for k in range(30)] + t + [f"z{i}x{k}" for k in range(30)]))
    return out


def test_template_texts_lose_no_repeat(spark):
    from dialoglens.llm.compact_windows import Settings, passages
    from dialoglens.llm.textops import shingles, word_memo, words_of

    texts = template_texts(150)
    own = [shingles(words_of(t), word_memo()) for t in texts]
    want = {b for b in range(len(own)) if any(passages(own[b], own[a], Settings()) for a in range(b))}
    got = repeated_passages(table(spark, *texts)).collect()
    assert {r["doc_id"] for r in got} >= want and all(r["source_doc_id"] < r["doc_id"] for r in got)


def test_url_filter_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    want = con.execute(f"select page_id, host, path, rule, verdict from ({queries.OP7_SQL}) order by 1").fetchall()
    got = queries.op7_url_filters(spark, sf).select("page_id", "host", "path", "rule", "verdict").orderBy("page_id").collect()
    assert [tuple(r) for r in got] == want


def test_url_filter_odd(spark):
    p = spark.createDataFrame([(1, None, "x"), (2, "no scheme", "x"), (3, "HTTP://A.Net/es/x?q", "x"), (4, "http://q.org/a", "x"), (5, "http://www.q.org/a.html", "x"), (6, "http://b.com", "x")], "page_id long, url string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter(p, shared_urls(p)).collect()}
    assert got[1] == got[2] == ("", "", None, "allow") and got[3] == ("a.net", "/es/x", "net/es/", "block")
    assert got[4][3] == got[5][3] == "block" and got[6] == ("b.com", "", None, "allow")
    assert url_filter(p.limit(0), shared_urls(p)).count() == 0


def test_nearest_against_brute_force(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = {r["vec_id"]: np.array(r["embedding"], dtype=np.float64) for r in v.collect()}
    got = {}
    for r in nearest(v).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    hit = 0
    for q in got:
        true = {k: float(x @ rows[q] / np.linalg.norm(x) / np.linalg.norm(rows[q])) for k, x in rows.items() if k != q}
        best = sorted(true, key=lambda k: (-true[k], k))[:5]
        hit += len(set(best) & set(got[q]))
        assert all(abs(true[k] - s) < 1e-9 for k, s in got[q].items())
    assert set(got) == {q for q in rows if q % 50 == 0} and hit >= 0.9 * 5 * len(got)


def test_nearest_odd(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [1.0, 0.0]), (5, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in nearest(v).orderBy("rank").collect()] == [(4, 1.0), (5, 0.0)]
    assert nearest(v.limit(0)).count() == 0


def test_nearest_extremes(spark):
    rows = [(0, [1e-200, 0.0]), (1, [1e200, 1e200]), (2, [1.0, 0.1]), (3, [2.0, 0.2]), (50, [1e200, 0.0]), (51, [1.0, 0.0, 0.0]), (52, [3.0, 0.3])]
    got = {}
    for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 12)))
    cos = round(1 / np.sqrt(1.01), 12)
    assert got == {0: [(50, 1.0), (2, cos), (3, cos), (52, cos), (1, round(0.5**0.5, 12))], 50: [(0, 1.0), (2, cos), (3, cos), (52, cos), (1, round(0.5**0.5, 12))]}


def test_packing_round_trip(spark, sf):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = pack(docs, spec()).collect()
    model = Tokenizer.from_str(spec())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = {d: np.array([*model.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4") for d, t in texts.items()}
    for r in got:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    assert sum(r["length"] for r in got) == sum(map(len, ids.values()))
    by: dict = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(by) <= 1.03 * sum(map(len, ids.values())) / 4096 + 1


def test_patterns_hold_the_histogram():
    hist = {7: 3, 5: 4, 3: 9, 1: 2, 10: 1}
    used: dict = {}
    for count, lengths in patterns(dict(hist), 10):
        assert sum(lengths) <= 10
        for n in lengths:
            used[n] = used.get(n, 0) + count
    assert used == hist


def test_trie_counts_match_plain_search():
    pieces = {"▁": -3.0, "▁a": -2.0, "b": -2.5, "▁ab": -4.0, "c": -1.0, "bc": -3.0, **{f"<0x{b:02X}>": -9.0 for b in range(256)}}

    def plain(word):
        best = [(0.0, 0)] + [(-1e9, 0)] * len(word)
        for end in range(1, len(word) + 1):
            spelt = word[end - 1].encode()
            options = [(best[end - 1][0] - 9.0 * len(spelt), best[end - 1][1] + len(spelt))]
            options += [(best[s][0] + pieces[word[s:end]], best[s][1] + 1) for s in range(end) if word[s:end] in pieces]
            best[end] = min(options, key=lambda o: (-o[0], o[1]))
        return best[-1][1]

    words = [b"abc", b"ab", b"abcc", b"x", b"", "é".encode(), b"abc"]
    assert Trie(pieces).counts(words).tolist() == [plain("▁" + w.decode()) for w in words]


def test_raking_meets_margins():
    cells = [(s, lang, t) for s in "ab" for lang in "xy" for t in "01"]
    tokens = np.array([50.0, 10, 5, 20, 7, 9, 30, 40])
    fit = raked(cells, tokens, Targets(shares={"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.3, "y": 0.7}}, temper={"topic": 0.0}))
    for m, key, share in ((0, "a", 0.5), (1, "x", 0.3), (2, "0", 0.5)):
        assert sum(f for c, f in zip(cells, fit) if c[m] == key) == pytest.approx(share, abs=1e-6)


def test_topics_come_from_content(spark):
    from dialoglens.llm.mixing import with_cells

    rng = random.Random(5)
    themes = [[f"{c}{rng.randrange(10**6)}" for _ in range(150)] for c in "abcdef"]
    common = [f"w{i}" for i in range(200)]
    texts, theme = [], []
    for i in range(240):
        theme.append(i % 6)
        texts.append(" ".join(rng.choice(common) if rng.random() < 0.5 else rng.choice(themes[i % 6]) for _ in range(400)))
    got = {r["doc_id"]: r["topic"] for r in with_cells(table(spark, *texts), Targets(topics=6), "doc_id", "text").collect()}
    pairs = [(theme[i] == theme[j], got[i] == got[j]) for i in range(240) for j in range(i)]
    assert np.mean([a == b for a, b in pairs]) > 0.95


def test_mixing_meets_its_budget(spark, sf):
    got = mixed_sample(spark.read.parquet(f"{sf}/documents.parquet")).agg(F.sum("n_tokens").alias("n"), F.sum(F.col("n_tokens") * F.col("probability")).alias("e")).first()
    assert got["e"] == pytest.approx(0.6 * got["n"], rel=1e-6)


@pytest.mark.parametrize("name,label,least", [("op1_quality_classifier", "quality", 0.85), ("op3_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.1"
    if not os.path.exists(sf):
        pytest.skip("no larger table")
    known = spark.read.parquet(f"{sf}/labels.parquet").where(F.col(label).isNotNull())
    got = queries.queries()[name](spark, sf).where("held_out").join(known, "doc_id").select("predicted", label).collect()
    assert np.mean([r["predicted"] == r[label] for r in got]) >= least


@pytest.mark.parametrize("n", [0, 1, 40, 700])
def test_block_max_search_against_brute_force(n):
    rng = np.random.default_rng(n)

    def unit():
        terms = np.unique(np.minimum(rng.zipf(1.4, 30), 400)) - 1
        w = rng.random(len(terms)) + 0.1
        return terms, w / np.linalg.norm(w)

    vectors = [unit() for _ in range(n)]
    if n > 2:
        vectors[1], vectors[2] = vectors[0], (np.empty(0, np.int64), np.empty(0))
    ids = rng.permutation(n) * 3
    index = BlockMaxIndex(ids, np.zeros(n), vectors, 401, 16)
    dense = np.zeros((n, 401))
    for row, (terms, w) in zip(dense, vectors, strict=True):
        row[terms] = w
    for terms, w in [*vectors[:3], *(unit() for _ in range(20))]:
        cos = np.round(np.minimum(dense[:, terms] @ w, 1), 12)
        want = [(ids[i], cos[i]) for i in np.lexsort((ids, -cos)) if cos[i] > 0][:8]
        found, scores = index.search(terms, w, 8)
        assert len(found) == len(want) and np.allclose(scores, [c for _, c in want], atol=1e-10)
        assert [int(i) for i in index.ids[found]] == [int(i) for i, _ in want]


def test_every_word_of_the_examples_counts(spark):
    """A near copy of a toxic example is caught by words that no other text holds; label words need no least count."""
    plain = [f"calm{i} words{i % 7} about rivers{i % 5} and hills{i}" for i in range(40)]
    rude = [f"dolt{i} churl{i} oaf{i} knave{i} lout{i} boor{i}" for i in range(40)]
    docs = table(spark, *plain, *rude)
    known = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") >= 40).cast("int").alias("toxic"))
    copies = docs.where("doc_id >= 40 and crc32(cast(cast(doc_id as string) as binary)) % 5 != 0").withColumn("doc_id", F.col("doc_id") + 1000)
    got = {r["doc_id"]: r for r in toxicity_scores(docs.unionByName(copies), known).collect()}
    assert all(r["predicted"] == 1 and r["evidence"][0]["doc_id"] == i - 1000 for i, r in got.items() if i >= 1000)
    assert all(r["predicted"] == 0 for i, r in got.items() if i < 40 and r["n_neighbours"])


def test_pipeline_keeps_its_columns(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = corpus_pipeline.by_quality_rules(spark, docs, sf)
    assert one.columns == docs.columns and 0 < one.count() < docs.count()
    two = corpus_pipeline.by_jaccard_join(spark, one, sf)
    assert two.columns == docs.columns and two.count() == jaccard_join(one).where("doc_id = component_id").select("doc_id").distinct().count()
    three = corpus_pipeline.by_compact_windows(spark, two, sf)
    assert three.columns == docs.columns and repeated_passages(three).count() <= repeated_passages(two).count()
    assert corpus_pipeline.run(spark, sf).agg(F.min("length")).first()[0] > 0


@pytest.mark.parametrize("name", ["quality_rules", "jaccard_join", "compact_windows", "mixing", "packing"])
def test_stages_on_odd_tables(spark, name):
    import corpus_pipeline

    rng = random.Random(2)

    def fresh(n):
        return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))

    shared, one = fresh(80), fresh(60)
    rows = [(1, fresh(30) + " " + shared, "en", "s"), (2, shared + " " + fresh(40), None, None), (3, shared, "en", "s"), (4, None, "en", "s"), (5, "", "en", "s"), (6, one, "en", "s"), (6, one, "de", "s"), (7, one, "en", "s"), (None, fresh(60), "en", "s"), (8, LONG, "en", "s")]
    stage = dict(corpus_pipeline.STAGES)[name]
    # clashing names, and no n_chars
    docs = spark.createDataFrame([(*r, 1, "x", True) for r in rows], "doc_id long, text string, lang string, source string, new long, spans string, kept boolean")
    out = stage(spark, docs, "")
    got = out.collect()
    assert stage(spark, docs.limit(0), "").collect() == []
    if name == "packing":
        assert len({r["doc_id"] for r in got}) == 9 and sum(r["length"] for r in got if r["start"] == 0 and r["doc_id"] in (4, 5)) == 2
        return
    assert out.columns == docs.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got)
    if name == "quality_rules":
        assert [i for _, i in ids] == [1, 2, 3, 6, 6, 7] or [i for _, i in ids] == [1, 2, 3, 6, 6, 7, 8]
    elif name == "jaccard_join":
        assert [i for _, i in ids] == [1, 2, 3, 4, 5, 6, 8] and next(r["lang"] for r in got if r["doc_id"] == 6) == "de"
    elif name == "compact_windows":
        texts = {r["doc_id"]: r["text"] for r in got}
        assert shared in texts[1] and shared not in texts[2] and 3 not in texts and 7 not in texts and texts[8] == LONG and None in texts and texts[5] == ""
    else:
        assert all(i is not None for _, i in ids)
