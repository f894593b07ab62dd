"""Operators 11 to 13 against plain programs and the tokenizers library."""

import hashlib
import itertools
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from dialoglens.llm.compact_windows import repeated_passages
from dialoglens.llm import conversation_repair as cr
from dialoglens.llm import oracles, queries
from dialoglens.llm.bpe import Bpe, bpe_decode, bpe_encode
from dialoglens.llm.conversation_repair import damaged, repair, spoken
from dialoglens.llm.vector_codes import nearest, packed, unpacked, vector_codes

TURNS = "conv_id long, turn long, role string, text string, audit string"
NULL_COPY = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """Least (cost, audit) of (role, fault) rows by trying every edit and up to two insertions at each place."""
    best = {(): (0, "")}
    step = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}

    def inserted(layer):
        layer = dict(layer)
        for _ in range(2):
            for state, (cost, audit) in list(layer.items()):
                to, way = (3 if state == 2 else 2), (cost + 5, audit + "I")
                layer[to] = min(layer.get(to, way), way)
        return layer

    best = inserted({0: (0, "")})
    for role, fault in rows:
        new = {}
        for state, (cost, audit) in best.items():
            ways = [(state, (cost + 2, audit + "D"))]
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                ways.append(((3 if state == 2 else 2), (cost + 1 + extra, audit + "R")))
                if state in step.get(role[:1], {}):
                    ways.append((step[role[:1]][state], (cost + extra, audit + "K")))
            for to, way in ways:
                new[to] = min(new.get(to, way), way)
        best = inserted(new)
    return min(best[s] for s in (0, 3) if s in best)


def plain_repair(rows):
    """(audit, cost, lines) of (turn, role, text) rows in order."""
    seen, faulty = set(), []
    for _, role, text in rows:
        end = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else ""
        seen.add((role, text))
        faulty.append((role, fault))
    cost, audit = cheapest(faulty)
    state, at, lines = 0, 0, []
    for edit in audit:
        if edit in "IR":
            state = 3 if state == 2 else 2
        if edit == "K":
            state = {"s": 1, "u": 2, "a": 3}[rows[at][1][0]]
        if edit != "D":
            lines.append(f"{rows[at][1] if edit == 'K' else {2: 'user', 3: 'assistant'}[state]}:{'' if edit == 'I' else rows[at][2]}")
        at += edit != "I"
    return audit, cost, lines


@pytest.mark.parametrize("most", [2, 512])
def test_repair_of_random_conversations(spark, monkeypatch, most):
    monkeypatch.setattr(cr, "MOST_TURNS", most)
    rng = random.Random(most)
    texts = ["fine.", "why?", "cut off", "", " \t", "ok!", "also fine. "]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "ugh", ""]), rng.choice(texts), None) for c in range(40) for t in range(rng.randint(0, 14))]
    rows += [(99, t, ("user", "assistant")[t % 2], f"line {t}{'.' * (t % 7 != 3)}", None) for t in range(400)]
    got = repair(spoken(spark.createDataFrame(rows, TURNS).repartition(7)))
    lines = {}
    for r in got.turns.orderBy("conv_id", "place").collect():
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    summary = {r["conv_id"]: r for r in got.summary.collect()}
    assert len(summary) == len({r[0] for r in rows})
    for conv, mine in itertools.groupby(rows, key=lambda r: r[0]):
        audit, cost, want = plain_repair([r[1:4] for r in mine])
        r = summary[conv]
        assert (r["audit"], r["cost"], lines.get(conv, [])) == (audit, cost, want)
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(want).encode()).hexdigest()


def test_repair_of_odd_rows(spark):
    long = "w " * 200_000 + "end."
    rows = [(None, None, None, None), (1, None, "user", "b."), (1, 5, "user", "b."), (1, 2, "assistant", long), (1, 2, "assistant", long), (2, 0, "user", None), (3, 7, "system", "only."), (4, 1, "user", "x."), (4, 4, "assistant", "y.")]
    df = spark.createDataFrame(rows, NULL_COPY).withColumn("cost", F.lit("clash")).withColumn("key", F.lit(1))
    got = {r["conv_id"]: r for r in repair(spoken(df)).summary.collect()}
    assert (got[1]["audit"], got[1]["cost"], got[1]["duplicate"], got[1]["gaps"]) == ("KKDD", 4, 2, 2)
    assert (got[None]["audit"], got[None]["blank"], got[None]["gaps"]) == ("D", 1, 0)
    assert (got[3]["audit"], got[3]["repaired_sha256"]) == ("D", hashlib.sha256(b"").hexdigest())
    assert (got[4]["audit"], got[4]["gaps"], got[2]["blank"]) == ("KK", 2, 1)
    assert repair(spoken(df.limit(0))).summary.collect() == []


def test_a_conversation_that_lost_all_rows(spark):
    import zlib

    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    r = repair(damaged(spoken(spark.createDataFrame([(gone, 0, "user", "a.")], NULL_COPY)))).summary.collect()
    assert [tuple(x) for x in r] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_vector_codes"])
def test_new_queries_match_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = queries.queries()[name](spark, folder)
    found = con.execute(queries.oracle_sql()[name])
    assert [d[0] for d in found.description] == df.columns
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(found.fetchall(), key=repr)


def plain_codes(ids, labels, vectors, parts=8, entries=16, rounds=6):
    whole = np.array([[int(np.floor(4096 * float(x))) for x in v] for v in vectors], dtype=object)
    order, w = np.argsort(ids, kind="stable"), whole.shape[1] // parts
    codes, errors, said = [[] for _ in ids], [0] * len(ids), []
    for p in range(parts):
        mine = whole[:, p * w : (p + 1) * w]
        book = [list(mine[i]) for i in order[:entries]]
        off = lambda a, e: sum((x - y) ** 2 for x, y in zip(a, e, strict=True))
        for r in range(rounds + 1):
            near = [min(range(len(book)), key=lambda e: off(a, book[e])) for a in mine]
            if r < rounds:
                for e in set(near):
                    held = [a for a, n in zip(mine, near, strict=True) if n == e]
                    book[e] = [sum(c) // len(held) for c in zip(*held, strict=True)]
        for i, (a, n) in enumerate(zip(mine, near, strict=True)):
            codes[i].append(f"{n:02x}")
            errors[i] += off(a, book[n])
        said += [str(x) for e in book for x in e]
    by = {}
    for label, e in zip(labels, errors, strict=True):
        by[label] = by.get(label, 0) + e
    h = hashlib.sha256(",".join(said).encode()).hexdigest()
    return sorted((i, "".join(c), e, by[label], h) for i, c, e, label in zip(ids, codes, errors, labels, strict=True))


@pytest.mark.parametrize("far", [1.0, 3000.0])
def test_codes_against_plain_python(spark, far):
    rng = np.random.default_rng(3)
    vectors = [[float(x) for x in rng.normal(size=16) * far] for _ in range(60)] + [[0.5 * far] * 16] * 40
    ids, labels = [int(i) for i in rng.permutation(100)], [None if i % 5 == 0 else i % 3 for i in range(100)]
    rows = [(i, v, x, "clash") for i, v, x in zip(ids, vectors, labels, strict=True)]
    rows += [(200, None, 1, ""), (201, [1.0, None] * 8, 1, ""), (202, [float("nan")] * 16, 1, ""), (203, [float("inf")] * 16, 1, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, code string").repartition(5)
    got = sorted(map(tuple, vector_codes(df).collect()))
    assert got == plain_codes(ids, labels, vectors)


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>, label int"
    few = spark.createDataFrame([(None, [1.0, 2.0], None), (3, [], 1), (3, [1e300] * 9, 1), (3, [1e300] * 9, 1)], schema)
    got = vector_codes(few).collect()
    assert len(got) == 4 and {r["vec_id"] for r in got} == {None, 3} and all(len(r["code"]) == 16 for r in got)
    assert vector_codes(few.limit(0)).collect() == [] and vector_codes(few.where("vec_id = 99")).collect() == []


def test_packed_parts_and_exact_distances():
    import pyarrow as pa

    rows = np.array([[1, -2], [40_000, 0], [-32_768, 32_767], [1 << 40, -(1 << 62)]])
    assert unpacked(pa.array(packed(rows)), 2).tolist() == rows.tolist() and [len(x) for x in packed(rows)] == [4, 8, 4, 16]
    code, off = nearest(np.array([[1 << 60, 1]]), [[0, 0], [(1 << 60) - 3, 1], [(1 << 60) + 3, 1]])
    assert (code.tolist(), off.tolist()) == ([1], [9])


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(queries.vocabulary(name).decode())


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_of_odd_texts(name):
    tokens, own = library(name), Bpe(queries.vocabulary(name).decode())
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzABC  '''..--!?0123<|>éÈßİΣσςíñ한국어ँ́​\x1c\x85\xa0 \x00ﬁ²½Ⅷ٣𝒳👍🏽"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    texts += ["".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(500)] + ["a" * n for n in range(0, 300, 7)]
    texts += ["<|endoftext|>", "a<|endoftext|>b<|endoftext|><|ENDOFTEXT|>", "don't we'll '''s 'S", "ab" * 5000, "abba" * 512 + " " + "baab" * 512]
    for text in texts:
        want = tokens.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.ids(text), "<u4").tolist() == want
        assert own.text(own.ids(text)) == tokens.decode(want, skip_special_tokens=False)


def test_bpe_small_memory_gives_the_same_ids():
    spec = queries.vocabulary("word_bpe_49k.json").decode()
    small, large = Bpe(spec, memory=3), Bpe(spec)
    text = "the quick brown fox don't jump éclair über the lazy dog, 12 times; " * 20
    assert small.ids(text) == large.ids(text) and len(small.words) <= 3


def test_bpe_query_of_odd_rows(spark):
    spec = queries.vocabulary("word_bpe_49k.json").decode()
    tokens = library("word_bpe_49k.json")
    rows = [(1, None), (2, ""), (3, " \n"), (None, "no id"), (4, "x " * 100_000 + "y" * 100_000), (5, "Same."), (5, "Same.")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, ids string")
    got = sorted(bpe_decode(bpe_encode(df, spec), spec).collect(), key=lambda r: (r["doc_id"] or 0, r["n_tokens"]))
    assert [r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)] == [0, 0, 0] and len(got) == len(rows)
    for r in got:
        text = next(t for i, t in rows if i == r["doc_id"]) or ""
        want = tokens.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == want and r["decoded"] == tokens.decode(want, skip_special_tokens=False)
    assert bpe_encode(df.limit(0), spec).collect() == []


def test_oracles_are_those_of_the_parameters():
    assert oracles.codes_sql(rounds=1).count("AS MATERIALIZED") == oracles.codes_sql(rounds=2).count("AS MATERIALIZED") - 2


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_word_hashes_tell_patterns_apart(spark):
    import pyarrow as pa
    import xxhash

    from dialoglens.llm.jaccard_join import jaccard_join
    from dialoglens.llm.packing import Encoder
    from dialoglens.llm.textops import hashed_words

    words = [w for n in (8, 16, 64, 128, 1024, 2048) for w in thue_morse(n)] + ["a" * n for n in range(1, 200)] + ["É", "e", "Word", "word", "\x00", "\x00\x00"]
    found, n = hashed_words(pa.array(words, pa.string()))
    assert n.tolist() == [1] * len(words) and len(set(found.tolist())) == len({w.encode().lower() for w in words})
    again, _ = hashed_words(pa.array([" ".join(words)], pa.string()))
    assert again.tolist() == found.tolist() and found[words.index("a" * 199)] == xxhash.xxh3_64_intdigest(b"a" * 199)
    spec, tokens = queries.vocabulary("word_bpe_49k.json").decode(), library("word_bpe_49k.json")
    texts = list(thue_morse(2048))
    assert [np.frombuffer(x, "<u4").tolist() for x in Encoder(spec).ids(pa.array(texts))] == [tokens.encode(t, add_special_tokens=False).ids for t in texts]
    docs = spark.createDataFrame(list(enumerate(thue_morse(1024), 1)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join(docs).collect()} == {1: 1, 2: 2}


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    import corpus_pipeline

    for seed in range(3):
        rng = random.Random(seed)

        def fresh(n):
            return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(n))

        shared, other = fresh(80), fresh(70)
        rows = [(1, f"{fresh(30)} {shared}"), (2, fresh(140)), (2, f"{shared} {fresh(40)}"), (3, f"{fresh(20)} {other}"), (3, f"{other} {fresh(20)}"), (3, None), (4, fresh(90))]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = repeated_passages(docs).collect()
        assert sorted((r["doc_id"], r["source_doc_id"], r["n_words"]) for r in got) == [(2, 1, 80), (3, 3, 70)]
        left = sorted((r["doc_id"], r["text"] or "") for r in corpus_pipeline.by_compact_windows(spark, docs, "").collect())
        # the text of id 2 that repeats nothing is whole, one of id 3 keeps what both hold
        assert (1, rows[0][1]) in left and (2, rows[1][1]) in left and sum(shared in t for _, t in left) == 1
        assert sum(other in t for _, t in left) == 1 and len(left) == 7 and sum(len(t.split()) for _, t in left) == 110 + 140 + 40 + 90 + 20 + 90


def test_shared_passages_against_plain_python():
    from dialoglens.llm.compact_windows import Settings, shared_passages

    s, rng = Settings(words=12), np.random.default_rng(5)
    group, doc = np.sort(rng.integers(0, 3, 40)), np.zeros(40, np.int64)
    for g in range(3):
        doc[group == g] = np.sort(rng.integers(0, 9, (group == g).sum()))
    context = rng.integers(0, 12, (40, 2 * s.reach + 1)).astype(np.uint16)
    smaller, other = shared_passages(group, doc, context, s)
    for m in range(40):
        for which, found in ((lambda d: d < doc[m], smaller), (lambda d: d != doc[m], other)):
            held = {x for i in range(40) if group[i] == group[m] and which(doc[i]) for x in context[i].tolist()} - {0}
            for p in range(s.least):
                first = s.reach - s.least + 1 + p
                assert found[m, p] == (sum(x in held for x in context[m, first : first + s.least].tolist()) >= s.enough)


def test_near_duplicates_with_a_column_that_has_no_order(spark):
    import corpus_pipeline

    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, {"a": 1}), (1, text, {"a": 2}), (2, text, {}), (3, "other words", None)], "doc_id long, text string, more map<string,int>")
    assert sorted(r["doc_id"] for r in corpus_pipeline.by_jaccard_join(spark, docs, "").collect()) == [1, 3]
