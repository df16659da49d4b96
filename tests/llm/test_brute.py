"""The operators against plain versions on the smallest tables and on planted cases."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
import tiktoken
from stratiform.llm import bpe, brown, minhash, mixing, neighbours, pii, queries, sharding, toxicity
from stratiform.llm import vector_duplicates as dup
from stratiform.llm.common import components
from stratiform.suite import Query
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    q = Query(name, lambda t: queries.QUERIES[name](t.spark, t.folder), queries.ORACLE_SQL[name], False)
    ok, text = compare(spark, connect(FOLDER), FOLDER, q)
    assert ok, text


def groups_of(n, linked):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_mix_is_near_its_targets(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randrange(1, 40), f"s{min(5, int(rng.expovariate(0.7)))}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    names, total = sorted(size), sum(size.values())
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, full = {}, set()
    while True:  # water filling, one capped set at a time
        rest = total - sum(3 * size[s] for s in full)
        level = rest / sum(weight[s] for s in names if s not in full)
        target = {s: 3 * size[s] if s in full else weight[s] * level for s in names}
        over = {s for s in names if target[s] > 3 * size[s]}
        if not over:
            break
        full |= over
    got = mixing.mix(docs).collect()
    again = {r["doc_id"]: r["copies"] for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["copies"] for r in got}
    for s in names:
        own = [r for r in got if r["source"] == s]
        assert own[0]["source_size"] == size[s] and own[0]["target"] == pytest.approx(target[s])
        assert abs(sum(r["copies"] * r["size"] for r in own) - target[s]) <= 2 * 40
    assert max(r["copies"] for r in got) <= 3


def test_shards_are_the_smallest_possible(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.choice([1, 5, 40, 300]) + str(rng.randrange(90))) for i in range(500)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 5)
    got = got.orderBy("_shard", "_slot").collect()
    groups = []
    for r in got:
        if groups and groups[-1][0] == r["text"]:
            groups[-1][1] += r["_size"]
        else:
            groups.append([r["text"], r["_size"]])
    assert len({g[0] for g in groups}) == len(groups)
    sizes = [g[1] for g in groups]

    def runs(capacity):
        n, room = 1, capacity
        for s in sizes:
            if s > room:
                n, room = n + 1, capacity
            room -= s
        return n

    best = next(c for c in range(max(sizes), sum(sizes) + 1) if runs(c) <= 5)
    fullest = collections.Counter()
    for r in got:
        fullest[r["_shard"]] += r["_size"]
    assert max(fullest.values()) == best


def test_shards_are_even_beside_a_wide_text(spark):
    rng = random.Random(4)
    rows = [(i, f"{i:04d}" + "x" * rng.randrange(160)) for i in range(800)] + [(900, "hot" * 10_000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    size = collections.Counter()
    for r in got:
        size[r["_shard"]] += r["_size"]
    rest = sorted(size.values())[:-1]
    assert len(size) == 8 and max(size.values()) == 30_001
    assert max(rest) < 1.5 * min(rest)


def test_signatures_are_those_of_the_definition():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 3, 30, 200)]
    got = minhash.super_minhash(sets, 48)
    for s, signature in zip(sets, got):
        want = [2**64 - 1] * 48
        for e in s:
            place = list(range(48))
            for j in range(48):
                step = np.array([(0x9E3779B97F4A7C15 * (j + 1)) % 2**64], np.uint64)
                draw = int(minhash.mix(np.array([e], np.uint64) + step)[0])
                k = j + (((draw >> 32) * (48 - j)) >> 32)
                place[j], place[k] = place[k], place[j]
                want[place[j]] = min(want[place[j]], (j << 32) + (draw & 0xFFFFFFFF))
        assert signature.tolist() == want


@pytest.mark.parametrize("n", [60, 2000])
def test_small_tables_take_the_passes_too(spark, monkeypatch, n):
    calls = collections.Counter()
    for name in ("sweep", "all_pairs"):
        whole = getattr(dup, name)
        monkeypatch.setattr(dup, name, lambda *a, f=whole, c=name: (calls.update([c]), f(*a))[1])
    rng = np.random.default_rng(2)
    v = rng.standard_normal((n, 24))
    v[n // 2 :] = v[: n - n // 2] + 0.05 * rng.standard_normal((n - n // 2, 24))
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["component_id"] for r in dup.near_vectors(frame).collect()}
    assert got == {i: i % (n // 2) for i in range(n)}
    assert calls["sweep"] >= 1 and not calls["all_pairs"]


@pytest.mark.parametrize("passes", [16, 1])
def test_lone_pairs_in_a_dense_cone_are_found(spark, passes):
    """Two thirds of the vectors lie at cosine 0.93 to each other, which is no link; 60 have a twin."""
    rng = np.random.default_rng(11)
    *v, axis = dup.unit(rng.standard_normal((3001, 512)))
    v = np.array(v)
    v[:2000] = dup.unit(0.93**0.5 * axis + 0.07**0.5 * v[:2000])
    u = rng.standard_normal((60, 512))
    u = dup.unit(u - (u * v[:60]).sum(axis=1, keepdims=True) * v[:60])
    v = np.concatenate([v, 0.951 * v[:60] + (1 - 0.951**2) ** 0.5 * u])
    want = (v @ v.T >= 0.95).sum(axis=1) - 1
    assert want.sum() == 120
    rows = [(i, w) for i, w in enumerate(v.tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in dup.near_vectors(frame, passes=passes).collect()}
    assert [got[i] for i in range(len(v))] == want.tolist()


def test_fringe_texts_link_with_one_member_of_a_joined_group_each(spark):
    """One bucket holds all texts; a fringe links with neither the centre nor other bridges."""

    def texts_of(salt):
        swap = lambda t, a, by: t[:a] + [f"{by}{i}" for i in range(a, a + 10)] + t[a + 10 :]
        centre = [f"{salt}w{i}" for i in range(100)]
        bridges = [swap(centre, 20 * k, "x") for k in range(3)]
        fringes = [swap(t, 20 * k + 10, "y") for k, t in enumerate(bridges)]
        return [" ".join(t) for t in [centre, *bridges, *fringes]]

    for salt in range(1000):  # until the one register is the same for all
        sets = [minhash.shingle_set(t, 1) for t in texts_of(salt)]
        if len(np.unique(minhash.super_minhash(sets, 1))) == 1:
            break
    rows = list(enumerate(texts_of(salt)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = minhash.near_duplicates(docs, words=1, percent=80, bands=1, rows=1).collect()
    assert {r["key"]: r["component_id"] for r in found} == {i: 0 for i, _ in rows}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_of_a_dense_group(spark, percent):
    """Copies edited more or less, around the threshold: same components as all pairs give."""
    rng = random.Random(percent)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(260):
        text = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6])):
            text[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, f"alone {i} " + " ".join(f"z{rng.random()}" for _ in range(9))) for i in range(40)]
    sets = [set(minhash.shingle_set(t, 3).tolist()) for _, t in rows]
    linked = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    want = {rows[i][0]: rows[r][0] for i, r in enumerate(groups_of(len(rows), linked))}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    bands = {"bands": 28, "rows": 6} if percent == 85 else {}
    got = minhash.near_duplicates(docs, words=3, percent=percent, **bands).collect()
    assert {r["key"]: r["component_id"] for r in got} == want
    assert 1 < len({c for i, c in want.items() if i < 1000}) < 260


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)]
    edges += [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    root = groups_of(400, edges)
    assert got == {i: root[i] for e in edges if e[0] != e[1] for i in e}


def test_scores(spark, documents, texts):
    got = {r["doc_id"]: r for r in brown.score(documents).collect()}
    counts = collections.Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*(t or "").encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    held = {True: [0.0, 0.0], False: [0.0, 0.0]}
    for i, t in texts.items():
        tokens = [*(t or "").encode().lower().split(), None]
        r = got[i]
        assert (r["n_tokens"], r["train_tokens"]) == (len(tokens), n)
        assert r["n_known"] == sum(counts[w] > 0 for w in tokens)
        plain = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        assert r["base_score"] == pytest.approx(plain)
        held[r["held_out"]][0] += r["score"]
        held[r["held_out"]][1] += r["base_score"]
    # Over all held-out texts the model gives a likelier account than the add-one unigram.
    assert held[True][1] < 0.9 * held[True][0] < 0


def test_score_probabilities_add_up(spark):
    """After any token, the known words, a word never seen and the end have probability 1."""
    rows = [(i, "a b a c d e f a b c x%d" % i) for i in range(1, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("text")
    vocabulary = brown.word_counts(docs, "text").cache()
    m = brown.fit(docs, vocabulary, "text", brown.Sizes(classes=3, core=4, middle=5))
    size = m.lexicon.size
    assert size == 6 and m.rest_words == m.rest_tokens == 29 and m.tokens == 29 * 12
    known = 29 * (1 - brown.DISCOUNT) / (29 + 1)
    never = (29 * brown.DISCOUNT + 1) / (29 + 1)
    for before in range(len(m.transition)):
        each = 10 ** (m.transition[before, m.of] + m.emission)
        outside, end = each[size], each[size + 1]
        assert each[:size].sum() + outside * (known + never) + end == pytest.approx(1)


def test_exchange_finds_the_languages():
    rng = np.random.default_rng(4)
    line = []
    for _ in range(400):
        line += [(rng.integers(0, 10) * 2 + rng.integers(0, 1) + lang) for lang in [rng.integers(0, 2)] for _ in range(30)]
    pairs = np.zeros((21, 21), np.int64)
    np.add.at(pairs, (line[:-1], line[1:]), 1)
    of = brown.exchange(pairs, 2)
    assert len({of[w] for w in range(0, 20, 2)}) == 1 and len({of[w] for w in range(1, 20, 2)}) == 1


def test_bpe_is_what_tiktoken_gives(texts):
    encoder = bpe._encoder(bpe.load_ranks(RANKS), public_tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN,
                            mergeable_ranks=encoder.vocabulary.ranks, special_tokens={})
    rng = random.Random(9)
    odd = ["", "<|endoftext|>", "I'll don't", "\x1c\x85  \n\n x", "a" * 3000, "ab" * 900, "=-" * 700]
    odd += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x3000), 0x1F600 + rng.randrange(40)]))
                    for _ in range(rng.randrange(300))) for _ in range(60)]
    some = [*odd, *list(texts.values())[:80]]
    for text, ids in zip(some, encoder.encode(some)):
        assert ids == own.encode_ordinary(text)
        assert encoder.decode(ids) == text.encode()


def test_pseudonyms(spark):
    rows = [
        (1, "card 4111 1111 1111 1111 and 4111111111111111, not 4111111111111112"),
        (2, "mail Bob.x+1@mail.example.com or bob.x+1@MAIL.example.com; host 10.0.255.1 v1.2.3.4.5"),
        (3, "born 1985-02-28, 02/28/1985, 28.02.1985, 28.2.1985; not 1985-02-30 or 0985-01-01"),
        (4, "ssn 123-45-6789 not 000-12-3456, 666-12-3456 or 123-00-6789"),
        (5, "+1 (988) 555-2485 4041894974608795 (415) 555-1234 +1 415 555 1234 +49 30 1234567"),
        (6, "token = 0641917ea4e9feb9 version 3. 4.0 AKIA12 password=e3b3ed3cc8548923d6"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.pseudonymise(docs, "k").collect()}
    other = {r["doc_id"]: r for r in pii.pseudonymise(docs, "k2").collect()}
    shown = {i: [(f["kind"], f["pseudonym"]) for f in r["pii"]] for i, r in got.items()}
    (a, spaced), (b, bare) = shown[1]
    assert a == b == "card" and spaced.replace(" ", "") == bare and len(spaced) == 19
    assert "4111111111111112" in got[1]["text"] and "4111111111111111" not in got[1]["text"]
    digits = [int(c) for c in bare[::-1]]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    assert shown[2][0] == shown[2][1] and shown[2][2][0] == "ip" and len(shown[2]) == 3
    assert all(0 <= int(o) < 256 for o in shown[2][2][1].split("."))
    days = [v for _, v in shown[3]]
    assert len(days) == 4
    y, m, d = days[0].split("-")
    assert days[1:] == [f"{m}/{d}/{y}", f"{d}.{m}.{y}", f"{int(d)}.{int(m)}.{y}"]
    assert "1985-02-30" in got[3]["text"] and "0985-01-01" in got[3]["text"]
    assert [k for k, _ in shown[4]] == ["ssn"] and "000-12-3456" in got[4]["text"]
    kinds = [k for k, _ in shown[5]]
    assert kinds == ["phone", "card", "phone", "phone", "phone"]
    assert shown[5][0][1].startswith("+1 (") and shown[5][4][1].startswith("+49 ")
    assert got[6]["text"] == rows[5][1] and shown[6] == []
    assert all(got[i]["text"] != other[i]["text"] for i in range(1, 6))


def test_pseudonyms_are_permutations(spark):
    """A whole small domain maps onto itself, one to one."""
    pairs = spark.range(7 * 11).select((F.col("id") % 7).alias("l"), F.floor(F.col("id") / 7).alias("r"))
    done = pairs.select(pii.feistel(F.col("l"), F.col("r"), F.lit(7), F.lit(11), "k", "t").alias("s"))
    got = sorted((r["s"]["l"], r["s"]["r"]) for r in done.collect())
    assert got == [(a, b) for a in range(7) for b in range(11)]


def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held = F.xxhash64("doc_id") % 4 == 0
    model = toxicity.fit(docs, labels.where(~held))
    got = toxicity.score(docs.select("doc_id", "text"), model).join(labels.where(held), "doc_id")
    n = {(r["toxic"], r["rejected"]): r["n"] for r in got.groupBy("toxic", "rejected").agg(F.count("*").alias("n")).collect()}
    assert n.get((0, True), 0) <= 0.01 * n[(0, False)]
    assert n[(1, True)] >= 0.75 * (n[(1, True)] + n.get((1, False), 0))
    assert (np.diff(model.cuts) > 0).all()


def test_ordinal_gradient():
    """Fitted cuts and weights order three grades."""
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 3, 300)
    rows = [np.array([0]) for _ in grades]
    values = [np.array([g + 0.1 * rng.standard_normal()]) for g in grades]
    w, cuts = toxicity.fit_ordinal(rows, values, grades, 1)
    p = toxicity.Model({"x": 0}, w, cuts).grades(np.array([v[0] * w[0] for v in values]))
    assert (p.argmax(axis=1) == grades).mean() > 0.95
    assert p.sum(axis=1) == pytest.approx(np.ones(300))


def clustered(seed, n, dim=24):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 6, dim))
    v = centres[rng.integers(0, len(centres), n)] + 0.12 * rng.standard_normal((n, dim))
    v[:300] = centres[0] + 0.02 * rng.standard_normal((300, dim))  # denser than a window
    v[300:340] = v[0]
    return v


def test_near_vectors(spark):
    v = clustered(1, 3000)
    ids = list(range(10, 10 + len(v)))
    frame = spark.createDataFrame(list(zip(ids, v.tolist())), "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in dup.near_vectors(frame.repartition(4)).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    root = groups_of(len(v), [(int(a), int(b)) for a, b in zip(*np.nonzero(linked)) if a < b])
    wrong = sum(got[i]["component_id"] != ids[root[n]] for n, i in enumerate(ids))
    wrong += sum(got[i]["n_links"] != linked[n].sum() for n, i in enumerate(ids))
    assert wrong <= 2 and linked.sum() > 1000


def test_neighbours_recall(spark):
    v = clustered(2, 3000)
    frame = spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(frame).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hit = 0
    asked = range(0, len(v), 50)
    for q in asked:
        dots = u @ u[q]
        dots[q] = -9
        best = np.lexsort((np.arange(len(v)), -np.round(dots, 12)))[:5]
        assert len(got[q]) == 5
        assert all(s == pytest.approx(dots[i], abs=1e-12) for i, s in got[q])
        hit += len({i for i, _ in got[q]} & set(best.tolist()))
    assert hit >= 0.9 * 5 * len(asked)


def test_pipeline(spark):
    """run() is its stages one after the other, and every decision shows in the result."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        counts.append(rows)
    tox, unique, private, mixed = counts
    sets = [set(minhash.shingle_set(r["text"], 5).tolist()) for r in unique]
    for i, a in enumerate(sets):
        for b in sets[:i]:
            assert not a or 100 * len(a & b) < 80 * len(a | b)
    assert {r["doc_id"] for r in unique} <= {r["doc_id"] for r in tox}
    assert len(private) == len(unique)
    times = collections.Counter(r["doc_id"] for r in mixed)
    assert max(times.values()) <= 3
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert collections.Counter(r["doc_id"] for r in got) == times
    encoder = bpe._encoder(bpe.load_ranks(RANKS), public_tokenizers.PATTERN)
    text = {r["doc_id"]: r["text"] for r in private}
    for r in got:
        assert encoder.decode(r["ids"]).decode() == text[r["doc_id"]]
