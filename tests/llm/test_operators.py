"""Each operator against brute force, the tokenizers library, held-out labels or its SQL, on small tables with odd rows."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(seed=7, n=120):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeoité") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    line = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage = line(70)
    out = []
    for i in range(n):
        t = line(rng.randrange(1, 160))
        if i % 6 == 0:
            t = f"{line(9)} {passage}\n{line(5)}"
        if i % 7 == 1 and out:
            words = rng.choice(out).split()
            words[rng.randrange(len(words))] = "changed"
            t = " ".join(words)
        if i % 11 == 2 and out:
            t = rng.choice(out).replace(" ", "  ", 1) + rng.choice(["", "\n", "\t "])
        out.append(t)
    out[3], out[4], out[5] = "", " \t\n", "one two"
    out.append(" ".join([passage, line(6000), passage]))
    return out


@pytest.fixture(scope="module")
def rows():
    r = [(i * 3, t) for i, t in enumerate(texts())]
    return [*r, (1000, None), (1001, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    data = [(i, t, "x", 0, i, "k") for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, i long, sid long, t string").repartition(5)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def components(ids, linked):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80), (2, 60)])
def test_ngram_jaccard(spark, docs, rows, k, percent):
    from lobspark.llm.op1_ngram_jaccard import jaccard_components

    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    ids = sorted(sets)
    pairs = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = components(ids, pairs)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs, k, percent).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in ids} and any(want[i] != i for i in ids)
    assert jaccard_components(empty(spark)).count() == 0


def test_ngram_jaccard_large_group(spark):
    """Over a thousand near copies share every tile; a chain links only through its neighbours."""
    from lobspark.llm.op1_ngram_jaccard import jaccard_components

    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    data = [(i, " ".join([*base, f"x{i}"])) for i in range(1300)] + [(None, " ".join(base))]
    out = jaccard_components(spark.createDataFrame(data, "doc_id long, text string"), 4, 85).collect()
    assert {r["component_id"] for r in out} == {0, None}
    run = [f"y{j}" for j in range(200)]
    chain = spark.createDataFrame([(j, " ".join(run[4 * j : 4 * j + 100])) for j in range(20)], "doc_id long, text string")
    assert {r["component_id"] for r in jaccard_components(chain, 4, 85).collect()} == {0}


def test_ngram_jaccard_stage_repeated_ids(spark):
    """Exactly one row of each component stays, whatever identifiers repeat; rows without words or identifier stay."""
    from lobspark.llm.op1_ngram_jaccard import jaccard_components, stage

    word = lambda k: " ".join(f"{k}{j}" for j in range(40))
    a, b, c = word("a"), word("b"), word("c")
    data = [(1, a, "1"), (2, a + " x", "2"), (9, a + " y", "9a"), (9, b, "9b"), (9, b, "9c"), (9, None, "9d"), (9, " ", "9e"), (10, b + " z", "10"), (None, a, "n"), (None, a, "m"), (3, c, "3"), (3, c + " q", "4"), (11, c, "11"), (12, "", "12")]
    docs = spark.createDataFrame(data, "doc_id long, text string, sid string").repartition(3)
    out = stage(spark, docs, "")
    got = sorted(out.collect(), key=lambda r: r["sid"])
    assert out.columns == docs.columns and all(tuple(r) in data for r in got)
    kept = [r["sid"] for r in got]
    assert set(kept) >= {"1", "9d", "9e", "n", "m", "12"} and not set(kept) & {"2", "9a", "10", "11"}
    assert len(set(kept) & {"9b", "9c"}) == 1 and len(set(kept) & {"3", "4"}) == 1 and len(kept) == 8
    found = jaccard_components(docs, 5, 80).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in found) == sorted([(1, 1), (2, 1), (9, 1), (9, 9), (9, 9), (9, 9), (9, 9), (10, 9), (0, 0), (0, 0), (3, 3), (3, 3), (11, 3), (12, 12)])


def test_substring_dedup(spark, docs, rows):
    from lobspark.llm.op2_substring_dedup import remove_repeats

    seen, want = {}, {}
    for i, t in sorted(rows):
        w = WORD.findall(t or "")
        gone = set()
        for s in range(len(w) - 49):
            if seen.setdefault(tuple(w[s : s + 50]), i) < i:
                gone.update(range(s, s + 50))
        want[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in remove_repeats(docs).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 500
    digests = {r["doc_id"]: r["kept_sha256"] for r in remove_repeats(docs, digest=True, shard_bytes=5000).collect()}
    assert digests == {i: hashlib.sha256(x[2].encode()).hexdigest() for i, x in want.items()}
    assert remove_repeats(empty(spark)).count() == 0


def test_substring_dedup_hot_anchor(spark, monkeypatch):
    """A line common to all documents, with other words around it, and copies of some."""
    from lobspark.llm import op2_substring_dedup

    monkeypatch.setattr(op2_substring_dedup, "HOT", 20)
    rng, line = random.Random(8), " ".join(f"c{k}" for k in range(30))
    own = [" ".join(f"w{rng.randrange(900)}" for _ in range(30)) + f" {line} " + " ".join(f"w{rng.randrange(900)}" for _ in range(30)) for _ in range(60)]
    data = [(i, own[i % 60] if i % 7 else f"{own[i % 60]} {own[(i + 1) % 60]}") for i in range(150)]
    seen, want = {}, {}
    for i, t in data:
        w, gone = t.split(), set()
        for s in range(len(w) - 49):
            if seen.setdefault(tuple(w[s : s + 50]), i) < i:
                gone.update(range(s, s + 50))
        want[i] = len(gone)
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["n_removed"] for r in op2_substring_dedup.remove_repeats(docs, shard_bytes=3000).collect()}
    assert got == want and sum(want.values()) > 1000


def test_substring_dedup_stage_repeated_ids(spark, rows):
    """Every row comes back once, with its own columns and text, whatever identifiers repeat or are null."""
    from lobspark.llm.op2_substring_dedup import stage

    passage = " ".join(f"p{k}" for k in range(55))
    data = [(1, f"one  {passage}", "a"), *((9, f"{w} {passage}\n{w}", w) for w in ("x", "y", "z")), (9, "own  text", "q"), (9, None, "n"), (None, f"null {passage}", "u"), (None, "", "v")]
    docs = spark.createDataFrame([(i, t, s, None if t is None else len(t)) for i, t, s in data], "doc_id long, text string, source string, n_chars int")
    out = stage(spark, docs.repartition(3), "")
    want = [(1, "one", "a", 3), *((9, f"{w} {w}", w, 3) for w in "xyz"), (9, "own  text", "q", 9), (9, None, "n", None), (None, f"null {passage}", "u", len(passage) + 5), (None, "", "v", 0)]
    key = lambda r: r[2]
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key) and out.columns == docs.columns and out.dtypes == docs.dtypes


def test_toxicity(spark):
    from lobspark.llm.op3_toxicity import fit, fold, toxicity

    rng = random.Random(3)
    syllables = ["ba", "do", "ri", "te", "mu", "sel", "nak"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    bad = ["grumpfel", "zorkwit", "blixnarg"]
    data, labels = [], []
    for i in range(600):
        words = [word() for _ in range(rng.randrange(5, 60))]
        if i % 4 == 0:
            b = rng.choice(bad)
            words.insert(rng.randrange(len(words)), rng.choice([b, b, b[:3] + "-" + b[3:], " ".join(b)]) + rng.choice(["", "."]))
        data.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    data += [(600, None), (601, ""), (None, "grumpfel"), (5, "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    model = fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = toxicity(docs, model).collect()
    assert len(out) == len(data) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] < 600 and r["doc_id"] != 5]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out if r["doc_id"] is not None)
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held) >= 0.97 * len(held)
    assert toxicity(empty(spark), model).count() == 0
    assert fit(docs, spark.createDataFrame([], "doc_id long, toxic int")) is None
    assert {r["score"] for r in toxicity(docs, None).collect()} == {0.0}
    assert fold("doc_id") is not None


def test_toxicity_kernel():
    """The textbook kernel by sums over all subsequences, uncut, and so without negative eigenvalues; other readings of words."""
    from itertools import combinations

    from lobspark.llm.op3_toxicity import DECAY, ORDER, POWER, Lexicon, Words, longer, plain

    def features(w):
        out = {}
        for at in combinations(range(len(w)), ORDER):
            u = tuple(w[x] for x in at)
            out[u] = out.get(u, 0) + DECAY ** (at[-1] - at[0] + 1)
        return out

    dot = lambda x, y: sum(v * y.get(u, 0) for u, v in x.items())
    rng = random.Random(2)
    marks = [plain(w) for w in ("idiot", "moron", "trash", "scum", "worthless")]
    words = [plain(w) for w in ("idixot", "mxoroxn", "txrxash", "scuxym", "mo1on", "été")]
    words += [plain("".join(rng.choice("idotmrnascuhwle") for _ in range(rng.randrange(2, 15)))) for _ in range(300)]
    got = Words(marks).rows(words)
    for w, row in zip(words, got):
        for m, v in zip(marks, row):
            x, y = features(w), features(m)
            assert abs(v - (dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5) ** POWER) < 1e-4
    some = words[:120]
    assert np.linalg.eigvalsh(Words(some).rows(some).astype(float)).min() > -1e-5
    weights = np.arange(5.0)
    assert np.allclose(Words(marks).sums(words, weights), got @ weights, atol=1e-4)
    assert plain("ixdxixoxt") == plain("i-d-i-o-t") == plain("idiot") and plain("moron") == "\1moron\2" and plain("") == "\1\2"
    assert len(longer("idiot", rng)) in (8, 9)
    ids, start, doc, pair, extra = Lexicon(marks, Words(marks).rows).read(["you id iot. so i d i o t", "", "x " * 100])
    assert doc.tolist() == [0, 0, 2] and start.tolist() == [0, 3, 5] and pair.tolist() == [1] and abs(extra[0, 0] - 1) < 1e-5
    assert len(Lexicon(marks, Words(marks).rows).read(["word " * 100])[1]) == 3


def test_toxicity_held_out(spark):
    """Found and spared in the held-out fold of a labelled table, as it is and with each plain insult bent."""
    from lobspark.llm.op3_toxicity import Scorer, fit, fold

    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = fit(docs, labels)
    held = docs.filter(fold("doc_id") == 0).join(labels, "doc_id").select("text", "toxic").collect()
    texts, y = [r["text"] or "" for r in held], np.array([r["toxic"] for r in held])
    score = Scorer(model).score(texts)
    found, spared = (score[y == 1] >= 0.5).mean(), (score[y == 0] < 0.5).mean()
    assert found >= 0.85 and spared >= 0.95, (found, spared)
    insult = re.compile(r"\b(trash|pathetic|idiot|worthless|stupid|clown|loser|scum|moron)\b", re.I)
    bad = [t for t, k in zip(texts, y) if k and insult.search(t)]
    for bend in (lambda w: w[:2] + "x" + w[2:], "-".join, " ".join, "x".join, lambda w: w[:2] + " " + w[2:]):
        assert (Scorer(model).score([insult.sub(lambda m: bend(m[0]), t) for t in bad]) >= 0.5).mean() >= 0.9


def test_exact_dedup(spark, docs, rows):
    from lobspark.llm.op4_exact_dedup import exact_dedup, stage

    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    want = {i: (min(g)[1], len(g), i == min(g)[1], hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for _, i in g}
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup(docs).collect()}
    assert got == want and len(groups) < len(rows)
    assert stage(spark, docs, "").count() == len(groups) and stage(spark, docs, "").columns == docs.columns
    assert exact_dedup(empty(spark)).count() == 0


def test_exact_dedup_repeated_ids(spark, monkeypatch):
    """Repeated and null identifiers, with equal and with different texts; then with digests that collide."""
    from pyspark.sql import functions as F

    from lobspark.llm.op4_exact_dedup import exact_dedup, stage

    data = [(7, "a b"), (7, "ab"), (7, "c"), (8, "c"), (9, "ab"), (None, "x"), (None, "y"), (None, " x"), (3, "y"), (5, "z"), (5, "z"), (5, "z"), (None, None), (None, "")]
    data = [(*r, k) for k, r in enumerate(data)]
    docs = spark.createDataFrame(data, "doc_id long, text string, k int").repartition(3)
    groups = {}
    for i, t, _ in data:
        groups.setdefault((t or "").replace(" ", ""), []).append((-len(t or ""), i is None, i))
    key = lambda r: tuple((v is not None, v) for v in r)
    want = sorted(((i, min(g)[2], len(g), i == min(g)[2]) for g in groups.values() for _, _, i in g), key=key)
    for collide in (False, True):
        if collide:
            monkeypatch.setattr(F, "sha2", lambda c, bits: F.lit("00" * 32))
        out = exact_dedup(docs).collect()
        assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in out), key=key) == want
        assert collide or {r["text_sha256"] for r in out} == {hashlib.sha256(t.encode()).hexdigest() for t in groups}
        left = stage(spark, docs, "").collect()
        assert sorted((r["text"] or "").replace(" ", "") for r in left) == sorted(groups)
        assert all((r["doc_id"], r["text"], r["k"]) in data for r in left)
        assert all((-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"]) == min(groups[(r["text"] or "").replace(" ", "")]) for r in left)


def test_exact_dedup_index(spark):
    """Runs of many memtables, merged: one entry a digest in ranges, found by lookup."""
    from pyspark.sql import functions as F

    from lobspark.llm.op4_exact_dedup import MergeIndex

    data = [(i % 40 if i % 9 else None, i % 7, hashlib.sha256(str(0 if i % 3 == 0 else i % 50).encode()).hexdigest()) for i in range(600)]
    log = spark.createDataFrame(data, "i long, n int, d string").repartition(23)
    index = MergeIndex(spark, 5).build(log)
    want = {}
    for i, n, d in data:
        want.setdefault(d, []).append((-n, i is None, i))
    got = {r["d"]: (r["keep"], r["n"], r["g"]) for r in index.entries.collect()}
    assert got == {d: (min(x)[2], -min(x)[0], len(x)) for d, x in want.items()}
    one = data[1][2]
    assert [r["d"] for r in index.lookup([one, "00" * 32]).collect()] == [one]
    spans = index.entries.groupBy(F.input_file_name().alias("f")).agg(F.min("d").alias("a"), F.max("d").alias("z")).orderBy("a").collect()
    assert len(spans) > 1 and all(x["z"] < y["a"] for x, y in zip(spans, spans[1:]))


def test_sharding(spark):
    """The law, sizes, slots; groups that fit a shard stay whole, also with repeated and null ids and clashing columns."""
    from lobspark.llm.op5_sharding import balanced_shards, cut_edges

    rng = random.Random(4)
    data = [(i, "hot" if i % 3 == 0 else f"pair {i // 4}" if i % 5 else f"own {i}") for i in range(700)] + [(None, None), (7, None), (7, "")]
    data += [(1000 + i, f"group {rng.randrange(40)}") for i in range(300)] + [(2000 + i, "large") for i in range(80)] + [(None, "none")] * 30 + [(3000, "long " * 50_000)]
    data += [(5000 + i, f"single {i}") for i in range(600)]
    docs = spark.createDataFrame([(i, t, "g", 1, 2) for i, t in data], "doc_id long, text string, g string, shard int, n int").repartition(5)
    result = balanced_shards(docs, shards=8)
    out = result.collect()
    assert len(out) == len(data)
    by, shards_of, size_of = {}, {}, {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
        shards_of.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
        size_of[r["text_crc32"], r["size"]] = size_of.get((r["text_crc32"], r["size"]), 0) + 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and len(by) == 8
    key = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    want = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in data]
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in out), key=key) == sorted(want, key=key)
    split = [size_of[g] for g, s in shards_of.items() if len(s) > 1]
    assert split == [234], split  # the hot group alone, which is larger than a shard
    assert tuple(cut_edges(result).first())[:2] == (sum(n > 1 for n in size_of.values()), 1)
    assert balanced_shards(empty(spark)).count() == 0
    assert sorted(r["slot"] for r in balanced_shards(spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "doc_id long, text string")).collect()) == [0, 0, 0]


def test_sharding_keeps_groups(spark):
    """On the tables: no group in several shards."""
    from lobspark.llm.op5_sharding import cut_edges, query

    for sf in ("sf0.001", "sf0.01"):
        r = cut_edges(query(spark, f"/root/testdata/{sf}")).first()
        assert r["groups"] > 5 and r["split"] == 0 == r["cut"], (sf, r)


def tokenizer(name):
    from tokenizers import Tokenizer

    from lobspark.llm.op10_bpe import vocabulary

    return Tokenizer.from_file(vocabulary(name))


ODD = ["It's THE end'LL ok", "a  b\n\n c\t", "naïve Ünïcode façade 日本語 № 5½", "é combine ẛ", "x<|endoftext|>y <|startoftext|> z", "\x1c\x1f\x85\xa0 nb sp", "😀😀 12345 6.7e8 --==", "a" * 300, "\0nul\0", "ﬁ ² ³ ª º µ"]


def test_token_files(spark, rows, tmp_path):
    from lobspark.llm.op6_token_binary import read_token_files, sequence, write_token_files
    from lobspark.llm.op10_bpe import vocabulary

    data = [*rows, *((2000 + k, t) for k, t in enumerate(ODD))]
    t, at, want, ids = tokenizer("word_bpe_49k.json"), 0, {}, []
    for i, x in sorted(data):
        e = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want[i] = (at, len(e), zlib.crc32(np.array(e, "<u4").tobytes()))
        ids += e
        at += len(e)
    url = f"file://{tmp_path}/tokens"
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    parts = write_token_files(docs, vocabulary("word_bpe_49k.json"), url, length=64)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in read_token_files(spark, url).collect()} == want
    back = []
    for p in sorted(parts.collect()):
        for k in range(p["sequences"]):
            s, m = sequence(url, p["part"], k)
            assert len(s) == 64
            back += s[m].tolist()
    assert back == ids
    write_token_files(empty(spark), vocabulary("word_bpe_49k.json"), f"{url}2")
    assert read_token_files(spark, f"{url}2").count() == 0


def test_embeddings(spark):
    from lobspark.llm.op7_embedding_neardup import embedding_links

    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    hot = rng.normal(size=(1, 16)) + rng.normal(scale=0.34, size=(60, 16))  # many pairs on either side of the threshold
    x = np.concatenate([base, base[:15] + rng.normal(scale=0.12, size=(15, 16)), base[:1].repeat(9, 0), base[3:4] * 2.5, hot, base[5:6] * 1e200, base[6:7] * 1e-200])
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, None), (201, [0.0] * 16), (202, [float("nan")] * 16), (203, [1.0, None]), (204, [1.0, 2.0]), (205, [])]
    scaled = x / np.abs(x).max(1)[:, None]
    u = scaled / np.sqrt((scaled * scaled).sum(1))[:, None]
    link = (u @ u.T) >= 0.9
    np.fill_diagonal(link, False)
    comp = components(range(len(x)), zip(*np.nonzero(link)))
    want = {i: (int(link[i].sum()), comp[i], comp[i] == i) for i in range(len(x))} | {i: (0, i, True) for i in range(200, 206)}
    near = np.abs(u @ u.T - 0.9)[np.triu_indices(len(x), 1)]
    assert link.any() and near.min() > 1e-9 and (near < 0.01).any()
    for block in (16, None):
        rows = spark.createDataFrame([(*r, 1, 2, "c") for r in data], "vec_id long, embedding array<double>, rep long, n int, v string").repartition(3)
        out = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_links(rows, block=block).collect()}
        assert out == want
    assert embedding_links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted((r["vec_id"] or 0, r["n_links"]) for r in embedding_links(twice).collect()) == [(0, 0), (1, 0), (1, 1), (1, 1)]


@pytest.mark.parametrize("d", [3, 64, 1500, 4096])
def test_embedding_bounds(d):
    """Estimates stay within their errors, also where sums pass 2**24."""
    from lobspark.llm.op7_embedding_neardup import bounds, quantise

    rng = np.random.default_rng(d)
    x = np.concatenate([rng.normal(size=(30, d)), rng.choice([-1.0, 1.0], size=(10, d)), np.abs(rng.normal(size=(10, d))) ** 8])
    u, *codes = quantise(x)
    for at, about, error in bounds(codes, codes, False):
        assert (np.abs(about - u[at : at + len(about)] @ u.T) <= error).all()


def test_license_scan(spark, rows):
    from lobspark.llm.op8_license_scan import license_scan

    extra = ["CC-BY 4.0, all rights\nreserved.", "licensed under the apachee licence", "al rights reserved", "General  Public/License general public license", "écc by x", "cc byé cc", "nothing here"]
    data = [*rows, *((3000 + k, t) for k, t in enumerate(extra))]
    out = {r["doc_id"]: r for r in license_scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in data:
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at, labels = [], set()
        for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
            p = phrase.split()
            found = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            at += found
            labels |= {label} if found else set()
        r = out[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(at), ",".join(sorted(labels)))
        assert (r["first_word"], r["last_word"]) == ((min(at), max(at)) if at else (None, None))
        assert labels <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert out[3001]["labels"] == "apache" and out[3001]["spans"][0]["edits"] == 2 and "reserved" in out[3002]["labels"] and out[3006]["labels"] == ""
    assert license_scan(empty(spark)).count() == 0


def test_license_scan_long_gaps(spark):
    """Gaps of any length between words, with spans in the text's own characters."""
    from lobspark.llm.op8_license_scan import license_scan

    gap = "\n#" + 40 * " "
    data = [(0, f"é all rigts{gap}resrved"), (1, f"al{gap * 50}rights reservd."), (2, f"{gap}gnu  {gap}generl public licence"), (3, f"all{gap}rights")]
    out = {r["doc_id"]: r for r in license_scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert [out[i]["labels"] for i in range(4)] == ["reserved", "reserved", "gpl", ""]
    (x,), (y,) = out[0]["spans"], out[1]["spans"]
    assert data[0][1][x["start"] : x["end"]] == f"all rigts{gap}resrved" and x["edits"] == 2
    assert data[1][1][y["start"] : y["end"]] == f"al{gap * 50}rights reservd" and y["edits"] == 2


def test_license_scan_all_spans():
    """Misspelt notices before a better one are reported, and a best match isn't widened by its neighbours."""
    from lobspark.llm.op8_license_scan import BASE, NOTICES, Scanner

    said = ["all rigts resrved", "all rights reserved", "al rights reserved", "all rights resevd", "all rights reserved"]
    text = " yy zz ".join(said)
    found = [f for f in Scanner(BASE, NOTICES).notices(text) if f[0] == "reserved"]
    assert [text[a:z] for _, a, z, _ in found] == said and [e for *_, e in found] == [2, 0, 1, 2, 0]


def test_license_scan_long_text(spark):
    """Time grows with a text's length, frames lose nothing, and null or repeated ids and clashing columns don't matter."""
    import time

    from lobspark.llm.op8_license_scan import BASE, NOTICES, Scanner, license_scan

    began = time.time()
    found = Scanner(BASE, NOTICES).notices("general publik licens " * 20_000)
    assert sum(f[0] == "gpl" for f in found) >= 20_000 and time.time() - began < 60
    rng, said = random.Random(9), ["all rigts resrved", "al rights reserved", "all rights reserved", "gnu general publik licence", "mozila public license"]
    words = ["filler", "all", "rights", "publ", "x", "license"]
    for _ in range(20):
        text = " ".join(rng.choice(said) if rng.random() < 0.1 else rng.choice(words) for _ in range(400))
        whole, framed = Scanner(BASE, NOTICES), Scanner(BASE, NOTICES)
        whole.matches = lambda k, t, a, b, of=whole: of.framed(k, t, a, b)
        at = lambda s: sorted(f for f in s.notices(text) if f[3] == 0)
        assert at(framed) == at(whole) and {f[0] for f in framed.notices(text)} == {f[0] for f in whole.notices(text)}
    data = [(1, "all rigts resrved", "spans", 1), (1, None, "s", 2), (None, "CC BY", "t", 3)]
    out = license_scan(spark.createDataFrame(data, "doc_id long, text string, labels string, n_words int")).collect()
    assert sorted((r["doc_id"] or 0, r["labels"], r["n_words"]) for r in out) == [(0, "cc-by", 2), (1, "", 0), (1, "reserved", 3)]


def test_packing(spark, rows):
    from lobspark.llm.op9_packing import pack
    from lobspark.llm.op10_bpe import vocabulary

    t, path = tokenizer("word_bpe_49k.json"), vocabulary("word_bpe_49k.json")
    data = [*rows, *((2000 + k, x) for k, x in enumerate(ODD))]
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in data}
    out = pack(spark.createDataFrame(data, "doc_id long, text string").repartition(4), path, length=128, with_ids=True).collect()
    parts, rooms = {}, {}
    for r in out:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        parts.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
        rooms.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert {i: sum((p for _, p in sorted(x)), []) for i, x in parts.items()} == ids
    for s, room in rooms.items():
        at = 0
        for offset, n in sorted(room):
            assert offset == at
            at += n
        assert at == 128 or s == max(rooms)
    assert sorted(rooms) == list(range(len(rooms))) and pack(empty(spark), path).count() == 0


@pytest.mark.parametrize("name", ["toxicity", "token files", "packing", "bpe"])
def test_clashing_columns_and_repeated_ids(spark, tmp_path, name):
    """Columns named as the operators' own, identifiers that repeat or are null, ties, and a very long text: one result a row."""
    from lobspark.llm import op3_toxicity, op6_token_binary, op9_packing, op10_bpe

    long = " ".join(f"word{k % 977}" for k in range(60_000))
    data = [(1, "one two", 1, "i", 0.5), (1, "one two", 2, "t", 0.5), (1, "three", 3, "ids", 0.0), (None, "four", 4, "n", 0.1), (None, None, 5, "part", 0.2), (2, "", 6, "before", 0.3), (3, long, 7, "start", 0.4)]
    docs = spark.createDataFrame(data, "doc_id long, text string, n int, ids string, score double").repartition(3)
    texts = sorted((str(i), t or "") for i, t, *_ in data)
    if name == "toxicity":
        model = op3_toxicity.train(["bad grumpfel here", "so zorkwit", "grumpfel zorkwit"] * 4 + ["all is well", "fine day", "three"] * 4, [1] * 12 + [0] * 12)
        out = op3_toxicity.toxicity(docs, model).collect()
        assert sorted(str(r["doc_id"]) for r in out) == [i for i, _ in texts] and all(0 <= r["score"] <= 1 for r in out)
        assert len({r["score"] for r in out if r["doc_id"] == 1}) <= 2
        return
    t = tokenizer("byte_bpe_50k.json" if name == "bpe" else "word_bpe_49k.json")
    ids = {x: t.encode(x, add_special_tokens=False).ids for _, x in texts}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    if name == "bpe":
        out = op10_bpe.bpe_digest(docs, op10_bpe.vocabulary("byte_bpe_50k.json")).collect()
        sha = lambda x: hashlib.sha256(x).hexdigest()
        want = [(i, len(ids[x]), sha(np.array(ids[x], "<u4").tobytes()), sha(t.decode(ids[x], skip_special_tokens=False).encode())) for i, x in texts]
        assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out) == sorted(want)
    elif name == "packing":
        out = op9_packing.pack(docs, op10_bpe.vocabulary("word_bpe_49k.json"), length=100_000).collect()
        whole = [(str(r["doc_id"]), r["doc_tokens"], r["ids_crc32"]) for r in out if r["length"] == r["doc_tokens"]]
        want = [(i, len(ids[x]) + 1, crc([*ids[x], 1])) for i, x in texts]
        assert sum(r["length"] for r in out) == sum(n for _, n, _ in want) and set(whole) <= set(want) and len(whole) >= 6
    else:
        url = f"file://{tmp_path}/tokens"
        op6_token_binary.write_token_files(docs, op10_bpe.vocabulary("word_bpe_49k.json"), url)
        out = op6_token_binary.read_token_files(spark, url).collect()
        assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in out) == sorted((i, len(ids[x]) + 1, crc([*ids[x], 2])) for i, x in texts)
        at = 0
        for r in sorted(out, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["n_tokens"]


def test_bpe(spark, rows):
    from lobspark.llm.op10_bpe import bpe_decode, bpe_digest, bpe_encode, vocabulary

    t, path = tokenizer("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.json")
    data = [*rows, *((2000 + k, x) for k, x in enumerate(ODD))]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    encoded = bpe_encode(docs, path)
    got = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in data}
    assert {r["doc_id"]: r["decoded"] for r in bpe_decode(encoded, path).collect()} == {i: t.decode(got[i], skip_special_tokens=False) for i, _ in data}
    for r in bpe_digest(docs, path).collect():
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(got[r["doc_id"]], skip_special_tokens=False).encode()).hexdigest()
        assert r["n_tokens"] == len(got[r["doc_id"]]) and r["ids_sha256"] == hashlib.sha256(np.array(got[r["doc_id"]], "<u4").tobytes()).hexdigest()
    assert bpe_digest(empty(spark), path).count() == 0


@pytest.mark.parametrize("name", ["op1_ngram_jaccard", "op2_substring_dedup", "op4_exact_dedup", "op7_embedding_neardup"])
def test_oracle(spark, name):
    from lobspark import llm

    d = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for table in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{d}/{table}.parquet')")
    got = llm.queries()[name](spark, d)
    want = db.execute(llm.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(want.fetchall())


def test_pipeline(spark, tmp_path):
    """Every stage against brute force on what its predecessor kept, with repeated and null identifiers and null texts."""
    from itertools import combinations

    import corpus_pipeline
    from lobspark.llm import op3_toxicity as toxic
    from lobspark.llm.op10_bpe import vocabulary

    rng = random.Random(6)
    syllables = ["ba", "do", "ri", "te", "mu", "sel", "nak", "Fo"]
    line = lambda n: " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(n))
    passage, data = line(60), []
    for i in range(160):
        t = line(rng.randrange(8, 70)) + rng.choice([".", "", "!"])
        if i % 4 == 0:
            words = t.split()
            for _ in range(max(1, len(words) // 20)):
                words.insert(rng.randrange(len(words)), rng.choice(["grumpfel", "zorkwit", "blixnarg"]))
            t = " ".join(words)
        elif i % 9 == 1:
            t = f"{t} {passage} {line(30)}"
        elif i % 9 == 2 and data:
            t = (data[-1][1] or "") + rng.choice(["  ", "\n", " "])
        elif i % 9 == 3 and data and data[-2][1]:
            t = data[-2][1] + " extra"
        data.append((i, t))
    clean = [t for i, t in data if i % 4 and t]
    data += [(7, clean[3]), (7, line(20)), (13, clean[5]), (None, clean[4]), (None, line(25)), (None, None), (500, None), (501, ""), (502, " \n")]
    rows = [(i, t, "en", f"s{k}", None if t is None else len(t)) for k, (i, t) in enumerate(data)]
    d = str(tmp_path / "in")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(160)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = toxic.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))

    def features(w):
        out = {}
        for at in combinations(range(len(w)), toxic.ORDER):
            u = tuple(w[x] for x in at)
            out[u] = out.get(u, 0) + toxic.DECAY ** (at[-1] - at[0] + 1)
        return out, None

    marks, known = [features(m)[0] for m in model.landmarks], {}

    def worth(w):
        if w not in known:
            x = features(w)[0]
            own = sum(v * v for v in x.values())
            known[w] = 0.0
            for m, weight in zip(marks, model.weights):
                dot = sum(v * m.get(u, 0) for u, v in x.items())
                known[w] += weight * (dot / (own * sum(v * v for v in m.values())) ** 0.5) ** toxic.POWER if len(w) > toxic.ORDER else 0
        return known[w]

    def score(t):
        words, margins, now = (t or "").lower().split(), [], []
        for k, w in enumerate(words):
            now.append(w)
            if w[-1] in ".!?" or len(now) == toxic.SENTENCE or k == len(words) - 1:
                m = model.bias + sum(worth(toxic.plain(w)) for w in now)
                for x, y in zip(now, now[1:]):
                    x, y = toxic.plain(x)[1:-1], toxic.plain(y)[1:-1]
                    if x and y and any((w[1], w[-2], len(w) - 2) == (x[0], y[-1], len(x) + len(y)) for w in model.landmarks):
                        m += worth(f"\1{x}{y}\2")
                margins.append(m)
                now = []
        over = sum(max(0, m - toxic.OVER) for m in margins)
        z = [min(2, max(-2, max(margins, default=model.bias))), np.log1p(over), np.log(1e-3 + over / max(1, len(words)))]
        return 1 / (1 + np.exp(-(np.dot(z, model.final[:-1]) + model.final[-1])))

    space, least = re.compile(r"[\x20\x09-\x0D]"), lambda r: (r[0] is None, r[0] or 0)

    def exact(rows):
        groups = {}
        for r in rows:
            groups.setdefault(space.sub("", r[1] or ""), []).append(r)
        return [[r for r in g if (-len(r[1] or ""), least(r)) == min((-len(q[1] or ""), least(q)) for q in g)] for g in groups.values()]

    def near(rows):
        sets = []
        for r in rows:
            w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
            sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
        able = [k for k, s in enumerate(sets) if s and rows[k][0] is not None]
        linked = [(a, b) for a, b in combinations(able, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        comp = components(range(len(rows)), linked)
        groups = {}
        for k in range(len(rows)):
            groups.setdefault(comp[k], []).append(rows[k])
        return [[r for r in g if least(r) == min(map(least, g))] for g in groups.values()]

    def cut(rows):
        seen, out = {}, []
        for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
            w, gone = WORD.findall(r[1] or ""), set()
            for s in range(len(w) - 49):
                first = seen.setdefault(tuple(w[s : s + 50]), r[0])
                if first != r[0]:
                    gone.update(range(s, s + 50))
            kept = " ".join(x for j, x in enumerate(w) if j not in gone) if gone else r[1]
            out.append((r[0], kept, r[2], r[3], len(kept) if gone else r[4]))
        return out

    key = lambda r: r[3]
    before = [tuple(r) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, d).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = [tuple(r) for r in docs.collect()]
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "toxicity":
            want = [r for r in before if score(r[1]) < 0.5]
            assert sorted(after, key=key) == sorted(want, key=key) and len(want) < len(before) - 25
            assert not any(x in (r[1] or "") for r in after for x in ("grumpfel", "zorkwit", "blixnarg"))
        elif name == "substring_dedup":
            assert sorted(after, key=key) == sorted(cut(before), key=key) and any(len(a[1] or "") < len(b[1] or "") for a, b in zip(sorted(after, key=key), sorted(before, key=key)))
        else:
            groups = (exact if name == "exact_dedup" else near)(before)
            assert len(after) == len(groups) < len(before)
            assert all(sum(r in after for r in g) == 1 for g in groups)
        before = after
    tokens, pieces = tokenizer("word_bpe_49k.json"), corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    ids = [(r[0], [*tokens.encode(r[1] or "", add_special_tokens=False).ids, 1]) for r in before]
    assert sum(p["length"] for p in pieces) == sum(len(x) for _, x in ids) and vocabulary("word_bpe_49k.json")
    assert sum(p["start"] == 0 for p in pieces) == len(before)
    for p in pieces:
        assert any(i == p["doc_id"] and len(x) == p["doc_tokens"] and zlib.crc32(np.array(x[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) == p["ids_crc32"] for i, x in ids)
    rooms = {}
    for p in pieces:
        rooms[p["sequence_id"]] = rooms.get(p["sequence_id"], 0) + p["length"]
    assert all(n == 2048 for s, n in rooms.items() if s < max(rooms))
    assert corpus_pipeline.run(spark, d).count() == len(pieces)


def test_pipeline_empty(spark, tmp_path):
    import corpus_pipeline

    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
