"""Operators against plain Python versions of the same computation, on small tables."""

import math
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from test_near_copies import _kept

import corpus_pipeline
from corvane.llm import class_lm, mixing, neighbours, pieces, quality_classifier, quality_rules, sharding, substring

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").cache()


@pytest.fixture(scope="module")
def rows(documents):
    return [(r["doc_id"], r["text"] or "", r["source"]) for r in documents.orderBy("doc_id").collect()]


# op1


def _counts(t):
    words = t.encode().split()
    lines = [x for x in t.split("\n") if x.encode().split()]
    return len(words), len(b"".join(words).decode()), len(lines) - len(set(lines))


def test_every_statistic_and_verdict(spark, documents, rows):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rules = quality_rules.learn(*quality_rules.sample(documents, labels))
    got = {r["doc_id"]: r for r in quality_rules.judge(documents, labels).collect()}
    for doc_id, t, _ in rows:
        r = got[doc_id]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"]) == _counts(t)
        n_lines = sum(bool(x.encode().split()) for x in t.split("\n"))

        def share(a, b):
            return a / b if b else 0.0

        x = {
            "symbols_per_word": share(r["n_symbols"], r["n_words"]),
            "chars_per_word": share(r["word_chars"], r["n_words"]),
            "dup_lines_per_line": share(r["n_dup_lines"], n_lines),
            "repeat_share": share(r["n_repeat_words"], r["n_words"]),
            "upper_share": share(sum("A" <= c <= "Z" for c in t), r["word_chars"]),
            "bangs_per_word": share(t.count("!"), r["n_words"]),
            "n_words": float(r["n_words"]),
        }
        fired = next((i for i, rule in enumerate(rules, 1) if all((x[c.feature] > c.cut) == c.above for c in rule)), 0)
        assert r["rule"] == fired and r["kept"] == (not r["base_failed"] and not fired)


# op4


def _brute_score(texts, held, vocabulary, label, end):
    """log10 probabilities by dictionaries over tokens."""
    tokens = [[*t.encode().lower().split(), None] for t in texts]
    train = [w for ws, h in zip(tokens, held) if not h for w in ws]
    n = Counter(train)
    total, kinds = len(train), len(n)
    once = sum(v == 1 for w, v in n.items() if w is not None)
    mix = min(class_lm.MOST, class_lm.MIX + once / total)
    c = [int(label[vocabulary[w]]) for w in train]
    pairs = Counter(zip([int(label[end]), *c[:-1]], c))
    first = Counter()
    mass = Counter()
    for (a, b), k in pairs.items():
        first[a] += k
        mass[b] += k
    out = []
    for ws in tokens:
        before, s = int(label[end]), 0.0
        for w in ws:
            now = int(label[vocabulary[w]])
            q = (pairs[before, now] + class_lm.ADD) / (first[before] + class_lm.ADD * class_lm.CLASSES) / mass[now] if mass[now] else 0.0
            s += math.log10((1 - mix) * q * n[w] + mix * (n[w] + 1) / (total + kinds + 1))
            before = now
        out.append(s)
    return out


def test_class_scores(spark, monkeypatch):
    monkeypatch.setattr(class_lm, "UNITS", 6)
    texts = ["the cat sat on a mat", "the dog sat on a rug", "a cat ran", "a dog ran", "Zebra the end", "", "the cat sat on a rug the dog ran"] * 3
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3, "doc_id")
    words = Counter(w for t, h in zip(texts, held) if not h for w in t.encode().lower().split())
    vocabulary = class_lm.Vocabulary([w for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0]))[:9]])
    sc = spark.sparkContext
    train = docs.where("crc32(cast(cast(doc_id as string) as binary)) % 7 <> 2").select(F.col("text").cast("binary").alias("text"))
    sequences = train.mapInArrow(class_lm._sequences(sc.broadcast(vocabulary)), "ids binary")
    monkeypatch.setattr(class_lm, "_head", lambda counts, limit: [(w, words[w]) for w in list(vocabulary)[: vocabulary.head]])
    label, end = class_lm.cluster(sequences.cache(), vocabulary)
    monkeypatch.setattr(class_lm, "cluster", lambda *_: (label, end))
    got = {r["doc_id"]: r["score"] for r in class_lm.score(docs).collect()}
    # texts follow one another inside a task, each closed by the end, so the order of tasks does not matter
    for i, want in enumerate(_brute_score(texts, held, vocabulary, label, end)):
        assert got[i] == pytest.approx(want, abs=1e-6)


def test_scores_of_a_shuffled_table_are_those_of_the_scan(documents):
    plain = sorted(map(tuple, class_lm.score(documents).select("doc_id", "n_tokens", "n_known", "base_score").collect()))
    mixed = documents.dropDuplicates(["doc_id"]).repartition(32, "text").dropDuplicates(["doc_id"])
    again = sorted(map(tuple, class_lm.score(mixed).select("doc_id", "n_tokens", "n_known", "base_score").collect()))
    assert [x[:3] for x in plain] == [x[:3] for x in again] and np.allclose([x[3] for x in plain], [x[3] for x in again])


def test_classes_help_on_unseen_texts(spark):
    rng = np.random.default_rng(4)
    nouns, verbs = [f"n{i}" for i in range(60)], [f"v{i}" for i in range(60)]
    texts = [" ".join(x for _ in range(20) for x in ("the", rng.choice(nouns), rng.choice(verbs))) for _ in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sums = class_lm.score(docs).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert sums["s"] > sums["b"]


def test_a_word_moves_where_the_likelihood_is_best():
    rng = np.random.default_rng(0)
    n = rng.integers(5, 50, (class_lm.CLASSES, class_lm.CLASSES)).astype(float)
    left, right = np.zeros((1, class_lm.CLASSES)), np.zeros((1, class_lm.CLASSES))
    left[0, [3, 7]], right[0, [5, 9]] = (2, 1), (2, 2)
    n[0] += right[0]
    n[:, 0] += left[0]

    def likelihood(k):
        m = n.copy()
        m[0] -= right[0]
        m[:, 0] -= left[0]
        m[k] += right[0]
        m[:, k] += left[0]
        f = class_lm._f
        return f(m).sum() - f(m.sum(axis=1)).sum() - f(m.sum(axis=0)).sum()

    best = max(range(class_lm.CLASSES), key=likelihood)
    got = class_lm.best_classes(left, right, np.array([0]), n)[0]
    assert likelihood(got) >= likelihood(best) - 0.05


# op5


def test_isotonic_fit_and_ridge_weights():
    x, y = np.array([0.1, 0.4, 0.3, 0.8, 0.9]), np.array([0.0, 0.0, 1.0, 1.0, 1.0])
    at, value = quality_classifier.isotonic(x, y)
    assert value.tolist() == sorted(value.tolist())
    assert value.tolist() == pytest.approx([0.0, 0.5, 1.0]) and at.tolist() == pytest.approx([0.1, 0.35, 0.85])


def test_classifier_against_one_solve(spark):
    rows = [(i, ("good words here and there " * (5 + i % 9) if i % 2 else "$$$ ### " * (3 + i % 7)) + str(i)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    model = quality_classifier.fit(docs, marks)
    table = quality_rules.statistics(docs).select("doc_id", *quality_classifier._inputs()).toPandas().sort_values("doc_id")
    x, ids = table.iloc[:, 1:].to_numpy(dtype=float), table["doc_id"].to_numpy()
    learn = np.array([zlib.crc32(str(i).encode()) % 5 != 0 for i in ids])
    held = np.array([r[0] for r in docs.select(F.xxhash64("doc_id") % 3 == 0).collect()])
    train = learn & ~held
    z = model.cosines(x[train])
    want = np.linalg.solve(z.T @ z + quality_classifier.RIDGE * train.sum() / z.shape[1] * np.eye(z.shape[1]), z.T @ (ids[train] % 2).astype(float))
    assert model.raw(x) == pytest.approx(model.cosines(x) @ want, abs=1e-4)
    got = {r["doc_id"]: r for r in quality_classifier.classify(docs, marks).collect()}
    for i, s in zip(ids, model.score(x)):
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i]["score"] == pytest.approx(s, abs=1e-6) and got[i]["predicted"] == int(got[i]["score"] >= 0.3)


def test_large_and_missing_ids_come_back(spark):
    ids = [9007199254740993, 9007199254740995, None, 5, 5]
    docs = spark.createDataFrame([(i, None if k == 3 else "") for k, i in enumerate(ids)], "doc_id long, text string")
    got = quality_classifier.classify(docs, docs.selectExpr("doc_id", "1 AS quality").limit(0)).collect()
    assert sorted((r["doc_id"] or 0) for r in got) == sorted((i or 0) for i in ids)


# op6


def test_the_winning_shard(spark):
    ids = [0, 1, 17, 2**40, -5]
    docs = spark.createDataFrame([(i, "x") for i in ids], "doc_id long, text string")

    def best(i, n):
        def score(k):
            h = xxhash.xxh64_intdigest(struct.pack("<i", k), xxhash.xxh64_intdigest(struct.pack("<q", i), 42))
            return -1 / math.log(((h & ((1 << 53) - 1)) + 0.5) / (1 << 53))

        return max(range(n), key=lambda k: (score(k), -k))

    for r in sharding.assign(docs).collect():
        assert (r["shard"], r["grown_shard"]) == (best(r["doc_id"], 24), best(r["doc_id"], 25))


def test_slots_of_one_id_with_many_texts(spark):
    docs = spark.createDataFrame([(7, f"t{i}") for i in range(200)] + [(7, "same")] * 20, "doc_id long, text string")
    got = sharding.assign(docs).collect()
    assert len({r["shard"] for r in got}) == 1 and sorted(r["slot"] for r in got) == list(range(220))


# op7


def _mixed(rows):
    """{(doc_id, epoch)} that are read, by plain Python: (doc_id, source, words)."""
    tokens = Counter()
    for _, s, n in rows:
        tokens[s] += n
    plan = mixing.make_plan(dict(tokens))
    out = set()
    for s in tokens:
        e = plan.epochs(s)
        whole = math.floor(e + 1e-9)
        own = [(xxhash.xxh64_intdigest(struct.pack("<q", d), xxhash.xxh64_intdigest(struct.pack("<i", mixing.SEED), 42)) >> 1, d, n) for d, t, n in rows if t == s]
        out |= {(d, k) for _, d, _ in own for k in range(whole)}
        want, done = (e - math.floor(e)) * tokens[s], 0
        if e - math.floor(e) > 1e-9:
            for _, d, n in sorted(own):
                if done >= want:
                    break
                done += n
                out.add((d, whole))
    return out, plan


def test_epochs_blocks_and_shares(documents, rows):
    want, plan = _mixed([(d, s, len(t.encode().split())) for d, t, s in rows])
    got = mixing.report(documents).collect()
    assert {(r["doc_id"], r["epoch"]) for r in got} == want and len(got) == len(want)
    assert sum(plan.weights.values()) == pytest.approx(1)
    assert all(0 <= r["block"] < mixing.BLOCKS and r["weight"] == pytest.approx(plan.weights[r["source"]]) for r in got)


def test_mixing_of_awkward_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, "x y", None), (None, "", None), (2, "z " * 50, "b")], "doc_id long, text string, source string")
    got = mixing.report(docs).collect()
    assert Counter(r["doc_id"] for r in got if r["epoch"] == 0) == Counter({1: 2, None: 2, 2: 1})


# op9


def test_curves_find_near_vectors_exactly_scored(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16))
    x = np.concatenate([c + 0.2 * rng.normal(size=(40, 16)) for c in centres])
    x[1] = x[0]
    x[7] = 2 * x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, [1.0, 2.0]), (9050, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, size=16).collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    met = 0
    asked = range(0, 800, 50)
    for q in asked:
        s = u @ u[q]
        order = [int(i) for i in np.lexsort((np.arange(800), -np.round(s, 12))) if i != q][:5]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and all(r["score"] == pytest.approx(float(s[r["vec_id"]]), abs=1e-12) for r in mine)
        met += len(set(order) & {r["vec_id"] for r in mine})
    assert met / (5 * len(asked)) >= 0.9 and {r["query_id"] for r in got} == set(asked)
    first = sorted((r for r in got if r["query_id"] == 0), key=lambda r: r["rank"])
    assert [r["vec_id"] for r in first[:2]] == [1, 7]  # equal cosines, the smaller id first


def test_windows_shrink_where_vectors_have_structure(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([c + 0.01 * rng.normal(size=(60, 8)) for c in rng.normal(size=(30, 8))])
    found = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "rep long, v array<double>")
    curves = neighbours.cut(neighbours.fit(found.toPandas()), found, len(x), 16)
    probes = found.where("rep % 100 = 0").toPandas()
    true = found.mapInPandas(neighbours._nearest_all(probes, 5), "query_id long, rep long, score double, v array<double>")
    used, reach = neighbours.window_for(true, probes, curves)
    assert used * (2 * reach + 1) < (curves.cuts.shape[1] + 1) / 2  # fewer comparisons than half of an exact scan


# op2


def _field(number, kind, body):
    return bytes([number << 3 | kind]) + (bytes([len(body)]) + body if kind == 2 else body)


def _unigram_model(byte_fallback):
    """A small unigram model file, written by hand."""

    def piece(text, score, kind):
        return _field(1, 2, _field(1, 2, text.encode()) + _field(2, 5, struct.pack("<f", score)) + _field(3, 0, bytes([kind])))

    parts = [piece("<unk>", 0, 2), piece("<s>", 0, 3), piece("</s>", 0, 3)]
    parts += [piece(f"<0x{i:02X}>", -9.0, 6) for i in range(256)] if byte_fallback else []
    parts += [piece(t, -1.0 - k / 10, 1) for k, t in enumerate(["▁", "▁the", "▁cat", "c", "a", "t", "h", "e", "s", "at", "▁c"])]
    trainer = _field(3, 0, bytes([1])) + (bytes([35 << 3 & 0x7F | 0x80, 35 >> 4, 1]) if byte_fallback else b"")
    normal = _field(1, 2, b"identity") + _field(3, 0, bytes([1])) + _field(4, 0, bytes([1])) + _field(5, 0, bytes([1]))
    return b"".join(parts) + bytes([2 << 3 | 2, len(trainer)]) + trainer + bytes([3 << 3 | 2, len(normal)]) + normal


@pytest.mark.parametrize("fallback", [False, True])
def test_a_unigram_model(tmp_path, fallback):
    path = str(tmp_path / "m.model")
    (tmp_path / "m.model").write_bytes(_unigram_model(fallback))
    codec = pieces.Codec(path)
    assert codec.model.kind == pieces.UNIGRAM and codec.model.byte_fallback == fallback and not codec.segments
    texts = ["the cat", "  the   cats ", "", "at the chat", "cat"] + (["zé"] if fallback else [])
    rebuilt = [e.ids for e in codec.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert rebuilt == [codec.peer.encode(t) for t in texts]
    assert [x.tolist() for x in codec.encode([t.encode() for t in texts])] == rebuilt and not codec.odd
    assert codec.decode(codec.encode([t.encode() for t in texts])) == [codec.plain(t.encode()) for t in texts]


# op10


def test_an_index_is_opened_again(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(i, f"{passage} own{i}" if i % 2 else f"other{i} " * 5) for i in range(8)], "doc_id long, text string")
    first = substring.SubstringIndex(spark, max_runs=2)
    first.ingest(docs.where("doc_id < 4"))
    again = substring.SubstringIndex(spark, first.path, max_runs=2)
    assert again.runs == first.runs and again.made == first.made
    got = {r["doc_id"] for r in again.ingest(docs.where("doc_id >= 4"), docs.where("doc_id < 4")).collect()}
    assert got == {5, 7}


# pipeline


def test_pipeline_rows(spark, documents):
    import sentencepiece

    peer = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    good = [(r["doc_id"], r["text"] or "", r["source"]) for r in quality_rules.keep_good(documents, labels).orderBy("doc_id").collect()]
    kept = _kept([(d, t) for d, t, _ in good])
    seen, cleaned = set(), []
    for d, t, s in good:
        if d not in kept:
            continue
        w = t.encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(key)
        cleaned.append((d, b" ".join(x for x, g in zip(w, gone) if not g).decode() if any(gone) else t, s))
    read, _ = _mixed([(d, s, len(t.encode().split())) for d, t, s in cleaned])
    texts = {d: t for d, t, _ in cleaned}
    want = sorted((d, peer.encode(texts[d])) for d, _ in read)
    got = sorted((r["doc_id"], list(r["ids"])) for r in corpus_pipeline.run(spark, FOLDER).collect())
    assert got == want


AWKWARD = "doc_id long, text string, lang string, source string, `_once` string, `a.b` string, line long, `row` string, key string, `x``y` string"


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_every_stage_on_awkward_rows(spark, stage, tmp_path):
    long = "mot " * 1_300_000  # five MB
    rows = [(None, None, "en", None, "1", "2", 3, "4", "5", "6"), (1, "", "en", "a", None, None, None, None, None, None), (1, "a b", "en", "a", "1", "2", 3, "4", "5", "6"), (1, "a b", "en", "a", "1", "2", 3, "4", "5", "6"), (2, long, "en", "a", "1", "2", 3, "4", "5", "6"), (2**60, " ".join(f"u{i}" for i in range(80)), None, "b", "1", "2", 3, "4", "5", "6")]
    docs = spark.createDataFrame(rows, AWKWARD)
    folder = str(tmp_path)
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    step = dict(corpus_pipeline.STAGES)[stage]
    got = step(spark, docs, folder)
    found = got.collect()
    assert found and step(spark, docs.limit(0), folder).count() == 0
    if stage != "sentencepiece":
        assert got.columns == docs.columns
    kept = Counter(r["doc_id"] for r in found)
    if stage == "quality_rules":
        assert set(kept) == {2**60}
    if stage == "simhash_near_dedup":
        assert kept == Counter({1: 2, 2: 1, 2**60: 1})  # the empty text of id 1 stands for the missing one
    if stage in ("substring_dedup", "sentencepiece"):
        assert kept == Counter({None: 1, 1: 3, 2: 1, 2**60: 1})
    if stage == "source_mixing":
        assert set(kept) == {None, 1, 2, 2**60}



def test_buckets_fill_all_partitions(spark):
    numbers = substring.dealt_to(13)
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(numbers)], "part int, bucket int")
    assert df.repartition(13, "bucket").where(F.col("part") != F.spark_partition_id()).count() == 0
