"""Operators on a small awkward table, against plain Python."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corvane.llm import class_lm, graph, mixing, neighbours, pieces, quality_classifier, quality_rules, sharding, simhash, substring, token_files
from corvane.llm.queries import SQL

PASSAGE = " ".join(f"w{i}" for i in range(30))
TEXTS = [
    PASSAGE + " one two", "x y " + PASSAGE, None, "", "  \n\t", "a", "a b", "the cat " * 200, "the cat " * 200, "Zoë—漢字 🙂 # $ %",
    "x" * 5000 + " end", "line one\nline one\nline two", " ".join(f"u{i}" for i in range(60)), " ".join(f"u{i}" for i in range(59)) + " other",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, h long, key string, fp long, words int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "r", 1, "k", 2, 3) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, [(i, t, "hot" if i % 3 else None) for i, t in enumerate(TEXTS)])


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows and rows without an id."""
    return table(spark, [(1, PASSAGE, "a"), (1, PASSAGE, "a"), (None, PASSAGE, "b"), (None, None, None), (2, "b c d", "a")])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")


def collect(df):
    return sorted(df.collect(), key=lambda r: (r[0] is None, r[0] or 0))


def test_quality_rules(docs, odd, none, labels):
    for r in collect(quality_rules.judge(docs, labels)):
        t = TEXTS[r["doc_id"]] or ""
        w = t.encode().split()
        c = Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if c[g] > 1 for k in range(3)}
        assert (r["n_words"], r["n_repeat_words"]) == (len(w), len(covered))
        assert r["n_symbols"] == sum(map(t.count, "#*$%&|<>"))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r["kept"] and r["base_failed"])
    assert quality_rules.judge(odd, labels).count() == 5 and quality_rules.judge(none, labels).count() == 0
    assert quality_rules.keep_good(docs, labels.limit(0)).columns == docs.columns
    x = {f: np.zeros(300) for f in quality_rules.FEATURES} | {"symbols_per_word": np.r_[np.ones(100), np.zeros(200)]}
    rules = quality_rules.learn(x, np.r_[np.ones(100, bool), np.zeros(200, bool)])
    assert len(rules) == 1 and rules[0][0].feature == "symbols_per_word" and rules[0][0].above


def test_golay_keys_meet():
    rng = np.random.default_rng(1)
    f = rng.integers(0, 2**64, 300, dtype=np.uint64)
    for n in range(4):
        g = f.copy()
        for i in range(len(g)):
            for b in rng.choice(64, n, replace=False):
                g[i] ^= np.uint64(1) << np.uint64(b)
        (ra, ka), (rb, kb) = simhash.link_keys(f), simhash.link_keys(g)
        a, b = set(zip(ra.tolist(), ka.tolist())), set(zip(rb.tolist(), kb.tolist()))
        assert {r for r, _ in a & b} == set(range(300))


def test_simhash(spark, docs, odd, none):
    def plain(t):
        w = (t or "").encode().lower().split()
        grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    got = collect(simhash.near_duplicates(docs))
    fps = [plain(t) for t in TEXTS]
    assert [r["fingerprint"] for r in got] == [f"{f:016x}" for f in fps]
    root = list(range(len(fps)))
    for _ in fps:
        root = [min(root[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 3) for i in range(len(fps))]
    assert [r["component_id"] for r in got] == root
    assert [r["component_id"] for r in collect(simhash.near_duplicates(odd))].count(1) == 3
    assert simhash.near_duplicates(none).count() == 0
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == sorted(set(root))
    base = np.random.default_rng(0).integers(0, 2**64, dtype=np.uint64)
    near = sorted({int((base ^ np.uint64(1 << a)) ^ np.uint64(1 << b)) for a in range(12) for b in range(12)})
    fp = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(near)], "fp long, rep long")
    found = graph.components(simhash.links(fp, block_limit=8, block_size=4)).collect()
    assert len(found) == len(near) - 1 and {r["root"] for r in found} == {0}


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_substring(docs, odd, none, batches):
    def plain(texts):
        seen = set()
        for t in texts:
            w = (t or "").encode().split()
            gone = [False] * len(w)
            for k in range(len(w) - 19):
                key = tuple(w[k : k + 20])
                if key in seen:
                    gone[k : k + 20] = [True] * 20
                seen.add(key)
            yield len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()

    got = collect(substring.repeat_report(docs, batches))
    assert [tuple(r)[1:] for r in got] == list(plain(TEXTS))
    assert sorted(r["n_removed"] for r in substring.repeat_report(odd, batches).collect()) == [0, 0, 0, 30, 30]
    assert substring.repeat_report(none, batches).count() == 0
    assert substring.remove_repeats(docs, batches).columns == docs.columns


def test_substring_compaction(spark, docs):
    index = substring.SubstringIndex(spark, max_runs=2)
    found = {}
    for low in range(0, 14, 3):
        part = docs.where(f"doc_id >= {low} AND doc_id < {low + 3}")
        found |= {r["doc_id"]: len(r["starts"]) for r in index.ingest(part, docs.where(f"doc_id < {low}")).collect()}
    whole = {r["doc_id"]: len(r["starts"]) for r in substring.repeats(docs.select("doc_id", "text"), 1).collect()}
    assert found == whole and len(index.runs) <= 2


def test_mixing(docs, none):
    plan = mixing.make_plan({"a": 1000, "b": 100, None: 10, "z": 0})
    e = [plan.epochs(s) for s in ("a", "b", None)]
    assert min(e) == pytest.approx(1) and max(e) == pytest.approx(mixing.MAX_EPOCHS) and plan.weights["z"] == 0
    flat = mixing.make_plan({"a": 1000, "b": 100}, target_entropy=0.6)
    assert mixing.entropy(flat.weights) == pytest.approx(0.6, abs=1e-6)
    rows = mixing.report(docs).collect()
    assert {r["doc_id"] for r in rows} == set(range(len(TEXTS))) and max(r["epoch"] for r in rows) <= 1
    assert mixing.report(none).count() == 0 and mixing.realise(docs).columns == docs.columns


def test_pieces(docs, odd, none):
    import sentencepiece

    peer = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    got = collect(pieces.encode(docs))
    assert [r["ids"] for r in got] == [peer.encode(t or "") for t in TEXTS]
    assert all(r["round_trip"] for r in got) and not any(r["mended"] for r in got)
    assert pieces.encode(odd).count() == 5 and pieces.encode(none).count() == 0


def test_class_lm(docs, odd, none):
    got = collect(class_lm.score(docs, limit=20))
    tokens = [(t or "").encode().lower().split() + [None] for t in TEXTS]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(TEXTS))]
    c = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    for r, t, h in zip(got, tokens, held):
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (h, len(t), n)
        assert r["n_known"] == sum(c[w] > 0 for w in t)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
        assert r["score"] < 0
    assert class_lm.score(odd).count() == 5 and class_lm.score(none).count() == 0
    b = np.array([[0, 9, 0, 9], [9, 0, 9, 0], [0, 9, 0, 9], [9, 0, 9, 0]])
    c = class_lm.exchange(b, 2)
    assert c[0] == c[2] != c[1] == c[3]


def test_quality_classifier(spark, none, labels):
    rows = [(i, ("good words here and there " * 20 if i % 2 else "$$$ ### " * 30) + str(i), "s") for i in range(200)]
    docs = table(spark, rows)
    marks = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    got = quality_classifier.classify(docs, marks).collect()
    assert len(got) == 200 and all(r["predicted"] == r["doc_id"] % 2 and 0 <= r["score"] <= 1 for r in got)
    assert quality_classifier.classify(none, marks).count() == 0
    assert quality_classifier.classify(docs, marks.limit(0)).select("score").distinct().collect()[0][0] == 0.5


def test_sharding(docs, odd, none):
    got = collect(sharding.assign(docs))
    for r in got:
        t = (TEXTS[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(t) + 8, zlib.crc32(t))
        assert r["grown_shard"] in (r["shard"], sharding.SHARDS)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert sharding.assign(odd).count() == 5 and sharding.assign(none).count() == 0
    assert sharding.assign(docs, 2, [1.0, 0.0001]).where("shard = 1").count() <= 1


def test_token_files(spark, docs, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    peer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, at = collect(token_files.digest(docs)), 0
    for r, t in zip(got, TEXTS, strict=True):
        ids = np.array([*peer.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert tuple(r)[1:] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_files.digest(odd).count() == 5 and token_files.digest(none).count() == 0
    for n in (0, 1, 4096, 4097):
        ids = np.random.default_rng(n).integers(0, 65536, n)
        data = token_files.pack(np.arange(2), np.array([n, 0]), ids)
        assert (token_files.unpack(data)[2] == ids).all()
    broken = bytearray(data)
    broken[-3000] ^= 1
    with pytest.raises(ValueError):
        token_files.unpack(bytes(broken))


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 8)))]
    rows += [(1000 + i, rows[0][1]) for i in range(20)]
    bad = [(5000, None), (5050, [0.0] * 8), (5100, [float("nan")] * 8), (5150, [None] * 8), (None, rows[3][1])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
    got = neighbours.nearest(df).collect()
    x, ids = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = 0
    asked = [i for i in ids if i % 50 == 0]
    for q in asked:
        s = np.round(u @ u[list(ids).index(q)], 12)
        s[ids == q] = -9
        want = set(ids[np.lexsort((ids, -s))[:5]].tolist())
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        hit += len(want & {r["vec_id"] for r in mine})
    assert hit / (5 * len(asked)) >= 0.9
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_substring_sql(spark):
    from compare import connection, difference

    folder = "/root/testdata/sf0.001"
    df = substring.repeat_report(spark.read.parquet(f"{folder}/documents.parquet"))
    assert difference(df, connection(folder), SQL["op10_substring"]) == ""
