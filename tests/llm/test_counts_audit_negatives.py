"""Token counts against the library, the audit of filters and hard negatives against plain loops, on awkward rows."""

import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from compare import connection, difference
from tokenizers import Tokenizer

from corvane.llm import filter_audit, hard_negatives, token_counts
from corvane.llm.queries import QUERIES, SQL

SCHEMA = "doc_id long, text string, lang string, part string, mask int, digest string, first boolean, n_tokens long"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "d", True, 7) for r in rows], SCHEMA)


def library(texts):
    found = Tokenizer.from_file(token_counts.tokenizer_path()).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [len(e.ids) for e in found]


PIECES = [
    "'s", "'", "'ll", "'re", "'ve", "'S", "s", "t", "re", " ", "  ", "   ", "\n", "\t", "\r\n", "a", "b", "1", "23", "!", "é", "ع", "٥", "\xa0", "　", "<|endoftext|>", "<|endo", "|>",
    "日本", "🙂", "\x1c", "\x85", "aaaaaaaa", "zzz", "don't", "ﬁ", "​", "́", "\U000323b0", "՘", "\x00", "the ", " and",
]


def test_counts_are_the_librarys():
    rng = random.Random(5)
    c = token_counts.Counter(token_counts.tokenizer_path())
    for _ in range(40):
        texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(40))) for _ in range(60)]
        assert c.counts([t.encode() for t in texts]).tolist() == library(texts)
    long = ["ab" * 20_000, "x" * 30_001, "é" * 9_999, " " * 5_000 + "x", "\n" * 4_001, "".join(rng.choice("abcdefgh") for _ in range(8_000))]
    assert c.counts([t.encode() for t in long]).tolist() == library(long)
    # a special string does not grow together from two texts
    assert c.counts([b"<|endof", b"text|>"]).tolist() == library(["<|endof", "text|>"])


def test_counts_do_not_depend_on_what_is_known(monkeypatch):
    texts = [f"word{i} other{i % 7} <|endoftext|>" for i in range(300)]
    want = library(texts)
    monkeypatch.setattr(token_counts, "CACHE_BYTES", 2_000)
    c = token_counts.Counter(token_counts.tokenizer_path())
    got = [n for at in range(0, 300, 20) for n in c.counts([t.encode() for t in texts[at : at + 20]]).tolist()]
    assert got == want and len(c.known) < 200


def test_counts_of_a_table(spark):
    rows = [(1, "a b c", "en"), (1, "a b c", "en"), (None, None, None), (2, "", ""), (3, "word " * 3000, "fr"), (4, "x" * 100_000, None)]
    got = token_counts.count(table(spark, rows))
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(i, len((t or "").encode()), n, n > 1024) for (i, t, _), n in zip(rows, library([t for _, t, _ in rows]))]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert token_counts.count(table(spark, [])).count() == 0


def test_other_vocabularies_are_refused(tmp_path):
    from tokenizers import models

    Tokenizer(models.BPE({"a": 0}, [])).save(str(tmp_path / "t.json"))
    with pytest.raises(ValueError):
        token_counts.Counter(str(tmp_path / "t.json"))


def test_counts_of_whole_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip((r[0] for r in docs), library([r[1] for r in docs])))
    assert {r[0]: r[2] for r in QUERIES["op11_token_counts"](spark, folder).collect()} == want


def audited(rows, labels):
    """The audit in plain Python: (part, order, step) -> the seven counts."""
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    fails = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
        fails.append((lang or "", i, f + "E" * (i is not None and i > first[t])))
    out = {}
    for part in {p for p, *_ in fails}:
        own = [(i, f) for p, i, f in fails if p == part]
        gone_by = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                gone_by[f] += len(gone)
                out[part, order, step] = [f, len(left), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == f for x in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, _, _), row in out.items():
            if p == part:
                row.append(gone_by[row[0]])
    return {k: tuple(v) for k, v in out.items()}


NAMES = ["filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_against_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "PARTS", 1)  # sums leave a task early
    many = " ".join(f"w{i}" for i in range(300))
    texts = [many, many.upper(), "the cat " * 150, "a # b", None, "", many + " $", "Zoë 漢字 🙂", "\x0b\x0c\r", "X", many + " " + "end " * 400, "A" * 5000]
    rng = random.Random(3)
    rows = [(rng.choice([*range(40), None]), rng.choice(texts), rng.choice(["en", "fr", None, "", "ar"])) for _ in range(150)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, 2])) for i in range(30)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    got = filter_audit.audit(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in NAMES) for r in got.collect()}
    assert found == audited(rows, labels)
    assert len(found) == 4 * 600


def test_audit_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(table(spark, []), none).count() == 0
    assert filter_audit.audit(table(spark, [(1, "x", None)]), none).where("good_lost > 0 OR part <> ''").count() == 0


def mined(rows, every, low=50, high=95):
    """Hard negatives by plain loops over (vec_id, label, vector)."""
    once = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v) or len(v) != 4:
            continue
        q = [math.floor(256 * x) for x in v]
        if sum(x * x for x in q) < 2**62:
            once[i] = min(once.get(i, (label, q)), (label, q))
    out = []
    for a, (label, q) in once.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, w)), i, other == label) for i, (other, w) in once.items() if i != a)
        for s, p, _ in [x for x in scored if x[2]][:5]:
            met = [x for x in scored if not x[2] and low * -s <= 100 * -x[0] <= high * -s][:3]
            out += [(a, p, k, n, -s, -t) for k, (t, n, _) in enumerate(met, 1)]
    return sorted(out)


VECTORS = "vec_id long, label int, embedding array<double>, score long, v string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 3, "x") for r in rows], VECTORS)


def test_negatives_against_a_plain_loop(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(3)), [float(x) for x in rng.normal(size=4)]) for i in range(300)]
    rows += [(300 + i, i % 2, [0.5, 0.25, 0.0, -0.125]) for i in range(60)]  # ties
    rows += [(400, None, [1.0] * 4), (405, 1, None), (410, 1, [1.0, None, 0.0, 0.0]), (415, 1, [math.nan] * 4), (420, 1, [math.inf, 0.0, 0.0, 0.0]), (425, 1, [0.0] * 4), (430, 1, [1.0] * 3), (None, 1, [1.0] * 4)]
    rows += [(7, 2, [9.0] * 4), (7, 2, [9.0] * 4), (10, 0, [0.1] * 4)]  # ids that repeat
    want = mined(rows, 5)
    assert want
    assert sorted(map(tuple, hard_negatives.mine(vectors(spark, rows), 5).collect())) == want
    # anchors in many blocks
    assert sorted(map(tuple, hard_negatives.mine(vectors(spark, rows), 5, block_bytes=500).collect())) == want


def test_negatives_beyond_what_doubles_hold(spark):
    rows = [(i, i % 2, [float((2**20 + 3 * i) >> i % 2) * 1.5, float(i), 1.0 + i, 2.0]) for i in range(20)] + [(21, 1, [1e300, 0.0, 0.0, 0.0]), (22, 0, [float(2**18), 0.0, 1.0, 1.0]), (23, 1, [float(2**19), 1.0, 1.0, 1.0])]
    want = mined(rows, 2)
    assert max(abs(r[4]) for r in want) > 2**53
    assert sorted(map(tuple, hard_negatives.mine(vectors(spark, rows), 2).collect())) == want


def test_negatives_of_few_rows(spark):
    assert hard_negatives.mine(vectors(spark, [])).count() == 0
    assert hard_negatives.mine(vectors(spark, [(0, 1, [1.0] * 4)])).count() == 0
    assert hard_negatives.mine(vectors(spark, [(0, 1, []), (50, 1, [])])).count() == 0
    two = vectors(spark, [(0, 1, [1.0] * 4), (1, 1, [1.0] * 4), (2, 2, [0.75] * 4)])
    assert [tuple(r) for r in hard_negatives.mine(two).collect()] == [(0, 1, 1, 2, 4 << 16, 3 << 16)]


@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_hard_negatives"])
def test_query_equals_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    assert difference(QUERIES[name](spark, folder), connection(folder), SQL[name]) == ""
