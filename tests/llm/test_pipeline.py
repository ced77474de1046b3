"""Each stage of the corpus pipeline against brute force, on what the stage before kept, and on rows that are odd."""

import hashlib
import itertools
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

import corpus_pipeline as pipeline  # noqa: E402
from sparkloom.llm import mixing  # noqa: E402
from sparkloom.llm.bpe import load_ranks  # noqa: E402
from sparkloom.llm.simhash import shingle_set  # noqa: E402

SF = "/root/testdata/sf0.01"
STAGES = dict(pipeline.STAGES)


def words(t):
    return [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]


def good(t):
    """The default quality rules, spelt out."""
    w, t = words(t), t or ""
    c = Counter(zip(w, w[1:], w[2:]))
    repeated = {i + k for i, x in enumerate(zip(w, w[1:], w[2:])) if c[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if words(x)]
    chars = sum(map(len, w))
    return not (len(w) < 50 or 100 * len(repeated) > 50 * len(w) or 100 * sum(x in "#*$%&|<>" for x in t) > 10 * len(w) or 100 * (len(lines) - len(set(lines))) > 50 * len(lines) or chars > 15 * len(w) or chars < 2 * len(w))


def near_pairs(rows, least=0.8):
    """Pairs of texts whose five-word shingles have a Jaccard similarity of `least`, found among all pairs by size."""
    sets = sorted(((len(s), i, s) for i, s in ((i, shingle_set(t)) for i, t in rows)), key=lambda x: x[:2])
    for (n, i, a), (m, j, b) in itertools.combinations(sets, 2):
        if n >= least * m and (both := len(a & b)) >= least * (n + m - both):
            yield i, j


def least_of_groups(rows):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in near_pairs(rows):
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return sorted(i for i in root if find(i) == i)


def without_repeats(rows, window=35):
    c = Counter(tuple(w[j : j + window]) for _, t in rows for w in [words(t)] for j in range(len(w) - window + 1))
    out = {}
    for i, t in rows:
        w = words(t)
        gone = {j + k for j in range(len(w) - window + 1) if c[tuple(w[j : j + window])] > 1 for k in range(window)}
        text = " ".join(x for j, x in enumerate(w) if j not in gone) if gone else t
        if not gone or text:
            out[i] = text
    return out


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage keeps of a whole table."""
    from sparkloom.llm.common import documents, materialize

    docs, out = documents(spark, SF), {}
    out["documents"] = docs
    for name, stage in pipeline.STAGES[:-1]:
        out[name] = docs = materialize(stage(spark, docs, SF), name)
        assert docs.columns == list(pipeline.COLUMNS)
    return out


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").orderBy("doc_id").collect()]


def test_quality_stage(kept):
    assert texts(kept["quality_rules"]) == [x for x in texts(kept["documents"]) if good(x[1])]


def test_near_dedup_stage_and_its_recall(kept):
    before = texts(kept["quality_rules"])
    assert [i for i, _ in texts(kept["simhash_near_dedup"])] == least_of_groups(before)
    left = {i for i, _ in texts(kept["simhash_near_dedup"])}
    pairs = list(near_pairs(before))
    missed = [p for p in pairs if p[0] in left and p[1] in left]
    print(f"near-dedup of {len(before)} documents: recall {1 - len(missed) / max(1, len(pairs)):.3f} of {len(pairs)} pairs")
    assert pairs and not missed


def test_substring_stage(kept):
    assert dict(texts(kept["substring_dedup"])) == without_repeats(texts(kept["simhash_near_dedup"]))
    assert kept["substring_dedup"].filter("n_chars <> char_length(text)").join(kept["documents"].select("doc_id", F.col("n_chars").alias("n")), "doc_id").filter("n <> n_chars").count() == 0


def test_mixing_stage(kept):
    before, after = kept["substring_dedup"], kept["mixing"]
    texts_before = dict(texts(before))
    assert all(texts_before[i] == t for i, t in texts(after))
    a, b = (mixing.with_margins(x, []).toPandas() for x in (before, after))
    assert b.n_tokens.sum() == pytest.approx(0.9 * a.n_tokens.sum(), rel=0.1)
    want = a.groupby("lang").n_tokens.sum() ** 0.7
    got = b.groupby("lang").n_tokens.sum()
    assert all(abs(got[k] / got.sum() - v / want.sum()) < 0.05 for k, v in want.items())


def test_encoding_stage(spark, kept):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = sorted(tuple(r) for r in STAGES["byte_bpe"](spark, kept["mixing"], SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    want = []
    for i, t in texts(kept["mixing"]):
        ids = enc.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want)


def odd_rows():
    long = " ".join(f"w{i}" for i in range(40_000))
    one = " ".join(f"a{i}" for i in range(80))
    two = " ".join(f"b{i}" for i in range(80))
    return [(1, one, "en", "s", 1), (1, one, "en", "s", 1), (2, one, None, None, None), (3, None, "en", "s", None), (4, "", "en", None, 0), (5, long, "de", "s", 5), (None, two, "de", "s", 7), (None, two, "de", "s", 7), (6, two + " " + one, "de", "s", 8), (7, "x" * 300_000, "en", "s", 9)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", STAGES)
def test_stages_on_empty_tables(spark, name):
    out = STAGES[name](spark, spark.createDataFrame([], SCHEMA), SF)
    assert out.count() == 0 and (name == "byte_bpe" or out.columns == list(pipeline.COLUMNS))


@pytest.mark.parametrize(("name", "ids"), [
    ("quality_rules", [1, 1, 2, 5, 6, None, None]),  # texts of fewer than 50 words go, rows that repeat are judged alike
    ("simhash_near_dedup", [1, 3, 5, 6, 7, None, None]),  # copies and repeated ids go; a null text is like an empty one; rows without an id stay
    ("substring_dedup", [3, 4, 5, 7]),  # texts whose every word is in a repeated window go, with or without an id
    ("byte_bpe", [1, 1, 2, 3, 4, 5, 6, 7, None, None]),
])
def test_stages_on_odd_rows(spark, name, ids):
    """Nulls in any column, empty and long texts, repeated rows; columns with names that clash change nothing."""
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    out = STAGES[name](spark, docs, SF)
    assert sorted((r.doc_id for r in out.collect()), key=repr) == sorted(ids, key=repr)
    clashing = docs.withColumns({c: F.lit("x") for c in ("t", "k", "w", "row", "h", "fp", "kept", "spans", "chunk", "cell", "topic", "n", "ids", "d", "u")})
    again = STAGES[name](spark, clashing, SF)
    assert again.columns == out.columns and sorted(map(repr, again.collect())) == sorted(map(repr, out.collect()))


def test_mixing_on_odd_rows(spark):
    """Every row is drawn as often as its cell says; ties and nulls included."""
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    out = STAGES["mixing"](spark, docs, SF)
    assert {r.doc_id for r in out.collect()} <= {r[0] for r in odd_rows()} and out.columns == list(pipeline.COLUMNS)
