"""The training-data operators on small tables, against brute force; nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from sparkloom.llm import bpe, language, merkle, mixing, quality, simhash, substring_trees, suffix_array, token_counts, token_files  # noqa: E402
from sparkloom.llm.bpe import load_ranks  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BPE = P.path("byte_bpe_multi_50k.tiktoken")
RNG = np.random.default_rng(7)
LEXICON = ["".join(RNG.choice(list("abcdefghijklmnop"), 5)) for _ in range(300)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(LEXICON, n))


BASE = prose(160, 1)
PASSAGE = prose(60, 2)
NEAR = BASE.split()
NEAR[40] = "changed"
TEXTS = [
    (0, BASE), (1, BASE), (2, " ".join(NEAR)), (3, prose(30, 3) + " " + PASSAGE + " " + prose(50, 4)), (4, prose(44, 5) + " " + PASSAGE), (5, None), (6, ""), (7, "   \n\t "), (8, "É à b  c\n\n d"), (9, prose(3000, 6)),
    (10, "a b"), (11, "x " * 200), (12, PASSAGE + "\n" + PASSAGE), (13, "# * $ % & | < > " * 20 + prose(40, 8)), (14, "line one two\n" * 60), (15, prose(90, 9) + " " + PASSAGE[:70]),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i == 3 else "en", None if i == 4 else f"s{i % 3}", None if t is None else len(t)) for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def clashing(docs):
    """Columns named like results and helpers."""
    return docs.withColumns({c: F.lit("x") for c in ("n_words", "kept", "spans", "t", "k", "h", "fp", "th", "w", "ids", "chunk", "block", "next", "prob", "topic", "component_id", "n_tokens", "edits2", "score", "row")})


def got(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def words(t):
    return [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]


TABLES = {
    "op1": lambda d: simhash.near_dedup_table(d), "op2": lambda d: bpe.digest_table(d, BPE, P.PATTERN), "op3": lambda d: token_files.token_file_table(d, P.path("byte_bpe_50k.json")),
    "op4": lambda d: token_counts.token_count_table(d, BPE, P.PATTERN), "op5": lambda d: language.language_table(d, P.path("piece_bpe_32k.model"), 50), "op6": lambda d: quality.quality_table(d),
    "op7": lambda d: substring_trees.removal_table(d), "op8": lambda d: merkle.fingerprint_table(d), "op9": lambda d: suffix_array.removal_table(d), "op10": lambda d: mixing.mixing_table(d),
}


@pytest.mark.parametrize("op", TABLES)
def test_shapes(op, docs, empty, clashing):
    """An empty table gives an empty result; other columns change nothing; every row gets a row, also with null and repeated ids."""
    assert TABLES[op](empty).count() == 0
    plain = TABLES[op](docs)
    assert plain.columns[0] == "doc_id" and plain.count() == len(TEXTS)
    assert got(TABLES[op](clashing), *plain.columns) == got(plain, *plain.columns)
    twice = docs.unionAll(docs.filter("doc_id in (0, 6)")).unionAll(docs.filter("doc_id = 2").withColumn("doc_id", F.lit(None).cast("long")))
    assert TABLES[op](twice).count() == len(TEXTS) + 3


ODD_IDS = [(0, BASE), (0, BASE), (0, prose(40, 50)), (None, BASE), (None, prose(40, 50)), (None, None), (2, " ".join(NEAR)), (2, ""), (3, "a b c")]


@pytest.fixture(scope="module")
def odd_ids(spark):
    """Repeated and null ids, with equal and other texts."""
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in ODD_IDS], SCHEMA)


def test_odd_ids_get_their_own_result(odd_ids):
    """Where a row's result depends on its text alone, it is that of the text under another id."""
    numbered = odd_ids.withColumn("doc_id", F.xxhash64("text", F.coalesce("doc_id", F.lit(-1))))
    for op in ("op2", "op4", "op6"):
        cols = [c for c in TABLES[op](odd_ids).columns if c != "doc_id"]
        assert got(TABLES[op](odd_ids), *cols) == got(TABLES[op](numbered), *cols), op


def test_odd_ids_near_dedup(odd_ids):
    rows, fps = simhash.near_dedup_table(odd_ids).collect(), [simhash.fingerprint(t) for _, t in ODD_IDS]
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2 and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    least = {r: min((i for (i, _), q in zip(ODD_IDS, root) if q == r and i is not None), default=None) for r in root}
    want = sorted(((i, format(f, "016x"), least[r]) for (i, _), f, r in zip(ODD_IDS, fps, root)), key=repr)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in rows), key=repr) == want


def test_odd_ids_substring(odd_ids):
    c = Counter(tuple(w[j : j + 35]) for _, t in ODD_IDS for w in [words(t)] for j in range(len(w) - 34))
    want = []
    for i, t in ODD_IDS:
        w = words(t)
        gone = {j + k for j in range(len(w) - 34) if c[tuple(w[j : j + 35])] > 1 for k in range(35)}
        want.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    assert got(substring_trees.removal_table(odd_ids), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)


def test_odd_ids_fingerprints(odd_ids):
    """Rows follow each other by id (null first), then text hash; the fingerprints are those of the texts."""
    rows = odd_ids.withColumn("h", F.xxhash64("text")).collect()
    order = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    want = []
    for r, n in zip(order, [*order[1:], order[0]]):
        t, k = r.text or "", len(r.text or "")
        e = t[: k - k // 2] + (n.text or "")[: k // 2]
        want.append((r.doc_id, merkle_tree(t)[2], merkle_tree(e)[2]))
    assert got(merkle.fingerprint_table(odd_ids), "doc_id", "fingerprint", "edited_fingerprint") == sorted(want, key=repr)


@pytest.mark.parametrize("op", TABLES)
def test_long_texts(op, spark):
    """A text of 2.5 MB, one like it with an insertion, a word of 300 kB, and a short one."""
    rng = np.random.default_rng(1)
    long = " ".join(rng.choice(LEXICON, 420_000))
    rows = [(0, long), (1, long[:1_000_000] + " inserted here " + long[1_000_000:]), (2, "x" * 300_000), (3, "short text")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    out = {r.doc_id: r for r in TABLES[op](docs).collect()}
    assert sorted(out) == [0, 1, 2, 3]
    if op == "op1":
        assert out[0].component_id == out[1].component_id == 0 and out[0].fingerprint == format(simhash.fingerprint(long), "016x")
    if op == "op2":
        import tiktoken

        enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(BPE), special_tokens={})
        assert [out[i].n_tokens for i in range(4)] == [len(enc.encode_ordinary(t)) if i != 2 else out[2].n_tokens for i, t in rows]
    if op == "op3":
        assert [(r.start, r.n_tokens, r.ids_crc32) for r in (out[0], out[1], out[3])] == [x[1:] for x in ids_by_library(rows) if x[0] != 2]
    if op == "op7":
        assert out[0].n_words == 420_000 and 419_990 <= out[0].n_removed < 420_000 and out[1].n_removed >= 419_900 and out[2].n_removed == 0
    if op == "op9":
        assert out[0].n_removed == 0 and out[1].n_removed >= len(long) - 200 and out[2].n_removed == 0


def test_near_dedup_groups(docs):
    by = {r.doc_id: r for r in simhash.near_dedup_table(docs).collect()}
    fps = {i: simhash.fingerprint(t) for i, t in TEXTS}
    assert all(by[i].fingerprint == format(fps[i], "016x") for i in fps)
    root = {i: i for i in fps}

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in fps:
        for j in fps:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert {i: r.component_id for i, r in by.items()} == {i: find(i) for i in fps}


def test_segments_follow_the_number_of_fingerprints():
    assert [simhash.key_bits(s) for s in (8, 16, 32, 64)] == [24, 28, 30, 31]
    assert [simhash.segments_for(n) for n in (0, 10**8, 10**9, 5 * 10**9, 10**11)] == [8, 8, 16, 32, 64]


@pytest.mark.parametrize(("bucket", "segments"), [(64, None), (2, None), (64, 16), (2, 32), (64, 64), (2, 16)])
def test_links_cold_and_hot(spark, bucket, segments):
    """The way for crowded keys finds the same components as the pairs, whatever the length of keys."""
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 63, 20, np.int64)]
    fps = {b ^ int(sum(1 << int(k) for k in rng.choice(64, n, replace=False))) for b in base for n in (0, 1, 2, 3) for _ in range(6)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.links(spark.createDataFrame([(0, x) for x in signed], "r int, fp long"), segments=segments, bucket=bucket)
    from sparkloom.llm.graph import components

    star = {r.a: r.b for r in components(links).collect()}
    root = {x: x for x in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in signed:
        for b in signed:
            if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {x: star.get(x, x) for x in signed} == {x: find(x) for x in signed}


def test_keep_one(docs, clashing):
    kept = [r.doc_id for r in simhash.keep_one(clashing).orderBy("doc_id").collect()]
    assert kept == [i for i, _ in TEXTS if i not in (1, 2, 6)]  # 5 and 6 are both without text; 7 differs from them only as a text without words
    assert set(simhash.keep_one(clashing).columns) == set(clashing.columns)
    again = docs.filter("doc_id = 0").unionAll(docs.filter("doc_id = 0")).unionAll(docs.filter("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long")))
    assert sorted(map(repr, (r.doc_id for r in simhash.keep_one(again).collect()))) == ["0", "None"]


def kept_by_brute_force(texts):
    root = dict.fromkeys(texts)
    for i in texts:
        root[i] = i
    for i in texts:
        for j in texts:
            if i < j and simhash.similar(texts[i], texts[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    return sorted(i for i in texts if root[i] == i)


def test_keep_one_finds_inserted_blocks(spark):
    """One text is the other plus a block of new words, at similarities from 0.81."""
    texts = {}
    for p in range(60):
        w, more = [f"a{p}x{i}" for i in range(300)], [f"b{p}x{i}" for i in range(60)]
        at, size = 5 * p, (60, 45, 25)[p % 3]
        texts |= {2 * p: " ".join(w), 2 * p + 1: " ".join(w[:at] + more[:size] + w[at:])}
    kept = sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect())
    assert kept == kept_by_brute_force(texts) == list(range(0, 120, 2))


@pytest.mark.parametrize(("crowded", "outside"), [(20_000, 2_000), (3, 2)])
def test_keep_one_in_crowded_buckets(spark, monkeypatch, crowded, outside):
    """A large group of near copies, and texts beside it that share its shingles but are too far from it; buckets dealt to many tasks or to one."""
    from sparkloom.llm import shingle_join

    monkeypatch.setattr(shingle_join, "OUTSIDE", outside)
    w, texts = [f"a{i}" for i in range(100)], {}
    for k in range(40):
        texts[k] = " ".join([*w[:k], f"x{k}", *w[k + 1 :]])  # one word changed: alike in chains
    for k in range(40, 70):
        texts[k] = " ".join([*w[: 50 + k % 7], *(f"y{k}{i}" for i in range(20 + k % 5))])
    for k in range(70, 80):
        texts[k] = texts[k - 30] + f" z{k}"
    kept = sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), crowded=crowded).collect())
    assert kept == kept_by_brute_force(texts) and 20 < len(kept) < 60


def test_keep_one_of_string_ids(spark):
    rows = [("b", BASE), ("a", BASE), ("d", " ".join(NEAR)), ("c", prose(50, 9)), (None, BASE)]
    assert sorted((r.doc_id or "" for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id string, text string")).collect())) == ["", "a", "c"]


def test_keep_one_compares_within_a_vocabulary(spark):
    """Texts of one small vocabulary in different order: near copies are found though the least document is like none."""
    words, texts = [f"w{i}" for i in range(40)], {}
    for p in range(30):
        w = np.random.default_rng(p).permutation(words * 3).tolist()
        texts |= {2 * p: " ".join(w), 2 * p + 1: " ".join(w[:60] + w[61:])}
    texts[0] = " ".join(np.random.default_rng(99).permutation(words * 3))
    kept = sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect())
    assert kept == kept_by_brute_force(texts) and len(kept) == 31


def test_bpe_round_trip(docs):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(BPE), special_tokens={})
    want = []
    for i, t in TEXTS:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got(bpe.digest_table(docs, BPE, P.PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    table = bpe.encode_table(docs, BPE, P.PATTERN)
    assert {r.doc_id: bytes(r.bytes).decode() for r in bpe.decode_table(table, BPE).collect()} == {i: t or "" for i, t in TEXTS}


def ids_by_library(rows, end=2):
    """(key, start, number of ids, crc32) by a fresh tokenizer of the library, rows in order of key and text hash left open among equals."""
    from tokenizers import Tokenizer

    enc, want, start = Tokenizer.from_file(P.path("byte_bpe_50k.json")), [], 0
    for i, t in rows:
        ids = np.array([*enc.encode(t or "", add_special_tokens=False).ids, end], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return want


def test_token_files(docs, spark, tmp_path):
    files = token_files.write_files(docs, P.path("byte_bpe_50k.json"), path="file://" + str(tmp_path / "f"))
    want = ids_by_library(TEXTS)
    assert got(token_files.token_file_table(docs, P.path("byte_bpe_50k.json")), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    keys = spark.createDataFrame([(4, 0), (99, 0), (4, 1)], "k long, nth int")
    places = files.lookup(keys)
    assert [(r.k, r.size) for r in places.collect()] == [(4, want[4][2])]  # others are not in the index
    read = files.fetch(places).first()
    assert (read.start, len(read.ids) // 4, zlib.crc32(read.ids)) == want[4][1:]


def test_token_files_special_and_wide(spark, tmp_path):
    """Special tokens as the library has them; ids of 4 bytes where the end id asks for it; string keys."""
    rows = [("a", "x <|endoftext|> y"), ("b", "<|endoftext|>"), ("c", "z<|endoftext|>  z "), ("d", " ")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert got(token_files.token_file_table(docs, P.path("byte_bpe_50k.json")), "doc_id", "start", "n_tokens", "ids_crc32") == ids_by_library(rows)
    assert got(token_files.token_file_table(docs, P.path("byte_bpe_50k.json"), 70000), "doc_id", "start", "n_tokens", "ids_crc32") == ids_by_library(rows, 70000)


def test_token_files_of_one_key(spark, monkeypatch):
    """A key that fills several parts and shards: each of its rows is found once, and the starts are those of one file."""
    monkeypatch.setattr(token_files, "SHARD_BYTES", 300)
    rows = [(7, prose(20, 100 + i)) for i in range(80)] + [(None, prose(20, 300 + i)) for i in range(40)] + [(9, "end")]
    table = token_files.token_file_table(spark.createDataFrame(rows, "doc_id int, text string"), P.path("byte_bpe_50k.json")).collect()
    size = {(i, n, c): 0 for i, _, n, c in ids_by_library(rows)}
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in table), key=repr) == sorted(size, key=repr)
    at = 0
    for r in sorted(table, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(table, key=lambda r: r.start)] == [None] * 40 + [7] * 80 + [9]


def test_token_counts(docs):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(BPE), special_tokens={})
    want = []
    for i, t in TEXTS:
        t = t or ""
        s = t
        for q in (1, 2, 3):
            at = min(len(t) * q // 4, len(s))
            s = s[:at] + t[:11] + s[at + 7 :]
        want.append((i, len(enc.encode_ordinary(t)), len(enc.encode_ordinary(s)), len(s)))
    assert got(token_counts.token_count_table(docs, BPE, P.PATTERN), "doc_id", "n_tokens", "n_tokens_after", "n_chars_after") == sorted(want, key=repr)


def test_token_trees_are_edited_again(docs):
    """The outcome of edits is a table of trees: two scripts, one after the other, give what one of both gives."""
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(BPE), special_tokens={})
    trees = token_counts.build_trees(docs, BPE, P.PATTERN)
    script = lambda at, drop, put: F.expr(f"array(named_struct('at', {at}, 'drop', {drop}, 'put', {put}), null)")
    once = token_counts.edit_trees(trees.withColumn("edits", script(5, 3, "'new  words here'")), BPE, P.PATTERN)
    twice = token_counts.edit_trees(once.select("doc_id", "text", "chars", "tokens").withColumn("edits", script(-4, 2, "cast(null as string)")), BPE, P.PATTERN)
    want = {}
    for i, t in TEXTS:
        t = t or ""
        t = (t[:5] + "new  words here" + t[8:])[2:]
        want[i] = (t, len(enc.encode_ordinary(t)), len(t))
    assert {r.doc_id: (r.text, r.n_tokens_after, r.n_chars_after) for r in twice.collect()} == want
    assert {r.doc_id: r.tokens[1] for r in twice.collect()} == {i: x[1] for i, x in want.items()}


def test_quality_counts(docs):
    def measures(t):
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        rep = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
        return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(lines) - len(set(lines)), len(rep)

    by = {r.doc_id: r for r in quality.quality_table(docs).collect()}
    assert {i: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for i, r in by.items()} == {i: measures(t) for i, t in TEXTS}
    assert by[0].kept and not by[13].kept and not by[14].kept and by[11].base_failed and not by[5].kept
    assert sorted(r.doc_id for r in quality.keep_good(docs).collect()) == sorted(i for i, r in by.items() if r.kept)


def test_quality_extra_rules(spark):
    """Words by frequency and kinds of lines, each against a plain count."""
    plain = " ".join(f"w{i}" for i in range(60))
    odd = {1: plain, 2: plain + " it" * 40, 3: plain.replace(" ", " \n", 50).replace("w3 ", "w3... "), 4: "\n".join(f"w{i} and{i}..." for i in range(40)), 5: "\n".join(f"- w{i} and{i} or{i} nor{i}" for i in range(40)), 6: "\n".join(f"* w{i} and{i} or{i} nor{i}" for i in range(36)) + "\nx y" * 4, 7: "", 8: None}
    frame = spark.createDataFrame(list(odd.items()), "doc_id long, text string")
    w, t = quality.words(F.col("text")), F.coalesce("text", F.lit(""))
    m = quality.Measures(t, w)
    got_ = {r.doc_id: (r.a, r.b, r.c) for r in frame.select("doc_id", m.top_word.alias("a"), m.n_ellipsis_lines.alias("b"), m.n_bullet_lines.alias("c")).collect()}
    lines_ = {i: (x or "").split("\n") for i, x in odd.items()}
    assert got_ == {i: (max(Counter(words(x)).values(), default=0), sum(y.rstrip(" \t\r").endswith("...") for y in lines_[i]), sum(re.match(r"[ \t]*[-*] ", y) is not None for y in lines_[i])) for i, x in odd.items()}
    assert {r.doc_id for r in quality.quality_table(frame, quality.extra_rules()).collect() if r.kept} == {1, 3, 6}


def test_quality_takes_further_measures_only_of_what_is_left(spark):
    """A rule behind the base, or behind a rule that rejects, isn't evaluated."""
    good = " ".join(f"w{i}" for i in range(60))
    frame = spark.createDataFrame([(1, "too few"), (2, good + " #" * 30)], "doc_id long, text string")
    trap = quality.Rule("trap", lambda m: F.raise_error(F.concat(F.lit("evaluated: "), m.text)).cast("boolean"))
    base = frame.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).withColumn("w", quality.words(F.col("t")))
    rules = [r for r in quality.default_rules() if r.name == "symbols"] + [trap]
    known = base.select("doc_id", F.when(F.size("w") < 50, False).otherwise(quality.cascade(rules, quality.Measures(F.col("t"), F.col("w"))).isNull()).alias("kept"))
    assert {r.doc_id: r.kept for r in known.collect()} == {1: False, 2: False}


def test_quality_samples_the_whole_table(spark):
    """Rules that reject rows at the table's end come first, too."""
    rows = [(i, " ".join(f"w{k}" for k in range(60)) + (" #" * 40 if i >= 300 else "")) for i in range(600)]
    ordered = quality.order_rules(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), quality.default_rules() + quality.extra_rules(), sample_rows=200)
    assert ordered[0].name == "symbols"
    assert len(quality.order_rules(spark.createDataFrame([], "doc_id long, text string"), quality.default_rules())) == 6


@pytest.mark.parametrize(("chunk_bytes", "crowded", "bits"), [(2 << 20, 2000, 64), (900, 2000, 64), (2 << 20, 1, 64), (900, 1, 64), (900, 2000, 4), (900, 1, 4)])
def test_substring_removal(docs, chunk_bytes, crowded, bits):
    """Also where all hashes have 4 bits, so that different windows meet, and where every anchor is crowded."""
    c = Counter(tuple(w[j : j + 35]) for _, t in TEXTS for w in [words(t)] for j in range(len(w) - 34))
    want = {}
    for i, t in TEXTS:
        w = words(t)
        gone = {j + k for j in range(len(w) - 34) if c[tuple(w[j : j + 35])] > 1 for k in range(35)}
        want[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    out = substring_trees.repeated_words(docs, chunk_bytes=chunk_bytes, crowded=crowded, bits=bits).collect()
    assert {r.doc_id: (r.n_words, sum(b - a for a, b in r.spans), r.kept) for r in out} == want
    assert want[3][1] == 60 and want[12][1] == 120


def test_substring_extras(docs):
    as_is = {r.doc_id: r for r in substring_trees.repeated_words(docs, extra=("lang", "n_chars"), as_is=True).collect()}
    assert as_is[8].kept == TEXTS[8][1] and as_is[5].kept is None and as_is[3].lang is None and as_is[9].n_chars == len(TEXTS[9][1])


def lost_bytes(rows, window=50):
    """By brute force: the bytes of each row that are covered by a window which starts in a row of smaller id."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for j in range(len(b) - window + 1):
            if i is not None:
                first[b[j : j + window]] = min(i, first.get(b[j : j + window], i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        mask = np.zeros(len(b), bool)
        for j in range(len(b) - window + 1):
            if i is not None and first[b[j : j + window]] < i:
                mask[j : j + window] = True
        out.append((i, len(b), int(mask.sum()), np.frombuffer(b, np.uint8)[~mask].tobytes()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("chunk_bytes", "crowded", "bits"), [(2 << 20, 2000, 64), (600, 2000, 64), (2 << 20, 1, 64), (600, 1, 64), (600, 2000, 4), (600, 1, 4)])
def test_suffix_array_removal(docs, chunk_bytes, crowded, bits):
    out = suffix_array.removed_bytes(docs, chunk_bytes=chunk_bytes, crowded=crowded, bits=bits).collect()
    assert sorted(((r.doc_id, r.n_bytes, sum(b - a for a, b in r.spans), bytes(r.kept)) for r in out), key=repr) == lost_bytes(TEXTS)


@pytest.mark.parametrize("chunk_bytes", [2 << 20, 200])
def test_suffix_array_equal_and_null_ids(spark, chunk_bytes):
    """Only a smaller id takes bytes: equal ids, and rows without one, lose nothing to each other."""
    rows = [(1, PASSAGE[:104]), (1, PASSAGE[:104]), (None, PASSAGE[:104]), (None, PASSAGE[:104]), (2, "x" + PASSAGE[:80]), (2, PASSAGE[:80]), (0, prose(30, 77))]
    out = suffix_array.removed_bytes(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=chunk_bytes).collect()
    got_ = sorted(((r.doc_id, r.n_bytes, sum(b - a for a, b in r.spans), bytes(r.kept)) for r in out), key=repr)
    assert got_ == lost_bytes(rows) and [x[2] for x in got_ if x[0] == 1] == [0, 0]
    named = suffix_array.removed_bytes(spark.createDataFrame([(None if i is None else f"k{i}", t) for i, t in rows], "doc_id string, text string"), chunk_bytes=chunk_bytes).collect()
    assert sorted((r.n_bytes, sum(b - a for a, b in r.spans)) for r in named) == sorted(x[1:3] for x in got_)


def merkle_tree(t):
    """Sections of paragraphs of runs, by brute force."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    runs = re.compile(r"[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]*){1,4}|[\x20\x09-\x0D]+|^$")
    sections = [[runs.findall(p) or [""] for p in re.split(r"(?<=\n)", s)] for s in re.split(r"(?<=\n\n)(?!\n)", t or "")]
    sections = [[p for i, p in enumerate(s) if p != [""] or len(s) == 1 or i == len(s) - 1] for s in sections]
    digests = [[[md5(x) for x in p if x or p == [""]] for p in s] for s in sections]
    root = hashlib.sha256("|".join(md5(";".join(md5(",".join(p)) for p in s)) for s in digests).encode()).hexdigest()
    return sections, root, root + "-" + "".join("".join("".join(x[:8] for x in p) + "0" * 8 for p in s) + "0" * 8 for s in digests)


def dice(a, b):
    if a[:64] == b[:64]:
        return 1.0
    x, y = ({p[65 + 8 * i :][:8] for i in range(len(p[65:]) // 8)} - {"0" * 8} for p in (a, b))
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0


@pytest.mark.parametrize(("block_rows", "most_cuts"), [(1500, 8192), (3, 8192), (2, 3), (2, 1)])
def test_merkle_next(docs, block_rows, most_cuts):
    nxt = merkle.with_next(docs, {"body": F.coalesce("text", F.lit(""))}, block_rows=block_rows, most_cuts=most_cuts)
    assert {r.doc_id: r.next.body for r in nxt.collect()} == {i: TEXTS[(k + 1) % len(TEXTS)][1] or "" for k, (i, _) in enumerate(TEXTS)}


@pytest.mark.parametrize("kind", ["string", "int", "decimal(20,2)", "date", "binary"])
@pytest.mark.parametrize(("block_rows", "most_cuts"), [(5, 8192), (2, 3), (1500, 8192)])
def test_merkle_next_follows_the_order_of_any_id(spark, kind, block_rows, most_cuts):
    """Numeric strings in string order, text ids, repeated and null ids, over several blocks."""
    ids = [str(i) for i in range(1, 31)] + (["id-0", "id-1", "Ä", "", "id-1", "id-1"] if kind == "string" else ["7", "7"])
    rows = [(i, f"text {k % 29} of {i}") for k, i in enumerate(ids)] + [(None, f"nobody {k}") for k in range(9)] + [("5", None)]
    cast = {"date": "date_add(DATE'2020-01-01', CAST(i AS int))", "binary": "CAST(i AS binary)"}.get(kind, f"CAST(i AS {kind})")
    frame = spark.createDataFrame(rows, "i string, text string").selectExpr(f"{cast} doc_id", "text").repartition(3)
    held = frame.withColumn("h", F.xxhash64("text")).collect()
    plain = lambda i: bytes(i) if isinstance(i, bytearray) else i
    order = sorted(held, key=lambda r: (r.doc_id is not None, r.doc_id is not None and (plain(r.doc_id).encode() if kind == "string" else plain(r.doc_id)), r.h))
    want = sorted((str(a.doc_id), a.text or "", b.text or "") for a, b in zip(order, [*order[1:], order[0]]))
    out = merkle.with_next(frame, {"body": F.coalesce("text", F.lit(""))}, block_rows=block_rows, most_cuts=most_cuts).collect()
    assert sorted((str(r.doc_id), r.body, r.next.body) for r in out) == want


def test_merkle_spans_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SPAN", 3)
    some = [0, 1, 2, 5, 9, 10, 11, 30]
    got_ = {r.b: r.to for r in merkle._after(spark.createDataFrame([(b,) for b in some], "b long")).collect()}
    assert got_ == dict(zip(some, [*some[1:], 0]))


def test_merkle_prints(docs):
    """All columns of the table against brute force."""
    by = {r.doc_id: r for r in merkle.fingerprint_table(docs).collect()}
    for k, (i, t) in enumerate(TEXTS):
        t, n, after = t or "", len(t or ""), TEXTS[(k + 1) % len(TEXTS)][1] or ""
        edited = t[: n - n // 2] + after[: n // 2]
        a, b, c = (merkle_tree(x)[2] for x in (t, edited, after))
        assert (by[i].fingerprint, by[i].edited_fingerprint, by[i].n_chars, by[i].edited_sha256) == (a, b, n, hashlib.sha256(edited.encode()).hexdigest()), i
        assert (by[i].near_edited, by[i].near_next) == (pytest.approx(dice(a, b)), pytest.approx(dice(a, c)))
    assert by[0].fingerprint == by[1].fingerprint != by[2].fingerprint and by[5].fingerprint == by[6].fingerprint != by[7].fingerprint


def test_merkle_locates_edits(spark):
    a = "one two three four five six seven eight\nnine ten\n\nsecond section here\nand more of it to read\n\nthird one"
    b = a.replace("second section", "2nd section").replace("seven", "7")
    rows = [(1, a, b), (2, a, a), (3, a, None), (4, None, a), (5, a, "new words up front\n\n" + a), (6, "", "")]
    got_ = {r.i: [(x.at, x.size) for x in r.edits] for r in merkle.locate_edits(spark.createDataFrame(rows, "i int, text string, other string")).collect()}
    assert [a[x : x + n] for x, n in got_[1]] == ["five six seven eight\n", "second section here\n"]
    assert got_[2] == got_[4] == got_[5] == got_[6] == [] and sum(n for _, n in got_[3]) == len(a)  # an empty text has no run that could be placed


def test_raking_meets_its_targets(spark):
    rng = np.random.default_rng(0)
    cells = spark.createDataFrame([(f"s{a}", f"l{b}", f"t{c}", int(rng.integers(1, 1000))) for a in range(3) for b in range(2) for c in range(2)], "source string, lang string, topic string, w0 long")
    targets = {"source": {"s0": 0.5, "s1": 0.3, "s2": 0.2}, "lang": {"l0": 0.5, "l1": 0.5}, "topic": {"t0": 0.9, "t1": 0.1}}
    raked, gap = mixing.rake(cells, targets=targets)
    out = raked.toPandas()
    assert gap < 1e-9
    for m, want in targets.items():
        share = out.groupby(m).w.sum() / out.w.sum()
        assert all(share[k] == pytest.approx(v, abs=1e-3) for k, v in want.items())
    for keep in (0.2, 0.9):
        p = mixing.probabilities(raked, keep).toPandas()
        assert (p.p * p.w0).sum() == pytest.approx(keep * p.w0.sum(), rel=1e-6) and p.p.max() <= 1
    none = {"source": {"s0": 1.0}, "lang": {"l0": 0.5, "l1": 0.5}, "topic": {"t0": 1.0, "t9": 1.0}}
    assert mixing.rake(cells, targets=none)[1] == pytest.approx(0.5)  # no weights meet these; it ends and says by how much


def test_mixture_meets_its_targets(spark):
    """Small classes get their tempered share although that is more than they have; the draw is within sampling error."""
    kinds = [("common of it " * 7, 9000), ("seldom of it " * 7, 600), ("rarely seldom rarely " * 7, 300), ("of it " * 10, 100)]
    rows = [(t, f"s{i % 3 % 2}", "en" if i % 7 else "de") for t, n in kinds for i in range(n)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, source string, lang string")
    topics = mixing.learn_topics(docs)
    out = mixing.sample_mixture(docs, keep=0.9, topics=topics)
    assert out.columns == docs.columns
    before, after = (mixing.with_margins(x, [], topics=topics).toPandas() for x in (docs, out))
    assert set(before.topic) == {"common", "seldom", "rarely", "(none)"}
    assert after.n_tokens.sum() == pytest.approx(0.9 * before.n_tokens.sum(), rel=0.03)
    for m in mixing.MARGINS:
        had, got_ = (x.groupby(m).n_tokens.sum() / x.n_tokens.sum() for x in (before, after))
        want = had**0.7 / (had**0.7).sum()
        assert all(got_[k] == pytest.approx(v, rel=0.1) for k, v in want.items())


def test_mixing_by_a_given_topic(docs, monkeypatch):
    """A topic column is taken as it is; many cells are joined without a broadcast of all of them; null ids draw apart."""
    named = docs.withColumn("subject", F.col("doc_id") % 2).unionAll(docs.filter("doc_id in (0, 3, 4)").withColumn("subject", F.lit(None).cast("long")).withColumn("doc_id", F.lit(None).cast("long")))
    plain = got(mixing.mixing_table(named, topic="subject"), "doc_id", "topic", "weight", "prob", "sampled")
    assert {r[1] for r in plain} == {"0", "1", "(none)"}
    monkeypatch.setattr(mixing, "FEW_CELLS", 0)
    assert got(mixing.mixing_table(named, topic="subject"), "doc_id", "topic", "weight", "prob", "sampled") == plain
    keys = [r[0] for r in named.select(mixing.draw_key(F.col("doc_id"), F.col("text"))).collect()]
    assert len(set(keys)) == len(keys)
    report, gap = mixing.mixing_report(docs)
    off = [abs(r.raked - r.target) for r in report.collect()]
    assert max(off) == pytest.approx(gap, abs=1e-9) and gap < 0.2  # the marginals of so small a table can't all be met


def test_language_held_out(spark, sf_dir):
    table = language.language_table(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("piece_bpe_32k.model"), 100)
    d = table.join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id").filter("held_out")
    assert d.filter("lang = lang_pred").count() >= 0.97 * d.count()


def test_language_undecided(docs):
    by = {r.doc_id: r for r in language.language_table(docs, P.path("piece_bpe_32k.model"), 50).collect()}
    assert by[5].lang_pred == by[6].lang_pred == by[7].lang_pred == "und" and by[0].lang_pred == "en" and by[0].score == 1.0


def test_language_without_letters(docs):
    """Numbers and signs that count as word characters elsewhere are no letters."""
    odd = docs.filter("doc_id = 0").withColumn("text", F.lit("½ ² Ⅷ 12_3 ...")).withColumn("doc_id", F.lit(50).cast("long"))
    by = {r.doc_id: r for r in language.language_table(docs.unionAll(odd), P.path("piece_bpe_32k.model"), 50).collect()}
    assert (by[50].lang_pred, by[50].score) == ("und", 0.0) and by[0].lang_pred == "en"


def test_components_of_a_chain(spark):
    from sparkloom.llm.graph import components

    n = 100
    star = {r.a: r.b for r in components(spark.createDataFrame([(i, i + 1) for i in range(n)] + [(500, 501)], "a long, b long")).collect()}
    assert star == {**{i: 0 for i in range(1, n + 1)}, 501: 500}
