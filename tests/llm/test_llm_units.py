"""Kernels of the training-data operators against brute force, without Spark."""

import random

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from sparkloom.llm import language, simhash, suffix_array, token_files  # noqa: E402
from sparkloom.llm.bpe import MatrixBPE, Remembered, TextEncoder, load_ranks  # noqa: E402
from sparkloom.llm.chunks import pack_bits, unpack_bits
from sparkloom.llm.spans import rolling, word_spans  # noqa: E402
from sparkloom.llm.substring_trees import repeated_suffixes  # noqa: E402
from sparkloom.llm.token_counts import PartCounts, TokenTree  # noqa: E402


@pytest.fixture(scope="module")
def ranks():
    return load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def bpe(ranks):
    return MatrixBPE(ranks)


@pytest.fixture(scope="module")
def tiktoken_encoding(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", " ", "   ", "  a", "a  b", "a   b", " a\n b", "x\n\n  y ", "it's  we'll\t\tgo", "a \nfoo", "日本語 テスト" * 50, "é" * 300, "ab" * 500, "aaaa" * 400, "🎉 🎉🎉", "\x00 \x00a", "a᠎ b", "<|endoftext|>"]


def test_bpe_is_tiktoken(bpe, tiktoken_encoding):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(" \n\tabcé日1.,'’s ") for _ in range(rng.randint(0, 60))) for _ in range(600)] + ["".join(rng.choice(a) for _ in range(rng.randint(250, 600))) for a in ("abcdef", "a", "ab", "etaoin", "日本é") for _ in range(5)]
    got = TextEncoder(bpe, P.PATTERN).encode(texts)
    for t, g in zip(texts, got):
        assert np.frombuffer(g, np.int32).tolist() == tiktoken_encoding.encode_ordinary(t), t
    assert TextEncoder(bpe, P.PATTERN).encode([None]) == [b""]


def test_slices_of_arrow_columns(bpe, tiktoken_encoding):
    """Texts as a slice of a column, as batches are cut; nulls among them."""
    import pyarrow as pa

    texts = [None, "one two", "  odd  ", "", "é three, four", None, "five"]
    for kind in (pa.string(), pa.large_string()):
        for a in range(7):
            for b in range(a, 8):
                got = TextEncoder(bpe, P.PATTERN).encode(pa.array(texts, kind).slice(a, b - a))
                assert [np.frombuffer(x, np.int32).tolist() for x in got] == [tiktoken_encoding.encode_ordinary(t or "") for t in texts[a:b]]


def test_bpe_under_another_pattern(bpe, ranks):
    """A pattern that doesn't begin a match at each space: texts are not cut there."""
    import tiktoken

    pattern = r"\w+ \w+|\s+|\w+|[^\w\s]+"
    enc, texts = tiktoken.Encoding("two", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), ["one two three four", " a b  c, d"]
    assert [np.frombuffer(x, np.int32).tolist() for x in TextEncoder(bpe, pattern).encode(texts)] == [enc.encode_ordinary(t) for t in texts]


def test_memory_keeps_two_generations():
    m = Remembered(2)
    for k in (b"a", b"b", b"c"):
        m.young[k] = 1
    assert m.get([b"a", b"d"]) == ([1, None], [1]) and b"a" in m.young and b"b" in m.old


@pytest.mark.parametrize("clash", [False, True])
def test_distinct_spans(monkeypatch, clash):
    """Spans are told apart by their bytes also where all hashes are equal."""
    from sparkloom.llm import spans

    if clash:
        monkeypatch.setattr(spans, "scramble", lambda x: x & np.uint64(1))
    rng = random.Random(2)
    for _ in range(50):
        words = ["".join(rng.choice("ab") for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 40]))).encode() for _ in range(rng.randint(0, 60))]
        sizes = np.array([len(w) for w in words], np.int64)
        keys, which = spans.distinct(b"".join(words), np.cumsum(sizes) - sizes, sizes)
        assert [keys[i] for i in which] == words and len(keys) == len(set(words)) == len(set(keys))


def test_library_encoder_is_the_library():
    from tokenizers import Tokenizer

    rng = random.Random(3)
    texts = ODD + ["plain words here and there, again and again." * 3] + ["".join(rng.choice(" \n\tabcé日1.,'’s ") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    for as_text in (False, True):
        enc, fresh = token_files.LibraryEncoder(P.path("byte_bpe_50k.json"), 2, as_text), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        fresh.encode_special_tokens = as_text
        assert [np.frombuffer(x, enc.kind).tolist() for x in enc.encode(texts)] == [fresh.encode(x, add_special_tokens=False).ids for x in texts]


def test_index_salts_clashing_keys():
    h, more = np.array([5, 5, 6], np.uint64), np.array([1, 2, 1], np.uint64)
    assert token_files.choose_salt(h, more) == 1 and token_files.choose_salt(h[1:], more[1:]) == 0
    with pytest.raises(ValueError):
        token_files.choose_salt(np.array([5, 5], np.uint64), np.array([1, 1], np.uint64))


@pytest.mark.parametrize("n", [0, 1, 2, 5, 100, 4096])
def test_minimal_perfect_hash(n):
    h = np.random.default_rng(n).integers(0, 1 << 63, n, np.int64).view(np.uint64)
    assert sorted(token_files.mph_slots(h, token_files.build_mph(h), n).tolist()) == list(range(n))


def test_token_tree_edits(bpe, tiktoken_encoding):
    count, rng = PartCounts(bpe, P.PATTERN), random.Random(2)
    for letters in ("ab c d  \n\n'srel1.2,é日", "ab cde fg h"):
        for _ in range(150):
            t = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 50, 700, 3000])))
            tree = TokenTree.of(t, count)
            assert tree.n_tokens == len(tiktoken_encoding.encode_ordinary(t)) and tree.n_chars == len(t)
            for _ in range(8):
                at, drop, put = rng.randint(0, len(t) + 2), rng.choice([0, 1, 3, 40, 300]), "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 4, 60, 900, 5000])))
                tree.edit(at, drop, put)
                at = min(at, len(t))
                t = t[:at] + put + t[at + drop :]
                assert tree.text() == t and tree.n_tokens == len(tiktoken_encoding.encode_ordinary(t)) and tree.n_chars == len(t)
                for heap in (tree.chars, tree.tokens):
                    assert all(heap[i] == heap[2 * i] + heap[2 * i + 1] for i in range(1, tree.width))
    big = TokenTree.of(t := "word " * 20000, count)
    big.edit(50000, 3, "xyz")
    assert big.encoded < 1000  # only the touched region is read anew


def test_token_tree_asks_for_the_look_ahead(bpe, ranks):
    import tiktoken

    pattern = r"\s*[\r\n]+|\s+(?!\S)|\S+|\s+"
    with pytest.raises(ValueError):
        PartCounts(bpe, pattern)
    enc, count, rng = tiktoken.Encoding("three", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), PartCounts(bpe, pattern, 40), random.Random(5)
    for _ in range(60):
        t = "".join(rng.choice("ab  \n\r") for _ in range(rng.choice([10, 300])))
        tree = TokenTree.of(t, count)
        for _ in range(5):
            at, drop, put = rng.randint(0, len(t)), rng.choice([0, 2, 20]), rng.choice(["", "x", " \n", "\n\n"])
            tree.edit(at, drop, put)
            t = t[:at] + put + t[at + drop :]
            assert tree.n_tokens == len(enc.encode_ordinary(t))


def test_collection_is_the_suffix_array():
    rng = random.Random(3)
    for trial in range(150):
        w = rng.choice([3, 4, 5])
        strings = ["".join(rng.choice("abc"[: 2 + trial % 2]) for _ in range(rng.randint(w, 70))).encode() for _ in range(rng.randint(1, 12))]
        docs, sizes = np.array([rng.randint(0, 4) for _ in strings]), np.array([len(s) for s in strings])
        text = np.frombuffer(b"".join(strings), np.uint8)
        c = suffix_array.Collection(text, np.cumsum(sizes) - sizes, sizes)
        suffixes = [strings[a][len(strings[a]) - n :] for a, n in zip(c.string, c.length)]
        assert suffixes == sorted(suffixes)
        common = lambda x, y: next((i for i in range(min(len(x), len(y))) if x[i] != y[i]), min(len(x), len(y)))
        assert c.lcp[1:].tolist() == [common(x, y) for x, y in zip(suffixes, suffixes[1:])]
        flags = suffix_array.earlier(strings, np.zeros(len(strings), np.uint32), docs, w)
        assert flags.tolist() == [any(docs[k] < docs[i] and s[j : j + w] in strings[k] for k in range(len(strings))) for i, s in enumerate(strings) for j in range(len(s) - w + 1)]


def test_subtree_compares_words():
    rng = random.Random(8)
    for _ in range(100):
        texts = [" ".join(rng.choice(["a", "b", "ab"]) for _ in range(rng.randint(3, 30))).encode() for _ in range(rng.randint(1, 8))]
        all_ = [tuple(w[i : i + 3]) for t in texts for w in [t.split()] for i in range(len(w) - 2)]
        got = [x for f in repeated_suffixes(texts, np.ones(len(texts)), 3) for x in f.tolist()]
        assert got == [all_.count(x) > 1 for x in all_]


def test_word_spans():
    rng = random.Random(9)
    for _ in range(100):
        texts = ["".join(rng.choice("ab \t\n\x0b\x0c\r\x1cé") for _ in range(rng.choice([0, 1, 9]))).encode() for _ in range(rng.randint(0, 6))]
        block, ends = b"".join(texts), np.cumsum([len(t) for t in texts], dtype=np.int64)
        starts, stops, doc = word_spans(np.frombuffer(block, np.uint8), ends)
        assert [(d, block[a:b]) for a, b, d in zip(starts, stops, doc)] == [(d, w) for d, t in enumerate(texts) for w in t.split()]


@pytest.mark.parametrize("bits", [64, 4])
def test_equal_windows_have_equal_anchors(bits):
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdef ") for _ in range(90))
    texts = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 200))) + passage + "x" * rng.randint(0, 40) for _ in range(6)]
    block, ends = "".join(texts).encode(), np.cumsum([len(t) for t in texts])
    b = suffix_array.Bytes(block, ends, np.ones(6, bool), 50, 8, bits)
    gram = {}
    for first, count, g in zip(b.runs.first.tolist(), b.runs.count.tolist(), b.runs.gram.tolist()):
        for at in range(first, first + count):
            assert gram.setdefault(block[at : at + 50], g) == g
    assert len(gram) == len({t[i : i + 50] for t in texts for i in range(len(t) - 49)})


def test_rolling_and_bits():
    x = np.array([1, 2, 3, 4, 1, 2, 3, 9], np.uint64)
    h = rolling(x, (1, 2, 3))
    assert len(h[3]) == 6 and h[3][0] == h[3][4] and h[2][0] == h[2][4] and h[3][1] != h[3][5 - 1]
    flags = np.random.default_rng(0).random(77) > 0.5
    assert (unpack_bits(pack_bits(flags), 77) == flags).all()


def test_pigeonring_budgets():
    assert simhash.budgets(8, 2) == [0, 0, 0, 1, 1, 1, 1, 2]
    rng = random.Random(5)
    for _ in range(300):  # some chain start meets every budget for any two fingerprints within 2 bits
        x = 0
        for b in rng.sample(range(64), rng.randint(0, 2)):
            x |= 1 << b
        seg = [(x >> (64 - 8 * (i + 1))) & 255 for i in range(8)]
        assert any(all(sum(seg[(i + k) % 8].bit_count() for k in range(n)) <= b for n, b in enumerate(simhash.budgets(8, 2), 1)) for i in range(8))


def test_fingerprint_cases():
    assert simhash.fingerprint(None) == simhash.fingerprint("  \n") == 0
    assert simhash.fingerprint("A b") == simhash.fingerprint("a\tB") != simhash.fingerprint("É b") != simhash.fingerprint("é b")
    assert simhash.similar(None, "") and not simhash.similar("a", "b") and simhash.similar("A b", "a B")


def total_of(w, pieces, p):
    """P(word) by recursion over all segmentations."""
    if not w:
        return 1.0
    return sum((p[pieces.index(w[:k])] if w[:k] in pieces else p[-1] if k == 1 else 0) * total_of(w[k:], pieces, p) for k in range(1, len(w) + 1))


@pytest.mark.parametrize("matrix", [40, 0])
def test_language_lattice_sums_all_segmentations(monkeypatch, matrix):
    """In matrices and along the word (matrix 0)."""
    monkeypatch.setattr(language, "MATRIX", matrix)
    pieces = ["a", "b", "ab", "▁a", "aabbabab", "aabbababab"]
    p = np.array([0.2, 0.3, 0.1, 0.25, 0.03, 0.04, 1e-7])
    lattice, words = language.Lattice(pieces), ["ab", "aabb", "▁ab", "xab", "b", "aabbababab", "xaabbababaabb"]
    out = lattice.forward(words, np.stack([p, p[::-1]], 1))
    for k, q in enumerate((p, p[::-1])):
        assert np.exp(out[:, k]) == pytest.approx([total_of(w, pieces, q) for w in words])
    got = lattice.expected(["aabb", "▁ab"], np.array([2.0, 1.0]), p)
    assert sum(got[i] * len(x) for i, x in enumerate(pieces)) + got[-1] == pytest.approx(11.0)  # 2 words of 4 characters, 1 of 3
    assert got == pytest.approx(language.Lattice(pieces).expected(["aabb", "aabb", "▁ab"], np.ones(3), p))


def test_long_words_are_scored_as_a_whole():
    pieces, rng = ["a", "b", "ab", "bba"], random.Random(1)
    p = np.array([[0.2, 0.1], [0.3, 0.2], [0.1, 0.4], [0.2, 0.1], [1e-7, 1e-7]])
    lattice, words = language.Lattice(pieces), ["".join(rng.choice("abx") for _ in range(n)) for n in (39, 40, 41, 80)]
    both = []
    for matrix in (40, 0):
        language.MATRIX, held = matrix, language.MATRIX
        try:
            both.append(lattice.forward(words, p))
            both.append(lattice.expected(words, np.ones(4), p[:, 0]))
        finally:
            language.MATRIX = held
    assert np.allclose(both[0], both[2]) and np.allclose(both[1], both[3]) and np.isfinite(lattice.forward(["ab" * 50000], p)).all()
    every = language.load_pieces(P.path("piece_bpe_32k.model"))
    assert max(map(len, every)) > 10 and len(every) == len(set(every))


def test_spell():
    assert language.spell("l'été,2") == ["▁l", "▁été"] and language.spell("123 ½²Ⅷ_") == [] and [len(x) for x in language.spell("x" * 90)] == [91]
