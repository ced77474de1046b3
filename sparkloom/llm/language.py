"""Language ID with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a
word is the sum over all its segmentations into pieces of any length (forward algorithm, run on padded
matrices of many words at once, and along the word for words beyond `MATRIX` characters); the score of a
text is the product over its words, which are its runs of letters. Piece probabilities are learned by
expectation maximisation over word counts, one task per language.

Learning uses a bounded sample of labelled rows: about `sample_rows` in all, shared evenly by the
languages and drawn by a hash of doc_id, whole texts. What a language's task holds is bounded by that: 3000
rows of 20,000 words are 60 million words at most, all languages together, counted before they are
brought together. The driver gets one row per language, the probabilities. Prediction covers every whole text.

Defined results: `und` with score 0 for a text that is null or has no letter (\\p{L}), or where nothing was
learned; equal posteriors go to the language first in order; rows without a lang or doc_id are not learned
from; repeated rows each keep their row; an empty table gives none; other columns never take part.
"""

from __future__ import annotations

from collections import Counter
from math import exp, log

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import small_steps
from .common import trimmed, trimmed_steps, worker_state
from .spans import distinct, word_spans

#: Longest word in a matrix, and numbers in a matrix of forward sums.
MATRIX, CELLS = 40, 4_000_000
REMEMBER = 400_000
LETTERS = regex.compile(r"\p{L}+")
START = "▁"
FLOOR = 1e-7


def load_pieces(path: str) -> list[str]:
    """Lower-cased pieces of letters, of any length, maybe with the word-start mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return sorted({x for x in every if x == START or LETTERS.fullmatch(x.removeprefix(START))})


class Lattice:
    """Pieces at every place of words, found by rolling hashes of their code points, one table for each length of pieces."""

    MULTIPLIER = 1000003

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        by: dict[int, list[int]] = {}
        for i, x in enumerate(pieces):
            by.setdefault(len(x), []).append(i)
        self.tables = {}
        for length, ids in sorted(by.items()):
            keys = self._prefixes(self.codes([pieces[i] for i in ids])[0])[:, -1]
            order = np.argsort(keys)
            seen = np.zeros(1 << 18, bool)
            seen[self._slot(keys)] = True
            self.tables[length] = keys[order], np.array(ids)[order], seen, np.uint64(pow(self.MULTIPLIER, length, 1 << 64))

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(w) for w in words])
        width = int(size.max(initial=1))
        flat = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
        return flat.reshape(len(words), width).astype(np.uint64), size

    def _prefixes(self, codes: np.ndarray) -> np.ndarray:
        """Hashes of the first 0, 1, 2, ... characters."""
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        step = codes * np.uint64(2654435761) + np.uint64(12345)
        for k in range(codes.shape[1]):
            out[:, k + 1] = out[:, k] * np.uint64(self.MULTIPLIER) + step[:, k]
        return out

    def _find(self, length: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces of this length, and which pieces."""
        keys, ids, seen, _ = self.tables[length]
        at = np.flatnonzero(seen[self._slot(h)])
        place = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
        hit = keys[place] == h[at]
        return at[hit], ids[place[hit]]

    def spans(self, codes: np.ndarray):
        """For each end and length, the rows where a piece ends there, and which; of length 1 every row, with the number of pieces where none does."""
        rows, width = codes.shape
        prefix = self._prefixes(codes)
        for end in range(1, width + 1):
            single = np.full(rows, self.size)
            if 1 in self.tables:
                at, piece = self._find(1, prefix[:, end] - prefix[:, end - 1] * self.tables[1][3])
                single[at] = piece
            yield end, 1, np.arange(rows), single
            for length in self.tables:
                if 1 < length <= end:
                    at, piece = self._find(length, prefix[:, end] - prefix[:, end - length] * self.tables[length][3])
                    if len(at):
                        yield end, length, at, piece

    def along(self, word: str) -> list[list[tuple[int, int]]]:
        """(length, piece) of the pieces that end at each place of one long word."""
        step = (np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) * np.uint64(2654435761) + np.uint64(12345)).tolist()
        h, prefix = 0, np.zeros(len(step) + 1, np.uint64)
        for k, s in enumerate(step):
            h = (h * self.MULTIPLIER + s) & (1 << 64) - 1
            prefix[k + 1] = h
        out: list[list[tuple[int, int]]] = [[(1, self.size)] for _ in step]
        for length in self.tables:
            if length <= len(step):
                for at, piece in zip(*(x.tolist() for x in self._find(length, prefix[length:] - prefix[:-length] * self.tables[length][3]))):
                    if length == 1:
                        out[at][0] = (1, piece)
                    else:
                        out[at + length - 1].append((length, piece))
        return out

    def _groups(self, words: list[str], columns: int):
        """Index lists of the words of up to MATRIX characters, of like length, and of the others."""
        order = np.argsort([len(w) for w in words], kind="stable")
        sizes = np.array([len(words[i]) for i in order])
        short = int(np.searchsorted(sizes, MATRIX, "right"))
        some = max(1, min(20000, CELLS // (columns * (MATRIX + 1))))
        return [order[a : min(a + some, short)] for a in range(0, short, some)], order[short:].tolist()

    def forward(self, words: list[str], table: np.ndarray) -> np.ndarray:
        """log P(word) by language. table: (pieces + 1, languages); its last row is for single characters that are no piece."""
        out = np.empty((len(words), table.shape[1]))
        short, long = self._groups(words, max(1, table.shape[1]))
        for rows in short:
            codes, size = self.codes([words[i] for i in rows.tolist()])
            alpha = np.zeros((codes.shape[1] + 1, len(rows), table.shape[1]))
            alpha[0] = 1
            for end, length, at, piece in self.spans(codes):
                if length == 1:
                    alpha[end] = alpha[end - 1] * table[piece]
                else:
                    alpha[end, at] += alpha[end - length, at] * table[piece]
            out[rows] = np.log(np.maximum(alpha[size, np.arange(len(rows))], 1e-300))
        for i in long:
            out[i] = self._forward_along(words[i], table)
        return out

    def _forward_along(self, word: str, table: np.ndarray) -> np.ndarray:
        """The forward sums of one word, scaled on the way; only as many as the longest piece are kept."""
        kept, scale = [np.ones(table.shape[1])], np.zeros(table.shape[1])
        most = max(self.tables, default=1)
        for spans in self.along(word):
            now = sum(kept[-k] * table[piece] for k, piece in spans)
            kept = [*kept[1 - most :], now] if most > 1 else [now]
            if now.min(initial=1) < 1e-100:
                top = np.max(kept, 0)
                kept, scale = [x / top for x in kept], scale + np.log(top)
        return np.log(np.maximum(kept[-1], 1e-300)) + scale

    def expected(self, words: list[str], weight: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces (and of other characters, last) in one language."""
        total = np.zeros(self.size + 1)
        short, long = self._groups(words, 10)
        for rows in short:
            codes, size = self.codes([words[i] for i in rows.tolist()])
            width, n = codes.shape[1], np.arange(len(rows))
            spans = list(self.spans(codes))
            alpha, beta = np.zeros((width + 1, len(rows))), np.zeros((width + 1, len(rows)))
            alpha[0] = 1
            beta[size, n] = 1
            for e, k, at, x in spans:
                alpha[e, at] += alpha[e - k, at] * p[x]
            for e, k, at, x in reversed(spans):
                beta[e - k, at] += beta[e, at] * p[x]
            scale = weight[rows] / np.maximum(alpha[size, n], 1e-300)
            for e, k, at, x in spans:
                total += np.bincount(x, alpha[e - k, at] * p[x] * beta[e, at] * scale[at], len(total))
        logs = np.log(p).tolist() if long else []
        for i in long:
            spans = self.along(words[i])
            alpha, beta = [0.0], [float("-inf")] * len(spans) + [0.0]
            for e, found in enumerate(spans, 1):
                alpha.append(_log_sum([alpha[e - k] + logs[x] for k, x in found]))
            for e in range(len(spans), 0, -1):
                for k, x in spans[e - 1]:
                    beta[e - k] = _log_sum([beta[e - k], beta[e] + logs[x]])
            for e, found in enumerate(spans, 1):
                for k, x in found:
                    total[x] += weight[i] * exp(alpha[e - k] + logs[x] + beta[e] - alpha[-1])
        return total


def _log_sum(xs: list[float]) -> float:
    top = max(xs)
    return top if top == float("-inf") else top + log(sum(exp(x - top) for x in xs))


def learn(words: list[str], weight: np.ndarray, pieces: list[str], rounds: int = 3) -> np.ndarray:
    """The piece probabilities (pieces + 1) of one language, from its words and how often each occurs."""
    lattice, lengths = Lattice(pieces), np.array([len(x) for x in pieces] + [1])
    p = np.full(len(pieces) + 1, 1.0) / (10.0 ** np.minimum(lengths, 4))
    p /= p.sum()
    for _ in range(rounds):
        got = lattice.expected(words, weight, p) + 0.01
        p = np.maximum(got / got.sum(), FLOOR)
    return p


def spell(token: str) -> list[str]:
    """The scored words of a token: its runs of letters, each with the start mark."""
    return [START + run for run in LETTERS.findall(token)]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def word_counts(docs: DataFrame, sample_rows: int) -> DataFrame | None:
    """lang, w, n: counts of the scored words by language in the bounded sample."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1 << 30)).alias("u"))
    n = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row per language
    share = sample_rows / max(1, len(n))
    few = None
    for lang, rows in n.items():
        cond = (F.col("lang") == lang) & (F.col("u") < int(min(1.0, share / rows) * (1 << 30)))
        few = cond if few is None else few | cond
    if few is None:
        return None

    def count(batches):
        for batch in small_steps(batches, "text"):
            by: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                by.setdefault(lang, Counter()).update(spell((text or "").lower()))
            rows = [(lang, w, n) for lang, c in by.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else ((), (), ()), (pa.string(), pa.string(), pa.int64()))], ["lang", "w", "n"])

    return known.filter(few).select("lang", "text").mapInArrow(count, "lang string, w string, n long").groupBy("lang", "w").agg(F.sum("n").alias("n"))


def learn_all(counts: DataFrame | None, pieces: list[str], rounds: int = 3) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the table of piece probabilities (pieces + 1, languages). counts: lang, w, n."""

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("w")
        p = learn(table.column("w").to_pylist(), table.column("n").to_numpy().astype(float), pieces, rounds)
        return pa.table({"lang": table.column("lang").slice(0, 1), "p": pa.array([p.tobytes()], pa.binary())})

    rows = sorted(counts.groupBy("lang").applyInArrow(lambda table: trimmed(one, table), "lang string, p binary").collect()) if counts is not None else []  # one row per language
    return [r.lang for r in rows], np.stack([np.frombuffer(r.p, np.float64) for r in rows], 1) if rows else np.zeros((len(pieces) + 1, 0))


def predict(docs: DataFrame, langs: list[str], table: np.ndarray, pieces: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred and score of each row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        worker_state(None, None)
        lattice, at, scores, used = Lattice(pieces), {}, np.zeros((1024, len(langs))), 0
        for batch in small_steps(batches, "t"):
            if used > REMEMBER:
                at, used = {}, 0
            raw = [(t or "").lower().encode() for t in batch.column("t").to_pylist()]
            block = b"".join(raw)
            starts, stops, doc = word_spans(np.frombuffer(block, np.uint8), np.cumsum([len(x) for x in raw], dtype=np.int64))
            tokens, which = distinct(block, starts, stops - starts)
            new = [w for w in tokens if w not in at]
            parts = [spell(w.decode()) for w in new]
            words = list({p for ps in parts for p in ps})
            value = dict(zip(words, lattice.forward(words, table) if words else []))
            if used + len(new) > len(scores):
                scores = np.concatenate([scores, np.zeros((max(len(new), len(scores)), len(langs)))])
            for i, (w, ps) in enumerate(zip(new, parts), used):
                at[w] = i
                scores[i] = sum(value[p] for p in ps) if ps else 0
            used += len(new)
            mine = np.fromiter(map(at.__getitem__, tokens), np.int64, len(tokens))[which]
            total = np.stack([np.bincount(doc, scores[mine, k], len(raw)) for k in range(len(langs))], 1) if langs else np.zeros((len(raw), 0))
            some = total.any(1)
            best = total.argmax(1) if langs else np.zeros(len(raw), np.int64)
            sure = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1) if langs else np.zeros(len(raw))
            said = [langs[b] if s else "und" for b, s in zip(best.tolist(), some.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(said, pa.string()), pa.array(np.where(some, sure, 0.0))], ["k", "lang_pred", "score"])

    return docs.selectExpr(f"`{key}` k", f"`{text}` t").mapInArrow(lambda batches: trimmed_steps(run(batches)), f"k {kind}, lang_pred string, score double").withColumnRenamed("k", key)


def language_table(docs: DataFrame, vocabulary: str, sample_rows: int = 3000) -> DataFrame:
    pieces = load_pieces(vocabulary)
    langs, table = learn_all(word_counts(docs, sample_rows), pieces)
    return predict(docs.select("doc_id", "text"), langs, table, pieces).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
