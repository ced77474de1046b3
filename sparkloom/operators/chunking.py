"""Chunk packing of prose and of tokens (CHK1-CHK6), and section carry-forward (SRC8, WIN7).

Packing is sequential within a document and independent between documents. Where a row holds a whole document
(an array of its items), it is packed where it lies, without a shuffle; items in rows of their own are brought together first.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import CROSS_REFERENCE_PATTERN

MAX_CHARS, OVERLAP_SENTENCES = 1500, 2
MAX_TOKENS, OVERLAP_TOKENS, CLAMP_TOKENS = 512, 64, 600


def section_carry(rows: DataFrame, doc: str, order: str, heading: Column) -> DataFrame:
    """Adds section: the last heading at or before each row."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.last(heading, ignorenulls=True).over(w))


def tail_sentences(text: str, n: int = OVERLAP_SENTENCES) -> str:
    parts = [x for x in text.split(". ") if x]
    return ". ".join(parts[-n:]) if len(parts) > n else ""


def pack_prose(items, max_chars: int = MAX_CHARS, overlap: int = OVERLAP_SENTENCES) -> list[tuple]:
    """(text, section, page, char_offset, has_overlap) of (is_heading, text, page) in order.

    A chunk ends at `max_chars` or at a heading; the last sentences of one go before the next of the same section.
    """
    out, held, section, page, offset, lead, size = [], [], "", 1, 0, "", 0

    def close(end: bool) -> str:
        if not held:
            return lead
        body = " ".join(held)
        out.append(((lead + " " + body).strip() if lead else body, section, page, offset, bool(lead)))
        held.clear()
        return "" if end else tail_sentences(body, overlap)

    for is_heading, text, at in items:
        text = (text or "").strip()
        if not text:
            continue
        if is_heading:
            close(True)
            lead, section, size = "", text, 0
            continue
        if not held:
            page = at
        held.append(text)
        size += len(text)
        offset += len(text) + 1
        if size >= max_chars:
            lead, size = close(False), 0
    close(True)
    return out


PROSE_SCHEMA = "chunk_no int, text string, section string, page int, char_offset long, has_overlap boolean"


def _packed(docs: DataFrame, key: str, items: Column, pack, schema: str) -> DataFrame:
    """key and the chunks that `pack` makes of each row's array of items, in batches."""
    kind, names = docs.schema[key].dataType.simpleString(), ["k", *(x.split()[0] for x in schema.split(", "))]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([(k, i, *x) for k, found in zip(part["k"], part["items"]) for i, x in enumerate(pack(found))], columns=names)

    return docs.select(F.col(key).alias("k"), items.alias("items")).mapInPandas(run, f"k {kind}, {schema}").withColumnRenamed("k", key)


def gathered(rows: DataFrame, key: str, order: str, *fields: str) -> DataFrame:
    """key and items: the rows of a document as one array of structs, in order."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("items"))


def prose_chunks(docs: DataFrame, items: Column, key: str = "doc_id") -> DataFrame:
    """items: array of struct<is_heading, text, page> in order. One row per chunk (CHK1)."""
    return _packed(docs, key, items, lambda found: pack_prose((x["is_heading"], x["text"], x["page"]) for x in found), PROSE_SCHEMA)


def estimate(text: str) -> int:
    return int(len(text.split()) * 1.3)


def split_oversized(text: str, count=estimate, most: int = MAX_TOKENS) -> list[str]:
    """Paragraphs, else sentences, else words, regrouped up to `most` tokens (CHK3)."""
    for pattern, glue in ((r"\n\s*\n", "\n\n"), (r"(?<=[.!?])\s+", " "), (r"\s+", " ")):
        parts = [x for x in re.split(pattern, text) if x.strip()]
        if len(parts) > 1 and (glue == " " and pattern == r"\s+" or all(count(x) <= most for x in parts)):
            out, held = [], []
            for x in parts:
                if held and count(glue.join([*held, x])) > most:
                    out.append(glue.join(held))
                    held = []
                held.append(x)
            return [*out, glue.join(held)] if held else out
    return [text]


def overlap_tail(text: str, tokens: int = OVERLAP_TOKENS) -> str:
    """The last words that make about `tokens` tokens (CHK6)."""
    return " ".join(text.split()[-max(1, int(tokens / 1.3)) :]) if text.strip() else ""


def pack_tokens(elements, count=estimate, most: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS) -> list[dict]:
    """Chunks of elements (text, modality, page_no, section_path) in order: a new top section ends a chunk without overlap, the size with one."""
    out, held, size, lead = [], [], 0, ""

    def close() -> str:
        body = "\n\n".join(e[0] for e in held)
        text = (lead + "\n\n" + body).strip() if lead else body
        total = sum(count(e[0]) for e in held) or 1
        share: dict[str, float] = {}
        for e in held:
            share[e[1]] = share.get(e[1], 0.0) + count(e[0]) / total
        pages = sorted({int(e[2]) for e in held})
        paths = list(dict.fromkeys(h for e in held for h in e[3]))
        key = text + str([int(e[2]) for e in held])
        out.append({"text": text, "n_tokens": min(CLAMP_TOKENS, max(1, count(text))), "page_first": pages[0], "page_last": pages[-1], "headings": paths, "shares": share,
                    "cross_refs": re.findall(CROSS_REFERENCE_PATTERN, text), "chunk_id": hashlib.sha256(key.encode()).hexdigest()[:24]})
        held.clear()
        return overlap_tail(body, overlap)

    top = None
    for text, modality, page, path in elements:
        path = list(path) if path is not None else []
        head = path[0] if path else None
        if held and head != top:
            close()
            size, lead = 0, ""
        top = head
        for piece in split_oversized(text, count, most) if count(text) > most else [text]:
            n = count(piece)
            if held and size + n > most:
                lead, size = close(), 0
            held.append((piece, modality, page, path))
            size += n
    if held:
        close()
    return out


def trim_path(path: list[str], level: int, heading: str) -> list[str]:
    """The section path at a heading: what stands above its level, then the heading."""
    return [*path[: max(0, level - 1)], heading]


def pack_elements(items) -> list[tuple]:
    """(text, modality, page, section_path) of the items that are no headings, in order of page and place; a heading trims the path to its level."""
    out, path = [], []
    for x in sorted(items, key=lambda x: (x["page"], x["place"])):
        if x["level"]:
            path = trim_path(path, x["level"], (x["text"] or "").strip())
        else:
            out.append((x["text"], x["modality"], x["page"], list(path)))
    return out


def element_stream(docs: DataFrame, items: Column, key: str = "doc_id") -> DataFrame:
    """items: array of struct<page, place, level (0 for what is no heading), modality, text>. One row per element, in reading order, with its section path (SRC8)."""
    return _packed(docs, key, items, pack_elements, "element_no int, text string, modality string, page int, section_path array<string>")


TOKEN_SCHEMA = "chunk_no int, text string, n_tokens int, page_first int, page_last int, headings array<string>, shares map<string,double>, cross_refs array<string>, chunk_id string"


def token_chunks(docs: DataFrame, items: Column, key: str = "doc_id") -> DataFrame:
    """items: array of struct<text, modality, page_no, section_path> in order. One row per chunk (CHK2, CHK4, AGG13, AGG14)."""

    def pack(found):
        for c in pack_tokens((x["text"], x["modality"], x["page_no"], x["section_path"]) for x in found):
            yield c["text"], c["n_tokens"], c["page_first"], c["page_last"], c["headings"], c["shares"], c["cross_refs"], c["chunk_id"]

    return _packed(docs, key, items, pack, TOKEN_SCHEMA)
