"""Documents packed into chunks of bounded size, written once to the shared folder, and their symbols.

A chunk is one row: its number, the keys of its documents, their sizes in bytes (-1 for a null text)
and their UTF-8 texts as one zstd block. Operators that read the texts more than once work on chunks:
the numbers stay the same for all readers, and what goes back to a chunk is addressed by its number.
A text beyond the chunk size is a chunk of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import small_steps
from .common import materialize, trimmed_steps, worker_state

CHUNK_BYTES = 2 << 20


def pack(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, key: str = "doc_id", text: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """chunk (long), keys, sizes, body, and x0, x1, ... with the values of the `extra` columns."""
    kind = docs.schema[key].dataType.simpleString()
    kinds = [docs.schema[c].dataType.simpleString() for c in extra]

    def run(batches):
        worker_state(None, None)
        part, seq = TaskContext.get().partitionId(), 0
        columns, sizes, body, held = [[] for _ in range(1 + len(kinds))], [], [], 0

        def flush(types):
            cols = [pa.array([part << 32 | seq], pa.int64()), pa.array([columns[0]], pa.list_(types[0])), pa.array([sizes], pa.list_(pa.int64())), pa.array([zstandard.ZstdCompressor(3).compress(b"".join(body))], pa.binary())]
            cols += [pa.array([xs], pa.list_(t)) for xs, t in zip(columns[1:], types[1:])]
            return pa.RecordBatch.from_arrays(cols, ["chunk", "keys", "sizes", "body", *(f"x{i}" for i in range(len(kinds)))])

        types = None
        for batch in small_steps(batches, "t", chunk_bytes):
            types = [batch.schema.field(c).type for c in ("k", *(f"x{i}" for i in range(len(kinds))))]
            for k, t, *xs in zip(*(c.to_pylist() for c in batch.columns)):
                raw = (t or "").encode()
                if held and held + len(raw) > chunk_bytes:
                    yield flush(types)
                    seq, columns, sizes, body, held = seq + 1, [[] for _ in columns], [], [], 0
                for to, x in zip(columns, (k, *xs)):
                    to.append(x)
                sizes.append(-1 if t is None else len(raw))
                body.append(raw)
                held += len(raw)
        if sizes:
            yield flush(types)

    rows = docs.selectExpr(f"`{key}` k", f"`{text}` t", *(f"`{c}` x{i}" for i, c in enumerate(extra)))
    return materialize(rows.mapInArrow(lambda batches: trimmed_steps(run(batches)), f"chunk long, keys array<{kind}>, sizes array<long>, body binary" + "".join(f", x{i} array<{x}>" for i, x in enumerate(kinds))), "chunks")


def volume(chunks: DataFrame) -> int:
    """Bytes of the texts of all chunks."""
    return chunks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + F.greatest(x, F.lit(0))))).first()[0] or 0


def unpack(body: bytes, sizes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The texts as one block, and the ends of the documents in it."""
    return zstandard.ZstdDecompressor().decompress(body) if body else b"", np.cumsum(np.maximum(sizes, 0))


def pack_bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unpack_bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)
