"""Token counts: the library encodes batches inside an Arrow function and only lengths leave it.

A batch holds about ``batch_bytes`` of text. A longer text is split into segments at safe boundaries, so neither the
library nor Python ever holds the ids of a whole long text, and the segment counts add up to the count of the text.

Safe boundaries. sentencepiece (this model: no normalisation, no dummy-prefix dependence inside a text, spaces kept):
between a non-space and the single space before a non-space. Merges only build vocabulary pieces, and no piece holds a
space mark after another character (checked when the model is loaded), so no merge crosses that place. The encoder
puts a space mark before a text, so a segment is passed without its leading space. Byte-level BPE: before a space
between two non-space characters, since the pre-tokeniser always starts a new word there.

Defined cases: null text counts as empty; empty text has 0 tokens; repeated rows give repeated rows; extra columns are
left out; a text without any safe boundary is encoded in one call.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tesserae.llm.common import inputs, slices

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: A space between two characters that are no white space and no space mark.
BOUNDARY = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


def safe_segments(text: str, limit: int) -> list[str]:
    """``text`` cut at safe boundaries into segments of about ``limit`` characters; each starts with its space but the first."""
    parts, start = [], 0
    while len(text) - start > limit:
        found = BOUNDARY.search(text, start + limit)
        if not found:
            break
        parts.append(text[start : found.start()])
        start = found.start()
    return [*parts, text[start:]]


@lru_cache(maxsize=4)
def counter(path: str):
    """A function from texts to their numbers of tokens, for a .json (tokenizers) or .model (sentencepiece) file."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        crossing = any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))
        return (lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]), not crossing, True
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return (lambda texts: [len(e.ids) for e in library.encode_batch_fast(texts, add_special_tokens=False)]), True, False


def count_texts(texts: list[str], path: str, segment_chars: int, batch_bytes: int) -> list[int]:
    count, safe, strip = counter(path)
    totals, waiting, owners, held = [0] * len(texts), [], [], 0

    def flush() -> None:
        nonlocal held
        for i, n in zip(owners, count(waiting), strict=True):
            totals[i] += n
        waiting.clear()
        owners.clear()
        held = 0

    for i, text in enumerate(texts):
        for k, part in enumerate(safe_segments(text, segment_chars) if safe else [text]):
            waiting.append(part[1:] if k and strip else part)
            owners.append(i)
            held += len(part)
            if held >= batch_bytes:
                flush()
    flush()
    return totals


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, segment_chars: int = 50_000, batch_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text", batch_bytes):
            n = pa.array(count_texts(texts.to_pylist(), path, segment_chars, batch_bytes), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.cast(pc.binary_length(texts), pa.int64()), n, pc.greater(n, limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return inputs(docs).mapInArrow(run, SCHEMA)
