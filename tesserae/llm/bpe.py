"""BPE encoding and decoding of whole texts by the tokenisation automaton of ``bpe_automaton``.

Defined cases: null text counts as empty; empty text has no ids; special strings in a text become their ids, as the
library does by default; repeated rows give repeated rows; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tesserae.llm.bpe_automaton import automaton
from tesserae.llm.common import inputs, slices


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(path)
        for batch, texts in slices(batches, "text"):
            ids = pa.array([machine.encode(t) for t in texts.to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return inputs(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every list of ids (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(path)
        for batch in batches:
            texts = pa.array([machine.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "text"])

    return encoded.selectExpr("cast(doc_id as long) doc_id", "cast(ids as array<int>) ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Each text encoded and decoded again in one pass; only counts and digests leave the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(path)
        for batch, texts in slices(batches, "text"):
            n, by_ids, by_text = [], [], []
            shown = machine.decimal.__getitem__
            for t in texts.to_pylist():
                ids = machine.encode(t)
                n.append(len(ids))
                by_ids.append(hashlib.sha256(",".join(map(shown, ids)).encode()).hexdigest())
                by_text.append(hashlib.sha256(machine.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(by_ids, pa.string()), pa.array(by_text, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return inputs(docs).mapInArrow(run, schema)
