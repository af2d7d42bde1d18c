"""Token counts by section, from one encoding of each whole document.

A document is encoded once by a byte-level BPE, whose tokens are byte strings
that join to the text, so token spans are running sums of token lengths.
Sections are consecutive spans that cover the text (lines with their line feed
by default, or the fields of a record laid end to end).  Token spans are
interval-joined to section spans by sorted search, and a token that crosses a
boundary is allocated by one rule: to the section that holds most of its bytes,
the earlier one of equals.

Defined cases: null text has no sections and gives one row with section null
and no tokens; empty text has one empty section; special-token strings in a text
are ordinary text; very long texts are encoded whole (a long run of blanks is
handed to the merges as the one piece that the splitting pattern makes of it: the
pattern itself overflows its stack there); repeated rows count each; null fields
are empty; an id column named like a result column is refused.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import text_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's publisher splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Runs of white space from this length on don't go through the pattern.
_LONG = 2048
_LONG_RUN = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % _LONG)


def encode(text: str, split, whole) -> list[int]:
    """The tokens of a text: ``split`` has the pattern, ``whole`` takes its text as one piece.

    Of a run of white space the pattern makes one piece up to its last character,
    which goes to what follows; at the end of a text the whole run is a piece.
    """
    out: list[int] = []
    at = 0
    for run in _LONG_RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        out += split.encode_ordinary(text[at : run.start()])
        out += whole.encode_ordinary(text[run.start() : end])
        at = end
    return out + split.encode_ordinary(text[at:]) if at else split.encode_ordinary(text)


def _encoding(data: bytes):
    """The encoding, one that takes a text as one piece, and the byte length of every token; kept for the life of a worker."""
    import tiktoken

    kept = tiktoken.registry.ENCODINGS
    key = f"tessera-{hash(data)}"
    if key not in kept:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        kinds = [tiktoken.Encoding(f"{key}-{i}", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for i, p in enumerate((PATTERN, r"(?s:.+)"))]
        kept[key] = (*kinds, lengths)
    return kept[key]


def allocate(token_ends: np.ndarray, section_ends: np.ndarray) -> np.ndarray:
    """The section of each token, both as ascending ends of spans that cover the same bytes."""
    starts = np.concatenate([[0], token_ends[:-1]])
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, token_ends, side="left")
    out = np.minimum(first, len(section_ends) - 1)
    bounds = np.concatenate([[0], section_ends])
    for i in np.flatnonzero(last > first):
        held = [min(token_ends[i], bounds[s + 1]) - max(starts[i], bounds[s]) for s in range(first[i], last[i] + 1)]
        out[i] = first[i] + int(np.argmax(held))
    return out


def line_ends(text: bytes) -> np.ndarray:
    """Ends of the lines of a text, each with its line feed; at least one."""
    ends = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 10) + 1
    return ends if len(ends) and ends[-1] == len(text) else np.append(ends, len(text))


_RESULT = ("section", "section_start", "section_end", "n_tokens", "first_token", "field")
_KINDS = "section int, section_start long, section_end long, n_tokens long, first_token long"


def _rows(docs: DataFrame, vocabulary: str, fields: int, id_name: str) -> DataFrame:
    """Rows of ``docs (id, c1 .. cn)`` by section: lines of the one text, or the texts of a record."""
    text_batches(docs.sparkSession)
    if id_name in _RESULT:
        raise ValueError(f"{id_name} is the name of a result column; rename the id column")
    with open(vocabulary, "rb") as file:
        data = docs.sparkSession.sparkContext.broadcast(file.read())  # about a megabyte, whatever the corpus
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, one_piece, lengths = _encoding(data.value)
        for batch in batches:
            rows, parts = [], []
            for row in range(batch.num_rows):
                texts = [batch.column(1 + k)[row].as_py() for k in range(fields)]
                if fields == 1 and texts[0] is None:
                    rows.append(row)
                    parts.append(None)
                    continue
                pieces = [(t or "").encode() for t in texts]
                whole = b"".join(pieces)
                ends = line_ends(whole) if fields == 1 else np.cumsum([len(p) for p in pieces])
                tokens = np.asarray(encode(whole.decode(), split, one_piece), dtype=np.int64)
                count = np.bincount(allocate(np.cumsum(lengths[tokens]), ends), minlength=len(ends)) if len(tokens) else np.zeros(len(ends), np.int64)
                lead = np.concatenate([[0], np.cumsum((np.frombuffer(whole, np.uint8) & 0xC0) != 0x80)]) if not whole.isascii() else None
                at = np.concatenate([[0], ends])
                chars = at if lead is None else lead[at]
                rows.extend([row] * len(ends))
                parts.append(np.stack([np.arange(len(ends)), chars[:-1], chars[1:], count, np.cumsum(count) - count]))
                if len(rows) >= 50_000:
                    yield emit(batch, rows, parts)
                    rows, parts = [], []
            if rows:
                yield emit(batch, rows, parts)

    def emit(batch: pa.RecordBatch, rows: list[int], parts: list) -> pa.RecordBatch:
        gap = np.array([[-1], [0], [0], [0], [0]])
        table = np.concatenate([gap if p is None else p for p in parts], axis=1)
        none = table[0] < 0
        columns = [pa.array(table[0].astype(np.int32), mask=none), pa.array(table[1], mask=none), pa.array(table[2], mask=none), pa.array(table[3]), pa.array(table[4], mask=none)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *columns], names=["id", "section", "section_start", "section_end", "n_tokens", "first_token"])

    return docs.mapInArrow(run, f"id {id_type}, {_KINDS}")


def line_token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """A row per line: id, ``section``, its span in code points, ``n_tokens`` and the number of its first token."""
    return _rows(docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("c1")), vocabulary, 1, id_col).withColumnRenamed("id", id_col)


def field_token_counts(docs: DataFrame, fields: list[str], id_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """A row per field of a record whose fields are encoded as one text, laid end to end."""
    if len(fields) < 2:
        raise ValueError("two fields at least")
    rows = docs.select(docs[f"`{id_col}`"].alias("id"), *[docs[f"`{f}`"].cast("string").alias(f"c{i}") for i, f in enumerate(fields)])
    names = F.array(*map(F.lit, fields))
    return _rows(rows, vocabulary, len(fields), id_col).withColumn("field", F.get(names, F.col("section"))).withColumnRenamed("id", id_col)


def op9_token_attribution(spark, sf_dir: str) -> DataFrame:
    return line_token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
