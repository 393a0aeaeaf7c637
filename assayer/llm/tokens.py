"""Token counts: offset-mapped attribution to sections.

A document is encoded once, as a whole, with a byte-level BPE vocabulary, so token byte lengths add up to the
text and give every token's span of characters. Sections (here the lines' paragraphs, or any given
spans) get tokens by an interval join of spans. A token that crosses a boundary belongs, whole, to
the section of its first byte; crossings are counted as well.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import flat
from assayer.llm.lineage import small_batches

#: Bytes encoded in one call; longer texts are cut between a word and the space before the next one, where the
#: vocabulary's pre-tokenizer cuts too.
PIECE = 1 << 18
SECTION_BREAK = b"\n"
FIELDS = ("prose", "table", "blank")


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        size[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size


def ids_of(text: str, own) -> np.ndarray:
    """Ids of a whole text."""
    if len(text) <= PIECE:
        return np.array(own.encode_ordinary(text), np.int64)
    out, at = [], 0
    while at < len(text):
        stop = at + PIECE
        # A letter, one space, a letter: the pattern always cuts before that space.
        while stop < len(text) and not (text[stop] == " " and text[stop - 1].isalpha() and text[stop - 1].isascii() and text[stop + 1 : stop + 2].isalpha()):
            stop += 1
        out.append(np.array(own.encode_ordinary(text[at:stop]), np.int64))
        at = stop
    return np.concatenate(out)


def sections(data: bytes) -> np.ndarray:
    """Ends (exclusive, in bytes) of a text's lines, each with its newline."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == SECTION_BREAK[0]) + 1
    return ends if len(ends) and ends[-1] == len(data) or not len(data) else np.append(ends, len(data))


def attributed(token_sizes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, int]:
    """Tokens of each section by their first byte's place, and how many cross a boundary."""
    stop = np.cumsum(token_sizes)
    home = np.searchsorted(ends, stop - token_sizes, "right")
    return np.bincount(home, minlength=len(ends)), int((np.searchsorted(ends, stop - 1, "right") != home).sum())


def fields(data: bytes, ends: np.ndarray) -> np.ndarray:
    """Each section's field: 0 prose, 1 table (a | between blanks), 2 blank."""
    start, out = 0, np.zeros(len(ends), np.int64)
    for i, end in enumerate(ends.tolist()):
        line = data[start:end]
        out[i] = 1 if b" | " in line else 0 if line.strip() else 2
        start = end
    return out


def token_counts(docs: DataFrame, path: str, pattern: str, per_section: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens, n_sections, n_crossing, most_in_section, and the tokens of
    each field (n_prose, n_table, n_blank); with per_section also section_tokens, array<int>.

    A section is a line with its newline. path and pattern: the vocabulary's file and pre-tokenizer, at the
    same place on every executor. Null and empty texts have no tokens and no sections. Repeated rows and null
    doc_ids are counted like any other; other columns are not read.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, size = encoding(path, pattern)
        for batch in batches:
            for part in flat.slices(batch):
                rows, lists = [], []
                for text in part.column("text").to_pylist():
                    data = (text or "").encode()
                    ends = sections(data)
                    ids = ids_of(text or "", own)
                    each, crossing = attributed(size[ids], ends)
                    by_field = np.bincount(fields(data, ends), each, len(FIELDS)).astype(np.int64)
                    rows.append((len(ids), len(ends), crossing, int(each.max(initial=0)), *by_field.tolist()))
                    lists.append(each)
                columns = [part.column("doc_id"), *(pa.array(x, pa.int64()) for x in zip(*rows))]
                names = ["doc_id", "n_tokens", "n_sections", "n_crossing", "most_in_section", *(f"n_{f}" for f in FIELDS)]
                if per_section:
                    columns.append(pa.array(lists, pa.list_(pa.int32())))
                    names.append("section_tokens")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, "doc_id long, n_tokens long, n_sections long, n_crossing long, most_in_section long, " + ", ".join(f"n_{f} long" for f in FIELDS) + (", section_tokens array<int>" if per_section else ""))
