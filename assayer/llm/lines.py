"""Line dedup: content-defined line chunks.

A text is its lines. A chunk ends at a line with words whose hash is below those of the lines with words
beside it, every third or so, so boundaries move with the content and not with the line numbers, and
a chunk has two lines with words at least where its text has. A chunk of two or more that stands anywhere before, in the order of (doc_id, chunk), with the
same bytes, is removed. Digests find the candidates; bytes decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import flat, sieve
from assayer.llm.lineage import cut, release

#: A chunk ends here at the latest: a run of one line repeated has no boundary of its own.
MOST_LINES = 64
LEAST_LINES = 2
#: A chunk with more copies than this, and than the HOT_KEYS-th part of all chunks, is a hot one.
HOT_ROWS, HOT_KEYS = 1000, 10_000


def chunks(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the chunks (without their last newline), their text's index, and whether they have
    LEAST_LINES lines with words. A text's chunks joined by newlines are the text; an empty one has none."""
    none = np.empty(0, np.int64)
    if not len(buf):
        return none, none, none, none.astype(bool)
    breaks = np.flatnonzero(buf == 10)
    full = np.diff(off) > 0
    # A newline at a text's end is followed by an empty last line, so that joining gives the text back.
    doc_of_break = np.searchsorted(off, breaks, "right") - 1
    starts = np.concatenate([off[:-1][full], breaks + 1])
    doc = np.concatenate([np.flatnonzero(full), doc_of_break])
    order = np.lexsort((starts, doc))
    starts, doc = starts[order], doc[order]
    ends = np.append(starts[1:] - 1, 0)
    last = np.append(doc[1:] != doc[:-1], True)
    ends[last] = off[1:][doc[last]]
    h = flat.span_hashes(buf, starts, np.maximum(ends, starts))
    words = np.concatenate([[0], np.cumsum(~flat._SPACE[buf])])
    worded = words[np.maximum(ends, starts)] > words[starts]
    filled = np.concatenate([[0], np.cumsum(worded)])
    at, rank = np.flatnonzero(worded), flat.mix(h[worded])
    inner = np.arange(1, max(len(at) - 2, 1))  # two lines with words before the end and two after it, in one text
    inner = inner[(doc[at[inner - 1]] == doc[at[inner + 2]])] if len(at) > 3 else none
    stop = last.copy()
    stop[at[inner[(rank[inner] < rank[inner - 1]) & (rank[inner] <= rank[inner + 1])]]] = True
    first = np.concatenate([[True], stop[:-1]])
    run = np.arange(len(h)) - np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
    stop |= run % MOST_LINES == MOST_LINES - 1
    end = np.flatnonzero(stop)
    short = np.flatnonzero((np.diff(np.concatenate([[0], filled[end + 1]])) < LEAST_LINES) & ~np.concatenate([[True], last[end[:-1]]]))
    stop[end[short - 1]] = False  # joined to the chunk before
    first = np.flatnonzero(np.concatenate([[True], stop[:-1]]))
    stop = np.flatnonzero(stop)
    return starts[first], np.maximum(ends[stop], starts[first]), doc[first], filled[stop + 1] - filled[first] >= LEAST_LINES


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in flat.slices(batch):
            buf, off = flat.bytes_of(part.column("text"))
            a, b, doc, use = chunks(buf, off)
            number = np.arange(len(doc)) - np.searchsorted(doc, doc)
            h = flat.span_hashes(buf, a, b)
            low = flat.span_hashes(buf ^ np.uint8(0x5A), a, b)
            pick = pa.array(doc[use])
            yield pa.RecordBatch.from_arrays([part.column("k_id").take(pick), part.column("k_text").take(pick), pa.array(number[use]), pa.array(flat.signed(h[use])), pa.array(flat.signed(low[use]))], names=["k_id", "k_text", "chunk", "h1", "h2"])


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the chunks that a row's list names."""
    for batch in batches:
        for part in flat.slices(batch):
            buf, off = flat.bytes_of(part.column("text"))
            a, b, doc, _ = chunks(buf, off)
            head = np.searchsorted(doc, np.arange(part.num_rows))
            wanted = part.column("wanted")
            row = np.repeat(np.arange(part.num_rows), np.diff(wanted.offsets.to_numpy()))
            items = wanted.flatten()
            at = head[row] + items.field("chunk").to_numpy(zero_copy_only=False)
            pick = pa.array(row)
            own = pa.array([buf[x:y].tobytes() for x, y in zip(a[at], b[at])], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("k_id").take(pick), part.column("k_text").take(pick), *(items.field(c) for c in ("chunk", "h1", "h2", "part")), own], names=["k_id", "k_text", "chunk", "h1", "h2", "part", "own"])


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in flat.slices(batch):
            buf, off = flat.bytes_of(part.column("text"))
            a, b, doc, _ = chunks(buf, off)
            edge = np.searchsorted(doc, np.arange(part.num_rows + 1)).tolist()
            texts = part.column("text")
            out, removed = [], []
            for i, gone in enumerate(part.column("gone").to_pylist()):
                gone = set(gone or ())
                removed.append(len(gone))
                out.append(b"\n".join(buf[a[k] : b[k]].tobytes() for k in range(edge[i], edge[i + 1]) if k - edge[i] not in gone) if gone else None)
            new = pa.array(out, pa.binary()).cast(pa.string())
            kept = pc.if_else(pa.array([n > 0 for n in removed], pa.bool_()), new, texts)
            yield pa.RecordBatch.from_arrays([part.column("row"), kept, pa.array(np.diff(np.array(edge))), pa.array(removed, pa.int64())], names=["row", "kept", "n_chunks", "n_removed_chunks"])


def repeated_chunks(keyed: DataFrame) -> DataFrame:
    """(k_id, k_text, gone): for each document with repeated chunks, the numbers of those that go. keyed: k_id, k_text, text."""
    keyed = keyed.where("k_id is not null and length(text) > 0")
    found = cut(keyed.mapInArrow(_digests, "k_id long, k_text long, chunk long, h1 long, h2 long"))
    place = F.struct("k_id", "chunk", "k_text")
    first = found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    first = cut(first.where("n > 1"))
    # Copies of a chunk that has very many are dealt over tasks. There are HOT_KEYS such chunks at most, as each
    # has more than its share of all rows, so their list can go to all tasks.
    least = max(HOT_ROWS, found.count() // HOT_KEYS)
    hot = F.broadcast(first.where(F.col("n") > least).select("h1", "h2", F.ceil(F.col("n") / least).cast("int").alias("parts")))
    salted = found.join(hot, ["h1", "h2"], "left")
    salted = salted.withColumn("part", F.coalesce(F.pmod(F.xxhash64("k_id", "k_text", "chunk"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    parts = F.greatest(F.lit(1), F.ceil(F.when(F.col("n") > least, F.col("n") / least))).cast("int")
    spread = first.select("h1", "h2", "first", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    again = salted.join(spread, ["h1", "h2", "part"]).where(place != F.col("first"))
    again = cut(again.select("k_id", "k_text", "chunk", "h1", "h2", "part").distinct())
    lead_of = spread.join(again.select("h1", "h2", "part").distinct(), ["h1", "h2", "part"], "left_semi")
    leads = lead_of.select("first.k_id", "first.k_text", "first.chunk", "h1", "h2", "part")

    def content(items: DataFrame) -> DataFrame:
        lists = cut(items.groupBy("k_id", "k_text").agg(F.collect_list(F.struct("chunk", "h1", "h2", "part")).alias("wanted")))
        texts = sieve.through(keyed, "k_text", sieve.of(lists.select("k_text")))
        return texts.join(lists, ["k_id", "k_text"]).mapInArrow(_bytes, "k_id long, k_text long, chunk long, h1 long, h2 long, part int, own binary")

    lead = content(leads).select("h1", "h2", "part", F.col("own").alias("lead")).dropDuplicates(["h1", "h2", "part"])
    same = content(again).join(lead, ["h1", "h2", "part"]).where("own = lead").select("k_id", "k_text", "chunk").distinct()
    gone = cut(same.groupBy("k_id", "k_text").agg(F.collect_list("chunk").alias("gone")))
    release(keyed.sparkSession)
    return gone


def stripped(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: row (all its columns as a struct), kept (the text left), n_chunks, n_removed_chunks.

    A chunk ends after MOST_LINES lines at the latest, so a long run of one line is cut by number, not by content, and may
    keep lines that other cuts would have found repeated. Texts may have any length.
    Rows with the same doc_id and text are one document: none of them is a repetition of the other. A null
    doc_id takes no part: its text stays and nothing is removed because of it. Null, empty and one-line texts stay as
    they are. A text of which every chunk is repeated becomes empty. Of equal chunks the one with the smallest
    (doc_id, chunk number) stays, within a document too.
    """
    base = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("k_id"), F.xxhash64("text").alias("k_text"), F.col("text").cast("string").alias("text"))
    gone = repeated_chunks(base.select("k_id", "k_text", "text"))
    kind = base.schema["row"].dataType.simpleString()
    bits = sieve.of(gone.select("k_text"))
    touched = sieve.through(base, "k_text", bits).join(gone, ["k_id", "k_text"], "left").select("row", "text", "gone")
    others = sieve.through(base, "k_text", bits, wanted=False).select("row", "text", F.lit(None).cast("array<long>").alias("gone"))
    return touched.union(others).mapInArrow(_strip, f"row {kind}, kept string, n_chunks long, n_removed_chunks long")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_chunks, n_removed_chunks, n_bytes, n_removed_bytes, kept_sha256 for each row of docs (doc_id, text)."""
    out = stripped(docs.select("doc_id", "text"))
    before, after = F.coalesce(F.octet_length("row.text"), F.lit(0)).cast("long"), F.coalesce(F.octet_length("kept"), F.lit(0)).cast("long")
    return out.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_chunks", "n_removed_chunks", before.alias("n_bytes"), (before - after).alias("n_removed_bytes"), F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated chunks out of its text, all other columns as they were.

    Rows whose text repeats others entirely, so that nothing is left, go; texts without content before stay.
    """
    out = stripped(docs).where("n_removed_chunks = 0 or length(kept) > 0")
    return out.select(F.col("row").withField("text", F.col("kept")).alias("row")).select("row.*")
