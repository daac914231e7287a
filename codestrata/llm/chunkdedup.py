"""Substring dedup by content-defined chunks: a gear hash cuts, digests find repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table, texts, written

#: Mean bytes between cuts before short chunks merge; chunks of under ``LEAST`` bytes join the next one.
MEAN, LEAST = 28, 8
#: Bytes of whole repeated chunks in a row that are removed; shorter repeats are ordinary speech. A passage of
#: fifty words has some 250 bytes at least, its whole chunks fewer.
SPAN = 96
#: The same where matches are drawn out byte by byte, so that a passage has its full length: some 35 words.
PASSAGE = 192
#: A single repeated chunk of so many bytes is looked at like two in a row; chunks at each end of a run whose
#: first occurrences are compared; chunks around a first occurrence that are carried. A match that goes on
#: over a whole chunk has the cuts of that chunk, once 16 bytes are equal, so it is in the run already.
ALONE, INNER, AROUND = 32, 2, 3
#: One random value per byte; the hash at a place depends on the last 16 bytes.
GEAR = np.random.default_rng(20_240_601).integers(0, 1 << 16, 256, dtype=np.uint16)


def cuts(data: bytes) -> np.ndarray:
    """End positions of the chunks of ``data``, the last of which is its end.

    The gear hash h = 2 h + GEAR[byte] (mod 2^16) forgets a byte after 16 steps, so all places are hashed
    at once by doubling the width; a place is a cut if the hash is low. A cut less than ``LEAST`` after
    another hit does not count. So cuts depend on the bytes just before them alone, and chunks come back
    into step right after an insertion.
    """
    if not data:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(data, np.uint8)
    h, width = GEAR[raw], 1
    while width < 16:
        h[width:] += h[:-width] << np.uint16(width)
        width *= 2
    hit = np.flatnonzero(h[:-1] < (1 << 16) // MEAN) + 1
    hit = hit[(raw[hit] & 0xC0) != 0x80]  # never inside a character
    return np.append(hit[np.diff(hit, prepend=-LEAST) >= LEAST], len(data))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_64_intdigest
    for b in batches:
        row, hashes, start, end = [], [], [], []
        for i, t in enumerate(texts(b.column(1))):
            data, at = t.encode(), 0
            for to in cuts(data).tolist():
                x = digest(data[at:to])
                row.append(i)
                hashes.append(x)
                start.append(at)
                end.append(to)
                at = to
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(pa.array(row, pa.int64())), b.column(2).take(pa.array(row, pa.int64())), pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array(start, pa.int32()), pa.array(end, pa.int32())],
            ["doc_id", "version", "digest", "start", "end"])


def _repeated(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, version, chunks (start, end, digest)) and (digest, first (doc_id, version, start)).

    Version is the hash of the text. Chunks are those whose digest occurred before: in a smaller (doc_id,
    version), null ids first, or further up in the same text. Equal rows are one document.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    d = docs.select("doc_id", "text", F.xxhash64("text").alias("version"))
    c = d.mapInArrow(_chunks, f"doc_id {kind}, version bigint, digest bigint, start int, end int")
    # Most chunks occur once: counting moves digests alone, and only what repeats is carried further. Each step is
    # written, so joins read plain shuffles on both sides, which a very common chunk can be split in.
    common = written(c.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"))
    c = written(c.join(common, "digest", "left_semi"))
    first = written(c.groupBy("digest").agg(F.min(F.struct("doc_id", "version", "start")).alias("first")))
    later = c.join(first, "digest").where(~F.struct("doc_id", "version", "start").eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "version").agg(F.collect_set(F.struct("start", "end", "digest")).alias("chunks")), first


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, version (hash of the text), chunks (start, end, digest): those whose digest occurred before."""
    return _repeated(docs)[0]


def spans(chunks: list[tuple[int, int]], least: int = SPAN) -> list[tuple[int, int]]:
    """Repeated chunks that touch, merged; what is shorter than ``least`` bytes stays in the text."""
    out: list[list[int]] = []
    for s, e in sorted(chunks):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out if e - s >= least]


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text, where = [], []
        for t, chunks in zip(b.column(1), b.column(2)):
            t, chunks = t.as_py(), chunks.as_py()
            found = spans([(x["start"], x["end"]) for x in chunks]) if chunks else []
            if found:
                data, at, kept = t.encode(), 0, []
                for s, e in found:
                    kept.append(data[at:s])
                    at = e
                t = b"".join([*kept, data[at:]]).decode()
            text.append(t)
            where.append([{"start": s, "end": e} for s, e in found])
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(text, pa.string()), pa.array(where, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
            ["doc_id", "text", "spans"])


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, text without repeated passages, spans (UTF-8 byte ranges that went).

    The first occurrence of a chunk in (doc_id, hash of the text, place) order stays, null ids first; of all
    others, runs of at least ``SPAN`` bytes go. Null texts stay null, empty ones empty; rows that agree in
    doc_id and text are one document and are cut alike; an empty table gives an empty result; other columns
    are not read.
    """
    r = repeated_chunks(docs).select(F.col("doc_id").alias("id"), "version", "chunks")
    d = docs.join(r, docs["doc_id"].eqNullSafe(r["id"]) & (F.xxhash64(docs["text"]) == r["version"]), "left").select(docs["doc_id"], docs["text"], "chunks")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(_removed, f"doc_id {kind}, text string, spans array<struct<start:int,end:int>>")


def _runs(chunks: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Repeated chunks (start, end, digest) that follow each other, as far as they ask for a look at their sides."""
    out: list[list[tuple[int, int, int]]] = []
    for c in sorted(chunks):
        if out and c[0] == out[-1][-1][1]:
            out[-1].append(c)
        else:
            out.append([c])
    return [r for r in out if len(r) > 1 or r[0][1] - r[0][0] >= ALONE]


def _triples(chunks) -> list[tuple[int, int, int]]:
    return [(x["start"], x["end"], x["digest"]) for x in chunks.as_py() or ()]


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, version, digest) of the chunks at either end of a run."""
    for b in batches:
        row, digests = [], []
        for i, chunks in enumerate(b.column(2)):
            asked = {c[2] for r in _runs(_triples(chunks)) for c in r[:INNER] + r[-INNER:]}
            row += [i] * len(asked)
            digests += asked
        at = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(digests, pa.int64())], ["doc_id", "version", "digest"])


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, before, after): what stands around the first occurrence, ``AROUND`` chunks to each side."""
    for b in batches:
        out: list[list] = [[], [], []]
        for t, asked in zip(b.column(0), b.column(1)):
            data = t.as_py().encode()
            ends = [0, *cuts(data).tolist()]
            place = {x: i for i, x in enumerate(ends)}
            for x in asked.as_py():
                i = place[x["start"]]
                out[0].append(x["digest"])
                out[1].append(data[ends[max(0, i - AROUND)]:ends[i]])
                out[2].append(data[ends[i + 1]:ends[min(len(ends) - 1, i + 1 + AROUND)]])
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], ["digest", "before", "after"])


def alike(a: bytes, b: bytes) -> int:
    """How many bytes ``a`` and ``b`` have in common from the front."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)))


def passages(data: bytes, chunks: list[tuple[int, int, int]], sides: dict[int, tuple[bytes, bytes]]) -> list[tuple[int, int]]:
    """Byte ranges of ``data`` that repeat: runs of chunks, drawn out to both sides as far as the first occurrence agrees.

    The chunks at an end may have different first occurrences; the one that reaches furthest counts. Ends
    inside a character move back to its border. The length is judged after that.
    """
    out = [(s, e) for s, e, _ in chunks]
    for run in _runs(chunks):
        lo, hi = run[0][0], run[-1][1]
        for s, e, digest in run[:INNER] + run[-INNER:]:
            before, after = sides.get(digest, (b"", b""))
            lo = min(lo, s - alike(data[max(0, s - len(before)):s][::-1], before[::-1]))
            hi = max(hi, e + alike(data[e:e + len(after)], after))
        while lo < run[0][0] and data[lo] & 0xC0 == 0x80:
            lo += 1
        while hi < len(data) and data[hi] & 0xC0 == 0x80:
            hi -= 1
        out.append((lo, hi))
    return spans(out, PASSAGE)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text, where = [], []
        for t, chunks, around in zip(b.column(1), b.column(2), b.column(3)):
            t, own, found = t.as_py(), _triples(chunks), []
            if own:
                data = t.encode()
                found = passages(data, own, {x["digest"]: (x["before"], x["after"]) for x in around.as_py() or ()})
            if found:
                at, kept = 0, []
                for s, e in found:
                    kept.append(data[at:s])
                    at = e
                t = b"".join([*kept, data[at:]]).decode()
            text.append(t)
            where.append([{"start": s, "end": e} for s, e in found])
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(text, pa.string()), pa.array(where, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
            ["doc_id", "text", "spans"])


def dedup_passages(docs: DataFrame) -> DataFrame:
    """doc_id, text without repeated passages, spans: like ``dedup_substrings``, but whole passages go.

    A run of two chunks (or one of ``ALONE`` bytes) is a candidate. Each end of it is compared byte by byte
    with what stands around the first occurrence of its outer chunks; ``PASSAGE`` is judged after that. A byte
    that goes always has an equal one earlier in (doc_id, hash of the text, place) order. Texts move
    for what stands around first occurrences and for the cut; Spark may reuse one exchange for both.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    repeated, first = _repeated(docs)
    repeated = written(repeated)
    edges = written(repeated.mapInArrow(_edges, f"doc_id {kind}, version bigint, digest bigint"))
    asked = first.join(edges.select("digest").distinct(), "digest").groupBy(F.col("first.doc_id").alias("id"), F.col("first.version").alias("version"))
    asked = asked.agg(F.collect_list(F.struct(F.col("first.start").alias("start"), "digest")).alias("asked"))
    at = docs["doc_id"].eqNullSafe(asked["id"]) & (F.xxhash64(docs["text"]) == asked["version"])
    sides = docs.join(asked, at).select(docs["text"], "asked").mapInArrow(_sides, "digest bigint, before binary, after binary")
    sides = sides.dropDuplicates(["digest"])  # not written, so that Spark may take its texts from the exchange that the cut reads
    around = edges.join(sides, "digest").groupBy("doc_id", "version").agg(F.collect_list(F.struct("digest", "before", "after")).alias("around"))
    around = around.select(F.col("doc_id").alias("id"), F.col("version").alias("v"), "around")
    r = repeated.join(around, repeated["doc_id"].eqNullSafe(around["id"]) & (repeated["version"] == around["v"]), "left")
    r = r.select(repeated["doc_id"].alias("id"), "version", "chunks", "around")
    d = docs.join(r, docs["doc_id"].eqNullSafe(r["id"]) & (F.xxhash64(docs["text"]) == r["version"]), "left")
    d = d.select(docs["doc_id"], docs["text"], r["chunks"], r["around"])
    return d.mapInArrow(_cut_out, f"doc_id {kind}, text string, spans array<struct<start:int,end:int>>")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dedup_passages(table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    return d.select("doc_id", F.size("spans").cast("bigint").alias("n_spans"), gone.alias("removed_bytes"), "spans", "text")
