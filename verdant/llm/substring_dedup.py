"""Exact removal of repeated word windows by super-k-mer partitioning.

A window is WINDOW consecutive words. Its minimiser is the least hash of the MINIMISER-word runs in
it. Consecutive windows of a document that share a minimiser (a super-k-mer) travel as one packed
string to the bucket of that minimiser; equal windows have equal minimisers, so each bucket can count
its windows by sorting, and verifies equal hashes word by word. Many strings of one map batch for one
bucket make one compressed row.

Hot passages: equal super-k-mers of a map batch are known to be repeated at once. Their ranges are
reported from there, joined where they touch, and one string goes on for all of them, so a passage in a
third of all documents sends a bucket a string per map batch. Nothing is capped or sampled.

A minimiser that stands in many different windows would make one bucket large. Minimisers that have
more than half a bucket's share of a sample of the documents (one in HOT_SAMPLE, by hash) are hot: their
windows go one by one to buckets by their own hash instead. All senders use the same list, so equal
windows still meet; the sample decides where windows meet, never which repeat.

Null and empty texts have no words; nothing is removed from them. Texts under WINDOW words have no
window. Repeated rows are copies like any others: both lose the words. Rows that share a doc_id and
differ in text are documents of their own, as are rows without a doc_id.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant.llm import _text as tx
from verdant.llm._shared import ID, KEY, TH, keyed, partitions

WINDOW, MINIMISER, LONGEST_RUN, HOT_SAMPLE = 35, 5, 512, 64
BATCH_BYTES = 4 << 20
_MARKS = -1


def _pack(arrays: list[np.ndarray], text: bytes) -> bytes:
    raw = struct.pack("<q", len(arrays[0])) + b"".join(a.tobytes() for a in arrays) + text
    return struct.pack("<q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes, types: str) -> tuple[list[np.ndarray], bytes]:
    raw = pa.decompress(memoryview(blob)[8:], struct.unpack_from("<q", blob)[0], codec="zstd", asbytes=True)
    (n,), at, out = struct.unpack_from("<q", raw), 8, []
    for t in types:
        out.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return out, raw[at:]


def joined_ranges(ids: np.ndarray, ths: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same places of the same documents in as few ranges as can be."""
    order = np.lexsort((begin, ths, ids))
    ids, ths, begin, end = ids[order], ths[order], begin[order].astype(np.int64), end[order].astype(np.int64)
    other = np.r_[True, (ids[1:] != ids[:-1]) | (ths[1:] != ths[:-1])][: len(ids)]
    above = np.cumsum(other) << 32  # keeps documents apart
    reach = np.maximum.accumulate(end + above) - above
    new = other.copy()
    new[1:] |= begin[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return ids[at], ths[at], begin[at], reach[np.r_[at[1:], len(ids)][: len(at)] - 1]


def super_kmers(words: tx.Words, window: int, m: int, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows and minimiser of each super-k-mer of a chunk.

    Windows of a hot minimiser stand alone, under a hash of the whole window.
    """
    h = words.hashes()
    none = (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    if len(h) < window:
        return none
    least = tx.sliding_min(tx.window_hashes(h, np.arange(len(h) - m + 1), m), window - m + 1)
    where = np.flatnonzero(np.repeat(words.first[1:], words.counts)[: len(least)] >= np.arange(len(least)) + window)
    if not len(where):
        return none
    value = least[where]
    new = np.ones(len(where), bool)
    new[1:] = (value[1:] != value[:-1]) | (where[1:] != where[:-1] + 1) | (words.doc[where[1:]] != words.doc[where[:-1]])
    if hot is not None and len(hot):
        alone = np.flatnonzero(np.isin(value, hot))
        value[alone] = tx.window_hashes(h, where[alone], window)
        new[alone] = new[alone[alone < len(new) - 1] + 1] = True
    first = np.flatnonzero(new)
    run = np.arange(len(where)) - np.repeat(first, np.diff(np.r_[first, len(where)]))
    new |= run % LONGEST_RUN == 0
    first = np.flatnonzero(new)
    return where[first], np.diff(np.r_[first, len(where)]), value[first]


def _minimiser_bytes(window: int, m: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches, most=BATCH_BYTES):
            words = tx.Words(*tx.buffers(chunk["text"]))
            first, n, least = super_kmers(words, window, m)
            value, group = np.unique(least, return_inverse=True)
            size = np.bincount(group, words.end[first + n + window - 2] - words.start[first], len(value)) if len(first) else np.empty(0)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64), pa.int64()), pa.array(size.astype(np.int64), pa.int64())], ["least", "size"])

    return run


def hot_minimisers(docs: DataFrame, window: int, m: int, buckets: int) -> np.ndarray:
    """Minimisers with over half a bucket's share of a sample's bytes: fewer than twice the buckets."""
    sample = docs.select("doc_id", "text").filter(F.expr(f"pmod(xxhash64(doc_id, text), {HOT_SAMPLE}) = 0"))
    each = sample.select("text").mapInArrow(_minimiser_bytes(window, m), "least long, size long").groupBy("least").agg(F.sum("size").alias("size"))
    total = each.agg(F.sum("size").alias("total"))
    rows = each.crossJoin(F.broadcast(total)).filter(F.col("size") * 2 * buckets > F.col("total")).select("least").collect()
    return np.sort(np.array([r["least"] for r in rows], np.int64).view(np.uint64))


def _send(window: int, m: int, buckets: int, hot) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, split = TaskContext.get().partitionId(), hot.value
        for chunk in tx.chunks(batches, most=BATCH_BYTES):
            words = tx.Words(*tx.buffers(chunk["text"]))
            first, n, least = super_kmers(words, window, m, split)
            if not len(first):
                continue
            text, where = words.joined()
            begin, end = where[first].tolist(), where[first + n + window - 1].tolist()
            strings = [text[x:y] for x, y in zip(begin, end)]
            leads: dict[bytes, int] = {}
            lead = np.array([leads.setdefault(x, i) for i, x in enumerate(strings)])
            several = np.bincount(lead, minlength=len(lead))[lead] > 1
            doc = words.doc[first]
            own, ids, ths = first - words.first[doc], chunk[ID].to_numpy()[doc], chunk[TH].to_numpy()[doc]
            rows: list[tuple[int, bytes]] = []
            if several.any():
                k = np.flatnonzero(several)
                rows.append((turn % buckets, struct.pack("<b", 1) + _pack([a.astype(t) for a, t in zip(joined_ranges(ids[k], ths[k], own[k], own[k] + n[k] + window - 1), ("<i8", "<i4", "<i4", "<i4"))], b"")))
                turn += 1
            go = np.flatnonzero(lead == np.arange(len(lead)))
            bucket = (least[go] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            go, bucket = go[order], bucket[order]
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            for a, b in zip(cuts[:-1], cuts[1:]):
                k = go[a:b]
                known = np.where(several[k], _MARKS, own[k]).astype(np.int32)
                own_strings = [strings[i] for i in k.tolist()]
                size = np.array([len(x) for x in own_strings], np.int32)
                rows.append((int(bucket[a]), struct.pack("<b", 0) + _pack([least[k], ids[k], ths[k], known, n[k].astype(np.int32), size], b"".join(own_strings))))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), tx.binary([r[1] for r in rows])], ["bucket", "blob"])

    return run


def repeated_windows(text: bytes, lengths: np.ndarray, n_windows: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which windows of packed strings occur more than once among them: string, offset in it, verdict."""
    offsets = np.r_[0, np.cumsum(lengths)]
    words = tx.Words(np.frombuffer(text, np.uint8), offsets)
    string = np.repeat(np.arange(len(n_windows)), n_windows)
    offset = np.arange(len(string)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    at = words.first[string] + offset
    h = tx.window_hashes(words.hashes(), at, window)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    lead = np.arange(len(h))
    run = np.flatnonzero(np.r_[True, ~same])
    lead[order] = np.repeat(order[run], np.diff(np.r_[run, len(h)]))
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    check = np.flatnonzero(twice & (lead != np.arange(len(h))))
    if len(check):
        where = np.r_[words.start, len(text)].astype(np.int64)
        code = pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(where.tobytes()), pa.py_buffer(text)]).dictionary_encode().indices.to_numpy()
        wrong = np.zeros(len(check), bool)
        for k in range(window):
            wrong |= code[at[check] + k] != code[at[lead[check]] + k]
        if wrong.any():  # windows of one hash that differ: count them by their words
            clash = np.isin(lead, lead[check[wrong]])
            seen: dict[bytes, list[int]] = {}
            for i in np.flatnonzero(clash):
                seen.setdefault(code[at[i] : at[i] + window].tobytes(), []).append(i)
            for group in seen.values():
                twice[group] = len(group) > 1
    return string, offset, twice


def _count(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def settle(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [_unpack(b, "<u8,<i8,<i4,<i4,<i4,<i4".split(",")) for b in blobs]
        least, ids, ths, own, n, size = (np.concatenate([p[0][i] for p in parts]) for i in range(6))
        size = size.astype(np.int64)
        _, group, many = np.unique(least, return_inverse=True, return_counts=True)
        alone = (many[group] == 1) & (n == 1)  # one window, met nowhere else
        ends = np.cumsum(size)
        text = b"".join(p[1] for p in parts)
        del parts
        order = np.argsort(group, kind="stable")
        order = order[~alone[order]]
        at, found = 0, []
        while at < len(order):  # whole minimisers, some MB of strings at a time
            to = int(np.searchsorted(np.cumsum(size[order[at:]]), 4 << 20, "right")) + at + 1
            while to < len(order) and group[order[to]] == group[order[to - 1]]:
                to += 1
            k = order[at:to]
            at = to
            strings = b"".join([text[b - a : b] for a, b in zip(size[k].tolist(), ends[k].tolist())])
            string, offset, twice = repeated_windows(strings, size[k], n[k], window)
            string, offset = string[twice], offset[twice]
            reply = own[k][string] != _MARKS
            string, offset = string[reply], offset[reply]
            if not len(string):
                continue
            new = np.r_[True, (string[1:] != string[:-1]) | (offset[1:] != offset[:-1] + 1)]
            i = np.flatnonzero(new)
            length = np.diff(np.r_[i, len(string)])
            begin = own[k][string[i]] + offset[i]
            found.append((ids[k][string[i]], ths[k][string[i]], begin, begin + length + window - 1))
        if found:
            yield marks(*joined_ranges(*(np.concatenate(x) for x in zip(*found))))

    def marks(ids: np.ndarray, ths: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x.astype(np.int32)) for x in (ths, begin, end))], [ID, TH, "begin", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        now = None
        for batch in batches:
            for bucket, blob in zip(batch["bucket"].to_pylist(), batch["blob"]):
                blob = blob.as_py()
                if blob[0] == 1:
                    yield marks(*_unpack(blob[1:], ["<i8", "<i4", "<i4", "<i4"])[0])
                    continue
                if bucket != now and held:
                    yield from settle(held)
                    held = []
                now = bucket
                held.append(blob[1:])
        if held:
            yield from settle(held)

    return run


def repeated_ranges(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER) -> DataFrame:
    """KEY, begin, end: word ranges of documents that repeated windows cover."""
    n = partitions(docs.sparkSession)
    hot = docs.sparkSession.sparkContext.broadcast(hot_minimisers(docs, window, minimiser, 4 * n))
    sent = keyed(docs, "text").mapInArrow(_send(window, minimiser, 4 * n, hot), "bucket int, blob binary")
    return sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_count(window), f"{ID} long, {TH} int, begin int, end int")


def _finish(keep_text: bool, columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches):
            total, gone, digest, kept_text = [], [], [], []
            for text, begins, ends in zip(chunk["text"].cast(pa.large_binary()).to_pylist(), chunk["begins"].to_pylist(), chunk["ends"].to_pylist()):
                words = (text or b"").split()
                total.append(len(words))
                if begins:
                    hit = tx.covered(len(words), np.array(begins), np.array(ends))
                    words = [w for w, x in zip(words, hit.tolist()) if not x]
                kept = b" ".join(words)
                gone.append(total[-1] - len(words))
                digest.append(hashlib.sha256(kept).hexdigest())
                kept_text.append(kept)
            extra = [pa.array(kept_text, pa.binary()).cast(pa.string())] if keep_text else []
            yield pa.RecordBatch.from_arrays([*(chunk[c] for c in columns), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), *extra], [*columns, "n_words", "n_removed", "kept_sha256", *["kept_text"] * keep_text])

    return run


def remove_repeated(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) of every document row."""
    ranges = repeated_ranges(docs, window, minimiser).groupBy(*KEY).agg(F.collect_list(F.struct("begin", "end")).alias("ranges"))
    ranges = ranges.select(*KEY, F.col("ranges.begin").alias("begins"), F.col("ranges.end").alias("ends"))
    both = keyed(docs, "doc_id", "text").join(ranges, KEY, "left").select("doc_id", "text", "begins", "ends")
    return both.mapInArrow(_finish(keep_text, ["doc_id"]), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text)


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_text=False)


OP5_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM windows) WHERE n > 1),
places AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM twice),
spread AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM words),
kept AS (
  SELECT s.doc_id, count(h.p) AS n_removed, string_agg(CASE WHEN h.p IS NULL THEN s.word END, ' ' ORDER BY s.p) AS kept
  FROM spread s LEFT JOIN places h ON s.doc_id = h.doc_id AND s.p = h.p GROUP BY s.doc_id)
SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN kept ON words.doc_id = kept.doc_id
"""
