"""Incremental, reversible line dedup: sharded cuckoo filters over exact reference counts.

The exact table holds, per line key, in how many documents it stands (one row per key; 16-byte digests).
Inserting documents adds to it, deleting documents subtracts, and a table of members keeps either from
counting a document twice, so every state can be undone. Per shard of the table a cuckoo filter holds the
keys that reached the limit. When a change takes keys over the limit or below it, they are inserted into
their shard's filter or deleted from it; a filter that is full is built again from the exact table.

Documents are scanned against the filters: where their rows are, while all filters together have at most
MOST_FILTER_BYTES; beyond it the line keys go to their shard's filter, each filter in SALTS tasks. Only
the lines that hit travel to the exact table, which has the last word.

A line's key is the line without the ASCII white space at its ends, A-Z in lower case. Null and empty
texts are one empty line, whose key has no code point and is never dropped. Rows of one doc_id and text
(or of no doc_id and one text) count as one document; rows of one doc_id with other texts are documents
of their own. Ties do not arise: counts only.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdant.llm import _text as tx
from verdant.llm._shared import ID, KEY, TH, Scratch, key_filter, keyed, let_through, partitions

MIN_CHARS, MIN_DOCS, LEAST_SHARDS, KEYS_A_SHARD = 1, 10, 16, 200_000
SLOTS, MOST_FILTER_BYTES, SALTS, KEYS_A_TASK = 4, 64 << 20, 8, 1_000_000
STRIP = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    return hashlib.blake2b(line.strip(STRIP).lower(), digest_size=16).digest()


def long_enough(line: bytes, least: int = MIN_CHARS) -> bool:
    own = line.strip(STRIP)
    return len(own) >= least and (len(own) >= 4 * least or len(own.decode("utf-8", "replace")) >= least)


def digests(lines: list[bytes]) -> np.ndarray:
    """A row of two numbers per 16-byte key."""
    return np.frombuffer(b"".join(lines), "<u8").reshape(-1, 2)


class CuckooFilter:
    """16-bit fingerprints, four to a bucket, two buckets to a key; whole arrays of keys at a time."""

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        self.table = np.zeros((1 << max(1, int(np.ceil(np.log2(max(capacity, 1) / SLOTS / 0.85 + 1)))), SLOTS), np.uint16) if table is None else table

    def place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets of each key."""
        mark = np.maximum(keys[:, 1] & np.uint64(0xFFFF), np.uint64(1)).astype(np.int64)
        one = (keys[:, 0] >> np.uint64(16)).astype(np.int64) & (len(self.table) - 1)
        return mark, one, self.other(one, mark)

    def other(self, bucket, mark):
        return bucket ^ ((mark * 0x5BD1E995 >> 7) & (len(self.table) - 1))

    def has(self, keys: np.ndarray) -> np.ndarray:
        mark, one, two = self.place(keys)
        return (self.table[one] == mark[:, None]).any(axis=1) | (self.table[two] == mark[:, None]).any(axis=1)

    def insert(self, keys: np.ndarray) -> None:
        """Fills free slots of the first, then of the second buckets; what is left moves others on."""
        mark, one, two = self.place(keys)
        left = np.arange(len(keys))
        for buckets in (one, two):
            left = left[np.argsort(buckets[left], kind="stable")]
            own = buckets[left]
            begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.empty(0, np.int64)
            rank = np.arange(len(own)) - np.repeat(begin, np.diff(np.r_[begin, len(own)]))
            fits = rank < (self.table[own] == 0).sum(axis=1)
            at = own[fits]
            slot = np.argsort(self.table[at] != 0, axis=1, kind="stable")[np.arange(len(at)), rank[fits]]
            self.table[at, slot] = mark[left[fits]]
            left = left[~fits]
        for i in left.tolist():
            self._move(int(mark[i]), int(two[i]))

    def _move(self, mark: int, bucket: int) -> None:
        for kick in range(500):
            slot = kick % SLOTS
            mark, self.table[bucket, slot] = int(self.table[bucket, slot]), mark
            bucket = self.other(bucket, mark)
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return
        raise OverflowError("the filter is full: build it again with more room")

    def delete(self, keys: np.ndarray) -> None:
        """Of keys that have been inserted."""
        for mark, *buckets in zip(*(x.tolist() for x in self.place(keys))):
            for bucket in buckets:
                held = np.flatnonzero(self.table[bucket] == mark)
                if len(held):
                    self.table[bucket, held[0]] = 0
                    break

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @staticmethod
    def from_bytes(raw: bytes) -> CuckooFilter:
        return CuckooFilter(0, np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy())


def build_filter(keys: np.ndarray) -> CuckooFilter:
    room = len(keys)
    while True:
        made = CuckooFilter(room)
        try:
            made.insert(keys)
            return made
        except OverflowError:
            room = 2 * max(room, 8)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """By the last two bytes, which the fingerprint does not use."""
    return (keys[:, 1] >> np.uint64(48)).astype(np.int64) % shards


def _shard_column(shards: int):
    """The same as shard_of for a column of keys."""
    return F.expr(f"cast(conv(hex(concat(substring(line, 16, 1), substring(line, 15, 1))), 16, 10) as int) % {shards}")


def _lines_of(chunk: pa.RecordBatch, least: int) -> tuple[list[bytes], np.ndarray]:
    """The distinct line keys of each row, and the rows they belong to."""
    keys: list[bytes] = []
    counts = []
    for text in chunk["text"].cast(pa.large_binary()).to_pylist():
        own = {line_key(x) for x in (text or b"").split(b"\n") if long_enough(x, least)}
        keys.extend(own)
        counts.append(len(own))
    return keys, np.repeat(np.arange(len(counts)), counts)


def _counted(repeated, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """line; KEY only for rows that may be repeated, whose lines must not count twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches):
            keys, row = _lines_of(chunk, least)
            sure = ~let_through(repeated.value, chunk[ID].to_numpy())[row]
            yield pa.RecordBatch.from_arrays([pa.array(chunk[ID].to_numpy()[row], pa.int64(), mask=sure), pa.array(chunk[TH].to_numpy()[row], pa.int32(), mask=sure), tx.binary(keys)], [ID, TH, "line"])

    return run


def reference_counts(docs: DataFrame, min_chars: int = MIN_CHARS, scratch: Scratch | None = None) -> DataFrame:
    """line, refs: in how many documents each line key stands. Counts are combined before they are shuffled."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "line-counts")
    repeated = scratch.write(keyed(docs).groupBy(*KEY).count().filter("count > 1").select(F.col(ID).alias("key")), f"repeated-{uuid.uuid4().hex}")
    tasks = min(partitions(spark), -(-repeated.count() // KEYS_A_TASK)) or 1  # each sends a whole bitmap
    rows = keyed(docs, "text").mapInArrow(_counted(spark.sparkContext.broadcast(key_filter(repeated, tasks)), min_chars), f"{ID} long, {TH} int, line binary")
    each = rows.groupBy("line", *KEY).agg(F.count("*").alias("n"))
    return each.groupBy("line").agg(F.sum(F.when(F.col(ID).isNull(), F.col("n")).otherwise(1)).alias("refs"))


def _changed_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """shard, filter (null: must be built again) from rows in order of shard and kind: 0 the filter, 1 deletions, 2 insertions."""

    def settle(shard: int, filters: list[bytes], gone: list[bytes], new: list[bytes]) -> pa.RecordBatch:
        raw = None
        try:
            made = CuckooFilter.from_bytes(filters[0]) if filters else build_filter(digests(new))
            if filters:
                made.delete(digests(gone))
                made.insert(digests(new))
            raw = made.to_bytes()
        except OverflowError:
            pass
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), tx.binary([raw])], ["shard", "filter"])

    now, held = None, ([], [], [])
    for batch in batches:
        for shard, kind, value in zip(*(batch[c].to_pylist() for c in ("shard", "kind", "value"))):
            if shard != now and now is not None:
                yield settle(now, *held)
                held = ([], [], [])
            now = shard
            held[kind].append(value)
    if now is not None:
        yield settle(now, *held)


class Filters:
    """The filters of all shards in one array, so that any keys are looked up together."""

    def __init__(self, by_shard: dict[int, bytes], shards: int):
        self.shards = shards
        parts = [np.frombuffer(by_shard[s], np.uint16).reshape(-1, SLOTS) if s in by_shard else np.zeros((2, SLOTS), np.uint16) for s in range(shards)]
        size = np.array([len(p) for p in parts])
        self.base, self.mask, self.table = np.cumsum(size) - size, size - 1, np.concatenate(parts)

    def has(self, keys: np.ndarray) -> np.ndarray:
        shard = shard_of(keys, self.shards)
        base, mask = self.base[shard], self.mask[shard]
        mark = np.maximum(keys[:, 1] & np.uint64(0xFFFF), np.uint64(1)).astype(np.int64)
        one = (keys[:, 0] >> np.uint64(16)).astype(np.int64) & mask
        two = one ^ ((mark * 0x5BD1E995 >> 7) & mask)
        return (self.table[base + one] == mark[:, None]).any(axis=1) | (self.table[base + two] == mark[:, None]).any(axis=1)


_HIT = f"{ID} long, {TH} int, line binary"


def _hits(filters, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filters(*filters.value)
        for chunk in tx.chunks(batches):
            keys, row = _lines_of(chunk, least)
            hit = np.flatnonzero(known.has(digests(keys)))
            yield pa.RecordBatch.from_arrays([pa.array(chunk[k].to_numpy()[row[hit]], t) for k, t in ((ID, pa.int64()), (TH, pa.int32()))] + [tx.binary([keys[i] for i in hit.tolist()])], [*KEY, "line"])

    return run


def _dealt(shards: int, salts: int, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """shard, salt, kind 1, value: line keys and their rows, packed for their shard's filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turn, chunk in enumerate(tx.chunks(batches)):
            keys, row = _lines_of(chunk, least)
            own = digests(keys)
            shard = shard_of(own, shards)
            order = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.r_[True, shard[order][1:] != shard[order][:-1], True]) if len(order) else []
            parts = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
            ids, ths = chunk[ID].to_numpy(), chunk[TH].to_numpy()
            values = [own[k].tobytes() + ids[row[k]].astype("<i8").tobytes() + ths[row[k]].astype("<i4").tobytes() for k in parts]
            first = [int(shard[k[0]]) for k in parts]
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int32()), pa.array([(s + turn) % salts for s in first], pa.int32()), pa.array([1] * len(first), pa.int32()), tx.binary(values)], ["shard", "salt", "kind", "value"])

    return run


def _tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hits of packed line keys, which follow their shard's filter."""
    now, known = None, None
    for batch in batches:
        for shard, salt, kind, value in zip(*(batch[c].to_pylist() for c in ("shard", "salt", "kind", "value"))):
            if (shard, salt) != now:
                now, known = (shard, salt), None
            if kind == 0:
                known = CuckooFilter.from_bytes(value)
            elif known is not None:
                n = len(value) // 28
                keys = np.frombuffer(value, "<u8", 2 * n).reshape(-1, 2)
                hit = np.flatnonzero(known.has(keys))
                lines = [value[16 * i : 16 * i + 16] for i in hit.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(value, "<i8", n, 16 * n)[hit]), pa.array(np.frombuffer(value, "<i4", n, 24 * n)[hit]), tx.binary(lines)], [*KEY, "line"])


class LineIndex:
    """Reference counts, members and filters of a set of documents, as tables in the shared folder.

    Each change writes new tables beside the old ones and takes them over together when all are written; so a
    change that fails leaves the index as it was and can be repeated. Shards are as many as the first insertion
    needs; when the keys need over twice as many, all filters are built again. Before any insertion all is empty.
    """

    def __init__(self, spark: SparkSession, scratch: Scratch | None = None, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS):
        self.spark, self.scratch, self.min_docs, self.min_chars = spark, scratch or Scratch(spark, "line-index"), min_docs, min_chars
        self.version, self.shards = 0, 0
        self.refs = self.members = self.filters = None
        self.made: list[str] = []

    def insert(self, docs: DataFrame) -> None:
        """Documents that are members already are left out."""
        if self.members is not None:
            docs = keyed(docs, "doc_id", "text").join(self.members, KEY, "left_anti").select("doc_id", "text")
        self._change(docs, 1)

    def delete(self, docs: DataFrame) -> None:
        """Undoes insert; documents that are no members are left out."""
        if self.members is not None:
            self._change(keyed(docs, "doc_id", "text").join(self.members, KEY, "left_semi").select("doc_id", "text"), -1)

    def frequent(self) -> DataFrame:
        return self.spark.createDataFrame([], "line binary") if self.refs is None else self._often(self.refs)

    def _often(self, refs: DataFrame) -> DataFrame:
        return refs.filter(F.col("refs") >= self.min_docs).select("line")

    def _change(self, docs: DataFrame, sign: int) -> None:
        name = f"{self.version + 1}-{uuid.uuid4().hex[:8]}"  # of this try alone
        change = reference_counts(docs, self.min_chars, self.scratch).select("line", (F.col("refs") * sign).alias("change"))
        both = change.withColumn("before", F.lit(0).cast("long"))
        if self.refs is not None:
            both = self.refs.select("line", F.col("refs").alias("before")).join(change, "line", "full").na.fill(0, ["before", "change"])
        table = self.scratch.write(both.select("line", (F.col("before") + F.col("change")).alias("refs"), "before"), f"counts-{name}")
        keys = keyed(docs).distinct()
        if self.members is not None:
            keys = self.members.union(keys) if sign > 0 else self.members.join(keys, KEY, "left_anti")
        members = self.scratch.write(keys, f"members-{name}")
        refs = table.filter("refs > 0").select("line", "refs")
        needed = max(LEAST_SHARDS, -(-self._often(refs).count() // KEYS_A_SHARD))
        grown = needed > 2 * self.shards
        shards = needed if grown else self.shards
        filters = self._new_filters(table, refs, None if grown else self.filters, shards, name)
        old, self.made = self.made, [f"{x}-{name}" for x in ("counts", "members", "filters", "rebuilt")]
        self.version, self.refs, self.members, self.filters, self.shards = self.version + 1, refs, members, filters, shards
        self.scratch.drop(*old)

    def _new_filters(self, table: DataFrame, refs: DataFrame, old: DataFrame | None, shards: int, name: str) -> DataFrame:
        was, now = (F.col("before") >= self.min_docs) & F.lit(old is not None), F.col("refs") >= self.min_docs
        shard = _shard_column(shards).alias("shard")
        moved = table.filter(was != now).select(shard, F.when(now, 2).otherwise(1).alias("kind"), F.col("line").alias("value"))
        if old is not None:
            moved = moved.union(old.select("shard", F.lit(0).alias("kind"), F.col("filter").alias("value")))

        def updated(rows: DataFrame) -> DataFrame:
            return rows.repartition(min(shards, partitions(self.spark)), "shard").sortWithinPartitions("shard", "kind").mapInArrow(_changed_filters, "shard int, filter binary")

        made = self.scratch.write(updated(moved), f"filters-{name}")
        full = made.filter("filter is null").select("shard")
        if full.isEmpty():
            return made
        again = self._often(refs).select(shard, F.lit(2).alias("kind"), F.col("line").alias("value")).join(F.broadcast(full), "shard", "left_semi")
        return self.scratch.write(made.filter("filter is not null").union(updated(again)), f"rebuilt-{name}")

    def dropped(self, docs: DataFrame, most_filter_bytes: int = MOST_FILTER_BYTES, salts: int = SALTS) -> DataFrame:
        """KEY, lines: the keys that each document must lose; documents without any are left out."""
        if self.filters is None:
            return keyed(docs, F.array(F.lit(b"")).alias("lines")).select(*KEY, "lines").limit(0)
        size = self.filters.agg(F.sum(F.length("filter"))).first()[0] or 0
        own = keyed(docs, "text")
        if size <= most_filter_bytes:
            known = {r["shard"]: bytes(r["filter"]) for r in self.filters.collect()}
            hits = own.mapInArrow(_hits(self.spark.sparkContext.broadcast((known, self.shards)), self.min_chars), _HIT)
        else:
            each = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
            filters = self.filters.select("shard", each, F.lit(0).alias("kind"), F.col("filter").alias("value"))
            lines = own.mapInArrow(_dealt(self.shards, salts, self.min_chars), "shard int, salt int, kind int, value binary")
            hits = filters.union(lines).repartition(partitions(self.spark), "shard", "salt").sortWithinPartitions("shard", "salt", "kind").mapInArrow(_tested, _HIT)
        return hits.join(self.frequent(), "line", "left_semi").groupBy(*KEY).agg(F.collect_set("line").alias("lines"))


def _finish(names: list[str], keep_text: bool, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches, "__text"):
            total, gone, digest, texts = [], [], [], []
            for text, drop in zip(chunk["__text"].cast(pa.large_binary()).to_pylist(), chunk["__lines"].to_pylist()):
                lines = (text or b"").split(b"\n")
                total.append(len(lines))
                if drop:
                    drop = set(drop)
                    lines = [x for x in lines if not (long_enough(x, least) and line_key(x) in drop)]
                kept = b"\n".join(lines)
                gone.append(total[-1] - len(lines))
                digest.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept if text is not None else None)
            extra = [pa.array(texts, pa.binary()).cast(pa.string())] if keep_text else []
            values = [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), *extra]
            yield pa.RecordBatch.from_arrays([*(chunk[c] for c in names), *values], [*names, *_MADE[: len(values)]])

    return run


_MADE = ["__n_lines", "__n_dropped", "__kept_sha256", "__kept_text"]


def dedup_lines(docs: DataFrame, keep: list[str], keep_text: bool, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, index: LineIndex | None = None) -> DataFrame:
    """The named columns, __n_lines, __n_dropped, __kept_sha256 (and __kept_text) of every document row.

    Against the given index, or else against one of these documents.
    """
    if index is None:
        index = LineIndex(docs.sparkSession, None, min_docs, min_chars)
        index.insert(docs)
    lines = index.dropped(docs).withColumnRenamed("lines", "__lines")
    both = keyed(docs, *(F.col(f"`{c}`") for c in keep), F.col("text").alias("__text")).join(lines, KEY, "left").drop(*KEY)
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "__n_lines long, __n_dropped long, __kept_sha256 string", *["__kept_text string"] * keep_text])
    return both.mapInArrow(_finish(keep, keep_text, index.min_chars), schema)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"], keep_text=False)
    return out.withColumnsRenamed({c: c[2:] for c in _MADE})


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts lose their frequent lines; n_chars, where there is such a column, follows."""
    out = dedup_lines(docs, [c for c in docs.columns if c != "text"], keep_text=True).withColumn("text", F.col("__kept_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, l, lower_key AS k FROM (
    SELECT doc_id, i, l, translate(regexp_replace(regexp_replace(l, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key
    FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents))),
frequent AS (SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(f.k)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN f.k IS NULL THEN l END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM lines LEFT JOIN frequent f ON lines.k = f.k GROUP BY doc_id
"""
