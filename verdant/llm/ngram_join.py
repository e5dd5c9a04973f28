"""Near duplicates by an n-gram Jaccard join: a blocked sparse product of document by n-gram incidence.

Texts with the same set of shingles form a class (its id: a hash of the set); the join links classes.

1. All shingles are counted into a table of fixed size, which orders them from rare to common. A pair
   at the threshold must share a shingle among the first n - ceil(0.75 n) + 1 of each side in that
   order (the size-derived prefix), whatever the order is: the table decides cost, never the result.
2. Prefix entries (shingle, class) go to blocks of shingles. A block drops shingles of one class only.
3. First product, linear in a shingle's classes: each class with the shingle's least class. Pairs whose
   accumulated overlap reaches the bound are verified and give components.
   A further linear round tries, for the classes still apart that share many shingles, some partners
   drawn at random from their shingles' classes (LEADS of them: a head start, the next step is exact).
4. Second product: the pairs of classes of a shingle that are not in one component yet. Each class has a
   parity bitmap of its set: bits that differ between two bitmaps are never more than the shingles that
   the sets do not share, which may be at most (x + y) / 7. Pairs beyond that go before anything is written,
   as do pairs of too different sizes; so what is written is close to the threshold or above it. Shingles
   with the same least class go to one task (in parts of PART_ROWS rows), where overlaps are accumulated;
   then over all tasks. The classes of a shingle that has over TILE_ROWS of them are dealt to blocks, and each
   pair of blocks is a tile of its own: so no task holds a hot shingle's classes, and its pairs spread. Pairs under the size-derived bound (their shared prefix plus all that can follow is
   under 3/7 of both sizes) go; the rest are verified on whole sets.
Within a group of near copies the first products find the links that join it, so its pairs are not
written out. Nothing is capped. Verification reads only documents that a filter of fixed size lets
through, and exact joins decide.

Texts without a word (or null) have no shingle and link with nothing; shorter texts than five words
are one shingle. Repeated rows and equal texts share a class. Rows of one doc_id that differ in text are
documents of their own. component_id is the least doc_id of a component that is not null; a component
of rows without doc_id has none. Class ids are 64-bit hashes of whole sets: among 10^9 distinct texts
the odds of one pair that is taken for equal are about 3 in 100.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdant.llm import _text as tx
from verdant.llm._shared import KEY, Scratch, key_filter, keyed, let_through, partitions

SHINGLE, PERCENT = 5, 75
SKETCH_BITS, LEADS = 22, 32
PARITY_BITS, PART_ROWS, TILE_ROWS = 1024, 10_000, 2_048
FAN_IN = 64  # count tables that one task sums up at first
EDGES_A_TASK, FEW_TASKS = 250_000, 16
CHUNK_BYTES = 2 << 20  # text hashed at once: a worker holds some ten times that in arrays


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each document, sorted, and where each document's begin."""
    words = tx.Words(*tx.buffers(texts), lower=True)
    at, grams = words.grams(k)
    doc, counts = words.doc[at], words.counts
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        for n in range(1, k):
            own = short[counts[short] == n]
            grams = np.concatenate([grams, tx.window_hashes(words.hashes(), words.first[own], n)])
            doc = np.concatenate([doc, own])
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    keep = np.ones(len(grams), bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[keep], doc[keep]
    return grams, np.searchsorted(doc, np.arange(len(counts) + 1))


def _count_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros(1 << SKETCH_BITS, np.int64)
    for chunk in tx.chunks(batches, most=CHUNK_BYTES):
        grams, _ = shingle_sets(chunk["text"])
        np.add.at(table, (grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
    parts = np.minimum(table, 2**31 - 1).astype(np.int32).reshape(64, -1)
    used = [i for i in range(64) if parts[i].any()]
    if used:
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), tx.binary([pa.compress(parts[i].tobytes(), codec="zstd", asbytes=True) for i in used])], ["part", "counts"])


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A table per run of rows of the same part, summed as they come: one table is held."""
    size = (1 << SKETCH_BITS) // 64
    part, total = None, np.zeros(size, np.int64)

    def row() -> pa.RecordBatch:
        whole = np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), tx.binary([pa.compress(whole, codec="zstd", asbytes=True)])], ["part", "counts"])

    for batch in batches:
        for now, blob in zip(batch["part"].to_pylist(), batch["counts"]):
            if now != part:
                if part is not None:
                    yield row()
                part, total = now, np.zeros(size, np.int64)
            total += np.frombuffer(pa.decompress(blob.as_buffer(), size * 4, codec="zstd", asbytes=True), np.int32)
    if part is not None:
        yield row()


def shingle_counts(docs: DataFrame) -> np.ndarray:
    """Shingles of all documents, counted by the leading bits of their hash: 16 MB at any input size.

    The tables of all map tasks are summed as a tree: FAN_IN tasks' tables of a part first, then the sums.
    """
    schema, size = "part int, counts binary", (1 << SKETCH_BITS) // 64
    rows = docs.select("text").mapInArrow(_count_shingles, schema).withColumn("fold", F.expr(f"spark_partition_id() div {FAN_IN}"))
    for by in (["part", "fold"], ["part"]):
        rows = rows.repartition(*by).sortWithinPartitions("part").select("part", "counts").mapInArrow(_sum_counts, schema)
    out = np.zeros((64, size), np.int32)
    for r in rows.collect():
        out[r["part"]] = np.frombuffer(pa.decompress(bytes(r["counts"]), size * 4, codec="zstd", asbytes=True), np.int32)
    return out.reshape(-1)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def parity_bitmaps(grams: np.ndarray, first: np.ndarray, bits: int = PARITY_BITS) -> np.ndarray:
    """A row of bits per set: whether an odd number of its shingles fall on the bit."""
    out = np.zeros((len(first) - 1, bits // 8), np.uint8)
    place = (grams >> np.uint64(20)).astype(np.int64) & (bits - 1)
    np.bitwise_xor.at(out, (np.repeat(np.arange(len(first) - 1), np.diff(first)), place >> 3), (1 << (place & 7)).astype(np.uint8))
    return out


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in tx.chunks(batches, most=CHUNK_BYTES):
        grams, first = shingle_sets(chunk["text"])
        n = np.diff(first)
        cls = tx.set_hashes(grams, first).view(np.int64)
        bits = pa.FixedSizeBinaryArray.from_buffers(pa.binary(PARITY_BITS // 8), len(n), [None, pa.py_buffer(parity_bitmaps(grams, first).tobytes())]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([chunk["doc_id"], *(chunk[k] for k in KEY), pa.array(cls, pa.int64(), mask=n == 0), pa.array(n, pa.int64()), bits], ["doc_id", *KEY, "cls", "n", "bits"])


def _prefixes(counts, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(counts.value, np.int32)
        for chunk in tx.chunks(batches, most=CHUNK_BYTES):
            grams, first = shingle_sets(chunk["text"])
            n = np.diff(first)
            cls = tx.set_hashes(grams, first)
            _, one = np.unique(cls, return_index=True)
            doc = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((grams, table[(grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], doc))
            rank = np.arange(len(doc)) - np.repeat(first[:-1], n)
            leader = np.zeros(len(n), bool)
            leader[one] = True
            keep = (rank < (n - (PERCENT * n + 99) // 100 + 1)[doc]) & leader[doc]
            token, cls = grams[order][keep], cls[doc[keep]]
            bucket = ((token & np.uint64(0xFFFFFF)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            token, cls, bucket = token[order], cls[order], bucket[order]
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else []
            rows = [(int(bucket[a]), b - a, pa.compress(token[a:b].tobytes() + cls[a:b].tobytes(), codec="zstd", asbytes=True)) for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], ["bucket", "n", "blob"])

    return run


def _shared_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block's shingles that several classes have; lead: the least class of the shingle."""

    def settle(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        token, cls = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        order = np.lexsort((cls, token))
        token, cls = token[order], cls[order]
        keep = np.ones(len(token), bool)
        keep[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
        token, cls = token[keep], cls[keep]
        begin = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        size = np.diff(np.r_[begin, len(token)])
        lead = np.repeat(cls[begin], size)
        several = np.repeat(size > 1, size)
        return pa.RecordBatch.from_arrays([_signed(token[several]), _signed(cls[several]), _signed(lead[several])], ["token", "cls", "lead"])

    now, held = None, []
    for batch in batches:
        for bucket, n, blob in zip(batch["bucket"].to_pylist(), batch["n"].to_pylist(), batch["blob"]):
            if bucket != now and held:
                yield settle(held)
                held = []
            now = bucket
            raw = pa.decompress(blob.as_buffer(), n * 16, codec="zstd", asbytes=True)
            held.append((np.frombuffer(raw, np.uint64, n), np.frombuffer(raw, np.uint64, n, n * 8)))
    if held:
        yield settle(held)


def _cross_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, shared: pairs of a shingle's classes in different components that sizes and bitmaps leave."""
    most, step = 1 << 20, 1 << 15
    pairs: list[tuple[np.ndarray, ...]] = []

    def merged() -> tuple[np.ndarray, ...]:
        a, b, n = (np.concatenate([p[i] for p in pairs]) for i in range(3))
        order = np.lexsort((b, a))
        a, b, n = a[order], b[order], n[order]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, np.int64)
        return a[first], b[first], np.add.reduceat(n, first) if len(first) else n

    def starts(token: np.ndarray, tile: np.ndarray) -> np.ndarray:
        return np.r_[True, (token[1:] != token[:-1]) | (tile[1:] != tile[:-1])]

    def partners(token: np.ndarray, tile: np.ndarray, side: np.ndarray, comp: np.ndarray, cls: np.ndarray, n: np.ndarray, bits: np.ndarray) -> None:
        """Rows of whole tiles of shingles, in order: row i meets row i + d where both are of one tile.

        side: 0 for all rows of a tile within a block; 1 and 2 for the rows of two blocks, which meet each other.
        """
        if not len(token):
            return
        group = np.cumsum(starts(token, tile))
        d, at = 1, np.arange(len(token))
        while True:
            at = at[at < len(token) - d]
            at = at[group[at] == group[at + d]]
            if not len(at):
                return
            other = at + d
            fit = (comp[at] != comp[other]) & (100 * np.minimum(n[at], n[other]) >= PERCENT * np.maximum(n[at], n[other]))
            fit &= (side[at] == 0) | (side[at] != side[other])
            x, y = at[fit], other[fit]
            for k in range(0, len(x), step):
                i, j = x[k : k + step], y[k : k + step]
                # J >= 3/4 means that at most (x + y) / 7 shingles are in one set only
                near = 7 * np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64) <= n[i] + n[j]
                i, j = i[near], j[near]
                pairs.append((np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j]), np.ones(len(i), np.int64)))
            if sum(len(p[0]) for p in pairs) > most:
                pairs[:] = [merged()]
            d += 1

    def table(batch: pa.RecordBatch) -> list[np.ndarray]:
        words = PARITY_BITS // 64
        return [*(batch[c].to_numpy() for c in ("token", "tile", "side", "comp", "cls", "n")), np.frombuffer(b"".join(batch["bits"].to_pylist()), np.uint64).reshape(-1, words)]

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = table(batch)
        now = now if held is None else [np.concatenate(x) for x in zip(held, now)]
        cut = int(np.flatnonzero(starts(now[0], now[1]))[-1])  # the last tile may go on
        partners(*(x[:cut] for x in now))
        held = [x[cut:] for x in now]
    if held is not None:
        partners(*held)
    if pairs:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], ["a", "b", "shared"])


def _sets(bits) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """cls, grams of the documents that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = (batch.filter(pa.array(let_through(bits.value, batch[KEY[0]].to_numpy()))) for batch in batches)
        for chunk in tx.chunks(wanted, most=CHUNK_BYTES):
            grams, first = shingle_sets(chunk["text"])
            yield pa.RecordBatch.from_arrays([_signed(tx.set_hashes(grams, first)), tx.binary([grams[a:b].tobytes() for a, b in zip(first[:-1], first[1:])])], ["cls", "grams"])

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch["x"], batch["y"]):
            one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.concatenate([one, two])
            both.sort(kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            keep.append(100 * shared >= PERCENT * (len(one) + len(two) - shared))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b of classes) whose whole shingle sets reach the threshold."""
    spark = docs.sparkSession
    own = scratch.write(pairs.select("a", "b"), f"{name}-pairs")
    named = own.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    needed = scratch.write(named.join(classes.select("cls", "key"), "cls"), f"{name}-needed")
    tasks = min(partitions(spark), 1 + needed.count() // EDGES_A_TASK)  # few keys: few filters to merge
    bits = spark.sparkContext.broadcast(key_filter(needed, tasks))
    sets = keyed(docs, "text").mapInArrow(_sets(bits), "cls long, grams binary")
    sets = scratch.write(sets.join(needed.select("cls"), "cls", "left_semi").dropDuplicates(["cls"]), f"{name}-sets")
    both = own.join(sets.select(F.col("cls").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("grams").alias("y")), "b")
    links = scratch.write(both.select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long"), f"{name}-links")
    scratch.drop(f"{name}-sets", f"{name}-needed")
    return links


def components(links: DataFrame, scratch: Scratch, name: str, rounds: int | None = None) -> DataFrame:
    """node, comp (least node reachable) of the nodes of links, by large and small stars in turn.

    With a number of rounds it stops early: comp is then some node that can be reached.
    """
    edges = scratch.write(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), f"{name}-0")
    tasks = 1 + edges.count() // EDGES_A_TASK

    def spread(df: DataFrame, *by: str) -> DataFrame:
        """Few edges go to few tasks; many are left to the session's partitions and skew handling."""
        return df.repartition(tasks, *by) if tasks <= FEW_TASKS else df

    seen, turn = None, 0
    while True:
        turn += 1
        both = spread(edges.union(edges.select("v", "u")), "u")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = spread(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v"), "u")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread(large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v"), "u", "v").distinct()
        edges = scratch.write(small, f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
        if turn == rounds:
            break
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == seen:
            break
        seen = now
    reached = spread(edges, "u").groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp")
    return spread(reached.union(edges.select(F.col("v").alias("node"), F.col("v").alias("comp"))), "node", "comp").distinct()


def _still_apart(rows: DataFrame, comps: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """token, lead, comp, cls, n: rows of the shingles whose classes are in several components."""
    placed = rows.join(comps.withColumnRenamed("node", "cls"), "cls", "left").select("token", "lead", F.coalesce("comp", "cls").alias("comp"), "cls", "n")
    mixed = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("token")
    return scratch.write(placed.join(mixed, "token", "left_semi"), name)


def _tiled(rows: DataFrame) -> DataFrame:
    """rows with blocks, tile, side: once each, or once for each block where a shingle has over TILE_ROWS classes.

    The number of blocks is a power of two, so that shingles of about the same classes make the same tiles.
    """
    hot = rows.groupBy("token").agg(F.count("*").alias("classes")).filter(F.col("classes") > TILE_ROWS)
    hot = hot.select("token", F.expr(f"shiftleft(1L, cast(ceil(log2(classes / {TILE_ROWS})) as int))").alias("blocks"))
    placed = rows.join(hot, "token", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("own", F.expr("pmod(xxhash64(cls), blocks)")).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    tile = F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return placed.select(*rows.columns, "blocks", tile.alias("tile"), side.alias("side"))


def _second_product(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b, shared: overlaps of the pairs that are left, accumulated over all shingles."""
    parts = rows.groupBy("lead").agg(F.ceil(F.count("*") / PART_ROWS).alias("parts")).filter("parts > 1")
    own = _tiled(rows.join(classes.select("cls", "bits"), "cls").join(parts, "lead", "left"))
    own = own.select("token", "lead", F.expr("pmod(xxhash64(token), coalesce(parts, 1))").alias("part"), "blocks", "tile", "side", "comp", "cls", "n", "bits")
    own = own.repartition(partitions(rows.sparkSession), "lead", "part", "blocks", "tile").sortWithinPartitions("lead", "token", "tile")
    own = own.select("token", "tile", "side", "comp", "cls", "n", "bits")
    return own.mapInArrow(_cross_pairs, "a long, b long, shared long").groupBy("a", "b").agg(F.sum("shared").alias("shared"))


def class_components(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """A row per document row (doc_id, KEY, cls, n; without a word cls is null), and cls, comp of the linked classes."""
    spark = docs.sparkSession
    n = partitions(spark)
    counts = spark.sparkContext.broadcast(shingle_counts(docs).tobytes())
    table = scratch.write(keyed(docs, "doc_id", "text").mapInArrow(_classes, "doc_id long, __id long, __th int, cls long, n long, bits binary"), "table")
    classes = scratch.write(table.filter("cls is not null").groupBy("cls").agg(F.min("__id").alias("key"), F.max("n").alias("n"), F.first("bits").alias("bits")), "classes")
    sent = docs.select("text").mapInArrow(_prefixes(counts, 4 * n), "bucket int, n long, blob binary")
    shared = scratch.write(sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_shared_tokens, "token long, cls long, lead long"), "shared")
    one, two = (classes.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}")) for c in "ab")
    # x + y shingles: an overlap of 3/7 of them is needed; what can follow a prefix is ceil(0.75 n) - 1
    most = f"(shared + greatest(({PERCENT} * na + 99) div 100, ({PERCENT} * nb + 99) div 100) - 1)"
    bound = F.expr(f"(100 + {PERCENT}) * {most} >= {PERCENT} * (na + nb) and 100 * least(na, nb) >= {PERCENT} * greatest(na, nb)")
    stars = shared.filter("cls <> lead").groupBy(F.col("lead").alias("a"), F.col("cls").alias("b")).agg(F.count("*").alias("shared"))
    links = verified(docs, stars.join(one, "a").join(two, "b").filter(bound), classes, scratch, "star")
    comps = scratch.write(components(links, scratch, "first", 2), "first")
    rows = _still_apart(shared.join(classes.select("cls", "n"), "cls"), comps, scratch, "apart")
    many = rows.groupBy("cls").agg(F.count("*").alias("tokens"), F.max("n").alias("n")).filter("10 * tokens >= n").select("cls")
    heavy = rows.join(many, "cls", "left_semi")
    drawn = heavy.groupBy("token").agg(F.min(F.struct(F.xxhash64("token", "cls").alias("draw"), "cls", "comp", "n")).alias("draw"))
    tried = heavy.join(drawn, "token").filter(f"comp <> draw.comp and 100 * least(n, draw.n) >= {PERCENT} * greatest(n, draw.n)").select("cls", F.col("draw.cls").alias("other")).distinct()
    tried = tried.withColumn("turn", F.row_number().over(W.partitionBy("cls").orderBy(F.xxhash64("cls", "other")))).filter(F.col("turn") <= LEADS)
    links = links.union(verified(docs, tried.select(F.least("cls", "other").alias("a"), F.greatest("cls", "other").alias("b")).distinct(), classes, scratch, "drawn"))
    comps = scratch.write(components(links, scratch, "second", 2), "second")
    rows = _still_apart(rows.select("token", "lead", "cls", "n"), comps, scratch, "rest")
    cross = _second_product(rows, classes).join(one, "a").join(two, "b").filter(bound)
    more = verified(docs, cross, classes, scratch, "cross")
    comps = scratch.write(components(links.union(more), scratch, "last"), "last")
    scratch.drop("shared", "apart", "rest", "first", "second")
    return table.drop("bits"), comps.select(F.col("node").alias("cls"), "comp")


def near_duplicates(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, cls, component_id: a row per document row."""
    table, comps = class_components(docs, scratch or Scratch(docs.sparkSession, "ngram-join"))
    reached = table.join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = reached.filter("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least"))
    return reached.join(least, "comp", "left").select("doc_id", F.col("n").alias("n_shingles"), "cls", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def op2_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies one row stays, of the least doc_id (null comes last).

    Repeated rows are copies; rows without a word link with nothing and stay.
    """
    table, comps = class_components(docs, Scratch(spark, "ngram-stage"))
    reached = table.filter("cls is not null").join(comps, "cls", "left")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *KEY)).alias("first")
    best = reached.groupBy(F.coalesce("comp", "cls").alias("comp")).agg(first).select(*(F.col(f"first.{k}").alias(k) for k in KEY))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = keyed(docs.filter(worded), *docs.columns).join(best, KEY, "left_semi").dropDuplicates(KEY)
    return kept.select(docs.columns).union(docs.filter(~worded))


OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, greatest(len(w) - 3, 2))]) END AS g FROM words),
sizes AS (SELECT doc_id, len(g)::BIGINT AS n_shingles FROM sets),
grams AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared
  FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM pairs WHERE 100 * shared >= 75 * (na + nb - shared)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, to_id) AS (
  SELECT doc_id, doc_id FROM sizes
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.to_id = e.a)
SELECT s.doc_id, n_shingles, min(to_id) AS component_id FROM sizes s JOIN reach r ON s.doc_id = r.doc_id GROUP BY ALL
"""
