"""Packing by lexical retrieval: each sequence is a seed document and the unused documents most like it.

Three steps. (1) Every text is tokenised once; ids, a route and, for each task, in how many documents each token
stands are written. Distinct runs between white space of a batch are encoded once, and worker caches keep the
runs met first. (2) Whole windows of long documents are sequences of their own. (3) What is left of each document
is dealt by its route, the least ranks of its tokens under a fixed shuffle of the vocabulary, so that documents
meet in a shard with about the odds of their likeness. A shard (at most SHARD_TOKENS tokens) has an inverted index with BM25
weights, of tokens as terms; counts are those of all documents. The first unused document is the seed; a query
of its QUERY most telling tokens ranks the shard, and the best unused documents fill the window, the last one
cut where the window ends; what is left of it stays in the index. If none shares a queried token, the next
unused one follows. What a shard cannot fill goes on to the next shard of its task; what a task cannot fill
(fewer than a window's tokens) makes sequences of powers of two, which need no padding.

The vocabulary bounds the statistics that are broadcast. Range borders and row numbers break ties of routes, so
thousands of copies spread over tasks. Row numbers are written, so a lost task is repeated with equal results.

A null or empty text has the end id only. Repeated rows are documents of their own (row tells them apart); a
null doc_id stays null. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant.llm import _text as tx
from verdant.llm._shared import Scratch, partitions
from verdant.llm.token_counts import PRE_TOKEN, library, vocabulary

WINDOW, END, QUERY, SHARD_TOKENS, CACHE, CHUNK = 2048, 1, 16, 1 << 22, 1_000_000, 8 << 20
K1, B = 1.2, 0.75
#: Characters beyond ASCII that the library takes, or may take, for white space.
_ODD = [c.encode() for c in map(chr, [0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])]
#: First bytes of characters up to U+017F, of which every version of Unicode has the same class.
_KNOWN = np.zeros(256, bool)
_KNOWN[[*range(0x80), *range(0x80, 0xC0), *range(0xC2, 0xC6)]] = True


class Tokens:
    """Ids of a vocabulary file of byte-level pairs, by runs between white space."""

    def __init__(self, name: str):
        import tiktoken

        self.library, special = library(name)
        self.special = [s.encode() for s in special]
        with open(vocabulary(name), encoding="utf-8") as f:
            model = json.load(f)["model"]
        # the file writes bytes as printable characters: those that are printable as they are, the others from U+0100 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(byte[c] for c in word): i for word, i in model["vocab"].items() if word not in special and all(c in byte for c in word)}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ids = [model["vocab"][m] for m in merged]
        # merging by rank gives the library's ids if later merges have higher ids; else the library encodes all
        self.fast = tiktoken.Encoding("own", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={}) if ids == sorted(ids) and len(ranks) == max(ranks.values()) + 1 else None
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.spaced, self.feed = np.zeros(self.size, bool), ranks.get(b"\n", -1)
        for word, i in ranks.items():
            self.spaced[i] = word[:1] == b" "
        self.known = np.empty(0, np.uint64)
        self.begin, self.size_of, self.pool = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, self.kind)

    def _slow(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def _encoded(self, raw: bytes, a: np.ndarray, b: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begins and sizes within ids of the runs raw[a:b]. kinds: 0 with a first space, 1 without any, 2 for the library."""
        begin, size, out, have = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), [], 0
        for kind in range(3):
            own = np.flatnonzero(kinds == kind)
            runs = [raw[x:y] for x, y in zip(a[own].tolist(), b[own].tolist())]
            if not runs:
                continue
            if kind == 2:
                parts = self._slow([r.decode() for r in runs])
                ids, sizes = np.concatenate(parts), np.array([len(p) for p in parts])
                at = np.cumsum(sizes) - sizes
            else:  # encoded as one text, in which a run begins at its space, or after a line feed
                ids = self.fast.encode_to_numpy((b"", b"\n")[kind].join(runs).decode()).astype(self.kind)
                at = np.flatnonzero(self.spaced[ids]) if not kind else np.r_[0, np.flatnonzero(ids == self.feed) + 1]
                sizes = np.diff(np.r_[at, len(ids) + kind]) - kind
            begin[own], size[own] = at + have, sizes
            out.append(ids)
            have += len(ids)
        return begin, size, np.concatenate(out) if out else np.empty(0, self.kind)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each begins (and the end)."""
        data, offsets = tx.buffers(texts)
        whole = self._whole(data, offsets)
        start, end = tx.runs(tx.WORD[data], offsets)
        begins = np.zeros(len(data) + 1, bool)
        begins[offsets] = True
        led = (start > 0) & ~begins[start] & (data[np.maximum(start - 1, 0)] == 0x20)
        start = start - led
        # white space between runs: all but its last character, which stands alone unless a word takes it along
        left, right = self._gaps(start, end, offsets)
        text_end = begins[right]
        alone = ~text_end & np.isin(right, start[~led]) & (right - left > 1)
        a = np.r_[start, left, right[alone] - 1]
        b = np.r_[end, np.where(alone, right - 1, right), right[alone]]
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        h = tx.range_hashes(data, a, b)
        unique, where, inverse = np.unique(h, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, unique)
        old = np.zeros(len(unique), bool)
        if len(self.known):
            old = self.known[np.minimum(place, len(self.known) - 1)] == unique
        raw = data.tobytes()
        bad = np.flatnonzero(whole)
        skip = np.zeros(len(unique), bool)
        if len(bad):  # runs of texts that the library takes whole needn't be encoded
            of = np.searchsorted(offsets, a, "right") - 1
            used = np.zeros(len(unique), bool)
            used[inverse[~whole[of]]] = True
            skip = ~used
        new = np.flatnonzero(~old & ~skip)
        x, y, strange = a[where[new]], b[where[new]], np.r_[0, np.cumsum(~_KNOWN[data])]
        easy = tx.WORD[data[y - 1]] & (strange[y] == strange[x]) & (self.fast is not None) & (self.feed >= 0)
        begins_new, sizes, ids = self._encoded(raw, x, y, np.where(easy, (data[x] != 0x20).astype(int), 2))
        size, begin = np.zeros(len(unique), np.int64), np.zeros(len(unique), np.int64)
        size[old], begin[old] = self.size_of[place[old]], self.begin[place[old]]
        size[new], begin[new] = sizes, len(self.pool) + begins_new
        pool = np.concatenate([self.pool, ids])
        each = size[inverse]
        total = np.cumsum(each)
        out = pool[np.repeat(begin[inverse] - (total - each), each) + np.arange(total[-1] if len(total) else 0)]
        first = np.r_[0, total][np.searchsorted(a, offsets)]
        if len(self.known) < CACHE and len(new):
            self._keep(unique[new], begins_new, sizes, ids)
        if not len(bad):
            return out, first
        parts = [out[x:y] for x, y in zip(first, first[1:])]
        for i, own in zip(bad, self._slow([texts[int(i)].as_py() for i in bad])):
            parts[i] = own
        return np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]

    def _keep(self, hashes: np.ndarray, begins: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        known, begin, size = np.r_[self.known, hashes], np.r_[self.begin, begins + len(self.pool)], np.r_[self.size_of, sizes]
        order = np.argsort(known)
        self.known, self.begin, self.size_of, self.pool = known[order], begin[order], size[order], np.concatenate([self.pool, ids])

    @staticmethod
    def _gaps(start: np.ndarray, end: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """White space outside the runs, cut at borders of texts."""
        edges = np.concatenate([start, end, offsets])
        kind = np.concatenate([np.full(len(start), 1), np.full(len(end), -1), np.zeros(len(offsets), np.int64)])
        order = np.lexsort((kind, edges))
        edges, inside = edges[order], np.cumsum(kind[order])
        keep = (inside[:-1] == 0) & (edges[1:] > edges[:-1])
        return edges[:-1][keep], edges[1:][keep]

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts the library has to take whole: special strings, rare white space, rare controls."""
        hits = [np.flatnonzero((data >= 0x1C) & (data <= 0x1F))]
        if (data >= 0x80).any():
            padded, odd = np.r_[data, 0, 0].astype(np.uint32), {int.from_bytes(c[:3].ljust(3, b"\0")) for c in _ODD}
            at = np.flatnonzero(np.isin(data, [c[0] for c in _ODD]))
            third = np.where(data[at] < 0xE0, 0, padded[at + 2])
            hits.append(at[np.isin(padded[at] << 16 | padded[at + 1] << 8 | third, list(odd))])
        raw = data.tobytes()
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                hits.append(np.array([at]))
                at = raw.find(s, at + 1)
        out = np.zeros(len(offsets) - 1, bool)
        out[np.searchsorted(offsets, np.concatenate(hits), "right") - 1] = True
        return out


@functools.lru_cache(maxsize=2)
def tokens(name: str) -> Tokens:
    return Tokens(name)


_WRITTEN = "doc_id long, row long, doc_tokens long, route long, ids binary, tally binary"
_WRITTEN_NAMES = [x.split()[0] for x in _WRITTEN.split(", ")]
_PIECE = "doc_id long, row long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long"
_PIECE_NAMES = [x.split()[0] for x in _PIECE.split(", ")]


def _ranks(n: int) -> np.ndarray:
    """A fixed shuffle of the vocabulary."""
    return np.argsort(np.argsort(tx.mix(np.arange(1, n + 1, dtype=np.uint64))))


def _tokenise(name: str, end: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, row = tokens(name), TaskContext.get().partitionId() << 33
        rank, tally = _ranks(coder.size), np.zeros(coder.size + 2, np.int64)
        for chunk in tx.chunks(batches, most=CHUNK):
            ids, first = coder.encode(chunk["text"])
            sizes, binary, routes = np.diff(first) + 1, [], []
            for a, b in zip(first.tolist(), first[1:].tolist()):
                own = np.append(ids[a:b], np.array(end, coder.kind))
                binary.append(own.tobytes())
                own = np.unique(own)
                tally[own] += 1
                least = np.sort(rank[own])[:3] if len(own) <= 3 else np.sort(np.partition(rank[own], 2)[:3])
                routes.append(functools.reduce(lambda t, x: t << 20 | int(x), [*least, 0, 0, 0][:3], 0))
            tally[-2:] += len(sizes), sizes.sum()
            n = chunk.num_rows
            values = [chunk["doc_id"], pa.array(np.arange(row, row + n)), pa.array(sizes), pa.array(routes, pa.int64()), tx.binary(binary), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays(values, _WRITTEN_NAMES)
            row += n
        if tally[-2]:
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())), tx.binary([tally.tobytes()])], _WRITTEN_NAMES)

    return run


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for x in batch["tally"].to_pylist():
            own = np.frombuffer(x, np.int64)
            total = own + total if len(total) else own
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["token", "n"])


def _pieces(found: list[tuple], kind: np.dtype) -> Iterator[pa.RecordBatch]:
    """Of (doc_id, row, start, ids, doc_tokens, sequence_id, offset)."""
    for at in range(0, len(found), 4096):
        doc, row, start, ids, size, sequence, offset = zip(*found[at : at + 4096])
        wide = [x.astype("<u4").tobytes() for x in ids]
        values = [pa.array(doc, pa.int64()), *(pa.array(np.array(x, np.int64)) for x in (row, start, [len(x) for x in ids], size)), tx.binary(wide), *(pa.array(np.array(x, np.int64)) for x in (sequence, offset))]
        yield pa.RecordBatch.from_arrays(values, _PIECE_NAMES)


def _long(window: int, kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Whole windows of long documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 33
        for batch in batches:
            found = []
            for doc, row, size, ids in zip(*(batch[c].to_pylist() for c in ("doc_id", "row", "doc_tokens", "ids"))):
                own = np.frombuffer(ids, kind)
                for at in range(0, size - window + 1, window):
                    found.append((doc, row, at, own[at : at + window], size, 2 * sequence, 0))
                    sequence += 1
            yield from _pieces(found, np.dtype(kind))

    return run


class Shard:
    """Unused rests of documents and their BM25 index. Each: [doc_id, row, start, ids, doc_tokens]."""

    def __init__(self, rests: list[list], weight: np.ndarray, mean: float):
        self.rests, n = rests, len(rests)
        self.unused = np.ones(n, bool)
        terms, tf = zip(*(np.unique(r[3], return_counts=True) for r in rests))
        sizes = np.array([len(r[3]) for r in rests])
        held = np.array([len(t) for t in terms])
        doc, term, tf = np.repeat(np.arange(n, dtype=np.int32), held), np.concatenate(terms).astype(np.int32), np.concatenate(tf)
        gain = (weight[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes / mean)[doc])).astype(np.float32)
        self.own = np.r_[0, np.cumsum(held)]
        self.terms, self.weights = term, weight[term]
        order = np.argsort(term, kind="stable")
        self.doc, self.gain = doc[order], gain[order]
        self.first = np.searchsorted(term[order], np.arange(len(weight) + 1))
        self.seed = 0

    def next(self) -> int:
        while not self.unused[self.seed]:
            self.seed += 1
        return self.seed

    def scores(self, i: int, query: int) -> np.ndarray:
        """BM25 of the shard's documents for the most telling tokens of one of them."""
        own, weight = self.terms[self.own[i] : self.own[i + 1]], self.weights[self.own[i] : self.own[i + 1]]
        if len(own) > query:
            own = own[np.argpartition(-weight, query)[:query]]
        out = np.zeros(len(self.rests), np.float32)
        for t in own.tolist():
            a, b = self.first[t], self.first[t + 1]
            out[self.doc[a:b]] += self.gain[a:b]
        return out

    def fill(self, window: int, query: int) -> list[tuple]:
        """The pieces of one sequence; there must be enough tokens for it."""
        out, room, i, scores = [], window, self.next(), None
        while True:
            rest = self.rests[i]
            ids = rest[3][:room]
            out.append((rest[0], rest[1], rest[2], ids, rest[4], window - room))
            room -= len(ids)
            if len(ids) == len(rest[3]):
                self.unused[i] = False
            else:
                rest[2], rest[3] = rest[2] + len(ids), rest[3][len(ids) :]
            if not room:
                return out
            if scores is None:
                scores = np.where(self.unused, self.scores(i, query), 0)
            scores[i] = 0
            i = int(scores.argmax())
            if scores[i] <= 0:
                i = self.next()


def _pack(stats, window: int, query: int, shard_tokens: int, kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """stats: a broadcast of (weights of tokens, mean tokens of a document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        (weight, mean), sequence = stats.value, TaskContext.get().partitionId() << 33
        rests, held = [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal rests, held, sequence
            shard, found = Shard(rests, weight, mean), []
            while held >= window:
                found += [(*p[:5], 2 * sequence + 1, p[5]) for p in shard.fill(window, query)]
                sequence, held = sequence + 1, held - window
            rests = [r for r, u in zip(rests, shard.unused) if u]
            yield from _pieces(found, np.dtype(kind))

        for batch in batches:
            for doc, row, size, start, ids in zip(*(batch[c].to_pylist() for c in ("doc_id", "row", "doc_tokens", "start", "rest"))):
                own = np.frombuffer(ids, kind)
                rests.append([doc, row, start, own, size])
                held += len(own)
                if held >= shard_tokens:
                    yield from packed()
        if held >= window:
            yield from packed()
        found, left = [], held
        while left:
            power = 1 << left.bit_length() - 1
            offset = 0
            while offset < power:
                rest = rests[0]
                ids = rest[3][: power - offset]
                found.append((*rest[:3], ids, rest[4], 2 * sequence + 1, offset))
                offset += len(ids)
                rest[2], rest[3] = rest[2] + len(ids), rest[3][len(ids) :]
                if not len(rest[3]):
                    rests.pop(0)
            sequence, left = sequence + 1, left - power
        yield from _pieces(found, np.dtype(kind))

    return run


def pack(docs: DataFrame, name: str = "byte_bpe_50k.json", window: int = WINDOW, end: int = END, query: int = QUERY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pieces of documents (doc_id, text) in sequences: doc_id, row, start, length, doc_tokens, ids (unsigned 32-bit, little-endian), sequence_id, offset.

    name: of a vocabulary, or its absolute path; window: a sequence's tokens, a power of two; end: the id after each document.
    """
    if window & window - 1:
        raise ValueError("a window is a power of two")
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "packing")
    kind = tokens(name).kind
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    written = scratch.write(texts.mapInArrow(_tokenise(name, end), _WRITTEN), "tokens")
    sums = written.filter("tally is not null").select("tally").mapInArrow(_tally, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = {r["token"]: r["n"] for r in sums.collect()}  # a row for each token of the vocabulary at most
    size = tokens(name).size
    n, total = counts.get(size, 0), counts.get(size + 1, 0)
    df = np.array([counts.get(t, 0) for t in range(size)])
    weight = np.log(1 + (n - df + 0.5) / (df + 0.5)).astype(np.float32)
    stats = spark.sparkContext.broadcast((weight, max(total, 1) / max(n, 1)))
    own = written.filter("tally is null")
    long = own.filter(F.col("doc_tokens") >= window).select("doc_id", "row", "doc_tokens", "ids").mapInArrow(_long(window, kind.str), _PIECE)
    rest = F.col("doc_tokens") % window
    rests = own.filter(rest > 0).select("doc_id", "row", "doc_tokens", "route", (F.col("doc_tokens") - rest).alias("start"), F.expr(f"substring(ids, cast(doc_tokens - doc_tokens % {window} as int) * {kind.itemsize} + 1)").alias("rest"))
    rests = rests.repartitionByRange(partitions(spark), "route", "row").sortWithinPartitions("route", "row")
    return long.unionAll(rests.mapInArrow(_pack(stats, window, query, shard_tokens, kind.str), _PIECE))


def op13_lexical_packing(spark, sf_dir: str) -> DataFrame:
    out = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
