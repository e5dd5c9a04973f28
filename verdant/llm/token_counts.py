"""Token counts by a two-tier look-up where the texts are.

A text's tokens are the sum over its pre-tokens, and few pre-tokens make most of a corpus. One pass over a
sample of the documents (one in SAMPLE, by hash) finds frequent pre-tokens; their lengths are broadcast as
one table of at most TABLE rows. It decides speed, never results. The pass over all documents looks each
pre-token up in the table, then in the worker's cache; the library encodes the misses of a batch together.
No pre-token of a text is ever shuffled.

Pre-tokens depend on the Unicode classes letter, number, white space and other. Characters whose class is
not the same in Unicode 3.2 and today might be split otherwise by the library; the run between spaces that
holds one is a look-up of its own, which the library splits. A piece cut before a space that begins a word,
or after a word, has the same tokens alone as in its text. Texts with a character that may or may not be
white space (rare controls), or with a special token's string, go to the library whole.

Null and empty texts have 0 bytes and 0 tokens. Repeated rows are counted alike.
"""

from __future__ import annotations

import functools
import os
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant.llm import _text as tx

LIMIT, TABLE, PER_PARTITION, CACHE, CACHED_CHARS, SAMPLE = 1024, 32_768, 8_192, 400_000, 64, 16
#: Fixed value: how the vocabulary's library splits a text before it merges bytes.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_split = regex.compile(PRE_TOKEN).findall
#: Runs of characters that need a look: all but ASCII and Latin letters that have been in Unicode from the start.
_unusual = regex.compile(r"[^\t\n\r\x20-\x7E\u00A1-\u00AC\u00AE-\u017F]+").findall
#: Beyond it every character counts as uncertain.
_LAST = 0x30000


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The place of a vocabulary where this is called: executors look for their own copy."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=1)
def uncertain() -> tuple[frozenset[str], frozenset[str]]:
    """Characters that may be white space or not, and those of uncertain class."""

    def kind(category: str) -> str:
        return category[0] if category[0] in "LN" else "space" if category[0] == "Z" else "other"

    spaces, classes = [], []
    for c in map(chr, range(_LAST)):
        old, now = unicodedata.ucd_3_2_0.category(c), unicodedata.category(c)
        if c in "\t\n\r":
            continue
        if "Z" in (old[0], now[0]) and old[0] != now[0] or now in ("Cc", "Zl", "Zp") or c in "\u200b\u180e\ufeff":
            spaces.append(c)
        elif kind(old) != kind(now) or now == "Cn":
            classes.append(c)
    return frozenset(spaces), frozenset(classes)


_next_space, _last_space = regex.compile(r"\s").search, regex.compile(r"(?r)\s").search


@functools.lru_cache(maxsize=4096)
def _any_of(characters: str):
    return regex.compile(f"[{regex.escape(characters, special_only=False)}]").search


def _runs_with(characters: str, text: str) -> Iterator[tuple[int, int]]:
    """Runs without white space that have any of the characters, and the space before; each place is looked at once."""
    end = 0
    while found := _any_of(characters)(text, end):
        before, after = _last_space(text, end, found.start()), _next_space(text, found.end())
        begin = end if before is None else before.start() if before[0] == " " else before.end()
        end = after.start() if after else len(text)
        yield begin, end


def pieces(text: str) -> list[str] | None:
    """The pre-tokens of a text, runs with a character of uncertain class in one piece; None if only the library may split it."""
    odd = set().union(*_unusual(text))
    if not odd:
        return _split(text)
    spaces, classes = uncertain()
    if not odd.isdisjoint(spaces):
        return None
    doubtful = "".join(sorted(c for c in odd if c in classes or ord(c) >= _LAST))
    if not doubtful:
        return _split(text)
    out, at = [], 0
    for begin, end in _runs_with(doubtful, text):
        before = text[at:begin]
        if before and before[-1].isspace() and text[begin] != " ":
            out += _split(before + "x")[:-1]  # white space before a word, not at the end
        elif before:
            out += _split(before)
        out.append(text[begin:end])
        at = end
    return out + _split(text[at:])


@functools.lru_cache(maxsize=2)
def library(name: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(vocabulary(name))
    made.no_truncation()
    made.no_padding()
    return made, [t.content for t in made.get_added_tokens_decoder().values()]


def lengths(name: str, parts: list[str]) -> list[int]:
    return [len(e.ids) for e in library(name)[0].encode_batch(parts, add_special_tokens=False)]


def looked_up(text: str, special: list[str]) -> list[str] | None:
    """What to look up for a text; None if only the library may split it."""
    return None if any(s in text for s in special) else pieces(text)


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[str] = Counter()
    for chunk in tx.chunks(batches):
        for text in chunk["text"].to_pylist():
            if text:
                seen.update(pieces(text) or ())
        if len(seen) > 20 * PER_PARTITION:
            seen = Counter(dict(seen.most_common(10 * PER_PARTITION)))
    top = seen.most_common(PER_PARTITION)
    yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["part", "n"])


def frequent_lengths(docs: DataFrame, name: str, sample: int = SAMPLE) -> dict[str, int]:
    """Lengths of at most TABLE frequent pre-tokens of a sample."""
    own = docs.filter(F.expr(f"pmod(xxhash64(doc_id, text), {sample}) = 0")).select("text")
    found = own.mapInArrow(_frequent, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))
    parts = [r["part"] for r in found.orderBy(F.desc("n"), "part").limit(TABLE).collect()]
    return dict(zip(parts, lengths(name, parts)))


def _count(name: str, table) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, special = library(name)
        first, second = table.value, _caches.setdefault(name, {})
        both = _Two(first, second)
        for chunk in tx.chunks(batches):
            texts = chunk["text"].to_pylist()
            total, own, new = [0] * len(texts), {}, {}
            for i, text in enumerate(texts):
                parts = looked_up(text, special) if text else []
                if parts is None:
                    total[i] = lengths(name, [text])[0]
                    continue
                own[i] = parts
                new.update((p, 0) for p in set(parts) if p not in first and p not in second)
            missing = list(new)
            for at in range(0, len(missing), 5000):
                some = missing[at : at + 5000]
                new.update(zip(some, lengths(name, some)))
            second.update(new)
            for i, parts in own.items():
                total[i] = sum(map(both.__getitem__, parts))
            for p in missing:
                if len(p) > CACHED_CHARS:
                    del second[p]
            if len(second) > CACHE:
                second.clear()
            size = pc.fill_null(pc.binary_length(chunk["text"]), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([chunk["doc_id"], size, pa.array(total, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


class _Two(dict):
    """Looks up the broadcast table, then the worker's cache."""

    def __init__(self, first: dict[str, int], second: dict[str, int]):
        super().__init__(first)
        self.second = second

    def __missing__(self, part: str) -> int:
        return self.second[part]


#: Per Python worker, by vocabulary.
_caches: dict[str, dict[str, int]] = {}


def token_counts(docs: DataFrame, name: str = "byte_bpe_50k.json", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document row. name: of a vocabulary, or its absolute path."""
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, name))
    out = docs.select("doc_id", "text").mapInArrow(_count(name, table), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
