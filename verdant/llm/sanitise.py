"""Information-theoretic sanitisation of personal data.

Base: e-mail addresses, IP addresses, card and phone numbers, found by fixed patterns in whole texts.
Method: each distinct value is a protected entity, and so is each secret: a value that is assigned to a
name such as token or password, or a run of 20 letters and digits or more with SECRET_BITS bits of
information a character. Words within CONTEXT words of an entity's mentions are candidate terms. Over all
documents, with n documents in all, n(t) having the term, n(e) the entity and n(t, e) the term near the
entity, the term reveals PMI(t; e) = log2(n n(t, e) / (n(t) n(e))) of the entity's information
IC(e) = log2(n / n(e)). A term that reveals at least DISCLOSURE of IC(e) is added as a span of kind
`term`. Most entities stand in one document; a word near such an entity reveals it the more, the rarer it
is, so MIN_TOGETHER is 1, and a higher value only restricts terms to entities met that often. Secrets are
added as spans of kind `secret`; base spans stay. `sanitised_texts` removes terms and generalises
the other spans to their kind.

Null and empty texts have no spans. Spans that would overlap a base span are not added. Repeated rows
count as documents of the statistics; rows of one doc_id that differ in text have spans of their own.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant.llm import _text as tx
from verdant.llm._shared import ID, KEY, TH, Scratch, key_filter, keyed, let_through, partitions

KINDS = ("email", "ip", "card", "phone")
CONTEXT, MIN_TOGETHER, DISCLOSURE, SECRET_BITS = 4, 1, 0.8, 3.0
MANY = 64  # spans of a text, from which its words are found once
SAMPLED = 16  # of so many documents one is looked at first, to leave out terms that are surely too common

# The patterns that the results are defined by. The first two are applied from where
# their leftmost match must begin, which is the same and takes linear time.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
NAMED_SECRET = re.compile(r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key)\b[\"']?[\x20\t]*[:=][\x20\t]*[\"']?([^\s\"',;]{6,})")
DENSE_RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
_not_local = re.compile(r"[^A-Za-z0-9._%+-]")
_other_space = re.compile(r"[\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]")  # str.split() cuts there, WORD does not
_digits = str.maketrans("", "", " ()-.+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    at, after = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > after and LOCAL.match(text, begin - 1):
            begin -= 1
        found = DOMAIN.match(text, at) if begin < at else None
        if found:
            after = found.end()
            yield begin, after
        else:
            after = at + 1
        at = text.find("@", max(at + 1, after))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans (code points, end exclusive) by kind, as KINDS lists them."""
    out: list[list[tuple[int, int]]] = [list(emails(text)) if "@" in text else [], [], [], []]
    for m in IP.finditer(text):
        if all(len(own := p.lstrip("0") or "0") <= 3 and int(own) <= 255 for p in m[0].split(".")):
            out[1].append(m.span())
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].translate(_digits)
            if 13 <= len(digits) <= 19 and luhn(digits):
                out[2].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(m[0].translate(_digits)) <= 15:
                out[3].append(m.span())
    return out


class Ranges:
    """Ranges that may overlap, for quick questions whether another one meets any."""

    def __init__(self, ranges: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(ranges):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b) - 1
        return i >= 0 and self.ends[i] > a


def bits_a_character(text: str) -> float:
    n = len(text)
    return -sum(k / n * math.log2(k / n) for k in Counter(text).values())


def secret_spans(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Values of secret-like names and dense runs with both letters and digits, in order, that overlap nothing."""
    found = [m.span(1) for m in NAMED_SECRET.finditer(text)]
    for m in DENSE_RUN.finditer(text):
        run = m[0]
        if any(c.isdigit() for c in run) and any(c.isalpha() for c in run) and bits_a_character(run) >= SECRET_BITS:
            found.append(m.span())
    out: list[tuple[int, int]] = []
    other = Ranges(taken)
    for a, b in sorted(found):
        if not other.meets(a, b) and (not out or a >= out[-1][1]):
            out.append((a, b))
    return out


def described(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def hash64(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def term(word: str) -> str:
    return word.strip(".,;:!?()[]\"'").lower()


_SCHEMA = "doc_id long, __id long, __th int, n_email long, n_ip long, n_card long, n_phone long, base string, secrets string, n_secrets long, contexts array<struct<entity:bigint,term:bigint,begin:int,end:int>>"
_CONTEXTS = pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.int64()), ("begin", pa.int32()), ("end", pa.int32())]))


def _find(context: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches):
            counts: list[list[int]] = [[], [], [], []]
            base, secrets, n_secrets, contexts = [], [], [], []
            for text in chunk["text"].to_pylist():
                found = base_spans(text) if text else [[], [], [], []]
                for c, f in zip(counts, found):
                    c.append(len(f))
                spans = [(k, a, b) for k, f in zip(KINDS, found) for a, b in f]
                base.append(described(spans))
                more = [("secret", a, b) for a, b in secret_spans(text or "", [(a, b) for _, a, b in spans])]
                secrets.append(described(more))
                n_secrets.append(len(more))
                spans += more
                near, taken = [], Ranges([(a, b) for _, a, b in spans])
                words = [m.span() for m in WORD.finditer(text)] if len(spans) > MANY else None
                for kind, a, b in spans:
                    entity = hash64(f"{kind}:{text[a:b].lower()}")
                    around = [*_before(text, a, context), *_after(text, b, context)] if words is None else _around(words, a, b, context)
                    for word in around:
                        if not taken.meets(*word) and (t := term(text[word[0] : word[1]])):
                            near.append({"entity": entity, "term": hash64(t), "begin": word[0], "end": word[1]})
                contexts.append(near)
            yield pa.RecordBatch.from_arrays([chunk["doc_id"], chunk[ID], chunk[TH], *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(secrets, pa.string()), pa.array(n_secrets, pa.int64()), pa.array(contexts, _CONTEXTS)], ["doc_id", *KEY, *(f"n_{k}" for k in KINDS), "base", "secrets", "n_secrets", "contexts"])

    return run


def _after(text: str, at: int, n: int) -> list[tuple[int, int]]:
    out = []
    for m in WORD.finditer(text, at):
        if len(out) == n:
            break
        out.append(m.span())
    return out


def _before(text: str, at: int, n: int) -> list[tuple[int, int]]:
    """The n words that end before a place, found backwards, whatever their length."""
    out: list[tuple[int, int]] = []
    end = at
    while len(out) < n and end > 0:
        while end > 0 and not WORD.match(text, end - 1):
            end -= 1
        begin = end
        while begin > 0 and WORD.match(text, begin - 1):
            begin -= 1
        if begin < end:
            out.append((begin, end))
        end = begin
    return out[::-1]


def _around(words: list[tuple[int, int]], a: int, b: int, n: int) -> list[tuple[int, int]]:
    """The same from all words of a text, for texts with many spans, whose words may be as long as the text."""
    before = words[max(0, (i := bisect_left(words, (a, 0))) - n) : i]
    j = bisect_right(words, b, key=lambda w: w[1])
    after = words[j : j + n]
    if before and before[-1][1] > a:
        before[-1] = (before[-1][0], a)
    if after and after[0][0] < b:
        after[0] = (b, after[0][1])
    return before + after


def words_of(text: str) -> list[str]:
    return WORD.findall(text) if _other_space.search(text) else text.split()


def _terms(wanted) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """term, n: the partition's documents that have each wanted term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        total: dict[int, int] = {}
        for chunk in tx.chunks(batches):
            texts = [set(words_of(t or "")) for t in chunk["text"].to_pylist()]
            new = {w: hash64(t) for w in set().union(*texts) if w not in memo and (t := term(w))}
            keep = let_through(wanted.value, np.array(list(new.values()), np.int64))
            memo.update(zip(new, (h if k else 0 for h, k in zip(new.values(), keep.tolist()))))
            for own in texts:
                for h in {memo.get(w, 0) for w in own} - {0}:
                    total[h] = total.get(h, 0) + 1
            if len(memo) > 300_000:
                memo.clear()
            if len(total) > 300_000:
                yield counted(total)
                total = {}
        yield counted(total)

    def counted(total: dict[int, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["term", "n"])

    return run


def _documents_with(terms: DataFrame, docs: DataFrame) -> DataFrame:
    """term, n_term: how many of docs have each term of the table. A filter of fixed size lets the pass over
    the texts drop other words; what it lets through by mistake goes when the caller joins."""
    spark = docs.sparkSession
    wanted = key_filter(terms.select(F.col("term").alias("key")), partitions(spark))
    counts = docs.select("text").mapInArrow(_terms(spark.sparkContext.broadcast(wanted)), "term long, n long")
    return counts.groupBy("term").agg(F.sum("n").alias("n_term"))


def disclosing_terms(docs: DataFrame, found: DataFrame, scratch: Scratch, min_together: int = MIN_TOGETHER, disclosure: float = DISCLOSURE) -> DataFrame:
    """entity, term: the pairs over the disclosure threshold, from counts over all documents.

    The threshold allows a pair at most n(t, e) (n / n(e)) ** (1 - disclosure) documents with the term, few
    where the entity is met once. So a term goes before the pass over all texts if it is already near
    entities in more documents than any of its pairs allows, or is in more of one document in SAMPLED:
    such counts are never above n(t), so no pair over the threshold is lost.
    """
    n = float(docs.count())
    near = found.select(*KEY, F.explode("contexts").alias("c")).select(*KEY, "c.entity", "c.term").distinct()
    entities = near.select(*KEY, "entity").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    pairs = near.groupBy("entity", "term").agg(F.count("*").alias("together")).filter(F.col("together") >= min_together)
    allowed = F.col("together") * F.pow(F.lit(n) / F.col("n_entity"), F.lit(1 - disclosure)) * (1 + 1e-9)
    pairs = scratch.write(pairs.join(entities.filter(F.col("n_entity") < n), "entity").withColumn("allowed", allowed), "pairs")
    beside = near.select(*KEY, "term").distinct().groupBy("term").agg(F.count("*").alias("n_near"))
    rare = pairs.groupBy("term").agg(F.max("allowed").alias("allowed")).join(beside, "term").filter("n_near <= allowed").select("term", "allowed")
    rare = scratch.write(rare, "terms")
    seen = _documents_with(rare, docs.filter(F.pmod(F.xxhash64("text", "doc_id"), F.lit(SAMPLED)) == 0))
    rare = scratch.write(rare.join(seen, "term", "left").filter(F.coalesce("n_term", F.lit(0)) <= F.col("allowed")).select("term"), "rare_terms")
    scored = pairs.join(_documents_with(rare, docs).join(rare, "term"), "term")
    pmi = F.log2(F.lit(n) * F.col("together") / (F.col("n_term") * F.col("n_entity")))
    return scored.filter(pmi >= disclosure * F.log2(F.lit(n) / F.col("n_entity"))).select("entity", "term")


def sanitise(docs: DataFrame, scratch: Scratch | None = None, context: int = CONTEXT, min_together: int = MIN_TOGETHER, disclosure: float = DISCLOSURE) -> DataFrame:
    """doc_id, KEY, counts per kind, n_secrets, n_terms, n_spans, base (described base spans), spans (base, secrets, terms): a row per document row."""
    scratch = scratch or Scratch(docs.sparkSession, "sanitise")
    found = scratch.write(keyed(docs, "doc_id", "text").mapInArrow(_find(context), _SCHEMA), "found")
    chosen = disclosing_terms(docs, found, scratch, min_together, disclosure)
    each = found.filter("size(contexts) > 0").select(*KEY, F.explode("contexts").alias("c")).select(*KEY, "c.*")
    added = each.join(chosen, ["entity", "term"], "left_semi").groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("added"))
    terms = F.expr("array_join(transform(added, s -> concat('term:', s.begin, ':', s.end)), ',')")
    out = found.drop("contexts").join(added, KEY, "left").withColumn("n_terms", F.coalesce(F.size("added"), F.lit(0)).cast("long"))
    out = out.withColumn("spans", F.concat_ws(",", *(F.when(t != "", t) for t in (F.col("base"), F.col("secrets"), F.coalesce(terms, F.lit(""))))))
    return out.withColumn("n_spans", sum((F.col(f"n_{k}") for k in KINDS), F.col("n_secrets") + F.col("n_terms"))).drop("added")


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch["text"].to_pylist(), batch["spans"].to_pylist()):
            parts, at = [], 0
            for kind, a, b in sorted(((k, int(x), int(y)) for k, x, y in (s.split(":") for s in (spans or "").split(",") if s)), key=lambda s: s[1:]):
                if text is not None and a >= at and b <= len(text):
                    parts += [text[at:a], "" if kind == "term" else f"[{kind}]"]
                    at = b
            out.append(None if text is None else "".join([*parts, text[at:]]))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out, pa.string()), batch["spans"]], ["doc_id", "text", "spans"])


def sanitised_texts(docs: DataFrame, **how) -> DataFrame:
    """doc_id, text (base values generalised to their kind, disclosing terms removed), spans."""
    spans = sanitise(docs, **how).select(*KEY, "spans").dropDuplicates(KEY)
    return keyed(docs, "doc_id", "text").join(spans, KEY).select("doc_id", "text", "spans").mapInArrow(_rewrite, "doc_id long, text string, spans string")


def op1_sanitise(spark, sf_dir: str) -> DataFrame:
    out = sanitise(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_secrets", "n_terms", "n_spans")
