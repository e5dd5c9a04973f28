"""Large JSON arrays of objects, by themselves or as a field of a page, read in splits.

Text is cut at every closing brace by Spark's own line reader, which reads byte ranges of a file in different
tasks. Whether a brace ends an element depends on all that stands before it, yet only through two things: whether
a string is open, and how deep the nesting is. So a first pass sums up each split, once for a string that is open
where it starts and once for none; windows over the splits of a file (a row each) then tell where each really
starts; and a second pass cuts out the elements. Elements within a split never move. A third pass finds the two ends
of each split, which alone are shuffled, one group for each element that crosses a border.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

_escaped = re.compile(r"\\.", re.DOTALL)
TAIL = 100  # characters of a file's last record that are looked at: it is a bracket, perhaps two


def _records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, block: which split a record is of; value: the text up to a closing brace or the end of the file."""
    rows = spark.read.option("lineSep", "}").text(path)
    return rows.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


#: Braces and brackets that are open between two elements, in a file that is an array and in one that is an object with an array.
ARRAY, PAGE = (0, 1), (1, 1)


def _depths(text: str) -> tuple[bool, tuple[int, int], tuple[int, int]]:
    """Whether the text opens or closes a string; the braces and brackets it leaves open if no string is open at its start, and if one is."""
    parts = (_escaped.sub("", text) if "\\" in text else text).split('"')
    net = [[0, 0], [0, 0]]
    for i, part in enumerate(parts):
        net[i % 2][0] += part.count("{")
        net[i % 2][1] += part.count("[") - part.count("]")
    return len(parts) % 2 == 0, tuple(net[0]), tuple(net[1])


_NUMBERS = ["plain_braces", "plain_brackets", "open_braces", "open_brackets"]
_SUMMARY = "file long, block long, flips boolean, plain_braces long, plain_brackets long, open_braces long, open_brackets long, first string, last string"
_SUMMARY_ARROW = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("flips", pa.bool_()), *((n, pa.int64()) for n in _NUMBERS), ("first", pa.string()), ("last", pa.string())])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each split: whether it flips the state of strings, its net nesting for either state at its start, its ends."""
    now, flips, net, first, last = None, 0, [[0, 0], [0, 0]], "", ""

    def row() -> pa.RecordBatch:
        values = (*now, bool(flips), *net[0], *net[1], first, last.strip()[:TAIL])
        return pa.RecordBatch.from_pylist([dict(zip(_SUMMARY_ARROW.names, values))], schema=_SUMMARY_ARROW)

    for batch in batches:
        for file, block, text in zip(*(batch[c].to_pylist() for c in ("file", "block", "value"))):
            if (file, block) != now:
                if now is not None:
                    yield row()
                now, flips, net, first = (file, block), 0, [[0, 0], [0, 0]], text.lstrip()[:1]
            odd, *own = _depths(text)
            for s in (0, 1):
                here = s ^ flips
                net[s][0] += own[here][0] - (0 if here ^ odd else 1)  # the brace that follows counts outside strings
                net[s][1] += own[here][1]
            flips, last = flips ^ odd, text
    if now is not None:
        yield row()


_PIECE = "file long, block long, part int, ends boolean, text string"
_PIECE_ARROW = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("part", pa.int32()), ("ends", pa.bool_()), ("text", pa.string())])


def _pieces(states, whole: bool, level: tuple[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Whole elements (part null), or of each split the text up to the first end (part 0) and after the last one (part 1).

    states: a broadcast of (open string, braces, brackets) where each split starts; level: those between elements.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, now, held, part, inside, braces, brackets, out = states.value, None, [], 0, False, 0, 0, []

        def leave() -> None:
            if held and not whole:
                out.append((*now, 0 if part == 0 else 1, False, "}".join([*held, ""])))

        for batch in batches:
            for file, block, text in zip(*(batch[c].to_pylist() for c in ("file", "block", "value"))):
                if (file, block) != now:
                    leave()
                    if (file, block) not in known:
                        raise ValueError("the files have changed, or are split otherwise than when they were first read")
                    now, held, part = (file, block), [], 0
                    inside, braces, brackets = known[now]
                held.append(text)
                odd, *own = _depths(text)
                braces, brackets = braces + own[inside][0], brackets + own[inside][1]
                inside ^= odd
                if not inside:
                    braces -= 1
                    if (braces, brackets) == level:
                        if whole == (part is None):
                            out.append((*now, part, True, "}".join([*held, ""])))
                        held, part = [], None
            yield pa.RecordBatch.from_pylist([dict(zip(_PIECE_ARROW.names, x)) for x in out], schema=_PIECE_ARROW)
            out.clear()
        leave()
        yield pa.RecordBatch.from_pylist([dict(zip(_PIECE_ARROW.names, x)) for x in out], schema=_PIECE_ARROW)

    return run


def read_elements(spark: SparkSession, path: str | list[str], key: str | None = None) -> DataFrame:
    """element: the text of each object of the files' arrays (S1), null where something else stands before it.

    A file that is no array is an error. With a key the files are objects, each with that array and no other array
    of objects (S2); that the very last brace of a page is missing cannot be seen. What is broadcast is three numbers
    a split.
    """
    rows, level = _records(spark, path), PAGE if key else ARRAY
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    own = rows.mapInArrow(_summed, _SUMMARY).withColumn("inside", F.coalesce(F.sum(F.col("flips").cast("int")).over(before) % 2, F.lit(0)) == 1)
    for what in ("braces", "brackets"):
        own = own.withColumn(f"net_{what}", F.when(F.col("inside"), F.col(f"open_{what}")).otherwise(F.col(f"plain_{what}")))
        own = own.withColumn(what, F.coalesce(F.sum(f"net_{what}").over(before), F.lit(0)))
    states, ends = {}, {}
    for r in own.drop(*_NUMBERS).orderBy("file", "block").toLocalIterator():
        states[r["file"], r["block"]] = r["inside"], r["braces"], r["brackets"]
        first, braces, brackets, flips, _ = ends.get(r["file"], (r["first"], 0, 0, False, ""))
        ends[r["file"]] = first, braces + r["net_braces"], brackets + r["net_brackets"], flips ^ r["flips"], r["last"]
    for first, braces, brackets, flips, last in ends.values():
        # where no brace follows the last record, one too many was counted there
        closed = not brackets and not flips and (braces == -1 or key and not braces)
        if not closed or first != ("{" if key else "[") or not key and not re.fullmatch(r"(\[\s*)?\]", last):
            raise ValueError(f"{path}: not a list of objects")
    shared = spark.sparkContext.broadcast(states)
    found, pieces = (rows.mapInArrow(_pieces(shared, whole, level), _PIECE) for whole in (True, False))
    turn = W.partitionBy("file").orderBy("block", "part").rowsBetween(W.unboundedPreceding, -1)
    crossing = pieces.withColumn("n", F.coalesce(F.count_if("ends").over(turn), F.lit(0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "part", "text"))), lambda x: x["text"]), "")
    joined = crossing.groupBy("file", "n").agg(text.alias("text"), F.bool_or("ends").alias("ends")).filter("ends")
    both = found.select("text").unionAll(joined.select("text"))
    # the first element comes with what stands before the array
    head = rf'(?s)^\s*(,|\{{.*?"{re.escape(key)}"\s*:\s*\[)\s*(?=\{{)' if key else r"^\s*[\[,]\s*"
    element = F.regexp_replace("text", head, "")
    return both.select(F.when(element.startswith("{"), element).alias("element"))


def _objects(elements: DataFrame, path: str | list[str], schema: T.StructType, required: list[str]) -> DataFrame:
    whole = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    rows = elements.select(F.from_json("element", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), F.json_object_keys("element").alias("keys"))
    lacking = F.array_except(F.array(*map(F.lit, required)).cast("array<string>"), F.coalesce("keys", F.array().cast("array<string>")))
    fails = lambda text: F.raise_error(F.concat(F.lit(f"{path}: "), text)).cast("boolean")
    good = F.when(F.col("r").isNull() | F.col("r._bad").isNotNull(), fails(F.lit("not a list of objects"))).when(F.size(lacking) > 0, fails(F.concat(F.lit("objects without "), F.array_join(lacking, ", ")))).otherwise(F.lit(True))
    return rows.filter(good).select("r.*").drop("_bad")


def read_json_array(spark: SparkSession, path: str | list[str], schema: T.StructType | str, required: list[str]) -> DataFrame:
    """One row per object of the files' arrays, read in splits. An object that cannot be read, or without a required field, is an error when the rows are read; a field that is there and null is fine."""
    own = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    return _objects(read_elements(spark, path), path, own, required)


def read_feed_pages(spark: SparkSession, path: str | list[str], record: T.StructType, array: str = "vulnerabilities", field: str = "cve") -> DataFrame:
    """One row per record of a folder of pages, of any size (S2): objects whose array has the records under a field."""
    return _objects(read_elements(spark, path, array), path, T.StructType([T.StructField(field, record)]), []).select(f"{field}.*")
