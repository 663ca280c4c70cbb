"""Records of large text files whose separators may stand inside quotes.

Files are read as pieces between a separator (line feeds for CSV, commas for JSON arrays), so
they split over many tasks.  Whether a separator ends a record depends on what stands before
it: inside a quoted value it doesn't, nor inside a nested JSON value.

1. Every block of a file (the part that one task reads) is scanned for either case, beginning
   outside or inside of quotes.  What a block does to the state is then a function of two
   values, and its change of depth two numbers: one short row for each block.
2. A prefix scan over a file's rows composes these functions to the state in which each block
   begins.
3. Blocks are read again, each from its own state, and give their whole records.  A record that
   crosses blocks comes in parts, which are joined in order.

The second table has one row per block and goes to the tasks by broadcast; files of more than
``BLOCKS`` blocks are refused, so its size is bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opinara.session import checkpointed

BLOCKS = 2_000_000  # 256 TB of blocks of 128 MB
_BLOCK = ("file", "start", "length")

# (piece, inside quotes) -> (inside quotes after it, change of depth)
Scanner = Callable[[str, bool], tuple[bool, int]]


@dataclass(frozen=True)
class Form:
    """How pieces make records: a record ends with a piece after which it isn't inside quotes and
    no deeper than ``base``."""

    separator: str
    scan: Scanner
    plain: str  # a pattern that pieces which change no state don't match
    base: int


def scan_csv(line: str, inside: bool) -> tuple[bool, int]:
    """Quotes open at the start of a field only; a doubled quote closes nothing."""
    at = 0
    while True:
        if not inside:
            # The next field that opens with a quote: this one, or one after a comma.
            if line.startswith('"', at):
                at += 1
            else:
                at = line.find(',"', at)
                if at < 0:
                    return False, 0
                at += 2
            inside = True
        at = line.find('"', at)
        if at < 0:
            return True, 0
        if line.startswith('"', at + 1):
            at += 2
            continue
        # Closed; what follows up to the comma belongs to the field.
        at = line.find(",", at + 1)
        if at < 0:
            return False, 0
        at += 1
        inside = False


def scan_json(piece: str, inside: bool) -> tuple[bool, int]:
    """Strings with their escapes, and depth of brackets outside of them."""
    depth, at = 0, 0
    while True:
        if inside:
            while True:
                end, escape = piece.find('"', at), piece.find("\\", at)
                if end < 0:
                    return True, depth
                if 0 <= escape < end:
                    at = escape + 2
                    continue
                at, inside = end + 1, False
                break
        end = piece.find('"', at)
        part = piece[at:] if end < 0 else piece[at:end]
        depth += part.count("[") + part.count("{") - part.count("]") - part.count("}")
        if end < 0:
            return False, depth
        at, inside = end + 1, True


CSV = Form("\n", scan_csv, '"', 0)
JSON = Form(",", scan_json, r'["\[\]{}]', 1)


def _pieces(spark: SparkSession, path: str | list[str], form: Form) -> DataFrame:
    rows = spark.read.option("lineSep", form.separator).text(path)
    meta = F.col("_metadata")
    return rows.select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("start"), meta["file_block_length"].alias("length"), "value"
    )


def _effects(form: Form):
    """One row for each block: the state after it and its change of depth, from either state."""
    names = [*_BLOCK, "end0", "end1", "depth0", "depth1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, depth = None, [False, True], [0, 0]

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(names, [*at, *state, *depth], strict=True))], schema=schema)

        schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("end0", pa.bool_()), ("end1", pa.bool_()), ("depth0", pa.int64()), ("depth1", pa.int64())])
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*_BLOCK, "value")]
            for file, start, length, value in zip(*columns, strict=True):
                if (file, start, length) != at:
                    if at is not None:
                        yield row()
                    at, state, depth = (file, start, length), [False, True], [0, 0]
                if value is not None:
                    for k in (0, 1):
                        state[k], change = form.scan(value, state[k])
                        depth[k] += change
        if at is not None:
            yield row()

    return run


def block_states(pieces: DataFrame, form: Form) -> DataFrame:
    """(file, start, length, inside, depth): the state in which each block begins."""
    told = F.when(F.col("value").rlike(form.plain), F.col("value")).alias("value")  # others change nothing
    kind = "file string, start long, length long, end0 boolean, end1 boolean, depth0 long, depth1 long"
    rows = pieces.select(*_BLOCK, told).mapInArrow(_effects(form), kind)
    # A block either sets the state, or keeps it, or swaps it; the state is what the last
    # setting block left, swapped as often as blocks did since.
    whole = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, 0)
    swaps = F.sum((F.col("end0") & ~F.col("end1")).cast("int")).over(whole)
    rows = rows.withColumn("swaps", swaps)
    last = F.last(F.when(F.col("end0") == F.col("end1"), F.struct("end0", "swaps")), ignorenulls=True).over(whole)
    rows = rows.withColumn("last", last)
    swapped = F.pmod(F.col("swaps") - F.coalesce(F.col("last.swaps"), F.lit(0)), F.lit(2)) == 1
    rows = rows.withColumn("after", F.coalesce(F.col("last.end0"), F.lit(False)) != swapped)
    order = W.partitionBy("file").orderBy("start")
    rows = rows.withColumn("inside", F.lag("after", 1, False).over(order))
    change = F.when(F.col("inside"), F.col("depth1")).otherwise(F.col("depth0"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("depth", F.coalesce(F.sum(change).over(before), F.lit(0))).select(*_BLOCK, "inside", "depth")


def _cut(form: Form, want: str):
    """`want` "whole": records that lie in one block, with whether each is its file's first;
    "parts": (file, start, head, text) of those that cross blocks."""

    def whole(texts: list[str], first: list[bool], files: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(first, pa.bool_()), pa.array(texts, pa.string())], names=["file", "first", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, inside, depth, held, open_before, new = None, False, 0, [], False, True
        out: list[tuple] = []

        def leave() -> None:
            """What is open at the end of a block goes on in the next."""
            if at is not None and held and want == "parts":
                out.append((at[0], at[1], not open_before, form.separator.join(held)))

        def flush() -> pa.RecordBatch:
            if want == "whole":
                batch = whole([o[2] for o in out], [o[1] for o in out], [o[0] for o in out])
            else:
                names = ["file", "start", "head", "text"]
                kinds = [pa.string(), pa.int64(), pa.bool_(), pa.string()]
                batch = pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=names)
            out.clear()
            return batch

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_pylist() for c in (*_BLOCK, "inside", "depth")]
            values = batch.column("value").to_pylist()
            marked = pc.match_substring_regex(batch.column("value"), form.plain).to_pylist()
            for file, start, length, begins, deep, value, mark in zip(*columns, values, marked, strict=True):
                if (file, start, length) != at:
                    leave()
                    if begins is None:
                        raise ValueError(f"the blocks of {file} have changed between two reads")
                    at, inside, depth, held = (file, start, length), begins, deep, []
                    open_before = inside or depth > form.base
                    new = start == 0
                if mark:
                    inside, change = form.scan(value, inside)
                    depth += change
                held.append(value)
                if inside or depth > form.base:
                    continue
                text = form.separator.join(held) if len(held) > 1 else value
                held = []
                if open_before:
                    if want == "parts":
                        out.append((file, start, False, text))
                    open_before = False
                elif want == "whole" and text.strip():
                    out.append((file, new, text))
                    new = False
                if len(out) >= 10_000:
                    yield flush()
        leave()
        if out:
            yield flush()

    return run


def records(spark: SparkSession, path: str | list[str], form: Form) -> DataFrame:
    """(file, first, text): every record once; first is that with which its file begins."""
    pieces = _pieces(spark, path, form)
    states = checkpointed(block_states(pieces, form))
    if states.count() > BLOCKS:
        raise ValueError(f"more than {BLOCKS} blocks of files; read them in parts")
    # One short row per block, counted above; a shuffled join would lose the order of pieces.
    begun = pieces.join(F.broadcast(states), [*_BLOCK], "left")
    one = begun.mapInArrow(_cut(form, "whole"), "file string, first boolean, text string")
    crossing = begun.mapInArrow(_cut(form, "parts"), "file string, start long, head boolean, text string")
    # At most two parts per block: the end of one record and the beginning of the next.
    order = W.partitionBy("file").orderBy("start", "head")
    crossing = crossing.withColumn("n", F.sum(F.col("head").cast("long")).over(order))
    joined = crossing.groupBy("file", "n").agg(F.sort_array(F.collect_list(F.struct("start", "head", "text"))).alias("p"), F.min("start").alias("at"))
    # A first record that crosses blocks begins its file's first block.
    text = F.array_join(F.col("p.text"), form.separator)
    starts = (F.col("at") == 0) & F.col("p")[0]["head"] & (F.col("n") == 1)
    rest = joined.select("file", starts.alias("maybe"), text.alias("text"))
    firsts = one.where("first").select("file").distinct().withColumn("known", F.lit(True))
    rest = rest.join(firsts, "file", "left").select("file", (F.col("maybe") & F.col("known").isNull()).alias("first"), "text")
    return one.unionByName(rest)
