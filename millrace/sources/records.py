"""Records of delimited files whose quoted fields may hold line breaks, read by all splits of a file at once.

Whether a line begins inside a quoted field depends on all lines before it. A first pass reduces each split
to a map: where its last line ends if it begins outside of quotes, and if it begins inside. The maps of a file, one row
per split, are composed in order; then every split knows how it begins, and a second pass puts its lines
together. Of a record that crosses splits each split gives its piece; these few are joined at the end.

A quote opens a field only at the field's start; inside, a doubled quote is one quote.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_WHOLE, _HEAD, _REST = 0, 1, 2  # a record; the beginning of one that goes on in the next split; what goes on
_RECORDS = "file string, block long, at long, kind int, record string"
_QUOTE = b'"'


def stays_open(line: bytes, open_: bool, delimiter: bytes) -> bool:
    """Whether a line ends inside a quoted field, given whether it begins inside one."""
    at = 0
    while True:
        if not open_:
            if line[at : at + 1] == _QUOTE:
                open_, at = True, at + 1
                continue
            at = line.find(delimiter, at) + 1
            if not at:
                return False
            continue
        at = line.find(_QUOTE, at) + 1
        if not at:
            return True
        if line[at : at + 1] == _QUOTE:
            at += 1
            continue
        at = line.find(delimiter, at) + 1
        if not at:
            return False
        open_ = False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as bytes with their file and split; in file order within a split."""
    lines = spark.read.text(path, lineSep="\n")
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Stretches of a batch that are of one split."""
    places = [*zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True)]
    begin = 0
    for k in range(1, len(places) + 1):
        if k == len(places) or places[k] != places[begin]:
            yield places[begin], batch.slice(begin, k - begin)
            begin = k


def _quoted(lines: pa.Array) -> list[bool]:
    return pc.match_substring(lines, '"').to_pylist()


def _maps(lines: DataFrame, delimiter: str) -> DataFrame:
    """file, block, from_out, from_in: whether a split ends inside quotes if it begins outside, and if inside."""
    sep = delimiter.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ends = None, (False, True)
        for batch in batches:
            for place, part in _runs(batch):
                if place != here:
                    if here:
                        yield row(here, ends)
                    here, ends = place, (False, True)
                column = part.column("line")
                for line in column.filter(pc.match_substring(column, '"')).to_pylist():  # others change nothing
                    ends = tuple(stays_open(line, x, sep) for x in ends)
        if here:
            yield row(here, ends)

    def row(place: tuple[str, int], ends: tuple[bool, bool]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"file": place[0], "block": place[1], "from_out": ends[0], "from_in": ends[1]}])

    return lines.mapInArrow(run, "file string, block long, from_out boolean, from_in boolean")


def begins_inside(lines: DataFrame, delimiter: str) -> set[tuple[str, int]]:
    """The splits whose first line lies inside a quoted field; one row per split is read to tell."""
    inside, file, open_ = set(), None, False
    for r in _maps(lines, delimiter).orderBy("file", "block").collect():
        if r["file"] != file:
            file, open_ = r["file"], False
        if open_:
            inside.add((r["file"], r["block"]))
        open_ = r["from_in"] if open_ else r["from_out"]
    return inside


def _text(lines: list[bytes]) -> str:
    return b"\n".join(line.removesuffix(b"\r") for line in lines).decode("utf-8", "replace")


def _pieces(lines: DataFrame, delimiter: str, inside: set[tuple[str, int]]) -> DataFrame:
    sep = delimiter.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, number, open_, kind, held, first = None, 0, False, _WHOLE, [], False
        for batch in batches:
            out: list[tuple] = []
            for place, part in _runs(batch):
                if place != here:
                    if held:  # what is still open at the end of a split goes on in the next
                        out.append((*here, number, _HEAD if kind == _WHOLE else _REST, _text(held)))
                    here, number, open_, held, first = place, 0, place in inside, [], place[1] == 0
                    kind = _REST if open_ else _WHOLE
                column = part.column("line")
                for line, quoted in zip(column.to_pylist(), _quoted(column), strict=True):
                    held.append(line.removeprefix(b"\xef\xbb\xbf") if first else line)
                    first = False
                    open_ = stays_open(held[-1], open_, sep) if quoted else open_
                    if not open_:
                        text = _text(held)
                        if kind == _REST or text.strip():  # blank lines are no records
                            out.append((*here, number, kind, text))
                            number += 1
                        kind, held = _WHOLE, []
            if out:
                yield rows(out)
        if held:
            yield rows([(*here, number, _HEAD if kind == _WHOLE else _REST, _text(held))])

    def rows(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True)
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "block", "at", "kind", "record"])

    return lines.mapInArrow(run, _RECORDS)


def records(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """file, block, at, record: every record of the files; it is the ``at``-th that begins in the split at ``block``."""
    lines = _lines(spark, path)
    inside = begins_inside(lines, delimiter)
    pieces = _pieces(lines, delimiter, inside)
    if not inside:  # no record crosses splits
        return pieces.select("file", "block", "at", "record")
    # The pieces of a record follow one another: a head, then what goes on until the next head. A few per split.
    order = Window.partitionBy("file").orderBy("block", "at")
    numbered = pieces.where(F.col("kind") != _WHOLE).withColumn("number", F.sum((F.col("kind") == _HEAD).cast("long")).over(order))
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "record")))
    joined = numbered.groupBy("file", "number").agg(parts.alias("parts"))
    joined = joined.select("file", F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["at"].alias("at"), F.array_join(F.transform("parts", lambda x: x["record"]), "\n").alias("record"))
    return pieces.where(F.col("kind") == _WHOLE).select("file", "block", "at", "record").unionByName(joined)
