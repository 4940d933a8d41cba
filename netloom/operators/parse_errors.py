"""Delimited lines that cannot be read, apart with a reason, and all others as typed rows.

Structure (quoting, number of cells) is decided per line from the pieces between its quotation marks.  Values are
decided per distinct cell text: each distinct text of a column is cast once, the texts that fail form a
dictionary of invalid values with reasons, and that dictionary is joined back to the lines.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.tables import cut

#: Invalid texts up to which their dictionary is broadcast (some 20 MB).
BROADCAST_ROWS = 200_000
FLOAT_MAX = 3.4028234663852886e38
NODE_MAX = 4294967295
#: What stands for the separator where quotation marks are looked at, and a cell, a whole line and a quoted part in terms of it.
MASK = "\u0001"
CELL = f'"[^"]*+(?:""[^"]*+)*+"|[^"{MASK}]*+'
LEGAL = rf"\A(?:{CELL})(?:{MASK}(?:{CELL}))*+\z"
QUOTED = '"[^"]*+"'
#: A file without a time of delivery comes after those with one.
FOREVER = datetime(9999, 12, 31)
NUMBER = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
DIGITS = r"\A[0-9]+\z"


@dataclass(frozen=True)
class Field:
    """A column of the file: its name and kind, `node` (unsigned 32-bit digits) or `real` (finite 32-bit float)."""

    name: str
    kind: str

    def reason(self, text: Column) -> Column:
        """Null where the text is valid."""
        bare = F.regexp_replace(text, r"\A0+(?=[0-9])", "")
        if self.kind == "node":
            value = F.when(F.length(bare) <= 10, bare.try_cast("long"))
            return (
                F.when(text == "", "empty")
                .when(~text.rlike(DIGITS), "not digits")
                .when(value.isNull() | (value > NODE_MAX), "out of range")
            )
        return (
            F.when(text == "", "empty")
            .when(~text.rlike(NUMBER), "not a number")
            .when(F.abs(text.try_cast("double")) > FLOAT_MAX, "out of range")
        )

    def typed(self, text: Column) -> Column:
        return text.try_cast("long" if self.kind == "node" else "double").cast("long" if self.kind == "node" else "float")


EDGE_FIELDS = (Field("from", "node"), Field("to", "node"), Field("value", "real"))


def split_lines(lines: DataFrame, files: DataFrame, fields: tuple[Field, ...] = EDGE_FIELDS) -> DataFrame:
    """Data lines with `fault` (null, `file`, `separator`, `quoting` or `column count`) and cells c0, c1, ... (null where there is a fault).

    Header lines and lines of blanks are left out.  Lines without quotation marks are cut by plain string functions; only the others
    are taken to pieces.
    """
    first = F.min_by(F.struct("layer", "sep_char", "has_header"), F.struct(F.coalesce("delivered_at", F.lit(FOREVER)), "layer", "sep_char", "has_header"))
    dated = files if "delivered_at" in files.columns else files.withColumn("delivered_at", F.lit(None).cast("timestamp_ntz"))
    known = dated.where("file_id is not null").groupBy("file_id").agg(first.alias("f"))
    known = known.select("file_id", "f.layer", F.col("f.sep_char").alias("sep"), F.coalesce("f.has_header", F.lit(False)).alias("header"), F.lit(True).alias("known"))
    raw = F.when(F.endswith("raw_line", F.lit("\r")), F.expr("left(raw_line, length(raw_line) - 1)")).otherwise(F.col("raw_line"))
    rows = lines.select("line_id", "file_id", "line_no", raw.alias("raw")).where("raw is not null").where(F.btrim("raw", F.lit(" \t")) != "")
    rows = rows.join(known, "file_id", "left").where("not (coalesce(header, false) and line_no <=> 1)")

    plain = ~F.col("raw").contains('"')
    # in lines with quotation marks the separator becomes MASK, so that the patterns are fixed (MASK itself is part of no valid cell)
    masked = F.replace(F.when(F.col("sep") == MASK, F.col("raw")).otherwise(F.replace("raw", F.lit(MASK), F.lit("\u0002"))), F.col("sep"), F.lit(MASK))
    rows = rows.withColumn("masked", F.when(~plain & (F.length("sep") == 1), masked))
    bare = F.regexp_replace("masked", QUOTED, "")
    count = lambda text, sep: F.length(text) - F.length(F.replace(text, sep, F.lit(""))) + 1
    fault = (
        F.when(F.col("known").isNull(), "file")
        .when(F.col("sep").isNull() | (F.length("sep") != 1) | (F.col("sep") == '"'), "separator")
        .when(~plain & ~F.col("masked").rlike(LEGAL), "quoting")
        .when(F.when(plain, count(F.col("raw"), F.col("sep"))).otherwise(count(bare, F.lit(MASK))) != len(fields), "column count")
    )
    rows = rows.withColumn("fault", fault)
    pattern = rf"\A({CELL})" + rf"{MASK}({CELL})" * (len(fields) - 1) + r"\z"

    def cell(k: int) -> Column:
        part = F.regexp_extract("masked", pattern, k + 1)
        inner = F.replace(F.regexp_replace(part, r'\A"|"\z', ""), F.lit('""'), F.lit('"'))
        text = F.when(plain, F.split_part("raw", F.col("sep"), F.lit(k + 1))).otherwise(F.replace(inner, F.lit(MASK), F.col("sep")))
        return F.when(F.col("fault").isNull(), F.btrim(text, F.lit(" ")))

    return rows.select("line_id", "file_id", "line_no", "layer", "raw", "fault", *[cell(k).alias(f"c{k}") for k in range(len(fields))])


def _exploded(rows: DataFrame, fields: tuple[Field, ...]) -> DataFrame:
    """A row for each cell: its field's place and text."""
    cells = F.array(*[F.struct(F.lit(k).alias("field"), F.col(f"c{k}").alias("cell")) for k in range(len(fields))])
    return rows.withColumn("x", F.explode(cells)).select(*rows.columns, "x.field", "x.cell")


def invalid_values(split: DataFrame, fields: tuple[Field, ...] = EDGE_FIELDS) -> DataFrame:
    """(field, cell, why): the distinct cell texts that cannot be cast, each judged once."""
    names = [f"c{k}" for k in range(len(fields))]
    cells = _exploded(split.where("fault is null").select(*names), fields).select("field", "cell").distinct()
    why = F.lit(None).cast("string")
    for i, field in reversed(list(enumerate(fields))):
        why = F.when(F.col("field") == i, field.reason(F.col("cell"))).otherwise(why)
    return cells.withColumn("why", why).where("why is not null")


def parse_lines(lines: DataFrame, files: DataFrame, fields: tuple[Field, ...] = EDGE_FIELDS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """All data lines with `reason` (null for valid lines), `detail` and the typed columns (null for invalid lines).

    `lines` needs line_id, file_id, line_no, raw_line; `files` needs file_id, layer, sep_char, has_header and may have delivered_at; further
    columns are ignored.  A carriage return at the end is not part of a line.  Left out are null lines, lines of
    spaces and tabs only, and line 1 of a file with has_header (null counts as false).  reason is `file` (unknown
    or null file_id), `separator` (missing, not one character, or a quotation mark), `quoting`,
    `column count` or `invalid value`; detail says which column and why for the last.  Repeated lines and lines without a
    line_id come out once each; of several rows for one file the first delivered counts; empty tables give no rows.

    The dictionary is broadcast if it has at most `broadcast_rows` texts (and 64 characters for each of these in all); beyond
    that it is joined by shuffles, with the same result.
    """
    split = split_lines(lines, files, fields)
    bad = cut(invalid_values(split, fields))  # each distinct text is judged once and for all
    size = bad.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.length("cell")), F.lit(0)).alias("chars")).first()
    names = [f"c{k}" for k in range(len(fields))]
    if size["rows"] <= broadcast_rows and size["chars"] <= 64 * broadcast_rows:
        joined = split
        for k, name in enumerate(names):
            one = bad.where(F.col("field") == k).select(F.col("cell").alias(name), F.struct("field", "why").alias(f"bad{k}"))
            joined = joined.join(F.broadcast(one), name, "left")
        joined = joined.withColumn("first", F.coalesce(*[f"bad{k}" for k in range(len(fields))]))
    else:  # joined back by the cells themselves: lines that hold invalid values are few, so only their cells are regrouped
        cells = _exploded(split.where("fault is null").select(*names).distinct(), fields)
        hit = cells.join(bad, ["field", "cell"]).groupBy(*names).agg(F.min(F.struct("field", "why")).alias("first"))
        joined = split.join(hit, names, "left")
    titles = F.array(*[F.lit(f.name) for f in fields])
    reason = F.coalesce("fault", F.when(F.col("first").isNotNull(), "invalid value"))
    detail = F.when(F.col("first").isNotNull(), F.concat_ws(": ", F.get(titles, F.col("first.field")), F.col("first.why")))
    typed = [F.when(F.col("reason").isNull(), f.typed(F.col(f"c{i}"))).alias(f.name) for i, f in enumerate(fields)]
    joined = joined.withColumn("reason", reason).withColumn("detail", detail)
    return joined.select("line_id", "file_id", "line_no", "layer", "reason", "detail", *typed, "raw")
