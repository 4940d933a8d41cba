"""Layers from and to delimited text: edge lists and matrices.  Read and written in parallel by Spark."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.errors import Failure
from netloom.operators.graph import numbered
from netloom.operators.model import Network
from netloom.sources.files import NODE_MAX, _float_text, exists, node_id, read_lines, write_lines


def _cells(lines: DataFrame, sep: str) -> DataFrame:
    cells = F.transform(F.split("line", re.escape(sep), -1), lambda c: F.btrim(F.btrim(c), F.lit("\"'")))
    return lines.where(F.trim("line") != "").withColumn("cells", cells)


def _body(spark: SparkSession, path: str, sep: str, header: bool) -> DataFrame:
    lines = read_lines(spark, path)
    if header:
        first = lines.agg(F.min("n")).first()[0]
        lines = lines.where(F.col("n") != (-1 if first is None else first))
    return _cells(lines, sep)


def _column(index: int) -> int:
    if index < 0:
        raise Failure("InvalidColumnIndex", "Column indexes begin at 0.")
    return index


def read_edges(spark: SparkSession, path: str, sep: str, header: bool, col1: int, col2: int, value_col: int, valued: bool) -> DataFrame:
    """edges(src, dst, value, place); rows that are short or hold no ids (or no value, if valued) are skipped.

    Self-ties and values of 0 are taken as they are.  place: where in the file, to be compared.
    """
    get = lambda k: F.get("cells", F.lit(_column(k)))
    rows = _body(spark, path, sep, header)
    value = get(value_col).try_cast("float") if valued else F.lit(1.0).cast("float")
    rows = rows.select(node_id(get(col1)).alias("src"), node_id(get(col2)).alias("dst"), value.alias("value"), "n").dropna()
    return rows.select("src", "dst", "value", F.struct("n", F.lit(0).alias("j")).alias("place"))


def read_members(spark: SparkSession, path: str, sep: str, header: bool, node_col: int, aff_col: int) -> DataFrame:
    get = lambda k: F.get("cells", F.lit(_column(k)))
    rows = _body(spark, path, sep, header).select(get(aff_col).alias("hyper_name"), node_id(get(node_col)).alias("node_id"))
    return rows.dropna().where("hyper_name <> ''").distinct()


def read_matrix(spark: SparkSession, path: str, sep: str, square: bool) -> DataFrame:
    """(row, column, value, upper, place) of all cells that are numbers other than 0; empty lines do not count.

    row and column are the labels in the first column and the first line; upper says whether the cell stands on the diagonal or
    above it, by its place and whatever the labels.  square: as many rows as columns, labelled by ids on both sides; otherwise the rows alone are.
    Anything else is refused as a whole.
    """
    lines = _cells(read_lines(spark, path).where(F.length("line") > 0), sep)
    top = lines.orderBy("n").select("n", "cells").first()
    if top is None:
        raise Failure("IOImportError", "The file is empty.")
    names, rest = top["cells"][1:], lines.where(F.col("n") != top["n"])
    label = F.get("cells", F.lit(0))
    shape = rest.agg(F.count("*").alias("rows"), F.max(F.size("cells")).alias("widest"), F.count_if(node_id(label).isNull()).alias("strange")).first()
    widest = max(shape["widest"] or 0, len(top["cells"])) - 1
    if shape["strange"] or widest > len(names) or (square and (shape["rows"] != widest or any(not x.isascii() or not x.isdigit() or int(x) > NODE_MAX for x in names))):
        raise Failure("IOImportError", f"'{path}' is no {'square ' if square else ''}matrix with {'ids as labels' if square else 'ids as row labels'}.")
    placed = rest.join(numbered(rest.select("n"), "n", "i"), "n") if square else rest.withColumn("i", F.lit(0))
    cells = placed.select(label.alias("row"), "n", "i", F.posexplode(F.slice("cells", 2, 2**30)).alias("j", "cell"))
    cells = cells.withColumn("value", F.col("cell").try_cast("float")).where("value is not null and value <> 0")
    head = spark.createDataFrame(list(enumerate(names)), "j int, column string")
    return cells.join(head, "j").select("row", "column", "value", (F.col("j") >= F.col("i")).alias("upper"), F.struct("n", "j").alias("place"))


def import_layer(
    network: Network, name: str, path: str, form: str, *, col1: int = 0, col2: int = 1, value_col: int = 2, node_col: int = 0, aff_col: int = 1,
    header: bool = False, sep: str = "\t", add_missing: bool = False,
) -> None:
    """Adds the file's edges or memberships to a layer; unknown nodes are added, or their rows skipped.

    Edge lists leave every pair of nodes with one edge.  Cells of a matrix are added like edges one by one: those that the layer or an
    earlier cell has already are refused, unless the setting blockmultiedges is off.
    """
    layer, spark = network.layer(name), network.spark
    if form not in ("edgelist", "matrix"):
        raise Failure("UnsupportedImportFormat", f"'{form}' can't be imported.")
    if layer.mode == 1:
        if form == "edgelist":
            edges = read_edges(spark, path, sep, header, col1, col2, value_col, layer.valued)
        else:
            cells = read_matrix(spark, path, sep, True).where(F.lit(layer.directed) | F.col("upper"))
            edges = cells.select(node_id(F.col("row")).alias("src"), node_id(F.col("column")).alias("dst"), "value", "place")
            if not layer.selfties:
                edges = edges.where("src <> dst")
            if not layer.valued:
                edges = edges.where("value > 0").withColumn("value", F.lit(1.0).cast("float"))
        if not layer.directed:
            edges = edges.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})
        if add_missing:
            network.nodeset.ensure_all(edges.select(F.explode(F.array("src", "dst")).alias("node_id")))
        else:
            ids = network.nodeset.df.select(F.col("node_id").alias("src"))
            edges = edges.join(ids, "src", "left_semi").join(ids.withColumnRenamed("src", "dst"), "dst", "left_semi")
        if form == "matrix" and not network.settings.blockmultiedges:
            layer.table.set(layer.df.unionByName(edges.select("src", "dst", "value")))
        else:  # an edge that is there keeps its value, then the first in the file counts
            held = layer.df.select("src", "dst", "value", F.lit(0).alias("later"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("j")).alias("place"))
            edges = held.unionByName(edges.withColumn("later", F.lit(1)))
            layer.table.set(edges.groupBy("src", "dst").agg(F.min_by("value", F.struct("later", "place")).alias("value")))
    else:
        if form == "edgelist":
            members = read_members(spark, path, sep, header, node_col, aff_col)
        else:
            cells = read_matrix(spark, path, sep, False).where("value > 0")
            members = cells.select(F.col("column").alias("hyper_name"), node_id(F.col("row")).alias("node_id")).distinct()
        if add_missing:
            network.nodeset.ensure_all(members.select("node_id"))
        else:
            members = members.join(network.nodeset.df.select("node_id"), "node_id", "left_semi").select("hyper_name", "node_id")
        layer.table.set(layer.df.unionByName(members).distinct())
        layer.names.set(layer.names.df.unionByName(members.select("hyper_name")).distinct())
    network.modified = True


def layer_rows(network: Network, name: str, both_ways: bool = True) -> DataFrame:
    """The columns of an export.  both_ways: a binary undirected layer is given in both directions, as its readers expect."""
    layer = network.layer(name)
    if layer.mode == 2:
        return layer.df.select(F.col("node_id").alias("node"), F.col("hyper_name").alias("affiliation"))
    a, b = ("from", "to") if layer.directed else ("node1", "node2")
    edges = layer.df
    if not layer.directed and not layer.valued and both_ways:
        edges = edges.unionByName(edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "value"))
    out = edges.select(F.col("src").alias(a), F.col("dst").alias(b), "value")
    return out if layer.valued else out.drop("value")


def export_layer(network: Network, name: str, path: str, header: bool = True, sep: str = "\t") -> None:
    """A path that ends in a slash is a folder written in parallel; any other is one file, rows in order."""
    rows = layer_rows(network, name)
    if path.endswith("/"):
        rows.write.mode("overwrite").option("sep", sep).option("header", header).csv(path)
        return
    if os.path.dirname(path) and not exists(os.path.dirname(path)):
        raise Failure("IOExportError", f"Folder of '{path}' not found.")

    def lines():
        if header:
            yield sep.join(rows.columns)
        for r in rows.orderBy(*rows.columns).toLocalIterator():
            yield sep.join(_float_text(x) if isinstance(x, float) else str(x) for x in r)

    write_lines(path, lines())
