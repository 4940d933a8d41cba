"""Nodesets and networks in files: sectioned text (.tsv, .tsv.gz), binary (.bin, .bin.gz) and Parquet folders (.parquet).

Text is read by Spark line by line; only section headings, a few lines per layer, come to the driver.  A text or binary
file is one file by its definition, so it is written by the driver, row by row as partitions arrive; a binary one is also
read there, as a stream, and goes to the shared folder block by block.  Parquet is the form for data of any size, and is
written and read in parallel.
"""

from __future__ import annotations

import gzip
import json
import os
import struct
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import parquet
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window as W

from netloom.functions.conditions import NODE_MAX
from netloom.functions.errors import Failure
from netloom.functions.tables import checkpoint_folder, cut
from netloom.operators.model import Network, Nodeset, Settings

FORMATS = ("tsv", "tsv.gz", "bin", "bin.gz", "parquet")
# Fixed values of the file formats.
HEADINGS = ("Name", "NodesetFile", "LayerMode", "LayerName", "Directionality", "ValueType", "Selfties")
TYPE_NAMES = {"int": "Int", "char": "Char", "float": "Float", "bool": "Bool"}
TYPE_BYTES = {"char": 0, "int": 1, "float": 2, "bool": 3}
NODESET_MAGIC, NETWORK_MAGIC, VERSION = b"TNDS", b"TNTW", 1


def format_of(path: str) -> str:
    name = os.path.basename(path.rstrip("/"))
    for form in sorted(FORMATS, key=len, reverse=True):
        if name.endswith("." + form):
            return form
    raise Failure("UnsupportedFileFormat", f"'{name}' has no known format.")


def _store(path: str):
    """The file system of an address with a scheme (an object store, say) and the path there, by the session's Hadoop settings."""
    spark = SparkSession.getActiveSession()
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def exists(path: str) -> bool:
    if "://" not in path:
        return os.path.exists(path)
    store, there = _store(path)
    return store.exists(there)


def _need_file(path: str) -> None:
    if not exists(path):
        raise Failure("FileNotFound", f"File '{path}' not found.")


@contextmanager
def opened(path: str, mode: str):
    """A file of bytes to read or write, packed if the name ends so; what lies in a store passes through a copy on the driver."""
    opener = gzip.open if path.endswith(".gz") else open
    if "://" not in path:
        with opener(path, mode) as f:
            yield f
        return
    store, there = _store(path)
    with tempfile.TemporaryDirectory() as folder:
        copy = os.path.join(folder, os.path.basename(path))
        if mode == "rb":
            store.copyToLocalFile(False, there, SparkSession.getActiveSession()._jvm.org.apache.hadoop.fs.Path(copy), True)
        with opener(copy, mode) as f:
            yield f
        if mode == "wb":
            store.copyFromLocalFile(True, True, SparkSession.getActiveSession()._jvm.org.apache.hadoop.fs.Path(copy), there)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, n): lines in order of n."""
    _need_file(path)
    return spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("n"))


def write_lines(path: str, lines: Iterable[str]) -> None:
    with opened(path, "wb") as out:
        for line in lines:
            out.write(f"{line}\n".encode())


def node_id(cell: Column) -> Column:
    """The id in a cell; null if there is none."""
    value = F.when(F.trim(cell).rlike(r"\A[0-9]{1,10}\z"), F.trim(cell).cast("long"))
    return F.when(value <= NODE_MAX, value)


def _float_text(value: float) -> str:
    """Shortest decimal that reads back to the same 32-bit float."""
    text = str(np.float32(value))
    return text[:-2] if text.endswith(".0") else text


# --- text ---------------------------------------------------------------------------------------------------------


def _typed(cell, kind: str):
    return {
        "int": F.trim(cell).try_cast("int"),
        "float": F.trim(cell).try_cast("float"),
        "bool": F.when(F.lower(F.trim(cell)).isin("true", "false"), F.lower(F.trim(cell)) == "true"),
        "char": F.when(F.length(cell) == 1, cell),
    }[kind]


def read_nodeset_text(spark: SparkSession, path: str) -> Nodeset:
    lines = read_lines(spark, path)
    first = lines.where(F.trim("line") != "").orderBy("n").limit(1).collect()
    if not first:
        raise Failure("MissingFileContent", f"File '{path}' is empty.")
    name, *heads = first[0]["line"].split("\t")
    kinds = {v.lower(): k for k, v in TYPE_NAMES.items()}
    columns = []
    for at, head in enumerate(heads, 1):
        attribute, _, kind = head.partition(":")
        if kind.strip().lower() in kinds:
            columns.append((at, attribute.strip(), kinds[kind.strip().lower()]))
    rows = lines.where((F.col("n") > first[0]["n"]) & (F.trim("line") != "")).withColumn("cells", F.split("line", "\t"))
    wide = F.exists(F.slice("cells", len(heads) + 2, 100_000), lambda c: F.trim(c) != "")
    rows = rows.withColumn("cells", F.when(wide, F.raise_error(F.lit(f"A row of '{path}' has more cells than columns."))).otherwise(F.col("cells")))
    rows = rows.withColumn("node_id", node_id(F.get("cells", F.lit(0)))).where("node_id is not null")
    # a repeated id is one node; later cells that are not empty prevail
    values = [F.max_by(_typed(F.get("cells", F.lit(at)), kind), F.when(_typed(F.get("cells", F.lit(at)), kind).isNotNull(), F.col("n"))).alias(a) for at, a, kind in columns]
    df = rows.groupBy("node_id").agg(*values) if values else rows.select("node_id").distinct()
    return Nodeset(spark, name.strip(), df, {a: k for _, a, k in columns}, path)


def write_nodeset_text(nodes: Nodeset, path: str) -> None:
    def cell(value, kind: str) -> str:
        if value is None:
            return ""
        return str(value).lower() if kind == "bool" else _float_text(value) if kind == "float" else str(value)

    def lines() -> Iterator[str]:
        yield "\t".join([nodes.name, *[f"{a}:{TYPE_NAMES[k]}" for a, k in nodes.attributes.items()]])
        for row in nodes.df.select("node_id", *[F.col(f"`{a}`") for a in nodes.attributes]).orderBy("node_id").toLocalIterator():
            yield "\t".join([str(row[0]), *[cell(v, k) for v, k in zip(row[1:], nodes.attributes.values())]])

    write_lines(path, lines())


def read_network_text(spark: SparkSession, path: str, settings: Settings, resolve=lambda p: p) -> tuple[Network, Nodeset]:
    lines = read_lines(spark, path).where(~F.trim("line").startswith("#") & (F.trim("line") != ""))
    heads = lines.where(F.col("line").rlike(rf"\A({'|'.join(HEADINGS)}):")).orderBy("n").collect()
    name, nodeset_file, sections = "", "", []
    for row in heads:
        key, _, value = row["line"].partition(":")
        value = value.strip()
        if key == "LayerMode":
            sections.append({"start": row["n"], "LayerMode": value})
        elif key in ("Name", "NodesetFile"):
            name, nodeset_file = (value, nodeset_file) if key == "Name" else (name, value)
        elif sections:
            sections[-1][key] = value
    if nodeset_file:
        nodes = read_nodeset(spark, resolve(nodeset_file))
    else:
        nodes = None
    network = Network(spark, name, nodes, settings, path)
    body = lines.where(~F.col("line").rlike(rf"\A({'|'.join(HEADINGS)}):"))
    mentioned = []
    for k, s in enumerate(sections):
        end = sections[k + 1]["start"] if k + 1 < len(sections) else 2**62
        part = body.where((F.col("n") > s["start"]) & (F.col("n") < end)).withColumn("cells", F.split("line", "\t"))
        first, rest = F.trim(F.get("cells", F.lit(0))), F.explode(F.slice("cells", 2, 2**30))
        if s["LayerMode"] == "2":
            names = part.select(first.alias("hyper_name")).distinct()
            members = part.select(first.alias("hyper_name"), rest.alias("c")).select("hyper_name", node_id(F.col("c")).alias("node_id")).dropna().distinct()
            network.add_two_mode(s["LayerName"], members, names)
            mentioned.append(members.select("node_id"))
        else:
            directed, valued = s["Directionality"].lower() == "directed", s["ValueType"].lower() == "valued"
            edges = part.select(node_id(first).alias("src"), rest.alias("c"))
            edges = edges.select("src", node_id(F.element_at(F.split("c", ";"), 1)).alias("dst"), F.get(F.split("c", ";"), F.lit(1)).try_cast("float").alias("value"))
            edges = edges.select("src", "dst", F.coalesce("value" if valued else F.lit(1.0), F.lit(1.0)).cast("float").alias("value")).where("src is not null and dst is not null and value <> 0")
            if not directed:
                edges = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "value")
            edges = edges.groupBy("src", "dst").agg(F.max("value").alias("value"))
            network.add_one_mode(s["LayerName"], directed, valued, s.get("Selfties", "false").lower() == "true", edges)
            mentioned.append(edges.select(F.explode(F.array("src", "dst")).alias("node_id")))
    if nodes is None:  # all ids that are mentioned
        ids = spark.createDataFrame([], "node_id long")
        for m in mentioned:
            ids = ids.unionByName(m)
        nodes = network.nodeset = Nodeset(spark, f"{name}_nodeset", cut(ids.distinct()))
    network.modified = nodes.modified = False
    return network, nodes


def write_network_text(network: Network, path: str) -> None:
    def lines() -> Iterator[str]:
        yield "# Network Metadata"
        yield f"Name: {network.name}"
        yield f"NodesetFile: {network.nodeset.path}"
        for layer in network.layers.values():
            yield ""
            yield "# Layer"
            yield f"LayerMode: {layer.mode}"
            yield f"LayerName: {layer.name}"
            if layer.mode == 1:
                yield f"Directionality: {'directed' if layer.directed else 'undirected'}"
                yield f"ValueType: {'valued' if layer.valued else 'binary'}"
                yield f"Selfties: {str(layer.selfties).lower()}"
                ego = None
                cells: list[str] = []
                for r in layer.df.orderBy("src", "dst").toLocalIterator():
                    if r["src"] != ego:
                        if cells:
                            yield "\t".join(cells)
                        ego, cells = r["src"], [str(r["src"])]
                    cells.append(f"{r['dst']};{_float_text(r['value'])}" if layer.valued else str(r["dst"]))
                if cells:
                    yield "\t".join(cells)
            else:
                every = layer.names.df.join(layer.df, "hyper_name", "left").orderBy("hyper_name", "node_id")
                name, cells = None, []
                for r in every.toLocalIterator():
                    if r["hyper_name"] != name:
                        if cells:
                            yield "\t".join(cells)
                        name, cells = r["hyper_name"], [r["hyper_name"]]
                    if r["node_id"] is not None:
                        cells.append(str(r["node_id"]))
                if cells:
                    yield "\t".join(cells)

    write_lines(path, lines())


# --- binary -------------------------------------------------------------------------------------------------------


#: Rows that the driver holds at once while it reads or writes a binary file.
HELD = 200_000


class _Reader:
    """A stream of values; never more of the file than HELD of them is held."""

    def __init__(self, file: BinaryIO):
        self.file = file

    def raw(self, size: int) -> bytes:
        data = self.file.read(size) if size >= 0 else b""
        if len(data) != size:
            raise Failure("IOLoadError", "The file ends too early.")
        return data

    def take(self, code: str) -> tuple:
        return struct.unpack("<" + code, self.raw(struct.calcsize("<" + code)))

    def one(self, code: str):
        return self.take(code)[0]

    def text(self) -> str:
        return self.raw(self.one("B")).decode("utf-8")

    def magic(self, wanted: bytes) -> None:
        if self.take("4s")[0] != wanted or self.one("B") != VERSION:
            raise Failure("IOLoadError", "The file is of another kind or version.")

    def parts(self, count: int, width: int) -> Iterator[tuple[int, bytes]]:
        """(number, bytes) of so many records of the given width, HELD at most at a time."""
        if count < 0:
            raise Failure("IOLoadError", "The file ends too early.")
        while count:
            n = min(count, HELD)
            yield n, self.raw(n * width)
            count -= n


@contextmanager
def _reading(path: str):
    _need_file(path)
    with opened(path, "rb") as f:
        yield _Reader(f)


class _Gathered:
    """Rows that come to the driver a block at a time, as a Parquet file in the shared folder, from which Spark reads them."""

    def __init__(self, spark: SparkSession, schema: str):
        self.spark, self.fields = spark, spark.createDataFrame([], schema).schema.fields
        kinds = {"bigint": pa.int64(), "int": pa.int32(), "float": pa.float32(), "boolean": pa.bool_(), "string": pa.string()}
        self.schema = pa.schema([(f"c{k}", kinds[f.dataType.simpleString()]) for k, f in enumerate(self.fields)])
        self.folder = self.file = None

    def add(self, *columns) -> None:
        if self.file is None:
            self.folder = tempfile.TemporaryDirectory()
            self.file = parquet.ParquetWriter(os.path.join(self.folder.name, "rows.parquet"), self.schema)
        self.file.write_table(pa.table([pa.array(c, t) for c, t in zip(columns, self.schema.types)], schema=self.schema))

    def table(self) -> DataFrame | None:
        """None if there were no rows."""
        if self.file is None:
            return None
        self.file.close()
        path = f"{checkpoint_folder(self.spark)}/netloom-{uuid.uuid4().hex}.parquet"
        near = self.spark._jvm.org.apache.hadoop.fs.Path(f"file://{self.folder.name}/rows.parquet")
        store, there = _store(path)
        store.mkdirs(there)
        store.copyFromLocalFile(True, True, near, there)
        self.folder.cleanup()
        schema = StructType([StructField(f"c{k}", f.dataType) for k, f in enumerate(self.fields)])
        return self.spark.read.schema(schema).parquet(path).toDF(*[f.name for f in self.fields])


def _text_bytes(text: str) -> bytes:
    raw = text.encode("utf-8")
    if len(raw) > 255:
        raise Failure("NameTooLong", "Names and paths have at most 255 bytes in binary files.")
    return bytes([len(raw)]) + raw


_PACK = {"int": "i", "float": "f", "bool": "i", "char": "I"}


def read_nodeset_binary(spark: SparkSession, path: str) -> Nodeset:
    with _reading(path) as r:
        r.magic(NODESET_MAGIC)
        name = r.text()
        kinds = {v: k for k, v in TYPE_BYTES.items()}
        attributes = [(r.text(), kinds[r.one("B")]) for _ in range(r.one("B"))]
        out = Nodeset(spark, name, None, dict(attributes), path)
        rows = _Gathered(spark, out._schema())
        for n, raw in r.parts(r.one("i"), 4):
            rows.add(np.frombuffer(raw, "<u4"), *[[None] * n for _ in attributes])
        left = r.one("i")
        while left > 0:
            block: list[list] = [[] for _ in range(len(attributes) + 1)]
            for _ in range(min(left, HELD)):
                node, k = r.take("IB")
                values: list = [None] * len(attributes)
                for _ in range(k):
                    at = r.one("B")
                    kind = attributes[at][1]
                    raw = r.one(_PACK[kind])
                    values[at] = bool(raw) if kind == "bool" else chr(raw & 0xFFFF) if kind == "char" else raw
                for column, value in zip(block, (node, *values)):
                    column.append(value)
            rows.add(*block)
            left -= HELD
    if (df := rows.table()) is not None:
        out.table.set(df)
    return out


def write_nodeset_binary(nodes: Nodeset, path: str) -> None:
    kinds = list(nodes.attributes.values())
    with opened(path, "wb") as f:
        f.write(NODESET_MAGIC + bytes([VERSION]) + _text_bytes(nodes.name) + bytes([len(kinds)]))
        for a, k in nodes.attributes.items():
            f.write(_text_bytes(a) + bytes([TYPE_BYTES[k]]))
        columns = [F.col(f"`{a}`") for a in nodes.attributes]
        unset = F.lit(True)
        for c in columns:
            unset = unset & c.isNull()
        bare = nodes.df.where(unset)
        f.write(struct.pack("<i", bare.count()))
        for r in bare.select("node_id").orderBy("node_id").toLocalIterator():
            f.write(struct.pack("<I", r[0]))
        rich = nodes.df.where(~unset)
        f.write(struct.pack("<i", rich.count()))
        for r in rich.select("node_id", *columns).orderBy("node_id").toLocalIterator():
            held = [(i, v) for i, v in enumerate(r[1:]) if v is not None]
            f.write(struct.pack("<IB", r[0], len(held)))
            for i, v in held:
                f.write(struct.pack("<B" + _PACK[kinds[i]], i, ord(v) if kinds[i] == "char" else v))


def _read_edges(r: _Reader, rows: _Gathered, undirected: bool, valued: bool) -> None:
    record = np.dtype([("dst", "<u4"), ("value", "<f4")][: 2 if valued else 1])
    egos, counts, pieces, held = [], [], [], 0

    def flush() -> None:
        src, x = np.repeat(np.array(egos, np.int64), counts), np.frombuffer(b"".join(pieces), record)
        dst = x["dst"].astype(np.int64)
        rows.add(*((np.minimum(src, dst), np.maximum(src, dst)) if undirected else (src, dst)), x["value"] if valued else np.ones(len(x), np.float32))

    for _ in range(r.one("i")):
        ego, k = r.take("Ii")
        for n, raw in r.parts(k, record.itemsize):
            egos.append(ego)
            counts.append(n)
            pieces.append(raw)
            held += n
            if held >= HELD:
                flush()
                egos, counts, pieces, held = [], [], [], 0
    if held:
        flush()


def _read_members(r: _Reader, rows: _Gathered, names: _Gathered) -> None:
    """Names of hyperedges, also of those without members."""
    hypers, counts, pieces, held, every = [], [], [], 0, []

    def flush() -> None:
        of = pa.DictionaryArray.from_arrays(np.repeat(np.arange(len(hypers), dtype=np.int32), counts), pa.array(hypers, pa.string()))
        rows.add(of.cast(pa.string()), np.frombuffer(b"".join(pieces), "<u4"))

    for _ in range(r.one("i")):
        hyper = r.text()
        every.append(hyper)
        if len(every) >= HELD:
            names.add(every)
            every = []
        for n, raw in r.parts(r.one("i"), 4):
            hypers.append(hyper)
            counts.append(n)
            pieces.append(raw)
            held += n
            if held >= HELD:
                flush()
                hypers, counts, pieces, held = [], [], [], 0
    if held:
        flush()
    if every:
        names.add(every)


def read_network_binary(spark: SparkSession, path: str, settings: Settings, resolve=lambda p: p) -> tuple[Network, Nodeset]:
    with _reading(path) as r:
        r.magic(NETWORK_MAGIC)
        name, nodeset_path = r.text(), r.text()
        nodes = read_nodeset(spark, resolve(nodeset_path))
        network = Network(spark, name, nodes, settings, path)
        for _ in range(r.one("B")):
            layer_name, mode = r.text(), r.one("B")
            if mode == 1:
                undirected, valued, selfties = r.take("BBB")
                layer = network.add_one_mode(layer_name, not undirected, bool(valued), bool(selfties))
                rows = _Gathered(spark, layer.table.schema)
                _read_edges(r, rows, bool(undirected), bool(valued))
            else:
                layer = network.add_two_mode(layer_name)
                rows, names = _Gathered(spark, layer.table.schema), _Gathered(spark, layer.names.schema)
                _read_members(r, rows, names)
                if (df := names.table()) is not None:
                    layer.names.set(df)
            if (df := rows.table()) is not None:
                layer.table.set(df.distinct())
    network.modified = False
    return network, nodes


def _by_owner(df: DataFrame, owner: str, other: str, value: Column) -> DataFrame:
    """(owner, part, x, n): the values of an owner by parts in the order of `other`, so that no row is large; n counts them all."""
    pieces = df.groupBy(owner, F.shiftright(other, 16).alias("part")).agg(F.sort_array(F.collect_list(value)).alias("x"))
    return pieces.withColumn("n", F.sum(F.size("x")).over(W.partitionBy(owner)))


def write_network_binary(network: Network, path: str) -> None:
    with opened(path, "wb") as f:
        f.write(NETWORK_MAGIC + bytes([VERSION]) + _text_bytes(network.name) + _text_bytes(network.nodeset.path) + bytes([len(network.layers)]))
        for layer in network.layers.values():
            f.write(_text_bytes(layer.name) + bytes([layer.mode]))
            last = None
            if layer.mode == 1:
                f.write(struct.pack("<BBB", not layer.directed, layer.valued, layer.selfties))
                f.write(struct.pack("<i", layer.df.select("src").distinct().count()))
                for r in _by_owner(layer.df, "src", "dst", F.struct("dst", "value")).orderBy("src", "part").toLocalIterator():
                    if r["src"] != last:
                        last = r["src"]
                        f.write(struct.pack("<Ii", last, r["n"]))
                    for dst, value in r["x"]:
                        f.write(struct.pack("<If", dst, value) if layer.valued else struct.pack("<I", dst))
            else:
                grouped = _by_owner(layer.df, "hyper_name", "node_id", F.col("node_id"))
                every = layer.names.df.join(grouped, "hyper_name", "left").orderBy("hyper_name", "part")
                f.write(struct.pack("<i", layer.names.df.count()))
                for r in every.toLocalIterator():
                    if r["hyper_name"] != last:
                        last = r["hyper_name"]
                        f.write(_text_bytes(last) + struct.pack("<i", r["n"] or 0))
                    ids = r["x"] or []
                    f.write(struct.pack(f"<{len(ids)}I", *ids))


# --- Parquet ------------------------------------------------------------------------------------------------------


def write_parquet(structure: Nodeset | Network, path: str) -> None:
    """A folder: meta.json, nodes, and for networks edges and members partitioned by layer."""
    spark = structure.spark
    if isinstance(structure, Nodeset):
        structure.df.write.mode("overwrite").parquet(f"{path}/nodes")
        meta = {"kind": "nodeset", "name": structure.name, "attributes": structure.attributes}
    else:
        layers = []
        for k, layer in enumerate(structure.layers.values()):
            entry = {"name": layer.name, "mode": layer.mode, "folder": f"layer_{k}"}
            if layer.mode == 1:
                entry |= {"directed": layer.directed, "valued": layer.valued, "selfties": layer.selfties}
                layer.df.write.mode("overwrite").parquet(f"{path}/layer_{k}")
            else:
                layer.df.write.mode("overwrite").parquet(f"{path}/layer_{k}")
                layer.names.df.write.mode("overwrite").parquet(f"{path}/layer_{k}_names")
            layers.append(entry)
        meta = {"kind": "network", "name": structure.name, "nodeset": structure.nodeset.path, "layers": layers}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def _meta(spark: SparkSession, path: str) -> dict:
    _need_file(path)
    return json.loads(spark.read.text(f"{path}/meta").first()[0])


# --- dispatch -----------------------------------------------------------------------------------------------------


def read_nodeset(spark: SparkSession, path: str) -> Nodeset:
    form = format_of(path)
    if form == "parquet":
        meta = _meta(spark, path)
        return Nodeset(spark, meta["name"], spark.read.parquet(f"{path}/nodes"), meta["attributes"], path)
    return (read_nodeset_text if form.startswith("tsv") else read_nodeset_binary)(spark, path)


def read_network(spark: SparkSession, path: str, settings: Settings, resolve=lambda p: p) -> tuple[Network, Nodeset]:
    form = format_of(path)
    if form != "parquet":
        return (read_network_text if form.startswith("tsv") else read_network_binary)(spark, path, settings, resolve)
    meta = _meta(spark, path)
    nodes = read_nodeset(spark, resolve(meta["nodeset"]))
    network = Network(spark, meta["name"], nodes, settings, path)
    for entry in meta["layers"]:
        df = spark.read.parquet(f"{path}/{entry['folder']}")
        if entry["mode"] == 1:
            network.add_one_mode(entry["name"], entry["directed"], entry["valued"], entry["selfties"], df)
        else:
            network.add_two_mode(entry["name"], df, spark.read.parquet(f"{path}/{entry['folder']}_names"))
    network.modified = False
    return network, nodes


def write_nodeset(nodes: Nodeset, path: str) -> None:
    form = format_of(path)
    (write_parquet if form == "parquet" else write_nodeset_text if form.startswith("tsv") else write_nodeset_binary)(nodes, path)
    nodes.path, nodes.modified = path, False


def write_network(network: Network, path: str) -> None:
    """The nodeset must have a file; a modified one is saved again, in its own format."""
    form = format_of(path)
    if not network.nodeset.path:
        raise Failure("ConstraintUnsavedNodeset", "Save the nodeset before the network.")
    if network.nodeset.modified:
        write_nodeset(network.nodeset, network.nodeset.path)
    (write_parquet if form == "parquet" else write_network_text if form.startswith("tsv") else write_network_binary)(network, path)
    network.path, network.modified = path, False
