"""Texts put into containers of fixed capacity, measured in tokens of a public tokenizer.

Hierarchical residual packing: each task packs the texts it reads, largest first, each into the container with the least
room that still holds it; nearly full containers are given out; the others go, as items, to fewer tasks that
pack them again, and so on in a tree.  A text longer than the capacity is cut into full containers and a rest.

Only containers with room to spare are ever shuffled, and each round has as many tasks as they need.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions.tables import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the byte-level vocabulary divides text before merging (fixed value, part of that vocabulary).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Containers filled to this part of their capacity are not packed again.
NEARLY_FULL = 0.985
#: Underfull containers a task packs in one round.
ITEMS_PER_TASK = 40_000

PIECE = pa.struct([("doc_id", pa.int64()), ("part", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int32())])
BINS = pa.schema([("pack_name", pa.string()), ("capacity", pa.int32()), ("used", pa.int32()), ("pieces", pa.list_(PIECE))])
BINS_SQL = "pack_name string, capacity int, used int, pieces array<struct<doc_id:bigint,part:int,start:bigint,n_tokens:int>>"


def counter(path: str = TOKENIZER):
    """Text to number of tokens.  path: as on the driver, or that of the copy that Spark has brought to the executor."""
    import tiktoken

    with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices of the sizes in each container: largest first, into the least room that holds it.  All must fit."""
    order = sorted(range(len(sizes)), key=lambda k: (-sizes[k], k))
    bins: list[list[int]] = []
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r is set if a container has exactly r left
    for k in order:
        size = sizes[k]
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
            bins[b].append(k)
        else:
            room, b = capacity, len(bins)
            bins.append([k])
        left = room - size
        rooms[left].append(b)
        mask |= 1 << left
    return bins


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    pieces = [[dict(zip(("doc_id", "part", "start", "n_tokens"), p)) for p in x] for x in columns[3]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((*columns[:3], pieces), BINS)], schema=BINS)


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(rows), 20_000):
        yield _batch(rows[k : k + 20_000])


def _measure_and_pack(capacities: list[tuple[str, int]], path: str):
    """(doc_id, text) to containers of each capacity, from each task's own texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        ids, sizes = [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            sizes += [count(t) for t in b.column(1).to_pylist()]
        order = np.argsort(np.array(ids, np.int64), kind="stable")
        for name, capacity in capacities:
            pieces, full = [], []
            for k in order.tolist():
                whole, rest = divmod(sizes[k], capacity)
                full += [(name, capacity, capacity, [(ids[k], p, p * capacity, capacity)]) for p in range(whole)]
                if rest:
                    pieces.append((ids[k], whole, whole * capacity, rest))
            yield from _batches(full)
            packed = best_fit([p[3] for p in pieces], capacity)
            yield from _batches([(name, capacity, sum(pieces[k][3] for k in b), [pieces[k] for k in b]) for b in packed])

    return run


def _pack_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers as items; those of one capacity come together, in a fixed order."""
    held: dict[tuple[str, int], list] = {}
    for b in batches:
        for r in b.to_pylist():
            held.setdefault((r["pack_name"], r["capacity"]), []).append((r["used"], [tuple(p.values()) for p in r["pieces"]]))
    for (name, capacity), items in sorted(held.items()):
        items.sort(key=lambda x: (-x[0], x[1][0]))
        packed = best_fit([x[0] for x in items], capacity)
        yield from _batches([(name, capacity, sum(items[k][0] for k in b), [p for k in b for p in items[k][1]]) for b in packed])


def pack_texts(
    documents: DataFrame, capacities: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER,
    nearly_full: float = NEARLY_FULL, items_per_task: int = ITEMS_PER_TASK,
) -> DataFrame:
    """Contents of containers: pack_name, container, capacity, used, doc_id, part, start, n_tokens.

    Every non-empty text is in every packing once, in one piece if it fits the capacity, otherwise in parts numbered from 0
    that follow one another in tokens, all but the last of them full.  container names its first piece (doc_id:part) and is
    unique in its packing.  Null and empty texts and rows with a null id are left out; rows with the same id are packed
    as texts of their own (keep ids unique to tell containers apart); capacities must be at least 1, null ones are
    left out; of one pack_name the smallest capacity counts; empty tables give no rows; further columns are ignored.
    `capacities` is a short list: it is read to the driver, and each entry repeats the packing.
    """
    if os.path.exists(tokenizer):  # executors need not have the file
        documents.sparkSession.sparkContext.addFile(tokenizer)
    sizes = capacities.select("pack_name", F.col("capacity_tokens").alias("c")).dropna().where("c > 0").groupBy("pack_name").agg(F.min("c").alias("c"))
    wanted = sorted((r["pack_name"], r["c"]) for r in sizes.collect())
    items_per_task = max(items_per_task, 4 * len(wanted))  # so that rounds of half empty containers shrink
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text <> ''")
    bins = cut(docs.mapInArrow(_measure_and_pack(wanted, tokenizer), BINS_SQL))
    is_full = F.col("used") >= F.ceil(F.col("capacity") * nearly_full)
    done, left = [bins.where(is_full)], bins.where(~is_full)
    before, n = None, left.count()
    while n:
        tasks = max(1, -(-n // items_per_task))
        shuffled = left.repartition(tasks, F.xxhash64(F.lit(len(done)), F.col("pieces")[0]))
        packed = cut(shuffled.mapInArrow(_pack_again, BINS_SQL))
        before, n = n, packed.where(~is_full).count()
        done.append(packed.where(is_full))
        left = packed.where(~is_full)
        if tasks == 1:  # one task has seen all there is
            break
        if n > 0.98 * before:
            # nothing much fits together any more; what can still save a container is half empty, at most one of a task and packing
            done.append(left.where("used * 2 > capacity"))
            left = left.where("used * 2 <= capacity")
            n = left.count()
    done.append(left)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    first = F.col("pieces")[0]
    name = F.concat_ws(":", first["doc_id"], first["part"]).alias("container")
    return out.select("pack_name", name, "capacity", "used", F.explode("pieces").alias("p")).select("pack_name", "container", "capacity", "used", "p.*")
