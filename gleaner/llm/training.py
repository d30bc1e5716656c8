"""The bounded, labelled sample that a classifier is fitted on, words of many texts at once, and scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import dropped, landed, pieces_of

#: Labelled documents that a classifier is fitted on at most, those with the least hash of doc_id: this bounds
#: the driver's work and memory; scoring covers all documents.
SAMPLE_ROWS = 8_000
#: Ids of features of the sample that reach the driver at most (four bytes each): rows beyond, in the order of that hash, are left out too.
SAMPLE_IDS = 16_000_000

#: Features of many texts: where each text's ids begin (and the last's end), and the ids, ascending in each text.
Features = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of doc_id as text, modulo parts; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % parts


def words_of(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Lists of words, one per text -> each word's text, its place among the different words, and these; empty words are left out."""
    doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    coded = lists.values.dictionary_encode()
    place, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    if "" in names:
        keep = place != names.index("")
        doc, place = doc[keep], place[keep]
    return doc, place, names


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values, ascending; x is sorted in place."""
    x.sort()
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def grouped(key: np.ndarray, texts: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending keys (text << bits | id) -> where each text's ids begin (and the last's end), and the ids."""
    return np.searchsorted(key, np.arange(texts + 1) << bits), key & (1 << bits) - 1


def labelled(docs: DataFrame, labels: DataFrame, column: str, use: Column, features: Features, rows: int = SAMPLE_ROWS):
    """Features (arrays of 32-bit ids) and labels of the sample: rows of labels of the input's documents where ``use`` (of doc_id) holds.

    A document with several labels counts with the greatest; null labels and ids are left out.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).dropna().filter(use)
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    marked = marked.groupBy("doc_id").agg(F.max("y").alias("y")).join(held, "doc_id", "left_semi")
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches, "text"):
            upto, ids = features(pc.fill_null(b.column("text"), ""))
            ids = ids.astype("<u4")
            found = pa.array([ids[a:z].tobytes() for a, z in zip(upto, upto[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), found], names=["doc_id", "y", "ids"])

    found = texts.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, ids binary").withColumn("row", F.monotonically_increasing_id())
    held = landed(found, "sample")
    # Which rows fit is told from their sizes alone: the ids of rows that don't are never brought together.
    sizes = held.select("row", "doc_id", F.octet_length("ids").alias("size"), F.xxhash64("ids").alias("mark"))
    upto = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id", "mark", "row"))  # over SAMPLE_ROWS documents
    fits = sizes.select("row", upto.alias("upto")).filter(F.col("upto") <= 4 * SAMPLE_IDS).select("row")
    got = held.join(F.broadcast(fits), "row", "left_semi").select("doc_id", "y", "ids").toArrow()
    dropped(held)
    order = pc.sort_indices(got, [("doc_id", "ascending")]).to_numpy()
    y = got.column("y").to_numpy().astype(np.int64)[order]
    ids = [np.frombuffer(x.as_buffer(), "<u4") for x in got.column("ids")]  # in place: the sample is held once
    return [ids[i] for i in order.tolist()], y


def scored(docs: DataFrame, score: Callable[[pa.Array], np.ndarray], threshold: float) -> DataFrame:
    """All columns of docs, score (double) and predicted (int: score >= threshold) of each row's text."""
    kept = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]
    names = [f.name for f in kept]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches, "text"):
            s = np.asarray(score(pc.fill_null(b.column("text"), "")), dtype=np.float64)
            own = [pa.array(s), pa.array((s >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *own], names=[*names, "score", "predicted"])

    return docs.select(names).mapInArrow(run, schema)
