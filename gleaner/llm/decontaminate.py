"""Benchmark decontamination by winnowing, in DataFrame functions alone.

A span of SPAN consecutive words that a document shares with a benchmark item is found through its
fingerprint: of the k-grams (K words) of every window of SPAN words, the one with the least hash is
kept, so both sides keep the same k-gram of a shared span, and no span of SPAN words can be missed.
The kept k-grams of the documents meet those of the benchmark's windows in one join on the hash;
each hit is then extended to its whole window by comparing the words around it.

Per document the benchmark's windows, not pairs of documents, are joined, so a passage that many
documents hold costs one row per occurrence. The texts are read once for windows of all lengths. A benchmark of more than
BROADCAST_WINDOWS windows, or BROADCAST_BYTES, is joined by a shuffle: of keys alone at first, which names the documents that hold any of them, and
of words for these documents only.

Defined cases: a null or empty text has no words and no hits; very long texts are read whole; an item without words is ignored; an item of
fewer than SPAN words is one window of its whole length; an item with a null id hits words but isn't
listed; repeated rows come out as often as they came in; of k-grams that tie for the least hash all are kept; an empty benchmark
leaves all documents clean, an empty table gives no rows; further columns of either input are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import checkpointed

SPAN = 10
K = 5
#: Windows of the benchmark that may be broadcast, and bytes of them with their items' ids, of which a window may have many. Beyond either, the join shuffles.
BROADCAST_WINDOWS = 100_000
BROADCAST_BYTES = 64_000_000
#: Documents with a benchmark's key whose names may be broadcast, 16 bytes each.
BROADCAST_DOCS = 1_000_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of ASCII digits, ASCII letters (lower-cased) and all characters beyond ASCII."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.array_remove(F.split(lowered, _GAP), "")


def _from(array: str | Column, length: Column) -> Column:
    """The first ``length`` elements, none if it's negative."""
    return F.slice(array, F.lit(1), F.greatest(length, F.lit(0)))


def _kgrams(hashes: str, k: int) -> Column:
    """Hash of each run of k words, from the hashes of words."""
    return F.transform(
        _from(F.col(hashes), F.size(hashes) - (k - 1)),
        lambda x, i: F.xxhash64(x, *(F.get(F.col(hashes), i + j) for j in range(1, k))),
    )


def _runs(hashes: str, length: int) -> Column:
    """Hash of each run of ``length`` words, chained as that of a short item's window is."""

    def chained(x: Column, i: Column) -> Column:
        return reduce(lambda a, j: F.xxhash64(a, F.get(F.col(hashes), i + j)), range(length), F.lit(0).cast("long"))

    return F.transform(_from(F.col(hashes), F.size(hashes) - (length - 1)), chained)


def benchmark_windows(items: DataFrame) -> DataFrame:
    """One row per distinct window of the items: its length, key hash, the key's place in it, words, ids of items."""
    words = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words"))
    n = F.size("words")
    windows = (
        words.filter(n > 0)
        .select("item_id", "words", F.explode(F.sequence(F.lit(0), F.greatest(n - SPAN, F.lit(0)))).alias("start"))
        .select("item_id", F.slice("words", F.col("start") + 1, F.least(F.size("words"), F.lit(SPAN))).alias("window"))
        .groupBy("window")
        .agg(F.array_sort(F.collect_set("item_id")).alias("items"))
        .select("window", "items", F.transform("window", lambda w: F.xxhash64(w)).alias("hashes"))
        .select("window", "items", "hashes", F.size("window").alias("len"), _kgrams("hashes", K).alias("kgrams"))
    )
    whole = F.aggregate("hashes", F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x))
    full = F.col("len") == SPAN
    return windows.select(
        "len",
        "window",
        "items",
        F.when(full, F.array_min("kgrams")).otherwise(whole).alias("key"),
        F.when(full, F.array_position("kgrams", F.array_min("kgrams")) - 1).otherwise(0).cast("int").alias("at"),
    )


def _row_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def _named(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", _row_key(F.col("text")).alias("row_key"), words_of(F.col("text")).alias("words")).withColumn("n_words", F.size("words"))


def _keys(named: DataFrame, lengths: list[int]) -> DataFrame:
    """A row per document (key null) and per key, a kept k-gram or a run as long as a short item: where it stands, and the document's words."""
    short = [x for x in lengths if x < SPAN]
    hashed = named.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    width = SPAN - K + 1
    least = F.transform(
        _from(F.col("kgrams"), F.size("kgrams") - (width - 1)),
        lambda x, i: F.least(x, *(F.get(F.col("kgrams"), i + j) for j in range(1, width))),
    )
    # A k-gram is kept if it is the least of any window over it: of equal ones, all are.
    kept = F.col("key") == F.greatest(*(F.get(F.col("least"), F.col("at") - j) for j in range(width)))
    out = hashed.select("*", _kgrams("hashes", K).alias("kgrams")).select("*", least.alias("least"))
    own = F.lit(None).cast("long")
    if not short:
        out = out.select("*", F.posexplode(F.concat("kgrams", F.array(own))).alias("at", "key")).withColumn("len", F.lit(SPAN))
    else:
        entry = lambda length, at, key: F.struct(F.lit(length).alias("len"), at.alias("at"), key.alias("key"))
        entries = lambda length, hashes: F.transform(hashes, lambda x, i: entry(length, i, x))
        every = F.concat(entries(SPAN, "kgrams"), *(entries(n, _runs("hashes", n)) for n in short), F.array(entry(SPAN, F.lit(0), own)))
        out = out.select("*", F.explode(every).alias("entry")).select("*", "entry.*")
    return out.filter(F.col("key").isNull() | (F.col("len") < SPAN) | kept).select("doc_id", "row_key", "words", "n_words", "key", "at", "len")


def _around(keys: DataFrame) -> DataFrame:
    """keys with the words around each in place of all, and the first one's place."""
    width = SPAN - K + 1
    full = F.col("len") == SPAN
    first = F.when(full, F.greatest(F.col("at") - (width - 1), F.lit(0))).otherwise(F.col("at"))
    around = F.slice("words", first + 1, F.when(full, F.lit(SPAN + width - 1)).otherwise(F.col("len")))
    return keys.select("doc_id", "row_key", "n_words", "key", "at", "len", first.alias("first"), around.alias("around"))


def _found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per distinct row of docs (doc_id, row_key: a hash of its text): copies, n_words, n_hit, item_ids, spans."""
    windows = checkpointed(benchmark_windows(items.select("item_id", "text")))
    size = F.octet_length(F.array_join("window", " ")) + F.size("window") * 24 + F.size("items") * 24 + 64  # about what a row takes in memory
    shape = windows.groupBy("len").agg(F.count("*").alias("many"), F.sum(size).alias("bytes")).collect()  # SPAN rows at most
    lengths = sorted(x["len"] for x in shape)
    named = _named(docs.select("doc_id", "text"))
    if sum(x["many"] for x in shape) <= BROADCAST_WINDOWS and sum(x["bytes"] for x in shape) <= BROADCAST_BYTES:
        return _met(named, F.broadcast(windows), lengths)
    wanted = windows.select("len", "key").distinct()
    holding = checkpointed(_keys(named, lengths).select("doc_id", "row_key", "len", "key").join(wanted, ["len", "key"], "left_semi").select("doc_id", "row_key").distinct())
    if holding.count() <= BROADCAST_DOCS:
        holding = F.broadcast(holding)
    holding = holding.select(F.col("doc_id").alias("h_id"), F.col("row_key").alias("h_key"))
    held = named["doc_id"].eqNullSafe(holding["h_id"]) & (named["row_key"] == holding["h_key"])
    hit = _met(named.join(holding, held, "left_semi"), windows, lengths)
    n_words, none = F.col("n_words").cast("long").alias("n_words"), F.array()
    clean = named.join(holding, held, "left_anti").groupBy("doc_id", "row_key", "n_words").agg(F.count("*").alias("copies"))
    types = {f.name: f.dataType for f in hit.schema.fields}
    return hit.unionByName(
        clean.select(
            "doc_id", "row_key", "copies", n_words, F.lit(0).cast("long").alias("n_hit"), none.cast(types["item_ids"]).alias("item_ids"), none.cast(types["spans"]).alias("spans")
        )
    )


def _met(named: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """_found for documents as _named has them."""
    w = windows.select(*(F.col(x).alias(f"w_{x}") for x in windows.columns))
    # A document's own row gets a key of its own: rows with a null key would all go to one task of a shuffled join.
    keys = _around(_keys(named, lengths)).withColumns({"own": F.col("key").isNull(), "key": F.coalesce("key", F.xxhash64("doc_id", "row_key"))})
    start = F.col("at") - F.col("w_at")
    inside = (start >= F.col("first")) & (F.col("w_window") == F.slice("around", F.greatest(start - F.col("first"), F.lit(0)) + 1, F.col("w_len")))
    met = keys.join(w, (F.col("key") == F.col("w_key")) & (F.col("len") == F.col("w_len")) & ~F.col("own") & inside, "left")
    found = (
        met.filter(F.col("own") | F.col("w_key").isNotNull())
        .groupBy("doc_id", "row_key", "n_words")
        .agg(
            F.count(F.when(F.col("own"), True)).alias("copies"),
            F.array_sort(F.collect_set(F.when(~F.col("own"), F.struct(start.alias("start"), F.col("w_len").alias("len"))))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("w_items")))).alias("item_ids"),
        )
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(
            F.greatest(a["end"], x["start"] + x["len"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), x["start"] + x["len"] - F.greatest(a["end"], x["start"]))).alias("n"),
        ),
        lambda a: a["n"],
    )
    passages = F.array().cast("array<struct<start:int,length:int>>")
    passage = lambda a: F.array(F.struct(a["start"].alias("start"), (a["end"] - a["start"]).alias("length")))
    merged = F.aggregate(
        "spans",
        F.struct(passages.alias("done"), F.lit(-1).alias("start"), F.lit(-1).alias("end")),
        lambda a, x: F.struct(
            F.when((x["start"] > a["end"]) & (a["end"] >= 0), F.concat(a["done"], passage(a))).otherwise(a["done"]).alias("done"),
            F.when((x["start"] > a["end"]) | (a["end"] < 0), x["start"]).otherwise(a["start"]).alias("start"),
            F.greatest(a["end"], x["start"] + x["len"]).alias("end"),
        ),
        lambda a: F.when(a["end"] < 0, passages).otherwise(F.concat(a["done"], passage(a))),
    )
    n_words = F.col("n_words").cast("long").alias("n_words")
    return found.select("doc_id", "row_key", "copies", n_words, covered.alias("n_hit"), "item_ids", merged.alias("spans"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_hit, n_items, item_ids, contaminated, spans.

    items: item_id, text. A word of a document is hit if it lies in any occurrence of an item's window; spans are
    the runs of hit words, as (start, length) in words from 0.
    """
    found = _found(docs, items).select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    n_items, contaminated = F.size("item_ids").cast("long").alias("n_items"), (F.col("n_hit") > 0).alias("contaminated")
    return found.select("doc_id", "n_words", "n_hit", n_items, "item_ids", contaminated, "spans")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that hold no window of an item."""
    hit = _found(docs, items).filter("n_hit > 0").select(F.col("doc_id").alias("hit_id"), "row_key")
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["hit_id"]) & (_row_key(docs["text"]) == hit["row_key"]), "left_anti")


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The digest of decontaminate: item_ids as the SHA-256 of their comma-joined list."""
    found = decontaminate(docs, items)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[s + 1 : s + least(len(w), 10)], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, l, s, array_to_string(w[s + 1 : s + l], ' ') AS k
  FROM (SELECT doc_id, w, l, unnest(range(0, greatest(len(w) - l + 1, 0))) AS s FROM d, (SELECT DISTINCT l FROM bw))),
h AS (SELECT doc_id, s, l, item_id FROM dw JOIN bw USING (l, k)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM h) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""
