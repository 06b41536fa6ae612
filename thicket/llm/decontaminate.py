"""Benchmark decontamination: size-partitioned MinHash containment search finds short test items inside long
documents, and exact shingle containment verifies them.  DataFrame functions only.

Containment differs from Jaccard similarity: a long document that holds an item has a signature of its own that
says nothing of the item.  So the item's signature, its smallest shingle hashes, is looked up among all shingle
hashes of the document.  Items are partitioned by size; in a partition of at most u shingles, a document that
holds the share t of an item misses at most (1 - t) u of its shingles, so one more than that many smallest hashes
make a signature of which at least one value is found.  The search therefore loses no match.

Signatures are a saved table.  The documents' shingle hashes meet its values in one join, by broadcast where the values
are few and by shuffle of hashes and row names otherwise; only the documents that a value is found in are read again, for
the verification.  The plan has the same size whatever the number of items, and the driver sees none of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm.common import at_once, certainly_named, place_of, plain, saved, table

#: Signature values (16 bytes each) and items (their shingles) that are sent to all tasks; more are joined by shuffle.
VALUES_AT_ONCE, ITEMS_AT_ONCE = 1_000_000, 5_000
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_list(text: Column) -> Column:
    """Lower-cased words: maximal runs of ASCII letters, digits and all characters beyond ASCII."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _BREAK), "")


def _starts(words: Column, n: int) -> Column:
    return F.when(F.size(words) > 0, F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def hashes(words: Column, n: int) -> Column:
    """A 64-bit hash of each run of n words; fewer words make one run."""
    return F.transform(_starts(words, n), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(n))))


def shingles(words: Column, n: int) -> Column:
    """The distinct runs of n words as strings."""
    return F.array_distinct(F.transform(_starts(words, n), lambda i: F.concat_ws(" ", F.slice(words, i + 1, n))))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once; Catalyst would repeat it wherever an alias is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def size_limit(n: Column) -> Column:
    """Upper size of the partition of an item: powers of two from 16 on."""
    return F.greatest(F.lit(16), F.pow(F.lit(2), F.ceil(F.log2(n.cast("double"))))).cast("int")


def signatures(items: DataFrame, least: float, n: int) -> DataFrame:
    """A saved row for each distinct set of shingles: at, item_ids (of all items that have it), item_shingles, n_item and
    signature.  Items without words have none."""
    words = word_list(F.col("text"))
    sized = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.size(words) > 0)
    sets = sized.select("item_id", F.array_sort(shingles(words, n)).alias("item_shingles"), F.array_sort(F.array_distinct(hashes(words, n))).alias("sorted"))
    rows = sets.groupBy("item_shingles", "sorted").agg(F.collect_list(F.struct("item_id")).alias("item_ids")).withColumn("n_item", F.size("item_shingles"))
    missing = F.floor((1.0 - least) * size_limit(F.col("n_item")) + 1e-9).cast("int")
    signature = F.slice("sorted", F.lit(1), F.least(missing + 1, F.col("n_item")))
    return saved(rows.select(F.monotonically_increasing_id().alias("at"), "item_ids", "item_shingles", "n_item", signature.alias("signature")), "items")


def _candidates(rows: DataFrame, words: Column, sets: DataFrame, n: int) -> DataFrame:
    """file, row and at: the named rows in which a value of an item's signature is found, once for each item."""
    values = sets.select("at", F.explode("signature").alias("value"))
    few = values.limit(VALUES_AT_ONCE + 1).count() <= VALUES_AT_ONCE
    own = rows.select(F.col("file").alias("f"), F.col("row").alias("r"), F.explode(_let(words, lambda w: F.array_distinct(hashes(w, n)))).alias("own"))
    return own.join(F.broadcast(values) if few else values, F.col("own") == F.col("value")).select("f", "r", "at").distinct()


def _matches(rows: DataFrame, words: Column, sets: DataFrame, least: float, n: int) -> DataFrame:
    """The named rows with each item set that they hold: columns of rows, item_ids, n_shared and n_item."""
    found = saved(_candidates(rows, words, sets, n), "candidates")
    named = rows.join(at_once(found), (F.col("file") == F.col("f")) & (F.col("row") == F.col("r"))).withColumn("own", _let(words, lambda w: shingles(w, n))).drop("f", "r")
    items = sets.select(F.col("at").alias("of"), "item_ids", "item_shingles", F.col("n_item").cast("long").alias("n_item"))
    items = F.broadcast(items) if items.limit(ITEMS_AT_ONCE + 1).count() <= ITEMS_AT_ONCE else items
    scored = named.join(items, F.col("at") == F.col("of")).withColumn("n_shared", F.size(F.array_intersect("own", "item_shingles")).cast("long"))
    return scored.where(F.col("n_shared") >= F.ceil(F.col("n_item") * least - 1e-9))


def contaminated(docs: DataFrame, items: DataFrame, least: float = 0.8, n: int = 5, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, item_id, n_shared, n_item and containment of every document row and item of which the document
    holds at least the share `least` of the distinct n-word shingles.

    An item of fewer than n words counts as one shingle, and so does a document: such an item is found in documents of just
    those words.  Null and empty texts on either side match nothing; a repeated row is matched on its own, a repeated item
    too, under its item_id.  Empty tables give no rows.  Columns of docs other than keep and the text are not read.  The
    documents' texts are read twice, and not shuffled unless more than 500,000 pairs of a document and an item are to
    be verified or there are more than 5,000 different items; then those documents are, that a value was found in.  A
    table that isn't a selection of rows of Parquet files is saved first.
    """
    kept = docs.select(*keep, text)
    rows = certainly_named(plain(kept))
    found = _matches(rows, word_list(F.col(f"c{len(keep)}").cast("string")), signatures(items, least, n), least, n)
    each = found.select(*(f"c{k}" for k in range(len(keep))), F.explode("item_ids").alias("i"), "n_shared", "n_item")
    out = each.select(*(f"c{k}" for k in range(len(keep))), "i.item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))
    return out.toDF(*kept.columns[:-1], "item_id", "n_shared", "n_item", "containment")


def decontaminated(docs: DataFrame, items: DataFrame, least: float = 0.8, n: int = 5, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that hold no item.

    A document holds an item if it has at least the share `least` of the item's distinct n-word shingles.  Rows with
    null or empty texts stay, items without words match nothing, repeated rows go or stay together, and texts are read
    whole.  Without items all rows stay; an empty table gives no rows.  Columns may have any names.  What isn't a
    selection of rows of Parquet files is saved first; whole rows move only if more than 500,000 go.
    """
    rows = certainly_named(plain(docs))
    words = word_list(F.col(place_of(docs, text)).cast("string"))
    found = _matches(rows.select(place_of(docs, text), "file", "row"), words, signatures(items, least, n), least, n)
    gone = at_once(saved(found.select(F.col("file").alias("f"), F.col("row").alias("r")).distinct(), "gone"))
    return rows.join(gone, (F.col("file") == F.col("f")) & (F.col("row") == F.col("r")), "left_anti").select(*(f"c{k}" for k in range(len(docs.columns)))).toDF(*docs.columns)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM dw WHERE len(w) > 0),
its AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM iw WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_item FROM its GROUP BY item_id),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN its USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
FROM shared JOIN n USING (item_id) WHERE n_shared >= ceil(n_item * 0.8 - 1e-9)
"""
