"""Benchmark decontamination by a prefix-filtered set join, in DataFrame
operations only.

1. Every item is cut into windows of ``window`` words (a shorter item is one
   window); equal windows are one. A window is the set of its ``k``-word
   shingles.
2. One pass over the documents hashes their rolling k-word shingles and keeps
   the positions whose shingle belongs to any window (two bits of a bitmap of
   bounded size tell in the scanning task), with the words around them.
3. Shingles are ordered by rarity: by the number of places they have in all
   documents. A window must be contained whole, so its necessary prefix is one
   token, its rarest shingle: wherever the window stands, that shingle stands. A
   window with a shingle that stands nowhere is dropped.
4. Places are joined to the windows on the prefix alone. A place fixes where the
   window would begin; the length bound (the document has as many words) and the
   positional bound (the window lies inside it) come first, then the words
   themselves are compared.

Texts never cross a shuffle. A passage that stands in many documents, and the
places of one shingle, are rows of a join that AQE can split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage
from .license_scan import WORDS, lowered


@dataclass(frozen=True)
class WindowParams:
    """``window`` words make a window, ``k`` a shingle. ``map_bits``: the
    bitmap has 2^map_bits bits at most, whatever the benchmark; a fuller one lets
    more places through to the exact join, and nothing else."""

    window: int = 10
    k: int = 5
    map_bits: int = 21


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORDS), F.lit(1))


def _rolling(rows: DataFrame, hashes: str, size: str, sizes: list[int]) -> DataFrame:
    """``rows`` with a column ``g<k>`` for each k of ``sizes``: the hash of every run
    of k word hashes, null where fewer words are left. Runs double step by step, each
    a column of its own, as an expression used twice would be evaluated twice."""
    def glued(a: str, step: int) -> Column:
        ahead = F.slice(a, step + 1, F.greatest(F.col(size), F.lit(1)))
        return F.zip_with(a, ahead, lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.xxhash64(x, y)))

    have, names = 1, {1: hashes}
    while 2 * have <= max(sizes, default=1):
        rows = rows.withColumn(f"r{2 * have}", glued(names[have], have))
        have *= 2
        names[have] = f"r{have}"
    for k in sizes:
        base = max(x for x in names if x <= k)
        rows = rows.withColumn(f"g{k}", F.col(names[k]) if base == k else glued(names[base], k - base))
    return rows


def _hashes(words: Column) -> Column:
    # ``lower`` is coarser than lowering A-Z: it finds every equal word, and words are compared in the end
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def item_windows(items: DataFrame, id_col: str, text: str, p: WindowParams) -> DataFrame:
    """(wid, words, len, items): the distinct windows of all items and the ids,
    as strings, of the items that hold each. To be staged, as numbers are given by row."""
    cut = items.select(F.col(f"`{id_col}`").cast("string").alias("item"), words_of(F.col(f"`{text}`")).alias("w"))
    cut = cut.filter("item IS NOT NULL AND size(w) > 0").withColumn("w", F.transform("w", lowered))
    start = F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - p.window, F.lit(0))))
    each = cut.select("item", "w", start.alias("s")).select("item", F.slice("w", F.col("s") + 1, p.window).alias("words"))
    return (each.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))
            .select(F.monotonically_increasing_id().alias("wid"), "words", F.size("words").alias("len"), "items"))


def window_shingles(windows: DataFrame, p: WindowParams) -> DataFrame:
    """(wid, len, k, gram, offset): the shingles of each window and their first
    place in it; a window of fewer than k words is one shingle of its own length."""
    sizes = list(range(1, p.k + 1))
    rows = _rolling(windows.select("wid", "len", _hashes(F.col("words")).alias("h")), "h", "len", sizes)
    out = None
    for k in sizes:
        some = rows.filter(F.col("len") >= k) if k == p.k else rows.filter(F.col("len") == k)
        grams = some.select("wid", "len", F.lit(k).alias("k"), F.posexplode(f"g{k}").alias("offset", "gram"))
        grams = grams.filter("gram IS NOT NULL").groupBy("wid", "len", "k", "gram").agg(F.min("offset").alias("offset"))
        out = grams if out is None else out.unionByName(grams)
    return out


def _bitmap(grams: DataFrame, p: WindowParams) -> tuple[Column, int]:
    """Bits of all shingle hashes as an array literal of 2^map_bits / 64 numbers
    at most, and its size in bits."""
    n = grams.select("gram").distinct().count()
    bits = min(p.map_bits, max(12, (32 * max(n, 1)).bit_length()))
    both = grams.select(F.explode(F.array(*_bits(F.col("gram"), bits))).alias("bit"))
    words = (both.groupBy(F.shiftright("bit", 6).alias("at"))
             .agg(F.expr("bit_or(shiftleft(1L, CAST(bit & 63 AS INT)))").alias("v")).collect())  # bounded by the bitmap
    held = ["0"] * (1 << (bits - 6))
    for r in words:
        held[r["at"]] = str(r["v"])
    return F.split(F.lit(",".join(held)), ",").cast("array<bigint>"), bits  # folded to one literal


def _bits(gram: Column, bits: int) -> tuple[Column, Column]:
    mask = F.lit((1 << bits) - 1)
    return gram.bitwiseAND(mask).cast("int"), F.shiftrightunsigned(gram, 64 - bits).cast("int")


def _known(gram: Column, held: Column, bits: int) -> Column:
    out = None
    for bit in _bits(gram, bits):
        one = F.getbit(F.get(held, F.shiftright(bit, 6)), bit.bitwiseAND(F.lit(63))) == 1
        out = one if out is None else out & one
    return out


def shingle_places(docs: DataFrame, id_col: str, text: str, grams: DataFrame, p: WindowParams) -> DataFrame:
    """(row, id, n_words, k, pos, gram, from, near): the places of documents whose
    shingle may belong to a window, with the words from ``from`` on that any
    window through the place can hold; a row of nulls for a document without."""
    held, bits = _bitmap(grams, p)
    sizes = sorted(r.k for r in grams.select("k").distinct().collect())  # at most p.k numbers
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"),
                       words_of(F.col(f"`{text}`")).alias("words"))
    rows = rows.withColumn("n_words", F.size("words").cast("int")).withColumn("h", _hashes(F.col("words")))
    rows = _rolling(rows, "h", "n_words", sizes)

    def hits(k: int) -> Column:
        place = F.transform(f"g{k}", lambda g, i: F.when(
            _known(g, held, bits), F.struct(F.lit(k).alias("k"), i.alias("pos"), g.alias("gram"))))
        return F.filter(place, lambda s: s.isNotNull())

    lists = [hits(k) for k in sizes] or [F.expr("CAST(array() AS array<struct<k:int,pos:int,gram:bigint>>)")]
    found = rows.select("row", "id", "n_words", "words", (F.concat(*lists) if len(lists) > 1 else lists[0]).alias("hits"))
    each = found.select("row", "id", F.col("n_words").cast("long").alias("n_words"), "words", F.explode_outer("hits").alias("s"))
    first = F.greatest(F.col("s.pos") + F.col("s.k") - p.window, F.lit(0))
    return each.select("row", "id", "n_words", "s.k", "s.pos", "s.gram", first.alias("from"),
                       F.when(F.col("s.pos").isNotNull(), F.slice("words", first + 1, 2 * p.window)).alias("near"))


def contaminated_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text",
                           item_id: str = "item_id", item_text: str = "text",
                           params: WindowParams = WindowParams()) -> DataFrame:
    """(id, n_words, n_hit, items, spans) for every row of ``docs``.

    ``n_hit`` counts the words inside any occurrence of a window, ``items`` are the
    ids (sorted strings) of the items whose windows occur, ``spans`` the runs of
    hit words (first word, word after the last). Words are runs of letters, digits
    and characters outside ASCII, A-Z lowered. Null texts and texts without a word
    have no words and no hits; items without a word or an id have no window;
    repeated items and repeated rows count each; a null document id stays null;
    empty tables give no rows, or no hits. Other columns are ignored.
    """
    p = params
    windows = stage(item_windows(items, item_id, item_text, p), "windows")
    grams = stage(window_shingles(windows, p), "shingles")
    places = stage(shingle_places(docs, id_col, text, grams, p), "places")
    found = places.filter("gram IS NOT NULL")

    # rarity of every shingle over all documents, counted before it is joined to the windows
    rarity = found.groupBy("k", "gram").agg(F.count(F.lit(1)).alias("places"))
    ranked = grams.join(rarity, ["k", "gram"], "left")
    prefix = (ranked.groupBy("wid").agg(F.min(F.struct(F.coalesce("places", F.lit(0)).alias("places"), "gram", "k", "offset", "len"))
                                        .alias("r")).select("wid", "r.*").filter("places > 0").drop("places"))
    asked = stage(prefix.join(windows.select("wid", "words"), "wid"), "prefixes")

    # length and positional bounds, then the words
    start = (F.col("pos") - F.col("offset")).alias("start")
    met = found.join(asked, ["k", "gram"]).select("row", "n_words", "wid", "len", "from", "near", "words", start)
    met = met.filter("n_words >= len AND start >= 0 AND start + len <= n_words")
    same = F.transform(F.slice("near", F.col("start") - F.col("from") + 1, F.col("len")), lowered) == F.col("words")
    hits = stage(met.filter(same).select("row", "wid", "start", (F.col("start") + F.col("len")).alias("stop")), "hits")

    # words of a document inside any window: runs of overlapping or touching occurrences
    along = W.partitionBy("row").orderBy("start", "stop")
    before = F.max("stop").over(along.rowsBetween(W.unboundedPreceding, -1))
    runs = (hits.select("row", "start", "stop").distinct().withColumn("new", F.coalesce(F.col("start") > before, F.lit(True)))
            .withColumn("run", F.sum(F.col("new").cast("int")).over(along.rowsBetween(W.unboundedPreceding, 0)))
            .groupBy("row", "run").agg(F.min("start").alias("first"), F.max("stop").alias("stop")))
    spans = (runs.groupBy("row").agg(F.sum(F.col("stop") - F.col("first")).alias("n_hit"),
                                     F.array_sort(F.collect_list(F.struct("first", "stop"))).alias("spans")))
    # windows of the same items are one key, so that a long list of items is written once a document
    owners = windows.select("wid", F.xxhash64(F.concat_ws(",", "items")).alias("owner"), "items")
    lists = owners.groupBy("owner").agg(F.min("items").alias("items"))
    of = hits.select("row", "wid").distinct().join(owners.select("wid", "owner"), "wid").select("row", "owner").distinct()
    held = (of.join(lists, "owner").groupBy("row")
            .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")))

    one = places.filter("pos IS NULL").select("row", "id", "n_words").unionByName(
        found.groupBy("row").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words")))
    out = one.join(spans, "row", "left").join(held, "row", "left")
    return out.select(F.col("id").alias(id_col), "n_words",
                      F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                      F.coalesce("items", F.expr("CAST(array() AS array<string>)")).alias("items"),
                      F.coalesce("spans", F.expr("CAST(array() AS array<struct<first:int,stop:int>>)")).alias("spans"))
