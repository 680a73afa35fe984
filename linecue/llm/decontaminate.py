"""Benchmark decontamination in native operations: SimHash of item-sized windows, verified by weighted shingles.

Words are runs of letters and digits, in lower case. Every document is cut into
windows of the sizes of SIZES that the benchmark needs, one from every
STRIDE-th word on, and each window gets a SimHash of its words (BITS digits).
An item is represented by STRIDE windows of the largest of these sizes that
leaves STRIDE - 1 words of it over, one from each of STRIDE words in its middle
on: wherever a document holds the item, one of its windows has the very words
of one of these. Digits are counted side by side in a few numbers, so that a
window is a sum of blocks of STRIDE words. Items of fewer than SHORT words meet
windows from every word on, two words shorter than the item, from its first and
its second word: no more than a word at an end of so short an item can differ; those of SHORT
words meet windows of a stride without its last word. No window reaches the item's last word, as a short word counts with the next
one, which behind the item is another (a single word counts alone).

Fingerprints meet in a multi-index of BLOCKS blocks: two of them that differ in
no more digits than radius(size) differ in a BLOCKS-th of these or fewer in one
block, so the benchmark's side, which is small, lists all such values of each of
its blocks. Pairs within the radius are candidates. Each is verified on the item's
own size: the document's windows that a shingle of WIDTH words shared with the
item places are compared by the weighted Jaccard similarity of shingle sets (a
shingle weighs 1000 over the number of different item texts that have it, 1 at
least, and 1000 if none does), or by the plain one where that is larger.

What the benchmark's side lists is broadcast only up to MAX_BROADCAST rows;
beyond that the same joins shuffle, positions and fingerprints only. Texts of
candidates are taken by a join with the candidates' keys, which are broadcast
under the same condition. A window with as many changed words as similarity
0.8 allows differs in 5 digits on average with a deviation of about 2, so a
few in a thousand such near copies can lie beyond the radius; exact copies
never do. README has the recall measured against all windows.

Cases: null and empty texts have no words; an item of fewer than WIDTH words is
one shingle; a window is cut at the document's ends; rows of equal doc_id count
as one document, a null doc_id as a document; repeated items are reported each
under its item_id, rows of equal item_id with different texts both under it;
null item_ids are kept; any number of items may share a text or a shingle;
empty tables give an empty table; further columns are not read, whatever their
names.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linecue.llm.common import checkpointed, document, table

WIDTH = 5
LEAST_PERCENT = 80
BITS, BLOCKS = 60, 6
STRIDE, SIZES = 8, (8, 16, 24, 32, 48, 64, 96)
#: Items of fewer words are looked for from every word on, as they may hold no whole window of a stride.
SHORT = 2 * STRIDE - 1
#: Added to the size in the key of such windows.
SHORT_MARK = 128
#: Shorter words count with the word after them, as on their own they make all texts alike.
SHORT_WORD = 4
MAX_BROADCAST = 2_000_000
WEIGHT = 1000
#: A 1 in each four digits and in each eight of a long, without the sign's; the lower four of each eight.
_NIBBLES, _ONES, _LOW = 0x0111111111111111, 0x0101010101010101, 0x0F0F0F0F0F0F0F0F


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(words: Column, width: int = WIDTH) -> Column:
    """Distinct shingle hashes of a word array; all words as one if there are fewer."""
    size = F.size(words)
    starts = F.sequence(F.lit(1), F.greatest(size - (width - 1), F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, width))))


def _at(words: Column, p: Column, width: int) -> Column:
    """Hash of `width` words from position p (from 0), the same as the shingle's."""
    return F.xxhash64(F.array(*(F.get(words, p + k) for k in range(width))))


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, words, m, shingles) of the items that have words; item numbers the rows' texts."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    return items.select(F.xxhash64("words").alias("item"), "item_id", "words", F.size("words").alias("m"), _shingles(F.col("words")).alias("shingles")).dropDuplicates(["item", "item_id"])


def window_size(m: int) -> int:
    """Words of the windows that an item of m words is looked for with: those in its middle stay clear of the words that may differ at its ends."""
    if m == SHORT:  # a window of each stride that stops before the last word
        return STRIDE - 1
    return max(1, m - 2) if m < SHORT else max(s for s in SIZES if s <= max(SIZES[0], m - STRIDE + 1 - 2 * (m - WIDTH + 1) // 9))


def radius(size: int) -> int:
    """Digits in which windows may differ: items that allow a changed word in their middle have windows of 32 words or more."""
    return 11 if 32 <= size < SHORT_MARK else 3


def features(words: Column, alone: bool | Column = False) -> Column:
    """A hash for each word; alone: whatever stands behind it."""
    return F.transform(words, lambda w, i: F.when(~F.lit(alone) & (F.length(w) < SHORT_WORD), F.xxhash64(w, F.get(words, i + 1))).otherwise(F.xxhash64(w)))


def fingerprints(texts: DataFrame, *keys: str) -> DataFrame:
    """(keys, fingerprint): SimHash of the features; texts: keys, features."""
    words = texts.select(*keys, F.explode("features").alias("h"))
    digit = lambda b: F.sum(F.when(F.shiftright("h", b).bitwiseAND(F.lit(1).cast("long")) == 1, 1).otherwise(-1)).alias(f"b{b}")
    counted = words.groupBy(*keys).agg(*(digit(b) for b in range(BITS)))
    bits = [F.when(F.col(f"b{b}") > 0, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")) for b in range(BITS)]
    return counted.select(*keys, reduce(lambda x, y: x.bitwiseOR(y), bits).alias("fingerprint"))


def _places(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _marks(counts: list[Column], add: int, half: int, place: int) -> Column:
    """The digits whose count, after adding add, has its digit `half`, which stands `place` digits above the count's lowest one."""
    over = [(c + add).bitwiseAND(F.lit(half)) for c in counts]
    return reduce(lambda x, y: x.bitwiseOR(y), [F.shiftrightunsigned(m, place - k) if k <= place else F.shiftleft(m, k - place) for k, m in enumerate(over)])


def block_counts(docs: DataFrame, lasts: bool = False) -> DataFrame:
    """docs (words, further columns) with s0 to s3 instead of words: an array each with a long for every STRIDE words; four digits of long k, from 4 j on, count digit 4 j + k. lasts: also last, the hash of each block's last word."""
    rows = docs.select(*[c for c in docs.columns if c != "words"], features(F.col("words")).alias("h"))

    def counts(k: int) -> Column:
        digits = lambda i, j: F.shiftrightunsigned(F.get("h", i * STRIDE + j), k).bitwiseAND(F.lit(_NIBBLES))
        return F.transform(_places(F.floor(F.size("h") / STRIDE).cast("int")), lambda i: reduce(lambda x, y: x + y, [digits(i, j) for j in range(STRIDE)]))

    last = F.transform(_places(F.floor(F.size("h") / STRIDE).cast("int")), lambda i: F.get("h", i * STRIDE + STRIDE - 1))
    return rows.select(*[c for c in rows.columns if c != "h"], *(counts(k).alias(f"s{k}") for k in range(4)), *([last.alias("last")] if lasts else []))


def stride_fingerprints(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """(doc, f{size} for each size): a row for every STRIDE words, null where no whole window begins; docs: doc, words.

    The blocks' counts are summed in generated code, so the sums of a row cost
    little, and no row carries more than its own numbers.
    """
    most, without_last = max(1, max(sizes) // STRIDE), STRIDE - 1 in sizes
    rows = block_counts(docs, without_last)
    # The outer form: a plain one lets the optimizer test for empty arrays before they are made, by making them twice.
    rows = rows.select("doc", "s0", "s1", "s2", "s3", *(["last"] if without_last else []), F.size("s0").alias("n"), F.explode_outer(_places(F.size("s0"))).alias("j"))
    block = lambda k, t: F.coalesce(F.get(f"s{k}", F.col("j") + t), F.lit(0).cast("long")).alias(f"b{k}_{t}")
    rows = rows.select("doc", (F.col("n") - F.col("j")).alias("left"), *(block(k, t) for t in range(most) for k in range(4)), *([F.get("last", F.col("j")).alias("last")] if without_last else []))
    low = lambda c: c.bitwiseAND(F.lit(_LOW))
    part = lambda t: [low(F.col(f"b{k}_{t}")) for k in range(4)] + [low(F.shiftrightunsigned(f"b{k}_{t}", 4)) for k in range(4)]
    first = _marks([F.col(f"b{k}_0") for k in range(4)], (7 - STRIDE // 2) * _NIBBLES, 8 * _NIBBLES, 3)
    names = [f"f{STRIDE}"]
    if without_last:  # the block's counts less those of its last word
        fewer = [F.col(f"b{k}_0") - F.shiftrightunsigned("last", k).bitwiseAND(F.lit(_NIBBLES)) for k in range(4)]
        rows = rows.select("*", _marks(fewer, (7 - (STRIDE - 1) // 2) * _NIBBLES, 8 * _NIBBLES, 3).alias(f"f{STRIDE - 1}"))
        names.append(f"f{STRIDE - 1}")
    # Longs 0 to 7 of a larger window count digit 8 j + k in their byte j.
    rows = rows.select("doc", "left", *(f"b{k}_{t}" for t in range(1, most) for k in range(4)), first.alias(f"f{STRIDE}"), *names[1:], *(c.alias(f"c{k}") for k, c in enumerate(part(0))))
    for t in range(1, most):
        size = (t + 1) * STRIDE
        rest = [f"b{k}_{u}" for u in range(t + 1, most) for k in range(4)]
        rows = rows.select("doc", "left", *names, *rest, *((F.col(f"c{k}") + c).alias(f"c{k}") for k, c in enumerate(part(t))))
        if size in sizes:
            mark = _marks([F.col(f"c{k}") for k in range(8)], (63 - size // 2) * _ONES, 0x40 * _ONES, 6)
            rows = rows.select("doc", "left", *names, *rest, *(f"c{k}" for k in range(8)), mark.alias(f"f{size}"))
            names.append(f"f{size}")
    return rows.select("doc", *(F.when(F.col("left") >= -(-s // STRIDE), F.col(f"f{s}")).alias(f"f{s}") for s in sizes))


def word_fingerprints(docs: DataFrame, size: int, alone: bool = False) -> DataFrame:
    """(doc, f{size}): a row for every word that a window of so few words begins with."""
    rows = docs.select("doc", features(F.col("words"), alone).alias("h"))
    rows = rows.select("doc", "h", F.explode_outer(_places(F.size("h") - (size - 1))).alias("p"))
    digits = lambda j, k: F.shiftrightunsigned(F.get("h", F.col("p") + j), k).bitwiseAND(F.lit(_ONES if k < 4 else _ONES >> 8))
    counts = [reduce(lambda x, y: x + y, [digits(j, k) for j in range(size)]) for k in range(8)]
    return rows.select("doc", _marks(counts, (63 - size // 2) * _ONES, 0x40 * _ONES, 6).alias(f"f{size}"))


def block_keys(size: Column, fingerprint: Column) -> list[Column]:
    """A number for each block: the window's size, the block's place and its digits."""
    wide = BITS // BLOCKS
    value = lambda b: F.shiftrightunsigned(fingerprint, b * wide).bitwiseAND(F.lit((1 << wide) - 1).cast("long"))
    return [(size.cast("long") * BLOCKS + b) * (1 << wide) + value(b) for b in range(BLOCKS)]


def probes(marked: DataFrame) -> DataFrame:
    """marked (fingerprint, size, item) as (key, f_item, item, most): every value that a block within the radius of `most` digits can have."""
    flips = lambda n: F.array(*(F.lit(sum(1 << b for b in some)).cast("long") for k in range(n + 1) for some in combinations(range(BITS // BLOCKS), k)))
    near, far = radius(SIZES[0]), radius(SIZES[-1])
    wide = F.col("size").between(32, SHORT_MARK - 1)
    rows = marked.select("item", F.col("fingerprint").alias("f_item"), F.when(wide, far).otherwise(near).alias("most"), F.explode(F.array(*block_keys(F.col("size"), F.col("fingerprint")))).alias("base"))
    # The block's digits are the lowest ones of a key.
    rows = rows.select("*", F.explode(F.when(F.col("most") == far, flips(far // BLOCKS)).otherwise(flips(near // BLOCKS))).alias("flip"))
    return rows.select(F.col("base").bitwiseXOR(F.col("flip")).alias("key"), "f_item", "item", "most")


def marks_of(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """(item, size, fingerprint): the windows that stand for each item; texts: item, m, words."""
    size_of = F.element_at(F.create_map(*(F.lit(x) for m in sizes for x in (m, window_size(m)))), F.col("m"))
    rows = texts.select("item", features(F.col("words"), F.col("m") == 1).alias("features"), "m", size_of.alias("size"))
    spare = F.col("m") - F.col("size")
    first = F.floor((spare - (STRIDE - 1)) / 2).cast("int")
    starts = F.when(F.col("m") < 3, F.array(F.lit(0))).when(F.col("m") < SHORT, F.array(F.lit(0), F.lit(1))).otherwise(F.sequence(F.greatest(first, F.lit(0)), F.least(F.greatest(first, F.lit(0)) + STRIDE - 1, spare)))
    rows = rows.select("item", F.when(F.col("m") < SHORT, SHORT_MARK + F.col("m")).otherwise(F.col("size")).alias("mark"), "size", "features", F.explode(starts).alias("from"))
    return fingerprints(rows.select("item", F.col("mark").alias("size"), "from", F.slice("features", F.col("from") + 1, F.col("size")).alias("features")), "item", "size", "from")


def candidates(docs: DataFrame, marked: DataFrame, lengths: list[int], small: bool) -> DataFrame:
    """(doc, item): documents with a window within the radius of one of the item's; docs: doc, words; lengths: of the items."""
    strides = sorted({window_size(m) for m in lengths if m >= SHORT})
    found = []
    if strides:
        rows = stride_fingerprints(docs, strides).select("doc", F.posexplode_outer(F.array(*(f"f{s}" for s in strides))).alias("place", "f_win"))
        size = reduce(lambda x, s: F.when(F.col("place") == strides.index(s), s).otherwise(x), strides[1:], F.lit(strides[0]))
        found.append(rows.select("doc", "f_win", size.alias("size")))
    short = {m: window_size(m) for m in sorted(set(lengths)) if m < SHORT}
    found += [word_fingerprints(docs, s, m == 1).select("doc", F.col(f"f{s}").alias("f_win"), F.lit(SHORT_MARK + m).alias("size")) for m, s in short.items()]
    met = reduce(DataFrame.union, (x.select("doc", "f_win", F.explode(F.array(*block_keys(F.col("size"), F.col("f_win")))).alias("key")) for x in found))
    index = probes(marked)
    met = met.join(F.broadcast(index) if small else index, "key")
    return met.where(F.bit_count(F.col("f_win").bitwiseXOR(F.col("f_item"))) <= F.col("most")).select("doc", "item").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = LEAST_PERCENT) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_windows): documents that hold an item, similarity in ten-thousandths."""
    found = matches(docs, benchmark, percent)
    return found.groupBy("doc.doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.min("start").cast("long").alias("first_word"), F.countDistinct("start").alias("n_windows"))


def leaking(docs: DataFrame, benchmark: DataFrame, percent: int = LEAST_PERCENT) -> DataFrame:
    """(doc) of the documents that hold an item: doc_id with a hash of the text, as common.document has it."""
    return matches(docs, benchmark, percent).select("doc").distinct()


def matches(docs: DataFrame, benchmark: DataFrame, percent: int = LEAST_PERCENT) -> DataFrame:
    """(doc, item_id, similarity, start): windows of documents that are similar to an item."""
    items = checkpointed(items_of(benchmark))
    texts = items.groupBy("item").agg(F.first("words").alias("words"), F.first("m").alias("m"), F.first("shingles").alias("shingles"))
    lengths = sorted(r.m for r in items.select("m").distinct().collect())  # sizes of items
    if not lengths:
        return docs.limit(0).select(document().alias("doc")).crossJoin(benchmark.limit(0).select("item_id")).selectExpr("doc", "item_id", "0L AS similarity", "0 AS start")
    marked = checkpointed(marks_of(texts, lengths))
    a_key = sum(1 for n in range(radius(SIZES[-1]) // BLOCKS + 1) for _ in combinations(range(BITS // BLOCKS), n))
    small = marked.count() * BLOCKS * a_key <= MAX_BROADCAST

    rows = docs.select(document().alias("doc"), words_of(F.col("text")).alias("words"))
    pairs = checkpointed(candidates(rows, marked, lengths, small).join(texts.select("item", "m"), "item"))
    few = pairs.count() <= MAX_BROADCAST // 10
    side = lambda df: F.broadcast(df) if few else df.hint("merge")
    held = rows.join(side(pairs.select("doc").distinct()), "doc", "left_semi")
    held = checkpointed(held.groupBy("doc").agg(F.first("words").alias("words")).select("doc", "words", F.size("words").alias("n")))

    # Where a shingle that the document shares with the item says that the item may begin.
    found = []
    for width in sorted({min(m, WIDTH) for m in lengths}):
        of_width = pairs.where(F.least("m", F.lit(WIDTH)) == width).join(texts.select("item", "words"), "item")
        asked = of_width.select("doc", "item", "m", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("m") - width + 1), lambda i: F.xxhash64(F.slice("words", i, width)))).alias("offset", "h"))
        at = held.select("doc", "n", "words", F.posexplode("words").alias("p", "w")).where(F.col("p") <= F.col("n") - width)
        at = at.select("doc", "n", "p", _at(F.col("words"), F.col("p"), width).alias("h"))
        start = F.greatest(F.least(F.col("p") - F.col("offset"), F.col("n") - F.col("m")), F.lit(0))
        found.append(at.join(asked, ["doc", "h"]).select("doc", "item", "m", start.alias("start")).distinct())
    starts = reduce(DataFrame.union, found)
    windows = held.join(starts, "doc").select("doc", "item", "m", "start", F.slice("words", F.col("start") + 1, F.col("m")).alias("words"))
    windows = checkpointed(windows.withColumn("win", F.unhex(F.md5(F.array_join("words", " ").cast("binary")))))

    weights = texts.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.expr(f"greatest(1, {WEIGHT} div count(*))").alias("w"))

    def weighed(df: DataFrame, key: str) -> DataFrame:
        each = df.select(key, F.explode("shingles").alias("s")).join(weights, "s", "left").select(key, "s", F.coalesce("w", F.lit(WEIGHT).cast("long")).alias("w"))
        # A shingle with its weight as one long: hashes meet by their upper 54 digits.
        marked = F.shiftleft(F.shiftrightunsigned("s", 10), 10).bitwiseOR(F.col("w"))
        return each.groupBy(key).agg(F.collect_list(marked).alias(f"{key}_shingles"), F.sum("w").alias(f"{key}_weight"), F.count("*").alias(f"{key}_n"))

    # Windows that many documents share are compared once.
    different = windows.groupBy("win").agg(F.first("words").alias("words")).select("win", _shingles(F.col("words")).alias("shingles"))
    compared = windows.select("win", "item").distinct().join(weighed(different, "win"), "win").join(weighed(texts, "item"), "item")
    compared = compared.withColumn("common", F.array_intersect("win_shingles", "item_shingles")).select(
        "win", "item",
        F.aggregate("common", F.lit(0).cast("long"), lambda acc, x: acc + x.bitwiseAND(F.lit(1023).cast("long"))).alias("both"), (F.col("win_weight") + F.col("item_weight")).alias("all"),
        F.size("common").cast("long").alias("both_n"), (F.col("win_n") + F.col("item_n")).alias("all_n"),
    )
    similar = compared.where((F.col("both") * 100 >= percent * (F.col("all") - F.col("both"))) | (F.col("both_n") * 100 >= percent * (F.col("all_n") - F.col("both_n"))))
    similar = similar.select("win", "item", F.expr("greatest(10000 * both div (all - both), 10000 * both_n div (all_n - both_n))").alias("similarity"))
    named = similar.join(items.select("item", "item_id"), "item").select("win", "item", "item_id", "similarity")
    return windows.select("doc", "start", "win", "item").join(named, ["win", "item"]).select("doc", "item_id", "similarity", "start")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, with the items."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def sql(documents: str = "documents", benchmark: str = "benchmark") -> str:
    """The same rows in DuckDB for items of WIDTH words or more: CTEs that end in one named leaks."""
    words = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
    shingle = lambda at, of: " || ' ' || ".join(f"{of}[{at} + {k}]" for k in range(WIDTH))
    return f"""
  leak_items AS (SELECT item_id, words, len(words) AS m FROM (SELECT item_id, {words} AS words FROM {benchmark}) WHERE len(words) >= {WIDTH}),
  leak_texts AS (SELECT DISTINCT words, m, array_to_string(words, ' ') AS item FROM leak_items),
  leak_item_at AS (SELECT item, m, k AS o, {shingle("k + 1", "words")} AS s FROM leak_texts, unnest(range(m - {WIDTH - 1})) AS ks(k)),
  leak_weights AS (SELECT s, greatest(1, {WEIGHT} // count(DISTINCT item)) AS w FROM leak_item_at GROUP BY s),
  leak_docs AS (SELECT doc_id, {words} AS words FROM {documents}),
  leak_doc_at AS (SELECT doc_id, words, k AS p, {shingle("k + 1", "words")} AS s FROM leak_docs, unnest(range(len(words) - {WIDTH - 1})) AS ks(k)),
  leak_windows AS (
    SELECT DISTINCT doc_id, item, m, start, words[start + 1 : start + m] AS win
    FROM (SELECT doc_id, item, words, m, greatest(least(p - o, len(words) - m), 0) AS start FROM leak_doc_at JOIN leak_item_at USING (s))),
  leak_wins AS (SELECT DISTINCT win, item FROM leak_windows),
  leak_win_shingles AS (SELECT DISTINCT win, {shingle("k + 1", "win")} AS s FROM (SELECT DISTINCT win FROM leak_wins), unnest(range(greatest(len(win) - {WIDTH - 1}, 0))) AS ks(k)),
  leak_win_weight AS (SELECT win, sum(coalesce(w, {WEIGHT})) AS total, count(*) AS n FROM leak_win_shingles LEFT JOIN leak_weights USING (s) GROUP BY ALL),
  leak_item_weight AS (SELECT item, sum(w) AS total, count(*) AS n FROM (SELECT DISTINCT item, s FROM leak_item_at) JOIN leak_weights USING (s) GROUP BY ALL),
  leak_both AS (
    SELECT win, item, sum(w) AS shared, count(*) AS n FROM leak_wins JOIN leak_win_shingles USING (win) JOIN (SELECT DISTINCT item, s FROM leak_item_at) USING (item, s) JOIN leak_weights USING (s) GROUP BY ALL),
  leak_similar AS (
    SELECT win, item, CAST(greatest(10000 * shared // (a.total + b.total - shared), 10000 * c.n // (a.n + b.n - c.n)) AS BIGINT) AS similarity
    FROM leak_both c JOIN leak_win_weight a USING (win) JOIN leak_item_weight b USING (item)
    WHERE shared * 100 >= {LEAST_PERCENT} * (a.total + b.total - shared) OR c.n * 100 >= {LEAST_PERCENT} * (a.n + b.n - c.n)),
  leaks AS (
    SELECT doc_id, item_id, max(similarity) AS similarity, CAST(min(start) AS BIGINT) AS first_word, count(DISTINCT start) AS n_windows
    FROM leak_windows JOIN leak_similar USING (win, item) JOIN (SELECT item_id, array_to_string(words, ' ') AS item FROM leak_items) USING (item) GROUP BY ALL)"""


ORACLE = f"WITH {sql()}\nSELECT * FROM leaks"
