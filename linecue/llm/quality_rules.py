"""Quality rules in native expressions: base statistics of a text and a log-likelihood ratio of its n-grams.

Words and word pairs are hashed (CRC-32) into buckets, whose number grows with
the corpus as its vocabulary does, about with the square root of its length:
BUCKETS_A_ROOT for each unit of that root in bytes, MIN_BUCKETS at least.
Two multinomials over the buckets are counted: one over every document, one
over the documents that a trusted table names. A document's score is the mean
over its n-grams of log(trusted share / raw share), so length doesn't matter;
it is kept if the score is LEAST_SCORE or more. Weights are whole millionths
and their sums whole numbers, so a verdict never depends on the order of rows.

Texts are read once for the counts, and shuffled for those of the trusted ones
only if more than MOST_BROADCAST trusted ids are known. Up to MOST_INLINE buckets, their weights are an array in the plan and a
text is scored in its row. Beyond that its n-grams meet the table of weights by
bucket, which is broadcast up to MOST_BROADCAST buckets and shuffled above.

Cases: a null or empty text has no words and fails the base rules; rows of
equal or null doc_id are judged one by one; a null doc_id is never trusted;
without trusted documents every weight follows from the smoothing alone;
empty tables give an empty table; further columns are not read, whatever their
names. A text is handled in one row, however long, by sorting and never by
comparing all its windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linecue.llm.common import checkpointed, document, table, words_of

MIN_BUCKETS, BUCKETS_A_ROOT = 1 << 14, 2
MOST_INLINE, MOST_BROADCAST = 1 << 17, 1 << 21
#: Mean log-likelihood ratio (in nats) of a kept document.
LEAST_SCORE = -0.1
MIN_WORDS = 50
#: Share of words, in hundredths, that may stand in repeated 3-word windows.
MOST_REPEATED = 50
SYMBOLS = "#*$%&|<>"


def n_buckets(text_bytes: int) -> int:
    """A power of two."""
    return max(MIN_BUCKETS, 1 << (BUCKETS_A_ROOT**2 * text_bytes).bit_length() // 2)


def _bucket(gram: Column, buckets: int) -> Column:
    return (F.crc32(gram.cast("binary")) % buckets).cast("int")


def _pairs(words: Column, count: Column) -> Column:
    """array<struct<a, b>>: every word and the next one, null after the last."""
    return F.zip_with(words, F.slice(words, F.lit(2), count), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _repeated(hashes: Column) -> Column:
    """Words inside the 3-word windows whose hash occurs twice or more; hashes: one for each window, in order."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda s, x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
    # The sorted array is bound to s by a transform over one element: lambdas then read it, not sort it, for each window.
    places = F.transform(F.array(ordered), lambda s: F.sort_array(F.transform(F.filter(s, lambda x, i: same(s, x, i)), lambda x: x["i"])))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda acc, p: F.struct((p + 3).alias("end"), (acc["n"] + 3 - F.greatest(F.lit(0), acc["end"] - p)).alias("n"))
    covered = F.aggregate(F.get(places, F.lit(0)), start, step, lambda acc: acc["n"])
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered).otherwise(0)


def base_statistics(docs: DataFrame, *further: Column, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, further, carried); row: the text's hash, as common.document has it; further: columns of words; carried: columns of docs."""
    body = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    out = docs.select("doc_id", document()["row"].alias("row"), F.col("text").cast("string").alias("text"), *carried)
    out = out.withColumns({"words": words_of(F.col("text")), "lines": lines})
    windows = F.arrays_zip("words", F.slice("words", F.lit(2), F.size("words")), F.slice("words", F.lit(3), F.size("words")))
    out = out.withColumn("windows", F.transform(F.slice(windows, F.lit(1), F.greatest(F.size("words") - 2, F.lit(0))), lambda x: F.xxhash64(x)))
    return out.select(
        "doc_id",
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate(body, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("windows")).cast("long").alias("n_repeat_words"),
        *further,
        *carried,
    )


def grams(rows: DataFrame, buckets: int) -> DataFrame:
    """(trusted, bucket): a row for each word and for each pair of words; rows: text, trusted."""
    pairs = rows.select("trusted", words_of(F.col("text")).alias("words")).select("trusted", F.explode(_pairs(F.col("words"), F.size("words"))).alias("p")).select("trusted", "p.a", "p.b")
    return pairs.select("trusted", F.explode(F.array(_bucket(F.col("a"), buckets), _bucket(F.concat("a", F.lit(" "), F.col("b")), buckets))).alias("bucket")).where("bucket is not null")


def joined_sums(docs: DataFrame, weights: DataFrame, buckets: int) -> DataFrame:
    """(doc, llr_sum) by a join of n-grams and weights; texts without words are left out."""
    words = docs.select(document().alias("doc"), words_of(F.col("text").cast("string")).alias("words"))
    pairs = words.select("doc", F.posexplode(_pairs(F.col("words"), F.size("words"))).alias("at", "p")).select("doc", "at", "p.a", "p.b")
    both = F.posexplode(F.array(_bucket(F.col("a"), buckets), _bucket(F.concat("a", F.lit(" "), F.col("b")), buckets))).alias("kind", "bucket")
    weights = F.broadcast(weights) if buckets <= MOST_BROADCAST else weights
    found = pairs.select("doc", "at", both).where("bucket is not null").join(weights, "bucket")
    # Rows that are equal in id and text are summed together: their number is how often their first word came.
    sums = found.groupBy("doc").agg(F.sum("w").alias("all"), F.count(F.when((F.col("at") == 0) & (F.col("kind") == 0), 1)).alias("copies"))
    return sums.select("doc", F.expr("all div copies").alias("llr_sum"))


def bucket_weights(docs: DataFrame, trusted: DataFrame, buckets: int) -> DataFrame:
    """(bucket, w) in millionths, for the buckets in use. trusted: doc_id of the documents to resemble."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    named = trusted.select("doc_id").where("doc_id is not null").distinct()
    if named.count() <= MOST_BROADCAST:  # one reading of the texts for both counts
        rows = rows.join(F.broadcast(named.withColumn("trusted", F.lit(1))), "doc_id", "left").select("text", F.coalesce("trusted", F.lit(0)).alias("trusted"))
        counts = grams(rows, buckets).groupBy("bucket").agg(F.count("*").alias("r"), F.sum("trusted").alias("t"))
    else:  # one for all documents, where they are, and one for the trusted ones
        raw = grams(rows.select("text", F.lit(0).alias("trusted")), buckets).groupBy("bucket").agg(F.count("*").alias("r"))
        aims = rows.join(named.hint("merge"), "doc_id", "left_semi").select("text", F.lit(1).alias("trusted"))
        aim = grams(aims, buckets).groupBy("bucket").agg(F.count("*").alias("t"))
        counts = raw.join(aim, "bucket", "left").select("bucket", "r", F.coalesce("t", F.lit(0)).alias("t"))
    counts = checkpointed(counts)
    rs, ts = (int(x or 0) for x in counts.agg(F.sum("r"), F.sum("t")).first())
    share = lambda n, total: (F.col(n) + 1.0) / F.lit(float(total) + float(buckets))
    return counts.select("bucket", F.round(F.lit(1e6) * F.log(share("t", ts) / share("r", rs))).cast("long").alias("w"))


def judge(docs: DataFrame, trusted: DataFrame, least_score: float = LEAST_SCORE, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, row, base statistics, llr_sum (millionths), n_grams, score, base_failed, kept, carried) for every row; row: the text's hash, as common.document has it; carried: columns of docs that go along."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    buckets = n_buckets(size)
    weights = bucket_weights(docs, trusted, buckets)
    if buckets <= MOST_INLINE:
        every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(weights, "bucket", "left")
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("bucket", F.coalesce("w", F.lit(0)).alias("w")))), lambda x: x["w"].cast("string"))
        inline = F.split(F.lit(every.agg(F.array_join(ordered, ",")).first()[0]), ",").cast("array<bigint>")  # the optimizer folds this into one literal
        of = lambda gram: F.coalesce(F.get(inline, _bucket(gram, buckets)), F.lit(0).cast("long"))
        total = F.aggregate(_pairs(F.col("words"), F.size("words")), F.lit(0).cast("long"), lambda acc, x: acc + of(x["a"]) + of(F.concat(x["a"], F.lit(" "), x["b"])))
        out = base_statistics(docs, total.alias("llr_sum"), carried=carried)
    else:
        sums = joined_sums(docs, weights, buckets).hint("merge")
        out = base_statistics(docs, carried=carried).withColumn("doc", F.struct("doc_id", "row")).join(sums, "doc", "left").drop("doc")
    out = out.withColumns({"llr_sum": F.coalesce("llr_sum", F.lit(0).cast("long")), "n_grams": F.greatest(2 * F.col("n_words") - 1, F.lit(0))})
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    verdict = F.col("llr_sum") >= F.lit(round(least_score * 1e6)) * F.col("n_grams")
    out = out.withColumns({"score": F.col("llr_sum") / F.greatest("n_grams", F.lit(1)) / 1e6, "base_failed": failed})
    return out.withColumn("kept", ~F.col("base_failed") & verdict)


def trusted_labels(labels: DataFrame) -> DataFrame:
    """The trusted target: documents whose quality label is 1."""
    return labels.where("quality = 1").select("doc_id")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics, score sum and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = judge(docs, trusted_labels(table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_grams", "llr_sum")


def sql(documents: str = "documents", labels: str = "labels") -> str:
    """The same rows in DuckDB: CTEs that end in one named judged_rules."""
    return f"""
  rules_docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM {documents}),
  rules_words AS (SELECT rid, doc_id, text, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM rules_docs),
  rules_lines AS (
    SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines
    FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM rules_docs)
    WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
  rules_at AS (SELECT rid, unnest(words) AS w, unnest(range(len(words))) AS i FROM rules_words),
  rules_near AS (SELECT rid, i, w, lead(w, 1) OVER p AS w1, lead(w, 2) OVER p AS w2 FROM rules_at WINDOW p AS (PARTITION BY rid ORDER BY i)),
  rules_twice AS (SELECT rid, w, w1, w2 FROM rules_near WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
  rules_repeat AS (
    SELECT rid, count(DISTINCT i + k) AS n_repeat_words
    FROM rules_near JOIN rules_twice USING (rid, w, w1, w2), range(3) AS ks(k) GROUP BY rid),
  rules_crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, n::BIGINT)) AS crc),
  rules_grams AS (
    SELECT rid, w AS gram FROM rules_near UNION ALL SELECT rid, w || ' ' || w1 FROM rules_near WHERE w1 IS NOT NULL),
  rules_size AS (SELECT greatest({MIN_BUCKETS}, 1 << (length(bin({BUCKETS_A_ROOT**2} * coalesce(sum(strlen(text)), 0)::BIGINT)) // 2)::BIGINT) AS buckets FROM rules_docs),
  rules_hex AS (SELECT gram, hex(encode(gram)) AS h FROM (SELECT DISTINCT gram FROM rules_grams)),
  rules_bytes AS (SELECT gram, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS b FROM rules_hex),
  rules_bucket AS (
    SELECT gram, xor(list_reduce(b, lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % buckets AS bucket
    FROM rules_bytes, rules_crc, rules_size),
  rules_trusted AS (SELECT DISTINCT doc_id FROM {labels} WHERE quality = 1),
  rules_counts AS (
    SELECT bucket, count(*) AS r, count(t.doc_id) AS t
    FROM rules_grams JOIN rules_docs USING (rid) JOIN rules_bucket USING (gram) LEFT JOIN rules_trusted t USING (doc_id) GROUP BY bucket),
  rules_totals AS (SELECT coalesce(sum(r), 0) AS rs, coalesce(sum(t), 0) AS ts FROM rules_counts),
  rules_weights AS (
    SELECT bucket, CAST(round(1e6 * ln(((t + 1.0::DOUBLE) / (ts + buckets::DOUBLE)) / ((r + 1.0::DOUBLE) / (rs + buckets::DOUBLE)))) AS BIGINT) AS w
    FROM rules_counts, rules_totals, rules_size),
  rules_scores AS (SELECT rid, sum(w) AS llr_sum FROM rules_grams JOIN rules_bucket USING (gram) JOIN rules_weights USING (bucket) GROUP BY rid),
  rules_base AS (
    SELECT rid, doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
      (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
      coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, greatest(2 * len(words) - 1, 0)::BIGINT AS n_grams, coalesce(llr_sum, 0)::BIGINT AS llr_sum
    FROM rules_words LEFT JOIN rules_lines USING (rid) LEFT JOIN rules_repeat USING (rid) LEFT JOIN rules_scores USING (rid)),
  judged_rules AS (
    SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
      NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND llr_sum >= {round(LEAST_SCORE * 1e6)} * n_grams AS kept
    FROM rules_base)"""


ORACLE = f"WITH {sql()}\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_grams, llr_sum FROM judged_rules"
