"""Benchmark decontamination on a distributed positional inverted index. DataFrame operations only.

Index. Each word of a text that occurs in the benchmark gives a posting (document, term, position);
one more posting holds the text's end. A document is a row, numbered as it is read. The index is a table in
the shared folder, written in one pass over the texts; all that follows reads the index alone, never the texts.

Search. A phrase is a window of WINDOW words of an item, or a whole shorter item; equal phrases are one.
Phrases with a term that has no posting are out. Of each other one the two rarest terms' posting lists,
adjusted by the terms' offsets, are intersected; the starts that are left are proven by the lists of
all its terms in those documents. `within` gives proximity matches: all terms of a phrase inside a span.

The vocabulary, the phrases and the candidate documents are broadcast only if their counted rows are
under SMALL; beyond that the same joins shuffle. Rows of a very frequent term are split by adaptive execution.

Null text: no words. Null doc_id: a document like others. Null item_id: its phrases hit, but it isn't an
item that is named. Repeated rows and rows of one id: each by itself. Empty
tables: no hits. Other columns are not read. Long texts are whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from colloquy.llm.common import Staging, read_table

WINDOW, SMALL, END = 13, 300_000, 0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words, before A-Z are lowered.
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATOR), lambda w: w != "")


def marks_of(doc_id: Column, text: Column) -> list[Column]:
    """Two digests of 64 bits of a row's id and text."""
    return [F.xxhash64(doc_id, F.coalesce(text, F.lit(""))), F.xxhash64(F.lit(1), doc_id, F.coalesce(text, F.lit("")))]


def lowered(word: Column) -> Column:
    """A-Z only; lower() is the fast test of whether there is anything to do."""
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, UPPER, LOWER))


def _small(df: DataFrame) -> DataFrame:
    """A broadcast if the rows, which are stored and counted, are few."""
    return F.broadcast(df) if df.count() <= SMALL else df


class PhraseIndex:
    """Postings of a table's texts over the terms of an item table."""

    def __init__(self, docs: DataFrame, items: DataFrame, staging: Staging):
        self.staging = staging
        item_words = items.select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
        self.items = item_words.select("item_id", F.transform("w", lowered).alias("w"))
        terms = self.items.select(F.explode("w").alias("word")).distinct()
        self.terms = staging.write(terms.select("word", (F.monotonically_increasing_id() + 1).alias("term")), "terms")
        end = "\x00"  # not a word of any text
        ends = self.terms.sparkSession.createDataFrame([(end, END)], "word string, term long")
        known = _small(staging.write(self.terms.unionByName(ends), "known"))
        texts = docs.select("doc_id", F.monotonically_increasing_id().alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
        marks = F.array(*marks_of(F.col("doc_id"), F.col("text")))
        said = texts.select("doc_id", "doc", marks.alias("marks"), F.posexplode(F.array_append(words(F.col("text")), F.lit(end))).alias("pos", "raw"))
        posted = said.select("doc_id", "doc", "marks", "pos", lowered(F.col("raw")).alias("word")).join(known, "word")
        self.postings = staging.write(posted.select("doc_id", "doc", "pos", "term", F.when(F.col("term") == END, F.col("marks")).alias("marks")), "postings", compression="zstd")

    def documents(self) -> DataFrame:
        """doc_id, doc, marks and n_words of every row."""
        return self.postings.where(F.col("term") == END).select("doc_id", "doc", "marks", F.col("pos").cast("long").alias("n_words"))

    def phrases(self, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
        """Distinct phrases that can occur (phrase, n, parts of (frequency, offset, term), rarest first) and the items of each."""
        frequency = self.staging.write(self.postings.where(F.col("term") != END).groupBy("term").agg(F.count("*").alias("frequency")), "frequency")
        cut = self.items.select(
            "item_id",
            F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1))), lambda i: F.slice("w", i, window))).alias("w"),
        )
        cut = self.staging.write(cut.select("item_id", "w", F.sha2(F.array_join("w", " "), 256).alias("phrase")), "cut")
        owners = cut.where("item_id IS NOT NULL").select("phrase", "item_id").distinct()
        parts = cut.select("phrase", "w").dropDuplicates(["phrase"]).select("phrase", F.size("w").alias("n"), F.posexplode("w").alias("offset", "word"))
        parts = parts.join(_small(self.terms), "word").join(_small(frequency), "term")
        grouped = parts.groupBy("phrase", "n").agg(F.array_sort(F.collect_list(F.struct("frequency", "offset", "term"))).alias("parts"))
        return self.staging.write(grouped.where(F.size("parts") == F.col("n")), "phrases"), owners

    def exact(self, phrases: DataFrame) -> DataFrame:
        """phrase, doc, start and n of every occurrence."""
        rare = phrases.select("phrase", "n", F.col("parts")[0].alias("one"), F.get("parts", F.lit(1)).alias("two"))
        rare = self.staging.write(rare.select("phrase", "n", F.col("one.term").alias("term"), F.col("one.offset").alias("at"), F.col("two.term").alias("other"), (F.col("two.offset") - F.col("one.offset")).alias("gap")), "rare")
        posted = self.postings.select("doc", "pos", "term")
        first = posted.join(_small(rare), "term").where("pos >= at").select("phrase", "n", "doc", (F.col("pos") - F.col("at")).alias("start"), "other", (F.col("pos") + F.col("gap")).alias("next"))
        wanted = self.staging.write(rare.where("other IS NOT NULL").select(F.col("other").alias("term")).distinct(), "wanted")
        second = posted.join(_small(wanted), "term", "left_semi").select("doc", F.col("term").alias("other"), F.col("pos").alias("next"))
        both = first.where("other IS NOT NULL").join(second, ["doc", "other", "next"], "left_semi").select("phrase", "n", "doc", "start")
        starts = self.staging.write(both.union(first.where("other IS NULL").select("phrase", "n", "doc", "start")).distinct(), "starts")
        held = self.staging.write(starts.where("n > 2").select("doc").distinct(), "held")
        lists = posted.join(_small(held), "doc", "left_semi")
        whole = phrases.select("phrase", F.explode(F.slice("parts", F.lit(3), F.size("parts"))).alias("p")).select("phrase", "p.offset", "p.term")
        whole = self.staging.write(whole, "rest")
        proof = starts.where("n > 2").join(_small(whole), "phrase").select("phrase", "n", "doc", "start", "term", (F.col("start") + F.col("offset")).alias("pos"))
        proven = proof.join(lists, ["doc", "pos", "term"], "left_semi").groupBy("phrase", "n", "doc", "start").agg(F.count("*").alias("k")).where("k = n - 2")
        return proven.select("phrase", "doc", "start", "n").union(starts.where("n <= 2").select("phrase", "doc", "start", "n"))

    def within(self, phrases: DataFrame, span: int) -> DataFrame:
        """phrase, doc, low and high: for each occurrence of a phrase's rarest term, the narrowest place of
        `span` words at most that holds it and all terms, each as often as the phrase does, in any
        order; the first of equals."""
        flat = phrases.select("phrase", F.col("parts")[0].term.alias("key"), F.explode("parts.term").alias("term")).groupBy("phrase", "key", "term").agg(F.count("*").cast("int").alias("need"))
        flat = flat.withColumn("kinds", F.count("*").over(Window.partitionBy("phrase")))
        posted = self.postings.select("doc", "pos", "term")
        centres = posted.withColumnsRenamed({"term": "key", "pos": "centre"}).join(flat, "key")
        near = centres.select("phrase", "kinds", "doc", "centre", "term", "need", F.explode(F.sequence(F.col("centre") - span + 1, F.col("centre") + span - 1)).alias("pos")).join(posted, ["doc", "term", "pos"])
        places = near.groupBy("phrase", "kinds", "doc", "centre", "term", "need").agg(F.array_sort(F.collect_list("pos")).alias("at"))
        held = places.groupBy("phrase", "kinds", "doc", "centre").agg(F.collect_list(F.struct("need", "at")).alias("terms")).where("size(terms) = kinds")
        far = F.col("centre") + span  # where a term isn't there often enough
        last = lambda low: F.array_max(F.transform("terms", lambda t: F.coalesce(F.get(F.filter(t["at"], lambda x: x >= low), t["need"] - 1), far)))
        lows = F.filter(F.flatten("terms.at"), lambda x: x <= F.col("centre"))
        best = F.array_min(F.transform(lows, lambda low: F.struct((F.greatest(last(low), "centre") - low).alias("wide"), low.alias("low"))))
        return held.select("phrase", "doc", best.alias("best")).where(F.col("best.wide") < span).select("phrase", "doc", F.col("best.low").alias("low"), (F.col("best.low") + F.col("best.wide")).alias("high"))


def decontaminate(docs: DataFrame, items: DataFrame, staging: Staging, window: int = WINDOW) -> DataFrame:
    """doc_id, marks (128 bits of id and text, as `marks_of` has them), n_words, n_hit, n_items, items_sha256, contaminated."""
    index = PhraseIndex(docs, items, staging)
    phrases, owners = index.phrases(window)
    hits = staging.write(index.exact(phrases), "hits")
    spans = hits.select("doc", "start", (F.col("start") + F.col("n")).alias("stop")).distinct()
    before = F.max("stop").over(Window.partitionBy("doc").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1))
    covered = spans.withColumn("before", before).groupBy("doc").agg(F.sum(F.greatest(F.col("stop") - F.greatest("start", F.coalesce("before", F.lit(0))), F.lit(0))).cast("long").alias("n_hit"))
    named = hits.select("doc", "phrase").distinct().join(owners, "phrase").groupBy("doc").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("names"))
    found = staging.write(covered.join(named, "doc", "left"), "found")
    out = index.documents().join(_small(found), "doc", "left")
    n_hit, names = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("names", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "marks", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated")
    )


def op9_phrase_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), Staging(spark, "phrases")).drop("marks")


#: The same rows by looking up every window of every text among the items' windows.
OP9_SQL = r"""
WITH cut AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
item AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
phrase AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS p
           FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
spot AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM cut),
hit AS (SELECT s.doc_id, s.i, p.n, p.item_id FROM (SELECT doc_id, i, k.n, array_to_string(w[i:i + k.n - 1], ' ') AS p FROM spot, (SELECT DISTINCT n FROM phrase) k WHERE i + k.n - 1 <= len(w)) s
        JOIN phrase p ON p.n = s.n AND p.p = s.p),
word AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS at FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT c.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM cut c LEFT JOIN word USING (doc_id) LEFT JOIN named USING (doc_id)
"""
