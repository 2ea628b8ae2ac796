"""Weighted BM25 over text columns, for many queries at once.

Queries become phrases of terms. Of a document only the terms that a query asks for become rows: a fixed list of
queries is matched inside the token array, a table of queries by a join on the term, after its prefixes
have been looked up in the corpus's own terms. Phrases are runs of positions. Statistics come from all documents.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlake.functions.text import tokens
from emberlake.session import stage

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Query words from this length on match as prefixes.
PREFIX_FROM = 5
TOP_BLOCKS = 16
#: Ranks up to this are cut in the tasks before the shuffle: spark.sql.optimizer.windowGroupLimitThreshold.
MOST_CUT_EARLY = 1000


@dataclass(frozen=True)
class Phrase:
    query_id: str
    no: int
    words: tuple[str, ...]
    prefix: bool


def phrases_of(query_id: str, text: str, synonyms: dict[str, list[str]] | None = None, prefixes: bool = True) -> list[Phrase]:
    """The phrases of a query text: each word, and its synonyms, once; a word with signs inside is a phrase of its parts.

    ``synonyms``: lower-case word to all spellings of its group. Long words match as prefixes; of a phrase only the last.
    """
    seen: dict[str, None] = {}
    for word in text.replace('"', " ").split():
        for spelling in (synonyms or {}).get(word.lower(), [word]):
            seen.setdefault(spelling.lower(), None)
    out = []
    for spelling in seen:
        words = tuple(re.findall(r"[^\W_]+", spelling))
        if words:
            out.append(Phrase(query_id, len(out), words, prefixes and len(spelling) >= PREFIX_FROM))
    return out


def phrase_table(spark: SparkSession, phrases: list[Phrase]) -> DataFrame:
    rows = [(p.query_id, p.no, i, w, p.prefix and i == len(p.words) - 1, len(p.words)) for p in phrases for i, w in enumerate(p.words)]
    return spark.createDataFrame(rows, "query_id string, phrase int, idx int, word string, prefix boolean, words int")


def phrases_from(queries: DataFrame, prefixes: bool = True) -> DataFrame:
    """``phrase_table`` of ``queries(query_id, text)`` by the rules of ``phrases_of``, for query sets that grow with the data."""
    spellings = F.array_distinct(F.filter(F.split(F.lower(F.replace("text", F.lit('"'), F.lit(" "))), r"\s+"), lambda s: F.size(tokens(s)) > 0))
    rows = queries.where("text IS NOT NULL").select("query_id", F.posexplode(spellings).alias("phrase", "spelling")).withColumn("t", tokens(F.col("spelling")))
    long = F.lit(prefixes) & (F.length("spelling") >= PREFIX_FROM)
    each = rows.select("query_id", "phrase", F.posexplode("t").alias("idx", "word"), long.alias("long"), F.size("t").alias("words"))
    return each.select("query_id", "phrase", "idx", "word", (F.col("long") & (F.col("idx") == F.col("words") - 1)).alias("prefix"), "words")


def asked(phrases: list[Phrase]):
    """A test of a term: whether a phrase of the list has it, or the beginning of it as a prefix."""
    whole = sorted({w for p in phrases for w in (p.words[:-1] if p.prefix else p.words)})
    heads: dict[int, set[str]] = {}
    for p in phrases:
        if p.prefix:
            heads.setdefault(len(p.words[-1]), set()).add(p.words[-1])

    def test(term: Column) -> Column:
        tests = [term.isin(whole)] if whole else []
        tests += [F.substring(term, 1, n).isin(sorted(h)) for n, h in heads.items()]
        return reduce(or_, tests, F.lit(False))

    return test


def index_of(docs: DataFrame, columns: list[str], keep=None) -> DataFrame:
    """(id, len, terms) of ``docs(id, columns...)``: the index that searches read, written as a table, so that texts are read and parted once.

    terms: structs of col, pos and term; len: the document's terms over all columns. Null texts have none.
    ``keep``: a test that a term must pass to stand in the table, for a list of queries that is all that will be asked.
    """

    def terms(c: str) -> Column:
        placed = F.transform(F.col(f"_t_{c}"), lambda t, i: F.struct(F.lit(c).alias("col"), i.alias("pos"), t.alias("term")))
        return placed if keep is None else F.filter(placed, lambda s: keep(s["term"]))

    text = lambda c: F.array_join(c, " ") if dict(docs.dtypes)[c].startswith("array") else F.col(c)
    each = docs.select("id", *[tokens(text(c)).alias(f"_t_{c}") for c in columns])
    length = reduce(lambda a, b: a + b, [F.size(f"_t_{c}") for c in columns])
    return stage(each.select("id", length.alias("len"), F.concat(*[terms(c) for c in columns]).alias("terms")), "index")


def postings(index: DataFrame) -> DataFrame:
    """(id, len, col, pos, term), one row per term of ``index_of``."""
    return index.select("id", "len", F.explode("terms").alias("p")).select("id", "len", "p.*")


def with_terms(phrases: DataFrame, terms: DataFrame) -> DataFrame:
    """``phrases`` with term: their word, or each of the corpus's ``terms(term)`` that begins with it where it is a prefix."""
    whole = phrases.where("NOT prefix").withColumn("term", F.col("word"))
    heads = phrases.where("prefix").withColumn("_n", F.length("word"))
    # Each term is cut at the lengths that some prefix has.
    ends = heads.agg(F.collect_set("_n").alias("_ends"))
    cut = terms.join(F.broadcast(ends)).select("term", F.explode("_ends").alias("_n")).where(F.length("term") >= F.col("_n"))  # one row
    cut = cut.withColumn("_head", F.substring("term", F.lit(1), F.col("_n")))
    begun = heads.join(cut.select("term", F.col("_head").alias("word"), F.col("_n")), ["word", "_n"]).drop("_n")
    return whole.unionByName(begun)


def met_in_list(post: DataFrame, phrases: list[Phrase]) -> DataFrame:
    """(query_id, phrase, idx, words, id, len, col, pos) of the terms of ``post`` that a list of phrases has; no join is needed for it."""
    rows = [F.struct(F.lit(p.query_id).alias("query_id"), F.lit(p.no).alias("phrase"), F.lit(i).alias("idx"), F.lit(w).alias("word"), F.lit(p.prefix and i == len(p.words) - 1).alias("prefix"), F.lit(len(p.words)).alias("words")) for p in phrases for i, w in enumerate(p.words)]
    if not rows:
        return met_in_table(post, phrase_table(post.sparkSession, []).withColumn("term", F.col("word")))
    fits = F.filter(F.array(*rows), lambda p: F.when(p["prefix"], F.startswith(F.col("term"), p["word"])).otherwise(F.col("term") == p["word"]))
    return post.select("id", "len", "col", "pos", F.explode(fits).alias("p")).select("p.query_id", "p.phrase", "p.idx", "p.words", "id", "len", "col", "pos")


def met_in_table(post: DataFrame, phrases: DataFrame) -> DataFrame:
    """``met_in_list`` for a table of phrases as of ``with_terms``."""
    return post.join(phrases, "term").select("query_id", "phrase", "idx", "words", "id", "len", "col", "pos")


def bm25(docs: DataFrame, weights: dict[str, float], phrases: list[Phrase] | DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score): higher is better; only documents with a hit.

    ``docs(id, columns of weights)``, one row per id; ``phrases``: a list, or a table as of ``phrases_from``. All documents count for the number of documents and the mean
    length. A phrase's hits add up over the columns by weight; a term in over half the documents scores next
    to nothing, as in the common formula with its floor. ``index``: an ``index_of`` the documents that is at hand already.
    """
    spark, columns = docs.sparkSession, list(weights)
    if index is None:
        index = index_of(docs, columns, None if isinstance(phrases, DataFrame) else asked(phrases))
    post = postings(index)
    met = met_in_table(post, with_terms(phrases, post.select("term").distinct())) if isinstance(phrases, DataFrame) else met_in_list(post, phrases)
    return _scored(met, weights, index.agg(F.count("*").cast("double").alias("total"), F.avg("len").alias("mean")))


def _idf(total: Column, n: Column) -> Column:
    raw = F.log((total - n + 0.5) / (n + 0.5))
    return F.when(raw > 0, raw).otherwise(LEAST_IDF)


def _part(idf: Column) -> Column:
    """A phrase's part of the score of a document, from columns f, len and mean."""
    return idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("mean")))


def _scored(met: DataFrame, weights: dict[str, float], corpus: DataFrame) -> DataFrame:
    """(query_id, id, score) of terms met; ``corpus``: one row (total, mean)."""
    # A hit is a run of positions that holds all words of its phrase.
    hits = met.groupBy("query_id", "phrase", "words", "id", "len", "col", (F.col("pos") - F.col("idx")).alias("start")).agg(F.count("*").alias("_n")).where("_n = words")
    weight = F.create_map(*[F.lit(x) for c, w in weights.items() for x in (c, float(w))])
    f = hits.groupBy("query_id", "phrase", "id").agg(F.sum(weight[F.col("col")]).alias("f"), F.first("len").alias("len"))
    found = f.groupBy("query_id", "phrase").agg(F.count("*").alias("n"))
    rows = f.join(found, ["query_id", "phrase"]).join(F.broadcast(corpus))  # one row
    part = _part(_idf(F.col("total"), F.col("n")))
    return rows.groupBy("query_id", "id").agg(F.round(F.sum(part), 9).alias("score"))


def top_k(scored: DataFrame, k: int, group: str = "query_id", score: Column | None = None, tie: str = "id") -> DataFrame:
    """``scored`` with rank, the ``k`` best of each group, from 1; ties by ``tie``.

    Rows are cut to ``k`` per hash block before a group meets in one task.
    """
    order = [F.col("score").desc() if score is None else score, F.col(tie)]
    part = scored.withColumn("_b", F.pmod(F.xxhash64(tie), F.lit(TOP_BLOCKS))).withColumn("_k", F.row_number().over(Window.partitionBy(group, "_b").orderBy(*order))).where(F.col("_k") <= k)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k).drop("_b", "_k")


def spelt(phrases: DataFrame, extra: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(asked, asked_extra, words): the phrases of many queries by their distinct spellings, so that each is looked for once.

    asked(query_id, phrase, s) of ``phrases`` and of ``extra``, which is ``phrases`` where it is None; words(s, idx, word, prefix, words).
    """
    of = lambda p, no: p.groupBy("query_id", "phrase").agg(F.array_sort(F.collect_list(F.struct("idx", "word", "prefix", "words"))).alias("spelling")).withColumn("list", F.lit(no))
    each = stage(of(phrases, 0) if extra is None else of(phrases, 0).unionByName(of(extra, 1)), "asked_spellings", sweep=True)
    # The numbers stay as they are once they are written.
    spellings = stage(each.select("spelling").distinct().withColumn("s", F.monotonically_increasing_id()), "spellings", sweep=True)
    asked = stage(each.join(spellings, "spelling").select("list", "query_id", "phrase", "s"), "asked", sweep=True)
    lists = [asked.where(F.col("list") == no).drop("list") for no in (0, 0 if extra is None else 1)]
    return lists[0], lists[1], spellings.select("s", F.inline("spelling"))


def hits(index: DataFrame, weights: dict[str, float], words: DataFrame) -> DataFrame:
    """(s, id, len, f): the weighted hits of each spelling of ``spelt`` in each document that has one, as a table.

    The corpus's terms are looked up first; where those that are asked for are few they go to all tasks, and only what they match travels, by document.
    """
    post = postings(index)
    terms = stage(with_terms(words, post.select("term").distinct()).select("term", "s", "idx", "words"), "asked_terms", sweep=True)
    met = post.join(terms, "term").select("s", "id", "len", "words", "col", (F.col("pos") - F.col("idx")).alias("start")).repartition("id")
    runs = met.groupBy("s", "id", "len", "words", "col", "start").agg(F.count("*").alias("_n")).where("_n = words")
    weight = F.create_map(*[F.lit(x) for c, w in weights.items() for x in (c, float(w))])
    found = runs.groupBy("s", "id", "len").agg(F.sum(weight[F.col("col")]).alias("f"))
    return stage(found, "hits", sweep=True)


def spelling_weights(found: DataFrame, index: DataFrame) -> DataFrame:
    """(s, n, idf, mean) of each spelling of ``hits``, as a table; n: the documents that have it. All documents of the index count."""
    corpus = index.agg(F.count("*").cast("double").alias("total"), F.avg("len").alias("mean"))
    rows = found.groupBy("s").agg(F.count("*").alias("n")).join(F.broadcast(corpus))  # one row
    return stage(rows.select("s", "n", _idf(F.col("total"), F.col("n")).alias("idf"), "mean"), "spelling_weights", sweep=True)


def scores(found: DataFrame, weighed: DataFrame, asked: DataFrame, *group: str) -> DataFrame:
    """(group..., id, score), the scores of ``bm25`` from ``hits`` or those of some documents, ``spelling_weights`` and ``spelt``; group: query_id, and phrase to score each alone."""
    rows = found.join(weighed, "s").join(asked, "s")
    return rows.groupBy(*group, "id").agg(F.round(F.sum(_part(F.col("idf"))), 9).alias("score"))


def best(scored: DataFrame, k: int) -> DataFrame:
    """``top_k`` of each query over many more rows than ``k``: every task leaves but its own ``k`` best before a query meets in one."""
    if k > MOST_CUT_EARLY:
        return top_k(scored, k)
    at = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(at)).where(F.col("rank") <= k)


def rare_terms(docs: DataFrame, columns: list[str], words: list[str], most: int = 25) -> DataFrame:
    """(word, df) of the query words that stand in 1 to ``most`` documents."""
    wanted = sorted({w.lower() for w in words})
    df = postings(index_of(docs, columns, lambda t: t.isin(wanted))).groupBy(F.col("term").alias("word")).agg(F.count_distinct("id").alias("df"))
    return df.where(F.col("df") <= most)


def interleaved(lanes: DataFrame) -> DataFrame:
    """(query_id, id, rank): ranked lanes (query_id, lane, id, rank) dealt out by rank, each id at its first place."""
    first = lanes.groupBy("query_id", "id").agg(F.min(F.struct("rank", "lane")).alias("at"))
    return first.select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy("at.rank", "at.lane", "id")).alias("rank"))


def synonym_groups(entities: DataFrame) -> DataFrame:
    """(word, spellings): one-word names of entities not denied that share an entity with other names, lower case."""
    names = F.array_union(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    own = entities.where("coalesce(pending_review, 0) <> 2").select("id", F.transform(F.filter(names, lambda n: F.trim(n) != ""), lambda n: F.lower(F.trim(n))).alias("names")).withColumn("names", F.array_distinct("names")).where(F.size("names") > 1)
    words = own.select("names", F.explode("names").alias("word")).where("word NOT LIKE '% %'")
    return words.groupBy("word").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("spellings"))


def merged_synonyms(entities: DataFrame, most_rounds: int = 30) -> DataFrame:
    """(word, spellings): like ``synonym_groups``, but entities that share a name, in any case, are one group, and so on from one to the next.

    The smallest label of a name's entities and of an entity's names goes around until none changes. Raises if ``most_rounds`` were not enough.
    """
    names = F.array_union(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    own = entities.where("coalesce(pending_review, 0) <> 2").select("id", F.explode(names).alias("n")).select("id", F.lower(F.trim("n")).alias("name")).where("name <> ''").distinct()
    pairs = stage(own.withColumn("label", F.col("id")), "names")
    for _ in range(most_rounds):
        by_name = pairs.groupBy("name").agg(F.min("label").alias("by_name"))
        by_id = pairs.join(by_name, "name").groupBy("id").agg(F.min("by_name").alias("low"))
        now = stage(pairs.join(by_id, "id").select("id", "name", "low", (F.col("low") != F.col("label")).alias("moved")), "names")
        pairs = now.select("id", "name", F.col("low").alias("label"))
        if now.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"synonyms are not settled after {most_rounds} rounds")
    groups = pairs.groupBy("label").agg(F.array_sort(F.collect_set("name")).alias("spellings")).where(F.size("spellings") > 1)
    return groups.select(F.explode("spellings").alias("word"), "spellings").where("word NOT LIKE '% %'")


def write_index(docs: DataFrame, columns: list[str], path: str, buckets: int = 64, spread: int = 4) -> None:
    """Keep the index of ``docs`` under ``path``: postings in ``buckets`` by the hash of the term, the terms in order, and the corpus statistics.

    A search reads the buckets of its terms alone, of the terms only what begins as its prefixes do. A bucket is written by ``spread`` tasks, so a term of very many rows fills no single one.
    """
    index = index_of(docs, columns)
    post = postings(index).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    post.repartition(buckets, "bucket", F.pmod(F.xxhash64("id"), F.lit(spread))).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    post.select("term", "bucket").distinct().repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    index.agg(F.count("*").cast("double").alias("total"), F.avg("len").alias("mean")).write.mode("overwrite").parquet(f"{path}/stats")


def stored_bm25(spark: SparkSession, path: str, weights: dict[str, float], phrases: list[Phrase]) -> DataFrame:
    """``bm25`` of an index that ``write_index`` keeps: only the partitions of the asked terms are read."""
    asked_for = asked(phrases)(F.col("term"))
    buckets = [r["bucket"] for r in spark.read.parquet(f"{path}/terms").where(asked_for).select("bucket").distinct().collect()]  # as many as there are buckets
    post = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(buckets) & asked_for & F.col("col").isin(list(weights)))
    return _scored(met_in_list(post.select("id", "len", "col", "pos", "term"), phrases), weights, spark.read.parquet(f"{path}/stats"))
