"""Keeping the store in order: links, candidates, sessions, entities, verdicts, each as the table that follows from the old one."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.functions.text import identity_key, tokens

PARTICIPANT = "participant"
MECHANICAL = "mech:%"


def links_after_tagging(links: DataFrame, tagged: DataFrame, tags: DataFrame) -> DataFrame:
    """``links(item_id, entity_id, confidence, source)`` after the items ``tagged(item_id)`` were tagged anew with ``tags`` (same columns).

    Links of participants come from who wrote and got an item, so tagging never takes them away; a new tag of a pair that is linked still adds nothing.
    Of several tags of one pair the most confident counts.
    """
    cols = ["item_id", "entity_id", "confidence", "source"]
    retagged = tagged.select("item_id").distinct().withColumn("_r", F.lit(True))
    kept = links.join(retagged, "item_id", "left").where(F.col("_r").isNull() | F.coalesce(F.col("source") == PARTICIPANT, F.lit(False))).select(*cols)
    one = tags.groupBy("item_id", "entity_id").agg(F.max(F.struct("confidence", "source")).alias("t")).select("item_id", "entity_id", "t.*")
    return kept.unionByName(one.join(kept.select("item_id", "entity_id"), ["item_id", "entity_id"], "left_anti").select(*cols))


def first_owner(stored: DataFrame, drafted: DataFrame, at: str = "created_at") -> DataFrame:
    """``stored`` candidates and those of ``drafted`` whose id is new: who produced a candidate first keeps it."""
    new = drafted.join(stored.select("id"), "id", "left_anti").groupBy("id").agg(F.min_by(F.struct(*[c for c in stored.columns if c != "id"]), F.struct(at, *[c for c in ("run_id",) if c in stored.columns])).alias("v"))
    return stored.unionByName(new.select("id", "v.*").select(*stored.columns))


def without_sessions(items: DataFrame, sessions: DataFrame, sources: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, sessions) after the sessions of ``sources``, or all, were taken back: their members point to none."""
    gone = sessions.where(F.col("source").isin(sources)) if sources else sessions
    mark = gone.select(F.col("consolidation_id").alias("consolidated_into")).distinct().withColumn("_g", F.lit(True))
    free = items.join(mark, "consolidated_into", "left").withColumn("consolidated_into", F.when(F.col("_g").isNull(), F.col("consolidated_into")))
    return free.select(*items.columns), sessions.join(gone.select("consolidation_id"), "consolidation_id", "left_anti")


def unused_entities(entities: DataFrame, uses: list[tuple[DataFrame, str]], candidates: DataFrame | None = None) -> DataFrame:
    """(id) of pending entities that nothing uses: in no column of ``uses``, pairs of a table and its column, and named by no ``candidates(entity)``.

    Reviewed and denied entities stay whatever uses them.
    """
    rows = entities.where("pending_review = 1").select("id", F.lower("canonical_name").alias("_name"))
    rows = reduce(lambda left, use: left.join(use[0].select(F.col(use[1]).alias("id")).distinct(), "id", "left_anti"), uses, rows)
    if candidates is not None:
        rows = rows.join(candidates.select(F.lower("entity").alias("_name")).distinct(), "_name", "left_anti")
    return rows.select("id")


def seeded(entities: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``entities`` after a curated ``dictionary(canonical_name, entity_type, aliases)``: names meet in any case.

    A known entity takes name, type and review state of the dictionary; its aliases are joined to the new ones. New ones get the next ids, by name.
    """
    key = F.lower("canonical_name")
    own = dictionary.where("trim(canonical_name) <> ''").groupBy(key.alias("_k")).agg(F.min(F.struct("canonical_name", "entity_type")).alias("d"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("aliases", F.array().cast("array<string>")))))).alias("more"))
    rows = entities.withColumn("_k", key).join(own, "_k", "full_outer")
    top = entities.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    fresh = own.join(entities.select(key.alias("_k")), "_k", "left_anti").select("_k")
    numbered = fresh.groupBy().agg(F.array_sort(F.collect_list("_k")).alias("ks")).select(F.posexplode("ks").alias("no", "_k"))  # the new names of a hand-kept dictionary
    rows = rows.join(numbered, "_k", "left").join(F.broadcast(top))  # one row
    aliases = F.when(F.col("more").isNull(), F.col("aliases")).otherwise(F.array_distinct(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), "more")))
    return rows.select(
        F.coalesce("id", F.col("top") + F.col("no") + 1).alias("id"), F.coalesce("d.canonical_name", "canonical_name").alias("canonical_name"), F.coalesce("d.entity_type", "entity_type").alias("entity_type"),
        aliases.alias("aliases"), F.when(F.col("d").isNotNull(), 0).otherwise(F.col("pending_review")).cast("int").alias("pending_review"),
    )


def dictionary_groups(entries: DataFrame) -> DataFrame:
    """(canonical, aliases) of ``entries(place, canonical, aliases)``: one entry per name in any case, spelled as first seen, its aliases in order of appearance."""
    seen = F.array_sort(F.collect_list(F.struct("place", "canonical", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))))
    rows = entries.where("trim(canonical) <> ''").groupBy(F.lower("canonical").alias("_k")).agg(seen.alias("e"))
    return rows.select(F.col("e")[0]["canonical"].alias("canonical"), F.array_distinct(F.flatten("e.aliases")).alias("aliases"))


def owners_of(people: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(place, owner) for each of ``people(place, canonical, aliases)`` that the ``dictionary`` (same columns) knows: by its name, else by its first known alias.

    A spelling that several entries have belongs to the first of them.
    """
    names = lambda df: df.select("place", F.posexplode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n", "name")).select("place", "n", identity_key(F.col("name")).alias("key")).where("key <> ''")
    own = names(dictionary).groupBy("key").agg(F.min("place").alias("owner"))
    return names(people).join(own, "key").groupBy("place").agg(F.min_by("owner", "n").alias("owner"))


def best_tags(tags: DataFrame) -> DataFrame:
    """One of ``tags(item_id, name, source, confidence)`` per item and name in any case: a dictionary's before a model's, then the more confident."""
    order = F.struct((F.col("source") != "dictionary").alias("a"), (-F.col("confidence")).alias("b"), F.col("name").alias("c"))
    return tags.groupBy("item_id", F.lower("name").alias("key")).agg(F.min_by(F.struct("name", "source", "confidence"), order).alias("t")).select("item_id", "t.*")


def verdict_changes(items: DataFrame, verdicts: DataFrame, protected: DataFrame, old: str, new: str) -> DataFrame:
    """(id, before, after): what ``verdicts(id, rank, junk)`` change in junk_reason; of several verdicts of an id the one of highest rank counts.

    Junk hides an item that is shown, unless it is ``protected(id)``; no junk shows one that ``old`` hides. What rules hid stays.
    """
    one = verdicts.groupBy("id").agg(F.max_by("junk", "rank").alias("junk"))
    safe = protected.select("id").distinct().withColumn("_safe", F.lit(True))
    rows = items.select("id", F.col("junk_reason").alias("before")).join(one, "id").join(safe, "id", "left")
    hide = F.col("junk") & F.col("before").isNull() & F.col("_safe").isNull()
    show = ~F.col("junk") & (F.col("before") == old)
    return rows.where((hide | show) & ~F.coalesce(F.col("before").like(MECHANICAL), F.lit(False))).select("id", "before", F.when(F.col("junk"), new).alias("after"))


def with_changes(items: DataFrame, changes: DataFrame, undo: bool = False) -> DataFrame:
    """``items`` with junk_reason changed, or changed back, where it still is what the change found."""
    a, b = ("after", "before") if undo else ("before", "after")
    own = changes.select("id", F.col(a).alias("_from"), F.col(b).alias("_to"), F.lit(True).alias("_c"))
    rows = items.join(own, "id", "left")
    return rows.withColumn("junk_reason", F.when(F.coalesce("_c", F.lit(False)) & F.col("junk_reason").eqNullSafe(F.col("_from")), F.col("_to")).otherwise(F.col("junk_reason"))).select(*items.columns)


def open_names(entities: DataFrame, items: DataFrame, source: str = "tier2_ledger") -> DataFrame:
    """``entities`` whose name is no subject of the curated items, in any case."""
    titles = items.where((F.col("source") == source) & F.col("subject").isNotNull()).select(F.lower("subject").alias("_n")).distinct()
    return entities.withColumn("_n", F.lower("canonical_name")).join(titles, "_n", "left_anti").select(*entities.columns)


def names_in(queries: DataFrame, entities: DataFrame, longest: int = 4) -> DataFrame:
    """(query_id, entity_id): entities whose name is a run of two to ``longest`` words of the query's text."""
    t = queries.select("query_id", tokens(F.col("text")).alias("t"))
    grams = reduce(DataFrame.unionByName, [t.where(F.size("t") >= k).select("query_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - k + 1), lambda i: F.array_join(F.slice("t", i, F.lit(k)), " "))).alias("name")) for k in range(2, longest + 1)])
    own = entities.where("coalesce(pending_review, 0) <> 2").select(F.col("id").alias("entity_id"), F.array_join(tokens(F.col("canonical_name")), " ").alias("name"))
    return grams.distinct().join(own, "name").select("query_id", "entity_id").distinct()


def similarity(a: Column, b: Column) -> Column:
    """The share of characters that two texts have in common blocks, as of difflib; null for nulls."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([None if p is None or q is None else SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)])

    return ratio(a, b)


def answer_parts(text: Column) -> tuple[Column, Column, Column, Column]:
    """Body, confidence, its reason, and gaps of an answer in sections; sections may be missing, and the first heading too."""
    head = lambda names: rf"(?im)^[ \t*#]*(?:{names})[ \t*]*:[ \t*]*"
    whole = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\r\n"))
    body = F.regexp_replace(whole, head("CONFIDENCE|GAPS") + r"[\s\S]*\z", "")
    body = F.regexp_replace(body, r"(?im)\A[\s\S]*?" + head("ANSWER")[5:], "")
    said = F.regexp_extract(whole, head("CONFIDENCE") + r"(.*)$", 1)
    level = F.lower(F.regexp_extract(said, r"(?i)^\W*(high|medium|low)\b", 1))
    reason = F.btrim(F.regexp_replace(said, r"(?i)^\W*(?:high|medium|low)\b[\W_]*", ""), F.lit(" \t\r\n()*"))
    listed = F.regexp_extract(whole, head("GAPS") + r"([\s\S]*?)(?=^[ \t*#]*(?:CONFIDENCE|ANSWER)[ \t*]*:|\z)", 1)
    lines = F.transform(F.split(listed, r"\n"), lambda x: F.btrim(F.regexp_replace(x, r"^[\s*•-]+", ""), F.lit(" \t\r")))
    gaps = F.filter(lines, lambda x: (x != "") & ~F.lower(x).isin("none", "none.", "n/a"))
    return F.btrim(body, F.lit(" \t\r\n")), F.when(level == "", "unknown").otherwise(level), reason, gaps


def bounded_batches(rows: DataFrame, text: str, most: int, most_tokens: int, fixed: int = 0) -> DataFrame:
    """``rows`` with batch: one after the other into a batch until it has ``most`` rows or ``most_tokens`` tokens, a third of the characters and one counting as tokens.

    Each partition fills its own batches, whose names hold its number; a text that is too long alone is a batch of its own.
    """
    rows = rows.withColumn("_p", F.spark_partition_id())

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        no, n, used = 0, 0, fixed
        for b in frames:
            out = []
            for p, t in zip(b["_p"], b[text]):
                cost = len(t or "") // 3 + 1
                if n and (n >= most or used + cost > most_tokens):
                    no, n, used = no + 1, 0, fixed
                n, used = n + 1, used + cost
                out.append(f"{p}-{no}")
            yield b.drop(columns="_p").assign(batch=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_p")
    return rows.mapInPandas(fill, f"{schema}, batch string")


def median_threshold(scores: DataFrame, keep_share: float, folds: int = 5) -> DataFrame:
    """One row (threshold): the median over folds of the score above which a ``keep_share`` of the others' kept rows do not lie.

    ``scores(id, score, label)``, label: to be caught. Folds go by the hash of the id; a fold without kept rows says 0.5. Labelled rows are few: each fold is ranked in one task.
    """
    rows = scores.where("score IS NOT NULL AND label IS NOT NULL").withColumn("_f", F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(folds)))
    others = rows.withColumn("fold", F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("_f")))).where("NOT label")
    w = Window.partitionBy("fold")
    ranked = others.select("fold", "score", F.row_number().over(w.orderBy("score")).alias("k"), F.count("*").over(w).alias("n"))
    tau = ranked.where(F.col("k") == F.greatest(F.lit(1), F.ceil(F.col("n") * keep_share - F.lit(1e-9)))).select("fold", (F.col("score") + 1e-9).alias("tau"))
    every = scores.sparkSession.range(folds).select(F.col("id").alias("fold")).join(tau, "fold", "left")
    return every.agg(F.array_sort(F.collect_list(F.coalesce("tau", F.lit(0.5)))).alias("t")).select(F.col("t")[folds // 2].alias("threshold"))


def still_open(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """``rows`` that an interrupted pass has not done yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def campaign(runs: DataFrame) -> DataFrame:
    """One row over ``runs(no, score, kept)``: how many were kept, improved on the best kept one before, or fell below it; the best, and its gain on the first run.

    A campaign is a list of runs made by hand, so it is ordered in one task.
    """
    w = Window.orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    rows = runs.withColumn("_best", F.max(F.when(F.col("kept"), F.col("score"))).over(w))
    first = F.min_by("score", "no")
    return rows.agg(
        F.count("*").alias("n"), F.count_if("kept").alias("kept"), F.count_if(F.col("score") > F.col("_best")).alias("improved"), F.count_if(F.col("score") < F.col("_best")).alias("fell"),
        F.max("score").alias("best"), F.max_by("no", F.struct("score", -F.col("no"))).alias("best_no"), (F.max("score") - first).alias("gain"),
    )


def at_least_gold(scores: DataFrame, group: str, gold: str, score: str) -> DataFrame:
    """(group, n): rows of each group that score at least its row marked ``gold``; groups without one are left out."""
    best = scores.where(gold).groupBy(group).agg(F.max(score).alias("_g"))
    return scores.where(f"NOT {gold}").join(best, group).groupBy(group).agg(F.count_if(F.col(score) >= F.col("_g")).alias("n"))
