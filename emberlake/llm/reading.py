"""Reading level of documents from the acquisition grades of their words.

A word's grade comes from the levels of the rated documents it stands in. A document's level follows
from the quantiles of the grades of its known words, calibrated on the rated documents, each measured
with grades that its own fold of ratings had no part in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.session import stage

LEAST_WORDS = 120
#: Rated documents that the fit takes at most, by smallest hash of the id; all documents are then scored.
MOST_RATED = 20_000
FOLDS = 5
#: A word's grade is drawn to the mean by as much as PRIOR documents of evidence; words below LEAST_SEEN are unknown.
PRIOR, LEAST_SEEN = 1.5, 1.0
RIDGE = 2.0
#: Ratings further than this from the first fit are taken for errors and left out of the second.
STRAY = 1.2
QUANTILES = np.array([0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95])
LEAST_KNOWN = 8

_WORD = re.compile(r"[^\W\d_]+")
_SPEAKER = re.compile(r"^(?:\[\d{1,2}:\d{2}(?::\d{2})?\] ?)?(?:[^\W\d_]+: )?(?=\S)")
_TIMED = re.compile(r"^\[\d{1,2}:\d{2}(?::\d{2})?\] ")
_QUOTE = re.compile(r"^(?:[>|] ?)+(?=[^|]*$)")
_FENCE = re.compile(r"^(?:```|~~~)")
_PASTED = re.compile(
    r"^(?:\||#|---|===|\d{4}-\d{2}-\d{2}[T ]\d|\[[^\]]*\d\] |[+-] ?\w+ ?=|(?:[-*+•]|\d+[.)]) (?:\S+ ?){1,5}$"
    r"|(?:subject|from|to|cc|date|sent|created|tags|attendees|author|title|emne|fra|til|dato)\s?:|[\w.]+\(.*\)|[{}<>;]|(?:def|class|import|return|if|for) .*[:;{]$)",
    re.I,
)


def prose_words(text: str) -> list[str]:
    """The lower-case words of the running text; logs, tables, lists, code, headers and headings have none."""
    words: list[str] = []
    fenced = False
    for line in text.replace("\r", "\n").split("\n"):
        line = line.strip()
        if _FENCE.match(line):
            fenced = not fenced
            continue
        if fenced or not line:
            continue
        line = _QUOTE.sub("", line)
        bare = _SPEAKER.sub("", line, count=1) if _TIMED.match(line) or ": " in line[:24] else line
        if _PASTED.match(line) and not _TIMED.match(line) or _PASTED.match(bare):
            continue
        words += _WORD.findall(bare.lower())
    return words


def _features(grades: np.ndarray) -> np.ndarray:
    grades = np.sort(grades)
    at = QUANTILES * (len(grades) - 1)
    low = at.astype(int)
    high = np.minimum(low + 1, len(grades) - 1)
    return np.append(grades[low] + (grades[high] - grades[low]) * (at - low), grades.mean())


def _measure(text: str | None, grades: dict[str, float], middle: float) -> np.ndarray:
    known = [grades[w] for w in prose_words(text or "") if w in grades]
    return _features(np.array(known if len(known) >= LEAST_KNOWN else [*known, *[middle] * (LEAST_KNOWN - len(known))]))


def _grades(stats: pd.DataFrame, but: int | None = None) -> tuple[dict[str, float], float]:
    """Each known word's grade from per-fold sums (word, fold, levels, seen), without those of fold ``but``."""
    part = stats if but is None else stats[stats["fold"] != but]
    middle = part["levels"].sum() / max(part["seen"].sum(), 1e-9)
    total = part.groupby("word")[["levels", "seen"]].sum()
    total = total[total["seen"] >= LEAST_SEEN]
    return ((total["levels"] + PRIOR * middle) / (total["seen"] + PRIOR)).to_dict(), middle


def fit(documents: DataFrame, labels: DataFrame, most_rated: int = MOST_RATED) -> dict:
    """Word grades and calibration from at most ``most_rated`` rated documents.

    Ratings of one document are averaged, null ones left out. Work on texts is Spark's; the driver gets
    the sums per word and fold, and a dozen figures per rated document, both bounded by ``most_rated``.
    Raises ValueError where no rated document has text.
    """
    spark = documents.sparkSession
    level = labels.where("reading_level IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg("reading_level").alias("level"))
    level = level.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rated).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS)).cast("int"))
    rated = stage(documents.where("text IS NOT NULL").select("doc_id", "text").join(level, "doc_id"), "rated")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text, y, fold in zip(b["text"], b["level"], b["fold"]):
                words = prose_words(text)
                for w, n in zip(*np.unique(words, return_counts=True)):
                    rows.append((str(w), fold, y, min(1.0, 50.0 * n / len(words))))
            yield pd.DataFrame(rows, columns=["word", "fold", "level", "seen"])

    def sums(rows: DataFrame) -> pd.DataFrame:
        per_word = rows.mapInPandas(counted, "word string, fold int, level double, seen double")
        return per_word.groupBy("word", "fold").agg(F.sum(F.col("level") * F.col("seen")).alias("levels"), F.sum("seen").alias("seen")).toPandas()

    def calibrate(rows: DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
        stats = sums(rows)
        if stats.empty:
            raise ValueError("no rated document has text")
        per_fold = spark.sparkContext.broadcast({k: _grades(stats, k) for k in range(FOLDS)})

        def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"doc_id": b["doc_id"], "level": b["level"], "x": pd.Series([_measure(t, *per_fold.value[f]).tolist() for t, f in zip(b["text"], b["fold"])], dtype=object)})

        table = rated.mapInPandas(measured, "doc_id long, level double, x array<double>").toPandas().sort_values("doc_id")
        return stats, table["doc_id"].to_numpy(), np.stack(table["x"].to_numpy()), table["level"].to_numpy()

    def solve(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mean, scale = x.mean(0), x.std(0) + 1e-9
        z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
        penalty = RIDGE * np.eye(z.shape[1])
        penalty[-1, -1] = 0
        return np.linalg.solve(z.T @ z + penalty, z.T @ y), mean, scale

    _, ids, x, y = calibrate(rated)
    weights, mean, scale = solve(x, y)
    sure = np.abs(np.column_stack([(x - mean) / scale, np.ones(len(x))]) @ weights - y) <= STRAY
    good = spark.createDataFrame(pd.DataFrame({"doc_id": ids[sure]}), "doc_id long")
    stats, ids, x, y = calibrate(rated.join(F.broadcast(good), "doc_id", "left_semi"))
    weights, mean, scale = solve(x[sure], y[sure])
    grades, middle = _grades(stats)
    return {"grades": grades, "middle": middle, "weights": weights, "mean": mean, "scale": scale, "low": int(y.min()), "high": int(np.ceil(y.max()))}


def reading_levels(documents: DataFrame, labels: DataFrame, least_words: int = LEAST_WORDS, most_rated: int = MOST_RATED) -> DataFrame:
    """(doc_id, reading_level, score) of every document of at least ``least_words`` words.

    Words are parted by white space for that count. Null texts have none. A document none of whose words
    is known gets the middle level.
    """
    model = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, most_rated))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for b in batches:
            x = np.array([_measure(t, m["grades"], m["middle"]) for t in b["text"]]).reshape(len(b), len(QUANTILES) + 1)
            s = ((x - m["mean"]) / m["scale"]) @ m["weights"][:-1] + m["weights"][-1]
            yield pd.DataFrame({"doc_id": b["doc_id"], "reading_level": np.clip(np.rint(s), m["low"], m["high"]).astype(np.int32), "score": s})

    n_words = F.size(F.split(F.trim(F.regexp_replace("text", r"[ \t\r\n]+", " ")), " "))
    return documents.where(F.col("text").isNotNull() & (n_words >= least_words)).select("doc_id", "text").mapInPandas(score, "doc_id long, reading_level int, score double")


def level_profile(levels: DataFrame, documents: DataFrame) -> DataFrame:
    """(source, reading_level, n_docs): how demanding each source is."""
    return levels.join(documents.select("doc_id", "source"), "doc_id").groupBy("source", "reading_level").agg(F.count("*").alias("n_docs"))
