"""Language identification with blended-spectrum string kernels.

Two texts' kernel is the number of character n-grams (lengths 1 to ``GRAMS``,
letters and single blanks only, hashed to ``WIDTH`` values) present in both,
divided by the root of the product of their own numbers.  Nystroem landmarks, a
bounded sample of the labelled rows, span the feature space; one ridge regression
per language is solved in it.  As the kernel is a product of presence vectors, the
landmarks' coefficients fold into one weight per n-gram and language, and scoring
is a product of a batch of presence rows and that matrix.

Texts that are null or have no letter get ``und`` and score 0.  The other scores
are (margin + 1) / 2 of the best language, clipped to 0..1; ties go to the first
language by name.  Without any labelled row every text gets ``und``.  Rows are
scored one by one, so repeated rows agree.  Rows with a null id are never learned
from and count as not held out.  Other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilframe.llm.common import bound_batches, give_back, map_rows, table

WIDTH = 1 << 16
GRAMS = 3


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)], bool)


def presence(text: str) -> np.ndarray | None:
    """Boolean row of the n-grams in a whole text; None without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), "<u4")
    letter = _letters()[points]
    if not letter.any():
        return None
    points = np.where(letter, points, 32).astype(np.uint64)
    points = points[letter | np.concatenate([[True], letter[:-1]])]
    row = np.zeros(WIDTH, bool)
    gram = np.zeros(len(points), np.uint64)
    for n in range(min(GRAMS, len(points))):
        gram = gram[: len(points) - n] * np.uint64(0x110001) + points[n:]
        row[((gram + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)] = True
    return row


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray

    def margins(self, rows: np.ndarray) -> np.ndarray:
        own = np.sqrt(np.maximum(rows.sum(axis=1), 1))
        return (rows.astype(np.float32) @ self.weights) / own[:, None] + self.bias


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, landmarks: int = 40, most_rows: int = 40_000, ridge: float = 1e-3) -> Model:
    """Learn from at most ``per_language`` rows of every language, chosen by a hash of the
    id; the first ``landmarks`` of each are the landmarks.

    Beyond ``most_rows`` rows in all, each language gives fewer rows and landmarks, one at
    least, so that the driver's share stays bounded while no language is left out.  Only rows that are not held out and have a language count.  The bounded sample's
    presence rows (8 KB each) are what reaches the driver.
    """
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}") & F.col(id_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    names = tuple(sorted(counts))
    if not names:
        return Model((), np.zeros((WIDTH, 0), np.float32), np.zeros(0, np.float32))
    per_language = max(1, min(per_language, most_rows // len(names)))
    landmarks = max(1, min(landmarks, most_rows // 10 // len(names)))
    share = F.create_map(*[F.lit(x) for n in names for x in (n, 1.2 * per_language / counts[n])])
    order = F.xxhash64(F.col(id_col).cast("long"))
    wanted = share[F.col(lang_col)]
    # With few rows a language the share could miss one; the ranks then bound them alone.
    near = rows if per_language < 100 else rows.where(F.pmod(order, F.lit(1 << 20)) < wanted * (1 << 20))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("order", F.md5("text")))
    picked = near.select(order.alias("order"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).withColumn("place", place).where(F.col("place") <= per_language).drop("place")

    def pack(slices):
        for part in slices:
            yield [(o, lang, np.packbits(row).tobytes()) for o, lang, text in part if (row := presence(text)) is not None]

    sample = sorted(map_rows(picked, pack, "order long, lang string, bits binary").collect())
    bits = np.frombuffer(b"".join(r[2] for r in sample), np.uint8).reshape(len(sample), WIDTH // 8)
    of = np.array([names.index(r[1]) for r in sample])
    root = np.sqrt(np.bitwise_count(bits).sum(axis=1, dtype=np.float64))
    chosen = np.concatenate([np.flatnonzero(of == c)[:landmarks] for c in range(len(names))])
    # Unpacked a few rows at a time, so that the driver holds little more than the landmarks.
    marks = np.unpackbits(bits[chosen], axis=1).astype(np.float32)
    marks /= root[chosen, None].astype(np.float32)
    kernel = np.concatenate([np.unpackbits(bits[i : i + 32], axis=1).astype(np.float32) @ marks.T for i in range(0, len(bits), 32)]).astype(np.float64) / root[:, None]
    values, vectors = np.linalg.eigh(kernel[chosen])
    inverse_root = vectors / np.sqrt(np.maximum(values, 1e-8)) @ vectors.T
    features = np.column_stack([kernel @ inverse_root, np.ones(len(bits))])
    target = np.where(of[:, None] == np.arange(len(names)), 1.0, -1.0)
    penalty = ridge * len(bits) * np.eye(features.shape[1])
    penalty[-1, -1] = 0
    solved = np.linalg.solve(features.T @ features + penalty, features.T @ target)
    return Model(names, marks.T @ (inverse_root @ solved[:-1]).astype(np.float32), solved[-1].astype(np.float32))


def predicted(text: Column, model: Model, spark: SparkSession, batch: int = 64) -> Column:
    """``struct<lang_pred, score, grams, evidence>`` of a text; only the text decides.

    ``grams``: how many n-grams it has; ``evidence``: by how much they raise the best
    language's margin above that of a text about which nothing is known.
    """
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, grams long, evidence double")
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for series in texts:
            names, (scores, grams, evidence) = ["und"] * len(series), np.zeros((3, len(series)))
            for start in range(0, len(series), batch):
                some = series.iloc[start : start + batch].tolist()
                held = [presence(text) if text and model.languages else None for text in some]
                if at := [i for i, row in enumerate(held) if row is not None]:
                    rows = np.array([held[i] for i in at])
                    margins = model.margins(rows)
                    where = np.array(at) + start
                    grams[where], evidence[where] = rows.sum(axis=1), (margins - model.bias).max(axis=1)
                    for i, m in zip(at, margins, strict=True):
                        names[start + i], scores[start + i] = model.languages[int(m.argmax())], min(1.0, max(0.0, (float(m.max()) + 1) / 2))
            yield pd.DataFrame({"lang_pred": names, "score": scores, "grams": grams.astype(np.int64), "evidence": evidence})
        give_back()

    # Else a filter on the result could make Spark compute it twice.
    return judge.asNondeterministic()(text.cast("string"))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, held_out, lang_pred, score)`` for every row."""
    chosen = docs.select(F.col(id_col).cast("long").alias(id_col), held_out(id_col).alias("held_out"), predicted(F.col(text_col), model, docs.sparkSession).alias("p"))
    return chosen.select(id_col, "held_out", "p.lang_pred", "p.score")


def op5_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
