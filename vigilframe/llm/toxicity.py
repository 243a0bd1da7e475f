"""Toxicity scores from gradient-boosted trees over dense features.

The features of a whole text are densities of a lexicon, of its obfuscated
spellings and of learned stems, the share of its hits with a second-person word
close by, capitals, punctuation and repeated marks.  Stems are beginnings of words
that labelled toxic texts hold far more often than others, so they reach languages
that the lexicon does not.  Stems and boosted trees are learned from a bounded
sample of labelled rows and calibrated by isotonic regression on labelled rows
that neither saw.

Null texts count as empty; an empty text has all features 0 and a score like any
other.  Labels that are null are ignored.  Repeated rows get equal scores.  With
no label of one of the two classes every score is the share of label 1 (0 without
labels).  Rows with a null id are scored, not learned from, and count as not held
out.  Of rows that share an id the smallest text is learned from.  Other columns
are not read.
"""

from __future__ import annotations

import functools
import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.llm.common import cut, map_rows, table

#: Insults and slights, in the languages of the corpus.
LEXICON = frozenset(
    "abomination arrogant awful bastard bigot brainless braindead bitch buffoon clown clueless coward creep cretin crap damn deplorable "
    "despicable dimwit dirtbag disgrace disgusting donkey dork dumb dumbass dunce evil failure fat filth filthy fool foolish fraud freak garbage "
    "hate hateful hideous horrible hypocrite idiot idiotic idiots ignorant imbecile incompetent jerk junk kill lame lazy liar loathsome loser losers "
    "lunatic maggot miserable monster moron moronic morons nasty nobody parasite pathetic pest phony pig psycho rat revolting ridiculous rotten "
    "rubbish scum scumbag shameful shit shut sick simpleton sleazy slime slob snake stink stinking stupid stupidity suck sucks swine terrible "
    "thug toxic traitor trash troll ugly useless vermin vile weak wicked worthless wretch wretched "
    "arschloch blöd blödmann depp dreck dumm dummkopf ekelhaft feigling idioten mistkerl scheiße trottel versager wertlos widerlich "
    "abruti con connard crétin débile dégoûtant imbécile minable nul ordure pathétique raté salaud stupide "
    "asqueroso basura estúpido gilipollas imbécil inútil patético payaso perdedor tonto".split()
)
#: Second-person words.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine sie ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
NEAR = 6
#: Characters written for letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "*": "", "_": "", "-": "", ".": ""})
_MARKS = str.maketrans({c: " " for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»„“”’‘…–—|"})
_REPEATED = re.compile(r"([!?#$%&*.])\1+")
NAMES = ("words", "hits", "hit_share", "hit_kinds", "near_share", "near_hits", "obfuscated", "obfuscated_share", "capitals", "shouted", "exclaims", "questions", "marks", "repeats", "word_length", "stem_hits", "stem_share", "stem_kinds")
STEM_LENGTHS = (4, 5, 6, 7)


def stems_of(text: str) -> set[str]:
    return {w[:n] for w in set(text.lower().translate(_MARKS).split()) for n in STEM_LENGTHS if len(w) >= n}


def learn_stems(rows: DataFrame, most: int = 200, certainty: float = 5.0, lift: float = 4.0) -> frozenset[str]:
    """The ``most`` stems that toxic texts of ``rows(text, label)`` hold far more often than others.

    Counts are of texts; a stem must exceed its expected count by ``certainty``
    standard deviations and be ``lift`` times as frequent in toxic texts.
    """

    def count(slices):
        counts: dict[str, list[int]] = {}
        for part in slices:
            for text, label in part:
                for stem in stems_of(text or ""):
                    counts.setdefault(stem, [0, 0])[int(label >= 0.5)] += 1
        made = [(stem, c, t) for stem, (c, t) in counts.items()]
        yield from (made[i : i + 50_000] for i in range(0, len(made), 50_000))

    sizes = {r[0]: r[1] for r in rows.groupBy((F.col("label") >= 0.5).alias("toxic")).count().collect()}
    toxic, clean = sizes.get(True, 0), sizes.get(False, 0)
    if not toxic or not clean:
        return frozenset()
    found = map_rows(rows.select("text", "label"), count, "stem string, clean long, toxic long").groupBy("stem").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    expected = (F.col("t") + F.col("c")) * (toxic / (toxic + clean))
    times = (F.col("t") / toxic) / ((F.col("c") + 1) / clean)
    score = (F.col("t") - expected) / F.sqrt(expected + 0.5)
    best = found.withColumns({"score": score, "times": times}).where((F.col("score") >= certainty) & (F.col("times") >= lift)).orderBy(F.desc("score"), "stem").limit(most)
    return frozenset(r[0] for r in best.select("stem").collect())


def _begun(words: list[str], stems: frozenset[str]) -> list[str]:
    """Words that begin with a stem; words whose first letters no stem has cost one look-up."""
    short = STEM_LENGTHS[0]
    heads = _heads(stems)
    return [w for w in words if w[:short] in heads and any(w[:k] in stems for k in STEM_LENGTHS)]


@functools.lru_cache(maxsize=4)
def _heads(stems: frozenset[str]) -> frozenset[str]:
    return frozenset(s[: STEM_LENGTHS[0]] for s in stems)


def features(text: str, stems: frozenset[str] = frozenset()) -> list[float]:
    """The dense features of a whole text, in the order of ``NAMES``."""
    low = text.lower()
    words = low.translate(_MARKS).split()
    n, size = len(words), max(len(text), 1)
    at = [i for i, w in enumerate(words) if w in LEXICON]
    near = sum(any(w in SECOND for w in words[max(0, i - NEAR) : i + NEAR + 1]) for i in at)
    hidden = sum(w.translate(LEET).rstrip("i") in LEXICON or w.translate(LEET) in LEXICON for w in low.split() if not w.isalpha() and any(c.isalpha() for c in w))
    plain = sum(w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") in LEXICON for w in low.split() if not w.isalpha()) if hidden else 0
    obfuscated = max(0, hidden - plain)
    capitals = size - len(text.translate(_NO_CAPITALS)) if text else 0
    shouted = sum(w.isupper() and len(w) > 2 for w in text.split()) if capitals else 0
    begun = _begun(words, stems) if stems else []
    bang, ask = text.count("!"), text.count("?")
    marks = size - len(text.translate(_NO_MARKS)) if text else 0
    return [
        float(n),
        float(len(at)),
        len(at) / max(n, 1),
        float(len({words[i] for i in at})),
        near / max(len(at), 1),
        float(near),
        float(obfuscated),
        obfuscated / max(n, 1),
        capitals / size,
        shouted / max(n, 1),
        bang / size,
        ask / size,
        marks / size,
        len(_REPEATED.findall(text)) / max(n, 1),
        sum(map(len, words)) / max(n, 1),
        float(len(begun)),
        len(begun) / max(n, 1),
        float(len(set(begun))),
    ]


_NO_CAPITALS = {i: None for i in range(0x250) if chr(i).isupper()}
_NO_MARKS = {ord(c): None for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"}


def _fold(id_col: str, n: int = 5) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def held_out(id_col: str) -> Column:
    return F.coalesce(_fold(id_col) == 0, F.lit(False))


def dense(docs: DataFrame, id_col: str, text_col: str, stems: frozenset[str]) -> DataFrame:
    def rows(slices):
        for part in slices:
            yield [(doc, out_of, features(text or "", stems)) for doc, out_of, text in part]

    chosen = docs.select(F.col(id_col).cast("long"), held_out(id_col), F.col(text_col).cast("string"))
    return map_rows(chosen, rows, "doc_id long, held_out boolean, dense array<double>").withColumn("features", array_to_vector("dense"))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = 20_000, trees: int = 20, depth: int = 4, seed: int = 7) -> DataFrame:
    """``(id, held_out, score, predicted)`` for every row; only the text decides.

    The model is learned from at most about ``most`` labelled rows that are not
    held out, chosen by a hash of the id; a quarter of them calibrates it.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label"))
    n = known.count()
    order = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30))
    # At most ``most`` rows of two numbers by choice, so this side may be broadcast.
    sample = known.where(order < (1 << 30) * min(1.0, most / max(n, 1))).groupBy("doc_id").agg(F.max("label").alias("label"))
    learned = docs.join(F.broadcast(sample.limit(2 * most)), docs[id_col] == sample["doc_id"], "left_semi")
    texts = cut(learned.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).groupBy("doc_id").agg(F.min("text").alias("text")).join(F.broadcast(sample.limit(2 * most)), "doc_id"))
    calibrating = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(4)) == 0
    stems = learn_stems(texts.where(~calibrating))
    rows = cut(dense(texts, "doc_id", "text", stems).select("doc_id", "features").join(texts.select("doc_id", "label"), "doc_id"))
    train, check = rows.where(~calibrating), rows.where(calibrating)
    classes = {r[0]: r[1] for r in train.groupBy("label").count().collect()}
    scored = dense(docs, id_col, text_col, stems)
    if len(classes) < 2 or check.isEmpty():
        value = F.lit(float(classes.get(1.0, 0)) / max(sum(classes.values()), 1))
    else:
        model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=seed).fit(train)
        first = vector_to_array("probability")[1].alias("first")
        iso = IsotonicRegression(featuresCol="first").fit(model.transform(check).select(first, "label"))
        scored = iso.transform(model.transform(scored.select("doc_id", "held_out", "features")).select("doc_id", "held_out", first))
        # Isotonic steps are flat; the trees' own order shows within a step.
        value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.98 * F.col("prediction") + 0.02 * F.col("first")))
    return scored.select(F.col("doc_id").alias(id_col), "held_out", value.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
