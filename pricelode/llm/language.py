"""Language identification by hierarchical discrimination.

First the family of a text's language is predicted, by linear support vector
machines between pairs of families; then machines between pairs of the
languages of that family decide among close relatives. Features are hashed
character n-grams within words, lengths 1 to 4.

Machines are fitted on the driver on the feature vectors of a bounded sample of
labelled texts, SAMPLE_PER_LANGUAGE whole texts of each language.
"""

import itertools
import pickle
import re

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import small_batches, table

# Families of languages by ISO 639-1 code. Others are families of their own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nl nn no sv yi",
    "romance": "ca co es fr gl it la oc pt rm ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "celtic": "br cy ga gd",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "dravidian": "kn ml ta te",
    "sinitic": "zh",
    "semitic": "am ar he mt",
    "austronesian": "id jv mg ms su tl",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

DIMS = 4_096
SAMPLE_PER_LANGUAGE = 600
STRENGTH = 1e-4
STEPS = 120
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_PLAIN_WORD = re.compile(r"(?<!\w)[^\W\d_]+(?!\w)")
#: The share of a profile that all n-grams have evenly.
EVEN = 0.02
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint64)
# ASCII bytes other than letters become spaces; bytes of other characters stay.
_KEEP = np.array([b if chr(b).isalpha() or b >= 128 else 32 for b in range(256)], dtype=np.uint8)


def ngram_counts(text):
    """Counts of the hashed byte n-grams of a text, square-rooted and scaled to length 1."""
    raw = _KEEP[np.frombuffer((" " + text.lower() + " ").encode(), dtype=np.uint8)]
    # A run of spaces counts once.
    raw = raw[np.append(True, (raw[1:] != 32) | (raw[:-1] != 32))].astype(np.uint64)
    counts = np.zeros(DIMS)
    code = np.zeros(len(raw), dtype=np.uint64)
    for n, factor in enumerate(_FACTORS, 1):
        if len(raw) < n:
            break
        code = code[: len(raw) - n + 1] * np.uint64(256) + raw[n - 1 :]
        slots = ((code + np.uint64(n)) * factor & np.uint64(0xFFFFFFFF)) >> np.uint64(20)
        counts += np.bincount(slots.astype(np.int64), minlength=DIMS)
    counts = np.sqrt(counts)
    return (counts / (np.sqrt((counts**2).sum()) or 1.0)).astype(np.float32)


def word_share(text):
    """Of a text's characters but white space, the share in words of nothing but letters."""
    return sum(map(len, _PLAIN_WORD.findall(text))) / max(1, len("".join(text.split())))


def fit_machine(x, y, strength=STRENGTH, steps=STEPS):
    """Weights and offset of a linear support vector machine: squared hinge loss, by accelerated gradient steps.

    y is 1 or -1; both sides count the same in total.
    """
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    rate = 1.0 / (2 * 2.0 + strength)  # rows and the offset's 1 have a squared length of 2
    w = ahead = np.zeros(x.shape[1] + 1)
    for k in range(steps):
        slack = np.maximum(0.0, 1 - y * (x @ ahead[:-1].astype(np.float32) + ahead[-1]))
        pull = weight * slack * y
        gradient = strength * ahead - 2 * np.append(pull.astype(np.float32) @ x, pull.sum())
        new = ahead - rate * gradient
        ahead, w = new + k / (k + 3) * (new - w), new
    return w.astype(np.float32)


class Machines:
    """One-versus-one machines among named classes; the class with most votes wins, margins part ties."""

    def __init__(self, x, labels, names):
        self.names, self.pairs, weights = names, list(itertools.combinations(range(len(names)), 2)), []
        for a, b in self.pairs:
            some = (labels == a) | (labels == b)
            weights.append(fit_machine(x[some], np.where(labels[some] == a, 1.0, -1.0)))
        self.weights = np.array(weights, dtype=np.float32)

    def decide(self, x):
        """Class number and confidence of each row: the least of the winner's own chances in its duels."""
        if not self.pairs:
            return np.zeros(len(x), dtype=np.int64), np.ones(len(x))
        margins = x @ self.weights[:, :-1].T + self.weights[:, -1]
        chance = 1 / (1 + np.exp(-4.0 * margins))
        votes = np.zeros((len(x), len(self.names)))
        worst = np.ones((len(x), len(self.names)))
        for k, (a, b) in enumerate(self.pairs):
            votes[:, a] += (margins[:, k] >= 0) + 1e-3 * chance[:, k]
            votes[:, b] += (margins[:, k] < 0) + 1e-3 * (1 - chance[:, k])
            worst[:, a] = np.minimum(worst[:, a], chance[:, k])
            worst[:, b] = np.minimum(worst[:, b], 1 - chance[:, k])
        best = votes.argmax(axis=1)
        return best, worst[np.arange(len(x)), best]


class LanguageModel:
    """Families first, then the languages of the predicted family."""

    def __init__(self, vectors, langs):
        x = np.array(vectors, dtype=np.float32).reshape(-1, DIMS)
        langs = np.array(langs, dtype=object)
        self.families = sorted({FAMILY_OF.get(code, code) for code in langs})
        family = np.array([self.families.index(FAMILY_OF.get(code, code)) for code in langs], dtype=np.int64)
        self.top = Machines(x, family, self.families)
        self.profiles = {code: self._profile(x[langs == code]) for code in set(langs)}
        self.within = []
        for number in range(len(self.families)):
            some = family == number
            names = sorted(set(langs[some]))
            self.within.append(Machines(x[some], np.array([names.index(code) for code in langs[some]], dtype=np.int64), names))

    @staticmethod
    def _profile(x):
        """Per n-gram slot, the log of its share in a language over an even share, scaled to 1 on average over the training texts."""
        shares = (x.astype(np.float64) ** 2).mean(axis=0)
        gain = np.log((1 - EVEN) * shares / (shares.sum() or 1.0) * DIMS + EVEN)
        return gain / max(1e-6, (x.astype(np.float64) ** 2 @ gain).mean())

    def predict(self, texts):
        """Language and score of each text; null texts and texts without a letter are unknown."""
        return self.judge(texts)[:2]

    def judge(self, texts):
        """Language, score and evidence of each text.

        Evidence says how much likelier the text's n-grams are in its language
        than in even noise: about 1 for texts like those learnt from, about 0
        for noise, below 0 for other alphabets. It does not depend on how many
        languages there are.
        """
        names, scores, evidence = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        rows = [k for k, t in enumerate(texts) if t and _LETTER.search(t)] if self.families else []
        if rows:
            x = np.array([ngram_counts(texts[k]) for k in rows], dtype=np.float32)
            family, chance = self.top.decide(x)
            for number, machines in enumerate(self.within):
                some = np.flatnonzero(family == number)
                if len(some):
                    best, own = machines.decide(x[some])
                    for k, b, c in zip(some.tolist(), best.tolist(), (own * chance[some]).tolist(), strict=True):
                        names[rows[k]], scores[rows[k]] = machines.names[b], c
                        evidence[rows[k]] = x[k].astype(np.float64) ** 2 @ self.profiles[machines.names[b]]
        return names, scores, evidence


def fit_languages(docs, learn, id_col="doc_id", text_col="text", lang_col="lang", per_language=SAMPLE_PER_LANGUAGE):
    """A LanguageModel from rows for which the column learn is true and language and text are given.

    At most `per_language` texts of a language are learnt from, chosen by a hash
    of the id; of equal draws those with the smaller vectors. Repeated rows are
    drawn together or not at all, null ids all alike. Without such rows the model
    knows no language. Further columns are not read.
    """
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.col(text_col) != ""))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageModel([], [])
    # Rows by their hash: about twice as many as wanted are ranked per language.
    draw = F.xxhash64(F.col(id_col), F.lit(11))
    pick = F.lit(False)
    for lang, n in sorted(sizes.items()):
        pick = pick | ((F.col(lang_col) == lang) & (F.pmod(draw, F.lit(max(1, n // (2 * per_language)))) == 0))
    some = rows.where(pick).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.lit(12)).alias("draw"))
    small_batches(docs.sparkSession)

    def vectors(batches):
        for batch in batches:
            yield pd.DataFrame({"lang": batch["lang"], "draw": batch["draw"], "vector": [ngram_counts(t).astype(np.float16).tobytes() for t in batch["text"]]})

    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "vector"))
    some = some.mapInPandas(vectors, "lang string, draw long, vector binary").withColumn("rank", rank).where(F.col("rank") <= per_language)

    def fit(frame):
        frame = frame.sort_values(["lang", "vector"])
        model = LanguageModel([np.frombuffer(v, dtype=np.float16) for v in frame["vector"]], frame["lang"].tolist())
        return pd.DataFrame({"model": [pickle.dumps(model)]})

    # The bounded sample is fitted in one task; the driver gets weights alone.
    (row,) = some.select("lang", "vector", F.lit(1).alias("all")).groupBy("all").applyInPandas(fit, "model binary").collect()
    return pickle.loads(bytes(row["model"]))


def identify_languages(docs, model, text_col="text", grounds=False):
    """The columns of docs but the text, and lang_pred and score (0 to 1); nothing but the text decides.

    With grounds also evidence (LanguageModel.judge) and word_share, 0 for null texts.

    Null texts and texts without a letter are `und` with score 0. Columns of
    docs that have a result's name, in whatever case, make way for it. Repeated rows are judged
    alike, an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    inner = "_" + "_".join(docs.columns)  # a name that no column has

    def run(batches):
        for batch in batches:
            texts = batch[inner].tolist()
            names, scores, evidence = shared.value.judge(texts)
            out = batch.drop(columns=inner).assign(lang_pred=names, score=scores)
            yield out.assign(evidence=evidence, word_share=[word_share(t or "") for t in texts]) if grounds else out

    results = ["lang_pred string", "score double", *(["evidence double", "word_share double"] if grounds else [])]
    taken = {text_col.lower(), *(r.split()[0] for r in results)}  # Spark's names don't tell cases apart
    kept = [c for c in docs.columns if c.lower() not in taken]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col).alias(inner))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != inner]
    return rows.mapInPandas(run, ", ".join([*kinds, *results]))


def fold(id_col="doc_id"):
    """The remainder by 4 of the CRC-32 of an id's text; 2 is held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def op4_hierarchical_svm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold() == 2, F.lit(False))
    model = fit_languages(docs, ~held_out)
    return identify_languages(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
