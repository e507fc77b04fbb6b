"""Language identification by hierarchical discrimination.

Features are hashed byte n-grams (1 to 4 bytes) of the lower-cased text, as shares of the text. First
one linear support vector machine per family says which language family a text is of; inside the
family, one machine per pair of languages votes, and the sum of margins decides ties. Machines are
fitted in parallel, one task each, on a bounded sample: about SAMPLE rows of each language by a hash of
their ids, and about SIDE rows on each side of a machine. Prediction covers every whole text.

Cases: null texts and texts without a letter are `und` with score 0; so is everything if nothing could
be learned. With one language only, that is the answer for each text with a letter. A language code that
FAMILIES lacks is a family of its own. Null languages and null ids are never learned from. Repeated rows
are predicted alike; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1 << 13
SAMPLE, SIDE = 1_000, 2_000
MAX_LANGUAGES = 1_000
ROUNDS, COST = 150, 100.0

# Families of language codes.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "bs", "sl"],
    "turkic": ["tr", "az", "kk", "ky", "uz", "tt", "tk"],
    "uralic": ["fi", "et", "hu"],
    "indic": ["hi", "bn", "ur", "pa", "gu", "mr", "ne", "si"],
    "semitic": ["ar", "he", "mt", "am"],
    "malayic": ["id", "ms", "jv", "tl"],
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(51)  # 64 - 13 bits


def family_of(lang: str) -> str:
    return _FAMILY.get(lang, f"only {lang}")


def places(text: str) -> np.ndarray:
    """Hashed places of all byte n-grams."""
    b = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint64)
    grams, now = [b + np.uint64(1)], b + np.uint64(1)
    for _ in range(3):
        if len(now) < 2:
            break
        now = (now[:-1] << np.uint64(9)) + b[len(b) - len(now) + 1:] + np.uint64(1)
        grams.append(now)
    return ((np.concatenate(grams) * _MIX) >> _SHIFT).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _shares(text: str) -> np.ndarray:
    at = places(text)
    return np.sqrt(np.bincount(at, minlength=DIMENSIONS) / max(len(at), 1)).astype(np.float32)


def fit_machine(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with squared hinge loss; y is 1 or -1, both sides weigh alike."""
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * COST
    w, b = np.zeros(x.shape[1]), 0.0
    v, vb, step, t = w.copy(), b, 1.0 / (1.0 + 2 * COST), 1.0
    for _ in range(ROUNDS):  # accelerated gradient steps; rows have length 1, so the step is safe
        slack = np.maximum(0.0, 1 - y * (x @ v + vb)) * weight * y
        new, nb = v - step * (v - 2 * (x.T @ slack)), vb + step * 2 * slack.sum()
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / after * (new - w), nb + (t - 1) / after * (nb - b)
        w, b, t = new, nb, after
    return w, b


def machines(langs: list[str]) -> list[tuple[str, str, str]]:
    """(kind, a, b): family a against all others, or language a against b of one family."""
    families = sorted({family_of(x) for x in langs})
    out = [("family", f, "") for f in families] if len(families) > 1 else []
    for f in families:
        out += [("pair", a, b) for a, b in combinations(sorted(x for x in langs if family_of(x) == f), 2)]
    return out


def learn(docs: DataFrame, may_learn: Column) -> dict:
    """The machines, from documents with a language of which `may_learn` (over doc_id) holds."""
    spark = docs.sparkSession
    known = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & may_learn
                                                      & F.rlike("text", F.lit(r"\p{L}")))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs = sorted(counts)
    wanted = machines(langs)
    if not wanted:
        return {"langs": langs, "machines": []}
    sizes = {f: sum(min(counts[x], SAMPLE) for x in langs if family_of(x) == f) for f in {family_of(x) for x in langs}}
    rows = []  # machine, language, side, share of the language's rows that it takes
    for m, (kind, a, b) in enumerate(wanted):
        for lang in langs:
            f = family_of(lang)
            side = (1 if f == a else -1) if kind == "family" else 1 if lang == a else -1 if lang == b else 0
            if side:
                total = sum(n for g, n in sizes.items() if (g == a) == (side > 0)) if kind == "family" else SIDE
                rows.append((m, lang, side, min(1.0, SAMPLE / counts[lang] * min(1.0, SIDE / max(total, 1)))))
    uses = F.broadcast(spark.createDataFrame(rows, "machine int, lang string, side int, share double"))
    u = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("language")), 12) / float(1 << 52)
    sample = known.join(uses, "lang").where(u < F.col("share")).select("machine", "doc_id", "side", "text")

    def train(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "text"])
        x = np.stack([_shares(t) for t in group["text"]])
        w, b = fit_machine(x, group["side"].to_numpy(float))
        return pd.DataFrame({"machine": [int(group["machine"].iloc[0])], "w": [w.tolist()], "b": [b]})

    fitted = {r["machine"]: r for r in sample.groupBy("machine").applyInPandas(train, "machine int, w array<double>, b double").collect()}
    return {"langs": langs, "machines": [(*wanted[m], np.array(r["w"]), r["b"]) for m, r in sorted(fitted.items())]}


def decide(margins: np.ndarray, model: dict) -> tuple[str, float]:
    """Language and score from the margins of all machines."""
    langs, names = model["langs"], [m[:3] for m in model["machines"]]
    sure = 1.0
    by_family = {a: margins[i] for i, (kind, a, _) in enumerate(names) if kind == "family"}
    if by_family:
        family = max(sorted(by_family), key=by_family.get)
        sure = 1 / (1 + np.exp(-np.clip(4 * by_family[family], -30, 30)))
    else:
        family = family_of(langs[0])
    inside = [x for x in langs if family_of(x) == family]
    votes, total = dict.fromkeys(inside, 0), dict.fromkeys(inside, 0.0)
    for i, (kind, a, b) in enumerate(names):
        if kind == "pair" and a in votes:
            votes[a if margins[i] >= 0 else b] += 1
            total[a] += margins[i]
            total[b] -= margins[i]
    best = max(inside, key=lambda x: (votes[x], total[x]))
    if len(inside) > 1:
        sure *= 1 / (1 + np.exp(-np.clip(4 * total[best] / (len(inside) - 1), -30, 30)))
    return best, float(sure)


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """docs (doc_id, text) -> doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = shared.value
        w = np.stack([m[3] for m in found["machines"]], axis=1) if found["machines"] else np.zeros((DIMENSIONS, 0))
        b = np.array([m[4] for m in found["machines"]])
        for batch in batches:
            said = []
            for text in batch["text"]:
                if not found["langs"] or not has_letter(text):
                    said.append(("und", 0.0))
                else:
                    said.append(decide(_shares(text) @ w + b, found))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": [x[0] for x in said], "score": [x[1] for x in said]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
