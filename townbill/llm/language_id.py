"""Language of whole texts by the nearest of several centroids per language.

Texts become normalised TF-IDF vectors of hashed letter n-grams. Document frequencies are counted over
all training documents; the centroids of each language come from spherical k-means over a bounded
sample of its training documents, `sample` per language, the smallest by hash. The model is a few fixed
arrays (languages * centroids * slots) whatever the input. A text is compared with all centroids by
cosine; the nearest gives the language, and a text further from it than nearly all stretches of training
texts with as many n-grams are from theirs is marked as rejected. Short texts lie further from a centroid
than long ones, so the least cosine is a function of the number of n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townbill.llm import common

SLOTS = 1 << 13
UNKNOWN = "und"
# texts counted together, to bound memory: rows and bytes
ROWS, BYTES = 48, 1 << 20
# lengths in letters of the stretches that the least cosines are fitted on, and the share of them left below
LENGTHS, LEAST = [4 << k for k in range(9)], 0.01


def letters_only(text: str) -> bytes:
    return text.lower().encode()


def _grams(raw: np.ndarray) -> np.ndarray:
    """Slots of the 1- to 3-byte n-grams of lower-cased UTF-8; runs of other signs count as one space."""
    mask = np.zeros(256, bool)
    mask[97:123] = True
    mask[128:] = True
    word = mask[raw]
    keep = word.copy()
    keep[1:] |= word[:-1]
    x = np.where(word, raw, 32)[keep].astype(np.uint32)
    if not len(x):
        return x
    x = np.concatenate([np.array([32], np.uint32), x, np.array([32], np.uint32)])
    one, two, three = x[1:-1], (x[:-1] << 8) | x[1:], (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
    codes = np.concatenate([one + (1 << 24), two + (1 << 25), three])
    return (codes * np.uint32(2654435761)) >> np.uint32(19)


def counts_of(texts: list[str]) -> np.ndarray:
    """Counts per slot, a row per text; the whole of each text."""
    out = np.zeros((len(texts), SLOTS), np.float32)
    for i, text in enumerate(texts):
        raw = np.frombuffer(letters_only(text), np.uint8)
        for at in range(0, len(raw), BYTES):
            out[i] += np.bincount(_grams(raw[at : at + BYTES]), minlength=SLOTS)
    return out


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def batched(texts: list[str]) -> Iterator[list[str]]:
    own, size = [], 0
    for text in texts:
        if own and (len(own) == ROWS or size + len(text) > BYTES):
            yield own
            own, size = [], 0
        own.append(text)
        size += len(text)
    if own:
        yield own


@dataclass(frozen=True)
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # languages * per_language rows
    owner: np.ndarray  # language of each centroid
    grams: list[np.ndarray]  # numbers of n-grams, rising, by language
    floor: list[np.ndarray]  # smallest cosine that is not rejected at each of them, by language

    def least(self, language: int, grams: float) -> float:
        """Smallest cosine that is not rejected; 0 for texts shorter than all stretches it was fitted on."""
        if not len(self.grams[language]):
            return 0.0
        return float(np.interp(np.log1p(grams), np.log1p(self.grams[language]), self.floor[language], left=0.0))

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
        """Language, cosine and rejection of each text; `und`, 0 and rejected where it has no letter."""
        names, scores, rejected = [], [], []
        for own in batched(texts):
            counts = counts_of(own)
            near = vectors(counts, self.idf) @ self.centroids.T
            for text, row, grams in zip(own, near, counts.sum(axis=1), strict=True):
                if not any(c.isalpha() for c in text):
                    names.append(UNKNOWN), scores.append(0.0), rejected.append(True)
                    continue
                best = int(row.argmax())
                score = min(1.0, max(0.0, float(row[best])))
                names.append(self.languages[self.owner[best]]), scores.append(score), rejected.append(score < self.least(self.owner[best], float(grams)))
        return names, scores, rejected


def _centres(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from spread-out starting points, the same on every run."""
    picked = [points.mean(axis=0)]
    for _ in range(k):
        picked.append(points[(points @ np.stack(picked).T).max(axis=1).argmin()])
    centres = np.stack(picked[1:])
    for _ in range(rounds):
        near = (points @ centres.T).argmax(axis=1)
        sums = np.stack([points[near == c].sum(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def _least_cosines(texts: list[str], points: np.ndarray, idf: np.ndarray, per_language: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of n-grams and the least cosine that passes at each: `share` of the low quantile over
    stretches of the texts. A text is compared with centroids of the other half of them, as a text to be
    judged took no part in them either; with a single text nothing is known, and nothing is rejected."""
    if len(texts) < 2:
        return np.zeros(0), np.zeros(0)
    halves = [_centres(points[k::2], min(per_language, len(points[k::2]))) for k in (0, 1)]
    grams, floor = [], []
    for length in LENGTHS:
        sizes, cosines = [], []
        for k in (0, 1):
            long = [t for t in texts[k::2] if len(t) >= length]
            parts = [t[at : at + length] for t in long for at in {0, (len(t) - length) // 2}]
            for own in batched(parts):
                counts = counts_of(own)
                some = counts.sum(axis=1) > 0
                sizes += counts.sum(axis=1)[some].tolist()
                cosines += (vectors(counts, idf) @ halves[1 - k].T).max(axis=1)[some].tolist()
        # stretches of one length may have other numbers of n-grams in another language
        at = float(np.median(sizes)) if sizes else 0.0
        if sizes and (not grams or at > grams[-1]):
            grams.append(at)
            floor.append(share * float(np.quantile(cosines, LEAST, method="lower")))
    return np.asarray(grams), np.asarray(floor)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(train: DataFrame, sample: int = 400, per_language: int = 3, reject: float = 0.75) -> Model | None:
    """Learns from (text, lang): `sample` texts per language are used for the centroids, all for the
    document frequencies. `reject`: share of the cosine that nearly all stretches of a language's sample
    with as many n-grams reach, below which a text is rejected. None if nothing is labelled."""
    labelled = train.where(F.col("lang").isNotNull() & has_letter(F.col("text"))).select("text", "lang")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.keep_only()
        seen, n = np.zeros(SLOTS, np.int64), 0
        for batch in common.slices(batches):
            for own in batched(batch.column(0).to_pylist()):
                seen += (counts_of(own) > 0).sum(axis=0)
                n += len(own)
        yield pa.RecordBatch.from_arrays([pa.array([seen.tolist()]), pa.array([n])], names=["seen", "n"])

    # one row of fixed width per task, added up by slot on the executors
    parts = labelled.select("text").mapInArrow(frequencies, "seen array<long>, n long")
    summed = parts.select("n", F.posexplode("seen").alias("slot", "seen")).groupBy("slot").agg(F.sum("seen").alias("seen"), F.sum("n").alias("n")).collect()
    if not summed or not summed[0]["n"]:
        return None
    seen = np.zeros(SLOTS)
    for row in summed:
        seen[row["slot"]] = row["seen"]
    idf = (np.log((1 + summed[0]["n"]) / (1 + seen)) + 1).astype(np.float32)
    return _fit_sample(labelled, idf, sample, per_language, reject)


def _fit_sample(labelled: DataFrame, idf: np.ndarray, sample: int, per_language: int, reject: float) -> Model:
    from pyspark.sql import Window

    # the hash range that holds about 4 * sample distinct texts of each language, then the first of them: the
    # range is a number per language, so that no other text leaves the scan. Copies share one hash, so they
    # must not narrow it
    hashed = labelled.withColumn("h", F.xxhash64("text"))
    distinct = hashed.groupBy("lang", "h").agg(F.lit(1).alias("one")).groupBy("lang").agg(F.count("*").alias("n"))
    reach = [F.lit(x) for r in distinct.collect() for x in (r["lang"], 4 * sample * (1 << 30) // r["n"])]
    wide = hashed.where(F.pmod("h", F.lit(1 << 30)) < F.element_at(F.create_map(*reach), F.col("lang")))
    # a text that stands often counts once, and its copies meet before the exchange
    wide = wide.groupBy("lang", "h").agg(F.any_value("text").alias("text"))
    first = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h")
    rows = wide.select("lang", "h", "text").withColumn("k", F.row_number().over(first)).where(F.col("k") <= sample).select("lang", "text").orderBy("lang", "k").collect()
    languages = sorted({r["lang"] for r in rows})
    centroids, owner, grams, floor = [], [], [], []
    for i, name in enumerate(languages):
        texts = [r["text"] for r in rows if r["lang"] == name]
        points = np.concatenate([vectors(counts_of(own), idf) for own in batched(texts)])
        own = _centres(points, min(per_language, len(points)))
        centroids.append(own)
        owner += [i] * len(own)
        known = _least_cosines(texts, points, idf, per_language, reject)
        grams.append(known[0])
        floor.append(known[1])
    return Model(languages, idf, np.concatenate(centroids).astype(np.float32), np.asarray(owner), grams, floor)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) and the columns in `keep`, one row per row of `docs`.

    Texts that are null or have no letter are `und` with score 0 and rejected, as all are without a
    model. Repeated rows get the same answer; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.keep_only()
        for batch in common.slices(batches):
            texts = [t or "" for t in batch.column(0).to_pylist()]
            if shared.value is None:
                found = ([UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts))
            else:
                found = shared.value.predict(texts)
            made = [pa.array(found[0], pa.string()), pa.array(found[1], pa.float64()), pa.array(found[2], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], names=[*batch.schema.names[1:], "lang_pred", "score", "rejected"])

    rows = docs.select(docs[text_col].alias("_text"), docs[id_col].cast("long").alias("doc_id"), *[docs[c] for c in keep])
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(answer, f"{shape}, lang_pred string, score double, rejected boolean")
