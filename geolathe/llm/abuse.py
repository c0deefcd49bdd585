"""Scores for abusive, hateful or sexual language by compression distance.

Two zstandard dictionaries are trained, one on abusive and one on ordinary windows of labelled documents. A window of
a text that compresses shorter with the abusive one is nearer to abusive language; a document scores by its best
windows, so one sentence in a long page is enough, and a threshold is calibrated on held-out labelled documents.

Labels are per document, while abuse is a sentence in it, and some labels are wrong. So the abusive windows to train on
are picked in rounds: first by words that labelled documents hold far more often (by the distance where there are
none), then by the distance, where a window is judged by dictionaries trained without its own document and must
exceed what ordinary windows reach. The
labelled documents used for fitting are a bounded sample (``LABELLED`` rows, ``LEARNT_CHARS`` characters in all). A
pair of dictionaries is trained without each of its folds, in tasks of their own, and the mean over the pairs is the
score. Every document is scored, over the whole of its text, and the scale of scores and the rate that the threshold
allows for are taken from all of them.
"""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolathe.plans.sampling import hashed_sample
from geolathe.session import written

#: Documents by raw score and class of length (binary orders of magnitude of the characters).
Histogram = dict[tuple[float, int], int]
#: Classes of length, and documents that a class needs for a middle of its own.
CLASSES, COUNTED = 40, 30

#: Labelled documents that the dictionaries are fitted on, at most (smallest hashes), and their characters in all.
LABELLED, LEARNT_CHARS = 12_000, 50_000_000
#: Window and step in characters.
WINDOW, STEP = 40, 20
#: Bytes of a dictionary, the length and step of the segments it's trained from, and the compression level.
DICTIONARY_BYTES, SEGMENT, SPAN, LEVEL = 262_144, 32, 6, 3
#: Windows that the ordinary dictionary is trained on, at most.
TRAINED = 10_000
#: How far out an abusive window must be: beyond the best window of this share of ordinary documents (the rest may be
#: labelled wrong), which ``PROBED`` labelled ones show.
QUANTILE, PROBED = 0.96, 500
#: Windows of an abusive document that are picked first.
FIRST = 3
#: Log odds of the telling words of an ordinary window beyond which its label is taken for wrong: it isn't learnt from.
SUSPECT = 8.0
FOLDS, ROUNDS = 3, 3
#: Documents whose windows are compressed in one call.
TOGETHER = 200

# Marks that stand for letters within words of badly read or veiled text.
STAND_FOR = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "ſ": "s"})
VEILED = re.compile(r"(?<=[^\W\d_])[013457@$ſ]+(?=[^\W\d_]|\b)|\b[013457@$ſ](?=[^\W\d_]{2})")
SPACED = re.compile(r"(?<!\S)(?:[^\W\d_] ){3,}[^\W\d_](?!\S)")
WORD = re.compile(r"[^\W\d_]+(?:[—\-*]+[^\W\d_]+)*")


def normal(text: str, columns: list[int] | None) -> str:
    """The text in one line and in reading order: lines by column of the page, words broken at line ends joined."""
    lines = [x for x in text.split("\n") if x.strip()]
    if columns is not None and len(columns) == len(lines) and any(a is not None and b is not None and a > b for a, b in zip(columns, columns[1:])):
        lines = [lines[i] for i in sorted(range(len(lines)), key=lambda i: (columns[i] is None, columns[i] or 0))]
    out = []
    for x in lines:
        x = x.strip()
        out.append(x[:-1] if len(x) > 1 and x[-1] in "-¬" and x[-2].isalpha() else x + " ")
    line = VEILED.sub(lambda m: m.group().translate(STAND_FOR), " ".join("".join(out).lower().split()))
    return SPACED.sub(lambda m: m.group().replace(" ", ""), line)


def windows(text: str) -> list[bytes]:
    """Overlapping windows over all of the text; a text shorter than a window is one."""
    return [text[i : i + WINDOW].encode("utf-8", "replace") for i in range(0, max(1, len(text) - WINDOW + STEP), STEP)]


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary trained on windows; of too few to train on, the windows themselves."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=SEGMENT, d=SPAN).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[-DICTIONARY_BYTES:] or b"\n" * 8


def compressor(trained: bytes):  # noqa: ANN201
    import zstandard

    data = zstandard.ZstdCompressionDict(trained)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)


def distances(ordinary, abusive, parts: list[bytes]) -> np.ndarray:  # noqa: ANN001
    """Bytes that each window is shorter with the abusive dictionary than with the ordinary one; all in one call each."""
    if not parts:
        return np.zeros(0)
    a, b = ordinary.multi_compress_to_buffer(parts), abusive.multi_compress_to_buffer(parts)
    return np.fromiter(map(len, a), dtype=float, count=len(parts)) - np.fromiter(map(len, b), dtype=float, count=len(parts))


def document_scores(ordinary, abusive, texts: list[str]) -> list[float]:  # noqa: ANN001
    """The scores of many texts, their windows compressed together."""
    return scores_by([(ordinary, abusive)], texts)[0]


def scores_by(pairs: list[tuple], texts: list[str]) -> list[list[float]]:
    """The scores of many texts by each pair of compressors; windows are cut once."""
    parts = [windows(t) for t in texts]
    every, size = [w for p in parts for w in p], np.array([len(p) for p in parts])
    return [best_of(distances(a, b, every), size) for a, b in pairs]


def best_of(distance: np.ndarray, size: np.ndarray) -> list[float]:
    """The best window of each document, and half of the second best; ``size`` windows belong to each in turn."""
    if not len(size):
        return []
    document = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((-distance, document))
    first = np.cumsum(size) - size
    top = distance[order]
    return (top[first] + np.where(size > 1, 0.5 * top[np.minimum(first + 1, len(top) - 1)], 0.0)).tolist()


@dataclass
class Scale:
    """How raw scores are put on a common scale: the middle that documents of each class of length reach, and the
    spread around it. The best of many windows lies higher than that of few, so long documents have a higher middle.
    """

    middles: list[float]
    spread: float = 1.0

    def standing(self, score: float, length: int) -> float:
        """A raw score of a document of some class of length, in units of the spread."""
        return (score - self.middles[length]) / self.spread


def length_class(chars: int) -> int:
    return min(CLASSES - 1, max(1, chars).bit_length() - 1)


@dataclass
class Model:
    """What is sent to the workers: the dictionaries (ordinary, abusive) of each fold, the scale of each pair's scores,
    and the threshold of the mean over the pairs."""

    pairs: list[tuple[bytes, bytes]]
    scales: list[Scale]
    threshold: float
    held_out_f1: float = 0.0

    def compressors(self) -> list[tuple]:
        return [(compressor(a), compressor(b)) for a, b in self.pairs]

    def score(self, raw: list[float], length: int) -> float:
        """How far the mean standing is above the threshold, in spreads."""
        return sum(x.standing(r, length) for x, r in zip(self.scales, raw)) / len(raw) - self.threshold


def telling_words(abusive: list[str], ordinary: list[str]) -> dict[str, float]:
    """Words that abusive documents hold significantly more often (G test), with their log odds."""
    held, free = Counter(), Counter()
    for texts, count in ((abusive, held), (ordinary, free)):
        for t in texts:
            count.update(set(WORD.findall(t)))
    n, m = max(1, len(abusive)), max(1, len(ordinary))
    out = {}
    for w, a in held.items():
        b = free[w]
        expected, other = (a + b) * n / (n + m), (a + b) * m / (n + m)
        g = 2 * (a * math.log(a / expected) + (b * math.log(b / other) if b else 0))
        if a >= 3 and a > expected and g > 12:
            out[w] = math.log(((a + 0.5) / (n + 1)) / ((b + 0.5) / (m + 1)))
    return out


def _without_each(parts: list[list[bytes]]) -> list:
    """Compressors with dictionaries of the windows of all documents but those of each fold."""
    return [compressor(dictionary([w for i, p in enumerate(parts) if i % FOLDS != k for w in p])) for k in range(FOLDS)]


def learn(abusive: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """The ordinary and the abusive dictionary from texts that are, on the whole, labelled right."""
    rng = random.Random(1)
    plain = [w for t in ordinary for w in windows(t)]
    rng.shuffle(plain)
    odds = telling_words(abusive, ordinary)
    weight = lambda w: sum(sorted((max(0.0, odds.get(t, 0.0) - 0.7) for t in set(WORD.findall(w.decode("utf-8", "replace")))), reverse=True)[:4])
    share = dictionary(list(itertools.islice((w for w in plain if weight(w) <= SUSPECT), TRAINED)))
    ordinary_c, probe = compressor(share), [windows(t) for t in ordinary[-PROBED:]]
    parts = [windows(t) for t in abusive]
    picked = [[w for s, w in sorted(((weight(w), w) for w in p), reverse=True)[:FIRST] if s > 1.5] for p in parts]
    folds = _without_each(parts)
    for i, p in enumerate(parts):
        if not picked[i]:
            picked[i] = [p[j] for j in np.argsort(-distances(ordinary_c, folds[i % FOLDS], p), kind="stable")[:FIRST]]
    for _ in range(ROUNDS - 1):
        folds = _without_each(picked)
        least = float(np.quantile([distances(ordinary_c, folds[i % FOLDS], p).max() for i, p in enumerate(probe)], QUANTILE)) if probe else 0.0
        # the distance may only pick windows with some telling word: what wrong labels brought in has none
        own = [[w for w, d in zip(p, distances(ordinary_c, folds[i % FOLDS], p)) if d > least and weight(w) > 1.0] for i, p in enumerate(parts)]
        picked = own if any(own) else picked
    return share, dictionary([w for p in picked for w in p])


def median_of(values: np.ndarray, counts: np.ndarray) -> float:
    """The median of values that occur ``counts`` times each."""
    order = np.argsort(values)
    ends = np.cumsum(counts[order])
    low, high = np.searchsorted(ends, [(ends[-1] - 1) // 2, ends[-1] // 2], side="right")
    return float(values[order][low] + values[order][high]) / 2


def scale(seen: Histogram) -> Scale:
    """Middle (median) of each class of length and spread (median distance from it) of the raw scores counted.

    Classes with few documents get what lies between their neighbours, those beyond the longest its middle: there, one
    sentence must still stand out, though ordinary text of such length reaches more by chance.
    """
    if not seen:
        return Scale([0.0] * CLASSES)
    raw, length, counts = np.array([r for r, _ in seen], dtype=float), np.array([c for _, c in seen]), np.array(list(seen.values()), dtype=np.int64)
    held = np.bincount(length, counts, CLASSES)
    known = np.flatnonzero(held >= min(COUNTED, held.max()))
    middle = np.array([median_of(raw[length == c], counts[length == c]) for c in known])
    middles = np.interp(np.arange(CLASSES), known, middle)
    return Scale(middles.tolist(), max(1.0, median_of(np.abs(raw - middles[length]), counts)))


def threshold_of(scores: np.ndarray, labels: np.ndarray, ordinary_weight: float = 1.0) -> tuple[float, float]:
    """The threshold with the best F1 and that F1; midway to the next lower score.

    ``ordinary_weight``: documents of the corpus that an ordinary labelled one stands for, against an abusive one.
    """
    if not labels.any():
        return float("inf"), 0.0
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], labels[order]
    hit = np.cumsum(y)
    f1 = 2 * hit / (hit + ordinary_weight * np.cumsum(~y) + y.sum())
    last = np.append(s[1:] != s[:-1], True)  # ties stay together
    best = int(np.argmax(np.where(last, f1, -1)))
    return float((s[best] + s[best + 1]) / 2 if best + 1 < len(s) else s[best]), float(f1[best])


@dataclass
class Learnt:
    """Dictionaries (ordinary, abusive) without each fold, and what each pair says of the texts of its own fold."""

    pairs: list[tuple[bytes, bytes]]
    held: np.ndarray
    chars: np.ndarray
    labels: np.ndarray


def lesson(labelled: list[tuple[str, bool]], k: int) -> tuple[bytes, bytes, list[float]]:
    """Dictionaries from all labelled texts but those of fold ``k``, and the raw scores of these."""
    rest = [x for i, x in enumerate(labelled) if i % FOLDS != k]
    ordinary, abusive = learn([t for t, v in rest if v], [t for t, v in rest if not v])
    return ordinary, abusive, document_scores(compressor(ordinary), compressor(abusive), [t for t, _ in labelled[k::FOLDS]])


def gathered(lessons: list[tuple[bytes, bytes, list[float]]], chars: list[int], labels: list[bool]) -> Learnt:
    """The outcome of the lessons of all folds."""
    held = np.zeros(len(labels))
    for k, (_, _, scores) in enumerate(lessons):
        held[k::FOLDS] = scores
    return Learnt([(a, b) for a, b, _ in lessons], held, np.array(chars), np.array(labels, dtype=bool))


def share_above(seen: Histogram, by: Scale, threshold: float) -> float:
    """The share of the counted documents that stand above the threshold."""
    return sum(n for (r, c), n in seen.items() if by.standing(r, c) > threshold) / max(1, sum(seen.values()))


def threshold_at(scores: Counter, share: float) -> float:
    """The least threshold above which at most that share of the counted scores lies, halfway to the next score."""
    total, above, last = sum(scores.values()), 0, None
    for s in sorted(scores, reverse=True):
        if above + scores[s] > share * total + 1e-9:
            return s if last is None else (s + last) / 2
        above, last = above + scores[s], s
    return float("-inf")


def held_threshold(found: Learnt, seen: list[Histogram], scales: list[Scale]) -> tuple[float, float, float]:
    """The threshold of a single pair's standing, the share of all documents above it, and F1 on held-out texts.

    It is the one with the best F1 for held-out texts at the rate of abuse that the corpus has rather than the labels:
    that rate follows from how many documents the pairs flag, and how many held-out ones rightly and wrongly. Without
    a single abusive label nothing can be learnt, and nothing will be flagged.
    """
    y = found.labels
    if not y.any():
        return float("inf"), 0.0, 0.0
    scores = np.array([scales[i % FOLDS].standing(s, length_class(c)) for i, (s, c) in enumerate(zip(found.held, found.chars.tolist()))])
    threshold, f1 = threshold_of(scores, y)
    flagged = lambda t: float(np.mean([share_above(h, x, t) for h, x in zip(seen, scales)]))
    held = float(y.mean())
    if seen[0] and held < 1:  # labels were given to abusive documents more often than the corpus holds them
        right, wrong = float((scores[y] > threshold).mean()), float((scores[~y] > threshold).mean())
        rate = min(held, max(1 / sum(seen[0].values()), (flagged(threshold) - wrong) / max(right - wrong, 1e-9)))
        threshold, _ = threshold_of(scores, y, (1 - rate) / rate * held / (1 - held))
    return threshold, flagged(threshold), f1


def fit(labelled: list[tuple[str, bool]], further: list[str]) -> Model:
    """The model where the labelled texts and ``further`` are all documents there are."""
    found = gathered([lesson(labelled, k) for k in range(FOLDS)], [len(t) for t, _ in labelled], [v for _, v in labelled])
    lengths = [length_class(len(t)) for t in further]
    raw = scores_by([(compressor(a), compressor(b)) for a, b in found.pairs], further)
    seen = [Counter(zip(r, lengths)) for r in raw]
    scales = [scale(h) for h in seen]
    single, share, f1 = held_threshold(found, seen, scales)
    model = Model(found.pairs, scales, 0.0, f1)
    if further and single < float("inf"):
        model.threshold = threshold_at(Counter(round(model.score(list(r), c), 2) for r, c in zip(zip(*raw), lengths)), share)
    else:
        model.threshold = single
    return model


def majority(labels: DataFrame, id_col: str, label: str) -> DataFrame:
    """One label per document: what most raters say. Undecided documents and null labels are left out."""
    votes = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.avg((F.col(label) > 0).cast("double")).alias("_share"))
    return votes.where(F.col("_share") != 0.5).select(id_col, (F.col("_share") > 0.5).alias("_abusive"))


def sampled(docs: DataFrame, labels: DataFrame, id_col: str, text: str, columns: Column | None = None, label: str = "toxic") -> tuple[Learnt, set]:
    """What is learnt from a bounded sample of labelled documents, and the ids of those documents.

    Documents are taken by hash up to ``LABELLED`` of them and ``LEARNT_CHARS`` characters in all, so a text of any
    length may be among them. Equal texts are one, with what most of them are labelled; each fold is a task that gets
    the sample and hands back its dictionaries.
    """
    df = docs.select(F.col(id_col).alias("id"), F.col(text).alias("t"), (columns if columns is not None else F.lit(None).cast("array<int>")).alias("c")).where(F.length("t") > 0)
    said = majority(labels, id_col, label).withColumnRenamed(id_col, "id")
    known = hashed_sample(said, ["id"], LABELLED, said.count())
    sizes = df.join(F.broadcast(known), "id").select("id", F.xxhash64("id").alias("h"), F.length("t").alias("n")).collect()
    taken, chars = [], 0
    for r in sorted(sizes, key=lambda r: r["h"]):
        if chars + r["n"] <= LEARNT_CHARS:
            taken.append((r["id"],))
            chars += r["n"]
    few = F.broadcast(docs.sparkSession.createDataFrame(taken, known.select("id").schema))
    rows = df.join(few, "id").join(F.broadcast(known), "id").withColumn("k", F.explode(F.array(*map(F.lit, range(FOLDS)))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        votes: dict[str, list[tuple]] = {}
        for i, t, c, a in pdf.sort_values("id")[["id", "t", "c", "_abusive"]].itertuples(index=False):
            votes.setdefault(normal(t, None if c is None else list(c)), []).append((i, a))
        labelled = [(t, sum(a for _, a in v) * 2 > len(v)) for t, v in votes.items() if t and sum(a for _, a in v) * 2 != len(v)]
        random.Random(3).shuffle(labelled)
        k = int(pdf["k"].iloc[0])
        own = labelled[k::FOLDS]
        ordinary, abusive, held = lesson(labelled, k)
        return pd.DataFrame([{"k": k, "a": ordinary, "b": abusive, "held": held, "chars": [len(t) for t, _ in own], "labels": [v for _, v in own], "ids": [[i for i, _ in votes[t]] for t, _ in own]}])

    kind = df.schema["id"].dataType.simpleString()
    done = rows.groupBy("k").applyInPandas(run, f"k int, a binary, b binary, held array<double>, chars array<int>, labels array<boolean>, ids array<array<{kind}>>").collect()
    done.sort(key=lambda r: r["k"])
    if not done:
        return Learnt([(b"\n" * 8, b"\n" * 8)] * FOLDS, np.zeros(0), np.zeros(0, dtype=int), np.zeros(0, dtype=bool)), set()
    n = sum(len(r["held"]) for r in done)
    chars_, labels_ = [0] * n, [False] * n
    for k, r in enumerate(done):
        chars_[k::FOLDS], labels_[k::FOLDS] = r["chars"], r["labels"]
    return gathered([(bytes(r["a"]), bytes(r["b"]), r["held"]) for r in done], chars_, labels_), {i for r in done for ids in r["ids"] for i in ids}


def raw_scores(docs: DataFrame, id_col: str, keep: list[str], text: str, found: Learnt, own: set, columns: Column | None = None) -> DataFrame:
    """A row per document: the columns ``keep``, raw scores by each pair of dictionaries (null without text), characters
    and whether it's one of the labelled documents that were learnt from."""
    sent = docs.sparkSession.sparkContext.broadcast((found.pairs, own))
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema.fields) + "_raw array<double>, _chars int, _own boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, mine = sent.value
        made = [(compressor(a), compressor(b)) for a, b in pairs]
        for b in batches:
            texts = [normal(t, c) if t else "" for t, c in zip(b.column("_text").to_pylist(), b.column("_columns").to_pylist())]
            own_ = [i in mine for i in b.column("_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(_raw(made, texts), pa.list_(pa.float64())), pa.array(map(len, texts), pa.int32()), pa.array(own_, pa.bool_())], [*keep, "_raw", "_chars", "_own"])

    cols = columns if columns is not None else F.lit(None).cast("array<int>")
    return docs.select(*keep, F.col(id_col).alias("_id"), F.col(text).alias("_text"), cols.alias("_columns")).mapInArrow(run, ddl)


def _raw(pairs: list[tuple], texts: list[str]) -> list[list[float] | None]:
    """Raw scores of texts by each pair, null for empty ones."""
    raw: list[list[float] | None] = [None] * len(texts)
    full = [i for i, t in enumerate(texts) if t]
    for at in range(0, len(full), TOGETHER):
        some = full[at : at + TOGETHER]
        for i, s in zip(some, zip(*scores_by(pairs, [texts[i] for i in some]))):
            raw[i] = list(s)
    return raw


def _class() -> Column:
    return F.least(F.lit(CLASSES - 1), F.floor(F.log2(F.greatest(F.lit(1), "_chars")))).cast("int")


def histograms(raw: DataFrame, pairs: int) -> list[Histogram]:
    """How many documents have a raw score and a class of length, for each pair of dictionaries.

    Scores are halves of bytes that a few windows differ by, so the lines are few however many documents there are.
    """
    each = raw.where(F.col("_raw").isNotNull() & ~F.col("_own")).select(F.posexplode("_raw").alias("k", "r"), _class().alias("c"))
    out: list[Histogram] = [Counter() for _ in range(pairs)]
    for x in each.groupBy("k", "r", "c").agg(F.count(F.lit(1)).alias("n")).collect():
        out[x["k"]][x["r"], x["c"]] = x["n"]
    return out


def _standing(scales: list[Scale], k: int) -> Column:
    return (F.col("_raw")[k] - F.get(F.array(*map(F.lit, scales[k].middles)), _class())) / F.lit(scales[k].spread)


def _modelled(docs: DataFrame, labels: DataFrame, id_col: str, keep: list[str], text: str, columns: Column | None, label: str) -> tuple[Model, DataFrame]:
    """The model for a corpus, and its documents with their scores: raw scores are written once, scales and thresholds
    come from all of them."""
    found, own = sampled(docs, labels, id_col, text, columns, label)
    raw = written(raw_scores(docs, id_col, keep, text, found, own, columns), "scores")
    seen = histograms(raw, FOLDS)
    scales = [scale(h) for h in seen]
    single, share, f1 = held_threshold(found, seen, scales)
    mean = sum((_standing(scales, k) for k in range(FOLDS)), F.lit(0.0)) / FOLDS
    threshold = single
    if share or single < float("inf") and seen[0]:
        counts = raw.where(F.col("_raw").isNotNull() & ~F.col("_own")).groupBy(F.round(mean, 2).alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()
        threshold = threshold_at(Counter({r["s"]: r["n"] for r in counts}), share)
    scored_ = raw.select(*keep, (mean - F.lit(threshold)).alias("score")).withColumn("flagged", F.coalesce(F.col("score") > 0, F.lit(False)))
    return Model(found.pairs, scales, threshold, f1), scored_


def judged(docs: DataFrame, labels: DataFrame, id_col: str, keep: list[str], text: str, columns: Column | None = None) -> DataFrame:
    """``scored`` with the model for the corpus, from one pass over its documents."""
    return _modelled(docs, labels, id_col, keep, text, columns, "toxic")[1]


def fitted(docs: DataFrame, labels: DataFrame, id_col: str, text: str, columns: Column | None = None, label: str = "toxic") -> Model:
    """The model for a corpus: dictionaries from a bounded sample, scales and thresholds from all documents."""
    return _modelled(docs, labels, id_col, [], text, columns, label)[0]


def scored(docs: DataFrame, keep: list[str], text: str, model: Model, columns: Column | None = None) -> DataFrame:
    """The columns ``keep`` of every document with its ``score`` (how far above the threshold, in spreads) and whether
    it's ``flagged`` (above it).

    Null, empty and blank texts have a null score and aren't flagged. Every row is judged alone, so copies score
    alike. ``columns`` gives the page column of each non-blank line, for texts whose columns are mixed up.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields) + ", score double, flagged boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        made = m.compressors()
        for b in batches:
            texts = [normal(t, c) if t else "" for t, c in zip(b.column("_text").to_pylist(), b.column("_columns").to_pylist())]
            score = [None if r is None else m.score(r, length_class(len(t))) for t, r in zip(texts, _raw(made, texts))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(score, pa.float64()), pa.array([s is not None and s > 0 for s in score], pa.bool_())], [*keep, "score", "flagged"])

    cols = columns if columns is not None else F.lit(None).cast("array<int>")
    return docs.select(*keep, F.col(text).alias("_text"), cols.alias("_columns")).mapInArrow(run, ddl)


def rates(scores: DataFrame, source: str) -> DataFrame:
    """A row per source (null is one): documents, flagged ones and their share, and the highest score."""
    return scores.groupBy(source).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("flagged").cast("long")).alias("n_flagged"), F.max("score").alias("top_score")).withColumn("rate", F.col("n_flagged") / F.col("n_docs"))
