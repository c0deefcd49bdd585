"""Finding text that was decoded with the wrong character encoding, and putting the original back.

A multinomial classifier over hashed byte bigrams is trained on names of the data that were garbled on purpose, one
class for each chain of encodings, one for text damaged beyond inversion (letters lost to replacement characters or
question marks on the way) and one for sound text. It ranks the chains for a value; each is inverted, must decode
strictly, must give the value again when garbled anew, and must read better than the value does under the classifier's
own model of sound text. Values that no chain explains are reported as damaged where that class wins.

The model is fitted on a bounded sample of distinct values (``SAMPLE``); every value of the data is then judged, equal
ones once.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolathe.plans.sampling import hashed_sample
from geolathe.plans.skew import salted_join
from geolathe.session import written

#: Distinct values the classifier is fitted on, at most (those with the smallest hashes).
SAMPLE = 12_000
#: Buckets that byte bigrams are hashed into.
BUCKETS = 1 << 14
#: Nats that a chain's score may lie below that of sound text; every chain nearer than that is tried. The second is for
#: chains between single-byte pages, which decode anything strictly, and values all of whose characters sound values
#: hold too: these must look garbled to the classifier by their order.
GATE, PLAIN_GATE = 25.0, 10.0
#: Classes of damage that nothing can be put back after.
DAMAGED = 2
#: Longer values are judged piece by piece, so that a garbled name in a long text isn't outweighed by the rest.
PIECE = 200
#: How many nats better than the value a restored text must read, its chain's prior included.
MARGIN = 2.0
#: Nats that a restored text pays for each character that sound values of the sample don't hold.
STRANGE = 12.0
#: Expected share of garbled values; only sets the priors.
PRIOR = 0.05

# Chains of (encoding of the bytes, encoding they were read in), first step first.
UTF8_READ_AS = ["cp1252", "latin-1", "cp1250", "cp1251", "cp1254", "iso8859-15", "cp437", "cp850", "cp852", "mac_roman", "cp866", "koi8-r"]
BYTES_READ_AS = [
    ("cp1252", "latin-1"), ("cp1252", "cp1250"), ("cp1252", "cp1251"), ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("cp1252", "cp437"),
    ("cp1250", "cp1252"), ("cp1254", "cp1252"), ("mac_roman", "cp1252"), ("mac_roman", "latin-1"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp852", "cp1252"), ("cp852", "cp1250"),
    ("cp437", "latin-1"), ("cp850", "latin-1"),
    ("cp1251", "cp1252"), ("cp1251", "koi8-r"), ("cp1251", "cp866"), ("koi8-r", "cp1251"), ("koi8-r", "cp1252"), ("cp866", "cp1251"), ("cp866", "cp1252"),
]
TWICE = [("cp1252", "cp1252"), ("latin-1", "latin-1"), ("latin-1", "cp1252"), ("cp1252", "latin-1")]

Step = tuple[str, str]
CHAINS: list[tuple[Step, ...]] = [
    *[(("utf-8", w),) for w in UTF8_READ_AS],
    *[(pair,) for pair in BYTES_READ_AS],
    *[(("utf-8", a), ("utf-8", b)) for a, b in TWICE],
    (("utf-8", "latin-1"),) * 3,
    (("utf-8", "cp1252"),) * 3,
]


class _Bytes(dict):
    """Characters to the bytes of a page, as a translation table; what the page lacks goes where no byte is."""

    def __missing__(self, code: int) -> int:
        return 0xFFFF


@lru_cache(maxsize=None)
def table(encoding: str) -> tuple[dict[int, str], _Bytes]:
    """Characters of the 256 bytes and back. Bytes a Windows page leaves open stand for control characters."""
    chars = []
    for i in range(256):
        try:
            chars.append(bytes([i]).decode(encoding))
        except UnicodeDecodeError:
            chars.append(chr(i))
    return dict(enumerate(chars)), _Bytes({ord(c): i for i, c in enumerate(chars)})


def to_bytes(text: str, encoding: str) -> bytes | None:
    if encoding == "utf-8":
        return text.encode("utf-8", "surrogatepass")
    try:
        return text.translate(table(encoding)[1]).encode("latin-1")
    except UnicodeEncodeError:
        return None


def from_bytes(data: bytes, encoding: str) -> str | None:
    if encoding == "utf-8":
        try:
            return data.decode("utf-8")
        except UnicodeDecodeError:
            return None
    return data.decode("latin-1").translate(table(encoding)[0])


def garble(text: str, chain: tuple[Step, ...]) -> str | None:
    """``text`` after its bytes were read in the wrong encoding, step by step; None where that isn't possible."""
    for true, wrong in chain:
        data = to_bytes(text, true)
        text = from_bytes(data, wrong) if data is not None else None  # type: ignore[assignment]
        if text is None:
            return None
    return text


def invert(text: str, chain: tuple[Step, ...]) -> str | None:
    """The text that ``chain`` turns into ``text``, if every step decodes strictly and leads back to it."""
    out: str | None = text
    for true, wrong in reversed(chain):
        data = to_bytes(out, wrong) if out is not None else None  # type: ignore[arg-type]
        out = from_bytes(data, true) if data is not None else None
        if out is None:
            return None
    return out if out != text and garble(out, chain) == text else None  # type: ignore[arg-type]


#: Leading bytes of the two-byte sequences of European letters: Latin ones and Cyrillic ones.
LATIN_LEADS, CYRILLIC_LEADS = range(0xC2, 0xC6), range(0xD0, 0xD2)


def invert_part(text: str, chain: tuple[Step, ...]) -> tuple[str, bool] | None:
    """Inverts what a one-step chain can explain and leaves the rest: (text, whether something of it was lost).

    UTF-8 sequences are looked for character by character; a leading byte at the end without its followers is a
    sequence cut off, one elsewhere among sequences has lost its followers: either can't be restored. For the chains
    between single-byte pages, each word is inverted by itself.
    """
    if len(chain) != 1:
        return None
    true, wrong = chain[0]
    if true != "utf-8":
        words = re.split(r"(\s+)", text)
        new = [w if w.isascii() else (invert(w, chain) or w) for w in words]
        return ("".join(new), False) if new != words else None
    back = table(wrong)[1]
    out, i, done, lone, cut = [], 0, 0, 0, False
    while i < len(text):
        lead = back.get(ord(text[i]), 0)
        need = 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
        if need:
            follow = [back.get(ord(c), 0) for c in text[i + 1 : i + need]]
            if all(0x80 <= b < 0xC0 for b in follow):
                if len(follow) == need - 1:
                    char = from_bytes(bytes([lead, *follow]), "utf-8")
                    if char:
                        out.append(char)
                        i, done = i + need, done + 1
                        continue
                elif i + 1 + len(follow) == len(text):
                    known = lead in LATIN_LEADS or (lead in CYRILLIC_LEADS or lead == 0xE2) and (done > 0 or not re.search("[A-Za-z]", text))
                    if known:
                        cut = True
                        break
        lone += lead in LATIN_LEADS or lead in CYRILLIC_LEADS
        out.append(text[i])
        i += 1
    return ("".join(out), cut or lone > 0) if done or cut else None


def buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed bigrams of the bytes of all texts, next to each other and one apart, and where each text begins.

    Begin and end count as a byte, so every text has some bigrams.
    """
    raw = [b"\x02" + t.encode("utf-8", "surrogatepass") + b"\x03\x03" for t in texts]
    size = np.array([len(r) for r in raw], dtype=np.int64)
    b = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int64)
    last = np.cumsum(size)
    near = (b[:-1] * 257 + b[1:]) * 2654435761
    far = (b[:-2] * 263 + b[2:]) * 2246822519 + 97
    inside = np.ones(len(b), dtype=bool)
    inside[last - 1] = False
    inside[last - 2] = False
    at = np.flatnonzero(inside)
    both = np.stack([near[at], far[at]], axis=1).ravel()
    return (both >> 7) % BUCKETS, 2 * (last - size - 2 * np.arange(len(size)))


@dataclass
class Model:
    """Log likelihoods of the buckets in each class; class 0 is sound text, class i + 1 the chain i, the last
    ``DAMAGED`` ones are single letters lost, and whole texts."""

    weights: np.ndarray
    prior: np.ndarray
    held_out: float = 0.0
    known: frozenset = frozenset()
    chains: list[tuple[Step, ...]] = field(default_factory=lambda: CHAINS)

    def scores(self, texts: list[str], classes: slice | int = slice(None)) -> np.ndarray:
        out = []
        for i in range(0, len(texts), 2000):
            h, start = buckets(texts[i : i + 2000])
            out.append(np.add.reduceat(self.weights[h][:, classes], start, axis=0))
        return np.concatenate(out) if out else np.zeros((0, self.weights.shape[1]))

    def sound(self, texts: list[str]) -> np.ndarray:
        return self.scores(texts, slice(0, 1))[:, 0] if texts else np.zeros(0)


def suspicious(text: str) -> bool:
    """Whether a value must not be learnt as sound: marks of damage, or readable as UTF-8 behind some page."""
    if "�" in text or any(unicodedata.category(c) in ("Cc", "Sm", "So", "Co", "Cn") for c in text):
        return True
    return not text.isascii() and any(invert(text, ((("utf-8", w)),)) for w in UTF8_READ_AS)


def fit(values: list[str], rounds: int = 2) -> Model:
    """The classifier, fitted on distinct values most of which are sound.

    Each round garbles the values taken for sound along every chain, counts bigrams by class, and drops the values
    that the model would restore from the next round's sound ones. A tenth of the values is held out in the last
    round; the share of their garbled forms whose original comes back is kept as ``held_out``.
    """
    sound = [v for v in values if not suspicious(v)]
    model = None
    for i in range(rounds):
        if model is not None:
            flagged = {v for v, r in zip(sound, judge(sound, model)) if r is not None and r[1] != "damaged"}
            sound = [v for v in sound if v not in flagged]
        test = sound[::10] if i == rounds - 1 and len(sound) >= 50 else []
        model = _count([v for j, v in enumerate(sound) if j % 10] if test else sound)
        if test:
            pairs = [(v, g) for n, v in enumerate(test) if not v.isascii() for chain in [CHAINS[n % len(CHAINS)]] for g in [garble(v, chain)] if g and g != v]
            got = judge([g for _, g in pairs], model)
            model.held_out = float(np.mean([r is not None and r[0] == v for (v, _), r in zip(pairs, got)])) if pairs else 1.0
    return model if model is not None else _count([])


def _count(sound: list[str]) -> Model:
    classes = [sound]
    odd = [v for v in sound if not v.isascii()]
    for chain in CHAINS:
        own = []
        for n, v in enumerate(odd):
            g = garble(v, chain)
            if g and g != v:
                own.append(g)
                if chain[0][0] == "utf-8" and n % 12 == 0:  # cut off within a sequence, as narrow fields do
                    at = [i for i, c in enumerate(g) if not c.isascii()]
                    own.append(g[: at[n % len(at)] + 1])
        classes.append(own)
    classes.append([d for n, v in enumerate(sound) for d in lost_forms(v, n)])
    classes.append([d for n, v in enumerate(odd) for d in damaged_forms(v, n)])
    weights = np.empty((BUCKETS, len(classes)), dtype=np.float32)
    for k, own in enumerate(classes):
        count = np.zeros(BUCKETS)
        for i in range(0, len(own), 5000):
            count += np.bincount(buckets(own[i : i + 5000])[0], minlength=BUCKETS)
        weights[:, k] = np.log((count + 0.05) / (count.sum() + 0.05 * BUCKETS))
    prior = np.full(len(classes), np.log(PRIOR / (len(CHAINS) + DAMAGED)))
    prior[0] = np.log(1 - PRIOR)
    held = Counter(c for v in sound for c in set(v))
    return Model(weights, prior, known=frozenset(c for c, n in held.items() if n > 1))


def lost_forms(text: str, n: int) -> list[str]:
    """Forms of a text in which one letter was lost to a mark; the ``n``-th value loses its ``n``-th one outside ASCII.

    All sound values lose a letter, so that the class differs from that of sound text by nothing but the marks.
    """
    at = [i for i, c in enumerate(text) if not c.isascii()] or range(len(text))
    i = at[n % len(at)]
    return [text[:i] + mark + text[i + 1 :] for mark in "?\ufffd"]


def damaged_forms(text: str, n: int) -> list[str]:
    """Forms of a text with letters outside ASCII after which nothing can be put back; the ``n``-th value has its own page."""
    page = UTF8_READ_AS[n % len(UTF8_READ_AS)]
    read = text.encode("utf-8").decode(page, "replace")
    forms = [
        "".join(c if c.isascii() else "\ufffd" for c in text),
        text.encode("ascii", "replace").decode("ascii"),
        text.encode("utf-8").decode("ascii", "replace"),
        text.encode("cp1252", "ignore").decode("utf-8", "replace"),
        text.encode("cp1252", "replace").decode("cp1252"),
        text.encode("latin-1", "replace").decode("latin-1"),
        read.encode("cp1252", "replace").decode("cp1252"),
        read.encode("ascii", "replace").decode("ascii"),
        "".join("\ufffd" if not c.isascii() and i % 2 else c for i, c in enumerate(read)),
    ]
    return [f for f in dict.fromkeys(forms) if f != text and not f.isascii() or "?" in f and "?" not in text]


def chain_name(chain: tuple[Step, ...]) -> str:
    return " > ".join(f"{true}:{wrong}" for true, wrong in chain)


def pieces(text: str) -> list[str]:
    """A long text in pieces of at most ``PIECE`` characters, cut at blanks, or else between two ASCII characters."""
    out, at = [], 0
    while len(text) - at > PIECE:
        end = max(text.rfind(" ", at + PIECE // 2, at + PIECE), at)
        if end == at:
            end = next((i for i in range(at + PIECE, at + PIECE // 2, -1) if text[i - 1 : i + 1].isascii()), at + PIECE)
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def judge(texts: list[str], model: Model) -> list[tuple[str | None, str] | None]:
    """For each text None if it's sound, else (original or None if it can't be restored, chain or kind of damage).

    Blanks around a text are kept. Texts longer than ``PIECE`` are judged in pieces: found if any of them is, restored
    if all found ones are.
    """
    out: list[tuple[str | None, str] | None] = [None] * len(texts)
    parts = {i: pieces(t) for i, t in enumerate(texts) if not t.isascii() or "?" in t}
    flat = [(i, p, x) for i, v in parts.items() for p, x in enumerate(v) if not x.isascii() or "?" in x]
    got: dict[int, dict[int, tuple[str | None, str]]] = {}
    for (i, p, _), r in zip(flat, _judged([x.strip(" ") for _, _, x in flat], model)):
        if r is not None:
            got.setdefault(i, {})[p] = r
    for i, found in got.items():
        whole = None
        if all(r[0] is not None for r in found.values()):
            whole = "".join(x.replace(x.strip(" "), str(found[p][0]), 1) if p in found else x for p, x in enumerate(parts[i]))
        out[i] = (whole, "; ".join(dict.fromkeys(r[1] for r in found.values())))
    return out


def _judged(core: list[str], model: Model) -> list[tuple[str | None, str] | None]:
    out: list[tuple[str | None, str] | None] = [None] * len(core)
    if not core:
        return out
    score = model.scores(core) + model.prior
    value = score[:, 0] - model.prior[0]
    plain = np.array([all(c.isascii() or c in model.known for c in v) for v in core])
    paged = np.array([chain[0][0] != "utf-8" for chain in model.chains])
    best = _best(core, score[:, 1:-DAMAGED] >= score[:, :1] - np.where(plain[:, None] & paged, PLAIN_GATE, GATE), value, model)
    for n, (_, k, text, whole, cut) in best.items():
        again = _judged([text], model)[0] if not text.isascii() and len(text) < len(core[n]) else None
        chain = chain_name(model.chains[k])
        if again is not None:
            chain = f"{again[1]} > {chain}"
        restored = again[0] if again is not None else text
        out[n] = (None if restored is None or cut or _damaged(restored) else restored, chain + ("" if whole else " (with loss)" if cut else " (in part)"))
    for n in np.flatnonzero(score[:, -DAMAGED:].max(axis=1) > score[:, 0] + MARGIN).tolist():
        if n not in best:
            out[n] = (None, "damaged")
    return out


def _best(core: list[str], tried: np.ndarray, value: np.ndarray, model: Model) -> dict[int, tuple[float, int, str, bool, bool]]:
    """Of the chains tried for each row, the one that gives the text that reads best: (gain, chain, text, whole, cut).

    Only rows that gain more than ``MARGIN`` are given back. A text restored in part pays for it, one cut off for the
    character and the end that it lacks, and every one for characters that sound values don't hold.
    """
    proposals: list[tuple[int, int, str, bool, bool]] = []
    for n, k in np.argwhere(tried).tolist():
        whole = invert(core[n], model.chains[k])
        if whole is not None:
            proposals.append((n, k, whole, True, False))
        elif (part := invert_part(core[n], model.chains[k])) is not None:
            proposals.append((n, k, part[0], False, part[1]))
    found: dict[int, tuple[float, int, str, bool, bool]] = {}
    for (n, k, text, whole, cut), s in zip(proposals, model.sound([p[2] for p in proposals])):
        gain = s + model.prior[k + 1] - (value[n] + model.prior[0]) - 12.0 * cut - 1.0 * (not whole) - (30.0 if _damaged(text) and not _damaged(core[n]) else 0.0) - STRANGE * len({c for c in text if not c.isascii() and c not in model.known})
        if gain > MARGIN and (n not in found or gain > found[n][0]):
            found[n] = (gain, k, text, whole, cut)
    return found


def _damaged(text: str) -> bool:
    """What no name holds: replacement and control characters, and question marks in place of letters."""
    return bool(re.search(r"\w\?+\w|\w\?\?+|\?\?+\w", text)) or any(c == "�" or (unicodedata.category(c) == "Cc" and c not in "\t\n\r") for c in text)


def _below(values: DataFrame, size: int, about: int) -> DataFrame:
    """The values whose hashes make up somewhat more than ``size`` distinct ones of ``about``."""
    return values.where(F.pmod(F.xxhash64("v", F.lit(5)), F.lit(1 << 32)) < F.lit(int(min(1.0, 1.5 * size / about) * (1 << 32))))


def sample(df: DataFrame, columns: list[str], size: int = SAMPLE) -> list[str]:
    """At most ``size`` distinct values of the columns, those with the smallest hashes: the same on every run."""
    values = df.select(F.explode(F.array(*[F.trim(F.col(c)) for c in columns])).alias("v")).where(F.length("v") > 0)
    about = values.agg(F.approx_count_distinct("v")).first()[0]
    # the cut on the hash comes first, so only the sample is made distinct
    few = values if about <= size else _below(values, size, about)
    return [r["v"] for r in hashed_sample(few.distinct(), ["v"], size, size).collect()]


def restored(df: DataFrame, id_col: str, columns: list[str], model: Model) -> DataFrame:
    """A row per garbled value: id, field, value, original (null: not restorable), chain.

    Nulls, blanks and plain ASCII are sound. Padding is kept around a restored text. Every distinct value is judged
    once, and the rows that hold a garbled one are found by a join on it, values of many rows being salted; ids needn't
    be unique.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    cells = df.select(F.col(id_col).alias("id"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("c")).select("id", "c.field", "c.value")
    cells = cells.where(F.col("value").rlike(r"[^\x00-\x7F]|\?"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column("value").to_pylist()
            found = [(v, *r) for v, r in zip(values, judge(values, sent.value)) if r is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], pa.string()) for i in range(3)], ["value", "original", "chain"])

    # as many tasks as there are for a shuffle: few bytes, but much work for each value
    values = cells.select("value").distinct().repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = written(values.mapInArrow(run, "value string, original string, chain string"), "garbled")
    return salted_join(cells, found, ["value"], F.col("id"), "inner").select(F.col("id").alias(id_col), "field", "value", "original", "chain")
