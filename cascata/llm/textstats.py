"""Dense text statistics of whole texts, computed batch-wise with numpy, for the two classifiers."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, give_up_kept, text_view

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "sentence": b".,;:?",
    "loud": b"!",
    "symbol": b"*$%&#|@^~<>{}[]\\=+_",
    "space": b" ",
    "line": b"\n",
}
CLASS_NAMES = (*_CLASSES, "high")


def _masks() -> np.ndarray:
    table = np.zeros((len(CLASS_NAMES), 256), np.uint8)
    for k, (_, members) in enumerate(_CLASSES.items()):
        table[k, list(members)] = 1
    table[-1, 128:] = 1
    return table


_TABLE = _masks()


def class_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(documents x classes) byte counts of CLASS_NAMES, and bytes per document."""
    buf, offsets = text_view(column)
    n = len(offsets) - 1
    out = np.zeros((n, len(CLASS_NAMES)), np.int64)
    for lo, hi in chunks(offsets):
        part, at = buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        if not len(part):
            continue
        for k in range(len(CLASS_NAMES)):
            total = np.concatenate(([0], np.cumsum(_TABLE[k][part], dtype=np.int64)))
            out[lo:hi, k] = total[at[1:]] - total[at[:-1]]
    return out, np.diff(offsets)


# Insults and their common forms in the corpus' languages, and second-person words.
INSULTS = frozenset(
    "idiot idiots moron morons stupid stupidity dumb dumbass fool fools loser losers clown clowns trash garbage scum filth filthy "
    "worthless pathetic disgusting useless ugly retard retarded imbecile jerk bastard bitch asshole crap shit fuck fucking "
    "vermin parasite freak creep liar disgrace coward hateful "
    "idiotisch dumm dummkopf trottel depp arschloch abschaum wertlos widerlich ekelhaft erbaermlich versager "
    "idiote stupide imbecile abruti connard salaud ordure minable degoutant pourriture "
    "idiota estupido imbecil tonto basura escoria inutil patetico asqueroso perdedor payaso cabron".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine tu te toi ton ta tes vous votre usted ti tus".split())
_WORD = re.compile(r"[^\W\d_]+")
#: Runs that a masked word may lie in, from letters that a sign or digit follows on, and the letters in them.
_RUN = re.compile(r"(?<![^\W\d_])[^\W\d_]++[*@$!#0-9](?:[^\W_]|[*@$!#])*+")
_PART = re.compile(r"[^\W\d_]+")
_MASKS = frozenset("*@$!#0123456789")
_LETTER = str.maketrans("0134578@$!", "oieastbasi")
#: Words between an insult and a second-person word that still count as near.
NEAR = 6

TOXICITY_FEATURES = (
    "insults", "insult_rate", "insult_kinds", "near_rate", "masked_insults", "masked_rate", "capital_rate", "shouted_rate", "loud_rate", "punctuation_rate", "symbol_rate", "digit_rate", "second_person_rate", "log_words",
    "learned", "learned_rate", "learned_kinds",
)
#: Lengths of the word beginnings that a learned lexicon may hold besides whole words.
STEMS = range(4, 10)
_CACHE = 1 << 17


def _unmask(token: str) -> bool:
    plain = token.translate(_LETTER)
    if plain in INSULTS:
        return True
    if "*" in token or "#" in token:
        pattern = re.compile("".join("." if c in "*#" else re.escape(c) for c in plain))
        return any(len(w) == len(plain) and pattern.fullmatch(w) for w in INSULTS)
    return False


def masked_words(low: str) -> list[str]:
    """Words with signs or digits inside, each from its first letter to its last, of a lower-case text.

    A word begins with a letter behind no letter or digit, and ends as far on as it can with a letter before
    none.  Every character is looked at a bounded number of times.
    """
    found = []
    for run in _RUN.finditer(low):
        token = run.group()
        free = not run.start() or not low[run.start() - 1].isalnum()
        parts = [m.span() for m in _PART.finditer(token)]
        k = 0
        while k < len(parts):
            last = k  # parts k to last are joined by signs and digits
            while last + 1 < len(parts) and _MASKS.issuperset(token[parts[last][1] : parts[last + 1][0]]):
                last += 1
            end = next((j for j in range(last, k, -1) if parts[j][1] == len(token) or not token[parts[j][1]].isalnum()), k)
            first = next((j for j in range(k, end) if (not token[parts[j][0] - 1].isalnum() if parts[j][0] else free)), end)
            if first < end:
                found.append(token[parts[first][0] : parts[end][1]])
            k = last + 1
    return found


def terms_of(text: str) -> set[str]:
    """The distinct lower-case words of a text (marked by a final space) and their beginnings."""
    words = set(_WORD.findall(text.lower()))
    return {w[:k] for w in words for k in STEMS if k <= len(w)} | {f"{w} " for w in words}


class ToxicityFeatures:
    """Kernel: (documents x TOXICITY_FEATURES); rates are per word, or per byte for characters.  Empty texts are all zero."""

    def __init__(self, lexicon: frozenset[str] = frozenset()):
        self.lexicon, self.known = lexicon, {}

    def __getstate__(self):
        return {"lexicon": self.lexicon, "known": {}}

    def learned(self, word: str) -> bool:
        hit = self.known.get(word)
        if hit is None:
            hit = f"{word} " in self.lexicon or any(word[:k] in self.lexicon for k in STEMS)
            if len(self.known) >= _CACHE:
                self.known.clear()
            self.known[word] = hit
        return hit

    def __call__(self, column: pa.Array) -> np.ndarray:
        counts, sizes = class_counts(column)
        at = {name: k for k, name in enumerate(CLASS_NAMES)}
        out = np.zeros((len(column), len(TOXICITY_FEATURES)))
        for i, text in enumerate(column.to_pylist()):
            if not text:
                continue
            low = text.lower()
            words = _WORD.findall(low)
            n = max(1, len(words))
            hits = [k for k, w in enumerate(words) if w in INSULTS]
            near = sum(any(w in SECOND_PERSON for w in words[max(0, k - NEAR) : k + NEAR + 1]) for k in hits)
            masked = masked_words(low)
            shouted = sum(1 for w in _WORD.findall(text) if len(w) > 1 and w.isupper()) if counts[i, at["upper"]] > 0.1 * sizes[i] else 0
            learned = list(filter(self.learned, words)) if self.lexicon else []
            out[i, :6] = len(hits), len(hits) / n, len({words[k] for k in hits}), near / n, sum(map(_unmask, masked)), len(masked) / n
            out[i, 7] = shouted / n
            out[i, 12:] = sum(1 for w in words if w in SECOND_PERSON) / n, np.log1p(len(words)), len(learned), len(learned) / n, len(set(learned))
        size = np.maximum(1, sizes)
        for k, names in ((6, ("upper",)), (8, ("loud",)), (9, ("sentence", "loud")), (10, ("symbol",)), (11, ("digit",))):
            out[:, k] = sum(counts[:, at[c]] for c in names) / size
        return out


QUALITY_FEATURES = ("upper_rate", "digit_rate", "sentence_rate", "loud_rate", "symbol_rate", "high_rate", "mean_word", "log_words", "distinct_rate", "repeat_rate", "line_words", "distinct_lines", "bar_rate", "stuck_rate", "top_share", "alpha_rate", "short", "end_rate")
_STUCK = re.compile(r"[*$%&#!]{2,}")


def quality_features(column: pa.Array) -> np.ndarray:
    """(documents x QUALITY_FEATURES): character make-up, repetition, line and sentence shape.  Empty texts are all zero."""
    counts, sizes = class_counts(column)
    at = {name: k for k, name in enumerate(CLASS_NAMES)}
    out = np.zeros((len(column), len(QUALITY_FEATURES)))
    for i, text in enumerate(column.to_pylist()):
        words = text.split() if text else []
        if not words:
            continue
        n = len(words)
        tally: dict[str, int] = {}
        for w in words:
            tally[w] = tally.get(w, 0) + 1
        lines = [x for x in text.split("\n") if x]
        repeat = sum(map(str.__eq__, words, words[1:]))
        out[i, 6:] = (
            min(30.0, len(text) / n), np.log1p(n), len(tally) / n**0.9, repeat / n, np.log1p(n / max(1, len(lines))), len(set(lines)) / max(1, len(lines)),
            tally.get("|", 0) / n, len(_STUCK.findall(text)) / n, max(tally.values()) / n, 0, n < 5, sum(1 for x in lines if x[-1] in ".!?") / max(1, len(lines)),
        )
    size = np.maximum(1, sizes)
    for k, name in enumerate(("upper", "digit", "sentence", "loud", "symbol", "high")):
        out[:, k] = counts[:, at[name]] / size
    out[:, QUALITY_FEATURES.index("alpha_rate")] = (counts[:, at["upper"]] + counts[:, at["lower"]] + counts[:, at["high"]]) / size
    return out


def feature_rows(docs: DataFrame, kernel, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the ``keep`` columns and the feature vector of every row."""

    def run(batches):
        give_up_kept()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                vectors = kernel(part.column(1))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1) * vectors.shape[1], pa.int32()), pa.array(vectors.ravel()))
                yield pa.record_batch([part.column(0), *[part.column(k + 2) for k in range(len(keep))], flat], names=["doc_id", *keep, "features"])

    kinds = dict(docs.dtypes)
    schema = ", ".join(["doc_id long", *[f"{c} {kinds[c]}" for c in keep], "features array<double>"])
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *keep).mapInArrow(run, schema)


def score_rows(docs: DataFrame, kernel, score) -> DataFrame:
    """doc_id and the score of every row; ``score`` maps a feature matrix to scores."""
    model = docs.sparkSession.sparkContext.broadcast(score)  # a fitted model: some KB, whatever the corpus

    def run(batches):
        predict = model.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                yield pa.record_batch([part.column(0), pa.array(predict(kernel(part.column(1))), pa.float64())], names=["doc_id", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def filter_rows(docs: DataFrame, kernel, score, threshold: float = 0.5) -> DataFrame:
    """The rows that score at least ``threshold``, with all their columns in one pass and without a join."""
    model = docs.sparkSession.sparkContext.broadcast(score)
    where = docs.columns.index("text")

    def run(batches):
        give_up_kept()
        predict = model.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                yield part.filter(pa.array(predict(kernel(part.column(where))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
