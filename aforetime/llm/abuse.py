"""Scores for abusive, hateful or sexually explicit text.

A text is cut into segments (sentences, comments, strings, output lines),
their spelling is normalised, and a linear model on words and pairs of words
scores each; a document's score is that of its worst segment.

The model is fitted by non-negative positive-unlabelled learning: documents
with a confirmed toxic label are the positives; documents of the corpus that
nobody reviewed and reviewed ones without a confirmed label (some labels are
mistaken) are the unlabelled part. The class-prior-corrected risk of the
unlabelled part is kept from going below zero. No segment is labelled;
gradients reach the segment that decides a document.

The model is fitted on the driver, on a bounded sample: of each of the three
kinds at most SAMPLE_AT_MOST documents and CHARACTERS_AT_MOST characters, whole
documents of at most DOCUMENT_AT_MOST characters with the lowest hashes. All
documents are scored.

Defined results
---------------
* Null, empty and wordless texts score 0. Whole texts are read.
* One row per row, repeated rows included. With no confirmed toxic label every
  score is 0. Empty tables give no rows. Further columns are ignored.
* Of several labels of a document the majority decides, a tie counts as toxic;
  null labels don't count.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aforetime.llm.text import plain
from aforetime.storage import written

#: Documents that the model is fitted on, at most, of each kind: confirmed, reviewed otherwise, not reviewed.
SAMPLE_AT_MOST = 6_000
#: Characters of their distinct segments, at most, of each kind.
CHARACTERS_AT_MOST = 32_000_000
#: Characters of the distinct segments of one document of the sample; larger ones aren't fitted on.
DOCUMENT_AT_MOST = 2_000_000
#: Words and pairs in fewer of those documents are no features.
FEWEST_DOCUMENTS = 3
#: Class prior: the share of toxic documents in the unlabelled part that the risk is corrected by.
PRIOR = 0.05
EPOCHS = 60
RATE = 0.5
DECAY = 1e-5
WINDOW = 24
#: Added to a segment's number of features before its evidence is scaled by their root: few words alone are weak evidence.
SMOOTHING = 3
#: Score from which a document counts as toxic (a little below one half: better reviewed than missed).
THRESHOLD = 0.45
CACHED_SEGMENTS = 200_000

# Characters that look like Latin letters.
LOOKALIKES = str.maketrans(
    "аеорсухіјѕԁһӏвкмнтαεορτυικνγ", "aeopcyxijsdhlbkmhtaeoptuikvy"
)
# Digits and signs written for letters.
LEET = str.maketrans("@4031$5!7", "aaoeissit")

_RUNS = re.compile(r"[^\n\r\"“”„«»|{}<>;]{2,}")
_SENTENCE = re.compile(r"[.!?。！？]+(?=\s|$)|(?<=[。！？])|\s{3,}")
# two letters with at most two other signs between: words, also spelt with blanks or digits
_HAS_WORDS = re.compile(r"[^\W\d_][\W\d_]{0,2}[^\W\d_]")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_*]){2,}[^\W\d_](?![^\W_])")
_TOKEN = re.compile(r"[^\W\d_](?:[\w@$!*'’]*[^\W_])?")
_RUN = re.compile(r"(.)\1+")
_CJK = re.compile(r"[぀-ヿ一-鿿]")
# numbers; digits beside letters may stand for letters
_DIGITS = re.compile(r"(?<![^\W_])\d+(?![^\W_])")


def cut(text: str) -> list[str]:
    """Segments of a document that hold words, with numbers as 0."""
    out = []
    for run in dict.fromkeys(_RUNS.findall(plain(text))):
        if _HAS_WORDS.search(run):
            out.extend(_SENTENCE.split(_DIGITS.sub("0", run)))
    return [s for s in out if s]


@lru_cache(maxsize=200_000)
def _spelling(token: str) -> tuple[str, ...]:
    """A token without masks and stretched letters; a masked one begins with *, Japanese is cut into pairs."""
    masked = "*" in token
    if not token.isalpha():
        token = re.sub(r"[\W_]", "", token.translate(LEET))
    if _CJK.search(token):
        return tuple(token[i : i + 2] for i in range(max(1, len(token) - 1)))
    return (("*" if masked else "") + _RUN.sub(r"\1", token),)


def tokens(segment: str) -> list[str]:
    """Words of a segment in one spelling: lower case, no accents, look-alikes, masks or stretched letters."""
    s = segment.lower()
    if not s.isascii():
        s = unicodedata.normalize("NFKD", s.translate(LOOKALIKES))
        s = "".join([c for c in s if not unicodedata.combining(c)])
    if _SPACED.search(s):
        s = _SPACED.sub(lambda m: re.sub(r"[ .\-_*]", "", m[0]), s)
    return [part for token in _TOKEN.findall(s) for part in _spelling(token)]


def windows(segment: str) -> Iterator[list[str]]:
    """A segment's words in stretches of at most WINDOW words, half overlapping."""
    words = tokens(segment)
    if len(words) <= WINDOW:
        if words:
            yield words
        return
    for start in range(0, len(words) - WINDOW // 2, WINDOW // 2):
        yield words[start : start + WINDOW]


def features(words: list[str]) -> set[str]:
    """Words and pairs of neighbouring words."""
    return {*words, *map(" ".join, zip(words, words[1:], strict=False))}


class Model:
    """Weights of words and pairs, and the words that masked spellings may stand for."""

    def __init__(self, weights: dict[str, float], bias: float, unmasked: dict[str, str]):
        self.weights, self.bias, self.unmasked = weights, bias, unmasked

    def clear(self, words: list[str]) -> list[str]:
        return [self.unmasked.get(w[1:], w[1:]) if w[0] == "*" else w for w in words]

    def logit(self, words: list[str]) -> float:
        names = features(self.clear(words))
        return sum(map(self.weights.get, names & self.weights.keys())) / (len(names) + SMOOTHING) ** 0.5 + self.bias


def masks(words: Counter) -> dict[str, str]:
    """Spellings with one letter left out → the most frequent word they may stand for."""
    out: dict[str, str] = {}
    for word, _ in words.most_common():
        if len(word) >= 4 and " " not in word and word[0] != "*":
            for i in range(1, len(word)):
                out.setdefault(_RUN.sub(r"\1", word[:i] + word[i + 1 :]), word)
    return out


def fit(positive: list[list[str]], unlabelled: list[list[str]], prior: float = PRIOR) -> Model:
    """The model that minimises the non-negative PU risk of the documents' worst segments.

    Documents are lists of segments, segments their words with blanks between.
    Risk: π·E₊[ℓ(f)] + max(0, Eᵤ[ℓ(−f)] − π·E₊[ℓ(−f)]) with the logistic loss;
    where the second part is negative only its gradient is followed, reversed.
    """
    positive, unlabelled = [d for d in positive if d], [d for d in unlabelled if d]
    if not positive or not unlabelled:
        return Model({}, -np.inf, {})
    n = len(positive)
    shares = [Counter(w for d in part for w in {w for s in d for w in s.split(" ")}) for part in (positive, unlabelled)]
    typical = {w: c / n - shares[1][w] / len(unlabelled) for w, c in shares[0].items()}
    draft = Model({}, 0.0, masks(Counter({w: v for w, v in typical.items() if v > 0})))
    number: dict[str, int] = {}
    segment_no: dict[str, int] = {}
    coded: list[np.ndarray] = []
    members: list[np.ndarray] = []
    for document in [*positive, *unlabelled]:
        rows = set()
        for segment in document:
            if segment not in segment_no:
                segment_no[segment] = len(coded)
                found = features(draft.clear(segment.split(" ")))
                coded.append(np.array([number.setdefault(f, len(number)) for f in found], dtype=np.int32))
            rows.add(segment_no[segment])
        members.append(np.array(sorted(rows), dtype=np.int64))

    def presence(of: list[np.ndarray]) -> np.ndarray:
        count = np.zeros(len(number), dtype=np.int64)
        for rows in of:
            count[np.unique(np.concatenate([coded[r] for r in rows]))] += 1
        return count

    in_positive, in_other = presence(members[:n]), presence(members[n:])
    kept = in_positive + in_other >= FEWEST_DOCUMENTS
    names = [f for f, k in zip(number, kept, strict=True) if k]
    place = np.cumsum(kept) - 1
    segments = [place[found[kept[found]]] for found in coded]
    scale = np.array([1 / (len(found) + SMOOTHING) ** 0.5 for found in coded])
    lengths = np.array([len(s) for s in segments], dtype=np.int64)
    columns = np.concatenate(segments)
    owner = np.repeat(np.arange(len(segments)), lengths)
    # first guess: how much likelier a feature is in a positive document
    likelier = np.log((in_positive[kept] + 0.5) / (n + 1)) - np.log((in_other[kept] + 0.5) / (len(unlabelled) + 1))
    weights, bias = np.clip(likelier, -3, 3) * 0.5, -1.0
    grown, grown_bias = np.full(len(names), 1e-8), 1e-8
    bag = np.concatenate(members)
    sizes = np.array([len(m) for m in members], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    firsts = np.cumsum(lengths) - lengths
    for _ in range(EPOCHS):
        logit = np.bincount(owner, weights[columns], len(segments)) * scale + bias
        f = np.maximum.reduceat(logit[bag], begins)
        top = np.flatnonzero(logit[bag] == np.repeat(f, sizes))
        worst = bag[top[np.searchsorted(top, begins)]]
        sure = 1 / (1 + np.exp(-f))
        loss_minus = np.logaddexp(0, f)
        rest = loss_minus[n:].mean() - prior * loss_minus[:n].mean()
        sign = 1.0 if rest >= 0 else -1.0
        gradient = np.empty(len(worst))
        gradient[:n] = prior * (sure[:n] - 1) / n * (rest >= 0) - sign * prior * sure[:n] / n
        gradient[n:] = sign * sure[n:] / (len(worst) - n)
        long = lengths[worst]
        at = np.repeat(firsts[worst] - (np.cumsum(long) - long), long) + np.arange(long.sum())
        step = np.bincount(columns[at], np.repeat(gradient * scale[worst], long), len(names))
        step += DECAY * weights
        grown += step**2
        weights -= RATE * step / np.sqrt(grown)
        grown_bias += gradient.sum() ** 2
        bias -= 0.2 * RATE * gradient.sum() / np.sqrt(grown_bias)
    return Model(dict(zip(names, weights.tolist(), strict=True)), float(bias), draft.unmasked)


def segments_of(text: str | None) -> list[str]:
    """Distinct segments of a document in normal spelling."""
    return sorted({" ".join(w) for s in set(cut(text or "")) for w in windows(s)})


def _near(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The rows of df (of which there are `rows`) with the lowest hashes of the key, about twice SAMPLE_AT_MOST, with `_order`."""
    share = min(1.0, 2 * SAMPLE_AT_MOST / max(1, rows))
    return df.withColumn("_order", F.xxhash64(key)).where(F.col("_order").cast("double") < share * 2.0**64 - 2.0**63)


def reviewed(labels: DataFrame, *, key: str = "doc_id", label: str = "label") -> DataFrame:
    """(key, toxic) of all labelled documents."""
    harmless = F.lower(F.trim(label)) == "none"
    return (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
        .groupBy(key)
        .agg((F.avg(F.when(harmless, 0.0).otherwise(1.0)) >= 0.5).alias("toxic"))
    )


def sample(documents: DataFrame, labels: DataFrame, *, key: str = "doc_id", label: str = "label") -> DataFrame:
    """(key, kind, _order) of the documents the model is fitted on."""
    votes = written(reviewed(labels, key=key, label=label), "votes")
    counts = {r["toxic"]: r["count"] for r in votes.groupBy("toxic").count().collect()}
    ids = _near(documents.select(key).where(F.col(key).isNotNull()), key, documents.count()).distinct()
    kinds = {
        "confirmed": _near(votes.where("toxic").select(key), key, counts.get(True, 0)),
        "reviewed": _near(votes.where("not toxic").select(key), key, counts.get(False, 0)),
        "corpus": ids.join(votes, key, "left_anti"),
    }
    chosen = [
        df.orderBy("_order", key).limit(SAMPLE_AT_MOST).select(key, F.lit(kind).alias("kind"), "_order") for kind, df in kinds.items()
    ]
    return chosen[0].unionByName(chosen[1]).unionByName(chosen[2])


def fit_reviewed(documents: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text") -> Model:
    """The model of the sampled documents; their distinct segments, of bounded size, reach the driver."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut_up = [segments_of(t) for t in batch.column(2).to_pylist()]
            sizes = pa.array([sum(map(len, c)) for c in cut_up], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], sizes, pa.array(cut_up, pa.list_(pa.string()))], names=["kind", "_order", "size", "segments"]
            )

    chosen = sample(documents, labels, key=key)
    held = documents.select(key, text).join(F.broadcast(chosen), key).select("kind", "_order", text)
    # at most three times SAMPLE_AT_MOST documents
    split_up = held.mapInArrow(split, "kind string, _order bigint, size bigint, segments array<string>")
    segments = written(split_up.where(F.col("size") <= DOCUMENT_AT_MOST), "segments")
    upto = F.sum("size").over(Window.partitionBy("kind").orderBy("_order", "segments").rowsBetween(Window.unboundedPreceding, 0))
    rows = segments.withColumn("_upto", upto).where(F.col("_upto") <= CHARACTERS_AT_MOST).select("kind", "segments").collect()
    rows.sort(key=lambda r: r["segments"])
    confirmed = [r["segments"] for r in rows if r["kind"] == "confirmed"]
    return fit(confirmed, [r["segments"] for r in rows if r["kind"] != "confirmed"])


def score(
    documents: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """(key, kept columns, score) of every document; the score is the chance that its worst segment is toxic."""
    shipped = documents.sparkSession.sparkContext.broadcast(model)  # at most a few words and pairs per fitted segment

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shipped.value
        known: dict[str, float] = {}

        def worst(segment: str) -> float:
            if (logit := known.get(segment)) is None:
                logit = max(map(held.logit, windows(segment)), default=-np.inf)
                if len(known) >= CACHED_SEGMENTS:
                    known.clear()
                known[segment] = logit
            return logit

        for batch in batches:
            logits = np.array(
                [max(map(worst, cut(t)), default=-np.inf) if t else -np.inf for t in batch.column(1).to_pylist()]
            )
            scores = pa.array(1 / (1 + np.exp(-np.clip(logits, -700, 700))) * (logits > -np.inf))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *batch.columns[2:], scores], names=[key, *keep, "score"]
            )

    types = [f"{c} {documents.schema[c].dataType.simpleString()}" for c in (key, *keep)]
    return documents.select(key, text, *keep).mapInArrow(run, ", ".join([*types, "score double"]))
