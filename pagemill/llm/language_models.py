"""Language identification by character language models with interpolated Kneser-Ney smoothing.

Every labelled training text is counted: tasks count the words of their texts, Spark adds them up, and each
distinct word of a language is turned into character n-grams once (it stands between blanks, ``" word "``); Spark
adds up the n-grams and works out the probabilities over the whole table.  Lower orders use
continuation counts (how many characters stand before an n-gram), except at the head of a word.  The model
holds every n-gram that was counted, so it grows with the input as the distinct n-grams do; only where a
caller sets ``max_grams`` does it keep, of all languages, the n-grams from a count on at which they fit, with
the probabilities of the whole table.  It is held as sorted arrays of 64-bit n-gram hashes beside their
log-probabilities and back-off weights, and words are scored by binary search.

The language with the lowest cross-entropy per character wins, ties by name.  Each worker remembers
scores of words, so equal words are looked up once.

Calibration uses at most ``calibration_docs`` labelled texts, each once and those with the smallest hash, of
a fold that is kept out of the counts.  From them come the temperature of ``score`` and, per language, how high
the cross-entropy of a text in that language may be: a text above it is ``rejected``.

Defined results: a null text or one without letters is ``und`` with score 0 and rejected; without any
labelled training text everything is ``und`` with score 0 and rejected; repeated rows and null ids stay;
an empty table gives no rows; other columns are ignored.  Null languages are not learned.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.batches import map_columns, texts
from pagemill.session import cut_lineage

ORDER = 5
CALIBRATION_DOCS = 4_000
KEPT_WORDS = 100_000  # a worker's memory of word scores; it is emptied when full
TASK_WORDS, TASK_GRAMS = 200_000, 500_000  # distinct words and n-grams that a counting task holds before it hands them on
DISCOUNT = 0.75
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased; nothing if no character is a letter."""
    found = _WORD.findall(text.lower())
    return found if any(map(str.isalpha, found)) or any(c.isalpha() for w in found for c in w) else []


def training_fold(doc_id: Column, folds: int = 4) -> Column:
    return F.crc32(doc_id.cast("string")) % folds


# --- counting ------------------------------------------------------------------------------------


def count_words(train: DataFrame) -> DataFrame:
    """``text, lang`` to ``lang, word, n`` over all rows."""

    def work(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict]:
        held: dict[str, Counter] = defaultdict(Counter)

        def hand_on() -> Iterator[dict]:
            for lang, words in held.items():
                if words:
                    yield {"lang": [lang] * len(words), "word": list(words), "n": list(words.values())}
            held.clear()

        for batch in batches:
            for text, lang in zip(texts(batch["text"]), batch["lang"].to_pylist(), strict=True):
                held[lang].update(words_of(text))
            if sum(map(len, held.values())) > TASK_WORDS:
                yield from hand_on()
        yield from hand_on()

    parts = map_columns(train.select("text", "lang"), "lang string, word string, n long", work)
    return parts.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _grams(words: dict[str, int], order: int) -> Counter:
    out: Counter = Counter()
    for word, n in words.items():
        marked = f" {word} "
        for size in range(1, order + 1):
            for i in range(size == 1, len(marked) - size + 1):  # a blank is not predicted by itself at the head of a word
                out[marked[i : i + size]] += n
    return out


def count_grams(train: DataFrame, order: int = ORDER) -> DataFrame:
    """``text, lang`` to ``lang, gram, n`` over all rows; each distinct word of a language is cut once."""

    def work(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict]:
        held: dict[str, Counter] = defaultdict(Counter)

        def hand_on() -> Iterator[dict]:
            for lang, grams in held.items():
                yield {"lang": [lang] * len(grams), "gram": list(grams), "n": list(grams.values())}
            held.clear()

        for batch in batches:
            words: dict[str, dict[str, int]] = defaultdict(dict)
            for lang, word, n in zip(*(batch[c].to_pylist() for c in ("lang", "word", "n")), strict=True):
                words[lang][word] = n
            for lang, own in words.items():
                held[lang].update(_grams(own, order))
            if sum(map(len, held.values())) > TASK_GRAMS:
                yield from hand_on()
        yield from hand_on()

    parts = map_columns(count_words(train), "lang string, gram string, n long", work)
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def prune(grams: DataFrame, max_grams: int) -> DataFrame:
    """The n-grams from the smallest count on at which they fit; counts are compared in quarter octaves."""
    level = F.floor(F.log2("n") * 4)
    levels = grams.groupBy(level.alias("level")).agg(F.count("*").alias("k")).orderBy(F.desc("level")).collect()
    total, least = 0, None
    for row in levels:  # at most 4 rows per doubling of the largest count
        total += row["k"]
        if total > max_grams:
            break
        least = row["level"]
    return grams.filter(level >= least) if least is not None else grams.filter(F.length("gram") == 1)


# --- the model -------------------------------------------------------------------------------------


def gram_hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams of each size, by the place of their first character.

    Characters run along the first axis; a second axis holds n-grams beside each other.
    """
    out = [(codes.astype(np.uint64) + np.uint64(1)) * _MIX]
    for n in range(2, order + 1):
        mixed = out[-1][: len(codes) - n + 1] * np.uint64(0xBF58476D1CE4E5B9)
        out.append((mixed ^ (mixed >> np.uint64(29))) + out[0][n - 1 :][: len(mixed)])
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Models:
    """All languages: per order the sorted n-gram hashes, and beside them a column per language.

    ``logs`` holds log2 probabilities (nan where a language lacks the n-gram), ``backoffs`` the log2 weight
    with which the n-gram as a context backs off (0 where it is none).
    """

    hashes: list[np.ndarray] = field(default_factory=list)
    logs: list[np.ndarray] = field(default_factory=list)
    backoffs: list[np.ndarray] = field(default_factory=list)
    unknown: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def find(self, size: int, wanted: np.ndarray) -> np.ndarray:
        """Places of n-grams, -1 for those that no language has."""
        known = self.hashes[size - 1]
        if not len(known):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        return np.where(known[at] == wanted, at, -1)


def fit_language(
    counts: dict[str, int], order: int, alphabet: int, discount: float = DISCOUNT
) -> tuple[list[dict[str, float]], list[dict[str, float]], float]:
    """Interpolated Kneser-Ney probabilities of n-grams, weights of contexts (both by size), and of the unknown."""
    by_size: list[dict[str, int]] = [{} for _ in range(order + 1)]
    for gram, n in counts.items():
        by_size[len(gram)][gram] = n
    for size in range(1, order):  # continuation counts, but for n-grams at the head of a word
        before: Counter = Counter(g[1:] for g in by_size[size + 1])
        for gram, n in by_size[size].items():
            by_size[size][gram] = n if size > 1 and gram[0] == " " else max(1, before[gram])
    lower: dict[str, float] = {}
    total, kinds = sum(by_size[1].values()) or 1, len(by_size[1])
    spread = discount * kinds / total if kinds else 1.0
    unknown = math.log2(spread / alphabet)
    for size in range(1, order + 1):
        sums, follow = Counter(), Counter()
        for gram, n in by_size[size].items():
            sums[gram[:-1]] += n
            follow[gram[:-1]] += 1
        weight = {c: discount * follow[c] / sums[c] for c in sums}
        current = {}
        for gram, n in by_size[size].items():
            context = gram[:-1]
            base = lower.get(gram[1:], 0.0) if size > 1 else 1 / alphabet
            if size > 1 and not base:  # pruned: back off step by step
                base = _backed_off(gram[1:], probs, weights, unknown)
            current[gram] = (n - discount) / sums[context] + weight[context] * base
        if size == 1:
            probs, weights = [current], [weight]
        else:
            probs.append(current)
            weights.append(weight)
        lower = current
    return probs, weights, unknown


def fit(counts: dict[str, dict[str, int]], order: int) -> Models:
    """Models of the languages, in order of their names."""
    alphabet = 1 + len({g for c in counts.values() for g in c if len(g) == 1})
    fitted = [fit_language(counts[lang], order, alphabet) for lang in sorted(counts)]
    models = Models(unknown=np.array([unknown for _, _, unknown in fitted]))
    for size in range(1, order + 1):
        grams = sorted(set().union(*(probs[size - 1] for probs, _, _ in fitted)))
        hashes = gram_hashes(_codes("".join(grams)).reshape(-1, size).T, size)[-1][0] if grams else np.zeros(0, np.uint64)
        logs = np.full((len(grams), len(fitted)), np.nan, np.float32)
        backoffs = np.zeros((len(grams), len(fitted)), np.float32)
        for k, (probs, weights, _) in enumerate(fitted):
            after = weights[size] if size < order else {}
            logs[:, k] = np.log2([probs[size - 1].get(g, np.nan) for g in grams])
            backoffs[:, k] = np.log2([after.get(g, 1.0) for g in grams])
        sort = np.argsort(hashes)
        models.hashes.append(hashes[sort])
        models.logs.append(logs[sort])
        models.backoffs.append(backoffs[sort])
    return models


def _backed_off(gram: str, probs: list[dict], weights: list[dict], unknown: float) -> float:
    factor = 1.0
    while gram:
        if gram in probs[len(gram) - 1]:
            return factor * probs[len(gram) - 1][gram]
        factor *= weights[len(gram) - 1].get(gram[:-1], 1.0)
        gram = gram[1:]
    return 2.0**unknown


def score_words(models: Models, words: list[str], order: int) -> np.ndarray:
    """Surprisal in bits of each word (its closing blank included) under each language."""
    lengths = np.array([len(w) + 1 for w in words])
    codes = _codes(" " + " ".join(words) + " ")
    grams = gram_hashes(codes, order)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    at = np.arange(1, len(codes))  # the predicted characters
    before = at - np.repeat(starts, lengths)  # characters of the word in front of it, its opening blank included
    bits = np.repeat(-models.unknown[None], len(at), axis=0)
    context = models.find(1, grams[0])[:-1]  # by predicted character: the place of what stands in front of it
    for size in range(1, order + 1):  # a longer match overrules, a missing one pays its context's weight
        if size > 1:
            paying = np.nonzero((before >= size - 1) & (context >= 0))[0]
            bits[paying] -= models.backoffs[size - 2][context[paying]]
        fits = np.nonzero(before >= size - 1)[0]
        place = models.find(size, grams[size - 1][at[fits] - size + 1])
        known, place = fits[place >= 0], place[place >= 0]
        logs = models.logs[size - 1][place]
        bits[known] = np.where(np.isnan(logs), bits[known], -logs)
        if size > 1:
            context = np.full(len(at), -1)
            context[known[known < len(at) - 1] + 1] = place[known < len(at) - 1]
    return np.add.reduceat(bits, starts)


@dataclass
class Classifier:
    langs: list[str]
    models: Models
    order: int
    temperature: float = 1.0
    highest: list[float] = field(default_factory=list)  # cross-entropy up to which a language is believed
    noise: list[float] = field(default_factory=list)  # how much more per root of a character

    def __post_init__(self) -> None:
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.scores, self.lengths = np.zeros((0, len(self.langs))), np.zeros(0)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "scores", "lengths")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def _learn(self, words: list[str]) -> None:
        parts = [score_words(self.models, words[a : a + 20_000], self.order) for a in range(0, len(words), 20_000)]
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.scores = np.concatenate([self.scores, *parts])
        self.lengths = np.concatenate([self.lengths, [len(w) + 1 for w in words]])

    def entropies(self, many: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text under each language, and the characters."""
        if len(self.known) > KEPT_WORDS:
            self._forget()
        self._learn(list(set().union(*many) - self.known.keys()))
        bits, length = np.zeros((len(many), len(self.langs))), np.zeros(len(many))
        for i, words in enumerate(many):
            if words:
                at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
                bits[i] = self.scores[at].sum(0)
                length[i] = self.lengths[at].sum()
        return bits / np.maximum(length, 1)[:, None], length

    def judge(self, entropy: np.ndarray, length: float) -> tuple[str, float, float, bool]:
        """Language, score, cross-entropy and whether the text is rejected."""
        if not self.langs or not length:
            return UNKNOWN, 0.0, 0.0, True
        best = int(np.argmin(entropy))
        weights = np.exp2(-(entropy - entropy[best]) * length**0.5 / self.temperature)
        limit = self.highest[best] + self.noise[best] / length**0.5 if self.highest else math.inf
        return self.langs[best], float(1 / weights.sum()), float(entropy[best]), bool(entropy[best] > limit)


def calibrate(classifier: Classifier, rows: list[tuple[str, list[float], float]]) -> None:
    """Set temperature and rejection limits from ``lang, entropies, characters`` of labelled texts."""
    langs = classifier.langs
    rows = [(langs.index(lang), np.array(e), n) for lang, e, n in rows if n and lang in langs]
    if not rows:
        return
    if len(langs) > 1:
        gaps = [((e - e[k]) * n**0.5, k) for k, e, n in rows]
        losses = {
            t: sum(math.log2(np.exp2(-np.maximum(g, -200 * t) / t).sum()) for g, _ in gaps)
            for t in (0.05, 0.1, 0.2, 0.4, 0.8, 1.6, 3.2, 6.4)
        }
        classifier.temperature = min(losses, key=losses.get)
    for k in range(len(langs)):
        own = np.array([(e[k], n) for j, e, n in rows if j == k]).reshape(-1, 2)
        if not len(own):  # nothing to judge by: believe all
            classifier.highest.append(math.inf)
            classifier.noise.append(0.0)
            continue
        mean = np.average(own[:, 0], weights=own[:, 1])
        classifier.noise.append(float(6 * np.sqrt(np.mean((own[:, 0] - mean) ** 2 * own[:, 1]))))
        classifier.highest.append(float(max(mean * 1.5, np.max(own[:, 0]))))


# --- Spark -----------------------------------------------------------------------------------------


def _measure(docs: DataFrame, classifier: Classifier) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def work(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict]:
        for batch in batches:
            entropy, length = shared.value.entropies([words_of(t) for t in texts(batch["text"])])
            yield {"lang": batch["lang"], "entropies": list(entropy), "length": length}

    narrow = docs.select("text", "lang")
    return map_columns(narrow, "lang string, entropies array<double>, length double", work)


def weigh(grams: DataFrame, order: int, discount: float = DISCOUNT) -> tuple[DataFrame, DataFrame]:
    """What ``fit_language`` works out, of a table ``lang, gram, n`` of any size.

    ``lang, gram, n, log, backoff`` (log2 of the probability and of the weight as a context), and the weights of
    the empty context, ``lang, weight``.
    """
    size = F.length("gram")
    before = grams.filter(size > 1).groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("before"))
    own = (size == order) | ((size > 1) & F.col("gram").startswith(" "))
    met = F.when(own, F.col("n")).otherwise(F.greatest(F.lit(1), F.coalesce("before", F.lit(0))))
    adjusted = grams.join(before, ["lang", "gram"], "left").select(
        "lang", "gram", "n", size.alias("size"), met.alias("met"), F.expr("left(gram, length(gram) - 1)").alias("context")
    )
    adjusted = cut_lineage(adjusted, "grams-met")
    spread = discount * F.count("*") / F.sum("met")
    contexts = adjusted.groupBy("lang", "context").agg(F.sum("met").alias("total"), spread.alias("weight"))
    contexts = cut_lineage(contexts, "grams-contexts")
    rest = F.expr("substring(gram, 2)").alias("rest")
    parts = adjusted.join(contexts, ["lang", "context"])
    parts = parts.select("lang", "gram", "n", "size", "weight", ((F.col("met") - discount) / F.col("total")).alias("p"), rest)
    back = contexts.filter("context <> ''").select("lang", F.col("context").alias("gram"), F.log2("weight").alias("backoff"))
    parts = cut_lineage(parts.join(back, ["lang", "gram"], "left"), "grams-parts")
    alphabet = 1 + grams.filter(size == 1).select("gram").distinct().count()
    levels, lower = [], None
    for k in range(1, order + 1):
        level = parts.filter(F.col("size") == k)
        base = F.lit(1 / alphabet)
        if lower is not None:
            shorter = lower.select("lang", F.col("gram").alias("rest"), F.col("probability").alias("shorter"))
            level, base = level.join(shorter, ["lang", "rest"]), F.col("shorter")
        level = level.select("lang", "gram", "n", (F.col("p") + F.col("weight") * base).alias("probability"), "backoff")
        lower = cut_lineage(level, "grams-level")
        levels.append(lower)
    whole = levels[0]
    for level in levels[1:]:
        whole = whole.unionByName(level)
    weighed = whole.select("lang", "gram", "n", F.log2("probability").alias("log"), F.coalesce("backoff", F.lit(0.0)).alias("backoff"))
    return weighed, contexts.filter("context = ''").select("lang", (F.col("weight") / alphabet).alias("unknown"))


def load(weighed: DataFrame, unknown: DataFrame, order: int) -> tuple[list[str], Models]:
    """The languages in order of their names, and their models."""
    least = {r["lang"]: r["unknown"] for r in unknown.collect()}  # a row per language
    langs = sorted(least)
    models = Models(unknown=np.log2([least[lang] for lang in langs]))
    place = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1 if langs else F.lit(0)
    narrow = weighed.select("gram", place.cast("int").alias("k"), F.col("log").cast("float"), F.col("backoff").cast("float"))
    for size in range(1, order + 1):
        rows = narrow.filter(F.length("gram") == size).toArrow()
        codes = _codes("".join(rows.column("gram").to_pylist())).reshape(-1, size).T
        hashes, at = np.unique(gram_hashes(codes, size)[-1][0], return_inverse=True) if len(rows) else (np.zeros(0, np.uint64), [])
        logs, backoffs = np.full((len(hashes), len(langs)), np.nan, np.float32), np.zeros((len(hashes), len(langs)), np.float32)
        column = rows.column("k").to_numpy()
        logs[at, column], backoffs[at, column] = rows.column("log").to_numpy(), rows.column("backoff").to_numpy()
        models.hashes.append(hashes)
        models.logs.append(logs)
        models.backoffs.append(backoffs)
    return langs, models


def train(
    labelled: DataFrame,
    order: int = ORDER,
    max_grams: int | None = None,
    calibration_docs: int = CALIBRATION_DOCS,
) -> Classifier:
    """A classifier from ``doc_id, text, lang``; a sixteenth of the rows is the calibration fold."""
    rows = labelled.filter("text is not null and lang is not null").select("doc_id", "text", "lang")
    calibrating = F.pmod(F.xxhash64("doc_id", "text"), F.lit(16)) == 0
    counted = cut_lineage(count_grams(rows.filter(~calibrating), order), "grams")
    weighed, unknown = weigh(counted, order)
    langs, models = load(prune(weighed, max_grams) if max_grams else weighed, unknown, order)
    classifier = Classifier(langs, models, order)
    if langs:
        held = calibration_texts(rows.filter(calibrating), calibration_docs)
        measured = _measure(held, classifier).collect()  # numbers only, of a bounded sample
        calibrate(classifier, [(r["lang"], r["entropies"], r["length"]) for r in measured])
    return classifier


def calibration_texts(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, each text of a language once: those with the smallest hash."""
    hashed = rows.withColumn("h", F.xxhash64("text"))
    least = hashed.select("h", "lang").distinct().orderBy("h", "lang").limit(most).agg(F.max("h")).first()[0]
    held = hashed.filter(F.col("h") <= least) if least is not None else hashed.limit(0)
    return held.dropDuplicates(["lang", "h"]).limit(most)


def language_of(text: Column | str, classifier: Classifier, spark: SparkSession) -> Column:
    """``lang_pred, score, entropy, rejected`` of a text, as one struct."""
    shared = spark.sparkContext.broadcast(classifier)

    @F.arrow_udf("lang_pred string, score double, entropy double, rejected boolean")
    def judge(column: pa.Array) -> pa.Array:
        entropy, length = shared.value.entropies([words_of(t) for t in texts(column)])
        judged = [shared.value.judge(e, n) for e, n in zip(entropy, length, strict=True)]
        lang, score, bits, rejected = zip(*judged, strict=True) if judged else ([],) * 4
        columns = [
            pa.array(lang, pa.string()),
            pa.array(score, pa.float64()),
            pa.array(bits, pa.float64()),
            pa.array(rejected, pa.bool_()),
        ]
        return pa.StructArray.from_arrays(columns, ["lang_pred", "score", "entropy", "rejected"])

    return judge(text)


def identify(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """``doc_id, text`` to ``doc_id, lang_pred, score, entropy, rejected``, row for row."""
    judged = language_of("text", classifier, docs.sparkSession).alias("judged")
    return docs.select("doc_id", judged).select("doc_id", "judged.*")


def keep_known(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """The rows whose text is not rejected, with all their columns."""
    return docs.filter(~language_of("text", classifier, docs.sparkSession)["rejected"])
