"""Language identification with interpolated Kneser-Ney character models."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER = 4
#: Bound of the training sample: documents per language, characters of a document that enter it, and documents of all
#: languages, which lowers the first where there are very many languages.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_ALL = 400, 20_000, 20_000
#: A text is rejected at MARGIN + SLACK / letters nats per character above the worst calibration document.
MARGIN, SLACK = 0.75, 30.0
#: A text with fewer letters is never rejected for its entropy.
MIN_LETTERS = 50
#: Words whose scores a Python worker remembers.
REMEMBERED = 300_000
_LETTERS = regex.compile(r"\p{L}+")
_EDGE = 0x110000
_MUL = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 16


def words_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All words' code points, each word between edge marks, and the start of each word's row."""
    flat = np.frombuffer("\n".join(["", *words, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    flat = np.where(flat == 10, _EDGE, flat)
    return flat, np.nonzero(flat == _EDGE)[0]


def _grams(flat: np.ndarray) -> list[np.ndarray]:
    """For k = 0 to ORDER: hashes of the k characters that end at each position, never across a word's start edge.

    Position i of grams[k] is 0 where fewer than k characters stand in the word up to i.
    """
    out = [np.ones(len(flat), np.uint64)]
    hashed = (flat + np.uint64(1)) * _MUL
    hashed ^= hashed >> np.uint64(29)
    edge = flat == _EDGE
    whole = np.ones(len(flat), bool)
    gram = np.zeros(len(flat), np.uint64)
    for k in range(1, ORDER + 1):
        shifted = np.zeros(len(flat), np.uint64)
        shifted[k - 1 :] = hashed[: len(flat) - k + 1] if k > 1 else hashed
        whole[: k - 1] = False
        if k > 2:  # an edge may begin or end a gram, not stand inside
            whole[k - 2 :] &= ~edge[: len(flat) - k + 2]
        gram = (gram ^ shifted) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)
        gram ^= gram >> np.uint64(31)
        out.append(np.where(whole, gram | np.uint64(1), np.uint64(0)))
    return out


@dataclass
class Language:
    """One language's model. Per order k: sorted hashes of its grams with discounted probabilities, sorted hashes of its contexts with back-off weights."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]


def _look(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, absent: float) -> np.ndarray:
    known, values = table
    if not len(known):
        return np.full(len(keys), absent)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], absent)


@dataclass
class KneserNey:
    langs: list[str]
    models: list[Language]
    floor: float
    ceiling: np.ndarray
    heat: float

    def score_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(words x languages) log probabilities and each word's number of predicted characters, an end mark included.

        Characters are scored in blocks, so a long word holds no more than its hashes.
        """
        out = np.zeros((len(words), len(self.langs)))
        if not words:
            return out, np.zeros(0, np.int64)
        flat, starts = _codes(words)
        grams = _grams(flat)
        owner = np.repeat(np.arange(len(words)), np.diff(starts))
        for lo in range(1, len(flat), _BLOCK):
            hi = min(len(flat), lo + _BLOCK)
            asked = []
            for k in range(1, ORDER + 1):
                gram, context = grams[k][lo:hi], grams[k - 1][lo - 1 : hi - 1] if k > 1 else grams[0][lo:hi]
                use = np.nonzero(gram)[0]
                # Sorted keys make the searches of all languages local; equal ones are looked up once.
                both, back = np.unique(gram[use], return_inverse=True)
                heads, head_back = np.unique(context[use], return_inverse=True)
                asked.append((use, both, back, heads, head_back))
            for column, model in enumerate(self.models):
                p = np.full(hi - lo, self.floor)
                for k, (use, both, back, heads, head_back) in enumerate(asked, 1):
                    p[use] = _look(model.grams[k], both, 0.0)[back] + _look(model.contexts[k], heads, 1.0)[head_back] * p[use]
                out[:, column] += np.bincount(owner[lo - 1 : hi - 1], np.log(p), len(words))
        return out, np.diff(starts)


def _fitted(words: Counter) -> Language:
    """Interpolated Kneser-Ney of one language's words and their counts, an absolute discount per order."""
    types = list(words)
    none = np.empty(0, np.uint64), np.empty(0)
    model = Language([none] * (ORDER + 1), [none] * (ORDER + 1))
    if not types:
        return model
    flat, starts = _codes(types)
    grams = _grams(flat)
    times = np.repeat(np.array([words[w] for w in types], np.float64), np.diff(starts))
    for k in range(ORDER, 0, -1):
        gram, context = grams[k][1:], grams[k - 1][:-1] if k > 1 else grams[0][1:]
        use = gram != 0
        keys, first, back = np.unique(gram[use], return_index=True, return_inverse=True)
        if not len(keys):
            continue
        raw = np.bincount(back, times[use], len(keys))
        if k == ORDER:
            count = raw
        else:
            # Continuations: the distinct longer grams that end in this one; grams at a word's start keep their counts.
            longer = grams[k + 1][1:]
            first_longer = np.unique(longer[longer != 0], return_index=True)[1]
            count = np.bincount(np.searchsorted(keys, gram[longer != 0][first_longer]), minlength=len(keys)).astype(np.float64)
            count = np.where(count > 0, count, raw)
        once, twice = (count == 1).sum(), (count == 2).sum()
        discount = min(0.95, once / (once + 2 * twice)) if once else 0.5
        heads, of = np.unique(context[use][first], return_inverse=True)
        total, kinds = np.bincount(of, count, len(heads)), np.bincount(of, minlength=len(heads))
        model.grams[k] = keys, (count - discount) / total[of]
        model.contexts[k] = heads, discount * kinds / total
    return model


def train(sample: list[tuple[str, str]]) -> KneserNey | None:
    """Models of (language, text) pairs; every fifth text calibrates the ceilings and the confidence."""
    split = [(lang, words_of(text)) for lang, text in sample]
    split = [x for x in split if x[1]]
    if not split:
        return None
    langs = sorted({lang for lang, _ in split})
    column = {x: k for k, x in enumerate(langs)}
    seen: dict[int, int] = defaultdict(int)
    fit, held = [Counter() for _ in langs], []
    for lang, words in split:
        seen[lang] += 1
        if seen[lang] % 5 == 0:
            held.append((column[lang], words))
        else:
            fit[column[lang]].update(words)
    alphabet = 1 + len({c for words in fit for w in words for c in w})
    model = KneserNey(langs, [_fitted(words) for words in fit], 1.0 / (alphabet + 1), np.full(len(langs), math.inf), 1.0)
    results = []
    for lang, words in held:
        logp, n = model.score_words(words)
        results.append((lang, -logp.sum(axis=0) / n.sum(), sum(map(len, words))))
    for lang in range(len(langs)):
        own = [h[lang] for truth, h, letters in results if truth == lang and letters >= MIN_LETTERS]
        if own:
            model.ceiling[lang] = max(own) + MARGIN
    if results:
        truth, entropy = np.array([r[0] for r in results]), np.stack([r[1] for r in results])

        def loss(heat: float) -> float:
            z = -heat * (entropy - entropy.min(axis=1, keepdims=True))
            return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(truth)), truth]))

        model.heat = min((2.0**k for k in range(-2, 8)), key=loss)
    return model


class Scorer:
    """Scores documents in a Python worker, remembering short words' scores."""

    def __init__(self, model: KneserNey) -> None:
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.model.langs) + 1), np.float32)

    def _learn(self, words: list[str]) -> None:
        for k in range(0, len(words), 20_000):
            some = words[k : k + 20_000]
            logp, n = self.model.score_words(some)
            end = len(self.place) + len(some)
            if end > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((max(end, len(self.rows)), self.rows.shape[1]), np.float32)])
            self.rows[len(self.place) : end, :-1] = logp
            self.rows[len(self.place) : end, -1] = n
            self.place.update(zip(some, range(len(self.place), end), strict=True))

    def scores(self, texts: list[str | None]) -> tuple[list, list, list, list]:
        if len(self.place) > REMEMBERED:
            self.forget()
        split = [words_of(t) if t else [] for t in texts]
        place = self.place
        new = {w for words in split for w in words if w not in place}
        long = {w for w in new if len(w) > 64}
        self._learn(sorted(new - long))
        lang, score, reject, best_entropy = [], [], [], []
        for words in split:
            if not words:
                lang.append("und"), score.append(0.0), reject.append(True), best_entropy.append(None)
                continue
            short = [w for w in words if w not in long] if long else words
            total = self.rows[np.fromiter(map(self.place.__getitem__, short), np.int64, len(short))].sum(axis=0, dtype=np.float64)
            for w in words if long else ():
                if w in long:
                    logp, n = self.model.score_words([w])
                    total[:-1] += logp[0]
                    total[-1] += n[0]
            entropy = -total[:-1] / total[-1]
            best = int(entropy.argmin())
            lang.append(self.model.langs[best])
            score.append(float(1 / np.exp(-self.model.heat * (entropy - entropy[best])).sum()))
            best_entropy.append(float(entropy[best]))
            letters = sum(map(len, words))
            reject.append(letters >= MIN_LETTERS and bool(entropy[best] > self.model.ceiling[best] + SLACK / letters))
        return lang, score, reject, best_entropy


_SCORERS: dict[int, Scorer] = {}


def _predict(shared, added: tuple[str, ...]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.value is not None:
            key = hash((*shared.value.langs, *(m.grams[ORDER][0].tobytes() for m in shared.value.models)))
            if key not in _SCORERS:
                _SCORERS.clear()
                _SCORERS[key] = Scorer(shared.value)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                texts = batch.column(batch.num_columns - 1).to_pylist()
                if shared.value is None:
                    n = len(texts)
                    lang, score, reject, entropy = ["und"] * n, [0.0] * n, [not (t and _LETTERS.search(t)) for t in texts], [None] * n
                else:
                    lang, score, reject, entropy = _SCORERS[key].scores(texts)
                extra = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(reject, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *extra], names=[*batch.schema.names[:-1], *added])

    return run


def training_sample(docs: DataFrame, text_col: str, lang_col: str, order: str, docs_per_lang: int = SAMPLE_DOCS, docs_in_all: int = SAMPLE_ALL) -> list[tuple[str, str]]:
    """Per language the documents of least hash, at most docs_per_lang and docs_in_all together, but two of each language.

    Of a text of more than SAMPLE_CHARS characters that many enter, from a place that its hash gives.
    """
    rows = docs.select(lang_col, text_col, order).where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).withColumn("_hash", F.pmod(F.xxhash64(order), F.lit(1 << 40)))
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not sizes:
        return []
    each = max(2, min(docs_per_lang, docs_in_all // len(sizes)))
    # By the languages' counts few more hashes than needed are let through to the sort.
    cuts = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, (2 * each + 50) / n) * (1 << 40)))])
    start = F.pmod(F.col("_hash"), F.greatest(F.lit(1), F.length(text_col) - SAMPLE_CHARS + 1)).cast("int")
    piece = F.substring(F.col(text_col), start + 1, F.lit(SAMPLE_CHARS))
    some = rows.where(F.col("_hash") < F.element_at(cuts, F.col(lang_col))).select(lang_col, piece.alias("piece"), "_hash", order)
    w = Window.partitionBy(lang_col).orderBy("_hash", order, "piece")
    some = some.withColumn("_place", F.row_number().over(w))
    return sorted((r[0], r[1]) for r in some.where(F.col("_place") <= each).select(lang_col, "piece").collect())


def predict_language(docs: DataFrame, model: KneserNey | None, text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str, str, str] = ("lang_pred", "score", "entropy", "rejected")) -> DataFrame:
    """The kept columns of docs with lang_pred, score, entropy and rejected, or other names for them; one row per document.

    lang_pred has the lowest cross-entropy per character over the text's words of letters; score
    is the calibrated probability of it. Texts are read in lower case, word by word: a word is a run of letters, scored
    alone with its two edges, so no gram spans a blank; a null or repeated id is passed through. Null texts and texts without a letter are `und` with
    score 0 and rejected; without a model every text is `und`. Others are rejected if their
    entropy lies above the language's calibrated ceiling and they have MIN_LETTERS letters.
    """
    keep = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias("__tg_text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(_predict(shared, names), ", ".join([*kinds, *(f"{n} {t}" for n, t in zip(names, ("string", "double", "double", "boolean"), strict=True))]))


def learnable(docs: DataFrame) -> DataFrame:
    """The documents outside the held-out fold: crc32 of doc_id as text, modulo 4, is not 2."""
    return docs.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4) != 2)
