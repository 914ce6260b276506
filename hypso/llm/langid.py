"""Language identification by interpolated Kneser-Ney character models.

One model of order 4 for each language, learned from a bounded sample of labelled rows.
The models of all languages share sorted hash arrays: for each order the hashed n-grams
in ascending order, and beside them their interpolated log probability in every language;
for each context its back-off weight. A text's language is the one of least cross-entropy
per character. A text is marked as rejected if even that is above what almost all of the
language's own texts show.

Letters are lower-cased; whatever lies between them counts as one blank.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import exact, small_batches, table, with_row

ORDER = 4
#: The sample that is learned from: so many rows of each language, none of them longer than this, and so
#: many languages, those with the most rows.
SAMPLE_ROWS, SAMPLE_CHARS, LANGUAGES = 500, 20_000, 100
#: Letters that have numbers of their own, the most frequent ones: a symbol has 16 bits.
LETTERS = 65_000
#: Every so manieth row of the sample calibrates instead of teaching.
HELD = 5
#: Share of a language's own texts that rejection may cost.
REJECT = 0.001
UNDETERMINED = "und"

_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_BITS = 20


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, letters lower-cased and other runs as one 0, each text after
    ORDER - 1 zeros; and where each text starts (after its zeros), with the end at last."""
    pad = "\0" * (ORDER - 1)
    lower = [t.lower() for t in texts]
    points = np.frombuffer((pad + pad.join(lower)).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, lower), np.int64, len(lower)) + ORDER - 1
    starts = np.concatenate([[0], np.cumsum(sizes)])
    letter = _letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of others
    front = starts[:-1, None] + np.arange(ORDER - 1)
    keep[front.ravel()] = True
    places = np.concatenate([[0], np.cumsum(keep)])
    return np.where(letter, points, 0)[keep], places[starts]


class SortedHashes:
    """Distinct keys, hashed one to one and sorted, with an index by their leading bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        hashed = keys * _SPREAD
        order = np.argsort(hashed)
        self.hashes, self.values = hashed[order], values[order]
        self.first = np.searchsorted(self.hashes >> np.uint64(64 - _BITS), np.arange(1 << _BITS, dtype=np.uint64)).astype(np.int32)
        self.hashes = np.append(self.hashes, np.uint64(0xFFFFFFFFFFFFFFFF))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 if it is not there."""
        hashed = keys * _SPREAD
        at = self.first[(hashed >> np.uint64(64 - _BITS)).astype(np.int64)]
        open_ = np.flatnonzero(self.hashes[at] < hashed)
        while len(open_):
            at[open_] += 1
            open_ = open_[self.hashes[at[open_]] < hashed[open_]]
        found = (self.hashes[at] == hashed) & (at < len(self.values))
        return np.where(found, at, -1)


def _grams(ids: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each place from ORDER - 1 on, 16 bits a symbol."""
    n = len(ids) - (ORDER - 1)
    key = np.zeros(max(n, 0), np.uint64)
    for k in range(order):
        key = (key << np.uint64(16)) | ids[ORDER - order + k : ORDER - order + k + n].astype(np.uint64)
    return key


class _Counts:
    """A language's Kneser-Ney counts, for training."""

    def __init__(self, sequences: list[np.ndarray], alphabet: int):
        keys = np.concatenate([_grams(s, ORDER) for s in sequences])
        self.alphabet, self.levels = alphabet, {}
        types, counts = np.unique(keys, return_counts=True)
        for order in range(ORDER, 0, -1):
            contexts, which = np.unique(types >> np.uint64(16), return_inverse=True)
            ones, twos = (counts == 1).sum(), (counts == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            self.levels[order] = (types, counts, contexts, np.bincount(which, counts), np.bincount(which), discount)
            if order > 1:  # from here on, how many different symbols come before
                types, counts = np.unique(types & np.uint64((1 << 16 * (order - 1)) - 1), return_counts=True)

    @staticmethod
    def _at(table: np.ndarray, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
        if not len(table):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[at] == keys, values[at], 0)

    def backoff(self, order: int, contexts: np.ndarray) -> np.ndarray:
        _, _, known, totals, kinds, discount = self.levels[order]
        total = self._at(known, totals, contexts)
        return np.where(total > 0, discount * self._at(known, kinds, contexts) / np.maximum(total, 1), 1.0)

    def probability(self, order: int, keys: np.ndarray) -> np.ndarray:
        if order == 0:
            return np.full(len(keys), 1.0 / self.alphabet)
        types, counts, known, totals, _, discount = self.levels[order]
        context = keys >> np.uint64(16)
        lower = self.probability(order - 1, keys & np.uint64((1 << 16 * (order - 1)) - 1))
        total = self._at(known, totals, context)
        own = np.maximum(self._at(types, counts, keys) - discount, 0) / np.maximum(total, 1)
        return own + self.backoff(order, context) * lower


class Model:
    """Models of several languages in shared sorted hash arrays."""

    def __init__(self, rows: list[tuple[str, str]]):
        """rows: (language, text); of each language every HELD-th calibrates."""
        self.languages = sorted({lang for lang, _ in rows})
        taught: dict[str, list[str]] = {lang: [] for lang in self.languages}
        held: list[tuple[str, str]] = []
        seen = dict.fromkeys(self.languages, 0)
        if not rows:
            return
        for lang, text in rows:
            seen[lang] += 1
            (held.append((lang, text)) if seen[lang] % HELD == 0 else taught[lang].append(text))
        points, often = np.unique(np.concatenate([symbols(t)[0] for t in taught.values()] or [np.zeros(1, np.uint32)]), return_counts=True)
        points, often = points[points > 0], often[points > 0]
        points = np.sort(points[np.argsort(-often, kind="stable")[:LETTERS]])
        self.ids = np.ones(0x110000, np.uint16)  # 1: a letter that was never seen, or too seldom
        self.ids[0] = 0
        self.ids[points] = np.arange(2, 2 + len(points))
        alphabet = len(points) + 2
        counts = []
        for lang in self.languages:
            sequence, starts = symbols(taught[lang])
            ids = self.ids[sequence]
            counts.append(_Counts([ids[s:e] for s, e in zip(starts[:-1], starts[1:], strict=True)], alphabet))
        self.grams, self.contexts = {}, {}
        for order in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([c.levels[order][0] for c in counts]))
            self.grams[order] = SortedHashes(keys, np.stack([np.log(c.probability(order, keys)) for c in counts], 1).astype(np.float32))
            keys = np.unique(np.concatenate([c.levels[order][2] for c in counts]))
            self.contexts[order] = SortedHashes(keys, np.stack([np.log(c.backoff(order, keys)) for c in counts], 1).astype(np.float32))
        self.floor = np.float32(-np.log(alphabet))
        self.limit, self.sharp = np.full(len(self.languages), np.inf), 8.0
        if held:
            self._calibrate(held)

    def _calibrate(self, held: list[tuple[str, str]]) -> None:
        entropy, size = self.entropies([t for _, t in held])
        truth = np.array([self.languages.index(lang) for lang, _ in held])
        for k in range(len(self.languages)):
            own = entropy[(truth == k) & (size > 0), k]
            if len(own):
                self.limit[k] = np.quantile(own, 1 - REJECT) + 3 * own.std()
        with_letters = size > 0
        if with_letters.any():
            loss = lambda sharp: -np.log(np.maximum(self._posterior(entropy, sharp)[np.arange(len(truth)), truth][with_letters], 1e-12)).mean()
            self.sharp = min((0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0), key=loss)

    @staticmethod
    def _posterior(entropy: np.ndarray, sharp: float) -> np.ndarray:
        x = np.exp(-sharp * (entropy - entropy.min(1, keepdims=True)))
        return x / x.sum(1, keepdims=True)

    def _log(self, order: int, keys: np.ndarray) -> np.ndarray:
        """Interpolated log probabilities, keys x languages."""
        if order == 0:
            return np.full((len(keys), len(self.languages)), self.floor)
        grams = self.grams[order]
        at = grams.find(keys)
        out = grams.values[at]
        missing = np.flatnonzero(at < 0)
        if len(missing):
            rest = keys[missing]
            context = self.contexts[order].find(rest >> np.uint64(16))
            weight = np.where((context >= 0)[:, None], self.contexts[order].values[context], np.float32(0))
            out[missing] = weight + self._log(order - 1, rest & np.uint64((1 << 16 * (order - 1)) - 1))
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text in each language, and the number of letters."""
        sequence, starts = symbols(texts)
        ids = self.ids[sequence]
        keys = _grams(ids, ORDER)
        logs = self._log(ORDER, keys) if len(keys) else np.zeros((0, len(self.languages)), np.float32)
        # place p of the sequence is row p - (ORDER - 1); a text's own places follow its zeros
        low, high = starts[:-1], starts[1:] - (ORDER - 1)
        total = np.concatenate([np.zeros((1, logs.shape[1])), np.cumsum(logs, 0, dtype=np.float64)])
        letters = np.concatenate([[0], np.cumsum(sequence > 0)])
        n = np.maximum(high - low, 1)
        return -(total[high] - total[low]) / n[:, None], letters[starts[1:]] - letters[starts[:-1]]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, score and whether it is rejected."""
        entropy, letters = self.entropies([t or "" for t in texts])
        best = entropy.argmin(1)
        score = self._posterior(entropy, self.sharp)[np.arange(len(best)), best]
        return [
            (self.languages[k], float(s), bool(h > self.limit[k])) if n else (UNDETERMINED, 0.0, True)
            for k, s, n, h in zip(best, score, letters, entropy[np.arange(len(best)), best], strict=True)
        ]


def learn(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, languages: int = LANGUAGES) -> Model:
    """A model from at most `rows` rows of each language, of at most `chars` characters each, and of the
    `languages` with the most rows (ties by name).

    Rows are taken in the order of a hash of key and text: the same sample whatever the partitions,
    and rows of one key are no more than any others. Null texts and languages teach nothing, nor do
    longer texts; without any row the model has no language. Repeated rows count as often as they are taken.
    """
    body = exact(text)
    usable = labelled.where(exact(lang).isNotNull() & body.isNotNull() & (F.length(body) <= chars))
    usable = usable.select(exact(lang).alias("lang"), body.alias("text"), F.xxhash64(exact(key), body).alias("h"))
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    if not counts:
        return Model([])
    # A share of each language's hashes that holds `rows` rows almost surely, so that few rows are ranked; of
    # repeated rows, which share theirs, the limit on ranks leaves no more before the shuffle either.
    shares = labelled.sparkSession.createDataFrame([(r["lang"], min(1.0, (rows + 5 * rows**0.5 + 10) / r["n"])) for r in counts], "lang string, share double")
    few = usable.join(F.broadcast(shares), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    place = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h", "text")
    ranked = few.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= rows)
    sample = ranked.select("lang", "rank", "text").collect()  # at most languages x rows x chars
    return Model([(r["lang"], r["text"]) for r in sorted(sample, key=lambda r: (r["lang"], r["rank"]))])


def predicted(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all by default) with lang_pred, score and rejected.

    A null text or one without a letter is `und` with score 0. Languages that tie go by
    name. Very long texts are scored whole. Rows are independent; repeats get equal results,
    an empty table an empty one; a model without languages gives `und` throughout. Extra
    columns pass through; those with names of added columns are replaced.
    """
    added = ["lang_pred", "score", "rejected"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the sample's
    row = F.struct(*[exact(c) for c in keep] or [F.lit(0).alias("_none")]).alias("_row")
    rows = docs.select(row, exact(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            found: list = []
            low = 0
            while low < len(texts):  # about a million characters at a time
                high, size = low, 0
                while high < len(texts) and (high == low or size + len(texts[high] or "") <= 1_000_000):
                    size += len(texts[high] or "")
                    high += 1
                part = texts[low:high]
                found += model.predict(part) if model.languages else [(UNDETERMINED, 0.0, True)] * len(part)
                low = high
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.bool_())], names=["_row", *added])

    out = rows.mapInArrow(run, with_row(rows, "lang_pred string, score double, rejected boolean"))
    return out.select(*[F.col("_row")[c].alias(c) for c in keep], *added)


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from two of three folds; see learn() and predicted()."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = learn(docs.where(fold != 1))
    return predicted(docs.select("doc_id", "text"), model, keep=["doc_id"]).select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
