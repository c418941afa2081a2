"""Language identification by unigram piece models whose score sums over all segmentations of a word.

Every language has a probability for each piece of one fixed public vocabulary. A word's probability is the sum, over all
ways to cut it into pieces, of the product of their probabilities, which the forward algorithm gives in one pass; a text's
is the product over its words. The probabilities are fitted by expectation-maximisation on word counts of a bounded sample
of labelled texts.

Cases: a null text, or one with no letter, is ``und`` with score 0. Ties go to the language that sorts first. Equal texts
get equal results. Without labelled rows every text is ``und``. Columns besides the id and text are never read for a
prediction; those of the input may have any names.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, giving_back, materialize, tokenizer_path
from .pieces import PieceTable, by_length, codes

#: Labelled texts of each language that the model is fitted on, as expected by a draw by the id's hash.
SAMPLE_PER_LANGUAGE = 1500
ITERATIONS = 3
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
#: Numerals that are no decimal digits count as letters there, so texts that hold some are cut at them first.
_NUMERALS = {i: " " for i in range(128, sys.maxunicode + 1) if (c := chr(i)).isnumeric() and not c.isalpha() and not c.isdecimal()}
_NUMERAL_CHARACTERS = frozenset(map(chr, _NUMERALS))
#: Probability of a single character that the vocabulary or the language lacks.
_FLOOR = 1e-7


def vocabulary(path: str | None = None) -> list[str]:
    """The pieces of a public sentencepiece model, by id; control and byte pieces are empty."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or tokenizer_path("piece_bpe_32k.model"))
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
    return ["" if special(i) else model.id_to_piece(i) for i in range(model.vocab_size())]


def words_of(chunk: str) -> list[str]:
    return ["▁" + w for w in letter_runs(chunk.lower())]


def letter_runs(text: str) -> list[str]:
    return _LETTERS.findall(text if text.isascii() or _NUMERAL_CHARACTERS.isdisjoint(set(text)) else text.translate(_NUMERALS))


def _weights(found: dict[int, np.ndarray], shape: tuple[int, int], probs: np.ndarray) -> dict[int, np.ndarray]:
    """By piece length: probabilities [word, start, language]; single characters have the floor at least."""
    out = {n: np.where(ids[..., None] >= 0, probs[ids], 0.0) for n, ids in found.items()}
    single = out.get(1, np.zeros((*shape, probs.shape[1])))
    out[1] = np.maximum(single, _FLOOR)
    return out


def _forward(weights: dict[int, np.ndarray], n: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over segmentations of each prefix, and the log of the scale; the last ``longest`` places share one scale (0: none)."""
    count, languages = weights[1].shape[0], weights[1].shape[2]
    alpha, scale = np.zeros((n + 1, count, languages)), np.zeros((count, languages))
    alpha[0] = 1
    for i in range(1, n + 1):
        for length, w in weights.items():
            if length <= i:
                alpha[i] += alpha[i - length] * w[:, i - length]
        if longest and (i % longest == 0 or i == n):
            most = alpha[max(0, i - longest + 1) : i + 1].max(axis=0)
            alpha[max(0, i - longest + 1) : i + 1] /= most
            scale += np.log(most)
    return alpha, scale


def _prefix_logs(weights: dict[int, np.ndarray], n: int) -> np.ndarray:
    """Logs of the sums over segmentations of each prefix [place, word, language]."""
    out = np.zeros((n + 1, weights[1].shape[0], weights[1].shape[2]))
    for i in range(1, n + 1):
        total = 0.0
        for length, w in weights.items():
            if length <= i:
                total = total + np.exp(out[i - length] - out[i - 1]) * w[:, i - length]
        out[i] = out[i - 1] + np.log(total)
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    pieces: list[str]
    probs: np.ndarray  # [piece, language]

    def __post_init__(self):
        self.table = PieceTable(self.pieces)

    def word_scores(self, words: list[str]) -> dict[str, np.ndarray]:
        """Natural log of each word's probability in each language."""
        out = {}
        for n, group in by_length(words):
            chars = codes(group, n)
            w = _weights(self.table.probe(chars), chars.shape, self.probs)
            alpha, scale = _forward(w, n, max(1, self.table.longest))
            out.update(zip(group, np.log(alpha[n]) + scale, strict=True))
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece [piece, language], for words counted by language."""
        total = np.zeros_like(self.probs)
        at = {w: i for i, w in enumerate(words)}
        for n, group in by_length(words):
            chars = codes(group, n)
            found = self.table.probe(chars)
            w = _weights(found, chars.shape, self.probs)
            # logs, as the sums of long words are below what a double holds; backwards, pieces stand by where they end
            back = {k: v[:, ::-1] for k, v in w.items()}
            alpha, beta, own = _prefix_logs(w, n), _prefix_logs(back, n), counts[[at[x] for x in group]]
            for length, ids in found.items():
                hit = ids >= 0
                share = np.exp(alpha[: n - length + 1] + beta[n - length :: -1] - alpha[n]).transpose(1, 0, 2)
                uses = own[:, None] * share * w[length]
                for k in range(total.shape[1]):
                    total[:, k] += np.bincount(ids[hit], uses[..., k][hit], minlength=len(total))
        return total


class Scorer:
    """Scores whole texts; the words' scores are kept in a bounded cache."""

    def __init__(self, model: LanguageModel, limit: int = 300_000):
        self.model, self.limit = model, limit
        self.clear()

    def clear(self):
        self.rows, self.table = {}, np.zeros((0, len(self.model.languages) + 1))

    def _learn(self, chunks: set[str]):
        new = [c for c in chunks if c not in self.rows]
        if not new:
            return
        split = [words_of(c) for c in new]
        scores = self.model.word_scores(list({w for ws in split for w in ws}))
        more = np.zeros((len(new), self.table.shape[1]))
        for i, ws in enumerate(split):
            for w in ws:
                more[i, :-1] += scores[w]
            more[i, -1] = len(ws)
        start = len(self.rows)
        self.rows.update((c, start + i) for i, c in enumerate(new))
        self.table = np.concatenate([self.table, more])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.model.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        split = [(t or "").split() for t in texts]
        if len(self.rows) > self.limit:
            self.clear()
        for i in range(0, len(split), 200):
            self._learn(set().union(*split[i : i + 200]))
        get, names, scores = self.rows.__getitem__, [], np.zeros(len(texts))
        for i, ws in enumerate(split):
            total = self.table[np.fromiter(map(get, ws), np.int64, len(ws))].sum(axis=0)
            if total[-1] == 0:
                names.append(UNKNOWN)
                continue
            best = int(total[:-1].argmax())
            names.append(self.model.languages[best])
            scores[i] = 1 / np.exp(total[:-1] - total[best]).sum()
        return names, scores


def held_out(doc_id="doc_id"):
    """Whether the id's remainder keeps the document out of the training rows."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, text="text", label="lang", doc_id="doc_id", sample: int = SAMPLE_PER_LANGUAGE, vocabulary_path: str | None = None) -> LanguageModel:
    """Fits the model on the labelled rows of docs, drawing about ``sample`` rows of each language by the id's hash.

    What reaches the driver is a number for each language, and one for each piece and language.
    """
    spark = docs.sparkSession
    pieces = vocabulary(vocabulary_path)
    train = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"), F.col(label).alias("l")).where("l is not null and t is not null")
    sizes = {r["l"]: r["n"] for r in train.groupBy("l").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], pieces, np.zeros((len(pieces), 0)))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample / n))])
    drawn = train.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.element_at(share, F.col("l")) * 1_000_000)
    index = {k: i for i, k in enumerate(languages)}

    def count(batches):
        for b in batches:
            own = Counter()
            for t, k in zip(b["t"].to_pylist(), b["l"].to_pylist(), strict=True):
                for chunk, n in Counter(t.split()).items():
                    for w in words_of(chunk):
                        own[w, index[k]] += n
            yield pa.record_batch({"w": pa.array([w for w, _ in own], pa.string()), "l": pa.array([k for _, k in own], pa.int32()), "n": pa.array(list(own.values()), pa.int64())})

    counted = drawn.select("t", "l").mapInArrow(giving_back(count), "w string, l int, n bigint").groupBy("w").agg(*[F.coalesce(F.sum(F.when(F.col("l") == i, F.col("n"))), F.lit(0)).alias(f"n{i}") for i in range(len(languages))])
    counted = materialize(counted, "langid-words")
    known = np.array([bool(p) for p in pieces])
    probs = np.where(known[:, None], 1.0 / known.sum(), 0.0).repeat(len(languages), axis=1)
    for _ in range(ITERATIONS):
        model = LanguageModel(languages, pieces, probs)

        def expect(batches, model=model):
            total = np.zeros_like(model.probs)
            for b in batches:
                total += model.expected(b["w"].to_pylist(), np.stack([b[f"n{i}"].to_numpy() for i in range(len(model.languages))], axis=1).astype(float))
            used = np.flatnonzero(total.sum(axis=1))
            yield pa.record_batch({"p": pa.array(used, pa.int64())} | {f"n{i}": pa.array(total[used, i]) for i in range(total.shape[1])})

        schema = "p bigint, " + ", ".join(f"n{i} double" for i in range(len(languages)))
        got = counted.mapInArrow(giving_back(expect), schema).groupBy("p").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(languages))]).collect()
        total = np.zeros_like(probs)
        for r in got:
            total[r["p"]] = [r[f"n{i}"] for i in range(len(languages))]
        total += np.where(known[:, None], 0.01, 0)
        probs = total / total.sum(axis=0)
    return LanguageModel(languages, pieces, probs)


def predict(docs: DataFrame, model: LanguageModel, text="text", doc_id="doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("t"))

    def run(batches):
        scorer = Scorer(model)
        for b in batches:
            names, scores = scorer.predict(b["t"].to_pylist())
            yield pa.record_batch([b["doc_id"], b["held_out"], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(giving_back(run), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel, text="text", least: float = 0.0) -> DataFrame:
    """The rows, with all their columns, whose text is in a learned language, by a score of ``least`` at least; others have no letters.

    A model that has learned no language tells nothing, so all texts with letters stay.
    """
    bounded_batches(docs.sparkSession)
    if not model.languages:
        return docs.where(F.col(text).rlike(r"\p{L}"))

    def run(batches):
        scorer = Scorer(model)
        for b in batches:
            names, scores = scorer.predict(b[text].to_pylist())
            yield b.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(giving_back(run), docs.schema)


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Fits on the documents that are not held out and predicts every document."""
    return predict(docs, fit(docs.where(~held_out())))
