"""What the corpus operators share: scratch tables, batch sizes and cached tokenising."""

from __future__ import annotations

import functools
import re
import string
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import drop, materialize, scratch_path, scratch_root  # noqa: F401


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 1 << 24) -> None:
    """Texts and vectors are long, so a batch sent to Python holds at most so many rows and bytes, unless the user set a number."""
    for key, plain, own in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", None, size)):
        if spark.conf.get(key, plain) == plain:
            spark.conf.set(key, str(own))


def free_name(df: DataFrame, name: str) -> str:
    """The name, or if a column of df is called so, whatever the case, the first of name_1, name_2, ... that is free."""
    taken = {c.lower() for c in df.columns}
    return name if name.lower() not in taken else next(f"{name}_{i}" for i in range(1, len(taken) + 2) if f"{name}_{i}".lower() not in taken)


def without(docs: DataFrame, gone: DataFrame, text: str, doc_id: str) -> DataFrame:
    """The rows of docs, with all their columns, but those whose id and text are those of a row of gone (doc_id, and h, the text's hash)."""
    d, h = free_name(docs, "gone"), free_name(docs, "gone_text")
    own = gone.select(F.col("doc_id").alias(d), F.col("h").alias(h)).distinct()
    return docs.join(own, (docs[doc_id].cast("bigint") == F.col(d).cast("bigint")) & (F.xxhash64(docs[text]) == F.col(h)), "left_anti")


class WordCache(dict):
    """What a word is turned into, looked up once. Memory stays bounded: beyond ``limit`` words only the first ``kept`` ones,
    which are likely to be common, and the last ``kept`` ones stay."""

    def __init__(self, encode, limit: int = 1_000_000):
        super().__init__()
        self.encode, self.limit, self.kept = encode, limit, limit // 3

    def __missing__(self, word):
        if len(self) >= self.limit:
            items = list(self.items())
            self.clear()
            self.update(items[: self.kept] + items[len(items) - self.kept :])
        value = self[word] = self.encode(word)
        return value


def load_tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others
    in order from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}


_LETTER = _byte_letters()


def _spelled(word: str) -> str:
    return word if word.isascii() else "".join(map(_LETTER.__getitem__, word.encode()))


#: After letters a run of these characters is a pre-token of its own.
_TAIL = string.punctuation.replace("'", "")


def laid_out(words: pa.Array, ids_of, skip: int = 0) -> tuple[list[bytes], list[int]]:
    """For lists of words: the words' ids end to end, less the first ``skip``, and which lists have a word without ids (None).

    Each distinct word is looked up once.
    """
    coded = words.flatten().dictionary_encode()
    index, docs = coded.indices.to_numpy(), np.append(0, np.cumsum(pc.list_value_length(words).to_numpy()))
    ids = list(map(ids_of, coded.dictionary.to_numpy(zero_copy_only=False)))
    del words, coded
    bad = []
    if None in ids:
        apart = np.fromiter((x is None for x in ids), bool, len(ids))
        ids = [x or b"" for x in ids]
        before = np.append(0, np.cumsum(apart[index]))[docs]
        bad = np.flatnonzero(before[1:] > before[:-1]).tolist()
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
    starts = np.cumsum(sizes) - sizes
    sizes = sizes[index]
    ends = np.append(0, np.cumsum(sizes))
    at = np.repeat((starts[index] - ends[:-1]).astype(np.int32), sizes)
    at += np.arange(ends[-1], dtype=np.int32)
    out = np.frombuffer(b"".join(ids), np.uint16)[at]
    cuts = ends[docs].tolist()
    return [out[a + skip : z].tobytes() for a, z in zip(cuts[:-1], cuts[1:], strict=True)], bad


class ByteBpeEncoder:
    """Ids of a byte-level BPE whose pre-tokens take one leading space: equal to encoding the whole text at once.

    Between two characters that are no white space, a single space starts a pre-token and a single line feed is one, so
    words can be encoded apart: each distinct word of a column once, and not again while it is among the ``limit`` words
    that are kept. Texts with other white space are cut only where that holds.
    """

    def __init__(self, path: str, limit: int = 900_000):
        self.tokenizer = load_tokenizer(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.feed = self._ids("\n")
        self.tails = WordCache(self._ids, limit // 8)
        self.words = WordCache(self._word, limit)  # a word follows a space, or begins with the line feed before it

    def _ids(self, text: str) -> bytes:
        return array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes | None:
        """None for words that can't be encoded apart: empty ones, and those that white space begins or ends."""
        if word.isascii():  # most words are letters, or letters and what follows them
            if word.isalpha():
                return array("H", [t.id for t in self.tokenize("Ġ" + word)]).tobytes()
            if (letters := word.rstrip(_TAIL)).isalpha():
                tail = word[len(letters) :]
                return (self.words.get(letters) or self.words[letters]) + (self.tails.get(tail) or self.tails[tail])
        own, before = (word[1:], self.feed) if word[:1] == "\n" else (word, b"")
        letters = own.rstrip(_TAIL)
        if letters.isalpha():  # one pre-token, which the model takes as it is, and what follows is another
            if len(letters) < len(word) and not before:
                return self.words[letters] + self.tails[own[len(letters) :]]
            ids = array("H", [t.id for t in self.tokenize(("" if before else "Ġ") + (letters if letters.isascii() else _spelled(letters)))]).tobytes()
            return before + ids + (self.tails[own[len(letters) :]] if len(letters) < len(own) else b"")
        if not own or own[0].isspace() or own[-1].isspace():
            return None
        return before + self._ids(own) if before else self._ids(" " + own)

    def _odd(self, text: str) -> bytes:
        parts = re.split(r"(?<=\S) (?=\S)", text)
        return b"".join(self._ids((" " if i else "") + x) for i, x in enumerate(parts))

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        """Little-endian unsigned 16-bit ids of each text; null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        feed, none = pa.scalar("\n", texts.type), pa.scalar("", texts.type)
        words = pc.split_pattern(pc.binary_join_element_wise(feed, pc.replace_substring(texts, "\n", " \n"), none), " ")
        got, bad = laid_out(words, self.words.__getitem__, skip=1)
        for i in bad:
            got[i] = self._odd(texts[i].as_py()) if texts[i].as_py() else b""
        return got

    def encode(self, text: str) -> bytes:
        return self.encode_column(pa.array([text]))[0]


def give_back() -> None:
    """Returns memory that this worker process no longer uses to the system; it would stay with the process for the stages that follow."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def giving_back(run):
    """A function of batches that gives memory back when it is done."""

    @functools.wraps(run)
    def own(batches):
        yield from run(batches)
        give_back()

    return own


def chunks(batches, column: str, size: int = 1 << 24):
    """Joins batches until the column holds ``size`` bytes, so that what repeats in it is met often but memory is bounded."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b[column].nbytes
        if n >= size:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


@functools.cache
def shared_encoder(kind: type, path: str, limit: int):
    """One encoder for all tasks of a worker process, so that its words are looked up once."""
    return kind(path, limit)


class WordBpeEncoder:
    """Ids of a BPE that drops white space, so every word can be encoded apart: equal to encoding the whole text."""

    def __init__(self, path: str, limit: int = 1_000_000):
        self.tokenizer = load_tokenizer(path)
        self.tokenize, self.words = self.tokenizer.model.tokenize, WordCache(self._word, limit)

    def _word(self, word: str) -> bytes:
        own = word.rstrip(_TAIL)
        if own.isalpha():  # one pre-token, and what follows is another
            if own.isascii():
                ids = self.words[low] if (low := own.lower()) != word and (low in self.words or len(own) < len(word)) else self._model(low)
            elif own == own.lower() and unicodedata.is_normalized("NFC", own):  # nothing to clean
                ids = self._model(_spelled(own))
            else:
                ids = self._ids(own)
            return ids + self.words[word[len(own) :]] if len(own) < len(word) else ids
        return self._ids(word)

    def _model(self, spelled: str) -> bytes:
        return array("H", [t.id for t in self.tokenize(spelled)]).tobytes()

    def _ids(self, word: str) -> bytes:
        return array("H", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        """Little-endian unsigned 16-bit ids of each text; null is empty."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        return laid_out(words, self.words.__getitem__)[0]

    def encode(self, text: str) -> bytes:
        return self.encode_column(pa.array([text]))[0]
