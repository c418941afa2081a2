"""Subword encoding by batched Viterbi search over a public sentencepiece vocabulary, and its exact inverse.

A text gets one space in front and spaces become the mark U+2581, as sentencepiece does; no piece has a mark after another
character, so the text can be cut before each run of marks. Words of equal length advance together: hashes of all their
substrings are looked up among the sorted hashes of the pieces, the best score of each prefix is a vectorised maximum, and
the length of the last piece is the back pointer. A character that no piece holds becomes its UTF-8 bytes' pieces.

The vocabulary's scores are merge ranks, not log-probabilities, so a piece of rank r (from 0, in the model's order) scores
-ln(r + 2), by Zipf's law, in fixed point. Of segmentations with equal scores the one whose last piece is longest wins,
then the last but one, and so on. The best segmentation under these scores is found exactly; it is not the merge order's.

Cases: a null or empty text has no ids and decodes to the empty text. Marks in the text itself are spelled in bytes, so any
text comes back unchanged. Long words cost time in proportion to their length. Equal texts get equal ids; other columns are
not read and may have any names; an empty table gives an empty one.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, tokenizer_path
from .pieces import PieceTable, by_length, codes

MARK = "▁"
#: Stands for a mark that the text itself holds; a lone surrogate, which no valid text or piece has.
_OWN = "\udfff"
_FIXED = 1 << 20
_BYTE_SCORE = -30 * _FIXED
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Vocabulary:
    def __init__(self, path: str | None = None):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or tokenizer_path("piece_bpe_32k.model"))
        n = model.vocab_size()
        names = [model.id_to_piece(i) for i in range(n)]
        byte = [model.is_byte(i) for i in range(n)]
        plain = [not (byte[i] or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)]
        ranks = np.cumsum(plain) - 1
        self.pieces = [p if ok else "" for p, ok in zip(names, plain, strict=True)]
        assert not any(MARK in p.lstrip(MARK) for p in self.pieces), "pieces may cross the start of a word"
        self.scores = np.where(plain, -np.round(np.log(ranks + 2.0) * _FIXED), 0).astype(np.int64)
        self.bytes = {int(p[3:5], 16): i for i, (p, b) in enumerate(zip(names, byte, strict=True)) if b}
        self.table = PieceTable(self.pieces)
        self.raw = [bytes([int(p[3:5], 16)]) if b else q.replace(MARK, " ").encode() for p, b, q in zip(names, byte, self.pieces, strict=True)]

    def segment(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each word (with its marks) as little-endian unsigned 16-bit integers."""
        out = {}
        for n, group in by_length(words):
            chars = codes(group, n)
            found = sorted(self.table.probe(chars).items())
            count = len(group)
            width = 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)
            spelled = width.astype(np.int64) * _BYTE_SCORE
            best = np.full((n + 1, count), np.iinfo(np.int64).min // 2)
            last, piece = np.ones((n + 1, count), np.int32), np.full((n + 1, count), -1, np.int32)
            best[0] = 0
            scores = {length: np.where(ids >= 0, self.scores[ids], np.iinfo(np.int64).min // 4) for length, ids in found}
            for i in range(1, n + 1):
                top = best[i - 1] + spelled[:, i - 1]
                for length, ids in found:  # longer pieces later, so that they win ties
                    if length > i:
                        break
                    new = best[i - length] + scores[length][:, i - length]
                    win = new >= top
                    top = np.where(win, new, top)
                    last[i, win], piece[i, win] = length, ids[win, i - length]
                best[i] = top
            at, rows, steps = np.full(count, n), np.arange(count), []
            while (at > 0).any():
                steps.append((np.where(at > 0, piece[at, rows], -2), at.copy()))
                at = np.where(at > 0, at - last[at, rows], 0)
            if not steps:
                out.update((w, b"") for w in group)
                continue
            ids = np.stack([s for s, _ in steps], axis=1)[:, ::-1]
            easy = (ids != -1).all(axis=1)
            for k, w in enumerate(group):
                row = ids[k][ids[k] != -2]
                if not easy[k]:
                    ends = [int(a[k]) for s, a in steps if s[k] != -2][::-1]
                    spell = lambda c: [self.bytes[x] for x in (MARK if c == _OWN else c).encode()]
                    row = np.array([y for x, e in zip(row, ends, strict=True) for y in ([x] if x >= 0 else spell(w[e - 1]))])
                out[w] = row.astype("<u2").tobytes()
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u2").tolist())).decode("utf-8", "replace")[1:]


class Encoder:
    """Encodes whole texts; words are searched once and kept in a bounded cache."""

    def __init__(self, vocabulary: Vocabulary, limit: int = 400_000):
        self.vocabulary, self.limit, self.words = vocabulary, limit, {}

    @staticmethod
    def split(text: str) -> list[str]:
        if MARK in text:
            text = text.replace(MARK, _OWN)
        parts = text.split(" ")
        if all(parts):
            return [MARK + p for p in parts]
        return _WORD.findall(MARK + text.replace(" ", MARK))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = []
        if len(self.words) > self.limit:
            self.words.clear()
        for i in range(0, len(texts), 100):
            split = [self.split(t) if t else [] for t in texts[i : i + 100]]
            new = set().union(*split).difference(self.words)
            if new:
                self.words.update(self.vocabulary.segment(list(new)))
            out += [b"".join(map(self.words.__getitem__, ws)) for ws in split]
        return out


def encode(docs: DataFrame, text="text", doc_id="doc_id", path: str | None = None) -> DataFrame:
    """doc_id, text and ids (little-endian unsigned 16-bit) of each document."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        encoder = Encoder(Vocabulary(path))
        for b in batches:
            yield pa.record_batch([b["doc_id"], b["text"], pa.array(encoder.encode(b["text"].to_pylist()), pa.binary())], names=["doc_id", "text", "ids"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds ``decoded``, the text of the ids, and their number ``n_ids`` and checksum ``ids_crc32``; columns that are called so are replaced."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    kept = [f for f in encoded.schema.fields if f.name.lower() not in ("decoded", "n_ids", "ids_crc32")]
    schema = StructType([*kept, StructField("decoded", StringType()), StructField("n_ids", LongType()), StructField("ids_crc32", LongType())])

    def run(batches):
        vocabulary = Vocabulary(path)
        for b in batches:
            ids = b["ids"].to_pylist()
            more = [pa.array([vocabulary.decode(x) for x in ids], pa.string()), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array([zlib.crc32(np.frombuffer(x, "<u2").astype("<u4")) for x in ids], pa.int64())]
            yield pa.record_batch([*(b[f.name] for f in kept), *more], names=schema.names)

    return encoded.mapInArrow(run, schema)
