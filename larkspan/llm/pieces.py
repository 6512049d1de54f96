"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is parsed and rebuilt: normaliser (its compiled character
map, white space rules), the mark U+2581 for spaces with the dummy prefix, piece
scores (unigram log scores, or merge ranks of a BPE model) and byte fallback.

If no piece holds the mark after another character, and the normaliser only
marks spaces, no piece can span the start of a word. Words then encode on their
own, so only the words not met before go to the library, some thousands a
multithreaded call, of which nothing but the ids is kept; a memo of bounded
bytes keeps them. Other models encode whole texts, in calls of bounded size.

Cases: null and empty texts have no tokens and decode to the empty text. Texts
are encoded whole. Strings that look like control pieces are plain text. With
byte fallback any text decodes to itself under an identity normaliser. Repeated
rows give repeated rows; columns other than id and text are ignored.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as proto
from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

from larkspan.llm.workers import tidy

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2
MEMO_BYTES, MEMO_CHARS = 3 << 24, 48
ENTRY_BYTES = 250  # of a memo's entry besides its word and ids
CALL_WORDS, CALL_CHARS = 4096, 1 << 17
LIST_CHARS = 1 << 21  # of texts encoded at once
_SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def parse(data: bytes) -> proto.ModelProto:
    model = proto.ModelProto()
    model.ParseFromString(data)
    return model


def _normalizer(model: proto.ModelProto):
    spec = model.normalizer_spec
    steps = []
    if spec.precompiled_charsmap:
        steps.append(normalizers.Precompiled(spec.precompiled_charsmap))
    if spec.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK if spec.escape_whitespaces else " "))
    if spec.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    return normalizers.Sequence(steps)


def _merges(model: proto.ModelProto) -> list[tuple[str, str]]:
    """All splits of every normal piece into two pieces, best piece first."""
    ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (NORMAL, USER)}
    ranked = sorted((p for p in model.pieces if p.type == NORMAL), key=lambda p: -p.score)
    out = []
    for p in ranked:
        splits = [(p.piece[:i], p.piece[i:]) for i in range(1, len(p.piece))]
        out += sorted((s for s in splits if s[0] in ids and s[1] in ids), key=lambda s: (ids[s[0]], ids[s[1]]))
    return out


def build(model: proto.ModelProto, normalize: bool = True) -> Tokenizer:
    """A tokenizers.Tokenizer with the ids of the model."""
    unknown = next((i for i, p in enumerate(model.pieces) if p.type == UNKNOWN), None)
    fallback = model.trainer_spec.byte_fallback
    if model.trainer_spec.model_type == UNIGRAM:
        # Unknown characters cost 10 more than the worst normal piece; other kinds must not lower that.
        worst = min((p.score for p in model.pieces if p.type == NORMAL), default=0.0)
        core = models.Unigram([(p.piece, p.score if p.type in (NORMAL, USER) else worst) for p in model.pieces], unknown, byte_fallback=fallback)
    elif model.trainer_spec.model_type == BPE:
        vocab = {p.piece: i for i, p in enumerate(model.pieces)}
        core = models.BPE(vocab, _merges(model), unk_token=None if unknown is None else model.pieces[unknown].piece, fuse_unk=True, byte_fallback=fallback)
    else:
        raise ValueError(f"model type {model.trainer_spec.model_type} is neither unigram nor BPE")
    tokenizer = Tokenizer(core)
    if normalize:
        tokenizer.normalizer = _normalizer(model)
    steps = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    if model.normalizer_spec.add_dummy_prefix:
        steps.append(decoders.Strip(" ", 1, 0))
    tokenizer.decoder = decoders.Sequence(steps)
    own = [AddedToken(p.piece, normalized=False) for p in model.pieces if p.type == USER]
    if own:
        tokenizer.add_tokens(own)
    return tokenizer


class Codec:
    """Encodes and decodes batches of texts by one model file's bytes."""

    def __init__(self, data: bytes, memo_bytes: int = MEMO_BYTES):
        model = parse(data)
        spec = model.normalizer_spec
        self.prefix = spec.add_dummy_prefix
        plain = not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and spec.escape_whitespaces and self.prefix
        users = any(p.type == USER for p in model.pieces)
        spans = any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in model.pieces if p.type == NORMAL)
        self.by_word = plain and not users and not spans
        self.tokenizer = build(model, normalize=not self.by_word)
        # Two generations of words met, each of bounded bytes.
        self.memo: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.held, self.most = 0, memo_bytes
        # What a piece adds to a decoded text; an unknown piece is written as the format's sign for it.
        self.bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else b"" if p.type == CONTROL else " ⁇ ".encode() if p.type == UNKNOWN else p.piece.replace(MARK, " ").encode() for p in model.pieces]

    def words(self, text: str) -> list[str]:
        """Keys of the words of a text: a word after one space is itself, others hold their marks."""
        if not text:
            return []
        if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        found = _SEGMENT.findall(MARK + text.replace(" ", MARK))
        return [w[1:] if w[1:2] not in ("", MARK) and w[0] == MARK else w for w in found]

    def _calls(self, texts: list[str]) -> Iterator[list[bytes]]:
        """Ids of the texts as bytes, a call's texts at a time: few thousand, and of bounded length but for single long texts."""
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and end - at < CALL_WORDS and (end == at or chars + len(texts[end]) <= CALL_CHARS):
                chars += len(texts[end])
                end += 1
            yield [array("i", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts[at:end], add_special_tokens=False)]
            at = end

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (int32) of each text."""
        if not self.by_word:
            found = [ids for part in self._calls(texts) for ids in part]
            return [np.frombuffer(ids if t else b"", np.int32) for ids, t in zip(found, texts)]
        split = [self.words(t) for t in texts]
        if self.held > self.most:
            # Words not met since the last change of generation go.
            self.memo, self.before, self.held = {}, self.memo, 0
        wanted = set().union(*split)
        found = {w: ids for w in wanted if (ids := self.memo.get(w)) is not None}
        again = {w: ids for w in wanted if w not in found and (ids := self.before.get(w)) is not None}
        new = [w for w in wanted if w not in found and w not in again]
        for w, ids in zip(new, (ids for part in self._calls([w if MARK in w else MARK + w for w in new]) for ids in part)):
            again[w] = ids
        found.update(again)
        kept = {w: ids for w, ids in again.items() if len(w) <= MEMO_CHARS}
        self.memo.update(kept)
        self.held += ENTRY_BYTES * len(kept) + sum(map(len, kept)) + sum(map(len, kept.values()))
        return [np.frombuffer(b"".join(map(found.__getitem__, words)), np.int32) for words in split]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        out = []
        for row in ids:
            text = b"".join(map(self.bytes.__getitem__, row.tolist())).decode("utf-8", "replace")
            out.append(text[1:] if self.prefix and text[:1] == " " else text)
        return out


def batches_of(column: pa.Array, chars: int = LIST_CHARS) -> Iterator[list[str]]:
    """Texts of a column (null: empty) in lists of bounded size."""
    part, held = [], 0
    for text in column:
        part.append(text.as_py() or "")
        held += len(part[-1])
        if held >= chars:
            yield part
            part, held = [], 0
    if part:
        yield part


def _use_threads() -> None:
    """The library's threads: the task's share of the machine, two at least; set before its first call in a worker."""
    context = TaskContext.get()
    os.environ.setdefault("RAYON_NUM_THREADS", str(max(2, context.cpus() if context else 2)))
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")


def encode_documents(docs: DataFrame, model: bytes, memo_bytes: int = MEMO_BYTES, chars: int = LIST_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip (the ids decode to the text; a null text counts as empty).

    Smaller ``memo_bytes`` and ``chars`` take less memory and more time, for the same rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _use_threads()
        codec = Codec(shared.value, memo_bytes)
        for batch in batches:
            at = 0
            for texts in batches_of(batch.column(1), chars):
                ids = codec.encode(texts)
                same = [a == b for a, b in zip(codec.decode(ids), texts)]
                sizes = np.array([len(x) for x in ids], np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + len(texts)], pa.array(sizes), pa.ListArray.from_arrays(offsets, values), pa.array(same)], ["doc_id", "n_tokens", "ids", "round_trip"])
                at += len(texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decode_documents(coded: DataFrame, model: bytes) -> DataFrame:
    """doc_id and the text of ``ids`` (null: empty)."""
    shared = coded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            ids = [np.array(x.as_py() or [], np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codec.decode(ids), pa.string())], ["doc_id", "text"])

    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()
