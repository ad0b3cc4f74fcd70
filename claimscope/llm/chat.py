"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as

    <|im_start|>ROLE<|im_sep|>TEXT<|im_end|>

per turn, one after the other, each followed by a line feed. Control strings inside
texts are escaped: every ``<``, k backslashes, ``|`` gets one backslash more, and
reading takes it away again, so any text survives and none can end a turn.

The rendered conversation is encoded with offsets. The marks are special tokens
of the tokenizer, which splits the text at them before it does anything else:
token spans never straddle a turn. A token bears loss if its span meets the text
span of an assistant turn; both span lists are sorted and are intersected by
binary search.

Turns are dealt in order, by ranges of (conversation, turn, role, start of the text), so
a hot conversation is spread over many tasks, and streamed: a task holds one piece of a
conversation at a time. A conversation is cut between turns where a range ends and
where a piece would be longer than ``piece_chars``, which is exact because tokens do
not cross the marks. Pieces are numbered upwards in the order of the conversation, with
gaps. A piece known to be its whole conversation says so; the others are put together
again by (conversation, piece), for which only their bytes to be hashed are sent.

Defined cases: null text or role is empty; a null conversation id is a
conversation of its own; turns with the same number follow by role and text,
null turns come first; repeated rows are turns of their own; an empty table
gives an empty result. Conversation ids are integers (or texts of such); rows equal in
conversation, turn, role and the first 64 characters of the text go to one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The marks of a turn.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
ASSISTANT = "assistant"
PIECE_CHARS = 4 << 20
#: Characters of a text that ranges of turns are told apart by; bytes to be hashed that
#: one row sends on.
KEY_CHARS, SENT = 64, 16 << 10

_ESCAPE = re.compile(r"<(\\*)\|")
_UNESCAPE = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"(.*?)" + re.escape(SEP) + r"(.*?)" + re.escape(END) + "\n", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: f"<\\{m[1]}|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: f"<{m[1]}|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the spans of the assistant's texts in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        if role == ASSISTANT:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which of the sorted token spans meet one of the sorted turn spans."""
    mask = np.zeros(len(starts), bool)
    if spans and len(starts):
        a, b = np.array(spans, np.int64).T
        at = np.searchsorted(b, starts, "right")  # the first turn that ends after the token starts
        inside = at < len(a)
        mask[inside] = (a[at[inside]] < ends[inside]) & (starts[inside] < ends[inside])
    return mask


def masked_texts(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> list[str]:
    """The unescaped texts under the mask, one per run of masked tokens."""
    on = np.flatnonzero(mask)
    if not len(on):
        return []
    cut = np.flatnonzero(np.diff(on) > 1)
    first, last = on[np.concatenate(([0], cut + 1))], on[np.concatenate((cut, [len(on) - 1]))]
    return [unescape(formatted[starts[i]:ends[j]]) for i, j in zip(first, last)]


def default_vocabulary() -> str:
    """The byte-level BPE file of the public tokenizers package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


PIECE = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("piece", T.LongType()),
                      T.StructField("whole", T.BooleanType()),
                      T.StructField("n_turns", T.LongType()), T.StructField("formatted", T.StringType()),
                      T.StructField("token_ids", T.ArrayType(T.IntegerType())),
                      T.StructField("starts", T.ArrayType(T.IntegerType())),
                      T.StructField("ends", T.ArrayType(T.IntegerType())),
                      T.StructField("mask", T.ArrayType(T.BooleanType()))])


def _pieces(batches, piece_chars: int) -> Iterator[tuple]:
    """``(conv_id, piece, whole, turns)`` from the sorted rows of a range; holds one piece
    at a time. ``whole``: the conversation begins and ends inside the range, in one piece."""
    conv, piece, inner, turns, chars = None, 0, False, [], 0
    for batch in batches:
        for c, r, t in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text"))):
            r, t = r or "", t or ""
            same = bool(turns) and c == conv
            if turns and (not same or chars + len(t) > piece_chars):
                yield conv, piece, inner and not same and piece == 0, turns
                turns, chars, piece, inner = [], 0, piece + 1 if same else 0, inner or not same
            conv = c
            turns.append((r, t))
            chars += len(t)
    if turns:
        yield conv, piece, False, turns


def _formatter(vocabulary, piece_chars: int):
    def run(batches):
        import os

        import pyarrow as pa
        from pyspark import TaskContext
        from tokenizers import Tokenizer

        first = TaskContext.get().partitionId() << 32  # ranges are numbered in their order
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_str(vocabulary.value)
        tokenizer.add_special_tokens([START, SEP, END])
        out, held = [], 0

        def batch():
            cols = list(zip(*out))
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), *[pa.list_(pa.int32())] * 3,
                     pa.list_(pa.bool_())]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)],
                                              names=PIECE.fieldNames())

        for conv, piece, whole, turns in _pieces(batches, piece_chars):
            text, spans = render(turns)
            enc = tokenizer.encode(text, add_special_tokens=False)
            offsets = np.array(enc.offsets, np.int32).reshape(-1, 2)
            starts, ends = offsets[:, 0], offsets[:, 1]
            out.append((conv, first + piece, whole, len(turns), text, np.array(enc.ids, np.int32), starts, ends,
                        loss_mask(starts, ends, spans)))
            held += len(text)
            if held >= 1 << 20:
                yield batch()
                out, held = [], 0
        if out:
            yield batch()
    return run


def format_conversations(conversations: DataFrame, vocabulary: str | None = None,
                         piece_chars: int = PIECE_CHARS) -> DataFrame:
    """``conv_id, turn, role, text`` → a row per conversation piece:
    ``conv_id, piece, whole, n_turns, formatted, token_ids, starts, ends, mask``.

    ``starts`` and ``ends`` are code point offsets of the tokens in
    ``formatted``. ``vocabulary`` is the path of a ``tokenizers`` file on the
    driver, whose content is broadcast."""
    spark = conversations.sparkSession
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    # the start of the text, since samples of the ranges' keys go to the driver
    dealt = (rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, KEY_CHARS))
                 .sortWithinPartitions("conv_id", "turn", "role", "text"))
    return dealt.mapInArrow(_formatter(content, piece_chars), PIECE)


DIGEST = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()),
                       T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
                       T.StructField("loss_sha256", T.StringType()),
                       T.StructField("formatted_chars", T.LongType()),
                       T.StructField("n_tokens", T.LongType()), T.StructField("n_loss_tokens", T.LongType())])


#: A whole conversation's digest, or a bit of one: its counts are in the first bit of a
#: piece, ``turns`` and ``said`` are the next bytes to be hashed.
BIT = T.StructType([*DIGEST.fields, T.StructField("piece", T.LongType()), T.StructField("bit", T.LongType()),
                    T.StructField("turns", T.BinaryType()), T.StructField("said", T.BinaryType())])


def _arrow(rows: list[tuple], schema: T.StructType):
    import pyarrow as pa

    kinds = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.BinaryType(): pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[f.dataType]) for c, f in zip(zip(*rows), schema.fields)],
                                      names=schema.fieldNames())


def _read_back(batches):
    """The digest of each whole conversation; the bytes to be hashed of other pieces."""
    import hashlib

    rows, held = [], 0
    for b in batches:
        for i in range(b.num_rows):
            conv, piece, whole, text = (b.column(x)[i].as_py() for x in ("conv_id", "piece", "whole", "formatted"))
            spoken = parse(text)
            turns = "".join(f"{role}\n{said}\n" for role, said in spoken).encode()
            starts, ends, mask = (b.column(x)[i].values.to_numpy(zero_copy_only=False) for x in ("starts", "ends", "mask"))
            loss = "".join(masked_texts(text, starts, ends, mask))
            said, counts = loss.encode(), (len(text), len(mask), int(mask.sum()))
            if whole:
                rows.append((conv, len(spoken), hashlib.sha256(turns).hexdigest(), len(loss), hashlib.sha256(said).hexdigest(),
                             *counts, piece, 0, None, None))
            else:
                for n, at in enumerate(range(0, max(len(turns), len(said), 1), SENT)):
                    first = (len(spoken), None, len(loss), None, *counts) if n == 0 else (0, None, 0, None, 0, 0, 0)
                    rows.append((conv, *first, piece, n, turns[at:at + SENT], said[at:at + SENT]))
                held += len(turns) + len(said)
            if held >= 1 << 20 or len(rows) >= 1000:
                yield _arrow(rows, BIT)
                rows, held = [], 0
    if rows:
        yield _arrow(rows, BIT)


def _joined(batches):
    """Digests from the bits of conversations in order; whole ones as they are."""
    import hashlib

    conv = sums = every = loss = None

    def row():
        return (conv, sums[0], every.hexdigest(), sums[1], loss.hexdigest(), *sums[2:])

    for b in batches:
        rows = []
        for r in zip(*(b.column(f.name).to_pylist() for f in BIT.fields)):
            c, n_turns, turns_sha, chars, said_sha, *counts, _, _, turns, said = r
            if turns is None:
                rows.append((c, n_turns, turns_sha, chars, said_sha, *counts))
                continue
            if sums is None or c != conv:
                if sums is not None:
                    rows.append(row())
                conv, sums, every, loss = c, [0] * 5, hashlib.sha256(), hashlib.sha256()
            every.update(turns)
            loss.update(said)
            sums = [x + y for x, y in zip(sums, (n_turns, chars, *counts))]
        if rows:
            yield _arrow(rows, DIGEST)
    if sums is not None:
        yield _arrow([row()], DIGEST)


def digests(formatted: DataFrame) -> DataFrame:
    """What the rows of :func:`format_conversations` say, in any order, read back: counts
    and hashes per conversation. Pieces are parsed where they are; those of a conversation
    in several pieces send their bytes to one task, which hashes them one after the other."""
    bits = formatted.mapInArrow(_read_back, BIT).repartition("conv_id").sortWithinPartitions("conv_id", "piece", "bit")
    return bits.mapInArrow(_joined, DIGEST)
