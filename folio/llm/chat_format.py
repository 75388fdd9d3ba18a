"""Chat formatting at the level of tokens.

Each text of a turn is encoded by itself, and turns are marked by reserved ids spliced between the segments: ids past the tokenizer's
own, which no text can yield. A control string inside a text is also escaped, so that the formatted text as well, once
rendered, can be read in one way only. The loss mask is a running sum over marks at both ends of what is to be learned.

Formatting a turn needs its own row alone. Turns are dealt by ranges of (conversation, turn), so a conversation of very many
turns is worked on by many tasks and comes out in several parts.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.shared import folder, table
from folio.llm.token_file import TOKENIZER, _encoder
from folio.llm.words import chunks

#: Marks of turns, in the order of their ids. Other roles are named between the first two of the last three.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|role|>", "<|text|>", "<|end|>"]
BOS, EOS, INST, INST_END, SYS, SYS_END, ROLE, TEXT, END = range(len(CONTROL))
#: Strings that are escaped in texts: marks, and what the tokenizer itself takes for a special token.
ESCAPED = [*CONTROL, "<|endoftext|>"]
#: Marks before the role, between role and text, and after the text, by kind of turn.
KINDS = {"user": ([BOS, INST], [], INST_END), "assistant": ([], [], EOS), "system": ([SYS], [], SYS_END), None: ([ROLE], [TEXT], END)}
#: Ids of one row of the output; a longer conversation has several.
PART_IDS = 1 << 20
OUT = "conv_id long, range int, part long, n_turns long, ids array<int>, loss array<boolean>"


def _patterns(strings: list[str]) -> list[tuple[str, str]]:
    """For each first character of control strings: it, and a pattern of backslashes and what follows them."""
    return [(c, r"(\\*)(" + "|".join(re.escape(s[1:]) for s in strings if s[0] == c) + ")") for c in dict.fromkeys(s[0] for s in strings)]


def escape(text: Column, strings: list[str] = ESCAPED) -> Column:
    """A backslash after the first character of each control string, and one more where there are some already."""
    for c, rest in _patterns(strings):
        text = F.regexp_replace(text, re.escape(c) + rest, c + r"\\$1$2")
    return text


@functools.cache
def _unescape(strings: tuple[str, ...]):
    return [(re.compile(re.escape(c) + r"\\" + rest), c + r"\1\2") for c, rest in _patterns(list(strings))]


def unescape(text: str, strings: list[str] = ESCAPED) -> str:
    for pattern, plain in _unescape(tuple(strings)):
        text = pattern.sub(plain, text)
    return text


def splice(segments: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Segments (flat ids, where each row's begin and one more) side by side: flat ids of whole rows, and where each segment of
    each row begins (rows + 1, segments); the last row holds the end."""
    size = np.stack([np.diff(first) for _, first in segments], 1)
    start = np.concatenate(([0], np.cumsum(size)))
    out = np.empty(start[-1], np.int32)
    begin = start[:-1].reshape(size.shape)
    for k, (flat, first) in enumerate(segments):
        out[np.arange(len(flat)) + np.repeat(begin[:, k] - first[:-1], size[:, k])] = flat
    return out, np.concatenate((begin, np.full((1, size.shape[1]), start[-1])))


def mask(start: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """True from each start to before its end: the running sum of marks at both."""
    marks = np.zeros(size + 1, np.int32)
    np.add.at(marks, start, 1)
    np.add.at(marks, end, -1)
    return np.cumsum(marks[:-1]) > 0


class Formatter:
    """Formats turns with one tokenizer."""

    def __init__(self, path: str, learn_end: bool):
        self.encoder, self.learn_end = _encoder(path), learn_end
        self.first = self.encoder.tokenizer.get_vocab_size()

    def _marks(self, kinds: list, place: int) -> tuple[np.ndarray, np.ndarray]:
        ids = [KINDS[k][place] if place < 2 else [KINDS[k][2]] for k in kinds]
        return np.array([self.first + m for row in ids for m in row], np.int32), np.concatenate(([0], np.cumsum([len(row) for row in ids], dtype=np.int64)))

    def turns(self, roles: pa.Array, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each chunk of rows: its first row; ids of all its turns, whether each is learned, and where each turn begins."""
        for chunk in chunks(texts):
            role = roles.slice(chunk.first, len(chunk)).to_pylist()
            kinds = [r if r in KINDS and r is not None else None for r in role]
            names = pa.array(["" if k else r for k, r in zip(kinds, role, strict=True)], pa.string())
            named = [self.encoder.encode(c) for c in chunks(names)]
            flat = np.concatenate([ids for ids, _ in named])
            first = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(f) for _, f in named]))))
            ids, begin = splice([self._marks(kinds, 0), (flat, first), self._marks(kinds, 1), self.encoder.encode(chunk), self._marks(kinds, 2)])
            learned = np.array([k == "assistant" for k in kinds])
            end = begin[1:, 0] if self.learn_end else begin[:-1, 4]
            yield chunk.first, ids, mask(begin[:-1, 3][learned], end[learned], len(ids)), begin[:, 0]


def _format(path: str, learn_end: bool, part_ids: int):
    names = [x.split()[0] for x in OUT.split(", ")]

    def rows(batches):
        """Turns of one conversation that follow each other, at most a chunk's: conversation, turns, ids, loss."""
        formatter = Formatter(path, learn_end)
        for batch in batches:
            conv = batch.column("conv_id")
            for at, ids, loss, start in formatter.turns(batch.column("role"), batch.column("text")):
                own = conv.slice(at, len(start) - 1).to_pylist()
                heads = [i for i, c in enumerate(own) if not i or c != own[i - 1]]
                for i, j in zip(heads, [*heads[1:], len(own)], strict=True):
                    yield own[i], j - i, ids[start[i] : start[j]], loss[start[i] : start[j]]

    def parts(batches):
        """Whole conversations, but for those that go on past a part's size or into the next range."""
        held, number = None, 0
        for c, n, ids, loss in rows(batches):
            if held is not None and held[0] == c and held[4] < part_ids:
                held = (c, held[1] + n, [*held[2], ids], [*held[3], loss], held[4] + len(ids))
                continue
            if held is not None:
                yield number, held
                number += 1
            held = (c, n, [ids], [loss], len(ids))
        if held is not None:
            yield number, held

    def run(batches):
        here, out, size = TaskContext.get().partitionId(), [], 0

        def batch():
            lists = lambda k, kind: pa.array([np.concatenate(h[k]) for _, h in out], pa.list_(kind))
            c, n = zip(*((h[0], h[1]) for _, h in out), strict=True)
            columns = [pa.array(c, pa.int64()), pa.array([here] * len(out), pa.int32()), pa.array([k for k, _ in out], pa.int64()), pa.array(n, pa.int64()), lists(2, pa.int32()), lists(3, pa.bool_())]
            return pa.RecordBatch.from_arrays(columns, names)

        for number, held in parts(batches):
            out.append((number, held))
            size += held[4]
            if size >= part_ids or len(out) >= 10_000:
                yield batch()
                out, size = [], 0
        if out:
            yield batch()

    return run


def write_chats(conversations: DataFrame, path: str, tokenizer: str | None = None, learn_end: bool = False, part_ids: int = PART_IDS) -> None:
    """Formats `conversations` (conv_id, turn, role, text) and writes Parquet under `path`: conv_id, range and part (numbers whose
    order is that of the turns), n_turns, ids, loss (whether an id is learned: those of assistants' texts; with
    `learn_end` their end mark too).

    Turns of a conversation are ordered by turn (null first), then role, then text. Null role or text: empty. Any role
    that isn't user, assistant or system is named in the output. Null conv_id: one conversation of its own. Repeated rows
    are turns each. Very long texts are encoded whole; conversations of over a million ids come in parts, as do those that
    lie across two ranges. Empty table: no rows. Other columns, whatever their names, are not looked at.
    """
    plain = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    rows = plain.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    shown = rows.select("conv_id", *(escape(F.col(c)).alias(c) for c in ("role", "text")))
    shown.mapInArrow(_format(tokenizer or public_tokenizers.path(TOKENIZER), learn_end, part_ids), OUT).write.parquet(path)


def read_chats(spark, path: str) -> DataFrame:
    return spark.read.schema(OUT).parquet(path)


class Reader:
    """Renders ids as text: the bytes of each id of a byte-level tokenizer, then the marks."""

    def __init__(self, path: str):
        tokenizer = _encoder(path).tokenizer
        self.first = tokenizer.get_vocab_size()
        # characters that stand for bytes: printable ones for themselves, the rest from 256 on
        plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        pieces = [bytes(byte[c] for c in tokenizer.id_to_token(i)) if i < self.first else CONTROL[i - self.first].encode() for i in range(self.first + len(CONTROL))]
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)
        self.off = np.concatenate(([0], np.cumsum([len(p) for p in pieces])))

    def bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, and where those of each begin (one more at the end)."""
        size = self.off[ids + 1] - self.off[ids]
        upto = np.concatenate(([0], np.cumsum(size)))
        return self.flat[np.arange(upto[-1]) + np.repeat(self.off[ids] - upto[:-1], size)], upto

    def turns(self, ids: np.ndarray) -> Iterator[tuple[str, str]]:
        """Role and text of each turn, read from the marks."""
        data, upto = self.bytes(ids)
        raw = data.tobytes()
        marks = np.flatnonzero(ids >= self.first)
        kind = (ids[marks] - self.first).tolist()
        begin, end = upto[np.concatenate(([0], marks + 1))].tolist(), upto[np.concatenate((marks, [len(ids)]))].tolist()
        closing = {INST_END: "user", EOS: "assistant", SYS_END: "system", END: None}
        for i, k in enumerate(kind):  # segment i lies before mark i
            if k in closing:
                role = closing[k] if k != END else unescape(raw[begin[i - 1] : end[i - 1]].decode())
                yield role, unescape(raw[begin[i] : end[i]].decode())

    def learned(self, ids: np.ndarray, loss: np.ndarray) -> Iterator[str]:
        """Each stretch of text under the loss mask; marks are no text."""
        edge = np.diff(np.concatenate(([0], (loss & (ids < self.first)).astype(np.int8), [0])))
        data, upto = self.bytes(ids)
        for i, j in zip(upto[np.flatnonzero(edge == 1)].tolist(), upto[np.flatnonzero(edge == -1)].tolist(), strict=True):
            yield unescape(data[i:j].tobytes().decode())

    def length(self, ids: np.ndarray) -> int:
        """Code points of the formatted text."""
        return int(((self.bytes(ids)[0] & 0xC0) != 0x80).sum())


def _lists(batch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids, loss = batch.column("ids"), batch.column("loss")
    flat, learned = ids.values.to_numpy(zero_copy_only=False), loss.values.to_numpy(zero_copy_only=False)
    for a, b, c, d in zip(*(x.tolist() for o in (ids.offsets.to_numpy(), loss.offsets.to_numpy()) for x in (o[:-1], o[1:])), strict=True):
        yield flat[a:b], learned[c:d]


def _turns(path: str):
    def run(batches):
        reader = Reader(path)
        for batch in batches:
            for i, (ids, _) in enumerate(_lists(batch)):
                got = list(reader.turns(ids))
                same = lambda c, i=i, n=len(got): batch.column(c).take(pa.array([i] * n, pa.int64()))
                yield pa.RecordBatch.from_arrays([same("conv_id"), same("range"), same("part"), pa.array(range(len(got)), pa.int64()), pa.array([r for r, _ in got], pa.string()), pa.array([x for _, x in got], pa.string())], ["conv_id", "range", "part", "place", "role", "text"])

    return run


def turns(chats: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The turns again, from what was written: conv_id; range, part, place (their order); role, text."""
    return chats.mapInArrow(_turns(tokenizer or public_tokenizers.path(TOKENIZER)), "conv_id long, range int, part long, place long, role string, text string")


def _digests(path: str):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        reader, out, now = Reader(path), [], None

        def ended():
            return (now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5])

        for batch in batches:
            for c, (ids, loss) in zip(batch.column("conv_id").to_pylist(), _lists(batch), strict=True):
                if now is None or now[0] != c:
                    if now is not None:
                        out.append(ended())
                    now = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in reader.turns(ids):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                for text in reader.learned(ids, loss):
                    now[3] += len(text)
                    now[4].update(text.encode())
                now[5] += reader.length(ids)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(ended(), kinds, strict=True)], names)

    return run


def digests(chats: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row a conversation of what was written. A digest is a running one: parts stream through it in order, none is kept."""
    rows = chats.repartition("conv_id").sortWithinPartitions("conv_id", "range", "part")
    return rows.mapInArrow(_digests(tokenizer or public_tokenizers.path(TOKENIZER)), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op11_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold marks."""
    ok = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    path = folder(spark, "chats")
    write_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(ok), path)
    return digests(read_chats(spark, path))


def _sql() -> str:
    shown = {"role": "role", "text": "text"}
    for name in shown:
        for c, rest in _patterns(ESCAPED):
            shown[name] = f"regexp_replace({shown[name]}, '{re.escape(c) + rest}', '{c}\\\\\\1\\2', 'g')"
    marks = {k: sum(len(CONTROL[m]) for m in [*a, *b, c]) for k, (a, b, c) in KINDS.items()}
    own = " ".join(f"WHEN '{k}' THEN {n}" for k, n in marks.items() if k)
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) AS r(i)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({shown["text"]}) + CASE role {own} ELSE {marks[None]} + length({shown["role"]}) END) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""


SQL = _sql()
