"""Conversations as tokens with a loss mask.

Each message is rendered by a template, tokenized, and its tokens are told apart by where they
begin in the rendered text: those of an assistant's message behind the words that introduce it are
learned, no others.  A template's system prompt stands before a conversation that brings none.
Tokenizers are loaded once per worker from a file whose path is a parameter."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

TOKENS = "array<int>"
PADS, TRUNCATIONS = ("right", "none"), ("left", "right", "error")
#: Bytes of text, or tokens, that a task works on at once: what the tokenizer tells of a token takes
#: over a hundred bytes, and an Arrow batch may have millions.
AT_ONCE = 1 << 18


@dataclass(frozen=True)
class Template:
    """``before`` may name the role; ``system`` is what a conversation without such a message gets."""

    before: str = "<|im_start|>{role}\n"
    after: str = "<|im_end|>\n"
    system: str | None = "You are a helpful assistant."

    def rendered(self, messages: list[dict]) -> list[tuple[str, int]]:
        """The text of each message, and from which character on it is learned."""
        out = []
        if self.system is not None and messages and messages[0]["role"] != "system":
            out.append((self.before.format(role="system") + self.system + self.after, -1))
        for m in messages:
            head = self.before.format(role=m["role"])
            out.append((head + (m["text"] or "") + self.after, len(head) if m["role"] == "assistant" else -1))
        return out


@lru_cache(2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def pieces(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in turn, as many at once as have ``AT_ONCE`` together, or one."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, before + AT_ONCE, "right")), start + 1)
        yield batch.slice(start, stop - start)
        start = stop


def text_sizes(messages: pa.ListArray) -> np.ndarray:
    """Bytes of each conversation's texts, and some for each message's words around it."""
    size = pc.fill_null(pc.binary_length(pc.struct_field(messages.flatten(), "text")), 0).to_numpy(zero_copy_only=False) + 64
    return np.bincount(pc.list_parent_indices(messages).to_numpy(), size, len(messages)).astype(np.int64)


def masked_tokens(conversations: list[list[dict]], path: str, template: Template) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, mask) of each conversation."""
    rendered = [template.rendered(c) for c in conversations]
    encoded = iter(tokenizer(path).encode_batch([text for c in rendered for text, _ in c], add_special_tokens=False))
    out = []
    for c in rendered:
        ids, mask = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for _, learned in c:
            e = next(encoded)
            ids.append(np.array(e.ids, np.int32))
            start = np.array([a for a, _ in e.offsets], np.int64)
            mask.append((start >= learned).astype(np.int32) if learned >= 0 else np.zeros(len(start), np.int32))
        out.append((np.concatenate(ids), np.concatenate(mask)))
    return out


def fitted(ids: np.ndarray, mask: np.ndarray, length: int, pad: str, truncation: str, pad_id: int) -> tuple[np.ndarray, ...]:
    """(ids, mask, attention, positions) of at most ``length`` tokens, or exactly as many if padded.

    Truncation on the left keeps the last tokens with the positions they had; without padding the first
    tokens are kept whatever the side."""
    n = len(ids)
    if n > length and truncation == "error":
        raise ValueError(f"a conversation of {n} tokens is longer than {length}")
    at = np.arange(n, dtype=np.int32)
    kept = slice(max(n - length, 0), n) if truncation == "left" and pad == "right" else slice(0, length)
    ids, mask, at, attention = ids[kept], mask[kept], at[kept], np.ones(min(n, length), np.int32)
    if pad == "right":
        more = length - len(ids)
        ids = np.concatenate((ids, np.full(more, pad_id, np.int32)))
        mask, attention, at = (np.concatenate((x, np.zeros(more, np.int32))) for x in (mask, attention, at))
    return ids, mask, attention, at


def loss_mask(df: DataFrame, messages: str, path: str, length: int, pad: str = "right", truncation: str = "error", pad_id: int = 0, template: Template | None = None) -> DataFrame:
    """``df`` with input_ids, loss_mask, attention_mask and position_ids of ``messages``, an array of
    (role, text); a null or empty conversation has no tokens."""
    if pad not in PADS or truncation not in TRUNCATIONS:
        raise ValueError(f"pad is one of {PADS}, truncation one of {TRUNCATIONS}")
    template, names = template or Template(), ["input_ids", "loss_mask", "attention_mask", "position_ids"]
    at = df.columns.index(messages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b, text_sizes(b.column(at)))):
            told = masked_tokens([c or [] for c in batch.column(at).to_pylist()], path, template)
            rows = [fitted(ids, mask, length, pad, truncation, pad_id) for ids, mask in told]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[k] for r in rows], pa.list_(pa.int32())) for k in range(4))], names=[*batch.schema.names, *names])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *(T.StructField(n, T.ArrayType(T.IntegerType())) for n in names)]))


def learned_text(df: DataFrame, path: str, name: str = "learned", whole: str = "whole") -> DataFrame:
    """The texts of the learned and of all attended tokens, as the tokenizer decodes them."""
    places = [df.columns.index(c) for c in ("input_ids", "loss_mask", "attention_mask")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b, pc.fill_null(pc.list_value_length(b.column(places[0])), 0).to_numpy(zero_copy_only=False))):
            rows = list(zip(*(batch.column(k).to_pylist() for k in places), strict=True))
            of = lambda chosen: pa.array(tokenizer(path).decode_batch(chosen, skip_special_tokens=False), pa.string())
            learned = of([[i for i, m in zip(ids, mask, strict=True) if m] for ids, mask, _ in rows])
            every = of([[i for i, a in zip(ids, attention, strict=True) if a] for ids, _, attention in rows])
            yield pa.RecordBatch.from_arrays([*batch.columns, learned, every], names=[*batch.schema.names, name, whole])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.StringType()), T.StructField(whole, T.StringType())]))


def within_tokens(df: DataFrame, messages: str, path: str, most: int, template: Template | None = None) -> DataFrame:
    """Prompts of at most ``most`` tokens, with the words that begin an answer; one that can't be
    rendered or tokenized is left out."""
    template = template or Template()
    at = df.columns.index(messages)

    def fits(conversation: list[dict] | None) -> bool:
        try:
            text = "".join(t for t, _ in template.rendered(conversation)) + template.before.format(role="assistant")
            return len(tokenizer(path).encode(text, add_special_tokens=False).ids) <= most
        except (TypeError, KeyError, ValueError, IndexError, AttributeError):
            return False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([fits(c) for c in batch.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)
