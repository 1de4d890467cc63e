"""Chat formatting with a loss mask over tokens.

A conversation is rendered whole, turn after turn, as ``<|turn|>role<|body|>text<|end|>``. The three marks are single
tokens of their own. Texts and roles that hold a control string (``<|``, ``<s>``, ``</s>``, ``[INST]``,
``[/INST]``) get one more backslash after its first character, so no text can act as a mark, and taking that
backslash away gives the text again. What is rendered is encoded once, with character offsets. The spans of the
assistant's texts and those of the tokens are both sorted; binary search finds the tokens of each span.

Rows of a conversation come in order to one task, which holds no more than ``PART_CHARS`` characters (or one longer turn)
at a time: as marks are tokens of their own, parts that end with a turn have the tokens of the whole.

Defined results: null texts and roles are empty; rows without a conversation id are one conversation; turns of one
number follow each other by role and text; a null turn number comes first; repeated rows are turns of their own; an
empty table gives an empty result; a very long turn is a part of its own. Other columns may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm._common import prepare, worker_state

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
TOKENIZER = "byte_bpe_50k.json"
LEARNED_ROLE = "assistant"
PART_CHARS = 200_000
_CONTROL = r"(?=\||/?INST\]|/?s>)"
_ESCAPE = re.compile(rf"([<\[])(\\*){_CONTROL}")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*){_CONTROL}")
_TURN = re.compile(rf"{re.escape(TURN)}(.*?){re.escape(BODY)}(.*?){re.escape(END)}", re.S)


def escape(text: str) -> str:
    """The text with no control string left."""
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    """The text that was escaped."""
    return _UNESCAPE.sub(r"\1\2", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, str]]]:
    """The formatted turns, and the span and role of each text in it, in order."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{BODY}", escape(text)
        out += [head, body, END]
        spans.append((at + len(head), at + len(head) + len(body), role))
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def tokenizer(name: str = TOKENIZER):  # noqa: ANN201
    """The public tokenizer with the template's marks as tokens; offsets keep white space."""
    import public_tokenizers
    from tokenizers import AddedToken, Tokenizer, processors

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    t.post_processor = processors.ByteLevel(trim_offsets=False)
    t.add_special_tokens([AddedToken(s, normalized=False) for s in (TURN, BODY, END)])
    return t


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int, str]], learned: str = LEARNED_ROLE) -> np.ndarray:
    """1 for each token that lies in a learned text. Tokens and spans are sorted."""
    mask = np.zeros(len(starts), dtype=np.int8)
    wanted = np.array([(a, b) for a, b, role in spans if role == learned and a < b], dtype=np.int64).reshape(-1, 2)
    for lo, hi in zip(np.searchsorted(ends, wanted[:, 0], side="right"), np.searchsorted(starts, wanted[:, 1], side="left"), strict=True):
        mask[lo:hi] = 1
    return mask


def masked_texts(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> list[str]:
    """The unescaped text under each run of masked tokens."""
    edges = np.flatnonzero(np.diff(np.r_[0, mask, 0]))
    return [unescape(formatted[starts[a] : ends[b - 1]]) for a, b in zip(edges[::2], edges[1::2], strict=True)]


PARTS = "conv_id {id}, part bigint, n_turns bigint, formatted string, ids array<int>, starts array<int>, ends array<int>, mask array<tinyint>"


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", name: str = TOKENIZER, part_chars: int = PART_CHARS) -> DataFrame:
    """Parts of formatted conversations, in order within each partition: conv_id, part, n_turns, formatted, ids, starts, ends, mask."""
    prepare(rows.sparkSession)
    kind = rows.schema[conv_col].dataType.simpleString()
    named = rows.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("n"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("r"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    ordered = named.repartition("c").sortWithinPartitions("c", "n", "r", "t")

    def finished(done: list[tuple[object, int, list[tuple[str, str]]]]) -> pd.DataFrame:
        tok = worker_state(f"chat {name}", lambda: tokenizer(name))
        made = [render(turns) for *_, turns in done]
        out = []
        for (conv, part, turns), (text, spans), e in zip(done, made, tok.encode_batch([t for t, _ in made], add_special_tokens=False), strict=True):
            offsets = np.array(e.offsets, dtype=np.int32).reshape(-1, 2)
            out.append((conv, part, len(turns), text, np.array(e.ids, dtype=np.int32), offsets[:, 0].copy(), offsets[:, 1].copy(), loss_mask(offsets[:, 0], offsets[:, 1], spans)))
        return pd.DataFrame(out, columns=["conv_id", "part", "n_turns", "formatted", "ids", "starts", "ends", "mask"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: list[tuple[object, int, list[tuple[str, str]]]] = []
        turns: list[tuple[str, str]] = []
        conv, part, size, waiting, begun = None, 0, 0, 0, False
        for batch in batches:
            ids = [None if pd.isna(c) else c for c in batch["c"]]
            for c, role, text in zip(ids, batch["r"], batch["t"], strict=True):
                if begun and (c != conv or size + len(text) > part_chars and turns):
                    done.append((conv, part, turns))
                    waiting += size
                    part = part + 1 if c == conv else 0
                    turns, size = [], 0
                    if waiting > part_chars:
                        yield finished(done)
                        done, waiting = [], 0
                conv, begun = c, True
                turns.append((role, text))
                size += len(text)
        if begun:
            yield finished([*done, (conv, part, turns)])

    return ordered.mapInPandas(run, PARTS.format(id=kind))
