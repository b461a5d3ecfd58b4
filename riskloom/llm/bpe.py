"""Byte-pair encoding by a tokenization automaton, and decoding by its arc labels.

The automaton reads tokens. It starts as one state with an arc to itself for every byte and takes one gadget per merge, in
order. The gadget of u + v: the state that arcs u lead to is copied without its arc v, and arcs u lead to the copy; every
state with an arc u gets an arc uv to where the path u, v led before. So u and v can no longer stand side by side, and uv takes
their place. All arcs of one label lead to one state, hence a gadget adds at most one state, and the finished automaton is
deterministic: a word has exactly one path, its encoding.

A state differs from the one it was copied from by one lost arc, so the arcs are stored by what is lost. Copies form a tree; for every
label the table has the subtrees that lost it and when. State q has the arc t = uv, born in merge k, if q has not lost t, and what
q was copied from had the arc u at k; that is one lookup per left part of t.

``encode`` splits texts at added tokens and by the splitting pattern, and walks the automaton over each distinct word: at a
place of a word the byte tree of labels offers the labels that fit, and the table says which of them are arcs; a dead end steps back.
``decode`` puts the labels of the tokens together.

Only the driver reads the file; the compiled automaton, a few MB for 50 000 merges, is broadcast. Its size is that of the vocabulary and does not grow with
the data. Encoding needs no shuffle; a task holds one Arrow slice and the words it has met (``KEPT`` at most).

Defined cases: null and empty texts have no tokens. Repeated rows, null ids and further columns (with any names) change nothing; texts of any length
are worked on whole, in pieces of ``PIECES`` words. A text that holds the string of an added token has that token there, as in the tokenizers library.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

PIECES = 200_000  # words worked on at once
ROWS = 256  # texts of an Arrow batch worked on at once
TOKENS = 4_000_000  # tokens of a batch that is given back
KEPT = 400_000  # words and arcs remembered
LONG = 64  # longer words are not remembered
#: How byte-level vocabularies split text before merging, a fixed value; <L>, <N> and <S> stand for letters, numerals and white space.
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d| ?[<L>]+| ?[<N>]+| ?[^<S><L><N>]+|[<S>]+(?![^<S>])|[<S>]+"


def byte_letters() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Words(dict):
    """The tokens of words met before, as packed numbers. When ``KEPT`` words are held they become the old ones, and of the
    old ones those met again are held on."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        out = self.old.get(word)
        if out is None:
            out = array("i", self.encode(word.encode())).tobytes()
        if len(word) <= LONG:
            if len(self) >= KEPT:
                self.old = dict(self)
                self.clear()
            self[word] = out
        return out


@dataclass
class Automaton:
    """``labels``: bytes of every token; ``target``: token -> state its arcs lead to; ``enter``: number of a state in the tree of
    copies, top down; ``lost``: label -> (first, last, merge) of the subtrees without it, by first; ``left``, ``born``: first part of a
    merged token and its merge; ``steps``, ``ends``: byte tree of the labels; ``added``: tokens found as strings; ``kinds``: code points of
    letters, numerals and white space as (first, last)."""

    labels: list[bytes]
    target: list[int]
    enter: list[int]
    lost: dict[int, tuple[list[int], list[int], list[int]]]
    left: list[int]
    born: list[int]
    steps: dict[int, int]
    ends: list[int]
    added: dict[str, int]
    kinds: dict[str, list[tuple[int, int]]]
    arcs: dict[int, bool] = field(default_factory=dict)

    def __post_init__(self):
        self.words = Words(self.encode_word)
        self.longest = max(map(len, self.labels), default=0)
        strings = sorted(self.added, key=len, reverse=True)
        self.fixed = re.compile("(" + "|".join(map(re.escape, strings)) + ")") if strings else None
        self.wide, self.latin = splitter(self.kinds), splitter(self.kinds, 255)  # a short class is searched faster

    def __reduce__(self):
        return Automaton, (self.labels, self.target, self.enter, self.lost, self.left, self.born, self.steps, self.ends, self.added, self.kinds)

    def has_arc(self, state: int, token: int) -> bool:
        at, limit = self.enter[state], len(self.labels)
        while True:
            gone = self.lost.get(token)
            if gone is not None:
                i = bisect_right(gone[0], at) - 1
                if i >= 0 and at <= gone[1][i] and gone[2][i] <= limit:
                    return False
            if self.left[token] < 0:
                return True
            limit, token = self.born[token], self.left[token]

    def fitting(self, word: bytes, at: int) -> list[int]:
        """All labels that stand at a place of a word, shortest first."""
        steps, ends, node, out = self.steps, self.ends, 0, []
        for b in word[at:at + self.longest]:
            node = steps.get(node << 8 | b, 0)
            if not node:
                break
            if ends[node] >= 0:
                out.append(ends[node])
        return out

    def encode_word(self, word: bytes) -> list[int]:
        """The labels of the one path that spells a word, found by trying long labels first. Every prefix of a word has one path
        too, so no place is reached twice and the search is linear."""
        labels, target, arcs, size, n = self.labels, self.target, self.arcs, len(self.labels), len(word)
        out, at, state, untried = [], 0, 0, [self.fitting(word, 0)]
        while at < n:
            options = untried[-1]
            while options:
                token = options.pop()
                known = arcs.get(state * size + token)
                if known is None:
                    if len(arcs) >= KEPT:
                        arcs.clear()
                    known = arcs[state * size + token] = self.has_arc(state, token)
                if known:
                    out.append(token)
                    at += len(labels[token])
                    state = target[token]
                    untried.append(self.fitting(word, at))
                    break
            else:
                untried.pop()
                at -= len(labels[out.pop()])
                state = target[out[-1]] if out else 0
        return out

    def split(self, text: str) -> Iterator[list[str]]:
        """The words of a text, ``PIECES`` at a time."""
        try:
            text.encode("latin-1")
            pattern = self.latin
        except UnicodeEncodeError:
            pattern = self.wide
        if len(text) <= PIECES:
            yield pattern.findall(text)
            return
        found = pattern.finditer(text)
        while words := [m.group() for m in islice(found, PIECES)]:
            yield words

    def encode(self, text: str | None) -> np.ndarray:
        out = []
        parts = self.fixed.split(text) if text and self.fixed and self.fixed.search(text) else [text or ""]
        for i, part in enumerate(parts):
            if i % 2:
                out.append(np.int32(self.added[part]).tobytes())
            elif part:
                out.extend(b"".join(map(self.words.__getitem__, words)) for words in self.split(part))
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: Iterable[int]) -> str:
        return spelled(self.labels, ids)


def spelled(labels: list[bytes], ids: Iterable[int]) -> str:
    """The labels of some tokens put together."""
    return b"".join(map(labels.__getitem__, ids)).decode("utf-8", "replace")


def _byte_tree(labels: dict[int, bytes]) -> tuple[dict[int, int], list[int]]:
    steps: dict[int, int] = {}
    ends = [-1]
    for token, label in labels.items():
        node = 0
        for b in label:
            after = steps.get(node << 8 | b)
            if after is None:
                after = steps[node << 8 | b] = len(ends)
                ends.append(-1)
            node = after
        ends[node] = token
    return steps, ends


def compiled(labels: list[bytes], merges: list[tuple[int, int, int]], added: dict[str, int], kinds: dict[str, list[tuple[int, int]]]) -> Automaton:
    """The automaton of ``merges`` (u, v, uv) in order. A merge whose parts can never stand side by side makes no arc."""
    size = len(labels)
    target, left, born = [0] * size, [-1] * size, [-1] * size
    copied, without, made = [0], [-1], [-1]
    tokens = {t: b for t, b in enumerate(labels) if len(b) == 1 and t not in added.values()}

    def has_arc(state: int, token: int) -> bool:
        limit = size
        while True:
            q = state
            while q:
                if without[q] == token and made[q] <= limit:
                    return False
                q = copied[q]
            if left[token] < 0:
                return True
            limit, token = born[token], left[token]

    for k, (u, v, both) in enumerate(merges):
        if labels[u] + labels[v] != labels[both] or both in tokens:
            raise ValueError(f"merge {k} does not make a new token of its parts")
        if u not in tokens or v not in tokens or not has_arc(target[u], v):
            continue
        tokens[both] = labels[both]
        target[both], left[both], born[both] = target[v], u, k
        copied.append(target[u])
        without.append(v)
        made.append(k)
        target[u] = len(copied) - 1

    below = [1] * len(copied)
    for q in range(len(copied) - 1, 0, -1):
        below[copied[q]] += below[q]
    enter, free = [0] * len(copied), [1] * len(copied)
    for q in range(1, len(copied)):  # a copy comes after what it was copied from
        enter[q] = free[copied[q]]
        free[copied[q]] += below[q]
        free[q] = enter[q] + 1
    spans: dict[int, list[tuple[int, int, int]]] = {}
    for q in range(1, len(copied)):
        spans.setdefault(without[q], []).append((enter[q], enter[q] + below[q] - 1, made[q]))
    lost = {t: tuple(map(list, zip(*sorted(s)))) for t, s in spans.items()}
    return Automaton(labels, target, enter, lost, left, born, *_byte_tree(tokens), added, kinds)


def _newer(kind: str, points: str, path: str) -> set[str]:
    """Letters or numerals that this Python's regex knows and the vocabulary's library does not.

    Libraries follow different Unicode versions. Only code points on which regex and the older tables of Python differ can be in question; the
    library is asked for those."""
    from tokenizers import Tokenizer

    asked = [c for c in points if unicodedata.category(c)[0] != kind]
    beside = {"L": "a", "N": "1"}[kind]
    starts = {a for _, (a, _) in Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str("".join(f"{beside}{c}\n" for c in asked))}
    return {c for k, c in enumerate(asked) if 3 * k + 1 in starts}


def kinds_of(path: str) -> dict[str, list[tuple[int, int]]]:
    """What the library of a vocabulary takes for letters (L), numerals (N) and white space (S)."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = {}
    for kind, name in (("L", "L"), ("N", "N"), ("S", "White_Space")):
        points = "".join(regex.findall(rf"\p{{{name}}}+", every))
        newer = _newer(kind, points, path) if kind != "S" else set()
        at = np.array([ord(c) for c in points if c not in newer])
        out[kind] = [(int(run[0]), int(run[-1])) for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1)]
    return out


def splitter(kinds: dict[str, list[tuple[int, int]]], last: int = 0x10FFFF) -> re.Pattern:
    """``PATTERN`` for texts whose code points go up to ``last``."""
    pattern = PATTERN
    for kind, runs in kinds.items():
        pattern = pattern.replace(f"<{kind}>", "".join(rf"\U{a:08X}-\U{b:08X}" for a, b in runs if a <= last))
    return re.compile(pattern)


def load(path: str) -> Automaton:
    """The automaton of a byte-level vocabulary file (JSON of the tokenizers library)."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, split = told["model"], told["pre_tokenizer"] or {}
    strange = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    if model["type"] != "BPE" or strange or told["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        raise ValueError(f"{path} is not a plain byte-level vocabulary")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in told["added_tokens"]):
        raise ValueError(f"{path} has added tokens that take white space")
    letters = byte_letters()
    added = {t["content"]: t["id"] for t in told["added_tokens"]}
    labels = [b""] * (1 + max([*model["vocab"].values(), *added.values()]))
    for name, token in model["vocab"].items():
        labels[token] = bytes(letters[c] for c in name)
    for name, token in added.items():
        labels[token] = name.encode()
    parts = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    number = model["vocab"]
    return compiled(labels, [(number[u], number[v], number[u + v]) for u, v in parts], added, kinds_of(path))


def encode(docs: DataFrame, automaton: Automaton, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id and ids, the tokens of its text."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton)  # as large as the vocabulary
    schema = T.StructType([docs.schema[doc_id], T.StructField("ids", T.ArrayType(T.IntegerType()), False)])

    def packed(ids: pa.Array, found: list[np.ndarray]) -> pa.RecordBatch:
        places = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(places), pa.array(np.concatenate(found)))], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                b = batch.slice(i, ROWS)
                first, found, held = 0, [], 0
                for k in range(b.num_rows):
                    found.append(a.encode(b.column(1)[k].as_py()))
                    held += len(found[-1])
                    if held > TOKENS or k == b.num_rows - 1:
                        yield packed(b.column(0).slice(first, k + 1 - first), found)
                        first, found, held = k + 1, [], 0

    return docs.select(doc_id, text).mapInArrow(run, schema)


def decode(encoded: DataFrame, automaton: Automaton, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """All columns and the text that the tokens spell; null tokens spell a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(automaton.labels)  # as large as the vocabulary
    schema = T.StructType([f for f in encoded.schema if f.name != name] + [T.StructField(name, T.StringType())])
    place = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                b = batch.slice(i, ROWS)
                rows = (b.column(place)[k] for k in range(b.num_rows))
                texts = [spelled(shared.value, r.values.to_pylist()) if r.is_valid else None for r in rows]
                kept = [c for c, f in zip(b.columns, b.schema) if f.name != name]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], names=schema.names)

    return encoded.mapInArrow(run, schema)
