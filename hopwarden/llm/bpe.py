"""Byte-pair encoding by a lazily determinised finite-state transducer.

The merges of a public vocabulary are compiled on demand into a transducer over bytes. Every prefix of a piece has
exactly one last token: the vocabulary token ending there that tokenises to itself and that may follow the last token
of the prefix before it. A state therefore is the last emitted token and the bytes after it; reading a byte adds the
one new last token, drops starts from which no vocabulary token can still reach further, and emits the tokens that all
remaining starts share. Look-ahead is bounded by the longest token. States and transitions are made when first met
and kept; whole words are kept as shortcuts over their path, so common text costs a look-up a word.

Decoding streams: bytes of the ids go through an incremental UTF-8 state machine, so a character split over two ids,
or over two calls, comes out once and whole.
"""

from __future__ import annotations

import base64
import bisect
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Place of the public vocabulary; every function takes another one as a parameter.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: how the vocabulary's texts are cut into pieces before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Bounds of what a worker remembers: states of the transducer and words.
MAX_STATES, MAX_WORDS = 200_000, 150_000


class Transducer:
    """Encodes one piece (bytes) at a time; `ranks` is the content of a vocabulary file."""

    def __init__(self, vocabulary: bytes) -> None:
        pairs = [line.split() for line in vocabulary.splitlines() if line.strip()]
        self.ranks = {base64.b64decode(t): int(r) for t, r in pairs}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.ordered = sorted(self.ranks)
        self.longest = max(map(len, self.ordered))
        self._fits: dict[tuple[bytes, bytes], bool] = {}
        self._whole: dict[bytes, bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = []
        self.ends: list[tuple[int, ...] | None] = []
        self._state((b"", b"", (), (0,)))

    def _state(self, key: tuple) -> int:
        found = self.ids.get(key[:2])
        if found is None:
            found = self.ids[key[:2]] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            self.ends.append(None)
        return found

    def _merge(self, text: bytes) -> list[bytes]:
        """Merges by rank, for the two tokens of a boundary only."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            ranked = [(self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)]
            rank, i = min(ranked)
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _is_whole(self, token: bytes) -> bool:
        if token not in self._whole:
            self._whole[token] = self._merge(token) == [token]
        return self._whole[token]

    def _may_follow(self, before: bytes, token: bytes) -> bool:
        if not before:
            return True
        pair = (before, token)
        if pair not in self._fits:
            if len(self._fits) > MAX_STATES:
                self._fits.clear()
            self._fits[pair] = self._merge(before + token) == [before, token]
        return self._fits[pair]

    def _reaches_on(self, text: bytes) -> bool:
        """Whether a longer vocabulary token starts with text."""
        i = bisect.bisect_right(self.ordered, text)
        return i < len(self.ordered) and self.ordered[i].startswith(text)

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """State: (last emitted token, pending bytes, ((position, last token there), ...), open starts)."""
        before, pending, lasts, starts = self.states[state]
        last = dict(lasts)
        text = pending + bytes((byte,))
        end = len(text)
        for s in starts:
            token = text[s:end]
            if token in self.ranks and self._is_whole(token) and self._may_follow(last[s] if s else before, token):
                last[end] = token
                break
        else:
            raise ValueError(f"no token ends at {text!r} after {before!r}")
        opened = [s for s in starts if self._reaches_on(text[s:end])] + [end]

        def back(s: int) -> list[int]:
            at = [s]
            while at[-1]:
                at.append(at[-1] - len(last[at[-1]]))
            return at[::-1]

        chains = [back(s) for s in opened]
        cut = 0
        for level in zip(*chains):
            if len(set(level)) > 1:
                break
            cut = level[0]
        emitted = [last[p] for p in chains[0] if 0 < p <= cut]
        kept = {p for c in chains for p in c if p > cut}
        key = (
            emitted[-1] if emitted else before,
            text[cut:],
            tuple((p - cut, last[p]) for p in sorted(kept)),
            tuple(s - cut for s in opened),
        )
        return self._state(key), tuple(self.ranks[t] for t in emitted)

    def encode(self, piece: bytes) -> list[int]:
        state, out = 0, []
        moves = self.moves
        for byte in piece:
            step = moves[state].get(byte)
            if step is None:
                step = moves[state][byte] = self._step(state, byte)
            state = step[0]
            if step[1]:
                out += step[1]
        tail = self.ends[state]
        if tail is None:
            _, pending, lasts, _ = self.states[state]
            last, at, back = dict(lasts), len(pending), []
            while at:
                back.append(self.ranks[last[at]])
                at -= len(last[at])
            tail = self.ends[state] = tuple(back[::-1])
        out += tail
        if len(self.states) > MAX_STATES:
            self._reset()
        return out


class _Words(dict):
    """Ids of a word, with or without the space before it; makes them through the transducer when first met."""

    def __init__(self, encoder: Encoder, lead: str) -> None:
        self.encoder, self.lead = encoder, lead

    def __missing__(self, word: str) -> tuple[int, ...]:
        if word[-4:-3] in _MARKS and _FIGURES(word):  # time codes: no two alike, so they are kept in two parts
            if len(word) <= 13:
                return self[word[:-3]] + self.encoder.pieces[word[-3:]]
            parts = _RUNS(word)
            piece = self.encoder.pieces
            return tuple(chain(piece[self.lead + parts[0]], *map(piece.__getitem__, parts[1:])))
        ids = tuple(self.encoder.by_pattern(self.lead + word))
        if len(self) >= MAX_WORDS:
            self.clear()
        if len(word) <= 64 and word[0] != "{":
            self[word] = ids
        return ids


class _Pieces(dict):
    def __init__(self, transducer: Transducer) -> None:
        self.transducer = transducer

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.transducer.encode(piece.encode("utf-8", "replace")))
        if len(self) >= MAX_WORDS:
            self.clear()
        if len(piece) <= 32:
            self[piece] = ids
        return ids


_MARKS = (",", ".")
_FIGURES = re.compile(r"[0-9][0-9:,.]*[,.][0-9]{3}\Z", re.ASCII).match
_RUNS = re.compile(r"[0-9]+|[^0-9]+", re.ASCII).findall


class Encoder:
    """Encodes whole texts: lines and words where cutting there is certain to agree with PATTERN, else the pattern itself."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN) -> None:
        self.transducer = Transducer(vocabulary)
        self.cut = regex.compile(pattern).findall
        self.pieces = _Pieces(self.transducer)
        self.first, self.later = _Words(self, ""), _Words(self, " ")

    def by_pattern(self, text: str) -> Iterator[int]:
        return chain.from_iterable(map(self.pieces.__getitem__, self.cut(text)))

    def _space_run(self, run: str, at_end: bool) -> list[int]:
        """Ids of white space that ends in a line end: before more text its last character is a piece of its own."""
        piece = self.pieces
        if at_end or len(run) == 1:
            return list(piece[run])
        return [*piece[run[:-1]], *piece[run[-1]]]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and empty texts have none."""
        out: list[int] = []
        if not text:
            return out
        add, first, later, pieces = out.extend, self.first, self.later.__getitem__, self.pieces
        newline = pieces["\n"]
        run = held = ""
        started = False
        for line in text.split("\n"):
            if started:
                run += "\n"
            started = True
            if not line:
                continue
            core, tail = (line[:-1], "\r") if line[-1] == "\r" else (line, "")
            if not core:
                run += tail
                continue
            words = core.split()
            if " ".join(words) == core:  # single spaces between words and no other white space
                if held:  # text up to here, which ends in a line end
                    add(chain.from_iterable(map(pieces.__getitem__, self.cut(held + run + "x")[:-1])))
                    held = ""
                elif run == "\n":
                    add(newline)
                elif run:
                    add(self._space_run(run, False))
                run = tail
                add(first[words[0]])
                if len(words) > 1:
                    add(chain.from_iterable(map(later, words[1:])))
            else:
                held += run + line
                run = ""
        if held:
            add(self.by_pattern(held + run))
        elif run:
            add(self._space_run(run, True))
        return out


class Utf8Stream:
    """Incremental decoder: bytes in any cuts, text out; what cannot be UTF-8 becomes U+FFFD once per maximal bad run.

    The state is the number of continuation bytes still due, the range the next one must be in, and the value so far.
    """

    def __init__(self) -> None:
        self.due, self.low, self.high, self.value = 0, 0x80, 0xBF, 0

    def feed(self, data: bytes, final: bool = False) -> str:
        out: list[str] = []
        for b in data:
            if self.due:
                if self.low <= b <= self.high:
                    self.value, self.due, self.low, self.high = self.value << 6 | b & 0x3F, self.due - 1, 0x80, 0xBF
                    if not self.due:
                        out.append(chr(self.value))
                    continue
                out.append("�")
                self.due = 0
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.due, self.low, self.high, self.value = 1, 0x80, 0xBF, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                self.due, self.low, self.high, self.value = 2, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF, b & 0x0F
            elif 0xF0 <= b <= 0xF4:
                self.due, self.low, self.high, self.value = 3, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF, b & 0x07
            else:
                out.append("�")
        if final and self.due:
            out.append("�")
            self.due = 0
        return "".join(out)


def decode(transducer: Transducer, ids: list[int]) -> str:
    stream = Utf8Stream()
    return "".join(stream.feed(transducer.tokens[i]) for i in ids) + stream.feed(b"", final=True)


_made: dict[int, Encoder] = {}


def _encoder(vocabulary: bytes) -> Encoder:
    """One encoder per worker process and vocabulary."""
    key = hash(vocabulary)
    if key not in _made:
        _made.clear()
        _made[key] = Encoder(vocabulary)
    return _made[key]


def _shared(spark: SparkSession, path: str):
    """The vocabulary file (fixed, about 0.6 MB) as a broadcast, so that only the driver needs the file."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(df: DataFrame, keep: list[str], text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """The kept columns and `ids` (array<int>): every row's text as token ids, without special tokens.

    Null and empty texts have the empty list. Strings that look like special tokens are ordinary text. Any length.
    """
    shared = _shared(df.sparkSession, path)
    picked = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            flat, offsets = array("i"), array("i", [0])
            for text in batch.column(batch.num_columns - 1).to_pylist():
                flat.fromlist(encoder.encode(text))
                offsets.append(len(flat))
            at, values = (pa.Array.from_buffers(pa.int32(), len(x), [None, pa.py_buffer(x)]) for x in (offsets, flat))
            lists = pa.ListArray.from_arrays(at, values)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], [*keep, "ids"])

    schema = picked.drop("__text").schema.add("ids", T.ArrayType(T.IntegerType()))
    return picked.mapInArrow(run, schema)


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """The kept columns and n_tokens (bigint): the length of `encode`'s ids without making the lists."""
    shared = _shared(df.sparkSession, path)
    picked = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            n = pa.array([len(encoder.encode(t)) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], [*keep, "n_tokens"])

    return picked.mapInArrow(run, picked.drop("__text").schema.add("n_tokens", T.LongType()))


def decode_ids(df: DataFrame, keep: list[str], ids: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """The kept columns and `text`: token ids back as text. Null ids give null, an empty list the empty text."""
    shared = _shared(df.sparkSession, path)
    picked = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{ids}`").alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = _encoder(shared.value).transducer
        for batch in batches:
            texts = [None if x is None else decode(transducer, x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*keep, "text"])

    return picked.mapInArrow(run, picked.drop("__ids").schema.add("text", T.StringType()))
