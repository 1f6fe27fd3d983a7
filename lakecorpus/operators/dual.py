"""Two tracks of tokens under one vocabulary: words of the traditional script by merges that respect morphemes, all else by a byte-level model.

A text is cut into spans by script (``tokens.spans``); each span goes to its track, whose local ids become ids of the unified
vocabulary through the surface that both share.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lakecorpus.functions.batches import list_places, lists_from, parts, places

from .tokens import SPECIALS, decode_stream, encode_with_fallback, plain_characters, span_pattern, spans
from .training_rows import byte_tokens

WORD_MARK, MORPHEME_MARK = "▁", "◈"
#: Tokens that decode to nothing (fixed values).
SILENT = frozenset(("<pad>", "<unk>", "<bos>", "<eos>", "<img>", MORPHEME_MARK))
#: Control characters of the traditional script: hard boundaries where the vocabulary has all of them (fixed values).
CONTROLS = ("᠊", "᠋", "᠌", "᠍", "᠎", "᠏", " ")
_BLANKS = " \t\n\r"

Token = tuple[int, str, str, int, int]  # id, surface, track, start, end


@dataclass
class Pieces:
    """A vocabulary of pieces and its merges, the lowest rank first: (left, right): rank.

    ``boundaries`` tells the places in a word that no merge may cross; without it there are none.
    """

    vocabulary: dict[str, int]
    merges: dict[tuple[str, str], int]
    boundaries: Callable[[str], Iterable[int]] | None = None
    texts: dict[int, str] = field(init=False)

    def __post_init__(self):
        self.texts = {i: t for t, i in self.vocabulary.items()}
        self.hard = frozenset(CONTROLS) if all(c in self.vocabulary for c in CONTROLS) else frozenset()
        self.unknown = self.vocabulary.get("<unk>", 0)

    def encode(self, text: str) -> list[tuple[int, str, int, int]]:
        """(local id, piece, start, end) of the words between blanks."""
        out, start = [], 0
        for k in range(len(text) + 1):
            if k == len(text) or text[k] in _BLANKS or text[k] in self.hard:
                if k > start:
                    out += self._word(text[start:k], start)
                if k < len(text) and text[k] in self.hard:
                    out.append((self.vocabulary[text[k]], text[k], k, k + 1))
                start = k + 1
        return out

    def _word(self, word: str, base: int) -> list[tuple[int, str, int, int]]:
        # without hard boundaries, controls stand between letters and belong to the piece behind them, the last to the last piece
        letters = [(c, k) for k, c in enumerate(word) if self.hard or c not in CONTROLS]
        if not letters:
            return []
        n = len(letters)
        piece = [c for c, _ in letters]
        starts = [0, *[k + 1 for _, k in letters[:-1]], len(word)]
        wall = {b for b in self.boundaries(word) if 0 < b < n} if self.boundaries else set()
        end = list(range(1, n + 1))  # of the piece that begins here, as an index of letters
        before = list(range(-1, n - 1))
        alive = [True] * n
        queue: list[tuple[int, int, str, str]] = []

        def offer(a: int) -> None:
            b = end[a]
            if b < n and b not in wall and (rank := self.merges.get((piece[a], piece[b]))) is not None:
                heapq.heappush(queue, (rank, a, piece[a], piece[b]))

        for a in range(n):
            offer(a)
        while queue:
            _, a, left, right = heapq.heappop(queue)
            if not alive[a] or piece[a] != left or (b := end[a]) >= n or piece[b] != right:
                continue  # one of the two has merged since
            piece[a], end[a], alive[b] = left + right, end[b], False
            if end[a] < n:
                before[end[a]] = a
                offer(a)
            if before[a] >= 0:
                offer(before[a])
        return [(self.vocabulary.get(piece[a], self.unknown), piece[a], base + starts[a], base + starts[end[a]]) for a in range(n) if alive[a]]

    def decode(self, ids: Iterable[int]) -> str:
        """Pieces joined; an unknown one is a replacement character, an id that isn't there nothing."""
        return "".join("�" if (t := self.texts.get(i, "")) == "<unk>" else t for i in ids)


def with_controls(vocabulary: dict[str, int]) -> dict[str, int]:
    """The vocabulary with the control characters it lacks behind its last id, in their order."""
    if not vocabulary:
        raise ValueError("the vocabulary is empty")
    missing = [c for c in CONTROLS if c not in vocabulary]
    return vocabulary | {c: k for k, c in enumerate(missing, max(vocabulary.values()) + 1)}


class General:
    """A byte-level model from a file of the tokenizers library; never trained here."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core
        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.vocabulary = self.model.get_vocab()
        kind = json.loads(self.model.to_str())
        before = kind["pre_tokenizer"] or {}
        # tokens stand for the bytes of the text itself, so their places follow from their lengths
        self.plain = not kind["normalizer"] and not kind["post_processor"] and before.get("type") == "ByteLevel" and not before["add_prefix_space"]
        self.lengths = np.zeros(max(self.vocabulary.values(), default=-1) + 1, dtype=np.int64)
        for t, i in self.vocabulary.items():
            self.lengths[i] = len(t)

    def encode(self, text: str) -> list[tuple[int, str, int, int]]:
        e = self.model.encode(text, add_special_tokens=False)
        return [(i, t, a, b) for i, t, (a, b) in zip(e.ids, e.tokens, e.offsets, strict=True)]

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids, skip_special_tokens=False)

    def encode_many(self, texts: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """How many tokens each text has, the local ids of all, and their places [from, to) in their texts as two rows."""
        found = self.model.encode_batch(texts, add_special_tokens=False)
        each = [e.ids for e in found]
        sizes = np.array(list(map(len, each)), dtype=np.int64)
        ids = np.fromiter(itertools.chain.from_iterable(each), dtype=np.int64, count=int(sizes.sum()))
        data = np.frombuffer("".join(texts).encode("utf-8", "surrogatepass"), dtype=np.uint8)
        ends = np.cumsum(self.lengths[ids])
        if self.plain and len(data) == (ends[-1] if len(ends) else 0) and sizes.all():
            first = np.cumsum((data & 0xC0) != 0x80) - 1  # the character of each byte
            base = np.repeat(np.r_[0, np.cumsum(list(map(len, texts)), dtype=np.int64)][:-1], sizes)
            return sizes.tolist(), ids, np.stack([first[ends - self.lengths[ids]], first[ends - 1] + 1]) - base
        return sizes.tolist(), ids, np.array([x for e in found for x in e.offsets], dtype=np.int64).reshape(-1, 2).T

    def decode_many(self, ids: list[list[int]]) -> list[str]:
        return self.model.decode_batch(ids, skip_special_tokens=False)


TRACKS = ("special", "space", "mn", "general", "general_punct")
#: Spans, or runs of ids, that a worker keeps, and their characters and tokens in all (fixed values); beyond that it begins anew.
KEPT, KEPT_SIZE = 1 << 18, 1 << 22
_BOS, _EOS = ("special", "<bos>", -1), ("special", "<eos>", -1)
_NARROW = "\u202f"


@functools.cache
def _alphanumeric() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000)


@dataclass
class Tokens:
    """The tokens of several texts, one text behind the other; text k has those from at[k] to at[k + 1]. Tracks are places in TRACKS, surfaces in names."""

    at: np.ndarray
    ids: np.ndarray
    surfaces: np.ndarray
    tracks: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    names: pa.Array


class _Spans:
    """A number for each distinct span, and the tokens of each with places counted from its beginning, one span behind the other."""

    def __init__(self, tokenizer: DualTokenizer):
        self.of, self.numbers, self.names = tokenizer, {}, {}
        self.lengths, self.begins = np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64)
        self.fields = np.zeros((5, 0), dtype=np.int32)

    def full(self) -> bool:
        return len(self.numbers) > KEPT or self.fields.shape[1] + int(self.lengths.sum()) > KEPT_SIZE

    def learn(self, keys: list) -> None:
        """Keys are spans, or (track, span) where the track doesn't follow from the span."""
        of, plain = self.of, self.of.plain
        likely = [k for k in keys if isinstance(k, str) and plain.match(k)]
        sizes, local, at = of.general.encode_many(likely)
        if 0 not in sizes:  # what the model has no token for is left to the fallback
            self._add(likely, list(map(len, likely)), sizes, self._general(likely, sizes, local, at))
        others = [k for k in keys if k not in self.numbers]
        rows, sizes, lengths = [], [], []
        for k in others:
            if k in (_BOS, _EOS):
                length, made = 0, [(of.vocabulary[k[1]], k[1], "special", -1, -1)]
            else:
                track, part = (of.track(k), k) if isinstance(k, str) else k
                length, made = len(part), of.of_span(track, part)
            rows += [(i, self._name(t), TRACKS.index(track), a, b) for i, t, track, a, b in made]
            sizes.append(len(made))
            lengths.append(length)
        self._add(others, lengths, sizes, np.array(rows, dtype=np.int32).reshape(-1, 5).T)

    def _name(self, surface: str) -> int:
        return self.names.setdefault(surface, len(self.of.general_names) + len(self.names))

    def _general(self, parts: list[str], sizes: list[int], local: np.ndarray, at: np.ndarray) -> np.ndarray:
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lettered = np.r_[0, np.cumsum(_alphanumeric()[codes])]
        base = np.repeat(np.r_[0, np.cumsum(list(map(len, parts)), dtype=np.int64)][:-1], sizes)
        track = np.where(lettered[base + at[1]] > lettered[base + at[0]], TRACKS.index("general"), TRACKS.index("general_punct"))
        return np.stack([self.of.of_local[local], local, track, *at]).astype(np.int32)

    def _add(self, keys: list, lengths: list[int], sizes: list[int], fields: np.ndarray) -> None:
        self.numbers.update(zip(keys, range(len(self.numbers), len(self.numbers) + len(keys)), strict=True))
        self.lengths = np.r_[self.lengths, np.array(lengths, dtype=np.int64)]
        self.begins = np.r_[self.begins, self.begins[-1] + np.cumsum(sizes, dtype=np.int64)]
        self.fields = np.concatenate([self.fields, fields], axis=1)


class DualTokenizer:
    """Encodes texts to ids of the unified vocabulary and back.

    ``segment``: the ids [from, to) that are the general model's own. Ids outside of it decode by their surface, wherever a track has them.
    """

    def __init__(self, vocabulary: dict[str, int], pieces: Pieces, general: General, segment: tuple[int, int]):
        self.vocabulary, self.pieces, self.general = vocabulary, pieces, general
        self.unknown = vocabulary["<unk>"]
        self.surface = {i: t for t, i in vocabulary.items()}
        lands = lambda local: {i: vocabulary[t] for t, i in local.items() if t in vocabulary}
        self.of_pieces, self.of_general = lands(pieces.vocabulary), lands(general.vocabulary)
        self.to_general = {g: i for i, g in self.of_general.items() if segment[0] <= g < segment[1]}
        self.byte_value = {vocabulary[t]: b for b, t in enumerate(byte_tokens()) if t in vocabulary}
        self.pattern = span_pattern()
        # the same spans as strings: what begins with a plain character can only be general
        plain, groups = plain_characters(SPECIALS), re.sub(r"\?P<\w+>", "?:", self.pattern.pattern)
        general = groups[groups.index(f"(?:(?:{plain}") :]
        self.plain, self.finder = re.compile(plain), re.compile(f"{plain}+{general}?|{groups}", re.S)
        names = {i: t for t, i in self.general.vocabulary.items()}
        self.general_names = [names.get(i, "") for i in range(max(names, default=-1) + 1)]
        self.of_local = np.array([self.of_general.get(i, self.unknown) for i in range(len(self.general_names))], dtype=np.int64)
        most = max([0, *self.to_general, *self.byte_value])
        self.kinds, self.locals = np.zeros(most + 2, dtype=np.int8), np.zeros(most + 2, dtype=np.int64)  # the last one stands for all ids beyond
        self.kinds[list(self.byte_value)] = 1
        self.kinds[list(self.to_general)] = 2
        self.locals[list(self.to_general)] = list(self.to_general.values())
        self._spans, self._runs, self._runs_size, self._last = _Spans(self), {}, 0, ((), "")

    def tokens(self, text: str, bos: bool = False, eos: bool = False) -> list[Token]:
        out: list[Token] = [(self.vocabulary["<bos>"], "<bos>", "special", -1, -1)] if bos else []
        for track, part, start, _ in spans(text, self.pattern):
            out += [(i, t, kind, start + a, start + b) for i, t, kind, a, b in self.of_span(track, part)]
        return out + ([(self.vocabulary["<eos>"], "<eos>", "special", -1, -1)] if eos else [])

    def of_span(self, track: str, part: str) -> list[Token]:
        """The tokens of a span, which depend on it alone, with places counted from its beginning."""
        if track == "special":
            return [(self.vocabulary.get(part, self.unknown), part, track, 0, len(part))]
        if track == "space":
            mark = self.vocabulary.get(WORD_MARK, self.unknown)
            return [(mark, WORD_MARK, track, k, k + 1) for k in range(len(part))]
        if track == "mn":
            return [(self.of_pieces.get(i, self.unknown), t, track, a, b) for i, t, a, b in self.pieces.encode(part)]
        found = self.general.encode(part)
        if not found:
            return [(i, self.surface.get(i, ""), "general", 0, len(part)) for i in encode_with_fallback(part, self.vocabulary, self.unknown)]
        lettered = lambda a, b: any(c.isalnum() for c in part[a:b])
        return [(self.of_general.get(i, self.unknown), t, "general" if lettered(a, b) else "general_punct", a, b) for i, t, a, b in found]

    def track(self, part: str) -> str:
        """That of a span of a text without narrow spaces, or of one that isn't a narrow space alone."""
        return self.pattern.match(part).lastgroup

    def _keys(self, text: str) -> list:
        if _NARROW not in text:
            return self.finder.findall(text)
        return [(track, part) for track, part, _, _ in spans(text, self.pattern)]

    def encode_texts(self, texts: list[str], bos: bool = False, eos: bool = False) -> Tokens:
        """``tokens`` of each text. A span that was there before isn't encoded again."""
        if self._spans.full():
            self._spans = _Spans(self)
        known, keys, ends = self._spans, [], [0]
        for text in texts:
            keys += [*[_BOS] * bos, *self._keys(text), *[_EOS] * eos]
            ends.append(len(keys))
        if new := [k for k in dict.fromkeys(keys) if k not in known.numbers]:
            known.learn(new)
        span, at = np.array(list(map(known.numbers.__getitem__, keys)), dtype=np.int64), np.array(ends, dtype=np.int64)
        behind = np.r_[0, np.cumsum(known.lengths[span])]
        offset = behind[:-1] - np.repeat(behind[at[:-1]], np.diff(at))
        sizes = known.begins[span + 1] - known.begins[span]
        ids, surfaces, tracks, starts, stops = known.fields[:, places(known.begins[span], sizes)]
        offset = np.where(starts < 0, 0, np.repeat(offset, sizes)).astype(np.int32)
        names = pa.array([*self.general_names, *known.names], type=pa.string())
        return Tokens(np.r_[0, np.cumsum(sizes)][at], ids, surfaces, tracks, starts + offset, stops + offset, names)

    def _decoded(self, ids: tuple[int, ...]) -> str:
        if ids != self._last[0]:
            self._last = (ids, self.decode(ids))
        return self._last[1]

    def decode_lists(self, at: np.ndarray, ids: np.ndarray) -> list[str]:
        """``decode`` of the ids of each row. A run of one kind that was there before isn't decoded again."""
        if not len(ids):
            return [""] * (len(at) - 1)
        if len(self._runs) > KEPT or self._runs_size > KEPT_SIZE:
            self._runs, self._runs_size = {}, 0
        place = np.where((ids < 0) | (ids >= len(self.kinds)), len(self.kinds) - 1, ids)
        kind = self.kinds[place]
        fresh = np.r_[True, (kind[1:] != kind[:-1]) & ((kind[1:] == 2) | (kind[:-1] != 2))]  # a run of the general model and what follows it stand together
        fresh[at[:-1][at[:-1] < len(ids)]] = True
        begins = np.flatnonzero(fresh)
        edges = np.r_[begins, len(ids)].tolist()
        others = np.r_[np.flatnonzero(kind != 2), len(ids)]
        middle = np.minimum(others[np.searchsorted(others, begins)], edges[1:]).tolist()  # where the general model's ids end
        data = ids.astype(np.int32).tobytes()
        keys = [data[4 * a : 4 * b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        new = {k: n for n, k in enumerate(keys) if k not in self._runs}
        local, unified = self.locals[place].tolist(), ids.tolist()
        told = iter(self.general.decode_many([local[edges[n] : middle[n]] for n in new.values() if middle[n] > edges[n]]))
        found = {k: (next(told) if middle[n] > edges[n] else "") + self._decoded(tuple(unified[middle[n] : edges[n + 1]])) for k, n in new.items()}
        self._runs |= found
        self._runs_size += sum(len(k) // 4 + len(x) for k, x in found.items())
        texts = list(map(self._runs.__getitem__, keys))
        rows = np.searchsorted(begins, at).tolist()
        return ["".join(texts[a:b]) for a, b in zip(rows[:-1], rows[1:], strict=True)]

    def encode(self, text: str, bos: bool = False, eos: bool = False) -> list[int]:
        return [t[0] for t in self.tokens(text, bos, eos)]

    def decode(self, ids: Iterable[int]) -> str:
        """Runs of one kind are decoded together: bytes, ids of the general model, and surfaces."""
        out: list[str] = []
        kind, held = None, []

        def flush() -> None:
            if kind == "bytes":
                out.append(bytes(held).decode("utf-8", "replace"))
            elif kind == "general":
                out.append(self.general.decode(held))
            held.clear()

        for i in ids:
            if i in self.to_general:
                now, value = "general", self.to_general[i]
            elif i in self.byte_value:
                now, value = "bytes", self.byte_value[i]
            else:
                now, value = "text", self.surface.get(i, "")
            if now != kind:
                flush()
                kind = now
            if now != "text":
                held.append(value)
            elif value not in SILENT:
                out.append(" " if value == WORD_MARK else value)
        flush()
        return "".join(out)

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        return decode_stream(ids, self.decode)

    def lossless(self, text: str) -> list[int]:
        """Ids of single characters that decode to themselves, and bytes of all others; what doesn't come back raises."""
        if len(self.byte_value) < 256:
            raise ValueError(f"the vocabulary lacks {256 - len(self.byte_value)} of 256 byte tokens")
        safe = {t: i for t, i in self.vocabulary.items() if len(t) == 1 and i not in self.to_general and t not in (WORD_MARK, MORPHEME_MARK)}
        ids = encode_with_fallback(text, safe | {t: self.vocabulary[t] for t in byte_tokens()}, self.unknown)
        if self.unknown in ids or self.decode(ids) != text:
            raise ValueError(f"the text doesn't come back: {text[:80]!r}")
        return ids

    def save(self, path: str) -> None:
        """One JSON file with all but the general model, which stays where it is."""
        merges = [[a, b, r] for (a, b), r in self.pieces.merges.items()]
        with open(path, "w", encoding="utf-8") as f:
            json.dump({"vocabulary": self.vocabulary, "pieces": self.pieces.vocabulary, "merges": merges}, f, ensure_ascii=False)


def load(path: str, general: General, segment: tuple[int, int], boundaries: Callable[[str], Iterable[int]] | None = None) -> DualTokenizer:
    """A saved tokenizer; one whose vocabulary gives an id twice or lacks what encoding needs raises."""
    with open(path, encoding="utf-8") as f:
        saved = json.load(f)
    v = {str(t): int(i) for t, i in saved["vocabulary"].items()}
    if len(set(v.values())) != len(v):
        raise ValueError("the vocabulary gives an id twice")
    if missing := [t for t in ("<unk>", "<bos>", "<eos>", WORD_MARK) if t not in v]:
        raise ValueError(f"the vocabulary lacks {missing}")
    pieces = Pieces({str(t): int(i) for t, i in saved["pieces"].items()}, {(a, b): int(r) for a, b, r in saved["merges"]}, boundaries)
    return DualTokenizer(v, pieces, general, segment)


def unified(pieces: dict[str, int], general: dict[str, int], pieces_at: tuple[int, int], general_at: tuple[int, int], specials: tuple[str, ...] = (*SPECIALS, WORD_MARK, MORPHEME_MARK)) -> dict[str, int]:
    """Special tokens and bytes first, then each track in its segment [from, to); a surface that is there already keeps its id."""
    out = {t: k for k, t in enumerate((*specials, *byte_tokens()))}
    for local, (at, end) in ((pieces, pieces_at), (general, general_at)):
        if len(out) and at < len(specials) + 256:
            raise ValueError("a segment begins among the special tokens")
        for t in sorted((t for t in local if t not in out), key=lambda t: (local[t], t)):
            if at >= end:
                raise ValueError("a vocabulary overflows its segment")
            out[t] = at
            at += 1
    return out


TOKEN = StructType([StructField("id", IntegerType()), StructField("token", StringType()), StructField("track", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])


def encode_column(text: Column, make: Callable[[], DualTokenizer], bos: bool = False, eos: bool = False) -> Column:
    """The tokens of each text as an array of structs; ``make`` builds the tokenizer once in each batch's worker. Null is empty.

    Texts are encoded part by part, and a part's tokens go straight to Arrow, so a worker holds no more than those of a part.
    """
    @F.arrow_udf(ArrayType(TOKEN))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = made(make)
        for batch in batches:
            for a, b in parts(batch) if len(batch) else ((0, 0),):
                t = tokenizer.encode_texts([x or "" for x in batch.slice(a, b - a).to_pylist()], bos, eos)
                named = [names.take(pa.array(x)) for names, x in ((t.names, t.surfaces), (pa.array(TRACKS), t.tracks))]
                yield lists_from(np.diff(t.at), pa.StructArray.from_arrays([pa.array(t.ids), *named, pa.array(t.starts), pa.array(t.ends)], names=TOKEN.names))

    return run(text)


def decode_column(ids: Column, make: Callable[[], DualTokenizer]) -> Column:
    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = made(make)
        for batch in batches:
            for a, b in parts(batch) if len(batch) else ((0, 0),):
                lists = batch.slice(a, b - a)
                at, flat = list_places(lists)
                texts = tokenizer.decode_lists(at, flat.fill_null(-1).to_numpy(zero_copy_only=False))
                yield pa.array(texts, type=pa.string(), mask=lists.is_null().to_numpy(zero_copy_only=False))

    return run(ids)


_kept: dict = {}


def made(make: Callable[[], DualTokenizer]) -> DualTokenizer:
    """The tokenizer that ``make`` builds, once in each worker."""
    f = getattr(make, "func", make)  # of a partial
    key = (f.__module__, f.__qualname__, repr(getattr(make, "args", "")), repr(getattr(make, "keywords", "")))
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]
