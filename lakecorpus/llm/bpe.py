"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of all new words of a batch lie in one flat array. In each round the pairs of neighbours
are looked up by binary search over the sorted keys of the merge table, every word merges all
occurrences of its own pair of lowest rank, and words without a pair leave the array. A very long word takes its rounds alone and
looks up only pairs that changed. Words seen before come from a
bounded table. Only the vocabulary file of a public tokenizer is read; no tokenizer library runs.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

#: Rows that are encoded together.
ROWS = 256
#: Distinct chunks that a worker keeps; the table starts anew at the next batch beyond it.
KEPT_CHUNKS = 100_000
#: Words of more bytes take their rounds alone.
LONG_WORD = 2_000
_BIG = np.iinfo(np.int32).max
#: White space as the normalizer's ``\s`` has it; str.split() also splits at U+001C to U+001F.
_SPACE = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordBPE:
    """A lower-casing byte-level BPE with word ends, from a tokenizer JSON file.

    Understands the file's special tokens (matched in the raw text), NFC, white space folding and lower case, a pattern whose
    matches are the words, and a merge table. Other kinds of file raise ValueError.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or spec.get("decoder"):
            raise ValueError(f"{path}: not a lower-casing BPE with word ends and without decoder")
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        tokens = np.full(self.size, "", dtype=object)
        for t, i in (vocab | self.special).items():
            tokens[i] = t
        self.tokens = tokens
        end = model["end_of_word_suffix"] or ""
        chars = byte_characters()
        self.first = np.array([vocab[c] for c in chars], dtype=np.int64)
        self.last = np.array([vocab[c + end] for c in chars], dtype=np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], dtype=np.int64) for k in (0, 1))
        keys = left * self.size + right
        self.ranks = np.argsort(keys, kind="stable")
        self.keys = keys[self.ranks]
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.made = made[self.ranks]
        self.by_rank = left, right, made
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool = np.zeros(0, dtype=np.int32)
        self.starts = np.zeros(0, dtype=np.int64)
        self.lengths = np.zeros(0, dtype=np.int64)

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of non-empty ``words`` in one flat array, and how many each has."""
        long = {k: self._merge_long(w) for k, w in enumerate(words) if len(w) > LONG_WORD}
        if not long:
            return self._merge_short(words)
        short = [w for w in words if len(w) <= LONG_WORD]
        ids, few = self._merge_short(short) if short else (np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64))
        counts = np.zeros(len(words), dtype=np.int64)
        is_short = np.array([k not in long for k in range(len(words))])
        counts[is_short] = few
        for k, x in long.items():
            counts[k] = len(x)
        out = np.zeros(counts.sum(), dtype=np.int32)
        out[np.repeat(is_short, counts)] = ids
        begins = np.cumsum(counts) - counts
        for k, x in long.items():
            out[begins[k] : begins[k] + len(x)] = x
        return out, counts

    def _merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one word. Places wait under the rank of the pair that begins there; a round takes the lowest rank, and only places next to a merge are looked up again."""
        left, right, made = self.by_rank
        flat = np.frombuffer(word, dtype=np.uint8)
        sym = self.first[flat]
        sym[-1] = self.last[flat[-1]]
        n = len(sym)
        after, before, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, dtype=bool)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def offer(at: np.ndarray) -> None:
            at = at[after[at] < n]
            key = sym[at] * self.size + sym[after[at]]
            found = np.searchsorted(self.keys, key)
            found[found == len(self.keys)] = 0
            hit = self.keys[found] == key
            at, rank = at[hit], self.ranks[found[hit]]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = [*np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]]), len(rank)] if len(rank) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                r = int(rank[a])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(at[a:b])

        offer(np.arange(n - 1))
        while heap:
            r = heapq.heappop(heap)
            i = np.unique(np.concatenate(waiting.pop(r)))
            i = i[alive[i] & (after[i] < n)]
            i = i[(sym[i] == left[r]) & (sym[after[i]] == right[r])]
            if left[r] == right[r] and len(i) > 1:  # of occurrences that overlap, every other one from the left
                new_run = np.r_[True, after[i[:-1]] != i[1:]]
                run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(i)), 0))
                i = i[(np.arange(len(i)) - run_start) % 2 == 0]
            if not len(i):
                continue
            gone = after[i]
            sym[i] = made[r]
            alive[gone] = False
            after[i] = after[gone]
            inside = after[i] < n
            before[after[i][inside]] = i[inside]
            offer(np.unique(np.r_[i, before[i][before[i] >= 0]]))
        return sym[alive].astype(np.int32)

    def _merge_short(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        sym = self.first[flat]
        ends = np.cumsum(sizes) - 1
        sym[ends] = self.last[flat[ends]]
        word = np.repeat(np.arange(len(words)), sizes)
        done_sym, done_word = [], []
        while len(sym):
            rank = np.full(len(sym), _BIG, dtype=np.int64)
            key = sym[:-1] * self.size + sym[1:]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            hit = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank[:-1][hit] = self.ranks[at[hit]]
            begins = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(rank, begins)
            counts = np.diff(np.r_[begins, len(sym)])
            lowest_here = np.repeat(lowest, counts)
            rest = lowest_here < _BIG
            done_sym.append(sym[~rest])
            done_word.append(word[~rest])
            merge = rest & (rank == lowest_here)
            i = np.flatnonzero(merge)
            if len(i):
                # of occurrences that overlap, every other one from the left
                new_run = np.r_[True, np.diff(i) > 1]
                run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(i)), 0))
                i = i[(np.arange(len(i)) - run_start) % 2 == 0]
                sym[i] = self.made[at[i]]
                rest[i + 1] = False
            sym, word = sym[rest], word[rest]
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.int32), np.bincount(word, minlength=len(words))

    def _learn(self, chunks: list[str]) -> None:
        """Encodes chunks (no white space in them) and adds them to the table."""
        words: list[bytes] = []
        owners: list[int] = []
        for k, chunk in enumerate(chunks):
            found = self.pattern.findall(unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower())
            words += [w.encode("utf-8", "surrogatepass") for w in found]
            owners += [k] * len(found)
        if words:
            ids, counts = self.merge_words(words)
            lengths = np.bincount(np.array(owners), weights=counts, minlength=len(chunks)).astype(np.int64)
        else:
            ids, lengths = np.zeros(0, dtype=np.int32), np.zeros(len(chunks), dtype=np.int64)
        self._add(chunks, ids, lengths)

    def _add(self, chunks: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n = len(self.known)
        self.known.update(zip(chunks, range(n, n + len(chunks)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.pool = np.concatenate([self.pool, ids])

    def _chunks(self, text: str) -> list[str]:
        if self.split_special and "<|" in text:
            out = []
            for part in self.split_special.split(text):
                out += [part] if part in self.special else self._plain_chunks(part)
            return out
        return self._plain_chunks(text)

    def _plain_chunks(self, text: str) -> list[str]:
        return [c for c in _SPACE.split(text) if c] if _SEPARATORS.search(text) else text.split()

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one flat array, and how many each text has."""
        if len(self.known) > KEPT_CHUNKS or not self.known:
            self._forget()
            for t, i in self.special.items():
                self._add([t], np.array([i], dtype=np.int32), np.array([1]))
        chunked = [self._chunks(t) if t else [] for t in texts]
        flat = [c for cs in chunked for c in cs]
        new = [c for c in dict.fromkeys(flat) if c not in self.known]
        if new:
            self._learn(new)
        known = self.known
        index = np.fromiter((known[c] for c in flat), dtype=np.int64, count=len(flat))
        lengths = self.lengths[index]
        before = np.cumsum(lengths) - lengths
        ids = self.pool[np.repeat(self.starts[index] - before, lengths) + np.arange(lengths.sum())]
        text_of = np.repeat(np.arange(len(texts)), np.fromiter(map(len, chunked), dtype=np.int64, count=len(texts)))
        return ids, np.bincount(text_of, weights=lengths, minlength=len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray) -> str:
        """The tokens of ``ids`` joined by spaces, special ones included: the file names no decoder."""
        return " ".join(self.tokens[ids].tolist())


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBPE:
    """The tokenizer of a file, made once in each worker."""
    return WordBPE(path)


def _encoded(bpe: WordBPE, batches: Iterator[pa.RecordBatch], decoded: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            ids, counts = bpe.encode(part.column("text").to_pylist())
            ends = np.cumsum(counts)
            columns = {n: c for n, c in zip(part.schema.names, part.columns, strict=True) if n != "text"}
            columns["ids"] = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], type=pa.int32()), pa.array(ids, type=pa.int32()))
            if decoded:
                columns["decoded"] = pa.array([bpe.decode(ids[e - n : e]) for e, n in zip(ends, counts, strict=True)], type=pa.string())
            yield pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """The columns ``keep`` and ids, the token ids of each whole text; with ``decoded`` also the text that these ids decode to.

    Special tokens of the file are recognised inside texts; none are added. Null and empty texts give an empty list. Rows
    with a null id or repeated rows are encoded like others; other columns are ignored. ``path`` must
    be there on every executor.
    """
    schema = docs.select(*keep).schema.add("ids", ArrayType(IntegerType()))
    if decoded:
        schema = schema.add("decoded", "string")
    return docs.select(*keep, "text").mapInArrow(lambda batches: _encoded(tokenizer(path), batches, decoded), schema)


def decode(encoded: DataFrame, path: str, id_column: str = "doc_id") -> DataFrame:
    """(id_column, ids, decoded): the text of each list of ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                lists = part.column("ids")
                text = [bpe.decode(x.values.to_numpy()) if x.is_valid else "" for x in lists]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text, type=pa.string())], names=[*part.schema.names, "decoded"])

    schema = encoded.select(id_column, "ids").schema.add("decoded", "string")
    return encoded.select(id_column, "ids").mapInArrow(run, schema)
