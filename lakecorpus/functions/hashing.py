"""Keys and signatures."""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from .batches import parts
from .metrics import bound
from .textnorm import squash

BITS, BANDS = 64, 4


def exact_key(text: Column) -> Column:
    """SHA-1 of the squashed text."""
    return F.sha1(squash(text).cast("binary"))


def stable_id(source: Column, path: Column, text: Column) -> Column:
    return F.sha1(F.concat_ws("\x00", source, path, text).cast("binary"))


def shingles(terms: Column, k: int = 4) -> Column:
    """Runs of k terms; all terms as one where there are fewer; none of none."""

    def runs(t):
        n = F.size(t)
        full = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(t, i, k), " "))
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(full)

    return bound(terms, runs)


def simhash_of_hashes(hashes: Column) -> Column:
    """Votes of 64-bit hashes: a bit is set if more hashes have it than not."""
    n = F.size(hashes)

    def bit(b: int) -> Column:
        on = F.aggregate(hashes, F.lit(0), lambda a, h: a + F.shiftrightunsigned(h, b).bitwiseAND(1).cast("int"))
        return F.when(2 * on > n, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    out = bit(0)
    for b in range(1, BITS):
        out = out.bitwiseOR(bit(b))
    return out


_MONGOLIAN = re.compile("[\u1800-\u18af\U00011660-\U0001167f]+")
_ALONE = re.compile("[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u3040-\u309f\u30a0-\u30ff]")
#: Runs of terms that vote together, so that no text takes more memory than these.
_VOTES = 1 << 15


def _joined_terms(text: str) -> str:
    """Terms as in ``dedup_terms``, joined by one space."""
    if text.isascii():
        return " ".join(text.split())
    words = _MONGOLIAN.findall(text)
    return " ".join(words or _ALONE.sub(r" \g<0> ", text).split())


def _signature(terms: str, k: int) -> tuple[int, int]:
    """How many terms there are, and the SimHash over runs of k of them: each run is a slice of the joined terms, none is put together."""
    data = terms.encode()
    if not data:
        return 0, 0
    spaces = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 32)
    starts, ends = np.r_[0, spaces + 1], np.r_[spaces, len(data)]
    n = max(len(ends) - k + 1, 1)
    on = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, _VOTES):
        to = min(n, at + _VOTES)
        runs = zip(starts[at:to].tolist(), ends[-n:][at:to].tolist(), strict=True)
        raw = b"".join([hashlib.blake2b(data[a:b], digest_size=8).digest() for a, b in runs])
        on += np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return len(ends), int(np.packbits(2 * on > n).view(">i8")[0])


def marks(text: Column, k: int = 4) -> Column:
    """What deduplication asks of a text, taken in one pass: a struct of exact_key, the number of its terms, and its SimHash. No part of a lambda.

    Key and number are null for a null text, its signature is 0.
    """

    @F.arrow_udf(StructType([StructField("exact_key", StringType()), StructField("n_terms", IntegerType()), StructField("sig", LongType())]))
    def run(texts: pa.Array) -> pa.Array:
        keys, sizes, sigs = [], [], []
        for a, b in parts(texts):
            for t in texts.slice(a, b - a).to_pylist():
                n, sig = _signature(_joined_terms(t or ""), k)
                # str.split parts at SPACE, so this is the squashed text
                keys.append(None if t is None else hashlib.sha1(" ".join(t.split()).encode()).hexdigest())
                sizes.append(None if t is None else n)
                sigs.append(sig)
        return pa.StructArray.from_arrays([pa.array(keys, pa.string()), pa.array(sizes, pa.int32()), pa.array(sigs, pa.int64())], names=["exact_key", "n_terms", "sig"])

    return run(text)


def simhash(text: Column, k: int = 4) -> Column:
    """64-bit SimHash over runs of k terms, each hashed with an 8-byte BLAKE2b; 0 of no terms."""
    return marks(text, k)["sig"]


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def bands(signature: Column) -> Column:
    """The signature's four 16-bit parts as (band, value)."""
    width = BITS // BANDS
    return F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(signature, i * width).bitwiseAND((1 << width) - 1).cast("int").alias("value")) for i in range(BANDS)])


def block_keys(signature: Column, apart: int) -> Column:
    """Keys (which, value) of which any two signatures within ``apart`` bits have one in common.

    The signature is cut into ``apart`` + 3 parts; a key is three of them with the others as zeros, some 32 bits at ``apart`` 3. So a key is met
    by chance far less often than a single part of 16 bits.
    """
    n = apart + 3
    edges = [round(k * BITS / n) for k in range(n + 1)]
    parts = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:], strict=False)]
    keys = []
    for k, three in enumerate(itertools.combinations(parts, 3)):
        mask = sum(three)
        keys.append(F.struct(F.lit(k).alias("band"), signature.bitwiseAND(F.lit(mask - (1 << BITS) * (mask >> (BITS - 1))).cast("long")).alias("value")))
    return F.array(*keys)


def uniform(*parts: Column) -> Column:
    """A draw from [0, 1) that follows from its parts alone: 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
