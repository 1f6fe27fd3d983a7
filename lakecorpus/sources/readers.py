"""Readers of text sources: JSON lines and arrays, plain text of any encoding, Parquet, HTML, Markdown, ZIP.

All give a ``text`` column and ``path`` of the file; ``pos`` orders rows within a file where the format has an order that Spark keeps.
Sources that only need what a format has are plain DataFrame readers; bytes are decoded and archives opened on the executors.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from lakecorpus.functions import textnorm as N
from lakecorpus.functions.markup import html_parts
from lakecorpus.operators.dedup import checkpointed

from . import store

_BOMS = ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"), (b"\xef\xbb\xbf", "utf-8-sig"))


def _valid_utf8(data: bytes) -> bool:
    """Whether a sample is UTF-8, but for a character that its end may have cut."""
    try:
        data.decode("utf-8")
        return True
    except UnicodeDecodeError as e:
        return e.end == len(data) and len(data) - e.start <= 3 and e.start > 0


def detect_encoding(sample: bytes, nul_share: float = 0.10, utf8_first: bool = False) -> str:
    """Byte order mark, else UTF-16 by the density and parity of NULs, else UTF-8 if valid, else GB18030.

    With ``utf8_first`` valid UTF-8 comes before the test for NULs, which then asks for twice as many on one side.
    """
    for bom, name in _BOMS:
        if sample.startswith(bom):
            return name
    if not sample:
        return "utf-8"
    even, odd = sample[0::2].count(0), sample[1::2].count(0)
    if utf8_first:
        if _valid_utf8(sample) and not (even or odd):
            return "utf-8"
        if (even + odd) / len(sample) > 0.25 and max(even, odd) >= 2 * min(even, odd):
            return "utf-16-le" if odd >= even else "utf-16-be"
        return "utf-8" if _valid_utf8(sample) else "gb18030"
    if (even + odd) / len(sample) > nul_share:
        return "utf-16-le" if odd >= even else "utf-16-be"
    return "utf-8" if _valid_utf8(sample) else "gb18030"


def decode_bytes(data: bytes | None, fallback: str = "utf-8") -> str:
    """Text of a web page: byte order mark, then the charset it declares, then usual encodings; at last with replacement."""
    data = data or b""
    for bom, name in _BOMS:
        if data.startswith(bom):
            return data.decode(name, "replace").lstrip("\ufeff")
    declared = re.search(rb"charset=[\"']?([A-Za-z0-9_\-]+)", data[:4096], re.I)
    names = ([declared[1].decode("ascii")] if declared else []) + [fallback, "utf-8", "gb18030", "gbk", "cp932", "shift_jis"]
    for name in dict.fromkeys(names):
        try:
            return data.decode(name)
        except (UnicodeDecodeError, LookupError):
            continue
    return data.decode(fallback, "replace")


def _from_files(files: DataFrame, rows: Callable[[str, bytes], Iterator[str]]) -> DataFrame:
    """(path, pos, text): what ``rows`` gives of each file, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                out: list[str] = []
                at = 0
                for text in rows(path, data.as_py()):
                    out.append(text)
                    if len(out) == 1000:
                        yield _batch(path, at, out)
                        at, out = at + len(out), []
                yield _batch(path, at, out)

    return files.select("path", "content").mapInArrow(run, "path string, pos long, text string")


def _batch(path: str, at: int, texts: list[str]) -> pa.RecordBatch:
    n = len(texts)
    return pa.RecordBatch.from_arrays([pa.array([path] * n, type=pa.string()), pa.array(range(at, at + n), type=pa.int64()), pa.array(texts, type=pa.string())], names=["path", "pos", "text"])


def files(spark: SparkSession, path: str | list[str], glob: str | None = None, recursive: bool = True) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt out to all cores where their files have fewer splits than there are cores; as they are in all larger tables. For row functions that are dear beside a shuffle."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def read_jsonl(spark: SparkSession, path: str | list[str], keys: tuple[str, ...] = ("text",), mark_bad: bool = False) -> DataFrame:
    """(path, text): the first non-empty of ``keys`` in each line; a line that is a bare JSON string is the text.

    Blank lines go, and so do lines that aren't JSON, but with ``mark_bad`` those are kept with bad = true.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value")).where(N.strip(F.col("value")) != "")
    json_ = F.try_parse_json("value")
    bare = F.try_variant_get(json_, "$", "string")
    fields = [F.try_variant_get(json_, f"$.{k}", "string") for k in keys]
    is_string = N.strip(F.col("value")).startswith('"')
    text = F.when(is_string, bare).otherwise(F.coalesce(*[F.nullif(f, F.lit("")) for f in fields], F.lit("")))
    rows = lines.select("path", text.alias("text"), json_.isNull().alias("bad"))
    return rows if mark_bad else rows.where(~F.col("bad")).drop("bad")


def read_jsonl_fields(spark: SparkSession, path: str | list[str], fields: tuple[str, ...], joined: bool = False) -> DataFrame:
    """(path, text): each non-empty field as a text, or all of a row joined by line feeds."""
    schema = StructType([StructField(f, StringType()) for f in fields])
    rows = spark.read.schema(schema).json(path).withColumn("path", F.col("_metadata.file_path"))
    full = F.filter(F.array(*[N.strip(F.col(f"`{f}`")) for f in fields]), lambda x: x.isNotNull() & (x != ""))
    if joined:
        return rows.select("path", F.array_join(full, "\n").alias("text")).where(F.col("text") != "")
    return rows.select("path", F.explode(full).alias("text"))


def _marked(rows: DataFrame, mark_bad: bool) -> DataFrame:
    """A file that couldn't be read has one row whose text is null: kept as bad, or left out."""
    return rows.withColumn("bad", F.col("text").isNull()) if mark_bad else rows.where(F.col("text").isNotNull())


def read_json_array(spark: SparkSession, path: str | list[str], fields: tuple[str, ...], joined: bool = False, mark_bad: bool = False) -> DataFrame:
    """(path, pos, text): each non-empty field of the objects of an array, or of one under ``data`` or ``records``; or, joined, all of an object line by line.

    A broken file has no rows; with ``mark_bad`` it has one without text that is bad.
    """

    def rows(_: str, data: bytes) -> Iterator[str | None]:
        try:
            value = json.loads(decode_bytes(data))
        except (ValueError, RecursionError):
            yield None
            return
        if isinstance(value, dict):
            value = value.get("data") or value.get("records") or [value]
        for item in value if isinstance(value, list) else []:
            full = [t for f in fields if isinstance(item, dict) and (t := str(item.get(f) or "").strip())]
            yield from (["\n".join(full)] if joined and full else full)

    return _marked(_from_files(files(spark, path), rows), mark_bad)


def read_json_documents(spark: SparkSession, path: str | list[str], mark_bad: bool = False) -> DataFrame:
    """(path, pos, text): documents anywhere inside JSON files: title and author over paragraphs, or instruction triples.

    A file that is broken, or nested beyond what can be read, has no rows; with ``mark_bad`` it has one without text that is bad.
    """
    bodies, titles = ("paragraphs", "paragraph", "content", "text"), ("title", "chapter", "section", "rhythmic")

    def first(item: dict, names: tuple[str, ...]):
        return next((item[n] for n in names if item.get(n)), None)

    def walk(value, title: str) -> Iterator[str]:
        if isinstance(value, list):
            for x in value:
                yield from walk(x, title)
        elif isinstance(value, dict):
            mine = str(first(value, titles) or title)
            body = first(value, bodies)
            if isinstance(body, list):
                body = "\n".join(str(x) for x in body if isinstance(x, (str, int, float)))
            if isinstance(body, str) and body:
                yield "\n".join(x for x in (mine, str(first(value, ("author", "poet")) or ""), body) if x)
            elif value.keys() & {"instruction", "input", "output"}:
                yield "\n".join([str(value.get("instruction") or ""), *(str(value[k]) for k in ("input", "output") if value.get(k))])
            else:
                for x in value.values():
                    yield from walk(x, mine)

    def rows(name: str, data: bytes) -> Iterator[str | None]:
        try:  # all of a file or nothing
            found = list(walk(json.loads(decode_bytes(data)), name.rpartition("/")[2].rpartition(".")[0]))
        except (ValueError, RecursionError):
            found = [None]
        yield from found

    return _marked(_from_files(files(spark, path), rows), mark_bad)


def read_lines(spark: SparkSession, path: str | list[str], nul_share: float = 0.10, utf8_first: bool = False) -> DataFrame:
    """(path, pos, text): non-empty lines of text files in any encoding that detect_encoding knows."""

    def rows(_: str, data: bytes) -> Iterator[str]:
        name = detect_encoding(data[: 1 << 16], nul_share, utf8_first)
        for line in io.StringIO(data.decode(name, "replace")):
            line = line.replace("\ufeff", "").strip()
            if line:
                yield line

    return _from_files(files(spark, path), rows)


def read_paragraphs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, text): paragraphs of UTF-8 text files, parted by blank lines."""
    whole = spark.read.text(path, lineSep="\n\n").select(F.col("_metadata.file_path").alias("path"), N.strip(F.col("value")).alias("text"))
    return whole.where(F.col("text") != "")


def read_documents(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """(path, pos, text): each file as one document."""
    return _from_files(files(spark, path, glob), lambda _, data: iter([data.decode(detect_encoding(data[: 1 << 16]), "replace").replace("\ufeff", "")]))


def read_parquet_text(spark: SparkSession, path: str | list[str], keys: tuple[str, ...] = ("text",)) -> DataFrame:
    """(path, text): the first non-empty of the key columns that the files have; none of them is an error. Only those columns are read."""
    table = spark.read.parquet(path if isinstance(path, str) else path[0]) if isinstance(path, str) or len(path) == 1 else spark.read.parquet(*path)
    there = [k for k in keys if k in table.columns]
    if not there:
        raise ValueError(f"none of the columns {keys} in {table.columns}")
    text = F.coalesce(*[F.nullif(F.col(f"`{k}`").cast("string"), F.lit("")) for k in there], F.lit(""))
    return table.select(F.col("_metadata.file_path").alias("path"), text.alias("text"))


def read_html(spark: SparkSession, path: str | list[str], selectors: tuple[str, ...] = ()) -> DataFrame:
    """(path, pos, text): each page as title and text."""
    return _from_files(files(spark, path), lambda _, data: iter(["\n".join(x for x in reversed(html_parts(decode_bytes(data), selectors)) if x)]))


#: Stores that tasks can open files in; of others (seen by Spark alone) files come whole, of up to 2 GB.
_OPENED = ("file", "hdfs", "s3", "s3a", "gs", "abfs", "abfss")


def _open(path: str):
    """A file that can be sought in, in the store of its path."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    store_, at = (fs.LocalFileSystem(), rest if rest.startswith("/") else path) if scheme == "file" or not rest else fs.FileSystem.from_uri(path.replace("s3a:", "s3:"))
    return store_.open_input_file("/" + at.lstrip("/") if scheme == "file" else at)


def _archives(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """(path, content) of files; content is null where tasks can open them by themselves."""
    found = files(spark, path, glob)
    scheme = F.when(F.col("path").rlike("^[a-zA-Z0-9]+:"), F.substring_index("path", ":", 1)).otherwise("file")
    return found.select("path", F.when(~scheme.isin(*_OPENED), F.col("content")).alias("content")) if _foreign(spark, path) else found.select("path", F.lit(None).cast("binary").alias("content"))


def _foreign(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether Spark alone can open the paths; a path without a scheme is in the session's own store."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(spark.sparkContext._jsc.hadoopConfiguration()).getScheme()
    return any((p.partition(":")[0] if ":" in p.split("/")[0] else own) not in _OPENED for p in ([path] if isinstance(path, str) else path))


def _archive(path: str, content: bytes | None) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BytesIO(content) if content is not None else _open(path))


def zip_members(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """(path, member, bytes, bad) of the files in archives, from their directories alone. An archive that can't be read is one row without a member that is bad."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    with _archive(path, content) as z:
                        out += [(path, i.filename, i.file_size, False) for i in z.infolist() if not i.is_dir()]
                except (zipfile.BadZipFile, OSError, ValueError):  # a seek before the first byte is a ValueError
                    out.append((path, None, None, True))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.bool_()), strict=True)], names=["path", "member", "bytes", "bad"])

    return _archives(spark, path, glob).mapInArrow(run, "path string, member string, bytes long, bad boolean")


def read_zip(spark: SparkSession, path: str | list[str], suffixes: tuple[str, ...] = (".jsonl", ".json", ".txt"), key: str = "text", member: str | None = None) -> DataFrame:
    """(path, pos, text): lines of JSON members, whole text members and texts of HTML or XML members of archives, by name; or of one member.

    Members are dealt out, so a task reads one of them, wherever it is in its archive; lines of JSON members are read as a stream, whatever their size. Archives that can't be read have no rows
    (``zip_members`` marks them). pos holds the place of the member in its archive and that of the text in the member.
    """
    wanted = F.lower("member").rlike("(" + "|".join(re.escape(s) for s in suffixes) + ")$") if member is None else F.col("member") == member
    place = F.row_number().over(Window.partitionBy("path").orderBy("member")) - 1
    listed = zip_members(spark, path).where(~F.col("bad") & wanted).withColumn("place", place)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = listed.select("path", "member", "place").repartition(n, "path", "member")
    if _foreign(spark, path):
        dealt = dealt.join(_archives(spark, path), "path")
    else:
        dealt = dealt.withColumn("content", F.lit(None).cast("binary"))

    def texts(z: zipfile.ZipFile, name: str) -> Iterator[str]:
        with z.open(name) as opened:
            if name.lower().endswith((".jsonl", ".json")):
                for line in io.TextIOWrapper(opened, "utf-8", errors="replace"):
                    try:
                        value = json.loads(line)
                    except ValueError:
                        continue
                    text = value if isinstance(value, str) else value.get(key) if isinstance(value, dict) else None
                    if text:
                        yield text
            elif name.lower().endswith((".html", ".htm", ".xml")):
                yield html_parts(decode_bytes(opened.read()))[0]
            else:
                yield decode_bytes(opened.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, name, place, content in zip(*[batch.column(c).to_pylist() for c in ("path", "member", "place", "content")], strict=True):
                out: list[str] = []
                at, size = place << 40, 0
                with _archive(path, content) as z:
                    for text in texts(z, name):
                        out.append(text)
                        size += len(text)
                        if len(out) == 1000 or size > 1 << 22:
                            yield _batch(path, at, out)
                            at, out, size = at + len(out), [], 0
                yield _batch(path, at, out)

    return dealt.select("path", "member", "place", "content").mapInArrow(run, "path string, pos long, text string")


def with_position(rows: DataFrame) -> DataFrame:
    """Adds input_pos, the place in the order of (path, pos): a global sort, then places counted from each partition's first."""
    placed = checkpointed(rows.orderBy("path", "pos").withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    sizes = placed.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = sizes.select("_p", before.alias("_first"))  # a row for each partition
    return placed.withColumn("_p", part).join(firsts, "_p").withColumn("input_pos", F.col("_first") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m", "_p", "_first")


def keep_lines(text: Column, strip_urls: bool = False, script_class: str | None = None) -> Column:
    """Without lines that are one address, or that lack a script; blank lines stay."""
    line = lambda x: N.strip(x)

    def keep(x: Column) -> Column:
        ok = F.lit(True)
        if strip_urls:
            ok = ok & ~(~line(x).contains(" ") & F.lower(line(x)).rlike(r"^(https?://|www\.)"))
        if script_class:
            ok = ok & ((line(x) == "") | x.rlike(f"[{script_class}]"))
        return ok

    return N.strip(N.join_lines(F.filter(N.lines(text), keep)))


READERS = {"jsonl": read_jsonl, "txt": read_lines, "parquet": read_parquet_text, "html": read_html, "zip": read_zip, "json": read_json_documents}


def units(spark: SparkSession, path: str | list[str], suffixes: tuple[str, ...] = ("jsonl", "json", "parquet", "zip", "txt", "html"), members: bool = False) -> DataFrame:
    """(path, kind, bytes) of the files that can be read, in no order; only the listing is read, not the files.

    With ``members`` archives are opened, for their directories alone, and stand as ``file.zip!member``, a row for each of their files; one that can't be read is ``file.zip!``.
    """
    found = files(spark, path).select("path", "length")
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    every = found.select("path", kind.alias("kind"), F.col("length").alias("bytes")).where(F.col("kind").isin(*suffixes))
    if not members:
        return every
    return every.where(F.col("kind") != "zip").union(zip_members(spark, path, "*.[zZ][iI][pP]").select(F.concat("path", F.lit("!"), F.coalesce("member", F.lit(""))), F.lit("zip"), "bytes"))


def read_training_rows(spark: SparkSession, path: str | list[str], rank: int = 0, ranks: int = 1) -> DataFrame:
    """Encoded rows of JSON-lines files, whole or the files of one rank; a broken line raises with its file."""
    from lakecorpus.streaming.ranks import deal_files

    mine = deal_files(units(spark, path, ("jsonl", "json")), ranks).where(F.col("rank") == rank).select("path")
    names = [r.path for r in mine.collect()]  # names of files, of one rank
    if not names:
        raise ValueError(f"there are no files for rank {rank} of {ranks}")
    return spark.read.option("mode", "FAILFAST").json(names)


def read_required_text(spark: SparkSession, path: str | list[str], key: str = "text") -> DataFrame:
    """(path, pos, text) of lines that are text, or objects with a text; arrays and objects without one raise with file and line."""

    def rows(name: str, data: bytes) -> Iterator[str]:
        for k, line in enumerate(io.StringIO(data.decode("utf-8-sig")), 1):
            line = line.strip()
            if not line:
                continue
            text = line
            if name.endswith((".json", ".jsonl", ".ndjson")):
                value = json.loads(line)
                text = value if isinstance(value, str) else value.get(key) if isinstance(value, dict) else None
            if not isinstance(text, str) or not text:
                raise ValueError(f"{name}:{k}: no text")
            yield text

    return _from_files(files(spark, path), rows)


#: Named sources: a function of a session that gives (path, text) rows.
SOURCES: dict[str, Callable[[SparkSession], DataFrame]] = {}


def source(name: str, bucket: str):
    """Registers a function as a source of a bucket; its rows get both as columns."""

    def add(f: Callable[[SparkSession], DataFrame]):
        SOURCES[name] = lambda spark: f(spark).withColumns({"source": F.lit(name), "bucket": F.lit(bucket)})
        return f

    return add


def read_sources(spark: SparkSession, *names: str) -> DataFrame:
    """The rows of the named sources, all of them without names, under one another."""
    out = None
    for n in names or SOURCES:
        rows = SOURCES[n](spark).select("path", "text", "source", "bucket")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("there are no sources")
    return out


def sniff_json(spark: SparkSession, path: str) -> str:
    """``array`` where the first visible character of the first file is ``[``, else ``jsonl``. Of that file 64 KB are read."""
    found = [f[0] for f in store.listing(spark, path)]
    head = store.read(spark, found[0]).decode("utf-8", "replace").lstrip("\ufeff \t\r\n") if found else ""
    return "array" if head.startswith("[") else "jsonl"


def read_json_fields(spark: SparkSession, path: str, fields: tuple[str, ...], joined: bool = False) -> DataFrame:
    """(path, text) of the fields of JSON lines or of an array, whichever the file is."""
    read = read_json_array if sniff_json(spark, path) == "array" else read_jsonl_fields
    return read(spark, path, fields, joined=joined).select("path", "text")


def infer_format(path: str, explicit: str | None = None) -> str:
    """The format of a path by its suffix; an unknown one is read as JSON lines."""
    suffix = (explicit or path.rpartition(".")[2]).lower()
    names = {"ndjson": "jsonl", "htm": "html", "xhtml": "html", "text": "txt", "md": "txt"}
    suffix = names.get(suffix, suffix)
    return suffix if suffix in READERS else "jsonl"


def read_text(spark: SparkSession, path: str, explicit: str | None = None, **options) -> DataFrame:
    return READERS[infer_format(path, explicit)](spark, path, **options)
