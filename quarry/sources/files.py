"""Readers and writers beyond Spark's own: typed CSV, ARFF, graph files, sparse matrices, vocabularies, WAV, checksums."""

from __future__ import annotations

import re
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",", header: bool = True, comment: str | None = None, missing: str = "") -> DataFrame:
    """CSV with a DDL schema, or with inferred types."""
    r = spark.read.option("header", header).option("sep", sep).option("nullValue", missing).option("mode", "FAILFAST")
    if comment:
        r = r.option("comment", comment)
    return (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", quote_all: bool = False) -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).option("quoteAll", quote_all).csv(path)


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """ARFF: numeric, string, date and nominal (checked against its set) attributes; ``?`` is null. The header is read on the driver."""
    lines = spark.read.text(path).withColumn("_i", F.monotonically_increasing_id())
    head = [r.value for r in lines.where(F.lower(F.ltrim("value")).startswith("@attribute")).orderBy("_i").select("value").collect()]
    fields: list[tuple[str, str, list[str] | None]] = []
    for h in head:
        m = re.match(r"@attribute\s+('[^']*'|\"[^\"]*\"|\S+)\s+(.*)$", h.strip(), re.I)
        name, kind = m[1].strip("'\""), m[2].strip()
        if kind.startswith("{"):
            fields.append((name, "string", [v.strip().strip("'\"") for v in kind.strip("{}").split(",")]))
        else:
            fields.append((name, {"numeric": "double", "real": "double", "integer": "long", "date": "timestamp"}.get(kind.split()[0].lower(), "string"), None))
    data = lines.where(~F.ltrim("value").rlike(r"^([@%].*)?$"))
    row = F.from_csv("value", ", ".join(f"`{n}` string" for n, _, _ in fields), {"quote": "'", "nullValue": "?", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    out = data.select(row.alias("r"))
    cols = []
    for name, kind, allowed in fields:
        c = F.col(f"r.`{name}`")
        if allowed is not None:
            c = F.when(c.isNull() | c.isin(allowed), c).otherwise(F.raise_error(F.concat(F.lit(f"{name}: not a nominal value: "), c)))
        cols.append(c.cast(kind).alias(name))
    return out.select(*cols)


def read_edge_list(spark: SparkSession, path: str, weighted: bool = False) -> DataFrame:
    """Lines ``src dst [weight]``; blank, ``#`` and malformed lines are skipped."""
    t = spark.read.text(path).select(F.split(F.trim("value"), r"[\s,]+").alias("p")).where(~F.get("p", F.lit(0)).startswith("#"))
    w = F.expr("try_cast(get(p, 2) AS double)")
    out = t.where(F.size("p") >= (3 if weighted else 2)).select(F.get("p", F.lit(0)).alias("src"), F.get("p", F.lit(1)).alias("dst"), *([w.alias("weight")] if weighted else []))
    return out.where("weight IS NOT NULL") if weighted else out


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of ``{"nodes": [{"id": ...}], "edges": [{"source", "target", "weight"}]}``."""
    j = spark.read.schema("nodes array<struct<id:string>>, edges array<struct<source:string,target:string,weight:double>>").option("multiLine", True).json(path)
    nodes = j.select(F.explode("nodes").alias("n")).select("n.id")
    edges = j.select(F.explode("edges").alias("e")).select(F.col("e.source").alias("src"), F.col("e.target").alias("dst"), F.coalesce("e.weight", F.lit(1.0)).alias("weight"))
    return nodes, edges


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, v) from 0 of a coordinate file; symmetric files give both triangles, pattern files ones."""
    t = spark.read.text(path).withColumn("_k", F.monotonically_increasing_id())
    head = t.where(F.col("value").startswith("%%")).first().value.lower()
    body = t.where(~F.col("value").startswith("%")).withColumn("p", F.split(F.trim("value"), r"\s+"))
    size = body.orderBy("_k").first()._k
    v = F.lit(1.0) if "pattern" in head else F.get("p", F.lit(2)).cast("double")
    out = body.where(F.col("_k") != size).select((F.get("p", F.lit(0)).cast("long") - 1).alias("i"), (F.get("p", F.lit(1)).cast("long") - 1).alias("j"), v.alias("v"))
    return out.union(out.where("i <> j").select("j", "i", "v")) if "symmetric" in head else out


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(term, id): one token a line, the id is the line number from 0."""
    t = spark.read.text(path, wholetext=True)
    return t.select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("id", "term")).select("term", F.col("id").cast("long").alias("id"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, crc32, sha256) of every file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.crc32("content").alias("crc32"), F.sha2("content", 256).alias("sha256"))


WAV = T.StructType([T.StructField("path", T.StringType()), T.StructField("rate", T.IntegerType()), T.StructField("channels", T.IntegerType()), T.StructField("samples", T.ArrayType(T.FloatType()))])


def _pcm(content: bytes) -> tuple[int, int, np.ndarray]:
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, fmt, data = 12, None, b""
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack("<I", content[at + 4 : at + 8])[0]
        body = content[at + 8 : at + 8 + size]
        if name == b"fmt ":
            fmt = struct.unpack("<HHIIHH", body[:16])
        elif name == b"data":
            data = body
        at += 8 + size + size % 2
    kind, channels, rate, _, _, bits = fmt
    if kind == 3:
        x = np.frombuffer(data, np.float32 if bits == 32 else np.float64)
    elif bits == 8:
        x = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    else:
        x = np.frombuffer(data, {16: np.int16, 32: np.int32}[bits]).astype(np.float64) / 2.0 ** (bits - 1)
    return rate, channels, x.astype(np.float32)


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """A row a file: path, rate, channels, interleaved samples in [-1, 1]."""

    def run(it):
        for pdf in it:
            rows = [(p, *_pcm(c)) for p, c in zip(pdf.path, pdf.content)]
            yield pd.DataFrame({"path": [r[0] for r in rows], "rate": [r[1] for r in rows], "channels": [r[2] for r in rows], "samples": [r[3] for r in rows]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, WAV)


def wav_bytes(samples: np.ndarray, rate: int, channels: int = 1) -> bytes:
    """A 16-bit PCM file."""
    pcm = (np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(pcm)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16) + b"data" + struct.pack("<I", len(pcm)) + pcm


# synthetic data


def make_blobs(spark: SparkSession, n: int, centers: list[list[float]], std: float = 1.0, seed: int = 0) -> DataFrame:
    """(id, label, x0, x1, ...): normal points around centres, in turn."""
    k, dims = len(centers), len(centers[0])
    c = F.array(*(F.array(*map(F.lit, map(float, v))) for v in centers))
    d = spark.range(n).withColumn("label", (F.col("id") % k).cast("int"))
    return d.select("id", "label", *((c[F.col("label")][i] + F.randn(seed + i) * std).alias(f"x{i}") for i in range(dims)))


def make_regression(spark: SparkSession, n: int, coefficients: list[float], noise: float = 0.1, seed: int = 0) -> DataFrame:
    d = spark.range(n).select("id", *(F.randn(seed + i).alias(f"x{i}") for i in range(len(coefficients))))
    y = sum((c * F.col(f"x{i}") for i, c in enumerate(coefficients)), F.lit(0.0))
    return d.withColumn("y", y + noise * F.randn(seed + 1000))


# more formats


def read_libsvm(spark: SparkSession, path: str) -> DataFrame:
    """(label, indices, values) of lines ``label i:v i:v ...`` with indices as in the file; ``#`` starts a comment, blank lines are skipped, a malformed pair is an error."""
    t = spark.read.text(path).select(F.split(F.trim(F.regexp_replace("value", "#.*$", "")), r"\s+").alias("p")).where(F.get("p", F.lit(0)) != "")
    pairs = F.transform(F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0))), lambda x: F.split(x, ":"))
    return t.select(F.get("p", F.lit(0)).cast("double").alias("label"), F.transform(pairs, lambda x: F.get(x, F.lit(0)).cast("int")).alias("indices"), F.transform(pairs, lambda x: F.get(x, F.lit(1)).cast("double")).alias("values"))


def map_chunks(df: DataFrame, size: int, f, schema: str) -> DataFrame:
    """f(pandas chunk) -> pandas over chunks of exactly ``size`` rows (the last of a partition may be shorter); a worker holds one chunk."""
    if size < 1:
        raise ValueError("a chunk has a row at least")

    def run(batches):
        held: list[pd.DataFrame] = []
        n = 0
        for b in batches:
            while len(b):
                part, b = b.iloc[: size - n], b.iloc[size - n :]
                held.append(part)
                n += len(part)
                if n == size:
                    yield f(pd.concat(held, ignore_index=True))
                    held, n = [], 0
        if n:
            yield f(pd.concat(held, ignore_index=True))

    return df.mapInPandas(run, schema)


def read_csv_chunks(spark: SparkSession, path: str, schema: str, size: int, f, out_schema: str, **options) -> DataFrame:
    """f over chunks of the rows of CSV files; see :func:`map_chunks`."""
    return map_chunks(read_csv(spark, path, schema, **options), size, f, out_schema)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): lines numbered from 0 inside each file, by one sort a file range."""
    from pyspark.sql import Window

    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"), "value")
    per = t.groupBy("file", "_b").agg(F.count("*").alias("_n"), F.min("_i").alias("_least"))
    start = per.withColumn("_s", F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a block
    return t.join(start, ["file", "_b"]).select("file", (F.col("_s") + F.col("_i") - F.col("_least")).alias("line"), "value")


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Fields of structs at any depth as columns of their own; arrays and maps stay."""

    def leaves(kind, path: list[str]):
        for f in kind.fields:
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, [*path, f.name])
            else:
                yield [*path, f.name]

    return df.select(*(F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path)) for path in leaves(df.schema, [])))


def read_nested_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines with nested objects flattened."""
    return flatten((spark.read.schema(schema) if schema else spark.read).json(path))


def read_sql(spark: SparkSession, url: str, table: str, column: str | None = None, lower=None, upper=None, parts: int = 1, **options) -> DataFrame:
    """A table or ``(query) alias`` by JDBC; with a column and its bounds, read in parts."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if column is not None:
        r = r.option("partitionColumn", column).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", parts)
    return r.load()


def _binary(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    """parse(content) -> pandas of each file; a file is one piece of work."""

    def run(batches):
        for b in batches:
            for content in b["content"]:
                yield parse(bytes(content))

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def read_sparse_npz(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, v) of CSR, CSC or COO matrices saved as .npz."""

    def parse(content: bytes) -> pd.DataFrame:
        import io

        z = np.load(io.BytesIO(content), allow_pickle=False)
        kind = z["format"].item()
        kind = kind.decode() if isinstance(kind, bytes) else str(kind)
        if kind == "coo":
            i, j = z["row"], z["col"]
        elif kind in ("csr", "csc"):
            major = np.repeat(np.arange(len(z["indptr"]) - 1), np.diff(z["indptr"]))
            i, j = (major, z["indices"]) if kind == "csr" else (z["indices"], major)
        else:
            raise ValueError(f"format {kind}")
        return pd.DataFrame({"i": i.astype(np.int64), "j": j.astype(np.int64), "v": z["data"].astype(float)})

    return _binary(spark, path, parse, "i long, j long, v double")


def sparse_npz_bytes(i: np.ndarray, j: np.ndarray, v: np.ndarray, shape: tuple[int, int]) -> bytes:
    """One matrix as an .npz file in COO format."""
    import io

    out = io.BytesIO()
    np.savez_compressed(out, format=np.array("coo"), row=i, col=j, data=v, shape=np.array(shape))
    return out.getvalue()


def mat4_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    """Real matrices as a level 4 MAT file (column-major doubles)."""
    out = b""
    for name, a in arrays.items():
        a = np.atleast_2d(np.asarray(a, float))
        out += struct.pack("<5i", 0, a.shape[0], a.shape[1], 0, len(name) + 1) + name.encode() + b"\0" + a.astype("<f8").tobytes(order="F")
    return out


def read_mat4(spark: SparkSession, path: str) -> DataFrame:
    """(name, i, j, v) of the real double matrices of level 4 MAT files."""

    def parse(content: bytes) -> pd.DataFrame:
        at, parts = 0, []
        while at < len(content):
            kind, rows, cols, imag, n = struct.unpack_from("<5i", content, at)
            if kind or imag:
                raise ValueError("only real little-endian double matrices")
            name = content[at + 20 : at + 20 + n - 1].decode()
            at += 20 + n
            a = np.frombuffer(content, "<f8", rows * cols, at).reshape((rows, cols), order="F")
            at += 8 * rows * cols
            i, j = np.indices(a.shape)
            parts.append(pd.DataFrame({"name": name, "i": i.ravel().astype(np.int64), "j": j.ravel().astype(np.int64), "v": a.ravel()}))
        return pd.concat(parts) if parts else pd.DataFrame({"name": [], "i": [], "j": [], "v": []})

    return _binary(spark, path, parse, "name string, i long, j long, v double")


def read_safetensors(spark: SparkSession, path: str) -> DataFrame:
    """(name, dtype, shape, values) of the tensors of a file: header length, JSON header, raw little-endian data."""
    kinds = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U8": "u1", "BOOL": "u1"}

    def parse(content: bytes) -> pd.DataFrame:
        import json

        (n,) = struct.unpack_from("<Q", content)
        head = json.loads(content[8 : 8 + n])
        rows = []
        for name, t in head.items():
            if name == "__metadata__":
                continue
            lo, hi = t["data_offsets"]
            data = np.frombuffer(content[8 + n + lo : 8 + n + hi], kinds[t["dtype"]]).astype(float)
            rows.append((name, t["dtype"], [int(x) for x in t["shape"]], data.tolist()))
        return pd.DataFrame(rows, columns=["name", "dtype", "shape", "values"])

    return _binary(spark, path, parse, "name string, dtype string, shape array<long>, `values` array<double>")


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of lines ``src dst dst ...``; blank and ``#`` lines are skipped."""
    t = spark.read.text(path).select(F.split(F.trim("value"), r"[\s,:]+").alias("p")).where("p[0] <> '' AND NOT startswith(p[0], '#')")
    return t.select(F.get("p", F.lit(0)).alias("src"), F.explode(F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0)))).alias("dst"))


def read_dot(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, weight, directed) of the edges ``a -> b [weight=w]`` or ``a -- b`` of DOT files, one a line; weight is null without one."""
    t = spark.read.text(path)
    name = r'("[^"]*"|[\w.]+)'
    pattern = rf"^\s*{name}\s*(->|--)\s*{name}"
    bare = lambda i: F.regexp_replace(F.regexp_extract("value", pattern, i), '^"|"$', "")
    w = F.expr(r"try_cast(nullif(regexp_extract(value, 'weight\\s*=\\s*\"?([-0-9.eE]+)', 1), '') AS double)")
    return t.where(F.col("value").rlike(pattern)).select(bare(1).alias("src"), bare(3).alias("dst"), w.alias("weight"), (F.regexp_extract("value", pattern, 2) == "->").alias("directed"))


def read_gml(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, weight) of the edges of GML files; a file is one value, as edges span lines."""
    t = spark.read.text(path, wholetext=True)
    e = t.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)\bedge\s*\[(.*?)\]"), F.lit(1))).alias("e"))
    of = lambda k: F.expr(f"nullif(regexp_extract(e, '\\\\b{k}\\\\s+\"?([^\"\\\\s]+)', 1), '')")
    return e.select(of("source").alias("src"), of("target").alias("dst"), F.coalesce(of("weight"), of("value")).try_cast("double").alias("weight"))


def read_graphml(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of the edges of GraphML files; a file is one value."""
    t = spark.read.text(path, wholetext=True)
    e = t.select(F.explode(F.regexp_extract_all("value", F.lit(r"<edge\b[^>]*>"), F.lit(0))).alias("e"))
    of = lambda k: F.regexp_extract("e", rf"\b{k}\s*=\s*[\"']([^\"']*)", 1)
    return e.select(of("source").alias("src"), of("target").alias("dst"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of all files below a folder."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return b.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """(file, problem) of files that are missing, new or changed against a manifest."""
    now = manifest(spark, path).select("file", F.col("sha256").alias("_now"))
    j = expected.select("file", F.col("sha256").alias("_then")).join(now, "file", "full")
    problem = F.when(F.col("_now").isNull(), "missing").when(F.col("_then").isNull(), "new").when(F.col("_now") != F.col("_then"), "changed")
    return j.select("file", problem.alias("problem")).where("problem IS NOT NULL")
