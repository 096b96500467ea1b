"""PLY point and mesh files.

Reading goes through Spark's binary file source, so every file system Spark
knows works, paths are pruned before content is read, and the same decoder
serves batch and stream. Writing goes through Spark's own writers and renames.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import checkpointed
from ..storage import write_files

# PLY type names with their numpy code and Spark type (unsigned widen one step).
PLY_TYPES = {
    "char": ("i1", "tinyint"), "int8": ("i1", "tinyint"),
    "uchar": ("u1", "smallint"), "uint8": ("u1", "smallint"),
    "short": ("i2", "smallint"), "int16": ("i2", "smallint"),
    "ushort": ("u2", "int"), "uint16": ("u2", "int"),
    "int": ("i4", "int"), "int32": ("i4", "int"),
    "uint": ("u4", "bigint"), "uint32": ("u4", "bigint"),
    "float": ("f4", "float"), "float32": ("f4", "float"),
    "double": ("f8", "double"), "float64": ("f8", "double"),
}
PLY_ORDERS = {"ascii": "", "binary_little_endian": "<", "binary_big_endian": ">"}
WRITE_TYPES = {"tinyint": "char", "smallint": "short", "int": "int", "bigint": "double",
               "float": "float", "double": "double"}
BATCH = 1 << 16
HEADER_BYTES = 1 << 16
SESSION_PATTERN = r"(\d{4}-\d{2}-\d{2}-\d{2}-\d{2}-\d{2})"
STAMP_PATTERN = r"([0-9]+(?:\.[0-9]+)?)[^/]*\.ply$"


@dataclass
class Element:
    name: str
    count: int
    fields: list[tuple[str, str]]
    is_list: bool
    length: str = "uchar"


def parse_header(raw: bytes) -> tuple[str, list[Element], int]:
    """Byte order, elements and length of a PLY header."""
    end = raw.find(b"end_header")
    if not raw.startswith(b"ply") or end < 0:
        raise ValueError("not a PLY file")
    stop = raw.index(b"\n", end) + 1
    order, elements = "", []
    for line in raw[:end].decode("ascii").splitlines()[1:]:
        words = line.split()
        if not words or words[0] in ("comment", "obj_info"):
            continue
        if words[0] == "format":
            if words[1] not in PLY_ORDERS:
                raise ValueError(f"unknown PLY format {words[1]}")
            order = PLY_ORDERS[words[1]]
        elif words[0] == "element":
            elements.append(Element(words[1], int(words[2]), [], False))
        elif words[0] == "property" and words[1] == "list":
            elements[-1].is_list, elements[-1].length = True, words[2]
            elements[-1].fields.append((words[4], words[3]))
        elif words[0] == "property":
            elements[-1].fields.append((words[2], words[1]))
    return order, elements, stop


def _layout(element: Element, order: str) -> np.dtype:
    mark = order or "<"
    if element.is_list:
        if len(element.fields) > 1 or PLY_TYPES[element.length][0] != "u1":
            raise ValueError("a list must be the only property and have a one-byte length")
        code = PLY_TYPES[element.fields[0][1]][0]
        return np.dtype([("k", "u1"), ("v1", mark + code), ("v2", mark + code), ("v3", mark + code)])
    return np.dtype([(n, mark + PLY_TYPES[t][0]) for n, t in element.fields])


def _only_triangles(element: Element, rows: np.ndarray) -> None:
    if element.is_list and (rows["k"] != 3).any():
        raise ValueError("only triangles can be read")


def decode(raw: bytes, element: str = "vertex") -> Iterator[np.ndarray]:
    """Structured arrays of one element, a batch of rows at a time."""
    order, elements, at = parse_header(raw)
    if element not in [e.name for e in elements]:
        return
    if order == "":
        lines = raw[at:].decode("ascii").split("\n")
        at = 0
        for e in elements:
            layout = _layout(e, order)
            if e.name == element:
                for i in range(0, e.count, BATCH):
                    rows = [tuple(r.split()) for r in lines[at + i: at + min(i + BATCH, e.count)]]
                    if e.is_list and any(len(r) != 4 for r in rows):
                        raise ValueError("only triangles can be read")
                    yield np.array(rows, dtype=layout)
            at += e.count
        return
    for e in elements:
        layout = _layout(e, order)
        if e.name == element:
            for i in range(0, e.count, BATCH):
                n = min(BATCH, e.count - i)
                part = np.frombuffer(raw, layout, n, at + i * layout.itemsize)
                _only_triangles(e, part)
                yield part
            return
        at += e.count * layout.itemsize


def header_schema(raw: bytes, element: str = "vertex") -> str:
    """Spark columns of an element, as DDL."""
    for e in parse_header(raw)[1]:
        if e.name == element:
            if e.is_list:
                return "v1 int, v2 int, v3 int"
            return ", ".join(f"`{n}` {PLY_TYPES[t][1]}" for n, t in e.fields)
    raise ValueError(f"no element {element}")


def path_session(path="path") -> Column:
    return F.regexp_extract(path, SESSION_PATTERN, 1)


def path_stamp(path="path") -> Column:
    return F.expr(f"try_cast(regexp_extract({path}, r'{STAMP_PATTERN}', 1) as double)")


def decode_files(files: DataFrame, schema: str, element: str = "vertex") -> DataFrame:
    """Points of binary file rows (``path``, ``content``); works on batch and streaming frames.

    ``schema`` is DDL of the wanted columns; columns a file lacks become NULL.
    ``session``, ``frame_ts`` and ``id`` (row number in the file) come first.
    """
    wanted = T.StructType.fromDDL(schema)
    names = wanted.fieldNames()
    out = T.StructType.fromDDL("session string, frame_ts double, path string, id bigint")
    for f in wanted:
        out = out.add(f)
    arrow = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(),
             "float": pa.float32(), "double": pa.float64()}
    kinds = {f.name: arrow[f.dataType.simpleString()] for f in wanted}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = batch.to_pydict()
            for session, stamp, path, raw in zip(cols["session"], cols["frame_ts"], cols["path"], cols["content"]):
                start = 0
                for part in decode(raw, element):
                    n = len(part)
                    data = [pa.array([session] * n, pa.string()), pa.array([stamp] * n, pa.float64()),
                            pa.array([path] * n, pa.string()), pa.array(np.arange(start, start + n))]
                    for name in names:
                        if name in (part.dtype.names or ()):
                            native = part[name].astype(part[name].dtype.newbyteorder("="))
                            data.append(pa.array(native).cast(kinds[name]))
                        else:
                            data.append(pa.nulls(n, kinds[name]))
                    start += n
                    yield pa.RecordBatch.from_arrays(data, names=["session", "frame_ts", "path", "id", *names])

    keyed = files.select(path_session().alias("session"), path_stamp().alias("frame_ts"), "path", "content")
    return keyed.mapInArrow(rows, out)


def merged_schema(files: DataFrame, element: str = "vertex") -> str | None:
    """Columns of an element over the headers of all files, as DDL; None without files.

    Only the distinct headers' columns, in the order of first sight by name of the
    file, come to the driver.
    """
    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [header_schema(raw, element) for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["path", "ddl"])

    kinds = (files.select("path", F.substring("content", 1, HEADER_BYTES).alias("head")).mapInArrow(heads, "path string, ddl string")
             .groupBy("ddl").agg(F.min("path").alias("path")).orderBy("path").collect())
    columns: dict[str, str] = {}
    for row in kinds:
        for field in T.StructType.fromDDL(row["ddl"]):
            kind = field.dataType.simpleString()
            if columns.setdefault(field.name, kind) != kind:
                raise ValueError(f"column {field.name} is {columns[field.name]} in some files, {kind} in {row['path']}")
    return ", ".join(f"`{n}` {k}" for n, k in columns.items()) or None


def list_files(spark: SparkSession, path: str, glob: str = "*.ply") -> DataFrame:
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob)
            .option("recursiveFileLookup", "true").load(path))


def read_ply(spark: SparkSession, path: str, schema: str | None = None, element: str = "vertex",
             sessions: Column | None = None, glob: str = "*.ply") -> DataFrame:
    """All PLY files below ``path`` as one table.

    Without a schema the headers of all files are read first, by Spark; the
    columns are those of any file, and files that give one column different
    types are refused. Longer headers than ``HEADER_BYTES`` need a schema.
    ``sessions`` is a
    filter on the column ``session``, applied to paths before files are read.
    """
    files = list_files(spark, path, glob)
    if sessions is not None:
        files = files.withColumn("session", path_session()).where(sessions).drop("session")
    if schema is None:
        schema = merged_schema(files, element)
        if schema is None:
            raise FileNotFoundError(path)
    return decode_files(files, schema, element)


def stream_ply(spark: SparkSession, path: str, schema: str, glob: str = "*.ply") -> DataFrame:
    """PLY files as they appear below ``path``."""
    files = (spark.readStream.format("binaryFile").option("pathGlobFilter", glob)
             .schema("path string, modificationTime timestamp, length bigint, content binary").load(path))
    return decode_files(files, schema)


# --- writing -----------------------------------------------------------------


def encode(columns: list[np.ndarray], names: list[str], types: list[str],
           faces: np.ndarray | None = None) -> bytes:
    """A binary little-endian PLY file without its last byte, a line feed; lengths and names must agree.

    That byte is the one row of a last element ``end``, so that writers that close a file with a line feed write
    a valid file; readers of points and faces pass over it.
    """
    if len(columns) != len(names) or len({len(c) for c in columns}) > 1:
        raise ValueError("fields need one name each and equal lengths")
    n = len(columns[0]) if columns else 0
    head = ["ply", "format binary_little_endian 1.0", f"element vertex {n}"]
    head += [f"property {t} {c}" for t, c in zip(types, names)]
    if faces is not None:
        head += [f"element face {len(faces)}", "property list uchar int vertex_indices"]
    head += ["element end 1", "property uchar feed"]
    table = np.empty(n, np.dtype([(c, "<" + PLY_TYPES[t][0]) for t, c in zip(types, names)]))
    for c, name in zip(columns, names):
        table[name] = c
    body = table.tobytes()
    if faces is not None:
        rows = np.empty(len(faces), np.dtype([("k", "u1"), ("v", "<i4", 3)]))
        rows["k"], rows["v"] = 3, faces
        body += rows.tobytes()
    return ("\n".join([*head, "end_header"]) + "\n").encode("ascii") + body


def _name(values: list) -> str:
    """Folders and file name of a key: ``session/1.500000.ply``."""
    parts = [f"{v:.6f}" if isinstance(v, float) else re.sub(r"[^\w.-]", "_", str(v)) for v in values]
    return "/".join(parts) + ".ply"


def ply_files(df: DataFrame, keys: list[str] = ("session", "frame_ts"), order: list[str] = ()) -> DataFrame:
    """``name, content``: one PLY file per key, rows in ``order``. A file is one frame, and put together by one task."""
    keys, fields = list(keys), [(f.name, WRITE_TYPES[f.dataType.simpleString()]) for f in df.schema if f.name not in keys]
    if not fields:
        raise ValueError("no columns to write")
    names, kinds = [n for n, _ in fields], [t for _, t in fields]

    def save(rows: pa.Table) -> pa.Table:
        if order:
            rows = rows.sort_by([(c, "ascending") for c in order])
        name = _name([rows.column(k)[0].as_py() for k in keys])
        raw = encode([rows.column(n).to_numpy() for n in names], names, kinds)
        return pa.table({"name": pa.array([name]), "content": pa.array([raw], pa.binary())})

    return df.groupBy(*keys).applyInArrow(save, "name string, content binary")


def write_ply(df: DataFrame, path: str, keys: list[str] = ("session", "frame_ts"), mode: str = "append",
              order: list[str] = ()) -> list[str]:
    """One PLY file per key below ``path``, any folder the session can write; returns their names.

    Files appear under their names once all are written. With ``mode`` "append"
    a file that exists is an error, with "overwrite" it is replaced.
    """
    return write_files(ply_files(df, keys, order), path, mode == "overwrite")


def write_mesh(vertices: DataFrame, faces: DataFrame, path: str, mesh: str = "mesh") -> DataFrame:
    """One PLY mesh per ``mesh`` key (v_id, x, y, z and f_id, v1, v2, v3); returns the files written, with their sizes.

    A mesh is one file with consecutive vertex numbers, so it is put together by
    one task per mesh. A mesh that exists is replaced.
    """

    def save(key, v: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        v, f = v.sort_values("v_id"), f.sort_values("f_id")
        raw = encode([v[a].to_numpy("f4") for a in "xyz"], list("xyz"), ["float"] * 3,
                     f[["v1", "v2", "v3"]].to_numpy("i4"))
        return pd.DataFrame({"name": [_name(list(key))], "content": [raw], "vertices": [len(v)], "faces": [len(f)]})

    made = checkpointed(vertices.groupBy(mesh).cogroup(faces.groupBy(mesh))
                        .applyInPandas(save, "name string, content binary, vertices long, faces long"))
    write_files(made.select("name", "content"), path, overwrite=True)
    return made.select(F.concat(F.lit(path.rstrip("/") + "/"), "name").alias("file"), "vertices", "faces")
