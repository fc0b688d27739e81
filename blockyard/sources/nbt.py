"""The nested tagged binary format: values, bytes, and a table of nodes.

``Tag`` keeps the width of each number and the element type of each list, so a
round trip gives the same bytes.  A schema is optional: a dict for a compound, a
one-element list for a list, a word for a leaf, None or {} for anything.  On
reading it is checked (any number fits a number word); on writing a number takes
the width that the schema names.
"""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tag numbers of the format and their names.
END, BYTE, SHORT, INT, LONG, FLOAT, DOUBLE, BYTES, STRING, LIST, COMPOUND, INTS = range(12)
NAMES = ("end", "byte", "short", "int", "long", "float", "double", "data", "string", "list", "compound", "intarray")
NUMBERS = frozenset((BYTE, SHORT, INT, LONG, FLOAT, DOUBLE))
_CODE = {BYTE: ">b", SHORT: ">h", INT: ">i", LONG: ">q", FLOAT: ">f", DOUBLE: ">d"}
LONGEST = 65535
_STRUCT = {c: struct.Struct(c) for c in (*_CODE.values(), ">B", ">H")}
#: Rows and bytes of documents after which a batch of nodes or files is given on.
BATCH_ROWS, BATCH_BYTES = 10_000, 8 << 20


class NBTError(ValueError):
    """Bytes or values that do not follow the format or the schema; names the key path."""


class Tag(NamedTuple):
    """``value``: number, bytes, str, list of Tag, dict of Tag or list of int; ``item``: element kind of a list."""

    kind: int
    value: Any
    item: int = END


def kind_of(schema: Any) -> int | None:
    """The tag number that a schema asks for; None if anything goes."""
    if schema is None:
        return None
    if isinstance(schema, dict):
        return COMPOUND
    if isinstance(schema, list):
        return LIST
    return NAMES.index(schema)


def is_number(kind: int) -> bool:
    return kind in NUMBERS


def is_known(kind: int) -> bool:
    return END <= kind <= INTS


def fits(kind: int, schema: Any) -> bool:
    want = kind_of(schema)
    return want is None or want == kind or (want in NUMBERS and kind in NUMBERS)


class Codec(NamedTuple):
    """A compression of the caller's own, in place of a name."""

    compress: Callable[[bytes], bytes]
    decompress: Callable[[bytes], bytes]


def inflate(data: bytes, how: str | Codec = "auto") -> bytes:
    """``auto`` takes gzip or zlib; also ``gzip``, ``zlib``, ``deflate``, ``none`` and a ``Codec``."""
    if isinstance(how, Codec):
        return how.decompress(data)
    if how == "none":
        return data
    bits = {"auto": 47, "gzip": 31, "zlib": 15, "deflate": -15}[how]
    d = zlib.decompressobj(bits)
    try:
        out = d.decompress(data) + d.flush()
    except zlib.error as e:
        raise NBTError(f"cannot decompress: {e}") from None
    if not d.eof:
        raise NBTError("compressed data are cut off")
    return out


def deflate(data: bytes, how: str | Codec = "gzip") -> bytes:
    if isinstance(how, Codec):
        return how.compress(data)
    if how == "none":
        return data
    if how == "gzip":
        return gzip.compress(data, mtime=0)
    c = zlib.compressobj(wbits={"zlib": 15, "deflate": -15}[how])
    return c.compress(data) + c.flush()


class _Input:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int, path: str) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise NBTError(f"data end inside {path}")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, code: str, path: str):
        kind, at = _STRUCT[code], self.at
        if at + kind.size > len(self.data):
            raise NBTError(f"data end inside {path}")
        self.at = at + kind.size
        return kind.unpack_from(self.data, at)[0]

    def text(self, path: str) -> str:
        raw = self.take(self.number(">H", path), path)
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            raise NBTError(f"bad text in {path}") from None

    def body(self, kind: int, schema: Any, path: str) -> Tag:
        if schema is not None and not fits(kind, schema):
            raise NBTError(f"{path}: {NAMES[kind]} where the schema has {NAMES[kind_of(schema)]}")
        if kind in _CODE:
            return Tag(kind, self.number(_CODE[kind], path))
        if kind == BYTES:
            return Tag(kind, self.take(self.number(">i", path), path))
        if kind == STRING:
            return Tag(kind, self.text(path))
        if kind == INTS:
            n = self.number(">i", path)
            return Tag(kind, list(struct.unpack(f">{max(0, n)}i", self.take(4 * n, path))))
        if kind == LIST:
            item, n = self.number(">B", path), self.number(">i", path)
            if not is_known(item) or (item == END and n > 0):
                raise NBTError(f"{path}: list of unknown type {item}")
            sub = schema[0] if schema else None
            return Tag(kind, [self.body(item, sub, f"{path}[{i}]") for i in range(max(0, n))], item)
        if kind == COMPOUND:
            out: dict[str, Tag] = {}
            while (k := self.number(">B", path)) != END:
                name = self.text(path)
                out[name] = self.body(k, (schema or {}).get(name), f"{path}.{name}")
            return Tag(kind, out)
        raise NBTError(f"{path}: unknown type {kind}")


def loads(data: bytes, root_name: str | None = None, schema: Any = None, fragments: bool = False, compression: str = "auto") -> tuple[str, Tag]:
    """Name and value of the root; it must be a compound unless ``fragments``."""
    source = _Input(inflate(data, compression))
    kind = source.number(">B", "root")
    if kind == END or not is_known(kind):
        raise NBTError(f"root: unknown type {kind}")
    name = source.text("root")
    if kind != COMPOUND and not fragments:
        raise NBTError("root is no compound")
    if root_name is not None and name != root_name:
        raise NBTError(f"root is named {name!r}, not {root_name!r}")
    return name, source.body(kind, schema, name or "root")


def tag(value: Any, schema: Any = None) -> Tag:
    """A Tag from plain Python: ints are as wide as the schema says, else int or long; floats double."""
    if isinstance(value, Tag):
        want = kind_of(schema)
        return Tag(want, value.value) if want in NUMBERS and value.kind in NUMBERS else value
    want = kind_of(schema)
    if isinstance(value, (bool, int)):
        kind = want if want in NUMBERS else BYTE if isinstance(value, bool) else INT if -(1 << 31) <= value < 1 << 31 else LONG
        return Tag(kind, float(value) if kind in (FLOAT, DOUBLE) else int(value))
    if isinstance(value, float):
        kind = want if want in NUMBERS else DOUBLE
        return Tag(kind, value if kind in (FLOAT, DOUBLE) else int(value))
    if isinstance(value, (bytes, bytearray)):
        return Tag(BYTES, bytes(value))
    if isinstance(value, str):
        return Tag(STRING, value)
    if isinstance(value, dict):
        return Tag(COMPOUND, {k: tag(v, (schema or {}).get(k)) for k, v in value.items()})
    if isinstance(value, (list, tuple)):
        if want == INTS:
            return Tag(INTS, [int(v) for v in value])
        sub = schema[0] if schema else None
        own = [tag(v, sub) for v in value]
        return Tag(LIST, own, own[0].kind if own else (kind_of(sub) or END))
    raise NBTError(f"no tag for {type(value).__name__}")


def plain(t: Tag) -> Any:
    """Python values without widths."""
    if t.kind == COMPOUND:
        return {k: plain(v) for k, v in t.value.items()}
    if t.kind == LIST:
        return [plain(v) for v in t.value]
    return t.value


def _body(t: Tag, path: str) -> bytes:
    try:
        if t.kind in _CODE:
            return _STRUCT[_CODE[t.kind]].pack(t.value)
    except struct.error:
        raise NBTError(f"{path}: {t.value} does not fit {NAMES[t.kind]}") from None
    if t.kind == BYTES:
        return struct.pack(">i", len(t.value)) + t.value
    if t.kind == STRING:
        return _text(t.value, path)
    if t.kind == INTS:
        return struct.pack(f">i{len(t.value)}i", len(t.value), *t.value)
    if t.kind == LIST:
        item = t.item or (t.value[0].kind if t.value else END)
        for i, v in enumerate(t.value):
            if v.kind != item:
                raise NBTError(f"{path}[{i}]: {NAMES[v.kind]} in a list of {NAMES[item]}")
        return struct.pack(">Bi", item, len(t.value)) + b"".join(_body(v, f"{path}[{i}]") for i, v in enumerate(t.value))
    if t.kind == COMPOUND:
        return b"".join(struct.pack(">B", v.kind) + _text(k, path) + _body(v, f"{path}.{k}") for k, v in t.value.items()) + b"\0"
    raise NBTError(f"{path}: cannot write type {t.kind}")


def _text(s: str, path: str) -> bytes:
    raw = s.encode("utf-8")
    if len(raw) > LONGEST:
        raise NBTError(f"{path}: text of {len(raw)} bytes")
    return struct.pack(">H", len(raw)) + raw


def dumps(name: str, value: Any, schema: Any = None, fragments: bool = False, compression: str = "gzip") -> bytes:
    """Bytes of a root; plain values are tagged first, numbers take the schema's widths."""
    t = _widths(tag(value, schema), schema)
    if t.kind != COMPOUND and not fragments:
        raise NBTError("root is no compound")
    return deflate(struct.pack(">B", t.kind) + _text(name, "root") + _body(t, name or "root"), compression)


def _widths(t: Tag, schema: Any) -> Tag:
    if schema is None or not fits(t.kind, schema):
        return t
    if t.kind == COMPOUND:
        return Tag(COMPOUND, {k: _widths(v, schema.get(k)) for k, v in t.value.items()})
    if t.kind == LIST and schema:
        own = [_widths(v, schema[0]) for v in t.value]
        return Tag(LIST, own, own[0].kind if own else t.item)
    return tag(t, schema) if t.kind in NUMBERS else t


def is_valid(value: Any) -> bool:
    """Whether the value can be written."""
    try:
        dumps("", value, fragments=True, compression="none")
        return True
    except NBTError:
        return False


NODE_SCHEMA = (
    "doc string, node_id int, parent_id int, depth int, ordinal int, name string, path string, tag_type int, element_type int, "
    "long_val bigint, double_val double, string_val string, bytes_val binary, child_count int"
)
_NODE_KIND = pa.schema(
    [("doc", pa.string()), *[(c, pa.int32()) for c in ("node_id", "parent_id", "depth", "ordinal")], ("name", pa.string()), ("path", pa.string()), ("tag_type", pa.int32()), ("element_type", pa.int32())]
    + [("long_val", pa.int64()), ("double_val", pa.float64()), ("string_val", pa.string()), ("bytes_val", pa.binary()), ("child_count", pa.int32())]
)


def _node_values(doc: str, name: str, root: Tag) -> list[tuple]:
    """One tuple for each value in the order of ``NODE_SCHEMA``, parents first; compounds' children in their order."""
    out: list[tuple] = []
    todo = [(None, 0, 0, name, name or "root", root)]
    while todo:
        parent, depth, ordinal, label, path, (kind, value, item) = todo.pop()
        number, count = len(out), 0
        element = whole = real = text = raw = None
        if kind == COMPOUND:
            count = len(value)
            todo += reversed([(number, depth + 1, i, k, f"{path}.{k}", v) for i, (k, v) in enumerate(value.items())])
        elif kind == LIST:
            element, count = item, len(value)
            todo += reversed([(number, depth + 1, i, None, f"{path}[{i}]", v) for i, v in enumerate(value)])
        elif kind == STRING:
            text = value
        elif kind in (FLOAT, DOUBLE):
            real = float(value)
        elif kind in NUMBERS:
            whole = value
        elif kind == BYTES:
            raw = value
        elif kind == INTS:
            raw, count = struct.pack(f">{len(value)}i", *value), len(value)
        out.append((doc, number, parent, depth, ordinal, label, path, kind, element, whole, real, text, raw, count))
    return out


def node_rows(doc: str, name: str, root: Tag) -> list[dict]:
    """One row for each value, parents first; compounds' children in their order."""
    return [dict(zip(_NODE_KIND.names, r)) for r in _node_values(doc, name, root)]


def from_node_rows(rows: list[dict]) -> tuple[str, Tag]:
    """The root that ``node_rows`` came from; numbers are cast by their tag, list items to the element type."""
    kids: dict[int | None, list[dict]] = {}
    for r in sorted(rows, key=lambda r: (r["parent_id"] is not None, r["parent_id"] or 0, r["ordinal"])):
        kids.setdefault(r["parent_id"], []).append(r)

    def build(r: dict, kind: int) -> Tag:
        if kind in (FLOAT, DOUBLE):
            v = r["double_val"] if r["double_val"] is not None else r["long_val"]
            return Tag(kind, float(v or 0))
        if kind in NUMBERS:
            v = r["long_val"] if r["long_val"] is not None else r["double_val"]
            return Tag(kind, int(v or 0))
        if kind == STRING:
            return Tag(kind, r["string_val"] or "")
        if kind == BYTES:
            return Tag(kind, bytes(r["bytes_val"] or b""))
        if kind == INTS:
            raw = bytes(r["bytes_val"] or b"")
            return Tag(kind, list(struct.unpack(f">{len(raw) // 4}i", raw)))
        own = kids.get(r["node_id"], [])
        if kind == LIST:
            item = r["element_type"] or (own[0]["tag_type"] if own else END)
            return Tag(kind, [build(c, item) for c in own], item)
        return Tag(kind, {c["name"]: build(c, c["tag_type"]) for c in own})

    (root,) = kids[None]
    return root["name"] or "", build(root, root["tag_type"])


def nodes(files: DataFrame, doc: str = "path", content: str = "content", root_name: str | None = None, fragments: bool = False, compression: str = "auto", permissive: bool = False, ordered: bool = False) -> DataFrame:
    """The node table of binary rows, such as ``spark.read.format("binaryFile")`` gives.

    ``ordered`` sorts the keys of compounds, without regard to case.

    Bytes that cannot be read raise, or with ``permissive`` give one row without
    a tag_type whose string_val says why.  Null contents give no rows.
    Small documents share a batch.
    """

    def batched(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _NODE_KIND)], schema=_NODE_KIND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for d, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not raw.is_valid:
                    continue
                try:
                    data = inflate(raw.as_py(), compression)
                    name, root = loads(data, root_name, None, fragments, "none")
                    own = _node_values(d, name, sorted_compounds(root) if ordered else root)
                except NBTError as e:
                    if not permissive:
                        raise
                    data, own = b"", [(d, 0, None, 0, 0, None, None, None, None, None, None, str(e), None, 0)]
                if rows and (len(rows) + len(own) > BATCH_ROWS or size + len(data) > BATCH_BYTES):
                    yield batched(rows)
                    rows, size = [], 0
                if len(own) > BATCH_ROWS:
                    for i in range(0, len(own), BATCH_ROWS):
                        yield batched(own[i : i + BATCH_ROWS])
                else:
                    rows += own
                    size += len(data)
        if rows:
            yield batched(rows)

    return files.select(F.col(doc).cast("string"), F.col(content).cast("binary")).mapInArrow(run, NODE_SCHEMA)


def _values(c: pa.Array) -> list:
    """``to_pylist`` of numbers, texts or bytes by way of numpy, which takes a tenth of the time."""
    if c.null_count == len(c):
        return [None] * len(c)
    if not c.null_count or not pa.types.is_primitive(c.type):
        return c.to_numpy(zero_copy_only=False).tolist()
    out = c.fill_null(0).to_numpy(zero_copy_only=False).astype(object)
    out[c.is_null().to_numpy(zero_copy_only=False)] = None
    return out.tolist()


_ENCODED = ("doc", "node_id", "parent_id", "ordinal", "name", "tag_type", "element_type", "long_val", "double_val", "string_val", "bytes_val")


def encoded(table: DataFrame, compression: str = "gzip") -> DataFrame:
    """doc, content: each document of a node table as bytes; a document is one task's work.

    A task gets the rows of its documents one document after the other, so small
    ones do not cost a call each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, raw, size = [], [], 0
        own: list[dict] = []

        def close() -> int:
            name, root = from_node_rows(own)
            docs.append(own[0]["doc"])
            raw.append(dumps(name, root, fragments=True, compression=compression))
            return len(raw[-1])

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), pa.array(raw, pa.binary())], names=["doc", "content"])

        for batch in batches:
            for r in zip(*map(_values, batch.columns)):
                if own and own[0]["doc"] != r[0]:
                    size += close()
                    own = []
                    if len(docs) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield given()
                        docs, raw, size = [], [], 0
                own.append(dict(zip(_ENCODED, r)))
        if own:
            close()
            yield given()

    dealt = table.select(F.col("doc").cast("string"), *_ENCODED[1:]).repartition("doc").sortWithinPartitions("doc")
    return dealt.mapInArrow(run, "doc string, content binary")


def preview(c: Column, longest: int = 100, shown: int = 95) -> Column:
    """Texts over 100 characters are cut to 95 and three dots."""
    return F.when(F.length(c) > longest, F.concat(F.substring(c, 1, shown), F.lit("..."))).otherwise(c)


def tag_name(kind: Column) -> Column:
    """The word for a tag number; null for unknown ones."""
    return F.try_element_at(F.array(*map(F.lit, NAMES)), kind + 1)


def tree_text(table: DataFrame) -> DataFrame:
    """doc, node_id, line: each node as an indented line of type, name and value or number of children."""
    kind = F.col("tag_type")
    value = F.coalesce(
        F.when(kind.isin(LIST, COMPOUND, INTS), F.concat(F.lit("("), F.col("child_count").cast("string"), F.lit(" entries)"))),
        F.col("long_val").cast("string"),
        F.col("double_val").cast("string"),
        F.concat(F.lit('"'), preview(F.col("string_val")), F.lit('"')),
        F.concat(F.octet_length("bytes_val").cast("string"), F.lit(" bytes")),
        F.lit(""),
    )
    label = F.coalesce(F.concat(F.lit(" "), F.col("name")), F.lit(""))
    return table.select("doc", "node_id", F.concat(F.repeat(F.lit("\t"), F.col("depth")), tag_name(kind), label, F.lit(": "), value).alias("line"))


def insert_node(table: DataFrame, doc: str, parent: int, name: str | None, value: Any) -> DataFrame:
    """The table with a value added at the end of a compound or list of one document; ids go on from its greatest."""
    own = table.where(F.col("doc") == doc)
    last, p = own.agg(F.max("node_id"), F.first(F.when(F.col("node_id") == parent, F.struct("tag_type", "element_type", "path", "child_count", "depth")), ignorenulls=True)).first()
    if p is None or p["tag_type"] not in (LIST, COMPOUND):
        raise NBTError("values go into a list or compound")
    t = tag(value)
    if p["tag_type"] == LIST and p["element_type"] in NUMBERS and t.kind in NUMBERS:
        t = tag(t, NAMES[p["element_type"]])  # numbers take the list's type
    path = f"{p['path']}.{name}" if p["tag_type"] == COMPOUND else f"{p['path']}[{p['child_count']}]"
    rows = node_rows(doc, name if p["tag_type"] == COMPOUND else None, t)
    for r in rows:
        top = r["parent_id"] is None
        r |= {"node_id": r["node_id"] + last + 1, "parent_id": parent if top else r["parent_id"] + last + 1, "depth": r["depth"] + p["depth"] + 1, "ordinal": p["child_count"] if top else r["ordinal"]}
        r["path"] = path + r["path"][len(name or "root") :]
    grown = table.withColumn("child_count", F.when((F.col("doc") == doc) & (F.col("node_id") == parent), F.col("child_count") + 1).otherwise(F.col("child_count")))
    return grown.unionByName(table.sparkSession.createDataFrame([tuple(r[c] for c in _NODE_KIND.names) for r in rows], NODE_SCHEMA))


def _below(kids: dict[int | None, list[int]], *top: int) -> set[int]:
    """Nodes' numbers and those of all under them."""
    found, todo = set(), list(top)
    while todo:
        n = todo.pop()
        found.add(n)
        todo += kids.get(n, [])
    return found


def remove_node(table: DataFrame, doc: str, node: int) -> DataFrame:
    """The table without a node and what is below it; the root stays.

    The parent counts one child less, and what follows in it moves up; in a list
    the paths of those change with their places.
    """
    # One document is one task's work, so its numbers fit the driver; the table is gone through once for them.
    own = table.where(F.col("doc") == doc).select("node_id", "parent_id", "ordinal", F.when(F.col("tag_type") == LIST, F.col("path")).alias("list"))
    rows = {r["node_id"]: r for r in own.toArrow().to_pylist()}
    target = rows.get(node)
    if target is None or target["parent_id"] is None:
        raise NBTError("the root cannot be removed")
    here, parent = F.col("doc") == doc, target["parent_id"]
    kids: dict[int | None, list[int]] = {}
    for n, r in rows.items():
        kids.setdefault(r["parent_id"], []).append(n)
    out = table.where(~(here & F.col("node_id").isin(*_below(kids, node))))
    path, at = F.col("path"), rows[parent]["list"]
    later = [n for n in kids[parent] if rows[n]["ordinal"] > target["ordinal"]]
    if at is not None and later:
        rest = F.substring("path", len(at) + 2, 1 << 30)
        place = F.regexp_extract(rest, r"^\d+", 0)
        moved = F.concat(F.lit(f"{at}["), (place.cast("int") - 1).cast("string"), F.substr(rest, F.length(place) + 1))
        path = F.when(F.col("node_id").isin(*_below(kids, *later)), moved).otherwise(path)
    return out.withColumns(
        {
            "child_count": F.when(here & (F.col("node_id") == parent), F.col("child_count") - 1).otherwise(F.col("child_count")),
            "ordinal": F.when(here & (F.col("parent_id") == parent) & (F.col("ordinal") > target["ordinal"]), F.col("ordinal") - 1).otherwise(F.col("ordinal")),
            "path": F.when(here, path).otherwise(F.col("path")),
        }
    )


def sorted_compounds(t: Tag) -> Tag:
    """The value with the keys of every compound in order without regard to case, as the tree view shows them."""
    if t.kind == COMPOUND:
        return Tag(COMPOUND, {k: sorted_compounds(t.value[k]) for k in sorted(t.value, key=lambda k: (k.lower(), k))})
    return Tag(LIST, [sorted_compounds(v) for v in t.value], t.item) if t.kind == LIST else t


def in_list() -> Column:
    """Whether a node of the table is a list's item."""
    return F.col("name").isNull() & F.col("parent_id").isNotNull()


def display_name() -> Column:
    """What the tree view calls a node: its place for a list's item, else its name."""
    return F.when(in_list(), F.col("ordinal").cast("string")).otherwise(F.coalesce("name", F.lit("")))


def name_editable() -> Column:
    """Whether a node has a name of its own to change, which a list's item has not."""
    return ~in_list()
