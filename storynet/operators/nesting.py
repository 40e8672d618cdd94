"""JSON documents as rows of paths, and back: flattening, nesting, three-way overlay, and taking protected keys out.

A path is a JSON pointer whose array positions are written ``#n``, so that an array and an object with numbers as keys
stay apart; in keys ``~``, ``/`` and a leading ``#`` are ``~0``, ``~1`` and ``~2``. Values are JSON text. ``nest`` of
``flatten`` gives the document back. The rows of a document are dealt out together and sorted; overlay and quarantine deal
out whole documents. A task holds one batch of rows and the documents of one key at a time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storynet.functions.shared import spread

#: Keys that place or identify an entity, and endings of such keys.
PROTECTED = ("id", "entity_id", "entity_key", "formal_id", "schema_version", "primary_name", "aliases")
PROTECTED_ENDS = ("_id", "_ref", "_refs", "_key", "_keys")
#: Fixed value: what an overlay never touches where the current document has it.
MANAGED = "entity_management"


def escape(key: str) -> str:
    key = key.replace("~", "~0").replace("/", "~1")
    return f"~2{key[1:]}" if key.startswith("#") else key


def _key(part: str) -> str | int:
    return int(part[1:]) if part.startswith("#") else part.replace("~2", "#").replace("~1", "/").replace("~0", "~")


def _walk(value, arrays: bool, path: str = "") -> Iterator[tuple[str, str, str]]:
    """Rows of a value: leaves, and each object or array that is looked into as an empty one."""
    inner = value.items() if isinstance(value, dict) else enumerate(value) if arrays and isinstance(value, list) else None
    if inner is None:
        kind = {bool: "boolean", int: "integer", float: "number", str: "string", list: "array"}.get(type(value), "null")
        yield path, kind, text(value)
        return
    yield path, *(("object", "{}") if isinstance(value, dict) else ("array", "[]"))
    for k, v in inner:
        yield from _walk(v, arrays, f"{path}/{escape(k) if isinstance(k, str) else f'#{k}'}")


def flatten(docs: DataFrame, keys: tuple[str, ...] = ("entity_id",), arrays: bool = False) -> DataFrame:
    """``docs``(keys, data as JSON text) to keys, path, kind, value: a row for each leaf and each object (as ``{}``).

    An array is one value, or with ``arrays`` it is looked into as well. Malformed text gives one row of kind invalid, null none.
    """

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for *key, data in zip(*(b.column(c).to_pylist() for c in (*keys, "data")), strict=True):
                if data is None:
                    continue
                try:
                    rows = list(_walk(json.loads(data), arrays))
                except ValueError:
                    rows = [("", "invalid", data)]
                out += [(*key, *r) for r in rows]
            yield _batch(out, [*keys, "path", "kind", "value"])

    text = docs.select(*[F.col(k).cast("string").alias(k) for k in keys], "data")
    return text.mapInArrow(scan, ", ".join(f"{c} string" for c in (*keys, "path", "kind", "value")))


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names)


def put(root, path: str, value):
    """``root`` with ``value`` at ``path``. An empty object leaves an object as it is, and an empty array an array in parts; what else stands in the way is replaced."""
    parts = [_key(p) for p in path.split("/")[1:]]
    if not parts:
        return root if value == {} and isinstance(root, dict) else _open(value)
    node = root = root if isinstance(root, dict) else {}
    for k in parts[:-1]:
        node[k] = node = node[k] if isinstance(node.get(k), dict) else {}
    last = parts[-1]
    if not (value in ({}, []) and isinstance(node.get(last), dict) and _is_list(node[last]) == (value == [])):
        node[last] = _open(value)
    return root


class Parts(dict):
    """An array while its parts are put together, by position."""


def _open(value):
    return Parts() if value == [] and isinstance(value, list) else value


def _is_list(node: dict) -> bool:
    return isinstance(node, Parts) or bool(node) and all(isinstance(k, int) for k in node)


def close(node):
    """The document of nodes: numbered ones are arrays in order of their numbers, gaps closed."""
    if not isinstance(node, dict):
        return node
    return [close(node[k]) for k in sorted(node)] if _is_list(node) else {k: close(v) for k, v in node.items()}


_ENCODER = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def text(value) -> str:
    return _ENCODER.encode(value)


def _fold(rows: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...], fold: Callable[[list[tuple]], Iterable[tuple]], made: tuple[str, ...] = ("data",)) -> DataFrame:
    """keys and ``made`` for what ``fold`` makes of each document's rows, sorted by their columns, paths with parents first."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in (*keys, *columns)), strict=True):
                key, rest = row[: len(keys)], row[len(keys) :]
                if held is None or held[0] != key:
                    if held:
                        out += [(*held[0], *d) for d in fold(held[1])]
                    held = (key, [])
                held[1].append(rest)
            yield _batch(out, [*keys, *made])
            out = []
        if held:
            yield _batch([(*held[0], *d) for d in fold(held[1])], [*keys, *made])

    order = [F.split("path", "/") if c == "path" else F.col(c) for c in columns if c != "data"]
    dealt = spread(rows, *keys).sortWithinPartitions(*keys, *order)
    return dealt.select(*keys, *columns).mapInArrow(scan, ", ".join(f"{c} string" for c in (*keys, *made)))


def nest(rows: DataFrame, keys: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    """``rows``(keys, path, value) to keys, data: one document with sorted keys for each. Of rows with one path the greatest value counts; under a value that is no object, later paths replace it."""

    def fold(found: list[tuple]) -> Iterable[str]:
        root = None
        for path, value in found:
            root = put(root, path, json.loads(value))
        yield (text(close(root)),)

    return _fold(rows, keys, ("path", "value"), fold)


def overlay_documents(current: DataFrame, base: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    """Three-way merge of documents (keys, data): keys, data.

    What the projection ``new`` changed against the one before (``base``) goes over ``current``: objects key by key, arrays and
    scalars whole. What only ``current`` has, and what the projection dropped, stays; entity_management stays wherever
    ``current`` has it. A value that both projections share and ``current`` lacks was taken out by hand and stays out.
    Documents of one side only pass through; a document that only ``base`` has is none.
    """
    sides = [df.select(*[F.col(k).cast("string").alias(k) for k in keys], "data", F.lit(n).alias("side")) for n, df in enumerate((current, base, new))]

    def fold(found: list[tuple]) -> Iterable[tuple[str]]:
        now, old, fresh = by_side = ({}, {}, {})
        for data, side in found:
            for path, _, value in _rows(data, False):
                by_side[side][path] = max(value, by_side[side].get(path, ""))
        root = None
        differ = {p for p in old.keys() | fresh.keys() if not now or old.get(p) != fresh.get(p)}
        within = {p[:i] for p in differ for i, c in enumerate(p) if c == "/"}  # objects in which something changed
        for path, _ in _sorted(now):
            root = put(root, path, json.loads(now[path]))
        for path, parts in _sorted(fresh):
            kept = any(p == MANAGED and "/".join(parts[: i + 1]) in now for i, p in enumerate(parts))
            if not kept and (path in differ or path in within and fresh[path] == "{}"):
                root = put(root, path, json.loads(fresh[path]))
        if now or fresh:
            yield (text(close(root)),)

    return _fold(sides[0].unionByName(sides[1]).unionByName(sides[2]), keys, ("data", "side"), fold)


def _rows(data: str | None, arrays: bool) -> list[tuple[str, str, str]]:
    """path, kind and value of a document, none of one that is null or malformed."""
    try:
        return [] if data is None else list(_walk(json.loads(data), arrays))
    except ValueError:
        return []


def _sorted(paths: Iterable[str]) -> list[tuple[str, list[str]]]:
    """Paths and their parts, parents first."""
    return sorted(((p, p.split("/")) for p in paths), key=lambda x: x[1])


_HIT = re.compile(f"(?:{'|'.join(PROTECTED_ENDS)})(?:\r\n|[\n\r\u0085\u2028\u2029])?\\Z")


def _first_protected(parts: list[str]) -> int:
    """Position of the first protected key of a path's parts, 0 if there is none."""
    for i, p in enumerate(parts, 1):
        name = p.strip(" ").lower()
        if not p.startswith("#") and (name in PROTECTED or _HIT.search(name)):
            return i
    return 0


def quarantine(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs``(entity_id, data) without the keys that identify or refer, at any depth and in arrays too; and what was taken out: entity_id, path, data."""

    def parted(found: list[tuple]) -> Iterable[tuple[str, list[str], str, int]]:
        values: dict[str, str] = {}
        for (data,) in found:
            for path, _, value in _rows(data, True):
                values[path] = max(value, values.get(path, ""))
        return ((path, parts, values[path], _first_protected(parts)) for path, parts in _sorted(values))

    def safe(found: list[tuple]) -> Iterable[tuple[str]]:
        root, any_ = None, False
        for path, _, value, at in parted(found):
            if not at:
                root, any_ = put(root, path, json.loads(value)), True
        if any_:
            yield (text(close(root)),)

    def blocked(found: list[tuple]) -> Iterable[tuple[str, str]]:
        roots: dict[str, object] = {}
        for path, parts, value, at in parted(found):
            if at:
                prefix = "/".join(parts[:at])
                roots[prefix] = put(roots.get(prefix), path[len(prefix) :], json.loads(value))
        return ((prefix, text(close(root))) for prefix, root in roots.items())

    rows = docs.select(F.col("entity_id").cast("string").alias("entity_id"), "data")
    return _fold(rows, ("entity_id",), ("data",), safe), _fold(rows, ("entity_id",), ("data",), blocked, ("path", "data"))
