"""Nested JSON documents: a row for every object in them, and stable keys for objects in lists.

Spark has no recursive explode, so an Arrow task walks each document with a stack of its own.
A row carries what rules by type need: the object's place and types and, for each member,
its kind and scalar text, or the size and kind of a list. Rules are then plain expressions
over these rows, and links between objects are joins on (document, path).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: kind: string, number, boolean, null, array or object. text: of a scalar, or an object's string ``_ref``.
#: type: an object's ``_type``. count: of an object's members. size, items, blanks, texts: of a list, its length, the one kind of its items, how many are blank texts, and its texts.
MEMBER = "struct<kind: string, text: string, type: string, size: int, items: string, blanks: int, texts: array<string>>"
NODE = f"path string, place string, root_type string, parent string, pos int, seq int, depth int, type string, types array<string>, node_key string, count int, members map<string, {MEMBER}>"

_MEMBER = pa.struct([("kind", pa.string()), ("text", pa.string()), ("type", pa.string()), ("size", pa.int32()), ("items", pa.string()), ("blanks", pa.int32()), ("texts", pa.list_(pa.string()))])
_NODE = [("path", pa.string()), ("place", pa.string()), ("root_type", pa.string()), ("parent", pa.string()), ("pos", pa.int32()), ("seq", pa.int32()), ("depth", pa.int32()), ("type", pa.string()), ("types", pa.list_(pa.string())), ("node_key", pa.string()), ("count", pa.int32()), ("members", pa.map_(pa.string(), _MEMBER))]

#: Rows of a batch that a task sends.
ROWS = 4096


class Number(str):
    """A number as it stands in the document."""


def _no_constant(name: str) -> None:
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=_no_constant)


def parsed(text: str):
    """A JSON value with numbers as they stand; ValueError for anything else, depth beyond the interpreter's included."""
    if text.startswith("\ufeff"):
        raise ValueError("byte order mark")
    try:
        return _DECODER.decode(text)
    except RecursionError as e:
        raise ValueError("too deep") from e


def _kind(value) -> str:
    if isinstance(value, Number):
        return "number"
    if isinstance(value, bool):
        return "boolean"
    return {str: "string", dict: "object", list: "array", type(None): "null"}[type(value)]


def _text(value) -> str | None:
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value) if isinstance(value, str) else None


def _plain(value) -> str | None:
    return str(value) if type(value) is str else None


def _member(value) -> tuple:
    """The fields of ``MEMBER``."""
    if type(value) is str:
        return "string", value, None, None, None, None, None
    if type(value) is Number:
        return "number", str(value), None, None, None, None, None
    if isinstance(value, dict):
        return "object", _plain(value.get("_ref")), _plain(value.get("_type")), None, None, None, None
    if isinstance(value, list):
        kinds = {_kind(x) for x in value}
        items = kinds.pop() if len(kinds) == 1 else "mixed" if kinds else None
        return "array", None, None, len(value), items, sum(type(x) is str and not x.strip() for x in value), [x for x in value if type(x) is str]
    return _kind(value), _text(value), None, None, None, None, None


def _structs(parts: Iterable[tuple], missing: np.ndarray | None = None) -> pa.StructArray:
    """Members of Arrow, of the columns of ``_member``; null where ``missing``."""
    return pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(parts, _MEMBER, strict=True)], fields=list(_MEMBER), mask=None if missing is None else pa.array(missing))


def array_key(doc: str, path: str, pos: int) -> str:
    """The stable key of an object in the list at ``path``."""
    return hashlib.sha1(f"{doc}:{path}:{pos}".encode()).hexdigest()[:12]


def within(scopes: Iterable[tuple[str | None, str | None, str | None]]) -> Callable[[str | None, str, str | None], bool]:
    """Whether an object of (root_type, place, type) is in one of the scopes; null in a scope is anything."""
    found = set(scopes)
    masks = {tuple(x is not None for x in s) for s in found}
    return lambda of, where, kind: any((of if a else None, where if b else None, kind if c else None) in found and not (a and of is None or c and kind is None) for a, b, c in masks)


def objects(root) -> Iterator[tuple]:
    """(object, path, place, parent, pos, depth) of every object of a parsed value, parents first and in order; pos is its place in a list, else null."""
    stack = [(root, "", "", None, None, 0)]
    while stack:
        value, path, where, parent, pos, depth = stack.pop()
        if isinstance(value, list):
            if any(isinstance(x, (dict, list)) for x in value):
                stack += [(x, f"{path}[{k}]", f"{where}[]", parent if parent is not None else path, k, depth + 1) for k, x in reversed(list(enumerate(value))) if isinstance(x, (dict, list))]
        elif isinstance(value, dict):
            yield value, path, where, parent, pos, depth
            stack += [(v, f"{path}.{k}" if path else k, f"{where}.{k}" if where else k, path, None, depth + 1) for k, v in reversed(value.items()) if isinstance(v, (dict, list))]


def walk(root, doc: str = "", wanted: Callable[[str | None, str, str | None], bool] | None = None, names: frozenset[str] | None = None, keys: bool = True) -> Iterator[tuple]:
    """The fields of ``NODE`` of every object of a parsed value, parents first and in order.

    Only objects that are ``wanted`` and members of ``names``, if given; node_key is null without ``keys``.
    """
    root_type = _plain(root.get("_type")) if isinstance(root, dict) else None
    for seq, (value, path, where, parent, pos, depth) in enumerate(objects(root)):
        kind, named = _plain(value.get("_type")), value.get("@type")
        if wanted is None or wanted(root_type, where, kind):
            key = None
            if keys and pos is not None:
                key = _plain(value.get("_key"))
                key = array_key(doc, path.rpartition("[")[0], pos) if key is None else key
            types = [str(t) for t in (named if isinstance(named, list) else [named]) if type(t) is str]
            yield path, where, root_type, parent, pos, seq, depth, kind, types, key, len(value), [(k, *_member(v)) for k, v in value.items() if names is None or k in names]


def json_walk(df: DataFrame, column: str, doc: Column | None = None, scopes: Iterable[tuple[str | None, str | None, str | None]] | None = None, names: Iterable[str] | None = None, fields: Iterable[str] | None = None) -> DataFrame:
    """The rows of ``df`` without ``column``, once for every object in it, with the columns of ``NODE``.

    Paths read ``a.b[2].c``, places ``a.b[].c``; the root's are empty. ``parent`` is the object around an object,
    through any lists, ``seq`` counts a document's objects from 0. ``doc`` names a document in the keys of list items; they stay as they
    are where an item has a ``_key``. A null gives no row, a text that isn't JSON one with a
    null path, a scalar or a list without objects none.

    What is read of the objects can be narrowed: to those in ``scopes`` (root_type, place, type; null
    is anything), to members of ``names``, to the columns of ``fields``. Texts that aren't JSON stay.
    """
    wanted, names = None if scopes is None else within(scopes), None if names is None else frozenset(names)
    fields = [c for c, _ in _NODE] if fields is None else [c for c, _ in _NODE if c in set(fields)]
    kinds = [(k, c, t) for k, (c, t) in enumerate(_NODE) if c in fields and c != "members"]
    kept = [c for c in df.columns if c != column]
    clash = {c.lower() for c in kept} & {f.name for f in StructType.fromDDL(NODE).fields}
    if clash:
        raise ValueError(f"columns of the walk are taken: {sorted(clash)}")
    short = [f"_{k}" for k in range(len(kept))]
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, short, strict=True)], (F.lit("") if doc is None else F.coalesce(doc.cast("string"), F.lit(""))).alias("_doc"), F.col(f"`{column}`").alias("_json"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            nodes: list[tuple] = []
            docs, texts = batch.columns[-2:]

            def send() -> pa.RecordBatch:
                columns = [batch.column(k).take(pa.array(at, pa.int32())) for k in range(len(short))]
                *plain, members = zip(*nodes, strict=True)
                columns += [pa.array(plain[k], t) for k, _, t in kinds]
                if "members" not in fields:
                    return pa.RecordBatch.from_arrays(columns, [*short, *fields])
                keys, *parts = zip(*[m for some in members if some for m in some], strict=True) if any(members) else [()] * 8
                ends = np.cumsum([0, *[len(m or ()) for m in members]])
                offsets = pa.array(ends.astype(np.int32), mask=np.array([*[m is None for m in members], False]))
                columns.append(pa.MapArray.from_arrays(offsets, pa.array(keys, pa.string()), _structs(parts)))
                return pa.RecordBatch.from_arrays(columns, [*short, *fields])

            for k in range(batch.num_rows):
                text = texts[k].as_py()
                if text is None:
                    continue
                try:
                    found = walk(parsed(text), docs[k].as_py(), wanted, names, "node_key" in fields)
                except ValueError:
                    found = iter([(None,) * len(_NODE)])
                for node in found:
                    at.append(k)
                    nodes.append(node)
                    if len(nodes) >= ROWS:
                        yield send()
                        at, nodes = [], []
            if nodes:
                yield send()

    schema = StructType([f for f in rows.schema.fields if f.name in short] + [f for f in StructType.fromDDL(NODE).fields if f.name in fields])
    return rows.mapInArrow(run, schema).withColumnsRenamed(dict(zip(short, kept, strict=True)))


class ABSENT:
    """What stands for a member that an object doesn't have; a class, as tasks know it by name."""


def only(value: object) -> bool:
    """Stands for a test of ``json_doubts`` that looks at several objects."""
    return value is ABSENT


#: Places of documents, and texts that a test has cleared, that a task remembers.
PLACES, CLEARED = 1 << 14, 256


def _path(link: tuple | None) -> str:
    """The path of an object, from (that of the object or list around it, its name or place there)."""
    steps = []
    while link is not None:
        link, step = link
        steps.append(f"[{step}]" if type(step) is int else f".{step}")
    return "".join(reversed(steps)).removeprefix(".")


def json_doubts(df: DataFrame, column: str, doc: Column, rules: Iterable[tuple[str | None, str | None, str | None, str, Callable[[], Callable[[object], bool]]]]) -> DataFrame:
    """(key, path, rule, member) of the members of objects that a rule may not clear, by their document ``doc``, the key.

    A rule is (root_type, place, type, member, what makes its test): it looks at the member of the objects in its scope, null being
    anything. ``rule`` is its number; the member is null if the object has none; path is the object's. Only what a test doesn't clear
    leaves the task; ``only`` doesn't clear texts that an earlier object at the same place of the document has. A text that isn't
    JSON gives one row with a null rule.

    A place is looked up once an object, in a tree that grows with the places seen; paths are written for doubts alone.
    """
    rules = list(rules)
    rows = df.select(doc.cast("string").alias("key"), F.col(f"`{column}`").alias("_json"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = [make() for *_, make in rules]
        known: list[set[str]] = [set() for _ in rules]
        # By type of document the root's place: (its name, tests by type of object, places of members, that of items).
        roots: dict[str | None, tuple] = {}
        places = 0

        def of(scope: tuple) -> tuple[dict[str, list[tuple]], list[tuple]]:
            """The tests of each member, and those that miss a member that isn't there."""
            by_name: dict[str, list[tuple]] = {}
            here = [n for n, r in enumerate(rules) if all(want is None or want == have for want, have in zip(r[:3], scope, strict=True))]
            for n in here:
                by_name.setdefault(rules[n][3], []).append((n, tests[n], known[n]))
            return by_name, [(rules[n][3], n) for n in here if not tests[n](ABSENT)]

        def send(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
            at, paths, numbers, members = zip(*found, strict=True)
            parts = zip(*[(None,) * len(_MEMBER) if m is ABSENT else _member(m) for m in members], strict=True)
            missing = np.array([m is ABSENT for m in members])
            columns = [batch.column(0).take(pa.array(at, pa.int32())), pa.array(paths, pa.string()), pa.array(numbers, pa.int32()), _structs(parts, missing)]
            return pa.RecordBatch.from_arrays(columns, ["key", "path", "rule", "member"])

        for batch in batches:
            found: list[tuple] = []
            for k, text in enumerate(batch.column(1).to_pylist()):
                if text is None:
                    continue
                try:
                    root = parsed(text)
                except ValueError:
                    found.append((k, None, None, ABSENT))
                    continue
                if places > PLACES:  # they may be many; what isn't kept is found again
                    roots, places = {}, 0
                root_type = _plain(root.get("_type")) if type(root) is dict else None
                if (place := roots.get(root_type)) is None:
                    place = roots[root_type] = ("", {}, {}, [])
                    places += 1
                once: dict[tuple, list[tuple]] = {}
                # Breadth first: objects of one place come in the order of the document.
                todo = [(root, place, None)] if type(root) is dict or type(root) is list else []
                for value, place, link in todo:
                    where, by_type, inner, items = place
                    if type(value) is list:
                        for pos, x in enumerate(value):
                            if type(x) is dict or type(x) is list:
                                if not items:
                                    items.append((f"{where}[]", {}, {}, []))
                                    places += 1
                                todo.append((x, items[0], (link, pos)))
                        continue
                    kind = value.get("_type")
                    kind = kind if type(kind) is str else None
                    if (tests_here := by_type.get(kind)) is None:
                        tests_here = of((root_type, where, kind))
                        if len(by_type) < CLEARED:
                            by_type[kind] = tests_here
                    by_name, required = tests_here
                    for name, n in required:
                        if name not in value:
                            found.append((k, _path(link), n, ABSENT))
                    for name, x in value.items():
                        form = type(x)
                        if (some := by_name.get(name)) is not None:
                            for n, test, texts in some:
                                if form is str and x in texts:
                                    continue
                                if test is only:
                                    if (same := _member(x)[1]) is not None:
                                        once.setdefault((n, where, same), []).append((link, x))
                                elif not test(x):
                                    found.append((k, _path(link), n, x))
                                elif form is str and len(texts) < CLEARED:
                                    texts.add(x)
                        if form is list:
                            for y in x:
                                if type(y) is dict or type(y) is list:
                                    break
                            else:
                                continue
                        elif form is not dict:
                            continue
                        if (child := inner.get(name)) is None:
                            child = inner[name] = (f"{where}.{name}" if where else name, {}, {}, [])
                            places += 1
                        todo.append((x, child, (link, name)))
                for (n, _, _), same in once.items():
                    if len(same) > 1:
                        place_in = lambda s: s[0][1] if s[0] is not None and type(s[0][1]) is int else -1
                        found += [(k, _path(link), n, member) for link, member in sorted(same, key=place_in)[1:]]
                if len(found) >= ROWS:
                    yield send(batch, found)
                    found = []
            if found:
                yield send(batch, found)

    return rows.mapInArrow(run, f"key string, path string, rule int, member {MEMBER}")


def register(spark: SparkSession) -> None:
    """``json_objects(text, doc)`` for SQL: a table function with a row (path, depth, type, node_key, members) an object."""

    class JsonObjects:
        def eval(self, text, doc):
            if text is not None:
                try:
                    root = parsed(text)
                except ValueError:
                    return
                for path, _, _, _, _, _, depth, kind, _, key, _, members in walk(root, doc or ""):
                    yield path, depth, kind, key, {m[0]: m[2] for m in members}

    spark.udtf.register("json_objects", F.udtf(JsonObjects, returnType="path string, depth int, type string, node_key string, members map<string, string>"))


def keyed(text: Column, doc: Column) -> Column:
    """A document with a ``_key`` in every object of its lists, at any depth; other texts and nulls as they are."""

    def add(value, path: str, doc: str):
        todo = [(value, path)]
        while todo:
            node, at = todo.pop()
            if isinstance(node, list):
                for k, x in enumerate(node):
                    if isinstance(x, dict) and not isinstance(x.get("_key"), str):
                        x["_key"] = array_key(doc, at, k)
                    todo.append((x, f"{at}[{k}]"))
            elif isinstance(node, dict):
                todo += [(v, f"{at}.{k}" if at else k) for k, v in node.items() if isinstance(v, (dict, list))]
        return value

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, docs in batches:
            out = []
            for t, d in zip(texts.to_pylist(), docs.to_pylist(), strict=True):
                try:
                    t = None if t is None else json.dumps(add(json.loads(t, parse_constant=_no_constant), "", d or ""), ensure_ascii=False, separators=(",", ":"))
                except (ValueError, RecursionError):
                    pass
                out.append(t)
            yield pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(text, doc)

