"""Deeply nested records as related flat tables (problem 2): Merkle subtree identities.

Every child object is canonicalised and hashed bottom-up (the hash of an object covers the hashes of its children),
identical objects are stored once, and parent-child bridge rows with ordinals keep every occurrence.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.skew import salted_join

#: Keys that hold children, by their spelling without case and signs.
CHILD_KEYS = {"parameters": "parameters", "overloads": "overloads", "typefields": "type_fields"}
#: Keys an object of its own has; they tell a lone object from members keyed by their names.
OWN_KEYS = {"name", "type", "description", "optional", "default", "syntax", "returns"}
#: Columns of a typed entry that tell of its landing, not of the entry: no part of its identity.
LANDING = ("rec_id", "landed_at")
#: Kind of an entry itself, beside the kinds of children.
ROOT = "entry"
#: Rows and characters that a task gathers before it hands them on.
BATCH_ROWS, BATCH_CHARS = 20_000, 16_000_000

BRIDGE = "src_table string, row_key bigint, child_path string, parent_path string, child_kind string, ordinal int, depth int, object_id string, parent_id string, own_json string"

_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"true|false|null|NaN|-?Infinity|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_CONTROL = re.compile(r"(?<!\\)((?:\\\\)*)\\u(00[01][0-9a-f])")
_HALF = re.compile("[\ud800-\udfff]")


@functools.lru_cache(maxsize=4_096)
def _plain(key: str) -> str:
    return "".join(ch for ch in key.lower() if ch.isalpha())


def _deep(text: str):
    """The value of a JSON text nested too deeply for the library's parser, which recurses; an explicit stack here."""
    space = lambda i: _SPACE.match(text, i).end()

    def key_at(i: int) -> tuple[str, int]:
        if text[i : i + 1] != '"':
            raise ValueError("a key is due")
        key, i = scanstring(text, i + 1)
        i = space(i)
        if text[i : i + 1] != ":":
            raise ValueError("a colon is due")
        return key, space(i + 1)

    opened: list[list] = []  # [container, key of the member being read]
    i = space(0)
    while True:
        sign = text[i : i + 1]
        if sign and sign in "{[":
            i = space(i + 1)
            if text[i : i + 1] != ("}" if sign == "{" else "]"):
                key = None
                if sign == "{":
                    key, i = key_at(i)
                opened.append([{} if sign == "{" else [], key])
                continue
            value, i = ({} if sign == "{" else []), i + 1
        elif sign == '"':
            value, i = scanstring(text, i + 1)
        else:
            found = _SCALAR.match(text, i)
            if not found:
                raise ValueError("a value is due")
            value, i = json.loads(found.group()), found.end()
        while True:  # the value is whole: hand it to what holds it, and close what ends here
            i = space(i)
            if not opened:
                if i < len(text):
                    raise ValueError("text behind the value")
                return value
            holder, key = opened[-1]
            if key is None:
                holder.append(value)
            else:
                holder[key] = value
            sign = text[i : i + 1]
            if sign == ",":
                i = space(i + 1)
                if key is not None:
                    opened[-1][1], i = key_at(i)
                break
            if sign != ("]" if key is None else "}"):
                raise ValueError("a comma or an end is due")
            value, i = holder, i + 1
            opened.pop()


def loads(text: str):
    """The value of a JSON text of any depth; ValueError where it is none."""
    try:
        return json.loads(text)
    except RecursionError:
        return _deep(text)


def _opened(value):
    """A JSON text inside a string, at any number of wrappings, as its value; other strings stay."""
    while isinstance(value, str) and value.strip()[:1] in ("{", "[", '"'):
        try:
            value = loads(value)
        except ValueError:
            break
    return value


def _members(value) -> list[tuple[int, str | None, object]]:
    """(position, member name, element) of the value of a child key; nulls take a position but are no elements."""
    value = _opened(value)
    if value is None or isinstance(value, str) and not value.strip():
        return []
    if isinstance(value, dict):
        own = {_plain(k) for k in value} & (OWN_KEYS | set(CHILD_KEYS))
        if value and all(v is None or isinstance(v, dict) for v in value.values()) and not own & set(CHILD_KEYS):
            return [(i, k, v) for i, (k, v) in enumerate(value.items()) if v is not None]
        return [(0, None, value)] if value else []
    if isinstance(value, list):
        return [(i, None, v) for i, v in enumerate(value) if v is not None]
    return [(0, None, value)]


def _dumps(value) -> str:
    try:
        return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    except RecursionError:
        pass
    out, todo = [], [value]  # todo: texts to write as they are (in a tuple) and values, the next one last
    while todo:
        at = todo.pop()
        if isinstance(at, tuple):
            out.append(at[0])
        elif at and isinstance(at, (dict, list)):
            pairs = sorted(at.items()) if isinstance(at, dict) else [(None, v) for v in at]
            todo.append(("}" if isinstance(at, dict) else "]",))
            for n, (k, v) in reversed(list(enumerate(pairs))):
                todo += [v, (("," if n else "") + ("" if k is None else json.dumps(k, ensure_ascii=False) + ":"),)]
            out.append("{" if isinstance(at, dict) else "[")
        else:
            out.append(json.dumps(at, ensure_ascii=False))
    return "".join(out)


def _canonical(value) -> str:
    """JSON text with sorted keys and without spaces, as Spark writes it: escapes in capitals, half characters escaped."""
    text = _dumps(value)
    if "\\u00" in text:
        text = _CONTROL.sub(lambda m: f"{m[1]}\\u{m[2].upper()}", text)
    return text if text.isascii() else _HALF.sub(lambda m: f"\\u{ord(m[0]):04X}", text)


def _identity(own: str, parts: list) -> str:
    text = f"[{own},{_canonical(parts)}]"
    return hashlib.md5(text.encode("utf-8"), usedforsecurity=False).hexdigest()


class _Node:
    """An object on the way down: its own members, its children still to visit, and those whose identity is known."""

    __slots__ = ("at", "kind", "ordinal", "own", "todo", "done")

    def __init__(self, node: dict, kind: str, ordinal: int):
        self.at, self.kind, self.ordinal, self.own, self.todo, self.done = f"{kind}[{ordinal}]", kind, ordinal, {}, [], []
        for key, value in node.items():
            child = CHILD_KEYS.get(_plain(key))
            if child is not None:
                self.todo += [(child, *m) for m in _members(value)]
            elif value is not None:
                self.own[key] = value
        self.todo.reverse()


def walk(entry: dict) -> Iterator[tuple]:
    """(child_path, parent_path, kind, ordinal, depth, object_id, parent_id, own_json) of every child, and last of the entry.

    Bottom-up with an explicit stack, so depth has no limit: an object's identity covers its own members (nulls left
    out) and the kinds, positions and identities of its children. Paths are put together when a row is given out.
    """
    stack = [_Node(entry, ROOT, 0)]
    while stack:
        node = stack[-1]
        if node.todo:
            kind, ordinal, name, element = node.todo.pop()
            element = _opened(element)
            if isinstance(element, dict):
                stack.append(_Node(element if name is None or "name" in element else {"name": name, **element}, kind, ordinal))
            else:
                own = _canonical(element)
                node.done.append((kind, ordinal, _identity(own, []), own))
            continue
        stack.pop()
        own = _canonical(node.own)
        identity = _identity(own, sorted([k, o, i] for k, o, i, _ in node.done))
        if node.done:
            path = ".".join([n.at for n in stack[1:]] + ([node.at] if stack else []))
            for kind, ordinal, child, text in node.done:
                yield f"{path}.{kind}[{ordinal}]" if path else f"{kind}[{ordinal}]", path, kind, ordinal, len(stack) + 1, child, identity, text
        if stack:
            stack[-1].done.append((node.kind, node.ordinal, identity, own))
        else:
            yield "", None, ROOT, 0, 0, identity, None, own


def _entry_of(payload: str | None) -> dict | None:
    """The entry of a payload, out of its wrappings; None where it is not valid JSON or no object."""
    try:
        entry = _opened(loads(payload)) if payload is not None else None
    except ValueError:
        return None
    if not isinstance(entry, dict):
        return None
    wrapped = _opened(entry.get("result"))
    return wrapped if isinstance(wrapped, dict) and not any(_plain(k) in CHILD_KEYS for k in entry) else entry


def _payload_rows(roots: bool):
    columns = [c.split(" ")[0] for c in BRIDGE.split(", ")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, chars = [], 0
            for key, table, payload in zip(batch["row_key"], batch["src_table"], batch["payload"]):
                entry = _entry_of(payload)
                for row in walk(entry) if entry is not None else ():
                    if row[4] or roots:
                        out.append((table, key, *row))
                        chars += 2 * len(row[0]) + len(row[7])
                    if len(out) >= BATCH_ROWS or chars >= BATCH_CHARS:
                        yield pd.DataFrame(out, columns=columns)
                        out, chars = [], 0
            yield pd.DataFrame(out, columns=columns)

    return rows


def payload_children(payloads: DataFrame, key: str = "land_id", payload: str = "payload", table: str = "pine_entry_payloads", roots: bool = False) -> DataFrame:
    """Bridge rows of JSON entries; the walk over free shapes is a small Python helper on Arrow batches.

    Key spellings, JSON texts inside strings, wrapped entries, lone objects and members keyed by their names are
    understood, at any depth; null, blank and broken payloads have no children. With ``roots``, a row of depth 0 for each entry too.
    """
    rows = payloads.select(F.col(key).alias("row_key"), F.lit(table).alias("src_table"), F.col(payload).alias("payload"))
    return rows.mapInPandas(_payload_rows(roots), BRIDGE)


def entry_children(entries: DataFrame, key: str = "rec_id", table: str = "pine_merged_entries", roots: bool = False) -> DataFrame:
    """Bridge rows of typed entries, in built-in expressions: their children have no children of their own.

    An entry's identity covers all its columns but those of its landing, nulls left out, as for the same entry in JSON.
    """
    kinds = sorted(CHILD_KEYS.values())  # the order in which an identity takes them

    def canonical(field: str, e: Column) -> Column:
        inner = entries.schema[field].dataType.elementType
        if hasattr(inner, "fieldNames"):  # members in the order of their names; to_json leaves nulls out
            return F.to_json(F.struct(*[e[n].alias(n) for n in sorted(inner.fieldNames())]))
        listed = F.to_json(F.array(e))
        return F.substring(listed, F.lit(2), F.length(listed) - 2)

    def items(field: str) -> Column:
        each = F.transform(
            F.col(field),
            lambda e, i: F.when(e.isNotNull(), F.struct(F.lit(field).alias("child_kind"), i.cast("int").alias("ordinal"), canonical(field, e).alias("own_json"))),
        )
        return F.coalesce(F.filter(each, lambda s: s.isNotNull()), F.array().cast("array<struct<child_kind:string,ordinal:int,own_json:string>>"))

    def identity(own: Column) -> Column:
        return F.md5(F.concat(F.lit("["), own, F.lit(",[]]")))

    own = F.to_json(F.struct(*[F.col(c) for c in sorted(set(entries.columns) - {key, *LANDING, *kinds})]))
    parts = F.array_join(F.transform("kids", lambda k: F.concat(F.lit('["'), k["child_kind"], F.lit('",'), k["ordinal"].cast("string"), F.lit(',"'), identity(k["own_json"]), F.lit('"]'))), ",")
    rows = entries.select(F.col(key).alias("row_key"), own.alias("root_json"), F.concat(*[items(f) for f in kinds]).alias("kids"))
    rows = rows.filter(F.size("kids") > 0) if not roots else rows
    rows = rows.withColumn("root_id", F.md5(F.concat(F.lit("["), F.col("root_json"), F.lit(",["), parts, F.lit("]]"))))
    at_root = F.lit(0) if not roots else F.when(F.col("kid").isNull(), 0).otherwise(1)  # the entry itself is a null among its children
    exploded = rows.select("row_key", "root_id", "root_json", F.explode(F.concat("kids", F.array(F.lit(None).cast("struct<child_kind:string,ordinal:int,own_json:string>"))) if roots else F.col("kids")).alias("kid"))
    if not roots:
        kind, ordinal, depth, parent, text, object_id = F.col("kid.child_kind"), F.col("kid.ordinal"), F.lit(1), F.col("root_id"), F.col("kid.own_json"), identity(F.col("kid.own_json"))
        path, above = F.concat(kind, F.lit("["), ordinal.cast("string"), F.lit("]")), F.lit("")
    else:
        child = at_root == 1
        kind, ordinal, depth = F.when(child, F.col("kid.child_kind")).otherwise(ROOT), F.when(child, F.col("kid.ordinal")).otherwise(0), at_root
        parent, text = F.when(child, F.col("root_id")), F.when(child, F.col("kid.own_json")).otherwise(F.col("root_json"))
        object_id = F.when(child, identity(F.col("kid.own_json"))).otherwise(F.col("root_id"))
        path, above = F.when(child, F.concat(kind, F.lit("["), ordinal.cast("string"), F.lit("]"))).otherwise(""), F.when(child, F.lit(""))
    return exploded.select(
        F.lit(table).alias("src_table"), "row_key", path.alias("child_path"), above.alias("parent_path"), kind.alias("child_kind"), ordinal.alias("ordinal"), depth.alias("depth"),
        object_id.alias("object_id"), parent.alias("parent_id"), text.alias("own_json"),
    )


def bridge(entries: DataFrame, payloads: DataFrame, roots: bool = False) -> DataFrame:
    """One row per occurrence of a child: its place, its parent's place, ordinal, identities of both.

    Null and empty arrays, and null elements, give no row; null elements keep their position. A payload landed
    twice gives its rows twice, under both keys. Empty tables give an empty result. With ``roots``, each entry has a
    row of its own too (depth 0, an empty path, no parent), so that every parent is an object of the result.
    """
    return entry_children(entries, roots=roots).unionByName(payload_children(payloads, roots=roots))


def objects(rows: DataFrame) -> DataFrame:
    """(object_id, child_kind, own_json, n_occurrences): each distinct object once.

    own_json is the object without its children; those hang below it by the bridge.
    """
    return rows.groupBy("object_id", "child_kind").agg(F.min("own_json").alias("own_json"), F.count("*").alias("n_occurrences"))


def expanded(rows: DataFrame, store: DataFrame) -> DataFrame:
    """Bridge rows joined back to their stored objects: the round trip of the two tables."""
    return salted_join(rows.drop("own_json"), store, ["object_id", "child_kind"], "n_occurrences", "row_key")


def unresolved(rows: DataFrame, store: DataFrame) -> DataFrame:
    """(src_table, n_objects, n_parents): occurrences whose object, or whose parent, the store does not hold; a row per table.

    Occurrences are counted per identity before they meet the store, so a common object is no hot key.
    """
    used = rows.groupBy("src_table", "object_id", "child_kind").agg(F.count("*").alias("n"))
    above = rows.filter("parent_id is not null").groupBy("src_table", "parent_id").agg(F.count("*").alias("n"))
    ids = store.select("object_id").distinct()
    lost = used.join(store.select("object_id", "child_kind"), ["object_id", "child_kind"], "left_anti").select("src_table", F.col("n").alias("n_objects"), F.lit(0).cast("bigint").alias("n_parents"))
    lost = lost.unionByName(above.join(ids.withColumnRenamed("object_id", "parent_id"), "parent_id", "left_anti").select("src_table", F.lit(0).cast("bigint").alias("n_objects"), F.col("n").alias("n_parents")))
    tables = used.select("src_table", F.lit(0).cast("bigint").alias("n_objects"), F.lit(0).cast("bigint").alias("n_parents"))
    return tables.unionByName(lost).groupBy("src_table").agg(F.sum("n_objects").alias("n_objects"), F.sum("n_parents").alias("n_parents"))
