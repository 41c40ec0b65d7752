"""Landed reference pages: from HTML to raw items, and from raw items to entries."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.scalar import PARAMETER, fragment_category, header_name, namespace_of, parse_parameter, strip
from glyphmill.operators.ingest import index_category

#: Class of the element that holds an item; its header and content have it with an ending.
ITEM = "reference-item"
RAW_ITEM = (
    "header string, section string, fragment string, syntax_blocks array<string>, descriptions array<string>, parameter_lines array<string>, returns_text string, "
    "remarks_text string, example_blocks array<string>, see_also array<string>, field_lines array<string>, method_lines array<string>, all_text string"
)
#: What a sub-header says, in this order, and the section that it opens.
SECTIONS = (
    ("syntax", "syntax"), ("signature", "syntax"), ("argument", "arguments"), ("parameter", "arguments"), ("return", "returns"), ("remark", "remarks"), ("note", "remarks"),
    ("example", "example"), ("see also", "seealso"), ("field", "fields"), ("method", "methods"),
)
#: What a text says that tells of a withdrawn entry, and the headings of the categories.
WITHDRAWN = ("deprecated", "obsolete", "no longer supported", "removed in")
HEADINGS = {"variables": "variable", "constants": "constant", "functions": "function", "keywords": "keyword", "types": "type", "operators": "operator", "annotations": "annotation"}
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))


class _Page(HTMLParser):
    """Collects of each item its heading, header, anchor, and the elements of its content in order."""

    def __init__(self, item: str):
        super().__init__(convert_charrefs=True)
        self.item, self.items, self.heading = item, [], ""
        self.open: list[str] = []  # roles of the open elements
        self.now: dict | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        told = dict(attrs)
        classes = (told.get("class") or "").split()
        role = ""
        if tag == "h2":
            role, self.heading = "h2", ""
        elif self.item in classes:
            self.open = []  # an item that was never closed ends here
            role, self.now = "item", {"header": "", "section": self.heading.strip().lower(), "fragment": "", "id": told.get("id") or "", "children": []}
            self.items.append(self.now)
        elif self.now is not None and "item" in self.open:
            if tag == "a" and not self.now["fragment"] and "#" in (told.get("href") or ""):
                self.now["fragment"] = told["href"].rpartition("#")[2]
            if f"{self.item}__header" in classes:
                role = "header"
            elif f"{self.item}__content" in classes:
                role = "content"
            elif self.open[-1] == "content":
                role = "child"
                self.now["children"].append({"tag": tag, "class": told.get("class") or "", "text": "", "links": [], "code": None})
            elif "child" in self.open:
                role = "a" if tag == "a" else "code" if tag == "code" else ""
                child = self.now["children"][-1]
                if role == "a":
                    child["links"].append("")
                elif role == "code" and child["code"] is None:
                    child["code"] = ""
        if tag not in _VOID:
            self.open.append(role)

    def handle_endtag(self, tag: str) -> None:
        if tag not in _VOID and self.open:
            self.open.pop()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1] == "h2":
            self.heading += data
        elif self.now is not None and "header" in self.open:
            self.now["header"] += data
        elif self.now is not None and "child" in self.open:
            child = self.now["children"][-1]
            child["text"] += data
            if "a" in self.open:
                child["links"][-1] += data
            if "code" in self.open:
                child["code"] += data


def _raw_item(item: dict) -> tuple:
    """The sections of an item: a sub-header opens one, and every text goes to the one that is open."""
    section = ""
    found: dict[str, list[str]] = {k: [] for k in ("syntax", "description", "arguments", "returns", "remarks", "example", "seealso", "fields", "methods", "all")}
    for child in item["children"]:
        kind, text = child["class"], child["text"].strip()
        if "sub-header" in kind:
            said = text.lower()
            section = next((s for word, s in SECTIONS if word in said), section or ("type" if "type" in said else "description"))
        elif "see-also" in kind:
            found["seealso"] += [link.strip() for link in child["links"] if link.strip()]
        elif "syntax" in kind:
            found["syntax"].append(text)
        elif "example" in kind and child["tag"] == "pre":
            found["example"].append(child["text"] if child["code"] is None else child["code"])
        elif "text" in kind or child["tag"] == "p":
            found["all"].append(text)
            place = section or "description"
            if place in ("description", "arguments", "returns", "remarks", "fields", "methods"):
                found[place].append(text)
    return (
        item["header"].strip(), item["section"], item["fragment"] or item["id"], found["syntax"], found["description"], found["arguments"], "\n".join(found["returns"]),
        "\n".join(found["remarks"]), found["example"], found["seealso"], found["fields"], found["methods"], " ".join(found["all"]),
    )


def raw_items(pages: DataFrame, key: str = "page_id", html: str = "html", item: str = ITEM) -> DataFrame:
    """(page key, place, raw item): the items of each page in order; broken markup gives what can be read of it.

    Null and empty pages have none. One small parser per page, in Arrow batches, without a shuffle.
    """
    columns = ["page_id", "place", *[c.split(" ")[0] for c in RAW_ITEM.split(", ")]]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, text in zip(batch["page_id"], batch["html"]):
                if text:
                    parser = _Page(item)
                    parser.feed(text)
                    parser.close()
                    out += [(page, place, *_raw_item(found)) for place, found in enumerate(parser.items)]
            yield pd.DataFrame(out, columns=columns)

    rows = pages.select(F.col(key).cast("bigint").alias("page_id"), F.col(html).alias("html"))
    return rows.mapInPandas(read, f"page_id bigint, place int, {RAW_ITEM}")


def _full(col: str) -> Column:
    """Texts of an array that are not blank."""
    return F.filter(col, lambda x: strip(x) != "")


def entries_of(items: DataFrame, index: DataFrame, base: str = "") -> DataFrame:
    """Entries of raw items: page_id, place and the fields of an entry.

    Items without a header or a name are dropped. The category is told by the prefix of the fragment, else by the first
    word of the heading, else by the discovery row of the same name; an item without one is no entry. The first syntax
    block is the syntax, the others are overloads.
    """
    named = items.withColumn("name", header_name(F.col("header"))).filter("name != ''")
    told = index_category(named, index)
    by_heading = F.create_map(*[F.lit(x) for pair in HEADINGS.items() for x in pair])[F.regexp_extract(F.lower("section"), r"^\s*(\S+)", 1)]
    prefix = fragment_category(F.col("fragment"))
    category = F.coalesce(F.when(prefix != "unknown", prefix), by_heading, "index_category")
    field = PARAMETER
    lower = F.lower("all_text")
    withdrawn = F.lit(False)
    for marker in WITHDRAWN:
        withdrawn = withdrawn | lower.contains(marker)
    fields = F.transform(F.filter("field_lines", lambda l: l.rlike(field)), lambda l: F.struct(F.regexp_extract(l, field, 1).alias("name"), strip(F.regexp_extract(l, field, 2)).alias("type"), strip(F.regexp_extract(l, field, 3)).alias("description")))
    methods = F.filter(F.transform("method_lines", lambda l: F.regexp_extract(l, r"^([a-zA-Z_][a-zA-Z0-9_.]*)\s*\(", 1)), lambda m: m != "")
    generated = F.concat_ws("_", "category", F.translate(F.lower("name"), ". ", "__"))
    return told.withColumn("category", category).filter("category is not null").select(
        "page_id", "place", F.coalesce(F.nullif("fragment", F.lit("")), generated).alias("id"), "name", "category", namespace_of(F.col("name")).alias("namespace"),
        F.get("syntax_blocks", F.lit(0)).alias("syntax"), F.slice("syntax_blocks", 2, F.greatest(F.size("syntax_blocks") - 1, F.lit(0))).alias("overloads"),
        F.when(F.size("descriptions") > 0, F.array_join(_full("descriptions"), "\n\n")).alias("description"), F.filter(F.transform(_full("parameter_lines"), parse_parameter), lambda p: p.isNotNull()).alias("parameters"),
        F.nullif(strip(F.col("returns_text")), F.lit("")).alias("returns"), F.nullif(strip(F.col("remarks_text")), F.lit("")).alias("remarks"), fields.alias("type_fields"), methods.alias("type_methods"),
        F.transform(_full("example_blocks"), strip).alias("examples"), "see_also", withdrawn.alias("deprecated"), F.when(F.col("fragment") != "", F.concat(F.lit(f"{base}#"), "fragment")).alias("url"),
    )
