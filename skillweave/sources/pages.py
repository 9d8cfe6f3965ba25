"""HTML pages and XML responses parsed to columns with the standard library."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CODE = re.compile(r"[A-Z]{2,8}\d{3,6}[A-Z]?")
_CODE_TITLE = re.compile(r"([A-Z]{2,8}\d{3,6}[A-Z]?)\s+(.*)", re.S)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
TAXONOMY = "struct<anzsco:string,industry:string,occupation:string>"
UNITS = "array<struct<section:string,unit_code:string,unit_title:string,grp:string>>"


class Node:
    def __init__(self, tag: str, parent: Node | None = None):
        self.tag, self.parent, self.children = tag, parent, []

    def walk(self) -> Iterator[Node]:
        for child in self.children:
            if isinstance(child, Node):
                yield child
                yield from child.walk()

    def all(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def text(self, sep: str = "") -> str:
        parts = [c.strip() if isinstance(c, str) else c.text(sep) for c in self.children]
        return sep.join(p for p in parts if p)

    def siblings(self) -> list[Node]:
        """Elements that follow within the same parent."""
        if self.parent is None:
            return []
        own = self.parent.children
        return [n for n in own[own.index(self) + 1 :] if isinstance(n, Node)]


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("root")

    def handle_starttag(self, tag, attrs):
        node = Node(tag, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        if self.at.tag not in ("script", "style"):
            self.at.children.append(data)


def parse_html(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def _label_key(label: str) -> str | None:
    return "anzsco" if "ANZSCO" in label else "industry" if "Industry Sector" in label else "occupation" if "Occupation" in label else None


def taxonomy_of(html: str | None) -> dict[str, str]:
    """Classification values of a page: from the table after a 'Classifications' heading, else from definition lists."""
    out = dict.fromkeys(("anzsco", "industry", "occupation"), "N/A")
    if not html:
        return out
    nodes = list(parse_html(html).walk())
    heads = [i for i, n in enumerate(nodes) if n.tag in ("h2", "h3") and "classifications" in n.text(" ").lower()]
    table = next((n for n in nodes[heads[0] :] if n.tag == "table"), None) if heads else None
    for row in table.all("tr") if table else ():
        cells = row.all("td")
        if len(cells) >= 2 and (key := _label_key(cells[0].text())):
            out[key] = cells[-1].text()
    if set(out.values()) == {"N/A"}:
        for label in (n for n in nodes if n.tag == "dt"):
            value = next((n for n in label.siblings() if n.tag == "dd"), None)
            if value is not None and (key := _label_key(label.text())):
                out[key] = value.text()
    return {k: v if v in ("", "N/A") else ", ".join(p.strip() for p in re.split(r"[\n\r;|•]+", v) if p.strip()) for k, v in out.items()}


def _table_units(table: Node) -> Iterator[tuple[str, str, str]]:
    group = ""
    for row in table.all("tr"):
        cells = row.all("td", "th")
        whole = " ".join(c.text(" ") for c in cells).strip()
        both = _CODE_TITLE.match(whole)
        if len(cells) == 1 and not both:
            group = whole
        elif cells and _CODE.fullmatch(cells[0].text()):
            yield cells[0].text(), cells[1].text() if len(cells) > 1 else "", group
        elif both:
            yield both[1], both[2].strip(), group


def _line_units(lines) -> Iterator[tuple[str, str, str]]:
    for line in lines:
        if m := _CODE_TITLE.match(line.strip()):
            yield m[1], m[2].strip(), ""


def _content_units(node: Node) -> list[tuple[str, str, str]]:
    if node.tag == "table":
        return list(_table_units(node))
    if node.tag in ("ul", "ol"):
        return list(_line_units(li.text(" ") for li in node.all("li")))
    if node.tag in ("div", "section"):
        inner = next(iter(node.all("table")), None) or next(iter(node.all("ul", "ol")), None)
        return _content_units(inner) if inner is not None else list(_line_units(node.text("\n").splitlines()))
    return []


def units_of(html: str | None) -> list[dict[str, str]]:
    """Units of a page with the section and group whose heading they follow."""
    out: list[dict[str, str]] = []
    if not html:
        return out
    for head in parse_html(html).all("h2", "h3", "h4", "strong", "b"):
        label = head.text()
        low = label.lower()
        section = "core" if "core unit" in low else "elective" if "elective unit" in low or "group" in low else None
        if section is None:
            continue
        default = label if section == "elective" and "group" in low else ""
        for node in head.siblings():
            if node.tag in ("h2", "h3", "h4"):
                break
            out += [{"section": section, "unit_code": c, "unit_title": t, "grp": g or default} for c, t, g in _content_units(node)]
    return out


def taxonomy(html: Column) -> Column:
    """taxonomy_of as a column."""

    @F.pandas_udf(TAXONOMY)
    def parse(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([taxonomy_of(p) for p in pages], columns=["anzsco", "industry", "occupation"])

    return parse(html)


def units(html: Column) -> Column:
    """units_of as a column."""

    @F.pandas_udf(UNITS)
    def parse(pages: pd.Series) -> pd.Series:
        return pd.Series([units_of(p) for p in pages])

    return parse(html)


# --- XML and JSON responses -----------------------------------------------------------------------------------------


def taxonomy_of_xml(xml: str | None) -> dict[str, str]:
    """Classification values of an XML response by scheme; a description counts before a value. Broken XML has none."""
    found: dict[str, list[str]] = {"anzsco": [], "industry": [], "occupation": []}
    try:
        root = ElementTree.fromstring(xml) if xml else None
    except ElementTree.ParseError:
        root = None
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    for scheme in (e for e in root.iter() if local(e) == "ClassificationScheme") if root is not None else ():
        text = {local(e): (e.text or "").strip() for e in reversed(list(scheme.iter()))}
        name = text.get("Scheme", "")
        key = "anzsco" if "ANZSCO" in name else "industry" if "Industry" in name or "Sector" in name else "occupation" if "Occupation" in name or "Taxonomy" in name else None
        if key:
            found[key].append(text.get("Description") or text.get("Value", ""))
    return {k: ", ".join(v) for k, v in found.items()}


def soap_taxonomy(xml: Column) -> Column:
    """taxonomy_of_xml as a column."""

    @F.pandas_udf(TAXONOMY)
    def parse(responses: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([taxonomy_of_xml(r) for r in responses], columns=["anzsco", "industry", "occupation"])

    return parse(xml)


UNIT_DETAIL = (
    "struct<Code:string,Title:string,Status:string,ReleaseDate:string,TrainingPackageCode:string,TrainingPackageTitle:string,"
    "Elements:struct<Element:array<struct<Num:string,Title:string,PerformanceCriteria:struct<PerformanceCriterion:array<struct<Num:string,Description:string>>>>>>,"
    "KnowledgeEvidence:string,PerformanceEvidence:string,AssessmentConditions:string,FoundationSkills:string>"
)
#: Lists of one that come as the object itself.
_SINGLE = re.compile(r'("(?:Element|PerformanceCriterion)"\s*:\s*)\{')


def _wrap_singles(text: str | None) -> str | None:
    """A JSON text in which single objects are lists of one."""
    if text is None or not _SINGLE.search(text):
        return text
    import json

    def fix(value):
        if isinstance(value, dict):
            return {k: [fix(v)] if k in ("Element", "PerformanceCriterion") and isinstance(v, dict) else fix(v) for k, v in value.items()}
        return [fix(v) for v in value] if isinstance(value, list) else value

    try:
        return json.dumps(fix(json.loads(text)))
    except ValueError:
        return text


def unit_detail(payload: Column) -> Column:
    """A unit's JSON as a struct; missing parts are null, single objects become lists of one."""

    @F.pandas_udf("string")
    def wrap(texts: pd.Series) -> pd.Series:
        return texts.map(_wrap_singles)

    return F.from_json(wrap(payload), UNIT_DETAIL)


def unit_rows(rows: DataFrame, payload: str) -> DataFrame:
    """(unit_code, unit_title, element_num, element_title, pc_num, pc_text), one row per criterion of the units in `payload`."""
    unit = rows.select(unit_detail(F.col(payload)).alias("u")).where("u.Code is not null")
    elements = unit.select("u.Code", "u.Title", F.explode("u.Elements.Element").alias("e"))
    criteria = elements.select("Code", "Title", "e.Num", F.col("e.Title").alias("et"), F.explode("e.PerformanceCriteria.PerformanceCriterion").alias("p"))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return criteria.select(
        F.col("Code").alias("unit_code"), blank("Title").alias("unit_title"), blank("Num").alias("element_num"), blank("et").alias("element_title"), blank("p.Num").alias("pc_num"), blank("p.Description").alias("pc_text")
    )


def organisation(payload: Column) -> Column:
    """An organisation's JSON as code, legal_name, trading_name, status, state, postcode; missing ones are ''."""
    o = F.from_json(payload, "struct<Code:string,LegalName:string,TradingName:string,Status:string,AddressState:string,AddressPostcode:string>")
    names = ("code", "legal_name", "trading_name", "status", "state", "postcode")
    fields = ("Code", "LegalName", "TradingName", "Status", "AddressState", "AddressPostcode")
    return F.struct(*[F.coalesce(o[f], F.lit("")).alias(n) for f, n in zip(fields, names, strict=True)])


def qualification_summaries(payload: DataFrame, column: str) -> DataFrame:
    """(code, title, type) of the items of a JSON:API search response; the first of repeated codes."""
    data = F.from_json(F.col(column), "struct<data:array<struct<id:string,type:string,attributes:struct<code:string,title:string>>>>")["data"]
    items = payload.select(F.posexplode(data).alias("n", "x")).select("n", F.coalesce("x.attributes.code", "x.id").alias("code"), "x.attributes.title", "x.type").where("code <> ''")
    return items.groupBy("code").agg(F.min_by("title", "n").alias("title"), F.min_by("type", "n").alias("type"))
