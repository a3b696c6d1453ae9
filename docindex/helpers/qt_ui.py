"""Qt Designer files: the widget tree in preorder and the signal connections."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree as ET

# Properties that are shown in the tree's text.
SHOWN = ["text", "title", "windowTitle", "placeholderText"]


def _properties(widget: ET.Element) -> dict[str, str]:
    out = {}
    for p in widget.findall("property"):
        value = next((c.text for c in p if c.text), None)
        if p.get("name") and value is not None:
            out[p.get("name")] = value
    return out


def _number(value: str | None) -> int | None:
    return int(value) if value is not None else None


def _children(widget: ET.Element) -> Iterator[tuple[ET.Element, int | None, int | None]]:
    """Widgets directly inside, then those in items of any layout below."""
    for child in widget.findall("widget"):
        yield child, None, None
    for item in (i for layout in widget.iter("layout") for i in layout.findall("item")):
        inner = item.find("widget")
        if inner is not None:
            yield inner, _number(item.get("row")), _number(item.get("column"))


def _own(widget: ET.Element) -> list[tuple[ET.Element, int | None, int | None]]:
    """Of ``_children`` those that no widget further in has: what lies in a widget that is listed itself is not looked
    into, so that a whole file's elements are passed once. Items come by layout, outer layouts first."""
    out = [(child, None, None) for child in widget.findall("widget")]
    layouts: list[ET.Element] = []
    todo = [c for c in reversed(widget) if c.tag != "widget"]
    while todo:
        x = todo.pop()
        if x.tag == "layout":
            layouts.append(x)
            for item in reversed(x):
                if item.tag == "item":
                    first = item.find("widget")
                    todo.extend(c for c in reversed(item) if c is not first)
                else:
                    todo.append(item)
        else:
            todo.extend(reversed(x))
    for layout in layouts:
        for item in layout.findall("item"):
            inner = item.find("widget")
            if inner is not None:
                out.append((inner, _number(item.get("row")), _number(item.get("column"))))
    return out


def parse(xml: str, dedupe: bool = True) -> dict | None:
    """{class_name, version, widgets, connections}; None for bad XML or without a
    root widget. A widget in nested layouts is reached in several ways; ``dedupe``
    keeps the first, else it is listed each time."""
    try:
        root = ET.fromstring(xml)
    except (ET.ParseError, ValueError):
        return None
    top = root.find("widget")
    if top is None:
        return None
    widgets: list[dict] = []
    children = _own if dedupe else _children
    todo: list[tuple] = [(top, None, None, None, 0)]
    while todo:
        widget, row, column, parent, depth = todo.pop()
        number = len(widgets)
        widgets.append({"node_no": number, "parent_no": parent, "depth": depth, "object_name": widget.get("name", ""), "class_name": widget.get("class", ""), "row": row, "column": column, "properties": _properties(widget)})
        todo.extend((w, r, c, number, depth + 1) for w, r, c in reversed([*children(widget)]))
    connections = []
    for c in root.iter("connection"):
        one = {k: c.findtext(k) or "" for k in ("sender", "signal", "receiver", "slot")}
        if all(one.values()):
            connections.append(one)
    name = root.find("class")
    return {"class_name": (name.text or "") if name is not None else "", "version": root.get("version", "unknown"), "widgets": widgets, "connections": connections}


def tree_text(widgets: list[dict]) -> str:
    lines = []
    for w in widgets:
        pad = "  " * w["depth"]
        lines.append(f"{pad}- {w['class_name']}" + (f" (objectName: {w['object_name']})" if w["object_name"] else ""))
        lines += [f"{pad}  {p}: {w['properties'][p]}" for p in SHOWN if p in w["properties"]]
    return "\n".join(lines)
