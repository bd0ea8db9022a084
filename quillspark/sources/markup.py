"""Markdown and XML parsers."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

from .parsers import Item, Parsed, ProcessingError, _decode, _meta, parser

LINK = re.compile(r"\[[^\]]+]\([^)]+\)")
IMAGE = re.compile(r"!\[[^\]]*]\([^)]+\)")


def front_matter(text: str) -> tuple[dict | None, str]:
    """YAML between two ``---`` at the top, and the text after it; what isn't YAML stays text."""
    if text.startswith("---"):
        parts = text.split("---", 2)
        if len(parts) == 3:
            try:
                import yaml

                found = yaml.safe_load(parts[1])
            except Exception:  # noqa: BLE001 - absent library or broken YAML: no front matter
                found = None
            if isinstance(found, dict):
                return found, parts[2].strip()
    return None, text


@parser("md")
def parse_markdown(content: bytes, options: dict) -> Parsed:
    text = _decode(content, options)
    front, body = front_matter(text)
    lines = body.split("\n")
    meta = _meta(word_count=len(body.split()), line_count=len(lines), header_count=sum(s.strip().startswith("#") for s in lines), link_count=len(LINK.findall(body)), image_count=len(IMAGE.findall(body)), frontmatter=front)
    return Parsed(body, meta, [Item("text:normal", body)])


def safe_xml(content: bytes) -> ET.Element:
    """Parse XML that declares no document type: without one there are no entities to expand."""
    if re.search(rb"<!(DOCTYPE|ENTITY)", content, re.I):
        raise ProcessingError("XML with a document type is refused")
    return ET.fromstring(content)


def _walk(node: ET.Element, depth: int, out: list[str]) -> None:
    out.append(f"{'#' * min(depth, 6)} {node.tag.rpartition('}')[2]}")
    if node.attrib:
        out.append("\n".join(f"- **{k}**: {v}" for k, v in node.attrib.items()))
    if node.text and node.text.strip():
        out.append(node.text.strip())
    for child in node:
        _walk(child, depth + 1, out)
        if child.tail and child.tail.strip():
            out.append(child.tail.strip())


@parser("xml")
def parse_xml(content: bytes, options: dict) -> Parsed:
    root = safe_xml(content)
    out: list[str] = []
    _walk(root, 1, out)
    return Parsed("\n\n".join(out), _meta(root_tag=root.tag.rpartition("}")[2], element_count=sum(1 for _ in root.iter()) - 1))
