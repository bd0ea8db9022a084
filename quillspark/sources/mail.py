"""E-mail parser."""

from __future__ import annotations

from email import message_from_bytes, policy

from .parsers import Item, Parsed, _meta, markdown_of_html, parser

HEADERS = ("From", "To", "Cc", "Date")


def body_of(message) -> str:
    """All plain parts, one a line; without any, the HTML parts as Markdown. Attachments don't count."""
    texts: dict[str, list[str]] = {"text/plain": [], "text/html": []}
    for part in message.walk():
        kind = part.get_content_type()
        if kind in texts and part.get_content_disposition() != "attachment":
            raw = part.get_payload(decode=True) or b""
            texts[kind].append(raw.decode(part.get_content_charset() or "utf-8", "replace"))
    if texts["text/plain"]:
        return "\n".join(texts["text/plain"]).strip()
    return markdown_of_html("\n".join(texts["text/html"])) if texts["text/html"] else ""


@parser("eml")
def parse_mail(content: bytes, options: dict) -> Parsed:
    m = message_from_bytes(content, policy=policy.default)
    subject, body = m.get("Subject"), body_of(m)
    fields = {h: str(m[h]) for h in HEADERS if m[h]}
    head = "\n".join(f"**{h}:** {v}  " for h, v in fields.items())
    return Parsed(f"# {subject or '(no subject)'}\n\n{head}\n\n---\n\n{body}", _meta(subject=subject, **{h.lower(): v for h, v in fields.items()}), [Item("text:title", str(subject or "(no subject)")), Item("text:normal", body)])
