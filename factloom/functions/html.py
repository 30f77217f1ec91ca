"""Pages: decoding, body text, publication times.  What needs a parser runs on Arrow batches."""

from __future__ import annotations

import json
import re
import unicodedata
from datetime import datetime, timezone
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements whose text is no text of the page, those that have no end, and where the body is looked for.
DROPPED = frozenset("script style noscript template svg iframe form nav header footer aside button".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SELECTORS = ("article", "article_body", "main", "body")
BODY_CLASSES = ("article-body", "article__body", "content-detail")
SHORT = 200
ARTICLE_TYPES = frozenset(("Article", "NewsArticle", "BlogPosting", "Report"))


def decode_bytes(raw: bytes | None) -> tuple[str | None, str]:
    """(text, decoder): the declared charset, UTF-8, Vietnamese Windows, Latin-1."""
    if raw is None:
        return None, "none"
    declared = re.search(rb"charset\s*=\s*[\"']?([A-Za-z0-9_\-]+)", raw[:8192], re.I)
    for name in ([declared[1].decode("ascii").lower()] if declared else []) + ["utf-8", "windows-1258", "latin-1"]:
        try:
            return raw.decode(name), name
        except (LookupError, UnicodeDecodeError):
            continue
    return raw.decode("utf-8", "replace"), "utf-8-replace"


class _Body(HTMLParser):
    """Text of the first element that each selector finds, the meta tags and the linked data of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, tuple[str, ...]]] = []
        self.parts: dict[str, list[str]] = {}
        self.reading: set[str] = set()
        self.dropped = 0
        self.scripts: list[str] = []
        self.meta: list[tuple[str, str]] = []
        self.ld = False

    def handle_starttag(self, tag, attrs):
        d = dict(attrs)
        if tag == "meta" and d.get("content"):
            self.meta.append((d.get("property") or d.get("name") or "", d["content"]))
        if tag in VOID:
            return
        named = [tag] if tag in SELECTORS else []
        named += ["article_body"] if any(c in (d.get("class") or "") for c in BODY_CLASSES) else []
        # What stands inside of a dropped element is no element of the page.
        begun = tuple(n for n in named if n not in self.parts and not self.dropped)
        for n in begun:
            self.parts[n] = []
            self.reading.add(n)
        self.dropped += tag in DROPPED
        self.open.append((tag, begun))
        self.ld = tag == "script" and "ld+json" in (d.get("type") or "")
        if self.ld:
            self.scripts.append("")

    def handle_endtag(self, tag):
        self.ld = False
        if any(t == tag for t, _ in self.open):
            while True:
                t, begun = self.open.pop()
                self.dropped -= t in DROPPED
                self.reading.difference_update(begun)
                if t == tag:
                    return

    def handle_data(self, data):
        if self.ld:
            self.scripts[-1] += data
        elif not self.dropped and data.strip():
            for n in self.reading:
                self.parts[n].append(data.strip())


def _collapsed(parts: list[str]) -> str:
    return re.sub(r"\s+", " ", " ".join(parts).replace("\u00a0", " ")).strip()


def body_text(html: str | None) -> tuple[str | None, str | None, list[str]]:
    """(text, selector, flags): the text of the first element of the strongest selector that the page has, white space collapsed.

    A text without tags is taken whole (selector raw_text); null and blank ones have none.
    """
    if not html or not html.strip():
        return None, None, ["EMPTY_BODY"]
    if "<" not in html:
        selector, text, flags = "raw_text", _collapsed([html]), []
    else:
        p = _Body()
        p.feed(html)
        p.close()
        selector = next((n for n in SELECTORS if n in p.parts), None)
        if selector is None:
            return None, None, ["PARSER_NO_BODY_NODE"]
        text, flags = _collapsed(p.parts[selector]), ["PARSER_FALLBACK_BODY"] if selector == "body" else []
    if not text:
        return None, selector, sorted([*flags, "EMPTY_BODY"])
    return text, selector, sorted([*flags, "BODY_EXTRACTED", *(["SHORT_BODY_LT_200_CHARS"] if len(text) < SHORT else [])])


def _dates(node) -> list[str]:
    """datePublished of every node that is an article, depth first."""
    if isinstance(node, list):
        return [d for x in node for d in _dates(x)]
    if not isinstance(node, dict):
        return []
    kinds = node.get("@type")
    own = set(kinds if isinstance(kinds, list) else [kinds]) & ARTICLE_TYPES
    here = [node["datePublished"]] if own and isinstance(node.get("datePublished"), str) else []
    return here + [d for v in node.values() for d in _dates(v)]


def _aware(value: str) -> datetime | None:
    try:
        d = datetime.fromisoformat(value.strip().replace("Z", "+00:00"))
    except ValueError:
        return None
    return d.astimezone(timezone.utc) if d.tzinfo else None


def published_at(html: str | None) -> tuple[datetime | None, str | None]:
    """(instant, source): the first time with a zone of the page's articles, else of its meta tag."""
    if not html:
        return None, None
    p = _Body()
    p.feed(html)
    for s in p.scripts:
        try:
            found = [d for d in map(_aware, _dates(json.loads(s))) if d]
        except ValueError:
            continue
        if found:
            return found[0], "jsonld_datePublished"
    for name, content in p.meta:
        if name == "article:published_time" and (d := _aware(content)):
            return d, "meta_published_time"
    return None, None


@F.pandas_udf(T.StructType().add("text", "string").add("selector", "string").add("flags", T.ArrayType(T.StringType())))
def extract_body(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([body_text(h) for h in html], columns=["text", "selector", "flags"])


@F.pandas_udf(T.StructType().add("text", "string").add("decoder", "string"))
def decode(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decode_bytes(r) for r in raw], columns=["text", "decoder"])


@F.pandas_udf(T.StringType())
def normal_form(text: pd.Series) -> pd.Series:
    """Canonical composition with plain line ends."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t).replace("\r\n", "\n"))


@F.pandas_udf(T.StringType())
def casefolded(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else t.casefold())


@F.pandas_udf(T.StructType().add("published", "timestamp").add("source", "string"))
def publication(html: pd.Series) -> pd.DataFrame:
    rows = [published_at(h) for h in html]
    return pd.DataFrame({"published": pd.to_datetime([r[0] for r in rows], utc=True).tz_localize(None) if rows else [], "source": [r[1] for r in rows]})
