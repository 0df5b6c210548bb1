"""Where descriptors and tables are: overrides, discovery beside a table, link headers, a cache of fetched texts."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from urllib.parse import urljoin

from quadloom.issues import Issues

#: Templates of metadata places, when no well-known list says otherwise.
DEFAULT_TEMPLATES = ("{+url}-metadata.json", "csv-metadata.json")
MEDIA_TYPES = ("application/csvm+json", "application/ld+json", "application/json")


def override(url: str, rules: list[tuple[str, str]]) -> str:
    """The rule with the longest match replaces the URL's start; a rule that begins with ^ is a regular expression."""
    best, new = -1, url
    for old, to in rules:
        if old.startswith("^"):
            m = re.match(old, url)
            n = m.end() if m else -1
        else:
            n = len(old) if url.startswith(old) else -1
        if n > best:
            best, new = n, to + url[n:]
    return new


def link_metadata(header: str) -> str | None:
    """The last describedby link of a metadata media type."""
    found = None
    for m in re.finditer(r"<([^>]*)>((?:\s*;\s*[^,;=]+=(?:\"[^\"]*\"|[^,;]*))*)", header):
        attrs = {k.strip().lower(): v.strip().strip('"') for k, v in re.findall(r";\s*([^,;=]+)=(\"[^\"]*\"|[^,;]*)", m[2])}
        if attrs.get("rel") == "describedby" and attrs.get("type") in MEDIA_TYPES:
            found = m[1]
    return found


def places(url: str, well_known: str | None = None) -> list[str]:
    """Where a table's metadata may be, in order; ``well_known``: the text of the site's list, a template a line."""
    templates = [x.strip() for x in well_known.splitlines() if x.strip()] if well_known else list(DEFAULT_TEMPLATES)
    return [urljoin(url, t.replace("{+url}", url).replace("{url}", url)) for t in templates]


class Cache(dict):
    """URL -> text, fetched once."""

    def __init__(self, fetch: Callable[[str], str], seed: dict[str, str] | None = None):
        super().__init__(seed or {})
        self.fetch = fetch

    def __missing__(self, url: str) -> str:
        self[url] = text = self.fetch(url)
        return text


def read_text(url: str, rules: list[tuple[str, str]] | None = None) -> str:
    """A local file's text, by path or file URL, after the overrides."""
    own = override(url, rules or [])
    with open(re.sub(r"^file://", "", own), encoding="utf-8") as f:
        return f.read()


def discover(url: str, read: Callable[[str], str] = read_text, well_known: str | None = None, link: str | None = None, issues: Issues | None = None) -> tuple[str, str] | None:
    """(place, text) of the first metadata that describes the table: the link header's, then the well-known places."""
    candidates = ([urljoin(url, link)] if link else []) + places(url, well_known)
    for place in candidates:
        try:
            text = read(place)
            obj = json.loads(text)
        except (OSError, KeyError, ValueError):
            continue
        tables = obj.get("tables", [obj]) if isinstance(obj, dict) else []
        urls = [t.get("url") for t in tables if isinstance(t, dict)]
        if any(u is None or urljoin(place, u) == url or os.path.normpath(urljoin(place, u)) == os.path.normpath(url) for u in urls):
            return place, text
        (issues or Issues()).warn(f"{place} does not describe {url}")
    return None
