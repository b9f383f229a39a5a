"""Connectors and caches outside Spark: query texts, retrying requests, caches that know their query, manifests."""

from __future__ import annotations

import gzip
import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable
from pathlib import Path

#: Answers after which a request is worth repeating.
AGAIN = {429, 500, 502, 503, 504}


def overpass_query(box: tuple[float, float, float, float], selectors: list[str], output: str = "center", seconds: int = 180) -> str:
    """A query for nodes, ways and relations that any selector matches within a box (south, west, north, east).

    ``output`` is center (one point for each element) or geom (whole lines).
    """
    if output not in ("center", "geom"):
        raise ValueError(f"unknown output {output}")
    place = ",".join(f"{v:g}" for v in box)
    lines = [f"  {kind}{s}({place});" for s in selectors for kind in ("node", "way", "relation")]
    return "\n".join([f"[out:json][timeout:{seconds}];", "(", *lines, ");", f"out tags {output};", ""])


def _open(url: str, body: bytes | None, seconds: float) -> bytes:
    with urllib.request.urlopen(urllib.request.Request(url, data=body), timeout=seconds) as r:
        return r.read()


def fetch(url: str, body: bytes | None = None, tries: int = 4, wait: float = 1.0, seconds: float = 60.0, opener: Callable = _open, sleep: Callable = time.sleep) -> bytes:
    """The answer to a GET, or a POST of ``body``; repeated with doubled waits after a failure that may pass."""
    for k in range(tries):
        try:
            return opener(url, body, seconds)
        except urllib.error.HTTPError as x:
            if x.code not in AGAIN or k == tries - 1:
                raise
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            if k == tries - 1:
                raise
        sleep(wait * 2**k)
    raise ValueError("tries must be positive")


def failover(mirrors: list[str], body: bytes, rounds: int = 2, wait: float = 5.0, opener: Callable = _open, sleep: Callable = time.sleep) -> bytes:
    """The first mirror's answer, all tried in order, ``rounds`` times with a wait between; the last failure if none answers."""
    last: Exception = ValueError("no mirrors")
    for r in range(rounds):
        for url in mirrors:
            try:
                return fetch(url, body, tries=1, opener=opener, sleep=sleep)
            except (OSError, ValueError) as x:
                last = x
        if r < rounds - 1:
            sleep(wait)
    raise last


def cached(query: str, path: str | Path, load: Callable[[str], dict]) -> dict:
    """The answer kept at ``path``, or a new one that is kept there with its query; a cache of another query is refused."""
    path = Path(path)
    if path.exists():
        kept = json.loads(path.read_text("utf-8"))
        if kept.get("query") != query:
            raise ValueError(f"{path} was made by another query")
        return kept["answer"]
    answer = load(query)
    path.write_text(json.dumps({"query": query, "answer": answer}, ensure_ascii=False, sort_keys=True), "utf-8")
    return answer


def provenance(path: str | Path, basis: str) -> dict:
    """SHA-256, size and basis of a file; text is measured with LF line ends (a CR alone is refused)."""
    data = Path(path).read_bytes()
    if basis == "text":
        data = data.replace(b"\r\n", b"\n")
        if b"\r" in data:
            raise ValueError(f"{path} has a CR without LF")
    return {"sha256": hashlib.sha256(data).hexdigest(), "bytes": len(data), "basis": basis}


def untrue(path: str | Path, record: dict) -> list[str]:
    """Fields of a provenance record that the file does not bear out."""
    now = provenance(path, record["basis"])
    return [k for k in ("sha256", "bytes") if now[k] != record.get(k)]


def upsert(manifest: str | Path, section: str, values: dict, keep: Iterable[str] = ()) -> dict:
    """A section of a JSON manifest replaced, the others and, of the old section, the entries ``keep`` carried forward."""
    path = Path(manifest)
    every = json.loads(path.read_text("utf-8")) if path.exists() else {}
    old = every.get(section, {})
    every[section] = {k: old[k] for k in keep if k in old} | values
    path.write_text(json.dumps(every, ensure_ascii=False, sort_keys=True, indent=1, allow_nan=False) + "\n", "utf-8")
    return every


def stable_gzip(text: str, path: str | Path) -> str:
    """Text as gzip without a time or name in it, so equal texts are equal files; the file's SHA-256."""
    data = gzip.compress(text.encode("utf-8"), mtime=0)
    Path(path).write_bytes(data)
    return hashlib.sha256(data).hexdigest()
