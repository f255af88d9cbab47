"""URL verdicts from block and allow entries held in one trie: reversed host labels, then path segments.

An entry is ``host/path``; it fits its host and all subdomains if the url's path starts with its path. Among fitting
entries the longest (characters of host and path) decides, so a longer allow entry is an exception to a shorter block entry
and the other way round; of equal entries block decides. Urls without a fitting entry get the default verdict.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pickled trie may not be larger: it goes to every executor.
MOST_TRIE_BYTES = 256 << 20
VERDICTS = "page_id long, host string, path string, rule string, verdict string"
_UPPER = {c: c + 32 for c in range(65, 91)}
_END, _NEXT, _PATHS = 0, 1, 2


class RuleTrie:
    """``add`` entries, then ``match`` a host and a path in steps of their labels and segments."""

    def __init__(self, rules: Iterable[tuple[str, str]] = ()):
        self.root: dict = {}
        for verdict, rule in rules:
            self.add(verdict, rule)

    def add(self, verdict: str, rule: str) -> None:
        if verdict not in ("allow", "block"):
            raise ValueError(f"unknown verdict {verdict}")
        host, slash, rest = rule.partition("/")
        node = self.root
        for label in reversed(host.translate(_UPPER).split(".")):
            node = node.setdefault(_NEXT, {}).setdefault(label, {})
        at = node.setdefault(_PATHS, {})
        *whole, tail = (slash + rest).split("/")
        for segment in whole:
            at = at.setdefault(_NEXT, {}).setdefault(segment, {})
        ends = at.setdefault(_END, {})
        if ends.get(tail, (None, "allow"))[1] == "allow":  # block stays if both are given
            ends[tail] = (rule, verdict)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest fitting entry and its verdict."""
        best, segments, node = None, path.split("/"), self.root
        for label in reversed(host.split(".")):
            node = node.get(_NEXT, {}).get(label)
            if node is None:
                break
            at = node.get(_PATHS)
            for i, segment in enumerate(segments):
                if at is None:
                    break
                for tail, entry in at.get(_END, {}).items():
                    if segment.startswith(tail) and (best is None or self._key(entry) > self._key(best)):
                        best = entry
                # Only a segment that a slash follows is whole.
                at = at.get(_NEXT, {}).get(segment) if i + 1 < len(segments) else None
        return best

    @staticmethod
    def _key(entry: tuple[str, str]) -> tuple[int, bool]:
        return len(entry[0]), entry[1] == "block"


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    for stop in "#?":
        rest = rest.partition(stop)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_UPPER), slash + path


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str]], default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages``.

    ``rules``: (verdict, entry) pairs. Null urls and urls without ``://`` have an empty host and path and the default
    verdict (no entry has an empty host); null ids and repeated rows are kept; other columns are not read.
    """
    trie = RuleTrie(rules)
    if len(pickle.dumps(trie.root)) > MOST_TRIE_BYTES:
        raise ValueError(f"the entries' trie is larger than {MOST_TRIE_BYTES} bytes")
    held = pages.sparkSession.sparkContext.broadcast(trie)
    schema = pa.schema([("page_id", pa.int64())] + [(n, pa.string()) for n in ("host", "path", "rule", "verdict")])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [host_and_path(u) for u in batch.column("url").to_pylist()]
            found = [held.value.match(h, p) or (None, default) for h, p in parts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), *(pa.array(c, pa.string()) for c in (
                    [h for h, _ in parts], [p for _, p in parts], [r for r, _ in found], [v for _, v in found]))],
                schema=schema)

    return pages.select(F.col("page_id").cast("long"), "url").mapInArrow(judge, VERDICTS)
