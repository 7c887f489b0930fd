"""URL filter: a trie over reversed host labels and path segments.

A rule names a host and the beginning of a path. It fits that host and all its subdomains where
the URL's path starts with the rule's. Rules are entered label by label from the top-level domain
and then segment by segment; a walk down the trie along a URL meets every rule that fits, and the
longest one decides. The trie is built on the driver, its size is checked, and it is broadcast:
rows are judged where they are, without a shuffle.
"""

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrowatch.llm.common import quoted, spare, without

# A rule set beyond this many characters is refused rather than broadcast.
MAX_RULE_CHARS = 64_000_000
OUTPUT = ("host", "path", "rule", "verdict")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path. The host follows the first `://` and ends at `/`, `?` or `#`; the path goes on
    to `?` or `#`. Both are empty for a null URL and one without `://`."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


class Node:
    """A place in the trie: the ways on, and the rules that end here by their last, open segment."""

    __slots__ = ("labels", "segments", "ends")

    def __init__(self) -> None:
        self.labels: dict[str, Node] = {}
        self.segments: dict[str, Node] = {}
        self.ends: dict[str, tuple[str, str]] = {}


def build_trie(rules: Iterable[tuple[str, str, str]]) -> Node:
    """rules: (verdict, host, path). Of equal rules, a block outranks an allow."""
    root, size = Node(), 0
    for verdict, host, path in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"a rule allows or blocks, not {verdict!r}")
        size += len(host) + len(path)
        if size > MAX_RULE_CHARS:
            raise ValueError(f"rules of more than {MAX_RULE_CHARS} characters are not broadcast")
        host = host.translate(_LOWER)
        node = root
        for label in reversed(host.split(".")):
            node = node.labels.setdefault(label, Node())
        # Every segment but the last is whole; the last may be the beginning of a longer one.
        *segments, last = path.split("/")
        for segment in segments:
            node = node.segments.setdefault(segment, Node())
        if node.ends.get(last, ("", "allow"))[1] == "allow":
            node.ends[last] = (host + path, verdict)
    return root


def judge(root: Node, host: str, path: str) -> tuple[str, str] | None:
    """The longest rule that fits, and its verdict."""
    best, longest = None, -1
    segments = path.split("/")
    node: Node | None = root
    for label in reversed(host.split(".")):
        node = node.labels.get(label)
        if node is None:
            break
        inner = node
        for segment in segments:
            for last, found in inner.ends.items():
                if len(found[0]) > longest and segment.startswith(last):
                    best, longest = found, len(found[0])
            inner = inner.segments.get(segment)
            if inner is None:
                break
    return best


def filter_urls(
    pages: DataFrame,
    rules: Iterable[tuple[str, str, str]],
    *,
    url: str = "url",
    default: str = "allow",
) -> DataFrame:
    """Add host, path, rule (null where none fits) and verdict (the default where none fits).

    A null URL has an empty host and path and gets the default. Columns of the input that carry
    one of the four names are replaced. Repeated rows are judged alike; an empty table stays empty.
    """
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for urls in batches:
            rows = []
            for value in urls:
                host, path = split_url(value)
                rule, verdict = judge(trie.value, host, path) or (None, default)
                rows.append((host, path, rule, verdict))
            yield pd.DataFrame(rows, columns=OUTPUT)

    (found,) = spare(pages, "found")
    kept = [c for c in pages.columns if c.lower() not in OUTPUT]
    judged_pages = pages.withColumn(found, judged(F.col(quoted(url))))
    return judged_pages.select(*map(quoted, kept), *[F.col(f"{found}.{c}").alias(c) for c in OUTPUT])


def allowed(pages: DataFrame, rules: Iterable[tuple[str, str, str]], **options) -> DataFrame:
    """The pages that the rules let pass, with their own columns."""
    judged_pages = filter_urls(pages, rules, **options)
    return without(judged_pages.where(F.col("verdict") == "allow"), OUTPUT)
