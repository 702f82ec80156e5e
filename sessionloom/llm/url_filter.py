"""Operator 4: URL rules looked up in a sorted digest array.

Rules (host, path, verdict) become one file: 64-bit xxhash keys of host + path in ascending order, with
offsets into the full strings, and sorted keys of the distinct hosts with the lengths of their paths. Each
executor gets the file through the session's file distribution and memory-maps it, so its pages are shared
by all Python workers of a machine; opening it reads the header only. A batch of URLs is probed by two
vectorised binary searches: one of its host suffixes among the hosts, one of the path prefixes whose lengths
the hosts found there have. A digest hit counts only after the stored string is compared, so collisions
can't decide.

A rule fits its host and all subdomains if the URL's path starts with the rule's path; the longest rule
wins, then the longer host. URLs without a rule get the list's default verdict.

Defined results: a null URL, or one without ://, has an empty host and path; an empty host or path fits
no rule that names one; repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm._shared import columns_of, new_folder, unused

_MAGIC = b"URLD0002"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


def digest(host: str, path: str) -> int:
    return xxhash.xxh64_intdigest(f"{host}\x00{path}".encode())


def digest_bytes(rules: Sequence[Rule]) -> bytes:
    """The file. Later rules replace earlier ones of the same host and path.

    Header: magic, numbers of rules, hosts and lengths, most labels of a host (8 bytes each); then keys and string ends
    of rules, keys and length ends of hosts, the lengths, the strings. Hosts of one key share their lengths.
    """
    last = {(r.host, r.path): r for r in rules}
    rows = sorted((digest(r.host, r.path), f"{r.host}\x00{r.path}\x00{r.verdict}".encode()) for r in last.values())
    sizes: dict[int, set[int]] = {}
    for host, path in last:
        sizes.setdefault(digest(host, ""), set()).add(len(path))
    hosts = sorted(sizes)
    lengths = [n for h in hosts for n in sorted(sizes[h])]
    labels = max((host.count(".") + 1 for host, _ in last), default=0)
    array = lambda values: np.array(values, "<u8").tobytes()
    parts = [array([len(rows), len(hosts), len(lengths), labels]), array([k for k, _ in rows]), array(np.cumsum([len(t) for _, t in rows]))]
    parts += [array(hosts), array(np.cumsum([len(sizes[h]) for h in hosts])), array(lengths)]
    return b"".join([_MAGIC, *parts, *(t for _, t in rows)])


class Digests:
    """The memory-mapped file."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        if raw[:8].tobytes() != _MAGIC:
            raise ValueError(f"{path} is no digest array")
        n, hosts, lengths, self.labels = raw[8:40].view("<u8").tolist()
        cuts = 40 + 8 * np.cumsum([0, n, n, hosts, hosts, lengths])
        self.keys, self.ends, self.hosts, self.length_ends, self.lengths = (raw[a:b].view("<u8") for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        self.strings = raw[int(cuts[-1]) :]

    def at(self, k: int) -> tuple[str, str, str]:
        a = int(self.ends[k - 1]) if k else 0
        return tuple(self.strings[a : int(self.ends[k])].tobytes().decode().split("\x00"))

    def _sizes(self, hosts: list[str]) -> dict[str, list[tuple[str, list[int]]]]:
        """For each distinct host its suffixes that have rules (or share a digest with one that has), with their path lengths."""
        suffixes: dict[str, list[str]] = {}
        for h in dict.fromkeys(hosts):
            tail = h.rsplit(".", self.labels)[-self.labels :] if h and self.labels else []
            suffixes[h] = [".".join(tail[k:]) for k in range(len(tail))]
        distinct = list(dict.fromkeys(s for many in suffixes.values() for s in many))
        keys = np.array([digest(s, "") for s in distinct], np.uint64)
        at = np.searchsorted(self.hosts, keys)
        known = {}
        for k in np.flatnonzero(np.searchsorted(self.hosts, keys, "right") > at).tolist():
            place = int(at[k])
            known[distinct[k]] = self.lengths[int(self.length_ends[place - 1]) if place else 0 : int(self.length_ends[place])].tolist()
        return {h: [(s, known[s]) for s in many if s in known] for h, many in suffixes.items()}

    def find(self, hosts: list[str], paths: list[str]) -> list[tuple[str, str] | None]:
        """(rule, verdict) for each host and path."""
        sizes = self._sizes(hosts)
        asked = [[(s, p[:n]) for s, many in sizes[h] for n in many if n <= len(p)] for h, p in zip(hosts, paths, strict=True)]
        distinct = list(dict.fromkeys(a for row in asked for a in row))
        keys = np.array([digest(*a) for a in distinct], np.uint64)
        lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        found = {}
        for j in np.flatnonzero(hi > lo).tolist():
            for at in range(int(lo[j]), int(hi[j])):
                host, path, verdict = self.at(at)
                if (host, path) == distinct[j]:
                    found[distinct[j]] = (len(host) + len(path), len(host), host + path, verdict)
        best = [max((found[a] for a in row if a in found), default=None) for row in asked]
        return [b and b[2:] for b in best]


_OPEN: dict[str, Digests] = {}
_SENT: set[tuple[str, str]] = set()


def judge(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", url: str = "url", replace: bool = False) -> DataFrame:
    """pages with host, path, rule and verdict.

    Columns of pages with these names raise an error, or are replaced with replace; others pass through.
    """
    spark = pages.sparkSession
    name = distribute(spark, rules)
    taken = {"host", "path", "rule", "verdict"} & set(pages.columns)
    if taken and not replace:
        raise ValueError(f"the input already has columns {sorted(taken)}")
    pages = pages.drop(*taken)
    # A-Z only: translate() leaves other letters alone.
    rest = F.expr(f"IF(instr(`{url}`, '://') > 0, substring(`{url}`, instr(`{url}`, '://') + 3), '')")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    split = pages.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})

    def look(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        where = SparkFiles.get(name)
        if where not in _OPEN:
            _OPEN[where] = Digests(where)
        for hosts, paths in batches:
            found = _OPEN[where].find(hosts.tolist(), paths.tolist())
            yield pd.DataFrame({"rule": [f and f[0] for f in found], "verdict": [f[1] if f else default for f in found]})

    found = F.pandas_udf(look, "rule string, verdict string")("host", "path")
    (both,) = unused(split.columns, "_found")
    return split.withColumn(both, found).select(*columns_of(split), f"{both}.rule", f"{both}.verdict")


def distribute(spark: SparkSession, rules: Sequence[Rule]) -> str:
    """Puts the digest file into the shared folder and lets every executor fetch it; returns its name there."""
    name = f"url-digests-{xxhash.xxh64_hexdigest(repr([*rules]))}.bin"
    key = (spark.sparkContext.applicationId, name)
    if key not in _SENT:
        folder = new_folder(spark, "url-digests")
        to = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        out = to.getFileSystem(spark._jsc.hadoopConfiguration()).create(to)
        out.write(bytearray(digest_bytes(rules)))
        out.close()
        spark.sparkContext.addFile(f"{folder}/{name}")
        _SENT.add(key)
    return name
