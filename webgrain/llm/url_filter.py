"""URL filters: a bit-parallel wildcard automaton over canonical URLs.

Glob rules are packed into one multiword Shift-And automaton: each rule owns a
run of bits, one for its start and one for each literal, and a ``*`` is a loop
on the bit before it.  One pass over the characters of many URLs at once
simulates all rules.

Canonical form: ``.host<SEP>path``, where SEP is a symbol that no text holds, so
that a host rule can't match inside a path.  A rule's host part fits the host
and all its subdomains (the leading dot), its path part is a prefix unless it
has wildcards of its own; ``*`` and ``?`` don't cross SEP.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, narrow

SEP, ANY, STAR = -1, -2, -3
#: Characters of URLs that one step of the automaton may hold at once.
CELLS = 1 << 21


@dataclass(frozen=True)
class Rule:
    """verdict for hosts and paths that fit ``glob``, which is host/path."""

    glob: str
    verdict: str

    def symbols(self) -> list[int]:
        host, slash, path = self.glob.partition("/")
        code = lambda s: [{"*": STAR, "?": ANY}.get(c, ord(c)) for c in s]
        return [STAR, ord("."), *code(host.lower()), SEP, *code(slash + path), STAR]


class Automaton:
    """Shift-And over 64-bit words for any number of rules."""

    def __init__(self, rules: Iterable[Rule]):
        self.rules = list(rules)
        literals = [s for r in self.rules for s in r.symbols() if s != STAR]
        self.alphabet = np.array(sorted({s for s in literals if s >= 0}), dtype=np.int64)
        self.other, self.sep = len(self.alphabet), len(self.alphabet) + 1
        classes = self.sep + 1
        bits = sum(1 + sum(s != STAR for s in r.symbols()) for r in self.rules)
        words = max(1, -(-bits // 64))
        self.start, self.final = np.zeros(words, np.uint64), []
        self.step = np.zeros((classes, words), np.uint64)
        self.loop = np.zeros((classes, words), np.uint64)
        at = 0

        def put(row: np.ndarray, bit: int) -> None:
            row[bit // 64] |= np.uint64(1 << (bit % 64))

        for rule in self.rules:
            put(self.start, at)
            for s in rule.symbols():
                if s == STAR:
                    for c in range(classes):
                        if c != self.sep:
                            put(self.loop[c], at)
                    continue
                at += 1
                hit = [self.sep] if s == SEP else range(self.sep) if s == ANY else [int(np.searchsorted(self.alphabet, s))]
                for c in hit:
                    put(self.step[c], at)
            self.final.append((at // 64, np.uint64(at % 64)))
            at += 1

    def classes_of(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        if not len(self.alphabet):
            return np.full(len(codes), self.other)
        k = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[k] == codes, k, self.other)

    def match(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """A row for each URL and a column for each rule: whether it fits."""
        out = np.zeros((len(hosts), len(self.rules)), dtype=bool)
        rows = [np.concatenate([self.classes_of("." + h), [self.sep], self.classes_of(p)]) for h, p in zip(hosts, paths)]
        order = sorted(range(len(rows)), key=lambda i: len(rows[i]))
        while order:  # URLs of like length together, few at once where they are long
            longest = len(rows[order[-1]])
            n = max(1, CELLS // longest)
            part, order = order[-n:], order[:-n]
            lengths = np.array([len(rows[i]) for i in part])
            grid = np.zeros((longest, len(part)), dtype=np.int64)
            for k, i in enumerate(part):
                grid[: lengths[k], k] = rows[i]
            state = np.tile(self.start, (len(part), 1))
            first = 0  # lengths ascend: those before it are done
            for t in range(longest):
                while lengths[first] <= t:
                    first += 1
                s, c = state[first:], grid[t, first:]
                moved = s << np.uint64(1)
                moved[:, 1:] |= s[:, :-1] >> np.uint64(63)
                state[first:] = (moved & self.step[c]) | (s & self.loop[c])
            for r, (word, bit) in enumerate(self.final):
                out[part, r] = (state[:, word] >> bit) & np.uint64(1) == 1
        return out


def host_path(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path; both empty for null or without ``://``."""
    head, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return host.translate({c: c + 32 for c in range(65, 91)}), path


def filter_urls(
    df: DataFrame, rules: Iterable[Rule], *, key: str = "page_id", url: str = "url",
    defaults: Iterable[Rule] = (), otherwise: str = "allow",
) -> DataFrame:
    """key, host, path, rule (the longest that fits, else null), verdict of each row.

    verdict is the rule's; without one that of the longest of ``defaults`` that
    fits, else ``otherwise``.  Of rules of one length the first given wins.  One
    row comes for each row that is read, repeated ones too; null and malformed
    urls have an empty host and path and fit no rule with a host; an empty table
    gives an empty table.  Other columns are dropped.
    """
    rules, defaults = list(rules), list(defaults)
    source = narrow(df, key, url)
    schema = f"{key} {source.schema[key].dataType.simpleString()}, host string, path string, rule string, verdict string"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton([*rules, *defaults])
        own = np.arange(len(machine.rules)) < len(rules)
        # the rules' own before the defaults, then the longest, then the first given
        order = sorted(range(len(machine.rules)), key=lambda k: (not own[k], -len(machine.rules[k].glob), k))
        globs = np.array([*(machine.rules[k].glob if own[k] else None for k in order), None], dtype=object)
        said = np.array([*(machine.rules[k].verdict for k in order), otherwise], dtype=object)
        for batch in batches:
            parts = [host_path(u) for u in batch.column(1).to_pylist()]
            hosts, paths = [h for h, _ in parts], [p for _, p in parts]
            fits = machine.match(hosts, paths)
            best = np.append(fits[:, order], np.ones((len(fits), 1), bool), axis=1).argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(globs[best], pa.string()), pa.array(said[best], pa.string())],
                names=[key, "host", "path", "rule", "verdict"],
            )

    return source.select(F.col(key), F.col(url)).mapInArrow(lean(judge), schema)


#: The stated rules, and what holds where none of them fits.
PAGE_RULES = (Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow"))
PAGE_DEFAULTS = (Rule("ads-track.*/", "block"), Rule("*/*/ads/", "block"))


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages, PAGE_RULES, defaults=PAGE_DEFAULTS)


OP3_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*', 0) AS raw FROM u
), p AS (
  SELECT page_id, translate(coalesce(raw, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(coalesce(rest, ''), length(coalesce(raw, '')) + 1), '^[^?#]*', 0) AS path FROM h
), r AS (
  SELECT *, '.' || host AS dotted FROM p
), m AS (
  SELECT page_id, host, path, dotted,
         CASE WHEN suffix(dotted, '.example.net') AND prefix(path, '/en/') THEN 'example.net/en/'
              WHEN suffix(dotted, '.example.com') AND prefix(path, '/de/') THEN 'example.com/de/'
              WHEN suffix(dotted, '.org') AND prefix(path, '/fr/') THEN 'org/fr/'
              WHEN suffix(dotted, '.net') AND prefix(path, '/') THEN 'net/' END AS rule FROM r
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
            WHEN rule IS NOT NULL THEN 'allow'
            WHEN (regexp_matches(dotted, '\\.ads-track\\.') AND prefix(path, '/'))
              OR regexp_matches(path, '(?s)^/.*/ads/') THEN 'block'
            ELSE 'allow' END AS verdict
FROM m
"""
