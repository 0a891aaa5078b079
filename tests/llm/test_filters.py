"""URL filter, WARC archives, packing and decontamination against brute force."""

import decimal
import fnmatch
import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from webgrain.llm import archives, decontaminate, packing, url_filter
from webgrain.llm.common import narrow

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string"


def with_clashes(df):
    """Columns that operators compute or read, again under clashing names."""
    return df.select("*", F.lit(1).alias("score"), F.lit("x").alias("node"), F.lit("y").alias("key"), F.lit("z").alias(df.columns[1]), F.lit(0).alias(df.columns[1].upper()))


def test_narrow_takes_the_first_of_columns_alike(spark):
    df = with_clashes(spark.createDataFrame([(1, "a")], DOCS))
    assert narrow(df, "doc_id", "text").collect() == [(1, "a")]


# -- URL filter ------------------------------------------------------------------

URLS = [
    (1, "https://m.Example.NET/en/1"), (2, "http://example.net/de/1"), (3, "http://example.com/de/x"), (4, "http://a.example.com/fr/de/"), (5, "https://w.org/fr/"),
    (6, "https://notorg/fr/"), (7, "http://x.net"), (8, None), (9, "no scheme"), (10, "https://evil.com/x.net/en/"), (11, "http://net/"), (12, "https://m.ads-track.example.com/en/1"),
    (13, "http://h.com/a/ads/b"), (14, "http://h.com/ads/"), (15, "x://?q"), (16, ""), (16, ""), (None, "http://a.net/"), (17, "http://a.net/" + "p" * 70000), (18, "http://É.net/ü"),
]


def brute_rule(host, path):
    best = None
    for rule in ("net/", "example.net/en/", "example.com/de/", "org/fr/"):
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best)):
            best = rule
    return best


def test_url_filter_against_plain_matching(spark):
    df = with_clashes(spark.createDataFrame(URLS, "page_id long, url string"))
    rows = url_filter.filter_urls(df, url_filter.PAGE_RULES, defaults=url_filter.PAGE_DEFAULTS).collect()
    assert len(rows) == len(URLS)
    verdicts = {r.glob: r.verdict for r in url_filter.PAGE_RULES}
    for r in rows:
        want = brute_rule(r.host, r.path)
        assert r.rule == want, r
        if want:
            assert r.verdict == verdicts[want]
    by = {r.page_id: r for r in rows}
    assert (by[8].host, by[8].path, by[8].verdict) == ("", "", "allow")
    assert by[10].rule is None and by[12].verdict == by[13].verdict == "block" and by[14].verdict == "allow"


def test_automaton_matches_globs_across_words():
    rng = np.random.default_rng(0)
    globs = ["".join(rng.choice(list("ab*?"), rng.integers(1, 12))) for _ in range(60)]
    machine = url_filter.Automaton([url_filter.Rule(g + "/", "block") for g in globs])
    hosts = ["".join(rng.choice(list("ab"), rng.integers(1, 14))) for _ in range(80)]
    got = machine.match(hosts, ["/"] * len(hosts))
    for i, h in enumerate(hosts):
        for k, g in enumerate(globs):  # the rule may fit any part after a dot: here the whole host
            assert got[i, k] == fnmatch.fnmatchcase(h, g), (h, g)


def test_url_filter_of_nothing(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.filter_urls(empty, url_filter.PAGE_RULES).count() == 0
    some = spark.createDataFrame(URLS, "page_id long, url string")
    assert {r.verdict for r in url_filter.filter_urls(some, []).collect()} == {"allow"}


# -- archives --------------------------------------------------------------------

PAGES = [
    (1, "http://a b/\t", "x" * 100), (2, "http://b", "x" * 100), (0, None, "x" * 100), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""),
    (7, "u", "é\r\n\r\nWARC/1.1\r\n" * 20), (8, "u", "é\r\n\r\nWARC/1.1\r\n" * 20), (9, "u", "y" * 3_000_000), (2, "http://b", "x" * 100), (None, "n", "x" * 100),
]


def test_archives_round_trip(spark, tmp_path):
    df = with_clashes(spark.createDataFrame(PAGES, "page_id long, url string, html string"))
    rows = archives.convert_pages(df, f"file://{tmp_path}/warc").collect()
    assert len(rows) == len(PAGES)
    first = defaultdict(list)
    for k, _, body in PAGES:
        if k is not None:
            first[body].append(k)
    want = []
    for k, _, body in PAGES:
        data = (body or "").encode()
        low = min(first[body]) if len(data) >= 100 and first[body] and len(set(first[body])) > 1 else None
        again = low is not None and low != k
        want.append((k, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", low if again else None))
    key = lambda r: (str(r[0]), r[1], r[2], r[3])
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("kind,keys", [("smallint", [3, 2, 1]), ("decimal(9,1)", [decimal.Decimal("2.5"), decimal.Decimal("1.0"), None]), ("string", ["b+ %\r\n:é", "a", ""])])
def test_archives_with_keys_of_any_type(spark, tmp_path, kind, keys):
    df = spark.createDataFrame([(k, "u", "x" * 100) for k in keys], f"page_id {kind}, url string, html string")
    rows = archives.convert_pages(df, f"file://{tmp_path}/warc").collect()
    low = min(k for k in keys if k is not None)
    assert sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in rows) == sorted((str(k), "response" if k == low else "revisit", str(None if k == low else low)) for k in keys)


def test_archive_files_are_bounded_by_bytes(spark):
    records = spark.createDataFrame([(5,), (archives.FILE_BYTES // 4,)], "bytes long")
    assert archives.records_per_file(records) == 3 and archives.records_per_file(records.where("bytes = 5")) == archives.FILE_RECORDS
    assert archives.records_per_file(records.limit(0)) == archives.FILE_RECORDS


def test_archives_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert archives.convert_pages(empty, f"file://{tmp_path}/none").count() == 0


def test_arc_versions_and_declared_lengths():
    for version in (1, 2):
        data = archives.arc_version_block(version) + archives.arc_record(version, "http://a/", b"one\n\ntwo", "20010203040506") + archives.arc_record(version, None, b"")
        a, b = archives.read_arc(data)
        assert (a.version, a.url, a.body, archives.iso_date(a.date)) == (version, "http://a/", b"one\n\ntwo", "2001-02-03T04:05:06Z")
        assert (b.url, b.body, archives.iso_date(b.date)) == (None, b"", "1970-01-01T00:00:00Z")
    for bad in (b"http://a 1.1.1.1 2001 text/html ten\nx", archives.arc_version_block(1) + b"http://a 1.1.1.1 2001 text/html 10\nx", b"no end"):
        with pytest.raises(ValueError):
            list(archives.read_arc(bad))


def test_arc_url_with_blanks_is_read_from_the_right():
    (r,) = archives.read_arc(archives.arc_version_block(1) + b"http://a b c 1.1.1.1 20010203 text/html 2\nok\n")
    assert r.url == "http://a b c" and r.body == b"ok"


def test_ids_are_stable():
    assert archives.record_id("u", "d", "x") == archives.record_id("u", "d", "x") != archives.record_id("u", "d", "y")


# -- packing ---------------------------------------------------------------------


def check_pieces(texts, rows, tiers=packing.TIERS):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(packing.tokenizer_path())
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r)
    for k, text in texts:
        ids = np.array([*exact.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for p in sorted(got[k], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids)) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    windows = defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append(r)
    padded = 0
    for w in windows.values():
        at = 0
        for p in sorted(w, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= tiers[-1] and {p.sequence_tokens for p in w} == {at}
        padded += {p.padding for p in w} != {0}
    return padded, len(windows)


def test_packing_is_exact_and_full(spark):
    rng = np.random.default_rng(1)
    texts = [(i, " ".join(rng.choice(["alpha", "beta!!", "Été", "x9", "\n"], rng.integers(0, 900)))) for i in range(160)]
    texts += [(200, None), (201, ""), (202, "word " * 30000), (203, "<|endoftext|> a"), (204, "漢字 \u200b \U0001f600"), (205, "a" * 5000), (206, "\x85\xa0  \u2028x")]
    df = with_clashes(spark.createDataFrame(texts, DOCS).coalesce(2))
    rows = packing.pack(df, pool_tokens=40_000).collect()
    padded, windows = check_pieces(texts, rows)
    assert padded <= 2 and windows > 100
    by = {r.sequence_id: (r.tier, r.sequence_tokens, r.step_group) for r in rows}
    assert sum(t == used for t, used, _ in by.values()) >= len(by) - 2  # windows of each size are full, but the tasks' last ones
    assert len({t for t, _, _ in by.values()}) >= 3
    for tier in packing.TIERS:
        groups = [sum(g == k and t == tier for t, _, g in by.values()) for k in range(packing.STEP_GROUPS)]
        assert max(groups) - min(groups) <= 1


def test_packing_repeated_and_no_rows(spark):
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0
    twice = packing.pack(spark.createDataFrame([(1, "a b")] * 2, DOCS)).collect()
    assert sum(r.length for r in twice) == 2 * twice[0].doc_tokens


@pytest.mark.parametrize("kind,keys", [("smallint", [1, 2]), ("decimal(9,1)", [decimal.Decimal("1.5"), None]), ("string", ["a", "a"]), ("double", [0.5, 1.5]), ("struct<a:int,b:string>", [(1, "x"), (2, None)])])
def test_packing_with_keys_of_any_type(spark, kind, keys):
    rows = packing.pack(spark.createDataFrame([(k, "a b") for k in keys], f"doc_id {kind}, text string"), with_ids=True).collect()
    assert sorted(str(r.doc_id if not isinstance(r.doc_id, tuple) else tuple(r.doc_id)) for r in rows) == sorted(map(str, keys)) and {len(r.ids) for r in rows} == {3}


def test_each_tier_is_packed_and_gaps_filled_from_shorter_ones():
    ids = lambda n: np.zeros(n, np.uint32)
    made, left = packing.pack_pool([(k, 0, ids(n)) for k, n in enumerate([1000, 24, 700, 300, 24, 500, 10, 300, 212, 100, 28, 2])])
    assert [(size, sorted(len(p[2]) for p in w)) for size, w in made] == [(1024, [24, 1000]), (1024, [24, 300, 700]), (512, [2, 10, 500]), (512, [212, 300]), (128, [28, 100])] and not left
    made, left = packing.pack_pool([(0, 0, ids(700)), (1, 0, ids(600))])  # the shorter one is cut
    assert [[(p[0], p[1], len(p[2])) for p in w] for _, w in made] == [[(0, 0, 700), (1, 0, 324)]] and [(p[0], p[1], len(p[2])) for p in left] == [(1, 324, 276)]
    rng = np.random.default_rng(3)
    some = [(k, 0, ids(int(n))) for k, n in enumerate(rng.integers(1, 1025, 500))]
    made, left = packing.pack_pool(some)
    assert all(sum(len(p[2]) for p in w) == size for size, w in made) and sum(len(p[2]) for p in left) < 1024
    assert sum(len(p[2]) for _, w in made for p in w) + sum(len(p[2]) for p in left) == sum(len(p[2]) for p in some)


# -- decontamination ---------------------------------------------------------------

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return _WORD.findall((text or "").translate(LOW))


def brute_hits(docs, tests, size=10):
    windows = defaultdict(set)
    for item, text in tests:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i : i + size])].add(str(item))
    out = []
    for k, text in docs:
        w, hit, items = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i : i + n]))
                if found:
                    hit.update(range(i, i + n))
                    items |= found
        out.append((k, len(w), len(hit), sorted(items)))
    return out


TEXT = "The quick, brown fox jumps over ÉTÉ lazy dogs while seven wizards 42 quietly wait beyond the Hills"
TESTS = [(1, TEXT), (2, "two words"), (3, None), (4, "!!!"), (5, "the the the the the the the the the the the"), (6, TEXT), (7, "Two WORDS")]


def test_decontamination_against_brute_force(spark):
    rng = np.random.default_rng(2)
    filler = lambda n: " ".join(rng.choice(["the", "fox", "two", "of", "jumps", "ÉTÉ", "été"], n))
    docs = [(i, filler(rng.integers(0, 60))) for i in range(60)]
    docs += [
        (100, TEXT.upper()), (101, filler(30) + "; " + TEXT.replace(" ", "--") + " " + filler(9)), (102, None), (103, ""), (104, "two-WORDS two words"), (105, "the " * 40),
        (106, TEXT.split(" while")[0]), (107, (filler(50) + " " + TEXT + " ") * 100), (107, "two words"), (None, TEXT),
    ]
    df, tests = with_clashes(spark.createDataFrame(docs, DOCS)), spark.createDataFrame(TESTS, "item_id long, text string")
    rows = decontaminate.decontaminate(df, tests).collect()
    key = lambda r: (str(r[0]), r[1], r[2])
    got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in rows), key=key)
    assert got == sorted(brute_hits(docs, TESTS), key=key)
    assert all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r["items"]) for r in rows)


def test_decontamination_by_shuffle_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(decontaminate.sized, "__defaults__", (0, 0))
    docs, tests = spark.createDataFrame([(1, TEXT), (2, "clean"), (3, None)], DOCS), spark.createDataFrame(TESTS, "item_id long, text string")
    got = {r.doc_id: r.n_hit for r in decontaminate.decontaminate(docs, tests).collect()}
    assert got == {1: len(words(TEXT)), 2: 0, 3: 0}
    assert decontaminate.decontaminate(docs.limit(0), tests).count() == 0
    assert {r.n_hit for r in decontaminate.decontaminate(docs, tests.limit(0)).collect()} == {0}


def test_phrase_and_proximity_search(spark):
    docs = spark.createDataFrame([(1, "red green blue"), (2, "red and green blue"), (3, "blue red"), (4, None)], DOCS)
    phrases = spark.createDataFrame([(9, "red green blue")], "item_id long, text string")
    assert [(r.doc_id, r.exact) for r in decontaminate.search(docs, phrases).collect()] == [(1, True)]
    near = {(r.doc_id, r.exact) for r in decontaminate.search(docs, phrases, slop=1).collect()}
    assert near == {(1, True), (2, False)}


def test_search_is_by_row(spark):
    rows = [(1, "alpha zzz"), (1, "yyy beta"), (2, "alpha beta alpha beta"), (2, "alpha beta alpha beta"), (None, "an alpha beta"), (None, "alpha"), (3, "beta")]
    phrases = spark.createDataFrame([(9, "Alpha beta"), (8, "alpha, BETA"), (7, None), (6, "!")], "item_id long, text string")
    found = decontaminate.search(spark.createDataFrame(rows, DOCS), phrases).collect()
    assert sorted((str(r.doc_id), r.item_id, r.start, r.exact) for r in found) == sorted((k, i, s, True) for k, s in (("2", 0), ("2", 2), ("None", 1)) for i in ("8", "9"))
    assert decontaminate.search(spark.createDataFrame([], DOCS), phrases).count() == 0
    assert decontaminate.search(spark.createDataFrame(rows, DOCS), phrases.limit(0)).count() == 0
