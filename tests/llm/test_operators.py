"""Each operator against a plain version, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import base64
import hashlib
import random
import re
import textwrap
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitsift.llm import bpe, decontaminate, exact_dedup, html_text, licenses, ngram_join, quality, suffix_dedup, toxicity, warc
from bitsift.llm.components import connected_components
from bitsift.llm.queries import tokenizer

WORDS = ["alpha", "Beta", "gamma", "déjà", "x1", "the", "of", "zeta"]
HARD = [None, "", " \n\t", "a", "É", "a b c", "A  b\nc", " ", "'s 't", "x" * 3000, "ab " * 2000]


def texts(seed, n, vocabulary=WORDS, longest=60):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, longest))) for _ in range(n)]
    out = list(base)
    for t in base:
        w = t.split(" ")
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append(" ".join(w))
    return out + HARD


def docs_of(spark, rows, extra=True):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    # names that the operators use inside
    return df.withColumns({c: F.lit("clash") for c in ("id", "h", "hash", "digest", "uid", "copy", "n", "words")}) if extra else df


@pytest.fixture(scope="module")
def rows():
    return texts(1, 40)


def test_exact_dedup(spark, rows):
    groups = defaultdict(list)
    for i, t in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    want = {}
    for norm, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            want[i] = (keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest())
    docs = docs_of(spark, rows)
    for capacity in (50_000, 3):
        got = {r["id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_groups(docs, capacity=capacity).collect()}
        assert got == want
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0
    assert {r["doc_id"] for r in exact_dedup.keep_first(docs).collect()} == {i for i, w in want.items() if w[2]}
    twice = docs.unionByName(docs.where("doc_id < 5")).unionByName(docs.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    assert exact_dedup.keep_first(twice).count() == sum(w[2] for w in want.values())


def test_exact_dedup_splits_pages_and_collisions(spark, rows):
    """Capacity 1, and hashes that are all the same or of four values: splits and pages change nothing."""
    docs = docs_of(spark, rows + [rows[0]] * 30 + [None] * 5)
    plain = sorted(map(str, exact_dedup.exact_groups(docs).drop("bucket").collect()))
    for capacity, hasher in ((1, exact_dedup.hash_of), (3, lambda norm: F.lit(7).cast("long")), (7, lambda norm: F.shiftleft(F.length(norm).cast("long") % 4, 50))):
        index = exact_dedup.build_index(docs, "doc_id", "text", capacity, hasher)
        assert index.count() == len(rows) + 35 and index.where("pages > 1").count()
        assert index.groupBy("bucket", "page").count().where(f"count > {3 * capacity + 8}").isEmpty()
        assert sorted(map(str, exact_dedup.exact_groups(docs, capacity=capacity, hasher=hasher).drop("bucket").collect())) == plain


def test_exact_dedup_keeps_columns_and_the_longest(spark):
    """Names that the stage could use itself stay; of one id's equal texts the longest stays."""
    own = [(5, "ab", 1), (5, "a b", 2), (6, "a b", 3), (None, "n", 4), (None, "n ", 5), (7, None, 6), (8, "", 7)]
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in own], "doc_id long, text string, gone_id int, Digest string, keep_points string, kept_id string")
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r["gone_id"], r["Digest"]) for r in kept.collect()) == [(2, "x"), (5, "x"), (6, "x")]


def test_directory_splits_overfull_buckets():
    buckets = exact_dedup.directory({0: 5, 1: 5, 2: 1, 7: 9}, 6, 3)
    assert buckets == [(3, 0), (3, 1), (2, 1), (2, 2), (3, 6), (3, 7)]
    assert exact_dedup.directory({}, 6, 3) == [(0, 0)]


@pytest.mark.parametrize("block_bytes", [16 << 20, 200])
def test_decontamination(spark, rows, block_bytes):
    items = [(1, rows[0]), (2, " ".join(rows[3].split()[2:16])), (3, "gamma the of"), (4, None), (5, " - "), (6, "zeta"), (7, rows[5])]
    want = decontaminate.brute_force(list(enumerate(rows)), [i for i in items if i[1]])
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("id", F.lit(0))
    docs = docs_of(spark, rows)
    got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.digest(decontaminate.contamination_spans(docs, bench, block_bytes=block_bytes)).collect()}
    assert got == want
    kept = {r["doc_id"] for r in decontaminate.reject(docs, bench, block_bytes=block_bytes).collect()}
    assert kept == {i for i, w in want.items() if not w[4]}
    assert decontaminate.contamination_spans(docs, bench.limit(0)).count() == len(rows)
    assert decontaminate.contamination_spans(docs.limit(0), bench).count() == 0


def test_decontamination_rows(spark):
    """One row for each input row, whatever their ids and however many blocks the benchmark has."""
    item = "one two three four five six seven eight nine ten eleven"
    own = [(1, item), (1, "clean"), (1, f"so {item} and {item}"), (None, item), (None, None), (2, f"{item[:-7]} x")]
    docs = spark.createDataFrame(own, "doc_id long, text string")
    bench = spark.createDataFrame([(i, item if i % 2 else f"text {i} " * 9) for i in range(8)], "item_id long, text string")
    got = [sorted(map(str, decontaminate.digest(decontaminate.contamination_spans(docs, bench, block_bytes=b)).collect())) for b in (16 << 20, 100)]
    assert got[0] == got[1] and len(got[0]) == 6
    assert sorted(r["n_hit"] for r in decontaminate.contamination_spans(docs, bench, block_bytes=100).selectExpr("aggregate(zip_with(ends, starts, (b, a) -> b - a), 0L, (s, n) -> s + n) AS n_hit").collect()) == [0, 0, 10, 11, 11, 22]


def test_warc(spark, tmp_path):
    pages = [(1, "http://a/é x", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", "only"), (6, "u", "same"), (7, "u", "fake\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 50), (None, "u", "none"), (8, "u", "long" * 20000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("sha", F.lit("clash"))
    owner = {}
    for i, _, h in pages:
        if i is not None:
            owner[h or ""] = max(i, owner.get(h or "", 0))
    for compress in (False, True):
        path = f"{tmp_path}/w{compress}"
        warc.write(warc.with_revisits(df), path, compress)
        for split in (32 << 20, 500):
            got = warc.read(spark, path, split_bytes=split).collect()
            assert len(got) == len(pages)
            for r in got:
                html = next(h or "" for i, _, h in pages if i == r["page_id"])
                top = owner.get(html)
                first = r["page_id"] is None or r["page_id"] == top
                assert (r["record_type"], r["refers_to"]) == (("response", None) if first else ("revisit", top))
                assert r["payload_bytes"] == len(html.encode()) and r["payload_digest"] == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
                assert r["payload"] == (html.encode() if first else None)
        only = warc.read(spark, path, payload="false").where("record_type = 'revisit' AND page_id IN (1, 5)")
        assert [r["page_id"] for r in only.collect()] == [1]
    assert warc.archive(df.limit(0)).count() == 0


def test_licenses(spark, rows):
    own = [*rows, "MIT license mit license", "under the Apache\nLicense, version 2.0", "released under the mit license", "cc by cc-by-nc", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and documentation files"]
    phrases = {tuple(p.split()): label for p, label in licenses.PHRASES.items()}
    docs = docs_of(spark, own)
    got = {r["id"]: r for r in licenses.scan(docs).collect()}
    assert len(got) == len(own)
    for i, t in enumerate(own):
        low = (t or "").translate({c: c + 32 for c in range(65, 91)})
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(j, label) for p, label in phrases.items() for j in range(len(w)) if tuple(w[j : j + len(p)]) == p]
        added, best = set(), 0.0
        for line in low.split("\n"):
            words = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line))
            for label, template in licenses.TEMPLATES:
                tw = licenses.template_words(template)
                if len(words & set(tw)) >= licenses.need_of(len(tw), licenses.CONTAINMENT):
                    added.add(label)
                    best = max(best, len(words & set(tw)) / len(tw))
        base = {label for _, label in at}
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min((j for j, _ in at), default=None), max((j for j, _ in at), default=None))
        assert r["base_labels"] == ",".join(sorted(base)) and r["labels"] == ",".join(sorted(base | added))
        assert r["score"] == (1.0 if at else best)
    assert licenses.scan(docs.limit(0)).count() == 0
    assert licenses.scan(docs, templates=[]).where("labels <> base_labels").count() == 0


def test_licenses_wrapped(spark):
    """Notices that are wrapped over lines count; words that are parted by a blank line, or stand far apart, don't."""
    own, want = [], []
    for label, template in licenses.TEMPLATES:
        for width in (20, 40, 80):
            own += [f"Some code.\n\n{textwrap.fill(template, width)}\nand more of it", textwrap.fill(template, width, initial_indent=" * ", subsequent_indent=" * ")]
            want += [{label}] * 2
    bsd = licenses.TEMPLATES[1][1].split()
    own += [" ".join(bsd[:10]) + "\n \n" + " ".join(bsd[10:]), "\n".join(" ".join([w, *["filler"] * 30]) for w in bsd), None]
    want += [set()] * 3
    got = {r["id"]: r for r in licenses.scan(docs_of(spark, own)).collect()}
    for i, labels in enumerate(want):
        assert labels <= set(got[i]["labels"].split(",")) and (labels or got[i]["labels"] == "" and got[i]["score"] == 0)
        assert not labels or got[i]["score"] == 1


def test_licenses_positional_filter(spark):
    """The filter passes over pairs, and loses none that meet; only A-Z are lower-cased."""
    rng = random.Random(8)
    pool = sorted({w for _, t in licenses.TEMPLATES for w in licenses.template_words(t)})
    own = [" ".join(rng.sample(pool, rng.randint(3, 30))) for _ in range(150)] + [t for _, t in licenses.TEMPLATES] + ["c\u212a by \u212aind mit license"]
    docs = docs_of(spark, own)
    pairs = [licenses.candidates(docs, "doc_id", "text", licenses.TEMPLATES, 0.9, positional).select("id", "template").distinct() for positional in (False, True)]
    assert 0 < pairs[1].count() < pairs[0].count()
    met = [{(i, label) for i, t in enumerate(own) for label, x in licenses.TEMPLATES if len(set(licenses.word_run(t)) & set(licenses.word_run(x))) >= licenses.need_of(len(licenses.template_words(x)), 0.9)}]
    labels = {(r["id"], x) for r in licenses.scan(docs).collect() for x in r["labels"].split(",")}
    assert {m for m in met[0] if m[0] >= 150} <= labels


def test_bpe_all_code_points(spark):
    """Every code point between a letter, a number and a blank is cut as the library cuts it."""
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = tokenizer()
    own = bpe.encoder(path, pattern)
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=own.ranks, special_tokens={})
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    lines = ["".join(f"a{c}1{c} " for c in points[i : i + 4096]) for i in range(0, len(points), 4096)]
    for text, (ids, back) in zip(lines, own.decimals(lines), strict=True):
        assert back == text.encode() and ids == ",".join(map(str, library.encode_ordinary(text)))
    for text in ("a\U00018da7a", "\u0558x 12\u0559"):
        assert own.encode(text) == library.encode_ordinary(text)


def test_bpe(spark, rows):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = tokenizer()
    own = bpe.Encoder.load(path, pattern)
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(4)
    parts = ["'", "'s", "'re", "'ll", "a", "é", "ß", " ", "  ", "\n", " ", "12", "²", "😀", "中", "!!", "tion", "<|endoftext|>", "́"]
    more = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    got = {r["doc_id"]: r for r in bpe.encode_documents(docs_of(spark, rows + more), path, pattern).collect()}
    for i, t in enumerate(rows + more):
        ids = library.encode_ordinary(t or "")
        assert got[i]["token_ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    piece = "unbelievable".encode()
    table = own.extend(piece, [])
    assert own.extend(piece, table[:5]) == table
    new, edited = own.edit(piece, list(table), 8, 2, b"ing")
    assert own.trace(edited) == own.encode_piece(new) == library.encode_ordinary(new.decode())
    encoded = bpe.encode_column(docs_of(spark, rows[:5]), path, pattern)
    assert {r["id"]: bytes(r["bytes"]).decode() for r in bpe.decode_column(encoded, path, pattern).collect()} == dict(enumerate(rows[:5]))


def test_html_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
    <nav><a href=/x>menu</a></nav><div class="cookie-notice">cookies</div><main><article><h1>Head&amp;line</h1><p>First <b>bold<p>Second
    &eacute; <a href=y>link</a><br>line</p><ul><li>one<li>two</ul><script>var a = "</p>";</script><div class="ad">buy</div><aside>side</aside>
    <section id="comments"><p>me too</p></section></article></main><footer>foot</footer>"""
    assert html_text.main_text(page) == "Head&line First bold Second é link line one two"
    plain = "<body><div class=menu><a>a</a><a>b</a></div><div><p>Long text of the page here.<p>And more of it there.</div><div>x <a>y</a></div>"
    assert html_text.main_text(plain).startswith("Long text of the page here. And more of it there.")
    assert [html_text.main_text(t) for t in (None, "", "<p></p>", "just text &lt;b&gt;")] == ["", "", "", "just text <b>"]
    assert html_text.main_text("<div>" * 20000 + "deep") == "deep"


def test_html_names_of_article_parts():
    """Headings, sections and wrappers that have a word of boilerplate in their name are text; real boilerplate isn't."""
    page = """<body><div class="content-with-sidebar"><div class="ad-slot-2">buy</div><article class="social-science"><h2 id="related-work">Related</h2><p>One.</p>
    <section id="discussion"><h2 id="history-of-advertising">Past</h2><p>Two.</p></section><div class="layout-sidebar">Three.</div>
    <div class="share-buttons">share</div><div class="ad">buy</div><section class="comments">me too</section><h3 class="notice">Four</h3></article></div>"""
    assert html_text.main_text(page) == "Related One. Past Two. Three. Four"
    for name in ("content-with-sidebar", "layout-sidebar", "sidebar", "widget"):
        assert html_text.main_text(f'<body><div class="{name}"><p>Long text of the page.</p><p>And more.</p></div></body>') == "Long text of the page. And more."
    assert html_text.main_text('<body><article><p>Short.</p><div class="ad">Buy this and that here.</div></article></body>') == "Short."
    longer = '<body><article><p>Short text.</p></article><div class="comments"><p>%s</p></div></body>' % ("I say so. " * 50)
    assert html_text.main_text(longer) == "Short text."


ARTICLE = "<h1>Head of it</h1><p>First long paragraph of the page, with <a href=x>a link</a>.</p><p>Second one, as long as the first.</p><p><a href=y>All of it is a link.</a></p><p>Short.</p>"
TEXT = "Head of it First long paragraph of the page, with a link. Second one, as long as the first. All of it is a link. Short."


@pytest.mark.parametrize("open_, close", [("<article>", "</article>"), ("<div>", "</div>"), ('<form id="aspnetForm"><div>', "</div></form>"), ('<div class="page-with-sidebar"><div>', "</div></div>"), ('<div class="right-sidebar"><div>', "</div></div>"), ('<aside class="widget"><section>', "</section></aside>")])
def test_html_wrappers(open_, close):
    """What holds the page is no boilerplate, whatever its name; the element <article> decides nothing."""
    page = f"<html><body><nav><a href=a>Home</a> <a href=b>News of today</a></nav><div><a href=c>one</a> <a href=d>two</a></div>{open_}{ARTICLE}{close}<footer>All rights</footer></body></html>"
    assert html_text.main_text(page) == TEXT


def test_html_density_decides(monkeypatch):
    """Without names and telling elements only density parts text from lists of links; with a constant density it can't."""
    links = "<div>" + "".join(f"<div><a href={i}>Some link {i}</a></div>" for i in range(12)) + "</div>"
    page = f"<body>{links}<div>{ARTICLE}</div>{links}</body>"
    assert html_text.main_text(page) == TEXT
    real = html_text.Page.densities
    monkeypatch.setattr(html_text.Page, "densities", lambda self: ([1.0] * len(self.tag), [float(sum(p == i for p in self.parent)) for i in range(len(self.tag))], *real(self)[2:]))
    assert html_text.main_text(page) != TEXT


def test_html_densities_equal_brute_force():
    """Every node's composite density by its formula, from counts over all its descendants."""
    import math

    rng = random.Random(9)

    def tree(depth):
        parts = []
        for _ in range(rng.randint(1, 4)):
            tag = rng.choice(["div", "p", "span", "a", "ul", ""])
            parts.append("w" * rng.randint(1, 9) + " " if not tag or depth == 0 else f"<{tag}>{tree(depth - 1) if tag != 'a' else 'link'}</{tag}>")
        return "".join(parts)

    for _ in range(60):
        page = html_text.Page(f"<body>{tree(4)}</body>")
        n = len(page.tag)
        up = [[i] for i in range(n)]
        for i in range(1, n):
            up[i] = [i, *up[page.parent[i]]]
        size = lambda node, in_link: sum(sum(map(len, t.split())) for m, t in page.pieces if node in up[m] and (not in_link or any(page.tag[x] == "a" for x in up[m])))
        own, sums, chars, link_chars = page.densities()
        body = page.tag.index("body")
        want = []
        for i in range(n):
            c, lc = size(i, False), size(i, True)
            t = max(1, sum(i in up[m] and m != i for m in range(n)))
            lt = max(1, sum(i in up[m] and m != i and page.tag[m] == "a" for m in range(n)))
            assert (chars[i], link_chars[i]) == (c, lc)
            base = math.log(math.log(c / max(1, c - lc) * lc + size(body, True) / max(1, size(body, False)) * c + math.e)) if c else 0
            top = math.log(max(1, c / max(1, lc) * t / lt)) if c else 0
            want.append((c / t * top / max(1e-3, base) if base > 0 else c / t * top) if c else 0)
        assert own == pytest.approx(want)
        assert sums == pytest.approx([sum(want[m] for m in range(1, n) if page.parent[m] == i and page.tag[m] not in html_text.INLINE) for i in range(n)])


def test_html_query(spark):
    df = spark.createDataFrame([(1, "u", "<p>a b</p>"), (2, None, None), (None, "v", "")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted((tuple(r) for r in html_text.extract(df).collect()), key=str)
    assert got == sorted([(1, "u", "a b", 3), (2, None, "", 0), (None, "v", "", 0)], key=str)


def test_segments_equal_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 12)
        gains = [rng.choice([0, 0, 0.5, 1.5, 2, 3]) for _ in range(n)]
        scores = [g - 1.0 for g in gains]
        found = toxicity.segments([(i, g) for i, g in enumerate(gains) if g], 1.0)
        best = max((sum(scores[a:b]) for a in range(n) for b in range(a + 1, n + 1)), default=0)
        assert max((s for s, _, _ in found), default=0.0) == pytest.approx(max(best, 0.0))
        for s, a, b in found:
            assert s == pytest.approx(sum(scores[a:b])) and s > 0
        assert all(x[2] <= y[1] for x, y in zip(sorted(found, key=lambda f: f[1]), sorted(found, key=lambda f: f[1])[1:]))


def labelled(spark):
    rng = random.Random(5)
    out, marks = [], []
    for i in range(600):
        words = [rng.choice(WORDS) for _ in range(rng.randint(20, 80))]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["vilest", "vilemo", "nastyword"])
        out.append((i, " ".join(words), f"s{i % 3}", "en", 10))
        marks.append((i, 0 if bad else 1, int(bad)))
    docs = spark.createDataFrame(out + [(600, None, None, None, None), (601, "", "s", "xx", 0)], "doc_id long, text string, source string, lang string, n_chars long")
    return docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs.withColumn("id", F.lit("clash")), labels, lambda i: ~toxicity.held_out(i))
    got = {r["id"]: r for r in toxicity.score(docs, model).collect()}
    held = {r["doc_id"] for r in docs.where(toxicity.held_out(F.col("doc_id"))).collect()}
    assert len(held) > 50 and len(got) == 602
    right = sum((got[i]["score"] >= 0.5) == (i % 4 == 0) for i in held if i < 600)
    assert right / sum(i < 600 for i in held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[600]["score"] < 0.5 and not got[601]["passages"]
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["score"] < 0.5}
    empty = toxicity.train(docs, labels.limit(0), lambda i: ~toxicity.held_out(i))
    assert toxicity.score(docs.limit(3), empty).where("score <> 0").count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join(spark, seed):
    own = texts(seed, 30, [f"w{i}" for i in range(40)], 90)
    rng = random.Random(seed)
    base = [f"q{i}" for i in range(60)]
    for _ in range(40):  # a family around the threshold
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(60)] = f"z{rng.randrange(5)}"
        own.append(" ".join(w))
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(docs_of(spark, own)).collect()}
    want = ngram_join.brute_force(list(enumerate(own)))
    assert got == want
    assert {r["doc_id"] for r in ngram_join.keep_one(docs_of(spark, own)).collect()} == {i for i, (_, c) in want.items() if c == i}


def test_ngram_join_hot_tokens(spark):
    """Tokens dealt to cells, no bands and a column of the stage's own name give the same rows."""
    rng = random.Random(3)
    own = []
    for _ in range(30):
        w = [f"q{i}" for i in range(60)]
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(60)] = f"z{rng.randrange(5)}"
        own.append(" ".join(w))
    docs = docs_of(spark, own).withColumn("gone_id", F.lit("clash"))
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(docs, bands=0, hot_token=3).collect()}
    assert got == ngram_join.brute_force(list(enumerate(own)))


def test_word_hashes_of_regular_strings():
    """Strings of the Thue-Morse sequence and its complement collide under every polynomial modulo 2**64."""
    own = "".join("ab"[i.bit_count() & 1] for i in range(1024))
    other = own.translate({97: 98, 98: 97})
    sets = ngram_join.shingle_sets([t.encode() for n in (8, 16, 60, 64, 65, 1024) for t in (own[:n], other[:n])], 4)
    assert len({int(s[0]) for s in sets}) == 12


@pytest.mark.parametrize("extra", [10, 15])
def test_ngram_join_contained(spark, extra):
    """Sets contained in larger ones whose own shingles are rare, without bands: only the matrix can find these links."""
    own = []
    for f in range(12):
        common = [f"c{f}x{j}" for j in range(103 - extra)]  # 100 - extra shingles of 4 words
        rare = [f"r{f}x{j}" for j in range(extra)]
        own += [" ".join(common), " ".join(common + rare)]
        own += [" ".join(common[:-40] + [f"o{f}x{i}x{j}" for j in range(60)]) for i in range(5)]  # makes most common shingles frequent
    want = ngram_join.brute_force(list(enumerate(own)))
    assert all(want[7 * f + 1][1] == 7 * f for f in range(12))
    for bands in (0, ngram_join.BANDS):
        got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(docs_of(spark, own), bands=bands).collect()}
        assert got == want


def test_ngram_join_edges(spark):
    docs = docs_of(spark, ["a b c d e", "A b c  d e", None]).unionByName(docs_of(spark, ["a b c d e"]).withColumn("doc_id", F.lit(None).cast("long")))
    got = sorted(tuple(r) for r in ngram_join.ngram_components(docs.unionByName(docs.where("doc_id = 0"))).where("id is not null").collect())
    assert got == [(0, 2, 0), (0, 2, 0), (1, 2, 0), (2, 0, 2)]
    assert ngram_join.ngram_components(docs.limit(0)).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5), (4, 1), (20, 7)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7, 20: 7} | {100 + i: 100 for i in range(41)}


def test_suffix_dedup(spark, rows):
    rng = random.Random(6)
    parts = ["".join(rng.choice("abcé ") for _ in range(n)) for n in (95, 100, 130, 180, 240)] + ["x" * 150]
    own = rows + ["".join(rng.choice(parts)[rng.randrange(40) :] for _ in range(rng.randint(0, 4))) for _ in range(60)]
    got = {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(docs_of(spark, own)).collect()}
    assert got == suffix_dedup.brute_force(list(enumerate(own)))
    assert suffix_dedup.remove_repeats(docs_of(spark, own).limit(0)).count() == 0


def test_loser_tree_and_front_coding():
    rng = random.Random(7)
    runs = [sorted((bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))), b"l", i, 0, j) for j in range(rng.randint(0, 30))) for i in range(5)]
    coded = [suffix_dedup.front_code(r) for r in runs]
    assert [[tuple(e[1:]) for e in suffix_dedup.front_decode(c)] for c in coded] == runs
    merged = list(suffix_dedup.loser_tree([suffix_dedup.front_decode(c) for c in coded]))
    assert [m[1] for m in merged] == sorted(e[0] for r in runs for e in r)
    before = b""
    for n, right, *_ in merged:
        assert n == suffix_dedup.common_prefix(before, right)
        before = right
    for size in (3, 40):  # pairs and windows find the same
        group = [(b"k" * 40 + bytes(rng.choice(b"ab") for _ in range(60)), bytes(rng.choice(b"a") for _ in range(60)), i % 7, 0, 1000 * i) for i in range(size)]
        spans = [defaultdict(set), defaultdict(set)]
        for kind, pairs in enumerate((100, 0)):
            for i, h, a, b in suffix_dedup.group_spans(group, pairs=pairs):
                spans[kind][i, h].update(range(a, b))
        assert spans[0] == spans[1]


def test_quality(spark):
    docs, labels = labelled(spark)
    noisy = docs.withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.concat_ws(" ", F.transform(F.split("text", " "), lambda w: F.concat(w, F.lit("###"))))).otherwise(F.col("text"))).withColumn("id", F.lit("clash"))
    odd = noisy.where("doc_id IN (1, 4)").unionByName(noisy.where("doc_id = 2").withColumn("doc_id", F.lit(None).cast("long")))  # repeated ids, no id
    made = quality.features(noisy.unionByName(odd))
    keep = lambda i: ~toxicity.held_out(i)
    model = quality.train(made, labels.where("doc_id < 300").unionByName(spark.createDataFrame([(7, None, None), (None, 1, 0)], labels.schema)), keep)
    scored = quality.score(made, model).collect()
    got = {r["id"]: r["score"] for r in scored}
    assert len(scored) == 605 and len(got) == 603 and all(0 <= s <= 1 for s in got.values())
    assert sum((got[i] >= 0.5) == (i % 4 != 0) for i in range(600)) > 590
    assert model.pseudo > 200  # of 300 rows without a label and those held out
    assert quality.train(made, labels.limit(0), keep).joint is None
    assert quality.score(made.limit(0), model).count() == 0


def two_views(seed, n):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n).astype(float)
    sign = (2 * y - 1)[:, None]
    return rng.normal(sign * 0.45, 1, (n, 16)), rng.normal(sign * 0.55, 1, (n, 12)), y


def test_quality_exchange_helps():
    alone, together = [], []
    for seed in range(5):
        text, meta, y = two_views(seed, 6000)
        part = np.arange(60) % 3 > 0
        pool = lambda views, calibrated, base, t=text[60:4000], m=meta[60:4000]: quality.exchange(views, calibrated, (t, m), 0.9, base)
        for rounds, found in ((0, alone), (4, together)):
            model = quality.co_train(text[:60], meta[:60], y[:60], part, pool, rounds)
            for view, x in zip(model.views, (text, meta), strict=True):
                found.append(((view.logit(x[4000:]) > 0) == (y[4000:] > 0.5)).mean())
    assert 1 - np.mean(together) < 0.75 * (1 - np.mean(alone))  # a quarter of the errors at least


def test_quality_sums_by_task(spark):
    rng = np.random.default_rng(3)
    raw = rng.random((300, quality.N_TEXT + quality.N_META)).astype(np.float32)
    raw[:, quality.N_TEXT : quality.N_TEXT + 2] = rng.integers(0, 16, (300, 2))
    text, meta = quality.unpack([r.tobytes() for r in raw])
    y = (text[:, 0] + meta[:, -2] > 1).astype(float)
    views = quality.fit(text, y), quality.fit(meta, y)
    calibrated = tuple(quality.fit(v.logit(x)[:, None], y) for v, x in zip(views, (text, meta), strict=True))
    table = spark.createDataFrame([(bytearray(r.tobytes()),) for r in raw], "x binary").repartition(5)
    got, want = quality._pool_sums(table, 0.6)(views, calibrated, 0.1), quality.exchange(views, calibrated, (text, meta), 0.6, 0.1)
    assert all(np.allclose(got[k], want[k]) for k in want) and sum(s[0] for s in want.values()) > 100
