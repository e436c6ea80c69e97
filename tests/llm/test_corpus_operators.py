"""Each corpus operator against a plain computation of the same thing, and on rows at the edges."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from html import unescape

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomspark.llm import decontam, hilbert, html, license, mixing, quality, queries, secrets, simhash, suffix, toxicity

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EDGE = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n\x0b ", "en", "", 5),
    (4, "same words in every copy of this text, over and over again until it is long enough to count. " * 4, "en", "a", 1),
    (5, "same words in every copy of this text, over and over again until it is long enough to count. " * 4, "de", None, 1),
    (None, "a row without an id", "en", "a", 1),
    (6, "repeated row", "en", "a", 1),
    (6, "repeated row", "en", "a", 1),
    (7, "é" * 5000 + " 日本語 ñandú 😀", "xx", "z", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# 1 -------------------------------------------------------------------------------------------------------------------


def brute_distance(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for w in text:
        new = [0]
        for j, x in enumerate(item):
            new.append(min(row[j] + (x != w), row[j + 1] + 1, new[j] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_best_distance_is_exact():
    r = random.Random(1)
    for _ in range(200):
        item, text = [r.randrange(4) for _ in range(r.randint(1, 9))], [r.randrange(4) for _ in range(r.randint(0, 25))]
        assert decontam.best_distance(item, text) == brute_distance(item, text)


def test_leaks_reach_recall_and_hold_up(spark):
    r = random.Random(2)
    vocab = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, say(r.randint(8, 50))) for i in range(40)]
    rows = []
    for i in range(300):
        body = words(say(120))
        if i % 3:
            item = words(items[i % 40][1])
            for _ in range(r.randint(0, math.floor(0.2 * len(item)))):
                k = r.randrange(len(item))
                item[k : k + 1] = r.choice([["new"], [], [item[k], "more"]])
            at = r.randint(0, len(body))
            body[at:at] = item
        rows.append((i, " ".join(body).title()))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(x.doc_id, x.item_id): x.edits for x in decontam.op1_decontam(df, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    want = {}
    for d, t in rows:
        for i, item in items:
            a = decontam.words(item)
            if (n := brute_distance(a, decontam.words(t))) <= math.floor(0.2 * len(a)):
                want[d, i] = n
    assert set(got) <= set(want)
    assert len(got) >= 0.95 * len(want) > 100
    assert all(got[k] == want[k] for k in got)
    exact = {k for k, v in want.items() if v == 0}
    assert exact <= set(got)


@pytest.mark.parametrize("n", [15, 30, 60, 150, 400])
def test_leaks_reach_recall_at_all_allowed_edits(n):
    r = random.Random(n)
    items = [(i, " ".join(f"w{r.randrange(3000)}" for _ in range(n))) for i in range(20)]
    slack = math.floor(0.2 * n)
    index = decontam.Index(items, 0.2, 3, {n: decontam.needed_tables(n, 0.2, 3, 0.95)})
    hits, total = 0, 0
    texts, keys = [], []
    for i in range(160):
        copy = words(items[i % 20][1])
        for k in range(slack):
            at = r.randrange(len(copy))
            copy[at : at + 1] = r.choice([[f"x{k}"], [], [copy[at], f"y{k}"]])
        texts.append(" ".join([f"a{r.randrange(500)}" for _ in range(40)] + copy + [f"b{r.randrange(500)}" for _ in range(40)]))
        keys.append(i % 20)
    for found, key in zip(index.leaks(texts), keys, strict=True):
        hits += key in found
        total += 1
    assert hits >= 0.93 * total  # 0.95 is asked; 160 trials have a deviation of 0.017


def test_leaks_of_items_with_one_id():
    items = [(1, "one two three four five six"), (1, "one two three four five six seven eight nine ten")]
    index = decontam.Index(items, 0.2, 4, {6: 30, 10: 30})
    assert index.leaks(["so one two three four five six it is", "x one two three four five six seven eight nine ten"]) == [{1: (0, 6)}, {1: (0, 6)}]


def test_leaks_on_the_edges(spark, edge, empty):
    items = spark.createDataFrame([(1, "repeated row"), (2, None), (None, "x"), (3, "")], "item_id bigint, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.op1_decontam(edge, items).collect()] == [(6, 1), (6, 1)]
    assert decontam.op1_decontam(empty, items).count() == 0
    assert decontam.op1_decontam(edge, items.limit(0)).count() == 0
    extra = edge.withColumn("leaks", F.lit(1)).withColumn("item_id", F.lit(2))
    assert decontam.clean(extra, items).columns == extra.columns
    assert decontam.clean(edge, items).count() == len(EDGE) - 2
    blocks = list(decontam.item_blocks(items, "item_id", "text", 40))
    assert sorted(x for b in blocks for x in b) == [(1, "repeated row")]


# 2 -------------------------------------------------------------------------------------------------------------------


def test_hilbert_is_a_curve():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    index = hilbert.hilbert_index(grid, 3)
    assert sorted(index) == list(range(512))
    path = grid[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def _by_shard(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.shard].append(r)
    return out


@pytest.mark.parametrize("which", ["docs", "edge", "empty"])
def test_shards(which, request):
    df = request.getfixturevalue(which)
    rows = hilbert.op2_hilbert(df).collect()
    texts = Counter((r.doc_id, r.text) for r in df.collect())
    assert Counter(r.doc_id for r in rows) == Counter(k for k, _ in texts.elements())
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert 0 <= r.shard < 40 and r.law == "rows" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by.get(i, [])) for i in range(40)]
    assert max(sizes) - min(sizes) <= 1
    known = {(d, zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for d, t in texts}
    assert {(r.doc_id, r.text_crc32, r["size"]) for r in rows} == known


def test_sharded_prunes_and_keeps_columns(docs):
    clash = {"shard": "x", "SLOT": "x", "_cell": 7, "cell": 8, "_start": 9, "row": 10, "tie0": 11, "mix": 12, "total": 13, "a.b": 14}
    extra = docs
    for name, value in clash.items():
        extra = extra.withColumn(name, F.lit(value))
    out = hilbert.sharded(extra)
    assert out.columns == [*docs.columns, *[c for c in clash if c.lower() not in ("shard", "slot")], "curve_cell", "shard", "slot"]
    assert out.count() == docs.count() and all(r[c] == v for r in out.collect() for c, v in clash.items() if c.lower() not in ("shard", "slot"))
    assert sorted(r[0] for r in out.select("shard").distinct().collect()) == list(range(40))
    few = hilbert.assign(docs, hilbert.shard_dims(F.length("text")), [F.col("doc_id")], 7, sub_rows=2)  # many sub-cells
    assert sorted(Counter(r.shard for r in few.collect()).values())[0] == docs.count() // 7
    assert all(sorted(x.slot for x in rows) == list(range(len(rows))) for rows in _by_shard(few).values())
    spread = hilbert.sharded(docs).groupBy("shard").agg(F.count_distinct("lang").alias("n")).agg(F.avg("n")).first()[0]
    assert spread < docs.select("lang").distinct().count()


@pytest.mark.parametrize("n", [4, 30])
def test_shards_tell_sources_with_one_beginning_apart(spark, n):
    rows = [(i, f"text {i}", "en", f"https://example.org/crawl_{i % n:02d}", 0) for i in range(2400)]
    df = spark.createDataFrame(rows, DOCS)
    cuts = hilbert.text_cuts(df, F.col("source"), 3)
    assert cuts == sorted({r[3] for r in rows})[:n] if n < 8 else len(cuts) == 7
    out = hilbert.sharded(df)
    spread = out.groupBy("shard").agg(F.count_distinct("source").alias("n")).agg(F.avg("n")).first()[0]
    assert out.count() == 2400 and spread < 0.6 * n
    assert hilbert.sharded(df.withColumn("source", F.lit(None).cast("string"))).count() == 2400


# 3 -------------------------------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = toxicity.op3_toxicity(docs, labels)
    rows = out.join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    assert right >= 0.93
    pos, neg = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc >= 0.85  # some labels of junk texts are noise, which no word explains
    for r in out.collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_clause_grammar():
    w = {"fool": 5.0, "fool*": 4.0}
    assert toxicity.read_clause("you are a fool".split(), w) == {"addressed": 5.0}
    assert toxicity.read_clause("not a fool".split(), w) == {"negated": 5.0}
    assert toxicity.read_clause("somebody said that fool".split(), w) == {"reported": 5.0}
    assert toxicity.read_clause("i will hurt you".split(), w) == {"threat": 1.0}
    assert toxicity.read_clause("a foolish thing".split(), w) == {"plain": 4.0}
    assert toxicity.read_clause("he said he will kill you".split(), w) == {"reported_threat": 1.0}
    assert toxicity.read_clause("i will never hurt you".split(), w) == {"denied_threat": 1.0}
    assert toxicity.read_clause("they kill time".split(), w) == {"threat": 1.0}
    assert toxicity.read_clause("kill the process".split(), w) == {}
    assert toxicity.read_clause("fool and fool like you".split(), w) == {"plain": 5.0, "addressed": 5.0}
    assert toxicity.read_clause("you have not been told by anyone at all that fool".split(), w) == {"reported": 5.0}
    assert toxicity.read_clause("you went far away from this place and saw a fool".split(), w) == {"plain": 5.0}
    assert toxicity.read_clause("a thing".split(), w) == {}


def plain_clause(words, weights):
    """The grammar's classes by looking around each hit, without any transducer."""
    kinds = []
    for w in words:
        hit = weights.get(w) or (weights.get(w[:4] + "*") if len(w) > 4 else None)
        kinds.append("negation" if w in toxicity.NEGATIONS else "report" if w in toxicity.REPORTING else "insult" if hit else "threat" if w in toxicity.THREATS else "target" if w in toxicity.TARGETS else "word")
    out = defaultdict(float)
    for i, (w, kind) in enumerate(zip(words, kinds, strict=True)):
        if kind in ("insult", "threat"):
            mark = "reported" if "report" in kinds[max(0, i - 8) : i] else "negated" if "negation" in kinds[max(0, i - 3) : i] else ""
            after = []
            for k in kinds[i + 1 : i + 5]:
                if k in ("insult", "threat"):
                    break
                after.append(k)
            aimed = "target" in kinds[max(0, i - 5) : i] or "target" in after
            if kind == "insult":
                out[mark or ("addressed" if aimed else "plain")] += weights.get(w) or weights[w[:4] + "*"]
            elif aimed:
                out[{"": "threat", "negated": "denied_threat", "reported": "reported_threat"}[mark]] += 1.0
    return dict(out)


def test_grammar_against_a_plain_reading():
    r = random.Random(3)
    w = {"fool": 5.0, "fool*": 4.0}
    for _ in range(3000):
        words = [r.choice("a the of is you they not said kill hurt fool foolish fooling".split() + ["thing"] * 8) for _ in range(r.randint(1, 25))]
        assert toxicity.read_clause(words, w) == plain_clause(words, w), words


def test_toxicity_on_the_edges(spark, edge, empty):
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert toxicity.op3_toxicity(edge, labels).count() == len(EDGE)
    assert toxicity.op3_toxicity(empty, labels).count() == 0
    assert toxicity.op3_toxicity(edge, labels.limit(0)).where("score <> 0").count() == 0
    model = toxicity.Model({"row": 9.0}, [0.0] * toxicity.N_FEATURES + [-9.0])
    assert toxicity.without_toxic(edge.withColumn("score", F.lit("mine")), model).count() == len(EDGE)


# 4 -------------------------------------------------------------------------------------------------------------------


def brute_repeats(texts, length=200):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        left = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        yield sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest()


def test_cover_covers():
    assert {(a - b) % suffix.PERIOD for a in suffix.COVER for b in suffix.COVER} == set(range(suffix.PERIOD))


def test_repeats_by_brute_force(spark):
    r = random.Random(4)
    say = lambda n: bytes(r.choice(b"abcdefgh ") for _ in range(n)).decode()
    shared = [say(n) for n in (199, 200, 201, 350, 900)]
    rows = [(i, say(r.randint(0, 300)) + r.choice(shared) + say(r.randint(0, 80)) + (r.choice(shared)[:250] if i % 3 else "")) for i in range(60)]
    rows += [(100, rows[0][1]), (101, "é" * 150), (102, "é" * 150), (103, "z" * 450), (104, None), (105, "short"), (106, "short"), (None, "ab" * 300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    texts = [(t or "").encode() for _, t in rows]
    want = Counter((d, len(t), *b) for (d, _), t, b in zip(rows, texts, brute_repeats(texts), strict=True))
    for chunk in (1 << 20, 3000):
        got = suffix.repeated_bytes(df, chunk_bytes=chunk)
        assert Counter(tuple(x) for x in got.collect()) == want


def test_texts_made_to_collide_stay(spark):
    """Thue-Morse blocks have one polynomial hash modulo 2**64 for any odd base; the texts below differ in 192 places."""
    morse = lambda a, b: "".join(chr((a, b)[i.bit_count() % 2]) for i in range(64))
    pairs = ((121, 62), (74, 60), (82, 121))
    x, y = "".join(morse(a, b) for a, b in pairs) + "the end.", "".join(morse(b, a) for a, b in pairs) + "the end."
    r = random.Random(9)
    say = lambda: "".join(r.choice("abcdefghij klmnop") for _ in range(120))
    rows = [(1, x), (2, y), (3, x[:150] + say()), (4, y[:150] + say())]
    assert len(x) == len(y) == 200 and all(n == 0 for n, *_ in brute_repeats([t.encode() for _, t in rows]))
    got = suffix.repeated_bytes(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {t.n_removed for t in got.collect()} == {0}
    for seed in range(50):
        p = suffix.prints(seed)
        first, second = [[f(run(np.frombuffer(t.encode(), np.uint8)), np.array([0]), 200)[0] for t in (x, y)] for f, run in ((p.names, p.running), (p.seconds, p.running_small))]
        assert second[0] != second[1] and first[0] != first[1]


def test_second_names_are_polynomials():
    p, data = suffix.prints(3), np.random.default_rng(1).integers(0, 256, 900).astype(np.uint8)
    got = p.seconds(p.running_small(data), np.arange(700), 200)
    for i in (0, 1, 350, 699):
        assert got[i] == sum((int(c) + 1) * pow(p.small_base, j, suffix.PRIME) for j, c in enumerate(data[i : i + 200])) % suffix.PRIME


def test_repeats_on_the_edges(edge, empty):
    out = {r.doc_id: r for r in suffix.op4_suffix(edge).collect()}
    assert out[4].n_removed == out[4].n_bytes and out[1].n_bytes == 0 and out[6].n_removed == 0
    assert suffix.op4_suffix(empty).count() == 0
    with pytest.raises(ValueError):
        suffix.repeated_bytes(edge, length=100)


# 5 -------------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies and that is the way it is, so that you can be at home with us.</p></div><article><header><h1>Head &amp; line</h1></header><p>First  paragraph<br>of the <b>text</b>.<p>Short.</p>
<aside>Related: the other story that was told on this site</aside><ul><li>One</li><li>Two</li></ul></article><section class="comments"><p>I do not like this article and will say so in the strongest words that I have.</p></section>
<form><label>Your name</label><input name=n></form><footer>&copy; 2020 all of it</footer></body></html>"""


def test_html_main_text():
    assert html.main_text(PAGE) == "Head & line\nFirst paragraph of the text.\nShort.\nOne\nTwo"
    assert html.main_text(None) == html.main_text("") == ""
    assert html.main_text("<p>cut off <b>in the middle of it all, and that is what the page was for the time") == "cut off in the middle of it all, and that is what the page was for the time"


def plain_article(page):
    """The text of a driver page's article, block by block, without any rule."""
    body = re.search("<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1|ul|li|div)[^>]*>", body)
    texts = (re.sub(r"\s+", " ", unescape(re.sub(r"<[a-zA-Z/][^>]*>", "", x.replace("<br>", " ")))).strip() for x in parts)
    return "\n".join(x for x in texts if x)


@pytest.fixture(scope="module")
def driver_pages(spark):
    return [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]


def test_html_driver_pages_by_a_plain_version(driver_pages):
    assert all(html.main_text(p) == plain_article(p) for p in driver_pages)


def test_html_text_decides_where_elements_say_nothing(driver_pages, monkeypatch):
    bare = [p.replace("<article>", "<div>").replace("</article>", "</div>") for p in driver_pages]
    hits = lambda: sum(html.main_text(b) == plain_article(p) for b, p in zip(bare, driver_pages, strict=True)) / len(bare)
    assert hits() >= 0.85
    monkeypatch.setattr(html, "STOP", frozenset())
    assert hits() <= 0.15


def test_html_second_pass():
    good = "This is the text of the page and it is about the things that were in the news on that day, with all of it. " * 2
    page = f"<body><div><a href=1>Home</a> <a href=2>News</a></div><div>By someone</div><div>{good}</div><div>The end</div><div><a href=3>Next page of results</a></div></body>"
    assert html.main_text(page).split("\n") == ["By someone", good.strip(), "The end"]
    page = f"<article><p>{good}<p>One.<p>Two.<p>Three.</article><div>Some words</div><footer>Imprint</footer><article class=comment><p>{good}</article>"
    assert html.main_text(page).split("\n") == [good.strip(), "One.", "Two.", "Three."]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p>A text.</p><button>x<p>Rest of it</article>", "A text.\nRest of it"),
        ("<article><p>A text.</p><select><option>a<option>b<p>Rest of it</p></article>", "A text.\nRest of it"),
        ("<article><p>A text.</p><select><option>a<option>b</select>Rest of it</article>", "A text.\nRest of it"),
        ("<article><p>A text.</p><svg><svg>x</svg>y</svg>Rest<script>z</article>", "A text.\nRest"),
        ("<article><p title='it's'>A text.<p title='>'>B text.", "A text.\nB text."),
        ("<article class='post has-sidebar'><p>A text.</p><div class='no-comments'>B text.</div><div class='post-comments'>C</div>", "A text.\nB text."),
        ("<title>T<body><p>A text.", "A text."),
        ("<article><h1><a href=x>Head</a></h1><p>A text.<pre>x = 1</pre></article><div class=x>Buy this</div>", "Head\nA text.\nx = 1"),
    ],
)
def test_html_odd_markup(page, want):
    assert html.main_text(page) == want


def test_html_long_pages():
    many = "<article>" + "<p>x</p>" * 100_000 + "</article>"
    assert html.main_text(many).count("x") == 100_000
    for odd in ("<option>" * 50_000, "<a b" * 50_000, "<p " + '"' * 50_001, "<!--" * 50_000, "<div>" * 20_000 + "x"):
        html.main_text(odd)


def test_html_query(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (2, None, None)], "page_id bigint, url string, html string")
    rows = sorted(html.op5_html(pages).collect(), key=lambda r: r.page_id)
    assert [r.n_chars for r in rows] == [len(rows[0].text), 0, 0]
    assert html.op5_html(pages.limit(0)).count() == 0


# 6 -------------------------------------------------------------------------------------------------------------------


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = total - sum(fixed.values())
        free = [s for s in order if s not in fixed]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_mixing(which, request):
    df = request.getfixturevalue(which)
    base = df.collect()
    sizes = defaultdict(int)
    for r in base:
        sizes[r.source] += len(words(r.text))
    want = brute_targets(dict(sizes))
    source, biggest = {}, defaultdict(int)
    for r in base:
        source[r.doc_id] = r.source
        biggest[r.source] = max(biggest[r.source], len(words(r.text)))
    taken = defaultdict(int)
    rows = mixing.op6_mixing(df).collect()
    assert sorted((r.doc_id or -1, r["size"]) for r in rows) == sorted((r.doc_id or -1, len(words(r.text))) for r in base)
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s], rel=1e-9, abs=1e-6)
        assert r.taken <= 3 * r["size"]
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= biggest[s] / 2 + 1e-6
    assert sorted(map(tuple, mixing.op6_mixing(df.repartition(5)).collect()), key=str) == sorted(map(tuple, rows), key=str)


def test_mixing_water_fills_over_caps(spark):
    rows = [(i, "w " * n, "en", s, 0) for i, (s, n) in enumerate([("a", 10), ("b", 1000), ("c", 400), ("d", 5), (None, 300)])]
    got = {r.doc_id: r.target for r in mixing.op6_mixing(spark.createDataFrame(rows, DOCS)).collect()}
    want = brute_targets({"a": 10, "b": 1000, "c": 400, "d": 5, None: 300})
    assert [got[i] for i in range(5)] == pytest.approx([want[s] for s in ("a", "b", "c", "d", None)])


def test_mixing_repeated_and_missing_ids(spark):
    r = random.Random(6)
    rows = [(1 if i % 2 else None, " ".join(["word"] * r.randint(1, 200)) + f" {i}", "en", "ab"[i % 3 % 2], 0) for i in range(300)]
    df = spark.createDataFrame(rows, DOCS)
    key = lambda x: (x.doc_id or 0, x["size"], x.taken)
    first = sorted(map(key, mixing.op6_mixing(df).collect()))
    for n in (3, 11):
        assert sorted(map(key, mixing.op6_mixing(df.orderBy(F.rand(n)).repartition(n)).collect())) == first


def test_mixing_weight(spark):
    texts = ["word and word " * 10, "a b c d e f " * 10, "#### $$$$ " * 20, "few words here", None, "x" * 100_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.text_quality(F.col("t"), mixing.n_words(F.col("t"))))
    assert [round(r[0], 4) for r in df.collect()] == [1.0, 0.5, 0.05, 0.5, 0.25, 0.25]


def test_mixed_repeats_rows(docs, empty):
    plan = {r.id: r.times for r in mixing.mix(docs).collect()}
    extra = docs.withColumn("_mix_n", F.lit(1)).withColumn("_mix_key", F.lit(2)).withColumn("h", F.lit(3)).withColumn("times", F.lit(-4))
    out = mixing.mixed(extra)
    assert out.columns == extra.columns and {(r._mix_n, r._mix_key, r.h, r.times) for r in out.collect()} == {(1, 2, 3, -4)}
    got = Counter(r.doc_id for r in out.collect())
    assert got == Counter({k: v for k, v in plan.items() if v})
    assert mixing.op6_mixing(empty).count() == 0 and mixing.mixed(empty).count() == 0


# 7 -------------------------------------------------------------------------------------------------------------------

PATTERNS = (
    ("assign", re.compile(r"((?ia:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)


def brute_secrets(text):
    found = []
    for k, (name, rule, group, least) in enumerate(PATTERNS):
        found += [(m.start(), k, m.end(), name) for m in rule.finditer(text or "") if len(m[group]) >= least]
    found.sort()
    base = ",".join(f"{n}:{a}:{b}" for a, _, b, n in found)
    return Counter(n for *_, n in found), hashlib.sha256(base.encode()).hexdigest(), base


def test_secrets_by_brute_force(spark, docs, edge):
    key = "AKIA" + "ABCDEFGH12345678"
    rows = [
        (900, f"é😀 {key} und {key}X api_key = 'zzzzzz' Token:abc secret: token : abcdefgh", "en", "a", 0),
        (901, "0123456789abcdef01234567 " * 3 + "0" * 23, "en", "a", 0),
        (902, "PASSWORD=" + "a" * 40 + " passwd: " + "0123456789abcdef" * 2, "en", "a", 0),
    ]
    df = docs.union(edge).union(spark.createDataFrame(rows, DOCS))
    texts = defaultdict(list)
    for r in df.collect():
        texts[r.doc_id].append(r.text)
    for r in secrets.op7_secrets(df).collect():
        options = [brute_secrets(t) for t in texts[r.doc_id]]
        n, sha, base = next(o for o in options if o[1] == r.base_sha256)
        assert (r.n_assign, r.n_access, r.n_hex) == (n["assign"], n["access"], n["hex"])
        assert set(base.split(",")) - {""} <= set(r.spans.split(","))


def test_markov_tells_random_from_ordinary(spark, docs):
    table = secrets.model(docs)
    r = random.Random(7)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    strings = ["".join(r.choice(alphabet) for _ in range(r.randint(24, 44))) for _ in range(300)]
    plain = [f"get_user_{w}_list_{i}" for i, w in enumerate(["settings", "profile", "history", "connection", "address"] * 40)] + [f"openConfigFileHandler{i}" for i in range(100)]
    df = spark.createDataFrame([(x, True) for x in strings] + [(x, False) for x in plain], "t string, y boolean").withColumn("hit", secrets.is_random(F.col("t"), table))
    n = {(x.y, x.hit): x["count"] for x in df.groupBy("y", "hit").count().collect()}
    assert n.get((True, True), 0) >= 285 and n.get((False, True), 0) <= 3
    clean = secrets.op7_secrets(docs).where(F.contains("spans", F.lit("random"))).count()
    assert clean <= 0.03 * docs.count()


def test_secrets_in_long_texts(spark):
    """Many matches in one row, several thousand of each kind: same as brute force, and in time that grows with them."""
    r = random.Random(70)
    some = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
    rows = [
        (1, " ".join(some(lower, 24) for _ in range(40_000))),
        (2, "\n".join(r.choice([f"token={some(lower, 8)}", f"AKIA{some(upper, 16)}", some(lower, 30), "word", f"x{some(upper + lower, 20)}.{some(lower, 25)}"]) for _ in range(20_000))),
        (3, some(upper + lower, 1_000_000)),
        (4, "ordinary words and nothing else " * 30_000),
    ]
    df = spark.createDataFrame([(*x, "en", "a", 0) for x in rows], DOCS)
    table = secrets.train(secrets.labelled(df))
    got = {x.id: x for x in secrets.findings(df, table).collect()}
    for i, text in rows:
        base = [(int(a), secrets.KINDS.index(n), int(b)) for n, a, b in (x.split(":") for x in brute_secrets(text)[2].split(",") if x)]
        assert [tuple(x) for x in got[i].base] == base
        tokens = [(m.start(), 3, m.end()) for m in re.finditer(secrets.TOKEN, text)]
        clear, at, reach = [], 0, 0
        for a, k, b in tokens:
            while at < len(base) and base[at][0] < b:
                reach, at = max(reach, base[at][2]), at + 1
            if reach <= a:
                clear.append((a, k, b))
        assert set(map(tuple, got[i].added)) <= set(clear)
    assert len(got[2].added) > 1000


def test_secrets_on_an_empty_table(empty):
    assert secrets.op7_secrets(empty).count() == 0


# 8 -------------------------------------------------------------------------------------------------------------------


def brute_print(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    if not shingles:
        return 0
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, k=3):
    ids, root = sorted({d for d, _ in fps if d is not None}), {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for i, (a, x) in enumerate(fps):
        for b, y in fps[:i]:
            if (x ^ y).bit_count() <= k:
                u, v = sorted((find(a), find(b)))
                root[v] = u
    return {d: find(d) for d in ids}


@pytest.mark.parametrize("hot", [20_000, 2])
def test_simhash_by_brute_force(spark, docs, hot):
    near = docs.where("doc_id < 60").select((F.col("doc_id") + 5000).alias("doc_id"), F.concat("text", F.lit(" more")).alias("text"))
    df = docs.select("doc_id", "text").union(near).union(spark.createDataFrame([(9000, None), (9001, ""), (9002, "One two"), (9003, "one TWO"), (9004, "É one")], "doc_id bigint, text string"))
    rows = [(r.doc_id, brute_print(r.text)) for r in df.collect()]
    comp = brute_components(rows)
    got = {r.id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.components(df, hot_bucket=hot).collect()}
    assert got == {d: (f, comp[d]) for d, f in rows}


def test_links_lose_nothing(spark):
    r = random.Random(8)
    centre = [r.getrandbits(64) for _ in range(30)]
    fps = sorted({c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for c in centre for _ in range(12)})
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp bigint")
    for n, hot in ((10, 20_000), (1 << 30, 20_000), (10, 3)):
        roots = {x.node: x.root for x in simhash.connected_components(simhash.links(df, 3, n, hot)).collect()}
        brute = brute_components([(simhash._signed(f), f) for f in fps])
        classes = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
        assert classes({k: roots.get(k, k) for k in brute}) == classes(brute)


def jaccard(a, b, k=5):
    x, y = ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (a, b))
    return len(x & y) / len(x | y)


def test_similar_texts_reach_recall_and_leave_others(spark):
    r = random.Random(88)
    rows, pairs = [], defaultdict(list)
    for i in range(900):
        a = [f"w{r.randrange(5000)}" for _ in range(r.randint(60, 500))]
        rows.append((10 * i, " ".join(a)))
        b = list(a)
        for _ in range(r.randint(0, max(1, len(a) // 22))):
            at = r.randrange(len(b))
            b[at : at + 1] = r.choice([[], ["new"], [b[at], "more"]])
        rows.append((10 * i + 1, " ".join(b)))
        s = jaccard(a, b)
        pairs["near" if s >= 0.8 else "far" if s < 0.6 else "between"].append((10 * i, 10 * i + 1))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    root = {x.id: x.root for x in simhash.similar_classes(df).collect()}
    near = [root[a] == root[b] for a, b in pairs["near"]]
    assert len(near) > 300 and sum(near) >= 0.95 * len(near)
    assert len({root[10 * i] for i in range(900)}) == 900  # unrelated texts stay apart
    far = [root[a] == root[b] for a, b in pairs["far"]]
    assert sum(far) <= 0.05 * max(1, len(far))


def test_similar_texts_in_one_large_group(spark):
    r = random.Random(89)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join([*base[:k], f"x{i}", *base[k:]])) for i, k in enumerate(r.randrange(300) for _ in range(3000))]
    rows += [(10_000 + i, " ".join(f"y{r.randrange(10**6)}" for _ in range(100))) for i in range(500)] + [(20_000 + i, None) for i in range(5)]
    kept = simhash.keep_similar(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(x.doc_id for x in kept.collect()) == [0, *range(10_000, 10_500), 20_000]


def test_keep_one(edge, empty):
    kept = simhash.keep_one(edge)
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {1, 4, 6, 7} <= set(ids) and not {2, 3, 5} & set(ids)
    assert simhash.op8_simhash(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    again = [r.doc_id for r in simhash.keep_similar(edge.withColumn("_kept_id", F.lit(1)).withColumn("n", F.lit(1))).collect()]
    assert sorted(again, key=str) == sorted(ids, key=str) and simhash.keep_similar(empty).count() == 0


def test_keep_one_keeps_rows_without_an_id(spark):
    r = random.Random(4)
    text = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(80))
    one, two, three, four, five = (text() for _ in range(5))
    for rows, want in (
        ([(1, one), (None, two)], [(1, one), (None, two)]),
        ([(1, one), (None, one), (None, two), (None, two), (None, three)], [(1, one), (None, two), (None, three)]),
        ([(5, four), (5, five), (5, five), (6, one)], [(5, four), (5, five), (6, one)]),
    ):
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        for out in (simhash.keep_one(df), simhash.keep_similar(df)):
            assert Counter((x.doc_id, x.text) for x in out.collect()) == Counter(want)


# 9 -------------------------------------------------------------------------------------------------------------------


def test_license_scan(spark, edge, empty):
    mit = license.TEMPLATES["MIT"][1]
    rows = [
        (1, "Some prose first.\nReleased under the MIT License.\nMore prose.", "en", "a", 0),
        (2, mit.replace("free of charge", "FREE of   charge").replace("sublicense, ", ""), "en", "a", 0),
        (3, mit[:300] + "\n" + mit[300:], "en", "a", 0),
        (4, "A text that speaks of the license of a doctor to practise medicine.", "en", "a", 0),
        (5, "licensed under cc by-nc 4.0", "en", "a", 0),
    ]
    full = "\n\n".join(license.FULL_TEXTS["MIT"])
    rows += [
        (6, mit + " " + "x" * 40_000, "en", "a", 0),
        (7, "*" * 45_000 + "\n" + mit + "\n" + "*" * 45_000, "en", "a", 0),
        (8, "Copyright (c) 2020 Somebody\n\n" + full, "en", "a", 0),
        (9, "\n\n".join(license.FULL_TEXTS["BSD-2-Clause"]).replace("HOLDERS", "OWNERS"), "en", "a", 0),
        (10, "Prose about something else. " * 20_000 + "\n\n" + license.FULL_TEXTS["BSD-3-Clause"][3] + "\n\nmore", "en", "a", 0),
    ]
    got = {(r.doc_id, r.license) for r in license.op9_license(spark.createDataFrame(rows, DOCS)).collect()}
    assert {(6, "MIT"), (7, "MIT"), (8, "MIT"), (9, "BSD-2-Clause"), (10, "BSD-3-Clause")} <= got
    assert {(1, "MIT"), (2, "MIT"), (3, "MIT"), (5, "CC-BY-NC-4.0")} <= got and not any(d == 4 for d, _ in got)
    assert license.op9_license(edge).count() == license.op9_license(empty).count() == 0


# 10 ------------------------------------------------------------------------------------------------------------------


def brute_quality(t):
    t = t or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    again = {j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), failed


def test_quality_by_brute_force(spark, docs, edge):
    r = random.Random(10)
    rows = [(800 + i, " ".join(r.choice("a b c".split()) for _ in range(n)) + "\n" * (i % 3) + "a b c d e f g h " * (i % 4), "en", "a", 0) for i, n in enumerate([0, 3, 7, 8, 9, 20, 60, 100])]
    df = docs.union(edge).union(spark.createDataFrame(rows, DOCS))
    texts = defaultdict(list)
    for x in df.collect():
        texts[x.doc_id].append(brute_quality(x.text))
    for x in quality.op10_quality(df).collect():
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) in texts[x.doc_id]
        assert not (x.base_failed and x.kept)


def test_quality_keeps_prose_and_drops_junk(spark, empty):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = quality.op10_quality(docs).join(labels, "doc_id").where("NOT base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.2 * len(bad)
    assert quality.op10_quality(empty).count() == 0


def test_line_rules(spark):
    lines = [("A sentence that ends as it should.", False), ("Home | News | About", True), ("###### %%%% $$$$", True), ("word", True), ("Please enable JavaScript to see this.", True), ("A long line of prose that speaks of a page which asked its readers to enable JavaScript, and goes on about it for more than two hundred characters, since it has a story to tell of the people who made the page and why they did so.", False), ("Click here to read on, all rights reserved. " * 20, True), ("no stop but long enough to be prose", False)]
    df = spark.createDataFrame(lines, "x string, y boolean").withColumn("got", quality.line_fails(F.col("x")))
    assert [r.got for r in df.collect()] == [y for _, y in lines]


def test_every_operator_has_a_query():
    assert [re.match(r"op(\d+)_", n)[1] for n in queries.queries()] == [str(i) for i in range(1, 11)]
