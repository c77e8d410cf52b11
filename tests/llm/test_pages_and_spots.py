"""Page extraction and SpotSigs: fixtures, brute force, edges."""

import hashlib
import re
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockquorum.llm import mainpage, spotsigs

PAGES = "page_id long, url string, html string"


def slow_article(html):
    """For the pages of the test tables: what stands between the article marks."""
    at = html.find("<article>")
    if at < 0:
        return ""
    inner = html[at + 9 :].split("</article>")[0]
    inner = re.sub(r"</?(?:p|h1)>", "\x01", inner)
    inner = re.sub(r"<[^>]*(?:>|\Z)", "", inner.replace("<br>", " "))
    return "\n".join(x for x in (" ".join(unescape(b).split()) for b in inner.split("\x01")) if x)


def test_pages(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    html = {r.page_id: r.html for r in df.collect()}
    got = mainpage.extract(df).collect()
    assert len(got) == len(html)
    assert all(r.text == slow_article(html[r.page_id]) and r.n_chars == len(r.text) for r in got)


def test_parts_that_are_no_article():
    html = (
        "<html><head><title>T</title><style>p{}</style></head><body class='page'><!-- <p>no</p> --><header>Site</header><nav><a>Menu</a></nav>"
        "<div id='cookie-notice'>We use cookies</div><main><article class='post'><h1>Head &eacute;&#33;</h1><p>One <b>two</b>three<br>four"
        "<p>Five &lt;6&gt;<div class='ad-banner'>Buy</div><script>var t='</p><p>x';</script><form><input>Mail</form><ul><li>a<li>b</ul>"
        "<table><tr><td>c<td>d</table><aside>side</aside></article><section id='comments'><article>Nice</article></section></main>"
        "<div class='has-sidebar'>out of article</div><footer>&copy;</footer></body></html>"
    )
    assert mainpage.articles([html]) == ["Head é!\nOne twothree four\nFive <6>\na\nb\nc\nd"]


def test_repeated_runs_of_a_host_go_where_nothing_is_marked():
    page = "<body><div>Start here for the best offers of our shop today</div><div><p>{}</p><p>{}</p></div><div>All rights reserved by us and our partners of course</div></body>"
    htmls = [page.format(f"{w} story begins with {w} and goes on", f"then {w} is told in full {w}") for w in ("alpha", "beta", "gamma")]
    assert mainpage.articles(htmls)[1] == "beta story begins with beta and goes on\nthen beta is told in full beta"
    copies = mainpage.articles([htmls[0], htmls[0]])  # a copy is no second page
    assert copies[0] == copies[1] and "alpha story" in copies[0]


@pytest.mark.parametrize(("group_bytes", "partitions"), [(1, 8), (256_000, 8), (256_000, 1), (1000, 23)])
def test_repeats_of_the_whole_host_at_any_grouping(spark, group_bytes, partitions):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(500)]
    notices = ["our rare notice number {} is shown on a few pages only".format(i) for i in range(12)]
    page = "<body><div>Start here for the best offers of our shop today</div><div><p>{}</p><p>{}</p></div><div>{}</div></body>"
    htmls = [page.format(" ".join(rng.choice(words, 40)), " ".join(rng.choice(words, 40)), notices[i % 12]) for i in range(36)]
    htmls += [htmls[0], "<article>" + notices[3] + "</article>", "<main><p>one</p></main><article>two of it " + notices[2] + "</article>"]
    rows = [(i, f"http://{host}/{i}", h) for host in ("a.b", "c.d") for i, h in enumerate(htmls)] + [(99, "http://alone.e/", htmls[0])]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = mainpage.extract(spark.createDataFrame(rows, PAGES).repartition(partitions), group_bytes).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = mainpage.articles(htmls)
    assert "notice" not in want[5] and "shop" not in want[5]
    assert len(got) == len(rows)
    alone = mainpage.articles([htmls[0]])[0]
    assert all(r.text == (alone if r.page_id == 99 else want[r.page_id]) and r.n_chars == len(r.text) for r in got)


@pytest.mark.parametrize("seed", range(10))
def test_repeated_as_brute_force(seed):
    rng = np.random.default_rng(seed)
    tokens, page = rng.integers(0, 3, 60), np.sort(rng.integers(0, 4, 60))
    runs: dict = {}
    for i in range(60 - 3):
        if page[i] == page[i + 3]:
            runs.setdefault(tuple(tokens[i : i + 4]), []).append(i)
    want = np.zeros(60, dtype=bool)
    for places in runs.values():
        if len({page[i] for i in places}) > 1:
            for i in places:
                want[i : i + 4] = True
    assert (mainpage.repeated(tokens, page, 4) == want).all()
    order = mainpage.suffix_array(tokens).tolist()
    assert [tuple(tokens[i : i + 64]) for i in order] == sorted(tuple(tokens[i : i + 64]) for i in range(60))


def test_every_page_goes_through_the_suffix_array(spark, monkeypatch):
    """Pages with one mark, too: what the suffix array finds on them goes back to them."""
    handed, asked = [], mainpage.in_arrow
    monkeypatch.setattr(mainpage, "in_arrow", lambda df, run, schema: handed.append((run.__qualname__, df)) or asked(df, run, schema))
    page = "<nav>the same menu of six words</nav><article>{} is told here in some words</article>"
    rows = [(i, f"http://a.b/{i}", page.format(w)) for i, w in enumerate(("alpha", "beta"))]
    got = {r.page_id: r.text for r in mainpage.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {0: "alpha is told here in some words", 1: "beta is told here in some words"}
    inputs = {name.split(".")[0]: df for name, df in handed}
    assert sorted(r.html for r in inputs["_runs_of"].collect()) == sorted(h for *_, h in rows)
    # the menu and the words that both articles share
    assert sorted(len(r.runs or []) for r in inputs["_marked_off"].collect()) == [2, 2]


def test_steps_hand_on_less_than_they_read(spark, monkeypatch):
    """What goes from step to step and back, in bytes, against the html of pages whose runs are nearly all unique."""
    given, asked = [], mainpage.in_arrow
    monkeypatch.setattr(mainpage, "in_arrow", lambda df, run, schema: given.append(asked(df, run, schema)) or given[-1])
    rng = np.random.default_rng(2)
    words = np.array(["".join(rng.choice(list("abcdefghij"), rng.integers(3, 12))) for _ in range(800)])
    html = "<nav>the same menu of six words</nav><article><p>{}</p><p>{}</p></article>"
    rows = [(i, f"http://a.b/{i}", html.format(*(" ".join(words[rng.integers(0, 800, 150)]) for _ in range(2)))) for i in range(400)]
    mainpage.extract(spark.createDataFrame(rows, PAGES).repartition(4)).collect()
    sizes = []
    for df in given[:-1]:
        for f in df.schema:
            kind = f.dataType.simpleString()
            size = F.length(f.name) if kind in ("binary", "string") else 8 * F.size(f.name) if kind == "array<bigint>" else F.lit(8)
            sizes.append(df.agg(F.sum(size)).first()[0])
    assert sum(sizes) < 1.5 * sum(len(h) for *_, h in rows)


@pytest.mark.parametrize("seed", range(6))
def test_packed_numbers_come_back(seed):
    rng = np.random.default_rng(seed)
    for n, bits in ((0, 13), (1, 13), (1, 31), (5, 3), (200, 13), (3000, 16), (700, 31), (40, 34)):
        values = np.sort(rng.integers(0, 1 << bits, n))
        packed = mainpage.pack(values, bits)
        assert (mainpage.unpack(packed, n, bits) == values).all()
        assert len(packed) * 8 <= n * (max(0, bits - np.log2(max(1, n))) + 4) + 32
        places = np.flatnonzero(rng.random(bits * 100) < rng.choice([0.001, 0.01, 0.5, 1]))
        assert (mainpage.from_gaps(mainpage.gaps(places)) == places).all()
    edges = np.array([0, 254, 509, 765, 765 + 510, 100_000])
    assert (mainpage.from_gaps(mainpage.gaps(edges)) == edges).all() and len(mainpage.from_gaps(None)) == 0


def test_values_of_two_streams():
    """Against counting; equal values in a chunk, streams that are not handed in, or handed in by several."""
    rng = np.random.default_rng(3)
    rows = []
    for chunk in range(5):
        values = np.sort(rng.integers(0, 200, 60))
        handed = rng.integers(0, 3, 60)
        rows.append((chunk, 7 * chunk, values, handed))
    short = mainpage.pa.table(
        {
            "chunk": [c for c, *_ in rows],
            "base": [b for _, b, *_ in rows],
            "n": [60] * 5,
            "runs": [mainpage.pack(v, 8) for _, _, v, _ in rows],
            "none": [mainpage.gaps(np.flatnonzero(h == 0)) for *_, h in rows],
            "more": [mainpage.gaps(np.flatnonzero(h == 2)) for *_, h in rows],
        }
    )
    whole = mainpage.pa.table(
        {
            "chunk": short["chunk"],
            "base": short["base"],
            "places": [mainpage.gaps(np.arange(60))] * 5,
            "runs": [(v | h << 56).astype("<u8").tobytes() for *_, v, h in rows],
        }
    )
    total = np.zeros(200, dtype=int)
    for *_, v, h in rows:
        np.add.at(total, v, h)
    want = [(c, b, np.flatnonzero(total[v] >= 2).tolist()) for c, b, v, _ in rows]
    for got in (mainpage._short_in_two(8)(short), mainpage._whole_in_two(whole)):
        assert [(r["chunk"], r["base"], mainpage.from_gaps(r["places"]).tolist()) for r in got.to_pylist()] == want


def test_page_edges(spark):
    rows = [(1, "http://a.b/x", None), (1, "http://a.b/x", None), (2, None, "<p>x"), (None, "", ""), (3, "http://A.B", "<article>cut &am"), (4, "x", "<p"), (5, "x", "plain  text"), (6, "x", "<article><p>" + "long text " * 50000)]
    df = spark.createDataFrame([(*r, "h", 1) for r in rows], PAGES + ", host string, salt int")
    got = sorted((str(r.page_id), str(r.url), r.text[:20], r.n_chars) for r in mainpage.extract(df).collect())
    assert got == sorted(
        [("1", "http://a.b/x", "", 0)] * 2
        + [("2", "None", "x", 1), ("None", "", "", 0), ("3", "http://A.B", "cut &am", 7), ("4", "x", "", 0), ("5", "x", "plain text", 10), ("6", "x", "long text long text ", 499999)]
    )
    assert mainpage.extract(spark.createDataFrame([], PAGES)).count() == 0


def slow_signatures(text):
    words = [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]
    spots = set()
    anchors = set(spotsigs.ANCHORS)
    for i, w in enumerate(words):
        block = words[i // spotsigs.BLOCK * spotsigs.BLOCK :][: spotsigs.BLOCK]
        if w in anchors or not anchors & set(block):
            near = words[i + 1 : i + 1 + spotsigs.SPAN]
            spots.add((w, tuple(x for x in near if x not in anchors)[: spotsigs.CHAIN]))
    return spots


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check_edited(rows, got):
    texts = [t or "" for _, t in rows]
    sets = [slow_signatures(t) for t in texts]
    for k, (doc_id, _) in enumerate(rows):
        a, b, r = texts[k], texts[(k + 1) % len(rows)], got[k]
        cut = len(a) // 4
        edited = a[: len(a) - cut] + b[:cut]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (doc_id, len(a), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(jaccard(sets[k], slow_signatures(edited)))
        assert r.near_next == pytest.approx(jaccard(sets[k], sets[(k + 1) % len(rows)]))
        assert len(r.fingerprint) == 8 * len(sets[k])


def test_edited_documents(documents, monkeypatch):
    df, rows = documents
    monkeypatch.setattr(spotsigs, "BUCKET_BYTES", 30_000)
    got = spotsigs.compare_edited(df).collect()
    assert len(got) == len(rows)
    check_edited(rows, sorted(got, key=lambda r: r.doc_id))


def test_edited_hard_rows(spark, hard, hard_rows, empty):
    rows = [r for r in hard_rows if r[0] is not None and r[0] != 11]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = spotsigs.compare_edited(df).collect()
    ordered = sorted([(r[0], r[1]) for r in rows], key=lambda r: r[0])
    check_edited(ordered, sorted(got, key=lambda r: r.doc_id))
    assert spotsigs.compare_edited(hard).count() == hard.count()
    assert spotsigs.compare_edited(empty).count() == 0
    one = spark.createDataFrame([(1, "the one and only text of it")], "doc_id long, text string").transform(spotsigs.compare_edited).first()
    assert one.near_next == 1.0


def test_likeness_prunes_by_length_only(spark):
    df = spark.range(1).select(F.array(*map(F.lit, range(10))).alias("a"), F.array(*map(F.lit, range(5))).alias("b"), F.array().cast("array<int>").alias("n"))
    r = df.select(spotsigs.likeness(F.col("a"), F.col("b")).alias("x"), spotsigs.likeness(F.col("a"), F.col("b"), 0.8).alias("y"), spotsigs.likeness(F.col("n"), F.col("n")).alias("z")).first()
    assert (r.x, r.y, r.z) == (0.5, 0.0, 1.0)


@pytest.mark.parametrize("least", [0.8, 0.5])
def test_near_duplicates_as_brute_force(spark, documents, least):
    df, rows = documents
    rows = rows[:90]
    more = [(1000 + i, (t or "") + " and the end of it") for i, t in rows[:15]] + [(2000, None), (2001, "")]
    df = spark.createDataFrame([*rows, *more], "doc_id long, text string")
    sets = [(i, slow_signatures(t)) for i, t in [*rows, *more]]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in range(len(sets)):
        for y in range(x):
            if jaccard(sets[x][1], sets[y][1]) >= least:
                a, b = find(sets[x][0]), find(sets[y][0])
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: r.class_id for r in spotsigs.near_duplicates(df, least).collect()}
    assert got == {i: find(i) for i in root}


def test_no_python_in_the_plan(documents):
    plan = spotsigs.compare_edited(documents[0])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_deep_nesting_costs_its_length():
    n = 200_000
    page = mainpage.read_page("<div>x y</section>" * n)
    assert len(page.blocks) == n and len(page.around) == n + 1
    assert mainpage.is_decided(page) is False
    assert mainpage.article(page, [2] * n, [2] * n).count("\n") + 1 >= n * mainpage.SHARE
    marked = mainpage.read_page("<div>x" * 1000 + "<article>" + "<div>y z" * n + "</article>tail")
    assert mainpage.is_decided(marked)
    assert mainpage.article(marked, [0] * len(marked.blocks), [0] * len(marked.blocks)) == "\n".join(["y z"] * n)


def test_sums_and_blocks_of_elements_by_paths():
    page = mainpage.read_page("a<div>b<p>c<nav>d</nav></div><section><p>e<p>f<div>g</section>h")
    paths = []
    for e in page.inside:
        path = [e]
        while path[-1]:
            path.append(page.around[path[-1]])
        paths.append(path)
    weights = [2**b for b in range(len(page.blocks))]
    sums = page.sums(weights)
    for e in range(len(page.around)):
        held = [b for b, path in enumerate(paths) if e in path and not page.out[b]]
        assert page.held_by(e) == held and sums[e] == sum(weights[b] for b in held)
