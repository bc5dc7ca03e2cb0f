"""N-gram join, sharding, nearest neighbours and page texts against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldcast.llm import html_text, ngram_join, sharding, vantage
from tests.llm import fixtures as X


def sets(text, k):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if len(words) < k:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute_join(rows, k, percent):
    """Counter of (id, n_shingles, component_id)."""
    by_set = defaultdict(list)
    for i, text in rows:
        by_set[sets(text, k)].append(i)
    nodes = [s for s in by_set if s]
    root = list(range(len(nodes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(nodes)):
        for b in range(a):
            if 100 * len(nodes[a] & nodes[b]) >= percent * len(nodes[a] | nodes[b]):
                root[find(a)] = find(b)
    least: dict = {}
    for a, s in enumerate(nodes):
        ids = [i for i in by_set[s] if i is not None]
        least.setdefault(find(a), []).extend(ids)
    out = Counter((i, 0, i) for i in by_set.get(frozenset(), []))
    for a, s in enumerate(nodes):
        out.update((i, len(s), min(least[find(a)], default=None)) for i in by_set[s])
    return out


def families() -> list[str]:
    """Chains of near copies, passages shared by many, short and equal texts."""
    r = random.Random(5)
    texts = X.edge_texts()
    passage = X.prose(77, 60)
    for f in range(6):
        words = X.prose(100 + f, r.choice([12, 40, 90, 200])).split()
        for _ in range(12):
            if r.random() < 0.8:
                words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
            if r.random() < 0.3:
                words.insert(r.randrange(len(words)), "extra")
            texts.append(" ".join(words))
    texts += [f"{X.prose(300 + i, 50)} {passage} {X.prose(400 + i, 50)}" for i in range(8)]
    texts += [" ".join(r.choices("abc", k=r.randint(1, 9))) for _ in range(60)]
    return texts


@pytest.mark.parametrize("words, percent, task", [(3, 90, 1_500_000), (5, 80, 400), (1, 50, 100)])
def test_join_equals_brute_force(spark, monkeypatch, words, percent, task):
    """The small tasks cut shards into blocks, with leaders and a second search."""
    monkeypatch.setattr(ngram_join, "TASK_SHINGLES", task)
    monkeypatch.setattr(ngram_join, "LEADERS", 2)
    df = X.clashing(X.documents(spark, families())).repartition(3)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(df, words=words, percent=percent).collect())
    assert got == brute_join(rows, words, percent)


def test_routing_loses_no_link():
    """Every linking pair shares a routing key, by any threshold; checked on random sets."""
    r = np.random.default_rng(3)
    left_out = 0
    for percent in (50, 80, 90, 95):
        for _ in range(150):
            n = int(r.integers(2, 60))
            a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
            b = np.setdiff1d(a, r.choice(a, r.integers(0, 1 + n // 8)))
            b = np.union1d(b, r.integers(0, 2**64, r.integers(0, 1 + n // 8), dtype=np.uint64))
            if 100 * len(np.intersect1d(a, b)) < percent * len(np.union1d(a, b)) or np.array_equal(a, b):
                continue
            of = np.repeat([0, 1], [len(a), len(b)])
            node, size = ngram_join.nodes_of(of, np.concatenate([a, b]), 2)
            both = np.concatenate([a, b])
            key, owner = ngram_join.part_keys(of, both, node, size, percent)
            assert set(key[owner == node[0]]) & set(key[owner == node[1]]), (percent, len(a), len(b))
            # whatever keys are called frequent, and however frequent
            some = np.unique(r.choice(key, r.integers(1, len(key) + 1)))
            few, owner = ngram_join.part_keys(of, both, node, size, percent, (some, r.integers(1, 5, len(some))))
            assert set(few[owner == node[0]]) & set(few[owner == node[1]]), (percent, len(a), len(b))
            left_out += len(key) - len(few)
    assert left_out > 1_000


def test_a_frequent_line_brings_nothing_together(spark):
    """Documents with a common passage are no shard; copies among them still link."""
    passage = X.prose(5, 40)
    texts = [f"{X.prose(100 + i, 220)} {passage} {X.prose(5_000 + i, 180)}" for i in range(300)] + [X.prose(1, 400)]
    texts += [texts[7].replace(".", ",", 2), texts[8] + " more"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)
    assert len(ngram_join.frequent_keys(rows, 5, 80)[0])
    shards = ngram_join.shards_of(rows, 5, 80).groupBy("component").count()
    assert max(r["count"] for r in shards.collect()) < 10  # all 300 but for a few, if no part is left out
    got = {r.id: r.component_id for r in ngram_join.ngram_join(rows, words=5, percent=80, id_column="id").collect()}
    assert {i: c for i, c in got.items() if i != c} == {301: 7, 302: 8}


def test_passages_of_few_documents_are_no_chain(spark):
    """Each document shares a passage with the next one, and no two are in one slice; the one copy is a shard."""
    passages = [X.prose(900 + i, 400) for i in range(21)]
    texts = [f"{passages[i]} {X.prose(100 + i, 800)} {passages[i + 1]}" for i in range(20)]
    texts.append(texts[3].replace(".", ",", 2))
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(21)
    shards = ngram_join.shards_of(rows, 5, 80).groupBy("component").count()
    assert [r["count"] for r in shards.collect()] == [2]  # one shard of nearly all, if only known frequent parts are left out


@pytest.mark.parametrize("step", [1, 3, 100])
def test_shared_keys(monkeypatch, step):
    """Whatever the batches: counts of different nodes up to a bound, no key of one node, the smallest mark."""
    monkeypatch.setattr(ngram_join, "COUNTED", 4)
    rows = [(1, 5, 9), (2, 1, 0), (2, 1, 3), (3, 1, 7), (3, 2, 1), (3, 2, 2)] + [(4, i, i) for i in range(9)] + [(5, 1, 1), (6, 1, 1), (6, 2, 1)]
    columns = [np.array(c, np.int64) for c in zip(*rows)]
    batches = (pa.RecordBatch.from_arrays([pa.array(c[i : i + step]) for c in columns], names=["key", "node", "mark"]) for i in range(0, len(rows), step))
    got = [tuple(r.values()) for b in ngram_join.shared_keys(batches) for r in b.to_pylist()]
    want = [(3, 1, 7, 2), (3, 2, 1, 2)] + [(4, i, i, 4) for i in range(9)] + [(6, 1, 1, 2), (6, 2, 1, 2)]
    assert got == want


def test_join_of_nothing(spark):
    assert ngram_join.ngram_join(X.documents(spark, [])).count() == 0
    rows = ngram_join.ngram_join(X.documents(spark, ["", None])).collect()
    assert all(r.n_shingles == 0 and r.component_id == r.doc_id for r in rows)


def test_keep_one(spark):
    df = X.clashing(X.documents(spark))
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    ids = Counter(r.doc_id for r in kept.collect())
    # 5, 6 and 7 are copies and near copies; the repeated last row counts once, and its copy without an id goes
    assert ids[5] == 1 and not ids[6] and not ids[7] and ids[12] == 1 and ids[None] == 1
    assert all(ids[i] == 1 for i in (0, 1, 2, 3, 4, 8, 9, 10, 11))


def test_keep_one_judges_rows_not_ids(spark):
    a, b, c = X.prose(1, 80), X.prose(2, 80), X.prose(3, 80)
    texts = [(1, a), (2, a), (2, b), (None, c), (None, c + " more"), (7, ""), (7, ""), (8, a.replace("e", "E")), (1, a.replace("e", "E"))]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], X.DOCS)
    kept = Counter((r.doc_id, r.text) for r in ngram_join.keep_one(df).collect())
    # the copy of id 2 goes, its other text stays; of near copies without an id one stays
    few = {(1, min(a, a.replace("e", "E"))): 1, (2, b): 1, (7, ""): 2}
    assert {k: n for k, n in kept.items() if k[0] is not None} == few
    assert sum(n for k, n in kept.items() if k[0] is None) == 1


def thue_morse(n: int) -> tuple[str, str]:
    """Two strings that any polynomial hash modulo 2**64 takes for one another."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_that_polynomials_confuse(spark, n):
    x, y = thue_morse(n)
    df = X.documents(spark, [x, y, f"{x} {y} {x}", f"{y} {x} {y}"])
    rows = {r.doc_id: r for r in ngram_join.ngram_join(df, words=3, percent=90).collect() if r.doc_id is not None}
    assert all(rows[i].component_id == i for i in range(4))
    assert ngram_join.keep_one(df).where("doc_id IS NOT NULL").count() == 4


def test_many_visitors_are_dealt_in_blocks(spark):
    """Sets that share a part but don't link: every task holds a bounded block of visitors and of hosts."""
    schema = "shard long, node long, one long, n long, known long, block long, task long"
    state = spark.createDataFrame([(1, i, i, 1_000, max(i, 100), i % 3, i % 3) for i in range(9_000)], schema)
    visiting, hosts = ngram_join.outside_and_hosts(state, state.select("shard", "task").distinct(), F.col("n"))
    v, h = ({(r.task, r.node) for r in x.collect()} for x in (visiting, hosts))
    assert max(Counter(t for t, _ in v).values()) < 2_000 and max(Counter(t for t, _ in h).values()) <= 3_000
    tasks_of = defaultdict(set)
    for t, node in h:
        tasks_of[node].add(t)
    seen = defaultdict(set)
    for t, node in v:
        seen[node].add(t)
    hot = {i for i in range(101)}  # one component: not outside
    assert set(seen) == set(range(9_000)) - hot
    r = random.Random(1)
    assert all(seen[a] & tasks_of[b] for a, b in zip(r.choices(sorted(seen), k=3_000), r.choices(range(9_000), k=3_000)))


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 20)
    texts = X.edge_texts() + ["hot"] * 90 + [f"t{i // 3}" for i in range(60)] + [f"u{i}" for i in range(50)]
    rows = sharding.balanced_shards(X.clashing(X.documents(spark, texts)), 8).collect()
    assert len(rows) == len(texts) + 3
    count = Counter(r.shard for r in rows)
    assert set(count) == set(range(8)) and max(count.values()) - min(count.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(count[s])) for s in range(8))
    for r in rows:
        if r.doc_id is not None:
            data = (texts[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
    # the hot group needs four shards; with the small groups in its way it takes a few more, and they stay together
    shards_of = defaultdict(set)
    for r in rows:
        if r.doc_id is not None:
            shards_of[texts[r.doc_id]].add(r.shard)
    assert len(shards_of["hot"]) <= 6
    assert sum(len(shards_of[f"t{i}"]) > 1 for i in range(20)) <= 4
    assert sharding.balanced_shards(X.documents(spark, [])).count() == 0


def test_shards_of_copies(spark):
    """Tables whose rows are all, or nearly all, copies: a group that fits is whole, a larger one in as few shards as can be."""
    tables = [
        [f"t{i // 20}" for i in range(640)],
        [f"t{i // 3}" for i in range(600)] + ["hot"] * 200,
        ["hot"] * 90 + [f"t{i // 3}" for i in range(60)] + [f"u{i}" for i in range(50)],
    ]
    for texts in tables:
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        rows = sharding.balanced_shards(df, 8).collect()
        count = Counter(r.shard for r in rows)
        assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
        assert len(count) == 8 and max(count.values()) - min(count.values()) <= 1
        shards_of = defaultdict(set)
        for r in rows:
            shards_of[texts[r.doc_id]].add(r.shard)
        cut = {t for t, s in shards_of.items() if len(s) > 1} - {"hot"}
        # 200 triples beside a hot group of two shards leave rooms that three doesn't divide
        assert len(cut) <= (8 if len(texts) == 800 else 0)
        assert len(shards_of["hot"]) <= -(-texts.count("hot") // (len(texts) // 8))


def test_packed_groups():
    whole, cut, cuts = sharding.packed({20: 32}, [80] * 8)
    assert sum(b - a for _, a, b, _ in whole) == 32 and not cut and not cuts
    whole, cut, cuts = sharding.packed({7: 1, 2: 3}, [4, 4, 5])
    assert cuts == 1 and cut == [(7, 0, [(5, 2), (2, 0)])] and sum(b - a for _, a, b, _ in whole) == 3
    assert sharding.packed({3: 2}, [5]) is None
    # steps and rows of the plan don't grow with the groups of a size
    whole, cut, cuts = sharding.packed({2: 4 * 10**12, 1: 3}, [10**12 + 1] * 8)
    assert len(whole) <= 16 and not cut and sum(b - a for s, a, b, _ in whole if s == 2) == 4 * 10**12


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, label int")


def test_nearest(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in r.standard_normal(8) * (1 + i % 3)], "own", 1) for i in range(300)]
    rows += [(1000 + i, rows[7][1], "own", 1) for i in range(40)]  # ties
    rows += [rows[0], rows[1], (None, rows[2][1], "own", 1)]
    rows += [(2000, None, "", 0), (2020, [0.0] * 8, "", 0), (2040, [1.0] * 7 + [float("nan")], "", 0)]
    rows += [(2060, [1.0] * 7 + [float("inf")], "", 0), (2080, [1.0] * 7 + [None], "", 0), (2100, [1.0], "", 0)]
    part = [(i, np.array(v, float)) for i, v, _, _ in rows[:342]]
    want = {}
    for q, x in part:
        if q % 20 == 0:
            best = sorted((-float(np.einsum("d,d->", x, v)), i) for i, v in part if i != q)[:20]
            want[q] = [i for _, i in best]
    for block in (4096, 3):
        got = vantage.nearest(vectors(spark, rows), factor=1.0, shard=64, block=block).collect()
        assert {r.query_id for r in got} == set(want)
        for q in want:
            mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
            assert [r["rank"] for r in mine] == list(range(1, 21)) and [r.vec_id for r in mine] == want[q]
    assert vantage.nearest(vectors(spark, [])).count() == 0
    assert vantage.nearest(vectors(spark, rows[:1])).count() == 0


def test_lengths_are_tables_of_their_own(spark):
    r = np.random.default_rng(2)
    four = [(i, [float(x) for x in r.standard_normal(4)], "own", 1) for i in range(60)]
    five = [(1000 + i, [float(i), 1.0, 0.0, 0.0, 0.0], "own", 1) for i in (0, 1, 3)]
    alone = vantage.nearest(vectors(spark, four), factor=1.0).collect()
    both = vantage.nearest(vectors(spark, four + five + [(40_000, [2.0], "own", 1)]), factor=1.0).collect()
    assert len(alone) == 60 and {tuple(x) for x in alone} == {tuple(x) for x in both if x.query_id < 1000}
    assert [tuple(x) for x in both if x.query_id >= 1000] == [(1000, 1, 1001, 1.0), (1000, 2, 1003, 1.0)]


def test_recall_of_the_production_factor(spark, sf):
    rows = spark.read.parquet(f"{sf}/../sf0.1/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in rows])
    v = np.array([r.embedding for r in rows], float)
    asked = ids % 20 == 0
    exact = v[asked] @ v.T
    exact[ids[asked][:, None] == ids[None]] = -np.inf
    truth = ids[np.argsort(-exact, axis=1, kind="stable")[:, :20]]
    norm = np.sqrt(np.square(v).sum(axis=1)).max()
    _, found, _ = vantage.Search(ids, v, norm, 20, vantage.FACTOR).run(ids[asked], v[asked])
    assert np.mean([len({*a} & {*b}) / 20 for a, b in zip(found.tolist(), truth.tolist())]) >= 0.95


def test_deep_and_unclosed_pages_stay_cheap():
    import time
    import tracemalloc

    text = "<p>" + X.prose(3, 60) + "</p>"
    pages = ["<div>" * 50_000 + text, "<b>" * 20_000 + "</i>" * 20_000 + text, "<b><div>" * 15_000 + text]
    pages += [f'<div class="{"x" * 100_000}">{text}</div>', "<p><b>" * 15_000 + text]
    tracemalloc.start()
    for page in pages:
        begin = time.time()
        paths = html_text.votes(page)
        assert time.time() - begin < 10 and all(len(p) <= html_text.LONGEST for p in paths)
        assert html_text.extract(page, next(iter(paths), None)) == " ".join(X.prose(3, 60).split())
    assert tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()


def test_urls_with_white_space_have_one_host(spark):
    rows = [(i, f"{lead}https://Host.example/{i}", PAGE) for i, lead in enumerate(("", " ", "\t", "\n \r"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {html_text.host_of(u) for _, u, _ in rows} == {"host.example"}
    assert len({r.path for r in html_text.main_text(df).collect()} - {None}) == 1


PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="p-7"><header>Site</header>'
    '<nav><ul><li><a href="/a">menu</a></li></ul></nav><div class="cookie-notice">We use</div>'
    '<script>var t="</p>";</script><div class="content c12"><h1>Title &amp; more</h1>Intro  text&nbsp;here\n'
    "<p>One <b>tw</b>o<br>three<p>Four <a href='x>y'>link</a> &lt;five&gt;<div class=\"ad-box\">Buy</div>"
    "<ul><li>a<li>b</ul><!-- <p>no</p> --><form>name</form><div id=comments><p>nice post</div></div>"
    '<aside>side</aside><div class="sidebar">more</div><footer>foot</footer></body></html>'
)


def test_page_text():
    want = "Title & more\nIntro text here\nOne two three\nFour link <five>\na\nb"
    assert html_text.extract(PAGE, None) == want
    assert html_text.extract(PAGE, "/html/body.p-/div.c.content") == want
    assert html_text.extract(PAGE, "/no/such") == want
    assert html_text.extract("just text", None) == "just text"
    assert html_text.extract("<p>a < b<script>x", None) == "a < b"
    assert html_text.extract("</div></p><b>odd</i>", None) == "odd"


STORY = "<h1>Title</h1>" + "<p>a long story of many words</p>" * 20
LINES = "\n".join(["Title"] + ["a long story of many words"] * 20)
ASIDE = '<div class="sidebar"><p>more of the site</p></div><div id="comments"><p>nice post</p></div>'


def test_page_text_in_elements_named_like_boilerplate():
    for name in (
        "content-sidebar-wrap",
        "layout has-sidebar",
        "main-content no-comments",
        "social-science",
        "print-article",
        "legal-news",
    ):
        for story in (STORY, f"<article>{STORY}</article>"):
            page = f'<body><div class="{name}">{story}{ASIDE}</div><p>imprint</p></body>'
            assert html_text.extract(page, None) == LINES or html_text.extract(page, None) == f"{LINES}\nimprint", name
    page = f'<body><form action="/"><input name="q"><label>find</label><div id="c">{STORY}</div>{ASIDE}</form></body>'
    assert html_text.extract(page, None) == LINES
    # the article wins over longer comments, also where those are articles; single-purpose names stay dropped
    for tag in ("div", "article"):
        page = f'<body><article><p>a short text of its own</p></article><div class="comment-list"><{tag}>{STORY}</{tag}></div></body>'
        assert html_text.extract(page, None) == "a short text of its own"
    for name in ("sidebar", "sidebar-wrap", "cookie-notice"):
        page = f'<body><div><p>a short text of its own</p></div><div class="{name}">{STORY}</div></body>'
        assert html_text.extract(page, None) == "a short text of its own"
    # nothing else has text
    assert html_text.extract(f'<body><div class="print">{STORY}</div></body>', None) == LINES


def test_small_container_on_the_winning_path(spark):
    """A host of two templates: a teaser on the path of the other template isn't the page's text."""
    links = "<p><a href='/x'>" + "a link to another page " * 20 + "</a></p>"
    usual = f"<body>{links}<article>{STORY}</article></body>"
    other = f'<body><div class="text">{STORY}</div><article><p>read this too</p></article></body>'
    path = "/html/body/article"
    for page in (usual, other):
        page = f"<html>{page}</html>"
        assert LINES in html_text.extract(page, path)
    for url in ("http://h.example/", None):
        rows = [(i, url, f"<html>{usual}</html>") for i in range(5)] + [(5, url, f"<html>{other}</html>")]
        got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
        assert {r.path for r in got} == {path} and all(LINES in r.text for r in got)


def test_main_text(spark, monkeypatch):
    rows = [(i, f"http://h{i % 2}.example/{i}", PAGE) for i in range(6)]
    rows += [(6, None, None), (7, "no url", ""), (None, "http://h0.example/x", "<p>only</p>"), rows[0]]
    rows += [(8, "http://h1.example/long", "<article>" + "<p>word word</p>" * 3000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'own' AS text", "1 AS path")
    for few in (50_000, 0):  # broadcast and salted join
        monkeypatch.setattr(html_text, "FEW_HOSTS", few)
        got = html_text.main_text(df).collect()
        assert len(got) == len(rows)
        by_id = {r.page_id: r for r in got}
        assert by_id[1].text == html_text.extract(PAGE, None) and by_id[1].url == rows[1][1]
        assert by_id[6].text == by_id[7].text == "" and by_id[None].text == "only"
        assert by_id[8].text.count("\n") == 2999
        assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.main_text(df.limit(0)).count() == 0
