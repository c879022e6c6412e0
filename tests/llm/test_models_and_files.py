"""Classifiers, mixing, neighbours, page text, token files and the pipeline."""

import hashlib
import html
import random
import time
import re
import tracemalloc
import zlib
from types import SimpleNamespace

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from compare import DATA, compare, connect
from gridlark.llm import html_text, labelled, mixing, neighbours, quality, token_files, toxicity
from gridlark.llm.queries import QUERIES
from gridlark.sources.scratch import scratch_path
from helpers import FOLDER, SCHEMA, clashing, documents
from test_text_operators import naive_hits, naive_links

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n\n", "word", "a" * 3000, "many words " * 5000]


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("key", [k for k, q in QUERIES.items() if q.oracle])
def test_query_against_sql(spark, duck, key):
    verdict, rows = compare(QUERIES[key].run(spark, FOLDER), duck, QUERIES[key].oracle)
    assert verdict == "ok" and rows


def labelled_rows(label, modulus, held, per_class, least=0):
    """Training rows of a larger folder, and the held-out ones."""
    folder = DATA / "sf0.1"
    rows = duckdb.sql(
        f"SELECT d.doc_id, d.text, l.{label} FROM '{folder}/documents.parquet' d JOIN '{folder}/labels.parquet' l "
        f"USING (doc_id) ORDER BY hash(doc_id)"
    ).fetchall()
    held_out = [r for r in rows if zlib.crc32(str(r[0]).encode()) % modulus == held]
    seen = [r for r in rows if zlib.crc32(str(r[0]).encode()) % modulus != held and len(r[1]) <= 10_000]
    train = [r for y in (0, 1) for r in [s for s in seen if s[2] == y][:per_class]]
    return sorted(train), held_out


def area(scores, labels):
    """Area under the curve of hits against false alarms."""
    scores, labels = np.array(scores), np.array(labels)
    rank = scores.argsort(kind="stable").argsort()
    ones = labels == 1
    return (rank[ones].sum() - ones.sum() * (ones.sum() - 1) / 2) / (ones.sum() * (~ones).sum())


def test_quality_of_held_out_texts():
    train, held = labelled_rows("quality", 5, 0, 1000)
    model = quality.train(train)
    scores = model.scores([t for _, t, _ in held])
    labels = np.array([y for *_, y in held])
    assert area(scores, labels) > 0.97
    assert (scores[labels == 1] >= 0.3).mean() > 0.97 and (scores[labels == 0] < 0.3).mean() > 0.85


def test_quality_does_not_depend_on_length():
    """Held-out texts of one class joined to long ones keep the class."""
    train, held = labelled_rows("quality", 5, 0, 1000)
    model = quality.train(train)
    for label in (0, 1):
        pool = [t for _, t, y in held if y == label]
        evidence = {}
        for size in (10_000, 100_000, 1_000_000, 3_000_000):
            rng = random.Random(size)
            texts = ["\n".join(rng.choices(pool, k=size // 300))[:size] for _ in range(4)]
            assert all((s >= 0.3) == bool(label) for s in model.scores(texts)), (label, size)
            evidence[size] = np.median([model.difference(t)[0] for t in texts])
        # The dictionaries tell as much of a long text as of a short one.
        assert all(abs(e) > 0.6 * abs(evidence[10_000]) and e * evidence[10_000] > 0 for e in evidence.values()), evidence


def test_pieces_are_the_whole_text():
    step = quality.PIECE_BYTES
    for n in (0, 1, step, 3 * step // 2 - 1, 2 * step, 7 * step + 5, 1_000_003):
        data = bytes(i % 251 for i in range(n))
        parts = quality.pieces(data)
        assert b"".join(parts) == data and max(map(len, parts)) <= 1.5 * step
        assert len(parts) == 1 or min(map(len, parts)) >= 0.75 * step - 1


def test_toxicity_of_held_out_texts():
    train, held = labelled_rows("toxic", 4, 2, 500)
    model = toxicity.train(train, epochs=5)
    held = held[:400]
    scores = model.scores(pa.array([t for _, t, _ in held]))
    assert area(scores, [y for *_, y in held]) > 0.85


def test_network_gradients():
    """Backpropagation against differences."""
    rng = np.random.default_rng(0)
    model = toxicity.train([(0, "one two three four", 0), (1, "two five", 1)], epochs=0)
    words = toxicity.read_words(pa.array(["one two three four", "two five"]))
    start, length, text = toxicity.windows_of(words.counts)
    inputs = toxicity._some(words, model.known(words), start, length)
    labels, weights = np.array([0.0, 1.0], np.float32), np.ones(2, np.float32)
    p = {k: rng.standard_normal(v.shape).astype(np.float64) * 0.4 for k, v in model.params.items()}

    def loss():
        x = toxicity._inputs(p, *inputs[:3]).astype(np.float64)
        z = toxicity._window_logits(p, x @ p["wx"] + p["bx"], inputs[3], inputs[4]).astype(np.float64)
        return float((np.log1p(np.exp(z)) - labels * z).mean())

    grad = toxicity._gradients(p, *inputs, labels, weights)
    for name in ("wx", "uf", "ub", "wa", "va", "wo", "bo"):
        spot = tuple(rng.integers(0, n) for n in p[name].shape)
        kept, step = p[name][spot], 1e-2
        p[name][spot] = kept + step
        high = loss()
        p[name][spot] = kept - step
        low = loss()
        p[name][spot] = kept
        assert abs((high - low) / (2 * step) - grad[name][spot]) < 2e-3, name


def test_all_windows_overlap():
    start, size, text = toxicity.windows_of(np.array([0, 5, 32, 33, 100]))
    for t, n in enumerate([0, 5, 32, 33, 100]):
        own = text == t
        first = int(np.array([0, 0, 5, 37, 70])[t])
        covered = {w for s, m in zip(start[own], size[own]) for w in range(s - first, s - first + m)}
        assert covered == set(range(n)) and (size[own] <= 32).all()


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_scores_of_odd_tables(spark, module, label):
    docs = clashing(documents(spark, [*ODD, *["good plain words here now"] * 30, *["BAD!! worthless!! LOUD!!"] * 30]), "score", "label")
    labels = spark.createDataFrame(
        [(i, int(i < 37), int(i >= 37)) for i in range(5, 67)] + [(None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int"
    )
    model = module.fit(docs, labels)
    rows = module.score(docs, model).collect()
    assert len(rows) == 67 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[0].score == by[1].score
    m, held = (module.MODULUS, module.HELD)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % m == held) for r in rows)
    assert module.score(docs.limit(0), model).count() == 0
    blank = module.fit(docs, labels.limit(0))
    assert {r.score for r in module.score(docs, blank).collect()} == {0.5}


def test_sample_is_bounded_and_leaves_out_what_is_held(spark):
    docs = documents(spark, [f"text {i}" for i in range(400)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    drawn = labelled.sample(docs, labels, "quality", 5, 0, 20, 100)
    assert len(drawn.rows) == 40 and drawn.zeros + drawn.ones > 300
    assert all(zlib.crc32(str(d).encode()) % 5 for d, *_ in drawn.rows)


def naive_mix(rows):
    """(doc_id, text, source) rows -> copies of each, in the rows' order."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = sum(size)
    own = {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * own[s] + 1e-9}
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: 3.0 * own[s] for s in over}
        open_ -= over
    key = [hashlib.md5(f"mix-1:{'' if d is None else d}".encode()).hexdigest() for d, *_ in rows]
    queue, done = [], dict.fromkeys(names, 0)
    for i in sorted(range(len(rows)), key=lambda i: (int(key[i][:8], 16) % 4096, key[i], rows[i][0] or -1, size[i])):
        s = rows[i][2]
        done[s] += size[i]
        for e in range(3):
            upto = e * own[s] + done[s]
            if size[i] and target[s] > 0 and upto - size[i] < target[s]:
                queue.append((upto / target[s], names.index(s), key[i], rows[i][0] or -1, e, i))
    copies, words = [0] * len(rows), 0
    for *_, i in sorted(queue):
        words += size[i]
        if words > total:
            break
        copies[i] += 1
    return copies, size, own, target


def test_mix(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randrange(1, 40), rng.choice(["hot"] * 20 + ["a", "b", "c", "Z", None])) for i in range(400)]
    rows += [(1000, None, "a"), (1001, "", "empty"), (1002, "w " * 900, "b"), (None, "w w", "a")]
    docs = spark.createDataFrame([(d, t, "en", s, 0) for d, t, s in rows], SCHEMA).repartition(3)
    got = mixing.mix(clashing(docs, "size", "rank", "bucket", "finish"), into="m").collect()
    copies, size, own, target = naive_mix(rows)
    want = {d: (n, own[s], c) for (d, _, s), n, c in zip(rows, size, copies)}
    assert {r.doc_id: (r.m.size, r.m.source_size, r.m.copies) for r in got} == want
    for r in got:
        assert abs(r.m.target - target[r.source]) < 1e-6 and r.m.copies <= 3
    taken = {s: sum(r.m.size * r.m.copies for r in got if r.source == s) for s in own}
    largest = {s: max([n for n, r in zip(size, rows) if r[2] == s]) for s in own}
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in own)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(copies)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mixed_documents(docs.filter("text = ''")).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[700:760] = x[3]
    rows = [(int(i), [float(v) for v in x[i]], 0) for i in range(len(x))]
    rows += [(2000, None, 0), (2100, [0.0] * 16, 0), (2200, [float("nan")] * 16, 0), (2300, [None] + [1.0] * 15, 0), (None, [1.0] * 16, 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(4)
    asked = vectors.filter("vec_id % 100 = 0")
    got = neighbours.nearest(vectors, asked).collect()
    hits = 0
    for q in range(0, 1500, 100):
        found = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(x)), d))[:10]
        assert [r for r, *_ in found] == list(range(1, 11)) and q not in {v for _, v, _ in found}
        assert all(abs(s - d[v]) < 1e-9 for _, v, s in found)
        hits += len(set(best.tolist()) & {v for _, v, _ in found})
    assert hits >= 0.9 * 150
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 700), key=lambda r: r["rank"])] == [3, *range(701, 710)]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r.vec_id) for r in neighbours.nearest(few, few.filter("vec_id = 0")).collect()] == [(1, 1), (2, 2)]
    assert neighbours.nearest(few.limit(0), few.limit(0)).count() == 0
    assert neighbours.nearest(few.limit(1), few.limit(1)).count() == 0


def test_descent_goes_on_until_it_settles(spark, monkeypatch):
    """From a poor start, two layouts; three rounds are too few for it."""
    monkeypatch.setattr(neighbours, "LAYOUTS", 2)
    x = np.random.default_rng(8).standard_normal((6000, 24)).astype(np.float32)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>").repartition(4)
    rows = neighbours.build_graph(points, 10).collect()
    d = (x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T
    np.fill_diagonal(d, np.inf)
    exact = {(i, int(j)) for i, row in enumerate(np.argpartition(d, 9, axis=1)[:, :10]) for j in row}
    assert len({(r.id, r.other) for r in rows} & exact) > 0.87 * len(exact)
    monkeypatch.setattr(neighbours, "MOST_ROUNDS", 3)
    with pytest.raises(RuntimeError, match="not settled after 3 rounds"):
        neighbours.build_graph(points, 10)


PAGES = "page_id long, url string, html string"
PAGE = """<html><head><title>no</title><style>p{}</style><script>var t = "</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies.</p></div>
<main><article><header><h1>The &amp; title</h1></header><p>First  paragraph,<br>with <b>bold</b>
text.</p><div class="advert"><p>Buy now!</p></div><p>Second &eacute;&#233; paragraph.<p>Third one.
<ul><li>point one</li><li>point two</li></ul></article></main>
<aside><h3>More</h3><p>Other things to read here.</p></aside><form><label>Mail</label><input></form>
<section class="comments"><h3>Comments</h3><p>I liked this very much indeed.</p></section>
<footer>&copy; somebody</footer></body></html>"""


def test_page_text(spark):
    pages = spark.createDataFrame(
        [(1, "u", PAGE), (2, "v", None), (None, None, ""), (3, "w", "plain text only"), (4, "x", "<p" * 50), (5, "y", "<script>never closed")],
        PAGES,
    )
    field = html_text.fit(clashing(pages, "text", "n_chars"))
    got = {r.page_id: r for r in html_text.extract(clashing(pages, "text", "n_chars"), field).collect()}
    expected = "The & title\nFirst paragraph, with bold text.\nSecond éé paragraph.\nThird one.\npoint one\npoint two"
    assert (got[1].text, got[1].n_chars, got[1].url) == (expected, len(expected), "u")
    assert got[2].text == got[None].text == got[5].text == "" and len(got) == 6
    assert html_text.extract(pages.limit(0), field).count() == 0


def test_page_parts_that_only_look_hidden():
    """Only the elements of HIDDEN leave out their content; what else looks hidden is left to the field."""
    field = html_text.train(html_text.layout_pages(150), rounds=60)
    body = "".join(f"<p>Sentence {i} of the article, which is long enough to be its text.</p>" for i in range(4))
    text = "\n".join(b.text for b in html_text.blocks_of(body))
    for bears in ('class="overflow-hidden"', 'aria-hidden="false"', 'class="hidden-print"', "class=hidden", 'title="Hidden gems"', 'data-hidden="0"',
                  "data-x='display:none'", 'style="overflow:hidden"', 'id="hidden"', "title='aria-hidden=true'"):
        for tag in ("article", "main", "div"):
            assert field.text(f"<body><nav><ul><li><a href='/'>Home</a></li></ul></nav><{tag} {bears}>{body}</{tag}></body>") == text, (tag, bears)
    for bears in ("hidden", "HIDDEN=''", 'style="color:red;display : none"', "aria-hidden=true"):
        page = f"<body><article>{body}<div {bears}><p>Not shown.</p></div></article></body>"
        assert html_text.blocks_of(page)[-1].text == "Not shown." and field.text(page) == text, bears
    formula = "<article><p>Here <math><mi>a</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>"
    assert [b.text for b in html_text.blocks_of(formula)] == ["Here a=2 holds."]
    for open_head in ("<html><head><title>t</title><meta charset=x><template><p>no</p></template>", "<head><script>x</script>"):
        assert [b.text for b in html_text.blocks_of(f"{open_head}<article>{body}</article>")] == text.split("\n")
        assert [b.text for b in html_text.blocks_of(f"{open_head}\n<b>Plain</b> words")] == ["Plain words"]
        assert [b.text for b in html_text.blocks_of(f"{open_head}\nPlain words")] == ["Plain words"]


def test_given_pages():
    """The pages mark their article: its paragraphs are the text."""
    pages = pq.read_table(DATA / "sf0.01" / "pages.parquet").column("html").to_pylist()
    marked = [html_text.marked_page(p) for p in pages[:100]]
    field = html_text.train([*html_text.layout_pages(150), *(m for m in marked if m)], rounds=60)
    for page in pages[100:]:
        inner = re.search("<article>(.*)</article>", page, re.S)[1]
        blocks = [html.unescape(re.sub(r"</?[bia]\b[^>]*>", "", b).replace("<br>", " ")) for b in re.split("</?(?:p|h1)>", inner)]
        assert field.text(page) == "\n".join(" ".join(b.split()) for b in blocks if b.strip())


def test_viterbi_finds_the_best_labelling():
    field = html_text.train(html_text.layout_pages(40), rounds=30)
    rng = random.Random(2)
    for rows, _ in html_text.layout_pages(30, seed=5):
        rows = rows[: rng.randint(1, 8)]
        scores = field.emissions(rows)

        def total(labels):
            steps = sum(field.change[a, b] for a, b in zip(labels, labels[1:]))
            return field.begin[labels[0]] + sum(scores[i, y] for i, y in enumerate(labels)) + steps

        every = [[(n >> i) & 1 for i in range(len(rows))] for n in range(2 ** len(rows))]
        assert [int(y) for y in field.best(scores.tolist())] == max(every, key=total)


def test_scores_along_the_chain_are_the_emissions():
    """Sums kept at the elements against the features of each block one by one."""
    field = html_text.train(html_text.layout_pages(60), rounds=30)
    pages = [r for r in pq.read_table(f"{FOLDER}/pages.parquet")["html"].to_pylist() if r][:60]
    for page in [*pages, '<div class="nav content nav"><div class="content">a<p>b</div><ul><li>c<li>d</ul>']:
        blocks = html_text.blocks_of(page)
        if blocks:
            assert np.allclose(field.scores(blocks), field.emissions(html_text.features(html_text.blocks_of(page))), atol=1e-9)


@pytest.mark.parametrize(
    "page",
    ["<b" * 500_000, "<a " + "x=1 " * 250_000, '<a "' * 250_000 + ">", "<!" * 500_000, "<div>x" * 100_000, "<script>" * 100_000,
     "<script>" + "</script " * 100_000, '<b"' * 300_000, "<center>" * 100_000 + "</x>" * 100_000,
     "<li><div>" + "<center>" * 50_000 + "<li></li>" * 50_000, "".join(f'<div class="c{i}x">t' for i in range(50_000))],
    ids=range(11),
)
def test_broken_and_deep_pages_take_seconds(page):
    field = html_text.train(html_text.layout_pages(10), rounds=5)
    start = time.monotonic()
    field.text(page)
    assert time.monotonic() - start < 30


def test_tags_with_quotes():
    """A tag ends at the first > outside quotes; what never ends is text."""
    texts = lambda page: [b.text for b in html_text.blocks_of(page)]
    assert texts("<p title='a>b'>x</p>") == ["x"]
    assert texts('<p title="a\'>b">x') == ["x"]
    assert texts('<p title="a>x</p>y') == ['<p title="a>x', "y"]
    assert texts("a < b <p>c<d") == ["a < b", "c<d"]
    assert texts("<!-- a > b -->c<!d>e<!--f") == ["ce"]
    assert texts("") == texts("<p></p>") == []


def test_fit_sends_few_pages_to_the_driver(spark):
    """Pages are chosen by numbers; equal pages and rows without id are chosen once."""
    page = "<main><p>Some words of text.</p></main><footer>End.</footer>"
    rows = [(1, "u", page)] * 50 + [(None, "u", page)] * 3 + [(i, "u", page.replace("Some", f"Some {i}")) for i in range(2, 30)] + [(99, "u", None)]
    field = html_text.fit(spark.createDataFrame(rows, "page_id long, url string, html string"), most=20)
    assert field.text(page) == "Some words of text."


def test_neighbours_of_unequal_and_tiny_vectors(spark):
    rows = [(i, [float(i), 1.0]) for i in range(40)] + [(100, [1.0]), (101, [1.0, 2.0, 3.0]), (102, [1e-45, 0.0]), (103, [0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest(table, table.filter("vec_id IN (0, 100, 102)"), 3).collect()
    assert {r.query_id for r in got} == {0, 102} and not {r.vec_id for r in got} & {100, 101, 103}
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 0] == [(1, 1.0), (102, 1.0), (2, 2.0)]


TEXTS = [
    "", " ", "  a", "a  b", "a \n b", " a b ", "a<|endoftext|> b", "x  y z", "don't  we're 'll", "\t\ta b\n", "1 2  3", "é ñ　 ü",
    "a  b", "x\u0085 y", "l'été c'est d'accord… !a×! é!", "it's's x<|endoftext|>! a|>", None, "word " * 3000, "x" * 2000,
]


def whole_text_ids(texts):
    encoder = Tokenizer.from_file(TOKENIZER)
    return [[*encoder.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def test_token_files(spark):
    texts = [*TEXTS, *(r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60).collect())]
    rng = random.Random(1)
    ids = rng.sample(range(10_000), len(texts))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in zip(ids, texts)], SCHEMA).repartition(5)
    path = scratch_path(spark, "test-tokens")
    token_files.write_token_files(clashing(docs, "ids", "part", "n_tokens"), path, TOKENIZER)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.token_digest(spark, path).collect()}
    start = 0
    for i, found in sorted(zip(ids, whole_text_ids(texts))):
        assert got[i] == (start, len(found), zlib.crc32(np.array(found, "<u4").tobytes()))
        start += len(found)
    some = token_files.read_tokens(spark, path, ids[:3])
    assert {r.doc_id: list(r.ids) for r in some.collect()} == dict(zip(ids[:3], whole_text_ids(texts[:3])))
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().executedPlan().toString()
    files = spark.read.parquet(path).inputFiles()
    meta = pq.ParquetFile(files[0].removeprefix("file://")).metadata.row_group(0)
    columns = {meta.column(c).path_in_schema: meta.column(c) for c in range(meta.num_columns)}
    assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and columns["doc_id"].has_offset_index


def test_token_files_of_odd_tables(spark):
    rows = [(5, "b", "en", "s", 0), (5, "a", "en", "s", 0), (None, "c", "en", "s", 0), (5, "a", "en", "s", 0)]
    path = scratch_path(spark, "test-tokens")
    token_files.write_token_files(spark.createDataFrame(rows, SCHEMA), path, TOKENIZER)
    got = sorted((r.start, r.doc_id) for r in token_files.token_digest(spark, path).collect())
    assert got == [(0, None), (2, 5), (4, 5), (6, 5)]
    empty = scratch_path(spark, "test-tokens")
    token_files.write_token_files(spark.createDataFrame([], SCHEMA), empty, TOKENIZER)
    assert token_files.token_digest(spark, empty).count() == 0


def test_worker_memory_is_bounded():
    encoder = token_files.PieceEncoder(TOKENIZER, most_pieces=50)
    for i in range(5):
        ids, lengths = encoder.encode(pa.array([f"alpha{i} beta{j} gamma" for j in range(40)]), 2)
        assert ids.tolist() == [x for t in range(40) for x in whole_text_ids([f"alpha{i} beta{t} gamma"])[0]]
        assert len(encoder.known) < 150


def test_pipeline(spark):
    """The registered run against a plain one over the same folder."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [tuple(r) for r in docs.orderBy("doc_id").collect()]
    model = quality.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    kept = [r for r, s in zip(rows, model.scores([r[1] or "" for r in rows])) if s >= 0.3]
    links = naive_links([(r[0], r[1]) for r in kept])
    kept = [r for r in kept if links[r[0]][1] == r[0]]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    hits = naive_hits([r[1] for r in kept], items)
    kept = [r for i, r in enumerate(kept) if not hits[i][4]]
    copies = naive_mix([(r[0], r[1], r[3]) for r in kept])[0]
    expected, start = [], 0
    for r, n in zip(kept, copies):
        (ids,) = whole_text_ids([r[1]])
        for _ in range(n):
            expected.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    got = [tuple(r) for r in corpus_pipeline.run(spark, FOLDER).orderBy("doc_id", "start").collect()]
    assert got == expected and len(got) > 50
    assert [name for name, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None


def test_stages_keep_the_columns(spark):
    docs = clashing(spark.read.parquet(f"{FOLDER}/documents.parquet"), "score", "mix", "again").withColumn("x", F.array(F.lit(1)))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), FOLDER).count() == 0


def test_encoder_memory(monkeypatch):
    """A large batch goes through the encoder in parts: few bytes and few pieces at once."""
    r = random.Random(8)
    texts = ["".join(r.choices("abcdefghij ", k=3000)) for _ in range(1400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1400)), pa.array(texts)], names=["doc_id", "text"])
    encoder, calls = token_files.PieceEncoder(TOKENIZER), []

    class Tokens:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode_batch_fast(self, pieces, **options):
            calls.append(len(pieces))
            return self.tokenizer.encode_batch_fast(pieces, **options)

    encoder.tokenizer = Tokens(encoder.tokenizer)
    monkeypatch.setattr(token_files, "_worker_encoder", lambda file: encoder)
    monkeypatch.setattr(token_files, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    got = []
    tracemalloc.start()
    try:
        for rows in token_files._encoder(TOKENIZER, 2)(iter([batch])):
            got += rows.column("ids").slice(0, 3).to_pylist()
            assert rows.column("part_start")[0].as_py() >= 0
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got[:3] == whole_text_ids(texts[:3])
    assert max(calls) <= 20_000
    assert most < 150e6, most
