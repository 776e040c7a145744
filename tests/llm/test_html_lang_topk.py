from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesela.llm import html_text, language_id, topk

LONG = "This is the first paragraph of the article and it has a lot of words in it for you."
MORE = "Another of the paragraphs that we have with the words of the language and so on."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("plain words", ""),
        (f"<p>{LONG}</p>", LONG),
        (f"<nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>A &amp; B&nbsp;&#233;</h1><p><b>{LONG}<br>\n<p>Short.</p>\t<p>{MORE}</article><footer>the of and to in a is that for it as was with be by on not he</footer>", f"A & B é\n{LONG}\nShort.\n{MORE}"),
        (f"<div class='cookie-notice'>{LONG}</div><p>{MORE}</p>", MORE),
        (f"<article><p>{MORE}</p><section id=comments><p>{LONG}</p></section><form><p>{LONG}</p></form><aside><p>{LONG}</p></aside></article>", MORE),
        (f"<script>var a = '<p>{LONG}</p>';</script><style>p {{}}</style><!-- <p>{LONG}</p> --><p>{MORE}</p>", MORE),
        (f"<header><h2>Site</h2>{LONG}</header><main><h2>Head</h2><p>{LONG}</p><p>ok</p></main>", f"Head\n{LONG}\nok"),
        (f"<div><p>{LONG}</p><p>tiny</p><p>{MORE}</p></div>", f"{LONG}\ntiny\n{MORE}"),
        (f"<p>{LONG}</p><p>" + " ".join(f"<a href=y>the link number {i} of it</a>" for i in range(9)) + "</p>", LONG),
        ("<article><p>uno</p><p>| x | y |</p></article>", "uno\n| x | y |"),
        (f"<article><p>{LONG}", LONG),
        ("<" * 5000, ""),
    ],
)
def test_main_text(page, want):
    assert html_text.main_text(page) == want


SCRIPTS = {
    "ru": ["Старый мост через реку построили рабочие завода больше ста лет тому назад, и город до сих пор гордится этим.", "Каждой весной жители собираются на берегу, чтобы вспомнить строителей и послушать музыку местного оркестра."],
    "zh": ["这座老桥建于一百多年前，当时工厂的工人们用石头和钢铁把两岸连接起来，城市至今仍为此感到自豪。", "每年春天，居民们都会聚集在河边，纪念当年的建设者，并聆听当地乐队演奏的音乐，直到夜幕降临。"],
    "it": ["Il vecchio ponte sopra il fiume venne costruito dagli operai della fabbrica oltre cento anni fa, e la città ne va fiera.", "Ogni primavera gli abitanti si ritrovano lungo la riva per ricordare i costruttori, ascoltando la musica della banda."],
}


@pytest.mark.parametrize("lang", sorted(SCRIPTS))
def test_pages_of_other_languages_are_not_empty(lang):
    a, b = SCRIPTS[lang]
    head = a[:12].rstrip()
    menu = "<nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav>"
    links = "<div><a href=x>one two three</a> <a href=y>four five</a></div>"
    page = f"{menu}<div><h1>{head}</h1>" + f"<div>{a}</div><div>{b}</div>" * 4 + f"</div>{links}<footer>{a}</footer>"
    assert html_text.main_text(page) == "\n".join([head, *[a, b] * 4])


def test_a_page_of_short_paragraphs_is_not_empty():
    short = [f"Sphinx number {i} waits" for i in range(20)]
    page = "<nav><a href=x>Home page of ours</a></nav>" + "".join(f"<p>{x}</p>" for x in short) + "<p><a href=y>All the other pages</a></p>"
    assert html_text.main_text(page) == "\n".join(short)


TEASER = "<article><h3>Card</h3><p>Short teaser of the card.</p><a href=x>Read more</a></article>"
LINKS = "<p><a href=x>one two three</a> <a href=y>four</a></p>"
SPARSE = " ".join(f"keyword{i}" for i in range(30))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<div><h1>Head</h1><p>{LONG}</p><p>tiny</p><p>{MORE}</p></div>{TEASER}{TEASER}", f"Head\n{LONG}\ntiny\n{MORE}"),
        (f"<main><h1>Head</h1><div>{LONG}</div><div>{MORE}</div>{TEASER}{TEASER}</main>", f"Head\n{LONG}\n{MORE}"),
        (f"<main><h1>Head</h1><article><p>{LONG}</p><p>{MORE}</p></article></main>", f"Head\n{LONG}\n{MORE}"),
        (f"<article><h1>Head</h1><p>{LONG}</p><p>{MORE}</p>{LINKS}<p>{SPARSE}</p><h4>Tags</h4>{LINKS}</article>", f"Head\n{LONG}\n{MORE}"),
        (f"<article><p>{SPARSE}</p><p>uno</p></article>", f"{SPARSE}\nuno"),
        (f"<article><p>{LONG}</p><p>{MORE}</p></article><div>{LONG} {MORE}</div>", f"{LONG}\n{MORE}\n{LONG} {MORE}"),
        (f"<div><h1>Head</h1><div>{LONG}</div><div>ok</div><div>{MORE}</div></div><div>{SPARSE}</div>", f"Head\n{LONG}\nok\n{MORE}"),
    ],
)
def test_articles_are_evidence_among_others(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        *[(f"<div class='{c}'><p>{LONG}</p></div>", LONG) for c in ("site-content no-sidebar", "has-sidebar", "content-no-comments", "legal-news", "social-science")],
        *[(f"<div class='{c}'><p>{LONG}</p></div><p>{MORE}</p>", MORE) for c in ("ad", "x ad-slot-2", "site-footer", "side-bar", "cookie_notice", "comments-area", "Related-Posts")],
        (f"<div id=search><p>{LONG}</p><p>{MORE}</p><div class=comments>{LONG}</div></div>", f"{LONG}\n{MORE}"),
        (f"<p>{LONG}</p><svg class=i/><p>{MORE}</p><math/><p>ok</p><p>{LONG}</p>", f"{LONG}\n{MORE}\nok\n{LONG}"),
        (f"<p>{LONG}</p><button><p>{MORE}</p><svg/><p>ok</p><p>{LONG}</p><svg><g>no</g><svg>no</svg>no</svg>", f"{LONG}\n{MORE}\nok\n{LONG}"),
        (f"<p>{LONG}</p><script>{MORE}", LONG),
    ],
)
def test_names_and_unclosed_elements_leave_the_text(page, want):
    assert html_text.main_text(page) == want


def test_pages_frame(spark):
    df = spark.createDataFrame([(1, "u", f"<p>{LONG}</p>"), (2, None, None)], "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS _row")
    out = html_text.extract_main_text(df)
    assert out.columns == ["page_id", "url", "html", "_row", "text", "n_chars"]
    assert [(r.page_id, r.text, r.n_chars) for r in out.orderBy("page_id").collect()] == [(1, LONG, len(LONG)), (2, "", 0)]
    assert html_text.extract_main_text(df.limit(0)).count() == 0


def test_generated_pages_give_back_their_articles(spark):
    import html as entities
    import re

    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1)>", body)]
        assert html_text.main_text(r.html) == "\n".join(b for b in blocks if b)


def test_languages_of_held_out_documents(spark):
    from tesela.llm.queries import op4_language_id

    got = op4_language_id(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").filter("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixtures_and_edges(spark):
    en, fr = "the cat and the dog with that thing ", "le chat et la souris avec que dans "
    train = spark.createDataFrame([(en * 5, "en"), (fr * 5, "fr"), (None, "en"), ("x", None)], "text string, lang string")
    model = language_id.learn_languages(train)
    assert model.languages == ["en", "fr"]
    rows = [(1, en * 3), (2, fr * 3), (3, en * 6 + fr * 3), (4, None), (5, ""), (6, "12 -- 34"), (7, "漢字だけ"), (8, en)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS _letter")
    got = {r.doc_id: r for r in language_id.identify_languages(df, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5, 6)] == ["en", "fr", "en", "und", "und", "und"]
    assert got[3].lang_set == ["en", "fr"] and got[3].score == pytest.approx(2 / 3, abs=0.1)
    assert got[1].lang_set == ["en"] and got[1].score == 1.0 and got[4].score == 0.0 and got[4].lang_set == []
    assert got[7].lang_pred in ("en", "fr")
    none = language_id.learn_languages(train.limit(0))
    assert {r.lang_pred for r in language_id.identify_languages(df, none).collect()} == {"und"}
    assert language_id.identify_languages(df.limit(0), model).count() == 0


def test_every_label_is_learned(spark, monkeypatch):
    words = [f"{chr(97 + i // 10)}{chr(107 + i % 10)}{chr(97 + i // 10)}" for i in range(70)]
    rows = [(i, f"{w} " * (100 - i), f"l{i:02}") for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn_languages(df)
    assert model.languages == [r[2] for r in rows]
    assert all(r.lang_pred == r.lang for r in language_id.identify_languages(df, model).collect())
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 69)
    with pytest.raises(ValueError):
        language_id.learn_languages(df)


def brute_topk(vectors, every, k):
    out = []
    for q, v in vectors.items():
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), c) for c, w in vectors.items() if c != q and len(w) == len(v))[:k]
            out += [(q, i, c, -s) for i, (s, c) in enumerate(scores, 1)]
    return sorted(out)


def test_topk_against_brute_force(spark, monkeypatch):
    import math

    monkeypatch.setattr(topk, "BLOCK", 64)
    rng = np.random.default_rng(4)
    rows = {i: (rng.normal(size=8) * rng.choice([0.1, 1, 5])).astype(np.float32).tolist() for i in range(600)}
    for i in range(100, 260):
        rows[i] = rows[100]
    rows[600], rows[601], rows[602] = [0.0] * 8, [0.0] * 8, [1.0, 2.0]
    bad = [(700, None), (701, [1.0, None] + [0.0] * 6), (702, [float("nan")] + [0.0] * 7), (703, [float("inf")] + [0.0] * 7), (704, []), (None, [1.0] * 8)]
    df = spark.createDataFrame([*rows.items(), *bad], "vec_id long, embedding array<float>").withColumn("norm", F.lit(1))
    whole = {i: [math.floor(256 * float(x)) for x in v] for i, v in rows.items()}
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.norm_bucket_topk(df).collect())
    assert got == brute_topk(whole, 50, 5)
    assert topk.norm_bucket_topk(df.limit(0)).count() == 0


def test_topk_of_large_components_and_repeated_ids(spark):
    """All finite vectors take part, products are exact where neither doubles nor longs hold them, and rows of one id are rows of their own."""
    import math

    rng = np.random.default_rng(6)
    sizes = [1.0, 1e3, 2e7, 3e9, 1e30]
    rows = [(i % 90, (rng.normal(size=4) * sizes[i % 5]).astype(np.float32).tolist()) for i in range(180)]
    rows += [(200, [3.0e38, -3.0e38, 3.0e38, 1.0]), (201, [-3.0e38, 3.0e38, -3.0e38, 1.0]), (0, rows[0][1])]
    got = Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.norm_bucket_topk(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows]
    want = Counter()
    for at, (q, v) in enumerate(whole):
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), c) for n, (c, w) in enumerate(whole) if n != at)[:5]
            want.update((q, i, c, min(max(-s, -(2**63)), 2**63 - 1)) for i, (s, c) in enumerate(scores, 1))
    assert got == want
    keys = [topk._sortable(x) for x in (-(2**200), -(2**70) - 1, -(2**70), -(2**63))] + [topk._sortable(x) for x in (2**63, 2**70, 2**70 + 1, 2**200)]
    assert keys == sorted(keys)


def test_topk_broadcasts_no_vectors(spark):
    """Vectors meet by a shuffle, however many cells their blocks are sent to; a broadcast of them is refused here."""
    import pyarrow as pa

    v = np.random.default_rng(8).normal(size=(4000, 256)).astype(np.float32)
    table = pa.table({"vec_id": np.arange(4000), "embedding": pa.ListArray.from_arrays(np.arange(0, v.size + 1, 256, dtype=np.int32), v.ravel())})
    # the page of any hashed table, as small as it may be, counts 64 MB
    changed = {"spark.sql.shuffle.partitions": "64", "spark.sql.maxBroadcastTableSize": "96m"}
    before = {x: spark.conf.get(x) for x in changed}
    try:
        for x, y in changed.items():
            spark.conf.set(x, y)
        got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.norm_bucket_topk(spark.createDataFrame(table).repartition(4), every=8).collect())
    finally:
        for x, y in before.items():
            spark.conf.set(x, y)
    whole = np.floor(256 * v.astype(float))
    s = whole[::8] @ whole.T
    s[np.arange(500), np.arange(500) * 8] = -np.inf
    best = np.lexsort((np.broadcast_to(np.arange(4000), s.shape), -s), axis=1)[:, :5]
    assert got == [(q * 8, i + 1, int(c), int(s[q, c])) for q in range(500) for i, c in enumerate(best[q])]


@pytest.mark.parametrize("size", [1.0, 1e5, 1e20])
def test_a_task_keeps_the_best_of_many_blocks(size):
    """Cell by cell, thresholds that rise from block to block give what all products at once give, ties to smaller ids."""
    import pyarrow as pa

    rng = np.random.default_rng(9)
    v = np.floor(256 * size * rng.integers(-3, 4, (300, 4)) * rng.choice([1.0, 0.25], (300, 1)))
    ids, norms = rng.permutation(300), np.sqrt((v**2).sum(1))
    order = np.argsort(-norms)

    def binary(x):
        return pa.array([x], pa.binary())

    def row(cell, at, top, least):
        vectors, least = topk._vector_bytes(v[at]), None if least is None else least.tobytes()
        parts = [pa.array([cell], pa.int64()), pa.array([4], pa.int32()), pa.array([top]), *map(binary, (at.tobytes(), ids[at].tobytes(), vectors, least))]
        return pa.RecordBatch.from_arrays(parts, names=["cell", "dim", "top", "rows", "ids", "vectors", "least"])

    cells = [(0, np.arange(0, 40)), (0, np.arange(40, 75)), (1, np.arange(100, 130))]
    batches = []
    for cell in (0, 1):
        batches += [row(cell, at, np.inf, np.full(len(at), -np.inf)) for c, at in cells if c == cell]
        batches += [row(cell, order[lo : lo + 37], norms[order[lo]], None) for lo in range(0, 300, 37)]
    merged = pa.Table.from_batches(batches).combine_chunks().to_batches()
    got = Counter(x for b in topk._search(5)(iter(merged)) for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
    want, whole = Counter(), [[int(x) for x in r] for r in v]
    for _, at in cells:
        for q in at.tolist():
            scores = sorted((-sum(a * b for a, b in zip(whole[q], whole[c], strict=True)), int(ids[c])) for c in range(300) if c != q)[:5]
            want.update((q, int(ids[q]), c, min(max(-s, -(2**63)), 2**63 - 1), topk._sortable(-s)) for s, c in scores)
    assert got == want


def test_both_prunings_keep_the_best():
    rng = np.random.default_rng(5)
    c = rng.integers(-50, 50, (400, 6))
    q = c[:20] * 2
    s = q @ c.T
    s[np.arange(20), np.arange(20)] = -(10**9)
    best = np.sort(s, axis=1)[:, -3:]
    for least in (np.full(20, -np.inf), best[:, 0].astype(float), best[:, 2].astype(float)):
        rows, a, b, v = map(np.array, topk.search_block(np.arange(20), np.arange(20), q.astype(float), least, np.arange(400), np.arange(400), c.astype(float), 3))
        assert (rows == a).all()
        for i in range(20):
            assert sorted(v[a == i]) == sorted(x for x in best[i] if x >= least[i])


BROKEN = ["<p a='", "<a<", "<!", "</script", "<svg", "<div>", "</p>", "<dd><dt>", "</h1>", "<p a=b c", "&#", "<![CDATA[", "<li><b>x</b>", '<i a="\'>', "<!-- ", "<script>"]


@pytest.mark.parametrize("bit", BROKEN)
def test_time_grows_with_the_page(bit):
    import time

    began = time.perf_counter()
    html_text.main_text("<article><p>" + LONG + "</p>" + bit * (400_000 // len(bit)))
    assert time.perf_counter() - began < 15
    assert html_text.main_text(f"<article><p>{LONG}</p><p>{MORE}</p></article>{bit}{bit}").startswith(LONG)


def test_ends_of_tags():
    page = "<p a='x>y' b=\"<i>\">one</p><p title='it's>two"
    ends = html_text.TagEnds(page)
    for at in range(len(page) + 1):
        quote, want = "", -1
        for i in range(at, len(page)):
            c = page[i]
            if not quote and c == ">":
                want = i
                break
            quote = ("" if c == quote else quote) if quote else (c if c in "'\"" else "")
        assert ends.after(at) == want
