import math
from collections import Counter
from itertools import groupby

import pytest
import xxhash

from binweave.llm import style_tree as s

SF = "/root/testdata/sf0.01"


def main(source):
    return s.parse(source.encode()).main()


@pytest.mark.parametrize(
    ("source", "blocks"),
    [
        ("<div class=cookie-notice>x</div><header><h1>Site</h1></header><main><article><header><h1>T&eacute;st</h1><p>by me</p></header><p>a<b>b</b>&nbsp; c<br>d<p>e <a href=x>l</a> f<ul><li>1<li>2</ul><aside>no</aside>"
         "<form>q<input></form><div class=\"comments\"><p>c1</p></div></article></main><div id=\"sidebar\">s</div><footer>f</footer>", ["Tést", "ab c d", "e l f", "1", "2"]),
        ('<body><div id="nav"><a>1</a></div><div class="post-content"><p>hello</p> tail</div><div class=ads>x', ["hello", "tail"]),
        ("<p>1 < 2 &lt; 3 <script>if(a<b)</script>t</p><table><tr><td>a<td>b</table><textarea>zz</textarea>&am", ["1 < 2 < 3 t", "a", "b", "&am"]),
        ("", []), ("<a <b <p", []), ("plain", ["plain"]), ("<!-- x --><p title='a>b'>y<!-- <p>no", ["y"]), ("<p>a</p></p></div>b<script>never closed", ["a", "b"]),
        ('<article>x</article><article class="comment">y</article><div role="navigation">z</div><p hidden>h</p>', ["x"]),
        ('<article><div class="article-header"><h1 class="header">T</h1><p>by</p></div><p>a <span class="advert">buy</span>b <button>no</button><ins class="adsbygoogle">z</ins>c</p><p class="notice">n</p></article>', ["T", "a b c"]),
        ('<div class="page-header"><h1>Site</h1></div><div class="alert">cookies</div><div id="story"><h2>T</h2>x</div>', ["T", "x"]),
    ],
)
def test_pages(source, blocks):
    assert main(source) == blocks


def test_deep_and_long_pages():
    assert main("<div>" * 5000 + "x" + "</div>" * 5000) == ["x"]
    assert main("<article><p>" + "word " * 200_000) == [("word " * 200_000).strip()]


def test_whole_tables_give_the_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    docs = {"\n".join(" ".join(x.split()) for x in r[0].split("\n") if x.split()) for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()}
    rows = s.extract(pages, keep=["page_id", "url"]).collect()
    assert len(rows) == pages.count()
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    assert sum(r["text"].split("\n", 1)[-1] in docs for r in rows) / len(rows) > 0.9


def brute_force(rows):
    """The tree in plain Python: (host, html) rows to (texts, composites), from the blocks of each page."""
    parsed = [(h, s.parse((x or "").encode())) for h, x in rows]
    distinct: dict = {}
    for h, page in parsed:
        area = max((b[2] for b in page.blocks if b[3] is False), default=0)
        blocks = [b for b in page.blocks if b[3] is False and b[2] == area]
        distinct.setdefault((h, "\n".join(b[1] for b in blocks)), []).append((page, blocks))
    seen: dict = {}
    for (h, _), same in distinct.items():
        for path in {b[0] for _, blocks in same for b in blocks}:
            digest = lambda t: xxhash.xxh3_64_intdigest(t) >> 1
            of_page = []
            for page, blocks in same:
                if own := [b for b in blocks if b[0] == path]:
                    names = [k for k, _ in groupby(page.children.get(path, []))]
                    of_page.append((digest("".join(b[1] + "\n" for b in own)), digest("\n".join(names)), sum(len(b[1]) for b in own), sum(b[4] for b in own)))
            seen.setdefault((h, path), []).append(min(of_page))
    score = {}
    for key, found in seen.items():
        m = len(found)
        entropy = lambda k: -sum(c / m * math.log(c / m) for c in Counter(f[k] for f in found).values()) / math.log(m) if m > 1 else 1.0  # noqa: B023, E731
        mixed = 0.8 * entropy(0) + 0.2 * entropy(1) if m >= s.MIN_PAGES else 1.0
        score[key] = mixed * (1 - sum(f[3] for f in found) / max(1, sum(f[2] for f in found)))
    best = {h: max(v for (g, _), v in score.items() if g == h) for h, _ in score}
    low = {k for k, v in score.items() if len(seen[k]) >= s.MIN_PAGES and v < 0.3 * best[k[0]] - 1e-9}
    texts = []
    for h, page in parsed:
        area = max((b[2] for b in page.blocks if b[3] is False), default=0)
        texts.append("\n".join(b[1] for b in page.blocks if b[3] is False and b[2] == area and (h, b[0]) not in low))
    return texts, score


def host(url):
    return (url or "").split("//")[-1].split("/")[0].lower() if url else ""


def test_whole_tables_as_a_tree_in_plain_python(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()
    got = {r["page_id"]: r["text"] for r in s.extract(spark.read.parquet(f"{SF}/pages.parquet"), keep=["page_id", "url"]).collect()}
    texts, _ = brute_force([(host(r["url"]), r["html"]) for r in rows])
    assert got == {r["page_id"]: t for r, t in zip(rows, texts, strict=True)}


def bare_site(prose, n=24, copies=6):
    """Pages of blocks without semantic tags or telling names: of a post, boxes that repeat on the site, and links."""
    pages = []
    for i in range(n):
        k = i % (n - copies)  # the last ones are copies
        post = f'<div class="b"><div class="c{i}"><h2>{prose(70 + k, 4)}</h2><p>{prose(k, 30)}</p><p>{prose(k % 3, 9)}</p></div><div class="e">{prose(5000 + k % 2, 12)}</div></div>'
        box = f'<div class="a"><p>{prose(9000, 20)}</p></div>' if i % 5 else ""
        links = "<div class=d>" + " ".join(f"<a href=/{j}>{prose(i * 100 + j, 2)}</a>" for j in range(6)) + "</div>"
        pages.append((i, f"http://bare.example/{i}", f"<body>{box}{post}{links}<div class=f><span>{prose(9001, 6)} {i % 2}</span></div></body>", f"{prose(70 + k, 4)}\n{prose(k, 30)}\n{prose(k % 3, 9)}"))
    return pages


def test_only_the_tree_separates_text_from_boilerplate(spark, prose):
    pages = bare_site(prose)
    df = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")
    out = {r["page_id"]: r["text"] for r in s.extract(df).collect()}
    assert out == {p[0]: p[3] for p in pages}
    assert list(out.values()) == brute_force([(host(p[1]), p[2]) for p in pages])[0]
    for p in pages:  # without the tree the boxes and links stay
        alone = "\n".join(main(p[2]))
        assert alone != p[3]
        assert prose(9001, 6) in alone


def test_the_tree_judges_inside_articles(spark, prose):
    rows = [(i, "http://h/", f"<article><h1>{prose(i, 3)}</h1><p>{prose(i + 50, 20)}</p><p class=k>By the staff of the paper</p><section><div>{prose(7, 10)}</div></section><section class=s>{prose(i + 90, 9)}</section></article>") for i in range(9)]
    out = {r["page_id"]: r["text"] for r in s.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {i: f"{prose(i, 3)}\n{prose(i + 50, 20)}\n{prose(i + 90, 9)}" for i in range(9)}


def test_entropy_by_hand(spark):
    body = lambda i: f'<body><div class="x{i % 2}9"><p>same line</p></div><div class="share">go</div><section class="tail"><div>Read more at our site</div></section><div class="text">{"word" * (i + 1)} unlike any</div>'
    rows = [(i, f"http://HOST.example:80/{i}", body(i)) for i in range(8)] + [(8, None, body(8)), (9, "http://host.example:80/x", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    with_host = df.withColumn("h", s.host_of(df.url))
    tree = {(r["host"], r["path"]): r for r in s.importance(s.nodes(with_host, "h", "html")).collect()}
    _, score = brute_force([("host.example:80" if u else "", h) for _, u, h in rows])
    assert {k: r["composite"] for k, r in tree.items()} == pytest.approx(score, abs=1e-6)
    assert sorted(round(v, 3) for (h, _), v in score.items() if h) == [0, 0, 0.8]
    out = {r["page_id"]: r["text"] for r in s.extract(df).collect()}
    assert out[0] == "word unlike any"
    assert "Read more" in out[8]  # alone on its host
    assert out[9] == ""


def test_repeated_lines_of_articles_stay(spark):
    rows = [(i, "http://h/", f"<article><h1>Same title</h1><p>Same line.</p><p>Own {i}.</p><div class=promo>p</div><div class=box>Follow us</div></article>") for i in range(12)]
    out = s.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in out} == {f"Same title\nSame line.\nOwn {i}." for i in range(12)}
    copies = [(i, "http://h/", "<article><p>One text.</p></article>") for i in range(6)]
    out = s.extract(spark.createDataFrame(copies, "page_id long, url string, html string").withColumnRenamed("page_id", "_host"), keep=["_host"]).collect()
    assert {r["text"] for r in out} == {"One text."}


def test_empty(spark):
    assert s.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
