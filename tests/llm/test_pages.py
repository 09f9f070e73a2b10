"""Pages: main text and archive."""

import hashlib
import math
import random
import time
from collections import Counter

from skein.llm import html_text, warc

PAGES = "page_id long, url string, html string, text string, payload string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES).repartition(3)


def test_text_of():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav>x</nav>
    <div class="sidebar">side</div><article><header><h1>T &amp; U</h1></header><p>One<p>Two <b>bold</b>er<ul><li>a<li>b</ul>
    <section class="comments"><p>hey</p></section><aside>as</aside><form>f<input>g</form><script>var t="</p>";</script>
    tail &lt;x&gt; &nbsp; z<table><tr><td>1<td>2<tr><td>3</table></article><div id="respond">r</div><footer>f</footer>"""
    assert html_text.text_of(page, set()) == "T & U\n\nOne\n\nTwo bolder\n\na\n\nb\n\ntail <x> z\n\n1\n\n2\n\n3"
    assert html_text.text_of("<p>hello <b>x<br><p>y a<5 and b>3</p><div class='ad-box'>k</div>", set()) == "hello x\n\ny a<5 and b>3"
    for broken in ("<", "<!-- a", "</p>", "<p", "&#xffffffff;", "<script>x", "<div>" * 3000 + "end"):
        html_text.text_of(broken, set())
    assert html_text.text_of("<div>" * 3000 + "end", set()) == "end"


def site(k, n, body):
    return [(100 * k + i, f"https://h{k}.example/p{i}", f"<body><div class=x>Same words on every page of the site</div><div class=y>{body(i)}</div></body>") for i in range(n)]


def tree_by_hand(pages):
    """Merged tree of one site: importance of every removable element, from whole trees in memory."""
    every = {}
    for html in set(pages):
        for x in html_text.candidates(html_text.dom(html)):
            shape = tuple(k.style for k in x.kids if isinstance(k, html_text.Node) and k.tag not in html_text.UNSEEN)
            own = tuple(t for t in [x.link, *(" ".join(k.split()) for k in x.kids if isinstance(k, str))] if t)
            every.setdefault((x.key, x.up.key), []).append((shape, own))

    def entropy(values):
        n = len(values)
        if n == 1:
            return 1.0
        return min(1.0, -sum(c / n * math.log(c / n, n) for c in Counter(values).values()) + 2 / n)

    out = {}

    def importance(key):
        if key not in out:
            rows = next(v for k, v in every.items() if k[0] == key)
            parts = [(len(v), *importance(k)) for (k, up), v in every.items() if up == key]
            content = entropy([r[1] for r in rows]) if any(r[1] for r in rows) else None
            share = 0.9 ** len({r[0] for r in rows})
            weight = sum(p[0] for p in parts) + (len(rows) if content is not None else 0)
            inner = (sum(p[0] * p[1] for p in parts) + (len(rows) * content if content is not None else 0)) / weight if weight else 0
            own = entropy([r[0] for r in rows])
            own = (1 - share) * own + share * inner if weight else own
            out[key] = own, max([own, content or 0.0, *(p[2] for p in parts)])
        return out[key]

    for key, _ in every:
        importance(key)
    low = {k for k, (_, most) in out.items() if most < html_text.LOW}
    return {k: out[k][0] for k, up in every if k in low and up not in low}


def test_templates_match_brute_force(spark):
    rnd = random.Random(3)
    menu = lambda i: "<div class=m1><ul>" + "".join(f"<li><a href=/{w}>{w}</a>" for w in ("news", "sport", f"day {i % 3}")[: 2 + i % 2]) + "</ul></div>"
    rows = [(100 * h + i, f"http://h{h}.example/{i}", f"<body>{menu(i)}<div class=box{i}><p>Same<span>{'x' if rnd.random() < 0.9 else i}</span></div><article><p>Own {i}</p><div class=z>Boiler</div></article><section><h2>All</h2><p>{rnd.random()}</p></section></body>") for h in range(3) for i in range(4 + 20 * h)]
    rows.append((999, "http://h2.example/copy", rows[-1][2]))
    t = table(spark, rows).withColumn("host", html_text.host_of())
    got = {}
    for r in html_text.templates(t.select("host", "html")).collect():
        got.setdefault(r.host, {})[r.key] = r.importance
    for h in range(3):
        want = tree_by_hand([r[2] for r in rows if f"//h{h}." in r[1]])
        assert set(got.get(f"h{h}.example", {})) == set(want)
        assert all(abs(got[f"h{h}.example"][k] - v) < 1e-9 for k, v in want.items())
    assert got["h2.example"]
    # Broadcast and joined by host with salt give the same texts.
    a, b = (sorted((r.page_id, r.text) for r in html_text.extract(table(spark, rows), broadcast_bytes=n).collect()) for n in (html_text.BROADCAST_BYTES, 0))
    assert a == b and "Boiler" not in dict(a)[205] and "Boiler" in dict(a)[2]


def test_tokenizer_is_linear():
    """Unclosed tags, quotes and comments, long and deep pages take seconds, not hours."""
    for part in ("<a x ", '<a x="', "<div>", "</x>", "<li><div>", "<b><p>", "<!--", "&", "<script>", "<style></stile>"):
        began = time.time()
        html_text.text_of(part * 100_000, set())
        assert time.time() - began < 20, part
    long = "word " * 1_000_000
    assert html_text.text_of(f"<article><p>{long}</p></article>", set()) == long.strip()


def test_site_template_goes(spark):
    pages = site(1, 8, lambda i: f"<p>Story number {i} is told here.</p>") + site(2, 2, lambda i: f"<p>Other {i}</p>")
    got = {r.page_id: r.text for r in html_text.extract(table(spark, pages)).collect()}
    assert got[103] == "Story number 3 is told here."
    assert got[200] == "Same words on every page of the site\n\nOther 0"  # too few pages to tell


def test_article_text_stays(spark):
    page = lambda i: f"<article><p>The same line.</p><p>Own line {i}.</p></article>"
    rows = [(i, "http://h.example/", page(i % 9)) for i in range(20)] + [(50, None, None), (51, "bad url", ""), (None, "http://h.example/", page(1)), (1, "http://h.example/", page(1))]
    got = html_text.extract(table(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = "" if r.page_id in (50, 51) else f"The same line.\n\nOwn line {1 if r.page_id is None else r.page_id % 9}."
        assert (r.text, r.n_chars) == (want, len(want))
    assert html_text.extract(table(spark, [])).count() == 0


def test_archive(spark, tmp_path):
    big = "x" * 999 + "é"
    rows = [(1, "http://a/1", big), (2, "http://a/\r\n2", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", "y" * 1000), (7, "u", "y" * 1000), (None, "u", "y" * 1000), (8, "u", "z" * 999)]
    got = warc.archive(table(spark, rows)).collect()
    want = Counter()
    for i, _, h in rows:
        p = (h or "").encode()
        last = max((j for j, _, g in rows if (g or "").encode() == p and j is not None), default=None)
        revisit = len(p) >= 1000 and last is not None and i != last
        want[i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", last if revisit else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert warc.archive(table(spark, [])).count() == 0


def test_archive_round_trip(spark, tmp_path):
    rows = [(i, f"http://a/{i}", "p" * (990 + i % 15)) for i in range(40)]
    path = str(tmp_path / "w")
    warc.write_archive(table(spark, rows), path)
    assert spark.read.parquet(f"{path}/payloads").count() == 15
    records = warc.read_archive(spark, path)
    assert all(r.verified for r in records.collect())
    data = b"".join(bytes(r.record) for r in warc.export(records).orderBy("page_id").collect())
    parsed = warc.parse(data)
    html = {i: h.encode() for i, _, h in rows}
    assert len(parsed) == 40
    for fields, head, body in parsed:
        i = int(fields["warc-record-id"].split(":")[2])
        http, _, payload = body.partition(b"\r\n\r\n")
        assert http.startswith(b"HTTP/1.1 200 OK\r\n") and f"Content-Length: {len(html[i])}".encode() in http
        assert payload == (html[i] if fields["warc-type"] == "response" else b"")
        assert head.startswith(b"WARC/1.1\r\n") and fields["content-type"] == "application/http; msgtype=response"
        assert (fields["warc-type"] == "revisit") == ("warc-profile" in fields)
    assert len({f["warc-record-id"] for f, _, _ in parsed}) == 40


def test_archive_of_a_long_page_and_repeated_ids(spark, tmp_path):
    rows = [(1, "u", "é" * 3_000_000), (1, "u", "other"), (2, "u", "é" * 3_000_000), (2, "v", "x")]
    path = str(tmp_path / "w")
    warc.write_archive(table(spark, rows), path)
    parsed = warc.parse(b"".join(bytes(r.record) for r in warc.export(warc.read_archive(spark, path)).collect()))
    assert len({f["warc-record-id"] for f, _, _ in parsed}) == 4
    kinds = sorted((f["warc-type"], int(f["warc-record-id"].split(":")[2])) for f, _, _ in parsed)
    assert kinds == [("response", 1), ("response", 2), ("response", 2), ("revisit", 1)]
