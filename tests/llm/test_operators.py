"""Each operator against plain Python, and on odd rows, empty tables and clashing columns."""

import hashlib
import random
import re
import time
import unicodedata
from itertools import combinations

import numpy as np
import pytest
import regex
import xxhash
from conftest_llm import EXTRA, frame, prose, vocabulary
from pyspark.sql import functions as F

from lineaframe.llm import decontam, fingerprint, html_text, license_scan, mixing, pii, quality, simhash, suffix_dedup, url_filter
from lineaframe.llm.queries import QUERIES, URL_RULES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def ids(rows):
    return sorted((r[0] for r in rows), key=str)


# ---- 1: decontamination


def plain_scan(text, bench):
    w, hit, items = words(text), set(), set()
    for item, body in bench:
        b = words(body)
        m = min(10, len(b))
        grams = {tuple(b[i : i + m]) for i in range(len(b) - m + 1)} if b and item is not None else set()
        for i in range(len(w) - m + 1):
            if m and tuple(w[i : i + m]) in grams:
                hit |= set(range(i, i + m))
                items.add(str(item))
    return len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


@pytest.mark.parametrize("block_chars", [decontam.BLOCK_CHARS, 300])
def test_decontamination_finds_every_window(spark, odd_rows, block_chars):
    rng = random.Random(1)
    few = ["Ab", "cd", "EF", "gh"]
    bench = [(i, " ".join(rng.choice(few) for _ in range(rng.randrange(1, 25)))) for i in range(12)]
    bench += [(20, None), (21, ""), (None, "ab cd ef gh ab cd ef gh ab cd"), (22, "a"), (22, "ab cd"), (23, prose(rng, 40)), (100, prose(rng, 11))]
    docs = [(i, " ,".join(rng.choice(few) for _ in range(rng.randrange(60)))) for i in range(30)]
    docs += [(40, prose(rng, 50) + "\n" + bench[-2][1] + " " + prose(rng, 30)), (41, bench[-1][1].upper())]
    rows = docs + [r[:2] for r in odd_rows]
    table = spark.createDataFrame(bench, "item_id bigint, text string")
    got = decontam.scan(frame(spark, rows), table, block_chars=block_chars, into="found").select("doc_id", "found.*").collect()
    want = [(i, *plain_scan(t, bench)) for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert any(r[2] for r in want) and any(r[3] > 1 for r in want)


def test_benchmark_blocks_are_bounded(spark):
    """Copies of an item, and one long item, over many blocks; none is above the bound and every window is in one block."""
    rng = random.Random(81)
    long = prose(rng, 4000, vocabulary(3000, 82))
    bench = [(1, prose(rng, 30))] * 300 + [(2, long), (3, "a b c"), (4, None), (5, " - ")]
    items = spark.createDataFrame(bench, "item string, body string").where("body is not null").distinct()
    blocks = list(decontam._blocks(items, 10, 4000))
    assert len(blocks) > 5 and max(sum(len(t) for _, t in b) for b in blocks) <= 4000
    found = [" ".join(w[i : i + 10]) for b in blocks for item, t in b if item == "2" for w in [words(t)] for i in range(len(w) - 9)]
    w = words(long)
    assert sorted(found) == sorted(" ".join(w[i : i + 10]) for i in range(len(w) - 9))
    docs = [(1, prose(rng, 20) + " " + " ".join(long.split()[1990:2110])), (2, bench[0][1]), (2, bench[0][1]), (3, "x a B c y"), (4, None), (None, "a b c")]
    table = spark.createDataFrame(bench, "item_id bigint, text string")
    got = decontam.scan(frame(spark, docs), table, block_chars=4000, into="found").select("doc_id", "found.*").collect()
    want = [(i, *plain_scan(t, set(bench))) for i, t in docs]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_decontamination_of_empty_tables(spark):
    docs, bench = frame(spark, [(1, "a b")]), spark.createDataFrame([], "item_id bigint, text string")
    assert [tuple(r) for r in decontam.scan(docs, bench, into="f").select("f.n_words", "f.n_hit").collect()] == [(2, 0)]
    assert decontam.scan(frame(spark, []), bench).count() == 0


def test_shift_tables_skip():
    table = decontam.build([("i", "a b c d e f g h i j")])[0]
    assert table.shift[b"i", b"j"] == 0 and table.shift[b"a", b"b"] == 8 and table.length == 10


# ---- 2: quality


def junk(rng, n):
    words = prose(rng, n).split()
    pick = rng.randrange(4)
    if pick == 0:
        return " ".join(w.upper() + "!!" for w in words)
    if pick == 1:
        return " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in words)
    if pick == 2:
        return " | ".join(words)
    return " ".join(" ".join([w] * 10) for w in words[: max(4, n // 10)])


def test_quality_separates_held_out_rows(spark, odd_rows):
    rng = random.Random(2)
    rows = [(i, junk(rng, rng.randrange(20, 200)) if i % 3 == 0 else prose(rng, rng.randrange(5, 300)).capitalize()) for i in range(600)]
    labels = spark.createDataFrame([(i, 0 if i % 3 == 0 else 1, 0) for i in range(600)] + [(None, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    docs = frame(spark, rows)
    net = quality.fit(docs, labels)
    scored = quality.score(docs, net).select("doc_id", quality.held_out(F.col("doc_id")).alias("out"), "score").collect()
    out = [r for r in scored if r["out"]]
    assert 80 < len(out) < 250 and np.mean([(r["score"] >= 0.7) == (r["doc_id"] % 3 != 0) for r in out]) > 0.95
    again = quality.fit(docs.repartition(5), labels)
    assert np.array_equal(net.left, again.left)
    odd = quality.score(frame(spark, [r[:2] for r in odd_rows]), net).collect()
    assert len(odd) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in odd)
    assert len({r["score"] for r in odd if not r["text"]}) == 1


def test_quality_without_labels(spark):
    docs = frame(spark, [(1, "a"), (2, "b")])
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, none)).collect()} == {0.5}
    only = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id bigint, quality int")
    assert min(r["score"] for r in quality.score(docs, quality.fit(docs, only)).collect()) > 0.99
    assert quality.score(frame(spark, []), quality.train([], [])).count() == 0


def test_held_out_rule(spark):
    import zlib

    got = spark.range(200).select("id", quality.held_out(F.col("id")).alias("out")).collect()
    assert all(r["out"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in got)


def plain_forward(net, text):
    """The network as its definition reads, byte by byte."""
    data = list((text or "").encode())
    cells = max(2, -(-len(data) // 64))
    embed = lambda i: net.embed[data[i]] if 0 <= i < len(data) else np.zeros(net.embed.shape[1])
    channels = []
    for c in range(cells):
        byte_filters = []
        for at in range(64 * c, 64 * c + 64, 2):
            window = np.concatenate([embed(i) for i in range(at - 4, at + 2)])
            byte_filters.append(np.maximum(window @ net.bytewise + net.offset, 0) if at < len(data) else np.zeros(len(net.offset)))
        repeats = [sum(data[i] == data[i - lag] for i in range(64 * c, min(64 * c + 64, len(data))) if i >= lag) / 64 for lag in range(1, 25)]
        channels.append(np.concatenate([np.mean(byte_filters, axis=0), repeats]))
    pooled = np.zeros(len(net.shift))
    for one, two in zip(channels, channels[1:], strict=False):
        pooled = np.maximum(pooled, one @ net.left + two @ net.right + net.shift)
    return 1 / (1 + np.exp(-(pooled @ net.out + net.bias[0])))


def test_network_is_what_its_definition_says(monkeypatch):
    rng = random.Random(3)
    texts = [None, "", "a", "x" * 64, "é" * 70, prose(rng, 400), junk(rng, 200), prose(rng, 900)]
    net = quality.train(texts[2:], [0, 1, 0, 1, 0, 1], steps=3)
    want = [plain_forward(net, t) for t in texts]
    assert np.allclose(net.scores(texts), want, atol=1e-4) and len(set(np.round(want, 5))) > 4
    monkeypatch.setattr(quality, "PIECE", 7)
    monkeypatch.setattr(quality, "PACK", 9)
    assert np.allclose(net.scores(texts), want, atol=1e-4)


def test_gradients():
    rng = np.random.default_rng(5)
    texts, y, weight = ["ab cd " * 30, "x", "!!" * 90, "zz y" * 40], np.array([1, 0, 1, 0]), np.full(4, 0.25)
    net = quality._new(rng)
    for name, value in vars(net).items():
        setattr(net, name, value.astype(np.float64) + 0.05)

    def loss():
        p = net.scores(texts)
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    for p, g in zip(vars(net).values(), quality.gradients(net, texts, y, weight), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        here = p[at]
        p[at] = here + 1e-3
        up = loss()
        p[at] = here - 1e-3
        down = loss()
        p[at] = here
        assert abs((up - down) / 2e-3 - g[at]) < 0.01 + 0.02 * abs(g[at])


def test_quality_learns_from_long_texts(spark):
    """Texts of over 20,000 characters are examples like any other, and ids that repeat in the table lose no row of the bound."""
    rng = random.Random(51)
    rows = [(i, (junk(rng, 5000) if i % 2 else prose(rng, 7000).capitalize())) for i in range(80)]
    docs = frame(spark, rows + rows[:20])
    labels = spark.createDataFrame([(i, 0 if i % 2 else 1) for i in range(-200, 80)], "doc_id bigint, quality int")
    assert min(len(t) for _, t in rows) > 20_000
    scored = quality.score(docs, quality.fit(docs, labels, train_rows=25)).where(quality.held_out(F.col("doc_id"))).collect()
    assert np.mean([(r["score"] >= 0.7) == (r["doc_id"] % 2 == 0) for r in scored]) > 0.9


# ---- 3: personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def plain_pii(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in regex.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 13 <= len(digits) <= 19 and plain_luhn(digits), "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_base_spans(spark, odd_rows):
    rng = random.Random(4)
    alphabet = ["a@b.c", "@", ".", "x", "1", "25", "256", "0", " ", "-", "+", "(", ")", "4111 1111 1111 1111", "+49 30 1234567", "10.0.0.1", "é", "😀", "_", "%", "..", "a.b-c@d-e.f.g", "000255"]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))) for i in range(400)]
    rows += [(900, "a@b.c_d@e.f+@x"), (901, "1.2.3.4.5.6.7.8"), (902, "4111111111111111" * 30), (903, " a@b.co" * 700), (904, "+" + "(" * 5000)]
    rows += [r[:2] for r in odd_rows]
    got = pii.annotate(frame(spark, rows)).collect()
    base = sorted(((r["doc_id"], [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] in pii.BASE_KINDS]) for r in got), key=str)
    assert base == sorted(((i, plain_pii(t)) for i, t in rows), key=str)
    assert pii.annotate(frame(spark, [])).count() == 0


def test_pii_added_kinds_and_redaction(spark):
    text = "Pay to IBAN DE89 3704 0044 0532 0130 00 now, not DE89 3704 0044 0532 0130 01. My SSN: 123-45-6789; part no 123-45-6789 of a very long list of spare parts and other things. Call +1 (212) 555-0153 or mail 😀 x@y.org"
    got = frame(spark, [(1, text), (2, "clean"), (3, None)]).select("doc_id", "text", pii.find_spans(F.col("text")).alias("s"))
    rows = {r["doc_id"]: r for r in got.withColumn("out", pii.redact(F.col("text"), F.col("s"))).collect()}
    found = {(s["kind"], text[s["start"] : s["end"]]) for s in rows[1]["s"]}
    assert ("iban", "DE89 3704 0044 0532 0130 00") in found and ("ssn", "123-45-6789") in found
    assert len([k for k, _ in found if k == "iban"]) == 1 and ("phone", "+1 (212) 555-0153") in found
    assert rows[1]["out"].startswith("Pay to IBAN [IBAN] now") and rows[1]["out"].endswith("Call [PHONE] or mail 😀 [EMAIL]")
    assert rows[2]["out"] == "clean" and rows[3]["out"] is None
    assert all(0 <= s["score"] <= 1 for s in rows[1]["s"])


def test_pii_of_long_texts(spark):
    """Positions, scores and replacements past the first piece of a text, and time in proportion to the number of spans."""
    rng = random.Random(45)
    filler = lambda n: "".join(rng.choice("xyz é😀.\n") for _ in range(n))
    text = "".join(filler(rng.randrange(1, 700)) + rng.choice([" a@b.org ", " mail: c.d@e.fr ", " +49 30 1234567 ", " IBAN DE89370400440532013000 ", " 10.0.0.1 "]) for _ in range(150)) + filler(9000)
    short = [text[i : i + 3000] for i in range(0, len(text), 3000)]
    rows = [(1, text)] + [(i, t) for i, t in enumerate(short, 2)]
    got = {r["doc_id"]: r for r in frame(spark, rows).select("doc_id", "text", pii.find_spans(F.col("text")).alias("s")).withColumn("out", pii.redact(F.col("text"), F.col("s"))).collect()}
    assert [(s["kind"], s["start"], s["end"]) for s in got[1]["s"] if s["kind"] in pii.BASE_KINDS] == plain_pii(text)
    for i, t in rows:
        out, at = "", 0
        for s in sorted(got[i]["s"], key=lambda s: (s["start"], s["end"], s["kind"])):
            around = t[max(0, s["start"] - 40) : s["end"] + 40].lower().replace(t[s["start"] : s["end"]].lower(), " ")
            near = pii.NEARBY_ADDS[s["kind"]] if re.search(pii.NEARBY[s["kind"]], around) else 0
            assert s["score"] == pytest.approx(pii.SCORES[s["kind"]] + near)
            if s["start"] >= at:
                out += t[at : s["start"]] + f"[{s['kind'].upper()}]"
            at = max(at, s["end"])
        assert got[i]["out"] == out + t[at:]
    took = []
    for n in (8000, 32_000):
        many = frame(spark, [(1, "mail me at a@b.org now " * n)]).select(F.col("text"), pii.find_spans(F.col("text")).alias("s")).cache()
        began = time.perf_counter()
        (row,) = many.select(F.size("s"), F.length(pii.redact(F.col("text"), F.col("s")))).collect()
        took.append(time.perf_counter() - began)
        assert tuple(row) == (n, 23 * n)
        many.unpersist()
    assert took[1] < 8 * took[0] + 2


# ---- 4: page text

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><p>Site head</p></header><nav><ul><li><a href="/">Home</a></li><li>More</li></ul></nav><!-- note --><div class="ad">Buy this long advert text now
 and never regret it, friends.</div><div id="cookie-notice">We use cookies of all kinds here.</div>
<article class="post"><h1>A &lt;title&gt; &amp; more</h1><p><b>First   paragraph<br>goes on</b> and <i>on</i>.<br><p>Second&nbsp;one.</p><p>Tiny.</p>
<aside>Also read this</aside><div class="share-buttons">Share</div><form><label>Name</label><input></form><ul><li>one<li>two</ul>
<section id="comments"><p>Great post, says a reader at great length indeed.</p></section></article>
<div class="sidebar"><p>Popular</p></div><footer>&copy; me &middot; A rather long footer text that says nothing at all.</footer>"""


def test_page_text():
    want = "A <title> & more\nFirst paragraph goes on and on.\nSecond one.\nTiny.\none\ntwo"
    assert html_text.main_text(PAGE) == want
    assert html_text.main_text(PAGE[: PAGE.index("<aside>")]) == "\n".join(want.split("\n")[:4])
    assert html_text.main_text("<p>" + "Only paragraphs here, no article. " * 5 + "</p><div class=menu>x</div>").startswith("Only paragraphs")
    for broken in ["", None, "<", "<!", "<![x", "<![foo[", "</", "<a", "plain & text", "<p" * 500, "<div>" * 3000 + "x", "&#xffffffff;", "<script>", "<![CDATA[x]]>"]:
        assert isinstance(html_text.main_text(broken), str)
    assert html_text.main_text("plain &amp; text") == "plain & text"
    assert html_text.main_text("<main><p>x</p></main>") == "x"
    nested = "<main><h2>News</h2><div class='siteHeader'>Top</div><article class='post comment-open'></article><article><div class='entry-header'><h1>T</h1></div><p>Body text.</p><article class='comment'>no</article></article><ins class='adsbygoogle'>Buy</ins></main>"
    assert html_text.main_text(nested) == "T\nBody text."


def page_of(rng, wrap):
    """A page and its text, block by block: titles, short and long paragraphs, lists, with boilerplate in and around the content."""
    say = lambda low, high: prose(rng, rng.randrange(low, high)).capitalize() + "."
    junk = lambda: rng.choice([
        f"<div class='{rng.choice(['ad', 'share-buttons', 'cookieNotice', 'related-posts'])}'><p>{say(3, 60)}</p></div>", f"<aside><p>{say(5, 40)}</p></aside>",
        f"<form><label>{say(1, 3)}</label><input><button>Go</button></form>", f"<script>var a = '{say(3, 9)}';</script>", "<!-- <p>gone</p> -->",
    ])
    want, body = [say(3, 9)], ""
    body += f"<h1>{want[0]}</h1>"
    for _ in range(rng.randrange(4, 9)):
        kind = rng.randrange(5)
        if kind == 0:
            items = [say(1, 6) for _ in range(3)]
            body += "<ul>" + "".join(f"<li>{i}" for i in items) + "</ul>"
            want += items
        elif kind == 1:
            body += junk()
        else:
            text = say(*rng.choice([(1, 4), (30, 60), (60, 120)]))
            one, two = text.split(" ", 1) if " " in text else (text, "")
            body += f"<p><b>{one}</b>\n {two}" + rng.choice(["</p>", ""])
            want.append(f"{one} {two}".strip())
    long = say(60, 90)
    body += f"<p>{long}</p>"
    want.append(long)
    links = "".join(f"<li><a href='/{i}'>{say(1, 3)}</a></li>" for i in range(6))
    stray = f"<div><a href='/in'>{say(1, 2)}</a> | <a href='/up'>{say(1, 2)}</a></div>"
    around = [f"<nav><ul>{links}</ul></nav>", stray, junk(), f"<footer><p>{say(4, 30)}</p></footer>"]
    rng.shuffle(around)
    cut = rng.randrange(4)
    comments = f"<section id='comments'><p>{say(40, 80)}</p></section>"
    page = "<html><head><title>x</title></head><body>" + "".join(around[:cut]) + wrap.format(body + comments) + "".join(around[cut:]) + "</body></html>"
    return page, "\n".join(want)


WRAPS = ["<article>{}</article>", "<main><article>{}</article></main>", "<div>{}</div>", "<div class=page><div class=post>{}</div></div>", "<main>{}</main>", "<table><tr><td>{}</td></tr></table>"]


@pytest.mark.parametrize("wrap", WRAPS)
def test_content_regions(wrap):
    rng = random.Random(71)
    wrong = [(p, t) for p, t in (page_of(rng, wrap) for _ in range(100)) if html_text.main_text(p) != t]
    assert not wrong, wrong[0]


def test_the_ratios_decide(monkeypatch):
    rng = random.Random(72)
    pages = [page_of(rng, rng.choice(WRAPS[2:4]))[0] for _ in range(50)]
    before = [html_text.main_text(p) for p in pages]
    monkeypatch.setattr(html_text, "smooth", lambda values: [0.0] * len(values))
    assert sum(html_text.main_text(p) != t for p, t in zip(pages, before, strict=True)) > 40


def test_smoothing_and_clusters():
    values = [0.0, 10.0, 0.0, 3.0, 90.0, 80.0, 1.0]
    kernel = {d: np.exp(-d * d / 2) for d in range(-2, 3)}
    near = lambda i: [j for j in range(len(values)) if abs(i - j) <= 2]
    want = [sum(kernel[j - i] * values[j] for j in near(i)) / sum(kernel[j - i] for j in near(i)) for i in range(len(values))]
    assert np.allclose(html_text.smooth(values), want)
    assert html_text.threshold([1, 2, 3, 50, 60]) == pytest.approx((2 + 55) / 2) and html_text.threshold([4, 4]) == 4


def test_damaged_pages_take_linear_time():
    began = time.perf_counter()
    for page in ("<div>" * 40_000 + "</p>" * 40_000 + "x", "<u><div>" + "<i>" * 40_000 + "</u>" * 40_000 + "x", "<div>x" * 30_000, "<p>" * 40_000, "<h1>a" * 20_000 + "<div><p>" + "word " * 300):
        html_text.main_text(page)
    assert time.perf_counter() - began < 10


def test_extract_keeps_every_page(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<p>" + "a b " * 100_000 + "</p>")]
    pages = spark.createDataFrame([(*r, "t", 5) for r in rows], "page_id bigint, url string, html string, text string, n_chars int")
    got = html_text.extract(pages).collect()
    assert len(got) == 5 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert max(r["n_chars"] for r in got) == 399_999
    assert html_text.extract(pages.where("false")).count() == 0


# ---- 5: url filters


def plain_rule(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (len(r.name), r.verdict == "block", r.name), default=None)


def test_url_rules(spark):
    rng = random.Random(6)
    labels, parts = ["com", "net", "example", "www", "a", "org", ""], ["/", "/en", "/en/", "/es/", "/fr/x", "", "/e", "//", "/en/a/b"]
    rules = [*URL_RULES, url_filter.Rule("block", "a.com", "/e"), url_filter.Rule("allow", "a.com", "/en/a"), url_filter.Rule("block", "org", "/"), url_filter.Rule("allow", "org", "/")]
    urls = [rng.choice(["http://", "HTTPS://", "://", "x"]) + ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 4))).upper()[: rng.randrange(30)]
            + rng.choice(parts) + rng.choice(["", "?a=/en/", "#top", "/en/"]) for _ in range(400)]
    urls += [None, "", "http://", "http://com", "http://com/", "a://b://c/d", "http://example.com\n/en/x"]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id bigint, url string, host string, path string")
    for chars in (url_filter.BROADCAST_CHARS, 0):
        for r in url_filter.judge(pages, rules, "allow", broadcast_chars=chars).collect():
            rest = (urls[r["page_id"]] or "").partition("://")[2]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            best = plain_rule(host.translate(UPPER), path, rules)
            assert (r["host"], r["path"]) == (host.translate(UPPER), path)
            assert (r["rule"], r["verdict"]) == ((best.name, best.verdict) if best else (None, "allow")), urls[r["page_id"]]
    assert url_filter.judge(pages.where("false"), rules).count() == 0


def test_url_verdict_at_any_size(spark):
    """Rules of equal lengths on different hosts, as a list and as a table, by the trie and by the join."""
    rng = random.Random(61)
    labels, chars = ["com", "net", "x", "ab", "a"], "ab/"
    pick = lambda: ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 4)))
    rules = [url_filter.Rule(rng.choice(["allow", "block"]), pick(), "/" + "".join(rng.choice(chars) for _ in range(rng.randrange(6)))) for _ in range(150)]
    rules += [url_filter.Rule("allow", "com", "/abcd"), url_filter.Rule("block", "x.com", "/ab")]
    urls = ["http://x.com/abcdef"] + [f"http://{pick()}/" + "".join(rng.choice(chars) for _ in range(rng.randrange(9))) for _ in range(500)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    table = spark.createDataFrame([tuple(r) for r in rules] + [("block", None, "/"), (None, "com", "/")], "verdict string, host string, path string")
    want = []
    for i, u in enumerate(urls):
        host, _, path = u[7:].partition("/")
        best = plain_rule(host, "/" + path, rules)
        want.append((i, best and best.name, best.verdict if best else "allow"))
    assert want[0][1:] == ("x.com/ab", "block")
    for given, most in ((rules, 10**6), (rules, 0), (table, 10**6), (table, 0)):
        got = url_filter.judge(pages, given, broadcast_chars=most).select("page_id", "rule", "verdict").collect()
        assert sorted(map(tuple, got)) == want


def test_very_many_rules_of_one_host():
    trie = url_filter.RuleTrie([url_filter.Rule("block", "example.com", f"/page{i}") for i in range(100_000)])
    began = time.perf_counter()
    assert all(trie.find("www.example.com", f"/page{i}x").path == f"/page{i}" for i in range(0, 100_000, 10))
    assert time.perf_counter() - began < 2  # 10,000 urls


# ---- 6: licenses


def test_license_base_places(spark, odd_rows):
    rng = random.Random(7)
    few = ["cc", "by", "CC BY", "general public license", "All Rights Reserved", "rights", "x", "GENERAL", "public", "-"]
    rows = [(i, " ".join(rng.choice(few) for _ in range(rng.randrange(40)))) for i in range(150)] + [r[:2] for r in odd_rows]
    got = license_scan.scan(frame(spark, rows)).collect()
    want = []
    for i, t in rows:
        w = words(t)
        places = [(label, p) for label, text, base in license_scan.BASE for p in range(len(w)) if tuple(w[p : p + len(text.split())]) == tuple(text.split())]
        want.append((i, len(w), sorted(places)))
    assert sorted(((r["doc_id"], r["n_words"], sorted((s["label"], s["start"]) for s in r["spans"] if s["base"])) for r in got), key=str) == sorted(want, key=str)
    assert license_scan.scan(frame(spark, [])).count() == 0


def test_license_notices_survive_small_changes(spark):
    mit = license_scan.NOTICES[4].text
    changed = mit.replace("free of charge", "free of any charge").replace("obtaining a copy", "getting a copy")
    half = " ".join(mit.split()[:8])
    rows = [(1, "xx " + mit + " yy"), (2, changed), (3, half), (4, "Released under the MIT License."), (5, mit + " and again " + mit)]
    got = {r["doc_id"]: [(s["label"], s["start"]) for s in r["spans"]] for r in license_scan.scan(frame(spark, rows)).collect()}
    assert got[1] == [("mit", 1)] and got[2] == [("mit", 0)] and got[3] == [] and got[4] == [("mit", 0)] and len(got[5]) == 2


def test_no_verified_span_is_without_a_trigger():
    triggers = set(license_scan.trigger_words(license_scan.BASE + license_scan.NOTICES))
    for t in license_scan.BASE + license_scan.NOTICES:
        ws = t.text.split()
        k = min(3, len(ws))
        without = sum(not triggers & set(ws[i : i + k]) for i in range(len(ws) - k + 1))
        assert without < (1 if t.base else license_scan.COVERAGE) * (len(ws) - k + 1)


def test_whole_license_texts(spark):
    """Each template as a file carries it, with other words around and a tenth of its words changed."""
    rng = random.Random(27)
    rows = []
    for i, t in enumerate(license_scan.NOTICES):
        ws = t.text.split()
        for at in rng.sample(range(len(ws)), len(ws) // 12):
            ws[at] = "other"
        rows.append((i, prose(rng, 30) + " " + " ".join(ws).capitalize() + ". " + prose(rng, 30)))
    got = {r["doc_id"]: {s["label"] for s in r["spans"]} for r in license_scan.scan(frame(spark, rows)).collect()}
    assert all(t.label in got[i] for i, t in enumerate(license_scan.NOTICES))
    assert not any(label in got[i] for i, t in enumerate(license_scan.NOTICES) for label in {"zlib", "isc", "bsd"} - {t.label})


# ---- 7: fingerprints


WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def plain_canonical(text):
    folded = unicodedata.normalize("NFC", text or "").casefold()
    return re.sub(f"[{WHITE}]+", " ", folded).strip(" ")


def plain_digest(text):
    data = plain_canonical(text).encode()
    wide = xxhash.xxh64_intdigest(b"wide", 42)
    return f"{xxhash.xxh64_intdigest(data, 42):016x}{xxhash.xxh64_intdigest(data, wide):016x}"


def test_normal_form_c(spark):
    rng = random.Random(8)
    pick = lambda: chr(rng.choice([rng.randrange(0x20, 0x250), rng.randrange(0x300, 0x370), rng.randrange(0x1100, 0x1200), rng.randrange(0xAC00, 0xAC00 + 11172), rng.randrange(0x900, 0xE00), rng.randrange(0x1E00, 0x2000), 0xF73, 0x1D15E, 0xFB1D]))
    rows = [("".join(pick() for _ in range(25)),) for _ in range(200)] + [("e" + "\u0301\u0323" * 400,), ("plain",), ("",)]
    got = spark.createDataFrame(rows, "text string").select("text", fingerprint.nfc(F.col("text")).alias("n")).collect()
    assert all(r["n"] == unicodedata.normalize("NFC", r["text"]) for r in got)


def test_case_folding(spark):
    """Every character that Python's Unicode data folds, and words whose forms differ in case only."""
    points = [p for p in range(0x20, 0x20000) if not 0xD800 <= p < 0xE000 and chr(p).casefold() != chr(p)]
    rows = [("".join(f"a{chr(p)}b " for p in points[i : i + 40]),) for i in range(0, len(points), 40)]
    rows += [("ſa",), ("ﬁx",), ("ŉ",), ("Maße ΣΊΣΥΦΟΣ İstanbul ǰ ᾳ",)]
    got = spark.createDataFrame(rows, "text string").select("text", fingerprint.folded(F.col("text")).alias("f")).collect()
    newer = [(a, b) for r in got for a, b in zip(r["text"].split(), r["f"].split(), strict=True) if b != a.casefold()]
    assert len(newer) <= 5, newer  # letters that only one side's Unicode data has
    alike = spark.createDataFrame([("ſa ﬁx ŉ",), ("SA FIX ʼN",)], "text string").select(fingerprint.digest(fingerprint.canonical(F.col("text")))).collect()
    assert alike[0] == alike[1]


@pytest.mark.parametrize("range_chars", [fingerprint.RANGE_CHARS, 50])
def test_next_row_and_digests(spark, odd_rows, range_chars):
    rng = random.Random(9)
    rows = [(i * 3 - 50, prose(rng, rng.randrange(30)) if i % 7 else None) for i in range(60)] + [(500, "Stra\u00dfe  E\u0301"), (501, "strasse é")]
    docs = frame(spark, rows)
    got = {r["doc_id"]: r for r in fingerprint.with_next(docs, range_chars=range_chars).collect()}
    ordered = sorted(rows)
    for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        assert got[i]["fingerprint"] == plain_digest(text) and got[i]["next_text"] == (after or "") and got[i]["next_fingerprint"] == plain_digest(after)
    assert got[500]["fingerprint"] == got[501]["fingerprint"]
    odd = fingerprint.with_next(frame(spark, [r[:2] for r in odd_rows]), range_chars=range_chars).collect()
    assert len(odd) == len(odd_rows) and all(r["next_fingerprint"] == plain_digest(r["next_text"]) for r in odd)
    assert fingerprint.with_next(frame(spark, [])).count() == 0
    alone = fingerprint.with_next(frame(spark, [(1, "a")])).collect()
    assert [(r["text"], r["next_text"]) for r in alone] == [("a", "a")]


def test_next_row_of_very_many_rows_of_one_id(spark):
    """Half the rows have one id, others none; they are dealt into several ranges and still follow each other in one ring."""
    rng = random.Random(19)
    rows = [(7 if i % 2 else None if i % 4 else i, f"text {i} " + prose(rng, 5)) for i in range(400)]
    docs = frame(spark, rows)
    buckets = docs.select(fingerprint._ranges(docs, "doc_id", "text", 200).alias("b"), "doc_id").groupBy("doc_id").agg(F.countDistinct("b").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in buckets}[7] > 5 and {r["doc_id"]: r["n"] for r in buckets}[None] > 5
    got = {r["text"]: r for r in fingerprint.with_next(docs, range_chars=200).collect()}
    assert len(got) == 400
    ring, at = [], rows[0][1]
    for _ in range(400):
        ring.append(got[at]["doc_id"])
        at = got[at]["next_text"]
    assert at == rows[0][1] and ring == sorted(ring, key=lambda i: (i is None, i or 0))


def test_exact_groups(spark, odd_rows):
    rows = [r[:2] for r in odd_rows]
    got = fingerprint.exact_groups(frame(spark, rows)).collect()
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(plain_canonical(t), []).append(i)
    want = [(i, min((x for x in groups[plain_canonical(t)] if x is not None), default=None), len(groups[plain_canonical(t)])) for i, t in rows]
    assert sorted(((r["doc_id"], r["group_id"], r["group_size"]) for r in got), key=str) == sorted(want, key=str)


def test_digests_that_collide(spark, monkeypatch):
    """With a digest of four values, buckets hold different texts and are split by comparing them."""
    monkeypatch.setattr(fingerprint, "digest", lambda canon: (F.length(canon) % 4).cast("string"))
    rows = [(i, f"text  number {i % 9}".upper() if i % 2 else f"Text number {i % 9}") for i in range(60)] + [(None, None), (99, " "), (70, "a"), (71, "bbbbb")]
    got = fingerprint.exact_groups(frame(spark, rows)).collect()
    want = []
    for i, t in rows:
        group = [j for j, u in rows if plain_canonical(u) == plain_canonical(t)]
        want.append((i, min((j for j in group if j is not None), default=None), len(group)))
    assert sorted(((r["doc_id"], r["group_id"], r["group_size"]) for r in got), key=str) == sorted(want, key=str)


def test_fingerprint_query(spark, odd_rows, tmp_path):
    """All columns, against the definition over rows in order; rows of one id in any order."""
    rng = random.Random(29)
    rows = [r[:2] for r in odd_rows] + [(100 + i, prose(rng, rng.randrange(60))) for i in range(40)] + [(200 + i, "Same  Text É" if i % 2 else "same text e\u0301") for i in range(6)]
    rows += [(300, "ab\u00df"), (301, "x"), (302, "abcd"), (303, "D" + prose(rng, 9))]
    rows = [r for i, r in enumerate(rows) if r[0] is not None or i == 0]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, QUERIES["op7_fingerprint"](spark, str(tmp_path)).collect()), key=str)
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    want = []
    for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        text, after = text or "", after or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        group = [j for j, u in rows if plain_canonical(u) == plain_canonical(text)]
        alike = lambda other: float(plain_canonical(text) == plain_canonical(other))  # noqa: B023, E731
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), plain_digest(text), plain_digest(edited), alike(edited), alike(after),
                     min((j for j in group if j is not None), default=None), len(group)))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "group_id", "group_size"]
    assert QUERIES["op7_fingerprint"](spark, str(tmp_path)).columns[:7] == names[:7]
    assert sorted(want, key=str) == sorted(((*g[:7], *g[7:]) for g in got), key=str)
    assert sum(w[6] for w in want) >= 5 and sum(w[5] for w in want) >= 1


# ---- 8: repeated passages


@pytest.mark.parametrize("frequent", [suffix_dedup.FREQUENT, 1])
def test_repeated_passages(spark, odd_rows, monkeypatch, frequent):
    monkeypatch.setattr(suffix_dedup, "FREQUENT", frequent)
    rng = random.Random(10)
    many = vocabulary(4000, 11)
    text = lambda n: prose(rng, n, many)
    shared = [text(n) for n in (49, 50, 51, 60, 75, 130, 400)]
    rows = [(i, text(rng.randrange(200))) for i in range(20)]
    for n, passage in enumerate(shared):
        rows += [(100 + 10 * n + k, text(rng.randrange(60)) + " " + passage + " " + text(rng.randrange(60))) for k in range(rng.randrange(2, 5))]
    rows += [(300, text(500)), (301, text(30) + " " + text(300))] + [r[:2] for r in odd_rows]
    got = suffix_dedup.repeats(frame(spark, rows)).collect()
    tokens = [(i, t, suffix_dedup.words_of(t)) for i, t in rows]
    owners: dict = {}
    for i, t, w in tokens:
        for p in range(len(w) - 49):
            owners.setdefault(tuple(w[p : p + 50]), set()).add((i, t))
    want = []
    for i, t, w in tokens:
        hit = sorted({q for p in range(len(w) - 49) if len(owners[tuple(w[p : p + 50])]) > 1 for q in range(p, p + 50)})
        spans: list = []
        for q in hit:
            if spans and spans[-1][1] == q:
                spans[-1][1] = q + 1
            else:
                spans.append([q, q + 1])
        want.append((i, len(w), spans))
    assert sorted(((r["doc_id"], r["n_words"], [[p["start"], p["end"]] for p in r["passages"]]) for r in got), key=str) == sorted(want, key=str)
    assert suffix_dedup.repeats(frame(spark, [])).count() == 0


def plain_passages(rows):
    tokens = [(i, t, suffix_dedup.words_of(t)) for i, t in rows]
    owners: dict = {}
    for i, t, w in tokens:
        for p in range(len(w) - 49):
            owners.setdefault(tuple(w[p : p + 50]), set()).add((i, t))
    out = []
    for i, t, w in tokens:
        hit = sorted({q for p in range(len(w) - 49) if len(owners[tuple(w[p : p + 50])]) > 1 for q in range(p, p + 50)})
        spans: list = []
        for q in hit:
            if spans and spans[-1][1] == q:
                spans[-1][1] = q + 1
            else:
                spans.append([q, q + 1])
        out.append((i, len(w), spans))
    return sorted(out, key=str)


def found_passages(spark, rows):
    got = suffix_dedup.repeats(frame(spark, rows)).collect()
    return sorted(((r["doc_id"], r["n_words"], [[p["start"], p["end"]] for p in r["passages"]]) for r in got), key=str)


@pytest.mark.parametrize("frequent", [suffix_dedup.FREQUENT, 1])
def test_passages_around_a_common_line(spark, monkeypatch, frequent):
    """Two documents share their own words and a line that stands in many others; also words that repeat on and on."""
    monkeypatch.setattr(suffix_dedup, "FREQUENT", frequent)
    rng = random.Random(31)
    many = vocabulary(4000, 32)
    text = lambda n: prose(rng, n, many)
    texts = []
    for k in range(16):
        line, own = text(35), text(rng.randrange(15, 21))
        texts += [" ".join([text(60), line, text(100)]) for _ in range(20)]
        pair = [line, own] if k % 4 == 3 else [own, line]
        texts += [" ".join([text(60), *pair, text(100)]) for _ in range(2)]
    texts += [" ".join([text(30), "on " * n, text(40)]) for n in (57, 58, 75, 90, 120)]
    period = text(3)
    texts += [" ".join([text(45), *[period] * n, text(45)]) for n in (17, 18, 25, 40)]
    rows = list(enumerate(texts))
    assert found_passages(spark, rows) == plain_passages(rows)


def test_neighbours_past_rows_of_the_same_document():
    common, none = [f"w{i}" for i in range(60)], ""
    row = lambda low, high, k: (1, low, high, " ".join([*common, f"x{k}", "y"]), none)
    rows = [row(4, 4, k) for k in range(10, 20)] + [row(5, 5, 20)]
    assert suffix_dedup.compare(rows) == [(0, 60)] * 11
    assert suffix_dedup.compare(rows[:10]) == [(0, 0)] * 10
    assert suffix_dedup.compare([row(4, 4, 1), row(4, 5, 2)]) == [(0, 60)] * 2


def test_passages_repeated_inside_a_document(spark):
    """Occurrences in one document, each with other words around, of a passage that another holds once, or with the same words."""
    rng = random.Random(33)
    many = vocabulary(4000, 34)
    text = lambda n: prose(rng, n, many)
    rows = []
    for k in range(10):
        passage = text(60)
        rows.append((10 * k, " ".join(passage + " " + text(100) for _ in range(10))))
        rows.append((10 * k + 1, text(100) + " " + passage + " " + text(100)))
        wide = text(100) + " " + (other := text(60)) + " " + text(100)
        rows += [(10 * k + 2, wide + " " + text(50) + " " + other + " " + text(100)), (10 * k + 3, wide + " " + text(20))]
    assert found_passages(spark, rows) == plain_passages(rows)


# ---- 9: mixing


def plain_targets(sizes, weights, share, most):
    """Clamp, reshare, repeat."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, target, free = share * sum(sizes.values()), {}, set(order)
    while free:
        level = max(0.0, budget - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > most * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in free}
        target |= {s: most * sizes[s] for s in over}
        free -= over
    return target


def test_mixing_meets_targets(spark, odd_rows):
    rng = random.Random(12)
    sources = ["a", "B", "é", None, "c", "d", "", "zz"]
    rows = [(i, prose(rng, rng.randrange(1, 200)), rng.choice(sources[: 3 + i % 6])) for i in range(400)] + list(odd_rows)
    docs = frame(spark, rows)
    got = mixing.mix(docs, into="mixed").select("doc_id", "source", "text", "mixed.*").collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = plain_targets(sizes, (5, 2, 1), 1.5, 2.0)
    assert len(got) == len(rows)
    taken: dict = {}
    for r in got:
        assert r["size"] == size(r["text"]) and r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["repeats"] * r["size"] + r["part"] and 0 <= r["part_start"] <= r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 3 + 0.02 * t
    again = mixing.mix(docs.repartition(7), into="mixed").select("doc_id", "mixed.taken").collect()
    assert sorted(map(tuple, again), key=str) == sorted(((r["doc_id"], r["taken"]) for r in got), key=str)
    assert mixing.mix(frame(spark, [])).count() == 0
    assert [r[0] for r in mixing.mix(frame(spark, [(1, None, None)])).select("mix.taken").collect()] == [0]


def test_mixed_texts(spark, odd_rows):
    """The rows that a mix stands for hold as many words as it takes, whole texts and runs that wrap round."""
    rng = random.Random(14)
    rows = [(1000 + i, prose(rng, rng.randrange(1, 60)), f"s{i % 3}") for i in range(100)] + [r for r in odd_rows if r[0] is not None and r[0] != 7]
    mixed = mixing.mix(frame(spark, rows)).cache()
    due = {r["doc_id"]: r for r in mixed.collect()}
    texts: dict = {}
    for r in mixing.mixed_texts(mixed).collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    for i, r in due.items():
        m, got = r["mix"], texts.get(i, [])
        ws = words(r["text"] or "")
        assert sum(len(words(t)) for t in got) == m["taken"] and len(got) == m["repeats"] + (m["part"] > 0)
        assert got.count(r["text"]) >= m["repeats"]
        if m["part"]:
            assert " ".join((ws + ws)[m["part_start"] : m["part_start"] + m["part"]]) in got
    assert mixing.mixed_texts(mixing.mix(frame(spark, []))).count() == 0
    mixed.unpersist()


def test_clashing_names_come_back_unchanged(spark):
    """Columns that have the names operators use on the way."""
    docs = frame(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, "g h i j k l m")])
    bench = spark.createDataFrame([(1, "h i j")], "item_id bigint, text string")
    for out in (
        simhash.deduplicate(docs), simhash.deduplicate(docs, by_likeness=True), mixing.mix(docs, into="mixed"), mixing.mixed_texts(mixing.mix(docs, into="mixed"), "mixed"),
        decontam.scan(docs, bench, into="d"), decontam.scan(docs, bench, into="d", block_chars=2), quality.score(docs, quality.train([], []), into="q"),
    ):
        assert set(docs.columns) <= set(out.columns) and out.count() >= 2
        assert all(r[c] == "x" for r in out.collect() for c in EXTRA)


def test_mixing_with_very_many_sources(spark, monkeypatch):
    rows = [(i, "a b c", f"s{i % 40}") for i in range(200)]
    want = sorted(map(tuple, mixing.mix(frame(spark, rows)).select("doc_id", "mix.taken").collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    assert sorted(map(tuple, mixing.mix(frame(spark, rows)).select("doc_id", "mix.taken").collect())) == want


# ---- 10: near-duplicates


def plain_simhash(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(UPPER)) if x]
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(codes):
    parent = {c: c for c in codes}

    def root(c):
        while parent[c] != c:
            c = parent[c]
        return c

    for a, b in combinations(sorted(parent), 2):
        if (a ^ b).bit_count() <= 3:
            parent[root(a)] = root(b)
    return {c: root(c) for c in parent}


@pytest.mark.parametrize("part", [simhash.PART, 4])
def test_links_join_what_pairs_join(spark, part):
    rng = random.Random(13)
    codes = {rng.getrandbits(64) for _ in range(150)}
    for _ in range(12):
        seed = rng.getrandbits(64)
        for _ in range(30):
            seed ^= sum(1 << rng.randrange(64) for _ in range(rng.randrange(1, 4)))
            codes.add(seed % 2**64)
    signed = [(c - 2**64 if c >= 2**63 else c,) for c in codes]
    for blocks in (4, 6):
        edges = simhash.link(spark.createDataFrame(signed, "fp bigint"), blocks, part)
        roots = {r["node"] % 2**64: r["root"] % 2**64 for r in simhash.components(edges).collect()}
        want = plain_components(codes)
        groups = lambda of: sorted(sorted(c for c in codes if of(c) == g) for g in {of(c) for c in codes})
        assert groups(lambda c: roots.get(c, c)) == groups(want.get)


def test_a_hot_node_is_cut_by_further_bits(spark):
    """Thousands of codes that share 16 bits: each is dealt out a bounded number of times, and no link is lost."""
    rng = random.Random(17)
    base = rng.getrandbits(16) << 48
    codes = {base | rng.getrandbits(48) for _ in range(3000)}
    for c in list(codes)[:300]:
        codes.add(c ^ 1 << rng.randrange(48) ^ 1 << rng.randrange(48))
    frame_ = spark.createDataFrame([(c - 2**64 if c >= 2**63 else c,) for c in codes], "fp bigint")
    edges = simhash.link(frame_, 4, part=64)
    linked = sorted((max(a, b), min(a, b)) for a, b in combinations(sorted(codes), 2) if (a ^ b).bit_count() <= 3)
    roots = {r["node"] % 2**64: r["root"] % 2**64 for r in simhash.components(edges).collect()}
    assert len(linked) >= 200 and all(roots.get(a, a) == roots.get(b, b) for a, b in linked)
    assert {*roots, *roots.values()} == {c for pair in linked for c in pair}
    for mask in simhash.top_masks(4):
        for finer in simhash.finer_masks(mask):
            assert mask & finer == mask and (finer % 2**64).bit_count() > (mask % 2**64).bit_count()


def test_gray_index_finds_all_pairs():
    rng = np.random.default_rng(14)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    codes = np.unique(np.concatenate([base ^ (np.uint64(1) << np.uint64(s)) for s in range(0, 60, 3)] + [base]))
    index = simhash.GrayIndex(codes)
    got = {(int(codes[a]), int(index.codes[b])) for q, at in index.search(codes, 3) for a, b in zip(q, at, strict=True)}
    want = {(int(a), int(b)) for a in codes for b in codes if (int(a) ^ int(b)).bit_count() <= 3}
    assert got == want


def test_near_duplicates(spark, odd_rows):
    rng = random.Random(15)
    rows = [(i, prose(rng, rng.randrange(3, 300))) for i in range(40)]
    for i in range(10):
        w = rows[i][1].split() * 3
        w[5 % len(w)] = "changed"
        rows += [(100 + i, " ".join(rows[i][1].split() * 3)), (200 + i, " ".join(w)), (300 - i, rows[i][1].upper().replace(" ", "  "))]
    rows += [r[:2] for r in odd_rows]
    docs = frame(spark, rows)
    got = simhash.near_duplicates(docs).withColumn("hex", simhash.as_hex(F.col("fp"))).collect()
    prints = [(i, plain_simhash(t)) for i, t in rows]
    root = plain_components({p for _, p in prints})
    least: dict = {}
    for i, p in prints:
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    assert sorted(((r["doc_id"], r["hex"], r["component_id"]) for r in got), key=str) == sorted(((i, f"{p:016x}", least.get(root[p])) for i, p in prints), key=str)
    kept = simhash.deduplicate(docs).collect()
    assert len(kept) == len({root[p] for _, p in prints})
    assert ids([(r["doc_id"],) for r in kept]) == sorted((least.get(g) for g in {root[p] for _, p in prints}), key=str)
    assert set(kept[0].asDict()) == set(docs.columns)
    assert simhash.near_duplicates(frame(spark, [])).count() == 0 and simhash.deduplicate(frame(spark, [])).count() == 0


def test_lone_null_ids_stay(spark):
    kept = simhash.deduplicate(frame(spark, [(None, "a b c d"), (None, "a b c d"), (None, "quite other words stand here in this")])).collect()
    assert len(kept) == 2
