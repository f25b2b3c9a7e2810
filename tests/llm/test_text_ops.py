"""The text operators against brute force, with nulls, empties, ties, repeats and extra columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import chat, decontaminate, fim, fingerprint, html, jaccard, linededup, mixing, pii, toxicity, warc
from corvane.llm.graph import components
from corvane.llm.words import letter_words, words_of

VOCAB = [f"w{i}" for i in range(400)]


LETTERS = ["".join(random.Random(i).choices("abcdefgh", k=6)) for i in range(400)]


def words(rng, n):
    return [rng.choice(VOCAB) for _ in range(n)]


def frame(spark, texts, **extra):
    """Documents with the usual columns and some with clashing names."""
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), 1, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_shingles int, component_id string")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    texts = []
    for _ in range(30):
        texts.append(" ".join(words(rng, rng.choice([1, 2, 3, 4, 5, 6, 9, 14, 40, 120]))))
    for base in (words(rng, 12), words(rng, 30), words(rng, 200)):
        for _ in range(8):
            near = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                near[rng.randrange(len(near))] = rng.choice(VOCAB)
            texts.append("  ".join(near).upper())
    texts += ["", None, " \n ", "one", "One", "a b", "A\tb", texts[3], texts[40]]
    # a family around sets of 7 to 14 shingles, where subsets are enumerated
    base = words(rng, 13)
    texts += [" ".join(base[:n]) for n in range(9, 14)]
    rng.shuffle(texts)
    return texts


def plain_components(texts, width, num, den):
    sets = []
    for t in texts:
        w = re.findall(r"[^ \t-\r]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    low = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j in range(i):
                b = sets[j]
                if a and b and den * len(a & b) >= num * len(a | b) and low[i] != low[j]:
                    low[i] = low[j] = min(low[i], low[j])
                    changed = True
    return [(i, len(s), low[i]) for i, s in enumerate(sets)]


@pytest.mark.parametrize("rule", [jaccard.Rule(), jaccard.Rule(5, 80, 100), jaccard.Rule(2, 60, 100)])
def test_jaccard(spark, corpus, rule):
    got = sorted(tuple(r) for r in jaccard.linked(frame(spark, corpus), rule).collect())
    assert got == plain_components(corpus, rule.width, rule.num, rule.den)


def test_jaccard_many_near_copies(spark):
    """A large family, all of it connected, in few pairs; and null and repeated ids."""
    rng = random.Random(1)
    base = words(rng, 60)
    texts = [" ".join([*base[:-1], f"end{i}"]) for i in range(150)] + [" ".join(words(rng, 50)) for _ in range(5)]
    assert sorted(tuple(r) for r in jaccard.linked(frame(spark, texts)).collect()) == plain_components(texts, 4, 85, 100)
    odd = spark.createDataFrame([(None, texts[0]), (7, texts[0]), (7, texts[0]), (3, texts[1])], "doc_id long, text string")
    assert sorted(map(str, jaccard.linked(odd).collect())) == sorted(["Row(doc_id=None, n_shingles=57, component_id=None)", *["Row(doc_id=7, n_shingles=57, component_id=3)"] * 2, "Row(doc_id=3, n_shingles=57, component_id=3)"])
    assert jaccard.linked(frame(spark, ["a"]).limit(0)).count() == 0


def test_one_of_each_keeps_columns(spark, corpus):
    docs = frame(spark, corpus)
    out = jaccard.one_of_each(docs)
    want = {i for i, _, c in plain_components(corpus, 4, 85, 100) if i == c}
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == want


def test_boundary_by_cost():
    rule = jaccard.Rule()
    assert rule.subsets(6) == 1 and rule.subsets(7) == 8 and rule.prefix(6) == 3 and rule.prefix(140) == 28
    assert jaccard.boundary_by_cost({}, rule) == 0
    assert 5 <= jaccard.boundary_by_cost({n: 100 for n in range(1, 25)}, rule) < 14
    assert jaccard.boundary_by_cost({24: 1000}, rule) < 24


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (5, 5)], "u long, v long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}
    assert components(edges.limit(0)).count() == 0


def test_words():
    texts = ["Ab\x1cc d  é", None, "", "\n\n", "x y", "ab"]
    w = words_of(texts, lower=True)
    got = [[w.data[a:b].decode() for a, b in zip(w.starts[i:j], w.ends[i:j])] for i, j in zip(w.first, w.first[1:])]
    assert got == [["ab\x1cc d", "é"], [], [], [], ["x", "y"], ["ab"]]
    assert letter_words("Él-Ab_c9 ") == ["Él".encode(), b"ab", "c9 ".encode()]
    long = " ".join(random.Random(2).choices(VOCAB, k=1_200_000))
    many = words_of([long])
    assert len(many.hashes) == 1_200_000 and len(set(many.hashes.tolist())) == 400


def plain_hits(text, items, window):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    doc, hit, found = fold(text), set(), set()
    for i, item in items:
        w = fold(item)
        k = min(window, len(w))
        for p in {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if w else ():
            for a in range(len(doc) - k + 1):
                if tuple(doc[a : a + k]) == p:
                    hit |= set(range(a, a + k))
                    found.add("" if i is None else str(i))
    return len(doc), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_decontaminate(spark):
    rng = random.Random(3)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate((3, 5, 8, 12, 1))] + [(10, None), (11, " - "), (2, "zz yy xx ww vv uu"), (None, "qq rr ss tt")]
    texts = [None, "", "zz yy xx ww vv", "QQ, rr-ss!tt"] + [" ".join([*words(rng, 9), (items[rng.randrange(4)][1]).upper(), *words(rng, 5)]) for _ in range(20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {i: plain_hits(t, items, 5) for i, t in enumerate(texts)}
    docs = frame(spark, texts)
    report = decontaminate.report(docs, bench, 5).collect()
    assert {r[0]: tuple(r[1:6]) for r in report} == want
    for r in report:
        pieces = [texts[r.doc_id][int(a) : int(b)] for a, b in (x.split(":") for x in r.spans.split(",") if x)]
        assert sum(plain_hits(x, [], 5)[0] for x in pieces) == r.n_hit
    blocks = {r.doc_id: (r.n_words, r.n_hit, len(r.item_ids)) for r in decontaminate.scan(docs, bench, 5, block_words=12).collect()}
    assert blocks == {i: w[:3] for i, w in want.items()}
    kept = decontaminate.drop_contaminated(docs, bench, 5)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, w in want.items() if not w[4]}
    spans = {r.doc_id: [texts[3][s.start : s.end] for s in r.char_spans] for r in decontaminate.scan(docs, bench, 4).collect()}
    assert spans[3] == ["QQ, rr-ss!tt"]


def test_char_spans():
    text = "Ünë x, zwei-drei €5 " * 4000
    edges = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    spans = [[i, i + 3] for i in range(0, len(edges) - 3, 5)]
    assert decontaminate.char_spans(text, spans) == [(edges[a][0], edges[b - 1][1]) for a, b in spans]


def test_automaton_of_a_block_is_small():
    """The memory of an automaton over as many random words as a block has."""
    import subprocess
    import sys

    code = (
        "import random, resource; from corvane.llm.decontaminate import build_automaton\n"
        "rng = random.Random(1); use = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
        "items = [(i, ' '.join(f'w{rng.randrange(60000)}' for _ in range(100))) for i in range(2000)]\n"
        "before = use(); kept = build_automaton(items, 10); print((use() - before) // 1024)"
    )
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) < 250


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return {
        "email": [m.span() for m in EMAIL.finditer(t)],
        "ip": [m.span() for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        "phone": [m.span() for m in PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15],
    }


def test_pii_base():
    rng = random.Random(4)
    for _ in range(4000):
        t = "".join(rng.choice("ab1250.@@+- ()é") for _ in range(rng.randrange(40)))
        assert pii.base_spans(t) == plain_spans(t), t
    assert pii.base_spans("x 4111 1111-1111 1111 y")["card"] == [(2, 21)]
    assert pii.base_spans("9" * 200_000 + "@" * 3 + "." * 1000)["email"] == []
    assert pii.base_spans(None) == {k: [] for k in pii.KINDS}


def test_pii_terms(spark):
    some = lambda seed: " ".join(random.Random(seed).choices(LETTERS, k=25))
    fill = [f"{some(i)} user{i}@mail.example.com {some(1000 + i)}" for i in range(20)]
    told = [f"{some(100 + i)} boss Zorro likes x@y.org {some(200 + i)}" for i in range(3)]
    texts = [*fill, *told, told[0], None, "", "plain"]
    rows = {r.doc_id: r for r in pii.report(frame(spark, texts)).collect()}
    assert len(rows) == len(texts) and rows[24].spans == "" and rows[25].n_email == 0
    for i in (20, 21, 22, 23):
        t = texts[i]
        a = t.index("Zorro")
        assert f"term:{a}:{a + 5}" in rows[i].spans and rows[i].spans.startswith("email:")
    for i in range(20):
        want = ",".join(f"email:{a}:{b}" for a, b in plain_spans(texts[i])["email"])
        assert rows[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest() and rows[i].spans.startswith(want)
    masked = {r.doc_id: r.text for r in pii.sanitise(frame(spark, texts)).collect()}
    assert "[EMAIL]" in masked[20] and "Zorro" not in masked[20] and masked[24] is None and masked[26] == "plain"
    assert pii.report(frame(spark, ["a"]).limit(0)).count() == 0


def test_pii_terms_of_the_corpus(spark):
    """Against counts over whole texts: far words, entities of one text, terms that are common elsewhere."""
    rng = random.Random(3)
    fill = [" ".join(rng.choices(LETTERS, k=30)) for _ in range(60)]
    texts = [f"Zorro {fill[0]} me@a.org {fill[1]} Tango", f"{fill[2]} Samba you@b.org", f"{fill[3]} you@b.org Samba"]
    texts += [*[f"{x} samba" for x in fill[4:40]], *[f"{x} 10.0.0.{i % 3}" for i, x in enumerate(fill[40:])], None, "", "plain"]
    texts += [texts[0], texts[1], texts[5], texts[5]]
    held = {t: ({pii.entity_value(k, t[a:b]) for k, v in pii.base_spans(t).items() for a, b in v}, pii.words_outside(t, pii.base_spans(t))) for t in texts if t}
    n_t, n_e, both = Counter(), Counter(), Counter()
    for found, ws in held.values():
        ts = {w["term"] for w in ws}
        n_t.update(ts)
        n_e.update(found)
        both.update((e, t) for e in found for t in ts)
    n = len(held)
    told = {(e, t) for (e, t), k in both.items() if np.log2(k * n / (n_e[e] * n_t[t])) >= 0.8 * np.log2(n / n_e[e]) - 1e-9}
    rows = {r.doc_id: r.spans for r in pii.report(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        found, ws = held.get(t, (set(), []))
        want = {f"term:{w['start']}:{w['end']}" for w in ws if any((e, w["term"]) in told for e in found)}
        assert {x for x in rows[i].split(",") if x.startswith("term")} == want, t
    for i in (0, len(texts) - 4):
        assert "term:0:5" in rows[i] and f"term:{len(texts[0]) - 5}:{len(texts[0])}" in rows[i]
    assert f"term:{texts[1].index('Samba')}:" not in rows[1]


def test_html(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li>Menu</li></ul></nav>
    <div class="ad">Buy</div><article><h1>Head &amp; more</h1><p><b>One  two<br><p>Three &lt;x&gt;&nbsp;y<div class="comments"><p>First!</p></div><aside>side</aside><form>f</form><p>5 < 6</p></article>
    <footer>&copy; me</footer></body></html>"""
    assert html.extract(page) == "Head & more\nOne two\nThree <x> y\n5 < 6"
    bare = "<div>Home</div><div>News</div><hr><div></div>" + "<div id=menu>m</div>" * 4 + "".join(f"<p>{'long text ' * 12}{i}</p>" for i in range(5)) + "<div class=footer>x</div>" * 4 + "<p>tail</p>"
    got = html.extract(bare).split("\n")
    assert len(got) == 6 and got[0].endswith("0") and got[4].endswith("4") and got[5] == "tail"
    assert [html.extract(x) for x in (None, "", "<p></p>", "x", "<!-- a", "<script>a", "<p>a</p")] == ["", "", "", "x", "", "", "a"]
    assert html.extract("<nav>never closed<article><p>kept</p></article>") == "kept"
    df = spark.createDataFrame([(1, "u", page, "z"), (2, None, None, "z")], "page_id long, url string, html string, text string")
    assert {r.page_id: (r.url, r.n_chars) for r in html.report(df).collect()} == {1: ("u", len(html.extract(page))), 2: (None, 0)}


def plain_lines(page):
    """(text, characters outside of links, tag, number of the article or 0) by the parser of the library."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.stack, self.out, self.now, self.block, self.links, self.articles = [], [], ["", ""], "", 0, 0

        def flush(self):
            text, linked = (" ".join(x.split()) for x in self.now)
            if text:
                self.out.append((text, max(0, len(text) - len(linked)), self.block, self.articles if "article" in [t for t, _ in self.stack] else 0))
            self.now = ["", ""]

        def gone(self):
            return any(out for _, out in self.stack)

        def handle_starttag(self, tag, attrs):
            if tag not in ("a", "b"):
                if not self.gone():
                    self.flush()
                self.block = tag
            self.stack.append((tag, tag in ("nav", "aside", "form", "footer", "script") or dict(attrs).get("class") in ("ad", "comments", "site-footer")))
            if tag == "article":
                self.articles += 1

        def handle_endtag(self, tag):
            if tag not in ("a", "b"):
                if not self.gone():
                    self.flush()
                self.block = ""
            self.stack.pop()

        def handle_data(self, data):
            if not self.gone():
                self.now[0] += data
                self.now[1] += data if "a" in [t for t, _ in self.stack] else ""

    reader = Reader()
    reader.feed(page)
    reader.flush()
    return reader.out


def plain_extract(page):
    lines = plain_lines(page)
    limit = min(40, max([s for _, s, _, _ in lines], default=0) // 2)
    prose = {"p", "h1", "h2", "li", "td"}
    inside, outside = set(), set()
    for number in {x[3] for x in lines}:
        # lines of one article, or the runs of lines between articles
        runs, last = [], None
        for i, x in enumerate(lines):
            if x[3] == number:
                runs.append([i]) if last != i - 1 else runs[-1].append(i)
                last = i
        for run in runs:
            near = {i for at in range(len(run)) if (at + 3 <= len(run) or at == 0) and sum(lines[i][1] for i in run[at : at + 3]) > limit for i in run[at : at + 3]}
            if number and near:
                bars = []  # runs of links alone; one that a window doesn't reach goes
                for i in run:
                    if lines[i][2] in prose or lines[i][1]:
                        inside.add(i)
                    elif bars and bars[-1][-1] == i - 1:
                        bars[-1].append(i)
                    else:
                        bars.append([i])
                inside |= {i for bar in bars if near.issuperset(bar) for i in bar}
            elif near:
                kept = set()
                for i in near:
                    block = [i]
                    while block[0] - 1 in near:
                        block.insert(0, block[0] - 1)
                    while block[-1] + 1 in near:
                        block.append(block[-1] + 1)
                    strong = [j for j in block if lines[j][2] in prose and lines[j][1] or lines[j][1] > limit] or block
                    kept |= set(range(strong[0], strong[-1] + 1))
                gap = []
                for i in range(min(kept), max(kept) + 1):
                    if i in kept:
                        if all(lines[j][2] in prose and lines[j][1] for j in gap):
                            kept |= set(gap)
                        gap = []
                    else:
                        gap.append(i)
                outside |= kept
    load = lambda places: sum(lines[i][1] for i in places)
    chosen = inside if load(inside) >= load(outside) else inside | outside
    return "\n".join(lines[i][0] for i in sorted(chosen or range(len(lines))))


def test_html_windows():
    """Generated pages, half of them without an article, against windows over another parser's lines."""
    rng = random.Random(12)
    some = lambda n: " ".join(rng.choices(VOCAB, k=n))
    link = lambda: f'<a href="/x">{some(rng.randrange(1, 4))}</a>'
    makers = [
        lambda: f"<p>{some(rng.choice([1, 3, 12, 60]))}</p>",
        lambda: f"<p>{some(rng.choice([5, 40]))} {link()} <b>{some(2)}</b>.</p>",
        lambda: f"<h2>{some(3)}</h2>",
        lambda: f"<div>{some(rng.choice([1, 2, 4, 30]))}</div>",
        lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randrange(1, 6))) + "</ul>",
        lambda: "<ul>" + "".join(f"<li>{some(rng.randrange(1, 5))}</li>" for _ in range(rng.randrange(1, 6))) + "</ul>",
        lambda: f"<nav>{link()}<ul><li>{some(2)}</li></ul></nav>",
        lambda: f'<div class="{rng.choice(["ad", "comments", "site-footer", "related-work", "menu-prices"])}"><p>{some(rng.choice([2, 30]))}</p></div>',
        lambda: f"<aside>{some(20)}</aside><form>{some(3)}</form>",
        lambda: f"<table><tr><td>{some(2)}</td><td>{some(1)}</td></tr></table>",
        lambda: "".join(f"<div>{link()}</div>" for _ in range(rng.randrange(1, 9))),
    ]
    changed = 0
    for k in range(500):
        part = lambda n: "".join(rng.choice(makers)() for _ in range(rng.randrange(n)))
        page = part(6) + (f"<article>{part(12)}</article>{part(5)}" if k % 2 else part(12))
        if k % 10 == 1:
            page += f"<article>{part(3)}</article>"
        page = f"<div>{page}</div><footer>{some(4)}</footer>"
        assert html.extract(page) == plain_extract(page), page
        whole = "\n".join(x[0] for x in plain_lines(page) if x[3])
        changed += bool(whole) and html.extract(page) != whole
    assert changed > 50  # pages with an article on which windows decide


OPTIONAL = ("p", "li", "dt", "dd", "td", "th", "tr", "thead", "tbody", "option")


def test_html_implied_end_tags():
    """Generated pages give their text with all end tags and without the optional ones."""
    rng = random.Random(21)
    some = lambda n: " ".join(rng.choices(VOCAB, k=n))
    for k in range(300):
        want: list[str] = []

        def text(n, keep=True, want=want):
            out = some(n)
            if keep:
                want.append(out)
            return out

        def tag(name, content, cls=""):
            return f'<{name}{f" class={cls}" if cls else ""}>{content}</{name}>'

        def part(keep=True):
            """An element; its texts are wanted if ``keep``."""
            kind = rng.randrange(7)
            if kind == 0:
                return tag("p", text(rng.choice([8, 30]), keep))
            if kind == 1:  # a paragraph, an item, a cell that is left out
                return tag("p", text(4, False), rng.choice(["notice", "ad", "share"])) + tag("p", text(9, keep))
            if kind == 2:
                return tag(rng.choice(["ul", "ol"]), "".join(tag("li", text(3, keep and not out), "menu" if out else "") for out in rng.choices([0, 0, 1], k=4)))
            if kind == 3:
                rows = ["".join(tag("td", text(2, keep and not out), "ad" if out else "") for out in rng.choices([0, 0, 1], k=3)) for _ in range(2)]
                return tag("table", tag("tbody", "".join(tag("tr", r) for r in rows)))
            if kind == 4:
                return tag("dl", "".join(tag("dt", text(2, keep)) + tag("dd", text(3, keep and not out), "promo" if out else "") for out in rng.choices([0, 1], k=2)))
            if kind == 5:
                return tag("div", part(False) + part(False), rng.choice(["comments", "cookie-notice"]))
            return tag("ul", tag("li", tag("p", text(5, keep)) + tag("ul", tag("li", text(2, False), "menu") + tag("li", text(2, keep)))))

        page = tag("article", tag("h1", text(3)) + tag("p", text(40)) + "".join(part() for _ in range(8)) + tag("p", text(12)))
        page = tag("body", tag("nav", part(False)) + page + tag("footer", part(False)))
        bare = re.sub(rf"</(?:{'|'.join(OPTIONAL)})>", "", page)
        assert html.extract(page) == "\n".join(want), page
        assert html.extract(bare) == "\n".join(want), bare


def test_html_ends():
    p = "long paragraph of words " * 12
    q = p.strip()
    assert html.extract(f"<article><h1>T</h1><p class=notice>Note<p>{p}<p>{p}</article>") == f"T\n{q}\n{q}"
    assert html.extract(f"<ul><li class=menu>a<li>b</ul><p>{p}</p>") == f"b\n{q}"
    assert html.extract(f"<table><tr><td class=ad>x<td>y<tr><td>z</table><p>{p}") == f"y\nz\n{q}"
    assert html.extract(f"<article><div class=ad>never closed<p>x</article><main><p>{p}</main>") == q
    assert html.extract(f"<article><select><option class=ad>a<option>b</select><p>{p}<b class=share>s</p><p>{p}</article>") == f"{q}\n{q}"
    assert html.extract(f"<article><p>{p}<b>bold<p>{p}</b> on</article>") == f"{q} bold\n{q} on"
    assert html.extract(f"<article><table><tr><td><div class=ad>x</table></div><p>{p}</article>") == q
    assert html.extract(f"<p>{p}</p><p><a href=x>{p}</a></p>") == f"{q}\n{q}"
    bar = "".join(f"<div><a href=/{i}>link {i}</a></div>" for i in range(7))
    assert html.extract(f"<article><p>{p}</p>{bar}<p>{p}</p></article>").split("\n") == [q, q]
    deep = "<div>" * 20000 + f"<p>{p}<li>x</b></i>" * 50
    assert html.extract(deep).count(q) == 50


def test_html_keeps_paragraphs():
    """Parts left out amid text, a teaser's article behind the text, closing paragraphs behind menus, names that only look like parts."""
    lead = "<article><p>Lead paragraph with real text.</p><aside>x</aside><div class=ad>y</div><div class=share>z</div><p>Body.</p></article>"
    assert html.extract(lead) == html.extract(lead.replace("article", "div")) == "Lead paragraph with real text.\nBody."
    paragraphs = [f"{'long text ' * 20}{i}" for i in range(9)]
    page = "".join(f"<p>{x}</p>" for x in paragraphs)
    assert html.extract(page + "<article>Related: read this too</article>").split("\n") == paragraphs
    menu = "<ul><li><a href=x>Home</a></li><li><a href=y>News</a></li><li><a href=z>More</a></li></ul>"
    closing = ["A closing paragraph of some words.", "And another one behind it."]
    assert html.extract(menu + page + menu * 3 + "".join(f"<p>{x}</p>" for x in closing) + menu).split("\n") == paragraphs + closing
    assert html.extract("<p><a name=x>Anchor<a href=y>open</p>" + page + "<p>end</p>").split("\n") == ["Anchoropen", *paragraphs, "end"]
    odd = "<article><p>a b c</p><div class='related-work'>w</div><div class='notice-board'>n</div><div class='menu-prices'>5</div><math>x</math></article>"
    assert html.extract(odd) == "a b c\nw\nn\n5\nx"


def test_html_keeps_a_lead_before_left_out_parts():
    """Inside article and main nothing is dropped, however many parts are left out after a line."""
    out = '<div class="share">s</div><div class="advert">a</div><form>newsletter</form>'
    page = f"<main><h1>Head</h1><p>{'lead ' * 20}</p>{out}<p>{'body ' * 60}</p><p>more</p>{out}<p>mid</p>{out}<p>end</p></main>"
    assert html.extract(page).split("\n") == ["Head", ("lead " * 20).strip(), ("body " * 60).strip(), "more", "mid", "end"]
    two = "<article><h2>One</h2></article><p>x<p>y<p>z<article><h2>Two</h2><p>text</article>"
    assert html.extract(two) == "One\nTwo\ntext"


def test_chat(spark):
    t = lambda c, *texts: [(c, i, ("user", "assistant")[i % 2], x) for i, x in enumerate(texts)]
    rows = [*t(1, "a", "b"), *t(2, "a", "b", "c"), *t(3, "a", "b", "c"), *t(4, "a", "x"), *t(5, "ab"), *t(6, "a"), (7, 0, None, None), (None, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.report(df).collect()}
    assert set(out) == {2, 4, 5, 7} and out[2].n_turns == 3 and out[2].n_assistant == 1
    assert out[4].rendered == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n"
    assert chat.report(df.limit(0)).count() == 0


def test_fingerprint(spark):
    rng = random.Random(6)
    texts = [" ".join(words(rng, 300)) for _ in range(12)] + ["", None, "é", "short one"]
    texts.append(texts[0])
    got = {r.doc_id: r for r in fingerprint.compare_with_next(frame(spark, texts), partitions=3).collect()}
    n = len(texts)
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i - 1) % n] or ""
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        a, b, c = (fingerprint.chunk_set(x) for x in (t, e, nxt))
        assert r.fingerprint == fingerprint.encode(a) and r.edited_fingerprint == fingerprint.encode(b)
        assert (r.near_edited, r.near_next) == (fingerprint.likeness(a, b), fingerprint.likeness(a, c)) and fingerprint.decode(r.fingerprint) == a
    assert 0.35 < got[5].near_edited < 0.6 and got[5].near_next < 0.1 and got[0].fingerprint == got[16].fingerprint
    plain = lambda d: [sum(int(fingerprint.GEAR[d[i - j]]) << j for j in range(min(32, i + 1))) % 2**32 for i in range(len(d))]
    data = texts[0].encode()[:200]
    assert fingerprint.gear_hashes(data).tolist() == plain(data)
    ties = spark.createDataFrame([(None, "n"), (2, "b"), (2, "a"), (2, "a"), (None, None), (1, "z")], "doc_id long, text string")
    assert fingerprint.compare_with_next(ties, partitions=2).count() == 6
    assert fingerprint.compare_with_next(ties.limit(0)).count() == 0
    assert fingerprint.compare_with_next(ties.where("doc_id is null")).count() == 2


def plain_chunks(data):
    """Chunks of some bytes, one byte after the other; 64 on average, 16 to 256."""
    out, start, h = [], 0, 0
    hashes = []
    for byte in data:
        h = (2 * h + int(fingerprint.GEAR[byte])) % 2**32
        hashes.append(h)
    while start < len(data):
        end = start + 1
        while end < len(data):
            size = end - start
            bits = 7 if size < 64 else 5
            if size >= 256 or size >= 16 and len(data) - start > 16 and hashes[end - 1] < 2 ** (32 - bits):
                break
            end += 1
        out.append(data[start:end])
        start = end
    return out


def test_fingerprint_against_a_plain_chunker():
    import xxhash

    rng = random.Random(11)
    shares = []
    for n in (*range(0, 40), 63, 64, 65, 255, 256, 257, 1000, 5000, 20000):
        text = "".join(rng.choice("abcde \né") for _ in range(n)) if n % 3 else "a" * n
        chunks = plain_chunks(text.encode())
        ends = np.cumsum([len(c) for c in chunks]).tolist()
        assert fingerprint.cut_points(text.encode()) == ends, n
        plain = {xxhash.xxh3_64_intdigest(c) >> 16: len(c) for c in chunks}
        assert fingerprint.encode(fingerprint.chunk_set(text)) == ",".join(f"{d:012x}.{k}" for d, k in sorted(plain.items()))
        other = {xxhash.xxh3_64_intdigest(c) >> 16: len(c) for c in plain_chunks(("x" + text[: n // 2]).encode())}
        both, most = sum(k for d, k in plain.items() if d in other), max(sum(plain.values()), sum(other.values()))
        assert fingerprint.likeness(plain, other) == (1.0 if plain == other else both / most)
        shares.append(fingerprint.likeness(plain, other))
    assert shares[-1] > 0.4  # a byte in front moves the cuts with their text


def plain_clean(texts, min_words):
    """The texts without repeats, by loops and dictionaries over words and their offsets."""
    full = 1 << 64
    spread = 0xD6E8FEB86659FD93

    def mixed(x):
        x ^= x >> 29
        x = x * 0x9E3779B97F4A7C15 % full
        return x ^ (x >> 32)

    def folded(values):
        return sum(mixed((i * spread + v) % full) for i, v in enumerate(values)) % full

    def cuts(values):
        out, run = [], 0
        for i, v in enumerate(values):
            run = run + 1 if i and values[i - 1] == v else 0
            out.append((i == 0 or v < values[i - 1]) and (i + 1 == len(values) or v < values[i + 1]) or run % 8 == 7)
        return out

    def split(items, ends):
        out, part = [], []
        for x, end in zip(items, ends):
            part.append(x)
            if end or x is items[-1]:
                out.append(part)
                part = []
        return [*out, part] if part else out

    chunks = []  # of each text: (hash, first word, last word + 1)
    spots = []
    for t in texts:
        data = (t or "").encode()
        words_ = [(m.start(), m.end()) for m in re.finditer(rb"[^ \t-\r]+", data)]
        hashes = words_of([t]).hashes.tolist()
        low = cuts(hashes)
        ends = [low[i] or data[b - 1 : b] in (b".", b"!", b"?") or i + 1 < len(words_) and b"\n" in data[b : words_[i + 1][0]] for i, (_, b) in enumerate(words_)]
        lines = split(list(range(len(words_))), ends)
        keys = [folded([hashes[i] for i in line]) for line in lines]
        rolling = [mixed((k + (keys[i - 1] if i else 0) * spread) % full) for i, k in enumerate(keys)]
        groups = split(list(range(len(lines))), cuts(rolling))
        chunks.append([(folded([keys[i] for i in g]), lines[g[0]][0], lines[g[-1]][-1] + 1) for g in groups])
        spots.append(([data[a:b].translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")) for a, b in words_], words_, data))

    def long_runs(found):
        out, run = set(), []
        for x in [*sorted(found), None]:
            if run and (x is None or x != (run[-1][0], run[-1][1] + 1)):
                if sum(chunks[i][j][2] - chunks[i][j][1] for i, j in run) >= 4:
                    out |= set(run)
                run = []
            run.append(x)
        return out

    places = [(i, j) for i, c in enumerate(chunks) for j in range(len(c))]
    counts = Counter(chunks[i][j][0] for i, j in places)
    seen = sorted(long_runs({(i, j) for i, j in places if counts[chunks[i][j][0]] > 1}))
    first = {}
    for i, j in seen:
        first.setdefault(chunks[i][j][0], (i, j))
    again = long_runs({x for x in seen if first[chunks[x[0]][x[1]][0]] != x})

    def bytes_of(i, a, b):
        _, words_, data = spots[i]
        return data[words_[a][0] : words_[b - 1][1]].translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")) if a < b else b""

    gone = [set() for _ in texts]
    todo = sorted(again)
    while todo:
        run = [todo.pop(0)]
        home = [first[chunks[run[0][0]][run[0][1]][0]]]
        while todo and todo[0] == (run[-1][0], run[-1][1] + 1) and first[chunks[todo[0][0]][todo[0][1]][0]] == (home[-1][0], home[-1][1] + 1):
            run.append(todo.pop(0))
            home.append((home[-1][0], home[-1][1] + 1))
        (i, j0), (_, j1) = run[0], run[-1]
        (h, k0), (_, k1) = home[0], home[-1]
        a, b, x, y = chunks[i][j0][1], chunks[i][j1][2], chunks[h][k0][1], chunks[h][k1][2]
        if bytes_of(i, a, b) != bytes_of(h, x, y):
            continue
        least, most = chunks[i][max(j0 - 2, 0)][1], chunks[i][min(j1 + 2, len(chunks[i]) - 1)][2]
        low, high = chunks[h][max(k0 - 2, 0)][1], chunks[h][min(k1 + 2, len(chunks[h]) - 1)][2]
        while a > least and x > low and bytes_of(i, a - 1, b) == bytes_of(h, x - 1, y):
            a, x = a - 1, x - 1
        while b < most and y < high and bytes_of(i, a, b + 1) == bytes_of(h, x, y + 1):
            b, y = b + 1, y + 1
        gone[i] |= set(range(a, b))
    out = []
    for t, g, (_, words_, data) in zip(texts, gone, spots):
        runs = split(sorted(g), [x + 1 not in g for x in sorted(g)])
        runs = [r for r in runs if len(r) >= min_words]
        left, at = b"", 0
        for r in runs:
            left += data[at : words_[r[0]][0]]
            at = words_[r[-1] + 1][0] if r[-1] + 1 < len(words_) else len(data)
        out.append(((left + data[at:]).rstrip(b" \t-\r".replace(b"-", b"\n\x0b\x0c")).decode() if runs else t, len(runs)))
    return out


def test_linededup(spark):
    rng = random.Random(7)
    passage = " ".join(words(rng, 80))
    texts = []
    for i in range(40):
        own = [" ".join(words(rng, rng.randrange(3, 12))).capitalize() + "." for _ in range(12)]
        if i % 2:
            own.insert(5, passage)
        texts.append(("\n" if i % 3 else " ").join(own))
    twice = " ".join(words(rng, 40))
    texts += ["", None, "Tiny.", texts[4], " \n", f"{twice}\nmore of it\n{twice} end", "For " * 3000, "é\u00a0 \tx\n" * 200, f"a {passage}\n\nb"]
    docs = frame(spark, texts)
    want = plain_clean(texts, linededup.MIN_WORDS)
    got = {r.doc_id: r for r in linededup.clean(docs).collect()}
    for i, t in enumerate(texts):
        assert (got[i].text, got[i].n_removed) == want[i], i
        assert got[i].n_chars == len(want[i][0]) if want[i][1] else got[i].n_chars == docs.where(f"doc_id={i}").first().n_chars
    assert passage in got[1].text and not any(set(passage.split()) <= set(got[i].text.split()) for i in range(3, 40, 2))
    assert all(got[i].n_removed == 0 for i in range(0, 40, 2)) and got[45].text == f"{twice}\nmore of it\nend" and got[48].text == "a b"
    assert len(got[46].text) < 600 and got[43].text == ""
    kept = linededup.drop_repeats(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(49)) - {43}
    assert linededup.report(docs.limit(0)).count() == 0
    same = spark.createDataFrame([(None, texts[1], 1), (None, texts[1], 2), (5, texts[1], 3), (5, texts[1], 4)], "doc_id long, text string, row int")
    assert sorted(r.row for r in linededup.drop_repeats(same).collect()) in ([3], [4])


@pytest.mark.parametrize("size, gap", [(40, "\n"), (40, " "), (45, " "), (60, " "), (200, "\n")])
def test_linededup_recall(spark, size, gap):
    """Pairs of texts that share a passage: what goes of its second occurrence, and nothing else."""
    rng = random.Random(size)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(5000)]
    some = lambda n: " ".join(rng.choices(vocabulary, k=n))
    texts, passages = [], []
    for _ in range(200):
        passages.append(some(size))
        texts += [f"{some(60)}{gap}{passages[-1]}{gap}{some(40)}" for _ in range(2)]
    rows = sorted(linededup.clean(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    left = [len(r.text.split()) - 100 for r in rows]
    assert left[::2] == [size] * 200 and min(left) >= 0
    assert 1 - sum(left[1::2]) / (200 * size) >= 0.9
    assert sum(p in r.text for p, r in zip(passages, rows[1::2])) <= {40: 20, 45: 2}.get(size, 0)
    plain = plain_clean(texts[:40], linededup.MIN_WORDS)
    assert [p[0] for p in plain[:2]] == [r.text for r in rows[:2]]


def test_toxicity(spark):
    rng = random.Random(8)
    group, insult = ["them", "folk", "tribe"], ["bad", "vile", "low"]
    texts, labels = [], []
    for i in range(900):
        t, kind = words(rng, 20), i % 4
        if kind in (0, 1):
            t.insert(3, rng.choice(insult))
        if kind in (0, 2):
            t.insert(9, rng.choice(group))
        texts.append(" ".join(t))
        labels.append((i, 1, int(kind == 0)))
    lab = spark.createDataFrame(labels + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    docs = frame(spark, [*texts, None, ""])
    rows = toxicity.report(docs, lab, epochs=60, min_chi2=10).collect()
    held = [r for r in rows if r.held_out and r.doc_id < 900]
    assert len(rows) == 902 and sum(r.predicted == (r.doc_id % 4 == 0) for r in held) / len(held) > 0.95  # not linear in the terms
    assert all(0 <= r.score <= 1 for r in rows)
    kept = toxicity.drop_toxic(docs, lab, epochs=60, min_chi2=10)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.score < 0.7}
    none = toxicity.report(docs, lab.limit(0))
    assert none.where("score < 1e-6").count() == 902


def test_toxicity_of_any_size(spark):
    """The defaults find terms in few rows, too, and keep frequent terms for pairs."""
    rng = random.Random(8)
    for n in (120, 900):
        texts, labels = [], []
        for i in range(n):
            t, kind = words(rng, 20), i % 4
            t += [rng.choice(["bad", "vile"])] * (kind in (0, 1)) + ["folk"] * (kind in (0, 2))
            texts.append(" ".join(t))
            labels.append((i, 1, int(kind == 0)))
        lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        held = toxicity.report(frame(spark, texts), lab).where("held_out").collect()
        assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) / len(held) > 0.95
    machine = toxicity.fit(frame(spark, texts), lab, max_buckets=2)
    place = machine.buckets.tolist().index(toxicity.Terms(machine.bits)["folk"][0])
    assert len(machine.buckets) > 2 and np.count_nonzero(machine.linear) == 2 and np.abs(machine.factors[place]).sum() > 0


def test_mixing(spark):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(9)
    rows = [(i, " ".join(words(rng, rng.randrange(1, 200))) + rng.choice(["", " a!!", " b | c", " ***"]), rng.choice(["en", "en", "de", None]), rng.choice(["s0"] * 6 + ["s1", None, ""])) for i in range(400)]
    rows += [(None, "no id", "en", "s0"), (1000, None, "en", "s0"), (1001, "", "de", "s1"), (3, "again", "en", "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("p", F.lit(1))
    out = mixing.chosen(docs, budget=0.4)
    got = sorted((str(r.doc_id), r.m_source, r.m_lang, r.m_topic, r.n_tokens, r.p, r.kept) for r in out.collect())
    documents = docs.toPandas()
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    con = duckdb.connect()
    con.register("documents", documents)
    want = sorted((str(r[0]), *r[1:]) for r in con.sql(mixing.sql(budget=0.4)).fetchall())
    assert [g[:5] + (g[6],) for g in got] == [w[:5] + (w[6],) for w in want] and np.allclose([g[5] for g in got], [w[5] for w in want], atol=2e-6)
    # raking meets the targets, and the budget is met in expectation
    for budget in (0.1, 0.5, 0.8):
        cells = mixing.weights(docs, budget=budget, rounds=16).toPandas()
        total = cells.n_tokens.sum()
        assert abs((cells.p * cells.n_tokens).sum() / total - budget) < 0.01
        for m in mixing.MARGINS:
            drawn = (cells.p * cells.n_tokens).groupby(cells[m]).sum()
            assert np.allclose(drawn / total, cells.groupby(m)[f"t_{m}"].first().reindex(drawn.index).fillna(0) / total, atol=0.02 * budget)
            raw = (cells.groupby(m).n_tokens.sum() / total) ** mixing.ALPHA[m]
            free = drawn[(cells.groupby(m).p.max() < 1) & (raw > 0)]  # classes that nothing limits share by their raw weights
            assert len(free) < 2 or budget > 0.1 or np.allclose(free / free.sum(), raw[free.index] / raw[free.index].sum(), atol=0.02)
    assert mixing.sample(docs, budget=0.4).columns == docs.columns and mixing.chosen(docs.limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in mixing.sample(docs, budget=0.4).collect()) == sorted(g[0] for g in got if g[6])


def test_mixing_targets(spark):
    """Given targets: drawn shares, margins that can't be met, other topics, tiny budgets, small probabilities."""
    rng = random.Random(10)
    rows = [(i, " ".join(words(rng, rng.randrange(20, 60))), rng.choice(["en"] * 5 + ["de"]), rng.choice(["a"] * 6 + ["b", "b", "c"]), rng.choice("xyz"), 0) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, theme string, _row int")
    targets = {"source": {"a": 2, "b": 1, "c": 1}, "lang": {"en": 0.8, "de": 0.2}, "topic": {"x": 0.5, "y": 0.3, "z": 0.2}}
    for budget in (0.1, 0.3):
        drawn = mixing.sample(docs, budget=budget, targets=targets, topic="theme")
        assert drawn.columns == docs.columns
        got = drawn.withColumn("n", mixing.tokens(F.col("text"))).toPandas()
        whole = docs.select(F.sum(mixing.tokens(F.col("text")))).first()[0]
        assert abs(got.n.sum() / whole / budget - 1) < 0.1
        for column, name in (("source", "source"), ("lang", "lang"), ("theme", "topic")):
            share, weights = got.groupby(column).n.sum() / got.n.sum(), targets[name]
            assert all(abs(share[k] - v / sum(weights.values())) < 0.06 for k, v in weights.items())
        cells = mixing.weights(docs, budget=budget, targets=targets, topic="theme").toPandas()
        for m in mixing.MARGINS:
            expected = (cells.p * cells.n_tokens).groupby(cells[m]).sum()
            assert np.allclose(expected / expected.sum(), cells.groupby(m)[f"t_{m}"].first() / expected.sum(), atol=0.005)
    with pytest.raises(ValueError, match="source 'c'"):
        mixing.weights(docs, budget=0.8, targets=targets, topic="theme")
    with pytest.raises(ValueError, match="lang 'fr'"):
        mixing.weights(docs, targets={"lang": {"en": 1, "fr": 1}})
    same = docs.withColumn("source", F.col("lang"))
    with pytest.raises(ValueError, match="margins"):
        mixing.weights(same, budget=0.1, targets={"lang": {"en": 1, "de": 1}, "source": {"en": 1, "de": 3}})
    few = mixing.chosen(docs, budget=1e-7)
    cells = mixing.weights(docs, budget=1e-7)
    assert cells.where("p > 0").count() == cells.count() and few.where("kept").count() <= 1


def test_warc(spark):
    bodies = ["<p>a</p>", "<p>b</p>", "<p>a</p>", "", None, "é\r\n\r\nWARC/1.1", "<p>a</p>"]
    rows = [(i, f"http://x/{i}?q=a b%20c\r\nX: y" if i % 2 else None, b, "z") for i, b in enumerate(bodies)] + [(None, "u", "<p>a</p>", "z"), (1, "again", "<p>b</p>", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, file string").repartition(3)
    want = []
    for i, _, b, _ in rows:
        data = (b or "").encode()
        same = [j for j, _, x, _ in rows if j is not None and (x or "").encode() == data]
        keep = max(same, default=None)
        again = i is not None and keep is not None and keep > i
        want.append((str(i), len(data), warc.digest32(data), "revisit" if again else "response", keep if again else None))
    got = [(str(r.page_id), *r[1:]) for r in warc.round_trip(df).collect()]
    assert Counter(got) == Counter(want)
    from corvane.session import scratch_path

    folder = scratch_path(spark, "warc")
    index = warc.write(df, folder, least_bytes=9)
    back = warc.read(index.where("page_id in (5, 3)"), folder).collect()
    assert {(r.page_id, r.url, r.payload) for r in back} == {(5, rows[5][1], bodies[5]), (3, rows[3][1], "")}
    assert index.where("record_type = 'revisit'").count() == 0
    assert warc.round_trip(df.limit(0)).count() == 0
    assert warc.read(index, folder, task_bytes=300).rdd.getNumPartitions() > 3
    assert [warc.filesystem(x)[1] for x in ("file:///tmp/a", "dbfs:/a/b", "/x")] == ["/tmp/a", "/dbfs/a/b", "/x"]
    raw = warc.record(5, "http://x/", b"<p>", "response", None)
    assert b"\r\n\r\nHTTP/1.1 200 OK\r\n" in raw and raw.endswith(b"\r\n\r\n<p>\r\n\r\n") and warc.parse(raw)[6] == "<p>"


CLASHES = "_may _spans n_words n_hit item_ids word_spans char_spans score n_removed row rest keys spans h k ord idx bucket place base terms entity may h1 found".split()


@pytest.mark.parametrize("name", ["jaccard", "pii", "decontaminate", "blocks", "toxicity", "linededup", "fim", "mixing"])
def test_own_columns_come_back(spark, name):
    """Operators on documents return extra columns as they were, whatever their names."""
    rng = random.Random(3)
    rows = [(i, " ".join(words(rng, 30)), "en", f"s{i % 2}", 7, *[f"{c}{i}" for c in CLASHES]) for i in range(60)]
    rows += [(60, rows[0][1], *rows[0][2:5], *[f"{c}60" for c in CLASHES]), (61, None, None, None, None, *[f"{c}61" for c in CLASHES])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES))
    bench = spark.createDataFrame([(i, rows[i][1] if i < 3 else " ".join(words(rng, 12))) for i in range(9)], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    out = {
        "jaccard": lambda: jaccard.one_of_each(docs),
        "pii": lambda: pii.sanitise(docs),
        "decontaminate": lambda: decontaminate.drop_contaminated(docs, bench, 10),
        "blocks": lambda: decontaminate.drop_contaminated(docs, bench, 10, block_words=40),
        "toxicity": lambda: toxicity.drop_toxic(docs, labels, threshold=2.0),
        "linededup": lambda: linededup.drop_repeats(docs),
        "fim": lambda: fim.rewrite(docs),
        "mixing": lambda: mixing.sample(docs),
    }[name]()
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) >= (1 if name == "mixing" else 55)
    for r in got:
        assert [r[c] for c in CLASHES] == [f"{c}{r.doc_id}" for c in CLASHES]
    if name in ("decontaminate", "blocks"):
        assert {r.doc_id for r in got} == set(range(3, 60)) | {61}


def test_decontamination_blocks_release(spark, tmp_path):
    """Three blocks give what one gives, and leave one scratch table, the result's."""
    from pathlib import Path

    from corvane import session

    rng = random.Random(9)
    docs = spark.createDataFrame([(i, " ".join(words(rng, 40))) for i in range(40)] + [(40, None)], "doc_id long, text string")
    texts = [r.text for r in docs.collect()]
    bench = spark.createDataFrame([(i, " ".join(texts[i].split()[5:25])) for i in range(12)], "item_id long, text string")
    folder = Path(session.shared_dir(spark).removeprefix("file://")) / "corvane"
    was = set(folder.glob("benchmark-*"))
    many = decontaminate.scan(docs, bench, block_words=80)
    assert len(set(folder.glob("benchmark-*")) - was) == 1
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(many) == rows(decontaminate.scan(docs, bench))


def test_pii_many_entities_in_a_text(spark):
    """A text of many entities and rare words makes no product of them, and finds the same words."""
    ips = [f"10.{i // 250 % 250}.{i % 250}.{i // 62500 + 1}" for i in range(20_000)]
    names = ["".join(random.Random(i).choices("abcdefghijklmnop", k=9)) for i in range(20_000)]
    log = " ".join(f"{a} {b}" for a, b in zip(ips, names))
    texts = [log, "shared 1.2.3.4 word", "shared 1.2.3.4 other", *[f"filler word {i}" for i in range(40)]]
    docs = frame(spark, texts)
    pairs = pii.rare_pairs(pii.scan(docs).where("size(entities) > 0").select("row", "entities", "words"), pii.term_counts(pii.scan(docs)), len(texts), 0.8)
    assert pairs.count() < 25_000
    spans = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    assert spans[0].count("term:") == len(names) and "term:0:6" in spans[1] and "term:0:6" in spans[2]
