"""Decontamination, secrets, HTML, sharding, URLs, toxicity, mixing and the pipeline."""

import os
import random
import re
import zlib
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopwise.llm import decontamination, hashing, html_text, mixing, queries, secrets, sharding, toxicity, urls

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


def test_words():
    import pyarrow as pa

    texts = ["a b  c", "", "  ", None, " lead trail ", "no\tgap\x0bq é ü\xa0z", "ABC abc"]
    for row, words in hashing.chunks(pa.array(texts)):
        got = [[bytes(words.data[words.start[j] : words.stop[j]]).decode() for j in range(words.first[i], words.first[i + 1])] for i in range(len(texts))]
        assert row == 0 and got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert list(hashing.chunks(pa.array([], pa.string()))) == []


def test_decontamination(spark):
    item = "If Alice has 5 apples and Bob has 7 apples, how many apples do Alice and Bob have together after 3 days?"
    items = spark.createDataFrame([(1, item), (2, "tiny one"), (3, "What is the capital of Peru"), (4, None), (None, None)], "item_id long, text string")
    docs = [
        (1, "Well, if Carol has 12 apples and Dave has 9 apples how many apples do Carol and Dave have together after 30 days ?"),
        (2, "tell me: what is the CAPITAL of Chile please"), (3, None), (4, "tiny one"), (5, "what is the capital of"), (6, ""), (7, "x " * 40000 + item), (8, "clean text " * 30),
    ]
    df = spark.createDataFrame(docs + [(None, item)], "doc_id long, text string").withColumn("h", F.lit(1))
    got = {r["doc_id"]: r["item_id"] for r in decontamination.contaminated(df, items).collect()}
    assert got == {1: 1, 2: 3, 7: 1}
    assert decontamination.without_contaminated(df, items).columns == df.columns and decontamination.without_contaminated(df, items).count() == 6
    assert decontamination.contaminated(df, items.limit(0)).count() == 0 and decontamination.contaminated(df.limit(0), items).count() == 0
    # 5 apples and 5 apples in the item cannot become 12 and 9
    twice = spark.createDataFrame([(1, "anna gave 5 red apples and otto gave 5 green apples to us")], "item_id long, text string")
    tries = spark.createDataFrame([(1, "anna gave 8 red apples and otto gave 8 green apples to us"), (2, "anna gave 8 red apples and otto gave 9 green apples to us")], "doc_id long, text string")
    assert [r["doc_id"] for r in decontamination.contaminated(tries, twice).collect()] == [1]


def test_decontamination_dense_and_short_items(spark):
    """Items whose windows are mostly slots, items of few tokens and texts without spaces are found as verbatim copies only."""
    items = [
        (1, "What is 12 + 7 * 3 - 4?"), (2, "Compute 12 + 7 * 31 - 4 / 15 + 6 - 18 * 9 + 11 - 2 * 40 + 8."), (3, "Mercury Venus Earth Mars Jupiter Saturn Uranus Neptune"),
        (4, "What is 2+3?"), (5, "光合作用发生在植物细胞的哪个部分？"), (6, "水は何度で沸騰しますか"),
    ]
    docs = [
        (1, "Solve: what is 12+7*3-4? Easy."), (2, "So compute 12 + 7 * 31 - 4 / 15 + 6 - 18 * 9 + 11 - 2 * 40 + 8 now"), (3, "The list is mercury, venus, Earth, mars, Jupiter, Saturn, Uranus, Neptune."),
        (4, "hm, what is 2 + 3 really"), (5, "题目：光合作用发生在植物细胞的哪个部分？请回答。"), (6, "問題「水は何度で沸騰しますか」です"),
        (11, "Solve: what is 13+7*3-4? Easy."), (12, "So compute 13 + 8 * 32 - 5 / 16 + 7 - 19 * 10 + 12 - 3 * 41 + 9 now"), (13, "They are Alice Bob Carol Dave Erin Frank Grace Heidi"), (14, "hm, what is 2 + 4 really"), (15, "光合作用很重要。植物细胞有细胞壁。"),
    ]
    found = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"]: r["item_id"] for r in found.collect()} == {i: i for i in range(1, 7)}


def test_decontamination_brute_force_with_slots(spark):
    r = random.Random(5)
    words = lambda t: tuple(re.findall(r"\w+", t.lower()))
    some = ["Bob", "Alice", "Lima", "7", "12", "305", "km", "kg", "days", "apples", "plus", "What", "is"]
    items = [" ".join(r.choice(some) + r.choice(["", "", ",", "."]) for _ in range(r.randrange(3, 30))) for _ in range(60)]
    docs = []
    for i in range(300):
        text = " ".join(r.choice(some) for _ in range(20))
        if i % 3 == 0:
            text += " ; " + r.choice([str, str.lower, str.upper])(r.choice(items)) + " ; " + text[:30]
        docs.append((i, text))
    grams = {w[a : a + 13] for w in map(words, items) for a in range(len(w) - 12)} | {w for w in map(words, items) if 3 <= len(w) < 13}
    want = {i for i, t in docs for w in [words(t)] if any(w[a : a + n] in grams for n in range(3, 14) for a in range(len(w) - n + 1))}
    found = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    got = {x["doc_id"] for x in found.collect()}
    assert want <= got and len(want) >= 100


def test_decontamination_case_and_place(spark):
    """Copies that are lower-cased, upper-cased, unpunctuated or quoted inside a sentence, and asked again with other numbers or names."""
    item = "Bob buys 5 apples. Alice takes 2 of them home. How many apples does Bob have now?"
    items = spark.createDataFrame([(1, item), (2, "What is the capital of Peru")], "item_id long, text string")
    bare = re.sub(r"[.?]", "", item)
    docs = {
        1: item.lower(), 2: item.upper(), 3: bare, 4: f"He said, “{item}”", 5: f"they wondered - {bare.lower()}", 6: bare.upper(),
        7: item.lower().replace("5", "8"), 8: bare.replace("5", "8").replace("2", "3"), 9: item.replace("Bob", "Carol").replace("5", "6"),
        21: 'he asked, "What is the capital of Peru"', 22: 'he asked, "What is the capital of Chile"', 23: "(WHAT IS THE CAPITAL OF PERU)", 24: "so what is the capital of peru", 25: "tell me what is the capital of Chile",
        31: "Lima is the capital of Peru", 32: "We know that Lima is the capital of Peru", 33: "what is the price of Peru",
    }
    found = decontamination.contaminated(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), items)
    assert {r["doc_id"]: r["item_id"] for r in found.collect()} == {i: 1 if i < 20 else 2 for i in docs if i < 30}


@needs_tables
def test_decontamination_brute_force(spark):
    words = lambda t: tuple(re.findall(r"\w+", t.lower()))
    items = [words(r["text"]) for r in queries.table(spark, SF, "benchmark").collect()]
    grams = {i[a : a + 13] for i in items for a in range(len(i) - 12)} | {i for i in items if 5 <= len(i) < 13}
    want = set()
    for r in queries.table(spark, SF, "documents").collect():
        w = words(r["text"])
        if any(w[a : a + n] in grams for n in range(5, 14) for a in range(len(w) - n + 1)):
            want.add(r["doc_id"])
    assert {r["doc_id"] for r in queries.op3_decontamination(spark, SF).collect()} == want


def test_secrets(spark):
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    docs = [(1, f'the token = "{key}" is here and token = "{key}" again'), (2, "a verylongwordwithoutanymeaning thathere"), (3, None), (4, ""), (5, f'{"word " * 30000}api_key: "sk_live_{key[:24]}"'), (6, "see 4952935900253052 please"), (None, f"password={key.upper()}")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("start", F.lit("x"))
    got = {r["doc_id"]: (r["finding"], r["n_occurrences"]) for r in secrets.secrets(df).collect()}
    assert got == {1: (key, 2), 5: (f"sk_live_{key[:24]}", 1), None: (key.upper(), 1)}
    assert secrets.secrets(df.limit(0)).count() == 0


def test_secrets_every_occurrence(spark):
    """A key that first stands after `commit` or inside a longer run is judged at its later places too."""
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    docs = [(1, f'commit {key} and then token = "{key}" here'), (2, f"commit {key} only, sha1: {key}"), (3, f'path/x/{key}abc then token = "{key}"'), (4, f'token = "{key}"'), (4, f'token = "{key}"')]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    ends = spark.createDataFrame([(i, f"x {key}{e} y") for i, e in enumerate(["", "=", "==", "===", "==+", ".", "==/ "])], "doc_id long, text string")
    assert [(r["start"], r["n_occurrences"]) for r in secrets.candidates(ends).collect()] == [(3, 1)] * 7
    got = sorted((r["doc_id"], r["start"], r["n_occurrences"]) for r in secrets.secrets(df).collect() if r["finding"] == key)
    assert got == [(1, 8, 2), (3, docs[2][1].rindex(key) + 1, 1), (4, 10, 1), (4, 10, 1)]


def test_secrets_positions(spark):
    """A string that first stands inside a longer run has the position and the words of its own place; announced short secrets are found."""
    key = "9f86d081884c7d659a2feaa0c55ad015"
    docs = [
        (1, f'commit AA{key} then api_key = "{key}"'), (2, 'password = "Tr0ub4dor&3" and more'), (3, "passwd: hunter2hunter2 ok"), (4, "see https://bob:s3cr3tPw9@host.org/x"),
        (5, "the password: required here"), (6, "token: https://example.org/some/page is where"), (7, "the secret: everything happens"), (None, f"x {key} " * 3), (8, None),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("finding", F.lit(1))
    got = sorted(((r["doc_id"] or 0, r["finding"], r["start"], r["n_occurrences"]) for r in secrets.secrets(df).collect()))
    assert got == [(0, key, 3, 3), (1, key, 59, 1), (2, "Tr0ub4dor&3", 13, 1), (3, "hunter2hunter2", 9, 1), (4, "s3cr3tPw9", 17, 1)]


def test_secrets_whole_values(spark):
    """Quoted values with spaces and brackets, and web tokens, are one finding each; what a form says is none."""
    part = "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9"
    jwt = f"{part}.{part[::-1]}x7Q.Qm9{part[5:]}_-a"
    docs = [
        (1, 'password = "correct horse battery staple" ok'), (2, f"sent {jwt} along"), (3, f'Authorization: Bearer {jwt}'), (4, "secret: 'a[9](Zq;7,k}#x' done"),
        (5, 'password: "please enter your new password here"'), (6, 'password = "unended ' + "word " * 20), (7, 'token = "\n\n"'), (8, 'password = "short"'),
        (9, 'password = "correct horse battery staple" and password = "correct horse battery staple"'),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    whole = {(r["doc_id"], r["finding"]) for r in secrets.candidates(df).collect()}
    phrase = "correct horse battery staple"
    assert whole == {(1, phrase), (2, jwt), (3, jwt), (4, "a[9](Zq;7,k}#x"), (5, "please enter your new password here"), (9, phrase)}
    got = sorted((r["doc_id"], r["finding"], r["start"], r["n_occurrences"]) for r in secrets.secrets(df).collect())
    assert got == [(1, phrase, 13, 1), (2, jwt, 6, 1), (3, jwt, 23, 1), (4, "a[9](Zq;7,k}#x", 10, 1), (9, phrase, 13, 2)]


def test_secrets_plain_version(spark):
    """Candidates, positions and features against plain Python, over many candidates in one text too."""
    import regex

    r = random.Random(4)
    some = lambda: "".join(r.choice("abcdefXYZ0189_/+-=") for _ in range(r.choice([3, 8, 16, 17, 20, 40])))
    texts = [" ".join(r.choice([some(), "word", "é", "token =", 'password: "', "pwd=", '"', f"//u:{some()}@h", "commit"]) for _ in range(r.choice([1, 5, 30, 400]))) for _ in range(80)]
    texts += [" ".join(f"{i:020d}" for i in range(3000))]
    table = secrets.standard_transitions()

    def plain(text):
        out = defaultdict(lambda: [None, 0, set()])
        for m in regex.finditer(secrets.CANDIDATE, text):
            entry = out[m[0]]
            entry[0] = entry[0] or m.start() + 1
            entry[1] += 1
            entry[2].add((text[max(0, m.start() - 40) : m.start()], text[m.end() : m.end() + 1]))
        return out

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = defaultdict(lambda: defaultdict(lambda: [None, 0, set()]))
    for x in secrets.described(secrets.candidates(df)).collect():
        entry = got[x["doc_id"]][x["finding"]]
        entry[:2] = x["start"], x["n_occurrences"]
        entry[2].add((x["before"], x["after"]))
        f = x["finding"]
        codes = [26 if c in "0123456789" else ord(c.lower()) - 97 if c.isascii() and c.isalpha() else 27 for c in f]
        assert x["transitions"] == pytest.approx(sum(table[a * 28 + b] for a, b in zip(codes, codes[1:])) / (len(f) - 1))
        plainly = re.sub("(?i)(" + "|".join(sorted(secrets.FREQUENT, key=lambda w: (-len(w), w))) + ")", "", f)
        kinds = re.sub(r"(.)\1*", r"\1", re.sub("[^aB0]", "-", re.sub("[0-9]", "0", re.sub("[A-Z]", "B", re.sub("[a-z]", "a", f)))))
        assert (x["length"], x["slashes"]) == (len(f), f.count("/")) and x["frequent"] == pytest.approx(1 - len(plainly) / len(f)) and x["changes"] == pytest.approx((len(kinds) - 1) / len(f))
    for i, t in enumerate(texts):
        # the 40 characters before may hold more of the text than what lies between two candidates and the one before
        want = plain(t)
        assert {f: v[:2] for f, v in got[i].items()} == {f: v[:2] for f, v in want.items()}
        ends = lambda v: {(b[-8:], a) for b, a in v[2]}
        assert {f: ends(v) for f, v in got[i].items()} == {f: ends(v) for f, v in want.items()}
    assert sum(map(len, got.values())) > 3500


def test_secret_forest_held_out(spark):
    held = secrets.labelled_findings(600, seed=99)
    rows = spark.createDataFrame(held, "finding string, before string, after string, label double")
    from pyspark.ml.feature import VectorAssembler

    found = secrets.forest(spark).transform(VectorAssembler(inputCols=secrets.FEATURES, outputCol="features").transform(secrets.described(rows)))
    assert found.where("prediction = label").count() / len(held) > 0.93


def test_html():
    tree = html_text.standard_tree()
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><h2>Site</h2></header><div class="cookie-notice">We use cookies to make it better for you</div>
    <main><h1>Head &lt;x&gt;</h1><p>One two <a href="x">three</a>&nbsp;four<br>five</p><aside>Side words</aside><form><label>Mail</label></form><script>var t="</p>";</script>
    <section id="comments"><p>First! I really liked it very much thanks</p></section></main><footer>&copy; 2020</footer></body></html>"""
    assert html_text.main_text(page, tree) == "Head <x>\nOne two three four five"
    long = "word " * 20
    assert html_text.main_text(f"<div><a href=a>Home</a> <a href=b>News</a></div><p>{long}</p><p>{long}</p><div><a>x</a> | <a>y</a></div>", tree) == f"{long.strip()}\n{long.strip()}"
    assert [html_text.main_text(x, tree) for x in (None, "", "<p", "<script>x", "&nbsp;")] == [""] * 5
    assert html_text.main_text(f"<article><p>{long}<b>bold<p>next &amp", tree) == f"{long}bold\nnext &"


def test_html_anchors_and_formulas():
    """An anchor without an address is no link, one that is not ended ends with what holds it, and formulas are text."""
    tree = html_text.standard_tree()
    long = " ".join(["word"] * 40)
    for page in (
        f'<body><div><a name="top"><p>{long}</p><p>{long}</p></div>', f'<article><a id="top"><p>{long}</p><p>{long}</p></article>', f'<body><div><p>{long}</p></div><div><a name=x></div><div><p>{long}</p></div>',
        f'<article><div><a href="/x">some link</div><p>{long}</p><p>{long}</p></article>',
    ):
        assert html_text.main_text(page, tree).endswith(f"{long}\n{long}"), page
    assert [b[2] for b in html_text.blocks(f'<p><a href="x">one two <a name="y">three</a> four</p><div><a href="z">five six</div><p>{long}</p>')] == [2, 2, 0]
    formula = f"<article><p>{long} where <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds</p></article>"
    assert html_text.main_text(formula, tree) == f"{long} where x=2 holds"


def test_html_reference_lists_comments_and_alerts():
    tree = html_text.standard_tree()
    long = " ".join(["word"] * 40)
    refs = ["First reference text here", "A second one by somebody else", "On the third of them", "Fourth reference of this article"]
    listed = "".join(f'<li><a href="/r{i}">{t}</a></li>' for i, t in enumerate(refs))
    page = f"<main><h1>A title here</h1><p>{long}</p><p>{long}</p><ol>{listed}</ol></main>"
    assert html_text.main_text(page, tree) == "\n".join(["A title here", long, long, *refs])
    for gone in ('<ol class="commentlist"><li>{}</li></ol>', '<section id="responses"><p>{}</p></section>', '<div role="alert">{}</div>', '<div role="alertdialog"><p>{}</p></div>'):
        for text in ("Please enable cookies to go on", "I liked it " * 20):
            assert html_text.main_text(f"<main><p>{long}</p><p>{long}</p>{gone.format(text)}</main>", tree) == f"{long}\n{long}", gone
    assert html_text.main_text(f'<article><p>{long}</p><section id="immune-responses"><p>{long}</p></section></article>', tree) == f"{long}\n{long}"


class PlainBlocks(HTMLParser):
    """The texts of the blocks of a page, by the parser of the standard library."""

    def __init__(self, page):
        super().__init__()
        self.found, self.parts, self.hidden = [], [], []
        self.feed(page)
        self.close()
        self.flush()

    def flush(self):
        text = " ".join("".join(self.parts).split())
        self.found += [text] if text else []
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag not in html_text.HEAD and self.hidden == ["head"]:
            self.hidden = []
        if tag in html_text.BLOCK:
            self.flush()
        if tag == "br":
            self.parts.append(" ")
        elif tag in html_text.HIDDEN:
            self.hidden.append(tag)

    def handle_endtag(self, tag):
        if tag in html_text.BLOCK:
            self.flush()
        if tag in self.hidden:
            del self.hidden[self.hidden.index(tag) :]

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def test_html_blocks_plain_version(spark):
    pages = [page for page, _ in html_text.labelled_pages(200, seed=5)]
    if os.path.isdir(SF):
        pages += [r["html"] for r in queries.table(spark, SF, "pages").collect() if r["html"]]
    for page in pages:
        by_inline = html_text.blocks(page)
        # elements with a hint end a block too, so texts are compared joined, blocks where there is no such inline element
        want = PlainBlocks(page).found
        assert " ".join(b[0] for b in by_inline) == " ".join(want), page[:300]
        if not re.search(r"<(?!/)(button|label|a|b|i|em|span)\b[^>]*", page):
            assert [b[0] for b in by_inline] == want, page[:300]


def other_pages(n, seed):
    """(html, blocks of main text) in families that the labelled pages do not have: tables for layout, sections in sections, definition lists, code, captions, link farms without a name."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        some = lambda lo, hi: " ".join(r.choice(["river", "of", "stone", "the", "walked", "seven", "light", "in", "harbour", "and", "slowly", "again"]) + str(r.randrange(10**6)) for _ in range(r.randint(lo, hi)))
        title, texts, code = some(3, 9), [some(15, 80) for _ in range(r.randint(2, 8))], some(3, 20)
        links = lambda k, sep: sep.join(f"<a href=/l{j}>{some(1, 2)}</a>" for j in range(k))
        farm = links(r.randint(4, 9), r.choice([" | ", " &middot; ", "<br>"]))
        family = i % 4
        if family == 0:
            page = f"<table><tr><td>{farm}</td><td><h1>{title}</h1>{''.join(f'<p>{t}</p>' for t in texts)}</td></tr></table><div>{farm}</div>"
            main = [title, *texts]
        elif family == 1:
            page = f"<div class=topbar>{some(4, 9)}</div><article><section><h1>{title}</h1>{''.join(f'<section><p>{t}</p></section>' for t in texts)}<figure><img src=x><figcaption>{code}</figcaption></figure></section></article><div class='pagination'>{farm}</div>"
            main = [title, *texts, code]
        elif family == 2:
            page = f"<main><h1>{title}</h1><dl>{''.join(f'<dt>{t.split()[0]}</dt><dd>{t}</dd>' for t in texts)}</dl><pre>{code}</pre></main><section class=related>{''.join(f'<h4><a href=q>{some(3, 8)}</a></h4>' for _ in range(4))}</section>"
            main = [title, *(x for t in texts for x in (t.split()[0], t)), code]
        else:
            page = f"<center>{farm}</center><div class='story'><h1>{title}</h1>{''.join(f'<div>{t}</div>' for t in texts)}</div><div class='reader-comments'>{''.join(f'<div>{some(3, 40)}</div>' for _ in range(5))}</div><center>{farm}</center>"
            main = [title, *texts]
        out.append((page, main))
    return out


def test_html_held_out_families():
    """Blocks of pages of families that the tree has not seen."""
    tree = html_text.standard_tree()
    held = html_text.labelled_blocks(other_pages(200, 31))
    right = np.mean([html_text.decide(tree, x) == y for x, y in zip(held, held[:, -1], strict=True)])
    print("held-out families", right)
    assert right > 0.9


def test_html_named_containers():
    """Classes of the page's frame do not make it chrome, and attribute values are no attributes."""
    tree = html_text.standard_tree()
    got = lambda page: html_text.main_text(page, tree)
    long = "word " * 40
    text = long.strip()
    for page in (
        '<body class="no-sidebar"><p>{}</p></body>', '<div id="page" class="has-sidebar"><p>{}</p></div>', '<article class="post has-share"><p>{}</p></article>', '<main class="tags-page"><p>{}</p></main>',
        '<body class="search widget"><article><p>{}</p></article></body>', '<div class="sidebar-left" id="page"><div><article><p>{}</p></article></div></div>', '<div role="main" class="social"><p>{}</p></div>',
        '<article><p title="a hidden gem">{}</p></article>', "<article><p data-x='class=\"ad\" hidden'>{}</p></article>", '<article><p title="x style=display:none y">{}</p></article>',
    ):
        assert got(page.format(long)) == text, page
    for gone in (
        '<div class="sidebar">{}</div>', '<div class="my-ad no-border">{}</div>', '<p hidden>{}</p>', "<p title='x' style='display: none'>{}</p>", '<div class="related"><article>{}</article></div>', '<section id="comments"><article class="comment">{}</article></section>',
    ):
        assert got(f"<article><p>{long}</p></article>" + gone.format("other " * 40)) == text, gone
    assert got(f'<p>{long}</p><div id="comments"><article class="comment"><p>{"other " * 40}</p></article></div>') == text


def test_html_tree():
    """Held-out pages, and what is lost when words and links, or the hints of place, are dealt to other blocks."""
    tree = html_text.standard_tree()
    pages = html_text.labelled_pages(150, seed=99)
    held = html_text.labelled_blocks(pages)
    right = lambda rows: np.mean([html_text.decide(tree, r) == y for r, y in zip(rows, held[:, -1], strict=True)])
    assert right(held) > 0.97
    for columns in ([0, 2, 4], [1, 3, 5], [0, 1, 2, 3, 4, 5], [6, 7]):
        mixed = held.copy()
        mixed[:, columns] = mixed[np.random.default_rng(1).permutation(len(held))][:, columns]
        assert right(mixed) < right(held) - 0.03, columns
    exact = [html_text.main_text(page, tree) == "\n".join(main) for page, main in pages]
    assert np.mean(exact) > 0.6


def test_html_frames_and_omitted_tags():
    tree = html_text.standard_tree()
    long = "word " * 30
    for page in (
        '<body class="page has-sidebar"><main><article><p>{}</p></article></main></body>', "<html><head><title>x</title><body><article>{}</article></body>", "<head><meta charset=x><p>{}",
        '<body><form id="f" action="/"><div id="content"><p>{}</p></div></form></body>', '<article class="post comments-open tags-news">{}</article>', '<article><div class="social-care">{}</div></article>',
        "<article>{}</article><ul><li class=ad><a>one</a><li><a>two</a></ul>", "<table><tr><td>{}</table>", "<dl><dt hidden>x<dd>{}</dl>",
    ):
        assert html_text.main_text(page.format(long), tree) == long.strip(), page


def test_html_long_pages():
    """Time grows with the length: unmatched and deeply nested tags, unclosed quotes, a page of one long text."""
    import time

    tree = html_text.standard_tree()
    n = 40_000
    began = time.perf_counter()
    for page in ("<div>" * n + "</x></section>" * n + "text", "<div class=ad>" * n + "a" + "</div>b" * n, "<ul><li><div>" * n + "<li>x" * n, '<a "' * n + "x>" + "<p '" * n):
        html_text.main_text(page, tree)
    long = "häuser " * 500_000
    assert html_text.main_text(f"<article><p>{long}</p></article>", tree) == long.strip()
    assert time.perf_counter() - began < 60


def test_html_query(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (2, None, "<article><p>Häuser</p></article>", "y"), (2, None, "<article><p>Häuser</p></article>", "y")], "page_id long, url string, html string, text string")
    assert sorted(tuple(r) for r in html_text.extracted(df).collect() if r["url"]) == [(1, "u", "", 0)]
    assert [(r["text"], r["n_chars"]) for r in html_text.extracted(df).where("page_id = 2").collect()] == [("Häuser", 6)] * 2
    assert html_text.extracted(df.limit(0)).collect() == [] and html_text.extracted(df).columns == ["page_id", "url", "text", "n_chars"]


def test_least_loaded():
    items = [(i, s) for i, s in enumerate([7, 7, 6, 6, 5, 5, 4, 4, 4])]
    load = defaultdict(int)
    for k, s in sharding.least_loaded(items, 3).items():
        load[s] += items[k][1]
    assert sorted(load.values()) == [15, 16, 17] or max(load.values()) <= 18


def test_sharding(spark):
    r = random.Random(4)
    texts = [f"text {r.randrange(200)} " * r.randrange(1, 30) for _ in range(600)] + [None, "", None]
    df = spark.createDataFrame([(i if i % 50 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, shard int")
    got = sharding.shards(df).collect()
    assert len(got) == len(texts)
    by, load = defaultdict(list), defaultdict(int)
    for row in got:
        by[row["shard"]].append(row["slot"])
        load[row["shard"]] += row["size"]
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) == set(range(16))
    biggest = max(sum(len(x) + 1 for x in texts if x == t) for t in set(texts) - {None})
    assert max(load.values()) - min(load.values()) <= biggest
    where = {row["doc_id"]: (row["shard"], row["size"], row["text_crc32"]) for row in got if row["doc_id"] is not None}
    groups = defaultdict(set)
    for i, t in enumerate(texts):
        if i in where:
            groups[t].add(where[i][0])
            assert where[i][1:] == (len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode()))
    assert all(len(s) == 1 for s in groups.values())
    assert sharding.shards(df.limit(0)).count() == 0


def test_class_counts():
    """Scheduling by classes of size gives what scheduling one by one gives."""
    r = random.Random(3)
    for _ in range(60):
        shards, top = r.randrange(1, 9), r.choice([3, 30, 3000])
        sizes = sorted({r.randrange(1, top): r.choice([1, 2, 7, 40, 300]) for _ in range(r.randrange(1, 12))}.items(), reverse=True)
        items = [size for size, n in sizes for _ in range(n)]
        placed = sharding.least_loaded(list(enumerate(items)), shards)
        want = {size: [0] * shards for size, _ in sizes}
        for key, s in placed.items():
            want[items[key]][s] += 1
        assert sharding.class_counts(sizes, shards) == list(want.values())
    many = sharding.class_counts([(10**11, 1), (100, 10**9), (1, 10**13 + 5)], 16)
    assert [sum(x) for x in many] == [1, 10**9, 10**13 + 5]
    loads = [sum(n * k[s] for n, k in zip((10**11, 100, 1), many)) for s in range(16)]
    assert max(loads) - min(loads) <= 1
    assert sharding.class_counts([], 4) == []


@pytest.mark.parametrize("limits", [{}, {"RANKED": 8, "BROADCAST_SIZES": 0, "HOT": 4}])
def test_sharding_brute_force(spark, monkeypatch, limits):
    """Each shard gets as many groups of each size as by the plain schedule of all groups; also with large classes, joins without a broadcast and few hot texts."""
    for name, value in limits.items():
        monkeypatch.setattr(sharding, name, value)
    r = random.Random(9)
    texts = [f"{r.randrange(400):03d}" + "x" * r.choice([0, 0, 0, 1, 2, 50]) for _ in range(1500)] + ["same"] * 700 + ["y" * 5000, None, None, "", "é"]
    df = spark.createDataFrame([(i, t, "a", 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, group string, copies int, part int")
    size, shard_of = defaultdict(int), {}
    for t in texts:
        size[t] += len((t or "").encode()) + 1
    for x in sharding.shards(df, 7).collect():
        assert shard_of.setdefault(texts[x["doc_id"]], x["shard"]) == x["shard"]
    of = sorted(size.values(), reverse=True)
    plain = [(of[k], s) for k, s in sharding.least_loaded(list(enumerate(of)), 7).items()]
    assert sorted((size[t], s) for t, s in shard_of.items()) == sorted(plain) and len(plain) == len(set(texts))


def test_sharding_small_groups(spark):
    """Many small groups and one large: whole groups, gapless slots and near-equal shards."""
    r = random.Random(5)
    texts = [f"text {r.randrange(900)} " * (1 + r.randrange(900) % 7) for _ in range(3000)] + ["big " * 3000] * 3 + [None, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sharding.shards(df).collect()
    groups, slots, load = defaultdict(set), defaultdict(list), defaultdict(int)
    for x in got:
        groups[texts[x["doc_id"]]].add(x["shard"])
        slots[x["shard"]].append(x["slot"])
        load[x["shard"]] += x["size"]
    assert len(got) == len(texts) and all(len(v) == 1 for v in groups.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len(load) == 16
    total, lone = sum(load.values()), 3 * (len("big " * 3000) + 1)
    rest = sorted(load.values())[:-1]
    assert max(load.values()) == lone and max(rest) - min(rest) <= total / 16


def plain_url(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = re.split(r"[?#]", url.split("://", 1)[1])[0]
    host, slash, path = rest.partition("/")
    host, path = "".join(c.lower() if c.isascii() else c for c in host), slash + path
    fits = [(len(h + p), v, h + p) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else None
    return host, path, best and best[2], best[1] if best else "allow"


def test_urls(spark):
    some = ["http://a.example.org/es/1", "https://EXAMPLE.org/en/12?x=/es/", "http://example.org", "x://b.com/de/#/fr/", "ftp://www.z.com/fr/q", "no scheme.org/es/", None, "", "http://notexample.org/es/", "http://org/", "://example.org/en/1", "http://ä.ORG/é?ü", "http://a.com/de", "http://" + "s." * 300 + "com/de/x" + "y" * 5000]
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(some * 2)] + [(None, some[0], "r")], "page_id long, url string, rule string")
    got = urls.judged(df, urls.listed(spark)).collect()
    assert len(got) == 2 * len(some) + 1
    assert all(tuple(r)[1:] == plain_url(some[r["page_id"] % len(some)]) for r in got if r["page_id"] is not None)
    none = urls.judged(df, urls.listed(spark).limit(0)).collect()
    assert {r["verdict"] for r in none} == {"allow"} and urls.judged(df.limit(0), urls.listed(spark)).count() == 0


def test_urls_of_very_long_hosts(spark):
    """Only as many of a host's last labels are looked up as some rule's host has."""
    rules = [("block", "example.org", "/"), ("block", "a.b.Example.COM", "/x"), ("allow", "É.net", "/")]
    long = "s." * 100_000
    some = [f"http://{long}example.org/", f"http://{long}b.example.com/x", f"http://{long}a.b.example.com/x", "http://org/", f"http://{long}É.NET/", "http://é.net/", "http://example.org./", "http://./x"]
    pages = spark.createDataFrame(list(enumerate(some)), "page_id long, url string")
    found = {r["page_id"]: r["rule"] for r in urls.judged(pages, urls.listed(spark, rules)).collect()}
    assert found == {0: "example.org/", 1: None, 2: "a.b.example.com/x", 3: None, 4: "É.net/", 5: None, 6: None, 7: None}


def test_url_bloom_lets_all_listed_through(spark):
    rules = [("block", f"h{i}.net", f"/p{i % 7}/") for i in range(3000)] + [("block", None, "/"), ("block", "h1.net", "/p1/")]
    pages = spark.createDataFrame([(i, f"http://www.h{i}.net/p{i % 7}/x") for i in range(3500)], "page_id long, url string")
    got = urls.judged(pages, urls.listed(spark, rules))
    assert got.where("verdict = 'block'").count() == 3000


def test_urls_large_lists(spark, monkeypatch):
    """Shuffle joins instead of broadcasts and a full Bloom filter give the same; equal lengths: block first, then the greater text."""
    r = random.Random(6)
    rules = [(r.choice(["allow", "block"]), f"h{i % 40}.net", r.choice(["/", "/a", "/a/b", "/p1/"])) for i in range(120)] + [("allow", "net", "/x/y"), ("block", "h1.net", "/z")]
    some = [f"http://{r.choice(['', 'www.', 'a.b.'])}h{r.randrange(60)}.NET{r.choice(['', '/', '/a', '/a/b/c', '/p1/q', '/x/yz', '/zz'])}" for _ in range(300)] + [None, "x"] * 50
    pages = spark.createDataFrame(list(enumerate(some)), "page_id long, url string")

    def plain(url):
        if not url or "://" not in url:
            return None, "allow"
        host, slash, path = url.split("://", 1)[1].partition("/")
        fits = [(len(h + p), v, h + p) for v, h, p in rules if (host.lower() == h or host.lower().endswith("." + h)) and (slash + path).startswith(p)]
        return (max(fits)[2], max(fits)[1]) if fits else (None, "allow")

    want = {i: plain(u) for i, u in enumerate(some)}
    judged = lambda: {x["page_id"]: (x["rule"], x["verdict"]) for x in urls.judged(pages, urls.listed(spark, rules)).collect()}
    assert judged() == want
    for name, value in (("BROADCAST_RULES", 0), ("BROADCAST_HITS", 0), ("MOST_BLOCKS", 1)):
        monkeypatch.setattr(urls, name, value)
    assert judged() == want and len({x for x in want.values()}) > 20


def test_folding():
    assert toxicity.folded("Tr4sh, ТRASH! ｔrash $tupid l0$er a$$$ 12") == " trash trash trash stupid loser a i "[:-3] + toxicity.folded("12")
    assert toxicity.folded(None).strip() == "" == toxicity.folded("").strip()
    match = toxicity.automaton({" trash ": 5.0, " trash can ": 0.0, " scum": 4.0})
    assert toxicity.features(match, toxicity.folded("a trash can"))[1] == 0.0
    assert toxicity.features(match, toxicity.folded("scummy trash"))[1] == pytest.approx(np.log1p(9.0))


def naive_features(weights, text):
    """The lexicon by trying every entry at every word."""
    total, covered = 0.0, -1
    for at in [i for i, c in enumerate(text[:-1]) if c == " "]:
        fits = [p for p in weights if text.startswith(p, at)]
        if not fits:
            continue
        p = max(fits, key=len)
        if at >= covered:
            total += weights[p]
        if weights[p] == 0.0:
            covered = max(covered, at + len(p) - 1)
    n = max(len(text.split()), 0)
    return 100 * total / (n + 30), np.log1p(total), np.log1p(n)


def test_toxicity_naive_matcher():
    r = random.Random(9)
    letters = "abc"
    for _ in range(60):
        word = lambda k: "".join(r.choice(letters) for _ in range(k))
        weights = {f" {word(r.randrange(4, 7))}{r.choice(['', ' '])}": r.choice([0.0, 1.5, 2.0]) for _ in range(40)} | {f" {word(4)} {word(3)} ": 0.0 for _ in range(10)}
        match = toxicity.automaton(weights)
        for _ in range(20):
            text = toxicity.folded(" ".join(word(r.randrange(1, 9)) for _ in range(r.randrange(0, 60))))
            assert toxicity.features(match, text) == pytest.approx(naive_features(weights, text))


def test_toxicity_labelled_bytes(spark, monkeypatch):
    """A bound on the bytes of labelled texts leaves out whole texts; repeated ids are scored each."""
    rows = [(i, f"plain words number {i} " * 3 + ("gnarfel " * 3 if i % 2 else "")) for i in range(300)]
    docs = spark.createDataFrame(rows + [(5, "gnarfel gnarfel gnarfel"), (5, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "LABELLED_BYTES", 8000)
    got = toxicity.scored(docs, labels)
    assert got.count() == 302 and sorted(x["toxicity"] > 0.5 for x in got.where("doc_id = 5").collect()) == [False, True, True]
    monkeypatch.setattr(toxicity, "LABELLED_BYTES", 0)
    assert {x["toxicity"] for x in toxicity.scored(docs, labels).collect()} == {0.0}


def test_toxicity_learns(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(500):
        w = [f"word{r.randrange(400)}" for _ in range(r.randrange(20, 80))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                w[r.randrange(len(w))] = r.choice(["gnarf", "blorgish", "Bl0rgish"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "gnarf " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("s"))
    table = spark.createDataFrame(labels + [(None, 1), (3, None), (4, 1), (4, 0), (99999, 1)], "doc_id long, toxic int")
    got = {x["doc_id"]: x["toxicity"] for x in toxicity.scored(docs, table).collect()}
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((got[i] >= 0.7) == (i % 4 == 0) for i in held)
    assert right / len(held) > 0.95 and got[1002] > 0.7 and got[1000] == got[1001] < 0.5
    assert {x["toxicity"] for x in toxicity.scored(docs.limit(3), table.limit(0)).collect()} == {0.0}
    assert toxicity.without_toxic(docs, table).columns == docs.columns


def test_mixing(spark):
    r = random.Random(3)
    vocabulary = {"a": [f"alpha{i}" for i in range(50)], "b": [f"beta{i}" for i in range(50)], "c": [f"gamma{i}" for i in range(50)]}
    rows = []
    for i in range(600):
        d = "a" if i % 6 < 4 else "b" if i % 6 == 4 else "c"
        rows.append((i, " ".join(r.choice(vocabulary[d]) for _ in range(r.randrange(5, 60))), d))
    docs = spark.createDataFrame(rows + [(700, None, "a"), (701, "", None)], "doc_id long, text string, posterior string")
    labelled = docs.where("doc_id % 5 = 0").select("text", F.col("posterior").alias("domain"))
    got = {x["doc_id"]: x for x in mixing.mixed(docs, labelled).collect()}
    assert sum(got[i]["domain"] == d for i, _, d in rows) > 590 and got[700]["rate"] == 1.0 and got[701]["n_tokens"] == 0
    assert all(x["copies"] >= 1 and abs(x["copies"] - x["rate"]) < 1 for x in got.values())
    known, domains = mixing.posteriors(docs.drop("posterior"), labelled)
    _, totals = mixing.fitted_rates(known, domains, {"a": 0.2, "b": 0.5, "c": 0.3}, least=0.0)
    assert domains == ["a", "b", "c"] and all(abs(t - x) <= 1e-4 * sum(v[0] for v in totals.values()) for t, x in totals.values())
    drawn = mixing.drawn(docs, labelled)
    assert drawn.columns == docs.columns and drawn.count() == sum(x["copies"] for x in got.values())
    assert mixing.mixed(docs, labelled.limit(0)).select("domain", "rate").distinct().collect() == [("none", 1.0)]
    assert mixing.mixed(docs.limit(0), labelled).count() == 0


def test_mixing_plain_version(spark):
    """The fit against least squares over all documents; one domain, ties, repeated ids and targets that cannot be met."""
    r = np.random.default_rng(5)
    n, p = r.integers(1, 200, 400), r.dirichlet([0.5, 0.3, 0.2], 400)
    known = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n_tokens long, posterior array<double>")
    rate, totals = mixing.fitted_rates(known, ["a", "b", "c"], {"a": 0.25, "b": 0.35, "c": 0.4}, least=0.0)
    rates = np.array([x["r"] for x in known.select(rate(F.col("posterior")).alias("r")).collect()])
    assert rates.min() >= 0 and np.allclose((rates[:, None] * n[:, None] * p).sum(0), np.array([0.25, 0.35, 0.4]) * n.sum(), rtol=1e-4)
    assert all(totals[d][1] == pytest.approx(x, rel=1e-4) for d, x in zip("abc", (rates[:, None] * n[:, None] * p).sum(0)))
    # all posteriors equal: no weights other than theirs can be met, and the totals tell
    flat = spark.createDataFrame([(10, [0.5, 0.5])] * 20, "n_tokens long, posterior array<double>")
    _, totals = mixing.fitted_rates(flat, ["a", "b"], {"a": 0.9, "b": 0.1}, least=0.0)
    assert totals["a"][0] == pytest.approx(180) and totals["a"][1] == pytest.approx(totals["b"][1], rel=1e-6)
    docs = spark.createDataFrame([(1, "x y z"), (1, "x y z"), (1, "q " * 50000), (2, None)], "doc_id long, text string")
    one = mixing.mixed(docs, spark.createDataFrame([("x y", "only")], "text string, domain string")).collect()
    assert len(one) == 4 and {x["domain"] for x in one} == {"only"} and {x["rate"] for x in one} == {1.0}
    # a tie of posteriors goes to the first domain in order
    tie = mixing.mixed(docs, spark.createDataFrame([("u", "b"), ("v", "a")], "text string, domain string")).where("n_tokens = 3").collect()
    assert {x["domain"] for x in tie} == {"a"}


@needs_tables
def test_pipeline(spark):
    import corpus_pipeline

    docs = queries.table(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    ids = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, SF)
        if name != "sharding":
            assert found.columns == docs.columns
            docs = mixing.stored(found)
            now = {r["doc_id"] for r in docs.collect()}
            assert now == ids if name == "mixing" else now <= ids
            ids = now
    assert len(ids) < queries.table(spark, SF, "documents").count()
    assert {r["doc_id"] for r in found.collect()} == ids
    for name, make in queries.QUERIES.items():
        assert re.fullmatch(r"op\d+_\w+", name) and callable(make)


@needs_tables
def test_pipeline_odd_rows(spark, tmp_path):
    """Null rows, repeated ids and columns whose names the operators use; then empty tables."""
    import corpus_pipeline as c

    docs = queries.table(spark, SF, "documents").limit(60)
    odd = docs.union(docs.limit(2)).union(spark.createDataFrame([(None, None, None, None, None), (None, "some words here", "en", None, 3), (10**9, "", None, "s", 0)], docs.schema))
    names = ["__lost", "__node", "h", "shingles", "size", "shard", "copies", "posterior", "node", "part"]
    odd = odd.withColumns({x: F.lit(1) for x in names})
    for name, rows in (("odd", odd), ("empty", odd.limit(0))):
        where = f"{tmp_path}/{name}"
        rows.write.parquet(f"{where}/documents.parquet")
        for t in ("labels", "benchmark"):
            (queries.table(spark, SF, t).limit(0) if name == "empty" else queries.table(spark, SF, t)).write.parquet(f"{where}/{t}.parquet")
        given = queries.table(spark, where, "documents")
        for step, stage in c.STAGES[:-1]:
            given = mixing.stored(stage(spark, given, where))
            assert given.columns == rows.columns, step
        found = c.shard(spark, given, where)
        assert found.count() == given.count() and (name == "empty") == (found.count() == 0)
        assert sum(x["doc_id"] is None for x in found.collect()) >= 2 * (name == "odd")


@needs_tables
def test_stages_against_plain_versions(spark):
    import corpus_pipeline as c
    from llm.test_near_duplicates import classes, shingles, similar

    docs = queries.table(spark, SF, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    scores = {r["doc_id"]: r["score"] for r in queries.op10_toxicity(spark, SF).collect()}
    assert ids(c.reject_toxic(spark, docs, SF)) == sorted(i for i, x in scores.items() if x < 0.7)
    sets = {i: shingles(t, 5) for i, t in texts.items()}
    top = classes(sets, similar(sets))
    assert ids(c.drop_near_duplicates(spark, docs, SF)) == sorted(i for i in top if top[i] == i) != sorted(texts)
    words = lambda t: tuple(re.findall(r"\w+", t.lower()))
    items = [words(r["text"]) for r in queries.table(spark, SF, "benchmark").collect()]
    grams = {i[a : a + 13] for i in items for a in range(len(i) - 12)} | {i for i in items if 5 <= len(i) < 13}
    split = {i: words(t) for i, t in texts.items()}
    clean = [i for i, w in split.items() if not any(w[a : a + n] in grams for n in range(5, 14) for a in range(len(w) - n + 1))]
    assert ids(c.decontaminate(spark, docs, SF)) == sorted(clean) != sorted(texts)
    copies = {r["doc_id"]: r["copies"] for r in queries.op2_mixing(spark, SF).collect()}
    assert ids(c.mix(spark, docs, SF)) == sorted(i for i, n in copies.items() for _ in range(n))
    load = defaultdict(int)
    for r in c.shard(spark, docs, SF).collect():
        load[r["shard"]] += r["size"]
    assert sum(load.values()) == sum(len(t.encode()) + 1 for t in texts.values()) and len(load) == 16


def test_decontamination_every_item(spark):
    """Items of any length are found, with `shortest` 1; an opening name may change, a word that opens many sentences may not."""
    items = {1: "what is the capital", 2: "3 4 5 6 7 of 8 9 10", 3: "Alice buys 3 apples for 2 dollars", 4: "photosynthesis", 5: "Ada Lovelace", 6: "Find the capital of Peru", 7: ""}
    docs = {1: "so what is the capital?", 2: "it reads 3 4 5 6 7 of 8 9 10 there", 3: "Brian buys 7 apples for 9 dollars", 4: "About Photosynthesis.", 5: "by ADA LOVELACE (1815)", 6: "Find the capital of Chile", 11: "what is a capital", 12: "3 4 5 6 8 of 8 9 10", 13: "Brian sells 7 apples for 9 dollars", 14: "synthesis", 15: "Ada and Lovelace", 16: "Sketch the capital of Chile"}
    df = lambda rows, schema: spark.createDataFrame(list(rows.items()), schema)
    texts, bench = df(docs, "doc_id long, text string"), df(items, "item_id long, text string")
    got = {r["doc_id"]: (r["item_id"], r["n_windows"]) for r in decontamination.contaminated(texts, bench, shortest=1).collect()}
    assert got == {i: (i, 1) for i in range(1, 7)}
    # ids that repeat, null ids, ties of items and clashing columns
    rows = [(1, docs[3], "a"), (1, "clean", "b"), (None, docs[3], "c"), (None, "clean", "d"), (2, None, "e")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    twice = spark.createDataFrame([(9, items[3]), (8, "Carl buys 4 apples for 5 dollars"), (None, items[3])], "item_id long, text string")
    assert [tuple(r) for r in decontamination.contaminated(odd, twice).collect()] == [(1, 8, 1)]
    left = lambda **kw: sorted(r["item_id"] for r in decontamination.without_contaminated(odd, twice, **kw).collect())
    assert left() == ["c", "d", "e"] and left(null_ids=True) == ["d", "e"]


def test_decontamination_joins_without_broadcast(spark, monkeypatch):
    """The shuffle joins of a large benchmark give the same."""
    r = random.Random(8)
    items = [(i, " ".join(r.choice(["Bob", "Ann", "7", "12", "km", "apples", "of", "are", "left"]) for _ in range(r.randrange(1, 20)))) for i in range(80)]
    docs = [(i, " ".join(r.choice(items)[1] if r.random() < 0.3 else "plain words here" for _ in range(4))) for i in range(200)]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = lambda: (sorted(decontamination.contaminated(docs, items, shortest=1).collect()), sorted(decontamination.without_contaminated(docs, items, shortest=1).collect()))
    want = found()
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(decontamination, "BROADCAST_IDS", 0)
    assert found() == want and want[0] and want[1]


def plain_template_matches(docs, items):
    """(doc, item) pairs of the template rules, written without hashes: for items of 5 to 13 words of ASCII letters and digits."""

    def readings(text):
        words = re.findall(r"\w+|[.!?:\n]", text)
        tokens, opens, start = [], [], True
        for w in words:
            if re.match(r"\w", w):
                tokens.append(w)
                opens.append(start)
            start = not re.match(r"\w", w)
        number = [t.isdigit() for t in tokens]
        unit = [i > 0 and number[i - 1] and t.lower() in decontamination.UNITS for i, t in enumerate(tokens)]
        name = [len(t) > 1 and t[0].isupper() and t[1].islower() for t in tokens]
        listed = [t.lower() in decontamination.OPENERS for t in tokens]
        for units, names in (([u and not o for u, o in zip(unit, opens)], [n and not o for n, o in zip(name, opens)]), (unit, [n and not x for n, x in zip(name, listed)]), (unit, [False] * len(tokens)), (None, None)):
            yield [("" if units is None else "#" if number[i] else "U" if units[i] else "N" if names[i] else "", t.lower()) for i, t in enumerate(tokens)]

    out = set()
    for i, item in items:
        mine = list(readings(item))
        for d, text in docs:
            for x, y in zip(mine, readings(text), strict=True):
                k = min(13, len(x))
                for p in range(len(x) - k + 1):
                    one = x[p : p + k]
                    if 2 * sum(kind in ("#", "N") for kind, _ in one) > k:
                        continue
                    for q in range(len(y) - k + 1):
                        two = y[q : q + k]
                        if all(a[0] == b[0] and (a[0] or a[1] == b[1]) for a, b in zip(one, two)):
                            pairs = {(a[1], b[1]) for a, b in zip(one, two) if a[0]}
                            if len(pairs) == len({a for a, _ in pairs}):
                                out.add((d, i))
    return out


def test_decontamination_templates_brute_force(spark):
    r = random.Random(12)
    some = ["Bob", "Alice", "Lima", "7", "12", "305", "km", "days", "apples", "walks", "to", "buys", "left", "What", "is", "now", "the", "at"]
    items = [(i, " ".join(r.choice(some) + r.choice(["", "", "", "."]) for _ in range(r.randrange(5, 17)))) for i in range(40)]

    def changed(text):
        swap = {w: r.choice(["Carol", "Dave", "Rome"]) if w[0].isupper() and w != "What" else str(r.randrange(99)) if w.isdigit() else w for w in set(re.findall(r"\w+", text))}
        return re.sub(r"\w+", lambda m: swap[m[0]], text)

    docs = [(d, f"so {changed(r.choice(items)[1])} . then {changed(r.choice(items)[1])}") for d in range(150)]
    want = defaultdict(set)
    for d, i in plain_template_matches(docs, items):
        want[d].add(i)
    found = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), shortest=5)
    assert {x["doc_id"]: x["item_id"] for x in found.collect()} == {d: min(x) for d, x in want.items()} and len(want) > 60


def thue_morse(n, a, b):
    """A pattern whose polynomial hashes modulo a power of two collide with those of its mirror."""
    return [(a, b)[bin(i).count("1") % 2] for i in range(n)]


def test_hashes_of_patterned_words_and_texts(spark):
    import pyarrow as pa

    from hopwise.llm import minhash, substrings

    one, two = "".join(thue_morse(2048, "a", "b")), "".join(thue_morse(2048, "b", "a"))
    _, words = next(iter(hashing.chunks(pa.array([" ".join([one, two, *thue_morse(4096, "x", "y"), *thue_morse(4096, "y", "x")])]))))
    for second in (False, True):
        h = words.level(0, second)
        assert h[0] != h[1] and words.spans(np.array([2]), np.array([4098]), second) != words.spans(np.array([4098]), np.array([8194]), second)
    docs = spark.createDataFrame([(i, f"{w} " + " ".join(f"w{j}" for j in range(60 if k else 3))) for k in (0, 1) for i, w in ((2 * k, one), (2 * k + 1, two))], "doc_id long, text string")
    assert {r["doc_id"] for r in minhash.near_duplicates(docs.where("doc_id < 2")).where("kept").collect()} == {0, 1}
    assert [r["n_removed"] for r in substrings.without_repeats(docs.where("doc_id > 1")).orderBy("doc_id").collect()] == [0, 60]
    item = spark.createDataFrame([(1, one)], "item_id long, text string")
    assert [r["doc_id"] for r in decontamination.contaminated(docs, item, shortest=1).orderBy("doc_id").collect()] == [0, 2]
