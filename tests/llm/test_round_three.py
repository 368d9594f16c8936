"""Fill-in-middle, HTML extraction and the filter audit against plain Python."""

import hashlib
import html
import itertools
import random
import re

import pyarrow as pa
import pytest

from quire.llm import extraction, filter_audit, fim, wordhash, wrappers
from tests.llm.conftest import prose, rows_of

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)
SPACES = re.compile(r"[\x20\x09-\x0D]+")


def key(x):
    return tuple((v is None, str(v)) for v in x)


# fill-in-middle


def example(doc_id, text):
    text = text or ""
    u = UNIT.findall(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(u), "plain", None, None, text
    i, j = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:i]), "".join(u[i:j]), "".join(u[j:])
    if h4 % 100 < 20:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, odd_docs):
    extra = [(50 + i, t, "e", "s", 1, "n", "k", 1, "l", 2, "y", 3) for i, t in enumerate(["a<P>b", "<", "S><S", "x" * 300_000, "é" * 700, prose(4000, 3)] * 6)]
    docs = odd_docs.union(spark.createDataFrame(extra, odd_docs.schema))
    out = fim.fill_in_middle(docs)
    got = out.withColumn("text", fim.restored(out.output, out.form)).collect()
    want = [(i, *example(i, t), t or "") for i, t in rows_of(docs)]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_empty(no_docs):
    assert fim.fill_in_middle(no_docs).collect() == []


def test_chunks_are_shared_and_counts_combine():
    rng = random.Random(5)
    passage = prose(3000, 9)
    texts = ["".join(rng.choice(["a", "Zz", "é", "😀", " ", "\n", "9", "x" * 40]) for _ in range(rng.choice([0, 1, 16, 17, 900]))) for _ in range(120)]
    texts += ["q " + passage, "other words " + passage, "ab " * 20_000]
    memo = fim.ChunkMemo()
    for lo, hi, data, off in wordhash.blocks(pa.array(texts)):
        index = fim.UnitIndex(data, off, memo)
        for r in range(hi - lo):
            t = texts[lo + r]
            u = UNIT.findall(t)
            assert index.n_units(r) == len(u)
            for k in {0, len(u), len(u) // 2, rng.randint(0, len(u))}:
                n = len("".join(u[:k]))
                assert index.locate(r, k) == (len(t[:n].encode()), n)
    assert memo.hits > 50  # the passage's chunks, wherever it stands


def test_memo_compares_content_and_stays_bounded():
    memo = fim.ChunkMemo(memo_bytes=100)
    assert memo.summary(1, b"ab cd") == (3, 5, True, True)
    assert memo.summary(1, b"1 2") == (3, 3, False, False)  # the same fingerprint, another content
    for i in range(50):
        memo.summary(10 + i, b"x" * 30)
    assert memo.used <= 100 and sum(len(c) for c, _ in memo.kept.values()) == memo.used


# filter audit


def audit(docs, labels):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    rows = []
    for i, t, lang in docs:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t],
        }
        mine = [x for x in labels if i is not None and x[0] == i]
        rows.append((lang or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = []
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        total, steps = dict.fromkeys("ABCDE", 0), []
        for order in itertools.permutations("ABCDE"):
            left = mine
            for n, f in enumerate(order):
                gone = [r for r in left if r[1][f]]
                before = [r for r in mine if all(r is not x for x in left)]
                left = [r for r in left if not r[1][f]]
                total[f] += len(gone)
                steps.append((
                    part, "".join(order), n + 1, len(left), len(gone), sum(r[1][f] for r in before),
                    sum(r[1][f] and sum(r[1].values()) == 1 for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone), f,
                ))
        out += [(*s[:-1], total[s[-1]]) for s in steps]
    return out


def test_filter_audit(spark, odd_docs):
    rng = random.Random(2)
    texts = [prose(150, 1), prose(150, 2), prose(120, 3) + " # x", "ABC " * 130, "Aa " + prose(99, 4), prose(40, 5).upper(), None, "", "\x0b\x0c"]
    more = [(100 + i, rng.choice(texts), rng.choice(["en", None, "", "de"]), "s", 1, "n", "k", 1, "l", 2, "y", 3) for i in range(80)]
    docs = odd_docs.union(spark.createDataFrame(more, odd_docs.schema))
    marks = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(180) if i % 3] + [(100, 1, 0), (None, 1, 1), (101, None, None)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = [tuple(r) for r in filter_audit.audit_filters(docs, labels).collect()]
    want = audit([(r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect()], marks)
    assert sorted(got) == sorted(want)


def test_filter_audit_empty(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(no_docs, labels).collect() == []


# HTML extraction


def page(host, no, body, head="<title>T</title>"):
    return no, f"https://{host}/x/{no}?q=a/b", f"<!DOCTYPE html><html><head>{head}<script>var a='</p><article>no</article>';</script></head><body>{body}</body></html>"


def blocks(*texts):
    return "\n\n".join(SPACES.sub(" ", html.unescape(t)).strip(" ") for t in texts)


PAGES = "page_id long, url string, html string, text string, host string, `shape` int"


def extracted(spark, rows):
    df = spark.createDataFrame([(i, u, h, "clash", "h", 1) for i, u, h in rows], PAGES)
    out = extraction.extract_main_text(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = {}
    for r in out.collect():
        assert r.n_chars == len(r.text)
        got.setdefault(r.page_id, []).append(r.text)
    assert sum(map(len, got.values())) == len(rows)
    return {k: v[0] for k, v in got.items() if len(set(v)) == 1}


def test_articles_of_messy_pages(spark):
    rows, want = [], {}
    rng = random.Random(3)
    for no in range(60):
        paras = [prose(rng.randint(3, 30), no * 50 + k) for k in range(rng.randint(0, 6))]
        marked = [f"<p><b>{p}<br>&amp; more&nbsp;x</b>" if rng.random() < 0.4 else f"<p class=c{no}>{p}</p>\n " for p in paras]
        shown = [p + " & more\xa0x" if m.startswith("<p><b>") else p for p, m in zip(paras, marked)]
        nav = "".join(f"<li><a href='/{k}'>{prose(1, k)}</a>" for k in range(rng.randint(1, 9)))
        notice = '<div class="cookie-notice">We use cookies</div>' if no % 3 else ""
        body = (
            f"<nav><ul>{nav}</ul></nav>{notice}<div class='ad'>buy {no}</div><article><h1>Title &lt;{no}&gt;</h1>{''.join(marked)}"
            f"<aside>aside {no}</aside><form><p>name</p></form><div class='sponsored'>s {no}</div></article>"
            f"<section id='comments'><article class='comment'><p>nice {no}</p></article></section><footer>&copy; {no}</footer>"
        )
        if no % 7 == 0:
            body = body.split("<footer>")[0] + "<footer>cut <a hre"  # a truncated page
        rows.append(page("a.example" if no % 4 else "b.example", no, body))
        want[no] = blocks(f"Title &lt;{no}&gt;", *shown)
    rows += rows[:5]
    assert extracted(spark, rows) == want


def test_hosts_without_article_elements(spark):
    rows, want = [], {}
    for no in range(12):
        paras = [prose(12, no * 20 + k) for k in range(2 + no % 3)]
        body = (
            "<div class='top'><span>The Daily Page</span></div><div id='left'><ul><li><a href='/'>Home</a><li><a href='/n'>News</a></ul></div>"
            f"<div class='content-{no}'><h2>About {no}</h2>" + "".join(f"<p>{p}" for p in paras) + "<p>Follow us for more.</div>"
            "<div>All rights reserved</div>"
        )
        rows.append(page("c.example", no, body))
        want[no] = blocks(f"About {no}", *paras, "Follow us for more.")
    assert extracted(spark, rows) == want


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "deep text" + "</div>" * 3000
    rows = [
        (1, None, None), (2, "not a url", ""), (None, None, "plain  text\n only &lt;b&gt;"), (4, "http://x.example/", deep),
        (5, "http://y.example", "<article>a < b and 3<4 <p title='open>x</p><p>last"), (6, "http://z.example/1", "<article><p>" + "word " * 200_000 + "</p></article>"),
        (7, "http://w.example/1", "<html><body><nav>menu only</nav></body></html>"), (8, "http://v.example", "<article><header><p>by me</p><h1>Head</h1></header><p>x<!-- no --><i>y</i></p></article>"),
        (9, "http://u.example", "<form><main><p>in a form</p></main></form>"), (10, "http://t.example", "<main><p>lead</p><article><p>one</p></article></main>"),
        (11, "http://s.example", "a<2 " * 2000), (12, "http://r.example", "<a '\">" * 2000),
    ]
    got = extracted(spark, rows)
    assert got[1] == got[2] == got[7] == "" and got[None] == "plain text only <b>" and got[4] == "deep text"
    assert got[5].startswith("a < b and 3<4") and got[5].endswith("last") and got[6] == ("word " * 200_000).strip()
    assert got[8] == "Head\n\nxy" and got[9] == "in a form" and got[10] == "one" and got[11] == ("a<2 " * 2000).strip()
    assert extraction.extract_main_text(spark.createDataFrame([], PAGES)).collect() == []


@pytest.mark.parametrize("partitions", [1, 7])
def test_wrapper_does_not_depend_on_partitions(spark, partitions):
    rows = [page("d.example", n, "<article>" + "<h2>t</h2><p>a</p><p>b</p>" * (n % 4) + ("<div>x</div>" if n % 3 else "") + f"<p>{n}</p></article>") for n in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(partitions)
    (row,) = extraction.infer_wrappers(df).collect()
    assert row.n_pages == 300
    assert row.expression == "<html><head></><body><article>(<h2>=</>(<p>#</>)+)*(<div>=</>)?(<p>#</>)?</></></>"


def test_alignment_finds_options_repeats_and_slots():
    a, b = (wrappers.read_page(f"<div>{x}</div>")[0] for x in ("<h1>same</h1><p>1</p><p>2</p><p>3</p>", "<h1>same</h1><hr><ul><li>x</ul><p>4</p>"))
    assert wrappers.regex(wrappers.align(a, b)) == "<div><h1>=</>(<ul><li>=</></>)?(<p>#</>)+</>"
