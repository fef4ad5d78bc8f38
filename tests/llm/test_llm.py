"""Each operator against a plain Python version, and on nulls, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import bwt, chat, common, jaccard, langid, leaks, mix, pages, place, quality, queries, simple8b, suffix, tokens

DOCS = "doc_id long, text string, lang string, source string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sentence(rng, n, lang="ab"):
    parts = [x + y for x in "bdfgk" for y in "aeiou"] if lang == "ab" else [x + y for x in "zxvwq" for y in "äöüéè"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Ordinary, copied, changed, empty, null and repeated documents."""
    rng = random.Random(3)
    out = []
    for i in range(40):
        out.append((i, sentence(rng, rng.choice([1, 2, 3, 25, 60, 200]), "ab" if i % 2 else "zx"), "ab" if i % 2 else "zx", f"s{i % 4}"))
    base = sentence(rng, 150)
    out += [(100 + i, base, "ab", "s0") for i in range(5)]
    for i in range(6):
        changed = base.split(" ")
        changed[10 + 7 * i] = "other"
        out.append((110 + i, " ".join(changed), "ab", "s0"))
    out += [(200, None, "ab", "s1"), (201, "", None, None), (202, " \n\t ", "zx", None), (203, "12 34 --", None, "s1")]
    out += [(None, base[:500], "ab", "s2"), (5, sentence(rng, 30), None, "s2"), out[7], out[7]]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, i, "x", 0.5) for i, r in enumerate(rows)],
                                 DOCS + ", n long, size string, score double").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def grams(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def plain_components(rows, k, percent):
    sets = [grams(r[1], k) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    return sorted(((r[0], len(s), least[g] if s else r[0]) for r, s, g in zip(rows, sets, group, strict=True)), key=str)


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard(docs, none, rows, k, percent):
    found = jaccard.components(docs, k, percent)
    assert sorted(map(tuple, found.collect()), key=str) == plain_components(rows, k, percent)
    assert jaccard.components(none, k, percent).count() == 0


def test_jaccard_large_groups(spark):
    """Hubs, bands and the pairs between components, with small blocks; half of the family is just too far from its base."""
    rng = random.Random(5)
    base = sentence(rng, 120).split(" ")
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(rng.randint(0, 5)):
            text[rng.randrange(len(text))] = sentence(rng, 1)
        if rng.random() < 0.3:
            text += "the line that many have".split(" ")
        rows.append((i, " ".join(text), "", ""))
    docs = spark.createDataFrame(rows, DOCS)
    old, jaccard.BLOCK = jaccard.BLOCK, 20
    try:
        assert sorted(map(tuple, jaccard.components(docs, 3, 90).collect()), key=str) == plain_components(rows, 3, 90)
    finally:
        jaccard.BLOCK = old


def test_representatives(docs, rows):
    kept = [(r.doc_id, r.text) for r in jaccard.representatives(docs).collect()]
    comps = plain_components(rows, 5, 80)
    assert len(kept) == len(set(kept))
    assert {i for i, t in kept if i is not None and i not in (5, 7)} == {c for _, n, c in comps if c not in (None, 5, 7)}


def test_language(spark, docs, none, rows):
    aside = langid.held_out(F.col("doc_id"))
    found = langid.predict(docs, langid.fit(docs.where(~aside))).collect()
    by_id = collections.defaultdict(list)
    for r in found:
        by_id[r.doc_id].append(r)
    assert len(found) == len(rows)
    for doc_id, text, lang, _ in rows:
        for r in by_id[doc_id]:
            assert 0 <= r.score <= 1
            if len(by_id[doc_id]) == 1 and len(text or "") > 40:
                assert r.lang_pred == (lang or r.lang_pred)
            if not any(c.isalpha() for c in text or "") and len(by_id[doc_id]) == 1:
                assert (r.lang_pred, r.score) == ("und", 0.0)
    assert langid.predict(none, langid.fit(none)).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(none)).collect()} == {"und"}
    held = {r.doc_id: r.h for r in spark.range(50).selectExpr("id AS doc_id").withColumn("h", langid.held_out(F.col("doc_id"))).collect()}
    assert held == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)}


def test_language_brute_force(spark):
    """Posteriors agree with counts made n-gram by n-gram."""
    train = [("Abba daba", "x"), ("cedi  fodi!", "y"), ("abba", "x"), (None, "x"), ("q", None)]
    model = langid.fit(spark.createDataFrame(train, "text string, lang string"))
    letters = langid._letters()
    counts = {lang: collections.Counter() for lang in "xy"}
    for text, lang in train:
        if lang:
            counts[lang].update(langid.features(pa.array([text]), letters)[0].tolist())
    prior = collections.Counter(lang for _, lang in train if lang)
    wanted = langid.features(pa.array(["abce"]), letters)[0]
    logs = [np.log(prior[x] / 4) + sum(np.log((counts[x][f] + 0.5) / (sum(counts[x].values()) + 0.5 * langid.BUCKETS)) for f in wanted.tolist())
            for x in "xy"]
    got = langid.predict(spark.createDataFrame([(1, "abce")], "doc_id long, text string"), model).first()
    assert got.lang_pred == "xy"[int(np.argmax(logs))]
    assert got.score == pytest.approx(1 / np.exp(np.array(logs) - max(logs)).sum())


def plain_repeats(rows, least):
    texts = [(r[1] or "").encode() for r in rows]
    seen = collections.Counter(t[i:i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for r, t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - least + 1):
            if seen[t[i:i + least]] > 1:
                gone[i:i + least] = b"\1" * least
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = len([x for x in bytes(gone).split(b"\0") if x])
        out.append((r[0], len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [suffix.MOST, 1])
def test_repeats(spark, docs, none, rows, most):
    found = suffix.repeats(docs, least=40, most=most).drop("kept")
    assert sorted(map(tuple, found.collect()), key=str) == plain_repeats(rows, 40)
    assert suffix.repeats(none, least=40).count() == 0
    odd = [(1, "ab" * 60, "", ""), (2, "x" * 300, "", ""), (3, "q" + "ab" * 30 + "z", "", ""), (4, "é" * 25 + "y", "", ""), (5, "n" * 39, "", "")]
    found = suffix.repeats(spark.createDataFrame(odd, DOCS), least=40, most=most).drop("kept")
    assert sorted(map(tuple, found.collect()), key=str) == plain_repeats(odd, 40)


def test_transform():
    rng = random.Random(1)
    for _ in range(200):
        strings = [bytes(rng.choice(b"ab\0" if rng.random() < 0.5 else b"a") for _ in range(rng.randrange(30))) for _ in range(rng.randint(1, 5))]
        least = rng.randint(1, 9)
        seen = collections.Counter(s[i:i + least] for s in strings for i in range(len(s) - least + 1))
        want = [[i for i in range(len(s) - least + 1) if seen[s[i:i + least]] > 1] for s in strings]
        assert [list(x) for x in bwt.repeated_starts(strings, least)] == want
    assert bwt.repeated_starts([], 4) == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home.</a></li></ul></nav><div class="cookie-notice">We use cookies, really.</div>
<article class="post"><h2>A &amp; B</h2><p>One <b>bold<br>line&nbsp; here.<p>Two, <a href=x>linked</a>
  text.</p><form><input name=q><button>Go</button></form><ul><li>Item one</li><li>Item two</ul><div class="ad">Buy!</div>
<section id="comments"><p>First comment, very long and with, much punctuation.</p></section></article>
<aside><p>Aside text, which is longer than the article, by far; or nearly so.</p></aside><!-- x --><footer>&copy; me</footer></body>"""


def test_pages(spark):
    text = "A & B\nOne bold line here.\nTwo, linked text.\nItem one\nItem two"
    plain = "<div><p>A long paragraph of text, with marks, and more. It goes on, and on.</p><p>Another one, the same kind.</p></div><div><a href=x>link</a></div>"
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "", ""), (4, "x", plain), (5, "x", "<p"), (None, "x", "no markup, just text"),
            (6, "x", "<article>" + "<p>word word</p>" * 5000 + "</article>")]
    frame = spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, n_chars int")
    found = pages.main_text(frame).collect()
    by_id = {r.page_id: r.text for r in found}
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    assert by_id[1] == text and by_id[2] == by_id[3] == by_id[5] == ""
    assert by_id[4].startswith("A long paragraph") and "link" not in by_id[4]
    assert by_id[None] == "no markup, just text" and by_id[6] == "\n".join(["word word"] * 5000)
    assert pages.main_text(frame.limit(0)).count() == 0


LONG = "A paragraph of the text, with marks; and more of it. " * 8
BOILED = '<div class="site-footer"><p>' + LONG[:120] + "</p></div>"


@pytest.mark.parametrize("opened, closed", [
    ('<body class="has-sidebar"><article>', "</article>" + BOILED), ('<body class="no-footer"><article>', "</article>"),
    ('<html class="hidden"><body id="search"><main id="main-with-nav">', "</main>"), ('<body><article class="post hidden-ads">', "</article>" + BOILED),
    ('<body><div class="modal"><main>', "</main></div>"), ('<body><div class="widget">', "</div>" + BOILED), ("<body><form>", "</form>" + BOILED)])
def test_classes_of_wrappers(opened, closed):
    """A class on what wraps the text does not drop the page; marked elements beside or in it still go."""
    text = LONG.strip()
    page = f'{opened}<h1>Title</h1><p>{LONG}</p><div class="ad">Buy now, quickly!</div><p>{LONG}</p>{closed}</body>'
    assert pages.extract(page) == f"Title\n{text}\n{text}"


def test_pages_without_article():
    """Headings, lists, quotes and code of a text in plain containers stay; links, footers and comments go."""
    text = LONG.strip()
    body = f"<h1>Title</h1>{f'<p>{LONG}</p>' * 5}<h2>Part</h2>{f'<p>{LONG}</p>' * 5}<ul><li>One</li><li>Two</li></ul><blockquote>Short</blockquote><pre>x = 1</pre>"
    want = "\n".join(["Title", *[text] * 5, "Part", *[text] * 5, "One", "Two", "Short", "x = 1"])
    around = '<div><a href="/">Home</a></div>', '<div>Imprint</div><div class="comments"><p>First, of all!</p></div><footer>me</footer>'
    assert pages.extract(f"<body>{around[0]}<div>{body}</div>{around[1]}</body>") == want
    assert pages.extract(f"<div>{body}</div>") == want and pages.extract(body) == want
    halves = body.replace("<h2>", "</div><div><h2>")
    assert pages.extract(f"<body>{around[0]}<section><div>{halves}</div></section>{around[1]}</body>") == want


def test_chats(spark):
    hard = ["</s>[INST] ok [/INST]", "[\\INST] <\\s> \\", "<<SYS>>[ROLE]x[TEXT]", "", None, "a\nb", "[", "<", "[\\\\/INST]", "<s" , "</s></s>", "é" * 10]
    rows = [(1, i, role, t) for i, (t, role) in enumerate(zip(hard, ["user", "assistant", "system", "tool", None, "[TEXT]"] * 2, strict=True))]
    rows += [(2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (2, None, "user", "first"), (None, 1, "user", "q"), (3, 5, "assistant", "</s>" * 2000)]
    frame = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, piece string")
    out = {r.conv_id: r for r in chat.read_chats(chat.format_chats(frame)).collect()}
    for conv in (1, 2, 3, None):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        turns = "".join(f"{role or ''}\n{text or ''}\n" for _, _, role, text in mine)
        loss = "".join(text or "" for _, _, role, text in mine if role == "assistant")
        assert out[conv][1:5] == (len(mine), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_chats(chat.format_chats(frame.limit(0))).count() == 0
    for text in hard:
        assert chat.unescape(chat.escape(text or "")) == (text or "")
    with pytest.raises(chat.Malformed):
        list(chat.parse("[INST] open"))


def test_chat_blocks(spark, monkeypatch):
    """A conversation longer than a block is several rows, none much longer than a block, and reads back as one."""
    assert chat.BLOCK <= 1 << 24
    monkeypatch.setattr(chat, "BLOCK", 100)
    rng = random.Random(5)
    rows = [(conv, i, rng.choice(["user", "assistant", "tool"]), rng.choice(["</s> x", "é" * 30, "", sentence(rng, 4)])) for conv in (1, None) for i in range(200)]
    rows.append((2, 0, "assistant", "y" * 500))
    chats = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5))
    blocks = chats.collect()
    assert len(blocks) > 50 and max(len(b.formatted) for b in blocks if b.conv_id != 2) <= 100
    out = {r.conv_id: r for r in chat.read_chats(chats).collect()}
    for conv in (1, 2, None):
        mine = [r for r in rows if r[0] == conv]
        whole = "".join(b.formatted for b in sorted((b for b in blocks if b.conv_id == conv), key=lambda b: b.block))
        turns = "".join(f"{role}\n{text}\n" for _, _, role, text in mine)
        loss = "".join(text for _, _, role, text in mine if role == "assistant")
        assert [t[:2] for t in chat.parse(whole)] == [r[2:] for r in mine]
        assert out[conv][1:] == (len(mine), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole))


def plain_targets(sizes):
    keys = sorted(k for k in sizes if k is not None) + [None] * (None in sizes)
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(keys)}
    left, open_, out = 1.5 * sum(sizes.values()), set(keys), {}
    while open_:
        level = left / sum(weight[k] for k in open_)
        over = {k for k in open_ if level * weight[k] > 2 * sizes[k]}
        if not over:
            return out | {k: level * weight[k] for k in open_}
        out |= {k: 2 * sizes[k] for k in over}
        left -= sum(2 * sizes[k] for k in over)
        open_ -= over
    return out


def test_mix(docs, none, rows):
    found = mix.mix(docs, shard_docs=15).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want, taken, copied = plain_targets(sizes), collections.Counter(), collections.Counter()
    assert len(found) == len(rows) and sorted(found, key=str) == sorted(mix.mix(docs, shard_docs=15).collect(), key=str)
    for r in found:
        assert r["size"] == len(WORD.findall(r.text or "")) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r["size"]
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
        copied[r.source] += r.copies * r["size"]
    for k in sizes:
        assert abs(taken[k] - want[k]) <= 0.03 * sizes[k] + 3 * mix.BLOCK
        assert abs(copied[k] - want[k]) <= 450
    assert mix.mix(none).count() == 0
    assert mix.repeated(docs, shard_docs=15).count() == sum(r.copies for r in found)


def test_apportion(spark):
    """The highest quotients, against dealing seat by seat."""
    rng = random.Random(2)
    for weights, seats in [([5.0, 3.0, 1.0], 9), ([1.0] * 7, 3), ([0.0, 2.0, 100.0], 50), ([rng.random() ** 4 for _ in range(40)], 200), ([1.0], 0)]:
        frame = spark.createDataFrame([(i, w, seats) for i, w in enumerate(weights)], "k long, w double, s long")
        got = {r.k: r.quota for r in mix.apportion(frame, [], "w", "s", ["k"]).collect()}
        want = collections.Counter()
        for _ in range(seats):
            want[max(range(len(weights)), key=lambda i: (weights[i] / (2 * want[i] + 1), -i))] += 1
        assert got == {i: want[i] for i in range(len(weights))}


def plain_rules(text):
    text = text or ""
    w = WORD.findall(text)
    seen, lines = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    c = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if c[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(covered)]


def test_rules(docs, none, rows):
    texts = [r[1] for r in rows] + ["a b\nc\na b\n\n \na b", "x " * 40, "é|ü #  $", "\n", "one two three four five six seven eight " * 3]
    found = quality.rules(pa.array(texts))
    assert [list(map(int, x)) for x in zip(*found.values(), strict=True)] == [plain_rules(t) for t in texts]
    out = quality.verdicts(docs).collect()
    assert len(out) == len(rows) and all(r.base_failed <= (not r.kept) for r in out)
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in out)
    assert quality.verdicts(none).count() == 0


def plain_kneser_ney(texts):
    """log p(c | h) by the textbook's recursion."""
    order = quality.ORDER
    levels = {order: collections.Counter()}
    for t in texts:
        padded = quality.START * (order - 1) + t
        levels[order].update(padded[i:i + order] for i in range(len(t)))
    for k in range(order - 1, 0, -1):
        levels[k] = collections.Counter(g[1:] for g in levels[k + 1])
    cuts = {}
    for k, level in levels.items():
        t = [sum(n == i for n in level.values()) for i in range(5)]
        y = t[1] / (t[1] + 2 * t[2]) if t[1] + 2 * t[2] else 0
        cuts[k] = [0.0]
        for i in (1, 2, 3):
            d = i - (i + 1) * y * t[i + 1] / t[i] if t[i] and t[1] + 2 * t[2] else 0
            cuts[k].append(d if 0 < d < i else 0.5)

    def p(h, c):
        k = len(h) + 1
        under = [(g, n) for g, n in levels[k].items() if g[:-1] == h]
        low = 1 / (len(levels[1]) + 1) if k == 1 else p(h[1:], c)
        if not under:
            return low
        total = sum(n for _, n in under)
        n = levels[k].get(h + c, 0)
        return max(n - cuts[k][min(n, 3)], 0) / total + sum(cuts[k][min(n, 3)] for _, n in under) / total * low

    return lambda t: sum(np.log(p((quality.START * (order - 1) + t)[i:i + order - 1], t[i])) for i in range(len(t)))


@pytest.mark.parametrize("rows_per_slice", [quality.SLICE_ROWS, 150])
def test_perplexity(spark, rows_per_slice):
    rng = random.Random(4)
    texts = [sentence(rng, 12) for _ in range(12)] + ["", "unseen Ü€ signs"]
    frame = spark.createDataFrame([(i, t, "ab" if i < 12 else None, "") for i, t in enumerate(texts)], DOCS)
    model = quality.train(frame.where("doc_id < 12").unionByName(spark.createDataFrame([(99, "ab", None, "")], DOCS)))
    old, quality.SLICE_ROWS = quality.SLICE_ROWS, rows_per_slice
    try:
        got = {r.doc_id: r.log_perplexity for r in quality.scored(frame, model, ["doc_id"]).collect()}
    finally:
        quality.SLICE_ROWS = old
    known = plain_kneser_ney(texts[:12])
    for i in range(12):
        assert got[i] == pytest.approx(-known(texts[i]) / len(texts[i]), rel=1e-4)
    assert got[12] is None and got[13] == pytest.approx(-plain_kneser_ney(["ab"])(texts[13]) / len(texts[13]), rel=1e-4)


def test_verdicts_follow_labels(spark):
    """Junk like the labelled junk goes, labelled or not, though a third of the corpus is made of it; good documents stay."""
    rng = random.Random(12)
    marks = ("%%%", "***", "$$$", "###")
    rows, labels, junk = [], [], set()
    for i in range(150):
        text = sentence(rng, rng.choice([40, 80, 150]))
        if i % 3 == 0:
            text = " | ".join(text.split(" ")) if i % 2 else " ".join(w + rng.choice(marks) for w in text.split(" "))
            junk.add(i)
        rows.append((i, text, "ab", "s"))
        if i % 5 < 3:
            labels.append((i, int(i not in junk), 0))
    frame = spark.createDataFrame(rows, DOCS)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.verdicts(frame, labels=known).where("kept").collect()}
    assert not kept & junk and len(kept) >= 97
    assert quality.verdicts(frame.limit(0), labels=known).count() == 0
    assert quality.verdicts(frame, labels=known.limit(0)).count() == 150


def test_powers_are_kept(monkeypatch):
    """Powers for span hashes are made once, not for each slice, and a long text does not stay in memory."""
    base = int(common.BASE)
    want = [pow(base, k, 1 << 64) for k in range(301)]
    assert common.powers(common.BASE, 300).tolist() == want and common.powers(common.BASE, 7).tolist() == want[:8]
    assert np.shares_memory(common.powers(common.BASE, 100), common.powers(common.BASE, 90))
    monkeypatch.setattr(common, "POWERS", 50)
    monkeypatch.setattr(common, "_powers", {})
    assert common.powers(common.BASE, 300).tolist() == want and not common._powers


def test_few_texts_are_shuffled(spark):
    """Before texts meet labels, those of documents without one go; every labelled document stays."""
    docs = spark.range(20000).selectExpr("id AS doc_id", "'a' AS text").unionByName(spark.sql("SELECT CAST(NULL AS LONG) doc_id, 'b' text"))
    chosen = spark.range(0, 20000, 10).selectExpr("id AS _id")
    left = {r.doc_id for r in quality._maybe(docs, chosen).collect()}
    assert left >= set(range(0, 20000, 10)) and len(left) < 2100
    assert quality._maybe(docs, chosen.selectExpr("int(_id) AS _id")).count() == 20001
    assert quality._maybe(docs, chosen.limit(0)).count() == 0


def test_grams_are_added_up_in_the_task(spark, monkeypatch):
    """Counts are exact, whether the n-grams of all slices of a task are held to its end or leave it earlier."""
    texts = ["abcde日é", "xyz", "", None, "abcde", "😀bcd"] * 50
    frame = spark.createDataFrame([(i, t, "ab" if i % 7 else None, "s") for i, t in enumerate(texts)], DOCS).coalesce(1)
    want = collections.Counter()
    for i, t in enumerate(texts):
        padded = quality.START * 4 + (t or "")
        want.update(("ab" if i % 7 else None, padded[k:k + 5]) for k in range(len(t or "")))
    for most in (quality.GRAMS, 5):
        monkeypatch.setattr(quality, "GRAMS", most)
        monkeypatch.setattr(quality, "SLICE", 40)
        assert {(r.lang, r.gram): r.n for r in quality.count_grams(frame).collect()} == want


def test_edges():
    off, good = np.array([-9.0, -2, -1, 0, 1, 2, 3, 7]), np.array([False, True, True, True, False, True, True, False])
    assert quality.edges(off, good) == (-5.5, 4.5)
    assert quality.edges(off[:4], np.array([True] * 4)) == (-9.0, 4.5)


def test_bands_take_every_label(spark):
    """Bands found across partitions and batches are those of all labelled documents in one array."""
    rng = np.random.default_rng(5)
    off = np.round(np.concatenate([rng.normal(0, 2, 4000), rng.normal(9, 2, 2500)]), 6)
    off, at = np.unique(off, return_index=True)
    good = np.concatenate([rng.random(4000) < 0.95, rng.random(2500) < 0.1])[at]
    rows = [("ab", bool(g), float(x), 100, 0, 100) for x, g in zip(off, good, strict=True)]
    rows += [(None, i < 12, float(i), 100, 0, 100) for i in range(20)]
    labelled = spark.createDataFrame(rows, "lang string, good boolean, log_perplexity double, n_words long, n_repeat_words long, n_points long")
    middles = spark.createDataFrame([("ab", 0.0, 100, 1.0), (None, 0.0, 100, 1.0)], "_of string, _middle double, _length long, _spread double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 70)
    try:
        got = {r._in: (r._low, r._high) for r in quality._labelled_bands(labelled, middles, 7.5, 4.5).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {"ab": quality.edges(off, good), None: quality.edges(np.arange(20.0), np.arange(20) < 12)}


def test_every_label_is_used(spark):
    """More labelled documents of a language than were once drawn: half are held back, and none is left out."""
    docs = spark.range(5001).selectExpr("id AS doc_id", "'a' AS text", "if(id < 5000, 'ab', NULL) AS lang")
    labels = spark.range(5001).selectExpr("id AS doc_id", "int(id % 3 > 0) AS quality")
    found = quality._labelled(docs, labels).groupBy("good").agg(F.count("*").alias("n"), F.count_if("held").alias("held")).collect()
    assert sum(r.n for r in found) == 5001 and sum(r.held for r in found) == 2500
    assert {r.good: r.n for r in found} == {True: 3334, False: 1667}


def test_leaks(spark, docs, none):
    rng = random.Random(6)
    items = [(i, sentence(rng, n)) for i, n in enumerate([12, 18, 25, 40, 60])] + [(9, None), (10, ""), (11, "short one here")]
    bench = spark.createDataFrame([(*x, 1.0) for x in items], "item_id long, text string, cosine double")
    rows, want = [], set()
    for i, (key, text) in enumerate(items[:5]):
        for j, at in enumerate((0, 17, 100)):
            words = sentence(rng, 150, "ab").split(" ")
            held = text.split(" ")
            if j == 2:  # reworded: a fifth of the words are others
                for k in range(0, len(held), 5):
                    held[k] = "different"
            rows.append((1000 + 10 * i + j, " ".join(words[:at] + [", ".join(held).upper() if j == 1 else " ".join(held)] + words[at:]), "", ""))
            want.add((rows[-1][0], key))
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, DOCS).select("doc_id", "text"))
    found = leaks.leaks(frame, bench)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want
    assert leaks.clean(frame, bench).count() == docs.count()
    assert leaks.leaks(none, bench).count() == leaks.leaks(frame, bench.limit(0)).count() == 0


def test_leaks_at_any_size(spark, monkeypatch):
    """Items with 40 % of their words changed, and a long one, are found among words of their own as if the corpus were 300 times as large."""
    rng = random.Random(21)
    items = [(i, sentence(rng, n)) for i, n in enumerate([20, 24, 32, 48, 400, 20, 24, 32])]
    rows, want, common = [], set(), []
    for key, text in items:
        held = text.split(" ")
        for k in range(len(held)):
            if k % 5 in (1, 3):  # common words elsewhere, so that the answer stays
                common += [held[k]] * 3
                held[k] = sentence(rng, 1, "zx") + "q"
        for j, words in enumerate((held, text.split(" "))):
            around = sentence(rng, 150, "zx").split(" ")
            rows.append((100 * key + j, " ".join(around[:37 + 5 * key] + words + around[37 + 5 * key:])))
            want.add((100 * key + j, key))
    rng.shuffle(common)
    rows += [(5000 + i, " ".join(common[i::10])) for i in range(10)]
    counts = leaks._counts
    monkeypatch.setattr(leaks, "_counts", lambda docs, known: tuple(300 * x for x in counts(docs, known)))
    found = leaks.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want


def test_common_subsequence():
    rng = random.Random(8)
    for _ in range(100):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(1, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert leaks.Item.common(leaks.Item._masks(a), len(a), b) == table[-1][-1]


def test_simple8b():
    rng = np.random.default_rng(1)
    for n in (0, 1, 59, 60, 61, 1023, 1024, 1025, 4000):
        for top in (1, 2, 16, 300, 50257, 1 << 31, (1 << 64) - 1):
            ids = rng.integers(0, top, n, dtype=np.uint64, endpoint=True)
            first, words, far = simple8b.encode(ids)
            assert (simple8b.decode(first, words, far, n) == ids).all()
    keys, nulls, lengths = np.array([3, 0]), np.array([False, True]), np.array([2, 1])
    ids, k, isnull, size = simple8b.from_file(simple8b.to_file(np.array([7, 0, 0]), keys, nulls, lengths))
    assert (list(ids), list(k), list(isnull), list(size)) == ([7, 0, 0], [3, 0], [False, True], [2, 1])
    with pytest.raises(ValueError):
        simple8b.from_file(b"????")


def tokenizer_or_skip():
    pytest.importorskip("public_tokenizers")
    return queries.tokenizer()


def plain_tokens(rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_or_skip())
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files(spark, docs, none, rows):
    path = tokenizer_or_skip()
    odd = ["a  b", " lead", "trail ", "x\n y", "x \n\n y  z", "\t", "don't it's'll", "<|endoftext|> x", "\x1c a\x85b \xa0c", "日本 語 ok", "A_b 1234 !?", "ª²½ x", "é  é",
           "  two", "   ", "a b c"]
    mine = [(r[0], r[1]) for r in rows] + [(500 + i, t) for i, t in enumerate(odd)]
    frame = spark.createDataFrame([(*r, "s") for r in mine], "doc_id long, text string, start string").repartition(4)
    found = sorted(map(tuple, tokens.token_files(frame, path).collect()), key=lambda r: r[1])
    assert found == plain_tokens(mine)
    assert tokens.token_files(none, path).count() == 0


def test_words_are_cut_together(monkeypatch):
    """Pieces of a slice are cut into words at once and each different word is encoded once, with the ids of whole-text encoding."""
    from tokenizers import Tokenizer

    path = tokenizer_or_skip()
    tok, rng, seen = Tokenizer.from_file(path), random.Random(8), []

    class Counted:
        def findall(self, text, words=tokens.WORDS):
            seen.append(text)
            return words.findall(text)

    monkeypatch.setattr(tokens, "WORDS", Counted())
    ends = [",", ".", "!?", "'s", "\0x", "12", "é", " \n", "\xa0", "日", "***", "\t\0", ""]
    texts = [" ".join(rng.choice(["ab", "cd", "don't", "ü"]) + rng.choice(ends) + rng.choice(ends) for _ in range(60)) for _ in range(20)]
    pieces = tokens.Pieces(path)
    for _ in range(2):  # the second time from memory
        ids, counts = pieces.encode(pa.array(texts))
        want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    assert len(seen) == 2


def test_added_tokens(spark):
    """An added token is matched in the text, as the library's encoding does it."""
    from tokenizers import Tokenizer

    path = tokenizer_or_skip()
    tok = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "plain words", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y  z", None, "", "<|ENDOFTEXT|> <|endoftext", "é <|endoftext|>\u3000日本"]
    ids, counts = tokens.Pieces(path).encode(pa.array(texts))
    want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 220, 50256, 275]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    found = tokens.token_files(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).orderBy("doc_id").collect()
    start = 0
    for row, expected in zip(found, want, strict=True):
        assert tuple(row)[1:] == (start, len(expected) + 1, zlib.crc32(np.array([*expected, 0], "<u4").tobytes()))
        start += len(expected) + 1


def test_place(spark, docs, none):
    shards = [f"n{i}" for i in range(7)]
    owner = place.fill(shards, 1009)
    counts = collections.Counter(owner)
    assert max(counts.values()) - min(counts.values()) <= 1
    # the plain rule: in turn, each takes its best free slot
    prefs = [[(place._number("offset", s) + j * (place._number("skip", s) % 1008 + 1)) % 1009 for j in range(1009)] for s in shards]
    plain, turn = [-1] * 1009, 0
    while -1 in plain:
        plain[next(slot for slot in prefs[turn % 7] if plain[slot] < 0)] = turn % 7
        turn += 1
    assert owner == plain
    fewer = place.fill(shards[:-1], 1009)
    moved = sum(a != b for a, b in zip(owner, fewer, strict=True) if a != 6)
    assert moved < 1009 * 0.1
    rows = place.place(docs.withColumn("shard", F.lit("old")), "doc_id", shards, 1009).collect()
    assert len(rows) == docs.count()
    for r in rows:
        slot = int(hashlib.md5(str(r.doc_id if r.doc_id is not None else "").encode()).hexdigest()[:8], 16) % 1009
        assert (r.slot, r.shard) == (slot, shards[owner[slot]])
    assert place.place(none, "doc_id", shards, 1009).count() == 0
    for wrong in (([], 7), (["a", "a"], 7), (["a"], 8)):
        with pytest.raises(ValueError):
            place.fill(*wrong)


def test_pipeline(spark, tmp_path):
    """The stages against plain versions, on few documents; clashing columns go through."""
    import corpus_pipeline

    rng = random.Random(9)
    item = sentence(rng, 30)
    rows = [(i, sentence(rng, 80) + "\n" + sentence(rng, 60), "ab", f"s{i % 3}") for i in range(30)]
    rows += [(100 + i, rows[i][1] + " end", "ab", "s0") for i in range(4)] + [(200, "too short", "ab", "s0"), (201, "same words here " * 40, "ab", "s1")]
    rows += [(300, rows[8][1] + " " + item, "ab", "s2"), (301, None, None, None)]
    names = DOCS + ", n_chars long, kept string, size int, _key string"
    spark.createDataFrame([(*r, len(r[1] or ""), "k", 1, "y") for r in rows], names).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns[:8] == ["doc_id", "text", "lang", "source", "n_chars", "kept", "size", "_key"]
        docs.write.parquet(path := f"{tmp_path}/{len(kept)}")
        docs = spark.read.parquet(path)
        kept.append(sorted(r.doc_id for r in docs.collect()))
    good = set(range(30)) | {100, 101, 102, 103, 300}
    assert set(kept[0]) == good
    alive = [r for r in rows if r[0] in good]
    assert set(kept[1]) == {c for _, _, c in plain_components(alive, 5, 80)}
    assert set(kept[2]) == set(kept[1]) - {300}
    sizes = collections.Counter()
    for r in rows:
        if r[0] in kept[2]:
            sizes[r[3]] += len(WORD.findall(r[1]))
    want, got = plain_targets(sizes), collections.Counter()
    for r in docs.collect():
        got[r.source] += len(WORD.findall(r.text))
    assert set(kept[3]) <= set(kept[2]) and max(collections.Counter(kept[3]).values()) <= 2
    assert all(abs(got[k] - want[k]) <= 160 for k in sizes)
    by_id = {r[0]: r[1] for r in rows}
    assert sorted(map(tuple, corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()), key=lambda r: r[1]) == plain_tokens(
        [(i, by_id[i]) for i in kept[3]])


def test_words_that_candidates_cover():
    """Words of an item in a stretch of text, each as often as the item has it, for runs of any length."""
    rng = np.random.default_rng(3)
    often, number = rng.integers(0, 3, (5, 9)).astype(np.int32), rng.integers(0, 9, 200)
    item, low = rng.integers(0, 5, 60), rng.integers(0, 150, 60)
    high = low + rng.integers(0, 50, 60)
    expected = [sum(int(often[i, w]) for w in set(number[a:z].tolist())) for i, a, z in zip(item, low, high, strict=True)]
    for most in (1, 40, leaks.PRODUCTS):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(leaks, "PRODUCTS", most)
            assert leaks._covered(often, item, low, high, number).tolist() == expected
