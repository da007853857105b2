"""The corpus operators against brute force on a small table with every edge case:
nulls in all columns, empty and long texts, ties, repeated rows, near copies, shared
passages, and extra columns whose names clash with the operators' own."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from affinity.llm import (decontaminate, fingerprints, html_extract, license_scan, line_dedup,  # noqa: E402
                          ngram_join, suffix_array, suffix_dedup, toxicity)
from affinity.llm.bpe import BytePairs, encode_decode  # noqa: E402
from affinity.llm.token_counts import count_tokens  # noqa: E402

VOCAB = P.path("byte_bpe_50k.json")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id string, h long, sig string, "
          "size long, kept string, component_id long, n_tokens long, hits string, label string")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


def shingles(t, n):
    w = words(t)
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def make_rows():
    rnd = random.Random(7)
    vocab = ["the", "of", "and", "to"] * 6 + [f"w{chr(97 + i % 26)}{i}é" for i in range(300)]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    passage = say(70)
    texts = [None, "", " \n\t ", "one", "ONE", "a b c", "a b c", "A  B\tC", "x" * 3000, "ab" * 700 + "\n" + "ab" * 700,
             "don't  stop\n\n <|endoftext|> 日本語 \U0001F600 ½", "\n".join([say(12)] * 4), "line\r\nline\x00nul"]
    for _ in range(14):
        texts.append("\n".join(say(rnd.randint(1, 60)) for _ in range(rnd.randint(1, 5))))
    base = say(120)
    for k in range(12):  # near copies of different distance
        w = base.split(" ")
        for _ in range(k):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        texts.append(" ".join(w))
    for _ in range(5):
        texts.append(say(20) + "\n" + passage + " " + say(25))
    texts += [texts[15], texts[15], texts[20] + " more"]
    texts.append("\n".join(say(50) for _ in range(60)))
    rnd.shuffle(texts)
    return [(i * 3 - 20, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else "src", None, "clash", i, "s", 1, "k",
             5, 6, "h", "l") for i, t in enumerate(texts)]


ROWS = make_rows()
TEXT = {r[0]: r[1] or "" for r in ROWS}
IDS = sorted(TEXT)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """A null id and repeated rows."""
    return spark.createDataFrame([ROWS[3], ROWS[3], (None, *ROWS[16][1:]), (None, None, *ROWS[0][2:]), ROWS[16]], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_suffix_order_against_sorting():
    rng = np.random.default_rng(3)
    held, suffix_array.HELD = suffix_array.HELD, 7  # through the scratch file
    try:
        for _ in range(60):
            x = rng.integers(0, rng.integers(1, 5), rng.integers(0, 80))
            t = x.tolist()
            pos, common = suffix_array.suffix_order(x, 200)
            assert pos.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
            for a, b, n in zip(pos[:-1].tolist(), pos[1:].tolist(), common[1:].tolist(), strict=True):
                m = min(len(t) - a, len(t) - b)
                assert n == next((i for i in range(m) if t[a + i] != t[b + i]), m)
    finally:
        suffix_array.HELD = held


def brute_removed():
    first, out = {}, {}
    for i in IDS:
        b = TEXT[i].encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k:k + 50], i)
    for i in IDS:
        b, m = TEXT[i].encode(), bytearray(len(TEXT[i].encode()))
        for k in range(len(b) - 49):
            if first[b[k:k + 50]] < i:
                m[k:k + 50] = b"\1" * 50
        out[i] = bytes(x for x, y in zip(b, m, strict=True) if not y), sum(m), len(re.findall(b"\1+", bytes(m)))
    return out


def test_suffix_dedup(docs, none, odd):
    want = brute_removed()
    assert sum(n for _, n, _ in want.values()) > 1000
    for shard in (8 << 20, 4000):
        got = by_id(suffix_dedup.dedup_substrings(docs, shard_bytes=shard))
        assert {i: (bytes(r["kept"]), r["n_removed"], r["n_spans"]) for i, r in got.items()} == want
    assert suffix_dedup.dedup_substrings(none).count() == 0
    r = suffix_dedup.dedup_substrings(odd, digests=True).collect()
    assert len(r) == 5 and all(x["n_removed"] == 0 for x in r if x["doc_id"] is not None)


def test_fingerprints(docs, none, odd):
    got = by_id(fingerprints.likeness_of_edits(docs))
    order = sorted(TEXT, reverse=True)
    for k, i in enumerate(order):
        after = TEXT[order[(k + 1) % len(order)]]
        half = len(TEXT[i]) // 2
        edited = TEXT[i][:len(TEXT[i]) - half] + after[:half]
        r, a, e, n = got[i], shingles(TEXT[i], 5), shingles(edited, 5), shingles(after, 5)
        assert (r["n_chars"], r["edited_sha256"]) == (len(TEXT[i]), hashlib.sha256(edited.encode()).hexdigest())
        for near, other in ((r["near_edited"], e), (r["near_next"], n)):
            assert abs(near - (len(a & other) / len(a | other) if a | other else 1.0)) < 0.13
    same = {}
    for i, r in got.items():
        assert same.setdefault(TEXT[i], r["fingerprint"]) == r["fingerprint"]
    assert fingerprints.likeness_of_edits(none).count() == 0
    assert fingerprints.likeness_of_edits(odd).count() == 5


def test_sketches_merge():
    rng = np.random.default_rng(5)
    a, b = (np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)) for n in (4000, 3000))
    b = np.unique(np.concatenate((b, a[::2])))
    sa, sb = fingerprints.Sketch.of_set(a), fingerprints.Sketch.of_set(b)
    both = fingerprints.Sketch.of_set(np.union1d(a, b))
    assert str(sa.merge(sb)) == str(both)
    assert str(fingerprints.Sketch.parse(str(sa))) == str(sa)
    assert abs(sa.distinct() - len(a)) < 0.3 * len(a)
    assert abs(sa.containment(sb) - 0.5) < 0.15


def brute_components(n, num, den):
    sets = {i: shingles(TEXT[i], n) for i in IDS}
    root = {i: i for i in IDS}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in IDS:
        for j in IDS:
            if i < j and sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in IDS}


@pytest.mark.parametrize("n,num,den,rounds", [(4, 85, 100, 2), (2, 1, 2, 1)])
def test_ngram_join(docs, n, num, den, rounds):
    got = by_id(ngram_join.jaccard_components(docs, n=n, num=num, den=den, rounds=rounds))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute_components(n, num, den)


def test_verified_sets_outlive_a_full_cache(monkeypatch):
    """A slice that mixes cached and new sets, when the cache is over its limit."""
    monkeypatch.setattr(ngram_join, "HELD_SHINGLES", 3, raising=False)
    text = {c: " ".join(f"{c}{i}" for i in range(40)) for c in "abcd"}
    text["e"] = text["a"] + " end"

    def batch(*pairs):
        return pa.RecordBatch.from_pydict({
            "x": pa.array([x.encode() for x, _ in pairs]), "y": pa.array([y.encode() for _, y in pairs]),
            "x_text": [text[x] for x, _ in pairs], "y_text": [text[y] for _, y in pairs]})

    batches = [batch(("a", "b")), batch(("a", "e"), ("c", "b")), batch(("c", "a"), ("d", "d"), ("e", "a"))]
    got = [x for part in ngram_join._verify(5, 4, 5)(iter(batches)) for x in part.column("linked").to_pylist()]
    assert got == [False, True, False, False, True, True]


def test_one_of_each(docs, none, odd):
    kept = ngram_join.one_of_each(docs, n=5, num=4, den=5)
    assert kept.columns == docs.columns
    want = brute_components(5, 4, 5)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in IDS if want[i][1] == i)
    assert ngram_join.one_of_each(none).count() == 0
    assert sorted(str(r["doc_id"]) for r in ngram_join.one_of_each(odd).collect()).count(str(ROWS[3][0])) == 1


def test_links_of_rows_without_id(spark):
    """A text without id links two others; rows of one id have different texts."""
    w = [f"v{i}" for i in range(130)]
    rows = [(1, " ".join(w[:100])), (None, " ".join(w[8:108])), (2, " ".join(w[16:116])), (3, "a b c d e f"),
            (5, " ".join(w[16:115])), (5, "q r s t u v"), (None, "g h i j k"), (None, "g h i j k"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = sorted(map(str, (tuple(r) for r in ngram_join.jaccard_components(docs).collect())))
    assert got == sorted(map(str, [(1, 96, 1), (None, 96, 1), (2, 96, 1), (3, 2, 3), (5, 95, 1), (5, 2, 5), (None, 1, None),
                                   (None, 1, None), (None, 0, None)]))


def test_decontamination(spark, docs, none):
    long = next(r[1] for r in ROWS if r[1] and len(words(r[1])) > 100)
    w = long.split()
    items = [(1, " ".join(w[10:40])), (2, "nothing like it " * 9), (3, "one"), (4, " ".join(w[50:55])), (5, None), (6, ""),
             (None, " ".join(w[60:75])), (10, " ".join(w[10:40])), (7, " ".join(w[0:3]) + " zz " + " ".join(w[70:90]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {}
    for i, t in items:
        v = split(t)
        for k in range(len(v) - min(13, len(v)) + 1 if v else 0):
            windows.setdefault(tuple(v[k:k + 13]), set()).add(i)
    for parts in (1, 5):
        bench = bench.repartition(parts)
        got = by_id(decontaminate.contamination(docs, bench))
        clean = []
        for i in IDS:
            v, hit, found = split(TEXT[i]), set(), set()
            for size in {len(k) for k in windows}:
                for k in range(len(v) - size + 1):
                    if (own := windows.get(tuple(v[k:k + size]))) is not None:
                        found |= own
                        hit.update(range(k, k + size))
            assert {k for a, b in got[i]["hits"] for k in range(a, b)} == hit
            assert got[i]["item_ids"] == sorted(str(x) for x in found if x is not None)
            assert got[i]["n_words"] == len(v)
            if not hit or 20 * len(hit) < len(v):
                clean.append(next(r for r in ROWS if r[0] == i))
        left = decontaminate.decontaminated(docs, bench)
        assert left.columns == docs.columns
        assert sorted(tuple(r) for r in left.select("doc_id", "text", "hits").fillna("-").collect()) == sorted(
            (r[0], r[1] if r[1] is not None else "-", r[12]) for r in clean)
        assert 0 < len(clean) < len(ROWS)
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).filter("size(hits) > 0").count() == 0


def test_shared_passages(spark):
    """A passage in a third of all documents and in many items, repeated rows, null ids
    and a long text of one phrase: the words hit and the items, by brute force."""
    rnd = random.Random(11)
    say = lambda n: " ".join(rnd.choice("abcdefgh") + str(rnd.randrange(9)) for _ in range(n))
    passage = say(40)
    rows = [(i, f"{say(i % 30)} {passage if i % 3 == 0 else passage[:60]} {say(20)}") for i in range(300)]
    rows += [rows[0], rows[0], (None, rows[3][1]), (None, rows[3][1]), (None, say(30)), (400, "r r " * 3000)]
    items = [(i, f"{say(i)} {passage}") for i in range(40)] + [(40, "r " * 15), (41, "r r r"), (41, say(14)), (42, passage[:60])]
    bench = spark.createDataFrame(items, "item_id int, text string").repartition(4)
    windows = {}
    for i, t in items:
        v = t.split()
        for k in range(len(v) - min(13, len(v)) + 1):
            windows.setdefault(tuple(v[k:k + 13]), set()).add(str(i))
    lengths = {len(w) for w in windows}

    def brute(t):
        v, hit, found = t.split(), set(), set()
        for n in lengths:
            for k in range(len(v) - n + 1):
                if (own := windows.get(tuple(v[k:k + n]))) is not None:
                    found |= own
                    hit.update(range(k, k + n))
        return len(v), len(hit), sorted(found)

    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(5)
    got = decontaminate.contamination(docs, bench).withColumn("n", decontaminate.n_hit(F.col("hits"))).collect()
    told = sorted((str(r["doc_id"]), r["n_words"], r["n"], r["item_ids"]) for r in got)
    assert told == sorted((str(i), *brute(t)) for i, t in rows)
    kept = decontaminate.decontaminated(docs, bench).collect()
    want = [(str(i), t) for i, t in rows if (b := brute(t))[1] == 0 or 20 * b[1] < b[0]]
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == sorted(want)


def test_tokens(docs, none, odd):
    coder = tokenizers.Tokenizer.from_file(VOCAB)
    ids = {i: coder.encode(TEXT[i], add_special_tokens=False).ids for i in IDS}
    got = by_id(count_tokens(docs, VOCAB))
    assert {i: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for i, r in got.items()} == {
        i: (len(TEXT[i].encode()), len(ids[i]), len(ids[i]) > 512) for i in IDS}
    got = by_id(encode_decode(docs, VOCAB))
    for i in IDS:
        assert got[i]["ids"] == ids[i] and got[i]["decoded"] == coder.decode(ids[i], skip_special_tokens=False)
    got = by_id(encode_decode(docs, VOCAB, digests=True))
    for i in IDS:
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids[i], "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(TEXT[i].encode()).hexdigest()
    for f in (lambda d: count_tokens(d, VOCAB), lambda d: encode_decode(d, VOCAB)):
        assert f(none).count() == 0 and f(odd).count() == 5


def test_tokens_of_other_files(docs):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = by_id(count_tokens(docs, P.path("piece_bpe_32k.model")))
    assert all(got[i]["n_tokens"] == len(sp.encode(TEXT[i])) for i in IDS)
    coder = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    coder.no_truncation()
    got = by_id(count_tokens(docs, P.path("word_bpe_49k.json")))
    assert all(got[i]["n_tokens"] == len(coder.encode(TEXT[i], add_special_tokens=False).ids) for i in IDS)


def test_long_words_and_white_space():
    coder, own = tokenizers.Tokenizer.from_file(VOCAB), BytePairs(VOCAB)
    texts = ["a" * 500 + "b" * 65 + " " + "hello" * 40, " \n  \n x", "a  b ", "　 x y", "a\x1cb \x1c c", "<|endoftext|>" * 3]
    ids, counts = own.encode(pa.array(texts))
    at = np.concatenate(([0], np.cumsum(counts)))
    for k, t in enumerate(texts):
        assert ids[at[k]:at[k + 1]].tolist() == coder.encode(t, add_special_tokens=False).ids


def brute_lines(rows):
    seen, out = [], {}
    for i, t in rows:
        kept = []
        for line in t.split("\n"):
            s = set(words(line))
            gone = bool(s) and any(5 * len(s & o) >= 4 * len(s | o) for o in seen)
            if s:
                seen.append(s)
            if not gone:
                kept.append(line)
        out[i] = "\n".join(kept)
    return out


def test_line_dedup(docs, none, odd):
    want = brute_lines([(i, TEXT[i]) for i in IDS])
    out = line_dedup.dedup_lines(docs, counts=True)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    got = by_id(out)
    raw = {r[0]: r[1] for r in ROWS}
    assert {i: got[i]["text"] for i in IDS} == {i: None if raw[i] is None else want[i] for i in IDS}
    assert sum(r["n_removed"] for r in got.values()) > 10
    assert line_dedup.dedup_lines(none).count() == 0
    assert line_dedup.dedup_lines(odd).count() == 5


@pytest.mark.parametrize("kind", ["long", "string", "int"])
def test_lines_of_rows_without_id(spark, kind):
    """Rows with a null id are documents of their own, before all others."""
    texts = ["p q r s t\nu v w x y\nalone a b c", "f g h i j\nk l m n o\nf g h i j", "alone d e f\nu v w x y"]
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (9, "p q r s t\nof nine only")]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    got = {r["text"]: r["n_removed"] for r in line_dedup.dedup_lines(docs, counts=True).collect()}
    assert got == {texts[0]: 0, "f g h i j\nk l m n o": 1, "alone d e f": 1, "of nine only": 1}


def test_html():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><p>no</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=a>Home</a></li></ul></nav><div class="cookie-notice">We use
    cookies, and, so, on, and on</div><article><h1>Title &amp; more</h1><p><b>One, two&nbsp;three,<br>four.<p>Second,
    <a href="x>y">linked</a>\tword.<div class=ad>Buy</div><ul><li>first, item<li>second</ul><form><p>Your name, please,
    now</form></article><section id=comments><p>Nice, really, very, nice, comment, here</p></section><footer>(c)"""
    assert html_extract.main_text(page) == (
        "Title & more\nOne, two three, four.\nSecond, linked word.\nfirst, item\nsecond")
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<script>x") == ""
    assert html_extract.main_text("plain &lt;text") == "plain <text"
    assert html_extract.main_text("<div>a<div>b</div>c") == "a\nb\nc"


@pytest.mark.parametrize("page,want", [
    ("<ul><li class=share>Share<li>More</ul><p>Article, text", "More\nArticle, text"),
    ("<p class=ad>Buy<p>Article, text", "Article, text"),
    ("<p class=ad>Buy<hr>Article, text", "Article, text"),
    ("<div><p class=ad>Buy</div><p>Article, text</p>", "Article, text"),
    ("<dl><dt class=ad>Buy<dd>Article, text</dl>", "Article, text"),
    ("<table><tr class=ad><td>Buy<tr><td>Article, text</table>", "Article, text"),
    ("<table><tr><td class=ad>Buy<td>Article, text</table>", "Article, text"),
    ("<div><form><p>Name</div><p>Article, text", "Article, text"),
    ("<p>One, <span class=ad>Buy <span>now</span> or</span> two.</p>", "One, two."),
    ("<p>One, <span class=ad>Buy<p>Article, text", "One,\nArticle, text"),
    ("<head><title>T</title><meta a=b><p>Article, text", "Article, text"),
    ("<div class='content has-sidebar'><p>Article, text</div>", "Article, text"),
    ("<div class='post no-comments'><p>Article, text</div>", "Article, text"),
    ("<div class='main with-menu'><p>Article, text</div>", "Article, text"),
    ("<div class='content sidebar'><p>Article, text</div>", "Article, text"),
    ("<div class=sidebar-layout><h1>Title</h1><p>Article, text</p><div class=share><p>Share</div></div><p>End", "Title\nArticle, text\nEnd"),
    ("<article><p>Article, text</article><section id=comments><article>" + "<p>Nice, very, nice" * 9 + "</section>", "Article, text"),
    ("<div><p>Article, text</p><div class=main-menu><p>Home, page</div><aside><p>a, b</aside></div>", "Article, text"),
])
def test_html_ends_and_names(page, want):
    assert html_extract.main_text(page) == want


def test_html_table(spark):
    rows = [(1, None, "<p>a, b", "x"), (1, "u", "<p>a, b", None), (None, "v", None, "y"), (3, "w", "<p>" + "word, " * 50000, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.extract(pages).collect()
    assert [r["text"][:4] for r in got] == ["a, b", "a, b", "", "word"] and got[3]["n_chars"] == 299999
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_toxicity(spark):
    rnd = random.Random(1)
    calm = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        t = [rnd.choice(calm) for _ in range(40)]
        if i % 5 == 0:
            t[rnd.randrange(40)] = rnd.choice(["idiot", "moron"])
        rows.append((i, " ".join(t), "x"))
        labels.append((i, int(i % 5 == 0), "en"))
    hidden = ["1d10t", "i d i o t", "m.o.r.o.n", "idiiiiot", "m0r0n", "id!ot", "m*ron"]
    plain = ["hello", "10.2.3.4", "a b c d", "wordaa@wordbb.org"]
    rows += [(1000 + k, f"wordaa {h} wordbb", "x") for k, h in enumerate(hidden)]
    rows += [(2000 + k, f"wordaa {h} wordbb", "x") for k, h in enumerate(plain)] + [(3000, None, "x"), (3001, "", None), (None, " ", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    known = spark.createDataFrame([*labels, (None, 1, "en"), (5000, None, "en")], "doc_id long, toxic int, text string")
    model = toxicity.train(docs, known)
    got = {r["doc_id"]: r["s"] for r in docs.select("doc_id", toxicity.score_of(docs["text"], model, spark).alias("s")).collect()}
    assert all((got[i] >= 0.3) == (i % 5 == 0) for i in range(600))
    assert all(got[1000 + k] >= 0.3 for k in range(len(hidden))), got
    assert all(got[i] < 0.3 for i in (*range(2000, 2000 + len(plain)), 3000, 3001, None))
    empty = toxicity.train(docs, known.limit(0))
    assert docs.select(toxicity.score_of(docs["text"], empty, spark).alias("s")).filter("s >= 0.3").count() == 0
    assert docs.limit(0).select(toxicity.score_of(docs["text"], model, spark)).count() == 0


def test_licences(spark):
    rows = [("/a/LICENSE", "Released under the MIT License.", 1), ("/a/b/x.txt", "some words\nand lines", 2),
            ("/a/b/c/y.txt", "Licensed under the Apache License, Version 2.0.\ncode", 3), ("/d/z.txt", None, 4), (None, "", 5),
            ("/a/b/c/z.txt", "the the the", 6), ("/a/b/x.txt", "some words\nand lines", 2), ("/a/b/c/COPYING", "plain", 7)]
    files = spark.createDataFrame(rows, "path string, text string, licence int")
    got = sorted((r["path"] or "", r["licence"] or "", r["origin"] or "") for r in license_scan.scan_licences(files).collect())
    assert got == sorted([("/a/LICENSE", "MIT", "own"), ("/a/b/x.txt", "MIT", "directory"), ("/a/b/x.txt", "MIT", "directory"),
                          ("/a/b/c/y.txt", "Apache-2.0", "own"), ("/d/z.txt", "", ""), ("", "", ""),
                          ("/a/b/c/z.txt", "Apache-2.0", "directory"), ("/a/b/c/COPYING", "Apache-2.0", "directory")])
    assert license_scan.scan_licences(files.limit(0)).count() == 0
