"""Decontamination, archives, toxicity, page text, packing, personal data, nearest neighbours, pipeline."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import ann, decontaminate, html_extract, packing, pii, tables, toxicity, warc
from quillspan.llm.registry import tokenizer_path


def seed_runs(doc, item, seed):
    pairs = [(i, j) for i in range(len(doc) - seed + 1) for j in range(len(item) - seed + 1) if doc[i : i + seed] == item[j : j + seed]]
    return decontaminate.runs_of(*[np.array(x, dtype=np.int64) for x in ([i for i, _ in pairs], [j for _, j in pairs], [1] * len(pairs))])


def greedy_tiles(doc, item, seed):
    """Brute force: of all matches of unmarked words the longest, ties at the smallest places, until none has ``seed`` words."""
    used, free, out = set(), set(range(len(item))), []
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and i + n not in used and j + n in free:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < seed:
            return out
        out.append((i, j, n))
        used.update(range(i, i + n))
        free.difference_update(range(j, j + n))


def test_tiles_equal_brute_force():
    doc = "x a b c d e f y p q r s t z".split()
    item = "p q r s t a b c d e f".split()
    assert decontaminate.tiles(seed_runs(doc, item, 3), 3) == [(1, 5, 6), (8, 0, 5)]
    rng = random.Random(8)
    for _ in range(150):
        letters = rng.choice(["ab", "abc", "abcdefgh"])
        item = [rng.choice(letters) for _ in range(rng.randint(0, 18))]
        doc = [rng.choice(letters) for _ in range(rng.randint(0, 14))] + item[rng.randint(0, 6) :] + item[: rng.randint(0, 9)]
        assert decontaminate.tiles(seed_runs(doc, item, 3), 3) == greedy_tiles(doc, item, 3)


def test_decontamination_of_repeated_and_structured_words(spark):
    long_ = "a"
    while len(long_) < 2048:
        long_ += long_.translate(str.maketrans("ab", "ba"))
    other = long_.translate(str.maketrans("ab", "ba"))
    bench = spark.createDataFrame([(1, f"u v w x {long_}"), (2, "la " * 300)], "item_id long, text string")
    rows = [(1, f"u v w x {other}"), (2, f"so U V W X {long_}"), (3, "la " * 20_000), (4, "la " * 149), (5, "la " * 150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for words in (1_000_000, 0):
        found = decontaminate.contaminated(docs.where("doc_id <> 3") if not words else docs, bench, broadcast_words=words).collect()
        expected = {(2, 1, 1.0), (3, 2, 1.0), (5, 2, 0.5)}
        assert {(r.doc_id, r.item_id, r.coverage) for r in found} == {x for x in expected if words or x[0] != 3}


def test_decontamination(spark, docs, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").union(spark.createDataFrame([(900, None), (901, "too short"), (902, "p1 p2 p3 p4 p5 p6 q1 q2 q3 q4 q5 q6")], "item_id long, text string"))
    more = spark.createDataFrame([(20_000, "zz q1 q2 q3 q4 q5 q6 yy P1 p2 p3 p4 p5 p6"), (20_001, "p1 p2 p3 p4 zz"), (None, "p1 p2 p3 p4 p5 p6 q1 q2 q3")], "doc_id long, text string")
    every = docs.select("doc_id", "text").union(more)
    found = {tuple(r) for r in decontaminate.contaminated(every, bench).collect()}
    pairs = {(d, i) for d, i, *_ in found}
    items = [(r.item_id, r.text) for r in bench.collect() if r.text and len(r.text.split()) >= 5]
    whole = {(d.doc_id, i) for d in every.collect() for i, t in items if d.text and t in d.text}
    assert whole <= pairs
    assert {(20_000, 902), (None, 902)} <= pairs and (20_001, 902) not in pairs
    assert [x[2:] for x in found if x[0] == 20_000] == [(1.0, 2, 6)]
    assert {tuple(r) for r in decontaminate.contaminated(every, bench, broadcast_words=0).collect()} == found
    left = decontaminate.drop_contaminated(every.withColumn("doc", F.lit(1)), bench)
    assert left.count() == every.count() - len({d for d, _ in pairs})
    assert decontaminate.contaminated(every.where("false"), bench).count() == 0
    assert decontaminate.contaminated(every, bench.where("false")).count() == 0


@pytest.mark.parametrize(("compression", "least"), [("none", 0), ("gzip", 5)])
def test_warc_round_trip(spark, sf, compression, least):
    odd = "WARC/1.1\r\n\r\nWARC/1.1 é\x00😀\r\n\r\n"
    rows = [(10**9, None, None), (10**9 + 1, "u\r\nX: y", ""), (10**9 + 2, "http://a", odd), (10**9 + 3, "http://a", odd), (10**9 + 3, "http://a", odd), (None, "http://n", odd), (None, None, "abc")]
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").union(spark.createDataFrame(rows, "page_id long, url string, html string"))
    path = tables.new_folder(spark, "warc")
    warc.write_warc(pages.withColumn("digest", F.lit(1)), path, least, compression)
    raw = warc.read_warc(spark, path)
    got = Counter(tuple(r) for r in warc.page_records(raw).collect())
    given = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    holder = {}
    for i, b in given:
        if i is not None and len(b) >= least:
            holder[b] = max(holder.get(b, i), i)
    expected = Counter()
    for i, b in given:
        h = holder.get(b)
        again = h is not None and h != i
        expected[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", h if again else None] += 1
    assert got == expected
    texts = {r.record_id: r.payload for r in raw.where("record_type = 'response'").collect()}
    assert texts[f"<urn:x-page:{10**9 + 3}>"] == odd.encode()
    assert raw.where("record_type = 'revisit' and target_uri = 'http://a'").count() == sum(r[0] in (10**9 + 2, None) and r[2] == odd for r in rows if r[1] == "http://a")
    assert all(r.payload is None for r in warc.read_warc(spark, path, payload=False).select("payload").collect())


def test_toxicity(spark, sf):
    rng = random.Random(4)
    plain = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for d in range(600):
        bad = d % 6 == 0
        text = rng.choices(plain, k=40) + (rng.sample(["vile", "vilest", "grubby"], 2) if bad else [])
        rng.shuffle(text)
        rows.append((d, " ".join(text)))
        labels.append((d, 1, int(bad)))
    rows += [(900, None), (901, ""), (None, "vile grubby")]
    labels += [(900, 1, None), (None, 1, 1), (0, 1, 1)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity(docs, marks).collect()}
    assert len(out) == len(rows)
    for d in range(600):
        assert out[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert out[d].predicted == int(d % 6 == 0) and 0 <= out[d].score <= 1
    assert out[900].predicted == 0 and out[901].score == out[900].score and out[None].predicted == 1
    assert out[0].evidence.split(":")[1] == "1"
    assert toxicity.drop_toxic(docs.withColumn("score", F.lit(1)), marks).columns == ["doc_id", "text", "score"]
    assert {r.score for r in toxicity.toxicity(docs, marks.where("false")).collect()} == {0.0}
    assert toxicity.toxicity(docs.where("false"), marks).count() == 0


def test_rare_toxic_terms_pass_beside_many_common_ones(spark):
    """More neutral terms of higher frequency than the 30,000 that a cut by frequency once let through."""
    # Beginnings of words are terms too; those of the fillers are shared, those of the rare word are its own.
    common = " ".join(f"{'abcdefghij'[i % 10]}{''.join(chr(97 + int(c)) for c in str(i))}" for i in range(31_000))
    toxic = spark.createDataFrame([(f"{common} {'vilest' if d < 6 else ''}",) for d in range(12)], "text string")
    clean = spark.createDataFrame([(common,)] * 12, "text string")
    assert toxicity._sums(toxic).where("n > 6").count() > 30_000
    assert toxicity._chosen(toxic, clean, 12, 12) == ["^vile", "^viles", "vilest"]


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(1)
    model = toxicity.Model([f"t{i}" for i in range(40)], np.ones(40))
    examples = []
    for d in range(700):
        terms = np.sort(rng.choice(40, rng.integers(1, 6), replace=False))
        w = rng.random(len(terms))
        examples.append((d, int(rng.random() < 0.5), tuple(zip(terms.tolist(), (w / np.linalg.norm(w)).tolist()))))
    model.index(examples, 0, 0)
    dense = np.zeros((700, 40))
    for t, (_, _, _, at, x) in model.postings.items():
        dense[at, t] = x
    for _ in range(60):
        terms = np.sort(rng.choice(40, 4, replace=False))
        q = tuple(zip(terms.tolist(), [0.5] * 4))
        score = dense[:, terms] @ np.full(4, 0.5)
        expected = sorted(score[score > 0])[::-1][:15]
        assert np.allclose([c for c, _ in model.nearest(q, 15)], expected)


def test_html_text(spark):
    page = (
        '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><a href=x>Menu</a></nav>'
        '<div class="cookie-notice">We use cookies on this site</div><article><h1>Head &amp; line</h1><p><b>First   para<br>goes on &lt;here&gt;.<p>Second&nbsp;one, a < b<div class="ad">Buy</div>'
        '<ul><li>one<li>two</ul><form>send</form><section class="comments"><p>Reader comment that is quite long indeed, longer than anything</section></article><aside>Side</aside><footer>Foot</footer></body></html>'
    )
    expected = "Head & line\n\nFirst para goes on <here>.\n\nSecond one, a < b\n\none\n\ntwo"
    plain = "<div class=c1><p>Long paragraph of this page that is the text, plain and simple.</p><p>More of it in a second one.</p></div><div class=s><a>x</a></div>"
    rows = [(1, "http://h/1", page), (2, None, page), (3, "http://h/2", None), (4, "http://h/3", ""), (5, "http://h/4", "just <b>text</b>"), (6, "http://g/1", plain), (6, "http://g/1", plain), (7, "http://g/2", plain.replace("c1", "c22"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("path", F.lit(2))
    out = html_extract.extract_pages(pages).collect()
    assert len(out) == len(rows)
    got = {r.page_id: r.text for r in out}
    assert got[1] == got[2] == expected
    assert got[3] == got[4] == "" and got[5] == "just text"
    assert got[6] == got[7] == "Long paragraph of this page that is the text, plain and simple.\n\nMore of it in a second one."
    assert all(r.n_chars == len(r.text) for r in out)
    assert {r.path for r in html_extract.host_paths(pages.where("page_id > 5")).collect()} == {"div.c#"}
    assert html_extract.extract_pages(pages.where("false")).count() == 0


def test_deep_and_broken_html():
    assert html_extract.extract("<div>" * 20_000 + "x", None) == "x"
    assert html_extract.extract("<" * 500 + "p", None) == "<" * 500 + "p"
    assert html_extract.extract("<p", None) == "<p"


def test_html_keeps_what_a_wrapper_or_an_open_tag_surrounds():
    prose = "<p>The long text of this page, which is what a reader came for.</p><p>And a second paragraph of it.</p>"
    text = "The long text of this page, which is what a reader came for.\n\nAnd a second paragraph of it."
    side = '<div class="sidebar"><p>Side note.</p></div>'
    for name in ("layout has-sidebar", "content-with-sidebar", "content with-sidebar", "post has-comments", "social-policy", "no-comments", "has-header"):
        assert html_extract.extract(f'<body><div class="{name}"><article>{prose}</article>{side}</div></body>', None) == text
        assert html_extract.extract(f'<body><div class="{name}"><div>{prose}</div>{side}</div></body>', None) == text
    talk = '<div class="comments"><article class="reply">' + "<p>A reader says a great deal about all this.</p>" * 3 + "</article></div>"
    assert html_extract.extract(f"<body><article>{prose}{talk}</article></body>", None) == text
    for tag in ("<title>", "<button>", "<video src=x>", "<svg/>", "<button-group>", "<title-bar>", "<svg><svg></svg><g></svg>", "<select><option>one</select>"):
        assert html_extract.extract(f"<body><div>{tag}{prose}</div></body>", None) == text, tag
    deep = [f'<div class="{"u" * 600}"><div class="a{n}">{prose}</div></div>' for n in range(2)]
    paths = {html_extract.best_container(*html_extract.parse(x)).path for x in deep}
    assert len(paths) == 1 and None not in paths and html_extract.extract(deep[0], paths.pop()) == text


def test_token_bytes_equal_the_tokenizer():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(1)
    latin = [chr(c) for c in range(1, 256)] + list("aaab'''stdlmrev  \n12") * 8
    odd = latin + ["́", "Σ", "İ", " ", "😀", "中", "<|endoftext|>", "\x1c", "ﬁ"] * 6
    texts = ["".join(rng.choices(latin if k % 2 else odd, k=rng.randint(0, 40))) for k in range(3000)] + [None, ""]
    for text, ids in zip(texts, packing.token_bytes(texts, tokenizer_path())):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text or "", add_special_tokens=False).ids


def test_packing(spark, docs, rows):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    out = packing.pack(docs, tokenizer_path()).collect()
    expected = Counter()
    for d, text in rows:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            expected[d, k // 4096, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == expected
    assert_packed([(r.sequence_id, r.offset, r.length) for r in out], 4096)
    total = sum(r.length for r in out)
    assert len({r.sequence_id for r in out}) <= math.ceil(total / 4096) + 1
    alone = packing._Open(4096)
    alone.best_fit(dict(Counter(r.length for r in out)))
    assert len({r.sequence_id for r in out}) <= sum(count for _, count in alone.sequences())
    assert packing.pack(docs.where("false"), tokenizer_path()).count() == 0


def assert_packed(places, limit):
    end = {}
    for sequence, offset, length in sorted(places):
        assert offset == end.get(sequence, 0)
        end[sequence] = offset + length
    assert max(end.values(), default=0) <= limit


def test_plans_use_up_every_length():
    rng = random.Random(6)
    for _ in range(40):
        histogram = Counter(rng.choice([rng.randint(1, 4096), rng.randint(1, 300), 4096, 1365]) for _ in range(rng.randint(1, 900)))
        made = Counter()
        sequences = packing.plan(dict(histogram))
        for lengths, count in sequences:
            assert sum(lengths) <= 4096 and count > 0
            for n in lengths:
                made[n] += count
        assert made == histogram
    assert packing.plan({}) == []


def test_nnls_meets_its_conditions():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.random((12, 20)), rng.normal(size=12)
        x = packing.nnls(a, b)
        grad = a.T @ (b - a @ x)
        assert x.min() >= 0 and grad.max() < 1e-6 and np.abs(grad[x > 1e-9]).max(initial=0) < 1e-6


def luhn(d):
    return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(x):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for kind, rank, pattern in (("card", 2, r"[0-9]([\x20-]?[0-9])+"), ("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, x):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "card" and 14 <= len(d) <= 19 and luhn(d) or kind == "phone" and 10 <= len(d) <= 15:
                out.append((m.start(), rank, kind, m.end()))
    return ",".join(f"{k}:{a}:{e}" for a, _, k, e in sorted(out))


def test_pii(spark, docs, rows):
    rng = random.Random(9)
    pool = ["a@b.co", "@", ".", "_x@d.com", "1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (555) 123-4567", "+", "0", "9", " ", "-", "😀", "é", "256", "\n", "(", "x"]
    more = [(50_000 + i, "".join(rng.choices(pool, k=rng.randint(1, 25)))) for i in range(400)]
    more += [(60_000, "1" * 20_000 + "a" * 20_000 + "@"), (60_001, "a@b.c " * 500), (60_002, "mail a@b.cd 1.2.3.4, " * 20_000)]
    every = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    out = pii.pii_report(every.withColumn("email", F.lit(1)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    got = Counter((r.doc_id, r.base_sha256) for r in out.collect())
    assert got == Counter((d, hashlib.sha256(brute_pii(t or "").encode()).hexdigest()) for d, t in rows + more)


def test_pii_added_spans(spark):
    text = "Bank account GB82 WEST 1234 5698 7654 32, wrong GB82 WEST 1234 5698 7654 33, card 4111111111111111 mail x@y.zz"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = pii.pii_report(df).first()
    assert r.spans == "iban:13:40,card:82:98,email:104:110" and (r.n_card, r.n_email, r.n_ip, r.n_phone) == (1, 1, 0, 0)
    assert r.scores.split(",")[0] == "0.95"
    assert pii.redact(df).first().text == "Bank account <iban>, wrong GB82 WEST 1234 5698 7654 33, card <card> mail <email>"


@pytest.mark.parametrize("shard", [8192, 60])
def test_nearest_neighbours(spark, shard):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(900, 16)) + 4 * rng.normal(size=(12, 16))[rng.integers(12, size=900)]
    data[200:400] = data[7]
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    rows += [(1000, None), (1100, [0.0] * 16), (1200, [float("nan")] * 16), (1300, [1.0] * 15 + [None]), (1400, []), (None, [1.0] * 16), (1500, [2.0] * 3), (5, data[5].tolist())]
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("vector", F.lit(1)), shard=shard).collect()
    hits = total = 0
    for q in range(0, 900, 100):
        d = np.sqrt(((data - data[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(900), d)) if i != q][:10]
        mine = sorted((r.rank, r.vec_id, r.score) for r in out if r.query_id == q)
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert all(abs(s - d[i]) < 1e-12 for _, i, s in mine) and mine == sorted(mine, key=lambda x: (x[2], x[1]))
        hits += len(set(order) & {i for _, i, _ in mine})
        total += 10
    assert hits / total >= 0.9
    assert not any(r.query_id in (1000, 1100, 1200, 1300, 1400, 1500) for r in out)


def test_pipeline(spark, sf):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        given = docs.columns
        docs = tables.cut(stage(spark, docs, sf), name)
        if name != "packing":
            assert docs.columns == given
            sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.6 * sizes[0]
    assert_packed([(r.sequence_id, r.offset, r.length) for r in docs.collect()], 4096)
    empty = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
        assert empty.count() == 0
